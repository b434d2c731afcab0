from defectlab.plans.ranks import (  # noqa: F401
    hash_holdout,
    hash_rank,
    ordered_rank,
    running,
    spread_buckets,
)
from defectlab.plans.skew import bounded_rows, group_join, skew_join, summary_join  # noqa: F401
