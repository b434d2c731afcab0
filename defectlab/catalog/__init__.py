"""All registered queries and, where SQL can say it, the same in ANSI SQL."""

from defectlab.catalog import changes, examples, features, metrics, models, storage, text  # noqa: F401
from defectlab.catalog.registry import QUERIES, SQL  # noqa: F401
