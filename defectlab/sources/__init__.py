from defectlab.sources.readers import *  # noqa: F401,F403
from defectlab.sources.writers import *  # noqa: F401,F403
