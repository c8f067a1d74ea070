from checks import cleaning, composed, matching, mining, profiling  # noqa: F401
from checks.registry import ORACLES, QUERIES  # noqa: F401
