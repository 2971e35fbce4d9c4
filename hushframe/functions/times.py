"""Times as numbers."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def millis(ts: Column) -> Column:
    """Milliseconds since 1970, rounded half away from zero, as SQL's epoch_ms does: unix_millis cuts off."""
    return F.call_function("div", F.round(F.unix_micros(ts), -3), F.lit(1000))
