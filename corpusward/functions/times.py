"""Time arithmetic in whole microseconds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def micros(ts: Column) -> Column:
    """Microseconds since the epoch; takes timestamps with and without time zone."""
    return F.unix_micros(ts.cast("timestamp"))
