"""Time expressions that do not depend on the session's zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def epoch_micros(ts: Column | str) -> Column:
    """Microseconds since 1970-01-01 of a timestamp without zone (null stays null)."""
    c = (F.col(ts) if isinstance(ts, str) else ts).cast("timestamp_ntz")
    days = F.unix_date(c.cast("date")).cast("bigint")
    seconds = F.hour(c).cast("bigint") * 3600 + F.minute(c) * 60
    micros = (F.extract(F.lit("SECOND"), c) * F.lit(1_000_000)).cast("bigint")
    return days * F.lit(86_400_000_000) + seconds * F.lit(1_000_000) + micros


def month_of(ts: Column | str) -> Column:
    """``yyyy-MM`` of a timestamp."""
    return F.date_format(F.col(ts) if isinstance(ts, str) else ts, "yyyy-MM")
