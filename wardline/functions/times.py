"""Time texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from wardline.functions.casts import as_column


def iso_text(at: str | Column) -> Column:
    """Microseconds since 1970 as ISO text in UTC; the fraction is written only when there is one."""
    instant = F.timestamp_micros(as_column(at))
    fraction = F.date_format(instant, "SSSSSS")
    return F.concat(
        F.date_format(instant, "yyyy-MM-dd'T'HH:mm:ss"),
        F.when(fraction != "000000", F.concat(F.lit("."), fraction)).otherwise(""),
        F.lit("+00:00"),
    )
