"""Beyond batch use: projections and masks are stateless expressions, so they run on streams as they are; n(z) is a
windowed count with a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def streaming_nz(rows: DataFrame, time: str, z: str, low: float, width: float, window: str = "1 day", late: str = "1 hour") -> DataFrame:
    """(window start, bin, counts) of a stream or a table."""
    w = F.window(time, window)
    k = F.floor((F.col(z) - low) / width).cast("int")
    return rows.withWatermark(time, late).groupBy(w.alias("w"), k.alias("bin")).agg(F.count("*").alias("counts")).select(F.col("w.start").alias("start"), "bin", "counts")
