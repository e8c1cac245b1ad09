"""Scoring and monitoring of streams. Mining stays a batch job; a stream is scored by the generated columns of a fit."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lodestone.operators.mining import Fit, pattern_columns


def scored(stream: DataFrame, fit: Fit, weights: Sequence[float], intercept: float = 0.0) -> DataFrame:
    """stream with p, a logistic score of the fit's patterns: a stateless projection."""
    wide = pattern_columns(stream, fit)
    z = sum((F.lit(float(w)) * F.col(f"p{k}") for k, w in enumerate(weights)), F.lit(float(intercept)))
    return wide.withColumn("p", 1 / (1 + F.exp(-z))).select(*stream.columns, "p")


def windowed(stream: DataFrame, ts: str, value: str, every: str = "1 hour", late: str = "10 minutes", by: Sequence[str] = ()) -> DataFrame:
    """Counts and moments in tumbling windows; rows later than `late` are left out once the window is closed."""
    typed = stream.withColumn(ts, F.col(ts).cast("timestamp"))
    w = typed.withWatermark(ts, late).groupBy(F.window(ts, every).alias("w"), *by)
    return w.agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.min(value).alias("low"), F.max(value).alias("high"), F.stddev_samp(value).alias("spread")).select(F.col("w.start").alias("start"), *by, "n", "mean", "low", "high", "spread")


def to_table(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Start writing a stream as Parquet, all that is there at once and then no more; a restart continues from the checkpoint."""
    return stream.writeStream.outputMode(mode).format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
