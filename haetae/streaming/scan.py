"""Detection and masking on streams: the batch expressions as they are, and windowed counts with a watermark."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from haetae import rules as catalog
from haetae.operators.detect import detect
from haetae.operators.mask import mask_text


def detect_stream(stream: DataFrame, keys: list[str], text_col: str = "text", rules: catalog.RuleSet | None = None) -> DataFrame:
    """Findings of a stream, row by row and without state; ``keys`` may hold the event time."""
    return detect(stream, keys, text_col, rules)


def mask_stream(stream: DataFrame, text_col: str = "text", mode: str = "full", rules: catalog.RuleSet | None = None) -> DataFrame:
    """A stream with its text masked in place."""
    masked = mask_text(stream, text_col, "__masked__", mode, rules)
    return masked.withColumn(text_col, F.col("__masked__")).drop("__masked__")


def windowed_counts(found: DataFrame, time_col: str, window: str = "1 hour", late: str = "10 minutes", slide: str | None = None) -> DataFrame:
    """Findings per window, rule and confidence; rows later than ``late`` are dropped by the watermark, as is usual for streams."""
    by: Column = F.window(time_col, window, slide) if slide else F.window(time_col, window)
    counted = found.withWatermark(time_col, late).groupBy(by.alias("w"), "rule_id", "confidence").agg(F.count("*").alias("n"))
    return counted.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "rule_id", "confidence", "n")


def run_available(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Everything there is now in micro-batches to ``sink``; starting again goes on where it stopped."""
    query = stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query
