"""Parsing and rates over streams of responses."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracemill.functions.text import unused
from tracemill.operators.model import ModelInfo
from tracemill.operators.parse import parse
from tracemill.operators.stats import RATES


def windowed_rates(stream: DataFrame, info: ModelInfo, time: str = "ts", response: str = "response", width: str = "1 hour", lateness: str = "10 minutes") -> DataFrame:
    """Counts and rates of outcomes by window of event time; works on batches and streams alike.

    A timestamp without a zone is taken as UTC whatever the session's zone, as a watermark needs an instant.
    """
    at, window = unused(stream.columns, "ts", "window")
    instant = F.col(time)
    if stream.schema[time].dataType.simpleString() == "timestamp_ntz":
        instant = F.convert_timezone(F.lit("UTC"), F.current_timezone(), instant)
    rows = parse(stream.withColumn(at, instant.cast("timestamp")), response, info)
    rates = [F.avg(F.col(flag).cast("double")).alias(name) for name, flag in RATES.items()]
    by = rows.withWatermark(at, lateness).groupBy(F.window(at, width).alias(window))
    return by.agg(F.count("*").alias("total"), *rates).select(F.col(f"{window}.start").alias("window_start"), "total", *RATES)


def each_batch(stream: DataFrame, info: ModelInfo, summarise: Callable[[DataFrame], DataFrame], sink: Callable[[DataFrame, int], None], response: str = "response"):
    """A writer that parses each micro-batch and hands ``summarise`` of it (macro averages, say) to ``sink``."""
    return stream.writeStream.foreachBatch(lambda batch, n: sink(summarise(parse(batch, response, info)), n))
