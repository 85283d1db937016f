"""Sharding by sampled splitters, with DataFrame functions only.

Records are ordered by (hash of the text, id), so equal texts lie side by side. A size-weighted
sample of hashes gives quantile boundaries; records are dealt to the ranges between them; a range
that came out overfull (a group of equal texts may hold a third of all bytes) is subdivided by a
hash of the id. Exact sums over the ranges then place every record on a line of bytes, which is
cut into equal shards. A group of equal texts that is small against a shard is never cut.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracemill.llm._io import cut, rank_in

MOST_RANGES = 8192


def shard_records(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shards: int = 24,
    overhead: int = 8,
    ranges_per_shard: int = 32,
    sample_per_range: int = 32,
    group_share: float = 0.01,
) -> DataFrame:
    """Place every row of ``df`` into one of ``shards`` shards of nearly equal bytes.

    Returns id_col, size, text_crc32, shard, slot. ``size`` is the text's UTF-8 bytes plus
    ``overhead``; a null text counts as none and as an empty text. Slots count from 0 without gaps
    in each shard. Repeated rows each get a slot of their own; null ids are placed like any other;
    ties in (hash, id) are in arbitrary but gapless order. An empty table gives an empty result;
    other columns are ignored.

    The sample holds about shards * ranges_per_shard * sample_per_range keys (25k) whatever the
    input, more only through rows larger than a sampling step; the ranges number at most twice
    ``MOST_RANGES``, so what reaches the driver is bounded.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = cut(
        df.select(
            F.col(id_col).alias("_id"),
            (F.octet_length(text) + F.lit(overhead)).cast("long").alias("_size"),
            F.crc32(text.cast("binary")).alias("_crc"),
            F.shiftright(F.xxhash64(text), 12).alias("_key"),  # 52 bits: a double holds them
        ),
        "shard-rows",
    )
    total, count = rows.agg(F.sum("_size"), F.count("*")).first()
    total = total or 1
    ranges = min(MOST_RANGES, max(shards * ranges_per_shard, count // 500_000))

    rate = ranges * sample_per_range / total
    unit = F.pmod(F.xxhash64("_id", "_key", F.lit(77)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    sample = rows.select("_key", F.floor(F.col("_size") * F.lit(rate) + unit).alias("_n")).filter("_n > 0")
    cuts = [i / ranges for i in range(1, ranges)]
    found = sample.agg(F.percentile("_key", F.array(*map(F.lit, cuts)), F.col("_n")).alias("q")).first()["q"]
    splitters = sorted({int(q) for q in found or []})

    ranged = rows.withColumn("_range", rank_in(splitters, F.col("_key")))
    share = total / ranges
    parts = {r["_range"]: int(r["b"] / share) + 1 for r in ranged.groupBy("_range").agg(F.sum("_size").alias("b")).collect() if r["b"] > 1.5 * share}
    sub = F.lit(0)
    if parts:
        n_parts = F.create_map(*[F.lit(x) for kv in parts.items() for x in kv])[F.col("_range")]
        lowest = F.get(F.array(*[F.lit(s) for s in splitters or [0]]), F.col("_range") - 1)
        dealt = F.pmod(F.xxhash64("_id", F.lit(5)), n_parts.cast("long")).cast("int")
        # a text that overfills a range is a splitter itself; the others of its range stay together
        sub = F.coalesce(F.when(F.col("_key") == lowest, dealt), F.lit(0))
    ranged = cut(ranged.withColumn("_sub", sub), "shard-ranges")

    cells = ranged.groupBy("_range", "_sub").agg(F.sum("_size").alias("b"), F.count("*").alias("n")).collect()
    at_bytes, at_rows, start = 0, 0, []
    for c in sorted(cells, key=lambda c: (c["_range"], c["_sub"])):
        start.append((c["_range"], c["_sub"], at_bytes, at_rows))
        at_bytes, at_rows = at_bytes + c["b"], at_rows + c["n"]
    spark = df.sparkSession
    starts = spark.createDataFrame(start, "_range int, _sub int, _b0 long, _r0 long")

    cell = Window.partitionBy("_range", "_sub")
    line = cell.orderBy("_key", "_id")
    group = Window.partitionBy("_range", "_sub", "_key")
    placed = (
        ranged.withColumn("_n", F.row_number().over(line) - 1)
        .withColumn("_at", F.sum("_size").over(line.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_size"))
        .withColumn("_group", F.sum("_size").over(group))
        .withColumn("_from", F.min("_at").over(group))
        .join(F.broadcast(starts), ["_range", "_sub"])
    )
    at = F.when(F.col("_group") <= F.lit(group_share * total / shards), F.col("_from")).otherwise(F.col("_at"))
    placed = cut(
        placed.select(
            "_id", "_size", "_crc",
            F.least(F.lit(shards - 1), F.floor((F.col("_b0") + at) * F.lit(shards) / F.lit(float(total)))).cast("int").alias("shard"),
            (F.col("_r0") + F.col("_n")).alias("_row"),
        ),
        "shard-placed",
    )
    first = {r["shard"]: r["f"] for r in placed.groupBy("shard").agg(F.min("_row").alias("f")).collect()}
    base = F.create_map(*[F.lit(x).cast("long") for kv in first.items() for x in kv])[F.col("shard").cast("long")] if first else F.lit(0).cast("long")
    return placed.select(
        F.col("_id").alias(id_col),
        F.col("_size").alias("size"),
        F.col("_crc").alias("text_crc32"),
        "shard",
        (F.col("_row") - base).alias("slot"),
    )
