"""Document fingerprints: one-permutation MinHash with optimal densification, in packed low bits.

A text's shingles of five words are hashed once; the high bits choose one of ``BINS`` bins and each
bin keeps its least hash. An empty bin borrows from a full bin found by hashing (bin, attempt), as
optimal densification does. Of every bin ``BITS`` low-order bits are stored; the estimate takes
off the matches that chance gives.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracemill.llm._io import rank_in, small_batches
from tracemill.llm._text import blocks, mix, pack, shingles, span_hashes, spans

BINS, BITS, WIDTH = 256, 8, 5
#: Ranges of ids at most: their boundaries are literals of the plan; rows stream through a range, however many it has.
MOST_RANGES = 16_384
_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)


def _donors(attempt: int) -> np.ndarray:
    """The bin that each bin asks at an attempt; the same for every text."""
    x = np.arange(BINS, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64((attempt + 1) * 0xD1B54A32D192ED03 % (1 << 64))
    return (mix(x) % np.uint64(BINS)).astype(np.int64)


def sketches(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(texts x BINS low-order bytes, whether a text has words). A text without words is all zeros."""
    out, full = np.zeros((len(texts), BINS), np.uint8), np.zeros(len(texts), bool)
    buf_all, offsets_all = pack(texts)
    for a, b in blocks(offsets_all):
        offsets = offsets_all[a : b + 1] - offsets_all[a]
        buf = buf_all[offsets_all[a] : offsets_all[b]]
        starts, ends = spans(buf, offsets)
        counts = np.diff(np.searchsorted(starts, offsets))
        h, n = shingles(span_hashes(buf, starts, ends), counts, WIDTH)
        least = np.full((b - a) * BINS, _EMPTY, np.uint64)
        if len(h):
            cell = np.repeat(np.arange(b - a), n) * BINS + (h >> np.uint64(56)).astype(np.int64) % BINS
            order = np.argsort(cell, kind="stable")
            first = np.flatnonzero(np.r_[True, np.diff(cell[order]) > 0])
            least[cell[order][first]] = np.minimum.reduceat(h[order], first)
        least = least.reshape(b - a, BINS)
        own = least != _EMPTY
        full[a:b] = own.any(axis=1)
        dense, todo, attempt = least.copy(), ~own & full[a:b, None], 0
        while todo.any():
            donor = _donors(attempt)
            rows = np.flatnonzero(todo.any(axis=1))
            got = own[rows][:, donor] & todo[rows]
            dense[rows] = np.where(got, least[rows][:, donor], dense[rows])
            todo[rows] &= ~got
            attempt += 1
        out[a:b] = np.where(full[a:b, None], dense, 0).astype(np.uint8)
    return out, full


def likeness(a: np.ndarray, a_full: np.ndarray, b: np.ndarray, b_full: np.ndarray) -> np.ndarray:
    """Estimated Jaccard likeness, row by row: matches less those that chance gives, in [0, 1].
    Two texts without words are alike (1); one without words is unlike any other (0)."""
    chance = 1.0 / (1 << BITS)
    est = np.clip(((a == b).mean(axis=1) - chance) / (1 - chance), 0.0, 1.0)
    return np.where(a_full & b_full, est, (a_full == b_full).astype(float))


def _cut_at_half(text: str, following: str) -> str:
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


SCHEMA = (
    "id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
)


def fingerprint_with_next(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of each text and of its edited text, made with the next one in descending id order.

    The ids are cut into ranges by approximate quantiles; a range's rows meet in one partition, in
    order, and stream through it. The first row of each range is sent to the range above too, as
    what follows that range's last row; the greatest id follows the least. Only that one shuffle
    moves texts, and no task holds more than a batch of them.

    Null texts are empty; rows with a null id stand after all others; equal ids stand in the order
    of their texts' hashes. One row alone is followed by itself. An empty table gives an empty one.
    """
    spark = df.sparkSession
    small_batches(spark)
    last = -(1 << 63)
    rows = df.select(
        F.col(id_col).cast("long").alias("id"),
        F.coalesce(F.col(id_col).cast("long"), F.lit(last)).alias("_o"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
    )
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ids = df.select(F.coalesce(F.col(id_col).cast("long"), F.lit(last)).alias("_o"))
    ranges = min(MOST_RANGES, 4 * parts)
    cuts = [i / ranges for i in range(1, ranges)]
    found = ids.agg(F.percentile_approx("_o", F.array(*map(F.lit, cuts)), 20_000).alias("q")).first()["q"]
    splitters = sorted(set(found or []))
    bucket = rank_in(splitters, F.col("_o"))
    tops = {r["b"]: r["top"] for r in ids.groupBy(bucket.alias("b")).agg(F.max("_o").alias("top")).collect()}
    order = sorted(tops)
    width = (order[-1] if order else 0) + 1
    top = F.get(F.array(*[F.lit(tops.get(b)).cast("long") for b in range(width)]), bucket)
    above = dict(zip(order, order[1:] + order[:1]))  # the top of a range follows the range above, the greatest follows the least
    to = F.get(F.array(*[F.lit(above.get(b)).cast("int") for b in range(width)]), bucket)
    target = F.when(F.col("_o") == top, to)
    own = F.struct(bucket.alias("b"), F.lit(False).alias("fed"))
    fed = F.struct(target.alias("b"), F.lit(True).alias("fed"))
    sent = rows.withColumn("_to", F.explode(F.when(target.isNotNull(), F.array(own, fed)).otherwise(F.array(own))))
    sent = (
        sent.select("_to.b", "_to.fed", "_o", "id", "text")
        .repartition(parts, "b")
        .sortWithinPartitions("b", "fed", F.desc("_o"), F.xxhash64("text"))
    )

    def results(ids: list, texts: list[str], follow: list[str]) -> pa.RecordBatch:
        edited = [_cut_at_half(t, f).encode() for t, f in zip(texts, follow)]
        raw = [t.encode() for t in texts]
        mine, full = sketches([*raw, follow[-1].encode()])
        other, other_full = sketches(edited)
        text_of = lambda m: [x.tobytes().hex() for x in m]
        return pa.RecordBatch.from_arrays(
            [
                pa.array(ids, pa.int64()), pa.array([len(t) for t in texts], pa.int64()),
                pa.array([hashlib.sha256(e).hexdigest() for e in edited]),
                pa.array(text_of(mine[:-1])), pa.array(text_of(other)),
                pa.array(likeness(mine[:-1], full[:-1], other, other_full)), pa.array(likeness(mine[:-1], full[:-1], mine[1:], full[1:])),
            ],
            names=[c.split()[0] for c in SCHEMA.split(", ")],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_b, held_id, held_text = [], [], []
        ready_b = None
        for batch in batches:
            b, fed = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            ids, texts = batch.column(3).to_pylist(), batch.column(4).to_pylist()
            out_id, out_text, out_next = [], [], []
            for k in range(len(b)):
                if held_b and held_b[0] == b[k]:
                    out_id.append(held_id.pop())
                    out_text.append(held_text.pop())
                    out_next.append(texts[k])
                    held_b.pop()
                if fed[k]:
                    ready_b = b[k]
                elif b[k] != ready_b:
                    held_b, held_id, held_text = [b[k]], [ids[k]], [texts[k]]
            at = 0
            while at < len(out_id):  # runs in which each text follows the one before
                to = at + 1
                while to < len(out_id) and out_next[to - 1] is out_text[to] and to - at < 1000:
                    to += 1
                yield results(out_id[at:to], out_text[at:to], out_next[at:to])
                at = to

    return sent.mapInArrow(run, SCHEMA)
