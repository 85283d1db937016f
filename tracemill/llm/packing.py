"""Best-fit packing of token sequences, certified by lower bounds.

Pieces are dealt to partitions of bounded size; each is packed by best-fit decreasing and gets a
lower bound from dual-feasible functions. A partition whose bins meet the bound is done. Partitions
with a gap exchange what lies in their bins that are not full: these pieces are dealt anew over
half as many partitions for their number and packed again, and the new bins stand if they are fewer.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracemill.llm._io import cut, discard, small_batches, turn_to
from tracemill.llm._text import blocks, buffers
from tracemill.llm.tokens import encoder

#: Pieces of a partition on average, twice and four times as many in the rounds of exchange; what one task packs.
PARTITION = 200_000


def best_fit_decreasing(lengths: np.ndarray, room: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each piece: longest first, each into the fullest bin that takes it."""
    order = np.argsort(-lengths, kind="stable")
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    open_bins: list[list[int]] = [[] for _ in range(room + 1)]  # by what is left
    some = 0  # bit r: a bin with r left
    made = 0
    for i, n in zip(order.tolist(), lengths[order].tolist()):
        fits = some >> n
        if fits and n:
            left = n + (fits & -fits).bit_length() - 1
            b = open_bins[left].pop()
            if not open_bins[left]:
                some ^= 1 << left
        else:
            left, b = room, made
            made += 1
        bins[i], offsets[i] = b, room - left
        left -= n
        if left:
            open_bins[left].append(b)
            some |= 1 << left
    return bins, offsets


def lower_bound(lengths: np.ndarray, room: int) -> int:
    """The most of three families of dual-feasible functions: the sum of sizes, thresholds that count
    large pieces whole, and rounding by k + 1 parts. No packing has fewer bins."""
    hist = np.bincount(lengths, minlength=room + 1).astype(np.int64)[: room + 1]
    size = np.arange(room + 1)
    best = -(-int((hist * size).sum()) // room)
    count, weight = np.r_[0, np.cumsum(hist)], np.r_[0, np.cumsum(hist * size)]
    half = room // 2
    for a in range(1, half + 1):
        large, middle = int(count[-1] - count[room - a + 1]), int(count[room - a + 1] - count[half + 1])
        free = middle * room - int(weight[room - a + 1] - weight[half + 1])
        small = int(weight[half + 1] - weight[a])
        best = max(best, large + middle + max(0, -(-(small - free) // room)))
    for k in range(2, 21):
        parts = (k + 1) * size
        value = np.where(parts % room == 0, size * k, parts // room * room)  # times k * room
        best = max(best, -(-int((hist * value).sum()) // (k * room)))
    return best


def cut_and_digest(df: DataFrame, tokenizer: str, words_only: bool, end_id: int, room: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of each whole text's ids with the end id: id, copy, piece, start, length, ids_crc32.

    Only what is longer than ``room`` is cut; the first piece takes the remainder. Null and empty texts have the end id alone;
    rows with a null id, and repeated rows, have pieces each, which ``copy`` tells apart. Other columns are ignored; an
    empty table gives an empty one.
    """
    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer, words_only)
        for batch in batches:
            buf, offsets = buffers(batch.column(2))
            for first, last in blocks(offsets):
                ids, n = enc.encode(buf[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first])
                counts = n + 1
                raw = memoryview(np.insert(ids, np.cumsum(n), end_id).astype("<u4").tobytes())
                doc, piece, start, length, crc = [], [], [], [], []
                begin = 0
                for d, count in enumerate(counts.tolist(), first):
                    at, k = 0, 0
                    while at < count:
                        to = at + ((count % room or room) if not at else room)
                        doc.append(d)
                        piece.append(k)
                        start.append(at)
                        length.append(to - at)
                        crc.append(zlib.crc32(raw[4 * (begin + at) : 4 * (begin + to)]))
                        at, k = to, k + 1
                    begin += count
                take = pa.array(doc, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(take), batch.column(1).take(take), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                    names=["id", "copy", "piece", "start", "length", "ids_crc32"],
                )

    rows = df.select(F.col(id_col).cast("long").alias("id"), F.monotonically_increasing_id().alias("copy"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "id long, copy long, piece int, start long, length long, ids_crc32 long")


_PACKED = "id long, copy long, piece int, start long, length long, ids_crc32 long, round int, part int, bin long, offset long, bins long, bound long, fill long"


def _packed(pieces: DataFrame, room: int, turn: int, parts: int) -> DataFrame:
    def one(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        turn_to("packing")
        lengths = rows["length"].to_numpy()
        bins, offsets = best_fit_decreasing(lengths, room)
        rows = rows[["id", "copy", "piece", "start", "length", "ids_crc32"]].copy()
        rows["round"], rows["part"], rows["bin"], rows["offset"] = turn, key[0], bins, offsets
        rows["bins"], rows["bound"] = int(bins.max()) + 1, lower_bound(lengths, room)
        rows["fill"] = np.bincount(bins, lengths).astype(np.int64)[bins]
        return rows

    part = F.pmod(F.xxhash64("copy", "piece", F.lit(turn)), F.lit(parts)).cast("int")
    return pieces.withColumn("_part", part).groupBy("_part").applyInPandas(one, _PACKED)


def pack(pieces: DataFrame, room: int = 1024, rounds: int = 2) -> DataFrame:
    """Pieces (as of :func:`cut_and_digest`) -> with sequence_id and offset, in few sequences of ``room``.

    Every piece is in exactly one sequence; offsets in a sequence leave no gap. An empty table gives
    an empty one. A partition's size is bounded whatever the lengths, copies or sources.
    """
    n = pieces.count()
    now = cut(_packed(pieces, room, 0, -(-n // PARTITION) or 1), "packed")
    # a piece's row says how its partition did, and one piece of each bin lies at its start: no join, no distinct bins
    gap, in_loose_bin, first = F.col("bins") > F.col("bound"), F.col("fill") < room, F.col("offset") == 0
    for turn in range(1, rounds + 1):
        found = now.filter(gap).agg(
            F.count_distinct("round", "part").alias("parts"), F.count_if(in_loose_bin).alias("pieces"), F.count_if(in_loose_bin & first).alias("bins")
        ).first()
        if found["parts"] < 2 or not found["pieces"]:
            break
        again = cut(_packed(now.filter(gap & in_loose_bin), room, turn, -(-found["pieces"] // (PARTITION << turn))), "repacked")
        if again.filter(first).count() >= found["bins"]:
            discard(again)
            break
        now = now.filter(~(gap & in_loose_bin)).unionByName(again)
    sequence = F.shiftleft(F.col("round").cast("long"), 58).bitwiseOR(F.shiftleft(F.col("part").cast("long"), 30)).bitwiseOR(F.col("bin"))
    return now.select("id", "piece", "start", "length", "ids_crc32", sequence.alias("sequence_id"), "offset")
