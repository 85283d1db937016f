"""SimHash near-duplicates found by pigeonring filtering.

The 64 bits lie on a ring of five segments. If two fingerprints differ in at most 4 bits, some
chain of consecutive segments stays within its proportional budget at every length: 0 differing
bits in the first segment, 1 in two, 2 in three, 3 in four, 4 in all. So the first segment is
equal, and of what follows it in a chain of n segments, which may differ in n - 1 bits, n - 1 + e
parts are equal in e at least: the segment and e parts are the key of an index. The chain is the
longer the more fingerprints there are, so that a key holds about as many of them at any size.
Within a key the longer chains are tested in turn, and only what passes them gets the full
Hamming check.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracemill.llm._io import cut, small_batches, turn_to
from tracemill.llm.components import components

#: (first bit, bits) of the ring's segments, and how many bits two fingerprints may differ in.
SEGMENTS = ((0, 13), (13, 13), (26, 13), (39, 13), (52, 12))
MOST_DIFFERENT = 4
#: (fingerprints at most, segments of a key's chain, parts of it that must be equal): keys of 18, 24 and 30 bits at least,
#: of which a fingerprint has 10, 30 and 100.
LEVELS = ((1 << 24, 2, 1), (1 << 31, 3, 2), (1 << 62, 4, 3))
#: Bits of an index key below its number.
KEY_BITS = 40
_LANES = np.uint64(0x0101010101010101)


def fingerprints(texts: list[str | None], width: int = 4) -> np.ndarray:
    """Unsigned 64-bit SimHashes of shingles of ``width`` words, repeats included.

    A-Z are lower-cased; words are runs of other than ASCII white space; a text of fewer words is
    one shingle; without words (or null) the fingerprint is zero. A bit is set if it is set in more
    than half of the shingles' XXH64 (seed 42).
    """
    digest = xxhash.xxh64_intdigest
    hashes, counts = [], np.zeros(len(texts), np.int64)
    for i, text in enumerate(texts):
        words = (text or "").encode("utf-8", "surrogatepass").lower().split()
        if not words:
            continue
        joined = b" ".join(words)
        ends = np.cumsum([len(w) + 1 for w in words]) - 1
        n = max(1, len(words) - width + 1)
        starts = [0, *(ends[: n - 1] + 1).tolist()]
        stops = ends[min(width, len(words)) - 1 :].tolist()
        counts[i] = n
        hashes.append(np.array([digest(joined[a:b], 42) for a, b in zip(starts, stops)], np.uint64))
    out = np.zeros(len(texts), np.uint64)
    if not hashes:
        return out
    flat, full = np.concatenate(hashes), np.flatnonzero(counts)
    # bits are summed in eight byte lanes at a time, in blocks of 255 shingles at most
    first = np.concatenate([np.arange(s, s + n, 255) for s, n in zip(np.cumsum(counts[full]) - counts[full], counts[full])])
    doc_block = np.concatenate([[0], np.cumsum(-(-counts[full] // 255))[:-1]])
    half = counts[full]
    fp = np.zeros(len(full), np.uint64)
    for k in range(8):
        lanes = np.add.reduceat((flat >> np.uint64(k)) & _LANES, first)
        sums = np.add.reduceat(lanes.view(np.uint8).reshape(-1, 8).astype(np.int64), doc_block, axis=0)
        for byte in range(8):
            fp |= (2 * sums[:, byte] > half).astype(np.uint64) << np.uint64(8 * byte + k)
    out[full] = fp
    return out


def add_fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp long) of every row; the long holds the unsigned fingerprint's bits."""
    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn_to("simhash")
        for batch in batches:
            fp = fingerprints(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp.view(np.int64))], names=["id", "fp"])

    return df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "id long, fp long")


def _bits(start: int, n: int) -> np.uint64:
    return np.uint64(((1 << n) - 1) << start)


def ring_keys(chain: int = 2, equal: int = 1) -> list[tuple[int, list[list[tuple[int, int]]]]]:
    """(first segment, the parts that must be equal, each a list of bit ranges) of each key: a segment, and ``equal`` of the
    parts of the rest of a chain of ``chain`` segments from there, which are more by the bits that may differ in it."""
    keys = []
    for i, seg in enumerate(SEGMENTS):
        bits = [b for j in range(1, chain) for s, n in [SEGMENTS[(i + j) % len(SEGMENTS)]] for b in range(s, s + n)]
        n_parts = chain * MOST_DIFFERENT // len(SEGMENTS) + equal
        parts = [_ranges(bits[len(bits) * p // n_parts : len(bits) * (p + 1) // n_parts]) for p in range(n_parts)]
        keys += [(i, [[seg], *chosen]) for chosen in itertools.combinations(parts, equal)]
    return keys


def _ranges(bits: list[int]) -> list[tuple[int, int]]:
    """(first bit, bits) of the runs in a list of bits."""
    out: list[tuple[int, int]] = []
    for b in bits:
        if out and sum(out[-1]) == b:
            out[-1] = (out[-1][0], out[-1][1] + 1)
        else:
            out.append((b, 1))
    return out


def _ring_masks(first: int) -> list[tuple[np.uint64, int]]:
    """(bits of the chain, budget) for chains of 2 to 5 segments from ``first``."""
    out, mask = [], np.uint64(0)
    for length in range(1, len(SEGMENTS) + 1):
        mask |= _bits(*SEGMENTS[(first + length - 1) % len(SEGMENTS)])
        if length > 1:
            out.append((mask, length * MOST_DIFFERENT // len(SEGMENTS)))
    return out


def _linked(a: np.ndarray, b: np.ndarray, masks: list[tuple[np.uint64, int]]) -> np.ndarray:
    """Positions where a and b stay within every chain's budget; the last chain is the whole ring."""
    at = np.arange(len(a))
    x = a ^ b
    for mask, budget in masks:
        keep = np.bitwise_count(x & mask) <= budget
        at, x = at[keep], x[keep]
    return at


def _links_of(fp: np.ndarray, rep: np.ndarray, masks: list) -> tuple[list, list]:
    """Links that join what one key holds as its ring chains allow: at most one a fingerprint.

    Each step takes an unvisited fingerprint and compares those reached so far with the unvisited
    ones, which thus get fewer and fewer: a group of near copies costs about one pass.
    """
    order = np.argsort(rep, kind="stable")
    fp, rep = fp[order], rep[order]
    left = np.arange(len(fp))
    one, two = [], []
    while len(left):
        root, left = left[0], left[1:]
        queue = [root]
        while queue and len(left):
            u = queue.pop()
            hit = _linked(np.broadcast_to(fp[u], len(left)), fp[left], masks)
            if len(hit):
                new = left[hit]
                one.append(np.full(len(new), rep[root]))
                two.append(rep[new])
                queue.extend(new.tolist())
                left = np.delete(left, hit)
    return one, two


def ring_links(distinct: DataFrame, level: int | None = None) -> DataFrame:
    """(a, b): links between representatives of distinct fingerprints (fp, rep), enough to
    connect every pair that differs in at most 4 bits, never all pairs of a group. ``level``: of LEVELS, by default
    by how many fingerprints there are; the links differ by it, what they connect does not."""
    fp = F.col("fp")
    if level is None:
        n_prints = distinct.count()
        level = next(i for i, (most, _, _) in enumerate(LEVELS) if n_prints <= most)
    found, keys = ring_keys(*LEVELS[level][1:]), []
    first_segment = np.array([i for i, _ in found])
    for number, (_, parts) in enumerate(found):
        ranges = [r for part in parts for r in part]
        key = F.lit(number << (KEY_BITS - sum(n for _, n in ranges))).cast("long")
        for start, n in ranges:
            key = F.shiftleft(key, n).bitwiseOR(F.shiftrightunsigned(fp, start).bitwiseAND(F.lit((1 << n) - 1)))
        keys.append(key)
    rows = distinct.select(F.explode(F.array(*keys)).alias("key"), "fp", "rep")

    def links(key: np.ndarray, fp: np.ndarray, rep: np.ndarray) -> pa.RecordBatch:
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        sizes = np.diff(np.r_[first, len(key)])
        one, two = [], []
        # small groups: neighbours at each distance, over all groups at once
        small = np.repeat(sizes <= 32, sizes)
        start_seg = first_segment[key >> KEY_BITS]
        for d in range(1, 32):
            at = np.flatnonzero(small[:-d] & (key[:-d] == key[d:])) if d < len(key) else np.empty(0, np.int64)
            if not len(at):
                break
            for s in range(len(SEGMENTS)):
                own = at[start_seg[at] == s]
                hit = own[_linked(fp[own], fp[own + d], _ring_masks(s))]
                one.append(rep[hit])
                two.append(rep[hit + d])
        for f, n in zip(first[sizes > 32], sizes[sizes > 32]):
            got = _links_of(fp[f : f + n], rep[f : f + n], _ring_masks(int(start_seg[f])))
            one += got[0]
            two += got[1]
        cat = lambda x: pa.array(np.concatenate(x).astype(np.int64) if x else np.empty(0, np.int64))
        return pa.RecordBatch.from_arrays([cat(one), cat(two)], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn_to("simhash")
        held: list[list[np.ndarray]] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64), batch.column(2).to_numpy()]
            if held and cols[0][-1] == held[0][0][0]:
                held.append(cols)
                continue
            cols = [np.concatenate([h[i] for h in held] + [cols[i]]) for i in range(3)]
            last = int(np.searchsorted(cols[0], cols[0][-1]))
            held = [[c[last:] for c in cols]]
            if last:
                yield links(*[c[:last] for c in cols])
        if held:
            yield links(*[np.concatenate([h[i] for h in held]) for i in range(3)])

    return rows.repartition("key").sortWithinPartitions("key").mapInArrow(run, "a long, b long")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp, component_id) of every row: the smallest id reachable over links of at most 4 bits.

    Null and empty texts and texts of white space have fingerprint zero, which links like any
    other. Equal fingerprints (copies, repeated rows) are one node whatever their number. A row
    with a null id gets its component's smallest id, or null if it has no row with an id near.
    Other columns are ignored; an empty table gives an empty one.
    """
    prints = cut(add_fingerprints(df, id_col, text_col), "simhash")
    distinct = cut(prints.groupBy("fp").agg(F.min("id").alias("id")), "simhash-distinct")
    # a stand-in above all ids keeps fingerprints whose ids are all null in play
    distinct = distinct.select("fp", F.coalesce("id", F.lit((1 << 63) - 1) - F.pmod(F.col("fp"), F.lit(1 << 40))).alias("rep"))
    labels = components(cut(ring_links(distinct), "simhash-links"))
    named = distinct.join(labels, distinct["rep"] == labels["id"], "left").select(
        "fp", F.coalesce("component_id", "rep").alias("component_id")
    )
    return prints.join(named, "fp").select(
        "id", "fp", F.when(F.col("component_id") <= F.lit((1 << 63) - 1 - (1 << 40)), F.col("component_id")).alias("component_id")
    )
