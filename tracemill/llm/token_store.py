"""Token ids in a content-addressed store.

A text's ids, closed by an end id, are cut where a rolling hash over the last ids says so; a chunk
is named by the hash of its bytes and stored once. A document is a recipe: the names and lengths of
its chunks. Recipes stand in ascending id order with the count of ids before each; the root of a
document is a hash over its chunks' names, and a manifest holds a root for each range of documents
and one over these.

A store is a folder of Parquet datasets: ``chunks`` (digest, n, ids), ``recipes`` (id, part, start,
n_tokens, digests, lengths, root) and ``manifest`` (part, documents, root; part -1 is the whole). ids are
little-endian unsigned integers, of 16 bits where the vocabulary allows, else of 32.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracemill.llm._io import cut, discard, rank_in, scratch_path, small_batches
from tracemill.llm._text import buffers, mix
from tracemill.llm.tokens import encoder

ROLL, MEAN, LEAST, MOST = 8, 256, 64, 2048
#: Ranges of ids at most: their boundaries are literals of the plan; within a range the sort spills.
MOST_RANGES = 4096
DIGEST = 16


def boundaries(ids: np.ndarray, counts: np.ndarray) -> list[list[int]]:
    """Ends of each document's chunks, from 0 at the document's first id.

    A chunk ends where the rolling hash of the last ``ROLL`` ids is zero in its low bits, at least
    ``LEAST`` ids after the last end; runs of more than ``MOST`` are cut at multiples of it.
    """
    h = mix(ids.astype(np.uint64) + np.uint64(1))
    have = 1
    while have < ROLL:  # windows of twice as many ids; ROLL is a power of two
        h[have:] += h[:-have] * np.uint64(pow(0x9E3779B97F4A7C15, have, 1 << 64))
        have *= 2
    marks = np.flatnonzero((h >> np.uint64(33)) % np.uint64(MEAN) == 0)
    stops = np.cumsum(counts)
    first = np.searchsorted(marks, stops - counts + ROLL - 1)  # a window never reaches into the document before
    last = np.searchsorted(marks, stops - 1)
    out = []
    for d in range(len(counts)):
        begin, n = int(stops[d] - counts[d]), int(counts[d])
        ends, at = [], 0
        for e in (marks[first[d] : last[d]] - begin + 1).tolist() + [n]:
            if e - at >= LEAST or e == n:
                while e - at > MOST:
                    at += MOST
                    ends.append(at)
                if e > at:
                    ends.append(e)
                at = e
        out.append(ends)
    return out


def digest(chunk: bytes) -> bytes:
    return hashlib.blake2b(chunk, digest_size=DIGEST).digest()


def merkle_root(leaves: list[bytes]) -> bytes:
    """Root of a binary hash tree; an odd leaf moves up as it is; no leaves hash as empty."""
    level = leaves or [digest(b"")]
    while len(level) > 1:
        level = [digest(b"\1" + b"".join(level[i : i + 2])) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return level[0]


@dataclass(frozen=True)
class Store:
    """Where a store is and how its ids are kept."""

    path: str
    width: int

    def dataset(self, spark: SparkSession, name: str) -> DataFrame:
        return spark.read.parquet(f"{self.path}/{name}")


_STAGED = "id long, n_tokens long, digests binary, lengths binary, fresh array<struct<digest: binary, ids: binary>>"


def _encoded(df: DataFrame, id_col: str, text_col: str, tokenizer: str, words_only: bool, end_id: int, width: int) -> DataFrame:
    kind = np.dtype(f"<u{width}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer, words_only)
        sent: set[bytes] = set()
        for batch in batches:
            buf, offsets = buffers(batch.column(1))
            ids, n = enc.encode(buf, offsets)
            closed = np.insert(ids, np.cumsum(n), end_id)
            counts = n + 1
            if len(closed) and int(closed.max()) >> (8 * width):
                raise ValueError(f"id {int(closed.max())} does not fit into {width} bytes")
            raw = closed.astype(kind).tobytes()
            digests, ends_of, sizes = [], [], [0]
            new_names, new_pieces, news = [], [], [0]
            begin = 0
            for ends, count in zip(boundaries(closed, counts), counts.tolist()):
                names, at = [], begin * width
                for e in ends:
                    stop = (begin + e) * width
                    piece = raw[at:stop]
                    name = digest(piece)
                    names.append(name)
                    if name not in sent:  # each task sends a chunk once: copies shrink before the shuffle
                        sent.add(name)
                        new_names.append(name)
                        new_pieces.append(piece)
                    at = stop
                    ends_of.append(begin + e)
                digests.append(b"".join(names))
                sizes.append(len(ends_of))
                news.append(len(new_names))
                begin += count
            lengths = np.diff(np.array([0, *ends_of], np.int64)).astype("<u4").tobytes()
            lengths = [lengths[4 * a : 4 * b] for a, b in zip(sizes[:-1], sizes[1:])]
            fresh = pa.StructArray.from_arrays([pa.array(new_names, pa.binary()), pa.array(new_pieces, pa.binary())], names=["digest", "ids"])
            fresh = pa.ListArray.from_arrays(pa.array(news, pa.int32()), fresh)
            if len(sent) > 2_000_000:
                sent.clear()
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts), pa.array(digests, pa.binary()), pa.array(lengths, pa.binary()), fresh],
                names=["id", "n_tokens", "digests", "lengths", "fresh"],
            )

    return df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, _STAGED)


def id_width(tokenizer: str, end_id: int) -> int:
    """Bytes of an id: 2 where the highest of the vocabulary and the end id fit, else 4."""
    from tokenizers import Tokenizer

    highest = max([end_id, *Tokenizer.from_file(tokenizer).get_vocab(with_added_tokens=True).values()])
    return 2 if highest < 1 << 16 else 4


def _once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    last = None
    for batch in batches:
        names = batch.column(0).to_pylist()
        keep = [x != y for x, y in zip(names, [last, *names])]
        last = names[-1] if names else last
        yield batch.filter(pa.array(keep))


def write_store(
    df: DataFrame, tokenizer: str, words_only: bool, end_id: int, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, width: int | None = None
) -> Store:
    """Encode whole texts and write them as a store.

    Null texts are empty and have the end id alone. Rows with a null id come first; rows of equal
    ids each have a recipe, in the order of their chunks' names. An empty table makes an empty store. A
    chunk that a third of all documents hold is sent to its shuffle once by each task. A very long text is
    encoded in blocks of distinct pieces and cut into chunks like others; its recipe is one row. ``width``: bytes
    of an id, by default what the vocabulary's highest id needs; an id that does not fit is an error. Recipes
    lie in ascending id order, within files and from file to file.
    """
    spark = df.sparkSession
    small_batches(spark)
    store = Store(path or scratch_path(spark, "token-store"), width or id_width(tokenizer, end_id))
    width = store.width
    staged = cut(_encoded(df, id_col, text_col, tokenizer, words_only, end_id, width), "encoded")
    chunks = staged.select(F.explode("fresh").alias("c")).select("c.digest", "c.ids")
    chunks = chunks.repartition("digest").sortWithinPartitions("digest").mapInArrow(_once, "digest binary, ids binary")
    chunks.select("digest", (F.octet_length("ids") / width).cast("int").alias("n"), "ids").write.option("compression", "zstd").parquet(f"{store.path}/chunks")

    # a prefix sum in two levels: sums of ranges of ids, then windows within each
    ids = F.coalesce("id", F.lit(-(1 << 63)))
    parts = min(MOST_RANGES, 2 * max(1, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    q = staged.agg(F.percentile_approx(ids, F.array(*[F.lit(i / parts) for i in range(1, parts)]), 20_000).alias("q")).first()["q"]
    splitters = sorted(set(q or []))
    ranged = staged.select(rank_in(splitters, ids).alias("part"), "id", "n_tokens", "digests", "lengths")
    in_order = ranged.repartitionByRange(len(splitters) + 1, "part")
    before, starts = 0, []
    for r in sorted(ranged.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect()):
        starts.append((r["part"], before))
        before += r["n"]
    base = F.get(F.array(*[F.lit(dict(starts).get(p, 0)).cast("long") for p in range(len(splitters) + 1)]), F.col("part"))
    line = Window.partitionBy("part").orderBy(F.asc_nulls_first("id"), "digests")
    recipes = in_order.withColumn("start", base + F.sum("n_tokens").over(line.rowsBetween(Window.unboundedPreceding, 0)) - F.col("n_tokens"))

    def rooted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            roots = [merkle_root([d[i : i + DIGEST] for i in range(0, len(d), DIGEST)]) for d in batch.column(4).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(roots, pa.binary())], names=[*batch.schema.names, "root"])

    recipes = recipes.select("id", "part", "start", "n_tokens", "digests", "lengths")
    recipes.mapInArrow(rooted, "id long, part int, start long, n_tokens long, digests binary, lengths binary, root binary").write.option(
        "compression", "zstd"
    ).parquet(f"{store.path}/recipes")
    _manifest(spark, store).write.parquet(f"{store.path}/manifest")
    discard(staged)
    return store


def _part_roots(recipes: DataFrame) -> DataFrame:
    def roots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, leaves = None, []
        for batch in batches:
            for p, root in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if p != part and leaves:
                    yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "documents": [len(leaves)], "root": [merkle_root(leaves)]})
                    leaves = []
                part = p
                leaves.append(root)
        if leaves:
            yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "documents": [len(leaves)], "root": [merkle_root(leaves)]})

    rows = recipes.select("part", "root", "start").repartition("part").sortWithinPartitions("part", "start").select("part", "root")
    return rows.mapInArrow(roots, "part int, documents long, root binary")


def _manifest(spark: SparkSession, store: Store) -> DataFrame:
    rows = sorted(_part_roots(store.dataset(spark, "recipes")).collect())
    whole = (-1, sum(r["documents"] for r in rows), bytearray(merkle_root([bytes(r["root"]) for r in rows])))
    return spark.createDataFrame([whole, *[tuple(r) for r in rows]], "part int, documents long, root binary")


def verify(spark: SparkSession, store: Store) -> bool:
    """Whether the recipes' roots give the manifest's; chunks are tested whenever they are read."""
    held = {r["part"]: bytes(r["root"]) for r in store.dataset(spark, "manifest").collect()}
    return held == {r["part"]: bytes(r["root"]) for r in _manifest(spark, store).collect()}


def _links(spark: SparkSession, store: Store) -> DataFrame:
    """(digest, id, start, seq) of every chunk of every recipe, after testing the recipe's root."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, ids, starts, seqs, total = [], [], [], [], []
            for i, s, n, d, root in zip(*[c.to_pylist() for c in batch.columns]):
                own = [d[k : k + DIGEST] for k in range(0, len(d), DIGEST)]
                if merkle_root(own) != root:
                    raise ValueError(f"the recipe of {i} does not have the root it should")
                names += own
                ids += [i] * len(own)
                starts += [s] * len(own)
                total += [n] * len(own)
                seqs += range(len(own))
            yield pa.RecordBatch.from_arrays(
                [pa.array(names, pa.binary()), pa.array(ids, pa.int64()), pa.array(starts, pa.int64()), pa.array(total, pa.int64()), pa.array(seqs, pa.int32())],
                names=["digest", "id", "start", "n_tokens", "seq"],
            )

    recipes = store.dataset(spark, "recipes").select("id", "start", "n_tokens", "digests", "root")
    return recipes.mapInArrow(run, "digest binary, id long, start long, n_tokens long, seq int")


_CRC_POLY = 0xEDB88320


def _gf_times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products of polynomials modulo CRC-32's, bits reflected."""
    a, b = a.astype(np.uint32), b.astype(np.uint32).copy()
    out = np.zeros(np.broadcast(a, b).shape, np.uint32)
    for k in range(31, -1, -1):
        out ^= np.where((a >> np.uint32(k)) & np.uint32(1), b, np.uint32(0))
        b = (b >> np.uint32(1)) ^ np.where(b & np.uint32(1), np.uint32(_CRC_POLY), np.uint32(0))
    return out


_zeros: list[np.ndarray] = []


def _zeros_operator(n: np.ndarray) -> np.ndarray:
    """x to the power of 8 n modulo CRC-32's polynomial, by tables for 16 bits of n each."""
    out, k = np.full(n.shape, 1 << 31, np.uint32), 0  # 1
    n = n.astype(np.int64)
    while n.any():
        if k == len(_zeros):
            powers = np.full(1, 1 << 31, np.uint32)
            square = _gf_times(_zeros[-1][-1:], _zeros[-1][1:2]) if k else np.full(1, 1 << 23, np.uint32)  # x^8 at first
            while len(powers) < 1 << 16:
                powers = np.concatenate([powers, _gf_times(powers, square)])
                square = _gf_times(square, square)
            _zeros.append(powers)
        own = _zeros[k][n & 0xFFFF]
        out = _gf_times(out, own) if k else own
        n, k = n >> 16, k + 1
    return out


def crc_joined(crc: np.ndarray, n_bytes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """CRC-32 of concatenations, from the CRCs and sizes of their parts; first: where each begins.

    A part's CRC goes into the whole's times x^8 for each byte that follows it there."""
    stop = np.r_[first[1:], len(crc)]
    end = np.cumsum(n_bytes.astype(np.int64))
    after = np.repeat(end[stop - 1], stop - first) - end
    return np.bitwise_xor.reduceat(_gf_times(crc, _zeros_operator(after)), first)


def read_digests(spark: SparkSession, store: Store) -> DataFrame:
    """(id, start, n_tokens, ids_crc32) of every document, from the files.

    Each stored chunk is read and tested once and gives the CRC of its ids as 32-bit integers; the
    recipes join these, and a document's CRC follows from those of its chunks and their lengths. So
    the ids themselves are not shuffled again.
    """
    if not verify(spark, store):
        raise ValueError("the recipes are not those of the manifest")
    kind, width = np.dtype(f"<u{store.width}"), store.width

    def tested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            crcs, n = [], []
            for name, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if digest(ids) != name:
                    raise ValueError(f"chunk {name.hex()} does not hold what its name says")
                crcs.append(zlib.crc32(np.frombuffer(ids, kind).astype("<u4")))
                n.append(len(ids) // width)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int32()), pa.array(crcs, pa.int64())], names=["digest", "n", "crc"])

    chunks = store.dataset(spark, "chunks").select("digest", "ids").mapInArrow(tested, "digest binary, n int, crc long")
    joined = _links(spark, store).join(chunks, "digest", "left").select("start", "seq", "id", "n_tokens", "n", "crc")

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            rows = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            start = rows.column("start").to_numpy()
            if not len(start):
                continue
            last = int(np.searchsorted(start, start[-1]))
            held = rows.slice(last)
            if last:
                yield done(rows.slice(0, last))
        if held is not None and held.num_rows:
            yield done(held)

    def done(rows: pa.Table) -> pa.RecordBatch:
        if rows.column("crc").null_count:
            raise ValueError("a chunk that a recipe names is not in the store")
        start, n = rows.column("start").to_numpy(), rows.column("n").to_numpy().astype(np.int64)
        first = np.flatnonzero(np.r_[True, start[1:] != start[:-1]])
        total = np.add.reduceat(n, first)
        if (total != rows.column("n_tokens").to_numpy()[first]).any():
            raise ValueError("a document's chunks do not have the ids its recipe counts")
        crc = crc_joined(rows.column("crc").to_numpy(), 4 * n, first)
        ids = rows.column("id").combine_chunks().take(pa.array(first))
        return pa.RecordBatch.from_arrays([ids, pa.array(start[first]), pa.array(total), pa.array(crc.astype(np.int64))], names=["id", "start", "n_tokens", "ids_crc32"])

    ordered = joined.repartition("start").sortWithinPartitions("start", "seq")
    return ordered.mapInArrow(whole, "id long, start long, n_tokens long, ids_crc32 long")


def read_ids(spark: SparkSession, store: Store) -> DataFrame:
    """(id, start, ids array<int>): the documents themselves, put together from their chunks."""
    kind = np.dtype(f"<u{store.width}")

    def plain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [np.frombuffer(x, kind).astype(np.int32) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ids, pa.list_(pa.int32()))], names=["id", "start", "ids"])

    joined = _links(spark, store).join(store.dataset(spark, "chunks").select("digest", "ids"), "digest")
    parts = joined.groupBy("id", "start").agg(F.array_sort(F.collect_list(F.struct("seq", "ids"))).alias("p"))
    one = F.aggregate("p", F.lit(b""), lambda acc, x: F.concat(acc, x["ids"]))
    return parts.select("id", "start", one.alias("ids")).mapInArrow(plain, "id long, start long, ids array<int>")
