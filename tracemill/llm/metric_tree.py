"""Exact top-k by inner product over M-trees: paged metric nodes and best-first search.

Vectors x get one more coordinate, sqrt(M - |x|^2) with M the largest squared norm, and queries a
zero there; then the greatest inner product is the least distance, and distances between vectors
obey the triangle inequality. A bounded set of pivots cuts the vectors into regions; a region makes
one M-tree, or several if it is large, each of a ring of distances to the pivot. A node has a routing vector, a covering radius and its
distance to its parent's vector; leaf pages hold vectors with their distances to the page's. The
search takes nodes in the order of their bounds, and skips what stored distances exclude before any
product is computed: first in the query's own region, then, with the k-th distance found there, in
those regions that it can't exclude.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracemill.llm._io import cut

PAGE = 256
TREE, REGION = 20_000, 1024
MOST_PIVOTS, MOST_TREES, MOST_RINGS = 256, 65_536, 64
#: Queries that search a tree together.
BLOCK = 512


def quantised(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 1024) -> DataFrame:
    """(id, v array<long>): floor(scale * x) of vectors that have components, all of them finite."""
    x = F.transform(vector_col, lambda x: x.cast("double"))
    odd = F.exists("x", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    rows = df.select(F.col(id_col).cast("long").alias("id"), x.alias("x")).filter("id is not null and x is not null and size(x) > 0").filter(~odd)
    return rows.select("id", F.transform("x", lambda x: F.floor(x * F.lit(scale))).alias("v"))


def _matrix(rows: list, width: int) -> np.ndarray:
    """Rows of integers, short ones followed by zeros."""
    return np.array([[*r, *[0] * (width - len(r))] for r in rows], np.int64).reshape(len(rows), width)


class Space:
    """Distances of vectors with their lifted coordinate."""

    def __init__(self, top: float):
        self.top = top
        self.slack = 1e-6 + 1e-7 * float(np.sqrt(top))  # what rounding can take from a distance

    def lift(self, x: np.ndarray) -> np.ndarray:
        x = x.astype(np.float64)
        return np.c_[x, np.sqrt(np.maximum(self.top - (x * x).sum(axis=1), 0.0))]

    @staticmethod
    def distances(points: np.ndarray, one: np.ndarray) -> np.ndarray:
        d = points - one
        return np.sqrt((d * d).sum(axis=1))


class MTree:
    """Nodes in arrays; children of a node are nodes, or for a leaf a slice of the entries."""

    def __init__(self, ids: np.ndarray, raw: np.ndarray, space: Space):
        self.space = space
        points = space.lift(raw)
        self.center: list[np.ndarray] = []
        self.radius: list[float] = []
        self.to_parent: list[float] = []
        self.children: list[list[int]] = []
        self.entries: list[np.ndarray | None] = []
        self.entry_distance: list[np.ndarray | None] = []
        self._build(points, np.arange(len(ids)), None)
        self.ids, self.raw = ids, exact(raw, space.top)

    def _build(self, points: np.ndarray, at: np.ndarray, parent: int | None) -> None:
        todo: list[tuple[np.ndarray, int | None]] = [(at, parent)]
        while todo:
            at, parent = todo.pop()
            own = points[at]
            mean = own.mean(axis=0)
            center = own[int(Space.distances(own, mean).argmin())]
            d = Space.distances(own, center)
            n = len(self.center)
            self.center.append(center)
            self.radius.append(float(d.max()))
            self.to_parent.append(0.0 if parent is None else float(np.linalg.norm(center - self.center[parent])))
            self.children.append([])
            if parent is not None:
                self.children[parent].append(n)
            if len(at) <= PAGE:
                order = np.argsort(d, kind="stable")
                self.entries.append(at[order])
                self.entry_distance.append(d[order])
                continue
            self.entries.append(None)
            self.entry_distance.append(None)
            # promote two far vectors and part by the nearer; where that is lopsided, part in halves
            one = own[int(d.argmax())]
            d1 = Space.distances(own, one)
            d2 = Space.distances(own, own[int(d1.argmax())])
            order = np.argsort(d1 - d2, kind="stable")
            half = int(np.clip((d1 <= d2).sum(), len(at) // 4, len(at) - len(at) // 4))
            todo += [(at[order[:half]], n), (at[order[half:]], n)]

    def search(self, queries: np.ndarray, asked: np.ndarray, k: int, limits: np.ndarray) -> tuple[list[list[tuple[int, int]]], np.ndarray]:
        """(each query's best (-score, id) within its limit, how many products each needed).

        Best-first over a block of queries: a node is taken in the order of the least bound that a query has for it, and only
        for those queries whose limit it is within; so one product of matrices serves all that look at a page.
        """
        n, slack = len(queries), self.space.slack
        lifted = np.concatenate([asked, np.zeros((n, 1), asked.dtype)], axis=1).astype(np.float64)
        total = (lifted * lifted).sum(axis=1) + self.space.top
        limits = limits.astype(np.float64).copy()
        best: list[list[tuple[int, int]]] = [[] for _ in range(n)]  # sorted (-score, id)
        worst = np.full(n, -np.inf)  # the k-th score so far
        computed = np.ones(n, np.int64)
        d_root = Space.distances(lifted, self.center[0])
        bounds = np.maximum(0.0, d_root - self.radius[0])
        heap = [(float(bounds.min()), 0, np.arange(n), d_root, bounds)]
        while heap:
            least, node, who, d, bounds = heapq.heappop(heap)
            reach = limits * (1 + 1e-9) + slack
            if least > reach.max():
                break
            go = bounds <= reach[who]
            who, d, bounds = who[go], d[go], bounds[go]
            if not len(who):
                continue
            if self.entries[node] is None:
                for c in self.children[node]:
                    near = np.abs(d - self.to_parent[c]) - self.radius[c] <= reach[who]  # the others are excluded by what is stored
                    if near.any():
                        computed[who[near]] += 1
                        d_c = Space.distances(lifted[who[near]], self.center[c])
                        low = np.maximum(np.maximum(0.0, d_c - self.radius[c]), bounds[near])
                        heapq.heappush(heap, (float(low.min()), c, who[near], d_c, low))
                continue
            stored = self.entry_distance[node]
            first, stop = np.searchsorted(stored, d - reach[who]), np.searchsorted(stored, d + reach[who], side="right")
            go = stop > first
            who, first, stop = who[go], first[go], stop[go]
            if not len(who):
                continue
            computed[who] += stop - first
            at = self.entries[node][int(first.min()) : int(stop.max())]
            scores, ids = asked[who] @ self.raw[at].T, self.ids[at]
            hit = (scores >= worst[who, None]) & (ids[None, :] != queries[who, None])
            for j in np.flatnonzero(hit.any(axis=1)).tolist():
                i, new = int(who[j]), np.flatnonzero(hit[j])
                if len(new) > k:  # the k-th best of the page, and what ties with it
                    new = new[scores[j, new] >= np.sort(scores[j, new])[len(new) - k]]
                best[i] = sorted(best[i] + [(-int(s), int(x)) for s, x in zip(scores[j, new].tolist(), ids[new].tolist())])[:k]
                if len(best[i]) == k:
                    worst[i] = -best[i][-1][0]
                    limits[i] = min(limits[i], float(np.sqrt(max(0.0, total[i] + 2.0 * best[i][-1][0]))))
        return best, computed


def exact(x: np.ndarray, top: float) -> np.ndarray:
    """Vectors in a type whose inner products are exact: floating point where no sum can pass 2^53, else Python's integers."""
    return x.astype(np.float64) if top < 2.0**53 else x.astype(object)


_INDEX = "tree int, id long, v array<long>, d double"
_FOUND = "query_id long, vec_id long, score long, computed long"


def top_k(df: DataFrame, k: int = 10, query_every: int = 100, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): for each row whose id is divisible by ``query_every``, the
    ``k`` highest integer inner products with other rows, ties to smaller ids; all, if fewer.

    Vectors that are null, empty, or hold nulls or other than finite numbers take no part; nor do
    rows without an id. Vectors of fewer components count as followed by zeros. Rows that repeat
    an id are candidates of others, each with a rank, never of a query of their id. Of a group of
    equal vectors, however large, k + 1 ids are indexed, which loses nothing. Components beyond 64 bits count as
    the ends of their range, and scores are compared exactly within a tree and returned as the ends of theirs; vectors whose
    squared lengths pass 2^53 are multiplied as Python's integers, slowly. Other columns are ignored. Empty tables give an
    empty result.
    """
    spark = df.sparkSession
    rows = cut(quantised(df, id_col, vector_col), "vectors")
    norm = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    n, top, width = rows.agg(F.count("*"), F.max(norm), F.max(F.size("v"))).first()
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    if not n:
        return empty
    # of equal vectors all score alike, so only the k + 1 smallest ids of each can be among a query's k
    same = Window.partitionBy("v").orderBy("id")
    held = rows.withColumn("_r", F.dense_rank().over(same)).filter(F.col("_r") <= k + 1)
    copies = Window.partitionBy("v", "id").orderBy("_r")
    held = cut(held.withColumn("_c", F.row_number().over(copies)).filter(F.col("_c") <= k).select("id", "v"), "candidates")
    n = held.count()
    n_pivots = int(min(MOST_PIVOTS, max(16, n // REGION)))
    sample = held.orderBy(F.xxhash64("id"), "id").limit(n_pivots).collect()
    space = Space(float(top))
    pivots = space.lift(_matrix([r["v"] for r in sample], width))

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            points = space.lift(_matrix(batch.column(1).to_pylist(), width))
            d = np.stack([Space.distances(points, p) for p in pivots], axis=1)
            best = d.argmin(axis=1)
            yield pa.RecordBatch.from_arrays(
                [pa.array(best, pa.int32()), batch.column(0), batch.column(1), pa.array(d[np.arange(len(d)), best])], names=["tree", "id", "v", "d"]
            )

    assigned = cut(held.mapInArrow(near, _INDEX), "regions")
    size = max(TREE, -(-n // MOST_TREES))
    edges = F.percentile_approx("d", F.array(*[F.lit(i / MOST_RINGS) for i in range(MOST_RINGS + 1)]), 10_000)
    regions = {r["tree"]: r for r in assigned.groupBy("tree").agg(F.count("*").alias("n"), F.max("d").alias("r"), edges.alias("e")).collect()}
    # a large region has several trees, each of a ring around the pivot; what a ring holds too much of is left to a hash of the id
    trees, place = [], F.lit(0)
    for p, r in sorted(regions.items()):
        rings = min(MOST_RINGS, -(-r["n"] // size))
        inner = sorted({r["e"][MOST_RINGS * i // rings] for i in range(1, rings)})
        each = -(-r["n"] // (size * rings))
        here = F.lit(0)
        for e in inner:
            here = here + (F.col("d") >= F.lit(e)).cast("int")
        place = F.when(F.col("tree") == p, F.lit(len(trees)) + here * F.lit(each) + F.pmod(F.xxhash64("id"), F.lit(each)).cast("int")).otherwise(place)
        for lo, hi in zip([0.0, *inner], [*inner, r["r"]]):
            trees += [(p, lo, hi)] * each
    index = assigned.select(place.cast("int").alias("tree"), "id", "v", F.lit(None).cast("double").alias("limit"))
    region_of, inner_of, outer_of = (np.array(x) for x in zip(*trees))

    def sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The trees that each query can't exclude: its own region's nearest ring without a limit, the others with one."""
        for batch in batches:
            out: list[tuple] = []
            for i, v, limit in zip(*[c.to_pylist() for c in batch.columns]):
                q = np.r_[_matrix([v], width)[0].astype(np.float64), 0.0]
                d = Space.distances(pivots, q)[region_of]
                bound = np.maximum(np.maximum(d - outer_of, inner_of - d), 0.0)
                own = region_of == region_of[int(d.argmin())]
                own &= bound == bound[own].min()
                go = own if limit is None else ~own & (bound <= limit * (1 + 1e-9) + space.slack)
                out += [(int(t), i, v, limit) for t in np.flatnonzero(go)]
            tree, ids, vs, limits = zip(*out) if out else ((), (), (), ())
            yield pa.RecordBatch.from_arrays(
                [pa.array(tree, pa.int32()), pa.array(ids, pa.int64()), pa.array(vs, pa.list_(pa.int64())), pa.array(limits, pa.float64())], names=["tree", "id", "v", "limit"]
            )

    def answered(entries: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple] = []
        if len(entries) and len(queries):
            tree = MTree(entries["id"].to_numpy(), _matrix(list(entries["v"]), width), space)
            ids, asked = queries["id"].to_numpy(), exact(_matrix(list(queries["v"]), width), space.top)
            limits = queries["limit"].fillna(np.inf).to_numpy()
            for at in range(0, len(ids), BLOCK):
                found, computed = tree.search(ids[at : at + BLOCK], asked[at : at + BLOCK], k, limits[at : at + BLOCK])
                for i, own, products in zip(ids[at : at + BLOCK].tolist(), found, computed.tolist()):
                    out += [(i, vec, max(-(1 << 63), min((1 << 63) - 1, -minus)), products) for minus, vec in own]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score", "computed"])

    def searched(queries: DataFrame) -> DataFrame:
        asked = queries.mapInArrow(sent, "tree int, id long, v array<long>, limit double")
        return index.groupBy("tree").cogroup(asked.groupBy("tree")).applyInPandas(answered, _FOUND)

    queries = rows.filter(F.col("id") % query_every == 0).dropDuplicates(["id"])
    rank = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    near_by = cut(searched(queries.select("id", "v", F.lit(None).cast("double").alias("limit"))), "nearby")
    kth = near_by.withColumn("rank", F.row_number().over(rank)).filter(F.col("rank") == k).select(F.col("query_id").alias("id"), "score")
    reach = F.sqrt(F.greatest(F.lit(0.0), norm + F.lit(float(top)) - 2 * F.col("score").cast("double")))
    asked = queries.join(kth, "id", "left").select("id", "v", F.when(F.col("score").isNull(), F.lit(float("inf"))).otherwise(reach).alias("limit"))
    found = near_by.unionByName(searched(asked))
    return found.withColumn("rank", F.row_number().over(rank)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
