"""Sampled SentencePiece segmentations: forward filtering, backward sampling; lossless decoding.

A text is cut into units that no piece crosses (a run of blanks and what follows up to the next; a
control character alone). The distinct units of a block share one lattice of vocabulary pieces; a
forward pass sums the weights of all paths to each place; each unit of each text then walks back
from its end, choosing the last piece with its probability given where it ends. The random numbers are
hashes of (seed, row key, place in the text), so a row gives the same pieces on any machine, in any
batch. A character without a piece is spelt in byte pieces, as is the meta symbol itself where a
text holds it; so decoding gives back exactly the text.

A unigram model's scores are log probabilities. A BPE model has only ranks; its weights follow
Zipf's law over them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracemill.llm._io import small_batches
from tracemill.llm._text import SpanHasher, blocks, buffers, expand, mix, span_hashes
from tracemill.llm.language_id import SortedHashes

META, LITERAL = 0x2581, 0x110001


class Lattice:
    """A vocabulary with weights; segmentations are drawn with probability proportional to exp(alpha * weight)."""

    def __init__(self, model: str, alpha: float = 1.0, seed: int = 0):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model)
        self.alpha, self.seed, self.size = alpha, seed, sp.get_piece_size()
        pieces, ids, scores = [], [], []
        self.byte_ids = np.zeros(256, np.int32)
        data: list[bytes] = []
        for i in range(self.size):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte_ids[int(piece[3:5], 16)] = i
                data.append(bytes([int(piece[3:5], 16)]))
                continue
            if sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) or META in map(ord, piece.lstrip(chr(META))) or not piece or any(ord(c) < 32 for c in piece):
                data.append(b"")
                continue
            data.append(piece.replace(chr(META), " ").encode())
            pieces.append(piece)
            ids.append(i)
            scores.append(sp.get_score(i))
        score = np.array(scores)
        ranked = bool((np.diff(score) == -1).mean() > 0.9)  # BPE: scores only count down
        weight = -np.log(2.0 + (score.max() - score)) if ranked else score
        # every prefix of a piece, with the piece it is (or none) and whether it goes on
        known: dict[str, list] = {}
        for p, i, w in zip(pieces, ids, weight):
            for size in range(1, len(p)):
                known.setdefault(p[:size], [-1, 0.0, False])[2] = True
            known.setdefault(p, [-1, 0.0, False])[:2] = [i, alpha * w]
        flat = np.array([ord(c) for p in known for c in p], np.uint64)
        n = np.array([len(p) for p in known])
        ends = np.cumsum(n)
        h = span_hashes(flat, ends - n, ends)
        order = np.argsort(h)
        self.vocab = SortedHashes(h[order])
        self.ids, self.weight, self.longer = (np.array(x)[order] for x in zip(*known.values()))
        self.longest = int(n.max())
        self.byte_weight = alpha * float(weight.min() - 2.0)
        self.data_start = np.r_[0, np.cumsum([len(d) for d in data])]
        self.data = np.frombuffer(b"".join(data), np.uint8)

    def _units(self, cps: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Where units start; each text starts one."""
        blank, control = cps == META, cps < 32
        start = control.copy()
        start[1:] |= control[:-1] | (blank[1:] & ~blank[:-1])
        start[starts[:-1][starts[:-1] < len(cps)]] = True
        return np.flatnonzero(start)

    def sample(self, buf: np.ndarray, offsets: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(piece ids of all texts in order, how many each has); keys: a 64-bit row key for each."""
        ids, counts = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
        for a, b in blocks(offsets, 2 << 20):
            got = self._block(buf[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], keys[a:b])
            ids.append(got[0])
            counts.append(got[1])
        return np.concatenate(ids), np.concatenate(counts)

    def _block(self, buf: np.ndarray, offsets: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n_texts = len(offsets) - 1
        cps = np.frombuffer(buf.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32).astype(np.int64)
        if not len(cps):
            return np.zeros(0, np.int32), np.zeros(n_texts, np.int64)
        lead = np.r_[0, np.cumsum((buf & 0xC0) != 0x80)]
        starts = lead[offsets]  # in characters
        cps = np.where(cps == 32, META, np.where(cps == META, LITERAL, cps))
        first = self._units(cps, starts)
        ends = np.r_[first[1:], len(cps)]
        h = span_hashes(cps.astype(np.uint64), first, ends)
        _, at, inverse = np.unique(h, return_index=True, return_inverse=True)
        u_len = (ends - first)[at]
        flat = cps[expand(first[at], u_len)]  # characters of the distinct units
        node0 = np.cumsum(u_len + 1) - (u_len + 1)  # a node before each character and one at the end
        cum, edge_from, token, edge_head = self._lattice(flat, u_len, node0)
        # all units walk back at once; the piece that ends at a place is written there
        text_of = np.searchsorted(starts, first, side="right") - 1
        out = np.full(len(cps), -1, np.int64)
        node = node0[inverse] + u_len[inverse]
        base = node0[inverse]
        who = np.arange(len(first))
        salt = mix(keys.astype(np.uint64) + np.uint64(self.seed * 0x9E3779B97F4A7C15 % (1 << 64)))
        while len(who):
            place = first[who] + (node - base)  # just after the last character
            r = mix(salt[text_of[who]] + (place - starts[text_of[who]]).astype(np.uint64) * np.uint64(0xD1B54A32D192ED03))
            u = (r >> np.uint64(12)).astype(np.float64) / float(1 << 52)
            e = edge_head[node]
            high = np.flatnonzero(cum[e] <= u)
            while len(high):
                e[high] += 1
                high = high[cum[e[high]] <= u[high]]
            out[place - 1] = token[e]
            node = edge_from[e]
            more = node > base
            who, node, base = who[more], node[more], base[more]
        last = np.flatnonzero(out >= 0)
        tokens = out[last]
        spelt = tokens == self.size
        text = np.searchsorted(starts, last, side="right") - 1
        if not spelt.any():
            return tokens.astype(np.int32), np.bincount(text, minlength=n_texts)
        byte_at = np.r_[np.flatnonzero((buf & 0xC0) != 0x80), len(buf)]
        n = np.where(spelt, byte_at[last + 1] - byte_at[last], 1)
        ids = np.repeat(np.where(spelt, 0, tokens), n).astype(np.int32)
        where = expand((np.cumsum(n) - n)[spelt], n[spelt])
        ids[where] = self.byte_ids[buf[expand(byte_at[last[spelt]], n[spelt])]]
        return ids, np.bincount(text, n, n_texts).astype(np.int64)

    def _lattice(self, flat: np.ndarray, u_len: np.ndarray, node0: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Edges by the node they end in, longest first: cumulative probability within the node, the
        node they start in, the piece (the vocabulary's size: a character spelt in bytes); and where
        each node's edges begin."""
        n, wide = len(flat), self.longest
        unit = np.repeat(np.arange(len(u_len)), u_len)
        into = np.arange(n) - np.repeat(np.cumsum(u_len) - u_len, u_len)
        room = u_len[unit] - into
        start_node = node0[unit] + into
        hashes = SpanHasher(flat.astype(np.uint64))
        found = np.zeros((n, wide), np.int32)  # by the last character and the length: the prefix's place + 1
        at = np.arange(n)
        for size in range(1, wide + 1):
            hit = self.vocab.find(hashes(at, at + size))
            got = np.flatnonzero(hit >= 0)
            at, hit = at[got], hit[got]
            piece = self.ids[hit] >= 0
            found[at[piece] + size - 1, wide - size] = hit[piece] + 1
            at = at[self.longer[hit]]
            at = at[room[at] > size]
            if not len(at):
                break
        none = found[:, wide - 1] == 0
        found[none, wide - 1] = -1
        cell = np.flatnonzero(found.ravel())
        last, size = cell // wide, wide - cell % wide
        place = found.ravel()[cell]
        spelt = place < 0
        place = np.maximum(place - 1, 0)
        c = flat[last]
        n_bytes = np.where(c < 0x80, 1, np.where(c < 0x800, 2, np.where((c < 0x10000) | (c == LITERAL), 3, 4)))
        w = np.where(spelt, self.byte_weight * n_bytes, self.weight[place])
        token = np.where(spelt, self.size, self.ids[place])
        to = start_node[last] + 1
        e_from = to - size
        n_nodes = int(node0[-1] + u_len[-1] + 1)
        # forward: by the ends' depth in their units, all units at once
        depth = into[last]
        order = np.argsort(depth.astype(np.uint16) if u_len.max() < 1 << 16 else depth, kind="stable")
        level = np.searchsorted(depth[order], np.arange(int(u_len.max()) + 1))
        alpha = np.zeros(n_nodes)
        prob = np.zeros(len(w))
        for a, b in zip(level[:-1].tolist(), level[1:].tolist()):
            o = order[a:b]
            v = alpha[e_from[o]] + w[o]
            t = to[o]
            head = np.flatnonzero(np.r_[True, t[1:] != t[:-1]])
            many = np.diff(np.r_[head, b - a])
            most = np.maximum.reduceat(v, head)
            x = np.exp(v - np.repeat(most, many))
            total = np.add.reduceat(x, head)
            alpha[t[head]] = most + np.log(total)
            prob[o] = x / np.repeat(total, many)
        head = np.flatnonzero(np.r_[True, to[1:] != to[:-1]])
        many = np.diff(np.r_[head, len(to)])
        run = np.cumsum(prob)
        cum = run - np.repeat(run[head] - prob[head], many)
        cum[head + many - 1] = 2.0  # above any random number
        edge_head = np.zeros(n_nodes, np.int64)
        edge_head[to[head]] = head
        return cum, e_from, token, edge_head

    def decode(self, ids: np.ndarray) -> bytes:
        """The text of piece ids, exactly as it was encoded."""
        ids = np.asarray(ids, np.int64)
        n = self.data_start[ids + 1] - self.data_start[ids]
        return self.data[expand(self.data_start[ids], n)].tobytes()


_lattices: dict[tuple, Lattice] = {}


def lattice(model: str, alpha: float, seed: int) -> Lattice:
    if (model, alpha, seed) not in _lattices:
        _lattices[model, alpha, seed] = Lattice(model, alpha, seed)
    return _lattices[model, alpha, seed]


def encode(df: DataFrame, model: str, alpha: float = 1.0, seed: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int>): a sampled segmentation of each whole text, seeded by its row's id.

    Null texts are empty and have no pieces. Rows of the same id and text get the same pieces; null
    ids share one key. Other columns are ignored; an empty table gives an empty one.
    """
    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lat = lattice(model, alpha, seed)
        for batch in batches:
            buf, offsets = buffers(batch.column(2))
            ids, counts = lat.sample(buf, offsets, batch.column(1).to_numpy().view(np.uint64))
            lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(counts)].astype(np.int32)), pa.array(ids))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], names=["id", "ids"])

    rows = df.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(F.col(id_col).cast("string")).alias("key"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "id long, ids array<int>")


def decode(df: DataFrame, model: str, id_col: str = "id", ids_col: str = "ids") -> DataFrame:
    """(id, text) of piece ids; null ids are a null text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lat = lattice(model, 1.0, 0)
        for batch in batches:
            texts = [None if x is None else lat.decode(np.array(x, np.int64)).decode("utf-8") for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["id", "text"])

    return df.select(F.col(id_col).cast("long").alias("id"), F.col(ids_col).cast("array<int>").alias("ids")).mapInArrow(run, "id long, text string")


def round_trip(df: DataFrame, model: str, alpha: float = 1.0, seed: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_pieces, ids_crc32, decoded_crc32, text_crc32, lossless): encode, decode and compare, in one pass."""
    import zlib

    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lat = lattice(model, alpha, seed)
        for batch in batches:
            buf, offsets = buffers(batch.column(2))
            ids, counts = lat.sample(buf, offsets, batch.column(1).to_numpy().view(np.uint64))
            at = np.r_[0, np.cumsum(counts)].tolist()
            crc, back, own, same = [], [], [], []
            for i in range(batch.num_rows):
                text = buf[offsets[i] : offsets[i + 1]].tobytes()
                mine = ids[at[i] : at[i + 1]]
                again = lat.decode(mine)
                crc.append(zlib.crc32(mine.astype("<u4").tobytes()))
                back.append(zlib.crc32(again))
                own.append(zlib.crc32(text))
                same.append(again == text)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), *[pa.array(x, pa.int64()) for x in (crc, back, own)], pa.array(same, pa.bool_())],
                names=["id", "n_pieces", "ids_crc32", "decoded_crc32", "text_crc32", "lossless"],
            )

    rows = df.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(F.col(id_col).cast("string")).alias("key"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "id long, n_pieces long, ids_crc32 long, decoded_crc32 long, text_crc32 long, lossless boolean")
