"""Token ids of many whole texts: every distinct piece of text is encoded once a worker.

A text is cut where its tokenizer's own splitting always cuts, each distinct piece is encoded by
the tokenizers library, and the ids of the texts are put together from those of their pieces.
Where the cuts can't be proved from the bytes alone (exotic white space), the library gets the
whole text.
"""

from __future__ import annotations

import os
import re
from itertools import chain

import numpy as np

from tracemill.llm._io import turn_to
from tracemill.llm._text import blocks, expand, mix, span_hashes

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(9, 14)]] = True
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_MARK = np.zeros(256, bool)
_MARK[[ord(","), ord(".")]] = True
#: First bytes of characters that can be white space (or separators) beyond the ASCII six.
_EXOTIC = np.zeros(256, bool)
_EXOTIC[[*range(0x1C, 0x20), 0xC2, 0xE1, 0xE2, 0xE3]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: ASCII characters that are neither white space, letters, digits nor controls.
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True
#: Words of these letters alone, which lower-casing and NFC leave letters.
_letters_only = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]+").fullmatch
#: Such words that go to the library as one text, and pieces that go to it in one call.
TOGETHER, CALL = 200, 4000
#: Bytes of texts that are cut into pieces at once; what that takes meanwhile is about 60 times as much.
BLOCK = 1 << 19


class _Known:
    """Distinct pieces: their hashes, where their ids begin in one flat array and how many they are, in rows from 1 on, and a table
    of open addresses, a fourth to half full, with the rows' numbers."""

    def __init__(self) -> None:
        self.used = 0
        self.places = np.zeros(1 << 16, np.int32)  # 0: free
        self.keys = np.zeros(1 << 15, np.uint64)
        self.start = np.zeros(1 << 15, np.int64)
        self.count = np.zeros(1 << 15, np.int32)

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(each hash's row, which hashes are not there); hashes are not 0."""
        mask = len(self.places) - 1
        place = (h & np.uint64(mask)).astype(np.int64)
        row = self.places[place]
        todo = np.flatnonzero(self.keys[row] != h)
        lacking = [todo[:0]]
        while len(todo):
            free = row[todo] == 0
            lacking.append(todo[free])
            todo = todo[~free]
            at = (place[todo] + 1) & mask
            place[todo], row[todo] = at, self.places[at]
            todo = todo[self.keys[row[todo]] != h[todo]]
        return row, np.concatenate(lacking)

    def add(self, h: np.ndarray, start: np.ndarray, count: np.ndarray) -> None:
        """Distinct hashes that are not there yet."""
        rows = np.arange(self.used + 1, self.used + len(h) + 1, dtype=np.int32)
        self.used += len(h)
        if self.used >= len(self.keys):
            for x in (self.keys, self.start, self.count):
                x.resize(max(self.used + 1, len(x) * 5 // 4), refcheck=False)
        self.keys[rows], self.start[rows], self.count[rows] = h, start, count
        if 2 * self.used > len(self.places):
            self.places = np.zeros(0, np.int32)  # the old one goes first
            self.places = np.zeros(1 << (2 * self.used).bit_length(), np.int32)
            rows = np.arange(1, self.used + 1, dtype=np.int32)
        mask = len(self.places) - 1
        at = (self.keys[rows] & np.uint64(mask)).astype(np.int64)
        while len(rows):
            free = self.places[at] == 0
            self.places[at[free]] = rows[free]
            lost = self.places[at] != rows
            rows, at = rows[lost], (at[lost] + 1) & mask


class PieceEncoder:
    """Ids of texts by a tokenizer of the library.

    words_only: the tokenizer lower-cases, drops white space and parts letters from symbols (word BPE); otherwise it is a
    byte-level BPE in which one blank belongs to what follows. About ``most`` distinct pieces are
    kept, and eight ids for each; beyond that the store starts anew.
    """

    def __init__(self, path: str, words_only: bool, most: int = 1_500_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.words_only, self.most = words_only, most
        self._reset()
        if words_only:
            vocab = self.tokenizer.get_vocab()
            self.ends = np.zeros(max(vocab.values()) + 1, bool)
            self.ends[[i for t, i in vocab.items() if t.endswith("</w>")]] = True

    def _reset(self) -> None:
        self.known = _Known()
        self.flat, self.used = np.zeros(1 << 16, np.int32), 0

    def encode(self, buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in order, how many each has) of the UTF-8 texts between offsets."""
        ids, counts = [], []
        for a, b in blocks(offsets, BLOCK):
            got = self._block(buf[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            ids.append(got[0])
            counts.append(got[1])
        if not ids:
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        return np.concatenate(ids), np.concatenate(counts)

    def _whole(self, text: bytes) -> list[int]:
        return self.tokenizer.encode_batch_fast([text.decode("utf-8")], add_special_tokens=False)[0].ids

    def _block(self, buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n_docs = len(offsets) - 1
        exotic = np.flatnonzero(_EXOTIC[buf])
        odd = np.zeros(n_docs, bool)
        if len(exotic):
            doc = np.searchsorted(offsets, exotic, side="right") - 1
            lead, follow = buf[exotic], buf[np.minimum(exotic + 1, len(buf) - 1)]
            # 0xC2 leads U+0080-00BF: only U+0085 and U+00A0 are white space
            odd[doc[(lead != 0xC2) | (follow == 0x85) | (follow == 0xA0)]] = True
        if self.words_only:
            buf = _LOWER[buf]
        starts, ends, blank = self._pieces(buf, offsets)
        if odd.any():
            keep = ~odd[np.searchsorted(offsets, starts, side="right") - 1]
            starts, ends, blank = starts[keep], ends[keep], blank[keep]
        h = span_hashes(buf, starts, ends)
        h = np.where(blank, mix(h + np.uint64(0x5851F42D4C957F2D)), h)
        at = self._lookup(buf, np.maximum(h, np.uint64(1)), starts, ends, blank)
        start, count = self.known.start[at], self.known.count[at].astype(np.int64)
        ids = self.flat[expand(start, count)]
        per_doc = np.diff(np.r_[0, np.cumsum(count)][np.searchsorted(starts, offsets)])
        if not odd.any():
            return ids, per_doc
        parts, cuts = [], np.r_[0, np.cumsum(per_doc)]
        for d in range(n_docs):
            if odd[d]:
                own = np.array(self._whole(buf[offsets[d] : offsets[d + 1]].tobytes()), np.int32)
                parts.append(own)
                per_doc[d] = len(own)
            else:
                parts.append(ids[cuts[d] : cuts[d + 1]])
        return np.concatenate(parts), per_doc

    def _pieces(self, buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of the pieces in order, and whether a blank before belongs to each."""
        n = len(buf)
        if not n:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
        space = _SPACE[buf]
        edge = np.zeros(n + 1, bool)
        edge[offsets] = True
        after_space = np.r_[True, space[:-1]] | edge[:-1]
        before_space = np.r_[space[1:], True] | edge[1:]
        letter = _LETTER[buf]
        lead = np.r_[np.uint8(0), buf[:-1]]
        letter |= (lead == 0xC3) & (buf >= 0x80) & (buf != 0x97) & (buf != 0xB7)
        if self.words_only:  # what follows a letter and is neither letter, digit nor white space always begins a piece
            mark = _SYMBOL[buf] & ~after_space & np.r_[False, letter[:-1]]
        else:  # a comma or full stop between a letter and white space is always a piece of its own
            mark = _MARK[buf] & before_space & ~after_space & np.r_[False, letter[:-1]]
        word_start = (~space & after_space) | mark
        word_end = ~space & (before_space | np.r_[mark[1:], False])
        starts, ends = np.flatnonzero(word_start), np.flatnonzero(word_end) + 1
        if self.words_only:
            return starts, ends, np.zeros(len(starts), bool)
        prev = np.maximum(starts - 1, 0)
        blank = (starts > 0) & ~edge[starts] & (buf[prev] == 0x20)
        if not (space & ~(np.r_[~space[1:], False] & ~edge[1:] & (buf == 0x20))).any():
            return starts, ends, blank
        # runs of white space: all but the last character is a piece; the last is one if it is no blank;
        # at a text's end the whole run is one
        first = np.flatnonzero(space & (np.r_[True, ~space[:-1]] | edge[:-1]))
        last = np.flatnonzero(space & (np.r_[~space[1:], True] | edge[1:]))
        at_end = edge[last + 1]
        s1, e1 = first, np.where(at_end, last + 1, last)
        keep1 = e1 > s1
        keep2 = ~at_end & (buf[last] != 0x20)
        starts = np.concatenate([starts, s1[keep1], last[keep2]])
        ends = np.concatenate([ends, e1[keep1], last[keep2] + 1])
        blank = np.concatenate([blank, np.zeros(int(keep1.sum() + keep2.sum()), bool)])
        order = np.argsort(starts, kind="stable")
        return starts[order], ends[order], blank[order]

    def _lookup(self, buf: np.ndarray, h: np.ndarray, starts: np.ndarray, ends: np.ndarray, blank: np.ndarray) -> np.ndarray:
        """The row of each piece among the known ones; those that are not there are encoded."""
        if self.known.used > self.most or self.used > 8 * self.most:
            self._reset()
        at, lacking = self.known.find(h)
        if len(lacking):
            distinct, first = np.unique(h[lacking], return_index=True)
            new, raw = lacking[first], buf.tobytes()
            texts = [(" " if b else "") + raw[s:e].decode("utf-8") for s, e, b in zip(starts[new].tolist(), ends[new].tolist(), blank[new].tolist())]
            flat, begin, counts = self._encode(texts)
            need = self.used + len(flat)
            if need > len(self.flat):
                self.flat.resize(max(need, len(self.flat) * 5 // 4), refcheck=False)
            self.flat[self.used : need] = flat
            self.known.add(distinct, self.used + begin, counts)
            self.used = need
            at, _ = self.known.find(h)
        return at

    def _encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, where each text's begin, how many each has)."""
        begin, counts = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
        flat: list[np.ndarray] = []
        used, rest = 0, list(range(len(texts)))
        if self.words_only:  # letters only make one word each, whose last id has the mark of an end
            plain = [i for i in rest if _letters_only(texts[i])]
            done = np.zeros(len(texts), bool)
            for a in range(0, len(plain), CALL):
                groups = [plain[k : k + TOGETHER] for k in range(a, min(a + CALL, len(plain)), TOGETHER)]
                joined = [" ".join([texts[i] for i in own]) for own in groups]
                for own, enc in zip(groups, self.tokenizer.encode_batch_fast(joined, add_special_tokens=False)):
                    ids = np.array(enc.ids, np.int32)
                    cuts = np.flatnonzero(self.ends[ids]) + 1
                    if len(cuts) != len(own):
                        continue
                    before = np.r_[0, cuts[:-1]]
                    done[own], begin[own], counts[own] = True, used + before, cuts - before
                    flat.append(ids[: cuts[-1]])
                    used += int(cuts[-1])
            rest = np.flatnonzero(~done).tolist()
        for a in range(0, len(rest), CALL):
            own = rest[a : a + CALL]
            each = [enc.ids for enc in self.tokenizer.encode_batch_fast([texts[i] for i in own], add_special_tokens=False)]
            n = np.array([len(x) for x in each], np.int64)
            counts[own], begin[own] = n, used + np.cumsum(n) - n
            flat.append(np.fromiter(chain.from_iterable(each), np.int32, int(n.sum())))
            used += int(n.sum())
        return np.concatenate([np.zeros(0, np.int32), *flat]), begin, counts


def encoder(path: str, words_only: bool) -> PieceEncoder:
    """This worker's encoder of a tokenizer file."""
    kept = turn_to("tokens")
    if (path, words_only) not in kept:
        kept[path, words_only] = PieceEncoder(path, words_only)
    return kept[path, words_only]
