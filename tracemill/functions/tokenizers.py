"""Tokenizers: native ones are Column expressions; files of the tokenizers library run as Arrow UDFs."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from typing import Protocol

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F


class ColumnTokenizer(Protocol):
    def encode(self, text: Column, most: int | None = None) -> Column: ...

    def count(self, text: Column, most: int | None = None) -> Column: ...


def _at_most(n: Column, most: int | None) -> Column:
    return n if most is None else F.least(n, F.lit(most))


@dataclass(frozen=True)
class CodePoints:
    """One token a character; its id is the code point."""

    def encode(self, text: Column, most: int | None = None) -> Column:
        ids = F.transform(F.filter(F.split(text, ""), lambda c: c != ""), F.ascii)
        return ids if most is None else F.slice(ids, 1, most)

    def count(self, text: Column, most: int | None = None) -> Column:
        return _at_most(F.length(text), most)


@dataclass(frozen=True)
class Words:
    """One token a run of other than blanks and line feeds; ids are 31-bit hashes."""

    def _words(self, text: Column) -> Column:
        return F.filter(F.split(text, "[ \n]"), lambda w: w != "")

    def encode(self, text: Column, most: int | None = None) -> Column:
        ids = F.transform(self._words(text), lambda w: F.pmod(F.xxhash64(w), F.lit(1 << 31)).cast("int"))
        return ids if most is None else F.slice(ids, 1, most)

    def count(self, text: Column, most: int | None = None) -> Column:
        return _at_most(F.size(self._words(text)), most)


@dataclass(frozen=True)
class TokenizerFile:
    """A tokenizer of the tokenizers library, loaded once a worker from ``path``.

    Texts go to a worker in batches of BATCH_ROWS rows and about BATCH_BYTES bytes, for which ``encode`` and ``count`` set the
    session's options, and to the library in parts of about AT_ONCE bytes; a longer text goes alone.
    """

    path: str

    def encode(self, text: Column, most: int | None = None) -> Column:
        path = self.path
        _small_batches()

        @F.arrow_udf("array<int>")
        def ids(texts: pa.Array) -> pa.Array:
            found = [np.zeros(0, np.int32), *_ids(path, texts)]
            offsets = np.cumsum([len(x) for x in found], dtype=np.int32)
            return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(found)), mask=texts.is_null())

        out = ids(text)
        return out if most is None else F.slice(out, 1, most)

    def count(self, text: Column, most: int | None = None) -> Column:
        path = self.path
        _small_batches()

        @F.arrow_udf("int")
        def n(texts: pa.Array) -> pa.Array:
            counts = np.array([len(x) for x in _ids(path, texts)], np.int32)
            return pa.array(counts, mask=texts.is_null().to_numpy(zero_copy_only=False))

        return _at_most(n(text), most)


#: Rows and bytes of an Arrow batch, and bytes of text that the library has at once: what it keeps of a token until its
#: ids are taken is a hundred times the id.
BATCH_ROWS, BATCH_BYTES, AT_ONCE = 1000, 8 << 20, 1 << 18


def _small_batches() -> None:
    spark = SparkSession.active()
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


_loaded: dict[str, object] = {}


def _ids(path: str, texts: pa.Array) -> Iterator[np.ndarray]:
    """Each text's ids; none for a null."""
    if path not in _loaded:
        from tokenizers import Tokenizer

        _loaded[path] = Tokenizer.from_file(path)
    texts = texts.fill_null("")
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False), dtype=np.int64)
    at = 0
    while at < len(texts):
        before = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + AT_ONCE, side="right")))
        for x in _loaded[path].encode_batch_fast(texts[at:to].to_pylist(), add_special_tokens=False):
            yield np.array(x.ids, np.int32)
        at = to
