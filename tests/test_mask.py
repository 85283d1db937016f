from __future__ import annotations

import itertools
import types

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tracemill.functions import tokenizers as column_tokenizers
from tracemill.functions.tokenizers import CodePoints, TokenizerFile
from tracemill.operators.mask import STRATEGIES, MaskType, apply_mask
from tracemill.operators.model import PLAIN, PREFIXED, STRIPPING
from tracemill.sources import io


def conv(reasoning=None, answer="the answer", question="why?"):
    last = {"role": "assistant", "content": answer}
    if reasoning is not None:
        last["reasoning"] = reasoning
    return [{"role": "user", "content": question}, last]


CASES = [conv("because"), conv(""), conv(), conv("r", "why?"), conv("r", ""), conv("é😀", "a😀"), conv("r", "x", "say <think> now"), conv("the answer", "the answer"), conv("  ", " spaced "), conv(None, "a <think> b")]


def restated(text: str, reply: str, flags: int, most: int, tag: str = "<think>") -> list[int]:
    ids = [ord(c) for c in text][:most]
    labels = list(ids)
    if not flags:
        return labels
    think = text.find(tag)
    at = text.rfind(reply)
    reply_at = min(len(text[:at]), most)
    think_at = min(think, most) if think >= 0 else None
    for i in range(len(ids)):
        prompt = flags & 1 and i < (think_at if think_at is not None else reply_at)
        block = flags & 2 and think_at is not None and think_at <= i < reply_at
        if prompt or block or (flags & 4 and i >= reply_at):
            labels[i] = -100
    return labels


@pytest.mark.parametrize("spec", [PLAIN, PREFIXED, STRIPPING])
def test_all_flags(spark, spec):
    df = io.from_conversations(spark, CASES)
    for flags, most in itertools.product(range(8), (5, 32768)):
        got = apply_mask(df, spec, masked=MaskType(flags) or None, max_seq_length=most).orderBy("conv_id").collect()
        whole = apply_mask(df, spec, masked=MaskType(flags) or None).orderBy("conv_id").collect()
        for c, row, full in zip(CASES, got, whole, strict=True):
            text = "".join(map(chr, full["input_ids"]))
            assert row["input_ids"] == [ord(x) for x in text][:most]
            assert row["labels"] == restated(text, c[-1]["content"], flags, most), (c, flags, most)
            assert row["attention_mask"] == [1] * len(row["input_ids"])


def text_of(spark, c, spec, **options):
    return "".join(map(chr, apply_mask(io.from_conversations(spark, [c]), spec, **options).first()["input_ids"]))


def test_empty_block_is_injected_only_when_masking(spark):
    assert "<think>\n</think>\nthe answer" in text_of(spark, conv(), PLAIN)
    assert "<think>" not in text_of(spark, conv(), PLAIN, masked=None)
    some = [{"role": "assistant", "content": "x", "reasoning": "r"}, *conv()]
    assert text_of(spark, some, PLAIN).count("<think>") == 1  # any message with reasoning is enough


def test_stripping_template_has_the_block_twice(spark):
    assert text_of(spark, conv("r"), STRIPPING).count("<think>") == 2
    assert text_of(spark, conv("r"), STRIPPING, single_block=True).count("<think>") == 1


def test_options(spark):
    row = apply_mask(io.from_conversations(spark, [conv("r")]), PLAIN, ignore_index=-999, override_tag="why").first()
    assert -999 in row["labels"] and "<why>" in "".join(map(chr, row["input_ids"]))
    assert STRATEGIES["respond"] == MaskType.THINK | MaskType.PROMPT and STRATEGIES["bare"] is None


def test_native_plan(spark):
    df = apply_mask(io.from_conversations(spark, [conv("r")]), PLAIN, tokenizer=CodePoints())
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan


def test_tokenizer_file(spark):
    tokenizers = pytest.importorskip("public_tokenizers")
    tok = TokenizerFile(tokenizers.path("byte_bpe_50k.json"))
    row = apply_mask(io.from_conversations(spark, [conv("because")]), PLAIN, tokenizer=tok, masked=MaskType.RESPONSE).first()
    assert len(row["labels"]) == len(row["input_ids"]) and row["labels"][-1] == -100 and row["labels"][0] == row["input_ids"][0]


def test_tokenizer_file_is_given_some_texts_at_a_time(spark, monkeypatch):
    class Spy:
        given = []

        def encode_batch(self, texts, add_special_tokens):
            self.given.append(sum(map(len, texts)))
            return [types.SimpleNamespace(ids=[ord(c) for c in t]) for t in texts]

        encode_batch_fast = encode_batch

    monkeypatch.setitem(column_tokenizers._loaded, "spy", Spy())
    texts = [None, "", "x" * 1_000_000, *["some words" * 300] * 1000, None]
    got = list(column_tokenizers._ids("spy", pa.array(texts)))
    assert [len(x) for x in got] == [len(t or "") for t in texts]
    assert sorted(Spy.given)[-2] <= 1 << 18 and max(Spy.given) == 1_000_000


def test_tokenizer_file_agrees_with_the_library(spark):
    from tokenizers import Tokenizer

    path = pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")
    texts = [None, "", " two  words\n", "é😀", "a long one " * 40_000, *[f"number {i}" for i in range(2500)], None]
    tok, text = TokenizerFile(path), F.col("text")
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string").coalesce(1)
    df = df.select("id", tok.encode(text).alias("ids"), tok.encode(text, 3).alias("three"), tok.count(text).alias("n"), tok.count(text, 3).alias("n3"))
    plain = Tokenizer.from_file(path)
    for row, t in zip(df.orderBy("id").collect(), texts, strict=True):
        want = None if t is None else plain.encode(t, add_special_tokens=False).ids
        assert (row["ids"], row["n"]) == (want, None if t is None else len(want))
        # a null's count is at most the bound, as least() leaves nulls out
        assert row["three"] == (None if t is None else want[:3]) and row["n3"] == (3 if t is None else min(3, len(want)))
