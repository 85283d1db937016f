from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tracemill.operators.chat import apply_chat_templates, inject_prefixes
from tracemill.operators.distill import to_conversations
from tracemill.operators.model import PLAIN, PREFIXED, STRIPPING, TEMPLATES, ModelInfo, detect_model
from tracemill.sources import io

HISTORY = [{"role": "user", "content": "q1"}, {"role": "assistant", "content": "a1", "reasoning": "r1"}, {"role": "user", "content": "q2"}]
INFO = ModelInfo(False)


def prompt_of(spark, conversation, spec, **options):
    return apply_chat_templates(io.from_conversations(spark, [conversation]), spec, **options).first()["prompt"]


def test_history(spark):
    assert prompt_of(spark, HISTORY, PLAIN) == "<|user|>\nq1<|end|>\n<|assistant|>\n<think>\nr1\n</think>\na1<|end|>\n<|user|>\nq2<|end|>\n"
    blank = [HISTORY[0], {**HISTORY[1], "reasoning": ""}]
    assert "<|assistant|>\n<think>\n</think>\na1<|end|>" in prompt_of(spark, blank, PLAIN)
    none = [HISTORY[0], {"role": "assistant", "content": "a1"}]
    assert "<think>" not in prompt_of(spark, none, PLAIN)


def test_stripping_template_keeps_given_reasoning(spark):
    raw = [{"role": "user", "content": " q "}, {"role": "assistant", "content": "<think>\nold\n</think>\n\nkept"}, {"role": "assistant", "content": " a ", "reasoning": "r"}]
    assert prompt_of(spark, raw, STRIPPING) == "<s>[user] q\n[assistant] kept\n[assistant] <think>\nr\n</think>\n a \n"


def test_native_render_is_the_local_one(spark):
    conv = [{"role": r, "content": c} for r, c in (("system", "s "), ("user", "u\n"), ("assistant", "<think>x</think>\ny</think> z"), ("tool", "t"))]
    for spec in TEMPLATES.values():
        for generate in (True, False):
            want = spec.rendered_locally([(m["role"], m["content"]) for m in conv], generate)
            assert prompt_of(spark, conv, spec, add_generation_prompt=generate) == want


#: (prompt, thought prefix, response prefix, add_generation_reasoning) and the prompt that is expected, one by one.
SEEDED = [
    ("q\n\n", None, None, None, "q\n\n"),
    ("q<think>\n", None, None, None, "q<think>\n"),
    ("", None, None, True, "\n<think>"),
    ("q", None, None, True, "q\n<think>"),
    ("q\n\n", None, None, True, "q\n<think>"),
    ("q<think>\n", None, None, True, "q<think>"),
    ("q<THINK>", None, None, True, "q<THINK>\n<think>"),
    ("q\n", None, None, False, "q"),
    ("q\n<think>\n\n", None, None, False, "q\n"),
    ("<think>", None, None, False, ""),
    ("q", "Okay, ", None, None, "q\n<think>\nOkay, "),
    ("q\n<think>\n", "Okay, ", None, None, "q\n<think>\nOkay, "),
    ("q\n<think>\n", "", None, True, "q\n<think>\n"),
    ("q<THINK>", "Okay, ", None, True, "q<THINK>\n<think>\nOkay, "),
    ("q\n", None, "Answer:", None, "q\nAnswer:"),
    ("q\n", None, "Answer:", True, "q\nAnswer:"),
    ("q\n<think>\n", None, "Answer:", None, "q\n<think>\n</think>\nAnswer:"),
    ("q\n<think>\n", None, "Answer:", True, "q\n<think>\n</think>\nAnswer:"),
    ("q\n<think>\n", None, "Answer:", False, "q\n\nAnswer:"),
    ("q\n", None, "Answer:", False, "q\nAnswer:"),
    ("q\n", None, "", None, "q\n"),
    ("q", "Okay, ", "Answer:", None, "q\n<think>\nOkay, \n</think>\nAnswer:"),
    ("q<think>", "Okay, ", "Answer:", True, "q<think>\nOkay, \n</think>\nAnswer:"),
    ("q<think>", "", "", None, "q<think>\n\n</think>\n"),
]


def test_seeded_prompts(spark):
    for include in (None, True, False):
        rows = [(p, t, r, want) for p, t, r, given, want in SEEDED if given is include]
        df = spark.createDataFrame(rows, "p string, t string, r string, want string")
        got = df.select("want", inject_prefixes(df.p, INFO, df.t, df.r, include).alias("x")).collect()
        assert [g["x"] for g in got] == [g["want"] for g in got]


def test_literal_prefixes(spark):
    assert prompt_of(spark, HISTORY[:1], PREFIXED, add_generation_prompt=True, think_prefix="Okay, ").endswith("<|assistant|>\n<think>\nOkay, ")
    assert prompt_of(spark, HISTORY[:1], PLAIN, add_generation_prompt=True, add_generation_reasoning=True, response_prefix="A:").endswith("<|assistant|>\nA:")
    rows = io.from_conversations(spark, [HISTORY[:1]] * 2).withColumn("t", F.when(F.col("conv_id") == 0, "x"))
    got = [r["prompt"] for r in apply_chat_templates(rows, PLAIN, think_prefix=F.col("t"), add_generation_prompt=True).orderBy("conv_id").collect()]
    assert got[0].endswith("<think>\nx") and got[1].endswith("<|assistant|>\n")


def test_options_are_checked(spark):
    df = io.from_conversations(spark, [HISTORY])
    for options in ({"add_generation_reasoning": False, "think_prefix": "x"}, {"add_generation_prompt": False, "response_prefix": "x"}, {"add_generation_prompt": False, "add_generation_reasoning": True}):
        with pytest.raises(ValueError):
            apply_chat_templates(df, PLAIN, **options)


def test_override_tag(spark):
    assert "<why>\nr1\n</why>\na1" in prompt_of(spark, HISTORY, PLAIN, override_tag="why")


def test_records_round(spark):
    records = spark.createDataFrame([("q", "a", None), ("q", "a", ""), ("q", "a", "r")], "instruction string, response string, reasoning string")
    got = [r["prompt"].count("<think>") for r in apply_chat_templates(to_conversations(records), PLAIN).collect()]
    assert got == [0, 1, 1]
    assert all(r["prompt"].count("<think>") == 1 for r in apply_chat_templates(to_conversations(records, strategy="empty"), PLAIN).collect())
    assert detect_model(PLAIN).prefixed is False
