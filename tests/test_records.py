"""Distillation, scoring, sources and sinks, streams."""

from __future__ import annotations

import json
import re

import pytest
from pyspark.sql import functions as F

from tracemill.functions.text import WHITE_SPACE, last_index, strip
from tracemill.operators import distill, score
from tracemill.operators.model import ModelInfo
from tracemill.operators.parse import parse
from tracemill.operators.stats import compute_stats
from tracemill.sources import io
from tracemill.streaming.rates import each_batch, windowed_rates


def column(spark, values, make):
    df = spark.createDataFrame([(v,) for v in values], "x string")
    return [r["y"] for r in df.select(make(F.col("x")).alias("y")).collect()]


def test_strip_is_unicode(spark):
    texts = [w + "a b" + w for w in WHITE_SPACE] + ["​a​", "", "  "]
    assert column(spark, texts, strip) == [t.strip() for t in texts]


def test_last_index(spark):
    for text, needle in (("abcabc", "bc"), ("abc", "x"), ("abc", ""), ("", ""), ("😀a😀", "😀"), ("aaa", "aa")):
        assert spark.range(1).select(last_index(F.lit(text), F.lit(needle)).alias("y")).first()["y"] == text.rfind(needle)


def test_distilled_reasoning(spark):
    texts = ["<reasoning_steps>a</reasoning_steps>b", "<REASONING_STEPS> a", "none", "<reasoning_steps> </reasoning_steps>", "<reasoning_steps>a</reasoning_steps><reasoning_steps>b</reasoning_steps>c", "</reasoning_steps>x<reasoning_steps>y", None]
    assert column(spark, texts, distill.distilled_reasoning) == ["a", "a", None, None, "b", "y", None]
    assert column(spark, ["<a.b>x</a.b>", "<axb>x"], lambda c: distill.distilled_reasoning(c, "a.b")) == ["x", None]


def test_update_keeps_what_was_there(spark):
    df = spark.createDataFrame([(1, "old", "none"), (2, "old", "<reasoning_steps>new")], "id int, reasoning string, output string")
    assert [r["reasoning"] for r in distill.update_records(df).orderBy("id").collect()] == ["old", "new"]
    assert distill.update_records(df.drop("reasoning")).orderBy("id").first()["reasoning"] is None


def test_outputs_must_match(spark):
    left, right = spark.createDataFrame([(1,), (2,)], "record_id int"), spark.createDataFrame([(1, "x")], "record_id int, output string")
    assert distill.join_outputs(left.filter("record_id = 1"), right).count() == 1
    with pytest.raises(Exception, match="do not match"):
        distill.join_outputs(left, right).collect()


def test_prompts(spark):
    df = spark.createDataFrame([("Q", "A"), ("Q", None)], "q string, a string")
    rows = distill.build_prompts(df, "q", "a").collect()
    assert rows[0]["prompt"].startswith("I need assistance") and "Question: Q\n\nAnswer: A\n\n" in rows[0]["prompt"] and rows[0]["prompt"].endswith("</reasoning_steps>")
    assert rows[1]["prompt"] is None
    assert distill.build_prompts(df, "q", "a", example="E", tag="t").first()["prompt"].endswith("inside <t> tags.\n\nHere is a complete example:\nE")


def letter(text: str) -> str | None:
    upper = text.upper()
    for t, p in [(upper, p) for p in score.IN_TEXT] + [(upper[-200:], p) for p in score.AT_END]:
        if m := re.search(p, t):
            return m[1]
    return None


def test_letters(spark):
    texts = ["The answer is B.", "answer: c", r"\boxed{d} yes", "it is E", "E)", "A. first thing", "(b) is right, ok", "", "none of it", "x" * 300 + " c. some words", "d. some words" + "x " * 300, "Answer is\n\nB\n", "é is A\u0085", "answer is Bb"]
    assert column(spark, texts, score.chosen_letter) == [letter(t) for t in texts]
    df = spark.createDataFrame([("answer is b", " B "), ("", "B"), ("what", "B")], "a string, e string")
    assert [r["y"] for r in df.select(score.is_correct_letter(df.a, df.e).alias("y")).collect()] == [True, False, False]


def test_code(spark):
    texts = ["a\n```python\nx\n```\nb", "```\ny\n``` ```\nz\n```", "plain", "```python no```"]
    assert column(spark, texts, score.code_block) == ["x\n", "y\n", "plain", "```python no```"]
    rows = [("```python\ndef f(x): return x + 1\n```", "f", "def check(g): assert g(1) == 2"), ("def f(x): return x", "f", "def check(g): assert g(1) == 2"), ("while True: pass", "f", "def check(g): pass")]
    df = spark.createDataFrame(rows, "answer string, entry_point string, test_code string")
    assert score.is_code_dataset(df)
    with pytest.raises(ValueError):
        score.code_passes(df)
    assert [r["correct"] for r in score.code_passes(df, allow_execution=True, seconds=3).collect()] == [True, False, False]


def test_report(spark):
    parsed = parse(io.from_nested(spark, [["<think>a</think>b"], ["c"]]), info=ModelInfo(False)).withColumn("correct", F.lit(True))
    row = score.evaluation_report(compute_stats(parsed, "task_id", "correct"), model="m").first()
    assert (row["model"], row["total"], row["vr"], row["pass_at_1"]) == ("m", 2, 0.5, 1.0)
    assert json.loads(io.metrics_json(compute_stats(parsed)).first()["metrics"])["pass_at_1"] is None


def test_sources(spark, tmp_path):
    (tmp_path / "r.jsonl").write_text('{"instruction": "q", "response": "a"}\n{"instruction": "q2"}\n')
    assert io.read_jsonl(spark, str(tmp_path / "r.jsonl"), "instruction string, response string").filter("response is null").count() == 1
    assert io.resolve("gsm8k", "d/") == "d/gsm8k_256.jsonl" and io.resolve("x/y.jsonl") == "x/y.jsonl"
    (tmp_path / "c.yaml").write_text("default: {a: 1, b: 2}\nfast: {b: 3}\n")
    path = str(tmp_path / "c.yaml")
    assert io.read_profile(path, "fast", "default") == {"a": 1, "b": 3} and io.read_profile(path, "fast") == {"b": 3} and io.read_profile(path, "none") == {}
    turns = spark.createDataFrame([(1, 1, "assistant", "a"), (1, 0, "user", "q")], "conv_id int, turn int, role string, text string")
    assert [m["content"] for m in io.conversations(turns).first()["messages"]] == ["q", "a"]


def test_stream(spark, tmp_path):
    rows = spark.sql("select timestamp_ntz'2024-01-01 00:10:00' as ts, '<think>a</think>b' as response union all select timestamp_ntz'2024-01-01 00:20:00', 'c' union all select timestamp_ntz'2024-01-01 02:00:00', 'c'")
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    run = windowed_rates(stream, ModelInfo(False)).writeStream.format("memory").queryName("rates").outputMode("complete").trigger(availableNow=True).start()
    run.awaitTermination(60)
    assert sorted(tuple(r) for r in spark.table("rates").select("total", "valid_reasoning_rate").collect()) == [(1, 0.0), (2, 0.5)]
    kept = []
    run = each_batch(stream, ModelInfo(False), compute_stats, lambda df, n: kept.append(df.first()["total"])).trigger(availableNow=True).start()
    run.awaitTermination(60)
    assert sum(kept) == 3
