from __future__ import annotations

import re
from dataclasses import replace

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tracemill.functions.tokenizers import CodePoints, Words
from tracemill.operators.model import BRACKET, PLAIN, PREFIXED, ModelInfo, TagStyle
from tracemill.operators.parse import FLAGS, effective_info, parse, parse_array
from tracemill.sources import io

THINK = ModelInfo(False)


def restated(text: str, info: ModelInfo) -> dict:
    """What a response means, told with Python's own strings."""
    open_at = re.search(re.escape(info.open_tag), text, re.I)
    close_at = re.search(re.escape(info.close_tag), text, re.I)
    reasoning, answer, kind = "", text, "missing"
    if close_at:
        before = text[: close_at.start()]
        inner = re.search(re.escape(info.open_tag), before, re.I)
        reasoning = (before[: inner.start()] + before[inner.end() :] if inner else before).strip()
        answer, kind = text[close_at.end() :].strip(), "valid" if reasoning else "empty"
    elif open_at:
        reasoning, answer, kind = text[open_at.end() :], "", "truncated"
    elif info.prefixed:
        reasoning, answer, kind = text.strip(), "", "truncated"
    return {"answer": answer, "reasoning": reasoning, "reasoning_tag": None if kind == "missing" else info.tag_content, **{f"has_{k}_reasoning": k == kind for k in ("valid", "truncated", "empty", "missing")}}


CASES = [
    "", "plain", "<think>a</think>b", "a</think>b", "<think>a", "<THINK> \n </Think> b ", "</think>", "x<think>a</think>b</think>c", "<think>", "a<think>b<think>c</think>d",
    " <think>　r\u001c</think>\u0085a ", "<thınk>a</thİnk>b", "<thinK>x</thinK>y", "a < b > c", "😀<think>😀</think>😀", "<think></think>",
    "[THINK]a[/THINK]b", "[think]a", "[/THINK] b",
]


def compare(spark, texts: list[str], info: ModelInfo) -> None:
    got = parse(io.from_flat(spark, texts), info=info).orderBy("sample_id").collect()
    for text, row in zip(texts, got, strict=True):
        want = restated(text, info)
        assert {k: row[k] for k in want} == want, (text, info)
        assert sum(row[f] for f in FLAGS) == 1
        assert row["has_invalid_reasoning"] is not row["has_valid_reasoning"]
        assert row["has_answer"] == bool(row["answer"].strip())


@pytest.mark.parametrize("prefixed", [False, True])
@pytest.mark.parametrize("tag,style", [("think", TagStyle.HTML), ("reasoning", TagStyle.HTML), ("THINK", TagStyle.BRACKET), ("a.b", TagStyle.HTML)])
def test_cases(spark, prefixed, tag, style):
    compare(spark, CASES, ModelInfo(prefixed, tag, style))


parts = st.sampled_from(["<think>", "</think>", "<THINK>", "</Think>", " ", "\n", "a", "b c", " ", "é", "<", ">", "think"])


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(parts, max_size=8).map("".join), min_size=1, max_size=40), st.booleans())
def test_random(spark, texts, prefixed):
    compare(spark, texts, ModelInfo(prefixed))


def test_null_response(spark):
    df = spark.createDataFrame([(1, None)], "id int, response string")
    for info in (THINK, ModelInfo(True)):
        row = parse(df, info=info).first()
        assert all(row[c] is None for c in ("answer", "reasoning", "reasoning_tag", "has_answer", "has_invalid_reasoning", *FLAGS))


def test_overrides():
    pre = ModelInfo(True)
    assert effective_info(THINK, add_generation_reasoning=True).prefixed
    assert not effective_info(pre, add_generation_reasoning=False).prefixed
    assert effective_info(THINK, prompt="q<think>\n\n").prefixed
    assert effective_info(THINK, prompt=["q<think>", "q"]).prefixed
    assert not effective_info(THINK, prompt=["q", "q<think>"]).prefixed
    assert not effective_info(THINK, prompt="q<THINK>").prefixed
    assert not effective_info(THINK, prompt=[]).prefixed
    assert effective_info(THINK, prompt="<think>", add_generation_reasoning=False).prefixed  # the prompt still counts
    assert effective_info(pre, template=PLAIN) == THINK  # a template wins
    assert effective_info(THINK, override_tag="x") == THINK  # and only with it does a tag count
    assert effective_info(template=PREFIXED, override_tag="[X]") == replace(pre, tag_content="X", tag_style=TagStyle.BRACKET)
    with pytest.raises(ValueError):
        effective_info()


def test_prompt_column(spark):
    rows = spark.createDataFrame([(1, "a", "q<think>\n"), (2, "a", "q"), (3, "a", None)], "id int, response string, prompt string")
    got = {r["id"]: r["has_truncated_reasoning"] for r in parse(rows, info=THINK, prompt_col="prompt").collect()}
    assert got == {1: True, 2: False, 3: False}


def test_tokens(spark):
    rows = io.from_flat(spark, ["<think>one two</think>three", "x"])
    got = parse(rows, info=THINK, tokenizer=Words()).orderBy("sample_id").collect()
    assert [(r["reasoning_token_count"], r["answer_token_count"]) for r in got] == [(2, 1), (0, 1)]
    assert parse(rows, info=THINK, tokenizer=CodePoints()).first()["reasoning_token_count"] == 7
    assert parse(rows, info=THINK).first()["reasoning_token_count"] is None


def test_shapes(spark):
    nested = io.from_nested(spark, [["<think>a</think>b", "c"], [], ["<think>d"]])
    assert nested.count() == 3 and parse(nested, info=THINK).filter("has_valid_reasoning").count() == 1
    rows = spark.createDataFrame([(["<think>a</think>b", "c"],), ([],)], "r array<string>")
    sizes = rows.select(F.size(parse_array(F.col("r"), THINK)).alias("n")).collect()
    assert [r["n"] for r in sizes] == [2, 0]


def test_other_columns_stay(spark):
    rows = spark.createDataFrame([("<think>a</think>b", 5, "x")], "response string, `odd name` int, extra string")
    assert parse(rows, template=BRACKET).columns[:3] == ["response", "odd name", "extra"]


def test_plan_has_no_python(spark):
    plan = parse(io.from_flat(spark, ["a"]), info=THINK, tokenizer=Words())._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_prompts_do_not_count_for_models_that_were_prefixed(spark):
    df = spark.createDataFrame([("plain", "q<think>\n")], "response string, prompt string")
    for given, add, want in ((True, False, "missing"), (False, False, "truncated"), (False, None, "truncated"), (True, None, "truncated"), (False, True, "truncated")):
        row = parse(df, info=ModelInfo(given), prompt_col="prompt", add_generation_reasoning=add).first()
        assert row[f"has_{want}_reasoning"], (given, add)


def test_columns_with_clashing_names(spark):
    df = spark.createDataFrame([("<think>a</think>b", "old", 1, 2)], "response string, answer string, _parsed int, _closed int")
    row = parse(df, info=ModelInfo(False)).select("answer", "reasoning", "_parsed", "_closed").first()
    assert tuple(row) == ("b", "a", 1, 2)
