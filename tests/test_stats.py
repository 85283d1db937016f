from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tracemill.functions.tokenizers import Words
from tracemill.operators.model import ModelInfo
from tracemill.operators.parse import parse
from tracemill.operators.stats import OPTIONAL, RATES, SHORT, compute_stats, short_names, with_results
from tracemill.sources import io

THINK = ModelInfo(False)
V, E, T, M = "<think>r s</think>a", "<think> </think>", "<think>r", "a b"


def nested(spark, tasks, results=None):
    rows = [(t, s, r, None if results is None else results[t][s]) for t, own in enumerate(tasks) for s, r in enumerate(own)]
    return parse(spark.createDataFrame(rows, "task_id int, sample_id int, response string, correct boolean"), info=THINK, tokenizer=Words())


def test_flat(spark):
    row = short_names(compute_stats(nested(spark, [[V, E, T, M]], [[True, True, False, False]]), correct_col="correct")).first()
    assert row["total"] == 4 and row["vr"] == row["er"] == row["tr"] == row["mr"] == 0.25 and row["ir"] == 0.75 and row["ar"] == 0.5
    assert row["pass_at_1"] == 0.5 and row["rpass_at_1"] == 1.0
    assert row["vr"] + row["ir"] == 1 and sum(row[k] for k in ("vr", "tr", "er", "mr")) == 1
    assert set(SHORT.values()) == set(RATES)


def test_macro_is_not_micro(spark):
    data = nested(spark, [[V], [M, M, M]], [[True], [False, True, False]])
    row = compute_stats(data, "task_id", "correct").first()
    assert row["valid_reasoning_rate"] == 0.5 and row["total"] == 4
    assert row["pass_at_1"] == pytest.approx((1 + 1 / 3) / 2) and row["rpass_at_1"] == 1.0
    assert compute_stats(data).first()["valid_reasoning_rate"] == 0.25


def test_empty_input(spark):
    for task in (None, "task_id"):
        row = compute_stats(nested(spark, [[]]), task, "correct").first()
        assert row["total"] == 0 and all(row[c] == 0.0 for c in RATES) and all(row[c] is None for c in OPTIONAL)


def test_empty_task_counts_with_zero(spark):
    tasks = spark.createDataFrame([(0,), (1,)], "task_id int")
    row = compute_stats(nested(spark, [[V]], [[True]]), "task_id", "correct", tasks=tasks).first()
    assert row["valid_reasoning_rate"] == 0.5 and row["pass_at_1"] == 1.0 and row["total"] == 1


def test_tokens(spark):
    row = compute_stats(nested(spark, [[V, M]])).first()
    assert row["avg_reasoning_tokens"] == 1.0 and row["avg_answer_tokens"] == 1.5
    without = nested(spark, [[V, M]]).withColumn("reasoning_token_count", F.lit(None).cast("int"))
    assert compute_stats(without).first()["avg_answer_tokens"] is None  # both depend on reasoning counts


def test_no_valid_reasoning(spark):
    assert compute_stats(nested(spark, [[M, E]], [[True, True]]), correct_col="correct").first()["rpass_at_1"] is None


def test_grouped(spark):
    rows = nested(spark, [[V], [M]]).withColumn("g", F.col("task_id"))
    got = {r["g"]: r["valid_reasoning_rate"] for r in compute_stats(rows, "task_id", group_by=["g"]).collect()}
    assert got == {0: 1.0, 1: 0.0}


def test_results_must_match(spark):
    parsed = nested(spark, [[V, M]]).drop("correct")
    good = spark.createDataFrame([(0, 0, True), (0, 1, False)], "task_id int, sample_id int, correct boolean")
    assert with_results(parsed, good).filter("correct").count() == 1
    with pytest.raises(Exception, match="do not match"):
        with_results(parsed, good.filter("sample_id = 0")).collect()


def test_macro_plan(spark):
    plan = compute_stats(parse(io.from_nested(spark, [[V]]), info=THINK), "task_id")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Python" not in plan
