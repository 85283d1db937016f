"""Rates over parsed responses, flat or as the unweighted mean over tasks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracemill.functions.text import unused

RATES = {
    "valid_reasoning_rate": "has_valid_reasoning",
    "invalid_reasoning_rate": "has_invalid_reasoning",
    "missing_reasoning_rate": "has_missing_reasoning",
    "truncated_reasoning_rate": "has_truncated_reasoning",
    "empty_reasoning_rate": "has_empty_reasoning",
    "answer_rate": "has_answer",
}
OPTIONAL = ("avg_reasoning_tokens", "avg_answer_tokens", "pass_at_1", "rpass_at_1")
SHORT = {"vr": "valid_reasoning_rate", "ir": "invalid_reasoning_rate", "mr": "missing_reasoning_rate", "tr": "truncated_reasoning_rate", "er": "empty_reasoning_rate", "ar": "answer_rate"}


def _one(flag: str | Column) -> Column:
    return (F.col(flag) if isinstance(flag, str) else flag).cast("double")


def _aggregates(correct_col: str | None, tokens: bool, real: Column) -> list[Column]:
    """Over rows of one group; rows where ``real`` is false stand for a group without responses."""
    n = F.sum(real.cast("long"))
    out = [F.coalesce(n, F.lit(0)).alias("total")]
    out += [F.coalesce(F.avg(F.when(real, _one(flag))), F.lit(0.0)).alias(name) for name, flag in RATES.items()]
    for name, c in (("avg_reasoning_tokens", "reasoning_token_count"), ("avg_answer_tokens", "answer_token_count")):
        mean = F.sum(F.when(real, F.coalesce(F.col(c), F.lit(0)))) / n if tokens else F.lit(None)
        # both means depend on whether any reasoning count is there
        seen = F.count("reasoning_token_count") > 0 if tokens else F.lit(False)
        out.append(F.when(seen, mean).cast("double").alias(name))
    right = _one(correct_col) if correct_col else F.lit(None).cast("double")
    out.append(F.avg(F.when(real, right)).alias("pass_at_1"))
    out.append(F.avg(F.when(real & F.col("has_valid_reasoning"), right)).alias("rpass_at_1"))
    return out


def compute_stats(df: DataFrame, task_col: str | None = None, correct_col: str | None = None, group_by: Sequence[str] = (), tasks: DataFrame | None = None) -> DataFrame:
    """One row (one for each ``group_by`` value): total, six rates and four optional means.

    With ``task_col`` rates are taken by task and averaged over tasks, each counting alike; ``total``
    is summed. ``tasks``: a table of all tasks, so that those without responses count with rates
    of 0 and no optional means. No rows give zero rates. Optional means are NULL where nothing
    they need is there.
    """
    tokens = "reasoning_token_count" in df.columns
    group = list(group_by)
    if task_col is None:
        return df.groupBy(*group).agg(*_aggregates(correct_col, tokens, F.lit(True)))
    real = F.lit(True)
    if tasks is not None:
        (has,) = unused(df.columns, "real")
        df = tasks.select(*group, task_col).distinct().join(df.withColumn(has, F.lit(True)), [*group, task_col], "left")
        real = F.coalesce(F.col(has), F.lit(False))
    by_task = df.groupBy(*group, task_col).agg(*_aggregates(correct_col, tokens, real))
    means = [F.coalesce(F.avg(c), F.lit(0.0)).alias(c) for c in RATES] + [F.avg(c).alias(c) for c in OPTIONAL]
    return by_task.groupBy(*group).agg(F.coalesce(F.sum("total"), F.lit(0)).alias("total"), *means)


def with_results(parsed: DataFrame, results: DataFrame, on: Sequence[str] = ("task_id", "sample_id"), correct_col: str = "correct") -> DataFrame:
    """Parsed responses with their results joined by key; a key on one side only is an error.

    One column named ``correct_col`` comes out, that of ``results``.
    """
    l_has, r_has = unused([*parsed.columns, *results.columns], "left", "right")
    left = parsed.drop(*[c for c in [correct_col] if c not in on]).withColumn(l_has, F.lit(1))
    both = left.join(results.select(*on, correct_col).withColumn(r_has, F.lit(1)), list(on), "full_outer")
    bad = F.raise_error(F.lit("responses and results do not match"))
    ok = F.when(F.col(l_has).isNull() | F.col(r_has).isNull(), bad.cast("boolean")).otherwise(F.col(correct_col))
    return both.withColumn(correct_col, ok).drop(l_has, r_has)


def short_names(stats: DataFrame) -> DataFrame:
    """The rates under their short names beside the long ones."""
    return stats.withColumns({s: F.col(c) for s, c in SHORT.items()})
