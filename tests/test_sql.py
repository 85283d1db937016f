from __future__ import annotations

from pyspark.sql import functions as F

from tests.test_parse import CASES
from tracemill.functions.sql import register
from tracemill.operators import distill, score
from tracemill.operators.model import ModelInfo, TagStyle
from tracemill.operators.parse import parsed, parsed_by_model


def test_sql_functions_are_the_operators(spark):
    assert "chosen_letter" in register(spark)
    texts = [*CASES, "The answer is B.", r"\boxed{C} so", "(d) it is", "```python\nx\n```", "<reasoning_steps>a</reasoning_steps> <Reasoning_Steps> b ", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for info in (ModelInfo(False), ModelInfo(True), ModelInfo(False, "THINK", TagStyle.BRACKET)):
        call = f"(t, '{info.open_tag}', {str(info.prefixed).lower()})"
        got = df.selectExpr(f"response_reasoning{call} r", f"response_answer{call} a", f"response_outcome{call} o").collect()
        want = df.select(parsed(F.col("t"), info).alias("p")).select("p.*").collect()
        for g, w, t in zip(got, want, texts, strict=True):
            kind = next((k for k in ("valid", "truncated", "empty", "missing") if w[f"has_{k}_reasoning"]), None)
            assert (g["r"], g["a"], g["o"]) == (w["reasoning"], w["answer"], kind), t
    t = F.col("t")
    pairs = [("chosen_letter(t)", score.chosen_letter(t)), ("code_block(t)", score.code_block(t)), ("distilled_reasoning(t, 'reasoning_steps')", distill.distilled_reasoning(t))]
    for sql, column in pairs:
        assert [r[0] for r in df.selectExpr(sql).collect()] == [r[0] for r in df.select(column).collect()]


def test_by_model(spark):
    df = spark.createDataFrame([("<think>a</think>b", "x"), ("[THINK]a[/THINK]b", "y"), ("<think>a", "z")], "r string, m string")
    infos = {"x": ModelInfo(False), "y": ModelInfo(False, "THINK", TagStyle.BRACKET)}
    got = df.select(parsed_by_model(F.col("r"), F.col("m"), infos).alias("p")).select("p.reasoning", "p.reasoning_tag").collect()
    assert [tuple(r) for r in got] == [("a", "think"), ("a", "THINK"), (None, None)]
