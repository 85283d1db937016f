"""Score answers: letters of multiple choice, code blocks, and opt-in execution of code."""

from __future__ import annotations

import subprocess
import sys
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

from tracemill.functions.text import is_blank, strip, unused

# Patterns of a chosen letter, tried in order over the upper-cased text, then over its end.
IN_TEXT = (r"(?:ANSWER|CHOICE)\s*(?:IS|:)\s*([A-Z])\b", r"\\BOXED\{([A-Z])\}", r"\b([A-Z])\s*[.\):]?\s*$")
AT_END = (r"\b([A-Z])[.:\)\]]\s+\S+.*$", r"[\(\[]([A-Z])[\)\]]")
END = 200
CODE_BLOCK = r"```(?:python)?\n(.*?)```"


def chosen_letter(text: Column) -> Column:
    """The letter that a response chooses; NULL if none is found."""
    upper = F.upper(text)
    end = F.right(upper, F.lit(END))
    tries = [(upper, p) for p in IN_TEXT] + [(end, p) for p in AT_END]
    return F.coalesce(*[F.nullif(F.regexp_extract(t, "(?dU)" + p, 1), F.lit("")) for t, p in tries])


def code_block(text: Column) -> Column:
    """The first fenced block, or the whole text."""
    return F.when(text.rlike("(?s)" + CODE_BLOCK), F.regexp_extract(text, "(?s)" + CODE_BLOCK, 1)).otherwise(text)


def is_correct_letter(answer: Column, expected: Column) -> Column:
    right = chosen_letter(answer) == F.upper(strip(expected))
    return F.coalesce(~is_blank(answer) & right, F.lit(False))


def is_code_dataset(df: DataFrame) -> bool:
    return {"entry_point", "test_code"} <= set(df.columns)


def code_passes(df: DataFrame, answer: str = "answer", output: str = "correct", seconds: float = 10.0, allow_execution: bool = False) -> DataFrame:
    """Whether an answer's code passes ``test_code``'s check of ``entry_point``.

    This runs code that a model wrote: it must be asked for, and each program runs in a process of
    its own with a time limit. Use it only on executors that are isolated.
    """
    if not allow_execution:
        raise ValueError("running generated code must be allowed explicitly")
    (code_col,) = unused(df.columns, "code")
    rows = df.withColumn(code_col, code_block(F.col(answer)))
    schema = StructType([*df.schema.fields, StructField(output, BooleanType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            passed = []
            for code, test, name in zip(batch[code_col], batch["test_code"], batch["entry_point"]):
                program = "\n".join([str(code), str(test), f"check({name})"])
                try:
                    done = subprocess.run([sys.executable, "-I", "-c", program], capture_output=True, timeout=seconds)
                    passed.append(done.returncode == 0)
                except (subprocess.TimeoutExpired, ValueError, OSError):
                    passed.append(False)
            yield batch.drop(columns=[code_col]).assign(**{output: passed})

    return rows.mapInPandas(run, schema)


def evaluation_report(stats: DataFrame, **run: str) -> DataFrame:
    """A metrics row: pass_at_1 and the structural rates, with what describes the run."""
    names = {"pass_at_1": "pass_at_1", "vr": "valid_reasoning_rate", "ir": "invalid_reasoning_rate", "mr": "missing_reasoning_rate", "tr": "truncated_reasoning_rate", "er": "empty_reasoning_rate"}
    return stats.select(*[F.lit(v).alias(k) for k, v in run.items()], "total", *[F.col(c).alias(n) for n, c in names.items()])


def first_samples(df: DataFrame, sample: str = "sample_id") -> DataFrame:
    """Only the first sample of each task is scored."""
    return df.filter(F.col(sample) == 0)
