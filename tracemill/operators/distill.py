"""Prompts that ask for reasoning, and what comes back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracemill.functions.text import after_last, any_case, halves, strip, unused

# The default wording of a distillation prompt.
PREAMBLE = (
    "I need assistance constructing a reasoning dataset.\n"
    "Given the following question and its correct answer, give a concise summary of the reasoning steps that explains how to arrive at the answer."
)
TAG = "reasoning_steps"
QUESTION, ANSWER = "\n\nQuestion: ", "\n\nAnswer: "
ASK = "\n\nIn your response, give the reasoning steps inside <{tag}> tags."
START = "\n\nStart your reasoning with 'Okay, ', for example:\n<{tag}>\nOkay, [your reasoning steps here]\n</{tag}>"
EXAMPLE = "\n\nHere is a complete example:\n{example}"


def distill_prompt(instruction: Column, response: Column, tag: str = TAG, preamble: str = PREAMBLE, example: str | None = None) -> Column:
    """A NULL field makes a NULL prompt."""
    closing = START.format(tag=tag) if example is None else EXAMPLE.format(example=example)
    return F.concat(F.lit(preamble + QUESTION), instruction, F.lit(ANSWER), response, F.lit(ASK.format(tag=tag) + closing))


def build_prompts(df: DataFrame, instruction: str = "instruction", response: str = "response", output: str = "prompt", **options: str | None) -> DataFrame:
    return df.withColumn(output, distill_prompt(F.col(instruction), F.col(response), **options))


def distilled_reasoning(text: Column, tag: str = TAG) -> Column:
    """What follows the last open tag, up to the close tag if one comes; NULL if blank or no tag."""
    inside = halves(after_last(text, any_case(f"<{tag}>")), any_case(f"</{tag}>"))[0]
    return F.nullif(strip(inside), F.lit(""))


def update_records(records: DataFrame, output: str = "output", field: str = "reasoning", tag: str = TAG) -> DataFrame:
    """Records with ``field`` set where reasoning is found in ``output``; else it stays as it was."""
    found = distilled_reasoning(F.col(output), tag)
    return records.withColumn(field, F.coalesce(found, F.col(field)) if field in records.columns else found)


def join_outputs(records: DataFrame, outputs: DataFrame, on: str = "record_id") -> DataFrame:
    """Records with their outputs; one without the other is an error, as lists of unequal lengths are."""
    left, right = unused([*records.columns, *outputs.columns], "left", "right")
    both = records.withColumn(left, F.lit(1)).join(outputs.withColumn(right, F.lit(1)), on, "full_outer")
    bad = F.raise_error(F.lit("records and outputs do not match"))
    key = F.when(F.col(left).isNull() | F.col(right).isNull(), bad.cast(records.schema[on].dataType)).otherwise(F.col(on))
    return both.withColumn(on, key).drop(left, right)


def conversation(instruction: Column, response: Column, reasoning: Column | None = None) -> Column:
    """Two messages; a NULL reasoning is none."""
    none = F.lit(None).cast("string")

    def message(role: str, content: Column, thought: Column) -> Column:
        return F.struct(F.lit(role).alias("role"), content.alias("content"), thought.alias("reasoning"))

    return F.array(message("user", instruction, none), message("assistant", response, none if reasoning is None else reasoning))


def to_conversations(df: DataFrame, instruction: str = "instruction", response: str = "response", reasoning: str = "reasoning", output: str = "messages", strategy: str | None = None) -> DataFrame:
    """Records as conversations; strategy ``empty`` gives '' where reasoning is missing."""
    thought = F.col(reasoning) if reasoning in df.columns else F.lit(None).cast("string")
    if strategy == "empty":
        thought = F.coalesce(thought, F.lit(""))
    return df.withColumn(output, conversation(F.col(instruction), F.col(response), thought))


def prompt_conversation(prompt: Column) -> Column:
    return F.array(F.struct(F.lit("user").alias("role"), prompt.alias("content"), F.lit(None).cast("string").alias("reasoning")))
