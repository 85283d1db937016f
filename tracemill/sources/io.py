"""Sources and sinks: records, generations, conversations, configuration, metrics."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Short names of evaluation sets and their files.
DATASETS = {"chemistry": "chemistry_256.jsonl", "gsm8k": "gsm8k_256.jsonl", "evalplus": "evalplus_256.jsonl"}
MESSAGES = "array<struct<role: string, content: string, reasoning: string>>"


def resolve(name: str, folder: str = "data", names: Mapping[str, str] = DATASETS) -> str:
    """The path that a short name stands for; anything else is a path itself."""
    return f"{folder.rstrip('/')}/{names[name]}" if name in names else name


def read_jsonl(spark: SparkSession, path: str, schema: str | StructType | None = None) -> DataFrame:
    return (spark.read.schema(schema) if schema else spark.read).json(path)


def read_profile(path: str, profile: str, base: str | None = None) -> dict:
    """A profile of a YAML file, over ``base`` if that is named; an unknown one is empty."""
    import yaml

    found = yaml.safe_load(Path(path).read_text()) or {}
    return {**(found.get(base) or {} if base else {}), **(found.get(profile) or {})}


def from_nested(spark: SparkSession, responses: Sequence[Sequence[str]]) -> DataFrame:
    """[task][sample] lists as (task_id, sample_id, response)."""
    rows = [(t, s, r) for t, samples in enumerate(responses) for s, r in enumerate(samples)]
    return spark.createDataFrame(rows, "task_id int, sample_id int, response string")


def from_flat(spark: SparkSession, responses: Sequence[str]) -> DataFrame:
    return spark.createDataFrame(list(enumerate(responses)), "sample_id int, response string")


def from_conversations(spark: SparkSession, conversations: Sequence[Sequence[Mapping[str, str]]]) -> DataFrame:
    rows = [(i, [(m["role"], m.get("content"), m.get("reasoning")) for m in c]) for i, c in enumerate(conversations)]
    return spark.createDataFrame(rows, f"conv_id int, messages {MESSAGES}")


def samples(df: DataFrame, outputs: str = "outputs", keys: Sequence[str] = ("task_id",)) -> DataFrame:
    """An array of generations by task as rows (keys, sample_id, response)."""
    return df.select(*keys, F.posexplode(outputs).alias("sample_id", "response"))


def conversations(turns: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", content: str = "text", reasoning: str | None = None) -> DataFrame:
    """Long form (key, turn, role, content) as one row of messages a conversation, in order."""
    thought = F.col(reasoning) if reasoning else F.lit(None).cast("string")
    message = F.struct(F.col(turn).alias("turn"), F.col(role).alias("role"), F.col(content).alias("content"), thought.alias("reasoning"))
    ordered = F.array_sort(F.collect_list(message))
    return turns.groupBy(key).agg(F.transform(ordered, lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content"), m["reasoning"].alias("reasoning"))).alias("messages"))


def write_metrics(stats: DataFrame, path: str) -> None:
    stats.coalesce(1).write.mode("overwrite").json(path)


def metrics_json(stats: DataFrame) -> DataFrame:
    return stats.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("metrics"))


def write_sequences(masked: DataFrame, path: str) -> None:
    """input_ids, labels and attention_mask as Parquet."""
    masked.select("input_ids", "labels", "attention_mask").write.mode("overwrite").parquet(path)
