"""One query for each operator, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill.functions.sql import register
from tracemill.functions.tokenizers import CodePoints, Words
from tracemill.operators import distill, mask, model, score
from tracemill.operators.chat import apply_chat_templates, inject_prefixes
from tracemill.operators.mask import MaskType, apply_mask, label_counts
from tracemill.operators.model import BRACKET, PLAIN, PREFIXED, STRIPPING, TEMPLATES, ModelInfo, TagStyle, detect_model, get_model_info
from tracemill.operators.parse import FLAGS, parse, parse_array, parsed_by_model
from tracemill.operators.stats import OPTIONAL, RATES, compute_stats, short_names, with_results
from tracemill.plans import views
from tracemill.plans.views import view
from tracemill.sources import io

THINK = ModelInfo(False)
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def _responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, views.RESPONSES)


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(c, 9).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


_SPLIT = ("doc_id", "answer", "reasoning", "reasoning_tag", *FLAGS)


@query
def parse_fields(spark, sf_dir):
    return parse(_responses(spark, sf_dir), info=THINK).select("doc_id", "answer", "reasoning", "reasoning_tag")


@query
def parse_flags(spark, sf_dir):
    return parse(_responses(spark, sf_dir), info=THINK).select("doc_id", *FLAGS, "has_invalid_reasoning", "has_answer")


@query
def parse_prefixed(spark, sf_dir):
    return parse(_responses(spark, sf_dir), info=THINK, add_generation_reasoning=True).select(*_SPLIT)


@query
def parse_override_false(spark, sf_dir):
    return parse(_responses(spark, sf_dir), info=ModelInfo(True), add_generation_reasoning=False).select(*_SPLIT)


@query
def parse_prompt_detect(spark, sf_dir):
    return parse(view(spark, sf_dir, views.PROMPTED), info=THINK, prompt_col="prompt").select(*_SPLIT)


@query
def parse_template(spark, sf_dir):
    return parse(_responses(spark, sf_dir), template=PREFIXED).select(*_SPLIT)


@query
def parse_bracket(spark, sf_dir):
    return parse(view(spark, sf_dir, views.BRACKETED), info=ModelInfo(False, "THINK", TagStyle.BRACKET)).select(*_SPLIT)


@query
def parse_custom_tag(spark, sf_dir):
    return parse(view(spark, sf_dir, views.CUSTOM), template=PLAIN, override_tag="<reasoning>").select(*_SPLIT)


@query
def parse_by_model(spark, sf_dir):
    infos = {"plain": THINK, "bracket": ModelInfo(False, "THINK", TagStyle.BRACKET)}
    rows = view(spark, sf_dir, views.MIXED)
    return rows.select("doc_id", "model", parsed_by_model(F.col("response"), F.col("model"), infos).alias("p")).select("doc_id", "model", *[f"p.{c}" for c in _SPLIT[1:]])


@query
def parse_sql_functions(spark, sf_dir):
    """The same by SQL functions, within a statement."""
    register(spark)
    rows = _responses(spark, sf_dir)
    call = "response_{}(response, '<think>', false) as {}"
    return spark.sql(f"select doc_id, {', '.join(call.format(n, n) for n in ('reasoning', 'answer', 'outcome'))} from {{rows}}", rows=rows)


@query
def parse_tokens(spark, sf_dir):
    return parse(_responses(spark, sf_dir), info=THINK, tokenizer=Words()).select("doc_id", "reasoning_token_count", "answer_token_count")


@query
def parse_nested(spark, sf_dir):
    rows = _responses(spark, sf_dir)
    ordered = F.array_sort(F.collect_list(F.struct("doc_id", "response")))
    nested = rows.groupBy("task_id").agg(F.transform(ordered, lambda x: x["response"]).alias("outputs"))
    long = parse(io.samples(nested), info=THINK)
    return long.select("task_id", F.col("sample_id").cast("long").alias("sample_id"), "answer", "reasoning", *FLAGS)


@query
def parse_arrays(spark, sf_dir):
    rows = _responses(spark, sf_dir).select("doc_id", parse_array(F.array("response", F.lit("<think>x")), THINK).alias("p"))
    return rows.select("doc_id", F.size("p").alias("n"), *[F.col("p")[i][f].alias(f"{f}_{i}") for i in (0, 1) for f in ("answer", "reasoning")])


@query
def stats_flat(spark, sf_dir):
    return _rounded(short_names(compute_stats(parse(_responses(spark, sf_dir), info=THINK))).select("total", *RATES, "vr", "ir", "mr", "tr", "er", "ar"))


@query
def stats_macro(spark, sf_dir):
    return _rounded(compute_stats(parse(_responses(spark, sf_dir), info=THINK), task_col="task_id", correct_col="correct").drop(*OPTIONAL[:2]))


@query
def stats_empty_task(spark, sf_dir):
    rows = _responses(spark, sf_dir).filter("task_id >= 10")
    tasks = view(spark, sf_dir, "select distinct doc_id % 100 as task_id from documents")
    return _rounded(compute_stats(parse(rows, info=THINK), "task_id", "correct", tasks=tasks).drop(*OPTIONAL[:2]))


@query
def stats_tokens(spark, sf_dir):
    return _rounded(compute_stats(parse(_responses(spark, sf_dir), info=THINK, tokenizer=CodePoints())).select("total", *OPTIONAL[:2]))


@query
def stats_pass(spark, sf_dir):
    return _rounded(compute_stats(parse(_responses(spark, sf_dir), info=THINK), correct_col="correct").select("total", *OPTIONAL[2:]))


@query
def stats_by_source(spark, sf_dir):
    rows = view(spark, sf_dir, views.RESPONSES.replace("select doc_id,", "select doc_id, source,", 1))
    return _rounded(compute_stats(parse(rows, info=THINK), task_col="task_id", correct_col="correct", group_by=["source"]).drop(*OPTIONAL[:2]))


@query
def stats_join_results(spark, sf_dir):
    rows = _responses(spark, sf_dir)
    parsed = parse(rows.select("doc_id", "task_id", "response"), info=THINK)
    joined = with_results(parsed, rows.select("doc_id", "correct"), on=["doc_id"])
    return _rounded(compute_stats(joined, correct_col="correct").select("total", *OPTIONAL[2:]))


@query
def distill_prompts(spark, sf_dir):
    rows = distill.build_prompts(view(spark, sf_dir, views.RECORDS))
    return distill.build_prompts(rows, output="with_example", tag="why", preamble="Explain.", example="<why>x</why>").select("record_id", "prompt", "with_example")


@query
def distill_extract(spark, sf_dir):
    return view(spark, sf_dir, views.OUTPUTS).select("record_id", distill.distilled_reasoning(F.col("output")).alias("reasoning"))


@query
def distill_update(spark, sf_dir):
    joined = distill.join_outputs(view(spark, sf_dir, views.RECORDS), view(spark, sf_dir, views.OUTPUTS))
    return distill.update_records(joined).select("record_id", "instruction", "response", "reasoning")


def _messages(df: DataFrame) -> DataFrame:
    m = F.col("messages")
    return df.select("record_id", *[m[i][f].alias(f"{f}_{i}") for i in (0, 1) for f in ("role", "content", "reasoning")])


@query
def distill_conversations(spark, sf_dir):
    return _messages(distill.to_conversations(view(spark, sf_dir, views.RECORDS)))


@query
def distill_conversations_empty(spark, sf_dir):
    return _messages(distill.to_conversations(view(spark, sf_dir, views.RECORDS), strategy="empty"))


@query
def choice_extract(spark, sf_dir):
    rows = view(spark, sf_dir, views.CHOICES)
    return rows.select("task_id", score.chosen_letter(F.col("answer")).alias("letter"), score.is_correct_letter(F.col("answer"), F.col("expected")).alias("correct"))


@query
def code_extract(spark, sf_dir):
    return view(spark, sf_dir, views.CODE).select("task_id", score.code_block(F.col("answer")).alias("code"))


@query
def eval_report(spark, sf_dir):
    rows = parse(_responses(spark, sf_dir).withColumn("sample_id", F.floor(F.col("doc_id") / 100)), info=THINK)
    first = score.first_samples(rows)
    key = view(spark, sf_dir, views.CHOICES).select(F.col("task_id").alias("doc_id"), F.col("answer").alias("said"), "expected")
    scored = first.join(key, "doc_id").withColumn("correct", score.is_correct_letter(F.col("said"), F.col("expected")))
    return _rounded(score.evaluation_report(compute_stats(scored, "task_id", "correct"), model="m", dataset="d"))


def _convs(spark: SparkSession, sf_dir: str, sql: str = views.TURNS) -> DataFrame:
    return io.conversations(view(spark, sf_dir, sql), reasoning="reasoning")


def _bare(spark: SparkSession, sf_dir: str) -> DataFrame:
    return io.conversations(view(spark, sf_dir, views.TURNS))


@query
def chat_render(spark, sf_dir):
    return apply_chat_templates(_bare(spark, sf_dir), PLAIN, add_generation_prompt=True).select("conv_id", "prompt")


@query
def chat_reasoning_history(spark, sf_dir):
    return apply_chat_templates(_convs(spark, sf_dir), PLAIN).select("conv_id", "prompt")


@query
def chat_bracket(spark, sf_dir):
    return apply_chat_templates(_convs(spark, sf_dir), BRACKET).select("conv_id", "prompt")


@query
def chat_prefixes(spark, sf_dir):
    rows = _bare(spark, sf_dir).withColumn("start", F.concat(F.lit("Okay, "), F.col("conv_id").cast("string")))
    okay, answer = F.lit("Okay, "), F.lit("Answer:")
    out = {"think": (F.col("start"), None, None), "reply": (None, answer, None), "both": (okay, answer, None), "closed": (None, answer, False), "forced": (None, None, True), "without": (None, None, False)}
    # each template's text is rendered once, and seeded six times
    for spec in (PLAIN, PREFIXED):
        rows = apply_chat_templates(rows, spec, output=f"{spec.name}_prompt", add_generation_prompt=True)
    cols = [inject_prefixes(F.col(f"{spec.name}_prompt"), get_model_info(spec), *seed).alias(f"{spec.name}_{name}") for spec in (PLAIN, PREFIXED) for name, seed in out.items()]
    digests = rows.select("conv_id", *cols)
    return digests.select("conv_id", *[F.md5(F.col(c).cast("binary")).alias(c) for c in digests.columns[1:]])


@query
def chat_stripping_template(spark, sf_dir):
    return apply_chat_templates(_convs(spark, sf_dir), STRIPPING, add_generation_prompt=True).select("conv_id", "prompt")


@query
def chat_single_turn(spark, sf_dir):
    rows = view(spark, sf_dir, views.RECORDS).withColumn("messages", distill.prompt_conversation(F.col("instruction")))
    return apply_chat_templates(rows, PREFIXED, add_generation_prompt=True).select("record_id", "prompt")


@query
def model_detect(spark, sf_dir):
    rows = []
    for spec in TEMPLATES.values():
        info = detect_model(spec)
        rows.append((spec.name, info.prefixed, info.open_tag, info.close_tag, info.strips_think_tags, spec.text, spec.rendered_locally([("user", "hello")], True)))
    df = spark.createDataFrame(rows, "name string, prefixed boolean, open_tag string, close_tag string, strips boolean, source string, prompt string")
    return df.select("name", "prefixed", "open_tag", "close_tag", "strips", model.is_prefixed(F.col("prompt")).alias("prompt_opens"), model.first_known_tag(F.col("source")).alias("first_tag"))


def _sequence(df: DataFrame) -> DataFrame:
    text: Callable[[Column], Column] = lambda c: F.array_join(c.cast("array<string>"), " ")
    hidden, trained = label_counts(F.col("labels"))
    return df.select("conv_id", text(F.col("input_ids")).alias("ids"), text(F.col("labels")).alias("labels"), F.size("attention_mask").alias("length"), hidden.alias("masked"), trained.alias("trainable"))


def _mask_query(name: str, sql: str = views.TRAIN_TURNS, **options: object) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _sequence(apply_mask(_convs(spark, sf_dir, sql), **{"spec": PLAIN, **options}))

    QUERIES[name] = run


_mask_query("mask_think", masked=MaskType.THINK)
_mask_query("mask_prompt_think", masked=MaskType.PROMPT | MaskType.THINK)
_mask_query("mask_response", masked=MaskType.RESPONSE)
_mask_query("mask_none", masked=None)
_mask_query("mask_truncated", masked=MaskType.PROMPT | MaskType.THINK, max_seq_length=64)
_mask_query("mask_inject_empty", views.BARE_TRAIN_TURNS, masked=MaskType.THINK)


@query
def mask_strategies(spark, sf_dir):
    """Masked and trainable labels by training strategy."""
    rows = _convs(spark, sf_dir, views.TRAIN_TURNS)
    kinds = {flags: f"kind_{i}" for i, flags in enumerate(dict.fromkeys(mask.STRATEGIES.values()))}
    for flags, kind in kinds.items():  # what strategies share is masked once
        n = label_counts(F.col("labels"))
        rows = apply_mask(rows, PLAIN, masked=flags).withColumns({f"{kind}_masked": n[0], f"{kind}_trainable": n[1]}).drop(*mask.SEQUENCE)
    return rows.select("conv_id", *[F.col(f"{kinds[flags]}_{x}").alias(f"{name}_{x}") for name, flags in mask.STRATEGIES.items() for x in ("masked", "trainable")])


@query
def mask_stripping(spark, sf_dir):
    return _sequence(apply_mask(_convs(spark, sf_dir, views.TRAIN_TURNS), STRIPPING, masked=MaskType.THINK))


@query
def metrics_json(spark, sf_dir):
    return io.metrics_json(_rounded(compute_stats(parse(_responses(spark, sf_dir), info=THINK)).select("total", *RATES)))


@query
def bpe_token_counts(spark, sf_dir):
    """Token counts by a file of the tokenizers library, in an Arrow UDF; there is no SQL for BPE."""
    import public_tokenizers

    from tracemill.functions.tokenizers import TokenizerFile

    counts = parse(_responses(spark, sf_dir), info=THINK, tokenizer=TokenizerFile(public_tokenizers.path("byte_bpe_50k.json")))
    return counts.select("doc_id", "reasoning_token_count", "answer_token_count")


@query
def stream_rates(spark, sf_dir):
    from tracemill.streaming.rates import windowed_rates

    return _rounded(windowed_rates(view(spark, sf_dir, views.STREAMED), THINK))


@query
def parse_prompt_not_prefixed(spark, sf_dir):
    """A model that was prefixed and is told not to be goes by that, whatever the prompts end in."""
    return parse(view(spark, sf_dir, views.PROMPTED), info=ModelInfo(True), prompt_col="prompt", add_generation_reasoning=False).select(*_SPLIT)


def _folder(spark: SparkSession, name: str) -> str:
    """A new folder where the cluster shares files, or a temporary one of the tests."""
    import tempfile
    import uuid

    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    return f"{shared.rstrip('/')}/{name}-{uuid.uuid4().hex}" if shared else f"{tempfile.mkdtemp()}/{name}"


@query
def records_jsonl(spark, sf_dir):
    """Records written as JSON lines and read by a schema."""
    path = _folder(spark, "records")
    view(spark, sf_dir, views.RECORDS).write.json(path)
    return io.read_jsonl(spark, path, "record_id long, instruction string, response string, reasoning string")


@query
def sequences_sink(spark, sf_dir):
    """Masked sequences written as a training file and read back."""
    path = _folder(spark, "sequences")
    io.write_sequences(apply_mask(_convs(spark, sf_dir, views.TRAIN_TURNS), PLAIN, masked=MaskType.THINK), path)
    text: Callable[[str], Column] = lambda c: F.array_join(F.col(c).cast("array<string>"), " ")
    return spark.read.parquet(path).select(text("input_ids").alias("ids"), text("labels").alias("labels"), F.size("attention_mask").alias("length"))


@query
def metrics_sink(spark, sf_dir):
    """Metrics written as JSON and read back."""
    path = _folder(spark, "metrics")
    io.write_metrics(_rounded(compute_stats(parse(_responses(spark, sf_dir), info=THINK)).select("total", *RATES)), path)
    return spark.read.schema("total long, " + ", ".join(f"{r} double" for r in RATES)).json(path)


@query
def sources_in_memory(spark, sf_dir):
    """Lists of responses, nested by task and flat."""
    nested = parse(io.from_nested(spark, [["<think>a</think>b", "c"], [], ["<think>d"]]), info=THINK)
    flat = parse(io.from_flat(spark, ["<think></think>e"]), info=THINK).select(F.lit(-1).alias("task_id"), "sample_id", "answer", "reasoning")
    return nested.select("task_id", "sample_id", "answer", "reasoning").unionByName(flat)


@query
def dataset_names(spark, sf_dir):
    """What short names of evaluation sets stand for; anything else is a path."""
    return spark.createDataFrame([(n, io.resolve(n)) for n in ("chemistry", "gsm8k", "evalplus", "/data/own.jsonl")], "name string, path string")


@query
def profile_settings(spark, sf_dir):
    """A profile of a YAML file over its base."""
    import tempfile
    from pathlib import Path

    path = Path(tempfile.mkdtemp()) / "profiles.yaml"
    path.write_text("base:\n  epochs: 3\n  rate: 0.5\nsmall:\n  epochs: 1\n")
    rows = [(p, k, float(v)) for p in ("small", "unknown") for k, v in sorted(io.read_profile(str(path), p, base="base").items())]
    return spark.createDataFrame(rows, "profile string, setting string, value double")


def _raises(f: Callable[[], object]) -> bool:
    try:
        f()
    except ValueError:
        return True
    return False


@query
def option_checks(spark, sf_dir):
    """Which combinations of options are refused, and whether a model's description is found once."""
    rows = _responses(spark, sf_dir)
    convs = _bare(spark, sf_dir)
    cases = {
        "thought without block": lambda: apply_chat_templates(convs, PLAIN, add_generation_reasoning=False, think_prefix="x"),
        "reply without prompt": lambda: apply_chat_templates(convs, PLAIN, add_generation_prompt=False, response_prefix="x"),
        "block without prompt": lambda: apply_chat_templates(convs, PLAIN, add_generation_prompt=False, add_generation_reasoning=True),
        "reply with prompt": lambda: apply_chat_templates(convs, PLAIN, add_generation_prompt=True, response_prefix="x"),
        "no model": lambda: parse(rows),
        "template": lambda: parse(rows, template=PLAIN),
        "code not allowed": lambda: score.code_passes(rows),
    }
    found = [(n, _raises(f)) for n, f in cases.items()] + [("found once", get_model_info(PLAIN) is get_model_info(PLAIN))]
    return spark.createDataFrame(found, "name string, holds boolean")


@query
def code_scores(spark, sf_dir):
    """Programs of answers run against their tests, where a table is one of code."""
    rows = view(spark, sf_dir, views.PROGRAMS)
    ran = score.code_passes(rows, allow_execution=score.is_code_dataset(rows) and not score.is_code_dataset(rows.drop("test_code")))
    return ran.select("task_id", "correct")


@query
def mask_tokenizer_file(spark, sf_dir):
    """Masked sequences of a tokenizer from a file; there is no SQL for BPE."""
    import public_tokenizers

    from tracemill.functions.tokenizers import TokenizerFile

    return _sequence(apply_mask(_convs(spark, sf_dir, views.TRAIN_TURNS), PLAIN, masked=MaskType.PROMPT | MaskType.THINK, tokenizer=TokenizerFile(public_tokenizers.path("byte_bpe_50k.json"))))
