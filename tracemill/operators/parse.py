"""Split model responses into reasoning and answer, and classify them, in one projection."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracemill.functions.text import halves, is_blank, strip, unused, without_first
from tracemill.functions.tokenizers import ColumnTokenizer
from tracemill.operators.model import ModelInfo, TemplateSpec, get_model_info

FLAGS = ("has_valid_reasoning", "has_truncated_reasoning", "has_empty_reasoning", "has_missing_reasoning")
FIELDS = ("answer", "reasoning", "reasoning_tag", *FLAGS, "reasoning_token_count", "answer_token_count", "has_invalid_reasoning", "has_answer")


def effective_info(
    info: ModelInfo | None = None, template: TemplateSpec | None = None, override_tag: str | None = None,
    prompt: str | list[str] | None = None, add_generation_reasoning: bool | None = None,
) -> ModelInfo:
    """The model description that parsing goes by. A template wins over ``info``, and only with it
    does ``override_tag`` count. True makes the model prefixed, False not, if it was; else the first
    prompt does where it ends in the open tag, line feeds aside."""
    if template is not None:
        info = get_model_info(template, override_tag)
    if info is None:
        raise ValueError("a template or a model description is needed")
    if add_generation_reasoning is True:
        return replace(info, prefixed=True)
    if info.prefixed:
        return replace(info, prefixed=add_generation_reasoning is not False)
    first = prompt if isinstance(prompt, str) else next(iter(prompt or []), None)
    return replace(info, prefixed=bool(first) and first.rstrip("\n").endswith(info.open_tag))


def prompt_opens(prompt: Column, info: ModelInfo) -> Column:
    """Row by row: whether a prompt ends in the open tag."""
    return F.rtrim(prompt, F.lit("\n")).endswith(info.open_tag)


def parsed(response: Column, info: ModelInfo, prefixed: Column | None = None, count: Callable[[Column], Column] | None = None) -> Column:
    """A struct of FIELDS for a response column; ``prefixed`` overrides the model's row by row.

    As one expression, this suits arrays of responses (``transform``); :func:`parse` stages it.
    """
    return _fields(response, halves(response, info.tag_regex[1]), halves(response, info.tag_regex[0]), info, prefixed, count)


def _fields(r: Column, closed: Column, opened: Column, info: ModelInfo, prefixed: Column | None, count: Callable | None) -> Column:
    pre = F.lit(info.prefixed) if prefixed is None else prefixed
    has_close, has_open = F.size(closed) == 2, F.size(opened) == 2
    some, inside = r.isNotNull(), strip(without_first(closed[0], info.tag_regex[0]))
    reasoning = (
        F.when(has_close, inside).when(has_open, F.get(opened, F.lit(1))).when(pre, strip(r)).when(some, F.lit(""))
    )
    answer = F.when(has_close, strip(F.get(closed, F.lit(1)))).when(some & (has_open | pre), F.lit("")).otherwise(r)
    truncated = F.when(some, ~has_close & (has_open | pre))
    out = {
        "answer": answer,
        "reasoning": reasoning,
        "reasoning_tag": F.when(has_close | has_open | (some & pre), F.lit(info.tag_content)),
        "has_valid_reasoning": F.when(some, has_close & (inside != "")),
        "has_truncated_reasoning": truncated,
        "has_empty_reasoning": F.when(some, has_close & (inside == "")),
        "has_missing_reasoning": F.when(some, ~has_close & ~has_open & ~pre),
        "reasoning_token_count": count(reasoning).cast("int") if count else F.lit(None).cast("int"),
        "answer_token_count": count(answer).cast("int") if count else F.lit(None).cast("int"),
        "has_invalid_reasoning": F.when(some, ~(has_close & (inside != ""))),
        "has_answer": F.when(some, ~is_blank(answer)),
    }
    return F.struct(*[c.alias(n) for n, c in out.items()])


def parse(
    df: DataFrame, response: str = "response", info: ModelInfo | None = None, template: TemplateSpec | None = None, override_tag: str | None = None,
    prompt: str | list[str] | None = None, prompt_col: str | None = None, add_generation_reasoning: bool | None = None, tokenizer: ColumnTokenizer | None = None,
) -> DataFrame:
    """``df`` with FIELDS of each response. A NULL response has NULL fields.

    ``prompt_col``: prompts row by row, in place of one that stands for all; like that one, they count only where the model is
    not prefixed of itself and ``add_generation_reasoning`` is not True. Token counts are NULL without a tokenizer. Columns of
    ``df`` that have the names of FIELDS are replaced; other names cannot clash.
    """
    given = get_model_info(template, override_tag) if template is not None else info
    info = effective_info(info, template, override_tag, prompt, add_generation_reasoning)
    open_re, close_re = info.tag_regex
    prefixed = None
    if prompt_col is not None and not info.prefixed and not given.prefixed:
        prefixed = F.coalesce(prompt_opens(F.col(prompt_col), info), F.lit(False))
    r = F.col(response)
    closed, opened, fields = unused(df.columns, "closed", "opened", "parsed")
    staged = df.withColumns({closed: halves(r, close_re), opened: halves(r, open_re)})
    count = tokenizer.count if tokenizer else None
    staged = staged.withColumn(fields, _fields(r, F.col(closed), F.col(opened), info, prefixed, count))
    return staged.select(*[F.col(f"`{c}`") for c in df.columns if c not in FIELDS], f"{fields}.*")


def parse_array(responses: Column, info: ModelInfo, count: Callable[[Column], Column] | None = None) -> Column:
    """An array of responses -> an array of structs, the shape kept ([] stays [])."""
    return F.transform(responses, lambda r: parsed(r, info, count=count))


def parsed_by_model(response: Column, model: Column, infos: Mapping[str, ModelInfo]) -> Column:
    """As :func:`parsed`, by the description that each row's model name stands for; NULL for other names."""
    out = F.when(F.lit(False), parsed(response, next(iter(infos.values()))))
    for name, info in infos.items():
        out = out.when(model == name, parsed(response, info))
    return out
