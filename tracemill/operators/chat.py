"""Render conversations into prompts, with reasoning history, thought steering and response prefixes.

Messages are ``array<struct<role, content, reasoning>>``: a NULL reasoning is none, '' an empty block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracemill.functions.text import drop_end
from tracemill.operators.model import ModelInfo, TemplateSpec, get_model_info


def block(reasoning: Column, info: ModelInfo) -> Column:
    """The reasoning block that stands before an answer, with the line feed after it."""
    body = F.when(reasoning == "", "").otherwise(F.concat(reasoning, F.lit("\n")))
    return F.concat(F.lit(info.open_tag + "\n"), body, F.lit(info.close_tag + "\n"))


def embed_reasoning(messages: Column, info: ModelInfo) -> Column:
    """Messages whose content begins with their reasoning's block, where they have reasoning."""
    return F.transform(
        messages,
        lambda m: F.struct(
            m["role"].alias("role"),
            F.when(m["reasoning"].isNull(), m["content"]).otherwise(F.concat(block(m["reasoning"], info), F.coalesce(m["content"], F.lit("")))).alias("content"),
        ),
    )


def render(messages: Column, spec: TemplateSpec, info: ModelInfo, add_generation_prompt: bool | None = None) -> Column:
    """The template's text of a conversation.

    A template that strips blocks would take out the reasoning, so a message that has some is put
    in after the template has done with the contents, as it is.
    """

    def turn(m: Column) -> Column:
        before, after = spec.around(m["role"])
        plain, reasoning = F.coalesce(m["content"], F.lit("")), m["reasoning"]
        with_block = F.concat(block(reasoning, info), plain)
        if not info.strips_think_tags:
            with_block = spec.content(m["role"], with_block)
        return F.concat(before, F.when(reasoning.isNull(), spec.content(m["role"], plain)).otherwise(with_block), after)

    generate = spec.generates_by_default if add_generation_prompt is None else add_generation_prompt
    return F.concat(F.lit(spec.bos), F.array_join(F.transform(messages, turn), ""), F.lit(spec.generation_prompt if generate else ""))


def inject_prefixes(prompt: Column, info: ModelInfo, think_prefix: Column | None = None, response_prefix: Column | None = None, include_reasoning: bool | None = True) -> Column:
    """Seed a rendered prompt. A NULL prefix counts as not given, row by row; '' counts as given.

    include_reasoning: True has the open tag there, False has it not, None leaves it.
    """
    feed, opening, closing = F.lit("\n"), F.lit(info.open_tag), F.lit(info.close_tag)
    bare = F.rtrim(prompt, feed)
    is_open = bare.endswith(info.open_tag)
    shut = drop_end(bare, len(info.open_tag))
    opened = F.when(is_open, bare).otherwise(F.concat(bare, feed, opening))
    alone = {None: prompt, True: opened, False: F.when(is_open, shut).otherwise(bare)}[include_reasoning]
    if think_prefix is None and response_prefix is None:
        return alone
    none = F.lit(None).cast("string")
    think = none if think_prefix is None else think_prefix
    reply = none if response_prefix is None else response_prefix
    thinking = F.concat(opened, feed, think)
    before_reply = (
        F.when(think.isNotNull(), F.concat(thinking, feed, closing))
        .when(is_open, shut if include_reasoning is False else F.concat(bare, feed, closing))
        .otherwise(bare)
    )
    return F.when(reply.isNotNull(), F.concat(before_reply, feed, reply)).when(think.isNotNull(), thinking).otherwise(alone)


def _prefix(value: str | Column | None) -> Column | None:
    return F.lit(value) if isinstance(value, str) else value


def check_options(think_prefix: object, response_prefix: object, add_generation_reasoning: bool | None, add_generation_prompt: bool | None) -> None:
    if add_generation_reasoning is False and think_prefix is not None:
        raise ValueError("a thought prefix needs a reasoning block, which add_generation_reasoning=False forbids")
    if add_generation_prompt is False and (think_prefix is not None or response_prefix is not None or add_generation_reasoning is True):
        raise ValueError("prefixes and add_generation_reasoning=True need the generation prompt")


def chat_text(
    messages: Column, spec: TemplateSpec, think_prefix: str | Column | None = None, response_prefix: str | Column | None = None,
    override_tag: str | None = None, add_generation_reasoning: bool | None = None, add_generation_prompt: bool | None = None,
) -> Column:
    """The prompt of a conversation column. A prefix is a string for all rows or a column."""
    check_options(think_prefix, response_prefix, add_generation_reasoning, add_generation_prompt)
    info = get_model_info(spec, override_tag)
    prompt = render(messages, spec, info, add_generation_prompt)
    return inject_prefixes(prompt, info, _prefix(think_prefix), _prefix(response_prefix), add_generation_reasoning)


def apply_chat_templates(df: DataFrame, spec: TemplateSpec, messages: str = "messages", output: str = "prompt", **options: object) -> DataFrame:
    """``df`` with a column of prompts; options as of :func:`chat_text`."""
    return df.withColumn(output, chat_text(F.col(messages), spec, **options))
