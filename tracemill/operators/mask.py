"""Training sequences with the loss masked on parts of them, as array expressions."""

from __future__ import annotations

from enum import IntFlag

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracemill.functions.text import head, last_index, strip, tail, unused
from tracemill.functions.tokenizers import CodePoints, ColumnTokenizer
from tracemill.operators.chat import chat_text
from tracemill.operators.model import TemplateSpec, get_model_info


class MaskType(IntFlag):
    """Parts to keep from the loss; combine with ``|``."""

    PROMPT = 1
    THINK = 2
    RESPONSE = 4


#: What each training strategy masks.
STRATEGIES = {"default": None, "bare": None, "empty": None, "mask": MaskType.THINK, "respond": MaskType.THINK | MaskType.PROMPT}
IGNORE = -100
SEQUENCE = ("input_ids", "labels", "attention_mask")


def with_empty_reasoning(messages: Column) -> Column:
    """The last message gets '' for its reasoning where no message has any."""
    last = F.element_at(messages, -1)
    emptied = F.struct(last["role"].alias("role"), last["content"].alias("content"), F.lit("").alias("reasoning"))
    some = F.exists(messages, lambda m: m["reasoning"].isNotNull())
    return F.when(some | (F.size(messages) == 0), messages).otherwise(F.concat(F.slice(messages, F.lit(1), F.size(messages) - 1), F.array(emptied)))


def training_text(messages: Column, spec: TemplateSpec, override_tag: str | None = None, single_block: bool = False) -> Column:
    """The whole sequence. For a template that strips blocks the last message's block is put in
    twice, as masking has always done; ``single_block`` leaves the second out."""
    info = get_model_info(spec, override_tag)
    text = chat_text(messages, spec, override_tag=override_tag, add_generation_reasoning=False, add_generation_prompt=False)
    if not info.strips_think_tags or single_block:
        return text
    last = F.element_at(messages, -1)
    at = last_index(text, last["content"])
    at = F.when(at < 0, F.greatest(F.length(text) - 1, F.lit(0))).otherwise(at)
    extra = F.concat(F.lit(info.open_tag + "\n"), strip(last["reasoning"]), F.lit("\n" + info.close_tag + "\n"))
    return F.when(last["reasoning"].isNull(), text).otherwise(F.concat(head(text, at), extra, tail(text, at)))


def masked_labels(ids: Column, think_start: Column, response_start: Column, masked: MaskType, ignore_index: int = IGNORE) -> Column:
    """ids with ``ignore_index`` in the masked parts; a NULL ``think_start`` is no block.

    The parts are at most three stretches, so labels are put together from slices: nothing that is
    costly to find stands in a lambda, where the optimizer would have it found for each element.
    """
    n = F.size(ids)
    reply = F.least(response_start, n)
    block = F.least(F.coalesce(think_start, response_start), n)  # where the prompt ends
    low, high = F.least(block, reply), F.greatest(block, reply)

    def stretch(begin: Column, end: Column, hidden: bool) -> Column:
        return F.array_repeat(F.lit(ignore_index), end - begin) if hidden else F.slice(ids, begin + 1, end - begin)

    # a block that opens only after the response began leaves prompt and response overlapping
    early = stretch(low, high, MaskType.THINK in masked)
    late = stretch(low, high, bool(masked & (MaskType.PROMPT | MaskType.RESPONSE)))
    middle = F.when(block <= reply, early).otherwise(late)
    return F.concat(stretch(F.lit(0), low, MaskType.PROMPT in masked), middle, stretch(high, n, MaskType.RESPONSE in masked))


def apply_mask(
    df: DataFrame, spec: TemplateSpec, messages: str = "messages", masked: MaskType | None = MaskType.THINK, max_seq_length: int = 32768,
    ignore_index: int = IGNORE, override_tag: str | None = None, tokenizer: ColumnTokenizer | None = None, single_block: bool = False,
) -> DataFrame:
    """``df`` with input_ids, labels and attention_mask. Each conversation ends in the response.

    Parts are found by how many tokens the text before them has; everything stays in the JVM for
    native tokenizers. Columns of ``df`` that have the names of SEQUENCE are replaced; other names cannot clash.
    """
    tokenizer, flags = tokenizer or CodePoints(), MaskType(0) if masked is None else masked
    info = get_model_info(spec, override_tag)
    chat = with_empty_reasoning(F.col(messages)) if flags else F.col(messages)
    c_chat, c_text, c_ids, c_think, c_reply = unused(df.columns, "chat", "text", "ids", "think", "reply")
    staged = df.withColumn(c_chat, chat)
    staged = staged.withColumn(c_text, training_text(F.col(c_chat), spec, override_tag, single_block))
    staged = staged.withColumn(c_ids, tokenizer.encode(F.col(c_text), max_seq_length).cast("array<int>"))
    text = F.col(c_text)
    if flags:
        think = F.instr(text, F.lit(info.open_tag))
        reply = last_index(text, F.element_at(c_chat, -1)["content"])
        reply = F.when(reply < 0, F.greatest(F.length(text) - 1, F.lit(0))).otherwise(reply)
        staged = staged.withColumns(
            {
                c_think: F.when(think > 0, tokenizer.count(head(text, think - 1), max_seq_length)),
                c_reply: tokenizer.count(head(text, reply), max_seq_length),
            }
        )
        labels = masked_labels(F.col(c_ids), F.col(c_think), F.col(c_reply), flags, ignore_index)
    else:
        labels = F.col(c_ids)
    kept = [F.col(f"`{c}`") for c in df.columns if c not in SEQUENCE]
    return staged.select(*kept, F.col(c_ids).alias("input_ids"), labels.alias("labels"), F.array_repeat(F.lit(1), F.size(c_ids)).alias("attention_mask"))


def label_counts(labels: Column, ignore_index: int = IGNORE) -> tuple[Column, Column]:
    """(masked, trainable) labels."""
    n = F.size(F.filter(labels, lambda x: x == ignore_index))
    return n, F.size(labels) - n
