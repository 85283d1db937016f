"""How a chat template treats reasoning blocks, told on the driver and turned into plan literals."""

from __future__ import annotations

import logging
import re
from dataclasses import dataclass, field, replace
from enum import Enum
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from tracemill.functions.text import any_case, exactly, strip

_log = logging.getLogger(__name__)


class TagStyle(str, Enum):
    HTML = "html"
    BRACKET = "bracket"

    def opened(self, name: str) -> str:
        return f"<{name}>" if self is TagStyle.HTML else f"[{name}]"

    def closed(self, name: str) -> str:
        return self.opened("/" + name)


@dataclass(frozen=True)
class ModelInfo:
    """prefixed: the template opens the block in its generation prompt. strips_think_tags: it takes
    blocks out of assistant messages. reasoning_key is never set by detection."""

    prefixed: bool
    tag_content: str = "think"
    tag_style: TagStyle = TagStyle.HTML
    strips_think_tags: bool = False
    reasoning_key: str | None = None

    @property
    def open_tag(self) -> str:
        return self.tag_style.opened(self.tag_content)

    @property
    def close_tag(self) -> str:
        return self.tag_style.closed(self.tag_content)

    @property
    def tag_regex(self) -> tuple[str, str]:
        """Java patterns of the tags, whatever their case."""
        return any_case(self.open_tag), any_case(self.close_tag)

    def with_tag(self, tag: str) -> ModelInfo:
        """A copy for ``think``, ``<think>`` or ``[THINK]``; a bare name keeps the style."""
        for style, ends in ((TagStyle.HTML, "<>"), (TagStyle.BRACKET, "[]")):
            if tag[:1] == ends[0] and tag[-1:] == ends[1]:
                return replace(self, tag_content=tag[1:-1], tag_style=style)
        return replace(self, tag_content=tag)


# Tags looked for in a template's source, in this order; a trailing open tag of a prompt.
KNOWN_TAGS = ("[THINK]", "[THINKING]", "[THOUGHT]", "[REASONING]", "<think>", "<thinking>", "<thought>", "<reasoning>")
TRAILING_TAG = r"(?:<[a-zA-Z][a-zA-Z0-9_]*>|\[[A-Z][A-Z0-9_]*\])\s*$"


@dataclass(frozen=True)
class TemplateSpec:
    """A chat template as data, so that it renders inside Catalyst.

    turns: (role, before, after); a role that is not listed renders with ``other``. drop_through: of
    messages rendered as assistant turns, content up to the last occurrence is dropped, and line feeds
    after it. source: text that stands for the template when tags are looked for; by default its parts.
    """

    name: str
    turns: tuple[tuple[str, str, str], ...]
    generation_prompt: str
    bos: str = ""
    other: tuple[str, str] = ("", "")
    drop_through: str | None = None
    trims: bool = False
    generates_by_default: bool = False
    source: str | None = None

    @property
    def text(self) -> str:
        parts = [self.bos, *[x for t in self.turns for x in t[1:]], *self.other, self.generation_prompt, self.drop_through or ""]
        return self.source if self.source is not None else "\n".join(parts)

    def around(self, role: Column) -> tuple[Column, Column]:
        before, after = F.lit(self.other[0]), F.lit(self.other[1])
        for name, b, a in reversed(self.turns):
            before, after = F.when(role == name, b).otherwise(before), F.when(role == name, a).otherwise(after)
        return before, after

    def content(self, role: Column, content: Column) -> Column:
        """What the template makes of a message's content."""
        if self.drop_through is not None:
            last = F.element_at(F.split(content, exactly(self.drop_through), -1), -1)
            cut = F.when(content.contains(self.drop_through), F.ltrim(last, F.lit("\n"))).otherwise(content)
            content = F.when(role == "assistant", cut).otherwise(content)
        return strip(content) if self.trims else content

    def rendered_locally(self, messages: list[tuple[str, str]], generation_prompt: bool) -> str:
        """The same on the driver, for detection only."""
        out = self.bos
        for role, content in messages:
            before, after = next(((b, a) for r, b, a in self.turns if r == role), self.other)
            if role == "assistant" and self.drop_through and self.drop_through in content:
                content = content.rpartition(self.drop_through)[2].lstrip("\n")
            out += before + (content.strip() if self.trims else content) + after
        return out + (self.generation_prompt if generation_prompt else "")


@lru_cache(maxsize=None)
def detect_model(spec: TemplateSpec) -> ModelInfo:
    """Whether the template is prefixed, which tag it uses and whether it strips blocks."""
    prefixed = re.search(TRAILING_TAG, spec.rendered_locally([("user", "hello")], True)) is not None
    tag = next((t for t in KNOWN_TAGS if t in spec.text), None)
    if tag is None:
        _log.warning("the template names no known reasoning tag; <think> is taken (override_tag chooses another)")
    info = ModelInfo(prefixed).with_tag(tag or "<think>")
    probe = f"{info.open_tag}\nA\n{info.close_tag}\nB"
    shown = spec.rendered_locally([("user", "hello"), ("assistant", probe)], False)
    return replace(info, strips_think_tags=info.open_tag not in shown)


def get_model_info(spec: TemplateSpec, override_tag: str | None = None) -> ModelInfo:
    info = detect_model(spec)
    return info if override_tag is None else info.with_tag(override_tag)


def is_prefixed(prompt: Column) -> Column:
    """Whether a column of generation prompts ends in an open tag."""
    return prompt.rlike(TRAILING_TAG)


def first_known_tag(source: Column) -> Column:
    """The tag that a column of template sources names, ``<think>`` if none."""
    return F.coalesce(*[F.when(source.contains(t), t) for t in KNOWN_TAGS], F.lit("<think>"))


def _turns(before: str, after: str, roles: str = "system user assistant") -> tuple[tuple[str, str, str], ...]:
    return tuple((r, before.format(r), after) for r in roles.split())


#: Templates of our own for the four kinds of behaviour.
PLAIN = TemplateSpec("plain", _turns("<|{}|>\n", "<|end|>\n"), "<|assistant|>\n", source="<think> </think>")
PREFIXED = TemplateSpec("prefixed", _turns("<|{}|>\n", "<|end|>\n"), "<|assistant|>\n<think>\n", bos="<s>", source="<think> </think>")
STRIPPING = TemplateSpec(
    "stripping", _turns("[{}] ", "\n"), "[assistant] <think>\n", bos="<s>", drop_through="</think>", trims=True, source="<think> </think>"
)
BRACKET = TemplateSpec("bracket", (("system", "[SYS]", "[/SYS]"), ("user", "[INST]", "[/INST]"), ("assistant", "", "</s>")), "", bos="<s>", source="[THINK] [/THINK]")
TEMPLATES = {t.name: t for t in (PLAIN, PREFIXED, STRIPPING, BRACKET)}
