"""String helpers as Column expressions, with the semantics of Unicode text processing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Every code point that counts as white space in a Unicode-aware strip.
WHITE_SPACE = "".join(
    map(
        chr,
        [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000],
    )
)


def unused(columns: list[str], *names: str) -> list[str]:
    """Names for columns of a plan's own, which none of ``columns`` has."""
    have = {c.lower() for c in columns}
    out = []
    for name in names:
        name = f"_{name}"
        while name in have:
            name += "_"
        out.append(name)
    return out


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(WHITE_SPACE))


def is_blank(c: Column) -> Column:
    return strip(c) == ""


def any_case(literal: str) -> str:
    """A pattern that matches ``literal`` whatever its case, by Unicode folding."""
    return r"(?iu)\Q" + literal.replace(r"\E", r"\E\\E\Q") + r"\E"


def exactly(literal: str) -> str:
    return r"\Q" + literal.replace(r"\E", r"\E\\E\Q") + r"\E"


def halves(c: Column, pattern: str) -> Column:
    """What lies before and after the first match; one element where there is none."""
    return F.split(c, pattern, 2)


def without_first(c: Column, pattern: str) -> Column:
    return F.array_join(halves(c, pattern), "")


def after_last(c: Column, pattern: str) -> Column:
    """What follows the last match; NULL where there is none."""
    parts = F.split(c, pattern, -1)
    return F.when(F.size(parts) > 1, F.element_at(parts, -1))


def last_index(text: Column, needle: Column) -> Column:
    """0-based place of the last occurrence in code points; -1 if none, the text's length if empty."""
    back = F.instr(F.reverse(text), F.reverse(needle))
    return (
        F.when(needle == "", F.length(text))
        .when(back == 0, F.lit(-1))
        .otherwise(F.length(text) - back - F.length(needle) + 1)
    )


def drop_end(c: Column, n: int) -> Column:
    return F.substring(c, F.lit(1), F.length(c) - F.lit(n))


def head(c: Column, n: Column) -> Column:
    return F.substring(c, F.lit(1), n)


def tail(c: Column, n: Column) -> Column:
    """From 0-based place ``n`` on."""
    return F.substring(c, n + 1, F.length(c))
