"""The main operators as SQL functions of a session, for use in ``spark.sql``."""

from __future__ import annotations

from pyspark.sql import SparkSession

from tracemill.functions.text import WHITE_SPACE
from tracemill.operators.score import AT_END, CODE_BLOCK, END, IN_TEXT


def _quoted(text: str) -> str:
    return "'" + "".join(c if c.isascii() and c.isprintable() and c not in "'\\" else f"\\u{ord(c):04x}" for c in text) + "'"


def _pattern(text: str) -> str:
    return 'r"' + text + '"'


_WS = _quoted(WHITE_SPACE)
_LETTERS = [("upper(t)", p) for p in IN_TEXT] + [(f"right(upper(t), {END})", p) for p in AT_END]

#: name: (parameters, type, expression). A tag is given as it opens: <think> or [THINK].
FUNCTIONS = {
    "strip_text": ("t STRING", "STRING", f"btrim(t, {_WS})"),
    "any_case": ("t STRING", "STRING", r"""concat(r"(?iu)\Q", t, r"\E")"""),
    "closing_tag": ("tag STRING", "STRING", "concat(left(tag, 1), '/', substring(tag, 2))"),
    "response_reasoning": (
        "r STRING, tag STRING, prefixed BOOLEAN", "STRING",
        "CASE WHEN r rlike any_case(closing_tag(tag)) THEN strip_text(array_join(split(split(r, any_case(closing_tag(tag)), 2)[0], any_case(tag), 2), ''))"
        " WHEN r rlike any_case(tag) THEN split(r, any_case(tag), 2)[1] WHEN prefixed THEN strip_text(r) WHEN r IS NOT NULL THEN '' END",
    ),
    "response_answer": (
        "r STRING, tag STRING, prefixed BOOLEAN", "STRING",
        "CASE WHEN r rlike any_case(closing_tag(tag)) THEN strip_text(split(r, any_case(closing_tag(tag)), 2)[1])"
        " WHEN r rlike any_case(tag) OR prefixed AND r IS NOT NULL THEN '' ELSE r END",
    ),
    "response_outcome": (
        "r STRING, tag STRING, prefixed BOOLEAN", "STRING",
        "CASE WHEN r rlike any_case(closing_tag(tag)) THEN if(response_reasoning(r, tag, prefixed) = '', 'empty', 'valid')"
        " WHEN r rlike any_case(tag) OR prefixed AND r IS NOT NULL THEN 'truncated' WHEN r IS NOT NULL THEN 'missing' END",
    ),
    "distilled_reasoning": (
        "t STRING, name STRING", "STRING",
        "CASE WHEN t rlike any_case(concat('<', name, '>')) THEN"
        " nullif(strip_text(split(element_at(split(t, any_case(concat('<', name, '>')), -1), -1), any_case(concat('</', name, '>')), 2)[0]), '') END",
    ),
    "chosen_letter": ("t STRING", "STRING", "coalesce(" + ", ".join(f"nullif(regexp_extract({t}, {_pattern('(?dU)' + p)}, 1), '')" for t, p in _LETTERS) + ")"),
    "code_block": ("t STRING", "STRING", f"if(t rlike {_pattern('(?s)' + CODE_BLOCK)}, regexp_extract(t, {_pattern('(?s)' + CODE_BLOCK)}, 1), t)"),
}


def register(spark: SparkSession) -> list[str]:
    """Make the functions known to the session as temporary functions; returns their names."""
    for name, (parameters, kind, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {kind} RETURN {body}")
    return list(FUNCTIONS)
