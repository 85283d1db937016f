from __future__ import annotations

import pytest

from tracemill.operators.model import BRACKET, KNOWN_TAGS, PLAIN, PREFIXED, STRIPPING, ModelInfo, TagStyle, TemplateSpec, detect_model, first_known_tag, get_model_info, is_prefixed


def test_tags():
    info = ModelInfo(False)
    assert (info.open_tag, info.close_tag) == ("<think>", "</think>")
    assert ModelInfo(False, "THINK", TagStyle.BRACKET).close_tag == "[/THINK]"
    assert info.with_tag("reasoning").open_tag == "<reasoning>"
    assert info.with_tag("[X]").open_tag == "[X]"
    assert ModelInfo(False, "A", TagStyle.BRACKET).with_tag("<b>").tag_style is TagStyle.HTML
    assert ModelInfo(True, strips_think_tags=True).with_tag("z") == ModelInfo(True, "z", strips_think_tags=True)


@pytest.mark.parametrize("spec,want", [(PLAIN, (False, "<think>", False)), (PREFIXED, (True, "<think>", False)), (STRIPPING, (True, "<think>", True)), (BRACKET, (False, "[THINK]", False))])
def test_detection(spec, want):
    info = detect_model(spec)
    assert (info.prefixed, info.open_tag, info.strips_think_tags) == want
    assert info.reasoning_key is None


def test_default_tag_and_cache(caplog):
    bare = TemplateSpec("bare", (("user", "U:", "\n"),), "A:")
    assert detect_model(bare).open_tag == "<think>"
    assert "no known reasoning tag" in caplog.text
    assert get_model_info(bare, "<r>").open_tag == "<r>" and detect_model(bare).open_tag == "<think>"


def test_any_trailing_tag_is_a_prefix():
    assert detect_model(TemplateSpec("odd", (), "<assistant>  \n")).prefixed


def test_columns(spark):
    rows = spark.createDataFrame([("x<think>\n", "a <thought> [THINK]"), ("x", "none")], "p string, s string")
    assert [tuple(r) for r in rows.select(is_prefixed(rows.p), first_known_tag(rows.s)).collect()] == [(True, "[THINK]"), (False, "<think>")]
    assert len(KNOWN_TAGS) == 8
