from __future__ import annotations

import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, id string, part string"


def words(rng: random.Random, n: int) -> str:
    return " ".join("".join(rng.choice("abcdeghilmnorst") for _ in range(rng.randint(2, 7))) for _ in range(n))


@pytest.fixture(scope="session")
def texts() -> list[tuple[int | None, str | None]]:
    """Nulls, empty and white texts, copies, near copies, shared passages, a long text, odd characters."""
    rng = random.Random(5)
    base = [words(rng, rng.randint(1, 160)) for _ in range(30)]
    passage, twice = words(rng, 70), words(rng, 80)
    near = base[3].split()
    rows: list[tuple[int | None, str | None]] = list(enumerate(base))
    rows += [(40 + i, base[2]) for i in range(12)]
    rows += [(60, " ".join(near[:-1] + ["changed"])), (61, None), (62, ""), (63, " \n\t"), (64, base[4] + " " + passage), (65, passage + "\n" + base[5]), (66, base[6] + " " + passage + " " + base[7])]
    rows += [(72, words(rng, 20) + " " + twice), (73, "some words before it\n" + twice + " and words after it")]
    rows += [(67, "é 日本語 ▁ 😀 <|endoftext|> ß"), (68, words(rng, 9000)), (69, "word " * 300), (70, ""), (61, None), (5, base[5]), (None, "no id here"), (None, None)]
    return rows


@pytest.fixture(scope="session")
def docs(spark, texts):
    """With columns whose names the operators use inside."""
    rows = [(i, t, "en", f"s{n % 3}", len(t or ""), "x", "y") for n, (i, t) in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
