"""Small document tables with every odd case."""

from __future__ import annotations

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row long, _row long, label string, token int, size int"


def prose(rng: random.Random, n: int) -> str:
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(n)]
    return " ".join(w + ("." if i % 9 == 8 else "") for i, w in enumerate(words)) + "."


def odd_texts() -> list[str | None]:
    rng = random.Random(4)
    base, shared = prose(rng, 120), prose(rng, 110)
    near = base.split()
    near[60] = "changed"
    texts: list[str | None] = [None, "", " \n\t ", "one", "four words only here", base, base, base.upper(), " ".join(near), shared]
    texts += [prose(rng, 30) + " " + shared + " " + prose(rng, 30) for _ in range(6)]
    texts += ["x" * 2000, "naïve café 漢字 😀 <|endoftext|> ▁ <s>", "a\r\nb\x0bc", "y " * 900, prose(rng, 3000)]
    texts += ["| a | b | c |\nall rights reserved.\n" + prose(rng, 40), "### $$$ %%% &&& *** ### $$$ %%% &&& *** one two"]
    return texts


@pytest.fixture(scope="session")
def texts():
    return odd_texts()


@pytest.fixture(scope="session")
def documents(spark, texts):
    """Odd texts with ties, a null id, repeated rows, null sources, and columns whose names clash."""
    rows = [(i if i != 7 else None, t, "en", [None, "a", "b", "ä", "Z"][i % 5], len(t or ""), i, -i, "x", 1, 2) for i, t in enumerate(texts)]
    rows += [rows[5], rows[5], rows[0]]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def nothing(documents):
    return documents.filter("false")
