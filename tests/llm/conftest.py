from __future__ import annotations

import random

import pytest

DOC = "doc_id long, text string, lang string, source string, n_chars long, m_hash string, q_lang int, g_id string, _row string"


@pytest.fixture(scope="session")
def docs(spark):
    """Rows as documents, with extra columns whose names clash with those that the operators use within."""

    def make(rows):
        full = [(r[0], r[1], *(list(r[2:]) + ["en", "src0"][len(r) - 2 :]), len(r[1]) if r[1] is not None else None, "x", 1, "y", "z") for r in rows]
        return spark.createDataFrame(full, DOC)

    return make


@pytest.fixture(scope="session")
def odd(docs):
    """Nulls everywhere, empty and blank texts, a very long text, ties and repeated rows."""
    rng = random.Random(3)
    long = " ".join(rng.choice(["alpha", "beta", "gamma", "delta's", "42", "é中", "\n"]) for _ in range(200_000))
    return docs([(1, "one two three four five"), (1, "one two three four five"), (2, None), (None, "null id"), (3, ""), (4, "   \n"), (5, "words here", None, None), (6, long), (7, "one two three four five"), (None, None, None, None)])
