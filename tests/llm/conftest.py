import random

import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, id bigint, root string, line_doc string, Line_Text string, line_lost string, multiset_id string, matches string, score double"


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents with extra columns whose names clash with what the operators use inside."""

    def make(rows):
        rows = [r if isinstance(r, tuple) else (i, r) for i, r in enumerate(rows)]
        return spark.createDataFrame([(i, t, None, "s", None if t is None else len(t), 7, "r", "x", "y", "z", "m", "n", 0.5) for i, t in rows], SCHEMA).repartition(3)

    return make


@pytest.fixture(scope="session")
def prose():
    """prose(seed, n): n invented words in sentences of twelve."""

    def make(seed, n, sep=" "):
        r = random.Random(seed)
        words = ["".join(r.choice(["th", "er", "on", "an", "re", "he", "in", "ed", "nd", "ha"]) for _ in range(r.randint(1, 4))) for _ in range(n)]
        return sep.join(w + ("." if i % 12 == 11 else "") for i, w in enumerate(words))

    return make


HARD = [None, "", " ", "\n\n", "word", "?!", "é", "word", "x " * 30000, "y" * 50000, "a.b!c\n" * 400, "😀".encode("utf-16", "surrogatepass").decode("utf-16"), "İstanbul İ " * 5]


@pytest.fixture(scope="session")
def hard():
    """Null, empty, blank, one-word, sign-only, repeated, very long and odd texts, with null and repeated ids."""
    return [(None if i == 3 else (5 if i == 7 else i), t) for i, t in enumerate(HARD)] + [(0, None), (4, "word")]


#: What the columns that operators pass through hold in every row of make_docs.
EXTRA = {"source": "s", "id": 7, "root": "r", "line_doc": "x", "Line_Text": "y", "line_lost": "z", "multiset_id": "m", "matches": "n", "score": 0.5}


@pytest.fixture(scope="session")
def untouched():
    """Whether the extra columns of rows still hold what they held."""
    return lambda df: all({k: r[k] for k in EXTRA} == EXTRA for r in df.collect())
