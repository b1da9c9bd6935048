import random

import pytest

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()


@pytest.fixture(scope="session")
def prose():
    def make(n, seed):
        r = random.Random(seed)
        return " ".join(r.choice(WORDS) + r.choice(("", "s", "ing", "ed", "er")) + str(r.choice(("", "", r.randrange(100)))) for _ in range(n))

    return make


#: Columns whose names the operators use inside.
EXTRA = ", row string, words long, hashes string, at int, k int, slot long, print string, block string, key int, n long"


@pytest.fixture(scope="session")
def docs_of(spark):
    """Documents from ``(doc_id, text, source)``, with columns of clashing names if asked."""

    def make(rows, extra=False):
        full = [(i, t, "en", s, len(t) if t is not None else None) for i, t, s in rows]
        schema = "doc_id long, text string, lang string, source string, n_chars long"
        if extra:
            full, schema = [(*r, "x", 1, "y", 2, 3, 4, "z", "b", 5, 6) for r in full], schema + EXTRA
        return spark.createDataFrame(full, schema)

    return make


@pytest.fixture(scope="session")
def odd_rows(prose):
    """Nulls in any column, empty and very long texts, ties and repeated rows."""
    long = prose(30_000, 1)
    return [
        (1, None, "a"), (2, "", "a"), (3, " \n\t ", None), (None, prose(80, 2), "a"), (None, prose(80, 2), "a"), (4, prose(80, 3), "a"),
        (4, prose(80, 3), "a"), (4, prose(80, 4), "b"), (5, long, "b"), (6, prose(80, 3), None), (7, "!!! ... ???", "b"), (8, "one", "b"), (9, "é" * 3, None),
    ]
