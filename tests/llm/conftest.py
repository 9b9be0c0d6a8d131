import random

import pytest
from pyspark.sql import functions as F

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents from texts (ids from 0), or from (id, text) pairs."""

    def make(texts, lang="en"):
        rows = [x if isinstance(x, tuple) else (k, x) for k, x in enumerate(texts)]
        return spark.createDataFrame([(k, t, lang, "s", None if t is None else len(t)) for k, t in rows], DOCS)

    return make


@pytest.fixture(scope="session")
def odd_docs(make_docs):
    """Nulls in any column, empty, blank, very long and repeated texts, and clashing extra columns."""
    texts = [(0, None), (1, ""), (2, "  \n\t "), (3, "one"), (3, "one"), (None, "a b c d e f"), (None, None), (6, "x" * 200_000), (7, "word " * 30_000), (8, "ünï 東京 \U0001f600"), (8, "another text of the same id")]
    docs = make_docs(texts)
    return docs.withColumns({c: F.lit("clash") for c in ("score", "spans", "k", "s", "m", "_k", "held_out", "n_bytes", "cid", "at")}).withColumn("lang", F.lit(None).cast("string"))


@pytest.fixture(scope="session")
def words():
    """Seeded prose of the given number of words over its own vocabulary."""

    def prose(n, seed):
        r = random.Random(seed)
        return " ".join("".join(r.choice(("th", "er", "on", "an", "re", "in", "ed", "ha", "to", "is")) for _ in range(r.randint(1, 4))) for _ in range(n))

    return prose


@pytest.fixture(scope="session")
def data():
    return "/root/testdata/sf0.001"
