"""The pipeline against its stages done plainly, and the registered queries."""

import collections

import duckdb
import pandas as pd
import pytest

import corpus_pipeline
from planloom.llm import pii, quality, queries
from planloom.llm.common import held_out, table


def shingles(t):
    w = t.split()
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def test_pipeline(spark, data):
    docs = table(spark, data, "documents")
    cfg = quality.Ftrl()
    weights, bias = quality.fit(docs, table(spark, data, "labels"), cfg, ~held_out())
    make = quality.Features(cfg.bits)
    left = [(r["doc_id"], r["text"]) for r in docs.orderBy("doc_id").collect() if quality.score_texts(make, weights, bias, cfg.scale, [r["text"] or ""])[0] >= cfg.threshold]
    sets = [shingles(t) for _, t in left]
    root = list(range(len(left)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(left)):
        for b in range(a):
            if sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) - 1e-9:
                lo, hi = sorted((find(a), find(b)))
                root[hi] = lo
    left = [x for k, x in enumerate(left) if find(k) == k]
    items = [shingles(r["text"]) for r in table(spark, data, "benchmark").collect()]
    left = [(k, t) for k, t in left if not any(i and len(i & shingles(t)) >= 0.8 * len(i) for i in items)]
    want = {k: len(pii.mask(t)) for k, t in left}
    got = corpus_pipeline.run(spark, data).collect()
    assert {r["doc_id"]: r["n_chars"] for r in got} == want
    assert all(r["round_trip"] and len(r["ids"]) == len(set(r["ids_sha256"])) for r in got)


def test_stages_keep_the_columns(spark, data):
    docs = table(spark, data, "documents")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, data).columns == docs.columns, name


def test_every_operator_is_registered():
    numbers = collections.Counter(n.split("_")[0] for n in queries.QUERIES)
    assert numbers == {f"op{n}": 1 for n in range(1, 11)}


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_sql_says_the_same(spark, name):
    d = "/root/testdata/sf0.01"
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark"):
        con.execute(f"create view {t} as select * from '{d}/{t}.parquet'")
    clean = lambda v: "null" if v is None or v is pd.NA or v != v else str(round(float(v), 9)) if isinstance(v, (int, float)) else v
    rows = lambda df: sorted(tuple(map(clean, r)) for r in df[sorted(df.columns)].astype(object).itertuples(index=False))
    assert rows(queries.QUERIES[name](spark, d).toPandas()) == rows(con.execute(queries.ORACLES[name]).df())


@pytest.fixture(scope="module")
def odd_tables(spark, odd_docs, tmp_path_factory):
    """A folder of tables: the odd rows with names that clash with what stages make, few labels, one item."""
    from pyspark.sql import functions as F

    folder = str(tmp_path_factory.mktemp("odd"))
    extra = odd_docs.withColumns({c: F.lit("clash") for c in ("_t", "text_", "key", "predicted", "n_pieces", "planloom", "t", "class_id")})
    extra.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(6, 1), (7, 1), (None, 0), (3, None)], "doc_id long, quality int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, "a b c d e f"), (2, None), (3, "")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder


def test_pipeline_over_odd_rows(spark, odd_tables):
    docs = table(spark, odd_tables, "documents")
    now, left = docs, []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, odd_tables)
        assert now.columns == docs.columns
        left.append(sorted(((r["doc_id"], r["text"]) for r in now.select("doc_id", "text").collect()), key=str))
    every = sorted(((r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()), key=str)
    assert left[0] == every  # all that is labelled is good, so nothing goes
    once = list(every)
    once.remove((3, "one"))
    assert left[1] == once
    once.remove((None, "a b c d e f"))
    assert left[2] == left[3] == once
    got = corpus_pipeline.run(spark, odd_tables).collect()
    assert sorted((r["doc_id"] for r in got), key=str) == [k for k, _ in sorted(once, key=lambda x: str(x[0]))]
    assert all(r["round_trip"] for r in got) and {r["planloom"] for r in got} == {r["predicted"] for r in got} == {"clash"}


def test_pipeline_over_empty_tables(spark, odd_tables, tmp_path):
    for name in ("documents", "labels", "benchmark"):
        table(spark, odd_tables, name).limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
