"""Every query of the catalogue against its SQL in DuckDB."""

import duckdb
import pandas as pd
import pytest

import planloom.plans.catalogue_captures  # noqa: F401
import planloom.plans.catalogue_kernels  # noqa: F401
import planloom.plans.catalogue_steps  # noqa: F401
from planloom.plans.catalogue import ORACLES, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{data}/{t}.parquet'")
    return con


def rows(df: pd.DataFrame) -> list[tuple]:
    df = df[sorted(df.columns)]
    clean = lambda v: "null" if v is None or v is pd.NA or v != v else repr(float(v)) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)
    return sorted(tuple(map(clean, r)) for r in df.astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, data, name):
    got = QUERIES[name](spark, data).toPandas()
    if name in ORACLES:
        want = duck.execute(ORACLES[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        a, b = rows(got), rows(want)
        assert len(a) == len(b)
        assert a == b


def test_rooms_have_their_sizes(spark, data):
    from planloom.plans import catalogue_captures as c

    want = {r["capture_id"]: r["w"] * r["h"] for r in c.sizes(spark, data).collect()}
    got = QUERIES["room_reconstruction"](spark, data).collect()
    assert {r["capture_id"] for r in got} == set(want)
    assert all(abs(r["area"] - want[r["capture_id"]]) < 0.4 and r["area_low"] <= r["area"] <= r["area_high"] and r["ceiling"] == "measured" for r in got)


def test_ablation(spark, data):
    got = QUERIES["stitch_ablation"](spark, data).collect()
    on = {r["capture_id"]: r for r in got if r["loop_closure"]}
    off = {r["capture_id"]: r for r in got if not r["loop_closure"]}
    again = [k for k in on if k.endswith("_again")]
    assert again and all(on[k]["footprint"] < off[k]["footprint"] and on[k]["closure_gap"] < 1e-3 for k in again)
    assert all(on[k]["overlap_ok"] and not on[k]["unstitched"] for k in set(on) - set(again))
