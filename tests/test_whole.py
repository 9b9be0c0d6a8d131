"""Queries over whole tables against direct computation: no row may be left out."""

from collections import Counter

import duckdb
import numpy as np

from planloom.plans import catalogue
from planloom.plans.catalogue import QUERIES


def read(data, sql):
    return duckdb.connect().execute(sql.replace("$/", f"{data}/")).fetchall()


def test_angle_over_every_point(spark, data):
    p = np.array(read(data, "SELECT l_extendedprice / 1000.0, l_quantity FROM '$/lineitem.parquet'"), float)
    scores = []
    for k, c, s in catalogue.ANGLES:
        bins = [np.floor(w / 0.5).astype(int) for w in (p[:, 0] * c + p[:, 1] * s, -p[:, 0] * s + p[:, 1] * c)]
        scores.append((sum(n * n for b in bins for n in Counter(b.tolist()).values()), -k))
    score, k = max(scores)
    assert [tuple(r) for r in QUERIES["manhattan_angle"](spark, data).collect()] == [(-k, score)]


def crossings(data):
    walls = [(k, float(900 + k % 100 + 0.37), n * 2.0, n * 2.0 + 10) for k, n in read(data, "SELECT s_suppkey, s_nationkey FROM '$/supplier.parquet'")]
    out = {}
    for p, size, price in read(data, "SELECT p_partkey, p_size, p_retailprice FROM '$/part.parquet'"):
        for k, off, a, b in walls:
            dv, dh = max(0.0, a - size, size - b), max(0.0, price - off, off - (price + 3))
            if min(dv, dh) <= 0.05 and max(dv, dh) <= 1.0:
                out[k, p] = float(size), "inside" if max(dv, dh) <= 0.05 else "extend_horizontal" if dv <= 0.05 else "extend_vertical"
    return out


def test_nodes_of_every_part(spark, data):
    want = crossings(data)
    got = {(r["s_suppkey"], r["p_partkey"]): (r["v"], r["kind"]) for r in QUERIES["node_candidates"](spark, data).collect()}
    assert got == want
    lines = {}
    for (k, _), (v, _) in want.items():
        lines.setdefault(k, set()).add(v)
    edges = {(k, a, b) for k, vs in lines.items() for a, b in zip(sorted(vs), sorted(vs)[1:])}
    assert {(r["s_suppkey"], r["va"], r["vb"]) for r in QUERIES["edge_between_nodes"](spark, data).collect()} == edges
    degrees = Counter(sum((k, v) in ((e[0], e[1]), (e[0], e[2])) for e in edges) for k, vs in lines.items() for v in vs)
    (r,) = QUERIES["node_types"](spark, data).collect()
    assert tuple(r) == (degrees[0] + degrees[1], degrees[2], degrees[3], sum(n for d, n in degrees.items() if d > 3))


def test_provenance_of_every_piece(spark, data):
    names, total = ("observed", "inferred_extension", "inferred_occluded", "inferred_dropout"), Counter()
    for wall, line, quantity in read(data, "SELECT l_suppkey, l_linenumber, l_quantity FROM '$/lineitem.parquet'"):
        total[wall, line % 4] += int(quantity) // 10
    want = {}
    for (wall, k), n in total.items():
        want[wall] = max(want.get(wall, (-1, 0)), (n, -k))
    got = {r["wall"]: (r["total"], r["provenance"]) for r in QUERIES["dominant_provenance"](spark, data).collect()}
    assert got == {wall: (n, names[-k]) for wall, (n, k) in want.items()}


def test_nearest_of_every_vector(spark, data):
    e = read(data, "SELECT vec_id, embedding[1]::DOUBLE, embedding[2]::DOUBLE, embedding[3]::DOUBLE FROM '$/embeddings.parquet'")
    want = {p: min(((a - x) * (a - x) + (b - y) * (b - y) + (c - z) * (c - z), q) for q, x, y, z in e if q != p) for p, a, b, c in e}
    got = {r["vec_id"]: (r["d2"], r["camera"]) for r in QUERIES["nearest_camera"](spark, data).collect()}
    assert got == want


def test_inside_share_by_all_evidence(spark, data):
    marks = {(int(x // 25000), int(z // 10)) for x, z in read(data, "SELECT l_extendedprice, l_quantity FROM '$/lineitem.parquet'")}
    near = {(i + a, j + b) for i, j in marks for a in (-1, 0, 1) for b in (-1, 0, 1)}
    n, inside = Counter(), Counter()
    for user, x, z in read(data, "SELECT user_id, value, json_extract_string(props, '$.k')::DOUBLE FROM '$/events.parquet'"):
        n[user] += 1
        inside[user] += (int(x // 25), int(z // 10)) in near
    assert 0 < sum(inside.values()) < sum(n.values())
    got = {r["user_id"]: (r["n"], r["inside"]) for r in QUERIES["camera_inside_share"](spark, data).collect()}
    assert got == {u: (n[u], inside[u]) for u in n}


def test_labels_across_bands(spark):
    """Whatever the height of a band, the labels are those of the whole raster."""
    r = np.random.default_rng(3)
    from planloom.operators import components

    cells = sorted({(int(i), int(j), "ab"[int((i + j) % 7 == 0)]) for i, j in r.integers(-20, 40, (1300, 2))})
    df = spark.createDataFrame(cells, "i long, j long, v string")
    for diagonal in (False, True):
        for value in (None, ["v"]):
            root = {c: c for c in cells}

            def find(c, root=root):
                while root[c] != c:
                    c = root[c]
                return c

            at = {(i, j): v for i, j, v in cells}
            for i, j, v in cells:
                for a in (-1, 0, 1):
                    for b in (-1, 0, 1):
                        o = at.get((i + a, j + b))
                        if o is not None and (diagonal or abs(a) + abs(b) == 1) and (value is None or o == v):
                            lo, hi = sorted((find((i, j, v)), find((i + a, j + b, o))))
                            root[hi] = lo
            want = {c: find(c)[:2] for c in cells}
            for band in (3, 256):
                got = components.label_cells(df, [], diagonal, value, band).collect()
                assert {(x["i"], x["j"], at[x["i"], x["j"]]): (x["li"], x["lj"]) for x in got} == want and len(got) == len(cells)


def test_nearest_in_any_layout(spark):
    from planloom.operators import joins

    r = np.random.default_rng(8)
    for kind in ("even", "far apart", "one place", "a line"):
        p = r.normal(size=(60, 3)) * {"even": 1, "far apart": 1, "one place": 0, "a line": 1}[kind]
        if kind == "far apart":
            p[::7] *= 1e4
        if kind == "a line":
            p[:, 1:] = 2.0
        rows = [(["a", "b"][k % 2], k, *map(float, x)) for k, x in enumerate(p)]
        df = spark.createDataFrame([*rows, ("a", 99, None, 0.0, 0.0)], "c string, k long, x double, y double, z double")
        for keys, others in (([], True), (["c"], False)):
            got = {x["k"]: (x["d2"], x["t"]) for x in joins.nearest_point(df, df.withColumnRenamed("k", "t"), "k", "t", ["x", "y", "z"], keys, others).collect()}
            want = {}
            for c, k, *a in rows:
                of = [((a[0] - b[0]) * (a[0] - b[0]) + (a[1] - b[1]) * (a[1] - b[1]) + (a[2] - b[2]) * (a[2] - b[2]), t) for e, t, *b in rows if (not keys or e == c) and (not others or t != k)]
                want[k] = min(of)
            assert got == want
    none = df.where("k < 0")
    assert joins.nearest_point(none, df.withColumnRenamed("k", "t"), "k", "t", ["x"]).count() == 0
    assert joins.nearest_point(df, none.withColumnRenamed("k", "t"), "k", "t", ["x"]).columns == ["k", "t", "d2"]


def test_counts_between(spark):
    from planloom.operators import joins

    r = np.random.default_rng(4)
    points = [(int(k % 3), float(x)) for k, x in enumerate(r.integers(-30, 60, 400) / 4)]
    spans = [(int(k % 4), k, float(a), float(a + w)) for k, (a, w) in enumerate(zip(r.integers(-40, 70, 80) / 4, r.integers(0, 40, 80) / 4, strict=True))]
    p, s = spark.createDataFrame(points, "l long, v double"), spark.createDataFrame(spans, "l long, k long, a double, b double")
    for width in (0.5, 4.0, 100.0):
        got = {x["k"]: x["n"] for x in joins.count_between(p, s, ["l"], "v", "a", "b", ["k"], "n", width).collect()}
        assert got == {k: sum(line == q and a <= v <= b for q, v in points) for line, k, a, b in spans}
