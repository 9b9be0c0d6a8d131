"""Bundles and whole captures through Spark."""

import json

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from planloom import schemas
from planloom.functions import measures, spatial
from planloom.plans import captures, damage, evidence, plan, recon
from planloom.sources import bundle, png


def write_bundle(folder, frames=3, confidence=2):
    for kind in ("depth", "confidence"):
        (folder / kind).mkdir(parents=True)
    names = "timestamp, frame, x, y, z, qx, qy, qz, qw, fx, fy, cx, cy"
    rows = [f"{i * 0.1}, {i:06d}, 0.0, 0.0, {0.5 * i}, 0.0, 0.0, 0.0, 1.0, {'' if i else 100.0}, 100.0, 50.0, 40.0" for i in range(frames)]
    (folder / "odometry.csv").write_text("\n".join([names, *rows]))
    (folder / "camera_matrix.csv").write_text("100,0,50\n0,100,40\n0,0,1\n")
    d = np.full((8, 8), 2000, np.uint16)
    d[0, 0] = 0
    for i in range(frames):
        (folder / "depth" / f"{i:06d}.png").write_bytes(png.encode(d))
        (folder / "confidence" / f"{i:06d}.png").write_bytes(png.encode(np.full((8, 8), confidence, np.uint8)))


@pytest.mark.parametrize("confidence, n", [(2, 63), (0, 0)])
def test_bundle_to_points(spark, tmp_path, confidence, n):
    write_bundle(tmp_path / "cap", confidence=confidence)
    folder = str(tmp_path / "cap")
    frames = bundle.read_frames(spark, folder)
    assert frames.where("depth_ref is null").count() == 0 and {r["fx"] for r in frames.collect()} == {100.0}
    depth = bundle.pixels(bundle.decoded(bundle.file_names(spark, folder, "depth")), "depth")
    sure = bundle.pixels(bundle.decoded(bundle.file_names(spark, folder, "confidence")), "confidence")
    pts = recon.world_points(bundle.with_confidence(depth, sure), frames)
    assert pts.count() == 3 * n
    assert recon.world_points(bundle.with_confidence(depth, sure), frames, gates=False).count() == 189
    if n:
        z = sorted({round(r["z"], 6) for r in pts.collect()})
        assert z == [2.0, 2.5, 3.0]
        assert recon.voxelised(pts, 10.0).count() <= 2
        assert recon.quality(depth, pts).first()["track_len"] == 3
    assert bundle.wrong_shapes(bundle.decoded(bundle.file_names(spark, folder, "depth"))).count() == 3
    assert bundle.missing_depth(frames).count() == 0


@pytest.mark.parametrize("kind", [np.uint8, np.uint16])
def test_png_round_trip(kind):
    x = np.random.default_rng(0).integers(0, np.iinfo(kind).max, (7, 9)).astype(kind)
    assert (png.decode(png.encode(x)) == x).all()


def test_png_filters():
    import struct
    import zlib

    rng = np.random.default_rng(2)
    x = rng.integers(0, 256, (5, 6)).astype(np.uint8)
    rows, above = [], np.zeros(6, int)
    for y, line in enumerate(x.astype(int)):
        left, corner = np.r_[0, line[:-1]], np.r_[0, above[:-1]]
        est = left + above - corner
        near = np.stack([abs(est - left), abs(est - above), abs(est - corner)]).argmin(0)
        guess = [np.zeros(6, int), left, above, (left + above) // 2, np.choose(near, [left, above, corner])][y]
        rows.append(bytes([y]) + ((line - guess) % 256).astype(np.uint8).tobytes())
        above = line
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    raw = png.MAGIC + chunk(b"IHDR", struct.pack(">IIBBBBB", 6, 5, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"".join(rows))) + chunk(b"IEND", b"")
    assert (png.decode(raw) == x).all()


def room_cloud(capture):
    x, z = (v.ravel() for v in np.meshgrid(np.linspace(0, 4, 81), np.linspace(0, 3, 61)))
    flat = [np.stack([x, np.full_like(x, y), z], 1) for y in (0.0, 2.5)]
    t4, t3 = np.arange(0, 4.001, 0.02), np.arange(0, 3.001, 0.02)
    side = [np.stack([t4, np.full_like(t4, y), np.full_like(t4, o)], 1) for y in np.linspace(0.3, 2.2, 20) for o in (0.0, 3.0)]
    side += [np.stack([np.full_like(t3, o), np.full_like(t3, y), t3], 1) for y in np.linspace(0.3, 2.2, 20) for o in (0.0, 4.0)]
    p = np.concatenate([*flat, *side])
    return pd.DataFrame({"capture_id": capture, "pid": np.arange(len(p)), "x": p[:, 0], "y": p[:, 1], "z": p[:, 2]})


@pytest.fixture(scope="module")
def two_captures(spark):
    points = spark.createDataFrame(pd.concat([room_cloud("a"), room_cloud("b")]))
    t = np.linspace(0, 2 * np.pi, 30)
    cam = pd.DataFrame({"seq": range(30), "x": 2 + np.cos(t), "y": 1.4, "z": 1.5 + 0.7 * np.sin(t)})
    camera = spark.createDataFrame(pd.concat([cam.assign(capture_id=c) for c in "ab"]))
    levels = evidence.planes(points).persist()
    return points, camera, levels, evidence.layers(points, camera, levels)


def test_evidence(two_captures):
    points, camera, levels, layers = two_captures
    got = {r["capture_id"]: r for r in levels.collect()}
    assert got["a"]["floor_y"] == pytest.approx(0, abs=0.02) and got["a"]["ceil_y"] == pytest.approx(2.5, abs=0.02)
    assert all(df.count() for df in layers.values())
    assert layers["wall_cells"].agg(F.min("support")).first()[0] >= 1
    stats = evidence.statistics(layers, camera).collect()
    assert len(stats) == 2 and all(r["camera_inside"] == 1.0 for r in stats)


def test_rooms_of_many_captures(two_captures):
    points, camera, levels, layers = two_captures
    high = points.where("y > 2.0").select("capture_id", "x", "y", "z")
    rows = captures.reconstructed(captures.stacked(layers, camera, high), levels).collect()
    assert {r["capture_id"] for r in rows} == {"a", "b"} and rows[0]["rooms"] == rows[1]["rooms"]
    doc = plan.document("a", rows[0]["walls"], rows[0]["rooms"])
    (room,) = doc["rooms"]
    assert room["area"]["value"] == pytest.approx(12, abs=0.6) and room["ceiling"]["value"] == pytest.approx(2.5, abs=0.05)
    held = {i["name"]: i["ok"] for i in json.loads(rows[0]["invariants"])}
    assert len(held) == 6 and not [k for k, v in held.items() if v is False]
    assert plan.problems(doc) == []
    assert plan.problems(doc | {"rooms": [room | {"colour": 1}]}) == ["rooms[0].colour: unknown field"]
    lost = [doc["surfaces"][0] | {"room_id": "nowhere"}]
    assert plan.problems(doc | {"surfaces": lost})
    found, rooms = json.loads(rows[0]["walls"]), json.loads(rows[0]["rooms"])
    assert plan.plan_svg(doc, found, rooms).startswith("<svg") and plan.walls_svg(found).count("<line") >= 4
    assert plan.evidence_svg([(0, 0)], [(1, 1)], [(0, 0), (1, 1)]).count("<circle") == 2


def test_no_rooms_skip_invariants():
    found = {"walls": [], "graph": {"nodes": []}, "open_space": []}
    out = captures.invariants(found, {"rooms": [], "openings": [], "enclosed": []}, *[np.zeros((0, 2))] * 3, np.zeros(0), 0.0)
    assert len(out) == 6 and all(i["ok"] is None for i in out)


def test_doors_on_facing_walls_connect():
    doors = [{"room": "a", "kind": "door", "width": 0.90, "half": 0.0, "mid": (4, 1.5), "normal": (-1, 0)}, {"room": "b", "kind": "door", "width": 0.88, "half": 0.0, "mid": (0, 1.5), "normal": (1, 0)}]
    (c,) = captures.connectors(doors)
    assert np.allclose(c["transform"], (-4, 0, 0), atol=1e-9)
    assert captures.connectors([doors[0], doors[1] | {"width": 1.2}]) == []
    assert captures.connectors([doors[0], doors[1] | {"kind": "window"}]) == []


def test_stitch_and_ablation(spark):
    a, b = [[0, 0], [4, 0], [4, 3], [0, 3]], [[0, 0], [3.5, 0], [3.5, 3], [0, 3]]
    doors = [{"room": "a", "kind": "door", "width": 0.90, "half": 0.0, "mid": (4, 1.5), "normal": (-1, 0)}, {"room": "b", "kind": "door", "width": 0.88, "half": 0.0, "mid": (0, 1.5), "normal": (1, 0)}]
    docs = [("two", json.dumps({"rooms": {"a": a, "b": b}, "openings": doors})), ("drift", json.dumps({"rooms": {"a": a, "b": a}, "start": {"b": [0.15, 0.10, 0.03]}}))]
    got = {(r["capture_id"], r["loop_closure"]): r for r in captures.stitched(spark.createDataFrame(docs, "capture_id string, doc string")).collect()}
    two = got["two", True]
    assert json.loads(two["poses"])["b"][0] == pytest.approx(4, abs=1e-6) and two["overlap_ok"] and not two["unstitched"]
    assert got["drift", True]["footprint"] == pytest.approx(12, abs=0.2) and got["drift", False]["footprint"] > got["drift", True]["footprint"] + 0.1


def painted(surface, grey, *patches, shape=(40, 120)):
    image = np.full((*shape, 3), grey, float)
    for (i0, i1, j0, j1), colour in patches:
        image[i0 : i1 + 1, j0 : j1 + 1] = colour
    i, j = (v.ravel() for v in np.meshgrid(range(shape[0]), range(shape[1]), indexing="ij"))
    return pd.DataFrame({"capture_id": "c", "surface_id": surface, "i": i, "j": j, **{c: image[..., k].ravel() for k, c in enumerate("rgb")}})


def test_damage(spark):
    cells = pd.concat([
        painted("w1", 200, ((5, 11, 10, 39), 20), ((20, 27, 50, 89), (210, 180, 120))),
        painted("w2", 128, ((30, 30, 20, 99), 200)),
        painted("w3", 200, ((5, 19, 10, 59), 20), ((25, 34, 20, 99), (210, 180, 120)), shape=(60, 120)),
    ])
    schema = "capture_id string, surface_id string, i long, j long, r double, g double, b double"
    out = damage.assessed(spark.createDataFrame(cells, schema))
    kinds = {(r["surface_id"], r["kind"]) for r in out["damages"].collect()}
    assert {("w1", "mold"), ("w1", "water_stain"), ("w2", "crack")} <= kinds
    flags = {(r["surface_id"], r["flag"]) for r in out["concealed"].collect()}
    assert {("w3", "MOIST"), ("w3", "BIO")} <= flags
    assert all(r["low"] < r["quantity"] < r["high"] for r in out["scope"].collect())
    empty = spark.createDataFrame(cells.assign(r=None, g=None, b=None), schema)
    assert damage.assessed(empty)["damages"].count() == 0


def test_points_go_to_the_nearest_wall(spark):
    walls = [("c", "w1", "wall", [0.0, 0.0], [4.0, 0.0], 0.0, 1.0, 0.0), ("c", "w2", "wall", [0.0, 0.1], [4.0, 0.1], 0.0, 1.0, -0.1)]
    s = spark.createDataFrame(walls, "capture_id string, id string, type string, a array<double>, b array<double>, nx double, nz double, d double")
    pts = [("c", 1, 1.0, 1.0, 0.02, 9, 9, 9), ("c", 2, 1.0, 1.0, 0.05, 9, 9, 9), ("c", 3, 1.0, 1.0, 0.5, 9, 9, 9), ("c", 4, 1.0, 0.1, 0.02, 9, 9, 9)]
    p = spark.createDataFrame(pts, "capture_id string, pid long, x double, y double, z double, r int, g int, b2 int")
    got = {r["pid"]: r["surface_id"] for r in damage.assigned(p, s).collect()}
    assert got == {1: "w1", 2: "w1"}
    assert damage.surface_grid(damage.assigned(p, s)).where("r is null").count() == 1


def test_spatial_expressions(spark):
    row = spark.range(1).select(F.lit(0.5).alias("x"), F.lit(-1.0).alias("y"), F.lit(3.0).alias("t"))
    a = spatial.se2(F.col("x"), F.col("y"), F.col("t"))
    got = row.select(spatial.compose(spatial.inverse(a), a).alias("i"), spatial.wrap_angle(F.lit(np.pi)).alias("w"), spatial.relative(a, a).alias("r")).first()
    assert np.allclose(list(got["i"]), 0, atol=1e-9) and got["w"] == pytest.approx(-np.pi) and np.allclose(list(got["r"]), 0, atol=1e-9)
    q = [F.lit(v) for v in (0.0, 0.7071067811865476, 0.0, 0.7071067811865476)]
    rows = spatial.quaternion_rows(*q)
    world = spark.range(1).select(*spatial.to_world(rows, [F.lit(0.0)] * 3, [F.lit(0.0), F.lit(0.0), F.lit(1.0)])).first()
    assert np.allclose(list(world), (1, 0, 0), atol=1e-9)
    with pytest.raises(Exception, match="length zero"):
        spark.range(1).select(spatial.quaternion_rows(*[F.lit(0.0)] * 4)[0][0]).collect()
    c = spark.range(1).select(spatial.connector(F.lit(4.0), F.lit(1.5), F.lit(-1.0), F.lit(0.0), F.lit(0.0), F.lit(1.5), F.lit(1.0), F.lit(0.0)).alias("c")).first()["c"]
    assert np.allclose([c["x"], c["y"]], (4, 0), atol=1e-9)


def test_depth_units(spark):
    df = spark.createDataFrame([(1.2345, "m"), (70.0, "m"), (-1.0, "m"), (1234.4, "mm")], "d double, u string")
    got = [r[0] for r in df.select(measures.depth_millimetres(F.col("d"), measures.depth_scale(F.col("u")))).collect()]
    assert got == [1234, 65535, 0, 1234]


def test_json_schema_is_closed():
    s = schemas.plan_schema()
    assert s["additionalProperties"] is False and set(s["properties"]) == set(schemas.TABLES)


def test_checks(spark):
    rooms = spark.createDataFrame([("c", "r1", None, None, None, 0.0, 0.0)], schemas.TABLES["rooms"])
    s = spark.createDataFrame([("c", "s1", "r1", "wall", None, None, None, None, None), ("c", "s2", "r9", "wall", None, None, None, None, None)], schemas.TABLES["surfaces"])
    got = schemas.checks({"rooms": rooms, "surfaces": s}).collect()
    assert [r["check"] for r in got] == ["surfaces.room_id"]


def test_streaming(spark, tmp_path, data):
    from planloom.streaming import camera

    events = spark.read.parquet(f"{data}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    events.repartition(2).write.parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    for name, make, mode in (("windows", camera.windows, "complete"), ("travel", camera.travel, "update")):
        q = make(stream()).writeStream.outputMode(mode).format("memory").queryName(f"t_{name}").option("checkpointLocation", str(tmp_path / name)).start()
        q.processAllAvailable()
        q.stop()
    assert spark.table("t_windows").agg(F.sum("n")).first()[0] == events.count()
    last = spark.table("t_travel").groupBy("user_id").agg(F.max("steps").alias("s"))
    assert last.agg(F.sum("s")).first()[0] == events.count() - events.select("user_id").distinct().count()


def test_cli(tmp_path, capsys):
    from planloom import cli

    p = tmp_path / "plan.json"
    p.write_text(json.dumps({"rooms": []}))
    assert cli.main(["validate", str(p)]) == 0
    p.write_text(json.dumps({"openings": [{"id": "o", "kind": "gate"}]}))
    assert cli.main(["validate", str(p)]) == 1 and "gate" in capsys.readouterr().out
    assert cli.main(["nothing"]) == 2


def test_single_rooms(spark, two_captures):
    from planloom.plans import single

    points, camera, levels, _ = two_captures
    docs = single.outlined(points, camera, levels, samples=12).persist()
    rows = {r["capture_id"]: json.loads(r["doc"]) for r in docs.collect()}
    assert set(rows) == {"a", "b"} and rows["a"] == rows["b"] and rows["a"]["status"] == "computed"
    assert rows["a"]["area"][0] == pytest.approx(12, abs=0.7) and rows["a"]["camera_inside"] == 1.0
    labelled = [r.asDict() for r in single.regions(docs.where("capture_id = 'a'")).collect()]
    assert labelled and {r["label"] for r in labelled} <= set(single.FILLS)
    assert single.outline_svg(rows["a"], labelled).count("<line") == len(rows["a"]["ring"])
