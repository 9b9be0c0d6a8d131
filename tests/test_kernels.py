"""Scenes with known answers for the per-capture kernels."""

import numpy as np
import pytest

from planloom.kernels import polygons, raster, rooms, stitch, walls

P = walls.PARAMS
FAR = np.array([[10.0, 10.0], [11.0, 11.0]])
NONE = np.zeros((0, 2))


def pieces(*rows):
    return [walls.wall(*r) for r in rows]


def line(axis, offset, start, end, step=0.02):
    """Cells every `step` along a wall, the ends included."""
    t = np.arange(start, end + step / 2, step)
    o = np.full(len(t), float(offset))
    return np.stack([o, t], 1) if axis == 0 else np.stack([t, o], 1)


# An oblong hall that doesn't begin at the origin, walked in a zigzag along its length.
HALL = [(0, -1.3, 0.6, 3.8), (0, 4.3, 0.6, 3.8), (1, 0.6, -1.3, 4.3), (1, 3.8, -1.3, 4.3)]
ZIGZAG = np.stack([np.linspace(-0.6, 3.6, 57), 2.2 + 0.5 * (np.abs(np.arange(57) % 16 - 8) / 4 - 1)], 1)


def scene(*lines):
    """Cells of walls with supports that vary between 5 and 9 along them."""
    parts = [line(*x) for x in lines]
    return np.concatenate(parts), np.concatenate([5 + np.arange(len(x)) % 5 for x in parts])


def test_a_hall_has_four_walls_and_four_corners():
    r = walls.reconstruct(*scene(*HALL), ZIGZAG)
    assert sorted(walls.length(w) for w in r["walls"] if walls.length(w) > 1) == pytest.approx([3.2, 3.2, 5.6, 5.6], abs=0.1)
    assert r["graph"]["counts"] == {"L": 4, "T": 0, "cross": 0, "dangling": 0}
    assert r["evidence"]["explained"] >= 0.8 * r["evidence"]["total"] and [round(w["offset"], 2) for w in r["walls"]] == pytest.approx([-1.3, 4.3, 0.6, 3.8], abs=0.06)


def test_a_partition_that_ends_in_the_hall():
    r = walls.reconstruct(*scene(*HALL, (0, 1.1, 2.3, 3.8)), np.stack([ZIGZAG[:, 0], np.full(57, 1.5)], 1))
    (w,) = [w for w in r["walls"] if w["axis"] == 0 and abs(w["offset"] - 1.1) < 0.05]
    assert walls.length(w) == pytest.approx(1.5, abs=0.12)
    assert r["graph"]["counts"]["T"] == 1 and r["graph"]["counts"]["dangling"] == 1


def test_two_faces_of_a_partition_are_one_thick_wall():
    r = walls.reconstruct(*scene(*HALL, (1, 3.66, 0.4, 2.3)), ZIGZAG)
    (w,) = [w for w in r["walls"] if w["axis"] == 1 and w["offset"] > 3]
    assert w["merged_from"] >= 2 and w["thickness"] == pytest.approx(0.14, abs=0.03)


def test_too_few_cells():
    r = walls.reconstruct(line(0, 2.0, 1.0, 1.1), np.full(6, 9), ZIGZAG)
    assert r["walls"] == [] and r["warnings"]


def test_every_gap_rule():
    """One line with a crossed, a hidden and a short gap; another with a long one; an end short of a wall."""
    rng = np.random.default_rng(17)
    cupboard = np.stack([rng.uniform(5.3, 7.2, 400), rng.uniform(2.1, 2.7, 400)], 1)
    path = np.array([[2.9, 1.2], [2.9, 3.1], [9.5, 3.4], [10.4, 3.9]])
    given = pieces((1, 2.0, 0.5, 2.4), (1, 2.0, 3.5, 5.4), (1, 2.0, 7.1, 8.2), (1, 2.0, 8.45, 11.0), (1, 5.5, 0.5, 4.0), (1, 5.5, 6.1, 11.0), (0, 0.5, 2.0, 4.8))
    out = walls.completed(given, cupboard, path, P)
    assert [(w["start"], w["end"]) for w in out["opening"]] == [(2.4, 3.5)]
    assert [(w["start"], w["end"]) for w in out["walls"] if w["provenance"] == walls.OCCLUDED] == [(5.4, 7.1)]
    assert [(w["start"], w["end"]) for w in out["walls"] if w["provenance"] == walls.DROPOUT] == [(8.2, 8.45)]
    assert [(w["start"], w["end"]) for w in out["unknown"]] == [(4.0, 6.1)]
    assert any(w["provenance"] == walls.EXTENSION and w["end"] == 5.5 for w in out["walls"])


@pytest.mark.parametrize(
    "crossed, occluded, width, kind",
    [(True, False, 0.4, walls.DROPOUT), (True, False, 3.0, "open_space"), (True, True, 1.0, "opening"), (False, True, 2.0, walls.OCCLUDED), (False, False, 0.3, walls.DROPOUT), (False, False, 0.31, "unknown")],
)
def test_gap_table(crossed, occluded, width, kind):
    assert walls.gap_verdict(width, crossed, occluded, P)[0] == kind


@pytest.mark.parametrize(
    "rows, counts",
    [
        ([(0, 0, 0, 3), (1, 0, 0, 3)], (1, 0, 0, 2)),
        ([(0, 0, 0, 4), (1, 2, 0, 3)], (0, 1, 0, 3)),
        ([(0, 0, 0, 4), (1, 2, -2, 2)], (0, 0, 1, 4)),
        ([], (0, 0, 0, 0)),
    ],
)
def test_graph_types(rows, counts):
    got = walls.graph(pieces(*rows), FAR, P)["counts"]
    assert (got["L"], got["T"], got["cross"], got["dangling"]) == counts


def test_inferred_node_only_where_the_camera_did_not_pass():
    ws = pieces((0, 0, 0, 4), (1, 4.5, -2, 2))
    assert any(n["inferred"] and n["v"] == 4.5 for n in walls.graph(ws, FAR, P)["nodes"])
    assert not any(n["inferred"] for n in walls.graph(ws, np.array([[-1, 4.2], [1, 4.2]]), P)["nodes"])


def test_piece_merge():
    assert [(w["start"], w["end"], round(w["thickness"], 2)) for w in walls.merged_pieces(pieces((0, 0, 0, 2), (0, 0.2, 1, 2.5)), P)] == [(0, 2.5, 0.2)]
    bridge = walls.wall(0, 0, 2, 2.3, provenance=walls.DROPOUT)
    assert len(walls.merged_pieces([*pieces((0, 0, 0, 2), (0, 0, 2.3, 4)), bridge], P)) == 3


# ---- rooms -----------------------------------------------------------------------------------


def room_scene(corners):
    ws, cells = [], []
    for a, b in zip(corners, corners[1:] + corners[:1], strict=True):
        axis = 0 if a[0] == b[0] else 1
        lo, hi = sorted((a[1 - axis], b[1 - axis]))
        ws.append(walls.wall(axis, a[axis], lo, hi, support=60))
        cells.append(line(axis, a[axis], lo, hi))
    c = np.array(corners, float)
    g = np.stack(np.meshgrid(*[np.arange(c[:, k].min() + 0.05, c[:, k].max(), 0.1) for k in (0, 1)]), -1).reshape(-1, 2)
    return ws, np.concatenate(cells), g[polygons.contains(corners, g)]


RECT, ELL = [(0, 0), (4.6, 0), (4.6, 2.8), (0, 2.8)], [(0, 0), (5, 0), (5, 2.6), (2.4, 2.6), (2.4, 5.2), (0, 5.2)]
RECT_AREA, ELL_AREA = 12.88, 19.24


@pytest.mark.parametrize("corners, to, area, least", [(RECT, (3.9, 1.7), RECT_AREA, 4), (ELL, (1.2, 4.4), ELL_AREA, 6)])
def test_rooms(corners, to, area, least):
    ws, cells, floor = room_scene(corners)
    out = rooms.build(ws, [], NONE, cells, floor, np.linspace((1, 1), to, 30), NONE)
    (r,) = out["rooms"]
    assert abs(r["area"] - area) < 0.5 and r["area_ci"][0] < area < r["area_ci"][1]
    assert len(r["wall_lengths"]) >= least and r["observed"] / r["perimeter"] > 0.8
    assert r["ceiling"]["status"] == "unmeasured"
    assert out == rooms.build(ws, [], NONE, cells, floor, np.linspace((1, 1), to, 30), NONE)


def test_gap_in_a_wall_is_closed_at_the_least_cost():
    ws, cells, floor = room_scene(RECT)
    path = np.linspace((0.9, 0.8), (3.7, 1.9), 25)
    out = rooms.build([ws[0] | {"end": 3.8}, *ws[1:]], [], NONE, cells, floor, path, NONE)
    (c,) = out["closures"]
    # the floor is seen up to 4.55, so closing there is shorter than going on to the wall at 4.6
    assert (c["kind"], c["start"], round(c["end"], 2)) == ("snap_boundary", 3.8, 4.55) and len(out["rooms"]) == 1
    out = rooms.build([ws[0] | {"end": 3.8}, *ws[1:]], [], NONE, cells, NONE, path, NONE)
    assert [(c["kind"], c["cost"]) for c in out["closures"]] == [("extend_perp", 0.0)]


def test_ceiling_choice():
    g = np.stack(np.meshgrid(np.linspace(0.15, 4.45, 32), np.linspace(0.15, 2.65, 23)), -1).reshape(-1, 2)
    uv, ys = np.concatenate([g, g, g]), np.concatenate([np.full(len(g), 2.5), np.full(2 * len(g), 3.2)])
    p = rooms.PARAMS
    assert rooms.ceiling(RECT, uv, ys, 0.0, p, 2.5)["value"] == pytest.approx(2.5, abs=0.02)
    assert rooms.ceiling(RECT, uv, ys, 0.0, p)["value"] == pytest.approx(3.2, abs=0.02)
    assert rooms.ceiling(RECT, g, np.full(len(g), 2.0), 0.0, p)["status"] == "unmeasured"


def test_intervals_cover():
    ws, cells, floor = room_scene(RECT)
    hits = 0
    for seed in range(20):
        moved = [w | {"offset": w["offset"] + np.random.default_rng(seed).normal(0, 0.01)} for w in ws]
        e = rooms.alternating(rooms.ring_edges(RECT, moved))
        e = [x | {"offset": moved[x["wall"]]["offset"]} for x in e]
        (lo, hi), _ = rooms.intervals(e, rooms.PARAMS | {"samples": 200, "seed": seed})
        hits += lo <= RECT_AREA <= hi
    assert hits >= 17


def test_closure_is_forbidden_across_the_camera():
    w = walls.wall(1, 0, 0, 1.5)
    across = np.array([[0.7, -1.0], [0.7, 1.0]])
    assert rooms.closure_cost(w, NONE, NONE, across, rooms.PARAMS) is None
    assert rooms.closure_cost(w, NONE, NONE, FAR, rooms.PARAMS) == pytest.approx(1.5)


def test_small_regions_merge_or_become_fragments():
    grid = rooms.Grid(0, 0, 0.1, (60, 60))
    big, small = np.zeros((60, 60), bool), np.zeros((60, 60), bool)
    big[2:40, 2:40], small[42:50, 2:20] = True, True
    r = [{"mask": big, "camera": True, "status": "room"}, {"mask": small, "camera": True, "status": "room"}]
    out, report = rooms.min_room(r, grid, rooms.PARAMS)
    assert out[1]["status"] == "merged" and report[0]["merged_into"] == 0
    out, _ = rooms.min_room([r[1]], grid, rooms.PARAMS)
    assert out[0]["status"] == "non_room_fragment"


# ---- rasters, polygons, stitching -----------------------------------------------------------


def test_raster():
    m = np.zeros((30, 40), bool)
    m[5:20, 5:30] = True
    assert raster.inradius(m) == 8.0
    ring = np.ones((5, 5), bool)
    ring[2, 2] = False
    assert raster.fill_holes(ring).all()
    diagonal = np.eye(4, dtype=bool)
    assert raster.label(diagonal)[1] == 4 and raster.label(diagonal, True)[1] == 1
    rng = np.random.default_rng(1)
    x = rng.random((20, 20)) < 0.6
    far = min((np.hypot(*(np.argwhere(~np.pad(x, 1)) - p).T).min() for p in [np.argwhere(np.pad(x, 1))[0]]))
    assert raster.inradius(x) >= far


def test_polygons():
    a, b = [(0, 0), (2, 0), (2, 2), (0, 2)], [(1, 1), (3, 1), (3, 3), (1, 3)]
    assert polygons.covered_area([a, b]) == pytest.approx(7) and polygons.overlap(a, b) == pytest.approx(1)
    assert polygons.inradius(RECT) == pytest.approx(1.4, abs=1e-3)
    assert not polygons.is_simple([(0, 0), (4, 0), (0, 3), (4, 3)]) and polygons.is_simple(ELL)
    ring, cut = polygons.minus(b, [a], 0.0)
    assert cut == pytest.approx(1) and polygons.area(ring) == pytest.approx(3)


def test_icp_and_pose_graph():
    sq = np.array(RECT, float)
    marks = np.random.default_rng(3).uniform(0, 6, (40, 2))
    motion, fit = stitch.icp(marks, polygons.placed(marks, (-0.12, 0.17, -0.04)))
    assert np.allclose(motion, (-0.12, 0.17, -0.04), atol=1e-9) and fit < 1e-9
    motion, _ = stitch.icp(polygons.resampled(sq), polygons.resampled(polygons.placed(sq, (-0.2, 0.1, 0.03))))
    assert polygons.overlap(polygons.placed(sq, motion), polygons.placed(sq, (-0.2, 0.1, 0.03))) > 0.97 * RECT_AREA
    truth = {"a": (0, 0, 0), "b": (4.0, 0.2, 0.1), "c": (3.0, 5.0, -0.4)}
    links = [(x, y, stitch.relative(truth[y], truth[x]), 1.0) for x, y in (("a", "b"), ("b", "c"), ("c", "a"))]
    poses, _ = stitch.pose_graph(list(truth), {"a": (0, 0, 0), "b": (3.8, 0.4, 0.2), "c": (3.2, 4.7, -0.3)}, links)
    assert all(np.allclose(poses[k], truth[k], atol=1e-6) for k in truth)


def test_revisit_is_corrected():
    sq = np.array(RECT, float)
    on = stitch.stitch({"a": sq, "b": sq}, [], {"b": (-0.2, 0.1, 0.03)})
    off = stitch.stitch({"a": sq, "b": sq}, [], {"b": (-0.2, 0.1, 0.03)}, loop_closure=False)
    assert on["footprint"] == pytest.approx(RECT_AREA, abs=0.2) and off["footprint"] > on["footprint"] + 0.1
    assert not on["unstitched"] and off["unstitched"]


# ---- the box of a single room ----------------------------------------------------------------


def cluttered_room(seed=4):
    """A 5.2 x 2.9 room turned by 34 degrees: a gap for a door, a reflection beyond one wall, a low bench,
    loose points; and a camera that walks a figure of eight."""
    rng = np.random.default_rng(seed)
    long, wide, low, high, door = 5.2, 2.9, -1.5, 1.0, (0.8, 1.65)
    n = 15_000
    sides = []
    for offset, along, size in ((0.0, 0, long), (wide, 0, long), (0.0, 2, wide), (long, 2, wide)):
        p = np.empty((n, 3))
        p[:, along], p[:, 2 - along], p[:, 1] = rng.uniform(0, size, n), offset, rng.uniform(low, high, n)
        if along == 0 and offset == wide:
            p = p[(p[:, 0] < door[0]) | (p[:, 0] > door[1])]
        sides.append(p + rng.normal(0, 0.007, p.shape))
    reflection = np.stack([rng.uniform(0.5, 3.0, 6000), rng.uniform(-0.3, 0.5, 6000), np.full(6000, -1.7)], 1)
    bench = rng.uniform((3.4, low, 0.25), (4.9, low + 0.5, 0.7), (7000, 3))
    loose = rng.uniform((-2, -1, -2), (7, 1, 5), (250, 3))
    k = np.linspace(0, 2 * np.pi, 160)
    cam = np.stack([2.6 + 1.4 * np.sin(k), np.zeros_like(k), 1.45 + 0.6 * np.sin(2 * k)], 1)
    c, s = np.cos(np.radians(34)), np.sin(np.radians(34))
    turn = np.array([[c, 0, s], [0, 1, 0], [-s, 0, c]])
    return np.concatenate([*sides, reflection, bench, loose]) @ turn.T, cam @ turn.T, low, high


def test_box_of_a_cluttered_room():
    from planloom.kernels import box

    points, cam, lo, hi = cluttered_room()
    r = box.fit(points, cam, lo, hi, samples=40)
    area, low, high = r["area"]
    assert area == pytest.approx(15.08, rel=0.05) and low <= area <= high
    assert any(0.65 <= d["width"] <= 1.05 for d in r["doors"])
    assert box.fit(points[:50], cam, lo, hi)["warnings"]
    assert abs((box.orientation(box.wall_cells(points, lo, hi)) - r["angle"] + 45) % 90 - 45) < 6


# ---- the outline of a single room ------------------------------------------------------------


def l_shaped_floor(step=0.04):
    g = np.stack(np.meshgrid(np.arange(0.4, 5.6, step), np.arange(-1.0, 3.2, step)), -1).reshape(-1, 2)
    return g[~((g[:, 0] > 3.4) & (g[:, 1] > 1.2))]


def test_footprint_of_an_l():
    from planloom.kernels import outline

    rng = np.random.default_rng(2)
    floor = np.concatenate([l_shaped_floor(), rng.uniform((9, 9), (12, 12), (20, 2))])  # a far island of strays
    floor = floor[~((np.abs(floor[:, 0] - 2) < 0.25) & (np.abs(floor[:, 1] - 1) < 0.25))]  # a hole under a table
    ring = outline.footprint(floor)
    assert len(ring) == 6 and polygons.area(ring) == pytest.approx(5.2 * 4.2 - 2.2 * 2.0, rel=0.06)
    assert outline.footprint(floor[:3]) is None and outline.footprint(floor[:40]) is None


def test_rings_by_wall_lines():
    from planloom.kernels import outline

    crooked = np.array([(0.1, -0.1), (4.9, 0.2), (5.1, 3.0), (2.0, 3.2), (2.1, 1.5), (-0.1, 1.4)])
    us, vs = [0.0, 5.0], [0.0, 3.1]
    assert (outline.snapped(crooked, us, vs, 0.3)[:3] == [(0, 0), (5, 0), (5, 3.1)]).all()
    square = outline.orthogonal(crooked, us, vs, 0.3)
    d = np.roll(square, -1, 0) - square
    assert len(square) == 6 and ((d[:, 0] == 0) ^ (d[:, 1] == 0)).all() and polygons.area(square) == pytest.approx(5 * 1.45 + 2.95 * 1.65, abs=0.2)
    assert len(outline.fewer_edges(crooked, 5)) == 5 and len(outline.fewer_edges(crooked, 2)) == 4
    turned = outline.counter_clockwise(crooked[::-1])
    assert {tuple(x) for x in turned} == {tuple(x) for x in crooked} and (turned == outline.counter_clockwise(turned)).all()
    assert outline.support_span(np.array([(0.0, 1.0), (0.03, 2.5), (1.0, 9.0)]), 0, 0.01) == (1.0, 2.5)
    assert [outline.beyond((1.0, 2.5), x) for x in (0.5, 2.0, 3.0)] == [0.5, 0.0, 0.5] and outline.beyond(None, 1.0) is None
    assert outline.half_width(0.03, 4.0, "observed", 0.0) == pytest.approx(0.05) and outline.half_width(0.03, 4.0, "unobserved", 0.0) == pytest.approx(0.10)


def test_a_wardrobe_hides_the_wall():
    from planloom.kernels import outline

    uv = np.concatenate([line(*x) for x in HALL] + [line(0, 3.8, 1.0, 2.9)])
    lines = {"u_min": -1.3, "u_max": 3.8, "v_min": 0.6, "v_max": 3.8}
    assert outline.hidden_sides(uv, lines) == ["u_max"]
    assert outline.hidden_sides(uv, lines | {"u_max": 4.3}) == []


def test_outline_of_a_cluttered_room():
    from planloom.kernels import outline

    points, cam, lo, hi = cluttered_room()
    rng = np.random.default_rng(1)
    floor = rng.uniform((0, lo, 0), (5.2, lo, 2.9), (9000, 3))
    c, s = np.cos(np.radians(34)), np.sin(np.radians(34))
    r = outline.fit(np.concatenate([points, floor @ np.array([[c, 0, s], [0, 1, 0], [-s, 0, c]]).T]), cam, lo, hi, samples=30)
    area, low, high = r["area"]
    assert r["status"] == "computed" and area == pytest.approx(15.08, rel=0.05) and low <= area <= high
    assert r["camera_inside"] == 1.0 and len(r["edges"]) == 4 and r["ceiling"] == pytest.approx(2.5)
    assert sum(e["length"] for e in r["edges"]) == pytest.approx(16.2, rel=0.05) and all(e["half"] > 0 for e in r["edges"])
    assert r["regions"] and any(x["height"] < 0.8 for x in r["regions"])
    bare = outline.fit(points[:60], cam, lo, hi)
    assert bare["status"] == "unavailable" and bare["warnings"]
