"""From a bundle on disk to the plan and back: a made-up corridor seen by a turning camera."""

import json

import numpy as np
import pytest

from planloom import cli, params, pipeline
from planloom.plans import plan
from planloom.sources import bundle, files, png, stages, video

LOW, HIGH = np.array([-1.3, -1.2, -2.1]), np.array([2.2, 1.3, 1.4])  # the inside of a box room
ROWS, COLS, FOCAL = 36, 48, 26.0


def views():
    """Yaw and pitch of each frame, and where the camera stands."""
    for k, yaw in enumerate(np.arange(0, 2 * np.pi, np.pi / 7)):
        for pitch in (-0.55, 0.0, 0.55):
            yield yaw, pitch, np.array([0.3 + 0.25 * np.cos(k), 0.05, -0.4 + 0.2 * np.sin(k)])


def rotation(yaw, pitch):
    a, b = (np.cos(yaw), np.sin(yaw)), (np.cos(pitch), np.sin(pitch))
    return np.array([[a[0], 0, a[1]], [0, 1, 0], [-a[1], 0, a[0]]]) @ np.array([[1, 0, 0], [0, b[0], -b[1]], [0, b[1], b[0]]])


def quaternion(yaw, pitch):
    cy, sy, cp, sp = np.cos(yaw / 2), np.sin(yaw / 2), np.cos(pitch / 2), np.sin(pitch / 2)
    return cy * sp, sy * cp, -sy * sp, cy * cp


def seen(yaw, pitch, at):
    """Depth in millimetres, and colours: a dark patch on the wall at the far x, else light grey."""
    v, u = np.mgrid[:ROWS, :COLS]
    ray = np.stack([(u - COLS / 2) / FOCAL, (v - ROWS / 2) / FOCAL, np.ones_like(u, float)], -1) @ rotation(yaw, pitch).T
    ray = np.where(np.abs(ray) < 1e-9, 1e-9, ray)
    t = np.where(ray > 0, (HIGH - at) / ray, (LOW - at) / ray).min(-1)
    hit = at + ray * t[..., None]
    dark = (np.abs(hit[..., 0] - HIGH[0]) < 1e-6) & (np.abs(hit[..., 2] + 0.3) < 0.6) & (np.abs(hit[..., 1]) < 0.5)
    return np.rint(t * 1000).astype(np.uint16), np.where(dark[..., None], 30, 200).astype(np.uint8).repeat(3, -1)


def write(folder, kind="depth", confidence=True, matrix=True):
    for k in (kind, *(["confidence"] * confidence)):
        (folder / k).mkdir(parents=True)
    lines, colours = ["timestamp, frame, x, y, z, qx, qy, qz, qw" + ("" if matrix else ", fx, fy, cx, cy")], []
    for k, (yaw, pitch, at) in enumerate(views()):
        depth, rgb = seen(yaw, pitch, at)
        (folder / kind / f"{k:06d}.png").write_bytes(png.encode(depth))
        if confidence:
            (folder / "confidence" / f"{k:06d}.png").write_bytes(png.encode(np.full(depth.shape, 2, np.uint8)))
        lines.append(", ".join(map(str, [k * 0.1, f"{k:06d}", *at, *quaternion(yaw, pitch), *([] if matrix else [FOCAL, FOCAL, COLS / 2, ROWS / 2])])))
        colours.append((folder.name, k, ROWS, COLS, rgb.tobytes()))
    (folder / "odometry.csv").write_text("\n".join(lines) + "\n")
    if matrix:
        (folder / "camera_matrix.csv").write_text(f"{FOCAL},0,{COLS / 2}\n0,{FOCAL},{ROWS / 2}\n0,0,1\n")
    return colours


@pytest.fixture(scope="module")
def done(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("product")
    colours = write(root / "in" / "box")
    cfg = params.load(stride=1, damage_stride=1, output_dir=str(root / "out"))
    code = cli.run(spark, str(root / "in" / "*"), cfg, spark.createDataFrame(colours, video.SCHEMA))
    return root, cfg, code


def test_run_leaves_every_file(done):
    root, _, code = done
    folder = root / "out" / "box"
    assert code == 0
    names = "evidence.json evidence.svg walls.json walls.svg rooms.json damage.json plan.json plan.svg ablation.svg recon/points.npz recon/points_unfiltered.npz recon/poses.npz".split()
    assert all((folder / n).stat().st_size for n in names)
    doc = json.loads((folder / "plan.json").read_text())
    assert doc["status"] == "computed" and plan.problems(doc) == [] and doc["provenance"]["tier"] == "lidar"
    (room,) = doc["rooms"]
    size = HIGH - LOW
    assert room["area"]["value"] == pytest.approx(size[0] * size[2], abs=0.5)
    assert room["ceiling"]["value"] == pytest.approx(size[1], abs=0.05)
    assert set(doc["stitch"]) == {"poses", "overlap_ok", "unstitched", "ablation"} and doc["stitch"]["ablation"]["on"]["footprint"] == doc["stitch"]["ablation"]["off"]["footprint"]


def test_run_finds_the_damage(done):
    folder = done[0] / "out" / "box"
    doc, report = json.loads((folder / "plan.json").read_text()), json.loads((folder / "damage.json").read_text())
    frames = len(list(views()))
    assert report["evidence"]["frames_sampled"] == report["evidence"]["frames_with_rgb"] == frames and report["evidence"]["points_projected"] > 1000
    # where the patch begins, colours change as they do at a crack
    assert report["by_class"]["mold"] == 1 and report["by_class"].keys() <= {"mold", "crack"} and report["damage_count"] == len(doc["damages"])
    (patch,) = (x for x in doc["damages"] if x["kind"] == "mold")
    assert patch["area"] == pytest.approx(1.2 * 1.0, abs=0.3)
    wall = next(s for s in doc["surfaces"] if s["id"] == patch["surface_id"])
    assert all(p[0] == pytest.approx(HIGH[0], abs=0.08) for p in (wall["a"], wall["b"]))
    assert {"MOIST", "BIO"} <= {c["flag"] for c in doc["concealed"]}
    assert "remediate_mold" in [s["task"] for s in doc["scope"]] and len(doc["scope"]) == len(doc["damages"])
    assert plan.DAMAGE_STROKES["mold"] in (folder / "plan.svg").read_text()


def test_saved_steps_are_read_again(spark, done, tmp_path):
    import shutil

    root, cfg, _ = done
    before = json.loads((root / "out" / "box" / "plan.json").read_text())
    cloud = stages.read_npz(spark, f"{root}/out/*/recon/points.npz", "points", ["x", "y", "z"])
    assert cloud.count() == np.load(root / "out" / "box" / "recon" / "points.npz")["points"].shape[0]
    poses = np.load(root / "out" / "box" / "recon" / "poses.npz")["poses"].reshape(-1, 4, 4)
    yaw, pitch, at = next(views())
    assert np.allclose(poses[0][:3, :3], rotation(yaw, pitch), atol=1e-9) and np.allclose(poses[0][:3, 3], at)
    for walls in (False, True):
        shutil.copytree(root / "out", tmp_path / str(walls))
        again = params.load(output_dir=str(tmp_path / str(walls)))
        assert cli.resume(spark, again, walls) == 0
        doc = json.loads((tmp_path / str(walls) / "box" / "plan.json").read_text())
        assert [(r["id"], r["area"]) for r in doc["rooms"]] == [(r["id"], r["area"]) for r in before["rooms"]]
    pieces = stages.read_walls(spark, f"{root}/out/*/walls.json").collect()
    assert len(pieces) == len(json.loads((root / "out" / "box" / "walls.json").read_text())["walls"])


def test_layers_of_either_form(spark):
    doc = {"cells": {"x": [1.0, 2.0], "z": [3.0, 4.0]}, "pairs": [[1.0, 3.0], [2.0, 4.0]]}
    df = spark.createDataFrame([(json.dumps(doc),)], "doc string")
    got = df.select(*[stages.layer(df["doc"], n, ["x", "z"]).alias(n) for n in ("cells", "pairs", "none")]).first()
    assert [tuple(r) for r in got["cells"]] == [tuple(r) for r in got["pairs"]] == [(1.0, 3.0), (2.0, 4.0)] and got["none"] == []


def test_bundle_from_an_export(spark, tmp_path):
    write(tmp_path / "raw", kind="depth", confidence=False, matrix=False)
    target, warnings = bundle.build(spark, str(tmp_path / "raw"), str(tmp_path / "made"), "cap7", meta={"device": "d", "ios": None}, shape=(ROWS, COLS))
    assert len(warnings) == 2 and target.endswith("/cap7")
    frames = bundle.read_frames(spark, target)
    assert frames.where("depth_ref is null or confidence_ref is null").count() == 0 and frames.count() == len(list(views()))
    assert json.loads((tmp_path / "made" / "cap7" / "meta.json").read_text()) == {"capture_id": "cap7", "tier": "lidar", "device": "d"}
    same = [png.decode((tmp_path / x / "depth" / "000003.png").read_bytes()) for x in ("raw", "made/cap7")]
    assert (same[0] == same[1]).all()
    assert bundle.resolve(spark, "cap_cap7", [str(tmp_path)]) == f"file:{target}"
    for capture, roots in (("cap_none", [str(tmp_path)]), ("cap7", [str(tmp_path), str(tmp_path.parent / tmp_path.name / "made" / "..")])):
        if capture == "cap_none":
            with pytest.raises(LookupError):
                bundle.resolve(spark, capture, roots)
    with pytest.raises(ValueError, match="not 192 x 256"):
        bundle.build(spark, str(tmp_path / "raw"), str(tmp_path / "bad"))
    (tmp_path / "raw" / "odometry.csv").unlink()
    with pytest.raises(ValueError, match="odometry"):
        bundle.build(spark, str(tmp_path / "raw"), str(tmp_path / "bad"))


def test_commands(spark, done, tmp_path, capsys, monkeypatch):
    root, _, _ = done
    monkeypatch.setattr(cli, "session", lambda: spark)
    monkeypatch.chdir(tmp_path)
    assert cli.main(["ingest", str(root / "in" / "box"), "--out", str(tmp_path / "i")]) == 0
    doc = json.loads((tmp_path / "i" / "box" / "session.json").read_text())
    assert doc["tier"] == "lidar" and len(doc["frames"]) == len(list(views())) and len(doc["frames"][0]["pose"]) == 16
    assert cli.main(["run", str(tmp_path / "nope")]) == 2 and cli.main(["ingest", str(tmp_path / "nope")]) == 2
    assert cli.main(["ablate", "--capture", "cap_nowhere"]) == 2 and cli.main(["ablate"]) == 2
    assert cli.main(["ablate", "--capture", str(root / "in" / "box"), "--feature", "other"]) == 2
    assert cli.main(["bench", "--tier", "lidar"]) == 3 and cli.main(["report"]) == 3
    assert cli.main(["--version"]) == 0 and params.VERSION in capsys.readouterr().out
    (tmp_path / "c.json").write_text('{"strid": 2}')
    assert cli.main(["run", str(root / "in" / "box"), "--config", str(tmp_path / "c.json")]) == 2
    (tmp_path / "video").mkdir()
    (tmp_path / "video" / "odometry.csv").write_text("x")
    assert cli.main(["run", str(tmp_path / "video")]) == 3
    assert cli.main(["build", str(tmp_path / "nothing"), "--out", str(tmp_path)]) == 2


def test_a_capture_without_rooms(spark, tmp_path):
    """Two frames of a bare wall: a stub of a plan, and every other file."""
    folder = tmp_path / "in" / "bare"
    for k in ("depth", "confidence"):
        (folder / k).mkdir(parents=True)
    for i in range(2):
        (folder / "depth" / f"{i:06d}.png").write_bytes(png.encode(np.full((8, 8), 1500, np.uint16)))
        (folder / "confidence" / f"{i:06d}.png").write_bytes(png.encode(np.full((8, 8), 2, np.uint8)))
    (folder / "odometry.csv").write_text("timestamp,frame,x,y,z,qx,qy,qz,qw\n0,000000,0,0,0,0,0,0,1\n1,000001,0,0,0.1,0,0,0,1\n")
    (folder / "camera_matrix.csv").write_text("9,0,4\n0,9,4\n0,0,1\n")
    cfg = params.load(stride=1, output_dir=str(tmp_path / "out"))
    assert cli.run(spark, str(folder), cfg) == 0
    doc = json.loads((tmp_path / "out" / "bare" / "plan.json").read_text())
    assert doc["status"] == "not_computed" and doc["rooms"] == [] and plan.problems(doc) == []
    report = json.loads((tmp_path / "out" / "bare" / "damage.json").read_text())
    assert report["damage_count"] == 0 and report["warnings"]
    assert pipeline.lists_of(None, "damages") == {"damages": []} and files.found(spark, f"{tmp_path}/nowhere/*") == []
