"""Commands over capture bundles. Exit codes: 0; 1 an invalid plan or a failed invariant; 2 bad arguments
or input; 3 what isn't supported."""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path

from pyspark.sql import SparkSession

from . import params

OK, INVALID, BAD, UNSUPPORTED = 0, 1, 2, 3


def session() -> SparkSession:
    return SparkSession.builder.appName("planloom").getOrCreate()


def saved(run, cfg: params.Config) -> int:
    """Writes the files of each capture and prints a line about it."""
    from . import pipeline
    from .sources import files

    code = OK
    for row in run.docs.toLocalIterator():  # one row a capture
        out, wrong, failed = pipeline.files_of(row.asDict(), cfg)
        folder = cfg.output_dir if "://" in cfg.output_dir else str(Path(cfg.output_dir).resolve())
        for name, content in out.items():
            files.put(f"{folder}/{row['capture_id']}/{name}", content if isinstance(content, bytes) else content.encode())
        doc = json.loads(out["plan.json"]) if "plan.json" in out else {}
        about = {"capture": row["capture_id"], "status": doc.get("status"), "rooms": len(doc.get("rooms", [])), "damages": len(doc.get("damages", [])), "problems": wrong, "failed": failed}
        print(json.dumps(about | {"ablation": (doc.get("stitch") or {}).get("ablation")}))
        code = INVALID if wrong or failed else code
    return code


def run(spark: SparkSession, folder: str, cfg: params.Config, rgb=None) -> int:
    """Every step, over the bundles of a folder or glob."""
    from . import pipeline
    from .sources import bundle, files

    if not files.found(spark, f"{folder}/odometry.csv"):
        print(f"no bundle in {folder}", file=sys.stderr)
        return BAD
    tier = bundle.tier_of(spark, folder)
    if tier != "lidar":
        print(f"tier {tier} isn't supported", file=sys.stderr)
        return UNSUPPORTED
    return saved(pipeline.run(spark, folder, cfg, rgb), cfg)


def resume(spark: SparkSession, cfg: params.Config, walls: bool) -> int:
    """Goes on from the evidence (or the walls) that an earlier run left in the output folder."""
    from . import pipeline

    return saved(pipeline.resumed(spark, cfg.output_dir, cfg, walls), cfg)


def ingest(spark: SparkSession, folder: str, cfg: params.Config) -> int:
    """The bundle alone: session.json with the tier, its frames and poses."""
    from pyspark.sql import functions as F

    from .plans import recon
    from .sources import bundle, files

    if not files.found(spark, f"{folder}/odometry.csv"):
        print(f"no bundle in {folder}", file=sys.stderr)
        return BAD
    tier = bundle.tier_of(spark, folder)
    frames = bundle.read_frames(spark, folder)
    frames = frames.join(recon.poses(frames), ["capture_id", "idx"], "left").withColumn("k", F.array("fx", "fy", "cx", "cy"))
    row = F.struct("timestamp", "frame", "idx", "depth_ref", "confidence_ref", F.col("m").alias("pose"), "k")
    docs = frames.groupBy("capture_id").agg(F.to_json(F.array_sort(F.collect_list(row))).alias("frames"))
    root = cfg.output_dir if "://" in cfg.output_dir else str(Path(cfg.output_dir).resolve())
    for r in docs.toLocalIterator():  # one row a capture
        doc = {"capture_id": r["capture_id"], "tier": tier, "frames": json.loads(r["frames"]), "provenance": params.provenance(tier, cfg.seed)}
        files.put(f"{root}/{r['capture_id']}/session.json", (json.dumps(doc, indent=2, sort_keys=True) + "\n").encode())
        print(json.dumps({"capture": r["capture_id"], "tier": tier, "frames": len(doc["frames"])}))
    return OK


def validate(path: str) -> int:
    from .plans import plan

    wrong = plan.problems(json.loads(Path(path).read_text()))
    print("\n".join(wrong) or "valid")
    return INVALID if wrong else OK


def ablate(spark: SparkSession, capture: str, feature: str, cfg: params.Config, rgb=None) -> int:
    """A whole run whose drawing compares the footprint with and without the feature."""
    from .sources import bundle

    if feature != "loop_closure":
        print(f"unknown feature {feature}", file=sys.stderr)
        return BAD
    try:
        here = Path.cwd()
        folder = bundle.resolve(spark, capture, [str(here), str(here / "bench" / "data")])
    except LookupError as e:
        print(e, file=sys.stderr)
        return BAD
    return run(spark, folder, cfg, rgb)


def build(spark: SparkSession, got: argparse.Namespace) -> int:
    from .sources import bundle

    meta = {"device": got.device, "ios": got.ios, "rooms_expected": got.rooms_expected}
    if got.app:
        meta["tool"] = {"name": got.app, "version": got.app_version or ""}
    try:
        target, warnings = bundle.build(spark, got.raw, str(Path(got.out).resolve()), got.capture_id, got.depth_units, meta)
    except ValueError as e:
        print(e, file=sys.stderr)
        return BAD
    print("\n".join([f"warning: {w}" for w in warnings] + [f"built {target}"]))
    return OK


def arguments() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="planloom")
    parser.add_argument("--version", "-V", action="version", version=f"planloom {params.VERSION}")
    sub = parser.add_subparsers(dest="command", required=True)

    def command(name: str, *positional: str) -> argparse.ArgumentParser:
        a = sub.add_parser(name)
        for p in positional:
            a.add_argument(p)
        if name in ("run", "ingest", "ablate", "resume"):
            a.add_argument("--config")
            a.add_argument("--out", "-o")
        if name in ("run", "ablate"):
            a.add_argument("--stride", type=int)
            a.add_argument("--voxel-cm", type=float)
        return a

    command("run", "folder")
    command("ingest", "folder")
    command("resume").add_argument("--walls", action="store_true")
    a = command("ablate")
    a.add_argument("--capture", required=True)
    a.add_argument("--feature", default="loop_closure")
    command("validate", "plan")
    b = command("build", "raw")
    b.add_argument("--out", default="bundles")
    b.add_argument("--depth-units", choices=("mm", "m"), default="mm")
    for name in ("capture-id", "device", "ios", "app", "app-version"):
        b.add_argument(f"--{name}")
    b.add_argument("--rooms-expected", type=int, default=0)
    for name in ("bench", "report"):  # named, but not there yet
        command(name).add_argument("--tier")
    return parser


def main(args: list[str] | None = None) -> int:
    try:
        got = arguments().parse_args(args)
    except SystemExit as e:
        return int(e.code or 0)
    if got.command == "validate":
        return validate(got.plan)
    if got.command in ("bench", "report"):
        print(f"{got.command} isn't there yet", file=sys.stderr)
        return UNSUPPORTED
    if got.command == "build":
        return build(session(), got)
    given = {"output_dir": got.out, "stride": getattr(got, "stride", None), "voxel": got.voxel_cm / 100 if getattr(got, "voxel_cm", None) else None}
    try:
        cfg = params.load(got.config, **{k: v for k, v in given.items() if v is not None})
    except ValueError as e:
        print(e, file=sys.stderr)
        return BAD
    if got.command == "resume":
        return resume(session(), cfg, got.walls)
    if got.command == "ablate":
        return ablate(session(), got.capture, got.feature, cfg)
    return run(session(), got.folder, cfg) if got.command == "run" else ingest(session(), got.folder, cfg)


if __name__ == "__main__":
    sys.exit(main())
