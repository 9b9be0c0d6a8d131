"""Settings of a run: the kernels' defaults, overridden by a file or by name. Unknown names are errors."""

from __future__ import annotations

import json
import subprocess
from dataclasses import dataclass, field
from pathlib import Path

from .kernels import rooms, walls

VERSION = "0.1.0"


@dataclass(frozen=True)
class Config:
    stride: int = 20
    voxel: float = 0.01
    depth_scale: float = 0.001
    max_range: float = 8.0
    least_confidence: int = 1
    least_support: int = 4
    seed: int = 1337
    loop_closure: bool = True
    output_dir: str = "out"
    save_unfiltered: bool = True
    damage: bool = True
    damage_stride: int = 60
    damage_frames: int = 200
    damage_nearest: float = 0.30
    damage_farthest: float = 6.0
    walls: dict = field(default_factory=lambda: dict(walls.PARAMS))
    rooms: dict = field(default_factory=lambda: dict(rooms.PARAMS))


def load(path: str | Path | None = None, **overrides) -> Config:
    """Defaults, then the file (JSON, or YAML where PyYAML is at hand; a missing one counts as empty),
    then the overrides."""
    given: dict = {}
    if path is not None and Path(path).exists():
        text = Path(path).read_text()
        if Path(path).suffix == ".json":
            given = json.loads(text)
        else:
            import yaml

            given = yaml.safe_load(text) or {}
    base = Config()
    out = {}
    for name, value in {**given, **overrides}.items():
        if not hasattr(base, name):
            raise ValueError(f"unknown setting {name}")
        if name in ("walls", "rooms"):
            unknown = set(value) - set(getattr(base, name))
            if unknown:
                raise ValueError(f"unknown settings in {name}: {sorted(unknown)}")
            value = getattr(base, name) | value
        out[name] = value
    return Config(**out)


def provenance(tier: str, seed: int = 1337) -> dict:
    """What made a plan: tier, version, commit (None outside a repository) and seed."""
    try:
        sha = subprocess.run(["git", "rev-parse", "HEAD"], capture_output=True, text=True, timeout=5, cwd=Path(__file__).parent).stdout.strip() or None
    except (OSError, subprocess.TimeoutExpired):
        sha = None
    return {"tier": tier, "code_version": VERSION, "git_sha": sha, "seed": seed}
