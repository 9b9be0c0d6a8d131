import json

import pytest

from planloom import params
from planloom.sources import video


def test_overrides(tmp_path):
    f = tmp_path / "c.json"
    f.write_text(json.dumps({"stride": 5, "walls": {"min_run": 0.8}}))
    c = params.load(f, seed=7)
    assert (c.stride, c.seed, c.walls["min_run"], c.walls["run_gap"]) == (5, 7, 0.8, 0.10)
    assert params.load(tmp_path / "none.json") == params.Config()


@pytest.mark.parametrize("bad", [{"strides": 5}, {"walls": {"min": 1}}])
def test_unknown_names(bad):
    with pytest.raises(ValueError, match="unknown"):
        params.load(**bad)


def test_provenance():
    p = params.provenance("lidar", 3)
    assert p["tier"] == "lidar" and p["seed"] == 3 and set(p) == {"tier", "code_version", "git_sha", "seed"}


def test_video_without_ffmpeg_or_file(spark, tmp_path):
    video.register(spark)
    df = spark.read.format("video_frames").option("paths", str(tmp_path / "cap" / "rgb.mp4")).option("stride", "2").load()
    assert df.count() == 0 and df.columns == ["capture_id", "idx", "height", "width", "rgb"]
    assert video.frame_numbers(3, 5) == [0, 5, 10]
