"""The frame source against a plain reader."""

import numpy as np
import pytest

from streamloom.sources import frames as R


def video(n, w, h, rate="25:2", kind="mono", seed=0):
    rng = np.random.default_rng(seed)
    extra = {"mono": 0, "420jpeg": 2 * ((w + 1) // 2) * ((h + 1) // 2), "422": 2 * ((w + 1) // 2) * h, "444": 2 * w * h}[kind]
    luma = rng.integers(0, 256, (n, h, w), dtype=np.uint8)
    body = b"".join(b"FRAME\n" + f.tobytes() + bytes(rng.integers(0, 256, extra, dtype=np.uint8)) for f in luma)
    return f"YUV4MPEG2 W{w} H{h} F{rate} Ip A1:1 C{kind}\n".encode() + body, luma


@pytest.fixture
def folder(tmp_path):
    luma = {}
    for k, (kind, size) in enumerate([("mono", (8, 6)), ("420jpeg", (7, 5)), ("422", (9, 4)), ("444", (4, 4))]):
        data, luma[f"v{k}.y4m"] = video(120, *size, kind=kind, seed=k)
        (tmp_path / f"v{k}.y4m").write_bytes(data)
    return tmp_path, luma


@pytest.mark.parametrize("share", [300, 5000, R.RANGE])
def test_a_window_of_frames(spark, folder, share):
    path, luma = folder
    want = {(name, k, k * 2 / 25): f.tobytes() for name, fs in luma.items() for k, f in enumerate(fs) if 2.0 <= k * 2 / 25 < 5.04}
    got = R.frames(spark, str(path), 2.0, 5.04, rangeBytes=share).collect()
    assert {(r["path"].rsplit("/", 1)[1], r["frame"], r["pts"]): bytes(r["luma"]) for r in got} == want and len(got) == len(want)
    assert all((r["height"], r["width"]) == luma[r["path"].rsplit("/", 1)[1]].shape[1:] and r["fault"] is None for r in got)
    assert R.frames(spark, str(path), rangeBytes=share).count() == 480


def test_bounds_of_every_kind(spark, folder):
    path, _ = folder
    every = R.frames(spark, str(path) + "/v0.y4m", rangeBytes=999)
    times = [k * 2 / 25 for k in range(120)]
    for text, keep in [("pts > 2 and pts <= 4", lambda t: 2 < t <= 4), ("pts = 4.0", lambda t: t == 4), ("pts >= 9.5", lambda t: t >= 9.5), ("pts < 0", lambda t: t < 0), ("pts > 1 and pts > 3 and pts < 5 and pts < 4", lambda t: 3 < t < 4), ("pts > 5 and frame % 2 = 0", None)]:
        got = sorted(r["pts"] for r in every.filter(text).collect())
        assert got == ([t for t in times if keep(t)] if keep else [t for k, t in enumerate(times) if t > 5 and k % 2 == 0])


def test_filters_reach_the_source(spark, folder, monkeypatch):
    path, _ = folder
    reader = R.FrameReader({"path": str(path)})
    rest = list(reader.pushFilters([R.GreaterThanOrEqual(("pts",), 2.0), R.LessThan(("pts",), 3.0), R.EqualTo(("frame",), 1)]))
    assert [type(f) for f in rest] == [R.EqualTo]
    head = R.Header.of((path / "v0.y4m").read_bytes()[:200])
    assert reader.within(head, 0, 120) == (25, 38)
    plan = R.frames(spark, str(path), 2.0, 3.0)._jdf.queryExecution().executedPlan().toString()
    assert "Filter" not in plan.replace("PushedFilters", "").replace("pushedFilters", "") or "pts" in plan.split("BatchScan")[1]


def test_resizing(spark, folder):
    path, luma = folder
    got = {r["frame"]: bytes(r["luma"]) for r in R.frames(spark, str(path) + "/v0.y4m", 0, 1, width=3, height=2).collect()}
    for k, data in got.items():
        f = luma["v0.y4m"][k].astype(int)
        cells = [f[y * 6 // 2 : (y + 1) * 6 // 2, x * 8 // 3 : (x + 1) * 8 // 3] for y in range(2) for x in range(3)]
        assert list(data) == [(2 * c.sum() + c.size) // (2 * c.size) for c in cells]
    assert R.resize(np.arange(4, dtype=np.uint8).reshape(1, 2, 2), 4, 2).tolist() == [[[0, 0, 1, 1], [2, 2, 3, 3]]]


def test_faults_are_rows(spark, tmp_path):
    data, _ = video(10, 4, 4)
    (tmp_path / "cut.y4m").write_bytes(data[:-5])
    (tmp_path / "broken.y4m").write_bytes(data.replace(b"FRAME\n", b"FRAME\n", 1)[: len(data) - 3 * 22] + b"GARBAGE---------------" * 3)
    (tmp_path / "none.y4m").write_bytes(b"RIFF....")
    (tmp_path / "empty.y4m").write_bytes(b"")
    (tmp_path / "deep.y4m").write_bytes(data.replace(b"Cmono", b"C420p10"))
    (tmp_path / "rate.y4m").write_bytes(data.replace(b"F25:2", b"F25:0"))
    got = R.frames(spark, str(tmp_path)).collect()
    faults = {(r["path"].rsplit("/", 1)[1], r["frame"], r["fault"]) for r in got if r["fault"]}
    assert faults == {("cut.y4m", 9, "frame is cut off"), ("broken.y4m", 7, "no frame where one should begin"), ("none.y4m", None, "no YUV4MPEG2 header"), ("empty.y4m", None, "no YUV4MPEG2 header"), ("deep.y4m", None, "pictures of kind 420p10 are not read"), ("rate.y4m", None, "header with a size or rate of nothing")}
    assert sum(r["fault"] is None for r in got) == 16


def test_written_and_read_back(spark, tmp_path):
    rows = [(v, k, bytes([v * 10 + k] * 4)) for v in range(3) for k in range(5)]
    made = R.write_files(spark.createDataFrame(rows, "video long, frame long, luma binary"), f"file://{tmp_path}/made", 2, 2, (1, 1))
    assert sorted(map(tuple, made.collect())) == [(0, 5), (1, 5), (2, 5)]
    got = R.frames(spark, f"file://{tmp_path}/made").collect()
    assert sorted((int(r["path"].rsplit("/", 1)[1][:-4]), r["frame"], bytes(r["luma"])) for r in got) == rows
