"""Runs by command line: answers, going on after a stop, merging and scores; checkpoints and annotations on disk."""

import json

import pytest

from streamloom import cli
from streamloom.sources import annotations, media, runs


def test_a_run_goes_on_where_it_stopped(spark, tmp_path, capsys):
    spark.createDataFrame([(1, 1, 1.0, "EVENT: cook enters kitchen"), (2, 1, 1.0, "EVENT: child leaves kitchen")], "video long, chunk long, ts double, caption string").write.parquet(f"{tmp_path}/captions")
    asked = [(v, q, f"question {q} kitchen") for v in (1, 2) for q in range(3)]
    spark.createDataFrame(asked, "video long, qid long, question string").write.parquet(f"{tmp_path}/questions")
    spark.createDataFrame([(v, q, "MCQ", "A") for v, q, _ in asked], "video long, qid long, task string, truth string").write.parquet(f"{tmp_path}/truth")
    base = ["answer", "--captions", f"{tmp_path}/captions", "--questions", f"{tmp_path}/questions", "--out", f"{tmp_path}/run", "--mode", "incremental", "--top-k", "3", "--scorer", "tests.stand_in:HashingScorer", "--vectors", f"{tmp_path}/vectors"]
    cli.main([*base, "--per-video", "2", "--videos", "1"], spark)
    cli.main(base, spark)
    cli.main(base, spark)
    cli.main(["merge", "--out", f"{tmp_path}/run"], spark)
    cli.main(["score", "--out", f"{tmp_path}/run", "--truth", f"{tmp_path}/truth"], spark)
    said = [json.loads(x) for x in capsys.readouterr().out.splitlines() if x.startswith("{")]
    assert said[:4] == [{"answered": 2}, {"answered": 4}, {"answered": 0}, {"rows": 6}]
    assert said[4]["task"] == "MCQ" and said[4]["total"] == 6
    with pytest.raises(runs.ProtocolMismatch):
        cli.main([*base, "--sim-threshold", "0.5"], spark)
    with pytest.raises(ValueError):
        cli.main([*base, "--top-k", "many"], spark)


def test_checkpoints_of_shards(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1, "x"), ("b", 2, "y")], "key string, line long, response string")
    runs.append_rows(rows, f"{tmp_path}/s", 0)
    runs.append_rows(rows.filter("key = 'a'"), f"{tmp_path}/s", 2)
    got = runs.read_rows(spark, f"{tmp_path}/s", "key string, line long, response string, rank int")
    assert sorted((r["key"], r["rank"], r["line"]) for r in got.collect()) == [("a", 0, 1), ("a", 2, 1), ("b", 0, 2)]
    assert runs.done_ranks(spark, f"{tmp_path}/s", 3) == [0, 2]
    with pytest.raises(ValueError):
        runs.append_rows(rows.drop("line"), f"{tmp_path}/s")
    with pytest.raises(ValueError):
        runs.ensure_protocol("hdfs://host/x", {})


def test_annotations_and_manifests_on_disk(spark, tmp_path):
    (tmp_path / "ovo.json").write_text(json.dumps([{"id": 1, "task": "EPM", "question": "q", "options": ["a", "b"], "gt": 1, "realtime": 3.0}, {"id": 2, "task": "REC", "activity": "jump", "test_info": [{"realtime": 9.0, "count": 2}, {"realtime": 4.0, "count": 1}]}, {"id": -1, "task": "EPM"}]))
    rows = {r["id"]: r for r in annotations.read_ovo(spark, f"{tmp_path}/ovo.json").collect()}
    assert rows[1]["truth"] == "B" and rows[1]["error"] is None and rows[2]["section"] == "forward" and rows[-1]["error"]
    items = annotations.forward_items(annotations.read_ovo(spark, f"{tmp_path}/ovo.json")).collect()
    assert sorted((r["place"], r["realtime"], r["count"]) for r in items) == [(0, 9.0, 2), (1, 4.0, 1)]
    (tmp_path / "stream.json").write_text(json.dumps([{"time": "[0:00]", "video_path": "./videos/a.mp4", "questions": [{"question": "q0", "time_stamp": "00:01:05", "options": ["x"]}, {"question": "q1", "time_stamp": "0:09"}]}]))
    got = {r["occurrence"]: r for r in annotations.read_stream(spark, f"{tmp_path}/stream.json").collect()}
    assert got["0:0"]["seconds"] == 65 and got["0:1"]["seconds"] == 9 and got["0:0"]["options"] == ["x"]
    sha = annotations.digest(spark, f"{tmp_path}/ovo.json").first()["sha256"]
    entry = {"original_path": "o", "original_sha256": sha, "input_path": f"file:{tmp_path}/ovo.json", "input_sha256": sha, "verified_until": 5.0, "unavailable_after": 5.0}
    (tmp_path / "manifest.json").write_text(json.dumps({"schema_version": 1, "entries": {"a": entry, "b": entry | {"verified_until": 4.0}}}))
    manifest = media.read_manifest(spark, f"{tmp_path}/manifest.json")
    assert {r["video"]: r["error"] is None for r in manifest.collect()} == {"a": True, "b": False}
    assert {r["video"]: r["verified"] for r in media.verify_files(manifest, annotations.digest(spark, f"{tmp_path}/ovo.json")).collect()}["a"]
