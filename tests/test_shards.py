"""Shards that are slow or fail, and protocols of two writers on two file systems."""

import threading
import time

import pytest

from streamloom.sources import runs, shards


def test_slow_and_failing_shards_are_told(spark):
    def work(rank, ranks):
        if rank == 1:
            raise ValueError("no model")
        if rank == 2:
            time.sleep(30)

    began = time.time()
    got = {r["rank"]: r for r in shards.run_shards(spark, 3, work, timeout=3).collect()}
    assert time.time() - began < 25
    assert {k: (r["status"], r["error"], r["done"]) for k, r in got.items()} == {0: ("done", None, 1), 1: ("failed", "ValueError: no model", 1), 2: ("timeout", None, 1)}


def test_shards_write_and_are_waited_for(spark, tmp_path):
    path, rows = str(tmp_path / "run"), spark.createDataFrame([("a", 1)], "key string, line long")
    runs.append_rows(rows, path, 0)
    with pytest.raises(shards.ShardsMissing) as e:
        shards.wait_for_shards(spark, path, 2, timeout=0.3, poll=0.1)
    assert e.value.missing == [1]
    late = threading.Timer(1.0, lambda: runs.append_rows(rows, path, 1))
    late.start()
    assert shards.wait_for_shards(spark, path, 2, timeout=30, poll=0.2) == [0, 1]
    late.join()


@pytest.mark.parametrize("scheme", ["file", "viewfs"])
def test_two_writers_one_protocol(spark, tmp_path, scheme):
    spark._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.lab.link./at", f"file://{tmp_path}")
    folder = f"file://{tmp_path}/run" if scheme == "file" else "viewfs://lab/at/run"
    ended: list = []

    def write(k):
        try:
            runs.ensure_protocol(folder, {"k": k}, spark)
            ended.append(k)
        except runs.ProtocolMismatch:
            ended.append(None)

    write(0)
    threads = [threading.Thread(target=write, args=(k,)) for k in (0, 1, 0, 1)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert sorted(map(str, ended)) == ["0", "0", "0", "None", "None"]
    assert [p.name for p in (tmp_path / "run").iterdir() if not p.name.endswith(".crc")] == ["protocol.json"]
    (tmp_path / "old").mkdir()
    (tmp_path / "old" / "part-0").write_text("{}")
    with pytest.raises(runs.ProtocolMismatch):
        runs.ensure_protocol(folder.replace("/run", "/old"), {"k": 0}, spark)


def test_another_scheme_needs_a_session():
    with pytest.raises(ValueError):
        runs.ensure_protocol("viewfs://lab/at/run", {})
