"""Bounded live operators against plain loops, for files in any order, with late rows, restarts and repeats."""

import random

import pytest
from pyspark.sql import functions as F

from streamloom.streaming import bounded as B

SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double"
MINUTE = 60_000_000
HOUR = 60 * MINUTE


def events(n=240, seed=4):
    rng, rows, us = random.Random(seed), [], 1_700_000_000_000_000
    for i in range(n):
        us += rng.randrange(1, 20) * MINUTE + (0 if i % 5 else -30 * MINUTE)
        rows.append((i, us, rng.randrange(3), rng.choice(["view", "click", "purchase", "question"]), 1.0))
    return rows


def write(spark, path, parts):
    """One file for each part, read in the order of their numbers."""
    import os
    import time

    for k, rows in enumerate(parts):
        df = spark.createDataFrame(rows, "event_id long, us long, user_id long, event_type string, value double")
        df = df.select("event_id", F.timestamp_micros("us").cast("timestamp_ntz").alias("ts"), "user_id", "event_type", "value")
        df.coalesce(1).write.mode("append").parquet(path)
        names = [f for f in os.listdir(path) if f.endswith(".parquet") and not f.startswith("part-9")]
        at = time.time() - 1000 + k
        for f in names:
            new = f"{path}/part-9{k:03d}.parquet"
            os.rename(f"{path}/{f}", new)
            os.utime(new, (at, at))


def run(spark, path, folder, operator, files=1, delay="1 day", **kw):
    rows = B.rows_of(B.source(spark, path, files), delay, amount=F.when(F.col("event_type") == "click", 1).when(F.col("event_type") == "purchase", 2).otherwise(0))
    return B.deliver(operator(rows), "q", str(folder), **kw).collect()


@pytest.fixture
def shuffled(spark, tmp_path):
    rows = events()
    mixed = sorted(rows, key=lambda r: r[1] + random.Random(r[0]).randrange(0, 12) * HOUR)
    # a row far ahead, so that the watermark passes all others
    far = [(9999, rows[-1][1] + 90 * 24 * HOUR, 77, "view", 1.0)]
    path = str(tmp_path / "in")
    write(spark, path, [mixed[k : k + 60] for k in range(0, 240, 60)] + [far])
    return path, rows


@pytest.mark.parametrize("files", [1, 3])
def test_windows_and_counts_in_any_order(spark, tmp_path, shuffled, files):
    path, rows = shuffled
    got = run(spark, path, tmp_path / "w", lambda r: B.windows(r, 6 * HOUR, 3 * HOUR), files)
    want = {}
    for i, us, u, _, _ in rows:
        s = us - us % (3 * HOUR)
        for start in (s, s - 3 * HOUR):
            n, a, b = want.get((u, start), (0, us, us))
            want[u, start] = (n + 1, min(a, us), max(b, us))
    assert {(r["user_id"], r["us"]): (r["n"], r["first_us"], r["last_us"]) for r in got if r["kind"] == "window"} == want
    assert len(got) == len(want)  # each window once, nothing late


def test_counts_and_cooldown_in_order(spark, tmp_path, shuffled):
    path, rows = shuffled
    got = run(spark, path, tmp_path / "c", B.counts)
    add = {"click": 1, "purchase": 2}
    least = {}
    for _, us, u, what, _ in rows:
        least[u, us] = min(add.get(what, 0), least.get((u, us), 9))
    for u in range(3):
        last = max((r["us"], r["n"]) for r in got if r["user_id"] == u)
        assert last == (max(us for v, us in least if v == u), sum(x for (v, _), x in least.items() if v == u))
    got = run(spark, path, tmp_path / "d", lambda r: B.cooldown(r, 2 * HOUR))
    want, last = [], {}
    for i, us, u, what, _ in sorted(rows, key=lambda r: (r[1], r[0])):
        if what in add and (u not in last or us - last[u] > 2 * HOUR):
            last[u] = us
            want.append(i)
    assert sorted(r["id"] for r in got if r["kind"] == "accepted") == sorted(want)


@pytest.mark.parametrize("files", [1, 2])
def test_recent_buffer_evicts_into_memory(spark, tmp_path, shuffled, files):
    path, rows = shuffled
    got = [r for r in run(spark, path, tmp_path / "r", lambda r: B.recent(r, 3, HOUR), files) if r["user_id"] < 3]
    evicted, context = {}, {}
    for u in range(3):
        own = sorted((us, i, what) for i, us, v, what, _ in rows if v == u)
        chunks = {}
        for us, i, what in own:
            if what != "question":
                chunks.setdefault(us // HOUR, []).append(i)
        order = sorted(chunks)
        for k, c in enumerate(order[:-3]):
            evicted[u, c] = (chunks[c], (order[k + 3] + 1) * HOUR)
        for us, i, what in own:
            if what == "question":
                over = [c for c in order if (c + 1) * HOUR <= us][-3:]
                context[i] = [x for c in over for x in chunks[c]]
    assert {(r["user_id"], r["id"]): (r["ids"], r["us"]) for r in got if r["kind"] == "evicted"} == evicted
    assert {r["id"]: r["ids"] for r in got if r["kind"] == "context"} == context
    assert len(got) == len(evicted) + len(context)


def test_late_rows_go_beside(spark, tmp_path):
    rows, path = events(60), str(tmp_path / "in")
    far = [(900, rows[-1][1] + 40 * 24 * HOUR, 0, "view", 1.0)]
    late = [(901, rows[3][1], 0, "click", 1.0), (902, rows[9][1], 1, "click", 1.0)]
    write(spark, path, [rows, far, late, [(903, far[0][1] + 40 * 24 * HOUR, 0, "view", 1.0)]])
    for name, op in (("w", lambda r: B.windows(r, HOUR)), ("c", B.counts)):
        got = run(spark, path, tmp_path / name, op)
        assert sorted(r["id"] for r in got if r["kind"] == "late") == [901, 902]
    assert sum(r["n"] for r in run(spark, path, tmp_path / "w", lambda r: B.windows(r, HOUR)) if r["kind"] == "window") == 61


def test_state_stops_growing(spark, tmp_path):
    rng, path = random.Random(1), str(tmp_path / "in")
    parts = [[(1000 * k + i, 1_700_000_000_000_000 + (k * 50 + i) * HOUR, i % 2, "view", 1.0) for i in range(50)] for k in range(8)]
    write(spark, path, parts)
    sizes = []
    rows = B.rows_of(B.source(spark, path, 1), "10 hours")
    query = B.recent(rows, 4, HOUR).writeStream.foreachBatch(lambda df, e: df.count()).option("checkpointLocation", str(tmp_path / "s")).trigger(availableNow=True).start()
    query.awaitTermination()
    sizes = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    assert len(sizes) >= 8 and max(sizes[2:]) <= sizes[1] + 10
    del rng


def test_stopped_between_writes_each_row_is_there_once(spark, tmp_path, shuffled):
    path, rows = shuffled
    operator = lambda r: B.windows(r, HOUR)
    whole = sorted(map(repr, run(spark, path, tmp_path / "a", operator)))

    def stop(epoch):
        if epoch == 2:
            raise RuntimeError("stopped")

    with pytest.raises(Exception, match="stopped"):
        run(spark, path, tmp_path / "b", operator, before_commit=stop)
    assert sorted(map(repr, run(spark, path, tmp_path / "b", operator))) == whole
    assert sorted(map(repr, run(spark, path, tmp_path / "b", operator))) == whole  # nothing new, nothing twice


def test_repeats_within_the_delay_count_once(spark, tmp_path):
    rows, path = events(80), str(tmp_path / "in")
    write(spark, path, [rows[:50], rows[30:80], rows[60:80]])
    out = B.deliver(B.once(B.source(spark, path, 1), "3 days", ["event_id"]).select("event_id"), "once", str(tmp_path / "o"))
    assert sorted(r[0] for r in out.collect()) == list(range(80))
