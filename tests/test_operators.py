"""Operators on small inputs, and stream against batch."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from streamloom.operators import chunks as C
from streamloom.operators import interval as I
from streamloom.operators import memory as M
from streamloom.operators import retrieval as S
from streamloom.operators import scoring as H
from streamloom.sources import runs
from streamloom.streaming import live

CAPTIONS = [
    (1, 1, 10.0, "noise\nPEOPLE: P1 (tall guest): walks\nOBJECTS: O1 (blue jug)\nACTIONS: P1 lifts the jug; P9 waves to all\nTEXT: menu card\nSPATIAL: NONE\nEVENT: guest lifts jug"),
    (1, 2, 20.0, "people: P1 (tall guest)\n* ACTIONS: P1 pours water\n  slowly; N/A\nEVENT: guest pours water"),
    (1, 3, 30.0, "PEOPLE: P2 (short guest)\nACTIONS: P2 sits down; P1 pours water slowly\nEVENT: guests sit"),
]


@pytest.fixture
def log(spark):
    return M.observations(spark.createDataFrame(CAPTIONS, "video long, chunk long, ts double, caption string"))


def test_parse(log):
    got = [(r["chunk"], r["node_type"], r["text"]) for r in log.orderBy("seq").collect()]
    assert (2, "action", "P1 pours water slowly") in got
    assert all(t != "NONE" for _, _, t in got)
    assert got[0] == (1, "entity", "P1 (tall guest): walks")


def test_merge_links_and_retraction(spark, log):
    node = M.nodes(log)
    by_key = {r["key"]: r for r in node.collect()}
    assert by_key["id:P1"]["n"] == 2 and by_key["action:p1 pours water slowly"]["n"] == 2
    hub = {r["text"]: r["hub"] for r in M.with_hubs(log, node).collect()}
    assert hub["P1 lifts the jug"] == by_key["id:P1"]["node_id"] and hub["P9 waves to all"] is None
    gone = spark.createDataFrame([(1, 2)], "video long, chunk long")
    left = M.retract(log, gone)
    again = M.observations(spark.createDataFrame([c for c in CAPTIONS if c[1] != 2], "video long, chunk long, ts double, caption string"))
    assert M.signature(M.nodes(left), M.edges(left)).collect() == M.signature(M.nodes(again), M.edges(again)).collect()


def test_rewrite(spark):
    items = spark.createDataFrame([(1, 1, 1, "action", "P1 gives O1 to P2"), (1, 1, 2, "text_ocr", "P1")], "video long, chunk long, item long, node_type string, text string")
    known = spark.createDataFrame([(1, 1, "P1", "P7", "man near P2"), (1, 1, "O1", "O3", "cup"), (1, 1, "O1", "O4", "jug")], "video long, chunk long, local_id string, gid string, description string")
    got = [r["text"] for r in M.rewrite_references(items, known).orderBy("item").collect()]
    assert got == ["P7 (man near P2) gives [unresolved object reference] to [unresolved person reference]", "P1"]


def test_entity_resolution_against_a_loop(spark):
    rng = np.random.default_rng(3)
    rows = [(v, p // 3, p, "PO"[p % 2], (x / np.linalg.norm(x)).tolist()) for v in range(3) for p in range(40) for x in [rng.normal(size=4)]]
    want = {}
    for v in range(3):
        entities, counters, claimed, chunk = [], {}, set(), None
        for _, c, p, kind, vec in (r for r in rows if r[0] == v):
            if c != chunk:
                chunk, claimed = c, set()
            best = max(((round(float(np.dot(e, vec)), 6), -i) for i, (g, k, e) in enumerate(entities) if k == kind and g not in claimed), default=(-2, 0))
            if best[0] >= 0.65:
                gid = entities[-best[1]][0]
            else:
                counters[kind] = counters.get(kind, 0) + 1
                gid = f"{kind}{counters[kind]}"
                entities.append((gid, kind, vec))
            claimed.add(gid)
            want[v, p] = gid
    df = spark.createDataFrame(rows, "video long, chunk long, pos long, kind string, vector array<double>")
    assert {(r["video"], r["pos"]): r["gid"] for r in M.resolve_entities(df).collect()} == want


def test_top_k_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(S, "BLOCK", 3)
    rng = np.random.default_rng(1)
    v = rng.normal(size=(50, 6))
    v /= np.linalg.norm(v, axis=1)[:, None]
    nodes = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "node_id long, vector array<double>")
    asked = nodes.filter("node_id % 7 = 0").withColumnRenamed("node_id", "qid")
    got = {(r["qid"], r["rank"]): r["node_id"] for r in S.top_k(asked, nodes, 4).collect()}
    for q in range(0, 50, 7):
        best = sorted((i for i in range(50) if i != q), key=lambda i: (-round(float(v[q] @ v[i]), 6), i))[:4]
        assert [got[q, k + 1] for k in range(4)] == best


def test_gap_needs_three_hits(spark):
    hits = spark.createDataFrame([(1, 1, 0.9, 1), (1, 2, 0.3, 2), (2, 1, 0.9, 1), (2, 2, 0.88, 2), (2, 3, 0.4, 3), (2, 4, 0.39, 4)], "qid long, node_id long, sim double, rank int")
    got = {(r["qid"], r["rank"]) for r in S.gap_cutoff(hits, 0.25).collect()}
    assert got == {(1, 1), (1, 2), (2, 1), (2, 2)}


def test_cooldown_against_a_loop(spark):
    random.seed(4)
    rows = [(v, float(t), t, random.choice([0, 1, 2])) for v in range(4) for t in random.sample(range(100), 30)]
    got = {r["video"]: (r["count"], r["suppressed"]) for r in I.cooldown(spark.createDataFrame(rows, "video long, ts double, frame_id long, delta int"), 5.0).collect()}
    for v in range(4):
        count = gone = 0
        last = None
        for _, t, _, d in sorted(r for r in rows if r[0] == v):
            if d and last is not None and t - last <= 5:
                gone += 1
            elif d:
                count, last = count + d, t
        assert got[v] == (count, gone)


def test_shards(spark):
    rows = spark.createDataFrame([("a", 0, 1, "x"), ("a", 0, 2, "y"), ("b", 1, 1, "z"), (None, 0, 3, "w"), ("a", 1, 0, "v")], "key string, rank int, line long, response string")
    assert sorted((r["key"], r["response"]) for r in H.merge_shards(rows).collect()) == [("a", "x"), ("b", "z")]
    want = spark.createDataFrame([("a",), ("c",)], "key string")
    assert sorted((r["key"], r["fault"]) for r in H.coverage(want, rows.filter("key is not null")).collect()) == [("a", "repeated"), ("b", "unexpected"), ("c", "missing")]


def test_as_of_and_sessions(spark):
    states = spark.createDataFrame([(1, 1.0, "a"), (1, 5.0, "b")], "video long, end_time double, s string")
    asked = spark.createDataFrame([(1, 0.5), (1, 5.0), (1, 9.0)], "video long, cutoff double")
    assert sorted((r["cutoff"], r["s"]) for r in C.as_of(states, asked).collect()) == [(5.0, "b"), (9.0, "b")]
    peaks = spark.createDataFrame([(1, t) for t in (0.0, 2.5, 5.1)], "video long, ts double")
    assert sorted((r["start"], r["n"]) for r in I.peak_sessions(peaks, 2.5).collect()) == [(0.0, 2), (5.1, 1)]


def test_protocol(tmp_path):
    runs.ensure_protocol(str(tmp_path / "r"), {"k": 1})
    runs.ensure_protocol(str(tmp_path / "r"), {"k": 1})
    with pytest.raises(runs.ProtocolMismatch):
        runs.ensure_protocol(str(tmp_path / "r"), {"k": 2})
    (tmp_path / "old").mkdir()
    (tmp_path / "old" / "results.json").write_text("{}")
    with pytest.raises(runs.ProtocolMismatch):
        runs.ensure_protocol(str(tmp_path / "old"), {"k": 1})


def test_stream_is_batch(spark):
    path = "/root/testdata/sf0.001/events.parquet"
    got = {r["user_id"]: r["count"] for r in live.replay(spark, path, live.running_counts).collect()}
    e = spark.read.parquet(path)
    want = {r[0]: r[1] for r in e.groupBy("user_id").agg(F.sum(F.when(F.col("event_type") == "click", 1).when(F.col("event_type") == "purchase", 2).otherwise(0))).collect()}
    assert got == want


@pytest.fixture
def shuffled(spark, tmp_path):
    """Events of two users in many files whose order is not that of time, read in small Arrow batches."""
    rng = random.Random(8)
    start = 1_700_000_000_000_000
    times = sorted(rng.sample(range(0, 400 * 86_400, 3_600), 1200))
    rows = [(i, start + t * 1_000_000, 1 if rng.random() < 0.9 else 2, rng.choice(["click", "purchase", "view"])) for i, t in enumerate(times)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "event_id long, us long, user_id long, event_type string").selectExpr("event_id", "timestamp_micros(us) as ts", "user_id", "event_type", "1.0D as value")
    df.repartition(12).write.parquet(f"{tmp_path}/events.parquet")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    yield f"{tmp_path}/events.parquet"
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_stream_counts_of_shuffled_events(spark, shuffled):
    delta = F.when(F.col("event_type") == "click", 1).when(F.col("event_type") == "purchase", 2).otherwise(0)
    want = {tuple(r) for r in spark.read.parquet(shuffled).groupBy("user_id").agg(F.sum(delta), F.max(F.unix_micros("ts"))).collect()}
    assert {tuple(r) for r in live.replay(spark, shuffled, live.running_counts).collect()} == want


def test_stream_counts_over_micro_batches():
    import pandas as pd

    class State:
        exists, get = False, None

        def update(self, x):
            self.exists, self.get = True, x

    state = State()
    for us, delta in (([50, 10], [2, 1]), ([20, 50], [2, 1]), ([5], [1])):
        got = next(live._count((7,), iter([pd.DataFrame({"us": [u], "delta": [d]}) for u, d in zip(us, delta, strict=True)]), state))
    assert got.to_dict("records") == [{"user_id": 7, "count": 1 + 1 + 2 + 1, "last_us": 50}]


def test_stream_sessions_of_shuffled_events(spark, shuffled):
    peaks = spark.read.parquet(shuffled).filter("event_type = 'purchase'").select(F.col("user_id").alias("video"), (F.unix_micros("ts") / 1e6).alias("ts"))
    want = {(r["video"], round(r["start"] * 1e6), round(r["end"] * 1e6), r["n"]) for r in I.peak_sessions(peaks, 86_400.0).collect()}
    got = [tuple(r) for r in live.replay(spark, shuffled, live.sessions).collect()]
    assert len(got) == len(want) > 10 and set(got) == want
