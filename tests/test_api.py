"""The memory object and scorers, against plain Python."""

import numpy as np
import pytest

from streamloom import api
from streamloom.functions import values as V
from streamloom.models import scorer as models
from streamloom.operators import memory as M
from streamloom.operators import retrieval as S

from .stand_in import HashingScorer

CAPTIONS = [
    (1, 1, 10.0, "PEOPLE: P1 (tall cook with hat)\nOBJECTS: O1 (red pan)\nACTIONS: P1 washes the pan; P1 washes the pan\nEVENT: cook enters kitchen"),
    (1, 2, 20.0, "PEOPLE: P4 (tall cook with hat); P5 (small child)\nACTIONS: P4 cuts bread; P9 sings loudly\nTEXT: exit sign\nSPATIAL: O1 near P5"),
    (1, 3, 30.0, "PEOPLE: P1 (small child); P1 (old man)\nACTIONS: P1 leaves room\nEVENT: child leaves kitchen"),
    (2, 1, 5.0, "PEOPLE: P1 (old man)\nACTIONS: P1 walks away"),
]
ASKED = [(1, 0, "How many times did the cook wash so far?"), (1, 1, "red pan"), (1, 2, "zzz"), (2, 0, "P1 walks away")]


@pytest.fixture(scope="module")
def captions(spark):
    return spark.createDataFrame(CAPTIONS, api.CAPTIONS)


@pytest.fixture(scope="module")
def asked(spark):
    return spark.createDataFrame(ASKED, "video long, qid long, question string")


def rows_of(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


@pytest.mark.parametrize("mode", ["entity_resolved", "flat_caption"])
def test_taking_back_is_never_having_added(spark, captions, mode):
    gone = spark.createDataFrame([(1, 2)], "video long, chunk long")
    one = api.open_memory(spark, factory=HashingScorer, mode=mode).update(captions).remove_chunks(gone)
    two = api.open_memory(spark, factory=HashingScorer, mode=mode).update(captions.join(gone, ["video", "chunk"], "left_anti"))
    if mode == "flat_caption":
        assert rows_of(one.stats(), "video", "total_nodes") == rows_of(two.stats(), "video", "total_nodes") == [(1, 2), (2, 1)]
    else:
        assert rows_of(one.signature(), "video", "signature") == rows_of(two.signature(), "video", "signature")
        assert rows_of(one.signature(), "signature") != rows_of(api.open_memory(spark, factory=HashingScorer, mode=mode).update(captions).signature(), "signature")


def test_entities_are_linked_across_chunks(spark, captions):
    memory = api.open_memory(spark, factory=HashingScorer).update(captions)
    found = {(c, p): (g, m) for c, p, g, m in rows_of(memory.declared.filter("video = 1"), "chunk", "description", "gid", "method")}
    assert found[1, "tall cook with hat"][0] == found[2, "tall cook with hat"][0] and found[2, "tall cook with hat"][1] == "description_similarity"
    assert found[2, "small child"][0] == found[3, "small child"][0] != found[3, "old man"][0]
    texts = {r["text"] for r in memory.log.collect()}
    cook = found[1, "tall cook with hat"][0]
    assert f"{cook} (tall cook with hat) cuts bread" in texts and "[unresolved person reference] sings loudly" in texts
    # P1 is declared for two entities in chunk 3, so a reference to it cannot be resolved.
    assert "[unresolved person reference] leaves room" in texts and "exit sign" in texts
    status, named = memory.provenance()
    assert {(r["chunk"], r["local_id"]) for r in status.filter("ambiguous").collect()} == {(3, "P1")}
    assert {(r["chunk"], r["local_id"]): r["gid"] for r in named.filter("video = 1").collect()}[2, "P4"] == cook
    assert memory.stats().filter("video = 1").first()["unresolved"] == 3


def test_retrieval_modes(spark, captions, asked):
    base = api.open_memory(spark, factory=HashingScorer, mode="hub_spoke", sim_threshold=0.2).update(captions)
    got = {(r["video"], r["qid"]): r for r in base.retrieve(asked).collect()}
    assert got[1, 0]["context"].startswith(V.COUNT_TITLE.strip()) and "'wash'" in got[1, 0]["context"] and "[Most recent events]" in got[1, 0]["context"]
    assert not got[1, 2]["matched"] and got[1, 2]["signal"] == V.NO_MATCH_SIGNAL and got[1, 2]["context"] == ""
    flat = api.open_memory(spark, factory=HashingScorer, mode="flat_caption", sim_threshold=0.1).update(captions)
    texts = {(r["video"], r["qid"]): r for r in flat.retrieve(asked, top_k=1).collect()}
    assert texts[2, 0]["context"] == "[00:05]\n" + CAPTIONS[3][3] and texts[2, 0]["hit_count"] == 1
    prompts = {(r["video"], r["qid"]): r["prompt"] for r in base.prompts(asked).collect()}
    assert prompts[1, 2] == f"{V.NO_MATCH_SIGNAL}\n\nzzz" and prompts[1, 0].endswith(ASKED[0][2])
    assert base.answer(asked).count() == 4 and {r["letter"] for r in base.answer_mcq(asked, top_k="dynamic").collect()} <= set("ABCD")


def test_configuration_is_checked(spark):
    for bad in ({"mode": "other"}, {"sim_threshold": 2}, {"max_nodes": 0}, {"expand": False}, {"prompt_policy": "x"}, {"stride": 0}):
        with pytest.raises(ValueError):
            api.MemoryConfig(**bad)
    assert api.MemoryConfig(mode="hub_spoke", expand=False).expand is False
    assert [S.top_k_argument(x) for x in (None, "5", 0, " Auto ")] == [(12, False), (5, False), (1, False), (12, True)]
    for bad in ("many", 1.5j):
        with pytest.raises((ValueError, TypeError)):
            S.top_k_argument(bad)


def test_scorers(spark):
    rows = spark.createDataFrame([(1, "a b", [1, 2]), (2, "A  b", []), (3, None, None), (4, "c", [5])], "id long, text string, frames array<long>").repartition(2)
    got = {r["id"]: r["vector"] for r in models.embed(rows, "text", HashingScorer).collect()}
    assert got[1] == got[2] and got[3] is None and abs(np.linalg.norm(got[4]) - 1) < 1e-9
    said = {r["id"]: r["response"] for r in models.generate(rows, "text", HashingScorer, "frames").collect()}
    assert said == {1: "a b (2 frames)", 2: "A  b (0 frames)", 3: " (0 frames)", 4: "c (1 frames)"}
    best = {r["id"]: r["letter"] for r in models.choose(rows, "text", HashingScorer, 4).collect()}
    assert best == {1: "D", 2: "A", 3: "A", 4: "B"}


def test_build_and_stream(spark):
    chunks = spark.createDataFrame([(1, k, k * 10.0, k * 10.0 + 10, k * 10.0 + 5, [k]) for k in range(8)], "video long, chunk long, start_time double, end_time double, mid double, frames array<long>")
    memory = api.build_memory_from_chunks(chunks, "EVENT: something here", HashingScorer, api.MemoryConfig(mode="incremental", stride=2, max_chunks=3))
    assert rows_of(memory.captions, "chunk") == [(0,), (2,), (4,)]
    captions = spark.createDataFrame([(1, k, k * 10.0, f"EVENT: event number{k} here") for k in range(8)], api.CAPTIONS)
    questions = spark.createDataFrame([(1, 0, "what happened before now", 45.0), (1, 1, "what happened before now", 80.0)], "video long, qid long, question string, cutoff double")
    got = {r["qid"]: r for r in api.stream_and_answer(chunks, captions, questions, 2, HashingScorer, api.MemoryConfig(mode="incremental", sim_threshold=0.0)).collect()}
    assert set(got) == {0, 1} and got[0]["video"] == 1
    assert "number1" in got[0]["context"] and "number2" not in got[0]["context"] and "number5" in got[1]["context"] and "number6" not in got[1]["context"]
    frames = spark.createDataFrame([(1, 3.0, 7), (1, 4.0, 8)], "video long, ts double, frame_id long")
    asked = spark.createDataFrame([(1, 5.0, "x"), (1, 1.0, "y")], "video long, cutoff double, prompt string")
    out = {r["prompt"]: r for r in api.answer_recent_window(frames, asked, 1.0, 4, HashingScorer).collect()}
    assert out["x"]["frames"] == [7, 8] and out["x"]["error"] is None and out["y"]["error"] and out["y"]["letter"] is None


def test_task_states(spark):
    memory = api.open_memory(spark, factory=HashingScorer).update_task_state(spark.createDataFrame([(1, "k", 1.0, "2"), (1, "k", 3.0, "5")], "video long, key string, ts double, response string"))
    row = memory.task_states().first()
    assert (row["response"], row["n"], row["text"]) == ("5", 2, "STATE k: response=5; delta=None; label=None; cutoff=3.0")
    with pytest.raises(ValueError):
        api.open_memory(spark, factory=HashingScorer).task_states()
    assert M.flat_captions(spark.createDataFrame([], api.CAPTIONS)).count() == 0


def test_a_memory_without_a_scorer_is_not_asked(spark):
    rows = spark.createDataFrame([(1, 1, 1.0, "EVENT: cook enters kitchen")], api.CAPTIONS)
    memory = api.open_memory(spark, mode="incremental").update(rows)
    assert memory.nodes.count() == 1
    with pytest.raises(ValueError):
        memory.answer(spark.createDataFrame([(1, 0, "kitchen")], "video long, qid long, question string"))
