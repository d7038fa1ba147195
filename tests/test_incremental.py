"""A memory under random additions and removals against one that is built from what is left."""

import random

import pytest

from streamloom.operators import memory as M
from streamloom.operators.incremental import Memory, ordered_log

SCHEMA = "video long, chunk long, ts double, caption string"


def caption(rng, v, c):
    a, b, o = rng.randrange(4), rng.randrange(4), rng.randrange(3)
    return (v, c, c * 10.0, f"PEOPLE: P{a} (guest {a}): walks; P{b} (guest {b})\nOBJECTS: O{o} (blue box {o})\nACTIONS: P{a} lifts O{o}; P{b} sits down\nTEXT: menu {rng.randrange(2)}\nEVENT: guest {a} lifts box {o}")


def state(nodes, edges):
    pick = "video", "key", "node_id", "node_type", "text", "n", "n_chunks", "first_seen", "last_seen", "admitted", "hub", "next1", "next2"
    return sorted(map(repr, (tuple(r[c] for c in pick) for r in nodes.collect()))), sorted(tuple(r) for r in edges.select("video", "a", "b", "support").collect())


def rebuilt(spark, rows, cap):
    log = ordered_log(spark.createDataFrame(rows, SCHEMA))
    node = M.nodes(log, cap=cap)
    linked = M.with_hubs(log, node)
    out = node.join(linked.select("video", "node_id", "hub"), ["video", "node_id"], "left").join(M.chains(linked).drop("hub"), ["video", "node_id"], "left")
    return state(out, M.edges(log))


@pytest.mark.parametrize("cap", [300, 9])
def test_changes_equal_a_rebuild(spark, tmp_path, cap):
    rng, have = random.Random(cap), {}
    memory = Memory(spark, f"file://{tmp_path}/m", buckets=8, cap=cap)
    for step in range(4):
        new = {(v, c): caption(rng, v, c) for v, c in {(rng.randrange(5), rng.randrange(12)) for _ in range(14)}}
        gone = rng.sample(sorted(have), len(have) // 3) if step else []
        gone = [k for k in gone if k not in new] + [(99, 1)]
        memory = memory.change(spark.createDataFrame(list(new.values()), SCHEMA), spark.createDataFrame(gone, "video long, chunk long"))
        for k in gone:
            have.pop(k, None)
        have.update(new)
        if step in (1, 3):
            assert state(memory.nodes(), memory.edges()) == rebuilt(spark, list(have.values()), cap)
    memory = memory.change(removed=spark.createDataFrame(sorted(have), "video long, chunk long"))
    assert state(memory.nodes(), memory.edges()) == ([], []) and memory.change() is memory


def test_only_touched_videos_are_written(spark, tmp_path):
    rng = random.Random(1)
    rows = [caption(rng, v, c) for v in range(30) for c in range(3)]
    first = Memory(spark, f"file://{tmp_path}/m", buckets=16).change(spark.createDataFrame(rows, SCHEMA))
    before = state(first.nodes(), first.edges())
    second = first.change(removed=spark.createDataFrame([(7, 1)], "video long, chunk long"))
    for t in second.places:
        assert sum(second.places[t].get(b) != p for b, p in first.places[t].items()) == 1
    assert state(first.nodes(), first.edges()) == before  # the state before can still be read
    assert state(second.nodes(), second.edges()) == rebuilt(spark, [r for r in rows if r[:2] != (7, 1)], 300)
