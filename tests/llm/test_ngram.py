"""The Jaccard join of word n-gram sets against all pairs."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from streamloom.llm import dartminhash, ngram

from .test_operators import SCHEMA, corpus


def brute(rows):
    lower = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    sets = []
    for r in rows:
        w = [x for x in __import__("re").split(r"[\x20\x09-\x0D]+", lower(r[1])) if x]
        sets.append({tuple(w[k : k + 4]) for k in range(len(w) - 3)} if len(w) >= 4 else {tuple(w)} if w else set())
    up = {r[0]: r[0] for r in rows}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and rows[i][0] is not None and rows[j][0] is not None and 100 * len(a & b) >= 85 * len(a | b):
                x, y = top(rows[i][0]), top(rows[j][0])
                up[max(x, y)] = min(x, y)
    return sorted(((r[0], len(s), (top(r[0]) if s else r[0]) if r[0] is not None else None) for r, s in zip(rows, sets)), key=repr)


def got(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("clash") for c in ("rep", "keys", "component")})
    return sorted(map(tuple, ngram.join_components(spark, df.repartition(4)).select("doc_id", "n_shingles", "component_id").collect()), key=repr)


def families(n, seed):
    """Families of texts with a few words changed, added or left out each, of all sizes, with a passage in most of them."""
    rng = random.Random(seed)
    words = [f"v{i}" for i in range(3000)]
    passage = [f"p{i}" for i in range(40)]
    rows, at = [], 0
    while at < n:
        base = [rng.choice(words) for _ in range(rng.choice([2, 5, 9, 12, 30, 31, 60, 64, 128, 300]))]
        if rng.random() < 0.6:
            base = base + passage
        for _ in range(rng.choice([1, 2, 3, 8])):
            w = list(base)
            for _ in range(rng.choice([0, 1, 1, 2, 3, max(1, len(base) // 60)])):
                k = rng.randrange(len(w))
                w[k : k + 1] = rng.choice([[], [rng.choice(words)], [w[k], rng.choice(words)], [w[k].upper()]])
            rows.append((at, "\t ".join(w), "en", "s", 1, None, None))
            at += 1
    rng.shuffle(rows)
    return rows


def test_like_all_pairs(spark):
    rows = corpus()
    assert got(spark, rows) == brute(rows)


@pytest.mark.parametrize("chunk", [512, 32])
def test_families(spark, monkeypatch, chunk):
    monkeypatch.setattr(dartminhash, "CHUNK", chunk)
    rows = families(260, chunk)
    assert got(spark, rows) == brute(rows)


def test_two_texts_of_one_document(spark):
    long = [" ".join(f"{c}{i}" for i in range(60)) for c in "abc"]
    rows = [(i, t, "en", "s", 1, None, None) for i, t in [(9, long[0]), (9, long[1]), (4, long[0]), (7, long[1] + " tail"), (12, long[2]), (9, None), (None, long[2])]]
    want = {(9, 57, 4), (4, 57, 4), (7, 58, 4), (12, 57, 12), (9, 0, 9), (None, 57, None)}
    assert set(got(spark, rows)) == want


def test_parts_of_linked_sets_meet():
    """Whatever the counts say, linked sets share a key: random edits at the very threshold."""
    rng = np.random.default_rng(3)
    bits = rng.integers(1, 255, ngram.SLOTS).astype(np.uint8)
    for n in [6, 7, 11, 13, 20, 31, 32, 33, 60, 63, 64, 70, 127, 128, 500, 1100]:
        for _ in range(60):
            a = rng.integers(0, 1 << 63, n, dtype=np.uint64)
            gone, new = rng.integers(0, n // 6 + 1), rng.integers(0, n // 6 + 1)
            b = np.concatenate([a[gone:], rng.integers(0, 1 << 63, new, dtype=np.uint64)])
            if 100 * (n - gone) < ngram.PERCENT * (n + new):
                continue
            values = np.concatenate([np.sort(a), np.sort(b)])
            row = np.repeat([0, 1], [len(a), len(b)])
            keys, at = ngram.part_keys(values, row, np.bincount(row), bits)
            same = len(a) == len(b) and gone == new == 0
            assert same or np.intersect1d(keys[at == 0], keys[at == 1]).size, (n, gone, new)


def test_bitmaps_never_hide_a_link():
    texts = [r[1] for r in families(200, 9)]
    import pyarrow as pa

    tiles = ngram.Tiles(pa.array(texts))
    sets = np.split(tiles.values, tiles.ends[:-1])
    for p, a in enumerate(sets):
        want = [q for q, b in enumerate(sets) if len(a) and len(b) and 100 * len(x := np.intersect1d(a, b)) >= 85 * (len(a) + len(b) - len(x))]
        like, passed = tiles.linked(p)
        assert like.tolist() == want and passed >= len(want)


def test_empty(spark):
    assert got(spark, []) == []
