"""Vector codes by annular norm pruning against a plain search over all entries."""

import collections
import hashlib
import math
import random

import numpy as np

from streamloom.llm import annulus

SCHEMA = "vec_id long, embedding array<double>, label int, code string"


def brute(rows, length):
    kept = [r for r in rows if r[1] is not None and len(r[1]) == length and all(x is not None and math.isfinite(x) for x in r[1])]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    width = -(-length // 16)
    whole = [[math.floor(256 * x) if abs(x) < 1e15 else 256 * int(x) for x in r[1]] for r in kept]
    parts = [[v[p * width : (p + 1) * width] for p in range(16)] for v in whole]
    books = [[list(parts[r][p]) for r in range(min(64, len(kept)))] for p in range(16)]

    def assign():
        out = []
        for v in parts:
            out.append([min((sum((a - b) ** 2 for a, b in zip(v[p], e)), i) for i, e in enumerate(books[p])) for p in range(16)])
        return out

    for _ in range(2):
        found = assign()
        for p in range(16):
            for e in range(len(books[p])):
                own = [parts[r][p] for r in range(len(parts)) if found[r][p][1] == e]
                if own:
                    books[p][e] = [sum(c) // len(own) for c in zip(*own)]
    found = assign()
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    total = collections.Counter()
    for r, f in zip(kept, found):
        total[r[2]] += sum(d for d, _ in f)
    cap = lambda x: min(x, annulus.LONG)
    return collections.Counter((r[0], "".join(f"{i:02x}" for _, i in f), cap(sum(d for d, _ in f)), sha) for r, f in zip(kept, found)), total


def table(n, length, seed, spread=1.0):
    rng = random.Random(seed)
    rows = [(i, [rng.gauss(0, spread) for _ in range(length)], rng.choice([0, 1, 1, 1, None]), "x") for i in range(n)]
    if n > 9:
        rows += [rows[3], rows[3], (3, rows[4][1], 1, "x"), (None, rows[5][1], 2, "x"), (n, None, 1, "x"), (n + 1, [None] * length, 1, "x"), (n + 2, [math.nan] + [0.0] * (length - 1), 1, "x")]
        rows += [(n + 3, [math.inf] + [0.0] * (length - 1), 1, "x"), (n + 4, [0.5] * (length + 1), 1, "x"), (n + 5, [-0.0] * length, 1, "x"), (n + 6, [0.0] * length, 1, "x")]
    return rows


def check(spark, rows, length):
    got = annulus.code_vectors(spark, spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    want, total = brute(rows, length)
    assert collections.Counter((r["vec_id"], r["code"], r["error"], r["codebooks_sha256"]) for r in got) == want
    labels = {r[0]: r[2] for r in rows}
    assert all(r["label_error"] == min(total[labels[r["vec_id"]]], annulus.LONG) for r in got if r["vec_id"] is not None and r["vec_id"] != 3)


def test_like_a_plain_search(spark):
    check(spark, table(150, 64, 1), 64)


def test_ties_few_rows_and_uneven_parts(spark):
    check(spark, table(5, 16, 2), 16)
    check(spark, table(90, 16, 3, 0.004), 16)
    check(spark, table(40, 35, 4), 35)


def test_large_numbers_stay_exact(spark):
    rows = table(70, 32, 5)
    rows += [(500 + i, [x * 10.0**i for x in rows[i][1]], 4, "x") for i in range(12)]
    check(spark, rows, 32)


def test_only_the_annulus_is_measured(monkeypatch):
    rng = np.random.default_rng(6)
    entries, parts = rng.integers(-300, 300, (64, 4)), rng.integers(-300, 300, (2000, 4))
    measured, plain = [0], annulus.Codebook.distance

    def counted(self, p, e):
        measured[0] += len(p)
        return plain(self, p, e)

    monkeypatch.setattr(annulus.Codebook, "distance", counted)
    index, error = annulus.Codebook(entries).nearest(parts)
    every = ((parts[:, None] - entries) ** 2).sum(2)
    assert (index == every.argmin(1)).all() and (error == every.min(1)).all()
    assert measured[0] < 0.75 * every.size
    annulus.Codebook(entries).nearest(entries)
    assert measured[0] < 0.75 * every.size + 64 * 40


def test_nothing_usable(spark):
    assert annulus.code_vectors(spark, spark.createDataFrame([], SCHEMA)).collect() == []
    assert annulus.code_vectors(spark, spark.createDataFrame([(1, None, 1, "x"), (2, [None], 1, "x")], SCHEMA)).collect() == []
