"""The Merkle manifest against plain lists."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from streamloom.llm import merkle

from .test_operators import SCHEMA, corpus


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(r, text):
    values = [r[0], r[3], r[2], r[4], text]
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def climb(level, at):
    """Root over level and the steps from place at to it."""
    steps = []
    while len(level) > 1:
        runs = [level[i : i + 3] for i in range(0, len(level), 3)]
        run, k = runs[at // 3], at % 3
        steps.append(("".join(run[:k]), "".join(run[k + 1 :])))
        level, at = [sha("".join(r)) for r in runs], at // 3
    return level[0], steps


def brute(rows):
    trees = {}
    for r in rows:
        trees.setdefault(r[3], []).append((r[0] is not None, r[0] or 0, leaf(r, r[1]), r))
    order = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    for t in trees.values():
        t.sort(key=lambda x: x[:3])
    roots = [climb([x[2] for x in trees[s]], 0)[0] for s in order]
    out = []
    for k, s in enumerate(order):
        for i, (_, _, h, r) in enumerate(trees[s]):
            own, steps = climb([x[2] for x in trees[s]], i)
            root, more = climb(roots, k)
            at = h
            if r[0] is not None and r[1] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0:
                at = leaf(r, r[1].replace("\n", ""))
            for a, b in steps + more:
                at = sha(a + at + b)
            out.append((r[0], h, own, root, sha("".join(a + b for a, b in steps + more)), at, at == root))
    return sorted(out, key=repr)


def rows_of(df):
    return sorted((tuple(r[c] for c in ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")) for r in df.collect()), key=repr)


def test_like_plain_lists(spark):
    rows = corpus()
    rows += [(900 + i, f"line\n{i}\n", "en", "big", i, None, None) for i in range(250)] + [(900, "other text of one id", "en", "big", 1, None, None), (5, "x", "en", "", 1, None, None), (6, "é\n", "en", "é", 1, None, None)]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("clash") for c in ("tree", "idx", "n", "hash", "item", "part")})
    got = rows_of(merkle.verify_documents(spark, df.repartition(5)))
    assert got == brute(rows)
    assert any(not r[-1] for r in got) and any(r[-1] for r in got)


@pytest.mark.parametrize("n", [1, 2, 3, 4, 9, 10, 28])
def test_sizes_of_one_tree(spark, n):
    rows = [(i, f"a\n{i}", "en", None if n == 4 else "s", i, None, None) for i in range(n)]
    assert rows_of(merkle.verify_documents(spark, spark.createDataFrame(rows, SCHEMA))) == brute(rows)


def test_empty(spark):
    assert merkle.verify_documents(spark, spark.createDataFrame([], SCHEMA)).collect() == []


def test_proofs_are_whole_and_any_change_shows(spark):
    rows = [(i, f"text {i}", "en", f"s{i % 2}", i, None, None) for i in range(20)]
    found = merkle.manifest(spark, spark.createDataFrame(rows, SCHEMA), merkle.DOCUMENT, "source", "doc_id", other=F.sha2(F.col("text"), 256))
    got = found.select("*", merkle.fold(F.col("leaf"), F.col("steps")).alias("good"), merkle.fold(F.col("other"), F.col("steps")).alias("bad")).collect()
    assert len(got) == 20 and all(r["good"] == r["roots"][-1] != r["bad"] for r in got)
