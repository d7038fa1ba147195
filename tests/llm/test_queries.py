"""The registered queries over tables on disk, against brute force written from their contracts."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest

import __spark_entry__ as entry
from streamloom.llm import blocks, dartminhash, hpylm, pii, queries

from .test_operators import corpus


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(21)
    out = [r[:5] for r in corpus()]
    vile = [f"calm{i}x" for i in range(200)]
    out += [(2000 + i, " ".join(rng.choice(vile) for _ in range(30)) + (" vilest slurword" if i % 3 == 0 else ""), "en", "src0", 9) for i in range(240)]
    out += [(3000 + i, f"mail me{i}.x@host.org or 10.0.0.{i} and 4111 1111 1111 1111, +49 (30) 1234567{i}", "de", "src2", 9) for i in range(5)]
    out.append((3100, "start " * 20 + " ".join(f"item{k}" for k in range(25)) + " end" * 20, "fr", "src3", 9))
    return out


@pytest.fixture(scope="module")
def folder(spark, rows, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(2000 + i, i % 2, int(i % 3 == 0)) for i in range(0, 240, 2)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, " ".join(f"item{k}" for k in range(25))), (2, None)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    spark.createDataFrame([(i, f"u{i}", "same" if i % 3 else f"p{i % 5}" * 9) for i in range(30)] + [(90, None, None)], "page_id long, url string, html string").write.parquet(f"{d}/pages.parquet")
    spark.createDataFrame([(i, [((i * 7 + k * 3) % 11 - 5) / 8 for k in range(32)], i % 3) for i in range(90)] + [(91, None, 1)], "vec_id long, embedding array<float>, label int").write.parquet(f"{d}/embeddings.parquet")
    return d


@pytest.fixture(autouse=True)
def small_blocks(monkeypatch):
    monkeypatch.setattr(blocks, "BLOCK_BYTES", 4000)
    monkeypatch.setattr(blocks, "SHARD_BYTES", 40000)
    monkeypatch.setattr(hpylm, "SHARD_BYTES", 40000)


def ask(spark, folder, name):
    return entry.queries()[name](spark, folder).collect()


def test_all_are_registered():
    names = {n for n in entry.queries() if re.match(r"op\d+_", n)}
    assert names == set(queries.QUERIES) and len(names) == len(queries.QUERIES) and "pipeline" in entry.queries()


def test_toxicity(spark, folder, rows):
    got = ask(spark, folder, "op1_toxicity")
    assert len(got) == len(rows)
    assert {r["doc_id"] for r in got if r["rejected"]} == {2000 + i for i in range(0, 240, 3)}


def test_warc(spark, folder):
    pages = [(i, "same" if i % 3 else f"p{i % 5}" * 9) for i in range(30)] + [(90, "")]
    last = {h: max(i for i, x in pages if x == h) for _, h in pages}
    want = {i: (len(h), "response" if last[h] == i else "revisit", None if last[h] == i else last[h]) for i, h in pages}
    assert {r["page_id"]: (r["payload_bytes"], r["record_type"], r["refers_to"]) for r in ask(spark, folder, "op2_warc")} == want


def test_substring(spark, folder, rows):
    words = [(r[0], (r[1] or "").encode().split()) for r in rows]
    seen = collections.Counter(tuple(w[s : s + 35]) for _, w in words for s in range(len(w) - 34))
    want = collections.Counter()
    for i, w in words:
        gone = {k for s in range(len(w) - 34) if seen[tuple(w[s : s + 35])] > 1 for k in range(s, s + 35)}
        want[i, len(w), len(gone), hashlib.sha256(b" ".join(x for k, x in enumerate(w) if k not in gone)).hexdigest()] += 1
    assert collections.Counter((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in ask(spark, folder, "op3_substring")) == want


def test_decontamination(spark, folder, rows):
    got = ask(spark, folder, "op5_decontamination")
    assert len(got) == len(rows) and {(r["doc_id"], r["item_id"], r["score"]) for r in got if r["contaminated"]} == {(3100, 1, 1.0)}


def test_tiff(spark, folder, rows):
    want = collections.Counter()
    for r in rows:
        b = (r[1] or "").encode()
        p = b + bytes(-len(b) % 64 if b else 64)
        want[r[0], len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:])] += 1
    got = ask(spark, folder, "op6_tiff")
    assert collections.Counter((r["doc_id"], r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) for r in got) == want
    same = collections.defaultdict(set)
    for r in got:
        same[r["payload_sha256"]].add((r["media_bytes"], r["media_sha256"], r["feature"]))
    assert all(len(x) == 1 for x in same.values())


def test_language_model(spark, folder, rows):
    tokens = [(r[0], (r[1] or "").encode().lower().split() + [None]) for r in rows if (r[1] or "").isascii()]
    got = {r["doc_id"]: r for r in ask(spark, folder, "op7_lm_scoring")}
    assert len({r["train_tokens"] for r in got.values()}) == 1 and all(math.isfinite(r["score"]) for r in got.values())
    for i, t in tokens:
        r = got[i]
        assert r["n_tokens"] == len(t) and r["held_out"] == hpylm.held_out(i) and r["n_known"] <= r["n_tokens"]


def test_near_duplicates(spark, folder, rows):
    sets = {}
    for i, text in ((r[0], r[1]) for r in rows if r[0] is not None):
        w, seen, own = (text or "").split(), collections.Counter(), set()
        for g in [tuple(w[k : k + 5]) for k in range(len(w) - 4)] if len(w) >= 5 else [tuple(w)] if w else []:
            own.add((g, seen[g]))
            seen[g] += 1
        sets[i] = own
    up = {i: i for i in sets}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in sets:
        for j in sets:
            if j < i and sets[i] and len(sets[i] & sets[j]) >= dartminhash.THRESHOLD * len(sets[i] | sets[j]):
                a, b = top(i), top(j)
                up[max(a, b)] = min(a, b)
    got = ask(spark, folder, "op8_dartminhash")
    assert len(got) == len(rows) and all(r["class_id"] == (None if r["doc_id"] is None else top(r["doc_id"])) for r in got)


def test_suffixes(spark, folder, rows):
    texts = [(r[0], (r[1] or "").encode()) for r in rows]
    first = {}
    for i, b in texts:
        if i is not None:
            for s in range(len(b) - 49):
                first[b[s : s + 50]] = min(first.get(b[s : s + 50], i), i)
    want = collections.Counter()
    for i, b in texts:
        gone = np.zeros(len(b), bool)
        for s in range(len(b) - 49):
            if i is not None and first[b[s : s + 50]] < i:
                gone[s : s + 50] = True
        want[i, len(b), int(gone.sum()), int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum()), hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest()] += 1
    assert collections.Counter((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in ask(spark, folder, "op9_suffix_array")) == want


def test_personal_data(spark, folder, rows):
    got = ask(spark, folder, "op10_pii")
    want = collections.Counter()
    for r in rows:
        text = r[1] or ""
        spans = [(m.start(), m.end(), 0) for m in re.finditer(pii.EMAIL, text)] + [(m.start(), m.end(), 1) for m in re.finditer(pii.IP, text) if all(int(x) <= 255 for x in m[0].split("."))]
        spans += [(m.start(), m.end(), 2) for m in re.finditer(pii.CARD, text) if 12 <= len(x := re.sub("[^0-9]", "", m[0])) <= 19 and pii.luhn(x)]
        spans += [(m.start(), m.end(), 3) for m in re.finditer(pii.PHONE, text) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
        spans.sort(key=lambda s: (s[0], s[2]))
        listed = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, b, k in spans)
        want[r[0], *(sum(s[2] == k for s in spans) for k in range(4)), hashlib.sha256(listed.encode()).hexdigest()] += 1
    assert collections.Counter((r["doc_id"], r["n_email"], r["n_ip"], r["n_card"], r["n_phone"], r["base_sha256"]) for r in got) == want


@pytest.mark.parametrize("name", [n for n in queries.QUERIES if n != "op2_warc"] + ["pipeline"])
def test_empty_tables(spark, folder, tmp_path, name):
    for t in ("documents", "labels", "benchmark", "embeddings"):
        spark.read.parquet(f"{folder}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    assert ask(spark, str(tmp_path), name) == []


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_matches_sql(spark, name):
    import duckdb

    data, con = "/root/testdata/sf0.001", duckdb.connect()
    for t in ("documents", "pages", "embeddings"):
        con.execute(f"create view {t} as select * from '{data}/{t}.parquet'")
    found = con.execute(queries.ORACLE_SQL[name])
    columns = [c[0] for c in found.description]
    want = collections.Counter(map(repr, found.fetchall()))
    got = entry.queries()[name](spark, data).select(*columns).collect()
    assert collections.Counter(repr(tuple(r)) for r in got) == want
