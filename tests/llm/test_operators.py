"""Corpus operators against brute force on small documents with hard cases: nulls, empty, long, tied and repeated rows."""

import base64
import collections
import functools
import hashlib
import math
import random
import re
import time
import zlib

import numpy as np
import pytest

from streamloom.llm import blocks, dartminhash, decontam, hpylm, mixing, pii, substring, suffix, tiff, toxicity, warc

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, domain string, score double"


def corpus(n=60, seed=5):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    passage = " ".join(rng.choice(vocabulary) for _ in range(60))
    rows = []
    for i in range(n):
        words = [rng.choice(vocabulary) for _ in range(rng.choice([0, 3, 20, 80, 200]))]
        text = " ".join(words)
        if i % 7 == 0:
            text = text + "\n" + passage + "  " + text[:40]
        if i % 11 == 0 and rows:
            text = rows[-1][1] or ""
        if i % 13 == 0 and words:
            text = " ".join([*words[:-1], "édité"])
        rows.append((i, text, "en", f"src{i % 4}", len(text), "own", 0.5))
    base = [rng.choice(vocabulary) for _ in range(100)]
    for k in range(6):
        w = list(base)
        if k:
            w[k * 15] = "changed"
        rows.append((n + k, " ".join(w), "en", "src1", 1, None, None))
    rows += [(n + 10, None, None, None, None, None, None), (n + 11, "", "fr", "src1", 0, "x", 1.0), (n + 12, "   \t ", "fr", "src2", 4, "x", 1.0), (n + 13, "word " * 30000, "de", "src9", 150000, "x", 1.0), (None, "no id at all", "en", "src0", 12, "x", 1.0)]
    return rows + [rows[3], rows[3]]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(autouse=True)
def small_blocks(monkeypatch):
    monkeypatch.setattr(blocks, "BLOCK_BYTES", 2000)
    monkeypatch.setattr(hpylm, "SHARD_BYTES", 20000)
    monkeypatch.setattr(substring, "INDEX_WORDS", 3000)
    monkeypatch.setattr(blocks, "SHARD_BYTES", 20000)


def test_substring(spark, docs, empty):
    got = collections.Counter((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substring.remove_repeats(spark, docs).collect())
    words = [(r[0], (r[1] or "").encode().split()) for r in corpus()]
    seen = collections.Counter(tuple(w[s : s + 35]) for _, w in words for s in range(len(w) - 34))
    want = collections.Counter()
    for i, w in words:
        gone = set()
        for s in range(len(w) - 34):
            if seen[tuple(w[s : s + 35])] > 1:
                gone.update(range(s, s + 35))
        kept = b" ".join(x for k, x in enumerate(w) if k not in gone)
        want[i, len(w), len(gone), hashlib.sha256(kept).hexdigest()] += 1
    assert got == want
    assert substring.remove_repeats(spark, empty).count() == 0


def brute_words(texts):
    seen = collections.Counter(tuple(w[s : s + 35]) for w in texts for s in range(len(w) - 34))
    return [len({k for s in range(len(w) - 34) if seen[tuple(w[s : s + 35])] > 1 for k in range(s, s + 35)}) for w in texts]


def test_substring_compares_words_exactly(spark):
    # The hashes of both words agree in 32 bits.
    base = [f"q{i}" for i in range(35)]
    texts = [base[:17] + [w] + base[18:] for w in ("tok95941", "tok304400")]
    rows = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(texts)], "doc_id long, text string")
    assert {r["n_removed"] for r in substring.remove_repeats(spark, rows).collect()} == {0}


@pytest.mark.parametrize("phrase", [10, 20, 34])
def test_a_common_phrase_in_many_surroundings(spark, phrase):
    rng = random.Random(phrase)
    common = [f"c{i}" for i in range(phrase)]
    around = [[f"v{rng.randrange(9)}" for _ in range(30)] for _ in range(6)]
    texts = [rng.choice(around)[-rng.randrange(1, 31) :] + common + rng.choice(around)[: rng.randrange(1, 31)] for _ in range(150)]
    rows = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(texts)], "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r["n_removed"] for r in substring.remove_repeats(spark, rows).collect()}
    want = brute_words(texts)
    assert [got[i] for i in range(len(texts))] == want and 0 < sum(want) < sum(map(len, texts))
    raw = [" ".join(w).encode() for w in texts]
    first = {}
    for i, b in enumerate(raw):
        for s in range(len(b) - 49):
            first.setdefault(b[s : s + 50], i)
    gone = [len({k for s in range(len(b) - 49) if first[b[s : s + 50]] < i for k in range(s, s + 50)}) for i, b in enumerate(raw)]
    got = {r["doc_id"]: r["n_removed"] for r in suffix.remove_repeats(spark, rows).collect()}
    assert [got[i] for i in range(len(texts))] == gone


def test_suffix(spark, docs, empty):
    got = collections.Counter((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffix.remove_repeats(spark, docs).collect())
    texts = [(r[0], (r[1] or "").encode()) for r in corpus()]
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
        spans = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
        want[i, len(b), int(gone.sum()), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()] += 1
    assert got == want
    assert suffix.remove_repeats(spark, empty).count() == 0


def test_merge_is_a_sort():
    rng = random.Random(2)
    runs = [sorted({bytes(rng.choice(b"ab") for _ in range(8)) for _ in range(30)}) for _ in range(7)]
    coded = [suffix.front_code(np.frombuffer(b"".join(x), np.uint8).reshape(-1, 8)) for x in runs]
    last, got, next_of = b"", [], [iter(x) for x in runs]
    for k, shared, r in suffix.merge(coded, 8):
        assert k == next(next_of[r]) and shared == suffix.common_prefix(last, k, 0)
        last = k
        got.append(k)
    assert got == sorted(k for x in runs for k in x)
    assert list(suffix.merge(coded[:1], 8)) and not list(suffix.merge([], 8))


def test_fm_index_counts():
    rng = np.random.default_rng(0)
    parts = [rng.integers(0, 9, 20) for _ in range(12)]
    index = substring.FMIndex(parts)
    for p in (parts[0][3:6], parts[4][:2], parts[7][10:11]):
        low, high = np.zeros(1, np.int64), np.array([index.n])
        for x in p[::-1]:
            low, high = index.extend(np.array([np.searchsorted(index.known, x) + 1]), low, high)
        assert high - low == sum((q[s : s + len(p)] == p).all() for q in parts for s in range(20 - len(p) + 1))


def test_components(spark):
    from streamloom.llm.common import components

    rng = random.Random(1)
    edges = [(k, k + 1) for k in range(100, 160)] + [(5, k) for k in range(200, 260)] + [(rng.randrange(300, 400), rng.randrange(300, 400)) for _ in range(60)] + [(7, 7)]
    up = {}

    def top(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        if a != b:
            a, b = top(a), top(b)
            up[max(a, b)] = min(a, b)
    got = {r["node"]: r["component"] for r in components(spark, spark.createDataFrame(edges, "a long, b long").repartition(3)).collect()}
    assert got == {x: top(x) for x in list(up)}
    assert components(spark, spark.createDataFrame([], "a long, b long")).count() == 0


def test_near_duplicates(spark, docs, empty):
    def shingles(t):
        # The k-th occurrence of a shingle is an element of its own: weighted similarity.
        w, seen = (t or "").split(), collections.Counter()
        out = set()
        for g in [tuple(w[i : i + 5]) for i in range(len(w) - 4)] if len(w) >= 5 else [tuple(w)] if w else []:
            out.add((g, seen[g]))
            seen[g] += 1
        return out

    sets = {r[0]: shingles(r[1]) for r in corpus() if r[0] is not None}
    up = {i: i for i in sets}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in sets:
        for j in sets:
            if j < i and sets[i] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = top(i), top(j)
                up[max(a, b)] = min(a, b)
    got = [(r["doc_id"], r["class_id"]) for r in dartminhash.classes(spark, docs).collect()]
    assert len(got) == len(corpus())
    assert all(c == (None if i is None else top(i)) for i, c in got)
    assert dartminhash.classes(spark, empty).count() == 0
    kept = {r["doc_id"] for r in dartminhash.drop_near_duplicates(spark, docs).collect()}
    assert kept == {top(i) for i in sets} | {None}


def test_near_duplicates_in_large_groups(spark, monkeypatch):
    monkeypatch.setattr(dartminhash, "CHUNK", 8)
    monkeypatch.setattr(dartminhash, "WITNESSES", 2)
    rng = random.Random(3)
    word = [f"w{i}" for i in range(500)]
    base = [rng.choice(word) for _ in range(150)]
    texts = []
    for _ in range(4):  # chains, so that links are few and ends far apart
        w = list(base)
        for at in rng.sample(range(150), 12):
            w[at] = rng.choice(word)
        for _ in range(30):
            w[rng.randrange(150)] = rng.choice(word)
            texts.append(" ".join(w))
    rng.shuffle(texts)
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (t.split() for t in texts)]
    top = list(range(len(sets)))
    for i in range(len(sets)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = top[i], top[j]
                top = [min(a, b) if t in (a, b) else t for t in top]
    assert 1 < len(set(top)) < len(top) / 2
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    assert {r["doc_id"]: r["class_id"] for r in dartminhash.classes(spark, docs).collect()} == dict(enumerate(top))


@pytest.mark.parametrize("size", [200, 900])
def test_no_link_is_lost_on_either_side_of_a_full_bucket(spark, size):
    # Buckets of up to CHUNK documents go by leaders, larger ones are stars; pairs of 0.8 and more are all in one class.
    rng = random.Random(size)
    word = [f"w{i}" for i in range(300)]
    base = [rng.choice(word) for _ in range(60)]
    texts = []
    for i in range(size):
        w = list(base)
        for at in rng.sample(range(60), rng.choice([0, 1, 1, 2, 3])):
            w[at] = f"x{rng.randrange(10**6)}"
        texts.append(" ".join(w))
    texts += [" ".join(rng.choice(word) for _ in range(60)) for _ in range(20)]
    sets = [frozenset(zip(*(w[k:] for k in range(5)))) for w in map(str.split, texts)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    label = {r["doc_id"]: r["class_id"] for r in dartminhash.classes(spark, docs).collect()}
    pairs = [(i, j) for i in range(len(sets)) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    assert len(pairs) > 1000
    found = sum(label[i] == label[j] for i, j in pairs) / len(pairs)
    assert found >= 0.999
    assert all(label[size + k] == size + k for k in range(20))


def test_signatures_estimate_weighted_jaccard():
    rng = np.random.default_rng(1)
    base = rng.integers(1, 1 << 62, 300).astype(np.uint64)
    other = base.copy()
    other[:60] = rng.integers(1, 1 << 62, 60).astype(np.uint64)
    found, has = dartminhash.signatures(np.concatenate([base, other]), np.repeat([0, 1], 300), 2, k=120)
    assert has.all() and abs((found[0] == found[1]).mean() - 240 / 360) < 0.15
    many = np.concatenate([base, base[:100], base])
    found, _ = dartminhash.signatures(many, np.repeat([0, 1], [400, 300]), 2, k=120, weighted=True)
    assert abs((found[0] == found[1]).mean() - 300 / 400) < 0.15


def test_tiff_codecs():
    rng = np.random.default_rng(0)
    pages = [np.repeat(rng.integers(0, 9, (37, 40)), 2, 1).astype(np.uint8)[:, :70], rng.integers(0, 256, (50, 33, 3)).astype(np.uint8)]
    for code in (tiff.NONE, tiff.LZW, tiff.DEFLATE, tiff.PACKBITS):
        for predictor in (1, 2):
            for tile in (None, (16, 32)):
                for order in "<>":
                    got = [x for _, x, _ in tiff.decode_tiff(tiff.encode_tiff(pages, code, predictor, tile, 8, order))]
                    assert (got[0][:, :, 0] == pages[0]).all() and (got[1] == pages[1]).all()
    long = bytes(rng.integers(0, 4, 20000).astype(np.uint8))
    assert tiff.lzw_decode(tiff.lzw_encode(long)) == long and tiff.packbits_decode(tiff.packbits_encode(long)) == long


def test_tiff_planes_fill_order_and_what_is_not_known():
    rng = np.random.default_rng(3)
    image = rng.integers(0, 256, (5, 7, 3)).astype(np.uint8)
    planes = [image[:, :, k].tobytes() for k in range(3)]
    tags = {256: (7,), 257: (5,), 277: (3,), 284: (2,), 273: (0, 35, 70), 279: (35, 35, 35)}
    assert (tiff.read_image(b"".join(planes), tags) == image).all()
    turned = bytes(int(f"{b:08b}"[::-1], 2) for b in b"".join(planes))
    assert (tiff.read_image(turned, tags | {266: (2,)}) == image).all()
    for bad in ({317: (3,)}, {266: (3,)}, {284: (3,)}, {258: (16,)}, {259: (7,)}, {273: (0,), 279: (35,)}):
        with pytest.raises(ValueError):
            tiff.read_image(b"".join(planes), tags | bad)


def test_tiff_of_several_pages_and_clashing_names(spark):
    long = "".join(chr(97 + k * k % 23) for k in range(600_000))
    docs = spark.createDataFrame([(1, long), (2, "short"), (3, long), (None, None)], "doc_id long, text string").coalesce(1)
    got = {r["doc_id"]: r for r in tiff.digest_media(tiff.encode_documents(docs)).collect()}
    blob = {i: tiff.store(tiff.payload_of((t or "").encode())) for i, t in ((1, long), (2, "short"), (None, ""))}
    for i, b in blob.items():
        assert (got[i]["media_bytes"], got[i]["media_sha256"]) == (len(b), hashlib.sha256(b).hexdigest())
    assert got[1]["feature"].startswith("pages=3;rows=9375;") and got[1][2:] == got[3][2:]
    assert got[2]["feature"] == f"pages=1;rows=1;mean={sum(b'short') * 1000 // 64};max={max(b'short')}"
    pages = tiff.read_pages(spark.createDataFrame([(5, "own", blob[1])], "page int, error string, media binary"))
    assert pages.columns[:2] == ["input_page", "input_error"] and [(r["input_page"], r["page"], r["input_error"], r["error"]) for r in pages.collect()] == [(5, k, "own", None) for k in range(3)]


def test_tiff_documents(spark, docs, empty):
    got = collections.Counter(tuple(r)[:5] for r in tiff.digest_media(tiff.encode_documents(docs)).collect())
    want = collections.Counter()
    for r in corpus():
        b = (r[1] or "").encode()
        p = b + bytes(-len(b) % 64 if b else 64)
        want[r[0], len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:])] += 1
    assert got == want
    media = spark.createDataFrame([(1, tiff.encode_tiff([np.zeros((3, 4), np.uint8)] * 2)), (2, b"II*\0broken"), (3, None)], "id long, media binary")
    assert sorted((r["id"], r["page"], r["error"] is None) for r in tiff.read_pages(media).collect()) == [(1, 0, True), (1, 1, True), (2, -1, False)]
    assert tiff.digest_media(tiff.encode_documents(empty)).count() == 0


def test_warc(spark):
    rng = random.Random(1)
    pages = [(i, f"http://x/{i}", rng.choice(["", "<p>same</p>", "".join(rng.choice("abc<é") for _ in range(rng.randrange(3000)))])) for i in range(80)] + [(500, None, None), (501, "u", "long " * 60000)]
    last = {}
    for i, _, h in pages:
        last[h or ""] = max(last.get(h or "", -1), i)
    want = sorted((i, len((h or "").encode()), base64.b32encode(hashlib.sha1((h or "").encode()).digest()).decode(), "response" if last[h or ""] == i else "revisit", None if last[h or ""] == i else last[h or ""]) for i, _, h in pages)
    df = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(2)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        got = [tuple(r) for r in warc.round_trip(spark, df).collect()]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert sorted(got, key=lambda r: r[0]) == want
    assert warc.round_trip(spark, df.limit(0)).count() == 0


def test_warc_false_magic(spark, tmp_path):
    """Stored (uncompressed) payloads full of the magic: candidates that are no members are glued, also over range borders."""
    raw = b""
    for i in range(30):
        payload = warc.MAGIC * 40 + b"%d" % i
        block = b"HTTP/1.1 200 OK\r\n\r\n" + payload
        coder = zlib.compressobj(0, zlib.DEFLATED, 31)
        head = f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:x-page:{i}>\r\nContent-Length: {len(block)}\r\n\r\n".encode()
        raw += coder.compress(head + block + b"\r\n\r\n") + coder.flush()
    (tmp_path / "a.warc").write_bytes(raw)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300")
    try:
        got = sorted((r["record_id"], bytes(r["payload"])) for r in warc.read_archives(spark, str(tmp_path)).collect())
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == sorted((f"<urn:x-page:{i}>", warc.MAGIC * 40 + b"%d" % i) for i in range(30))


def test_warc_named_gz_and_broken_lengths(spark, tmp_path):
    import gzip

    body = b"see WARC/1.0 and WARC/1.1 " * 3
    raw = b"".join(warc.member(i, f"http://x/{i}", body + b"%d" % i, None) for i in range(20))
    (tmp_path / "a.warc.gz").write_bytes(raw)
    (tmp_path / "b.warc").write_bytes(warc.member(50, None, b"plain", None))
    lying = b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:x-page:60>\r\nContent-Length: 39\r\n\r\nHTTP/1.1 200 OK\r\nContent-Length: 99\r\n\r\nabc"
    assert len(lying.partition(b"\r\n\r\n")[2]) == 42
    (tmp_path / "c.warc").write_bytes(gzip.compress(lying.replace(b"Length: 39", b"Length: 42") + b"\r\n\r\n"))
    got = {r["record_id"]: (r["payload_bytes"], bytes(r["payload"])) for r in warc.read_archives(spark, str(tmp_path)).collect()}
    want = {f"<urn:x-page:{i}>": (len(body) + len(str(i)), body + b"%d" % i) for i in range(20)}
    assert got == want | {"<urn:x-page:50>": (5, b"plain"), "<urn:x-page:60>": (3, b"abc")}


@pytest.mark.parametrize("share", [warc.SHARE, 3])
def test_warc_of_repeated_rows_and_null_ids(spark, monkeypatch, share):
    monkeypatch.setattr(warc, "SHARE", share)
    rows = [(i % 12, f"u{i}", "same" if i % 2 else f"own{i % 6}") for i in range(40)] + [(None, None, "same"), (None, "u", None), (7, None, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    path = warc.write_archives(spark, pages, share=share)
    got = collections.Counter((r["record_id"], r["record_type"], r["refers_to"], r["payload_bytes"]) for r in warc.read_archives(spark, path).collect())
    last = {}
    for i, _, h in rows:
        last[h or ""] = max(last.get(h or "", -1), -1 if i is None else i)
    name = lambda i: f"<urn:x-page:{'null' if i is None else i}>"
    want = collections.Counter()
    for i, _, h in rows:
        top = last[h or ""]
        want[(name(i), "response", None, len(h or "")) if i == top else (name(i), "revisit", name(top), len(h or ""))] += 1
    assert got == want


def test_language_model(spark, docs, empty):
    got = hpylm.score_documents(spark, docs).collect()
    low = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
    tokens = [(r[0], (r[1] or "").encode().translate(low).split() + [None]) for r in corpus()]
    held = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 7 == 2
    c = collections.Counter(w for i, t in tokens if not held(i) for w in t)
    n, v = sum(c.values()), len(c)
    want = collections.Counter((i, held(i), len(t), sum(c[w] > 0 for w in t), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in t), 4)) for i, t in tokens)
    assert collections.Counter((*tuple(r)[:5], round(r["base_score"], 4)) for r in got) == want
    assert all(r["score"] <= 0 and math.isfinite(r["score"]) for r in got)
    assert sum(r["score"] for r in got) > sum(r["base_score"] for r in got)
    assert hpylm.score_documents(spark, empty).count() == 0


@functools.lru_cache
def ways_of(n, discount):
    ways = np.full(n + 1, -np.inf)  # logarithms, of t tables: each new customer opens one or joins one
    ways[1] = 0.0
    for c in range(1, n):
        t = np.arange(1, min(n, c + 1) + 1)
        with np.errstate(divide="ignore"):
            ways[t] = np.logaddexp(ways[t - 1], np.log((c - discount * t).clip(0)) + ways[t])
    return ways


def chances(n, weight, discount):
    """Of 1, 2, ... tables of a dish, by plain recursion over its customers."""
    chance = ways_of(n, discount)[1:] + math.log(weight) * np.arange(n)
    chance = np.exp(chance - chance.max())
    return chance / chance.sum()


@pytest.mark.parametrize("n", [2, 40, 64, 200, 900, 1024, 1025, 3000, 8000])
@pytest.mark.parametrize("discount", [hpylm.DISCOUNT, hpylm.ROOT_DISCOUNT])
def test_seating_draws_the_tables_of_the_exact_distribution(n, discount):
    """One sweep, from few or many tables before: mean and variance of a dish of any size."""
    for weight in (0.05, 3.0, 30.0, 100.0, 1000.0):
        chance, t = chances(n, weight, discount), np.arange(1, n + 1)
        mean = chance @ t
        variance = chance @ (t - mean) ** 2
        for start in (1, n):
            s = hpylm.Seating(np.full(4000, n), np.full(4000, start), np.random.default_rng(1), discount)
            s.sweep(np.full(4000, weight))
            noise = 4 * math.sqrt(variance / 4000)
            assert abs(s.tables.mean() - mean) < 0.015 * mean + noise
            assert s.tables.var() == pytest.approx(variance, rel=0.15, abs=0.05)
        m, v = s.moments(np.full(4000, weight))
        assert m == pytest.approx(mean, rel=0.015) and v == pytest.approx(variance, rel=0.05, abs=1e-6)


def test_seating_is_kept_for_other_counts():
    rng = np.random.default_rng(0)
    count = rng.integers(0, 130, 150)
    s = hpylm.Seating(count, np.minimum(count, 4), rng, 0.75)
    for _ in range(4):
        count = np.maximum(0, count + rng.integers(-15, 16, 150))
        s.resize(count)
        s.sweep(np.full(150, 2.0))
        assert ((s.tables >= np.minimum(count, 1)) & (s.tables <= count)).all()


def zipf(words, contexts, tokens, seed):
    rng = np.random.default_rng(seed)
    share = 1 / np.arange(1, words + 1) ** 1.05
    share /= share.sum()
    pair = rng.choice(words, tokens, p=share) * contexts + rng.choice(words, tokens, p=share) * 7919 % contexts
    key, count = np.unique(pair, return_counts=True)
    word, context = key // contexts, key % contexts
    return word, context, count.astype(np.int64), np.bincount(context, count, contexts).astype(np.int64)


def test_seats_settle_from_far_starts(monkeypatch):
    """From one table a pair and from one a customer, in the sweeps the query does, as after many more sweeps."""
    word, context, count, customers = zipf(4000, 64, 200_000, 5)
    ask = lambda start: hpylm.seat(word, context, count, 4000, customers, 1, 1, start)
    got = [ask(start) for start in (None, np.minimum(count, 1), count)]
    monkeypatch.setattr(hpylm, "BURN_IN", 150)
    got.append(ask(None))
    for part in (lambda x: x[0].sum(1).mean(), lambda x: x[2].sum(1).mean(), lambda x: x[1][:, :10].sum(1).mean()):
        first, *others = map(part, got)
        assert others == pytest.approx([first] * 3, rel=0.05)


def plain_gibbs(word, context, sweeps, burn, seed):
    """Mean probability of each (context, word) by customers that leave and come one by one; tables hold their customers, and each is a customer of the root."""
    rng = random.Random(seed)
    d, a, e, b = hpylm.DISCOUNT, hpylm.STRENGTH, hpylm.ROOT_DISCOUNT, hpylm.ROOT_STRENGTH
    distinct = len(set(word))
    seats, root = collections.defaultdict(list), collections.defaultdict(list)
    customers, tables, total = collections.Counter(), collections.Counter(), [0, 0]

    def parent(w):
        return (sum(root[w]) - e * len(root[w]) + (b + e * total[1]) / (distinct + 1)) / (b + total[0])

    def sit(at, new, discount):
        k = rng.choices(range(len(at) + 1), [x - discount for x in at] + [new])[0]
        if k == len(at):
            at.append(0)
        at[k] += 1
        return at[k] == 1

    def leave(at):
        k = rng.choices(range(len(at)), at)[0]
        at[k] -= 1
        return at[k] == 0 and (at.pop(k), True)[1]

    mean = collections.Counter()
    for sweep in range(sweeps):
        for w, u in zip(word, context, strict=True):
            if sweep:
                customers[u] -= 1
                if leave(seats[w, u]):
                    tables[u] -= 1
                    total[0] -= 1
                    total[1] -= leave(root[w])
            if sit(seats[w, u], (a + d * tables[u]) * parent(w), d):
                tables[u] += 1
                total[0] += 1
                total[1] += sit(root[w], (b + e * total[1]) / (distinct + 1), e)
            customers[u] += 1
        if sweep >= burn:
            for w in set(word):
                p = parent(w)
                for u in set(context):
                    at = seats[w, u]
                    mean[u, w] += (sum(at) - d * len(at) + (a + d * tables[u]) * p) / (a + customers[u]) / (sweeps - burn)
    return mean


def test_scores_of_a_plain_gibbs_sampler(monkeypatch):
    rng = np.random.default_rng(2)
    share = 1 / np.arange(1, 31)
    word, context = rng.choice(30, 1500, p=share / share.sum()), rng.integers(0, 6, 1500)
    word = np.unique(word, return_inverse=True)[1]
    want = plain_gibbs(word.tolist(), context.tolist(), 200, 50, 3)
    v = int(word.max()) + 1
    key, count = np.unique(word * 6 + context, return_counts=True)
    customers = np.bincount(context, minlength=6)
    monkeypatch.setattr(hpylm, "SAMPLES", 60)
    tables, guests, root = hpylm.seat(key // 6, key % 6, count.astype(np.int64), v, customers, 1, 1)
    mean = np.zeros((6, v))
    for s in range(60):
        grid, seats = np.zeros((v, 6)), np.zeros((v, 6))
        grid[key // 6, key % 6], seats[key // 6, key % 6] = count, tables[s]
        p = hpylm.root_probability(guests[s], root[s], guests[s].sum(), root[s].sum(), v)
        for u in range(6):
            mean[u] += hpylm.probability(grid[:, u], seats[:, u], customers[u], seats[:, u].sum(), p) / 60
    ours = sum(math.log10(mean[u, w]) for w, u in zip(word, context, strict=True))
    plain = sum(math.log10(want[u, w]) for w, u in zip(word.tolist(), context.tolist(), strict=True))
    assert ours == pytest.approx(plain, rel=0.01)
    assert all(mean[u, w] == pytest.approx(p, rel=0.15) for (u, w), p in want.items())


def test_language_model_is_a_distribution():
    """The probabilities of all words and of an unknown one after a context sum up to 1 in each sample, and a word seen there is likelier than in the root."""
    rng = np.random.default_rng(3)
    words, contexts = 40, 4
    grid = rng.poisson(1.5, (words, contexts)) * (rng.random((words, contexts)) < 0.5)
    grid[:3] += 200
    word, context = np.nonzero(grid)
    count = grid[word, context].astype(np.int64)
    tables, guests, root = hpylm.seat(word, context, count, words, grid.sum(0), 1, 7)
    distinct = int((grid.sum(1) > 0).sum())
    for s in range(hpylm.SAMPLES):
        seats = np.zeros((words, contexts))
        seats[word, context] = tables[s]
        assert (guests[s] == seats.sum(1)).all() and (tables[s] <= count).all() and (tables[s] >= 1).all()
        parent = hpylm.root_probability(guests[s], root[s], guests[s].sum(), root[s].sum(), distinct)
        unknown = hpylm.root_probability(0, 0, guests[s].sum(), root[s].sum(), distinct)
        assert parent[grid.sum(1) > 0].sum() + unknown == pytest.approx(1)
        for u in range(contexts):
            own = hpylm.probability(grid[:, u], seats[:, u], grid[:, u].sum(), seats[:, u].sum(), parent)
            rest = hpylm.probability(0, 0, grid[:, u].sum(), seats[:, u].sum(), unknown)
            assert own[grid.sum(1) > 0].sum() + rest == pytest.approx(1)


def test_perplexity(spark):
    rows = spark.createDataFrame([(True, 2, -2.0), (True, 2, -4.0), (False, 1, -1.0)], "held_out boolean, n_tokens long, score double")
    assert {r["held_out"]: round(r["perplexity"], 6) for r in hpylm.perplexity(rows).collect()} == {True: round(10**1.5, 6), False: 10.0}


def test_decontamination(spark, docs, empty):
    rng = random.Random(9)
    item = " ".join(f"b{rng.randrange(10**6)}" for _ in range(30))
    w = item.split()
    edited = " ".join(x if k % 6 else "swap" for k, x in enumerate(w))
    extra = [(900, "start " * 50 + item + " end", None, None, None, None, None), (901, "Before, " + edited.upper() + "!", None, None, None, None, None), (902, " ".join(w[:6]), None, None, None, None, None)]
    benchmark = spark.createDataFrame([(1, item), (2, None), (3, "two words"), (4, item)], "item_id long, text string")
    both = docs.unionByName(spark.createDataFrame(extra, SCHEMA))
    got = {r["doc_id"]: r["item_id"] for r in decontam.detect(spark, both.drop("score"), benchmark).filter("contaminated").collect()}
    assert got == {900: 1, 901: 1}
    kept = decontam.decontaminate(spark, both, benchmark)
    assert kept.columns == both.columns and kept.count() == both.count() - 2
    assert decontam.detect(spark, empty, benchmark).count() == 0


@pytest.mark.parametrize("block", [decontam.BLOCK, 7])
def test_decontamination_against_plain_alignment(spark, monkeypatch, block):
    monkeypatch.setattr(decontam, "BLOCK", block)
    rng = random.Random(12)
    items = [[f"i{rng.randrange(300)}" for _ in range(rng.randrange(6, 40))] for _ in range(30)]
    texts = []
    for k in range(90):
        w = list(items[k % 30])
        for _ in range(rng.randrange(0, 1 + len(w) // 2)):
            at = rng.randrange(len(w))
            w[at : at + 1] = rng.choice([[], ["new"], [w[at], "more"]])
        texts.append([f"t{rng.randrange(300)}" for _ in range(rng.randrange(60))] + w + [f"t{rng.randrange(300)}" for _ in range(rng.randrange(60))])

    def smith_waterman(q, p):
        row, best = [0] * (len(p) + 1), 0
        for x in q:
            new = [0]
            for j, y in enumerate(p):
                new.append(max(0, row[j] + (2 if x == y else -1), row[j + 1] - 1, new[j] - 1))
            row, best = new, max(best, *new)
        return best

    want = {}
    for d, t in enumerate(texts):
        own = {tuple(t[a : a + 3]) for a in range(len(t) - 2)}
        for i, q in enumerate(items):
            s = smith_waterman(q, t) if own & {tuple(q[a : a + 3]) for a in range(len(q) - 2)} else 0
            if s >= max(2 * len(q) * decontam.THRESHOLD, 2 * min(len(q), decontam.LEAST_WORDS)):
                want[d] = max(want.get(d, (0, 0)), (s / (2 * len(q)), -i))
    docs = [(d, " ".join(t)) for d, t in enumerate(texts)] + [(None, " ".join(texts[0])), (0, " ".join(texts[0])), (95, None), (96, "")]
    benchmark = spark.createDataFrame([(i, " ".join(q)) for i, q in enumerate(items)], "item_id long, text string")
    got = decontam.detect(spark, spark.createDataFrame(docs, "doc_id long, text string").repartition(3), benchmark).collect()
    assert len(got) == len(docs) and 30 < len(want) < 90
    for r in got:
        i = {None: 0}.get(r["doc_id"], r["doc_id"])
        assert (r["contaminated"], r["score"], r["item_id"]) == ((True, want[i][0], -want[i][1]) if i in want else (False, None, None))


def test_decontamination_of_an_edited_copy_beside_many_exact_leaks(spark):
    rng = random.Random(4)
    w = [f"c{rng.randrange(10**6)}" for _ in range(30)]
    edited = " ".join(f"swap{k}" if k % 4 == 3 else x for k, x in enumerate(w))
    other = [" ".join(f"f{rng.randrange(10**6)}" for _ in range(40)) for _ in range(50)]
    texts = [f"{t} {' '.join(w)} {t}" for t in other] + [f"{other[0]} {edited} {other[1]}"] + [f"{t} {' '.join(w[:5])} {t}" for t in other]
    benchmark = spark.createDataFrame([(1, " ".join(w))], "item_id long, text string")
    got = decontam.detect(spark, spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), benchmark).filter("contaminated")
    assert {r["doc_id"]: r["score"] for r in got.collect()} == dict.fromkeys(range(50), 1.0) | {50: 39 / 60}


def test_decontamination_aligns_all_that_can_reach_the_threshold(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(decontam, "_AT_ONCE", 100)
    rng = random.Random(6)
    items = [" ".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 30))) for _ in range(40)]
    texts = [" ".join(rng.choice("abcdefghxyz") for _ in range(60)) if k % 2 else items[k].replace("a", "x") for k in range(40)]
    block = decontam.Items(list(range(40)), items)
    got = decontam.judge(pa.array(texts), block)
    monkeypatch.setattr(decontam, "most_shared", lambda block, item, *_: np.full(len(item), 1000))
    assert got == decontam.judge(pa.array(texts), block) and len(got) > 10


def test_pii_spans():
    text = "mail a.b@c-d.org, ip 10.0.0.255 and 10.0.0.256, card 4111 1111 1111 1111, call +49 (30) 1234567 x@y"
    assert [(k, text[a:b]) for a, b, k in pii.base_spans(text)] == [("email", "a.b@c-d.org"), ("ip", "10.0.0.255"), ("card", "4111 1111 1111 1111"), ("phone", "+49 (30) 1234567")]


def test_pii_disclosing_terms(spark, docs, empty):
    extra = [(1000 + k, f"filler{k} text{k} nickname Zorblax writes to z@q.org about topic{k} and more{k}", None, None, None, None, None) for k in range(5)]
    both = docs.unionByName(spark.createDataFrame(extra, SCHEMA))
    terms = {r["term"] for r in pii.find_disclosing(spark, both).collect()}
    assert "zorblax" in terms and "filler1" not in terms
    red = {r["doc_id"]: r["text"] for r in pii.redact(spark, both).collect()}
    assert "z@q.org" not in red[1000] and "Zorblax" not in red[1000] and "[EMAIL]" in red[1000]
    assert red[70] is None
    assert pii.detect(spark, empty, pii.find_disclosing(spark, empty)).count() == 0


def test_pii_terms_of_few_contexts(spark):
    common = "please write about this matter soon and call back"
    texts = [f"{common} {common} {common}"] * 400
    texts += [f"{common} Zorblax a.b@c.org {common}", f"{common} Quillon d@e.org {common}", f"now then Quillon on d@e.org {common}"]
    texts += [f"{common} Marrow f@g.org here f@g.org {common}", *[f"Marrow {common}"] * 2]
    texts += [f"{common} Tivoli k@l.org {common}"] * 3
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r["term"]: r["posterior"] for r in pii.find_disclosing(spark, docs).collect()}
    # Quillon has two contexts and nothing else. Zorblax, now, then and here stand once, Tivoli in copies of one context only,
    # and Marrow once near two mentions, of three times in all: none of these shows more than chance would.
    assert set(found) == {"quillon"} and 0.5 < found["quillon"] < 0.51
    red = {r["doc_id"]: r["text"] for r in pii.redact(spark, docs).collect()}
    assert red[400] == f"{common} Zorblax [EMAIL] {common}" and red[401] == f"{common} [EMAIL TERM] [EMAIL] {common}" and red[404] == texts[404]


def test_pii_planted_terms_among_rare_words(spark):
    """Names that stand with an address in several contexts are found, and hardly any of the many words that stand once near one."""
    rng = random.Random(8)
    words = ["".join(rng.choice("abcdefghijklmno") for _ in range(6)) for _ in range(3000)]
    names = [f"{c}{c}xname" for c in "abcdefghijkl"]
    texts = []
    for i in range(600):
        w = [rng.choice(words) for _ in range(60)]
        if i % 4 == 0:
            k = i // 4 % len(names)
            w[30:30] = [names[k], f"user{k}@mail.org"]
        texts.append(" ".join(w))
    terms = {r["term"] for r in pii.find_disclosing(spark, spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert terms == set(names)


def test_pii_contexts_are_whole_words():
    long = ["outermost" * 9, *(c * 90 for c in "bcdef")]
    text = "seventh " + (" " * 300).join(long) + " to:a@b.org. " + " ".join(long[::-1]) + " seventh"
    # What touches the mention ("to:" and ".") is the nearest word of each side.
    assert {t for t, *_ in pii.contexts(text)} == set(long[1:])
    text = text.replace("to:", "").replace("org. ", "org ")
    assert {t for t, *_ in pii.contexts(text)} == set(long)


def test_mixing(spark, docs, empty):
    import duckdb

    out = mixing.mix_sources(docs)
    assert mixing.mix_sources(empty).count() == 0
    got = collections.Counter((r["doc_id"], r["domain"], r["n_tokens"], r["epoch"]) for r in out.collect())
    documents = docs.select("doc_id", "text", "lang", "source", "n_chars").toPandas()
    documents["doc_id"] = documents["doc_id"].astype("Int64")
    con = duckdb.connect()
    con.register("documents", documents)
    want = collections.Counter((r[0], r[1], r[2], r[3]) for r in con.execute(f"select doc_id, domain, n_tokens, epoch from ({mixing.oracle()})").fetchall())
    assert got == want


def test_mixing_with_other_weights_ties_and_clashing_names(spark):
    import duckdb

    rng = random.Random(2)
    rows = [(rng.randrange(40), " ".join(["t"] * rng.choice([1, 2, 5])) + rng.choice(["", " "]), rng.choice(["en", "de"]), f"src{rng.randrange(3)}", k, "own") for k in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, domain string").repartition(3)
    weights = mixing.Weights(domains={"web": 1, "*": 7}, langs={"de": 9, "*": 1}, sources={"*": 1})
    for budget in (350, 1700):
        out = mixing.mix_sources(docs, weights=weights, budget=budget, seed=5)
        assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "input_domain", "domain", "n_tokens", "epoch"]
        got = collections.Counter((r["n_chars"], r["epoch"]) for r in out.collect())
        con = duckdb.connect()
        con.register("documents", docs.drop("domain").toPandas())
        want = collections.Counter(con.execute(f"select n_chars, epoch from ({mixing.oracle(weights=weights, budget=budget, seed=5)})").fetchall())
        assert got == want and len(want) > 30


def test_base_spans_are_those_of_the_patterns():
    rng = random.Random(8)
    for _ in range(4000):
        text = "".join(rng.choice("aZ9@@..-+_ ()1é5") for _ in range(rng.randrange(40))) + rng.choice(["", "4111 1111-1111 1111", "1.2.3.4.5.6.7.8.9", "+12 (34) 567.890(("])
        want = [(m.start(), m.end(), "email") for m in re.finditer(pii.EMAIL, text)]
        want += [(m.start(), m.end(), "ip") for m in re.finditer(pii.IP, text) if all(int(x) <= 255 for x in m[0].split("."))]
        want += [(m.start(), m.end(), "card") for m in re.finditer(pii.CARD, text) if 12 <= len(d := re.sub("[^0-9]", "", m[0])) <= 19 and pii.luhn(d)]
        want += [(m.start(), m.end(), "phone") for m in re.finditer(pii.PHONE, text) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
        assert pii.base_spans(text) == sorted(want, key=lambda x: (x[0], pii.KINDS.index(x[2]))), text


def test_long_unbroken_texts_take_linear_time():
    began = time.time()
    for text in ("a" * 10**6 + "@", "@" + "a." * 10**6, "7" * 10**6, "1." * 10**6, "a@" * 10**6, "+1(" * 10**5, "x@y.z " * 10**5):
        pii.all_spans(text, {"zzz": "email"})
    assert time.time() - began < 20


def disclosing(texts):
    """The definition in plain Python: term -> kind of its entity."""
    together, marks, own, total, n = collections.Counter(), collections.defaultdict(set), collections.defaultdict(set), collections.Counter(), 0
    for t in texts:
        found = re.findall(r"[^\W\d_]{3,}", (t or "").lower())
        total.update(found)
        n += len(found)
        for term, entity, mark, k, _ in pii.contexts(t or ""):
            together[term, entity] += k
            marks[entity].add(mark)
            if k:
                own[term, entity].add(mark)
    best = {}
    for (term, entity), k in together.items():
        if not k:
            continue
        share, prior, support = min(1.0, k / total[term]), min(1.0, len(marks[entity]) * 2 * pii.WINDOW / n), len(own[term, entity])
        posterior = (support + pii.PSEUDO * prior) / (support / share + pii.PSEUDO)
        divergence = share * math.log2(share / prior) + ((1 - share) * math.log2((1 - share) / (1 - prior)) if share < 1 else 0)
        chance = support / share * divergence - math.log2(len(together))
        if posterior >= pii.MIN_POSTERIOR and math.log2(share / prior) >= pii.MIN_BITS and chance >= pii.MIN_BITS:
            best[term] = max(best.get(term, (0, "")), (posterior, entity))
    return {t: e.split(":")[0] for t, (_, e) in best.items()}


@pytest.mark.parametrize("block", [pii.TERM_BLOCK, 0])
def test_terms_and_spans_against_plain_python(spark, monkeypatch, block):
    monkeypatch.setattr(pii, "TERM_BLOCK", block)
    rng = random.Random(6)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(4)) for _ in range(500)]
    texts = []
    for i in range(200):
        w = [rng.choice(vocabulary) for _ in range(rng.randrange(5, 60))]
        if i % 5 == 0:
            k = i % 25
            w[3:3] = [f"keeper{k:02d}".replace("0", "o").replace("1", "i").replace("2", "z").replace("5", "s"), f"person{k}@host.org"]
        if i % 9 == 0:
            w.append("call +49 30 1234567 or 10.1.2.3")
        texts.append(" ".join(w))
    rows = [*enumerate(texts), (None, texts[0]), (900, None), (901, ""), (3, texts[3])]
    docs = spark.createDataFrame([(*r, "own", len(r[1] or "")) for r in rows], "doc_id long, text string, _terms string, n_chars long").repartition(3)
    want = disclosing([t for _, t in rows])
    found = pii.find_disclosing(spark, docs)
    assert {r["term"]: r["kind"] for r in found.collect()} == want and {"email"} <= set(want.values())
    expect = collections.Counter()
    for i, t in rows:
        base = pii.base_spans(t or "")
        more = [(m.start(), m.end(), "term") for m in re.finditer(r"[^\W\d_]{3,}", t or "") if m[0].lower() in want and not any(a < m.end() and m.start() < b for a, b, _ in base)]
        kinds = collections.Counter(k for _, _, k in base)
        spans = sorted(base + more, key=lambda s: (s[0], pii.KINDS.index(s[2])))
        expect[i, kinds["email"], kinds["ip"], kinds["card"], kinds["phone"], hashlib.sha256(pii.listing(base).encode()).hexdigest(), pii.listing(spans), len(more)] += 1
    assert collections.Counter(tuple(r) for r in pii.detect(spark, docs, found).collect()) == expect
    red = pii.redact(spark, docs).collect()
    assert len(red) == len(rows) and all(r["_terms"] == "own" and r["n_chars"] == len(r["text"] or "") for r in red)
    assert any("[EMAIL TERM] [EMAIL]" in (r["text"] or "") for r in red)


def test_toxicity():
    rng = random.Random(3)
    bad = ["vile", "rotten", "awful"]
    texts, labels = [], []
    for _ in range(600):
        toxic = rng.random() < 0.3
        w = [f"n{rng.randrange(300)}x" for _ in range(rng.randrange(5, 80))]
        w = [x.replace("n", "abcdefghij"[int(x[1]) % 10]) for x in w] + (rng.sample(bad, 2) if toxic else [])
        quality = rng.random() < 0.5
        texts.append(" ".join(w))
        labels.append((toxic and not quality, toxic and quality, toxic))
    model = toxicity.fit_chain(texts[:400], np.array(labels[:400], int))
    score = toxicity.Scorer(model)
    hits = [(score(t)[-1] >= 0.5) == y[-1] for t, y in zip(texts[400:], labels[400:])]
    assert np.mean(hits) > 0.95
    assert all(0 <= p <= 1 for p in score(None))
    # Plain arithmetic over all features of a text, one category after the other.
    for t in texts[400:420]:
        z = [math.log1p(len(toxicity.features(t)))]
        for k, bias in enumerate(model["bias"]):
            v = bias + sum(model["words"][f][k] for f in toxicity.features(t) if f in model["words"]) + sum(a * b for a, b in zip(model["dense"][k], z))
            z.append(1 / (1 + math.exp(-v)))
        assert score(t) == pytest.approx(z[1:])


def test_toxicity_without_labels(spark, docs):
    labels = spark.createDataFrame([(None, 1, 1), (1, None, None)], "doc_id long, quality int, toxic int")
    assert toxicity.toxic_filter(spark, docs, labels).count() == docs.count()


def test_toxicity_by_spark_keeps_columns(spark):
    rng = random.Random(4)
    vocabulary = [f"calm{i}x" for i in range(300)]
    rows = [(i, " ".join(rng.choice(vocabulary) for _ in range(40)) + (" vilest slurword" if i % 3 == 0 else ""), 0.5 + i) for i in range(300)]
    docs = spark.createDataFrame([*rows, (None, None, 7.0), (900, "", 8.0), rows[1]], "doc_id long, text string, toxic double").repartition(3)
    labels = spark.createDataFrame([(i, i % 2, int(i % 3 == 0)) for i in range(0, 300, 2)] + [(1, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    model = toxicity.train(spark, docs, labels)
    scored = toxicity.score_documents(docs, model).collect()
    assert all(r["rejected"] == (r["doc_id"] is not None and r["doc_id"] < 300 and r["doc_id"] % 3 == 0) for r in scored)
    kept = toxicity.toxic_filter(spark, docs, labels).collect()
    assert collections.Counter((r["doc_id"], r["toxic"]) for r in kept) == collections.Counter([(i, v) for i, _, v in [*rows, rows[1]] if i % 3] + [(None, 7.0), (900, 8.0)])
    assert toxicity.score_documents(docs.limit(0), model).count() == 0
