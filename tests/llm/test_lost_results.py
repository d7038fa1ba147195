"""Results that must not get lost: foreign digests, broken members, copies with words between, rows beyond a bound."""

import base64
import gzip
import hashlib

import numpy as np
import pyarrow as pa
import pytest

from streamloom.llm import decontam, toxicity, warc


def record(i, label, block=b"HTTP/1.1 200 OK\r\n\r\nbody"):
    head = f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <r{i}>\r\n" + (f"WARC-Payload-Digest: {label}\r\n" if label else "") + f"Content-Length: {len(block)}\r\n\r\n"
    return gzip.compress(head.encode() + block + b"\r\n\r\n")


@pytest.mark.parametrize("name", ["a.warc", "a.warc.gz"])
def test_records_with_any_digest_come_out(spark, tmp_path, name):
    b32 = lambda kind: base64.b32encode(hashlib.new(kind, b"body").digest()).decode()
    labels = [f"sha1:{b32('sha1')}", f"sha1:{hashlib.sha1(b'body').hexdigest()}", f"sha256:{b32('sha256')}", f"sha256:{b32('sha256').rstrip('=')}", "sha1:WRONG", f"md5:{hashlib.md5(b'body').hexdigest()}", "md5:wrong", "crc9:1", None]
    (tmp_path / name).write_bytes(b"".join(record(i, x) for i, x in enumerate(labels)))
    got = {r["record_id"]: (bytes(r["payload"]), r["payload_digest"], r["digest_ok"], r["error"]) for r in warc.read_archives(spark, str(tmp_path)).collect()}
    want = [True, True, True, True, False, True, False, None, None]
    assert got == {f"<r{i}>": (b"body", b32("sha1"), w, None) for i, w in enumerate(want)}


def test_broken_records_are_rows(spark, tmp_path):
    whole, broken = record(1, None), bytearray(record(2, None, b"HTTP/1.1 200 OK\r\n\r\n" + bytes(range(256)) * 4))
    broken[-20] ^= 255
    short = gzip.compress(b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <r3>\r\nContent-Length: 99\r\n\r\nHTTP/1.1 200 OK\r\n\r\nbody")
    (tmp_path / "a.warc").write_bytes(whole + bytes(broken) + whole + short)
    got = sorted((r["record_id"] or "", r["error"] or "") for r in warc.read_archives(spark, str(tmp_path)).collect())
    assert got == [("", "member does not inflate"), ("<r1>", ""), ("<r1>", ""), ("<r3>", "record is cut off")]


@pytest.mark.parametrize("block", [4000, 2])
def test_item_with_words_between_is_found(spark, monkeypatch, block):
    monkeypatch.setattr(decontam, "BLOCK", block)
    item = [f"item{k}" for k in range(40)]
    apart = [w for k, x in enumerate(item) for w in ([x, f"other{k}"] if k < 37 else [x])]
    back = [w for k, x in enumerate(item) for w in ([x, f"other{k}"] if k > 2 else [x])]
    lead = [f"lead{k}" for k in range(50)]
    texts = [" ".join(lead + apart + lead), " ".join(lead + back + lead), " ".join(w for x in item for w in (x, "a", "b")), " ".join(lead)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    items = spark.createDataFrame([(7, " ".join(item))] + [(20 + k, f"nothing of {k} is anywhere in here") for k in range(6)], "item_id long, text string")
    got = {r["doc_id"]: (r["item_id"], r["score"]) for r in decontam.detect(spark, docs, items).collect() if r["contaminated"]}
    assert got == {0: (7, 43 / 80), 1: (7, 44 / 80)}


def test_very_long_text_full_of_hits(monkeypatch):
    item = [f"w{k}" for k in range(20)]
    block = decontam.Items([1, 2], [" ".join(item), " ".join(item[::-1])])
    text = " ".join(item[:9] + ["x"] * 9) + " "
    assert decontam.judge(pa.array([text * 6000, (text * 6000) + " ".join(item)]), block) == [(1, 1, 1.0)]
    rng = np.random.default_rng(1)
    words = [rng.integers(10, 19, n).astype(np.uint64) for n in rng.integers(1, 60, 80)]
    passages = [rng.integers(10, 19, n).astype(np.uint64) for n in rng.integers(1, 400, 80)]
    whole = decontam.align(words, passages)
    monkeypatch.setattr(decontam, "CELLS", 500)
    assert (decontam.align(words, passages) == whole).all()


def test_labelled_rows_are_bounded(spark):
    docs = spark.createDataFrame([(i % 4, f"word{i % 9} calm") for i in range(400)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(4)], "doc_id long, quality int, toxic int")
    seen = []
    plain = toxicity.materialise

    def counted(s, df, name):
        out = plain(s, df, name)
        seen.append(out.count())
        return out

    toxicity.materialise, kept = counted, plain
    try:
        assert toxicity.train(spark, docs, labels, max_train=50) is not None
    finally:
        toxicity.materialise = kept
    assert seen == [50]
