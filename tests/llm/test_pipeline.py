"""The pipeline against plain Python and DuckDB on planted documents."""

import collections
import random

import corpus_pipeline
import duckdb
import pandas as pd

from streamloom.llm import common, mixing, pii

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, note string"


def planted():
    rng = random.Random(11)
    letters = "abcdefghijklmnopqrstuvwxyz"
    vocabulary = ["".join(rng.choice(letters) for _ in range(7)) for _ in range(400)]
    item = " ".join("".join(rng.choice(letters) for _ in range(9)) for _ in range(30))
    texts, toxic = [], set()
    for i in range(600):
        w = [rng.choice(vocabulary) for _ in range(rng.randrange(30, 80))]
        if i % 3 == 0:
            toxic.add(i)
            w[5:5] = ["vileness", "rottenly", "awfulest"]
        texts.append(" ".join(w))
    copies = {}
    for k in range(1, 90, 3):
        copies[len(texts)] = k
        texts.append(texts[k] if k % 2 else texts[k] + " tail")
    leaks = set()
    for k in (0, 1):
        leaks.add(len(texts))
        texts.append(f"{texts[2 + k * 3][:60]} {item if k == 0 else item.upper()} {texts[5 + k * 3][:60]}")
    mails = [len(texts), len(texts) + 1]
    texts += [" ".join(rng.choice(vocabulary) for _ in range(40)) + f" m{k}.n@host{k}.org or +49 (30) 123456{k}" for k in (0, 1)]
    return texts, toxic, copies, leaks, mails, item


def test_pipeline_against_brute_force(spark, tmp_path):
    texts, toxic, copies, leaks, mails, item = planted()
    rows = [(i, t, ("en", "de", "fr")[i % 3 if i % 2 else 0], f"src{i % 4}", len(t), "own") for i, t in enumerate(texts)]
    rows += [(len(texts), None, None, None, None, None), (len(texts) + 1, "", "en", "src1", 0, None)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i % 2), int(i in toxic)) for i in range(600)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    shingles = {i: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} for i, w in ((r[0], (r[1] or "").split()) for r in rows) if i not in toxic}
    kept = []
    for i, s in shingles.items():
        alike = [j for j in shingles if j < i and s and len(s & shingles[j]) >= 0.8 * len(s | shingles[j])]
        assert alike == [copies[i]] if i in copies else not alike
        if not alike and i not in leaks:
            kept.append(i)
    left = [(*rows[i][:1], rows[i][1] and pii.redact_text(rows[i][1], pii.base_spans(rows[i][1])), *rows[i][2:5]) for i in kept]
    assert all("@" not in t[1] and "[EMAIL]" in t[1] for t in left if t[0] in mails)
    documents = pd.DataFrame(left, columns=["doc_id", "text", "lang", "source", "n_chars"])
    con = duckdb.connect()
    con.register("documents", documents)
    want = collections.Counter(con.execute(f"select doc_id, domain, n_tokens, epoch from ({mixing.oracle()})").fetchall())
    assert len({w[0] for w in want}) > 100

    before = common.written()
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert len(common.written()) == len(before) + 1
    got = out.collect()
    assert collections.Counter((r["doc_id"], r["domain"], r["n_tokens"], r["epoch"]) for r in got) == want
    text = {i: t for i, t, *_ in left}
    assert all(r["text"] == text[r["doc_id"]] for r in got)
    assert all(r["note"] in ("own", None) for r in got)
