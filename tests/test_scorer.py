"""Batches, costs and kept vectors against plain loops."""

import os
import random
import uuid

import numpy as np
from hypothesis import given
from hypothesis import strategies as st

from streamloom.models import scorer as models

from .stand_in import HashingScorer


class Told(HashingScorer):
    """Writes down what it was asked."""

    def __init__(self, folder):
        super().__init__()
        self.folder = folder
        self.first_token_seconds = 0.25

    def note(self, lines):
        with open(f"{self.folder}/{uuid.uuid4().hex}", "w") as f:
            f.write("\n".join(lines))

    def embed(self, texts):
        self.note(texts)
        return super().embed(texts)

    def tokens(self, prompts, frames):
        return [len(p.split()) + 3 * len(f) for p, f in zip(prompts, frames, strict=True)]

    def generate(self, prompts, frames):
        self.note([f"{n}" for n in self.tokens(prompts, frames)])
        return super().generate(prompts, frames)


def told(folder):
    return [(folder / f).read_text().split("\n") for f in os.listdir(folder)]


@given(st.lists(st.integers(0, 60)), st.integers(1, 6), st.integers(1, 150), st.sampled_from([0.0, 0.1, 0.5, 1.0]))
def test_batches_keep_their_bounds(lengths, rows, tokens, padding):
    how = models.Batches(rows, tokens, padding)
    cuts = list(how.cut(lengths))
    assert [x for a, b in cuts for x in range(a, b)] == list(range(len(lengths)))
    fits = lambda some: len(some) <= rows and len(some) * max(some) <= tokens and len(some) * max(some) - sum(some) <= padding * len(some) * max(some)
    for a, b in cuts:
        assert b - a == 1 or fits(lengths[a:b])
        # None could have taken one more row.
        assert b == len(lengths) or not fits(lengths[a : b + 1])


def test_answers_of_similar_length_meet(spark, tmp_path):
    rng = random.Random(3)
    rows = [(i, None if i == 7 else " ".join(["w"] * rng.choice([1, 2, 40, 300])), [1] * rng.randrange(3)) for i in range(200)]
    df = spark.createDataFrame(rows, "id long, prompt string, frames array<long>").repartition(3)
    seen = tmp_path / "asked"
    seen.mkdir()
    factory = lambda: Told(seen)
    how = models.Batches(rows=8, padding=0.2)
    answers, costs = models.observed(models.generate(df, "prompt", factory, "frames", batch=how))
    answers.write.parquet(f"{tmp_path}/answers")
    got = {r["id"]: r for r in spark.read.parquet(f"{tmp_path}/answers").collect()}
    batches = [[int(n) for n in b] for b in told(seen)]
    assert len(got) == 200 == sum(map(len, batches)) and len(batches) < 60
    assert all(len(b) * max(b) - sum(b) <= 0.2 * len(b) * max(b) and len(b) <= 8 for b in batches)
    for i, text, frames in rows:
        words = len((text or "").split())
        assert got[i]["prompt_tokens"] == words + 3 * len(frames) and got[i]["response"].endswith(f"({len(frames)} frames)")
    total = costs.get
    assert (total["answers"], total["prompt_tokens"], total["padded_tokens"]) == (200, sum(map(sum, batches)), sum(len(b) * max(b) - sum(b) for b in batches))
    assert total["batches"] == len(batches) and total["slowest_first"] == 0.25 and total["seconds"] > 0


def test_captions_of_chunks_without_frames_are_null(spark):
    chunks = spark.createDataFrame([(1, 0, 5.0, [1, 2]), (1, 1, 15.0, []), (1, 2, 25.0, None)], "video long, chunk long, mid double, frames array<long>")
    got = {r["chunk"]: (r["caption"], r["batch_rows"]) for r in models.caption(chunks, HashingScorer, "EVENT: x").collect()}
    assert got == {0: ("EVENT: x (2 frames)", 1), 1: (None, None), 2: (None, None)}
    assert models.generate(chunks.filter("chunk > 9").selectExpr("'' as p"), "p", HashingScorer).count() == 0


def test_a_second_run_embeds_new_texts_only(spark, tmp_path):
    seen = tmp_path / "asked"
    seen.mkdir()
    cache = models.VectorCache(f"{tmp_path}/vectors", "one")
    first = spark.createDataFrame([(1, "Red  pan"), (2, "red pan"), (3, None), (4, "cook")], "id long, text string")
    second = spark.createDataFrame([(1, "cook"), (2, "red pan"), (3, "old man"), (4, None), (5, "")], "id long, text string")

    def run(rows, cache=cache):
        return {r["id"]: r["vector"] for r in models.embed(rows, "text", lambda: Told(seen), cache=cache).collect()}

    def asked():
        return sorted(t for b in told(seen) for t in b)

    a = run(first)
    assert a[1] == a[2] and a[3] is None and asked() == ["cook", "red pan"]
    b = run(second)
    assert b[1] == a[4] and b[2] == a[1] and b[4] is None and asked() == ["", "cook", "old man", "red pan"]
    assert run(second) == b and asked() == ["", "cook", "old man", "red pan"]
    assert np.allclose(b[3], HashingScorer().embed(["old man"])[0])
    # Vectors of another model are not taken for this one's; rows that two runs both appended count once.
    assert run(first, models.VectorCache(f"{tmp_path}/vectors", "two")) == a and len(asked()) == 6
    spark.read.parquet(cache.path).write.mode("append").parquet(cache.path + "-copy")
    spark.read.parquet(cache.path + "-copy").write.mode("append").parquet(cache.path)
    assert run(second) == b
