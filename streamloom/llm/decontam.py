"""Benchmark decontamination: n-gram seeds, then Smith-Waterman alignment of passages with test items.

Words are lower-cased runs without white space and ASCII punctuation. Every run of SEED words of an item is a seed, and
none is dropped, however common: each hit of a seed puts the passage around it to a local alignment with the item, over
words: match 2, mismatch and gap -1. A document is contaminated if an alignment reaches THRESHOLD of the item's best
score and the score of min(item length, LEAST_WORDS) matching words. A passage is not aligned where twice the number of
words it shares with the item (with multiplicity) is below what must be reached: no alignment scores more than that, so
hits of common seeds cost little and nothing is lost. A passage reaches to either side of a hit as far as the item does
and as many words more as an alignment that still reaches what it must can hold of others: each of these costs 1.

Items are handled in blocks of about BLOCK items, one after the other, each against all documents; a block's seeds and
words are all that is sent to tasks and is let go before the next. With several blocks only what is found is kept of
each, by the MD5 of the text, and joined to the documents in the end. Hits are taken a few rows at a time, so that a
seed of many items in many rows is held in parts.

Defined cases: null and empty texts and items match nothing; items shorter than SEED words have no seeds and are never
found; repeated items count once each, the least item_id winning ties; repeated documents are each judged; other
columns pass through the filter.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import SPACE, U, chunks, gram_hash, materialise, string_buffers, word_hashes, words

SEED = 3
THRESHOLD = 0.5
LEAST_WORDS = 8
BLOCK = 4000
#: Cells of alignments that are held at once.
CELLS = 1 << 21
#: Postings or words of passages that are held at once.
_AT_ONCE = 1 << 20
_FILTER_BITS = 20
_PUNCTUATION = SPACE.copy()
_PUNCTUATION[[c for c in range(33, 127) if not chr(c).isalnum()]] = True


def word_rows(column) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, and how many words lie before each row."""
    data, offs = string_buffers(pc.utf8_lower(column))
    starts, ends, before = words(data, offs, _PUNCTUATION)
    return word_hashes(data, starts, ends), before


class Items:
    """A block of test items: word hashes, and their seeds with where they stand."""

    def __init__(self, ids: list[int], texts: list[str | None]):
        hashes, before = word_rows(pa.array(texts, pa.string()))
        self.ids = np.array(ids, np.int64)
        self.words = [hashes[a:b] for a, b in zip(before[:-1], before[1:], strict=True)]
        grams = [gram_hash(w, SEED) for w in self.words]
        every = np.concatenate(grams) if grams else np.zeros(0, np.uint64)
        self.seeds, self.seed = np.unique(every, return_inverse=True)
        order = np.argsort(self.seed, kind="stable")
        self.seed = self.seed[order]
        self.item = np.repeat(np.arange(len(grams)), [len(g) for g in grams])[order]
        self.place = np.concatenate([np.arange(len(g)) for g in grams])[order] if grams else np.zeros(0, np.int64)
        self.first = np.searchsorted(self.seed, np.arange(len(self.seeds) + 1))
        self.filter = np.zeros(1 << _FILTER_BITS, bool)
        self.filter[(self.seeds >> U(64 - _FILTER_BITS)).astype(np.int64)] = True
        # How often each item has each word, by item and word.
        self.known, word = np.unique(hashes, return_inverse=True)
        self.size = np.diff(before)
        self.pairs, self.times = np.unique(np.repeat(np.arange(len(self.ids)), self.size) * len(self.known) + word, return_counts=True)
        self.least = np.maximum(2 * self.size * THRESHOLD, 2 * np.minimum(self.size, LEAST_WORDS))

    def hits(self, hashes: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Word positions where a seed starts inside one row, and which."""
        grams = gram_hash(hashes, SEED)
        if not len(grams) or not len(self.seeds):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.flatnonzero(self.filter[(grams >> U(64 - _FILTER_BITS)).astype(np.int64)])
        found = np.searchsorted(self.seeds, grams[at])
        found[found == len(self.seeds)] = 0
        good = self.seeds[found] == grams[at]
        at, found = at[good], found[good]
        inside = np.searchsorted(before, at, "right") == np.searchsorted(before, at + SEED - 1, "right")
        return at[inside], found[inside]


def align(items: list[np.ndarray], passages: list[np.ndarray]) -> np.ndarray:
    """Smith-Waterman scores of pairs, all in step: match 2, mismatch -1, gap -1."""
    out = np.zeros(len(items), np.int64)
    width = np.array([len(p) for p in passages], np.int64)
    order = np.lexsort(([len(q) for q in items], width)) if len(width) else np.zeros(0, np.int64)
    a = 0
    while a < len(order):
        # Passages in order of length: the last one of a part is the widest.
        b = min(a + 512, len(order))
        while b > a + 1 and (b - a) * width[order[b - 1]] > CELLS:
            b = max(a + 1, a + int(CELLS // width[order[b - 1]]))
        part, a = order[a:b], b
        n, m = max(len(items[i]) for i in part), max(len(passages[i]) for i in part)
        q, p = np.zeros((len(part), n), np.uint64), np.ones((len(part), m), np.uint64)
        for r, i in enumerate(part):
            q[r, : len(items[i])], p[r, : len(passages[i])] = items[i], passages[i]
        row = np.zeros((len(part), m + 1), np.int32)
        best, slope = np.zeros(len(part), np.int32), np.arange(m + 1, dtype=np.int32)
        for i in range(n):
            new = np.zeros_like(row)
            np.maximum(row[:, :-1] + np.where(p == q[:, i : i + 1], 2, -1), row[:, 1:] - 1, out=new[:, 1:])
            np.maximum(new, 0, out=new)
            row = np.maximum.accumulate(new + slope, axis=1) - slope
            np.maximum(best, row.max(1), out=best)
        out[part] = best
    return out


def parts(sizes: np.ndarray):
    """Ranges [a, b) whose sizes sum up to about _AT_ONCE; a larger one stands alone."""
    total = np.append(0, np.cumsum(sizes))
    yield from chunks(total, _AT_ONCE)


def most_shared(block: Items, item: np.ndarray, low: np.ndarray, high: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """How many words the passages hashes[low:high] share with their items, with multiplicity."""
    out = np.zeros(len(item), np.int64)
    # Only words that some item has are looked at.
    found = np.searchsorted(block.known, hashes)
    found[found == len(block.known)] = 0
    at = np.flatnonzero(block.known[found] == hashes)
    word = found[at]
    low, high = np.searchsorted(at, low), np.searchsorted(at, high)
    for a, b in parts(high - low):
        n = high[a:b] - low[a:b]
        which = np.repeat(np.arange(b - a), n)
        pair = item[a:b][which] * len(block.known) + word[np.repeat(low[a:b] - np.cumsum(n) + n, n) + np.arange(n.sum())]
        place = np.searchsorted(block.pairs, pair)
        place[place == len(block.pairs)] = 0
        good = block.pairs[place] == pair
        both, times = np.unique(which[good] * len(block.pairs) + place[good], return_counts=True)
        out[a:b] = np.bincount(both // len(block.pairs), np.minimum(times, block.times[both % len(block.pairs)]), b - a)
    return out


def judge(column, block: Items) -> list[tuple]:
    """(row, item_id, score) of the best contaminating item of each contaminated row."""
    out: dict[int, tuple] = {}
    _, offs = string_buffers(column)
    for a, b in chunks(offs, 1 << 21):
        hashes, before = word_rows(column.slice(a, b - a))
        every, seeds = block.hits(hashes, before)
        if not len(every):
            continue
        rows = np.searchsorted(before, every, "right") - 1
        start = np.append(np.flatnonzero(np.append(True, rows[1:] != rows[:-1])), len(rows))
        postings = block.first[seeds + 1] - block.first[seeds]
        for x, y in parts(np.add.reduceat(postings, start[:-1])):
            some = slice(start[x], start[y])
            at, seed, row, n = every[some], seeds[some], rows[some], postings[some]
            which = np.repeat(block.first[seed] - np.cumsum(n) + n, n) + np.arange(n.sum())
            at, row, item, place = np.repeat(at, n), np.repeat(row, n), block.item[which], block.place[which]
            order = np.lexsort((at, item, row))
            row, item, at, place = row[order], item[order], at[order], place[order]
            size = block.size[item]
            new = np.ones(len(at), bool)
            new[1:] = (row[1:] != row[:-1]) | (item[1:] != item[:-1]) | (at[1:] - at[:-1] > 2 * size[1:])
            # An alignment that reaches what it must has so many words of others at most, as each costs 1.
            slack = 2 * size - block.least[item].astype(np.int64)
            low, high = np.maximum(before[row], at - place - slack), np.minimum(before[row + 1], at - place + size + slack)
            first = np.flatnonzero(new)
            low, high = np.minimum.reduceat(low, first), np.maximum.reduceat(high, first)
            row, item = row[first], item[first]
            able = 2 * most_shared(block, item, low, high, hashes) >= block.least[item]
            row, item, low, high = row[able], item[able], low[able], high[able]
            scores = align([block.words[i] for i in item], [hashes[p:q] for p, q in zip(low, high, strict=True)])
            good = scores >= block.least[item]
            for r, i, s, k in zip(row[good], item[good], scores[good], block.size[item[good]], strict=True):
                got = (s / (2 * k), -int(block.ids[i]))
                if got > out.get(a + int(r), (0.0, 0)) or a + int(r) not in out:
                    out[a + int(r)] = got
    return [(r, -i, float(s)) for r, (s, i) in sorted(out.items())]


def judged(docs: DataFrame, sent, keep: list[str]) -> DataFrame:
    """The columns keep of docs, with contaminated, item_id and score after the block of items that was sent."""
    at = keep.index("text")
    schema = T.StructType([*(docs.schema[c] for c in keep), T.StructField("contaminated", T.BooleanType()), T.StructField("item_id", T.LongType()), T.StructField("score", T.DoubleType())])

    def run(batches):
        block = pickle.loads(sent.value)
        for batch in batches:
            item, score = [None] * batch.num_rows, [None] * batch.num_rows
            for r, i, s in judge(batch.column(at), block):
                item[r], score[r] = i, s
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([i is not None for i in item], pa.bool_()), pa.array(item, pa.int64()), pa.array(score, pa.float64())], schema.names)

    return docs.select(*keep).mapInArrow(run, schema)


#: Contaminated texts of up to so many rows are broadcast.
FEW_FOUND = 1_000_000


def detect(spark: SparkSession, docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs with contaminated (boolean), item_id and score of the best item (null for clean documents)."""
    keep = [c for c in docs.columns if c not in ("contaminated", "item_id", "score")]
    items = benchmark.filter("text is not null and item_id is not null").select(F.col("item_id").cast("long").alias("item_id"), "text")
    k = max(1, -(-items.count() // BLOCK))

    def send(b: int):
        rows = sorted(items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(k)) == b).collect())
        return spark.sparkContext.broadcast(cloudpickle.dumps(Items([r[0] for r in rows], [r[1] for r in rows])))

    if k == 1:
        return judged(docs, send(0), keep)
    found = None
    for b in range(k):
        sent = send(b)
        got = judged(docs, sent, ["text"]).filter("contaminated").select(F.md5("text").alias("_decontam_key"), "item_id", "score")
        got = materialise(spark, got.distinct(), "leaks")
        sent.destroy()
        found = got if found is None else found.union(got)
    best = F.max_by(F.struct("item_id", "score"), F.struct("score", -F.col("item_id")))
    found = materialise(spark, found.groupBy("_decontam_key").agg(best.alias("_decontam_best")), "all-leaks")
    found = F.broadcast(found) if found.count() <= FEW_FOUND else found
    out = docs.select(*keep).withColumn("_decontam_key", F.md5("text")).join(found, "_decontam_key", "left")
    return out.select(*keep, F.col("_decontam_best").isNotNull().alias("contaminated"), "_decontam_best.item_id", "_decontam_best.score")


def decontaminate(spark: SparkSession, docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The clean documents, with the columns of docs."""
    return detect(spark, docs.withColumnsRenamed({c: f"_own_{c}" for c in ("contaminated", "item_id", "score") if c in docs.columns}), benchmark).filter("not contaminated").drop("contaminated", "item_id", "score").withColumnsRenamed({f"_own_{c}": c for c in ("contaminated", "item_id", "score") if c in docs.columns}).select(*docs.columns)
