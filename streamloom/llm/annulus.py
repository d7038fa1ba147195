"""Product codes of vectors whose nearest codebook entries are found by annular norm pruning, in whole numbers.

A component x becomes floor(SCALE * x), and a vector is cut into PARTS equal parts, each coded by the nearest entry of the
codebook of its position. The entries of a codebook are sorted by norm. A part first meets the NEAR entries next to its own
norm; with the best distance d so far, only entries with a norm in [norm - d, norm + d] can be nearer or tie (triangle
inequality). This interval is found by binary search and measured exactly, ends included, from its middle outwards, NEAR
entries to each side at a time; each time it shrinks to what the best distance by then allows. Norms are floating-point
roots, so the interval is widened by a billionth; distances are whole numbers.

Codebooks start as the parts of the ENTRIES vectors with the least ids. In each of ROUNDS rounds every task sends one row
for each entry, with count and sums, whatever the number of its vectors; sums come back as one row for each entry, so the
codebooks (ENTRIES vectors) are all that is on the driver. Sums are decimals of 38 digits.

Defined cases: a null vector, or one with a null, NaN or infinite component, is dropped, and so is one whose length is not
that of the vector with the least id; where PARTS does not divide the length, the last parts are shorter or empty; fewer
than ENTRIES vectors make a smaller codebook; vectors with equal ids start the codebooks in the order of their components,
those without an id (null) come last; rows that repeat are all coded and counted; an empty table has no rows; numbers beyond
2^24 are handled as Python's integers, and an error beyond a long is given as the greatest long. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise

SCALE, PARTS, ENTRIES, ROUNDS = 256, 16, 64, 2
#: Entries measured to either side before the interval is searched again.
NEAR = 4
#: Scaled components up to this one are multiplied as 64-bit numbers.
SAFE = 1 << 24
#: Numbers held at once, of a batch's vectors or of pairs of parts and entries.
CELLS = 1 << 22
LONG = (1 << 63) - 1
#: Salts that the rows of a label are dealt over when they meet its total.
SALTS = 64


class Codebook:
    """The entries of one part position, sorted by norm."""

    def __init__(self, entries: np.ndarray) -> None:
        self.entries = entries
        norm = np.sqrt((entries.astype(np.float64) ** 2).sum(1))
        self.order = np.argsort(norm, kind="stable")
        self.sorted, self.norm = entries[self.order], norm[self.order]

    def nearest(self, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the nearest entry of each part, the least of those that tie, and the squared distance."""
        norm = np.sqrt((parts.astype(np.float64) ** 2).sum(1))
        at = np.searchsorted(self.norm, norm)
        index, error = np.full(len(parts), len(self.norm)), np.full(len(parts), None if parts.dtype == object else np.iinfo(parts.dtype).max)
        left, right, todo = at.copy(), at.copy(), np.arange(len(parts))
        low, high = np.maximum(at - NEAR // 2, 0), np.minimum(at + NEAR // 2, len(self.norm))
        while len(todo):
            for from_, to in ((np.maximum(low, left - NEAR), left), (right, np.minimum(high, right + NEAR))):
                self.measure(parts, todo, from_, to, index, error)
            left, right = np.maximum(np.minimum(low, left), left - NEAR), np.minimum(np.maximum(high, right), right + NEAR)
            seen = index[todo] < len(self.norm)
            reach = np.sqrt(np.where(seen, error[todo], 0).astype(np.float64))
            reach = np.where(seen, reach + 1e-9 * (1 + norm[todo] + reach), np.inf)
            low, high = np.searchsorted(self.norm, norm[todo] - reach, "left"), np.searchsorted(self.norm, norm[todo] + reach, "right")
            more = (low < left) | (high > right)
            todo, low, high, left, right = todo[more], low[more], high[more], left[more], right[more]
        return index, error

    def measure(self, parts: np.ndarray, rows: np.ndarray, low: np.ndarray, high: np.ndarray, index: np.ndarray, error: np.ndarray) -> None:
        """Measure parts[rows] against the entries [low, high) of each in the order of norms, and keep what is nearer, or as near with a lesser index."""
        some = np.flatnonzero(high > low)
        step = max(1, CELLS // (NEAR * max(parts.shape[1], 1)))
        for a in range(0, len(some), step):
            own = some[a : a + step]
            count = (high - low)[own]
            first = np.cumsum(count) - count
            entry = np.arange(count.sum()) - np.repeat(first - low[own], count)
            found = self.distance(parts[np.repeat(rows[own], count)], entry)
            least = np.minimum.reduceat(found, first)
            named = np.minimum.reduceat(np.where(found == np.repeat(least, count), self.order[entry], len(self.norm)), first)
            at = rows[own]
            new = index[at] == len(self.norm)
            better = new.copy()
            better[~new] = (least[~new] < error[at[~new]]) | ((least[~new] == error[at[~new]]) & (named[~new] < index[at[~new]]))
            index[at[better]], error[at[better]] = named[better], least[better]

    def distance(self, parts: np.ndarray, entry: np.ndarray) -> np.ndarray:
        return ((parts - self.sorted[entry]) ** 2).sum(1)


def scaled(flat: np.ndarray) -> np.ndarray:
    """floor(SCALE * x), as 64-bit numbers where that is safe, else as Python's."""
    x = np.floor(flat.astype(np.float64) * SCALE)
    if not len(x) or np.abs(x).max() <= SAFE:
        return x.astype(np.int64)
    return np.array([int(v) // int(w) for v, w in ((SCALE * n, d) for n, d in (float(f).as_integer_ratio() for f in flat))], dtype=object)


def cut(vectors: np.ndarray) -> list[np.ndarray]:
    """The parts of each vector, by position."""
    width = -(-vectors.shape[1] // PARTS)
    return [vectors[:, p * width : (p + 1) * width] for p in range(PARTS)]


def usable(rows: DataFrame, vector: str = "embedding") -> DataFrame:
    """Rows whose vector is there, with finite components only."""
    return rows.filter(F.col(vector).isNotNull() & F.coalesce(F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False)))


def slices(batch: pa.RecordBatch, length: int) -> Iterable[pa.RecordBatch]:
    """Slices of a batch whose vectors have at most CELLS numbers."""
    step = max(1, CELLS // max(length, 1))
    return (batch.slice(a, step) for a in range(0, batch.num_rows, step))


def batch_vectors(column, length: int) -> np.ndarray:
    return scaled(column.flatten().to_numpy(zero_copy_only=False)).reshape(len(column), length)


def codes(column, length: int, books: list[Codebook]) -> Iterable[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each position: the parts of a batch, their indexes and errors."""
    for parts, book in zip(cut(batch_vectors(column, length)), books, strict=True):
        kind = np.result_type(parts.dtype, book.entries.dtype)
        yield parts, *book.nearest(parts.astype(kind))


def improve(spark: SparkSession, rows: DataFrame, length: int, books: list[Codebook]) -> list[Codebook]:
    """One round: every entry becomes the floor of the mean of its parts; unused ones stay."""

    def run(batches):
        count = [np.zeros(len(b.norm), np.int64) for b in books]
        total = [np.zeros(b.entries.shape, object) for b in books]
        for batch in batches:
            for some in slices(batch, length):
                for p, (parts, index, _) in enumerate(codes(some.column(0), length, books)):
                    part = np.zeros(total[p].shape, parts.dtype)
                    np.add.at(part, index, parts)
                    total[p] = total[p] + part
                    count[p] += np.bincount(index, minlength=len(count[p]))
        out = [(p, e, d, int(n), Decimal(int(t))) for p in range(PARTS) for e, n in enumerate(count[p].tolist()) if n for d, t in enumerate([*total[p][e], 0])]
        cols = list(zip(*out, strict=True)) if out else [[]] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.decimal128(38, 0)), strict=True)], ["part", "entry", "place", "n", "total"])

    found = rows.select("embedding").mapInArrow(run, "part int, entry int, place int, n long, total decimal(38,0)").groupBy("part", "entry", "place").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
    entries = [b.entries.astype(object) for b in books]
    for r in found.collect():  # ENTRIES * (length + PARTS) rows at most
        if r["place"] < entries[r["part"]].shape[1]:
            entries[r["part"]][r["entry"], r["place"]] = int(r["total"]) // r["n"]
    return [Codebook(compact(e)) for e in entries]


def compact(entries: np.ndarray) -> np.ndarray:
    """64-bit numbers where they are safe."""
    return entries.astype(np.int64) if not entries.size or max(map(abs, entries.flat)) <= SAFE else entries


def train(spark: SparkSession, rows: DataFrame, vector: str = "embedding", key: str = "vec_id") -> tuple[int | None, list[Codebook]]:
    """Length of the vectors and the codebooks after all rounds; None and none for an empty table."""
    first = usable(rows, vector).orderBy(F.col(key).asc_nulls_last(), vector)
    start = first.select(F.size(vector).alias("n")).first()
    if start is None:
        return None, []
    same = usable(rows, vector).filter(F.size(vector) == start["n"])
    seeds = [r[0] for r in same.orderBy(F.col(key).asc_nulls_last(), vector).select(vector).limit(ENTRIES).collect()]
    books = [Codebook(p) for p in cut(scaled(np.array(seeds, np.float64).reshape(-1)).reshape(len(seeds), start["n"]))]
    for _ in range(ROUNDS):
        books = improve(spark, same.select(F.col(vector).alias("embedding")), start["n"], books)
    return start["n"], books


def digest(books: list[Codebook]) -> str:
    return hashlib.sha256(",".join(str(int(x)) for b in books for x in b.entries.flat).encode()).hexdigest()


def encode(rows: DataFrame, length: int, books: list[Codebook], keep: list[str], vector: str = "embedding") -> DataFrame:
    """The columns keep, code (two hex digits for each part) and error of every usable row."""

    def run(batches):
        for batch in (s for b in batches for s in slices(b, length)):
            found = [(index, error) for _, index, error in codes(batch.column(len(keep)), length, books)]
            text = [bytes(c).hex() for c in np.stack([i for i, _ in found], 1).astype(np.uint8)]
            error = [min(int(e), LONG) for e in sum((e.astype(object) for _, e in found), np.zeros(batch.num_rows, object))]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keep))), pa.array(text, pa.string()), pa.array(error, pa.int64())], [*keep, "code", "error"])

    same = usable(rows, vector).filter(F.size(vector) == length).select(*keep, F.col(vector))
    return same.mapInArrow(run, same.select(*keep).withColumns({"code": F.lit(""), "error": F.lit(0).cast("long")}).schema)


def with_label_error(spark: SparkSession, coded: DataFrame) -> DataFrame:
    """coded (vec_id, label, code, error) with label_error, the error of all rows of the label.

    Rows meet the total of their label by label and salt, so a label of very many rows is not one task's.
    """
    salt = F.pmod(F.xxhash64("vec_id", "code"), F.lit(SALTS))
    rows = coded.withColumns({"salt": salt, "unlabelled": F.col("label").isNull(), "label": F.coalesce("label", F.lit(0))})
    parts = rows.groupBy("unlabelled", "label", "salt").agg(F.sum(F.col("error").cast("decimal(38,0)")).alias("part"))
    whole = parts.groupBy("unlabelled", "label").agg(F.least(F.sum("part"), F.lit(LONG).cast("decimal(38,0)")).cast("long").alias("label_error"))
    return rows.join(parts.drop("part").join(whole, ["unlabelled", "label"]), ["unlabelled", "label", "salt"]).select("vec_id", "code", "error", "label_error")


def code_vectors(spark: SparkSession, rows: DataFrame) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 of every usable row of embeddings."""
    length, books = train(spark, rows)
    if length is None:
        return spark.createDataFrame([], "vec_id long, code string, error long, label_error long, codebooks_sha256 string")
    coded = materialise(spark, encode(rows, length, books, ["vec_id", "label"]), "codes")
    return with_label_error(spark, coded).withColumn("codebooks_sha256", F.lit(digest(books)))


def oracle() -> str:
    """DuckDB SQL of code_vectors, for vectors of one length that PARTS divides."""
    near = lambda book: f"""select r, p, part, arg_min(e, (d, e)) as e, min(d) as d from (
    select r, p, part, e, list_sum(list_transform(list_zip(part, entry), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::bigint as d from parts join {book} using (p)) group by r, p, part"""  # noqa: E731
    rounds = "".join(
        f"""
  near{k} as ({near(f"book{k}")}),
  mean{k} as (select p, e, list(m order by place) as entry from (select p, e, place, floor(sum(x)::hugeint / count(*))::bigint as m from (select p, e, unnest(part) as x, unnest(range(len(part))) as place from near{k}) group by p, e, place) group by p, e),
  book{k + 1} as (select p, e, coalesce(m.entry, b.entry) as entry from book{k} b left join mean{k} m using (p, e)),"""
        for k in range(ROUNDS)
    )
    return f"""
with kept as (select row_number() over (order by vec_id nulls last, embedding) - 1 as r, vec_id, label, list_transform(embedding, lambda x: floor(x::double * {SCALE})::bigint) as v from embeddings
    where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
  parts as (select r, p, v[p * (len(v) // {PARTS}) + 1 : (p + 1) * (len(v) // {PARTS})] as part from kept, range({PARTS}) t(p)),
  book0 as (select p, r as e, part as entry from parts where r < {ENTRIES}),{rounds}
  final as ({near(f"book{ROUNDS}")}),
  coded as (select r, string_agg(printf('%02x', e), '' order by p) as code, sum(d)::bigint as error from final group by r),
  digest as (select sha256(string_agg(x::varchar, ',' order by p, e, place)) as h from (select p, e, unnest(entry) as x, unnest(range(len(entry))) as place from book{ROUNDS}))
select vec_id, code, error, sum(error) over (partition by label)::bigint as label_error, h as codebooks_sha256 from coded join kept using (r) cross join digest
"""
