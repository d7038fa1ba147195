"""Jaccard join of word n-gram sets: size-banded tiles, hashed bitmaps that bound overlaps, exact intersections.

A document's set is its distinct shingles of WORDS words, as 64-bit hashes. Sets link when their Jaccard index is at least
PERCENT hundredths; equal sets are put together first and enter the join once, by the least doc_id.

Tiles. Tile t is for pairs whose smaller set has 2^t to 2^(t+1) - 1 elements: sets of that size, and larger ones that may
still link with them. In a tile, elements are dealt by a hash over a fixed number of parts. Linked sets differ in at most
H elements (a bound from the size and PERCENT), hence in at most H parts, so they have the same content in all others; of
these, the one that comes first in any order that depends on content alone is among the first H + 1 parts of both. Each
set sends the hashes of its first H + 1 parts, so no link is lost, whatever the order; the order puts parts first that say
most (the sum of log2(documents / count) of their elements, by a table of counts of fixed size over all documents), so
that a passage in very many documents does not bring these together. Sets that share a part are candidates.

In a group of candidates, sets are sorted by size, and each has a bitmap with BITS bits for each element of its band's least
size. The bits of one bitmap that another lacks are at least so many elements that it lacks: this bounds the overlap from
above. Only pairs whose bound reaches what their sizes need are intersected, as sorted arrays. Classes are connected
components, and a set is tested against all others of its group unless it is in the largest class: of a link between two
classes one end is outside it, so none is lost. Larger groups are cut in chunks, as in near-duplicates.

Defined cases: texts with fewer than WORDS words are one shingle; null texts and texts without words have empty sets and
are linked with nothing; a null doc_id has a null component; rows with the same doc_id are one document that has the links
of all its texts, and only its rows without words stay alone; a tie at exactly PERCENT links; an empty table has no rows. Other columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import U, chunks, components, materialise, mix, string_buffers
from .dartminhash import exact_members, shingles, weigh

WORDS, PERCENT = 4, 85
#: Slots of the table of counts, and blocks in which it is summed up.
SLOTS, BLOCKS = 1 << 20, 64
#: Parts of a tile for each element of its largest sets, and at least so many.
SHARE, LEAST_PARTS = 0.22, 16
BITS = 4
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def sets_of(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of each of concatenated rows, sorted by row and value, and their rows."""
    values, row, _ = weigh(*shingles(_LOWER[data], offs, WORDS))
    return values, row


def slot(values: np.ndarray) -> np.ndarray:
    return (values >> U(44)).astype(np.int64)


def rarity(spark: SparkSession, docs: DataFrame) -> np.ndarray:
    """How many bits an element of each slot tells, in eighths: log2(documents / count of the slot). SLOTS bytes, whatever the size of docs."""

    def count(batches):
        table, n = np.zeros(SLOTS, np.int64), 0
        for batch in batches:
            data, offs = string_buffers(batch.column(0))
            for a, b in chunks(offs):
                values, row = sets_of(data[offs[a] : offs[b]], offs[a : b + 1] - offs[a])
                table += np.bincount(slot(values), minlength=SLOTS)
                n += len(np.unique(row))
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(range(BLOCKS), pa.int32()), pa.array([n] * BLOCKS, pa.int64()), pa.array([t.tobytes() for t in np.split(table, BLOCKS)], pa.binary())], ["block", "n", "counts"])

    def total(batches):
        tables: dict[int, list] = {}
        for batch in batches:
            for k, n, c in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                old = tables.setdefault(k, [0, 0])
                old[0], old[1] = old[0] + n, old[1] + np.frombuffer(c, np.int64)
        for k, (n, t) in tables.items():
            bits = np.clip(np.round(8 * np.log2(n / np.maximum(t, 1))), 1, 255).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([bits.tobytes()], pa.binary())], ["block", "bits"])

    counted = docs.select("text").mapInArrow(count, "block int, n long, counts binary").repartition(BLOCKS, "block").mapInArrow(total, "block int, bits binary")
    out = np.full((BLOCKS, SLOTS // BLOCKS), 255, np.uint8)
    for r in counted.collect():  # BLOCKS rows of SLOTS / BLOCKS bytes
        out[r["block"]] = np.frombuffer(r["bits"], np.uint8)
    return out.reshape(-1)


def differing(size: np.ndarray) -> np.ndarray:
    """In how many elements, both sides together, a set can differ from a linked one."""
    return size * (100 - PERCENT) // PERCENT


def tile_parts(tile: np.ndarray) -> np.ndarray:
    return np.maximum(LEAST_PARTS, np.ceil(SHARE * 2.0 ** (tile + 1)).astype(np.int64) + 1)


def part_keys(values: np.ndarray, row: np.ndarray, size: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys that the sets send (values sorted by row), and their rows, in order of rows."""
    own = np.floor(np.log2(np.maximum(size, 1))).astype(np.int64)
    low = np.left_shift(1, own)
    keys, rows = [], []
    # A set is in the tile of its size, and in the one below while sets of that one are large enough for it.
    for tile, inside in ((own, size > 0), (own - 1, (size > 1) & (100 * (low - 1) >= PERCENT * size))):
        most = np.minimum(differing(size), differing(np.left_shift(2, np.maximum(tile, 0)) - 1))
        inside &= most > 0  # without a difference only equal sets are linked
        if not inside.any():
            continue
        parts = np.where(inside, tile_parts(tile), 0)
        start = np.cumsum(parts) - parts
        on = inside[row]
        v, r = values[on], row[on]
        place = start[r] + ((mix(v + U(0x51ED270B153A4D2F)) >> U(32)) * parts[r].astype(np.uint64) >> U(32)).astype(np.int64)
        n = int(parts.sum())
        content, weight = np.zeros(n, np.uint64), np.bincount(place, bits[slot(v)], n).astype(np.int64)
        np.add.at(content, place, mix(v ^ U(0xC2B2AE3D27D4EB4F)))
        of = np.repeat(np.arange(len(size)), parts)
        number = np.arange(n) - start[of]
        key = mix(content + mix((tile[of] * (1 << 40) + number).astype(np.uint64) + U(0x9E3779B97F4A7C15)))
        packed = (of.astype(np.uint64) << U(44)) | (U(4095) - np.minimum(weight, 4095).astype(np.uint64) << U(32)) | (key >> U(32))
        order = np.argsort(packed)
        if len(size) > 1 << 20 or (packed[order[1:]] == packed[order[:-1]]).any() or weight.max() > 4095:
            order = np.lexsort((key, -weight, of))
        first = np.arange(n) - start[of] <= most[of]  # rows keep their places in the order
        keys.append(key[order[first]])
        rows.append(of[first])
    if not keys:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    keys, rows = np.concatenate(keys), np.concatenate(rows)
    order = np.argsort(rows, kind="stable")
    return keys[order], rows[order]


def profiles(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, set_key (MD5 of the set; null if it is empty), keys."""
    told = spark.sparkContext.broadcast(rarity(spark, docs).tobytes())

    def run(batches):
        bits = np.frombuffer(told.value, np.uint8)
        for batch in batches:
            data, offs = string_buffers(batch.column(1))
            for a, b in chunks(offs):
                values, row = sets_of(data[offs[a] : offs[b]], offs[a : b + 1] - offs[a])
                size = np.bincount(row, minlength=b - a)
                ends = np.cumsum(size)
                raw = values.tobytes()
                named = [hashlib.md5(raw[8 * (e - s) : 8 * e]).digest() if s else None for s, e in zip(size.tolist(), ends.tolist(), strict=True)]
                keys, at = part_keys(values, row, size, bits)
                lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(at, np.arange(b - a + 1)), pa.int32()), pa.array(keys.view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(size, pa.int64()), pa.array(named, pa.binary()), lists], ["doc_id", "n_shingles", "set_key", "keys"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_shingles long, set_key binary, keys array<long>")


def shared_keys(unique: DataFrame) -> DataFrame:
    """key, rep, least: the keys that several sets have, with the least of these."""

    def run(batches):
        last, low, told = None, 0, False
        for batch in batches:
            keys, reps = (batch.column(i).to_numpy() for i in range(2))
            if not len(keys):
                continue
            first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
            count, start = np.diff(np.append(first, len(keys))), reps[first]
            goes_on = last is not None and keys[0] == last
            if goes_on:
                start[0] = low
            least = np.repeat(start, count)
            more = reps > least
            several = np.add.reduceat(more, first, dtype=np.int64) > 0
            heads = several.copy()
            heads[0] &= not (goes_on and told)  # a key's least set is told once
            own = keys[first]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x), pa.int64()) for x in ((keys[more], own[heads]), (reps[more], start[heads]), (least[more], start[heads]))], ["key", "rep", "least"])
            last, low, told = keys[-1], start[-1], bool(several[-1]) or (goes_on and told and len(first) == 1)

    return unique.select(F.explode("keys").alias("key"), "rep").repartition("key").sortWithinPartitions("key", "rep").mapInArrow(run, "key long, rep long, least long")


class Tiles:
    """Exact links within a group of texts: bitmaps by size band, then intersections of sorted arrays."""

    def __init__(self, texts) -> None:
        data, offs = string_buffers(texts)
        values, row = sets_of(data, offs)
        self.size = np.bincount(row, minlength=len(texts))
        self.ends = np.cumsum(self.size)
        self.values, self.row = values, row
        self.order = np.argsort(self.size, kind="stable")
        self.sorted, self.place = self.size[self.order], np.argsort(self.order)
        self.maps: dict[int, np.ndarray] = {}

    def bitmaps(self, band: int) -> np.ndarray:
        """Bitmaps of the sets of a band's tile, in order of size, from the first that has at least 2^band elements."""
        if band not in self.maps:
            a, b = self.tile(band)
            width = max(64, BITS << band)
            place = np.full(len(self.size), -1)
            place[self.order[a:b]] = np.arange(b - a)
            at = place[self.row]
            on = at >= 0
            bits = np.zeros((b - a, width), bool)
            bits[at[on], (mix(self.values[on] ^ U(0xA0761D6478BD642F)) & U(width - 1)).astype(np.int64)] = True
            self.maps[band] = np.packbits(bits, axis=1).view(np.uint64)
        return self.maps[band]

    def tile(self, band: int) -> tuple[int, int]:
        """Places, in order of size, of the sets in a band's tile."""
        high = ((2 << band) - 1) * 100 // PERCENT
        return int(np.searchsorted(self.sorted, 1 << band)), int(np.searchsorted(self.sorted, high, "right"))

    def linked(self, p: int, skip: np.ndarray | None = None) -> tuple[np.ndarray, int]:
        """The sets that link with set p, without those to skip, and how many its bitmaps let through."""
        size, found, passed = int(self.size[p]), [], 0
        if size == 0:
            return np.zeros(0, np.int64), 0
        own = self.values[self.ends[p] - size : self.ends[p]]
        band = size.bit_length() - 1
        for b in (band, band - 1)[: 2 if band else 1]:
            a, z = self.tile(b)
            least, most = -(-PERCENT * size // 100), size * 100 // PERCENT
            if b < band:  # the smaller set decides on the tile: here it is the other one
                if size > ((2 << b) - 1) * 100 // PERCENT:
                    continue
                most = (2 << b) - 1
            else:
                least = max(least, 1 << b)
            x, y = max(a, int(np.searchsorted(self.sorted, least))), min(z, int(np.searchsorted(self.sorted, most, "right")))
            if x >= y:
                continue
            maps = self.bitmaps(b)
            mine = maps[self.place[p] - a]
            others, theirs, sizes = self.order[x:y], maps[x - a : y - a], self.sorted[x:y]
            most_shared = np.minimum(size - np.bitwise_count(mine & ~theirs).sum(1, dtype=np.int64), sizes - np.bitwise_count(theirs & ~mine).sum(1, dtype=np.int64))
            able = (100 + PERCENT) * most_shared >= PERCENT * (size + sizes)
            passed += int(able.sum())
            if skip is not None:
                able &= ~skip[others]
            others = others[able]
            if len(others):
                count = self.size[others]
                first = np.cumsum(count) - count
                elements = self.values[np.arange(count.sum()) + np.repeat(self.ends[others] - count - first, count)]
                at = np.searchsorted(own, elements)
                shared = np.add.reduceat((own[np.minimum(at, size - 1)] == elements).astype(np.int64), first)
                found.append(others[100 * shared >= PERCENT * (size + count - shared)])
        return np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64), passed

    def central(self) -> np.ndarray:
        """The sets in order of how common their elements are, most common first."""
        _, flat, df = np.unique(self.values, return_inverse=True, return_counts=True)
        return np.argsort(-np.bincount(self.row, df[flat], len(self.size)) / np.maximum(self.size, 1), kind="stable")


class Jaccard:
    """Exact links by the Jaccard index of sets, between texts."""

    @staticmethod
    def classes(ids: np.ndarray, texts) -> tuple[np.ndarray, np.ndarray]:
        n, tiles = len(ids), Tiles(texts)
        _, label = np.unique(ids, return_inverse=True)  # texts of one document are one
        links, tested, order = np.zeros(n, np.int64), np.zeros(n, bool), tiles.central()
        while True:
            largest = np.argmax(np.bincount(label, minlength=n))
            todo = ~tested & (label != largest) if tested.any() else ~tested
            if not todo.any():
                return label, links
            p = int(order[np.argmax(todo[order])])
            tested[p] = True
            like, links[p] = tiles.linked(p, label == label[p])
            joined = np.unique(np.append(label[like], label[p]))
            label[np.isin(label, joined)] = joined[0]

    @staticmethod
    def outside(label: np.ndarray, asks: np.ndarray, texts) -> set[tuple[int, int]]:
        tiles, label, out = Tiles(texts), label.copy(), set()
        for p in asks:
            joined = np.unique(np.append(label[tiles.linked(int(p), label == label[p])[0]], label[p]))
            if len(joined) > 1:
                out.update((int(joined[0]), int(j)) for j in joined[1:])
                label[np.isin(label, joined)] = joined[0]
        return out


def join_components(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id (the least doc_id that links lead to): a row for each row of docs."""
    known = materialise(spark, profiles(spark, docs), "profiles")
    unique = known.filter("set_key is not null and doc_id is not null").groupBy("set_key").agg(F.min("doc_id").alias("rep"), F.first("keys").alias("keys"))
    unique = materialise(spark, unique, "unique")
    shared = materialise(spark, shared_keys(unique), "shared")
    member = components(spark, shared.filter("rep > least").select(F.col("least").alias("a"), F.col("rep").alias("b")).distinct()).select("component", F.col("node").alias("rep"))
    own = exact_members(spark, member, shared, docs, Jaccard)
    sets = materialise(spark, unique.select("set_key", "rep").join(own, "rep", "left").select("set_key", "rep", F.coalesce("class", "rep").alias("class")), "sets")
    placed = known.filter("set_key is not null and doc_id is not null").select("doc_id", "n_shingles", "set_key").join(sets.select("set_key", F.col("class").alias("component_id")), "set_key").drop("set_key")
    # A document with several texts joins what these are linked with.
    several = materialise(spark, placed.groupBy("doc_id").agg(F.min("component_id").alias("a"), F.max("component_id").alias("b")).filter("a < b").select("a", "b"), "several")
    if several.limit(1).count():
        top = components(spark, several).select(F.col("node").alias("component_id"), F.col("component").alias("top"))
        placed = placed.join(top, "component_id", "left").select("doc_id", "n_shingles", F.coalesce("top", "component_id").alias("component_id"))
    alone = known.filter("set_key is null or doc_id is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return placed.select("doc_id", "n_shingles", "component_id").union(alone)
