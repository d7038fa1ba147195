"""Whole texts in blocks, and seeded exchanges between blocks and shards.

Repeated windows (35 words, or 50 bytes) are found without any task holding the corpus: every window picks an anchor,
the run of k values with the least hash inside it, so equal windows pick equal anchors and meet in the shard that owns
the anchor's hash. First only anchor hashes are exchanged, 6 bytes each, once for each block that has them; shards
answer with one bit: whether the anchor stands elsewhere too. Only the surroundings of anchors that repeat travel in a
second exchange, put together inside each block, and shards answer about each. What an anchor found in every block
brings to its shard is one entry for each block, however often it stands there.

The number of shards follows the bytes of the corpus, so a shard's share stays the same at any size. A message holds at
least one key, so messages never number more than keys.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import U, chunks, gram_hash, materialise, mix, sorted_groups, string_buffers, trim

BLOCK_BYTES = 2 << 20
#: Bytes of text for each shard.
SHARD_BYTES = 16 << 20
KEY_BITS = 48
#: A text in an Arrow column has less than 2^31 bytes, so every place fits.
_PLACE_BITS = 31


def pack_body(ids: np.ndarray, valid: np.ndarray, data: np.ndarray, offs: np.ndarray) -> bytes:
    head = np.array([len(ids)], np.int64).tobytes() + ids.astype(np.int64).tobytes() + offs.astype(np.int64).tobytes() + valid.astype(np.uint8).tobytes()
    return zstandard.ZstdCompressor(level=3).compress(head + data.tobytes())


class Block:
    """Rows of one block: ids, valid (false: null id), data (UTF-8 bytes of all texts) and offs."""

    def __init__(self, body: bytes):
        raw = zstandard.ZstdDecompressor().decompress(body)
        n = int(np.frombuffer(raw, np.int64, 1)[0])
        self.ids = np.frombuffer(raw, np.int64, n, 8)
        self.offs = np.frombuffer(raw, np.int64, n + 1, 8 + 8 * n)
        self.valid = np.frombuffer(raw, np.uint8, n, 16 + 16 * n) > 0
        self.data = np.frombuffer(raw, np.uint8, -1, 16 + 17 * n)


def make_blocks(spark: SparkSession, docs: DataFrame, size: int | None = None) -> DataFrame:
    """block, n_bytes, body: the documents (doc_id, text) in blocks of about `size` bytes (BLOCK_BYTES), written once so that numbers stay."""

    limit = size or BLOCK_BYTES

    def run(batches):
        part, k = TaskContext.get().partitionId(), 0
        for batch in batches:
            data, offs = string_buffers(batch.column(1))
            ids = batch.column(0)
            valid = np.asarray(ids.is_valid())
            ids = ids.fill_null(0).to_numpy(zero_copy_only=False)
            for a, b in chunks(offs, limit):
                body = pack_body(ids[a:b], valid[a:b], data[offs[a] : offs[b]], offs[a : b + 1] - offs[a])
                yield pa.RecordBatch.from_arrays([pa.array([part << 32 | k], pa.int64()), pa.array([int(offs[b] - offs[a])], pa.int64()), pa.array([body], pa.binary())], ["block", "n_bytes", "body"])
                k += 1

    return materialise(spark, docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "block long, n_bytes long, body binary"), "blocks")


def shard_count(blocks: DataFrame, size: int | None = None) -> int:
    return max(8, (blocks.agg(F.sum("n_bytes")).first()[0] or 0) // (size or SHARD_BYTES) + 1)


class Anchors:
    """The anchors of the windows of `size` values inside each row: key, place, and first and last window that picked it."""

    def __init__(self, values: np.ndarray, before: np.ndarray, size: int, k: int):
        grams = gram_hash(values, k)
        n, w = len(values) - size + 1, size - k + 1
        self.size = size
        if n <= 0:
            self.key = self.place = self.low = self.high = np.zeros(0, np.int64)
            self.key = self.key.astype(np.uint64)
        else:
            x = (grams >> U(_PLACE_BITS) << U(_PLACE_BITS)) | np.arange(len(grams), dtype=np.uint64)
            span = 1
            while span < w:
                step = min(span, w - span)
                x = np.minimum(x[:-step], x[step:])
                span += step
            at = (x & U((1 << _PLACE_BITS) - 1)).astype(np.int64)
            good = np.ones(n, bool)
            for cut in before[1:-1]:
                good[max(0, cut - size + 1) : min(cut, n)] = False
            new = np.ones(n, bool)
            new[1:] = (at[1:] != at[:-1]) | ~good[:-1]
            first = np.flatnonzero(new & good)
            last_change = new.copy()
            last_change[:-1] = new[1:] | ~good[1:]
            last_change[-1] = True
            self.low, self.high = first, np.flatnonzero(last_change & good)
            self.place = at[first]
            # Anchors have small hashes, being the least of their windows: mixed once more, their keys spread over all shards.
            self.key = mix(grams[self.place]) >> U(64 - KEY_BITS)
        self.row = np.searchsorted(before, self.low, "right") - 1
        self.keys, self.which, self.times = np.unique(self.key, return_inverse=True, return_counts=True)

    def shard_slices(self, shards: int):
        """(shard, first, last) of the sorted keys."""
        owner = ((self.keys >> U(16)) * U(shards)) >> U(KEY_BITS - 16)
        for s, a, b in zip(*_runs(owner), strict=True):
            yield int(s), int(a), int(b)

    def repeated(self, bits: dict[int, bytes], shards: int) -> np.ndarray:
        """Which keys stand more than once in the corpus."""
        out = self.times > 1
        for s, a, b in self.shard_slices(shards):
            if s in bits:
                out[a:b] |= np.unpackbits(np.frombuffer(bits[s], np.uint8), count=b - a).astype(bool)
        return out


def _runs(x: np.ndarray):
    first = np.flatnonzero(np.append(True, x[1:] != x[:-1])) if len(x) else np.zeros(0, np.int64)
    return x[first], first, np.append(first, len(x))[1:]


def _message(rows: list[tuple[int, int, bytes]], names=("shard", "block", "payload")) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) or [(), (), ()]
    return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.binary())], list(names))


MESSAGE = "shard long, block long, payload binary"


def send_keys(blocks: DataFrame, anchors, shards: int) -> DataFrame:
    """anchors(Block) -> Anchors. A message for each block and shard: the gaps of the block's sorted keys of that shard."""

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                found = anchors(Block(batch.column(1)[i].as_py()))
                yield _message([(s, batch.column(0)[i].as_py(), dump(sorted_planes(found.keys[a:b]))) for s, a, b in found.shard_slices(shards)])
                del found
            trim()

    return blocks.select("block", "body").mapInArrow(run, MESSAGE)


def at_shards(messages: DataFrame, answer) -> DataFrame:
    """answer(list of payloads in block order) -> list of payloads (or None), for all messages of a shard; they go back to their blocks."""

    def run(batches):
        for group in sorted_groups(batches, 1):
            shard = group.column("shard")[0].as_py()
            back = answer(group.column("payload").to_pylist())
            trim()
            yield _message([(shard, b, p) for b, p in zip(group.column("block").to_pylist(), back, strict=True) if p is not None])

    return messages.repartition("shard").sortWithinPartitions("shard", "block").mapInArrow(run, MESSAGE)


def repeated_bits(payloads: list[bytes]) -> list[bytes | None]:
    """For each block's keys, a bit: another block has it."""
    parts = [from_planes(undump(p)[0]) for p in payloads]
    keys = np.concatenate(parts)
    order = np.argsort(keys)
    ranked = keys[order]
    same = np.zeros(len(keys) + 1, bool)
    same[1:-1] = ranked[1:] == ranked[:-1]
    bits = np.zeros(len(keys), bool)
    bits[order] = same[1:] | same[:-1]
    out, at = [], 0
    for p in parts:
        part = bits[at : at + len(p)]
        out.append(np.packbits(part).tobytes() if part.any() else None)
        at += len(p)
    return out


def at_blocks(blocks: DataFrame, messages: list[DataFrame], run, schema: str) -> DataFrame:
    """run(Block, [payloads of each message table by shard]) -> list of tuples of schema, for every block with all that came back to it."""
    sent = None
    for k, m in enumerate(messages):
        m = m.select("block", "shard", "payload", F.lit(k).alias("kind"))
        sent = m if sent is None else sent.unionByName(m)
    names = [x.split()[0] for x in schema.split(", ")]
    kinds = {"long": pa.int64(), "binary": pa.binary(), "string": pa.string(), "double": pa.float64(), "boolean": pa.bool_()}
    types = [kinds[x.split()[1]] for x in schema.split(", ")]
    n = len(messages)

    def both(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        if left.num_rows:
            parts: list[dict[int, bytes]] = [{} for _ in range(n)]
            for s, p, k in zip(right.column("shard").to_pylist(), right.column("payload").to_pylist(), right.column("kind").to_pylist(), strict=True):
                parts[k][s] = p
            block = Block(left.column("body")[0].as_py())
            block.number = left.column("block")[0].as_py()
            out = run(block, parts)
            trim()
        cols = list(zip(*out, strict=True)) or [()] * len(names)
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names)

    return blocks.select("block", "body").groupBy("block").cogroup(sent.groupBy("block")).applyInArrow(both, schema)


def small(x: np.ndarray) -> np.ndarray:
    """Whole numbers in the narrowest type that holds them."""
    if not len(x.reshape(-1)):
        return x.astype(np.int8)
    low, high = int(x.min()), int(x.max())
    return x.astype(next(t for t in (np.uint8, np.int8, np.uint16, np.int16, np.int32, np.int64) if np.iinfo(t).min <= low and high <= np.iinfo(t).max))


def sorted_planes(x: np.ndarray) -> np.ndarray:
    """Gaps of sorted 64-bit numbers, byte by byte, so that leading zeros stand together."""
    return np.ascontiguousarray(np.diff(x, prepend=U(0)).view(np.uint8).reshape(-1, 8).T)


def from_planes(planes: np.ndarray) -> np.ndarray:
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint64).reshape(-1), dtype=np.uint64)


def dump(*arrays) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(pickle.dumps(arrays, 5))


def undump(payload: bytes) -> tuple:
    return pickle.loads(zstandard.ZstdDecompressor().decompress(payload))
