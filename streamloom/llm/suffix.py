"""Repeated byte strings, by a distributed merge sort of suffixes that never compares a known common prefix again.

Every byte covered by a WINDOW-byte string that also starts in a document with a smaller doc_id is removed.

The suffixes sorted are those that start at repeated anchors (see blocks.py), as far as the windows that picked the
anchor reach, followed by what of these windows stands before the anchor (read backwards) and both lengths, padded to
WIDTH bytes. A block sends each shard a sorted run, front-coded: how many bytes a suffix shares with the one before it,
and the rest. A loser tree merges the runs of a shard. Each head carries the length of its common prefix with the last
suffix given out, so a match is decided by these lengths alone unless they are equal, and then bytes are compared from
there on; the prefix length of a run's next head is the front code itself. Equal suffixes come out together and give
the least doc_id of their whole surroundings. Where an anchor's surroundings differ, the windows inside them are looked
up by content, those of one distance from the anchor at a time.

A shard holds its front-coded runs, an answer for each suffix in packed arrays, and the different suffixes of the
anchor that is being merged; a run's answers come in its own order, so they are only ever appended.

Defined cases: null texts are empty; texts under WINDOW bytes are kept; rows with equal doc_ids don't remove each
other; nothing is removed from, or by, rows with a null doc_id; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from array import array

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from . import blocks as B
from .common import byte_values, materialise

WINDOW = 50
SEED = 16
#: What may stand before an anchor inside a window, and the width of a suffix with both parts and their lengths.
LEFT = WINDOW - SEED
WIDTH = WINDOW + LEFT + 2
_NULL = np.iinfo(np.int64).max


def common_prefix(a: bytes, b: bytes, start: int) -> int:
    """Length of the common prefix, known to be start at least."""
    n = min(len(a), len(b))
    x = int.from_bytes(a[start:n], "big") ^ int.from_bytes(b[start:n], "big")
    return n - (x.bit_length() + 7) // 8


def front_code(rows: np.ndarray) -> tuple[np.ndarray, bytes]:
    """Lengths shared with the row before, and the rests, of sorted rows of equal width."""
    n, width = rows.shape
    shared = np.zeros(n, np.uint8)
    if n > 1:
        differ = rows[1:] != rows[:-1]
        shared[1:] = np.where(differ.any(1), differ.argmax(1), width)
    return shared, rows[np.arange(width) >= shared[:, None]].tobytes()


def merge(runs: list[tuple[np.ndarray, bytes]], width: int):
    """Merge front-coded runs (shared, rests) of keys of equal width: yield (key, common prefix with the key before, run) in order, equal keys one after another.

    A loser tree: head[r] is the next key of run r, and near[r] how much of it is known to be shared with the last key
    given out (-1 at the end of the run). Of two heads the one that shares more comes first; only heads that share the
    same are compared, from there on.
    """
    n = len(runs)
    k = 1 << max(0, (n - 1).bit_length())
    code, rest = [x[0].tobytes() for x in runs], [x[1] for x in runs]
    end, at, i = [len(c) for c in code], [width] * n, [1] * n
    # The first key of each run is whole.
    head = [r[:width] for r in rest] + [b""] * (k - n)
    near = [0 if e else -1 for e in end] + [-1] * (k - n)
    losers = [0] * k

    def play(a: int, b: int) -> tuple[int, int]:
        """Winner and loser; the loser's near becomes its common prefix with the winner."""
        if near[a] != near[b]:
            return (a, b) if near[a] > near[b] else (b, a)
        if near[a] < 0:
            return a, b
        x, y, m = head[a], head[b], near[a]
        if m == width or x == y:
            w, lose = (a, b) if a < b else (b, a)
            near[lose] = width
            return w, lose
        if x[m] == y[m]:
            m = common_prefix(x, y, m)
        w, lose = (a, b) if x[m] < y[m] else (b, a)
        near[lose] = m
        return w, lose

    winners = [0] * k + list(range(k))
    for j in range(k - 1, 0, -1):
        winners[j], losers[j] = play(winners[2 * j], winners[2 * j + 1])
    top = winners[1] if k > 1 else 0
    while near[top] >= 0:
        yield head[top], near[top], top
        j = i[top]
        if j == end[top]:
            mine = near[top] = -1
        else:
            i[top] = j + 1
            mine = near[top] = code[top][j]
            x = at[top]
            at[top] = y = x + width - mine
            head[top] = head[top][:mine] + rest[top][x:y]
        j = (top + k) >> 1
        while j:
            other = losers[j]
            its = near[other]
            if its > mine:
                losers[j], top, mine = top, other, its
            elif its == mine and mine >= 0:
                if mine < width:
                    top, losers[j] = play(top, other)
                    mine = near[top]
                elif other < top:
                    # Both are equal to the last key.
                    losers[j], top = top, other
            j >>= 1


def least_of_windows(keys: list[bytes], docs: list[int], near: list[int]) -> list[list[int]]:
    """For different suffixes of one anchor, in order: the least doc_id of each of their windows, in order of window starts (one value if it is the same for all).

    near: how much each shares with the one before. A window that starts j bytes before the anchor takes WINDOW - j bytes
    from there on, so a suffix can share it only if its neighbours in order share so much; the others are its own.
    """
    low, high = [], []
    for i, k in enumerate(keys):
        p = max(near[i] if i else 0, near[i + 1] if i + 1 < len(keys) else 0)
        low.append(WINDOW - min(p, k[-2]))
        high.append(k[-1])
    out: list[list[int]] = [[d] for d in docs]
    live = [i for i in range(len(keys)) if low[i] <= high[i]]
    if len(live) < 2:
        return out
    for j in range(min(low[i] for i in live), max(high[i] for i in live) + 1):
        first: dict[bytes, int] = {}
        have = [(i, keys[i][: WINDOW - j] + keys[i][WINDOW : WINDOW + j]) for i in live if low[i] <= j <= high[i]]
        for i, w in have:
            if first.get(w, _NULL) > docs[i]:
                first[w] = docs[i]
        if len(first) < len(have):
            for i, w in have:
                if first.get(w, _NULL) < docs[i]:
                    k = keys[i]
                    if len(out[i]) == 1:
                        out[i] = out[i] * (k[-2] + k[-1] - WINDOW + 1)
                    out[i][k[-1] - j if len(out[i]) > 1 else 0] = first[w]
    return [w[:1] if w[0] == w[-1] and len(set(w)) == 1 else w for w in out]


def answer_runs(payloads: list[bytes]) -> list[bytes]:
    """For each block's suffixes, how many values, and the least doc_id of each window (one value if it is the same for all)."""
    runs, least = [], []
    for p in payloads:
        shared, rest, docs = B.undump(p)
        runs.append((shared, rest))
        least.append(iter(array("q", docs.astype(np.int64).tobytes())))
    sizes, values = [bytearray() for _ in runs], [array("q") for _ in runs]
    # The suffixes of the current anchor: the different ones, their least doc_ids, and (run, which of them) in order.
    keys: list[bytes] = []
    docs: list[int] = []
    near: list[int] = []
    owner, which = array("q"), array("q")

    def flush() -> None:
        if len(keys) == 1:
            doc = docs[0]
            for r in owner:
                sizes[r].append(1)
                values[r].append(doc)
            return
        packed = [(len(w), array("q", w)) for w in least_of_windows(keys, docs, near)]
        for r, k in zip(owner, which, strict=True):
            n, w = packed[k]
            sizes[r].append(n)
            values[r].extend(w)

    for key, shared, r in merge(runs, WIDTH):
        doc = next(least[r])
        if shared < SEED and keys:
            flush()
            keys, docs, near, owner, which = [], [], [], array("q"), array("q")
        if shared == WIDTH:
            if doc < docs[-1]:
                docs[-1] = doc
        else:
            keys.append(key)
            docs.append(doc)
            near.append(shared)
        owner.append(r)
        which.append(len(keys) - 1)
    if keys:
        flush()
    return [B.dump(np.frombuffer(n, np.uint8), np.frombuffer(v, np.int64)) for n, v in zip(sizes, values, strict=True)]


def byte_anchors(block: B.Block) -> B.Anchors:
    return B.Anchors(byte_values(block.data), block.offs, WINDOW, SEED)


def surroundings(block: B.Block, found: B.Anchors, again: np.ndarray, shards: int):
    """Repeated anchors by shard and suffix: their numbers, the row of each among the different suffixes, those as rows of WIDTH bytes, and (shard, first, last) of the rows."""
    owner = np.zeros(len(found.keys), np.int64)
    for s, a, b in found.shard_slices(shards):
        owner[a:b] = s
    at = np.flatnonzero(again[found.which])
    shard = owner[found.which[at]]
    place, left = found.place[at], (found.place - found.low)[at]
    right = (found.high + WINDOW - found.place)[at]
    # The shard number, first byte first, then the suffix: byte strings of one width, in the order of their bytes.
    rows = np.zeros((len(at), 8 + WIDTH), np.uint8)
    rows[:, :8] = shard.astype(">u8").view(np.uint8).reshape(-1, 8)
    data = np.concatenate([block.data, np.zeros(WINDOW, np.uint8)])
    for j in range(WINDOW):
        rows[:, 8 + j] = data[place + j] if j < SEED else np.where(j < right, data[place + j], 0)
    for j in range(LEFT):
        rows[:, 8 + WINDOW + j] = np.where(j < left, data[place - 1 - j], 0)
    rows[:, -2], rows[:, -1] = right, left
    order = np.argsort(rows.view(f"S{8 + WIDTH}").reshape(-1))
    at, rows = at[order], rows[order]
    new = np.ones(len(at), bool)
    new[1:] = (rows[1:] != rows[:-1]).any(1)
    shard, rows = shard[order], rows[:, 8:]
    number = np.cumsum(new) - 1
    return at, number, rows[new], [(int(s), int(a), int(b)) for s, a, b in zip(*B._runs(shard[new]), strict=True)]


RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"


def remove_repeats(spark: SparkSession, docs: DataFrame, with_text: bool = True) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, if asked for, kept: a row for each document."""
    blocks = B.make_blocks(spark, docs)
    shards = B.shard_count(blocks)
    bits = materialise(spark, B.at_shards(B.send_keys(blocks, byte_anchors, shards), B.repeated_bits), "anchor-bits")

    def send(block, parts):
        found, out = byte_anchors(block), []
        at, number, rows, slices = surroundings(block, found, found.repeated(parts[0], shards), shards)
        doc = np.where(block.valid, block.ids, _NULL)[found.row[at]]
        least = np.full(len(rows), _NULL, np.int64)
        np.minimum.at(least, number, doc)
        return [(s, block.number, B.dump(*front_code(rows[a:b]), B.small(least[a:b]))) for s, a, b in slices]

    answers = materialise(spark, B.at_shards(B.at_blocks(blocks, [bits], send, B.MESSAGE), answer_runs), "suffix-answers")

    def finish(block, parts):
        found = byte_anchors(block)
        at, number, rows, slices = surroundings(block, found, found.repeated(parts[0], shards), shards)
        got = [B.undump(parts[1][s]) for s, _, _ in slices]
        size = np.concatenate([g[0] for g in got]).astype(np.int64) if got else np.zeros(0, np.int64)
        value = np.concatenate([g[1] for g in got]) if got else np.zeros(0, np.int64)
        del rows, got
        first = np.cumsum(size) - size
        doc, low = np.where(block.valid, block.ids, np.iinfo(np.int64).min)[found.row[at]], found.low[at]
        many = found.high[at] - low + 1
        cover = np.zeros(len(block.data) + 1, np.int64)
        # One value stands for all windows of an anchor, else each window has its own.
        n = np.where(size[number] == 1, 1, many)
        step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        gone = value[np.repeat(first[number], n) + step] < np.repeat(doc, n)
        start = (np.repeat(low, n) + step)[gone]
        end = start + np.repeat(np.where(n == many, 1, many), n)[gone] - 1 + WINDOW
        np.add.at(cover, start, 1)
        np.add.at(cover, end, -1)
        gone = np.cumsum(cover)[:-1] > 0
        begin = gone.copy()
        begin[1:] &= ~gone[:-1]
        cut = block.offs[(block.offs > 0) & (block.offs < len(gone))]
        begin[cut] = gone[cut]
        removed, spans = np.append(0, np.cumsum(gone)), np.append(0, np.cumsum(begin))
        out = []
        for i in range(len(block.ids)):
            a, b = block.offs[i], block.offs[i + 1]
            n = int(removed[b] - removed[a])
            kept = block.data[a:b][~gone[a:b]].tobytes() if n else block.data[a:b].tobytes()
            out.append((int(block.ids[i]) if block.valid[i] else None, int(b - a), n, int(spans[b] - spans[a]), hashlib.sha256(kept).hexdigest(), kept if with_text else None))
        return out

    return B.at_blocks(blocks, [bits, answers], finish, RESULT)
