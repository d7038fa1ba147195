"""Repeated passages of words, by a compressed FM-index for each shard.

Words are runs of characters other than white space. A window is WINDOW consecutive words of one document; each word
covered by a window whose word sequence also starts anywhere else, in the same document or another, is removed.

A shard (see blocks.py) indexes the passages around the repeated anchors it owns: their Burrows-Wheeler transform in a
wavelet matrix with rank directories. Passages that a block streams to the shard are searched backwards, all in step:
the interval of a match is extended to the left while it still holds a second place, which gives the matching
statistics up to the passage's length; every start from which a match of at least WINDOW words goes on is reported.
Equal passages are put together before, with their number; one that came more than once needs no search, since all its
windows stand elsewhere. An index holds passages of whole anchors, and a shard builds one after another, each of about
INDEX_WORDS words, so that only the passages of one anchor are ever needed at once.

Words are compared exactly: a message carries the words its passages use, and hashes only choose anchors and shards.

Defined cases: null and empty texts have no words, and the kept text is empty; fewer than WINDOW words are never
removed; repeated rows are copies of each other; null ids are kept; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from itertools import compress

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from . import blocks as B
from .common import U, materialise, word_hashes, words

WINDOW = 35
#: Words of an anchor, and how many windows may share one.
SEED = 16
SPREAD = WINDOW - SEED + 1
INDEX_WORDS = 1 << 20


class WaveletMatrix:
    """Ranks over an array of numbers below 2^levels: bits in 64-bit words, and how many ones come before each word."""

    def __init__(self, values: np.ndarray, levels: int):
        self.levels, self.words, self.ones, self.zeros = levels, [], [], []
        for level in reversed(range(levels)):
            bit = (values >> level) & 1 > 0
            packed = np.packbits(np.pad(bit, (0, -len(bit) % 64 + 64)), bitorder="little").view(np.uint64)
            self.words.append(packed)
            self.ones.append(np.append(0, np.cumsum(np.bitwise_count(packed))).astype(np.int64))
            self.zeros.append(int(len(bit) - bit.sum()))
            values = np.concatenate([values[~bit], values[bit]])

    def descend(self, value: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Where position at stands on the last level among the places of value."""
        for k in range(self.levels):
            bit = (value >> (self.levels - 1 - k)) & 1 > 0
            word, rest = at >> 6, (at & 63).astype(np.uint64)
            ones = self.ones[k][word] + np.bitwise_count(self.words[k][word] & ((U(1) << rest) - U(1)))
            at = np.where(bit, self.zeros[k] + ones, at - ones)
        return at


def suffix_order(text: np.ndarray, depth: int) -> np.ndarray:
    """Order of suffixes by their first depth symbols at least, by prefix doubling."""
    n = len(text)
    rank = text.astype(np.int64)
    span = 1
    while True:
        key = rank * (n + 1)
        key[:-span] += rank[span:] + 1
        order = np.argsort(key, kind="stable")
        ranked = key[order]
        new = np.append(0, np.cumsum(ranked[1:] != ranked[:-1]))
        rank = np.empty(n, np.int64)
        rank[order] = new
        span *= 2
        if span >= depth or new[-1] == n - 1 or span >= n:
            return order


class FMIndex:
    """Backward search over passages of words; symbol 0 ends each passage."""

    def __init__(self, passages: list[np.ndarray]):
        self.sizes = np.array([len(p) for p in passages])
        self.known, ids = np.unique(np.concatenate(passages), return_inverse=True)
        self.starts = np.cumsum(self.sizes + 1) - self.sizes - 1
        text = np.zeros(self.sizes.sum() + len(passages), np.int64)
        place = np.arange(len(ids)) + np.repeat(np.arange(len(passages)), self.sizes)
        text[place] = ids + 1
        self.text, self.n = text, len(text)
        order = suffix_order(text, int(self.sizes.max()) + 1)
        levels = max(1, int(len(self.known)).bit_length())
        self.bwt = WaveletMatrix(text[order - 1], levels)
        counts = np.bincount(text, minlength=len(self.known) + 1)
        symbols = np.arange(len(self.known) + 1)
        self.base = np.cumsum(counts) - counts - self.bwt.descend(symbols, np.zeros(len(symbols), np.int64))

    def extend(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        got = self.bwt.descend(np.concatenate([symbol, symbol]), np.concatenate([low, high]))
        base, k = self.base[symbol], len(symbol)
        return base + got[:k], base + got[k:]

    def repeated_starts(self, queries: np.ndarray, window: int, probe: int = 7) -> np.ndarray:
        """For passages of the index (by number), a bit for each window start: the window has a second place.

        A match runs from its end to the left while two places are left. Where it breaks at i, nothing that holds
        [i, end] repeats: with i right of all starts the end moves left by one, else a probe of a few words from i on
        settles all windows that are left; only if the probe itself repeats does the end move on by one.
        """
        out = np.zeros(len(queries), np.uint64)
        last = self.sizes[queries] - window
        start = self.starts[queries]
        live = np.arange(len(queries))
        end = self.sizes[queries] - 1
        at, low, high = end.copy(), np.zeros(len(queries), np.int64), np.full(len(queries), self.n)
        goal, resume = np.full(len(queries), -1), end.copy()
        while len(live):
            a, b = self.extend(self.text[start[live] + at[live]], low[live], high[live])
            good = b - a >= 2
            i, e, probing = at[live], end[live], goal[live] >= 0
            flag = good & (e - i + 1 >= window) & (i <= last[live])
            out[live[flag]] |= U(1) << i[flag].astype(np.uint64)
            low[live], high[live] = a, b
            at[live] = i - 1
            over = good & ~probing & (i == 0)
            # A probe that reached its goal decides nothing: go on with the next end.
            lost = good & probing & (i == goal[live])
            # A probe that broke settles the rest.
            over |= ~good & probing
            broke = ~good & ~probing
            short = broke & (i > last[live])
            near = broke & (i <= last[live])
            step = short | lost
            nxt = np.where(lost, resume[live], e) - 1
            over |= step & (nxt < window - 1)
            restart = step & ~over
            tail = near & (np.minimum(i + probe, e - 1) <= i)
            over |= near & (e - 1 < window - 1)
            move = near & ~over
            idx = live[restart]
            end[idx] = nxt[restart]
            at[idx], low[idx], high[idx], goal[idx] = nxt[restart], 0, self.n, -1
            idx = live[move]
            probe_end = np.where(tail, e - 1, np.minimum(i + probe, e - 1))[move]
            resume[idx] = e[move]
            end[idx], at[idx], low[idx], high[idx], goal[idx] = probe_end, probe_end, 0, self.n, i[move]
            live = live[~over]
        return out


def anchors_only(block: B.Block) -> B.Anchors:
    starts, ends, before = words(block.data, block.offs)
    return B.Anchors(word_hashes(block.data, starts, ends), before, WINDOW, SEED)


def word_anchors(block: B.Block) -> tuple[B.Anchors, list[bytes], np.ndarray]:
    """Anchors, the words themselves, and how many lie before each row."""
    starts, ends, before = words(block.data, block.offs)
    raw = block.data.tobytes()
    own = [raw[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
    return B.Anchors(word_hashes(block.data, starts, ends), before, WINDOW, SEED), own, before


def numbered(own: list[bytes]) -> tuple[list[bytes], np.ndarray]:
    """The distinct words, and each word's number."""
    known = {w: i for i, w in enumerate(dict.fromkeys(own))}
    return list(known), np.fromiter(map(known.__getitem__, own), np.int32, len(own))


def passages(found: B.Anchors, codes: np.ndarray, again: np.ndarray, shards: int) -> dict[int, tuple[list, list, list, list]]:
    """By shard: distinct passages (bytes of word numbers) in order of anchors, the anchor of each, how often it stands in the block, and each place as (anchor, passage)."""
    raw = codes.tobytes()
    order = np.argsort(found.which, kind="stable")
    edge = np.searchsorted(found.which[order], np.arange(len(found.keys) + 1))
    low, high = found.low.tolist(), (found.high + found.size).tolist()
    out = {}
    for s, a, b in found.shard_slices(shards):
        parts, anchor, count, where = [], [], [], []
        for k in (np.flatnonzero(again[a:b]) + a).tolist():
            known: dict[bytes, int] = {}
            for i in order[edge[k] : edge[k + 1]].tolist():
                key = raw[4 * low[i] : 4 * high[i]]
                j = known.setdefault(key, len(parts))
                if j == len(parts):
                    parts.append(key)
                    anchor.append(k)
                    count.append(0)
                count[j] += 1
                where.append((i, j))
        if parts:
            out[s] = (parts, anchor, count, where)
    return out


def message(vocabulary: list[bytes], keys: np.ndarray, parts: list[bytes], anchor: list[int], count: list[int]) -> bytes:
    """Passages with the words they use, in order of their anchors' keys."""
    flat = np.frombuffer(b"".join(parts), np.int32)
    used, flat = np.unique(flat, return_inverse=True)
    sizes = np.array([len(p) >> 2 for p in parts])
    return B.dump(B.sorted_planes(keys[anchor]), b" ".join([vocabulary[i] for i in used.tolist()]), sizes.astype(np.uint8), B.small(flat), B.small(np.array(count)))


def answer_passages(payloads: list[bytes]) -> list[bytes]:
    """For each block's passages, the bits of repeated window starts."""
    known: dict[bytes, int] = {}
    keys, sizes, flat, count = [], [], [], []
    for p in payloads:
        planes, vocabulary, size, ids, times = B.undump(p)
        number = np.array([known.setdefault(w, len(known)) for w in vocabulary.split(b" ")], np.int32)
        keys.append(B.from_planes(planes))
        sizes.append(size.astype(np.int64))
        flat.append(number[ids])
        count.append(times.astype(np.int64))
    own = [len(x) for x in keys]
    del known
    keys, sizes, flat, count = (np.concatenate(x) for x in (keys, sizes, flat, count))
    first = np.cumsum(sizes) - sizes
    order = np.argsort(keys, kind="stable")
    # Ranges of whole anchors with about INDEX_WORDS words.
    total = np.cumsum(sizes[order])
    edges = np.append(np.flatnonzero(np.append(True, keys[order][1:] != keys[order][:-1])), len(order))
    bits = np.zeros(len(keys), np.uint64)
    a = 0
    while a < len(order):
        want = (total[a - 1] if a else 0) + INDEX_WORDS
        b = int(edges[max(np.searchsorted(edges, a, "right"), np.searchsorted(edges, np.searchsorted(total, want, "right"), "right") - 1)])
        bits[order[a:b]] = repeated_windows(flat, first[order[a:b]], sizes[order[a:b]], count[order[a:b]])
        a = b
    edge = np.append(0, np.cumsum(own))
    return [B.dump(bits[x:y]) for x, y in zip(edge[:-1], edge[1:], strict=True)]


def repeated_windows(flat: np.ndarray, first: np.ndarray, sizes: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Bits of repeated window starts of the passages flat[first : first + sizes], each of which stands count times."""
    raw, at = flat.tobytes(), {}
    which = np.array([at.setdefault(raw[4 * x : 4 * (x + n)], len(at)) for x, n in zip(first.tolist(), sizes.tolist(), strict=True)])
    parts = [np.frombuffer(k, np.int32) for k in at]
    times = np.bincount(which, count, len(parts))
    size = np.array([len(p) for p in parts])
    bits = (U(1) << (size - WINDOW + 1).astype(np.uint64)) - U(1)
    single = np.flatnonzero(times == 1)
    if len(single) and len(parts) > 1:
        index = FMIndex(parts)
        for a in range(0, len(single), 8192):
            bits[single[a : a + 8192]] = index.repeated_starts(single[a : a + 8192], WINDOW)
    elif len(single):
        bits[:] = FMIndex(parts).repeated_starts(single, WINDOW)
    return bits[which]


RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string"


def remove_repeats(spark: SparkSession, docs: DataFrame, with_text: bool = True) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and, if asked for, kept: a row for each document."""
    blocks = B.make_blocks(spark, docs)
    shards = B.shard_count(blocks)
    bits = materialise(spark, B.at_shards(B.send_keys(blocks, anchors_only, shards), B.repeated_bits), "anchor-bits")

    def send(block, parts):
        found, own, _ = word_anchors(block)
        vocabulary, codes = numbered(own)
        return [(s, block.number, message(vocabulary, found.keys, got, anchor, count)) for s, (got, anchor, count, _) in passages(found, codes, found.repeated(parts[0], shards), shards).items()]

    answers = materialise(spark, B.at_shards(B.at_blocks(blocks, [bits], send, B.MESSAGE), answer_passages), "passage-answers")

    def finish(block, parts):
        found, own, before = word_anchors(block)
        _, codes = numbered(own)
        cover = np.zeros(len(codes) + 1, np.int64)
        for s, (_, _, _, where) in passages(found, codes, found.repeated(parts[0], shards), shards).items():
            (masks,) = B.undump(parts[1][s])
            at = np.array(where, np.int64)
            mask, low = masks[at[:, 1]], found.low[at[:, 0]]
            for k in range(SPREAD):
                first = low[(mask >> U(k)) & U(1) > 0] + k
                np.add.at(cover, first, 1)
                np.add.at(cover, first + WINDOW, -1)
        gone = np.cumsum(cover)[:-1] > 0
        removed = np.append(0, np.cumsum(gone))
        out = []
        for i in range(len(block.ids)):
            a, b = int(before[i]), int(before[i + 1])
            n = int(removed[b] - removed[a])
            kept = b" ".join(compress(own[a:b], ~gone[a:b]) if n else own[a:b])
            out.append((int(block.ids[i]) if block.valid[i] else None, b - a, n, hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "replace") if with_text else None))
        return out

    return B.at_blocks(blocks, [bits, answers], finish, RESULT)
