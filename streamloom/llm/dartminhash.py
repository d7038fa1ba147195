"""Near-duplicates by DartMinHash signatures, a banded join, and exact checks.

Each shingle (WORDS consecutive words) of a document is an element whose weight is how often it occurs. Darts are
thrown by hashing into cells of the (weight, rank) plane of an element: cell widths double with the weight, and in each
cell ranks arrive as a Poisson process. A dart below the element's weight counts; each dart belongs to one of K
coordinates, and a coordinate keeps its earliest dart. About K (ln K + 2) darts a document are looked at, however long
it is; the rank limit doubles for documents with a coordinate left empty. Two signatures agree in a coordinate with the
probability of their weighted Jaccard similarity.

Signatures are cut in BANDS bands of ROWS coordinates. Documents that share a band are candidates. In a bucket of up to
CHUNK documents they are compared by their signatures with a few leaders, never all pairs: a leader covers what agrees
with it in COVER of the coordinates, and everything that agrees with it in LOOSE is linked to it. The Jaccard distance
obeys the triangle inequality: what is within 0.2 of a covered document is within 0.35 + 0.2 of its leader, so it is
linked to the same leader. In a larger bucket everything is linked to the least document. Connected candidates then meet
with their texts, and classes are made from exact similarities of at least THRESHOLD: a document is tested against all
others unless it is in the largest class, so no link between classes is lost. Similarity is the weighted Jaccard index, the
sum of the lesser weights over the sum of the greater ones; where no shingle repeats, it is that of the sets.

Components of more than CHUNK documents are dealt over chunks by a hash. Some witnesses of the largest class of each
chunk join these classes, in as many levels as are needed. What is then outside the largest class of its component is
tested, in blocks of CHUNK, against every chunk where it shares a band with a document: of a link between two classes
one end is outside the largest, so none is lost here either. Groups in a task stay near 2 CHUNK documents; the work is
documents outside x documents, compared in blocks, and only links between classes leave it.

Copies (equal texts) are put together first and enter the join once.

Defined cases: texts with fewer than WORDS words are one shingle; null texts and texts without words are in no class
but their own; a null doc_id has a null class; rows with the same doc_id share a class; ties go to the least doc_id.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import U, bit_table, chunks, components, gram_hash, materialise, mix, sorted_groups, string_buffers, through_table, word_hashes, words

WORDS = 5
THRESHOLD = 0.8
BANDS, ROWS = 20, 4
K = BANDS * ROWS
LOOSE, COVER = 0.4, 0.65
CHUNK = 512
WITNESSES = 8


def shingles(data: np.ndarray, offs: np.ndarray, size: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes of concatenated rows, and each one's row."""
    starts, ends, before = words(data, offs)
    hashes = word_hashes(data, starts, ends)
    count = np.diff(before)
    grams = gram_hash(hashes, size)
    row = np.repeat(np.arange(len(count)), count)
    whole = row[: len(grams)] == row[size - 1 :] if len(grams) else np.zeros(0, bool)
    out, at = grams[whole], row[: len(grams)][whole]
    short = np.flatnonzero((count > 0) & (count < size))
    if len(short):
        extra = np.array([gram_hash(hashes[before[r] : before[r + 1]], int(count[r]))[0] for r in short], np.uint64)
        out, at = np.concatenate([out, mix(extra)]), np.concatenate([at, short])
        order = np.argsort(at, kind="stable")
        out, at = out[order], at[order]
    return out, at


def weigh(elements: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct elements of each row, their row, and how often they occur."""
    order = np.lexsort((elements, row))
    elements, row = elements[order], row[order]
    new = np.ones(len(row), bool)
    new[1:] = (elements[1:] != elements[:-1]) | (row[1:] != row[:-1])
    first = np.flatnonzero(new)
    return elements[first], row[first], np.diff(np.append(first, len(row)))


def throw(elements: np.ndarray, row: np.ndarray, weight: np.ndarray | None, limit: np.ndarray, k: int) -> np.ndarray:
    """Darts with rank up to limit[row], as sorted numbers (row, coordinate, rank): 27 bits for the first two, 37 for the rank."""
    seed, top, width, low = mix(elements), limit[row], 1.0, 0.0
    out = []
    while len(seed):
        cell, at, high, w = seed, row, top, weight
        rank, step = np.zeros(len(cell)), 0
        while len(cell):
            step += 1
            h = mix(cell + U(step * 0xD1342543DE82EF95 & 0xFFFFFFFFFFFFFFFF))
            rank = rank - np.log(((h >> U(11)).astype(np.float64) + 0.5) * 2.0**-53) / width
            alive = rank <= high
            cell, at, high, rank, h = cell[alive], at[alive], high[alive], rank[alive], h[alive]
            h = mix(h ^ U(0xA0761D6478BD642F))
            coordinate = ((h >> U(32)) * U(k)) >> U(32)
            dart = ((at.astype(np.uint64) * U(k) + coordinate) << U(37)) | (rank.view(np.uint64) >> U(27))
            if w is not None:
                w = w[alive]
                dart = dart[low + width * ((h & U(0xFFFFFFFF)).astype(np.float64) * 2.0**-32) < w]
            out.append(dart)
        if weight is None:
            break
        low, width = (1.0, 1.0) if low == 0 else (low * 2, width * 2)
        more = weight > low
        seed, row, top, weight = mix(seed[more] + U(1)), row[more], top[more], weight[more]
    darts = np.concatenate(out) if out else np.zeros(0, np.uint64)
    darts.sort()
    return darts


def signatures(elements: np.ndarray, row: np.ndarray, n: int, k: int = K, weighted: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """n x k earliest ranks (37 bits each) and which rows have a signature. Elements are sorted by row; repeats are allowed."""
    out, done = np.zeros((n, k), np.uint64), np.zeros(n, bool)
    weight = None
    if weighted:
        elements, row, weight = weigh(elements, row)
        weight = weight.astype(np.float64)
    total = np.bincount(row, weight, n).astype(np.float64)
    limit = k * (np.log(k) + 2) / np.maximum(total, 1)
    todo = total > 0
    has = todo.copy()
    while todo.any():
        on = todo[row]
        elements, row = elements[on], row[on]
        weight = weight[on] if weighted else None
        darts = throw(elements, row, weight, limit, k)
        place = (darts >> U(37)).astype(np.int64)
        first = np.flatnonzero(np.append(True, place[1:] != place[:-1])) if len(place) else np.zeros(0, np.int64)
        filled = np.bincount(place[first] // k, minlength=n) == k
        take = first[filled[place[first] // k]]
        out.reshape(-1)[place[take]] = darts[take] & U((1 << 37) - 1)
        done |= filled & todo
        todo &= ~filled
        limit = limit * 2
        if todo.any() and not weighted:
            on = todo[row]
            elements, row, _ = weigh(elements[on], row[on])
    return out, has


def sign_documents(docs: DataFrame) -> DataFrame:
    """doc_id, text_key (MD5 of the text), bands (BANDS longs), sig (a byte for each coordinate); the last three null without words."""

    def run(batches):
        for batch in batches:
            data, offs = string_buffers(batch.column(1))
            for a, b in chunks(offs):
                part, at = data[offs[a] : offs[b]], offs[a : b + 1] - offs[a]
                found, has = signatures(*shingles(part, at), b - a, weighted=True)
                raw = part.tobytes()
                sig = (mix(found.reshape(-1)) >> U(56)).astype(np.uint8).reshape(b - a, K)
                bands = np.zeros((b - a, BANDS), np.uint64)
                for r in range(ROWS):
                    bands = mix(bands * U(0x9E3779B97F4A7C15) + found[:, r::ROWS][:, :BANDS])
                bands = mix(bands + np.arange(BANDS, dtype=np.uint64) * U(0xBF58476D1CE4E5B9)).view(np.int64)
                gone = pa.array(~has)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(b - a + 1) * BANDS, pa.int32()), pa.array(bands.reshape(-1)), mask=gone)
                keys = [hashlib.md5(raw[x:y]).digest() if h else None for x, y, h in zip(at[:-1].tolist(), at[1:].tolist(), has.tolist(), strict=True)]
                sigs = [s.tobytes() if h else None for s, h in zip(sig, has.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(keys, pa.binary()), lists, pa.array(sigs, pa.binary())], ["doc_id", "text_key", "bands", "sig"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, text_key binary, bands array<long>, sig binary")


def lead(ids: np.ndarray, sig: np.ndarray) -> tuple[list, list, np.ndarray]:
    """Links (a, b) of a bucket by its leaders, and the leaders: a row that no leader covers leads; all rows like a leader are linked to it.

    Links serve to connect, so each row is linked once, to the least row of what its leaders connect; ids are in order.
    """
    label, leaders, free = np.arange(len(ids)), [], np.ones(len(ids), bool)
    while free.any():
        k = int(np.argmax(free))
        agree = (sig == sig[k]).mean(1)
        joined = np.unique(label[agree >= LOOSE])
        if len(joined) > 1:
            label[np.isin(label, joined)] = joined[0]
        free &= agree < COVER
        leaders.append(k)
    linked = np.flatnonzero(label != np.arange(len(ids)))
    return ids[label[linked]].tolist(), ids[linked].tolist(), np.array(leaders)


def link_buckets(rows: DataFrame) -> DataFrame:
    """rows: key, rep, sig. Links (a, b), a < b, of buckets of bounded size."""

    def run(batches):
        out: set[tuple[int, int]] = set()
        for group in sorted_groups(batches, 1):
            sig = np.frombuffer(b"".join(group.column("sig").to_pylist()), np.uint8).reshape(-1, K)
            a, b, _ = lead(group.column("rep").to_numpy(), sig)
            out.update(zip(a, b, strict=True))
            if len(out) > 20_000:
                yield link_batch(out)
                out = set()
        yield link_batch(out)

    return rows.repartition("key").sortWithinPartitions("key", "rep").select("key", "rep", "sig").mapInArrow(run, "a long, b long")


def link_batch(links: set[tuple[int, int]]) -> pa.RecordBatch:
    a, b = zip(*links, strict=True) if links else ((), ())
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def shared_bands(spark: SparkSession, unique: DataFrame) -> DataFrame:
    """key, rep, count, least: the bands of unique (rep, bands, sig) that several documents have."""
    keys = unique.select("rep", F.explode("bands").alias("key"))
    counts = materialise(spark, keys.groupBy("key").agg(F.count("*").alias("count"), F.min("rep").alias("least")).filter("count > 1"), "bands")
    return materialise(spark, keys.join(counts, "key"), "buckets")


def candidate_links(unique: DataFrame, shared: DataFrame) -> DataFrame:
    """Distinct links (a, b), a < b, between documents that share a band and may be alike."""
    small = link_buckets(shared.filter(F.col("count") <= CHUNK).join(unique.select("rep", "sig"), "rep"))
    large = shared.filter((F.col("count") > CHUNK) & (F.col("rep") > F.col("least"))).select(F.col("least").alias("a"), F.col("rep").alias("b"))
    return small.union(large).distinct()


def exact_classes(sets: list[np.ndarray], threshold: float = THRESHOLD) -> tuple[np.ndarray, np.ndarray]:
    """Class (least index) of each set, by exact Jaccard links, and how many links were seen of each. Sets are distinct values.

    After the most central set, only sets outside the largest class need testing: a link between two classes has an end
    outside it.
    """
    n = len(sets)
    size = np.array([len(s) for s in sets])
    _, flat = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(n), size)
    df = np.bincount(flat)
    central = np.bincount(owner, df[flat], n) / size
    parts = np.split(flat, np.cumsum(size)[:-1])
    label, links, tested = np.arange(n), np.zeros(n, np.int64), np.zeros(n, bool)
    order = np.argsort(-central, kind="stable")
    while True:
        largest = np.argmax(np.bincount(label, minlength=n))
        todo = ~tested & (label != largest) if tested.any() else ~tested
        if not todo.any():
            return label, links
        p = int(order[np.argmax(todo[order])])
        tested[p] = True
        mark = np.zeros(len(df), bool)
        mark[parts[p]] = True
        both = np.bincount(owner[mark[flat]], minlength=n)
        like = both >= threshold * (size + size[p] - both) - 1e-9
        links[p] = like.sum()
        joined = np.unique(label[like])
        label[np.isin(label, joined)] = joined.min()


def shingle_sets(column) -> list[np.ndarray]:
    """The shingles of each text as distinct values, the k-th occurrence of a shingle as a value of its own: set similarity of these is weighted similarity. A text without any has its row number."""
    data, offs = string_buffers(column)
    values, row = shingles(data, offs)
    values, row, times = weigh(values, row)
    nth = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
    values, row = np.repeat(values, times), np.repeat(row, times)
    values = np.where(nth > 0, mix(values + nth.astype(np.uint64) * U(0x9E3779B97F4A7C15)), values)
    sets = np.split(values, np.searchsorted(row, np.arange(1, len(column))))
    return [s if len(s) else np.array([i], np.uint64) for i, s in enumerate(sets)]


class Weighted:
    """Exact links by weighted similarity, between texts."""

    @staticmethod
    def classes(ids: np.ndarray, texts) -> tuple[np.ndarray, np.ndarray]:
        """Class of each text (an index), and how many links were seen of each."""
        return exact_classes(shingle_sets(texts))

    @staticmethod
    def outside(label: np.ndarray, asks: np.ndarray, texts) -> set[tuple[int, int]]:
        """Links between classes, from every text that asks against all."""
        sets = shingle_sets(texts)
        size = np.array([len(s) for s in sets])
        _, flat = np.unique(np.concatenate(sets), return_inverse=True)
        owner = np.repeat(np.arange(len(sets)), size)
        parts = np.split(flat, np.cumsum(size)[:-1])
        label, out = label.copy(), set()
        for p in asks:
            mark = np.zeros(int(flat.max()) + 1, bool)
            mark[parts[p]] = True
            both = np.bincount(owner[mark[flat]], minlength=len(sets))
            joined = np.unique(label[both >= THRESHOLD * (size + size[p] - both) - 1e-9])
            if len(joined) > 1:
                out.update((int(joined[0]), int(j)) for j in joined[1:])
                label[np.isin(label, joined)] = joined[0]
        return out


def class_rows(rows: DataFrame, exact=Weighted) -> DataFrame:
    """rows: component, chunk, rep, text, split, dealt out and sorted by the first two. (rep, class), and with component and text the witnesses of the largest class of each chunk of a split component."""

    def run(batches):
        for group in sorted_groups(batches, 2):
            ids = group.column("rep").to_numpy()
            label, links = exact.classes(ids, group.column("text"))
            least = {int(c): int(ids[label == c].min()) for c in np.unique(label)}
            out = [(int(i), least[int(c)], None, None) for i, c in zip(ids, label, strict=True)]
            if group.column("split")[0].as_py():
                component, texts, largest = group.column("component")[0].as_py(), group.column("text"), int(np.argmax(np.bincount(label)))
                own = np.flatnonzero(label == largest)
                picked = own[np.argsort(-links[own], kind="stable")[: WITNESSES // 2]].tolist() + own[:: max(1, len(own) // (WITNESSES // 2))].tolist()[: WITNESSES // 2]
                out += [(int(ids[i]), least[largest], component, texts[i].as_py()) for i in set(picked)]
            cols = list(zip(*out, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True)], ["rep", "class", "component", "text"])

    return rows.select("component", "chunk", "rep", "text", "split").repartition("component", "chunk").sortWithinPartitions("component", "chunk").mapInArrow(run, "rep long, class long, component long, text string")


def deal(rows: DataFrame, sizes: DataFrame) -> DataFrame:
    """rows with n (rows of the component), chunk (near CHUNK rows of a component share one) and split (it has several)."""
    chunk = F.pmod(F.xxhash64("rep"), F.expr(f"cast(ceil(n / {CHUNK}) as long)"))
    return rows.join(sizes, "component").withColumn("chunk", chunk).withColumn("split", F.col("n") > CHUNK)


def component_sizes(spark: SparkSession, rows: DataFrame) -> DataFrame:
    return materialise(spark, rows.groupBy("component").agg(F.count("*").alias("n")), "sizes")


def join_witnesses(spark: SparkSession, found: DataFrame, exact=Weighted) -> DataFrame:
    """Links (a, b) between classes of the chunks of a component, from witnesses (rep, class, component, text): level after level of chunks."""
    links = None
    while True:
        hubs = found.filter("component is not null").select("component", F.col("class").alias("own"), "rep", "text")
        sizes = component_sizes(spark, hubs)
        found = materialise(spark, class_rows(deal(hubs, sizes), exact), "witnesses")
        now = found.filter("component is null").select("rep", "class").join(hubs.select("rep", "own"), "rep").select("class", "own")
        # the class of a witness set is named by a witness; its own class stands for it
        named = now.join(hubs.select(F.col("rep").alias("class"), F.col("own").alias("named")), "class").select(F.col("named").alias("a"), F.col("own").alias("b")).filter("a <> b").distinct()
        links = named if links is None else links.union(named)
        found = found.filter("component is not null").join(hubs.select("rep", "own"), "rep").select("rep", F.col("own").alias("class"), "component", "text")
        if not sizes.filter(F.col("n") > CHUNK).limit(1).count():
            return links


def try_outside(rows: DataFrame, exact=Weighted) -> DataFrame:
    """rows: component, place, rep, class, asks, text, dealt out and sorted by the first two. Links (a, b) between classes, from every document that asks against all of its place."""

    def run(batches):
        for group in sorted_groups(batches, 2):
            yield link_batch(exact.outside(group.column("class").to_numpy(), np.flatnonzero(group.column("asks").to_numpy()), group.column("text")))

    return rows.select("component", "place", "rep", "class", "asks", "text").repartition("component", "place").sortWithinPartitions("component", "place").mapInArrow(run, "a long, b long")


def outside_links(spark: SparkSession, members: DataFrame, shared: DataFrame, docs: DataFrame, exact=Weighted) -> DataFrame | None:
    """Links (a, b) between classes of split components, members (component, chunk, rep, class); None if each is one class.

    Documents outside the largest class of their component ask every chunk where one shares a band with them.
    """
    count = members.groupBy("component", "class").agg(F.count("*").alias("n"))
    largest = count.groupBy("component").agg(F.max_by("class", F.struct("n", "class")).alias("largest"))
    asking = materialise(spark, members.join(largest, "component").filter("class <> largest").select("component", "rep", "class"), "outside")
    asked = asking.groupBy("component").agg(F.count("*").alias("asked"))
    if not asking.limit(1).count():
        return None
    # Only bands that several documents have can be shared; each chunk has a band once here, however many have it.
    bands = materialise(spark, shared.select("key", "rep").join(members.select("component", "rep", "chunk"), "rep"), "split_bands")
    held = bands.select("component", "key", "chunk").distinct()
    wanted = bands.join(asking.select("rep", "class"), "rep").select("component", "key", "rep", "class").join(held, ["component", "key"]).select("component", "rep", "class", "chunk").distinct()
    block = F.pmod(F.xxhash64(F.lit(1), F.col("rep")), F.expr(f"cast(ceil(asked / {CHUNK}) as long)"))
    wanted = materialise(spark, wanted.join(asked, "component").withColumn("place", F.col("chunk") * (1 << 32) + block).select("component", "chunk", "place", "rep", "class"), "asking")
    places = wanted.select("component", "chunk", "place").distinct()
    both = wanted.select("component", "place", "rep", "class", F.lit(True).alias("asks")).union(
        members.join(places, ["component", "chunk"]).select("component", "place", "rep", "class", F.lit(False).alias("asks"))
    )
    both = both.groupBy("component", "place", "rep", "class").agg(F.max("asks").alias("asks"))
    return materialise(spark, try_outside(with_text(spark, docs, both), exact), "outside_links")


def with_text(spark: SparkSession, docs: DataFrame, rows: DataFrame) -> DataFrame:
    """rows with the text of the document that rep names, one row of it."""
    texts = through_table(docs.select("doc_id", "text").filter("text is not null and doc_id is not null"), "doc_id", bit_table(spark, rows.select("rep").distinct(), "rep"))
    return texts.join(rows, texts["doc_id"] == rows["rep"]).drop("doc_id")


def exact_members(spark: SparkSession, member: DataFrame, shared: DataFrame, docs: DataFrame, exact=Weighted) -> DataFrame:
    """rep, class (by exact links between texts) of candidates member (component, rep); shared (key, rep) names who may be linked with whom."""
    member = materialise(spark, deal(member, component_sizes(spark, member)), "members")
    first = materialise(spark, class_rows(with_text(spark, docs, member), exact), "classes")
    own = first.filter("component is null").groupBy("rep").agg(F.min("class").alias("class"))
    if member.filter("split").limit(1).count():
        links = materialise(spark, join_witnesses(spark, first, exact), "class_links")
        own = materialise(spark, rename(spark, own, links), "joined")
        members = materialise(spark, member.filter("split").select("component", "chunk", "rep").join(own, "rep"), "split")
        more = outside_links(spark, members, shared, docs, exact)
        own = own if more is None else rename(spark, own, more)
    return own


def classes(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """doc_id, class_id (the least doc_id of the class): a row for each row of docs."""
    signed = materialise(spark, sign_documents(docs), "signatures")
    known = signed.filter("text_key is not null and doc_id is not null")
    unique = materialise(spark, known.groupBy("text_key").agg(F.min("doc_id").alias("rep"), F.first("bands").alias("bands"), F.first("sig").alias("sig")), "unique")
    shared = shared_bands(spark, unique)
    member = components(spark, candidate_links(unique, shared)).select("component", F.col("node").alias("rep"))
    own = exact_members(spark, member, shared, docs)
    final = unique.select("text_key", "rep").join(own, "rep", "left").select("text_key", F.coalesce("class", "rep").alias("class_id"))
    final = materialise(spark, final, "final")
    out = signed.select("doc_id", "text_key").join(final, "text_key", "left").select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"))
    return out


def rename(spark: SparkSession, own: DataFrame, links: DataFrame) -> DataFrame:
    """own (rep, class) with the classes that links (a, b) connect made one."""
    top = components(spark, links).select(F.col("node").alias("class"), F.col("component").alias("top"))
    return own.join(top, "class", "left").select("rep", F.coalesce("top", "class").alias("class"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """docs without those that have a class with a smaller doc_id; the others stay, with all their columns."""
    gone = materialise(spark, classes(spark, docs).filter("class_id < doc_id").select("doc_id").distinct(), "dropped")
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
