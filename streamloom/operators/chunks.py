"""Frames of a stream in chunks, windows and samples. A frame is (video, ts, frame_id, ...), ts in seconds from the start.

Every rank ends in frame_id, so results do not depend on partitioning. Work is keyed by video throughout: one exchange
serves chunking, windows and samples of the same frames.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X


def tumbling(frames: DataFrame, duration: float) -> DataFrame:
    """Adds chunk = floor(ts / duration)."""
    return frames.withColumn("chunk", F.floor(F.col("ts") / duration).cast("long"))


def chunk_bounds(frames: DataFrame, duration: float, frame_seconds: float = 1.0, video_end: float | None = None, nominal_fps: float = 1.0) -> DataFrame:
    """video, chunk, start_time, end_time, n, fps, frames: chunks that hold frames, ends clamped to what the video can hold."""
    cut = tumbling(frames, duration)
    end = F.max(F.col("ts") + frame_seconds).over(Window.partitionBy("video"))
    end = F.least(end, F.lit(video_end)) if video_end is not None else end
    grouped = cut.withColumn("_end", end).groupBy("video", "chunk").agg(
        F.count("*").alias("n"), F.min("ts").alias("_first"), F.max("ts").alias("_last"), F.first("_end").alias("_end"), F.sort_array(F.collect_list(F.struct("ts", "frame_id"))).alias("frames")
    )
    return grouped.select(
        "video", "chunk", (F.col("chunk") * duration).alias("start_time"), F.greatest("_last", F.least((F.col("chunk") + 1) * duration, F.col("_end"))).alias("end_time"), "n",
        F.when((F.col("n") > 1) & (F.col("_last") > F.col("_first")), (F.col("n") - 1) / (F.col("_last") - F.col("_first"))).otherwise(nominal_fps).alias("fps"), "frames",
    )


def representative(chunks: DataFrame) -> DataFrame:
    """Adds the middle frame and the chunk's middle time."""
    return chunks.withColumns({"rep": F.get("frames", F.floor(F.col("n") / 2).cast("int")), "mid": (F.col("start_time") + F.col("end_time")) / 2})


def upsert(old: DataFrame, new: DataFrame) -> DataFrame:
    """Chunks (video, chunk, start_time, end_time, n, frames) of two decode windows as one: least start, largest end, frames of both in order."""
    every = old.unionByName(new, allowMissingColumns=True)
    merged = every.groupBy("video", "chunk").agg(F.min("start_time").alias("start_time"), F.max("end_time").alias("end_time"), F.sort_array(F.array_distinct(F.flatten(F.collect_list("frames")))).alias("frames"))
    return representative(merged.withColumn("n", F.size("frames")))


def causal(frames: DataFrame, questions: DataFrame) -> DataFrame:
    """Frames that a question (video, cutoff) may see: ts <= cutoff."""
    return frames.join(questions, "video").filter("ts <= cutoff")


def split_history(chunks: DataFrame, questions: DataFrame, window: int) -> DataFrame:
    """video, cutoff, chunk, part: of the chunks that end by the cutoff the last `window` are recent, the rest history."""
    seen = chunks.select("video", "chunk", "end_time").join(questions, "video").filter("end_time <= cutoff")
    back = F.row_number().over(Window.partitionBy("video", "cutoff").orderBy(F.desc("chunk")))
    return seen.select("video", "cutoff", "chunk", F.when(back <= window, "recent").otherwise("history").alias("part"))


def last_rows(rows: DataFrame, questions: DataFrame, k: int) -> DataFrame:
    """The last k rows (video, ts, frame_id, ...) up to each cutoff (video, cutoff), with back, 1 for the last.

    Rows are numbered once in each video, each cutoff finds its last number, and k numbers back are joined by equality: k
    rows for each cutoff, never all that came before it.
    """
    numbered = rows.withColumn("_i", F.row_number().over(Window.partitionBy("video").orderBy("ts", "frame_id")))
    last = as_of(numbered.groupBy("video", F.col("ts").alias("end_time")).agg(F.max("_i").alias("_last")), questions.select("video", "cutoff").distinct())
    wanted = last.select("video", "cutoff", F.posexplode(F.sequence(F.col("_last"), F.greatest(F.col("_last") - (k - 1), F.lit(1)), F.lit(-1))).alias("_b", "_i"))
    return wanted.join(numbered, ["video", "_i"]).withColumn("back", F.col("_b") + 1).drop("_i", "_b")


def recent_frames(frames: DataFrame, questions: DataFrame, duration: float, window: int) -> DataFrame:
    """The last `window` frames with distinct times of the last `window` chunks before each cutoff, the first frame of each time.

    So many frames never reach further back than so many chunks that hold frames, whatever the duration.
    """
    first = frames.groupBy("video", "ts").agg(F.min("frame_id").alias("frame_id"))
    return last_rows(first, questions, window).select("video", "cutoff", "frame_id", "ts", "back")


def stride_cap(frames: DataFrame, stride: int, cap: int, order: tuple[str, ...] = ("ts", "frame_id")) -> DataFrame:
    """Every stride-th frame; of more than cap, those at int(i * n / cap)."""
    w = Window.partitionBy("video")
    place = F.row_number().over(w.orderBy(*order)) - 1
    kept = frames.withColumn("_p", place).filter(F.col("_p") % stride == 0).withColumn("_p", F.floor(F.col("_p") / stride).cast("long")).withColumn("_n", F.count("*").over(w))
    # p is picked if some i has floor(i * n / cap) = p: the least i with i * n / cap >= p.
    i = F.floor((F.col("_p") * cap + F.col("_n") - 1) / F.col("_n"))
    picked = (F.col("_n") <= cap) | ((i < cap) & (F.floor(i * F.col("_n") / cap) == F.col("_p")))
    return (kept.filter(picked) if cap > 0 else kept).drop("_p", "_n")


def uniform(frames: DataFrame, k: int, by: tuple[str, ...] = ("video",), order: tuple[str, ...] = ("ts", "frame_id")) -> DataFrame:
    """k frames of each group at evenly spread places, rounded half to even."""
    w = Window.partitionBy(*by)
    ranked = frames.withColumns({"_p": (F.row_number().over(w.orderBy(*order)) - 1).cast("int"), "_n": F.count("*").over(w)})
    return ranked.filter(F.array_contains(X.uniform_indices("_n", F.lit(k)), F.col("_p"))).drop("_p", "_n")


def intervals(questions: DataFrame) -> DataFrame:
    """Adds prev, the cutoff before (0 for the first)."""
    return questions.withColumn("prev", F.coalesce(F.lag("cutoff").over(Window.partitionBy("video").orderBy("cutoff")), F.lit(0.0)))


def rows_until(numbered: DataFrame, asked: DataFrame) -> DataFrame:
    """video, t, n: how many of a video's rows (video, ts, _i from 1 on) are at or before each time asked (video, t)."""
    marked = numbered.select("video", F.col("ts").alias("_t"), F.col("_i"), F.lit(None).cast("double").alias("t"), F.lit(0).alias("_k"))
    ask = asked.select("video", F.col("t").alias("_t"), F.lit(None).cast("int").alias("_i"), "t", F.lit(1).alias("_k")).distinct()
    w = Window.partitionBy("video").orderBy("_t", "_k").rowsBetween(Window.unboundedPreceding, 0)
    return marked.unionByName(ask).withColumn("n", F.coalesce(F.max("_i").over(w), F.lit(0))).filter("t is not null").select("video", "t", "n")


def interval_sample(frames: DataFrame, questions: DataFrame, context: float, k: int) -> DataFrame:
    """k frames of (prev - context, cutoff] for each question, and whether the interval holds any before prev.

    An interval is a range of frame numbers, so its k places are known before any frame is read, and k rows are joined.
    """
    numbered = frames.select("video", "ts", "frame_id", F.row_number().over(Window.partitionBy("video").orderBy("ts", "frame_id")).alias("_i"))
    asked = intervals(questions).withColumn("_low", F.greatest(F.lit(0.0), F.col("prev") - context))
    times = asked.select("video", F.explode(F.array("cutoff", "prev", "_low")).alias("t")).distinct()
    at = rows_until(numbered, times)
    for name, to in (("cutoff", "_to"), ("prev", "_mid"), ("_low", "_from")):
        asked = asked.join(at.select("video", F.col("t").alias(name), F.col("n").alias(to)), ["video", name])
    places = F.transform(X.uniform_indices(F.col("_to") - F.col("_from"), F.lit(k)), lambda p: p + F.col("_from") + 1)
    picked = asked.select("video", "cutoff", "prev", (F.col("_mid") > F.col("_from")).alias("has_context"), F.explode(places).alias("_i"))
    return picked.join(numbered, ["video", "_i"]).select("video", "cutoff", "prev", "frame_id", "ts", "has_context")


def storyboard(frames: DataFrame, most: int, tail: int) -> DataFrame:
    """All frames if few; else the last `tail` and evenly spread ones of the rest, `most` together."""
    w = Window.partitionBy("video")
    ranked = frames.withColumns({"_back": F.row_number().over(w.orderBy(F.desc("ts"), F.desc("frame_id"))), "_n": F.count("*").over(w)})
    tail = min(tail, most)
    ranked = ranked.withColumns({"_p": (F.col("_n") - F.col("_back")).cast("int"), "_h": (F.col("_n") - tail).cast("int")})
    head = (F.col("_back") > tail) & F.array_contains(X.uniform_indices("_h", F.lit(most - tail)), F.col("_p"))
    return ranked.filter((F.col("_n") <= most) | (F.col("_back") <= tail) | head).drop("_back", "_n", "_p", "_h")


def segments(chunks: DataFrame, parts: int) -> DataFrame:
    """video, segment, first, last (exclusive): places of the chunks of a video cut evenly in at most `parts` segments."""
    n = chunks.groupBy("video").agg(F.count("*").cast("int").alias("n"))
    edges = X.uniform_indices(F.col("n") + 1, F.least(F.lit(parts), F.col("n")) + 1)
    cut = n.select("video", F.posexplode(edges).alias("segment", "first"))
    cut = cut.withColumn("last", F.lead("first").over(Window.partitionBy("video").orderBy("segment")))
    return cut.filter("last > first").select("video", "segment", "first", "last")


def phase_context(chunks: DataFrame, c: int) -> DataFrame:
    """Middle times of each chunk and the c - 1 before it."""
    w = Window.partitionBy("video").orderBy("chunk").rowsBetween(-(c - 1), 0)
    return representative(chunks).withColumn("context", F.collect_list("mid").over(w)).select("video", "chunk", "context")


def sheet_layout(frames: DataFrame, columns: int) -> DataFrame:
    """Row and column of each frame on a contact sheet."""
    place = F.row_number().over(Window.partitionBy("video").orderBy("ts", "frame_id")) - 1
    return frames.select("video", "frame_id", F.floor(place / columns).cast("int").alias("sheet_row"), (place % columns).cast("int").alias("sheet_col"))


def as_of(states: DataFrame, questions: DataFrame) -> DataFrame:
    """The last state (video, end_time, ...) with end_time <= cutoff, for each question: a union and one window instead of a range join."""
    marked = states.select("video", F.col("end_time").alias("_t"), F.struct(*states.columns).alias("_s"), F.lit(None).cast("double").alias("cutoff"), F.lit(0).alias("_k"))
    asked = questions.select("video", F.col("cutoff").alias("_t"), F.lit(None).cast(marked.schema["_s"].dataType).alias("_s"), "cutoff", F.lit(1).alias("_k"))
    w = Window.partitionBy("video").orderBy("_t", "_k").rowsBetween(Window.unboundedPreceding, 0)
    both = marked.unionByName(asked).withColumn("_s", F.last("_s", ignorenulls=True).over(w)).filter("_k = 1 and _s is not null")
    return both.select("cutoff", "_s.*")


def first_at(frames: DataFrame, asked: DataFrame, strict: bool = False) -> DataFrame:
    """The first frame at or after (strict: after) each time asked (video, t): a union and one window, no range join."""
    marked = frames.select("video", F.col("ts").alias("_t"), F.struct("ts", "frame_id").alias("_f"), F.lit(None).cast("double").alias("t"), F.lit(0 if strict else 1).alias("_k"))
    ask = asked.select("video", F.col("t").alias("_t"), F.lit(None).cast(marked.schema["_f"].dataType).alias("_f"), "t", F.lit(1 if strict else 0).alias("_k"))
    w = Window.partitionBy("video").orderBy("_t", "_k", "_f.frame_id").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    both = marked.unionByName(ask).withColumn("_f", F.first("_f", ignorenulls=True).over(w)).filter("t is not null")
    return both.select("video", "t", F.col("_f.ts").alias("ts"), F.col("_f.frame_id").alias("frame_id"))


def decode_windows(questions: DataFrame) -> DataFrame:
    """questions (video, step, cutoff) in their order: start and end of what is newly decoded, (start, end]; null where the cutoff doesn't advance."""
    before = F.max("cutoff").over(Window.partitionBy("video").orderBy("step").rowsBetween(Window.unboundedPreceding, -1))
    rows = questions.withColumn("_last", before)
    new = F.col("_last").isNull() | (F.col("cutoff") > F.col("_last"))
    return rows.select("video", "step", "cutoff", F.when(new, F.coalesce("_last", F.lit(0.0))).alias("start"), F.when(new, F.col("cutoff")).alias("end"))


def evict_frames(chunks: DataFrame, window: int) -> DataFrame:
    """Chunks with frames kept only in the last `window` chunks of a video."""
    back = F.row_number().over(Window.partitionBy("video").orderBy(F.desc("chunk")))
    return chunks.withColumn("_back", back).withColumn("frames", F.when(F.col("_back") <= window, F.col("frames"))).drop("_back")


def evicted_at(chunks: DataFrame, questions: DataFrame, window: int) -> DataFrame:
    """video, chunk, evicted: the first cutoff at which a chunk is no longer among the last `window` that have ended, when it passes on to memory.

    That is the first cutoff at or after the end of the chunk `window` places later.
    """
    later = F.lead("end_time", window).over(Window.partitionBy("video").orderBy("chunk"))
    rows = chunks.select("video", "chunk", later.alias("t"))
    cuts = questions.select("video", F.col("cutoff").alias("ts"), F.lit(0).cast("long").alias("frame_id"))
    found = first_at(cuts, rows.filter("t is not null").select("video", "t").distinct())
    return rows.join(found, ["video", "t"], "left").select("video", "chunk", F.col("ts").alias("evicted"))


def last_frames(frames: DataFrame, k: int) -> DataFrame:
    """The last k frames of each video."""
    back = F.row_number().over(Window.partitionBy("video").orderBy(F.desc("ts"), F.desc("frame_id")))
    return frames.withColumn("_back", back).filter(F.col("_back") <= k).drop("_back")


def recent_chunk_frames(frames: DataFrame, duration: float, window: int) -> DataFrame:
    """The last `window` frames of the last `window` chunks of each video, times repeated or not."""
    w = Window.partitionBy("video").orderBy(F.desc("chunk"))
    near = tumbling(frames, duration).withColumn("_c", F.dense_rank().over(w)).filter(F.col("_c") <= window).drop("_c", "chunk")
    return last_frames(near, window)


def cap_for(counting, count_cap: int, cap: int):
    """How many chunks are captioned at most: counting questions have a cap of their own (0: all)."""
    return F.when(counting, F.lit(count_cap)).otherwise(F.lit(cap))


def baseline_sample(frames: DataFrame, recent: int, stride: int, cap: int) -> DataFrame:
    """The last `recent` frames, and of those before every stride-th up to cap; part says which."""
    back = F.row_number().over(Window.partitionBy("video").orderBy(F.desc("ts"), F.desc("frame_id")))
    ranked = frames.withColumn("_back", back)
    old = stride_cap(ranked.filter(F.col("_back") > recent), stride, cap).withColumn("part", F.lit("history"))
    return old.unionByName(ranked.filter(F.col("_back") <= recent).withColumn("part", F.lit("recent"))).drop("_back")


def stride_gate(steps: DataFrame, stride: int, value: str) -> DataFrame:
    """steps (video, step, ...) in order: the value is taken anew at every stride-th step and carried in between."""
    w = Window.partitionBy("video").orderBy("step")
    rows = steps.withColumn("_i", F.row_number().over(w) - 1).withColumn("looked", F.col("_i") % stride == 0)
    return rows.withColumn("held", F.last(F.when(F.col("looked"), F.col(value)), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_i")


def zipped(frames: DataFrame, ids: str, times: str) -> DataFrame:
    """Frames and their times (two arrays) as one array of structs; null where they don't match or a time isn't finite."""
    finite = F.forall(times, lambda t: t.isNotNull() & ~F.isnan(t) & (F.abs(t) < float("inf")))
    return frames.withColumn("zipped", F.when((F.size(ids) == F.size(times)) & finite, F.arrays_zip(ids, times)))


def valid_cutoff(c):
    """Whether a cutoff is finite and not negative."""
    return F.coalesce(~F.isnan(c) & (c >= 0) & (c < float("inf")), F.lit(False))


def out_of_order(history: DataFrame, recent: DataFrame) -> DataFrame:
    """video, violations: history frames that are not before the first recent frame."""
    first = recent.groupBy("video").agg(F.min("ts").alias("_first"))
    return history.join(first, "video", "left").groupBy("video").agg(F.count_if(F.col("ts") >= F.col("_first")).alias("violations"))


def first_n(rows: DataFrame, by: str, order: list[str], per_group: int, groups: int | None = None) -> DataFrame:
    """The first rows of each group, and of the first groups only, in the order of the columns."""
    out = rows.withColumn("_n", F.row_number().over(Window.partitionBy(by).orderBy(*order))).filter(F.col("_n") <= per_group).drop("_n")
    if groups is None:
        return out
    return out.join(F.broadcast(rows.select(by).distinct().orderBy(by).limit(groups)), by, "left_semi")


def shard_of(rows: DataFrame, order: list[str], shards: int) -> DataFrame:
    """Adds shard: an even contiguous split by the order of the columns; the first shards get what is left over.

    Places come from range partitions and their sizes, so no task sorts all rows.
    """
    ranged = rows.repartitionByRange(*order).withColumn("_part", F.spark_partition_id())
    sizes = ranged.groupBy("_part").agg(F.count("*").alias("_size"))
    before = F.coalesce(F.sum("_size").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("_part", before.alias("_start"))
    total = sizes.agg(F.sum("_size").alias("_total"))
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1
    out = ranged.withColumn("_i", inside).join(F.broadcast(starts), "_part").join(F.broadcast(total))
    place, q, r = F.col("_start") + F.col("_i"), F.floor(F.col("_total") / shards), F.col("_total") % shards
    head = r * (q + 1)
    shard = F.when(place < head, F.floor(place / (q + 1))).otherwise(r + F.floor((place - head) / F.greatest(q, F.lit(1))))
    return out.withColumn("shard", shard.cast("int")).drop("_part", "_start", "_total", "_i")
