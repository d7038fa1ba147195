"""State over ordered cutoffs: running counts, latches, sessions, cooldowns."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _upto(*order: str) -> Window:
    return Window.partitionBy("video").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)


def running_count(steps: DataFrame, max_delta: int = 2, cap: int = 0) -> DataFrame:
    """steps: video, cutoff, label (a letter or null). A letter's place up to max_delta is what it adds; the count runs over the cutoffs.

    A cutoff that isn't later than the one before is carried: it adds nothing and counts no label. With a cap the sum
    is cut after each step, which is the same as cutting the whole sum, since no step is negative.
    """
    w = Window.partitionBy("video").orderBy("cutoff", "step")
    carried = F.coalesce(F.col("cutoff") <= F.lag("cutoff").over(w), F.lit(False))
    delta = F.ascii("label") - F.ascii(F.lit("A"))
    delta = F.when(carried | F.col("label").isNull() | (delta > max_delta) | (delta < 0), 0).otherwise(delta)
    total = F.sum("delta").over(_upto("cutoff", "step"))
    out = steps.withColumns({"carried": carried, "delta": delta.cast("int")})
    out = out.withColumn("count", (F.least(total, F.lit(cap)) if cap else total).cast("int"))
    labels = [F.sum(F.when(~F.col("carried") & (F.coalesce("label", F.lit("A")) == x), 1).otherwise(0)).over(_upto("cutoff", "step")).cast("int").alias(f"n_{x.lower()}") for x in "ABC"]
    return out.select("video", "step", "cutoff", "label", "delta", "count", *labels)


def monotone(rows: DataFrame, column: str) -> DataFrame:
    """Adds clamped (the largest so far) and clamped_from (the value that was raised, else null)."""
    top = F.max(column).over(_upto("cutoff", "step"))
    return rows.withColumn("clamped", top).withColumn("clamped_from", F.when(F.col("clamped") > F.col(column), F.col(column)))


def latch(rows: DataFrame) -> DataFrame:
    """rows: video, step, cutoff, label. Yes from the first A on; later rows are not looked at (label A, looked false)."""
    before = Window.partitionBy("video").orderBy("cutoff", "step").rowsBetween(Window.unboundedPreceding, -1)
    done = F.coalesce(F.max((F.col("label") == "A").cast("int")).over(before), F.lit(0)) == 1
    valid = F.when(F.col("label").isin("A", "B", "C"), F.col("label")).otherwise("C")
    out = rows.withColumn("done", done).withColumn("seen", F.when(F.col("done"), "A").otherwise(valid))
    return out.select("video", "step", "cutoff", F.col("seen").alias("label"), F.when(F.col("seen") == "A", "Yes").otherwise("No").alias("response"), (~F.col("done")).alias("looked"))


def running_or(rows: DataFrame) -> DataFrame:
    """Yes once any answer so far was yes."""
    return rows.withColumn("response", F.when(F.max((F.col("response") == "Yes").cast("int")).over(_upto("cutoff", "step")) == 1, "Yes").otherwise("No"))


def peak_sessions(peaks: DataFrame, gap: float) -> DataFrame:
    """peaks: video, ts. Sessions part where the gap is larger than `gap`: video, session, start, end, n."""
    w = Window.partitionBy("video").orderBy("ts")
    new = F.coalesce((F.col("ts") - F.lag("ts").over(w) > gap).cast("int"), F.lit(1))
    cut = peaks.withColumn("_new", new).withColumn("session", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("int"))
    return cut.groupBy("video", "session").agg(F.min("ts").alias("start"), F.max("ts").alias("end"), F.count("*").alias("n"))


def cooldown(steps: DataFrame, seconds: float) -> DataFrame:
    """steps: video, ts, frame_id, delta. A positive delta within `seconds` of the last accepted one is suppressed.

    What is accepted depends on what was accepted before, so each video is folded once over its ordered deltas; only
    positive deltas, with their times, are gathered, and the fold is a JVM expression.
    """
    ordered = F.sort_array(F.collect_list(F.struct("ts", "frame_id", "delta")))
    grouped = steps.filter("delta > 0").groupBy("video").agg(ordered.alias("steps"))
    start = F.struct(F.lit(None).cast("double").alias("last"), F.lit(0).cast("long").alias("count"), F.lit(0).cast("long").alias("suppressed"))

    def fold(s, x):
        hit = s["last"].isNotNull() & (x["ts"] - s["last"] <= seconds)
        return F.struct(F.when(hit, s["last"]).otherwise(x["ts"]).alias("last"), (s["count"] + F.when(hit, 0).otherwise(x["delta"])).cast("long").alias("count"), (s["suppressed"] + hit.cast("long")).alias("suppressed"))

    return grouped.select("video", F.aggregate("steps", start, fold).alias("s")).select("video", F.col("s.count").alias("count"), F.col("s.suppressed").alias("suppressed"), F.col("s.last").alias("last_event_time"))


def hybrid(events: DataFrame, story: DataFrame) -> DataFrame:
    """The event count if there is one, else the storyboard's, else 0."""
    return events.join(story, "video", "full_outer").select("video", F.coalesce(F.nullif(F.col("event_count"), F.lit(0)), "story_count", F.lit(0)).alias("count"))


def tail_context(captions: DataFrame, questions: DataFrame, seconds: float = 45.0, most: int = 48, width: int = 220) -> DataFrame:
    """The captions of the last seconds before each cutoff, or of all before it if there are none; the last `most`, cut at `width`."""
    from .chunks import last_rows

    seen = last_rows(captions, questions, most).withColumn("near", F.col("ts") >= F.col("cutoff") - seconds)
    by = ["video", "cutoff"]
    # If there is any near caption, the last one is.
    seen = seen.withColumn("_any", F.max(F.col("near").cast("int")).over(Window.partitionBy(*by))).filter(F.col("near") | (F.col("_any") == 0))
    lines = F.transform(F.sort_array(F.collect_list(F.struct("ts", "frame_id", F.substring("caption", 1, width).alias("caption")))), lambda x: x["caption"])
    return seen.groupBy(*by).agg(F.count("*").alias("n"), F.array_join(lines, "\n").alias("context"))


def question_counts(steps: DataFrame, max_delta: int = 6) -> DataFrame:
    """steps: video, step, question, cutoff, label, options. A running count for each normalised question of a video.

    A cutoff that isn't later than every one before is carried: it adds nothing, counts no label, and moves nothing. A
    label out of range counts as the last, unclear. answer is the option nearest to the count.
    """
    from ..functions import text as X

    rows = steps.withColumn("key", X.question_key("question"))
    w = Window.partitionBy("video", "key").orderBy("step")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    carried = F.col("cutoff") <= F.coalesce(F.max("cutoff").over(before), F.lit(0.0))
    last = chr(66 + max_delta)
    label = F.when(F.col("label").between("A", last), F.col("label")).otherwise(last)
    place = F.ascii("seen") - F.ascii(F.lit("A"))
    rows = rows.withColumn("carried", carried).withColumn("seen", F.when(F.col("carried"), "A").otherwise(label))
    rows = rows.withColumn("delta", F.when(F.col("carried") | (place > max_delta), 0).otherwise(place))
    rows = rows.withColumn("count", F.sum("delta").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("int"))
    return rows.select("video", "key", "step", "cutoff", F.col("seen").alias("label"), F.col("delta").cast("int").alias("delta"), "count", X.count_to_option("count", "options").alias("answer"))


def step_answers(rows: DataFrame) -> DataFrame:
    """rows: video, step, cutoff, answer (A or B, or words). Yes or No of the current step, each cutoff by itself; looked is false where nothing was answered."""
    from ..functions import text as X

    said = X.yes_no("answer")
    return rows.select("video", "step", "cutoff", F.coalesce(said, F.lit("No")).alias("response"), said.isNotNull().alias("looked"))


def projected_states(counts: DataFrame) -> DataFrame:
    """The steps of a running count as updates of the task state "rec:count": video, key, ts, response, delta, label."""
    return counts.select("video", F.lit("rec:count").alias("key"), F.col("cutoff").alias("ts"), F.col("count").cast("string").alias("response"), F.col("delta").cast("string").alias("delta"), F.coalesce("label", F.lit("A")).alias("label"))


def segment_counts(counts: DataFrame, cap: int = 0) -> DataFrame:
    """counts: video, segment, response. The sum of the first numbers in the responses of a video's segments, each and all capped."""
    from ..functions import text as X

    one = F.coalesce(X.clamp_count("response", cap), F.lit(0))
    total = F.sum(one)
    return counts.groupBy("video").agg((F.least(total, F.lit(cap)) if cap else total).alias("count"), F.count("*").alias("segments"))


PHASES = {"A": "PEAK_COMPLETE", "B": "ACTIVE_NONPEAK", "C": "RESET_IDLE", "D": "OTHER_ACTION", "E": "UNCLEAR"}


def phase_labels(chunks: DataFrame, stride: int) -> DataFrame:
    """chunks: video, chunk, mid, label. The phase of every stride-th chunk; a label that is none is unclear."""
    place = F.row_number().over(Window.partitionBy("video").orderBy("chunk")) - 1
    names = F.create_map(*[F.lit(x) for kv in PHASES.items() for x in kv])
    letter = F.when(F.col("label").isin(*PHASES), F.col("label")).otherwise("E")
    return chunks.withColumn("_i", place).filter(F.col("_i") % stride == 0).select("video", "chunk", "mid", letter.alias("label"), F.element_at(names, letter).alias("phase"))


def ordered_occurrences(items: DataFrame) -> DataFrame:
    """items: id, place, realtime. Adds turn, the place in the order of cutoffs in which items are looked at; place restores the order they came in."""
    return items.withColumn("turn", (F.row_number().over(Window.partitionBy("id").orderBy("realtime", "place")) - 1).cast("int"))
