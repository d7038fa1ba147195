"""Registered queries over the test tables, each with the DuckDB SQL of the same result.

Streams: events.user_id is the video, seconds since its first event the time, event_type the label. Captions are written
from a day of a stream in the six-section grammar. Questions are conversation turns and a few fixed ones, as cue words
hardly occur in invented text. Where a set of questions is searched against vectors, it is every vec_id divisible by 50.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import routing as R
from ..functions import text as X
from ..functions import values as V
from ..operators import chunks as C
from ..operators import interval as I
from ..operators import memory as M
from ..operators import retrieval as S
from ..operators import scoring as H
from ..sources.stored import stored
from ..streaming import live

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(sql: str | None = None):
    def register(f):
        name = f.__name__.removeprefix("q_")
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f

    return register


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


# ---- streams -----------------------------------------------------------------------------------------------------

DAY = 86400.0


#: Events for each task that writes captions: each becomes several observations there.
DEALT = 25_000


def frames(spark: SparkSession, d: str, dealt: bool = False) -> DataFrame:
    """video, ts, frame_id, label, value. dealt: in as many parts as captions of them need."""
    e = table(spark, d, "events").select(F.col("user_id").alias("video"), F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), F.col("event_id").alias("frame_id"), F.col("event_type").alias("label"), "value")
    # A window leaves the rows dealt by video, which all that follows can use; a join with the firsts would not.
    first = F.min("us").over(Window.partitionBy("video"))
    e = e.filter("video is not null")
    e = e.repartition(1 + e.count() // DEALT, "video") if dealt else e
    return e.select("video", ((F.col("us") - first) / F.lit(1e6)).alias("ts"), "frame_id", "label", "value")


FR = "frames as (select user_id as video, (epoch_us(ts) - min(epoch_us(ts)) over (partition by user_id)) / 1e6 as ts, event_id as frame_id, event_type as label, value from events)"
CUTS = FR + ", cuts as (select video, unnest([604800.0, 1209600.0, 1814400.0, 2419200.0])::double as cutoff from (select distinct video from frames))"


def cutoffs(fr: DataFrame) -> DataFrame:
    return fr.select("video").distinct().select("video", F.explode(F.array(*[F.lit(k * 7 * DAY) for k in range(1, 5)])).alias("cutoff"))


@query(f"with {FR} select video, floor(ts / 86400)::bigint as chunk, count(*) as n, md5(string_agg(frame_id::varchar, ',' order by ts, frame_id)) as ids from frames group by all")
def q_chunk_tumbling(spark, d):
    ids = F.transform(F.sort_array(F.collect_list(F.struct("ts", "frame_id"))), lambda x: x["frame_id"].cast("string"))
    return C.tumbling(frames(spark, d), DAY).groupBy("video", "chunk").agg(F.count("*").alias("n"), F.md5(F.array_join(ids, ",")).alias("ids"))


BOUNDS = f"{FR}, ends as (select video, max(ts + 1.0) as e from frames group by video), bounds as (select f.video, floor(ts / 86400)::bigint as chunk, count(*) as n, min(ts) as a, max(ts) as b, any_value(e) as e from frames f join ends using (video) group by 1, 2)"


@query(f"with {BOUNDS} select video, chunk, chunk * 86400.0::double as start_time, greatest(b, least((chunk + 1) * 86400.0::double, e)) as end_time from bounds")
def q_chunk_bounds(spark, d):
    return C.chunk_bounds(frames(spark, d), DAY).select("video", "chunk", "start_time", "end_time")


@query(f"with {BOUNDS} select video, chunk, round(case when n > 1 and b > a then (n - 1) / (b - a) else 1.0 end, 9) as fps from bounds")
def q_chunk_fps(spark, d):
    return C.chunk_bounds(frames(spark, d), DAY).select("video", "chunk", X.rounded("fps", 9).alias("fps"))


@query(f"with {FR}, r as (select *, floor(ts / 86400)::bigint as chunk, row_number() over (partition by video, floor(ts / 86400) order by ts, frame_id) - 1 as p, count(*) over (partition by video, floor(ts / 86400)) as n from frames) select video, chunk, frame_id as rep_id, ts as rep_ts from r where p = n // 2")
def q_representative_frame(spark, d):
    return C.representative(C.chunk_bounds(frames(spark, d), DAY)).select("video", "chunk", F.col("rep.frame_id").alias("rep_id"), F.col("rep.ts").alias("rep_ts"))


@query(f"with {FR} select video, floor(ts / 86400)::bigint as chunk, count(*) as n, min(frame_id) as least_id from frames group by all")
def q_chunk_upsert(spark, d):
    fr = frames(spark, d)
    old, new = (C.chunk_bounds(fr.filter(c), DAY).drop("fps") for c in ("frame_id % 2 = 0", "frame_id % 2 = 1 or frame_id % 6 = 0"))
    return C.upsert(old, new).select("video", "chunk", F.col("n").cast("long").alias("n"), F.array_min(F.transform("frames", lambda x: x["frame_id"])).alias("least_id"))


@query(f"with {CUTS} select video, cutoff, count(*) as n, max(ts) as last_ts from frames join cuts using (video) where ts <= cutoff group by all")
def q_causal_prefix(spark, d):
    fr = frames(spark, d)
    return C.causal(fr, cutoffs(fr)).groupBy("video", "cutoff").agg(F.count("*").alias("n"), F.max("ts").alias("last_ts"))


@query(f"with {CUTS}, {BOUNDS.removeprefix(FR + ', ')}, seen as (select video, cutoff, chunk, row_number() over (partition by video, cutoff order by chunk desc) as k from bounds join cuts using (video) where greatest(b, least((chunk + 1) * 86400.0::double, e)) <= cutoff) select video, cutoff, chunk, case when k <= 4 then 'recent' else 'history' end as part from seen")
def q_history_recent_split(spark, d):
    fr = frames(spark, d)
    return C.split_history(C.chunk_bounds(fr, DAY), cutoffs(fr), 4)


@query(f"with {CUTS}, s as (select video, cutoff, frame_id, ts, dense_rank() over (partition by video, cutoff order by floor(ts / 86400) desc) as c, row_number() over (partition by video, cutoff, ts order by frame_id) as t from frames join cuts using (video) where ts <= cutoff), r as (select *, row_number() over (partition by video, cutoff order by ts desc) as back from s where c <= 4 and t = 1) select video, cutoff, frame_id, ts, back::int as back from r where back <= 4")
def q_recent_distinct_frames(spark, d):
    fr = frames(spark, d)
    return C.recent_frames(fr, cutoffs(fr), DAY, 4)


@query(f"with {FR}, r as (select video, frame_id, row_number() over (partition by video order by ts, frame_id) - 1 as p from frames), k as (select video, frame_id, p // 3 as p, count(*) over (partition by video) as n from r where p % 3 = 0) select video, frame_id from k where n <= 8 or p in (select i * n // 8 from range(8) t(i))")
def q_stride_cap_sample(spark, d):
    return C.stride_cap(frames(spark, d), 3, 8).select("video", "frame_id")


UNI = "list_distinct(list_transform(range({k}), lambda i: round_even(i * ({n} - 1) / ({k} - 1.0), 0)::bigint))"


@query(f"with {FR}, r as (select video, frame_id, row_number() over (partition by video order by ts, frame_id) - 1 as p, count(*) over (partition by video) as n from frames) select video, frame_id from r where n <= 10 or list_contains({UNI.format(k='10', n='n')}, p)")
def q_uniform_sample(spark, d):
    return C.uniform(frames(spark, d), 10).select("video", "frame_id")


@query(f"with {CUTS}, i as (select video, cutoff, coalesce(lag(cutoff) over (partition by video order by cutoff), 0.0) as prev from cuts), s as (select video, cutoff, prev, frame_id, ts, max((ts <= prev)::int) over (partition by video, cutoff) = 1 as has_context, row_number() over (partition by video, cutoff order by ts, frame_id) - 1 as p, count(*) over (partition by video, cutoff) as n from frames join i using (video) where ts > greatest(0.0, prev - 86400) and ts <= cutoff) select video, cutoff, prev, frame_id, ts, has_context from s where n <= 6 or list_contains({UNI.format(k='6', n='n')}, p)")
def q_interval_sample_context(spark, d):
    fr = frames(spark, d)
    return C.interval_sample(fr, cutoffs(fr), DAY, 6)


@query(f"with {FR}, r as (select video, frame_id, row_number() over (partition by video order by ts, frame_id) - 1 as p, count(*) over (partition by video) as n from frames) select video, frame_id from r where n <= 12 or p >= n - 4 or (p < n - 4 and (n - 4 <= 8 or list_contains({UNI.format(k='8', n='(n - 4)')}, p)))")
def q_storyboard_sample(spark, d):
    return C.storyboard(frames(spark, d), 12, 4).select("video", "frame_id")


@query(f"with {FR}, n as (select video, count(distinct floor(ts / 86400)) as n from frames group by video), e as (select video, unnest(case when n + 1 <= least(5, n) + 1 then range(n + 1) else {UNI.format(k='(least(5, n) + 1)', n='(n + 1)')} end) as first from n), s as (select video, first, lead(first) over (partition by video order by first) as last, row_number() over (partition by video order by first) - 1 as segment from e) select video, segment::int as segment, first::int as first, last::int as last from s where last > first")
def q_segment_partition(spark, d):
    return C.segments(C.chunk_bounds(frames(spark, d), DAY), 5)


@query(f"with {BOUNDS}, m as (select video, chunk, (chunk * 86400.0::double + greatest(b, least((chunk + 1) * 86400.0::double, e))) / 2 as mid from bounds) select video, chunk, count(*) over w as n_context, round(sum(mid) over w, 3) as mids from m window w as (partition by video order by chunk rows between 2 preceding and current row)")
def q_phase_context(spark, d):
    out = C.phase_context(C.chunk_bounds(frames(spark, d), DAY), 3)
    return out.select("video", "chunk", F.size("context").cast("long").alias("n_context"), X.rounded(F.aggregate("context", F.lit(0.0), lambda a, x: a + x), 3).alias("mids"))


@query(f"with {FR} select video, frame_id, ((row_number() over w - 1) // 4)::int as sheet_row, ((row_number() over w - 1) % 4)::int as sheet_col from frames window w as (partition by video order by ts, frame_id)")
def q_contact_sheet(spark, d):
    return C.sheet_layout(frames(spark, d), 4)


@query(f"with {CUTS} select c.video, c.cutoff, arg_max(f.frame_id, (f.ts, f.frame_id)) as frame_id, max(f.ts) as end_time from cuts c join frames f on f.video = c.video and f.ts <= c.cutoff group by all")
def q_asof_state(spark, d):
    fr = frames(spark, d)
    states = fr.groupBy("video", F.col("ts").alias("end_time")).agg(F.max("frame_id").alias("frame_id"))
    return C.as_of(states, cutoffs(fr)).select("video", "cutoff", "frame_id", "end_time")


# ---- interval state ----------------------------------------------------------------------------------------------

LETTER = "case label when 'view' then 'A' when 'click' then 'B' when 'purchase' then 'C' when 'signup' then 'D' else null end"


def steps(spark: SparkSession, d: str) -> DataFrame:
    return frames(spark, d).select("video", F.col("frame_id").alias("step"), F.col("ts").alias("cutoff"), F.expr(LETTER).alias("label"), "value")


STEPS = f"{FR}, steps as (select video, frame_id as step, ts as cutoff, {LETTER} as label, value from frames), counted as (select *, coalesce(cutoff <= lag(cutoff) over w, false) as carried, ascii(label) - 65 as raw from steps window w as (partition by video order by cutoff, step)), ran as (select *, case when carried or raw is null or raw > 2 then 0 else raw end as delta from counted)"


@query(f"with {STEPS} select video, step, cutoff, label, delta::int as delta, (sum(delta) over w)::int as count, " + ", ".join(f"(sum((not carried and coalesce(label, 'A') = '{x}')::int) over w)::int as n_{x.lower()}" for x in "ABC") + " from ran window w as (partition by video order by cutoff, step rows unbounded preceding)")
def q_rec_running_count(spark, d):
    return I.running_count(steps(spark, d))


@query(f"with {STEPS} select video, step, max(round(value)::int) over (partition by video order by cutoff, step rows unbounded preceding) as clamped, case when max(round(value)::int) over (partition by video order by cutoff, step rows unbounded preceding) > round(value)::int then round(value)::int end as clamped_from from steps")
def q_monotone_clamp(spark, d):
    rows = steps(spark, d).withColumn("r", F.round("value").cast("int"))
    return I.monotone(rows, "r").select("video", "step", "clamped", "clamped_from")


@query(f"with {STEPS}, l as (select *, coalesce(max((coalesce(label, 'C') = 'A')::int) over (partition by video order by cutoff, step rows between unbounded preceding and 1 preceding), 0) = 1 as done from steps), m as (select *, case when done then 'A' when label in ('A', 'B', 'C') then label else 'C' end as seen from l) select video, step, cutoff, seen as label, case when seen = 'A' then 'Yes' else 'No' end as response, not done as looked from m")
def q_crr_latch(spark, d):
    return I.latch(steps(spark, d))


@query(f"with recursive {FR}, x as (select video, ts, row_number() over (partition by video order by ts, frame_id) as k, case label when 'click' then 1 else 2 end as delta from frames where label in ('click', 'purchase')), r as (select video, k, ts as last, delta::bigint as count, 0::bigint as suppressed from x where k = 1 union all select x.video, x.k, case when x.ts - r.last <= 43200 then r.last else x.ts end, r.count + case when x.ts - r.last <= 43200 then 0 else x.delta end, r.suppressed + (x.ts - r.last <= 43200)::bigint from r join x on x.video = r.video and x.k = r.k + 1) select video, arg_max(count, k) as count, arg_max(suppressed, k) as suppressed, arg_max(last, k) as last_event_time from r group by video")
def q_delta_cooldown(spark, d):
    delta = F.when(F.col("label") == "click", 1).when(F.col("label") == "purchase", 2).otherwise(0)
    return I.cooldown(frames(spark, d).withColumn("delta", delta), 43200.0)


SESSIONS = f"{FR}, p as (select video, ts, coalesce((ts - lag(ts) over (partition by video order by ts) > 86400)::int, 1) as new from frames where label = 'purchase'), s as (select *, sum(new) over (partition by video order by ts rows unbounded preceding) as session from p)"


@query(f"with {SESSIONS} select video, session::int as session, min(ts) as start, max(ts) as \"end\", count(*) as n from s group by video, session")
def q_peak_sessions(spark, d):
    return I.peak_sessions(frames(spark, d).filter("label = 'purchase'"), DAY)


@query(f"with {SESSIONS}, e as (select video, max(session)::bigint as c from s group by video), b as (select video, count(*) as c from frames where label = 'view' group by video) select coalesce(e.video, b.video) as video, coalesce(nullif(e.c, 0), b.c, 0)::bigint as count from e full join b on e.video = b.video")
def q_hybrid_count(spark, d):
    fr = frames(spark, d)
    events = I.peak_sessions(fr.filter("label = 'purchase'"), DAY).groupBy("video").agg(F.max("session").cast("long").alias("event_count"))
    return I.hybrid(events, fr.filter("label = 'view'").groupBy("video").agg(F.count("*").alias("story_count")))


@query(f"with {CUTS}, s as (select video, cutoff, ts, frame_id, label || ' seen at ' || frame_id::varchar as caption, ts >= cutoff - 172800 as near from frames join cuts using (video) where ts <= cutoff), t as (select *, max(near::int) over (partition by video, cutoff) as any0 from s), u as (select *, row_number() over (partition by video, cutoff order by ts desc, frame_id desc) as back from t where near or any0 = 0) select video, cutoff, count(*) as n, string_agg(left(caption, 12), chr(10) order by ts, frame_id) as context from u where back <= 5 group by all")
def q_tail_context(spark, d):
    fr = frames(spark, d)
    captions = fr.withColumn("caption", F.concat("label", F.lit(" seen at "), F.col("frame_id").cast("string")))
    return I.tail_context(captions, cutoffs(fr), 2 * DAY, 5, 12)


# ---- text --------------------------------------------------------------------------------------------------------

FIXED = (
    ("What is he doing right now?", ["A. cut", "B. wash"]), ("How many times did they jump so far?", ["A. one", "B. 2", "C. three", "D. 9"]),
    ("You're watching a video of a dive. Now, answer the following question: how many times has the diver jumped in total so far?\nOptions: A. before now", ["two", "four"]),
    ("What does the woman do after that?", ["was cut before", "had been cut", "is washing"]), ("Is she currently walking before the gate?", ["yes", "no"]), ("Which colour is it?", ["red", "blue"]),
    ("Count how many boxes were running", ["A. 1", "B. 5"]), ("", ["x"]), ("Respond only with a letter.\nQuestion: who previously won?", ["A) a", "B) b"]),
)


def questions(spark: SparkSession, d: str) -> DataFrame:
    """id, question, options: every user turn with the other turns of its conversation as options, and the fixed ones (negative ids)."""
    turns = table(spark, d, "conversations")
    answers = turns.filter("role <> 'user'").groupBy("conv_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]).alias("options"))
    asked = turns.filter("role = 'user'").join(answers, "conv_id", "left").select((F.col("conv_id") * 100000 + F.col("turn")).alias("id"), F.col("text").alias("question"), "options")
    fixed = spark.createDataFrame([(-1 - i, q, o) for i, (q, o) in enumerate(FIXED)], "id long, question string, options array<string>")
    return asked.unionByName(fixed)


def _lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


ASKED = (
    "asked as (select conv_id * 100000 + turn as id, text as question, options from (select * from conversations where role = 'user') u left join (select conv_id, list(text order by turn) as options from conversations where role <> 'user' group by conv_id) a using (conv_id) union all "
    + " union all ".join(f"select {-1 - i}, {_lit(q)}, [{', '.join(map(_lit, o))}]" for i, (q, o) in enumerate(FIXED))
    + ")"
)
_W = r"[\p{L}\p{M}\p{N}_]"


def _re2(pattern: str) -> str:
    """RE2 has ASCII \\b and \\w only, so their Unicode forms are spelled out; good for searching, not for offsets."""
    out, parts = "", pattern.split(r"\b")
    for i, p in enumerate(parts):
        out += p.replace(r"\w", _W)
        if i < len(parts) - 1:
            out += r"(?:^|[^\p{L}\p{M}\p{N}_])" if i == 0 and not parts[0] else r"(?:$|[^\p{L}\p{M}\p{N}_])"
    return out


def _scaffold_sql(c: str) -> str:
    out = f"coalesce({c}, '')"
    for p in V.SCAFFOLD:
        look, to = "(?=", " "
        if look in p:
            body, ahead = p.split(look)
            p, to = body + "(" + ahead, r" \1"
        out = f"regexp_replace({out}, {_lit('(?ims)' + p)}, {_lit(to)}, 'g')"
    return rf"trim(regexp_replace({out}, '\s+', ' ', 'g'))"


def _cues_sql(c: str, cues: dict[str, str]) -> str:
    return "list_filter([" + ", ".join(f"case when regexp_matches({c}, {_lit('(?i)' + _re2(p))}) then {_lit(n)} end" for n, p in cues.items()) + "], lambda n: n is not null)"


_VOTED = "list_filter([" + ", ".join(f"case when len(list_filter(bare_options, lambda o: regexp_matches(o, {_lit('(?i)' + _re2(p))}))) >= greatest(2, (len(options) + 1) // 2) then {_lit(n)} end" for n, p in V.MEMORY_CUES.items()) + "], lambda n: n is not null)"
_STRONG = "len(list_filter({m}, lambda n: n <> 'before/after')) > 0"
GATED = (
    f"{ASKED}, bare as (select *, {_scaffold_sql('question')} as bare, list_transform(options, lambda o: {_scaffold_sql('o')}) as bare_options from asked),"
    f" cued as (select *, {_cues_sql('bare', V.MEMORY_CUES)} as mem, {_cues_sql('bare', V.RECENT_CUES)} as rec, coalesce({_VOTED}, []) as voted from bare),"
    f" gated as (select *, case when {_STRONG.format(m='mem')} or (len(mem) > 0 and len(rec) = 0) then 'strong_memory' when len(rec) > 0 then 'strong_recent' when {_STRONG.format(m='voted')} then 'strong_memory' else 'ambiguous' end as bucket from cued)"
)


@query(f"with {ASKED} select id, md5({_scaffold_sql('question')}) as bare from asked")
def q_scaffold_strip(spark, d):
    return questions(spark, d).select("id", F.md5(R.strip_scaffold("question")).alias("bare"))


@query(f"with {GATED} select id, bucket, bucket <> 'strong_recent' as needs_memory, array_to_string(case when len(mem) = 0 and len(rec) = 0 and {_STRONG.format(m='voted')} then voted else mem end, ',') as memory_cues, array_to_string(rec, ',') as recent_cues from gated")
def q_gate_bucket(spark, d):
    g = questions(spark, d).select("id", R.gate("question", "options").alias("g"))
    return g.select("id", "g.bucket", "g.needs_memory", F.array_join("g.memory_cues", ",").alias("memory_cues"), F.array_join("g.recent_cues", ",").alias("recent_cues"))


@query(f"with {GATED} select id, array_to_string(voted, ',') as voted from gated where len(voted) > 0")
def q_gate_option_quorum(spark, d):
    return questions(spark, d).select("id", F.array_join(R.option_cues("options"), ",").alias("voted")).filter("voted <> ''")


@query(f"with {GATED} select id, case when bucket <> 'strong_recent' then 'hub_and_spoke_memory' else 'recent_window' end as method_family, 'uniform_abstention' as policy, bucket <> 'strong_recent' as use_memory, true as include_no_match_signal, case when bucket = 'ambiguous' then 0.70::double when bucket = 'strong_memory' then 0.55::double end as min_evidence_sim from gated")
def q_route_ovo(spark, d):
    return questions(spark, d).select("id", R.ovo_route(R.gate("question", "options")).alias("r")).select("id", "r.*")


_COUNTS = " or ".join(f"contains(lower(bare), {_lit(p)})" for p in V.COUNT_PHRASES)


@query(f"with {GATED}, routed as (select *, case when bucket = 'strong_recent' then 'recent_window' when {_COUNTS} then 'interval_state' else 'graph_memory' end as route from gated) select id, route, case when route = 'graph_memory' then case when bucket = 'ambiguous' then 0.55::double else 0.25::double end end as floor from routed")
def q_route_stream(spark, d):
    g = questions(spark, d).withColumn("g", R.gate("question", "options"))
    g = g.withColumn("route", R.stream_route("question", F.col("g")))
    return g.select("id", "route", R.stream_floor(F.col("route"), F.col("g"), 0.25, 0.55).alias("floor"))


def _stem_sql(w: str) -> str:
    s = f"regexp_extract({w}, '(ings?|ied|ed|es|s)$', 1)"
    cut = f"left({w}, len({w}) - len({s}))"
    double = f"({s} in ('ing', 'ings', 'ed', 'ied') and len({cut}) >= 3 and {cut}[-1] = {cut}[-2] and {cut}[-1] not in ('a', 'e', 'i', 'o', 'u'))"
    silent = f"({s} in ('ing', 'ings', 'ed', 'es') and regexp_matches({cut}, '^[^aeiou][aeiou][^aeiouwxy]$'))"
    return f"case when {s} = '' or {cut} = '' then {w} when {double} then left({cut}, len({cut}) - 1) when {silent} then {cut} || 'e' else {cut} end"


_WORDS = f"words as (select doc_id, unnest(regexp_extract_all(lower(text), '{_W}{{4,}}')) as w from documents), stems as (select distinct doc_id, {_stem_sql('w')} as s from words)"
_STOPS = f"stops as (select distinct {_stem_sql('w')} as s from (select unnest([{', '.join(map(_lit, V.COUNT_STOP_WORDS))}]) as w))"


@query(f"with {_WORDS} select d.doc_id, count(s) as n_stems, md5(coalesce(string_agg(s, ' ' order by s), '')) as stems from documents d left join stems using (doc_id) group by d.doc_id")
def q_keyword_stems(spark, d):
    return table(spark, d, "documents").select("doc_id", X.keywords("text").alias("k")).select("doc_id", F.size("k").cast("long").alias("n_stems"), F.md5(F.array_join("k", " ")).alias("stems"))


@query(f"with {_WORDS}, {_STOPS}, kept as (select * from stems where len(s) >= 3 and s not in (select s from stops)) select d.doc_id, count(s) as n_stems, md5(coalesce(string_agg(s, ' ' order by s), '')) as stems from documents d left join kept using (doc_id) group by d.doc_id")
def q_content_stems(spark, d):
    return table(spark, d, "documents").select("doc_id", X.content_stems("text").alias("k")).select("doc_id", F.size("k").cast("long").alias("n_stems"), F.md5(F.array_join("k", " ")).alias("stems"))


@query(
    f"with {ASKED}, a as (select id, question, regexp_extract_all(regexp_replace(question, '(?is)^.*answer the following question:', ''), '(?i)how many times\\s+(?:do(?:es)?|did|has|have|are|is|will)?\\s*(?:they|he|she|the\\s+\\S+|people|someone)?\\s*([^?.\\n]+)', 1) as f from asked),"
    " b as (select id, question, len(f) as k, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(trim(f[-1]), '[?. ]+$', ''), '(?i)^(?:in total|in all|in the video|total(?:ly)?|so far|now|have|has|had|been|did|do|does|are|is|was|were)\\s+', ''), '(?i)^(?:in total|in all|in the video|total(?:ly)?|so far|now|have|has|had|been|did|do|does|are|is|was|were)\\s+', ''), '(?i)^(?:in total|in all|in the video|total(?:ly)?|so far|now|have|has|had|been|did|do|does|are|is|was|were)\\s+', ''), '(?i)^(?:in total|in all|in the video|total(?:ly)?|so far|now|have|has|had|been|did|do|does|are|is|was|were)\\s+', '') as f from a)"
    " select id, case when k > 0 then coalesce(nullif(regexp_replace(trim(regexp_replace(f, '(?i)\\s+(?:so far|in total|up to now|to date|in the video|by now)\\b.*$', '')), '[?. ]+$', ''), ''), question) else question end as focus from b"
)
def q_count_focus(spark, d):
    return questions(spark, d).select("id", X.count_focus("question").alias("focus"))


@query(r"select doc_id, md5(trim(regexp_replace(lower(text), '\s+', ' ', 'g'))) as norm from documents")
def q_normalise_text(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(X.normalise("text")).alias("norm"))


_TRIMMED = "ltrim(substr(text, 3))"


@query(rf"select doc_id, md5(case when starts_with(lower(trim(text)), 'th') and len(regexp_replace({_TRIMMED}, '(?i)^(is|are|was|were|has|have)\s+', '')) > 3 then regexp_replace({_TRIMMED}, '(?i)^(is|are|was|were|has|have)\s+', '') else text end) as body from documents")
def q_strip_subject(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(X.strip_subject("text", F.lit("Th"))).alias("body"))


@query(f"with {FR} select frame_id, printf('%02d:%02d', floor(ts)::bigint // 60, floor(ts)::bigint % 60) as minutes, case when ts >= 3600 then printf('%02d:%02d:%02d', floor(ts)::bigint // 3600, floor(ts)::bigint % 3600 // 60, floor(ts)::bigint % 60) else printf('%02d:%02d', floor(ts)::bigint // 60, floor(ts)::bigint % 60) end as hours from frames")
def q_fmt_time(spark, d):
    return frames(spark, d).select("frame_id", X.minutes("ts").alias("minutes"), X.hours("ts").alias("hours"))


@query(f"with {FR} select frame_id, floor(ts)::double as seconds from frames")
def q_timestamp_to_seconds(spark, d):
    return frames(spark, d).select("frame_id", X.timestamp_to_seconds(X.hours("ts")).alias("seconds"))


_VALUE = "coalesce(try_cast(regexp_extract(o0, '([0-9]+)', 1) as int), " + ", ".join(f"case when regexp_matches(lower(o0), '\\b{w}\\b') then {v} end" for w, v in V.NUMBER_WORDS.items()) + ")"


@query(f"with o as (select event_id, greatest(0, round(value))::int as c, i, regexp_replace(opt, '(?i)^[A-Z]\\s*[.)]\\s*', '') as o0 from events, (select unnest(['A. two', 'B. 40', 'C. none', 'D) twelve times', 'eighty']) as opt, unnest(range(5)) as i)), p as (select event_id, c, i, {_VALUE} as v from o) select event_id, c as count, coalesce(chr((65 + arg_min(i, abs(v - c) * 10 + i) filter (v is not null))::int), 'A') as letter from p group by event_id, c")
def q_count_to_option(spark, d):
    options = F.array(*map(F.lit, ("A. two", "B. 40", "C. none", "D) twelve times", "eighty")))
    return table(spark, d, "events").select("event_id", F.greatest(F.lit(0), F.round("value").cast("int")).alias("count")).withColumn("letter", X.count_to_option("count", options))


@query("select conv_id, turn, coalesce(nullif(regexp_extract(upper(trim(r)), '(?:^|[^\\p{L}\\p{M}\\p{N}_])([A-F])(?:$|[^\\p{L}\\p{M}\\p{N}_])', 1), ''), chr(64 + try_cast(nullif(regexp_extract(upper(trim(r)), '(?:^|[^\\p{L}\\p{M}\\p{N}_])([1-6])(?:$|[^\\p{L}\\p{M}\\p{N}_])', 1), '') as int))) as letter from (select *, case turn % 3 when 0 then text when 1 then 'option ' || (conv_id % 9)::varchar else text || ' (c)' end as r from conversations)")
def q_mcq_letter(spark, d):
    r = F.when(F.col("turn") % 3 == 0, F.col("text")).when(F.col("turn") % 3 == 1, F.concat(F.lit("option "), (F.col("conv_id") % 9).cast("string"))).otherwise(F.concat("text", F.lit(" (c)")))
    return table(spark, d, "conversations").select("conv_id", "turn", X.mcq_letter(r).alias("letter"))


@query("select page_id, case when page_id % 3 = 0 then 'media/' || stem || '/video.mp4' when page_id % 3 = 1 then '/abs/' || stem || '.mp4' else 'media/' || stem || '.mp4' end as path from (select page_id, 'v' || page_id::varchar as stem from pages)")
def q_resolve_path(spark, d):
    stem = F.concat(F.lit("v"), F.col("page_id").cast("string"))
    path = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("./videos/"), stem, F.lit("_real.mp4"))).when(F.col("page_id") % 3 == 1, F.concat(F.lit("/abs/"), stem, F.lit(".mp4"))).otherwise(F.concat(stem, F.lit(".mp4")))
    return table(spark, d, "pages").select("page_id", X.resolve_path(path, "media").alias("path"))


@query(r"select conv_id, turn, md5(regexp_replace(trim(regexp_replace(lower(text), '\s+', ' ', 'g')), '[^\p{L}\p{M}\p{N}_\s]+', '', 'g')) as key, md5('v_' || turn::varchar || '_' || role || '_' || left(text, 80)) as row_key from conversations")
def q_question_keys(spark, d):
    t = table(spark, d, "conversations")
    return t.select("conv_id", "turn", F.md5(X.question_key("text")).alias("key"), F.md5(X.row_key(F.lit("v"), F.col("turn").cast("string"), F.col("role"), F.col("text"))).alias("row_key"))


# ---- captions and memory -----------------------------------------------------------------------------------------


def captions(spark: SparkSession, d: str) -> DataFrame:
    a, b = F.col("chunk") % 3, (F.col("video") + F.col("chunk")) % 4
    s = lambda c: c.cast("string")
    fr = C.tumbling(frames(spark, d, dealt=True), DAY)
    act = F.concat(F.lit("P"), s(a), F.lit(" "), F.col("label"), F.lit("s item "), s(F.col("frame_id") % 5))
    g = fr.groupBy("video", "chunk").agg(F.min("ts").alias("ts"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ts", "frame_id", act.alias("x")))), lambda r: r["x"]), "; ").alias("acts"))
    text = F.concat(
        F.lit("some words first\npeople: P"), s(a), F.lit(" (guest "), s(a), F.lit("): walking; P"), s(a), F.lit(": waving\n- OBJECTS : O"), s(b), F.lit(" (box "), s(b), F.lit(" of P"), s(a), F.lit(")\nACTIONS: "), F.col("acts"),
        F.lit(";\nNONE; x\nTEXT: code "), s(b), s(b), F.lit("; N/A\nSPATIAL: O"), s(b), F.lit(" near P"), s(a), F.lit("; O7 behind P"), s(a), F.lit("\nEVENT: guest "), s(a), F.lit(" saw box "), s(b),
    )
    return g.select("video", "chunk", "ts", text.alias("caption"))


CAP = (
    f"{FR}, cap0 as (select video, floor(ts / 86400)::bigint as chunk, min(ts) as ts, (floor(ts / 86400)::bigint % 3)::varchar as a, ((video + floor(ts / 86400)::bigint) % 4)::varchar as b, string_agg('P' || (floor(ts / 86400)::bigint % 3)::varchar || ' ' || label || 's item ' || (frame_id % 5)::varchar, '; ' order by ts, frame_id) as acts from frames f group by video, floor(f.ts / 86400)),"
    " cap as (select video, chunk, ts, 'some words first' || chr(10) || 'people: P' || a || ' (guest ' || a || '): walking; P' || a || ': waving' || chr(10) || '- OBJECTS : O' || b || ' (box ' || b || ' of P' || a || ')' || chr(10) || 'ACTIONS: ' || acts || ';' || chr(10) || 'NONE; x' || chr(10) || 'TEXT: code ' || b || b || '; N/A' || chr(10) || 'SPATIAL: O' || b || ' near P' || a || '; O7 behind P' || a || chr(10) || 'EVENT: guest ' || a || ' saw box ' || b as caption from cap0)"
)
_HDR = r"(?i)^(OBJECTS|PEOPLE|ACTIONS|TEXT|SPATIAL|EVENT)\s*:"
ITEMS = (
    f"{CAP}, lines as (select video, chunk, ts, unnest(range(len(l))) as i, unnest(l) as line from (select *, string_split(caption, chr(10)) as l from cap)), clean as (select *, trim(regexp_replace(trim(line), '^[-*•]\\s+', '')) as x from lines),"
    f" headed as (select *, upper(regexp_extract(x, '{_HDR}', 1)) as h from clean), sect as (select *, sum((h <> '')::int) over (partition by video, chunk order by i) as sp, case when h <> '' then trim(regexp_replace(x, '{_HDR}', '')) else x end as b from headed),"
    " bodies as (select video, chunk, ts, sp, max(h) as section, coalesce(string_agg(b, ' ' order by i) filter (b <> ''), '') as body from sect where sp > 0 group by video, chunk, ts, sp),"
    " items as (select video, chunk, ts, (sp - 1) * 10000 + ip as item, section, case section when 'OBJECTS' then 'entity' when 'PEOPLE' then 'entity' when 'ACTIONS' then 'action' when 'TEXT' then 'text_ocr' when 'SPATIAL' then 'spatial' else 'event' end as node_type, trim(t) as text from (select video, chunk, ts, sp, section, unnest(range(len(s))) as ip, unnest(s) as t from (select *, string_split(body, ';') as s from bodies)))"
)
OBS = (
    f"{ITEMS}, obs as (select video, chunk, ts, row_number() over (partition by video order by chunk, item) as seq, section, node_type, text from items where len(text) >= 5 and upper(text) not in ('NONE', 'N/A', '-')),"
    " keyed as (select *, case when node_type = 'entity' and regexp_matches(text, '^[PO][0-9]+\\b') then 'id:' || regexp_extract(text, '^([PO][0-9]+)\\b', 1) else node_type || ':' || trim(regexp_replace(lower(text), '\\s+', ' ', 'g')) end as key from obs)"
)


def nodes_sql(source: str = "keyed", cap: int = 300) -> str:
    return f"nodes as (select *, row_number() over (partition by video order by node_id) <= {cap} as admitted from (select video, key, min(seq) as node_id, arg_min(node_type, seq) as node_type, case when starts_with(key, 'id:') then trim(split_part(arg_min(text, seq), ':', 1)) else arg_min(text, seq) end as text, count(*) as n, count(distinct chunk) as n_chunks, min(ts) as first_seen, max(ts) as last_seen from {source} group by video, key))"


HUBS = (
    "refs as (select video, node_id, unnest(range(len(r))) as pos, unnest(r) as ref from (select video, node_id, regexp_extract_all(text, '\\b([PO][0-9]+)\\b', 1) as r from nodes where admitted and node_type <> 'entity')),"
    " attached as (select s.video, s.node_id, arg_min(h.node_id, s.pos) as hub from refs s join nodes h on h.video = s.video and h.key = 'id:' || s.ref and h.admitted and h.node_type = 'entity' and h.node_id < s.node_id group by all),"
    " linked as (select nodes.*, a.hub from nodes left join attached a using (video, node_id) where admitted)"
)


def log(spark: SparkSession, d: str) -> DataFrame:
    return M.observations(captions(spark, d))


@query(f"with {ITEMS} select video, chunk, item::bigint as item, section, node_type, text from items")
def q_caption_parse(spark, d):
    return M.parse_captions(captions(spark, d)).select("video", "chunk", F.col("item").cast("long").alias("item"), "section", "node_type", "text")


@query(f"with {ITEMS} select video, chunk, item::bigint as item, len(text) >= 5 and upper(text) not in ('NONE', 'N/A', '-') as accepted from items")
def q_reject_filter(spark, d):
    return M.parse_captions(captions(spark, d)).select("video", "chunk", F.col("item").cast("long").alias("item"), X.accepted("text").alias("accepted"))


@query(f"with {OBS} select video, chunk, ts, seq, section, node_type, text from obs")
def q_caption_items(spark, d):
    return log(spark, d)


@query(f"with {OBS} select video, seq, nullif(regexp_extract(text, '^([PO][0-9]+)\\b', 1), '') as own_id, array_to_string(regexp_extract_all(text, '\\b([PO][0-9]+)\\b', 1), ',') as refs, key from keyed")
def q_stable_ids(spark, d):
    return M.keyed(log(spark, d)).select("video", "seq", X.stable_id("text").alias("own_id"), F.array_join(X.referenced_ids("text"), ",").alias("refs"), "key")


_BARE = r"trim(regexp_replace(text, '^[PO][0-9]+\b\s*:?\s*', ''))"
_DESC = rf"regexp_replace(regexp_replace(regexp_replace(regexp_replace(case when starts_with({_BARE}, '(') and contains({_BARE}, ')') then regexp_extract({_BARE}, '(?s)^\(([^)]*)\)', 1) else split_part({_BARE}, ':', 1) end, '\bP[0-9]+\b', 'person', 'g'), '\bO[0-9]+\b', 'object', 'g'), '\s+', ' ', 'g'), '^[ ()]+|[ ()]+$', '', 'g')"


@query(f"with {OBS} select video, seq, {_DESC} as description from obs where node_type = 'entity'")
def q_entity_description(spark, d):
    return log(spark, d).filter("node_type = 'entity'").select("video", "seq", X.entity_description("text").alias("description"))


@query(f"with {OBS}, {nodes_sql()} select video, key, node_id, node_type, text, n, n_chunks, first_seen, last_seen from nodes where admitted")
def q_node_merge(spark, d):
    return M.nodes(log(spark, d)).filter("admitted").drop("admitted")


@query(f"with {OBS}, k as (select *, case when node_type = 'entity' then key else key || '#' || seq::varchar end as k2 from keyed), {nodes_sql('(select * exclude (key) rename (k2 as key) from k)')} select video, node_id, n from nodes where admitted")
def q_node_no_merge(spark, d):
    return M.nodes(log(spark, d), merge_spokes=False).filter("admitted").select("video", "node_id", "n")


@query(f"with {OBS}, {nodes_sql(cap=8)} select video, node_id, key, admitted from nodes")
def q_node_cap(spark, d):
    return M.nodes(log(spark, d), cap=8).select("video", "node_id", "key", "admitted")


@query(f"with {OBS}, {nodes_sql('(select * from keyed where chunk % 3 <> 1)', 8)} select video, node_id, key, n, admitted from nodes")
def q_overflow_readmission(spark, d):
    rows = log(spark, d)
    gone = rows.filter("chunk % 3 = 1").select("video", "chunk").distinct()
    return M.nodes(M.retract(rows, gone), cap=8).select("video", "node_id", "key", "n", "admitted")


@query(f"with {OBS}, {nodes_sql()}, {HUBS} select video, node_id, hub from linked where node_type <> 'entity'")
def q_spoke_attach_id(spark, d):
    rows = log(spark, d)
    return M.with_hubs(rows, M.nodes(rows)).filter("node_type <> 'entity'").select("video", "node_id", "hub")


_EDGES = "seen as (select distinct video, chunk, key from keyed where node_type = 'entity'), edges as (select x.video, x.key as a, y.key as b, count(*) as support from seen x join seen y on x.video = y.video and x.chunk = y.chunk and x.key < y.key group by all)"


@query(f"with {OBS}, {_EDGES} select * from edges")
def q_caption_edges(spark, d):
    return M.edges(log(spark, d))


@query("select x.l_partkey as a, y.l_partkey as b, count(distinct x.l_orderkey) as support from (select distinct l_orderkey, l_partkey from lineitem) x join (select distinct l_orderkey, l_partkey from lineitem) y on x.l_orderkey = y.l_orderkey and x.l_partkey < y.l_partkey group by all")
def q_cooccurrence_edges(spark, d):
    li = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("chunk"), F.col("l_partkey").alias("key"))
    return M.pair_counts(li, ["chunk"], most=1_000_000)


_CHAIN = "chain as (select video, node_id, lead(node_id, 1) over w as next1, lead(node_id, 2) over w as next2 from linked where node_type = 'action' and hub is not null window w as (partition by video, hub order by node_id))"


@query(f"with {OBS}, {nodes_sql()}, {HUBS}, {_CHAIN} select * from chain")
def q_action_chain(spark, d):
    rows = log(spark, d)
    return M.chains(M.with_hubs(rows, M.nodes(rows))).drop("hub")


@query(f"with {OBS}, kept as (select * from keyed where chunk % 4 <> 2), {nodes_sql('kept')} select video, key, node_id, n, first_seen, last_seen from nodes where admitted")
def q_retract_chunks(spark, d):
    rows = log(spark, d)
    return M.nodes(M.retract(rows, rows.filter("chunk % 4 = 2").select("video", "chunk").distinct())).filter("admitted").select("video", "key", "node_id", "n", "first_seen", "last_seen")


@query(f"with {OBS}, {nodes_sql()} select video, count_if(admitted)::bigint as total_nodes, " + ", ".join(f"count_if(admitted and node_type = '{k}')::bigint as n_{k}" for k in ("entity", "action", "text_ocr", "spatial", "event")) + ", count_if(not admitted)::bigint as overflow from nodes group by video")
def q_memory_stats(spark, d):
    return M.stats(M.nodes(log(spark, d)))


_REF = "regexp_replace({t}, '\\b{k}\\b', '\x01{k}\x02', 'g')"


@query(
    f"with {OBS}, t as (select video, chunk, seq, node_type, text, (chunk % 3)::varchar as a, ((video + chunk) % 4)::varchar as b from obs where node_type <> 'entity')"
    " select video, chunk, seq, case when node_type = 'text_ocr' then text else regexp_replace(regexp_replace(regexp_replace(text, '\\bP' || a || '\\b', 'G' || a || ' (guest ' || a || ')', 'g'), '\\bO' || b || '\\b', '[unresolved object reference]', 'g'), '\\bO7\\b', '[unresolved object reference]', 'g') end as text from t"
)
def q_reference_rewrite(spark, d):
    rows = log(spark, d)
    a, b = (F.col("chunk") % 3).cast("string"), ((F.col("video") + F.col("chunk")) % 4).cast("string")
    keys = rows.select("video", "chunk").distinct()
    person = keys.select("video", "chunk", F.concat(F.lit("P"), a).alias("local_id"), F.concat(F.lit("G"), a).alias("gid"), F.concat(F.lit("guest "), a).alias("description"))
    twice = keys.select("video", "chunk", F.concat(F.lit("O"), b).alias("local_id"), F.explode(F.array(F.lit("X1"), F.lit("X2"))).alias("gid"), F.lit("box").alias("description"))
    items = rows.filter("node_type <> 'entity'").select("video", "chunk", "seq", "node_type", "text")
    return M.rewrite_references(items, person.unionByName(twice)).select("video", "chunk", "seq", "text")


@query("select user_id as video, event_type as key, count(*) as n, arg_max(event_id, (epoch_us(ts), event_id)) as response from events group by all")
def q_task_state(spark, d):
    rows = table(spark, d, "events").select(F.col("user_id").alias("video"), F.col("event_type").alias("key"), F.unix_micros(F.col("ts").cast("timestamp")).alias("ts"), F.col("event_id").alias("response"))
    return M.task_states(rows).select("video", "key", "n", "response")


# ---- retrieval ---------------------------------------------------------------------------------------------------

K, THRESHOLD, FLOOR = 12, 0.15, 0.2


def vectors(spark: SparkSession, d: str, id_name: str = "node_id") -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias(id_name), F.col("embedding").cast("array<double>").alias("vector"))


def asked_vectors(spark: SparkSession, d: str) -> DataFrame:
    return vectors(spark, d, "qid").filter("qid % 50 = 0")


TOP = f"sims as (select q.vec_id as qid, n.vec_id as node_id, round(list_dot_product(q.embedding::double[], n.embedding::double[]), 6) as sim from embeddings q join embeddings n on q.vec_id % 50 = 0 and q.vec_id <> n.vec_id), top as (select *, row_number() over (partition by qid order by sim desc, node_id) as rank from sims qualify rank <= {K})"
CUT = (
    f"{TOP}, hit as (select * from top where sim >= {THRESHOLD}), gaps as (select *, round(sim - lead(sim) over (partition by qid order by rank), 6) as gap from hit),"
    f" stat as (select qid, max(sim) as best, max(gap) as widest, median(gap) as middle, arg_min(rank, (-gap, rank)) filter (gap is not null) as place from gaps group by qid),"
    f" cut as (select h.qid, h.node_id, h.sim, h.rank from hit h join stat s using (qid) where not coalesce(widest >= greatest(0.05, 0.12 * greatest(0.0, best - {THRESHOLD})) and widest >= 2 * middle, false) or h.rank <= place)"
)


@query(f"with {TOP} select qid, node_id, sim, rank::int as rank from top")
def q_topk_cosine(spark, d):
    return S.top_k(asked_vectors(spark, d), vectors(spark, d), K)


@query(f"with {TOP} select qid, node_id, sim, rank::int as rank from top where sim >= {THRESHOLD}")
def q_topk_threshold(spark, d):
    return S.above(S.top_k(asked_vectors(spark, d), vectors(spark, d), K), THRESHOLD)


@query(f"with {CUT} select qid, node_id, sim, rank::int as rank from cut")
def q_topk_gap_cutoff(spark, d):
    return S.gap_cutoff(q_topk_threshold(spark, d), THRESHOLD).select("qid", "node_id", "sim", "rank")


@query(f"with {CUT} select qid, node_id, sim, rank::int as rank from cut where sim >= {FLOOR}")
def q_topk_floor(spark, d):
    return S.above(q_topk_gap_cutoff(spark, d), FLOOR)


NEAR = "n as (select s.vec_id as node_id, h.vec_id as hub, round(list_dot_product(s.embedding::double[], h.embedding::double[]), 6) as sim from embeddings s join embeddings h on h.vec_id % 50 = 0 and s.vec_id % 50 <> 0), b as (select *, row_number() over (partition by node_id order by sim desc, hub) as k from n qualify k = 1)"


@query(f"with {NEAR} select node_id, hub, sim from b")
def q_nearest_hub(spark, d):
    return S.nearest(vectors(spark, d).filter("node_id % 50 <> 0"), asked_vectors(spark, d))


@query(f"with {NEAR} select node_id, case when sim >= 0.25 then hub end as hub, sim from b")
def q_nearest_hub_threshold(spark, d):
    return S.nearest(vectors(spark, d).filter("node_id % 50 <> 0"), asked_vectors(spark, d), 0.25)


@query()
def q_entity_resolution(spark, d):
    """No SQL: each decision depends on the entities made before. Tests hold it against a plain loop."""
    rows = table(spark, d, "embeddings").select(F.col("label").cast("long").alias("video"), F.expr("vec_id div 25").alias("chunk"), F.col("vec_id").alias("pos"), F.when(F.col("vec_id") % 2 == 0, "P").otherwise("O").alias("kind"), F.col("embedding").alias("vector"))
    return M.resolve_entities(rows, 0.2)


def expanded(spark: SparkSession, d: str):
    # The log and the linked nodes are read by several branches; written once, each is computed once.
    rows = stored(log(spark, d), "log")
    linked = stored(M.with_hubs(rows, M.nodes(rows)), "linked")
    keys = linked.filter("node_type = 'entity'").select("video", "key", "node_id")
    edge = M.edges(rows).join(keys.select("video", F.col("key").alias("a"), F.col("node_id").alias("ia")), ["video", "a"]).join(keys.select("video", F.col("key").alias("b"), F.col("node_id").alias("ib")), ["video", "b"]).select("video", F.col("ia").alias("a"), F.col("ib").alias("b"))
    seeds = linked.filter("node_id % 5 = 1").select("video", "node_id")
    return S.expand(seeds, linked.select("video", "node_id", "node_type", "hub"), edge, M.chains(linked)), linked


EXPANDED = (
    f"{OBS}, {nodes_sql()}, {HUBS}, {_CHAIN}, {_EDGES}, seeds as (select video, node_id, node_type, hub from linked where node_id % 5 = 1),"
    " pairs as (select e.video, x.node_id as a, y.node_id as b from edges e join linked x on x.video = e.video and x.key = e.a join linked y on y.video = e.video and y.key = e.b),"
    " expanded as (select video, node_id from seeds union select l.video, l.node_id from linked l join seeds s on s.video = l.video and s.node_type = 'entity' and l.hub = s.node_id union select video, hub from seeds where node_type <> 'entity' and hub is not null"
    " union select p.video, p.b from pairs p join seeds s on s.video = p.video and s.node_type = 'entity' and s.node_id = p.a union select p.video, p.a from pairs p join seeds s on s.video = p.video and s.node_type = 'entity' and s.node_id = p.b"
    " union select c.video, unnest([c.next1, c.next2]) from chain c join seeds s on s.video = c.video and s.node_id = c.node_id and s.node_type = 'action' and s.hub is not null)"
)


@query(f"with {EXPANDED} select video, node_id from expanded where node_id is not null")
def q_expand_one_hop(spark, d):
    return expanded(spark, d)[0]


_CLOCK = "printf('[%02d:%02d] ', floor(s.first_seen)::bigint // 60, floor(s.first_seen)::bigint % 60)"
_TIMES = "case when s.n > 1 then ' (×' || s.n::varchar || ')' else '' end"
_REST = r"regexp_replace(ltrim(substr(s.text, len(trim(h.text)) + 1)), '(?i)^(is|are|was|were|has|have)\s+', '')"


@query(
    f"with {EXPANDED}, shown as (select l.* from linked l join expanded e using (video, node_id)), hub as (select * from shown where node_type = 'entity'),"
    f" body as (select s.video, s.node_id, s.node_type, s.first_seen, h.node_id as hub, s.text, case when s.node_type in ('action', 'event') then {_CLOCK} else '' end as clock, {_TIMES} as times, case when starts_with(lower(trim(s.text)), lower(trim(h.text))) and len({_REST}) > 3 then {_REST} else s.text end as own from shown s left join hub h on h.video = s.video and h.node_id = s.hub where s.node_type <> 'entity'),"
    " body_lines as (select video, hub, string_agg('  ' || clock || own || times, chr(10) order by (node_type = 'spatial')::int, first_seen, node_id) as l from body where hub is not null and node_type in ('action', 'event', 'spatial') group by all),"
    " blocks as (select h.video, 0 as b, h.first_seen as t, h.node_id as id, concat_ws(chr(10), '[' || h.text || ']' || case when h.n > 1 then ' ×' || h.n::varchar else '' end, l.l) as block from hub h left join body_lines l on l.video = h.video and l.hub = h.node_id"
    " union all select video, 1, 0, 0, '[Other]' || chr(10) || string_agg('  • ' || clock || text || times, chr(10) order by first_seen, node_id) from body where hub is null and node_type <> 'text_ocr' group by video"
    " union all select video, 2, 0, 0, '[Screen Text]' || chr(10) || string_agg('  • \"' || text || '\"', chr(10) order by node_id) from body where node_type = 'text_ocr' group by video)"
    " select video, string_agg(block, chr(10) || chr(10) order by b, t, id) as context from blocks group by video"
)
def q_render_context(spark, d):
    found, linked = expanded(spark, d)
    return S.render(found, linked)


@query(f"with {OBS} select video, ts, text, (row_number() over (partition by video order by ts desc, seq desc))::int as back from obs where node_type = 'event' qualify back <= 6")
def q_recency_events(spark, d):
    return S.recency_events(M.timeline(log(spark, d))).select("video", "ts", "text", "back")


def stream_questions(fr: DataFrame) -> DataFrame:
    asked = F.when(F.col("video") % 2 == 0, "How many times did the guest click so far?").otherwise("Where are purples?")
    return fr.select("video").distinct().select("video", asked.alias("question"))


_SQ = "sq as (select distinct video, case when video % 2 = 0 then 'How many times did the guest click so far?' else 'Where are purples?' end as question from frames)"


def _stems_of(c: str) -> str:
    w = f"list_distinct(list_transform(regexp_extract_all(lower({c}), '{_W}{{4,}}'), lambda w: {_stem_sql('w')}))"
    return w


@query(
    f"with {OBS}, {_SQ}, tl as (select *, row_number() over (partition by video order by seq desc) as back from obs where node_type = 'event'), r as (select t.*, q.question, list_has_any({_stems_of('t.text')}, {_stems_of('q.question')}) as hit from tl t join sq q using (video)), s as (select *, max(hit::int) over (partition by video, question) as any0 from r), k as (select * from s where hit or (any0 = 0 and back <= 8)) select video, question, (row_number() over (partition by video, question order by ts, seq))::int as place, ts, text from k qualify place <= 10"
)
def q_timeline_overlap(spark, d):
    return S.timeline_overlap(M.timeline(log(spark, d)), stream_questions(frames(spark, d)))


@query(
    f"with {OBS}, {_SQ}, {_STOPS}, fs as (select video, question, unnest({_stems_of('case when video % 2 = 0 then ' + _lit('click') + ' else question end')}) as stem from sq), fk as (select * from fs where len(stem) >= 3 and stem not in (select s from stops)),"
    f" acts as (select video, seq, text, round(ts, 1) as t, unnest({_stems_of('text')}) as stem from obs where node_type = 'action'), c as (select k.video, k.question, k.stem, count(distinct t) as n, arg_min(text, seq) as sample from fk k join acts a on a.video = k.video and a.stem = k.stem group by all) select video, question, stem, n, sample, (row_number() over (partition by video, question order by n desc, stem))::int as rank from c qualify rank <= 5"
)
def q_count_by_stem(spark, d):
    return S.count_by_stem(log(spark, d).filter("node_type = 'action'"), stream_questions(frames(spark, d)))


# ---- scoring and runs --------------------------------------------------------------------------------------------


def marks(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "lang", "source"), "doc_id").select("doc_id", "lang", "source", F.col("quality").alias("mark"), "toxic")


MARKS = "marks as (select doc_id, lang, source, quality as mark, toxic from labels join documents using (doc_id))"


@query(f"with {MARKS} select lang, source, sum(mark)::bigint as correct, count(*) as total, round(100.0::double * sum(mark) / count(*), 6) as accuracy from marks group by all")
def q_accuracy_by_task(spark, d):
    return H.accuracy(marks(spark, d), "lang", "source")


@query(f"with {MARKS}, t as (select lang, source, round(100.0::double * sum(mark) / count(*), 6) as a from marks group by all), s as (select lang, avg(a) as mean, count(*) as n_tasks from t group by lang) select lang, round(mean, 6) as mean, n_tasks from s union all select null, round(avg(mean), 6), sum(n_tasks)::bigint from s having sum(n_tasks) = 80")
def q_macro_average(spark, d):
    return H.macro_average(marks(spark, d), "lang", "source", 80).select("lang", "mean", "n_tasks")


@query(f"with {MARKS} select route, task, sum(mark)::bigint as correct, count(*) as total, sum(toxic)::bigint as errors from (select *, coalesce(nullif(trim(lang), ''), 'unknown') as route, coalesce(nullif(trim(source), ''), 'unknown') as task from marks) group by grouping sets ((), (route), (task))")
def q_summary_grouping_sets(spark, d):
    return H.summary(marks(spark, d), "lang", "source", "toxic").select("route", "task", "correct", "total", "errors")


@query(f"with {MARKS} select lang as route, source as task, count(*) as n from marks group by grouping sets ((lang), (source, lang))")
def q_route_histogram(spark, d):
    return H.histogram(marks(spark, d).select(F.col("lang").alias("route"), F.col("source").alias("task"))).select("route", "task", "n")


@query(f"with {MARKS} select 'mark' as method, sum(mark)::bigint as correct, count(mark) as total from marks union all select 'toxic', sum(toxic)::bigint, count(toxic) from marks")
def q_method_scoreboard(spark, d):
    return H.scoreboard(marks(spark, d), ["mark", "toxic"])


_TASK = "case event_id % 3 when 0 then 'REC' when 1 then 'SSR' else 'CRR' end"


@query(f"with f as (select event_id, {_TASK} as task, case event_id % 5 when 0 then 'There are ' || (event_id % 4)::varchar when 1 then 'Yes' when 2 then 'I KNOW it' when 3 then null else 'n' end as response, (event_id % 3)::int as count, (event_id % 2)::int as type from events) select event_id, task, (case when task = 'REC' then regexp_replace(coalesce(response, ''), '[^0-9]', '', 'g') = count::varchar else (type = 0 and (upper(trim(coalesce(response, ''))) = 'N' or contains(upper(coalesce(response, '')), 'NO'))) or (type = 1 and (upper(trim(coalesce(response, ''))) = 'Y' or contains(upper(coalesce(response, '')), 'YES'))) end)::int as mark from f")
def q_forward_marks(spark, d):
    i = F.col("event_id")
    response = F.when(i % 5 == 0, F.concat(F.lit("There are "), (i % 4).cast("string"))).when(i % 5 == 1, "Yes").when(i % 5 == 2, "I KNOW it").when(i % 5 == 4, "n")
    rows = table(spark, d, "events").select(i, F.expr(_TASK).alias("task"), response.alias("response"), (i % 3).cast("int").alias("count"), (i % 2).cast("int").alias("type"))
    return H.forward_marks(rows).select("event_id", "task", "mark")


def shards(spark: SparkSession, d: str) -> DataFrame:
    """Conversation turns as rows of four shards; every fifth is also in the next shard, and every seventh has no key."""
    t = table(spark, d, "conversations")
    key = F.when((F.col("conv_id") + F.col("turn")) % 7 != 0, F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string")))
    rows = t.select(key.alias("key"), (F.col("conv_id") % 4).alias("rank"), (F.col("conv_id") * 1000 + F.col("turn")).alias("line"), F.col("role").alias("response"))
    return rows.unionByName(rows.filter("line % 5 = 0").select("key", ((F.col("rank") + 1) % 4).alias("rank"), "line", F.lit("again").alias("response")))


SHARDS = "one as (select case when (conv_id + turn) % 7 <> 0 then conv_id::varchar || ':' || turn::varchar end as key, conv_id % 4 as rank, conv_id * 1000 + turn as line, role as response from conversations), shards as (select * from one union all select key, (rank + 1) % 4, line, 'again' from one where line % 5 = 0)"


@query(f"with {SHARDS} select key, rank, line, response from shards where key is not null qualify row_number() over (partition by key order by rank, line, response) = 1")
def q_merge_shards(spark, d):
    return H.merge_shards(shards(spark, d))


@query(f"with {SHARDS} select conv_id::varchar || ':' || turn::varchar as key from conversations where not exists (select 1 from shards s where s.key = conv_id::varchar || ':' || turn::varchar)")
def q_resume_anti(spark, d):
    want = table(spark, d, "conversations").select(F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("key"))
    return H.remaining(want, shards(spark, d).filter("key is not null"))


@query(f"with {SHARDS}, want as (select conv_id::varchar || ':' || turn::varchar as key from conversations where turn < 3), got as (select key, count(*) as n from shards where key is not null group by key) select coalesce(w.key, g.key) as key, case when g.key is null then 'missing' when w.key is null then 'unexpected' else 'repeated' end as fault, coalesce(n, 0) as n from want w full join got g on w.key = g.key where g.key is null or w.key is null or n > 1")
def q_coverage_check(spark, d):
    want = table(spark, d, "conversations").filter("turn < 3").select(F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("key"))
    return H.coverage(want, shards(spark, d).filter("key is not null"))


@query("select lang, doc_id, (row_number() over (partition by lang order by md5('42:' || doc_id::varchar), doc_id))::int as place from documents qualify place <= 20")
def q_seeded_sample(spark, d):
    return H.seeded_sample(table(spark, d, "documents").select("lang", "doc_id"), "lang", "doc_id", 20)


@query("select conv_id, conv_id::varchar || ':' || turn::varchar as occurrence, turn from conversations")
def q_annotation_occurrences(spark, d):
    """Entries with nested questions, unnested again with their places as identity."""
    nested = table(spark, d, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("questions"))
    from ..sources.annotations import unnest

    return unnest(nested, "conv_id", "questions").select("conv_id", F.concat_ws(":", F.col("conv_id").cast("string"), F.col("q.turn").cast("string")).alias("occurrence"), F.col("q.turn").alias("turn"))


@query("select n_name, case when n_nationkey % 2 = 0 then 0.60::double else 0.55::double end as floor, case when n_nationkey % 2 = 0 then 0.60::double else 0.70::double end as strict, case when n_nationkey % 2 = 0 then 8 else 12 end as k_max from nation")
def q_profile_lookup(spark, d):
    from ..sources.profiles import ovo_profiles

    models = table(spark, d, "nation").select("n_name", F.when(F.col("n_nationkey") % 2 == 0, "models/Qwen2.5-VL-7B").otherwise("other-vlm").alias("model"))
    return ovo_profiles(models, "model").select("n_name", "floor", "strict", "k_max")


@query("select c_custkey as video, case when s.s_suppkey is null then 'missing' when s.s_suppkey % 2 = 0 then 'verified_prefix' else 'original' end as status, case when s.s_suppkey % 2 = 0 and c_acctbal > s.s_acctbal then true else false end as unavailable from customer left join supplier s on s.s_suppkey = c_custkey")
def q_media_status(spark, d):
    from ..sources.media import source_status

    asked = table(spark, d, "customer").select(F.col("c_custkey").alias("video"), F.col("c_acctbal").alias("ts"))
    manifest = table(spark, d, "supplier").select(F.col("s_suppkey").alias("video"), F.when(F.col("s_suppkey") % 2 == 0, F.col("s_acctbal")).alias("verified_until"))
    return source_status(asked, manifest).select("video", "status", "unavailable")


@query("with p as (select user_id, epoch_us(ts) as us from events where event_type = 'purchase'), g as (select *, coalesce((us - lag(us) over (partition by user_id order by us) > 86400000000)::int, 1) as new from p), s as (select *, sum(new) over (partition by user_id order by us rows unbounded preceding) as session from g) select user_id, min(us) as start_us, max(us) as end_us, count(*) as n from s group by user_id, session")
def q_stream_sessions(spark, d):
    """A stream of events into sessions of each user; tests hold it against the same in batch."""
    return live.replay(spark, f"{d}/events.parquet", live.sessions)


@query("with e as (select user_id, epoch_us(ts) as us, min(case event_type when 'click' then 1 when 'purchase' then 2 else 0 end) as delta from events group by all) select user_id, sum(delta)::bigint as count, max(us) as last_us from e group by user_id")
def q_stream_counts(spark, d):
    """A stream of events into running counts of each user, by keyed state."""
    return live.replay(spark, f"{d}/events.parquet", live.running_counts)
