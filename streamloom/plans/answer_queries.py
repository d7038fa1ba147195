"""Registered queries over windows, limits, prompts, interval states of questions, choices of scorers, and annotations."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import values as V
from ..operators import chunks as C
from ..operators import interval as I
from ..operators import scoring as H
from ..operators import sheets
from ..operators.incremental import Memory
from ..sources import annotations as A
from ..sources import frames as video
from ..sources import media, runs
from ..sources.stored import shared_folder
from ..streaming import bounded, live
from .catalogue import _EDGES, BOUNDS, CUTS, DAY, FR, LETTER, OBS, _lit, captions, cutoffs, frames, nodes_sql, query, table

# ---- windows, limits, shards -------------------------------------------------------------------------------------


@query(f"with {CUTS} select c.video, c.cutoff as t, arg_min(f.frame_id, (f.ts, f.frame_id)) as frame_id, min(f.ts) as ts from cuts c left join frames f on f.video = c.video and f.ts >= c.cutoff group by all")
def q_pts_bound(spark, d):
    fr = frames(spark, d)
    return C.first_at(fr, cutoffs(fr).withColumnRenamed("cutoff", "t")).select("video", "t", "frame_id", "ts")


@query(f"with {FR}, asked as (select video, ts as t from frames where frame_id % 7 = 0) select a.video, a.t, min(f.ts) as ts from (select distinct * from asked) a left join frames f on f.video = a.video and f.ts > a.t group by all")
def q_pts_bound_strict(spark, d):
    fr = frames(spark, d)
    return C.first_at(fr, fr.filter("frame_id % 7 = 0").select("video", F.col("ts").alias("t")).distinct(), strict=True).select("video", "t", "ts")


_STEPS = "s as (select video, frame_id as step, round(ts / 86400 + (frame_id % 5) * 3) as cutoff from frames)"


@query(f"with {FR}, {_STEPS}, l as (select *, max(cutoff) over (partition by video order by step rows between unbounded preceding and 1 preceding) as last from s) select video, step, cutoff, case when last is null or cutoff > last then coalesce(last, 0.0) end as start, case when last is null or cutoff > last then cutoff end as \"end\" from l")
def q_decode_windows(spark, d):
    steps = frames(spark, d).select("video", F.col("frame_id").alias("step"), F.round(F.col("ts") / DAY + (F.col("frame_id") % 5) * 3).alias("cutoff"))
    return C.decode_windows(steps)


@query(f"with {BOUNDS} select video, chunk, case when row_number() over (partition by video order by chunk desc) <= 4 then n end as held from bounds")
def q_frame_eviction(spark, d):
    return C.evict_frames(C.chunk_bounds(frames(spark, d), DAY), 4).select("video", "chunk", F.when(F.col("frames").isNotNull(), F.size("frames")).cast("long").alias("held"))


@query(f"with {CUTS}, {BOUNDS.removeprefix(FR + ', ')}, ended as (select video, chunk, greatest(b, least((chunk + 1) * 86400.0::double, e)) as end_time from bounds), later as (select *, lead(end_time, 4) over (partition by video order by chunk) as t from ended) select l.video, l.chunk, min(c.cutoff) as evicted from later l left join cuts c on c.video = l.video and c.cutoff >= l.t group by all")
def q_evicted_to_memory(spark, d):
    fr = frames(spark, d)
    return C.evicted_at(C.chunk_bounds(fr, DAY), cutoffs(fr), 4)


@query(f"with {FR} select video, frame_id from frames qualify row_number() over (partition by video order by ts desc, frame_id desc) <= 5")
def q_last_frames(spark, d):
    return C.last_frames(frames(spark, d), 5).select("video", "frame_id")


@query(f"with {FR}, c as (select *, dense_rank() over (partition by video order by floor(ts / 86400) desc) as c from frames) select video, frame_id from c where c <= 4 qualify row_number() over (partition by video order by ts desc, frame_id desc) <= 4")
def q_recent_chunk_frames(spark, d):
    return C.recent_chunk_frames(frames(spark, d), DAY, 4).select("video", "frame_id")


@query(f"with {FR}, b as (select *, row_number() over (partition by video order by ts desc, frame_id desc) as back from frames), h as (select video, frame_id, row_number() over (partition by video order by ts, frame_id) - 1 as p from b where back > 4), k as (select video, frame_id, p // 2 as p, count(*) over (partition by video) as n from h where p % 2 = 0) select video, frame_id, 'history' as part from k where n <= 10 or p in (select i * n // 10 from range(10) t(i)) union all select video, frame_id, 'recent' from b where back <= 4")
def q_baseline_sample(spark, d):
    return C.baseline_sample(frames(spark, d), 4, 2, 10).select("video", "frame_id", "part")


@query(f"with {FR}, i as (select *, row_number() over (partition by video order by frame_id) - 1 as i from frames) select video, frame_id as step, i % 3 = 0 as looked, last_value(case when i % 3 = 0 then label end ignore nulls) over (partition by video order by frame_id rows unbounded preceding) as held from i")
def q_stride_gate(spark, d):
    steps = frames(spark, d).select("video", F.col("frame_id").alias("step"), "label")
    return C.stride_gate(steps, 3, "label").select("video", "step", "looked", "held")


@query("select conv_id, turn, case when contains(lower(text), 'how many') or contains(lower(text), 'how often') or contains(lower(text), 'number of times') then 20 else 40 end as cap from conversations")
def q_cap_choice(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", C.cap_for(X.is_count_question("text"), 20, 40).alias("cap"))


@query("select user_id, event_id from events where user_id in (select distinct user_id from events order by user_id limit 10) qualify row_number() over (partition by user_id order by ts, event_id) <= 3")
def q_video_limits(spark, d):
    return C.first_n(table(spark, d, "events"), "user_id", ["ts", "event_id"], 3, 10).select("user_id", "event_id")


@query("with p as (select doc_id, row_number() over (order by doc_id) - 1 as p, count(*) over () as n from documents), k as (select *, n // 7 as q, n % 7 as r from p) select doc_id, (case when p < r * (q + 1) then p // (q + 1) else r + (p - r * (q + 1)) // q end)::int as shard from k")
def q_shard_split(spark, d):
    return C.shard_of(table(spark, d, "documents").select("doc_id"), ["doc_id"], 7)


@query("select conv_id, unnest(list(turn)) as turn from conversations group by conv_id")
def q_flatten_gathered(spark, d):
    from ..sources.annotations import unnest

    gathered = table(spark, d, "conversations").groupBy("conv_id").agg(F.collect_list(F.array("turn")).alias("parts")).withColumn("turns", F.flatten("parts"))
    return unnest(gathered, "conv_id", "turns").select("conv_id", F.col("q").alias("turn"))


@query(f"with {FR}, z as (select video, floor(ts / 86400)::bigint as chunk, list(frame_id order by ts, frame_id) as ids, list(case when frame_id % 97 = 0 then null else ts end order by ts, frame_id) as times from frames group by all) select video, chunk, case when len(list_filter(times, lambda t: t is null)) = 0 then len(ids)::int end as n from z")
def q_frame_time_zip(spark, d):
    rows = F.sort_array(F.collect_list(F.struct("ts", "frame_id")))
    z = C.tumbling(frames(spark, d), DAY).groupBy("video", "chunk").agg(rows.alias("f")).select("video", "chunk", F.transform("f", lambda x: x["frame_id"]).alias("ids"), F.transform("f", lambda x: F.when(x["frame_id"] % 97 != 0, x["ts"])).alias("times"))
    return C.zipped(z, "ids", "times").select("video", "chunk", F.when(F.col("zipped").isNotNull(), F.size("zipped")).alias("n"))


@query("select event_id, case when event_id % 11 = 0 then false when event_id % 13 = 0 then false else value >= 0 end as good from events")
def q_cutoff_valid(spark, d):
    cut = F.when(F.col("event_id") % 11 == 0, F.lit(float("nan"))).when(F.col("event_id") % 13 == 0, F.lit(float("inf"))).otherwise(F.col("value"))
    return table(spark, d, "events").select("event_id", C.valid_cutoff(cut).alias("good"))


@query(f"with {FR}, r as (select video, min(ts) as first from frames where frame_id % 4 = 0 group by video) select f.video, count_if(coalesce(f.ts >= r.first, false))::bigint as violations from frames f left join r using (video) where f.frame_id % 4 <> 0 group by all")
def q_history_precedes_recent(spark, d):
    fr = frames(spark, d)
    return C.out_of_order(fr.filter("frame_id % 4 <> 0"), fr.filter("frame_id % 4 = 0"))


# ---- prompts and answers -----------------------------------------------------------------------------------------


def turns(spark: SparkSession, d: str) -> DataFrame:
    """conv_id, question (the first user turn), options (up to six first words of the others)."""
    t = table(spark, d, "conversations")
    options = F.slice(F.transform(F.sort_array(F.collect_list(F.when(F.col("role") != "user", F.struct("turn", F.substring("text", 1, 20).alias("o"))))), lambda x: x["o"]), 1, 6)
    return t.groupBy("conv_id").agg(F.min_by("text", F.when(F.col("role") == "user", F.col("turn"))).alias("question"), options.alias("options"))


TURNS = "turns as (select conv_id, arg_min(text, turn) filter (role = 'user') as question, coalesce(list(left(text, 20) order by turn) filter (role <> 'user'), [])[1:6] as options from conversations group by conv_id)"
_FORMAT = "array_to_string(list_transform(options, lambda o, i: case when regexp_matches(trim(o), '^[A-Z]\\s*[.)]') then trim(o) else chr((64 + i)::int) || '. ' || trim(o) end), chr(10))"


@query(f"with {TURNS} select conv_id, md5({_FORMAT}) as options from turns")
def q_format_options(spark, d):
    return turns(spark, d).select("conv_id", F.md5(X.format_options("options")).alias("options"))


@query(f"with {TURNS} select conv_id, case when trim(question) <> '' and len(options) between 2 and 6 and len(list_filter(options, lambda o: trim(o) = '')) = 0 then md5('Question: ' || question || chr(10) || 'Options:' || chr(10) || {_FORMAT} || chr(10) || 'Answer with one letter.') end as prompt from turns")
def q_mcq_prompt(spark, d):
    return turns(spark, d).select("conv_id", F.md5(X.mcq_prompt(F.col("question"), F.col("options"))).alias("prompt"))


@query(f"with {FR} select frame_id, 'Question: ' || label || chr(10) || 'From ' || printf('%02d:%02d', floor(ts)::bigint // 60, floor(ts)::bigint % 60) || ' to ' || printf('%02d:%02d', floor(ts + 9)::bigint // 60, floor(ts + 9)::bigint % 60) || '; counted before: 2' || chr(10) || 'A. 0 new' || chr(10) || 'B. 1 new' || chr(10) || 'C. unclear, count 0 new' || chr(10) || 'Answer with one letter.' as prompt from frames")
def q_delta_prompt(spark, d):
    text = X.prompt(V.DELTA_TEMPLATE, question=F.col("label"), previous=X.minutes("ts"), cutoff=X.minutes(F.col("ts") + 9), count=F.lit(2), options=F.lit(X.delta_options(1)))
    return frames(spark, d).select("frame_id", text.alias("prompt"))


@query(f"select p_partkey, md5('Describe.' || replace({_lit(V.ACTIVITY_TEMPLATE)}, '{{activity}}', lower(trim(p_name)))) as prompt from part")
def q_activity_prompt(spark, d):
    return table(spark, d, "part").select("p_partkey", F.md5(X.activity_prompt("Describe.", F.concat(F.lit(" "), F.col("p_name"), F.lit("?! ")))).alias("prompt"))


@query("select event_id, greatest(0, least(coalesce(try_cast(nullif(regexp_extract(props, '([0-9]+)', 1), '') as int), null), 5)) as count from events")
def q_clamp_count(spark, d):
    return table(spark, d, "events").select("event_id", X.clamp_count("props", 5).alias("count"))


_SAID = "case event_id % 9 when 0 then 'A' when 1 then 'b.' when 2 then 'Yes, it is' when 3 then 'y' when 4 then 'not now' when 5 then 'n' when 6 then 'maybe' when 7 then 'I say B' else '' end"


@query("select event_id, case event_id % 9 when 0 then 'Yes' when 1 then 'No' when 2 then 'Yes' when 3 then 'Yes' when 4 then 'No' when 5 then 'No' when 7 then 'No' end as said, case when event_id % 9 in (0, 2, 3) then 'Yes' else 'No' end as tail from events")
def q_yes_no(spark, d):
    said = F.expr(_SAID)
    return table(spark, d, "events").select("event_id", X.yes_no(said).alias("said"), X.yes_no(said, "No").alias("tail"))


@query("select conv_id, turn, coalesce(nullif(regexp_extract(upper(trim(t)), '(?:^|[^\\p{L}\\p{M}\\p{N}_])([A-D])(?:$|[^\\p{L}\\p{M}\\p{N}_])', 1), ''), upper(trim(t))) as truth from (select *, case turn % 3 when 0 then 'b' when 1 then ' (C) ' else 'other' end as t from conversations)")
def q_truth_letter(spark, d):
    t = F.when(F.col("turn") % 3 == 0, "b").when(F.col("turn") % 3 == 1, " (C) ").otherwise("other")
    return table(spark, d, "conversations").select("conv_id", "turn", X.truth_letter(t).alias("truth"))


@query("select conv_id, turn, (case when conv_id % 2 = 0 then 'B' else 'C' end = case turn % 2 when 0 then 'B' else 'C' end)::int as mark from conversations")
def q_mcq_marks(spark, d):
    response = F.when(F.col("conv_id") % 2 == 0, "the answer is B").otherwise("3")
    truth = F.when(F.col("turn") % 2 == 0, "b").otherwise("c")
    return table(spark, d, "conversations").select("conv_id", "turn", H.mark_mcq(response, truth).alias("mark"))


@query("select vec_id, chr((64 + list_position(l, list_max(l)))::int) as letter from (select vec_id, list_transform(embedding[1:4], lambda x: round(x, 1)) as l from embeddings)")
def q_choice_by_logits(spark, d):
    logits = F.transform(F.slice("embedding", 1, 4), lambda x: F.round(x, 1))
    return table(spark, d, "embeddings").select("vec_id", X.chosen(logits).alias("letter"))


@query("select doc_id, sha256(text) as digest from documents")
def q_text_digest(spark, d):
    return table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("digest"))


# ---- interval states of questions --------------------------------------------------------------------------------

_ASKS = "case when value > 40 then 'How many  clicks?' else 'how many clicks' end"
_OPTS = "['A. none', 'B. two', 'C. 5', 'D. 12']"


@query(
    f"with {FR}, s as (select video, frame_id as step, trim(regexp_replace(regexp_replace(lower({_ASKS}), '\\s+', ' ', 'g'), '[^a-z\\s]', '', 'g')) as key, round(ts / 86400) as cutoff, {LETTER.replace('else null', 'else chr(90)')} as label from frames),"
    " m as (select *, cutoff <= coalesce(max(cutoff) over (partition by video, key order by step rows between unbounded preceding and 1 preceding), 0) as carried from s), l as (select *, case when carried then 'A' when label between 'A' and 'D' then label else 'D' end as seen from m),"
    " c as (select *, case when carried or seen > 'C' then 0 else ascii(seen) - 65 end as delta from l), t as (select *, (sum(delta) over (partition by video, key order by step rows unbounded preceding))::int as count from c)"
    " select video, key, step, cutoff, seen as label, delta::int as delta, count, case when abs(0 - count) <= abs(2 - count) and abs(0 - count) <= abs(5 - count) and false then 'A' when abs(2 - count) <= abs(5 - count) and abs(2 - count) <= abs(12 - count) then 'B' when abs(5 - count) <= abs(12 - count) then 'C' else 'D' end as answer from t"
)
def q_interval_question_counts(spark, d):
    rows = frames(spark, d).select("video", F.col("frame_id").alias("step"), F.expr(_ASKS).alias("question"), F.round(F.col("ts") / DAY).alias("cutoff"), F.expr(LETTER.replace("else null", "else 'Z'")).alias("label"))
    return I.question_counts(rows.withColumn("options", F.array(*map(F.lit, ("A. none", "B. two", "C. 5", "D. 12")))), 2)


@query(f"with {FR}, s as (select *, case frame_id % 4 when 0 then 'A' when 1 then 'B' when 2 then 'no' else null end as answer from frames) select video, frame_id as step, case when answer = 'A' then 'Yes' else 'No' end as response, answer is not null as looked from s")
def q_step_answers(spark, d):
    a = F.when(F.col("frame_id") % 4 == 0, "A").when(F.col("frame_id") % 4 == 1, "B").when(F.col("frame_id") % 4 == 2, "no")
    rows = frames(spark, d).select("video", F.col("frame_id").alias("step"), F.col("ts").alias("cutoff"), a.alias("answer"))
    return I.step_answers(rows).select("video", "step", "response", "looked")


@query(f"with {FR}, s as (select video, frame_id as step, ts as cutoff, case label when 'view' then 0 when 'click' then 1 when 'purchase' then 2 else 0 end as delta from frames), g as (select *, coalesce(cutoff <= lag(cutoff) over (partition by video order by cutoff, step), false) as carried from s) select video, 'rec:count' as key, sum(case when carried then 0 else delta end)::varchar as response, count(*) as n from g group by video")
def q_rec_task_state(spark, d):
    from ..operators import memory as M
    from .catalogue import steps

    return M.task_states(I.projected_states(I.running_count(steps(spark, d)))).select("video", "key", "response", "n")


@query("select user_id as video, sum(least(coalesce(try_cast(nullif(regexp_extract(props, '([0-9]+)', 1), '') as int), 0), 3))::bigint as count, count(*) as segments from (select * from events qualify row_number() over (partition by user_id order by event_id) <= 5) group by user_id")
def q_segment_counts(spark, d):
    rows = C.first_n(table(spark, d, "events"), "user_id", ["event_id"], 5).select(F.col("user_id").alias("video"), F.col("event_id").alias("segment"), F.col("props").alias("response"))
    one = rows.withColumn("response", X.clamp_count("response", 3).cast("string"))
    return I.segment_counts(one)


@query(f"with {FR}, c as (select video, floor(ts / 86400)::bigint as chunk, min(label) as l from frames group by all), p as (select *, row_number() over (partition by video order by chunk) - 1 as i, case l when 'click' then 'A' when 'login' then 'B' when 'purchase' then 'C' else 'x' end as label from c) select video, chunk, case when label = 'x' then 'E' else label end as label, case label when 'A' then 'PEAK_COMPLETE' when 'B' then 'ACTIVE_NONPEAK' when 'C' then 'RESET_IDLE' else 'UNCLEAR' end as phase from p where i % 2 = 0")
def q_phase_labels(spark, d):
    c = C.tumbling(frames(spark, d), DAY).groupBy("video", "chunk").agg(F.min("label").alias("l"), F.avg("ts").alias("mid"))
    label = F.when(F.col("l") == "click", "A").when(F.col("l") == "login", "B").when(F.col("l") == "purchase", "C").otherwise("x")
    return I.phase_labels(c.withColumn("label", label), 2).select("video", "chunk", "label", "phase")


@query(f"with {FR} select video, frame_id as step, case when max((label = 'purchase')::int) over (partition by video order by ts, frame_id rows unbounded preceding) = 1 then 'Yes' else 'No' end as response from frames")
def q_tail_mono(spark, d):
    rows = frames(spark, d).select("video", F.col("frame_id").alias("step"), F.col("ts").alias("cutoff"), F.when(F.col("label") == "purchase", "Yes").otherwise("No").alias("response"))
    return I.running_or(rows).select("video", "step", "response")


@query("select l_orderkey as id, l_linenumber as place, (row_number() over (partition by l_orderkey order by l_extendedprice, l_linenumber) - 1)::int as turn from lineitem")
def q_occurrence_order(spark, d):
    items = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("place"), F.col("l_extendedprice").alias("realtime"))
    return I.ordered_occurrences(items).select("id", "place", "turn")


# ---- sources -----------------------------------------------------------------------------------------------------

_TASKS = "case conv_id % 8 when 0 then 'EPM' when 1 then 'OCR' when 2 then 'REC' when 3 then 'CRR' when 4 then 'HLD' when 5 then 'nothing' when 6 then 'OJR' else 'SSR' end"


@query(
    f"with {TURNS}, a as (select case when conv_id % 10 = 9 then -conv_id else conv_id end as id, conv_id, {_TASKS} as task, case when conv_id % 12 = 8 then ' ' else question end as question, options, case when conv_id % 7 = 4 then null else conv_id / 2.0 end as realtime from turns),"
    " s as (select *, case when task in ('EPM', 'HLD') then 'backward' when task in ('OCR', 'OJR') then 'realtime' when task in ('REC', 'CRR', 'SSR') then 'forward' end as section from a)"
    " select conv_id, section, case when id < 0 then 'id must be a non-negative integer' when section is null then 'unknown task' when section in ('backward', 'realtime') and trim(question) = '' then 'blank question' when section in ('backward', 'realtime') and (len(options) not between 2 and 6 or len(list_filter(options, lambda o: trim(o) = '')) > 0) then 'two to six options, none blank' when section in ('backward', 'realtime') and realtime is null then 'cutoff must be finite and not negative' end as error from s"
)
def q_annotation_errors(spark, d):
    c = F.col("conv_id")
    rows = turns(spark, d).select(c, F.when(c % 10 == 9, -c).otherwise(c).alias("id"), F.expr(_TASKS).alias("task"), F.when(c % 12 == 8, " ").otherwise(F.col("question")).alias("question"), "options", (c % 4).cast("int").alias("gt"), F.when(c % 7 != 4, c / 2.0).alias("realtime"))
    return A.checked_ovo(rows).select("conv_id", "section", "error")


@query("with e as (select s_suppkey as video, case when s_suppkey % 5 = 0 then 2 else 1 end as v, case when s_suppkey % 3 = 0 then 'x' else sha256(s_name) end as a, s_acctbal as u, case when s_suppkey % 4 = 0 then s_acctbal + 1 else s_acctbal end as w from supplier union all select s_suppkey, 1, sha256(s_name), 1.0, 1.0 from supplier where s_suppkey % 6 = 1) select video, case when v <> 1 then 'schema_version must be 1' when count(*) over (partition by video) > 1 then 'a video has one entry' when a = 'x' then 'SHA-256 expected' when u is distinct from w or u < 0 then 'verified_until and unavailable_after must be one time' end as error from e")
def q_manifest_errors(spark, d):
    s, k = table(spark, d, "supplier"), F.col("s_suppkey")
    sha = F.sha2("s_name", 256)
    one = s.select(k.alias("video"), F.when(k % 5 == 0, 2).otherwise(1).alias("schema_version"), F.when(k % 3 == 0, "x").otherwise(sha).alias("original_sha256"), sha.alias("input_sha256"), F.col("s_acctbal").alias("verified_until"), F.when(k % 4 == 0, F.col("s_acctbal") + 1).otherwise(F.col("s_acctbal")).alias("unavailable_after"))
    two = s.filter(k % 6 == 1).select(k.alias("video"), F.lit(1).alias("schema_version"), sha.alias("original_sha256"), sha.alias("input_sha256"), F.lit(1.0).alias("verified_until"), F.lit(1.0).alias("unavailable_after"))
    return media.checked_entries(one.unionByName(two)).select("video", "error")


@query("select conv_id, turn, case when conv_id % 8 in (0, 4) then 'backward' when conv_id % 8 in (1, 6) then 'realtime' when conv_id % 8 in (2, 3, 7) then 'forward' end as section from conversations")
def q_checkpoint_sections(spark, d):
    return runs.bucketed(table(spark, d, "conversations").withColumn("task", F.expr(_TASKS))).select("conv_id", "turn", "section")


@query("select conv_id::varchar || ':' || turn::varchar as key, null::varchar as video, role as task, text as question, null::varchar as truth, null::varchar as response, null::varchar as route, null::varchar as error, null::varchar as status from conversations")
def q_result_rows(spark, d):
    t = table(spark, d, "conversations")
    return runs.result_rows(t.select(F.concat_ws(":", "conv_id", "turn").alias("key"), F.col("role").alias("task"), F.col("text").alias("question")))


# ---- live streams ------------------------------------------------------------------------------------------------


@query("select user_id, epoch_us(date_trunc('day', ts)) as day_us, count(*) as n, epoch_us(min(ts)) as first_us, epoch_us(max(ts)) as last_us from events group by all")
def q_stream_chunks(spark, d):
    """A stream of events into a day's chunks of each user."""
    out = live.replay(spark, f"{d}/events.parquet", live.chunks)
    return out.select("user_id", F.unix_micros("window.start").alias("day_us"), "n", F.unix_micros("first").alias("first_us"), F.unix_micros("last").alias("last_us"))


@query("select user_id, epoch_us(s) as start_us, count(*) as n from (select user_id, unnest([date_trunc('day', ts), date_trunc('day', ts) - interval 1 day]) as s from events) group by all")
def q_stream_sliding(spark, d):
    """A stream of events into windows of two days that start each day."""
    out = live.replay(spark, f"{d}/events.parquet", live.sliding)
    return out.select("user_id", F.unix_micros("window.start").alias("start_us"), "n")


@query("select user_id, epoch_us(date_trunc('day', ts)) as day_us, count(*) as n from events group by all having count_if(event_type = 'signup') = 0")
def q_stream_retraction(spark, d):
    """A stream of events and removals: the chunks that are left."""
    return live.replay(spark, f"{d}/events.parquet", live.surviving_chunks)


@query("select user_id as video, arg_max(event_id, event_id) as event_id, max(least(round(value)::int, 60)) as count from (select * from events qualify row_number() over (partition by user_id order by event_id) <= 12) group by user_id")
def q_storyboard_count(spark, d):
    """The count that a storyboard's response gives, capped: here the largest of the first twelve."""
    rows = C.first_n(table(spark, d, "events"), "user_id", ["event_id"], 12)
    said = F.concat(F.lit("about "), F.round("value").cast("int").cast("string"), F.lit(" times"))
    return rows.select(F.col("user_id").alias("video"), "event_id", X.clamp_count(said, 60).alias("count")).groupBy("video").agg(F.max("event_id").alias("event_id"), F.max("count").alias("count"))


# ---- live streams whose state is bounded -------------------------------------------------------------------------

_DAY_US = 86_400_000_000
_MARKED = f"e as (select user_id, event_id, event_type, epoch_us(ts) as us from events where ts is not null and user_id is not null), m as (select max(us) // 1000 * 1000 - {_DAY_US} as mark from e)"


def _live(spark, d, operator):
    """What a bounded operator gives out for the events, with a day's delay."""
    rows = bounded.rows_of(bounded.source(spark, f"{d}/events.parquet"), "1 day", amount=F.when(F.col("event_type") == "click", 1).when(F.col("event_type") == "purchase", 2).otherwise(0))
    return bounded.deliver(operator(rows), "events", f"{shared_folder(spark)}/live-{uuid.uuid4().hex}")


@query(f"with {_MARKED} select user_id, us - us % {_DAY_US} as start_us, count(*) as n, min(us) as first_us, max(us) as last_us from e group by 1, 2 having us - us % {_DAY_US} + {_DAY_US} <= (select mark from m)")
def q_stream_closed_windows(spark, d):
    """Days of each user that the watermark has closed, each given out once and then forgotten."""
    out = _live(spark, d, lambda r: bounded.windows(r, _DAY_US)).filter("kind = 'window'")
    return out.select("user_id", F.col("us").alias("start_us"), "n", "first_us", "last_us")


@query(f"with {_MARKED}, l as (select user_id, us, min(case event_type when 'click' then 1 when 'purchase' then 2 else 0 end) as amount from e where us < (select mark from m) group by user_id, us) select user_id, sum(amount)::bigint as count, max(us) as last_us from l group by user_id")
def q_stream_settled_counts(spark, d):
    """Running counts of each user up to the watermark; the state is a sum, and what the watermark has not passed."""
    last = _live(spark, d, bounded.counts).filter("kind = 'count'").groupBy("user_id").agg(F.max(F.struct("us", "n")).alias("r"))
    return last.select("user_id", F.col("r.n").alias("count"), F.col("r.us").alias("last_us"))


@query(f"with {_MARKED}, c as (select user_id, us // {_DAY_US} as chunk, count(*) as n from e where us < (select mark from m) group by 1, 2), l as (select *, (lead(chunk, 4) over (partition by user_id order by chunk) + 1) * {_DAY_US} as ready_us from c) select user_id, chunk, n, ready_us from l where ready_us < (select mark from m)")
def q_stream_evicted_to_memory(spark, d):
    """A live buffer of the last four chunks of each user; a chunk that falls out of it passes on to memory."""
    out = _live(spark, d, lambda r: bounded.recent(r, 4, _DAY_US)).filter("kind = 'evicted'")
    return out.select("user_id", F.col("id").alias("chunk"), "n", F.col("us").alias("ready_us"))


# ---- frames of media ---------------------------------------------------------------------------------------------


def _video():
    return F.regexp_extract("path", r"(-?\d+)\.y4m$", 1).cast("int")


def _media(spark, d):
    """A folder of one file for each label, with its vectors as pictures."""
    rows = table(spark, d, "embeddings").filter("label is not null")
    grey = F.array_join(F.transform("embedding", lambda x: F.lpad(F.hex(F.greatest(F.lit(0), F.least(F.lit(255), F.floor(128 + 256 * x.cast("double")).cast("int"))).cast("long")), 2, "0")), "")
    pictures = rows.select(F.col("label").alias("video"), F.col("vec_id").alias("frame"), F.unhex(grey).alias("luma"))
    folder = f"{shared_folder(spark)}/media-{uuid.uuid4().hex}"
    video.write_files(pictures, folder, 8, 8, (2, 1)).count()
    return folder


@query("with f as (select label as video, row_number() over (partition by label order by vec_id) - 1 as frame, array_to_string(list_transform(embedding, lambda x: printf('%02x', greatest(0, least(255, floor(128 + 256 * x::double)))::int)), '') as luma from embeddings where label is not null) select video, frame, frame / 2 as pts, sha256(luma) as luma_sha256 from f where frame / 2 >= 3 and frame / 2 < 20")
def q_media_frames(spark, d):
    """Frames of a window of time from files: each label a video at two frames a second, each of its vectors a picture of grey values."""
    found = video.frames(spark, _media(spark, d), 3, 20, rangeBytes=20_000).filter("fault is null")
    return found.select(_video().alias("video"), "frame", "pts", F.sha2(F.lower(F.hex("luma")), 256).alias("luma_sha256"))


_GREY = "list_transform(embedding, lambda x: greatest(0, least(255, floor(128 + 256 * x::double)))::int)"
_GLYPHS = "map {" + ", ".join(f"'{c}': '{g.replace(' ', '')}'" for c, g in sheets.GLYPHS.items()) + "}"


@query(
    f"with f as (select label as video, row_number() over (partition by label order by vec_id) - 1 as place, {_GREY} as grey from embeddings where label is not null),"
    " g as (select video, place // 12 as sheet, place % 12 as i, place / 2 as ts, grey, (place % 12 + 1)::varchar || ' ' || printf('%02d:%02d', place // 2 // 60, place // 2 % 60) as label from f),"
    " s as (select video, sheet, count(*)::int as n_frames, min(ts) as first_ts, max(ts) as last_ts, ((count(*) + 3) // 4)::int as sheet_rows from g group by all),"
    " c as (select s.*, i.i, g.grey, g.label from (select *, unnest(range(sheet_rows * 4)) as i from s) i join s using (video, sheet) left join g on g.video = s.video and g.sheet = s.sheet and g.i = i.i),"
    " p as (select c.*, y.y, x.x, (x.x - 5) // 8 as k, (x.x - 5) % 8 // 2 as gx, (y.y - 5) // 2 as gy from c, range(64) y(y), range(64) x(x)),"
    f" v as (select *, case when grey is null then 245 when y in (0, 63) or x in (0, 63) then 180 when y between 2 and 18 and x between 2 and 62 then case when y between 5 and 14 and x >= 5 and (x - 5) % 8 < 6 and k < len(label) and substr(({_GLYPHS})[label[k + 1]], gy * 3 + gx + 1, 1) = '#' then 255 else 0 end"
    " when y between 28 and 35 and x between 28 and 35 then grey[(y - 28) * 8 + x - 27] else 245 end as sample from p)"
    " select video, sheet, 256 as width, sheet_rows * 64 as height, n_frames, first_ts, last_ts, sha256(string_agg(printf('%02x', sample::int), '' order by i // 4, y, i % 4, x)) as luma_sha256 from v group by all"
)
def q_contact_sheet_pixels(spark, d):
    """All frames of the files on sheets of twelve, four cells of 64 samples a row."""
    found = video.frames(spark, _media(spark, d)).filter("fault is null").select(_video().cast("long").alias("video"), F.col("frame").alias("frame_id"), F.col("pts").alias("ts"), "width", "height", "luma")
    rows = sheets.contact_sheets(found, 4, 64, 12)
    return rows.select(F.col("video").cast("int").alias("video"), "sheet", "width", "height", "n_frames", "first_ts", "last_ts", F.sha2(F.lower(F.hex("luma")), 256).alias("luma_sha256"))


# ---- a memory under changes --------------------------------------------------------------------------------------

_KEPT = f"{OBS}, kept as (select * from keyed where chunk % 4 <> 2)"


def _changed(spark, d):
    """A memory to which captions come in two parts, and from which a quarter of the chunks goes again."""
    rows = captions(spark, d)
    memory = Memory(spark, f"{shared_folder(spark)}/memory-{uuid.uuid4().hex}", buckets=8).change(rows.filter("chunk % 3 <> 1"))
    return memory.change(rows.filter("chunk % 3 = 1"), rows.filter("chunk % 3 <> 1 and chunk % 4 = 2")).change(removed=rows.filter("chunk % 4 = 2").select("video", "chunk"))


@query(f"with {_KEPT}, {nodes_sql('kept')} select video, key, node_type, text, n::bigint as n, n_chunks, first_seen, last_seen from nodes where admitted")
def q_incremental_nodes(spark, d):
    """Nodes after additions and removals, each of which touches its own videos only."""
    return _changed(spark, d).nodes().filter("admitted").select("video", "key", "node_type", "text", "n", "n_chunks", "first_seen", "last_seen")


@query(f"with {_KEPT}, {_EDGES.replace('keyed', 'kept')} select video, a, b, support from edges")
def q_incremental_edges(spark, d):
    """Edges after additions and removals, by counting."""
    return _changed(spark, d).edges()
