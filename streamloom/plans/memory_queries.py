"""Registered queries over memories built from captions: attachment, conflicts, provenance, counts, and whole contexts.

A node's vector is the embedding numbered (7 node_id + video) mod n, n the number of embeddings, a question's the one
numbered (13 video + 31 qid) mod n, and the focus of a counting question has the one numbered (17 video + 3) mod n.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import values as V
from ..operators import memory as M
from ..operators import retrieval as S
from ..sources.stored import stored
from .catalogue import _CHAIN, _EDGES, _REST, _STOPS, _TIMES, FR, HUBS, OBS, _lit, _stems_of, captions, frames, log, nodes_sql, query, table

NEAR = 0.2


def vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("vec"), F.col("embedding").alias("vector"))


def numbered(spark: SparkSession, d: str, rows: DataFrame, number) -> DataFrame:
    """rows with the number of their embedding as vec."""
    return rows.withColumn("vec", F.pmod(number, F.lit(max(1, vectors(spark, d).count()))))


def numbered_nodes(spark: SparkSession, d: str, node: DataFrame) -> DataFrame:
    return numbered(spark, d, node, 7 * F.col("node_id") + F.col("video"))


def with_near(spark: SparkSession, d: str, rows: DataFrame, node: DataFrame, resolved: bool = False) -> DataFrame:
    return M.with_hubs(rows, numbered_nodes(spark, d, node), vectors(spark, d), NEAR, resolved).drop("vec")


def linked_nodes(spark: SparkSession, d: str, rows: DataFrame, resolved: bool = False) -> DataFrame:
    # Nodes are read to find their vectors, to compare these, and to take in what was found; written once, they are made once.
    node = stored(M.hubs_by_id(M.nodes(rows)), "nodes")
    return with_near(spark, d, rows, node, resolved)


VECS = "vecs as (select vec_id, embedding::double[] as v from embeddings), nv as (select n.video, n.node_id, n.node_type, n.text, v.v from nodes n join vecs v on v.vec_id = (7 * n.node_id + n.video) % (select greatest(1, count(*)) from embeddings) where n.admitted)"


def near_sql(guard: str = "true") -> str:
    return f"near as (select video, node_id, arg_max(hub, (sim, -hub)) as near, max(sim) as sim from (select s.video, s.node_id, h.node_id as hub, round(list_dot_product(s.v, h.v), 6) as sim from nv s join nv h on h.video = s.video and h.node_type = 'entity' and h.node_id < s.node_id where s.node_type <> 'entity' and {guard}) where sim >= {NEAR} group by all)"


def linked_sql(guard: str = "true", obs: str = OBS, source: str = "keyed") -> str:
    hubs = HUBS.replace("linked as", "by_id as")
    return f"{obs}, {nodes_sql(source)}, {hubs}, {VECS}, {near_sql(guard)}, linked as (select b.* replace (coalesce(b.hub, n.near) as hub) from by_id b left join near n using (video, node_id))"


LINKED = linked_sql()


@query(f"with {LINKED} select video, node_id, near as hub, sim from near")
def q_nearest_earlier_hub(spark, d):
    node = stored(M.nodes(log(spark, d)), "nodes")
    return M.attach_by_vector(numbered_nodes(spark, d, node), vectors(spark, d), NEAR)


@query(f"with {LINKED} select video, node_id, hub from linked where node_type <> 'entity'")
def q_spoke_attach_embedding(spark, d):
    return linked_nodes(spark, d, log(spark, d)).filter("node_type <> 'entity'").select("video", "node_id", "hub")


def marked(rows: DataFrame) -> DataFrame:
    """The log with the guest of every fifth chunk's events unresolved."""
    return rows.withColumn("text", F.when((F.col("node_type") == "event") & (F.col("chunk") % 5 == 0), F.replace("text", F.lit("guest"), F.lit("[unresolved person reference]"))).otherwise(F.col("text")))


_MARKED = OBS.replace(", keyed as (select *, case", ", marked as (select * replace (case when node_type = 'event' and chunk % 5 = 0 then replace(text, 'guest', '[unresolved person reference]') else text end as text) from obs), keyed as (select *, case").replace("as key from obs)", "as key from marked)")
_GUARD = "not regexp_matches(s.text, '\\b[PO][0-9]+\\b') and not contains(s.text, '[unresolved ')"


@query(f"with {linked_sql(_GUARD, _MARKED)} select video, node_id, hub from linked where node_type <> 'entity'")
def q_attach_resolved(spark, d):
    return linked_nodes(spark, d, marked(log(spark, d)), resolved=True).filter("node_type <> 'entity'").select("video", "node_id", "hub")


@query(f"with {linked_sql(source='(select * from keyed where chunk % 4 <> 2)')} select video, node_id, key, hub from linked where node_type <> 'entity'")
def q_reattach_after_removal(spark, d):
    rows = log(spark, d)
    left = M.retract(rows, rows.filter("chunk % 4 = 2").select("video", "chunk").distinct())
    return linked_nodes(spark, d, left).filter("node_type <> 'entity'").select("video", "node_id", "key", "hub")


@query(f"with {OBS}, {nodes_sql(cap=8)} select k.video, k.chunk, k.seq, k.text from keyed k join nodes n on n.video = k.video and n.key = k.key and n.admitted where k.node_type = 'event'")
def q_timeline_admitted(spark, d):
    rows = log(spark, d)
    return M.timeline(rows, M.nodes(rows, cap=8)).select("video", "chunk", "seq", "text")


_TL = "tl as (select k.video, k.ts, k.seq, k.text from keyed k join nodes n on n.video = k.video and n.key = k.key and n.admitted where k.node_type = 'event')"


@query(
    f"with {linked_sql(obs=_MARKED)}, {_EDGES}, {_CHAIN}, {_TL} select n.video, count_if(admitted)::bigint as total_nodes, "
    + ", ".join(f"count_if(admitted and node_type = '{k}')::bigint as n_{k}" for k in ("entity", "action", "text_ocr", "spatial", "event"))
    + ", count_if(not admitted)::bigint as overflow, (select count(*) from edges e where e.video = n.video) as co_occurrence_edges, (select count(next1) from chain c where c.video = n.video) as action_chain_links, (select count(*) from tl where tl.video = n.video) as timeline_events,"
    " (select count(*) from marked m where m.video = n.video and m.node_type = 'action') as action_observations, (select count(*) from marked m where m.video = n.video and contains(m.text, '[unresolved ')) as unresolved, (select count(*) from linked l where l.video = n.video and l.node_type <> 'entity' and l.hub is null) as unattached from nodes n group by n.video"
)
def q_memory_full_stats(spark, d):
    rows = stored(marked(log(spark, d)), "log")
    node = stored(M.hubs_by_id(M.nodes(rows)), "nodes")
    linked = stored(with_near(spark, d, rows, node), "linked")
    return M.full_stats(rows, node, linked, M.edges(rows))


def _signature_sql(linked: bool) -> str:
    hub = "left join linked l using (video, node_id) left join nodes h on h.video = n.video and h.node_id = l.hub and h.admitted" if linked else ""
    name = "coalesce(h.text, '-')" if linked else "'-'"
    part = lambda at: "sum(" + " + ".join(f"(position(substr(m, {at + i}, 1) in '0123456789abcdef') - 1)::hugeint * {16 ** (14 - i)}::hugeint" for i in range(15)) + ")"
    return (
        f"r as (select n.video, concat_ws('|', 'n', n.node_type, n.text, n.n, n.n_chunks, round(n.first_seen, 3), round(n.last_seen, 3), {name}) as row from nodes n {hub} where n.admitted union all select video, concat_ws('|', 'e', a, b, support) from edges), h as (select video, md5(row) as m from r)"
        f" select video, count(*) as n_rows, {part(1)}::varchar || '-' || {part(16)}::varchar as signature from h group by video"
    )


@query(f"with {LINKED}, {_EDGES}, {_signature_sql(True)}")
def q_signature(spark, d):
    rows = log(spark, d)
    return M.signature(linked_nodes(spark, d, rows), M.edges(rows))


_KEPT_CAPTIONS = OBS.replace("lines as (select video", "kept as (select * from cap where chunk % 4 <> 2), lines as (select video", 1).replace("string_split(caption, chr(10)) as l from cap)", "string_split(caption, chr(10)) as l from kept)", 1)


@query(f"with {linked_sql(obs=_KEPT_CAPTIONS)}, n2 as (select *, row_number() over (partition by video order by node_id) as place from nodes where admitted) select video, place::int as place, key, n, first_seen, last_seen from n2")
def q_rebuild_equivalence(spark, d):
    """Everything added and some chunks taken back, held against a memory that never had them: nodes by place, as seq numbers differ."""
    from pyspark.sql import Window

    rows = log(spark, d)
    left = M.nodes(M.retract(rows, rows.filter("chunk % 4 = 2").select("video", "chunk").distinct())).filter("admitted")
    return left.select("video", F.row_number().over(Window.partitionBy("video").orderBy("node_id")).alias("place"), "key", "n", "first_seen", "last_seen")


@query("select user_id as video, event_type as key, count(*) as n, 'STATE ' || event_type || ': response=' || arg_max(event_id, (epoch_us(ts), event_id))::varchar || '; delta=' || arg_max((event_id % 3), (epoch_us(ts), event_id))::varchar || '; label=None; cutoff=' || max(epoch_us(ts))::varchar as text from events group by user_id, event_type")
def q_task_state_node(spark, d):
    rows = table(spark, d, "events").select(F.col("user_id").alias("video"), F.col("event_type").alias("key"), F.unix_micros(F.col("ts").cast("timestamp")).alias("ts"), F.col("event_id").alias("response"), (F.col("event_id") % 3).alias("delta"))
    return M.task_states(rows).select("video", "key", "n", "text")


def declared(spark: SparkSession, d: str) -> DataFrame:
    """Entity observations with their local ids; every third chunk gives its second declaration of an id to another entity."""
    rows = log(spark, d).filter("node_type = 'entity'").select("video", "chunk", F.col("seq").alias("pos"), X.stable_id("text").alias("local_id"), X.entity_description("text").alias("description"))
    other = (F.col("chunk") % 3 == 0) & ~F.col("description").startswith("guest")
    return rows.withColumn("gid", F.concat(F.substring("local_id", 1, 1), F.lit("g"), F.substring("local_id", 2, 9), F.when(other, "x").otherwise("")))


def _declared_sql() -> str:
    from .catalogue import _DESC

    return f"{OBS}, decl0 as (select video, chunk, seq as pos, nullif(regexp_extract(text, '^([PO][0-9]+)\\b', 1), '') as local_id, {_DESC} as description from obs where node_type = 'entity'), decl as (select *, left(local_id, 1) || 'g' || substr(local_id, 2, 9) || case when chunk % 3 = 0 and not starts_with(description, 'guest') then 'x' else '' end as gid from decl0)"


@query(f"with {_declared_sql()}, n as (select *, trim(regexp_replace(lower(description), '\\s+', ' ', 'g')) as norm from decl) select video, chunk, pos, local_id, local_id is not null and lag(gid) over w is not null and norm is not distinct from lag(norm) over w as repeated, local_id is not null and min(gid) over (partition by video, chunk, local_id) <> max(gid) over (partition by video, chunk, local_id) as ambiguous from n window w as (partition by video, chunk, local_id order by pos)")
def q_declaration_conflicts(spark, d):
    return M.declaration_status(declared(spark, d)).select("video", "chunk", "pos", "local_id", "repeated", "ambiguous")


@query(f"with {_declared_sql()}, local as (select video, chunk, local_id, min(gid) as gid from decl group by all having count(distinct gid) = 1), named as (select video, chunk, item, unnest(range(len(r))) as place, unnest(r) as local_id from (select video, chunk, item, regexp_extract_all(text, '\\b([PO][0-9]+)\\b', 1) as r from items where node_type not in ('entity', 'text_ocr'))) select n.video, n.chunk, n.item::bigint as item, n.place::int as place, n.local_id, l.gid from named n left join local l on l.video = n.video and l.chunk = n.chunk and l.local_id = n.local_id")
def q_reference_provenance(spark, d):
    items = M.parse_captions(captions(spark, d)).withColumn("item", F.col("item").cast("long"))
    return M.references(items, declared(spark, d)).select("video", "chunk", "item", "place", "local_id", "gid")


# ---- flat captions -----------------------------------------------------------------------------------------------


_FLAT = "flat as (select video, row_number() over (partition by video order by chunk) as node_id, ts, caption as text from cap qualify node_id <= 20)"


@query(f"with {OBS}, {_FLAT} select video, node_id, md5(text) as text from flat")
def q_flat_memory(spark, d):
    return M.flat_captions(captions(spark, d), 20).select("video", "node_id", F.md5("text").alias("text"))


def hits_sql(nodes: str, k: int, keep: str = "sim >= 0.2") -> str:
    return f"sims as (select n.video, q.qid, n.node_id, round(list_dot_product(n.v, v.v), 6) as sim from {nodes} n join rq q using (video) join vecs v on v.vec_id = (13 * q.video + 31 * q.qid) % (select greatest(1, count(*)) from embeddings)), best as (select *, row_number() over (partition by video, qid order by sim desc, node_id) as rank from sims qualify rank <= {k}), hits as (select * from best where {keep})"


ASKED_OF = (
    (0, "How many times did the guest click so far?", "click"), (1, "What happened after the box was seen?", ""), (2, "Where are purples?", ""), (3, "how many times did they fly", "fly"), (4, "What is the primary focus?", ""),
)
RQ = "rq as (select video, qid, question, focus from (select distinct video from frames), (values " + ", ".join(f"({i}, {_lit(q)}, {_lit(f)})" for i, q, f in ASKED_OF) + ") t(qid, question, focus))"


def asked_of(spark: SparkSession, d: str) -> DataFrame:
    """video, qid, question, vec: five questions to each memory."""
    rows = F.explode(F.array(*[F.struct(F.lit(i).alias("qid"), F.lit(q).alias("question")) for i, q, _ in ASKED_OF]))
    asked = frames(spark, d).select("video").distinct().select("video", rows.alias("r")).select("video", "r.*")
    return stored(numbered(spark, d, asked, 13 * F.col("video") + 31 * F.col("qid")), "asked")


@query(f"with {OBS}, {_FLAT}, vecs as (select vec_id, embedding::double[] as v from embeddings), fv as (select f.video, f.node_id, f.ts, f.text, v.v from flat f join vecs v on v.vec_id = (7 * f.node_id + f.video) % (select greatest(1, count(*)) from embeddings)), {RQ}, {hits_sql('fv', 6, 'sim >= 0.1')} select h.video, h.qid, count(*) as hit_count, md5(string_agg(printf('[%02d:%02d]', floor(f.ts)::bigint // 60, floor(f.ts)::bigint % 60) || chr(10) || f.text, chr(10) || chr(10) order by f.ts, f.node_id)) as context from hits h join flat f using (video, node_id) group by all")
def q_flat_context(spark, d):
    flat = stored(M.flat_captions(captions(spark, d), 20), "flat")
    hits = S.above(S.search(asked_of(spark, d), numbered_nodes(spark, d, flat), 6, vectors(spark, d)), 0.1)
    return S.flat_context(hits, flat).withColumn("context", F.md5("context"))


# ---- whole contexts ----------------------------------------------------------------------------------------------


def _memory(spark: SparkSession, d: str, expand: bool = True, co_occurrence: bool = True, next_action: bool = True):
    """The log, the nodes, and the graph with what the branches that are on read."""
    # The log and the linked nodes are read by many branches; written once, each is computed once.
    rows = stored(M.keyed(log(spark, d)), "log")
    node = stored(M.hubs_by_id(M.nodes(rows.repartition("video"))), "nodes")
    linked = stored(with_near(spark, d, rows, node), "linked")
    held = M.with_next(linked) if expand and next_action else linked
    if not (expand and co_occurrence):
        return rows, node, S.graph(held, None)
    keys = linked.filter("node_type = 'entity'").select("video", "key", "node_id")
    edge = M.edges(rows).join(keys.select("video", F.col("key").alias("a"), F.col("node_id").alias("ia")), ["video", "a"]).join(keys.select("video", F.col("key").alias("b"), F.col("node_id").alias("ib")), ["video", "b"]).select("video", F.col("ia").alias("a"), F.col("ib").alias("b"))
    return rows, node, S.graph(held, edge)


def _hits(spark: SparkSession, d: str, node: DataFrame, asked: DataFrame) -> DataFrame:
    found = S.search(asked, numbered_nodes(spark, d, node.filter("admitted")), 5, vectors(spark, d))
    return found.filter(F.col("sim") >= F.when(F.col("qid").isin(2, 4), 0.99).otherwise(0.2))


_HITS = hits_sql("nv", 5, "sim >= case when qid in (2, 4) then 0.99 else 0.2 end")


def expanded_sql(branches: str = "spokes hubs co next") -> str:
    out = [
        "select video, qid, node_id from seeds",
        "select s.video, s.qid, l.node_id from linked l join seeds s on s.video = l.video and s.node_type = 'entity' and l.hub = s.node_id" if "spokes" in branches else "",
        "select video, qid, hub from seeds where node_type <> 'entity' and hub is not null" if "hubs" in branches else "",
        "select s.video, s.qid, p.b from pairs p join seeds s on s.video = p.video and s.node_type = 'entity' and s.node_id = p.a union select s.video, s.qid, p.a from pairs p join seeds s on s.video = p.video and s.node_type = 'entity' and s.node_id = p.b" if "co" in branches else "",
        "select s.video, s.qid, unnest([c.next1, c.next2]) from chain c join seeds s on s.video = c.video and s.node_id = c.node_id and s.node_type = 'action' and s.hub is not null" if "next" in branches else "",
    ]
    return "expanded as (select * from (" + " union ".join(x for x in out if x) + ") where node_id is not null)"


_PAIRS = "pairs as (select e.video, x.node_id as a, y.node_id as b from edges e join linked x on x.video = e.video and x.key = e.a join linked y on y.video = e.video and y.key = e.b)"
SEEDED = f"{LINKED}, {_CHAIN}, {_EDGES}, {_PAIRS}, {RQ}, {_HITS}, seeds as (select h.video, h.qid, l.node_id, l.node_type, l.hub from hits h join linked l using (video, node_id))"


def _ablation(name: str, branches: str, **switches: bool) -> None:
    def run(spark, d):
        asked = asked_of(spark, d)
        _, node, memory = _memory(spark, d, **switches)
        seeds = _hits(spark, d, node, asked).groupBy("video", "qid").agg(F.sort_array(F.collect_set("node_id")).alias("seeds"))
        ids = S.with_memory(seeds, memory).withColumn("ids", S.expanded_ids("nodes", "seeds", **switches))
        return ids.select("video", "qid", F.size("ids").cast("long").alias("n"), F.aggregate("ids", F.lit(0).cast("long"), lambda a, x: a + x).alias("ids"))

    run.__name__ = name
    query(f"with {SEEDED}, {expanded_sql(branches)} select video, qid, count(*) as n, sum(node_id)::bigint as ids from expanded group by all")(run)


_ablation("expand_hits", "spokes hubs co next")
_ablation("expand_off", "", expand=False)
_ablation("expand_no_co_occurrence", "spokes hubs next", co_occurrence=False)
_ablation("expand_no_next_action", "spokes hubs co", next_action=False)

_MMSS = "printf('%02d:%02d', floor({t})::bigint // 60, floor({t})::bigint % 60)"
_LINE = f"'  [' || {_MMSS.format(t='ts')} || '] ' || text"
_CLOCK_OF = f"'[' || {_MMSS.format(t='s.first_seen')} || '] '"
_COUNT_BLOCKS = (
    f"acts as (select k.video, k.seq, k.ts, round(k.ts, 1) as t, k.text, n.node_id, n.admitted from keyed k join nodes n on n.video = k.video and n.key = k.key where k.node_type = 'action'), fs as (select video, qid, unnest({_stems_of('focus')}) as stem from rq where focus <> ''), fk as (select * from fs where len(stem) >= 3 and stem not in (select s from stops)),"
    f" heard as (select video, seq, t, text, unnest({_stems_of('text')}) as stem from acts), one as (select k.video, k.qid, k.stem, a.t, min(a.seq) as seq, arg_min(a.text, a.seq) as text from fk k join heard a on a.video = k.video and a.stem = k.stem group by all),"
    " placed as (select *, row_number() over (partition by video, qid, stem order by t) as place from one),"
    f" stemmed as (select video, qid, stem, count(*) as n, arg_min(text, seq) as sample, string_agg({_MMSS.format(t='t')}, ', ' order by t) filter (place <= 8) as times from placed group by all), stem_rank as (select *, row_number() over (partition by video, qid order by n desc, stem) as rank from stemmed qualify rank <= 5),"
    f" count_block as (select video, qid, {_lit(V.COUNT_TITLE)} || string_agg('  ''' || stem || ''' (e.g. \"' || rtrim(left(sample, 60)) || '\"): ' || n::varchar || ' time(s) at [' || times || case when n > 8 then ', ...' else '' end || ']', chr(10) order by rank) as block from stem_rank group by all),"
    " focus_sims as (select n.video, q.qid, q.focus, n.node_id, round(list_dot_product(n.v, v.v), 6) as sim from nv n join rq q on q.video = n.video and q.focus <> '' join vecs v on v.vec_id = (17 * q.video + 3) % (select greatest(1, count(*)) from embeddings) where n.node_type = 'action'),"
    " like_t as (select s.video, s.qid, s.focus, a.t, max(s.sim) as sim, arg_max(a.text, (s.sim, -a.seq)) as text from focus_sims s join acts a on a.video = s.video and a.node_id = s.node_id group by all having max(s.sim) >= 0.1),"
    " like_n as (select *, row_number() over (partition by video, qid order by t) as place, row_number() over (partition by video, qid, trim(regexp_replace(lower(text), '\\s+', ' ', 'g')) order by sim desc, t) as again from like_t), like_r as (select *, row_number() over (partition by video, qid order by again > 1, sim desc, t) as rank from like_n),"
    f" semantic_block as (select video, qid, {_lit(V.SEMANTIC_COUNT[0])} || '  Activity \"' || focus || '\": ' || count(*)::varchar || ' candidate occurrence(s) at [' || string_agg({_MMSS.format(t='t')}, ', ' order by t) filter (place <= 8) || case when count(*) > 8 then ', ...' else '' end || {_lit(V.SEMANTIC_COUNT[1])} || string_agg(left(text, 60), ' | ' order by rank) filter (again = 1 and rank <= 3) || {_lit(V.SEMANTIC_COUNT[2])} as block from like_r group by video, qid, focus)"
)
_EVENT_BLOCKS = (
    f"recent as (select video, string_agg({_LINE}, chr(10) order by ts, seq) as block from (select *, row_number() over (partition by video order by ts desc, seq desc) as back from tl qualify back <= 6) group by video),"
    f" scored as (select t.*, q.qid, list_has_any({_stems_of('t.text')}, {_stems_of('q.question')}) as hit, row_number() over (partition by t.video, q.qid order by t.seq desc) as back from tl t join rq q using (video)), any_hit as (select *, max(hit::int) over (partition by video, qid) as any0 from scored),"
    f" first_ten as (select *, row_number() over (partition by video, qid order by ts, seq) as place from any_hit where hit or (any0 = 0 and back <= 8) qualify place <= 10), spoken as (select video, qid, string_agg({_LINE}, chr(10) order by ts, seq) as block from first_ten group by all)"
)
_GRAPH_BLOCKS = (
    "shown as (select e.qid, l.* from linked l join expanded e using (video, node_id)), hub as (select * from shown where node_type = 'entity'),"
    f" body as (select s.video, s.qid, s.node_id, s.node_type, s.first_seen, h.node_id as hub, s.text, case when s.node_type in ('action', 'event') then {_CLOCK_OF} else '' end as clock, {_TIMES} as times, case when starts_with(lower(trim(s.text)), lower(trim(h.text))) and len({_REST}) > 3 then {_REST} else s.text end as own from shown s left join hub h on h.video = s.video and h.qid = s.qid and h.node_id = s.hub where s.node_type <> 'entity'),"
    " body_lines as (select video, qid, hub, string_agg('  ' || clock || own || times, chr(10) order by (node_type = 'spatial')::int, first_seen, node_id) as l from body where hub is not null and node_type in ('action', 'event', 'spatial') group by all),"
    " profiles as (select h.video, h.qid, 2 as b, h.first_seen as t, h.node_id as id, concat_ws(chr(10), '[' || h.text || ']' || case when h.n > 1 then ' ×' || h.n::varchar else '' end, l.l) as block from hub h left join body_lines l on l.video = h.video and l.qid = h.qid and l.hub = h.node_id"
    " union all select video, qid, 3, 0, 0, '[Other]' || chr(10) || string_agg('  • ' || clock || text || times, chr(10) order by first_seen, node_id) from body where hub is null and node_type <> 'text_ocr' group by video, qid"
    " union all select video, qid, 4, 0, 0, '[Screen Text]' || chr(10) || string_agg('  • \"' || text || '\"', chr(10) order by node_id) from body where node_type = 'text_ocr' group by video, qid)"
)
RETRIEVED = (
    f"{SEEDED}, {expanded_sql()}, {_STOPS}, {_TL}, {_COUNT_BLOCKS}, {_EVENT_BLOCKS}, {_GRAPH_BLOCKS},"
    " asked as (select q.*, qid in (0, 3) as counting, qid in (0, 4) as recency, qid = 1 as temporal, (select count(*) from seeds s where s.video = q.video and s.qid = q.qid) as hit_count, exists (select 1 from shown s where s.video = q.video and s.qid = q.qid and s.node_type in ('action', 'event')) as dated, exists (select 1 from acts a where a.video = q.video) as has_acts, (select block from recent r where r.video = q.video) as recent_lines from rq q),"
    " alive as (select * from asked where hit_count > 0 or (recency and recent_lines is not null) or (counting and has_acts)),"
    " blocks as (select a.video, a.qid, 0 as b, 0 as t, 0 as id, coalesce(c.block, m.block) as block from alive a left join count_block c using (video, qid) left join semantic_block m using (video, qid) where a.counting"
    " union all select video, qid, 1, 0, 0, '[Most recent events]' || chr(10) || recent_lines from alive where recency union all select p.* from profiles p join alive using (video, qid)"
    " union all select a.video, a.qid, 5, 0, 0, '[Timeline]' || chr(10) || s.block from alive a join spoken s using (video, qid) where a.temporal or a.dated),"
    " joined as (select video, qid, string_agg(block, chr(10) || chr(10) order by b, t, id) as context from blocks where block is not null group by all),"
    f" found as (select a.video, a.qid, a.question, coalesce(j.context, '') as context, a.hit_count > 0 as matched, a.hit_count, case when a.hit_count = 0 then {_lit(V.NO_MATCH_SIGNAL)} end as signal from asked a left join joined j using (video, qid))"
)


def retrieved(spark: SparkSession, d: str) -> DataFrame:
    asked = asked_of(spark, d)
    rows, node, memory = _memory(spark, d)
    acts = M.keyed(rows.filter("node_type = 'action'")).join(node.filter("admitted").select("video", "key", "node_id"), ["video", "key"], "left").select("video", "ts", "seq", "text", "node_id")
    focus = numbered(spark, d, asked.select("video", "qid").filter("qid in (0, 3)"), 17 * F.col("video") + 3)
    sims = S.search(focus, numbered_nodes(spark, d, node.filter("admitted and node_type = 'action'")), V.MAX_NODES, vectors(spark, d))
    return S.retrieve(asked, _hits(spark, d, node, asked), memory, M.timeline(rows, node), acts, sims.filter("sim >= 0.1"), semantic_threshold=0.1)


@query(f"with {RETRIEVED} select video, qid, context, matched, hit_count, signal from found")
def q_retrieve_context(spark, d):
    return retrieved(spark, d).drop("question")


@query(f"with {RETRIEVED} select video, qid, case when matched and context <> '' then context || chr(10) || chr(10) || question when not matched then signal || chr(10) || chr(10) || question else question end as prompt from found")
def q_prompt_compose(spark, d):
    return retrieved(spark, d).select("video", "qid", S.compose(F.col("question"), F.col("context"), F.col("matched"), V.NO_MATCH_SIGNAL).alias("prompt"))


@query(f"with {OBS}, {nodes_sql()}, {VECS}, {RQ}, {_HITS} select video, qid, array_to_string(list_transform(list(sim order by rank), lambda x: round(x + 0.000001::double, 4)), ',') as sims from best group by all")
def q_rounded_similarities(spark, d):
    node = stored(M.nodes(log(spark, d)), "nodes")
    found = S.search(asked_of(spark, d), numbered_nodes(spark, d, node.filter("admitted")), 5, vectors(spark, d))
    sims = found.groupBy("video", "qid").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "sim"))), lambda x: x["sim"] + 1e-6).alias("sims"))
    return sims.select("video", "qid", F.array_join(F.transform(S.round_similarities("sims"), lambda x: X.plain(x, 4)), ",").alias("sims"))
