"""A memory as one object: an immutable value over the observation log, whose views are DataFrames.

    memory = open_memory(spark, MemoryConfig(mode="entity_resolved"), factory)
    memory = memory.update(captions).remove_chunks(chunks)
    contexts = memory.retrieve(questions, top_k="dynamic")

update and remove_chunks give a new memory; nothing is changed in place. Questions are (video, qid, question).
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import values as V
from .models import scorer as models
from .operators import chunks as C
from .operators import memory as M
from .operators import retrieval as S

MODES = ("entity_resolved", "incremental", "hub_spoke", "flat_caption")
POLICIES = ("uniform", "plain")


@dataclass(frozen=True)
class MemoryConfig:
    """How a memory is built and asked. Ablation switches exist in mode hub_spoke only, as does the count aggregate."""

    mode: str = "entity_resolved"
    max_nodes: int = V.MAX_NODES
    sim_threshold: float = 0.25
    link_threshold: float = V.LINK_THRESHOLD
    top_k_max: int = V.TOP_K_MAX
    min_evidence_sim: float | None = None
    merge_spokes: bool = True
    expand: bool = True
    co_occurrence: bool = True
    next_action: bool = True
    stride: int = 1
    max_chunks: int = 0
    prompt_policy: str = "uniform"

    def __post_init__(self):
        if self.mode not in MODES:
            raise ValueError(f"mode must be one of {MODES}, not {self.mode!r}")
        if self.prompt_policy not in POLICIES:
            raise ValueError(f"prompt_policy must be one of {POLICIES}, not {self.prompt_policy!r}")
        for name in ("sim_threshold", "link_threshold", "min_evidence_sim"):
            x = getattr(self, name)
            if x is not None and not 0 <= x <= 1:
                raise ValueError(f"{name} must be between 0 and 1, not {x!r}")
        if self.max_nodes < 1 or self.top_k_max < 1 or self.stride < 1 or self.max_chunks < 0:
            raise ValueError("max_nodes, top_k_max and stride must be positive, max_chunks not negative")
        if self.mode != "hub_spoke" and not (self.merge_spokes and self.expand and self.co_occurrence and self.next_action):
            raise ValueError(f"mode {self.mode} has no ablation switches")


CAPTIONS = "video long, chunk long, ts double, caption string"


class Memory:
    def __init__(self, config: MemoryConfig, factory: models.Factory | None, captions: DataFrame, removed: DataFrame | None = None, states: DataFrame | None = None, cache: models.VectorCache | None = None):
        self.config, self.factory, self.captions, self.removed, self.states, self.cache = config, factory, captions, removed, states, cache

    def update(self, captions: DataFrame) -> "Memory":
        """With captions (video, chunk, ts, caption) added. A chunk that is there already has to be removed first."""
        return Memory(self.config, self.factory, self.captions.unionByName(captions.select("video", "chunk", "ts", "caption")), self.removed, self.states, self.cache)

    def remove_chunks(self, chunks: DataFrame) -> "Memory":
        """Without chunks (video, chunk): everything that only they support goes, what they crowded out comes back."""
        gone = chunks.select("video", "chunk")
        return Memory(self.config, self.factory, self.captions, gone if self.removed is None else self.removed.unionByName(gone).distinct(), self.states, self.cache)

    def update_task_state(self, updates: DataFrame) -> "Memory":
        """With updates (video, key, ts, response, and perhaps delta and label) of task states."""
        return Memory(self.config, self.factory, self.captions, self.removed, updates if self.states is None else self.states.unionByName(updates, allowMissingColumns=True), self.cache)

    def task_states(self) -> DataFrame:
        if self.states is None:
            raise ValueError("this memory has no task states")
        return M.task_states(self.states)

    @cached_property
    def kept(self) -> DataFrame:
        return self.captions if self.removed is None else self.captions.join(self.removed, ["video", "chunk"], "left_anti")

    @cached_property
    def declared(self) -> DataFrame:
        """Declarations of entities with their global ids; entity_resolved only."""
        return M.declarations(self.kept, self._embed, self.config.link_threshold)

    @cached_property
    def log(self) -> DataFrame:
        return M.resolved_observations(self.kept, self.declared) if self.config.mode == "entity_resolved" else M.observations(self.kept)

    @cached_property
    def nodes(self) -> DataFrame:
        return M.nodes(self.log, typed=self.config.mode != "hub_spoke", merge_spokes=self.config.merge_spokes, cap=self.config.max_nodes)

    @cached_property
    def vectors(self) -> DataFrame:
        return self._embed(self.nodes.filter("admitted").select("video", "node_id", "text")).select("video", "node_id", "vector")

    @cached_property
    def linked(self) -> DataFrame:
        return M.with_hubs(self.log, self.nodes, self.vectors, self.config.link_threshold, self.config.mode == "entity_resolved")

    @cached_property
    def edges(self) -> DataFrame:
        """Co-occurring entities by node_id: video, a, b, support."""
        known = self.linked.filter("node_type = 'entity'").select("video", "key", "node_id")
        a, b = (known.select("video", F.col("key").alias(c), F.col("node_id").alias(f"_{c}")) for c in "ab")
        return M.edges(self.log).join(a, ["video", "a"]).join(b, ["video", "b"]).select("video", F.col("_a").alias("a"), F.col("_b").alias("b"), "support")

    def _embed(self, rows: DataFrame, text: str = "text") -> DataFrame:
        return models.embed(rows, text, self._scorer(), cache=self.cache)

    def _scorer(self) -> models.Factory:
        if self.factory is None:
            raise ValueError("this memory has no scorer: give open_memory a factory")
        return self.factory

    def hits(self, questions: DataFrame, top_k: int | str | None = V.TOP_K_MAX, threshold: float | None = None, min_evidence_sim: float | None = None) -> DataFrame:
        """video, qid, node_id, sim, rank: the best nodes from the threshold on, up to the gap if top_k is dynamic, from the evidence floor on."""
        k, dynamic = S.top_k_argument(top_k, self.config.top_k_max)
        threshold = self.config.sim_threshold if threshold is None else threshold
        asked = self._embed(questions.select("video", "qid", "question"), "question")
        if self.config.mode == "flat_caption":
            pool = self._embed(self.flat()).select("video", "node_id", "vector")
        else:
            pool = self.vectors
        found = S.above(S.search(asked, pool, k), threshold)
        if dynamic:
            one = found.withColumn("_q", F.struct("video", "qid")).withColumnRenamed("qid", "_qid").withColumnRenamed("_q", "qid")
            found = S.gap_cutoff(one, threshold).select("qid.video", "qid.qid", "node_id", "sim", "rank")
        floor = self.config.min_evidence_sim if min_evidence_sim is None else min_evidence_sim
        return found if floor is None else S.above(found, floor)

    def flat(self) -> DataFrame:
        return M.flat_captions(self.kept, self.config.max_nodes)

    def retrieve(self, questions: DataFrame, top_k: int | str | None = V.TOP_K_MAX, threshold: float | None = None, min_evidence_sim: float | None = None) -> DataFrame:
        """video, qid, context, matched, hit_count, signal for each question."""
        found = self.hits(questions, top_k, threshold, min_evidence_sim)
        if self.config.mode == "flat_caption":
            got = S.flat_context(found, self.flat())
            out = questions.select("video", "qid").join(got, ["video", "qid"], "left").fillna({"hit_count": 0, "context": ""})
            matched = F.col("hit_count") > 0
            return out.select("video", "qid", "context", matched.alias("matched"), "hit_count", F.when(~matched, V.NO_MATCH_SIGNAL).alias("signal"))
        base, c = self.config.mode == "hub_spoke", self.config
        acts = M.keyed(self.log.filter("node_type = 'action'"), typed=not base).join(self.nodes.filter("admitted").select("video", "key", "node_id"), ["video", "key"], "left").select("video", "ts", "seq", "text", "node_id")
        sims = None
        if base:
            from .functions import text as X

            focus = self._embed(questions.filter(X.is_count_question("question")).select("video", "qid", X.count_focus("question").alias("focus")), "focus")
            kinds = self.nodes.filter("admitted and node_type = 'action'").select("video", "node_id")
            sims = S.search(focus, self.vectors.join(kinds, ["video", "node_id"]), c.max_nodes)
        graph = S.graph(self.linked, self.edges, M.chains(self.linked))
        return S.retrieve(questions, found, graph, M.timeline(self.log, None if base else self.nodes), acts, sims, count_aggregate=base, expand=c.expand, co_occurrence=c.co_occurrence, next_action=c.next_action).drop("question")

    def prompts(self, questions: DataFrame, **how) -> DataFrame:
        """Retrieved contexts with the prompt that is asked: context and question, or the question behind the sign that nothing was found (policy uniform) or alone."""
        rows = self.retrieve(questions, **how).join(questions.select("video", "qid", "question"), ["video", "qid"])
        signal = V.NO_MATCH_SIGNAL if self.config.prompt_policy == "uniform" else ""
        return rows.withColumn("prompt", S.compose(F.col("question"), F.col("context"), F.col("matched"), signal))

    def answer(self, questions: DataFrame, **how) -> DataFrame:
        """A generated response to each question with its context."""
        return models.generate(self.prompts(questions, **how), "prompt", self._scorer())

    def answer_mcq(self, questions: DataFrame, options: int = 4, **how) -> DataFrame:
        """The letter chosen for each question with its context."""
        return models.choose(self.prompts(questions, **how), "prompt", self._scorer(), options)

    def stats(self) -> DataFrame:
        if self.config.mode == "flat_caption":
            return self.flat().groupBy("video").agg(F.count("*").alias("total_nodes"), F.lit("flat_caption").alias("memory_type"))
        return M.full_stats(self.log, self.nodes, self.linked, self.edges)

    def signature(self) -> DataFrame:
        return M.signature(self.linked, M.edges(self.log))

    def provenance(self) -> tuple[DataFrame, DataFrame]:
        """Declarations and references of each chunk; entity_resolved only."""
        items = M.accepted_items(self.kept)
        return M.declaration_status(self.declared), M.references(items, self.declared)


def open_memory(spark: SparkSession, config: MemoryConfig | None = None, factory: models.Factory | None = None, cache: models.VectorCache | None = None, **changes) -> Memory:
    """An empty memory. Without a factory it can be built and looked at, not asked; with a cache, texts of earlier runs are not embedded again."""
    return Memory(replace(config or MemoryConfig(), **changes), factory, spark.createDataFrame([], CAPTIONS), cache=cache)


def build_memory_from_chunks(chunks: DataFrame, prompt: str, factory: models.Factory, config: MemoryConfig | None = None, batch: int = 4) -> Memory:
    """chunks (video, chunk, mid, frames): a memory of the captions of every stride-th chunk, evenly spread ones if there are too many."""
    config = config or MemoryConfig()
    picked = C.stride_cap(chunks, config.stride, config.max_chunks, ("chunk",))
    captions = models.caption(picked, factory, prompt, batch=batch).select("video", "chunk", F.col("mid").cast("double").alias("ts"), "caption")
    return open_memory(chunks.sparkSession, config, factory).update(captions)


def answer_recent_window(frames: DataFrame, questions: DataFrame, duration: float, window: int, factory: models.Factory, options: int = 4) -> DataFrame:
    """questions (video, cutoff, prompt): the letter chosen from the last frames before each cutoff; without frames there is none, and error says so."""
    seen = C.recent_frames(frames, questions.select("video", "cutoff"), duration, window).groupBy("video", "cutoff").agg(F.transform(F.sort_array(F.collect_list(F.struct("ts", "frame_id"))), lambda x: x["frame_id"]).alias("frames"))
    rows = questions.join(seen, ["video", "cutoff"], "left")
    good = models.choose(rows.filter("frames is not null"), "prompt", factory, options, "frames").withColumn("error", F.lit(None).cast("string"))
    none = rows.filter("frames is null").withColumn("error", F.lit("no frames before the cutoff"))
    return good.unionByName(none, allowMissingColumns=True)


def stream_and_answer(chunks: DataFrame, captions: DataFrame, questions: DataFrame, window: int, factory: models.Factory, config: MemoryConfig | None = None, **how) -> DataFrame:
    """Each question (video, qid, question, cutoff) is asked of a memory of the captions of the chunks that have left its recent window by its cutoff.

    Questions of one cutoff share a memory; each (video, cutoff) is a memory of its own, so no later chunk is seen.
    """
    history = C.split_history(chunks, questions.select("video", "cutoff").distinct(), window).filter("part = 'history'")
    cuts = questions.select("video", "cutoff").distinct()
    # A memory is keyed by one number: the video and the cutoff by their hash.
    key = F.xxhash64("video", "cutoff")
    own = captions.join(history, ["video", "chunk"]).select(key.alias("video"), "chunk", "ts", "caption")
    asked = questions.select(key.alias("video"), "qid", "question")
    found = open_memory(chunks.sparkSession, config, factory).update(own).answer(asked, **how)
    names = cuts.select(F.col("video").alias("_v"), "cutoff", key.alias("video"))
    return found.join(names, "video").drop("video").withColumnRenamed("_v", "video")
