"""The keyword gate and the answer routes, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text as X
from . import values as V


#: Each pattern of V.SCAFFOLD needs one of these words; texts without any are not matched against them.
SCAFFOLD_WORDS = "(?iU)watching|responsible|task|answer|respond|additional|decide|motion|performing|latest|option|question"


def strip_scaffold(c: Column | str) -> Column:
    def stripped(text: Column) -> Column:
        out = text
        for p in V.SCAFFOLD:
            out = F.regexp_replace(out, "(?imsdU)" + p, " ")
        return F.when(text.rlike(SCAFFOLD_WORDS), out).otherwise(text)

    return F.trim(F.regexp_replace(X.let(F.coalesce(X._col(c), F.lit("")), stripped), "(?U)\\s+", " "))


def cues(c: Column | str, table: dict[str, str]) -> Column:
    """Names of the cues in a text, in the table's order."""
    c = X._col(c)
    return F.filter(F.array(*[F.when(c.rlike("(?iU)" + p), F.lit(name)) for name, p in table.items()]), lambda n: n.isNotNull())


def option_cues(options: Column | str) -> Column:
    """Memory cues that at least half of the options have, and two at least."""
    options = X._col(options)
    quorum = F.greatest(F.lit(2), F.floor((F.size(options) + 1) / 2))

    def voted(bare: Column) -> Column:
        def votes(pattern: str) -> Column:
            return F.size(F.filter(bare, lambda o: o.rlike("(?iU)" + pattern)))

        return F.filter(F.array(*[F.when(votes(p) >= quorum, F.lit(name)) for name, p in V.MEMORY_CUES.items()]), lambda n: n.isNotNull())

    return X.let(F.transform(options, strip_scaffold), voted)


def gate(question: Column | str, options: Column | str | None = None) -> Column:
    """needs_memory, bucket, memory_cues, recent_cues, strict of a question."""
    none = F.array().cast("array<string>")
    weak = F.array(*map(F.lit, V.WEAK_CUES))
    voted = F.coalesce(option_cues(options), none) if options is not None else none
    found = X.let(strip_scaffold(question), lambda bare: F.struct(cues(bare, V.MEMORY_CUES).alias("memory"), cues(bare, V.RECENT_CUES).alias("recent"), voted.alias("voted")))

    def strong(m: Column) -> Column:
        return F.size(F.array_except(m, weak)) > 0

    def decide(f: Column) -> Column:
        memory, recent = f["memory"], f["recent"]
        bucket = F.when(strong(memory) | ((F.size(memory) > 0) & (F.size(recent) == 0)), "strong_memory").when(F.size(recent) > 0, "strong_recent").when(strong(f["voted"]), "strong_memory").otherwise("ambiguous")
        by_vote = (F.size(memory) == 0) & (F.size(recent) == 0) & strong(f["voted"])
        return F.struct(F.when(by_vote, f["voted"]).otherwise(memory).alias("memory_cues"), recent.alias("recent_cues"), bucket.alias("bucket"))

    def fields(g: Column) -> Column:
        return F.struct((g["bucket"] != "strong_recent").alias("needs_memory"), g["bucket"].alias("bucket"), g["memory_cues"].alias("memory_cues"), g["recent_cues"].alias("recent_cues"), (g["bucket"] == "ambiguous").alias("strict"))

    return X.let(X.let(found, decide), fields)


def ovo_route(gated: Column, floor: float = 0.55, strict: float = 0.70, history: bool = True, uniform: bool = True) -> Column:
    use = gated["needs_memory"] & F.lit(history)
    return F.struct(
        F.when(use, "hub_and_spoke_memory").otherwise("recent_window").alias("method_family"),
        F.lit("uniform_abstention" if uniform else "standard_mcq").alias("policy"),
        use.alias("use_memory"),
        F.lit(uniform).alias("include_no_match_signal"),
        F.when(use, F.when(gated["strict"], strict).otherwise(floor)).alias("min_evidence_sim"),
    )


def stream_route(question: Column | str, gated: Column) -> Column:
    return F.when(~gated["needs_memory"], "recent_window").when(X.is_count_question(strip_scaffold(question)), "interval_state").otherwise("graph_memory")


def stream_floor(route: Column, gated: Column, floor: float | None, strict: float) -> Column:
    return F.when(route == "graph_memory", F.when(gated["strict"], F.lit(strict)).otherwise(F.lit(floor).cast("double")))
