"""Mixing sources to target weights, with DataFrame functions only.

Weights run down a domain-language-source tree. A node that cannot spend its share passes the shortage to its
siblings first, since a parent's budget is shared out among its children up to what each holds (water-filling on
exact integers), and only what a whole subtree cannot spend reaches the parent's siblings. Each leaf then takes whole
seeded epochs and a token prefix of one more, in the order of md5(seed:epoch:doc_id).

No text is moved. What a document needs for its place, a narrow row of leaf, id and tokens, is written once; the end of
each leaf's prefix is found among sums over hash buckets, 256 of them, then 256 inside the bucket where it lies, and
then among that bucket's rows, a 65536th of the leaf; and documents are compared with it where they are read. So no
leaf, however large, meets in one task.

Defined cases: null text has 0 tokens and is never taken; null language or source becomes the leaf "none"; an empty
table gives no rows; repeated rows count each, and rows of equal id and number of tokens are taken into a prefix
together or not at all; columns of the input named like an added one (domain, n_tokens, epoch) are kept as input_domain
and so on; working columns start with "_mix_".
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise

#: Weights in parts of a thousand; a name that is missing gets "*".
DOMAIN_WEIGHTS = {"web": 400, "books": 300, "code": 200, "forum": 100, "*": 50}
LANG_WEIGHTS = {"en": 500, "de": 200, "fr": 200, "es": 100, "*": 50}
SOURCE_WEIGHTS = {"src0": 100, "*": 200}
#: The domain of a source is the number in its name modulo 4, as an index here; sources without a number are "web".
DOMAINS = ("web", "books", "code", "forum")
#: Leaves of up to so many rows are broadcast.
FEW_LEAVES = 100_000
LEAF = ("_mix_domain", "_mix_lang", "_mix_source")
ADDED = ("domain", "n_tokens", "epoch")
MAX_EPOCHS = 4
#: Token budget in thousandths of all tokens of the input.
BUDGET = 900
SEED = 17
BIG = "decimal(38,0)"


@dataclass(frozen=True)
class Weights:
    """Target weights of each level of the tree, and the domains that sources belong to."""

    domains: dict[str, int] = field(default_factory=lambda: DOMAIN_WEIGHTS)
    langs: dict[str, int] = field(default_factory=lambda: LANG_WEIGHTS)
    sources: dict[str, int] = field(default_factory=lambda: SOURCE_WEIGHTS)
    names: tuple[str, ...] = DOMAINS


def weight(name: Column, table: dict[str, int]) -> Column:
    out = F.lit(None).cast("int")
    for k, v in table.items():
        if k != "*":
            out = F.when(name == k, v).otherwise(out)
    return F.coalesce(out, F.lit(table["*"])).cast("long")


def share(nodes: DataFrame, parent: list[str], child: str) -> DataFrame:
    """Split _mix_budget of each parent among its children by _mix_w up to _mix_cap, adding _mix_take (whole tokens).

    Children are filled in order of cap / weight: a child takes its whole cap while that is at most its fair part of
    what is left, and the others share the rest by weight, rounded down.
    """
    ratio = F.col("_mix_cap").cast("decimal(38,6)") / F.col("_mix_w")
    w = Window.partitionBy(*parent) if parent else Window.partitionBy(F.lit(0))
    order = w.orderBy(F.col("_mix_ratio"), F.col(child))
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    nodes = (
        nodes.withColumn("_mix_ratio", ratio.cast("decimal(38,6)"))
        .withColumn("_mix_left", F.col("_mix_budget").cast(BIG) - F.coalesce(F.sum("_mix_cap").over(before), F.lit(0)).cast(BIG))
        .withColumn("_mix_weights", F.sum("_mix_w").over(after))
        .withColumn("_mix_full", F.expr(f"cast(_mix_cap as {BIG}) * _mix_weights <= cast(_mix_w as {BIG}) * _mix_left"))
    )
    # Fullness is monotone in this order, so the first open child fixes what the open ones share.
    first = F.min(F.when(~F.col("_mix_full"), F.struct("_mix_ratio", child, "_mix_left", "_mix_weights"))).over(w)
    return (
        nodes.withColumn("_mix_first", first)
        .withColumn("_mix_take", F.when(F.col("_mix_full"), F.col("_mix_cap")).otherwise(F.expr("cast(floor(cast(_mix_w as decimal(20,0)) * cast(greatest(_mix_first._mix_left, 0) as decimal(18,0)) / _mix_first._mix_weights) as long)")))
        .drop("_mix_ratio", "_mix_left", "_mix_weights", "_mix_full", "_mix_first")
    )


def with_leaf(docs: DataFrame, names: tuple[str, ...] = DOMAINS) -> DataFrame:
    number = F.try_to_number(F.regexp_extract(F.col("source"), "([0-9]{1,9})", 1), F.lit("999999999"))
    domain = F.coalesce(F.element_at(F.array(*map(F.lit, names)), (number % len(names) + 1).cast("int")), F.lit(names[0]))
    return docs.withColumns(
        {
            "_mix_domain": domain,
            "_mix_lang": F.coalesce(F.col("lang"), F.lit("none")),
            "_mix_source": F.coalesce(F.col("source"), F.lit("none")),
            "_mix_tokens": F.coalesce(F.regexp_count(F.col("text"), F.lit("[^ \\t\\n\\x0B\\f\\r]+")), F.lit(0)).cast("long"),
        }
    )


def leaf_budgets(leaves: DataFrame, budget: int = BUDGET, max_epochs: int = MAX_EPOCHS, weights: Weights = Weights()) -> DataFrame:
    """leaves: one row per (_mix_domain, _mix_lang, _mix_source) with its _mix_have tokens. Adds _mix_take."""
    leaves = leaves.withColumn("_mix_cap", F.col("_mix_have") * max_epochs)
    domains = leaves.groupBy("_mix_domain").agg(F.sum("_mix_cap").alias("_mix_cap"), F.sum("_mix_have").alias("_mix_h"))
    total = F.sum("_mix_h").over(Window.partitionBy(F.lit(0)))
    domains = domains.withColumn("_mix_budget", F.floor(total.cast("decimal(18,0)") * budget / 1000).cast("long")).drop("_mix_h")
    domains = share(domains.withColumn("_mix_w", weight(F.col("_mix_domain"), weights.domains)), [], "_mix_domain").select("_mix_domain", F.col("_mix_take").alias("_mix_budget"))
    langs = leaves.groupBy("_mix_domain", "_mix_lang").agg(F.sum("_mix_cap").alias("_mix_cap")).join(domains, "_mix_domain")
    langs = share(langs.withColumn("_mix_w", weight(F.col("_mix_lang"), weights.langs)), ["_mix_domain"], "_mix_lang").select("_mix_domain", "_mix_lang", F.col("_mix_take").alias("_mix_budget"))
    at = leaves.join(langs, ["_mix_domain", "_mix_lang"])
    return share(at.withColumn("_mix_w", weight(F.col("_mix_source"), weights.sources)), ["_mix_domain", "_mix_lang"], "_mix_source")


def small(df: DataFrame) -> DataFrame:
    """df, broadcast if it has few rows; it is written already, so counting costs little."""
    return F.broadcast(df) if df.count() <= FEW_LEAVES else df


def last_bucket(sizes: DataFrame, bucket: str) -> DataFrame:
    """sizes: leaves, bucket, _mix_n, _mix_rest and _mix_start (tokens before the first bucket). The bucket in which each leaf's prefix ends, with the tokens before it."""
    before = F.coalesce(F.sum("_mix_n").over(Window.partitionBy(*LEAF).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    found = sizes.withColumn("_mix_start", F.col("_mix_start") + before).filter("_mix_start <= _mix_rest and _mix_rest < _mix_start + _mix_n")
    return found.select(*LEAF, bucket, "_mix_start", "_mix_rest")


def prefix_ends(rows: DataFrame) -> DataFrame:
    """rows: leaves, _mix_hash, _mix_id, _mix_tokens and _mix_rest. For each leaf _mix_four and _mix_last: documents up to there are in its prefix of _mix_rest tokens at most."""
    rows = rows.withColumn("_mix_four", F.substring("_mix_hash", 1, 4))
    four = materialise(rows.sparkSession, rows.groupBy(*LEAF, "_mix_rest", "_mix_four").agg(F.sum("_mix_tokens").alias("_mix_n")), "mix-buckets").withColumn("_mix_two", F.substring("_mix_four", 1, 2))
    two = four.groupBy(*LEAF, "_mix_rest", "_mix_two").agg(F.sum("_mix_n").alias("_mix_n")).withColumn("_mix_start", F.lit(0).cast("long"))
    inside = four.join(last_bucket(two, "_mix_two").drop("_mix_rest"), [*LEAF, "_mix_two"])
    ends = materialise(rows.sparkSession, last_bucket(inside, "_mix_four"), "mix-bucket-ends")
    # Rows of equal hash, id and tokens go together.
    own = rows.drop("_mix_rest").join(small(ends), [*LEAF, "_mix_four"]).groupBy(*LEAF, "_mix_four", "_mix_start", "_mix_rest", "_mix_hash", "_mix_id", "_mix_tokens").agg(F.sum("_mix_tokens").alias("_mix_n"))
    place = F.struct("_mix_hash", "_mix_id", "_mix_tokens")
    upto = F.col("_mix_start") + F.sum("_mix_n").over(Window.partitionBy(*LEAF).orderBy("_mix_hash", "_mix_id", "_mix_tokens").rowsBetween(Window.unboundedPreceding, 0))
    return own.withColumn("_mix_upto", upto).groupBy(*LEAF, "_mix_four").agg(F.max(F.when(F.col("_mix_upto") <= F.col("_mix_rest"), place)).alias("_mix_last"))


def mix_sources(docs: DataFrame, *, weights: Weights = Weights(), budget: int = BUDGET, max_epochs: int = MAX_EPOCHS, seed: int = SEED) -> DataFrame:
    """One row per document and epoch in which it is drawn: the input's columns, then domain, n_tokens and epoch (from 1).

    A last, partial epoch takes documents in the order of md5(seed:epoch:doc_id) while they fit; it ends before the
    first document that doesn't fit.
    """
    spark = docs.sparkSession
    rows = with_leaf(docs, weights.names).withColumn("_mix_id", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))
    narrow = materialise(spark, rows.select(*LEAF, "_mix_id", "_mix_tokens"), "mix-rows")
    budgets = leaf_budgets(narrow.groupBy(*LEAF).agg(F.sum("_mix_tokens").alias("_mix_have")).filter("_mix_have > 0"), budget, max_epochs, weights)
    budgets = materialise(spark, budgets.select(*LEAF, F.expr("_mix_take div _mix_have").alias("_mix_epochs"), F.expr("_mix_take % _mix_have").alias("_mix_rest")), "mix-budgets")
    place = F.md5(F.concat_ws(":", F.lit(str(seed)), (F.col("_mix_epochs") + 1).cast("string"), "_mix_id"))
    ends = prefix_ends(narrow.join(small(budgets), list(LEAF)).withColumn("_mix_hash", place).drop("_mix_epochs"))
    ends = materialise(spark, budgets.join(ends, list(LEAF)).select(*LEAF, "_mix_epochs", "_mix_four", "_mix_last"), "mix-ends")
    rows = rows.join(small(ends), list(LEAF)).withColumn("_mix_hash", place)
    last = (F.col("_mix_hash") < F.col("_mix_four")) | F.coalesce(F.struct("_mix_hash", "_mix_id", "_mix_tokens") <= F.col("_mix_last"), F.lit(False))
    times = F.when(F.col("_mix_tokens") > 0, F.col("_mix_epochs").cast("int") + last.cast("int")).otherwise(0)
    rows = rows.withColumn("_mix_epoch", F.explode(F.sequence(F.lit(0), times))).filter("_mix_epoch > 0")
    kept = [F.col(c).alias(f"input_{c}" if c in ADDED else c) for c in docs.columns]
    return rows.select(*kept, F.col("_mix_domain").alias("domain"), F.col("_mix_tokens").alias("n_tokens"), F.col("_mix_epoch").cast("int").alias("epoch"))


def _case(name: str, table: dict[str, int]) -> str:
    return "".join(f"case when {name} = '{k}' then {v} else " for k, v in table.items() if k != "*") + str(table["*"]) + " end" * (len(table) - 1)


def _share_sql(source: str, parent: str, child: str) -> str:
    by = f"partition by {parent}" if parent else ""
    keys = f"{parent}, {child}" if parent else child
    return f"""select {keys}, cap, have, case when isfull then cap else (w::hugeint * greatest(f.l, 0)) // f.ws end as take from (
  select *, min(case when not isfull then {{'r': ratio, 'c': {child}, 'l': lft, 'ws': ws}} end) over ({by}) as f from (
    select *, cap::hugeint * ws <= w::hugeint * lft as isfull from (
      select *, budget::hugeint - coalesce(sum(cap) over ({by} order by ratio, {child} rows between unbounded preceding and 1 preceding), 0)::hugeint as lft,
        sum(w) over ({by} order by ratio, {child} rows between current row and unbounded following)::hugeint as ws
      from (select *, (cap::hugeint * 1000000 // w) as ratio from ({source})))))"""


def oracle(docs: str = "documents", budget: int = BUDGET, max_epochs: int = MAX_EPOCHS, seed: int = SEED, weights: Weights = Weights()) -> str:
    """The same in DuckDB SQL, over the table or subquery named docs."""
    names = ", ".join(f"'{d}'" for d in weights.names)
    one = _share_sql(f"select domain, sum(cap)::bigint as cap, sum(have)::bigint as have, {_case('domain', weights.domains)} as w, (sum(sum(have)) over () * {budget} // 1000)::bigint as budget from leaves group by domain", "", "domain")
    two = _share_sql(f"select l.domain, l.lang0, sum(l.cap)::bigint as cap, sum(l.have)::bigint as have, {_case('l.lang0', weights.langs)} as w, any_value(d.take)::bigint as budget from leaves l join one d using (domain) group by l.domain, l.lang0", "domain", "lang0")
    three = _share_sql(f"select l.domain, l.lang0, l.source0, l.cap, l.have, {_case('l.source0', weights.sources)} as w, g.take::bigint as budget from leaves l join two g using (domain, lang0)", "domain, lang0", "source0")
    return f"""with rows0 as (select *, coalesce(([{names}])[try_cast(nullif(regexp_extract(source, '([0-9]{{1,9}})', 1), '') as bigint) % {len(weights.names)} + 1], '{weights.names[0]}') as domain, coalesce(lang, 'none') as lang0, coalesce(source, 'none') as source0,
    coalesce(len(regexp_extract_all(text, '[^ \\t\\n\\x0B\\f\\r]+')), 0)::bigint as n_tokens, coalesce(doc_id::varchar, 'null') as id0 from {docs}),
  leaves as (select domain, lang0, source0, sum(n_tokens)::bigint as have, sum(n_tokens)::bigint * {max_epochs} as cap from rows0 group by all having sum(n_tokens) > 0),
  one as ({one}), two as ({two}), three as ({three}),
  drawn as (select r.*, (t.take // t.have)::bigint as epochs, (t.take % t.have)::bigint as rest from rows0 r join three t using (domain, lang0, source0) where n_tokens > 0),
  hashed as (select *, md5('{seed}:' || (epochs + 1)::varchar || ':' || id0) as h from drawn),
  summed as (select *, sum(n_tokens) over (partition by domain, lang0, source0 order by h, id0, n_tokens range unbounded preceding) as upto from hashed)
  select doc_id, text, lang, source, n_chars, domain, n_tokens, unnest(range(1, (epochs + (upto <= rest)::int + 1)::bigint))::int as epoch from summed"""
