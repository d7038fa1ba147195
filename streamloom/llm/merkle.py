"""A Merkle manifest of a table: one tree for each value of a column, and a tree of their roots over these.

A leaf is the hash of a row's columns. Rows get their places in their tree from one range-partitioned sort: places within
a partition are counted by its tasks, and offsets are sums over (tree, partition), so no window ever holds a tree.
Bottom-up, ARITY consecutive nodes become their parent; every level is written as a table with one row for a run and its
children. Top-down, the children of a level meet their parents' proofs, and each puts its siblings before what the parent
inherited: the root passes an empty proof, the bottom level has whole ones. Each level is one equi-join by (tree, run), so
a tree with a third of all rows is spread like any other; all levels together hold half as many runs as there are rows.

A proof is a list of steps (before, after): the siblings' digests on either side of the path. `fold` recomputes the root.

Defined cases: null values are `-`, others are told apart from it by their length; rows without a tree (null) make a tree
that comes first; rows that tie are ordered by their leaves, equal leaves take neighbouring places in any order; a tree of
one row is its leaf; an empty table has no rows. Columns that are not named are not read, whatever they are called.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialise

ARITY = 3
#: The columns of documents that a leaf covers, in order.
DOCUMENT = ("doc_id", "source", "lang", "n_chars", "text")


def field(value: Column) -> Column:
    """A value with its length before it, `-` for null."""
    text = value.cast("string")
    return F.when(text.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(values: Sequence[Column]) -> Column:
    """Lowercase hex SHA-256 of the values of a row."""
    return F.sha2(F.concat(*(field(v) for v in values)), 256)


def placed(spark: SparkSession, rows: DataFrame, order: Sequence[str]) -> DataFrame:
    """rows with idx (place in its tree, from 0) and n (rows of the tree), by order; tree is not null."""
    ordered = rows.repartitionByRange("tree", *order).sortWithinPartitions("tree", *order)
    ordered = materialise(spark, ordered.select("*", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at")), "ordered")
    parts = ordered.groupBy("tree", "part").agg(F.min("at").alias("first"), F.count("*").alias("rows"))
    by = Window.partitionBy("tree")
    parts = parts.select("tree", "part", "first", (F.sum("rows").over(by.orderBy("part")) - F.col("rows")).alias("offset"), F.sum("rows").over(by).alias("n"))
    return ordered.join(parts, ["tree", "part"]).withColumn("idx", F.col("at") - F.col("first") + F.col("offset")).drop("part", "at", "first", "offset")


def runs_of(nodes: DataFrame) -> DataFrame:
    """The runs of a level: tree, run, n (nodes of the level in the tree), kids in order, and the hash of the parent."""
    kid = F.struct("idx", "hash", *(c for c in nodes.columns if c == "item"))
    runs = nodes.filter("n > 1").groupBy("tree", "n", F.expr(f"idx div {ARITY}").alias("run")).agg(F.sort_array(F.collect_list(kid)).alias("kids"))
    return runs.withColumn("hash", F.sha2(F.array_join("kids.hash", ""), 256))


def build(spark: SparkSession, nodes: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """The levels of all trees of nodes (tree, idx, n, hash, item), bottom-up, and their roots (tree, hash, height)."""
    most = nodes.agg(F.max("n")).first()[0] or 0
    roots = nodes.filter("n = 1").select("tree", "hash", F.lit(0).alias("height"))
    levels: list[DataFrame] = []
    while most > 1:
        runs = materialise(spark, runs_of(nodes), "level")
        levels.append(runs)
        roots = roots.union(runs.filter(f"n <= {ARITY}").select("tree", "hash", F.lit(len(levels)).alias("height")))
        nodes = runs.select("tree", F.col("run").alias("idx"), F.expr(f"(n + {ARITY - 1}) div {ARITY}").alias("n"), "hash")
        most = -(-most // ARITY)
    return levels, materialise(spark, roots, "roots")


def push(spark: SparkSession, nodes: DataFrame, levels: list[DataFrame], top: DataFrame) -> DataFrame:
    """item, steps, roots of every node: top has tree, height, and the steps and roots that the root of each tree inherits."""
    start = lambda h: top.filter(F.col("height") == h).select("tree", F.lit(0).cast("long").alias("idx"), "steps", "roots")
    above = None
    for height in range(len(levels), 0, -1):
        parents = start(height) if above is None else above.union(start(height))
        runs = levels[height - 1].select("tree", F.col("run").alias("idx"), "kids")
        met = runs.join(parents, ["tree", "idx"]).select("tree", "kids", F.posexplode("kids").alias("pos", "kid"), "steps", "roots")
        side = lambda a, n: F.array_join(F.slice("kids.hash", a, n), "")
        step = F.struct(side(F.lit(1), F.col("pos")).alias("before"), side(F.col("pos") + 2, F.lit(ARITY)).alias("after"))
        met = met.select("tree", "kid.*", F.concat(F.array(step), "steps").alias("steps"), "roots")
        if height > 1:
            above = materialise(spark, met.drop("hash"), "proofs")
        else:
            above = met
    lone = nodes.filter("n = 1").join(start(0).drop("idx"), "tree").select("item", "steps", "roots")
    return lone if above is None else above.select("item", "steps", "roots").union(lone)


def manifest(spark: SparkSession, rows: DataFrame, columns: Sequence[str], tree: str, order: str, **carry: Column) -> DataFrame:
    """order (the column), leaf, roots (of its own tree, then of all), steps (the proof), and what carry computes from the row: a row for each row."""
    own = [F.coalesce(F.concat(F.lit("="), F.col(tree).cast("string")), F.lit("")).alias("tree"), F.col(order).alias("key"), leaf([F.col(c) for c in columns]).alias("hash")]
    leaves = materialise(spark, rows.select(*own, F.struct(F.col(order), *(v.alias(k) for k, v in carry.items())).alias("item")), "leaves")
    nodes = materialise(spark, placed(spark, leaves, ["key", "hash"]).select("tree", "idx", "n", "hash", F.struct("item", "hash").alias("item")), "places")
    levels, roots = build(spark, nodes)
    # The tree above has one leaf for each root, in the order of the trees.
    tops = placed(spark, roots.select(F.lit("").alias("tree"), F.col("tree").alias("name"), "hash", "height"), ["name"])
    tops = materialise(spark, tops.select("tree", "idx", "n", "hash", F.struct("name", "hash", "height").alias("item")), "tops")
    upper, summit = build(spark, tops)
    step = "array<struct<before:string,after:string>>"
    proofs = push(spark, tops, upper, summit.select("tree", "height", F.array().cast(step).alias("steps"), F.array("hash").alias("roots")))
    top = proofs.select(F.col("item.name").alias("tree"), F.col("item.height").alias("height"), "steps", F.concat(F.array("item.hash"), "roots").alias("roots"))
    whole = push(spark, nodes, levels, materialise(spark, top, "tops"))
    return whole.select("item.item.*", F.col("item.hash").alias("leaf"), "roots", "steps")


def fold(start: Column, steps: Column) -> Column:
    """The root that a leaf and its proof lead to."""
    return F.aggregate(steps, start, lambda at, s: F.sha2(F.concat(s["before"], at, s["after"]), 256))


def proof_digest(steps: Column) -> Column:
    return F.sha2(F.array_join(F.transform(steps, lambda s: F.concat(s["before"], s["after"])), ""), 256)


def tampered_leaf() -> Column:
    """The leaf of a document without its newlines, where 2 divides crc32 of its id and that changes it; else null."""
    text = F.when(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, F.replace("text", F.lit("\n"), F.lit("")))
    changed = leaf([text if c == "text" else F.col(c) for c in DOCUMENT])
    return F.when(F.length(text) < F.length("text"), changed)


def verify_documents(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root (from the tampered leaf, if there is one), verified."""
    found = manifest(spark, docs, DOCUMENT, "source", "doc_id", tampered=tampered_leaf())
    out = found.select(
        "doc_id", "leaf", F.col("roots")[0].alias("subroot"), F.col("roots")[1].alias("root"), proof_digest(F.col("steps")).alias("proof_sha256"),
        fold(F.coalesce("tampered", "leaf"), F.col("steps")).alias("folded_root"),
    )
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def _levels(prefix: str, depth: int) -> str:
    """DuckDB: the levels of all trees of {prefix}0 (tree, idx, n, h); a finished tree keeps its root."""
    return "".join(
        f", {prefix}{k + 1} as (select tree, idx // {ARITY} as idx, (n + {ARITY - 1}) // {ARITY} as n, case when n = 1 then any_value(h) else sha256(string_agg(h, '' order by idx)) end as h from {prefix}{k} group by tree, idx // {ARITY}, n)\n"
        for k in range(depth)
    )


def oracle(depth: int = 14, upper: int = 6) -> str:
    """DuckDB SQL of verify_documents, for trees of up to 3^depth rows and 3^upper sources."""
    value = lambda c: f"case when {c} is null then '-' else octet_length(encode(({c})::varchar))::varchar || ':' || ({c})::varchar end"
    row = lambda text: f"sha256({' || '.join(value(text if c == 'text' else c) for c in DOCUMENT)})"
    bits = "list_reduce(list_prepend(4294967295::bigint, list_transform(range(octet_length(encode(d))), lambda i: ascii(substr(d, i + 1, 1))::bigint)), lambda c, x: list_reduce(list_prepend(xor(c, x), range(8)), lambda v, _: case when v % 2 = 1 then xor(v // 2, 3988292384) else v // 2 end))"
    climb, source = "", "w0"
    for side, depth_of in (("l", depth), ("u", upper)):
        for k in range(depth_of):
            tree = "w.tree" if side == "l" else "''"
            climb += (
                f", {source}_{side}{k} as (select w.* replace (w.i // {ARITY} as i, case when s.n > 1 then sha256(s.before || w.folded || s.after) else w.folded end as folded, case when s.n > 1 then w.proof || s.before || s.after else w.proof end as proof)"
                f" from {source} w join p_{side}{k} s on s.tree = {tree} and s.idx = w.i)\n"
            )
            source = f"{source}_{side}{k}"
        if side == "l":
            climb += f", top as (select w.* replace (s.idx as i) from {source} w join u0 s on s.name = w.tree)\n"
            source = "top"
    sides = "".join(
        f", p_{side}{k} as (select tree, idx, n, coalesce(string_agg(h, '') over (run order by idx rows between unbounded preceding and 1 preceding), '') as before, coalesce(string_agg(h, '') over (run order by idx rows between 1 following and unbounded following), '') as after from {side}{k} window run as (partition by tree, idx // {ARITY}))\n"
        for side, depth_of in (("l", depth), ("u", upper))
        for k in range(depth_of)
    )
    return f"""
with crc as (select d, xor({bits}, 4294967295) as c from (select distinct doc_id::varchar as d from documents where doc_id is not null)),
  rows as (select doc_id, coalesce('=' || source, '') as tree, {row("text")} as h, case when c % 2 = 0 then {row("replace(text, chr(10), '')")} end as other from documents left join crc on d = doc_id::varchar),
  own as (select *, row_number() over (partition by tree order by doc_id nulls first, h) - 1 as idx, count(*) over (partition by tree) as n from rows),
  l0 as (select tree, idx, n, h from own)
  {_levels("l", depth)}
  , u0 as (select '' as tree, tree as name, row_number() over (order by encode(tree)) - 1 as idx, count(*) over () as n, h from l{depth})
  {_levels("u", upper)}
  {sides}
  , w0 as (select doc_id, tree, idx as i, h as leaf, coalesce(other, h) as folded, '' as proof from own)
  {climb}
select w.doc_id, leaf, s.h as subroot, r.h as root, sha256(proof) as proof_sha256, folded as folded_root, folded = r.h as verified from {source} w join l{depth} s on s.tree = w.tree cross join u{upper} r
"""
