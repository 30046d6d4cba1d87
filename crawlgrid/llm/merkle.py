"""Merkle manifest of a dataset: a tree a group, a tree over the groups' roots.

Sibling-shift self-joins: the nodes of a level are numbered rows (g, idx), and
every level is equijoined with itself on computed sibling indices, idx XOR 1
in a binary tree, the other slots of the run (idx - slot + 0..k-1) in wider
ones. So each node gets its siblings' digests, and the rows of slot zero, who
then know their whole run, emit the parents. No group is ever in one task:
the keys of the joins are single nodes, leaves are numbered by a range
partition, and a level is written to the shared folder before the next one
reads it (k-th of its size), so a lost executor costs a level at most.
Audit paths go the other way: from the roots down, each level joins its nodes
with their parents' paths, twice the leaves in all.

A leaf is H of the columns' values, ``-`` where null, else UTF-8 byte count,
``:`` and value; a parent is H of its run's digests (even of one), H being
lowercase hex sha256 over the concatenated text. Groups ascend by name (null
first, then bytewise), leaves within by ``order_col`` (null first); rows of
one order value ascend by digest, so repeated rows keep a leaf each and the
roots don't depend on the order of the input. Empty texts are leaves as any
others (``0:``). A group with one row has this leaf as its root; an empty
table gives no rows. Other columns are carried only when named in ``carry``;
the row travels in a struct, so their names can't clash.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crawlgrid.operators.ranking import row_number_within
from crawlgrid.session import scratch_dir

COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
SIDES = "array<struct<before:string,after:string>>"


def leaf_digest(values: Sequence[Column]) -> Column:
    """H of the values, each with its length, so that no two rows read alike."""
    def part(v: Column) -> Column:
        v = v.cast("string")
        return F.when(v.isNull(), "-").otherwise(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v))
    return F.sha2(F.concat(*map(part, values)), 256)


def proof(path: Column) -> Column:
    """H of all siblings of an audit path, from the leaf's level to the root's."""
    return F.sha2(F.array_join(F.transform(path, lambda x: F.concat(x["before"], x["after"])), ""), 256)


def fold(path: Column, leaf: Column) -> Column:
    """The root that a leaf and an audit path give."""
    return F.aggregate(path, leaf, lambda digest, x: F.sha2(F.concat(x["before"], digest, x["after"]), 256))


def with_siblings(nodes: DataFrame, fan_out: int) -> DataFrame:
    """``before`` and ``after``: the digests of each node's siblings in its run,
    joined, by one equijoin of the level with itself."""
    others = nodes.select(F.col("g").alias("_g"), F.col("idx").alias("_idx"), F.col("digest").alias("_digest"))
    if fan_out == 2:
        met = nodes.join(others, (F.col("g") == F.col("_g")) & (F.col("idx").bitwiseXOR(F.lit(1)) == F.col("_idx")), "left")
        digest, odd = F.coalesce("_digest", F.lit("")), F.col("idx") % 2 == 1
        return met.select(*nodes.columns, F.when(odd, digest).otherwise("").alias("before"), F.when(odd, "").otherwise(digest).alias("after"))
    slot = F.col("idx") % fan_out
    first = F.col("idx") - slot
    asked = nodes.withColumn("_want", F.explode(F.sequence(first, F.least(first + fan_out, F.col("n")) - 1)))
    met = asked.join(others, (F.col("g") == F.col("_g")) & (F.col("_want") == F.col("_idx")))
    # fan_out entries at most
    run = met.groupBy("g", "idx").agg(*[F.first(c).alias(c) for c in nodes.columns if c not in ("g", "idx")],
                                      F.array_sort(F.collect_list(F.struct("_want", "_digest"))).alias("_run"))
    side = lambda cond: F.array_join(F.transform(F.filter("_run", cond), lambda x: x["_digest"]), "")
    return run.select(*nodes.columns, side(lambda x: x["_want"] < F.col("idx")).alias("before"), side(lambda x: x["_want"] > F.col("idx")).alias("after"))


def grow(leaves: DataFrame, fan_out: int, folder: str) -> list[DataFrame]:
    """All levels of the trees over ``leaves`` (g, idx, n = nodes of g, digest,
    ...), each with siblings and written; a node with n = 1 is its tree's root."""
    spark, levels, nodes = leaves.sparkSession, [], leaves
    most = leaves.agg(F.max("n")).first()[0] or 0
    while True:
        path = f"{folder}/level-{len(levels)}"
        with_siblings(nodes, fan_out).write.parquet(path)
        level = spark.read.parquet(path)
        levels.append(level)
        if most <= 1:
            return levels
        most = -(-most // fan_out)
        nodes = level.where((F.col("n") > 1) & (F.col("idx") % fan_out == 0)).select(
            "g", F.expr(f"idx div {fan_out}").alias("idx"), F.expr(f"(n + {fan_out - 1}) div {fan_out}").alias("n"),
            F.sha2(F.concat("digest", "after"), 256).alias("digest"))


def roots(levels: Sequence[DataFrame]) -> DataFrame:
    """(g, level, digest) of the root of every tree."""
    out = None
    for k, level in enumerate(levels):
        top = level.where("n = 1").select("g", F.lit(k).alias("level"), "digest")
        out = top if out is None else out.unionByName(top)
    return out


def descend(levels: Sequence[DataFrame], tops: DataFrame, fan_out: int, carry: Sequence[str] = ()) -> DataFrame:
    """Audit paths of the leaves: (g, path, subroot, carry). ``tops`` has for each
    tree (g, level, path, subroot): its root's level and the path above it."""
    start = tops.select("g", F.lit(0).cast("long").alias("idx"), "path", "subroot", "level")
    above = start.where(F.col("level") == len(levels) - 1).drop("level")
    step = F.array(F.struct("before", "after"))
    for k in range(len(levels) - 2, 0, -1):
        nodes = levels[k].where("n > 1").select("g", "idx", "before", "after", F.expr(f"idx div {fan_out}").alias("_up"))
        met = nodes.join(above.withColumnRenamed("idx", "_up"), ["g", "_up"])
        above = met.select("g", "idx", F.concat(step, "path").alias("path"), "subroot").unionByName(start.where(F.col("level") == k).drop("level"))
    leaf = levels[0]
    alone = leaf.where("n = 1").join(start.where("level = 0"), ["g", "idx"]).select("g", "path", "subroot", *carry)
    if len(levels) == 1:
        return alone
    nodes = leaf.where("n > 1").withColumn("_up", F.expr(f"idx div {fan_out}"))
    met = nodes.join(above.withColumnRenamed("idx", "_up"), ["g", "_up"])
    return met.select("g", F.concat(step, "path").alias("path"), "subroot", *carry).unionByName(alone)


def manifest(rows: DataFrame, columns: Sequence[str] = COLUMNS, group_col: str = "lang", order_col: str = "doc_id",
             fan_out: int = 2, carry: Sequence[Column | str] = ("doc_id",)) -> DataFrame:
    """``carry`` columns, leaf, subroot, root and path (siblings before and after
    the node, a pair a level) of every row."""
    if fan_out < 2:
        raise ValueError("fan_out must be 2 at least")
    spark, folder = rows.sparkSession, scratch_dir(rows.sparkSession, "merkle")
    name = F.col(group_col).cast("string")
    hashed = rows.select(F.when(name.isNull(), "").otherwise(F.concat(F.lit("="), name)).alias("g"), F.col(order_col).alias("_order"),
                         leaf_digest([F.col(c) for c in columns]).alias("digest"), F.struct(*carry).alias("r"))
    hashed.write.parquet(f"{folder}/leaves")  # the texts are read once
    numbered = row_number_within(spark.read.parquet(f"{folder}/leaves"), ["g"], ["_order", "digest"], out="idx")
    numbered.select("g", (F.col("idx") - 1).alias("idx"), "digest", "r").write.parquet(f"{folder}/numbered")
    numbered = spark.read.parquet(f"{folder}/numbered")
    numbered.groupBy("g").agg(F.count("*").alias("n")).write.parquet(f"{folder}/groups")
    groups = spark.read.parquet(f"{folder}/groups")
    levels = grow(numbered.join(groups, "g").select("g", "idx", "n", "digest", "r"), fan_out, f"{folder}/trees")

    upper = row_number_within(roots(levels).withColumn("_all", F.lit("")), ["_all"], ["g"], out="idx")
    names = upper.select(F.col("_all").alias("g"), (F.col("idx") - 1).alias("idx"), F.lit(groups.count()).cast("long").alias("n"),
                         "digest", F.struct("g", "level", "digest").alias("tree"))
    above = grow(names, fan_out, f"{folder}/upper")
    top = roots(above).select("g", "level", F.lit([]).cast(SIDES).alias("path"), F.col("digest").alias("subroot"))
    descend(above, top, fan_out, ["tree"]).select(
        F.col("tree.g").alias("g"), F.col("tree.level").alias("level"), F.col("tree.digest").alias("subroot"), "path",
        F.col("subroot").alias("root")).write.parquet(f"{folder}/tops")
    tops = spark.read.parquet(f"{folder}/tops")
    root = tops.agg(F.max("root").alias("root")).select("root").scalar()
    return (descend(levels, tops, fan_out, ["digest", "r"])
            .select("r.*", F.col("digest").alias("leaf"), "subroot", root.alias("root"), "path"))
