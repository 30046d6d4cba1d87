"""Connected components of a link table: alternating large and small stars.

Each round is two grouped minima and two joins over the links, until every
node is linked to a root alone. A hub's links are spread by adaptive skew
handling of the joins and by partial minima. What a round makes is cut off
with reliable checkpoints.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crawlgrid.session import ensure_checkpoint_dir

MAX_ROUNDS = 100
ROWS_PER_FILE = 50_000


def saved(df: DataFrame, rows: int | None = None) -> DataFrame:
    """A reliable checkpoint; of few rows (when known) in few files."""
    ensure_checkpoint_dir(df.sparkSession)
    if rows is not None:
        df = df.coalesce(max(1, min(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), rows // ROWS_PER_FILE + 1)))
    return df.checkpoint()


def _star(links: DataFrame, rows: int) -> DataFrame:
    """Each node's least neighbour; saved, so that the join with the links has
    a shuffle on both sides and a hub's links can be split."""
    return saved(links.groupBy("u").agg(F.min("v").alias("m")), rows)


def _settled(links: DataFrame) -> bool:
    """Whether every node has one link only and no root is linked further."""
    ends = (links.select(F.col("u").alias("node"), F.lit(1).alias("down"), F.lit(0).alias("up"))
            .unionByName(links.select(F.col("v").alias("node"), F.lit(0).alias("down"), F.lit(1).alias("up"))))
    ends = ends.groupBy("node").agg(F.sum("down").alias("down"), F.max("up").alias("up"))
    return ends.where("down > 1 or down + up > 1").isEmpty()


def components(links: DataFrame) -> DataFrame:
    """(u, v) links of any orderable type -> (node, root): the least node
    reachable, for every node that is not itself the least."""
    links = saved(links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    rows = links.count()
    for _ in range(MAX_ROUNDS):
        if _settled(links):
            return links.select(F.col("u").alias("node"), F.col("v").alias("root"))
        # large star: a node's larger neighbours go to its least neighbour (or itself)
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = _star(both, rows).select("u", F.least("u", "m").alias("m"))
        large = saved(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), rows)
        # small star: a node and its smaller neighbours go to the least of them
        least = _star(large, rows)
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        links = saved(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), rows)
    raise RuntimeError(f"components not settled after {MAX_ROUNDS} rounds")


def local_roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For n places and links a-b, the least place reachable from each."""
    root = np.arange(n)
    while len(a):
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        if (new == root).all():
            break
        root = new
    while (root[root] != root).any():
        root = root[root]
    return root
