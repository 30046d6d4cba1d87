"""Row numbers within groups without putting a whole group into one task.

``row_number() OVER (PARTITION BY g ORDER BY o)`` shuffles every row of a
group to one task; a key holding a third of all rows then sorts a third of
the data alone. Here the rows are range-partitioned on (g, o) instead, so a
hot group is spread over consecutive tasks; each task counts its rows per
group (one row per task and group), a prefix over the few tasks a group
spans gives each task's starting number, and a row's number is that plus
its position inside the task. The order columns must end with a unique key
(ties are then impossible and numbering is deterministic).

The numbered rows feed two branches (the per-task counts and the rows
themselves). Range bounds come from sampling seeded per shuffle, so two
executions of the range shuffle may cut differently; the numbered rows are
therefore checkpointed once to the shared checkpoint folder (reliable, so a
lost executor does not re-cut them) and both branches read that copy.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from crawlgrid.session import ensure_checkpoint_dir


def row_number_within(df: DataFrame, group: list[str], order: list[Column | str], out: str = "rank",
                      partitions: int | None = None) -> DataFrame:
    """Add ``out`` = 1-based row number of each row inside its ``group`` by ``order``."""
    keys = [F.col(g) for g in group] + [F.col(o) if isinstance(o, str) else o for o in order]
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    s = (df.repartitionByRange(n, *keys).sortWithinPartitions(*keys)
         .withColumn("_pid", F.spark_partition_id())
         .withColumn("_mid", F.monotonically_increasing_id()))
    ensure_checkpoint_dir(df.sparkSession)
    s = s.checkpoint(eager=True)
    counts = s.groupBy("_pid", *group).agg(F.count(F.lit(1)).alias("_n"), F.min("_mid").alias("_first"))
    w = Window.partitionBy(*group).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("_before", F.coalesce(F.sum("_n").over(w), F.lit(0)))
    j = s.join(counts.select(*[F.col(c).alias(f"_c_{c}") for c in ["_pid", *group, "_first", "_before"]]),
               [s["_pid"] == F.col("_c__pid")] + [s[g].eqNullSafe(F.col(f"_c_{g}")) for g in group])
    return (j.withColumn(out, (F.col("_c__before") + F.col("_mid") - F.col("_c__first") + 1).cast("long"))
            .drop("_pid", "_mid", *[f"_c_{c}" for c in ["_pid", *group, "_first", "_before"]]))
