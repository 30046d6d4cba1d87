"""Snowflake ids (41-bit ms since the fixed epoch, 5-bit datacenter,
5-bit worker, 12-bit sequence)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from crawlgrid.operators.ranking import row_number_within
from crawlgrid.constants import (SNOWFLAKE_DATACENTER_BITS, SNOWFLAKE_EPOCH_MS,
                                 SNOWFLAKE_SEQUENCE_BITS, SNOWFLAKE_WORKER_BITS)

SEQ = SNOWFLAKE_SEQUENCE_BITS
WORKER_SHIFT = SEQ
DC_SHIFT = SEQ + SNOWFLAKE_WORKER_BITS
TS_SHIFT = SEQ + SNOWFLAKE_WORKER_BITS + SNOWFLAKE_DATACENTER_BITS
PER_MS = 1 << SEQ
BUCKET_MS = 3_600_000      # hour buckets for the two-level spill scan


def snowflake_parts(id_col) -> Column:
    """struct(ms, ts, datacenter, worker, sequence) of an id."""
    i = F.col(id_col) if isinstance(id_col, str) else id_col
    ms = F.shiftright(i, TS_SHIFT) + F.lit(SNOWFLAKE_EPOCH_MS)
    return F.struct(
        ms.alias("ms"),
        F.timestamp_millis(ms).cast("timestamp_ntz").alias("ts"),
        F.shiftright(i, DC_SHIFT).bitwiseAND(F.lit((1 << SNOWFLAKE_DATACENTER_BITS) - 1).cast("long")).alias("datacenter"),
        F.shiftright(i, WORKER_SHIFT).bitwiseAND(F.lit((1 << SNOWFLAKE_WORKER_BITS) - 1).cast("long")).alias("worker"),
        i.bitwiseAND(F.lit(PER_MS - 1).cast("long")).alias("sequence"))


def snowflake_assign(df: DataFrame, ts_col: str, order_col: str, worker: int = 1,
                     datacenter: int = 1, out: str = "snowflake_id") -> DataFrame:
    """ids for a whole table as one generator (worker, datacenter) would
    hand them out in time order: the sequence counts rows within a ms; a ms
    holding more than 4096 rows spills into the next free ms instead of sleeping.

    The spill is a prefix computation. start(ms) = max over earlier-or-equal
    ms' of (ms' * 4096 - rows before ms') + rows before ms. It is evaluated as a
    two-level scan so no window runs over the whole table in one task: scans
    inside hour buckets (windows partitioned by bucket), then one scan over the
    per-bucket summaries (one row per hour), then both are combined.
    """
    ms = F.unix_millis(F.col(ts_col).cast("timestamp"))
    d = df.withColumn("_ms", ms)
    counts = (d.groupBy("_ms").agg(F.count(F.lit(1)).alias("_n"))
              .withColumn("_b", F.floor(F.col("_ms") / BUCKET_MS)))
    wl = Window.partitionBy("_b").orderBy("_ms").rowsBetween(Window.unboundedPreceding, 0)
    local = (counts.withColumn("_bl", F.sum("_n").over(wl) - F.col("_n"))
             .withColumn("_lmax", F.max(F.col("_ms") * PER_MS - F.col("_bl")).over(wl)))
    buckets = local.groupBy("_b").agg(F.sum("_n").alias("_nb"),
                                      F.max(F.col("_ms") * PER_MS - F.col("_bl")).alias("_mb"))
    wb = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    buckets = (buckets.withColumn("_off", F.coalesce(F.sum("_nb").over(wb), F.lit(0)))
               .withColumn("_pm", F.max(F.col("_mb") - F.col("_off")).over(wb)))
    starts = local.join(buckets.select("_b", "_off", "_pm"), "_b").select(
        "_ms", (F.greatest(F.col("_pm"), F.col("_lmax") - F.col("_off"))
                + F.col("_off") + F.col("_bl")).alias("_start"))
    # sequence inside a ms: skew-safe numbering (a ms may hold a third of all rows)
    d = row_number_within(d, ["_ms"], [order_col], out="_rn")
    slot = (F.col("_start") + F.col("_rn") - 1).cast("long")
    sid = (F.shiftleft(F.shiftright(slot, SEQ) - SNOWFLAKE_EPOCH_MS, TS_SHIFT)
           .bitwiseOR(F.lit(datacenter << DC_SHIFT).cast("long"))
           .bitwiseOR(F.lit(worker << WORKER_SHIFT).cast("long"))
           .bitwiseOR(slot.bitwiseAND(F.lit(PER_MS - 1).cast("long"))))
    return (d.join(starts, "_ms")
            .withColumn(out, sid.cast("long")).drop("_ms", "_start", "_rn"))
