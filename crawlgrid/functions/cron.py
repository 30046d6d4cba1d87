"""F1 cron_valid and F2 cron_fires, as native Spark expressions.

A pattern is five fields split on single spaces: minute hour day month
day_of_week. Field grammar (comma lists of): ``*``, ``*/n``, ``a``, ``a-b``,
``a-b/n``, ``a/n`` (a to the field maximum), month names ``jan``-``dec`` and
weekday names ``mon``-``sun`` (also as ranges), and ``last`` (last day of the
month) in the day field. Weekday 0 is Monday. A time fires when *all* fields
match (no day-or-weekday rule), at second 0.

The ``xth weekday`` day form contains a space, so a five-part pattern split on
single spaces can never carry it; it is not accepted here either.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crawlgrid.constants import CRON_FIELDS, CRON_RANGES, MONTH_NAMES, WEEKDAY_NAMES


def _int(c: Column) -> Column:
    return c.try_cast("long")


def cron_parts(pattern: Column) -> Column:
    return F.split(pattern, " ", -1)


# --- relational parse: one element expression, column-valued field bounds ---
def _field_table(spark) -> DataFrame:
    """The five cron fields with their bounds and names (a fixed 5-row table)."""
    rows = []
    for i, name in enumerate(CRON_FIELDS):
        lo, hi = CRON_RANGES[name]
        names = MONTH_NAMES if name == "month" else WEEKDAY_NAMES if name == "day_of_week" else []
        off = 0 if name == "month" else -1
        rows.append((i, lo, hi, names, off, name == "day"))
    return F.broadcast(spark.createDataFrame(
        rows, "_fidx int, _lo int, _hi int, _names array<string>, _off int, _is_day boolean"))


def _element_cols(e: Column):
    """(valid, values) of one element, field bounds taken from the joined
    field table (_lo, _hi, _names, _off, _is_day)."""
    lo, hi, names, off = F.col("_lo"), F.col("_hi"), F.col("_names"), F.col("_off")
    le = F.lower(e)
    is_all = F.regexp_like(e, F.lit(r"^\*(/\d+)?$"))
    all_step = _int(F.nullif(F.regexp_extract(e, r"^\*/(\d+)$", 1), F.lit("")))
    all_ok = is_all & (all_step.isNull() | ((all_step > 0) & (all_step <= hi - lo)))
    is_rng = F.regexp_like(e, F.lit(r"^\d+(-\d+)?(/\d+)?$"))
    first = _int(F.regexp_extract(e, r"^(\d+)", 1))
    last_s = F.regexp_extract(e, r"^\d+-(\d+)", 1)
    step_s = F.regexp_extract(e, r"/(\d+)$", 1)
    step = _int(F.nullif(step_s, F.lit("")))
    last = F.when(last_s != "", _int(last_s)).when(step_s == "", first)
    span_top = F.when(last.isNull() | (last == 0), hi).otherwise(last)
    rng_ok = (is_rng & first.isNotNull() & (first >= lo)
              & (last.isNull() | ((last <= hi) & (first <= last)))
              & (step.isNull() | ((step > 0) & (step <= span_top - first))))
    is_name = (F.size(names) > 0) & F.regexp_like(le, F.lit(r"^[a-z]+(-[a-z]+)?$"))
    n1 = F.array_position(names, F.regexp_extract(le, r"^([a-z]+)", 1))
    n2s = F.regexp_extract(le, r"^[a-z]+-([a-z]+)$", 1)
    n2 = F.when(n2s == "", n1).otherwise(F.array_position(names, n2s))
    name_ok = is_name & (n1 > 0) & (n2 > 0) & (n1 <= n2)
    last_ok = F.col("_is_day") & (le == "last")
    valid = all_ok | rng_ok | name_ok | last_ok
    values = (F.when(all_ok, F.sequence(lo, hi, F.coalesce(all_step, F.lit(1)).cast("int")))
              .when(rng_ok, F.sequence(first.cast("int"), F.coalesce(last, hi).cast("int"),
                                       F.coalesce(step, F.lit(1)).cast("int")))
              .when(name_ok, F.sequence((n1 + off).cast("int"), (n2 + off).cast("int")))
              .otherwise(F.array().cast("array<int>")))
    return F.coalesce(valid, F.lit(False)), values, last_ok


def parse_patterns(patterns: DataFrame, pattern_col: str = "cron_pattern") -> DataFrame:
    """(pattern, valid, spec) for each distinct pattern: fields and comma
    elements exploded to rows, one element expression evaluated against the
    field table, then folded back per pattern. Work and compiled code stay
    small no matter how many triggers share a pattern."""
    p = patterns.select(F.col(pattern_col).alias("_pattern")).distinct()
    parts = p.select("_pattern", F.size(cron_parts(F.col("_pattern"))).alias("_n"),
                     F.posexplode(cron_parts(F.col("_pattern"))).alias("_fidx", "_fexpr"))
    elems = (parts.where(F.col("_fidx") < 5)
             .select("_pattern", "_n", "_fidx", F.explode(F.split("_fexpr", ",", -1)).alias("_e"))
             .join(_field_table(patterns.sparkSession), "_fidx"))
    valid, values, last = _element_cols(F.col("_e"))
    per_field = (elems.select("_pattern", "_n", "_fidx", valid.alias("_v"), values.alias("_vals"), last.alias("_last"))
                 .groupBy("_pattern", "_n", "_fidx")
                 .agg(F.bool_and("_v").alias("_v"), F.array_distinct(F.flatten(F.collect_list("_vals"))).alias("_vals"),
                      F.bool_or("_last").alias("_last")))
    pick = {name: F.max(F.when(F.col("_fidx") == i, F.col("_vals"))).alias(name) for i, name in enumerate(CRON_FIELDS)}
    per_pattern = per_field.groupBy("_pattern", "_n").agg(
        F.bool_and("_v").alias("_allv"), F.count(F.lit(1)).alias("_nf"), *pick.values(),
        F.bool_or(F.when(F.col("_fidx") == 2, F.col("_last"))).alias("day_last"))
    return per_pattern.select(
        F.col("_pattern").alias(pattern_col),
        ((F.col("_n") == 5) & (F.col("_nf") == 5) & F.col("_allv")).alias("valid"),
        F.struct(*[F.col(n).alias(n) for n in CRON_FIELDS], F.coalesce("day_last", F.lit(False)).alias("day_last"))
        .alias("_spec"))


def valid_patterns(df: DataFrame, pattern_col: str, out: str = "valid") -> DataFrame:
    """``df`` with a column telling whether its pattern is valid (F1), via the
    relational parse of the distinct patterns."""
    v = parse_patterns(df, pattern_col).select(F.col(pattern_col).alias("_vp"), F.col("valid").alias(out))
    return df.join(v, df[pattern_col].eqNullSafe(v["_vp"]), "left").drop("_vp").withColumn(
        out, F.coalesce(F.col(out), F.lit(False)))


def pattern_fires(patterns: DataFrame, start: str, end: str, pattern_col: str = "cron_pattern") -> DataFrame:
    """Fire times in [start, end) of each valid pattern: explode the window's
    days, keep days whose month, weekday and day-of-month match, then
    explode hours × minutes of the surviving days."""
    s = F.lit(start).cast("timestamp_ntz")
    e = F.lit(end).cast("timestamp_ntz")
    t = parse_patterns(patterns, pattern_col).where("valid")
    days = t.withColumn("_day", F.explode(F.sequence(F.to_date(s), F.to_date(e), F.expr("INTERVAL 1 DAY"))))
    d = F.col("_day")
    keep = (F.array_contains("_spec.month", F.month(d))
            & F.array_contains("_spec.day_of_week", F.weekday(d))
            & (F.array_contains("_spec.day", F.dayofmonth(d))
               | (F.col("_spec.day_last") & (d == F.last_day(d)))))
    hours = days.where(keep).withColumn("_h", F.explode("_spec.hour"))
    mins = hours.withColumn("_m", F.explode("_spec.minute"))
    fire = F.timestamp_add("MINUTE", F.col("_h") * 60 + F.col("_m"), d.cast("timestamp_ntz"))
    return (mins.select(pattern_col, fire.alias("fire_time"))
            .where((F.col("fire_time") >= s) & (F.col("fire_time") < e)))


def cron_fires(triggers: DataFrame, start: str, end: str, pattern_col: str = "cron_pattern", patterns: DataFrame | None = None) -> DataFrame:
    """every fire time in [start, end) of every valid trigger.

    Fires depend only on the pattern text, so each *distinct* pattern is
    parsed and expanded once (#patterns × #days + fires) and triggers are
    equi-joined back on the pattern; never triggers × all minutes. A pattern
    shared by very many triggers is a skewed join key, which AQE splits.
    ``patterns`` may name a plainer table that has all the triggers' patterns.
    """
    return triggers.join(pattern_fires(triggers if patterns is None else patterns, start, end, pattern_col), pattern_col)
