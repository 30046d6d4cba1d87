"""Webhook item batches, payloads, form bodies, size guard; I10 page items."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from crawlgrid.constants import BAD_ITEMS_LOG, MEMORY_LIMIT_LOG, WEBHOOK_MEMORY_LIMIT
from crawlgrid.operators.aggregates import dedupe_eav
from crawlgrid.sources.files import item_object

BLOCK_LINES = 1024     # lines per block of the two-level running byte count


def batch_sizes(jobs: DataFrame, settings: DataFrame) -> DataFrame:
    """(job_id, batch_size) from the job's spider setting ``webhook_batch_size``;
    missing or not an integer → 0 (whole file in one batch)."""
    s = dedupe_eav(settings.where(F.col("setting_key") == "webhook_batch_size"), "spider_id", "setting_key")
    j = jobs.select("job_id", "spider_id").join(s, "spider_id", "left")
    size = F.coalesce(F.trim(F.col("value")).try_cast("int"), F.lit(0))
    return j.select("job_id", F.when(size > 0, size).otherwise(F.lit(0)).alias("batch_size"))


def _running_bytes(lines: DataFrame) -> DataFrame:
    """Cumulative UTF-8 bytes of raw lines within each (job, batch), in line
    order, as a two-level scan: block sums (decomposable), a prefix over the
    blocks of a batch, then a running sum inside each bounded block."""
    d = lines.withColumn("_bytes", F.octet_length("raw")).withColumn(
        "_blk", F.floor((F.col("line_no") - 1) / BLOCK_LINES))
    blocks = d.groupBy("job_id", "batch_no", "_blk").agg(F.sum("_bytes").alias("_bsum"))
    wb = Window.partitionBy("job_id", "batch_no").orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("_before", F.coalesce(F.sum("_bsum").over(wb), F.lit(0)))
    wl = Window.partitionBy("job_id", "batch_no", "_blk").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    return (d.join(blocks.select("job_id", "batch_no", "_blk", "_before"), ["job_id", "batch_no", "_blk"])
            .withColumn("cum_bytes", F.col("_before") + F.sum("_bytes").over(wl))
            .drop("_bytes", "_blk", "_before"))


def annotate_lines(items: DataFrame, sizes: DataFrame) -> DataFrame:
    """Item lines with their batch number and parsed object (NULL for a bad
    line: blank, not strict JSON, or not a JSON object)."""
    size = F.coalesce(F.col("batch_size"), F.lit(0))
    return (items.join(sizes, "job_id", "left")
            .withColumn("batch_no", F.when(size > 0, F.floor((F.col("line_no") - 1) / size)).otherwise(F.lit(0)))
            .withColumn("_item", item_object(F.col("raw"))))


def first_failures(lines: DataFrame, memory_limit: int | None) -> DataFrame:
    """Per failing job, the first failing line's (batch_no, _bad): a malformed
    line, or the line where its batch's cumulative bytes pass ``memory_limit``.

    Malformed lines are few and combine before the shuffle. Only batches whose
    *total* exceeds the limit can hold an over-limit line, so the running byte
    count (a two-level scan) touches those batches alone; when there are none,
    AQE drops that branch at run time."""
    bad = lines.where(F.col("_item").isNull()).select("job_id", "line_no", "batch_no", F.lit(True).alias("_bad"))
    if memory_limit is not None:
        heavy = (lines.groupBy("job_id", "batch_no").agg(F.sum(F.octet_length("raw")).alias("_bytes"))
                 .where(F.col("_bytes") > memory_limit).select("job_id", "batch_no"))
        over = (_running_bytes(lines.join(heavy, ["job_id", "batch_no"], "left_semi"))
                .where(F.col("cum_bytes") > memory_limit)
                .groupBy("job_id", "batch_no").agg(F.min("line_no").alias("line_no"))
                .select("job_id", "line_no", "batch_no", F.lit(False).alias("_bad")))
        bad = bad.unionByName(over)
    # earliest line first; at the same line a malformed line wins (it fails
    # before its size counts). A numeric key keeps this a hash aggregate.
    order = F.col("line_no") * 2 + F.when(F.col("_bad"), 0).otherwise(1)
    return bad.groupBy("job_id").agg(F.min_by(F.struct("batch_no", "_bad"), order).alias("_f"))


def item_batches(items: DataFrame, sizes: DataFrame, memory_limit: int | None = None) -> DataFrame:
    """I4 (+ I7): split each job's item lines into delivery batches.

    A line that is not a JSON object (blank lines included) fails the job;
    with ``memory_limit`` set, so does the line where a batch's cumulative
    bytes pass the limit. Batches wholly before the first failing line are
    delivered; the failing batch and later ones are not.

    Output per (job_id, batch_no): rows, first_line, last_line, delivered,
    job_status ('success' / 'fail') and log.
    """
    lines = annotate_lines(items, sizes)
    stats = lines.groupBy("job_id", "batch_no").agg(
        F.count(F.lit(1)).alias("rows"), F.min("line_no").alias("first_line"), F.max("line_no").alias("last_line"),
        F.min(F.when(F.col("_item").isNull(), F.col("line_no"))).alias("_bad_line"))
    if memory_limit is None:
        # the least bad line of a job's batches; all columns are kept in the
        # struct, so that both readers of the aggregate share its shuffle
        worst = F.min_by(F.struct("batch_no", F.lit(True).alias("_bad"), "rows", "first_line", "last_line"), "_bad_line")
        fail = stats.groupBy("job_id").agg(F.count("_bad_line").alias("_n"), worst.alias("_f")).where("_n > 0").drop("_n")
    else:
        fail = first_failures(lines, memory_limit)
    over_msg = F.lit(MEMORY_LIMIT_LOG % memory_limit if memory_limit is not None else "")
    return (stats.join(fail, "job_id", "left").select(
        "job_id", "batch_no", "rows", "first_line", "last_line",
        (F.col("_f").isNull() | (F.col("batch_no") < F.col("_f.batch_no"))).alias("delivered"),
        F.when(F.col("_f").isNull(), "success").otherwise("fail").alias("job_status"),
        F.when(F.col("_f").isNull(), F.lit(None))
         .when(F.col("_f._bad"), F.lit(BAD_ITEMS_LOG)).otherwise(over_msg).alias("log")))


def guarded_batches(items: DataFrame, sizes: DataFrame, memory_limit: int = WEBHOOK_MEMORY_LIMIT) -> DataFrame:
    """The batches with the size guard on."""
    return item_batches(items, sizes, memory_limit)


def delivered_rows(items: DataFrame, sizes: DataFrame, memory_limit: int | None = None) -> DataFrame:
    """(job_id, batch_no, _rows, _keys) for every delivered batch: its parsed
    rows in line order and the sorted union of their keys.

    Lines of batches that aren't delivered are dropped before they are
    collected. A batch is one POST body, so its lines make one row: as many
    as the batch size, or the whole file where none is set (I7's limit
    bounds that; it applies only when given).
    """
    lines = annotate_lines(items, sizes)
    fail = first_failures(lines, memory_limit)
    d = (lines.join(fail, "job_id", "left")
         .where(F.col("_f").isNull() | (F.col("batch_no") < F.col("_f.batch_no"))))
    # maps are not orderable, their entries are
    rows = d.groupBy("job_id", "batch_no").agg(
        F.array_sort(F.collect_list(F.struct("line_no", F.map_entries("_item").alias("entries")))).alias("_rows"))
    keys = F.array_sort(F.array_distinct(F.flatten(F.transform("_rows", lambda r: F.transform(r["entries"], lambda e: e["key"])))))
    return rows.select("job_id", "batch_no", F.transform("_rows", lambda r: F.map_from_entries(r["entries"])).alias("_rows"), keys.alias("_keys"))


def batch_payload(items: DataFrame, sizes: DataFrame, memory_limit: int | None = None) -> DataFrame:
    """For every delivered batch, each key of the union of its rows' keys
    with the values of all rows in line order ('' where a row lacks the key;
    nested values as JSON text). Keys sorted (the reference used a set)."""
    rows = delivered_rows(items, sizes, memory_limit)
    columns = F.transform("_keys", lambda k: F.struct(
        k.alias("key"), F.transform("_rows", lambda r: F.coalesce(r[k], F.lit(""))).alias("values")))
    return rows.select("job_id", "batch_no", F.inline(columns))


def form_bodies(items: DataFrame, sizes: DataFrame, memory_limit: int | None = None) -> DataFrame:
    """I6 directly from the delivered batches: ``key=v1&key=v2&...`` per key
    (sorted), percent-encoded, in one projection per batch (no regrouping)."""
    rows = delivered_rows(items, sizes, memory_limit)
    body = F.array_join(F.transform("_keys", lambda k: F.array_join(F.transform(
        "_rows", lambda r: F.concat(quote_plus(k), F.lit("="), quote_plus(F.coalesce(r[k], F.lit(""))))),
        "&")), "&")
    return rows.select("job_id", "batch_no", body.alias("body"))


def quote_plus(s: Column) -> Column:
    """Form encoding as Python's ``quote_plus`` (Java leaves '*', encodes '~')."""
    e = F.url_encode(s)
    return F.replace(F.replace(e, F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def _named_entities() -> dict[str, str]:
    """HTML's named references, as the standard library lists them."""
    from html.entities import html5

    return {name[:-1]: text for name, text in html5.items() if name.endswith(";")}


def unescape(s: Column) -> Column:
    """Character references (named, decimal, hexadecimal) as their characters;
    what is none stays."""
    names = F.from_json(F.lit(json.dumps(_named_entities())), "map<string,string>")

    def one(part: Column) -> Column:
        ref = F.regexp_extract(part, r"^(#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]*);", 1)
        code = (F.when(F.regexp_like(ref, F.lit("^#[xX]")), F.conv(F.substring(ref, 3, 8), 16, 10))
                .when(F.startswith(ref, F.lit("#")), F.substring(ref, 2, 8))).try_cast("int")
        code = F.when((code > 0) & (code <= 0x10FFFF) & ~code.between(0xD800, 0xDFFF), code)
        char = F.when(code.isNotNull(), F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")).otherwise(F.element_at(names, ref))
        return F.when(char.isNotNull(), F.concat(char, F.substr(part, F.length(ref) + 2))).otherwise(F.concat(F.lit("&"), part))

    parts = F.split(s, "&", -1)
    whole = F.concat(F.get(parts, F.lit(0)), F.array_join(F.transform(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))), one), ""))
    return F.when(F.contains(s, F.lit("&")), whole).otherwise(s)


def page_items(pages: DataFrame) -> DataFrame:
    """(url, title) per page: the text of the head's first <title> (what
    ``/html/head/title/text()`` yields), character references decoded; NULL
    without one. A <title> in the body (of a drawing, say), in a comment, a
    script or a style doesn't count."""
    hidden = r"(?is)<!--.*?(?:-->|\z)|<script\b.*?(?:</script\s*>|\z)|<style\b.*?(?:</style\s*>|\z)"
    head = F.regexp_replace(F.regexp_replace("html", hidden, ""), r"(?is)(</head\s*>|<body[\s>]).*", "")
    found = r"(?is)<title[^>]*>(.*?)</title\s*>"
    title = F.when(F.regexp_like(head, F.lit(found)), unescape(F.regexp_extract(head, found, 1)))
    return pages.select("page_id", "url", title.alias("title"))
