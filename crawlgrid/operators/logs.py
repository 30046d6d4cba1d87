"""Facts from job logs, final status, charset of log files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crawlgrid.constants import ERROR_PATTERN, ITEMS_PATTERN, WARNING_PATTERN

# charsets tried in order
DEFAULT_CHARSETS = ("UTF-8", "ISO-8859-1")
# what a text doesn't hold: control characters but tab, line ends, form feed and escape
_CONTROL = r"[\x00-\x08\x0E-\x1A\x1C-\x1F\x7F-\x9F]"


def log_facts(logs: DataFrame) -> DataFrame:
    """Per job, the first match (in line order) of the scraped-items,
    ERROR-count and WARNING-count statistics. The patterns hold no newline,
    so matching line by line is exact; ``min_by`` over matching lines is a
    decomposable aggregate (no sort of a job's lines)."""
    def first(pattern: str) -> Column:
        hit = F.regexp_like(F.col("line"), F.lit(pattern))
        val = F.regexp_extract("line", pattern, 1).try_cast("long")
        return F.min_by(F.when(hit, val), F.when(hit, F.col("line_no")))
    return logs.groupBy("job_id").agg(
        first(ITEMS_PATTERN).alias("items_count"),
        first(ERROR_PATTERN).alias("errors"),
        first(WARNING_PATTERN).alias("warnings"))


def final_status(reported: Column, errors: Column, warnings: Column) -> Column:
    """A reported success turns into fail when the log has an ERROR
    count line (even 0), else into warning when it has a WARNING count line.
    Reports other than success (2) / fail (3) are invalid (NULL)."""
    return (F.when(~reported.isin(2, 3), F.lit(None).cast("int"))
            .when((reported == 2) & errors.isNotNull(), F.lit(3))
            .when((reported == 2) & warnings.isNotNull(), F.lit(4))
            .otherwise(reported))


def fits(content: Column, charset: str) -> Column:
    """Whether bytes can be text of a charset. Every byte is a character of
    ISO-8859-1, so there the control characters tell text from other bytes."""
    if charset == "UTF-8":
        return F.is_valid_utf8(content.cast("string"))
    if charset == "US-ASCII":
        return F.is_valid_utf8(content.cast("string")) & (F.octet_length(content) == F.char_length(content.cast("string")))
    if charset == "ISO-8859-1":
        return ~F.regexp_like(F.decode(content, "ISO-8859-1"), F.lit(_CONTROL))
    raise ValueError(f"charset {charset} can't be checked without an error on other bytes; known: UTF-8, US-ASCII, ISO-8859-1")


def choose_charset(content: Column, charsets: Sequence[str]) -> Column:
    """The first charset that fits; NULL if none does."""
    return F.coalesce(*[F.when(fits(content, c), F.lit(c)) for c in charsets])


def decoded(content: Column, charset: Column, charsets: Sequence[str]) -> Column:
    """The text of bytes in the chosen charset; NULL without one. A single
    charset given is taken as it is, malformed bytes replaced."""
    if tuple(charsets) == ("UTF-8",):
        return F.make_valid_utf8(content.cast("string"))
    text = F.when(F.lit(False), F.lit(None).cast("string"))
    for c in charsets:
        text = text.when(charset == c, content.cast("string") if c in ("UTF-8", "US-ASCII") else F.decode(content, c))
    return text


def decode_logs(blobs: DataFrame, content_col: str = "content",
                charsets: Sequence[str] | None = None) -> DataFrame:
    """Choose each log's charset, the first listed one that fits its bytes;
    none fits → NULL text (no facts, the job still finishes). Native
    expressions, no per-row detector library."""
    cs = charsets or DEFAULT_CHARSETS
    out = blobs.withColumn("charset", choose_charset(F.col(content_col), cs))
    return out.withColumn("text", decoded(F.col(content_col), F.col("charset"), cs))
