"""Corpus pipeline: from raw documents to tokens, stage by stage.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage
before kept; its result is written as Parquet and read again as the next one's
documents. All but the last return the columns of ``documents`` (any extra
columns, too), so stages can be left out or reordered. A row's text may be
null: it counts as empty, passes the filters as any empty text does, and stays
null; ``n_chars`` follows the text where a stage changes it.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crawlgrid.llm import bpe, chosen_path, fm_decontam, quality, suffix_refine
from crawlgrid.llm.queries import RANKS, table
from crawlgrid.llm.registry import register
from crawlgrid.session import scratch_dir

LEAST_SCORE = 0.3


def rows_with_text(docs: DataFrame) -> DataFrame:
    """The whole row in one column beside its text, so that no name can clash."""
    return docs.select(F.struct(*docs.columns).alias("_row"), F.col("text").alias("_text"))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    scored = quality.score(rows_with_text(docs), model, text_col="_text", carry=("_row",))
    return scored.where(F.col("score") >= LEAST_SCORE).select("_row.*")


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the least id stays."""
    return chosen_path.one_of_each(docs)


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings of 50 bytes that an earlier document has are cut out of the text;
    a character that loses a byte goes whole. No document is dropped."""
    rest = [c for c in docs.columns if c != "text"]
    rows = docs.select(F.col("doc_id").alias("_id"), F.col("text").alias("_text"), F.struct(*rest).alias("_row"), F.col("text").isNull().alias("_null"))
    cut = suffix_refine.dedup(rows, id_col="_id", text_col="_text", carry=("_row", "_null"), whole_characters=True)
    text = F.when(~F.col("_null"), F.col("kept").cast("string"))
    changed = F.size("spans") > 0
    cut = cut.select("_row", text.alias("_text"), changed.alias("_changed"))

    def column(c: str) -> F.Column:
        if c == "text":
            return F.col("_text").alias(c)
        if c == "n_chars":
            return F.when(F.col("_changed"), F.length("_text").cast(docs.schema[c].dataType)).otherwise(F.col("_row.n_chars")).alias(c)
        return F.col("_row").getField(c).alias(c)

    return cut.select(*map(column, docs.columns))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the benchmark contaminates (5 % of their words) go; others stay as they are."""
    found = fm_decontam.scan(rows_with_text(docs), table(spark, sf_dir, "benchmark"), text_col="_text", carry=("_row",))
    return fm_decontam.verdicts(found).where(~F.col("contaminated")).select("_row.*")


def tokenize_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, lang, source, n_tokens, token_ids, round_trip): the ids of each
    text, and whether they decode to its bytes."""
    rows = docs.select(F.struct("doc_id", "lang", "source", F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha")).alias("_row"), "text")
    got = bpe.round_trip(rows, RANKS, public_tokenizers.PATTERN, carry=("_row",))
    return got.select("_row.doc_id", "_row.lang", "_row.source", F.size("token_ids").cast("long").alias("n_tokens"), "token_ids",
                      (F.sha2("decoded", 256) == F.col("_row.sha")).alias("round_trip"))


STAGES = [
    ("quality classifier", quality_stage),
    ("n-gram Jaccard join", near_duplicate_stage),
    ("suffix-array dedup", substring_stage),
    ("benchmark decontamination", decontamination_stage),
    ("byte-level BPE", tokenize_stage),
]

# the classifier and the tokenizer can't be written in SQL; see tests/llm
ORACLE_SQL = None


@register("pipeline", ORACLE_SQL)
def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after the other, over ``documents``."""
    docs, folder = table(spark, sf_dir, "documents"), scratch_dir(spark, "pipeline")
    for k, (_, stage) in enumerate(STAGES[:-1]):
        path = f"{folder}/stage-{k}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
