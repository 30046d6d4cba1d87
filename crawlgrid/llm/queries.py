"""One query for each operator: production parameters over whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crawlgrid.session import scratch_dir

from . import (bpe, chosen_path, ctw, fm_decontam, license_scan, merkle, quality, resample, secret_grammar, subspace_join, substring_doubling,
               suffix_refine, warc)
from . import oracles as sql
from .registry import register

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def sha(col) -> F.Column:
    return F.sha2(col, 256)


@register("op2_decontamination", sql.OP2)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fm_decontam.scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    names = F.array_sort(F.col("item_ids").cast("array<string>"))
    return fm_decontam.verdicts(found).select(
        "doc_id", "n_words", "n_hit", "n_items", sha(F.concat_ws(",", names)).alias("items_sha256"), "contaminated")


@register("op3_byte_bpe")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.round_trip(docs, RANKS, public_tokenizers.PATTERN).select(
        "doc_id", F.size("token_ids").cast("long").alias("n_tokens"),
        sha(F.concat_ws(" ", F.col("token_ids").cast("array<string>"))).alias("ids_sha256"), sha(F.col("decoded")).alias("decoded_sha256"))


@register("op9_quality_classifier")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    held = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 5 == 0
    return quality.score(docs, model).select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


@register("op5_warc", sql.OP5)
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), F.col("url").alias("uri"), F.encode("html", "UTF-8").alias("payload"))
    manifest = warc.write(warc.with_types(pages), scratch_dir(spark, "warc"))
    page = lambda c: F.regexp_extract(c, r"(-?\d+)$", 1).try_cast("long")
    return warc.read(spark, manifest).select(
        page("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", page("refers_to").alias("refers_to"))


@register("op10_suffix_array_dedup")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = suffix_refine.dedup(table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return got.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), sha(F.col("kept")).alias("kept_sha256"))


@register("op7_substring_dedup", sql.OP7)
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = substring_doubling.dedup(table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return got.select("doc_id", "n_words", removed.alias("n_removed"), sha(F.col("kept")).alias("kept_sha256"))


@register("op1_context_tree_weighting")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = ctw.score(table(spark, sf_dir, "documents"))
    return got.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte")


@register("op8_ngram_jaccard_join", sql.OP8)
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = chosen_path.join(table(spark, sf_dir, "documents"))
    return got.select("doc_id", "class_id", "copies", "n_links", "component_id", (F.col("doc_id") == F.col("component_id")).alias("kept"))


@register("op4_embedding_near_dedup", sql.OP4)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = subspace_join.join(table(spark, sf_dir, "embeddings"))
    return got.select("vec_id", "n_links", "component_id", (F.col("vec_id") == F.col("component_id")).alias("kept"))


@register("op6_license_scan")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"))


@register("op11_merkle_manifest", sql.OP11)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    changed = [F.col("n_chars").cast("decimal(38,0)") + 1 if c == "n_chars" else F.col(c) for c in merkle.COLUMNS]
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 7 == 0, merkle.leaf_digest(changed))
    got = merkle.manifest(docs, carry=("doc_id", tampered.alias("tampered")))
    folded = merkle.fold(F.col("path"), F.coalesce("tampered", "leaf"))
    return (got.select("doc_id", "leaf", "subroot", "root", merkle.proof(F.col("path")).alias("proof_sha256"), folded.alias("folded_root"))
            .withColumn("verified", F.col("folded_root") == F.col("root")))


@register("op12_importance_resampling", sql.OP12)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = resample.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return got.select("doc_id", "n_features", "weight", "score", "rank")


@register("op13_secret_scan")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    got = secret_grammar.scan(docs, secret_grammar.fit(docs))
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["kind"].isin(*secret_grammar.KINDS))
    return got.select("doc_id", *map(count, secret_grammar.KINDS), sha(joined(base)).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
