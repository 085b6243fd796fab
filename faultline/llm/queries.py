"""Registered queries of the operators: thin digests of their results."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline.llm import (
    alignment,
    bpe,
    html_extract,
    langid,
    licenses,
    lm_score,
    packing,
    quality,
    simhash,
    suffix_dedup,
    token_files,
    topk,
    whitening,
)
from faultline.llm.common import prepare, table

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}


def register(name: str):
    def deco(fn: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            prepare(spark)
            return fn(spark, sf_dir)
        REGISTRY[name] = run
        return run
    return deco


@register("op4_simhash")
def op4_simhash(spark, sf_dir):
    out = simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=3, max_bits=2)
    return out.select(F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
                      F.col("component").alias("component_id"))


@register("op7_bpe")
def op7_bpe(spark, sf_dir):
    path = public_tokenizers.path("byte_bpe_50k.json")
    out = bpe.decode(bpe.encode(table(spark, sf_dir, "documents"), path), path)
    return out.select(F.col("id").alias("doc_id"), (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
                      F.sha2("ids", 256).alias("ids_sha256"),
                      F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"))


@register("op9_packing")
def op9_packing(spark, sf_dir):
    out = packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return out.drop("ids")


@register("op3_quality_rules")
def op3_quality_rules(spark, sf_dir):
    q = quality.quality_rules(table(spark, sf_dir, "documents").select("doc_id", "text"))
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "line_chars",
             "lost_chars", "kept"]
    return q.select("doc_id", *[F.col("quality")[n].alias(n) for n in names])


@register("op8_licenses")
def op8_licenses(spark, sf_dir):
    out = licenses.scan(table(spark, sf_dir, "documents"))
    at, own = F.transform("places", lambda p: p["at"]), F.transform("places", lambda p: p["label"])
    return out.select(
        F.col("id").alias("doc_id"), "n_words", F.size("places").cast("long").alias("n_base"),
        F.array_min(at).alias("first_word"), F.array_max(at).alias("last_word"),
        F.array_join(F.sort_array(F.array_distinct(own)), ",").alias("base_labels"),
        F.array_join(F.sort_array(F.array_union(own, "labels")), ",").alias("labels"), "score")


@register("op10_html_extract")
def op10_html_extract(spark, sf_dir):
    return html_extract.extract(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


@register("op5_topk")
def op5_topk(spark, sf_dir):
    out = topk.search(table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0, k=5)
    return out.withColumnRenamed("id", "vec_id")


@register("op6_language_id")
def op6_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    v = F.col("language_id")
    return langid.identify(docs).select(
        "doc_id", v["language"].alias("language"), v["best"].alias("best"), v["posterior"].alias("posterior"),
        v["text_best"].alias("text_best"), v["n_trigrams"].alias("n_trigrams"), v["accepted"].alias("accepted"))


@register("op6_page_language_id")
def op6_page_language_id(spark, sf_dir):
    """The pages by all evidences: their text, markup language, host and address suffix."""
    v = F.col("language_id")
    return langid.identify_pages(table(spark, sf_dir, "pages").select("page_id", "url", "html")).select(
        "page_id", "url", F.lit("page").alias("kind"), "declared", "host", "suffix", v["language"].alias("language"), v["best"].alias("best"),
        v["posterior"].alias("posterior"), v["text_best"].alias("text_best"), v["n_trigrams"].alias("n_trigrams"), v["accepted"].alias("accepted"))


@register("op2_suffix_dedup")
def op2_suffix_dedup(spark, sf_dir):
    out = suffix_dedup.deduplicate(table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


@register("op1_lm_score")
def op1_lm_score(spark, sf_dir):
    return lm_score.score(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


@register("op11_token_files")
def op11_token_files(spark, sf_dir):
    out = token_files.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=2)
    return out.select("doc_id", "start", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
                      F.crc32("ids").alias("ids_crc32"))


@register("op12_whitening")
def op12_whitening(spark, sf_dir):
    out = whitening.whiten(table(spark, sf_dir, "embeddings"), k=4, scale=256)
    both = F.arrays_zip("whitened", "explained")
    return out.select("id", "n", "deviation", "identity_error", F.posexplode(both).alias("at", "c")).select(
        F.col("id").alias("vec_id"), (F.col("at") + 1).cast("int").alias("component"), "n", "deviation",
        F.col("c.whitened").alias("whitened"), F.col("c.explained").alias("explained"), "identity_error")


@register("op13_alignment")
def op13_alignment(spark, sf_dir):
    out = alignment.align(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"),
                          public_tokenizers.path("piece_bpe_32k.model"))
    return out.withColumn("groups_sha256", F.coalesce(F.lower(F.hex("groups")), F.lit(""))).drop("groups")
