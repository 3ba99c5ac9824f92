"""Queries of the numbered operators over the driver's tables, with production parameters and whole tables."""

from __future__ import annotations

import zlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from threadlens.llm import (
    bestfit_packing,
    byte_bpe,
    hard_negatives,
    html_blocks,
    language_mixture,
    logbilinear_lm,
    periodic_runs,
    quality_divergence,
    secret_crf,
    simhash_balls,
    slot_sharding,
    topk_search,
    tree_bpe,
)
from threadlens.llm.common import remainder, table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(function):
    QUERIES[function.__name__] = function
    return function


@query
def op1_topk_search(spark: SparkSession, folder: str) -> DataFrame:
    return topk_search.search(table(spark, folder, "embeddings"))


@query
def op2_secret_crf(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return secret_crf.scan(docs, secret_crf.train(docs))


@query
def op3_language_mixture(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    model = language_mixture.train(docs.where(remainder("doc_id", 4) != 2))
    return language_mixture.identify(docs, model, extra={"held_out": remainder("doc_id", 4) == 2})


@query
def op4_bestfit_packing(spark: SparkSession, folder: str) -> DataFrame:
    return bestfit_packing.pack(table(spark, folder, "documents"))


@query
def op5_slot_sharding(spark: SparkSession, folder: str) -> DataFrame:
    return slot_sharding.shard(table(spark, folder, "documents"))


@query
def op6_html_blocks(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "pages")
    return html_blocks.extract(pages, html_blocks.train(pages))


@query
def op7_byte_bpe(spark: SparkSession, folder: str, json_path: str | None = None, ranks_path: str | None = None) -> DataFrame:
    import public_tokenizers

    vocabulary = byte_bpe.load_vocabulary(json_path or public_tokenizers.path("byte_bpe_50k.json"), ranks_path or public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return byte_bpe.digests(table(spark, folder, "documents"), vocabulary)


@query
def op8_simhash_balls(spark: SparkSession, folder: str) -> DataFrame:
    return simhash_balls.near_duplicates(table(spark, folder, "documents"))


@query
def op9_logbilinear_lm(spark: SparkSession, folder: str) -> DataFrame:
    return logbilinear_lm.score(table(spark, folder, "documents"), remainder("doc_id", 7) == 2)


@query
def op10_quality_divergence(spark: SparkSession, folder: str) -> DataFrame:
    return quality_divergence.quality(table(spark, folder, "documents"))


def planted(words: list[bytes], key: int | None) -> list[bytes]:
    """A tenth of the documents repeats a stretch of its words to the end, as the key's checksum says (null: of no text)."""
    checksum = zlib.crc32(b"" if key is None else str(key).encode())
    if not words or checksum % 10:
        return words
    seed = checksum // 10
    start = seed % len(words)
    period = 1 + (len(words) - start) // (3 + seed % 8)
    copy = words[start : start + period]
    return words[:start] + (copy * (-(-(len(words) - start) // period)))[: len(words) - start]


@query
def op11_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    found = periodic_runs.find(table(spark, folder, "documents"), rewrite=planted)
    # greatest length, then smallest start, then smallest period
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"], -r["start"], -r["period"]).cast("struct<length:long,start:long,period:long>")))
    run: dict[str, Column] = {"start": -F.col("_best.start"), "length": F.col("_best.length"), "period": -F.col("_best.period")}
    run["exponent_milli"] = F.floor(1000 * run["length"] / run["period"]).cast("long")
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    return found.withColumn("_best", best).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        *[value.alias(name) for name, value in run.items()],
        F.sha2(lines, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


@query
def op12_tree_bpe(spark: SparkSession, folder: str, json_path: str | None = None) -> DataFrame:
    import public_tokenizers

    vocabulary = tree_bpe.load_vocabulary(json_path or public_tokenizers.path("byte_bpe_50k.json"))
    return tree_bpe.digests(tree_bpe.encode(table(spark, folder, "documents"), vocabulary), vocabulary)


@query
def op13_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    swapped = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(table(spark, folder, "embeddings").withColumn("label", swapped))
