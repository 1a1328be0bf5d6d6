"""The operators as registered queries, with SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.llm import (
    bpe, conversations, decontamination, exact_dedup, line_dedup, mixing, order_minhash, pseudo_likelihood, rollup, simhash,
    surrogates, toxicity, whitening)
from larder.llm.common import table
from larder.session import scratch_path, ship_package

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            ship_package(spark)
            return fn(spark, folder)

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return run

    return register


@query("op1_order_minhash")
def op1(spark: SparkSession, folder: str) -> DataFrame:
    return order_minhash.edited_pairs(table(spark, folder, "documents"))


@query("op2_pii_surrogates")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    return surrogates.replaced(table(spark, folder, "documents"))


@query("op3_bpe_tree_concatenation")
def op3(spark: SparkSession, folder: str) -> DataFrame:
    return bpe.digests(table(spark, folder, "documents"))


@query("op4_masked_pseudo_likelihood")
def op4(spark: SparkSession, folder: str) -> DataFrame:
    return pseudo_likelihood.scores(table(spark, folder, "documents"))


@query("op5_exact_dedup", """
WITH rows AS (SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256 FROM documents),
groups AS (SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM rows GROUP BY text_sha256)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM rows JOIN groups USING (text_sha256)
""")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    found = exact_dedup.copies(table(spark, folder, "documents"), every_hash=True)
    return found.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("sha256")).alias("text_sha256"))


@query("op6_toxicity_ftrl")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.scores(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query("op7_mixing", mixing.SQL)
def op7(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mixed(table(spark, folder, "documents"))


@query("op8_line_dedup_sites", line_dedup.SQL)
def op8(spark: SparkSession, folder: str) -> DataFrame:
    found = line_dedup.without_spread_lines(table(spark, folder, "documents"))
    return found.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


@query("op9_simhash_covering")
def op9(spark: SparkSession, folder: str) -> DataFrame:
    found = simhash.classes(table(spark, folder, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query("op10_token_rollup")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    return rollup.maintained(
        table(spark, folder, "documents"), table(spark, folder, "labels"), scratch_path(spark, "rollup"),
        ("byte_bpe_50k", public_tokenizers.path("byte_bpe_50k.tiktoken")),
        ("byte_bpe_multi_50k", public_tokenizers.path("byte_bpe_multi_50k.tiktoken")))


@query("op11_decontamination", decontamination.SQL)
def op11(spark: SparkSession, folder: str) -> DataFrame:
    return decontamination.digests(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query("op12_conversation_repair")
def op12(spark: SparkSession, folder: str) -> DataFrame:
    return conversations.audited(conversations.damaged(table(spark, folder, "conversations")))


@query("op13_embedding_whitening")
def op13(spark: SparkSession, folder: str) -> DataFrame:
    return whitening.whitened(table(spark, folder, "embeddings"))
