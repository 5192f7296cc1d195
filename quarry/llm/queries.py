"""The corpus operators over whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import chat, languages, lines, mixing, orderhash, packing, pii, search, simhash, suffixes
from quarry.llm.common import table

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = languages.fit(languages.training(docs, languages.fold() != 2))
    made = languages.identify(docs.select("doc_id", "text"), model, ["doc_id"])
    return made.select("doc_id", (languages.fold() == 2).alias("held_out"), "lang_pred", "score", "accepted")


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = suffixes.remove_repeats(table(spark, sf_dir, "documents"))
    return made.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = lines.dedup_lines(table(spark, sf_dir, "documents"), ["doc_id"])
    return made.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("kept", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


def op4_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    made = pii.find(docs, pii.train(docs))
    return made.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2(F.col("base").cast("binary"), 256).alias("base_sha256"), "spans")


def op5_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orderhash.fingerprints(table(spark, sf_dir, "documents"))


def op6_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    taken, _ = mixing.mix(table(spark, sf_dir, "documents"))
    return taken.select("doc_id", "size", "source_size", "target", "taken", "first_slot")


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_chats(table(spark, sf_dir, "conversations"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), TOKENIZER)


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return made.select("doc_id", simhash.hex64(F.col("fp")).alias("fingerprint"), "component_id")


def op10_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.top_products(table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0)


QUERIES = {f.__name__: f for f in (op1_language_id, op2_suffix_dedup, op3_line_dedup, op4_personal_data, op5_order_minhash, op6_source_mix, op7_chat_format, op8_packing, op9_simhash, op10_topk_search)}
ORACLES = {"op2_suffix_dedup": suffixes.ORACLE, "op3_line_dedup": lines.ORACLE, "op6_source_mix": mixing.ORACLE, "op7_chat_format": chat.ORACLE, "op10_topk_search": search.ORACLE}
