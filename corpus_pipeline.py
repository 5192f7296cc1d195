"""From raw documents to packed training windows, in five stages."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import languages, lines, mixing, packing, simhash
from quarry.llm.common import BLANKS, checkpointed, prepare, row_hash, written


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts. It learns from all labelled ones, within its bound."""
    prepare(spark)
    model = languages.fit(languages.training(docs, F.lit(True)))
    names = ("quarry_lang", "quarry_score", "quarry_accepted")
    return languages.identify(docs, model, docs.columns, names).where("quarry_accepted").select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that later ones repeat. What had text and lost it all goes; null texts stay."""
    prepare(spark)
    others = [c for c in docs.columns if c != "text"]  # the text itself crosses the shuffle once, as what is left of it
    made = lines.dedup_lines(docs, others, names=("quarry_lines", "quarry_dropped", "text"))
    left = made.where((F.col("quarry_dropped") == 0) | (F.length(F.trim("text", F.lit(BLANKS))) > 0))
    if "n_chars" in docs.columns:
        left = left.withColumn("n_chars", F.when(F.col("quarry_dropped") > 0, F.char_length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return left.select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the one with the least id, then row hash."""
    prepare(spark)
    made = simhash.near_duplicates(docs)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("first")
    keep = checkpointed(made.groupBy("root").agg(first).select(F.col("first.row").alias("quarry_row")))
    stays = docs.withColumn("quarry_row", row_hash("doc_id", "text")).join(keep.hint("shuffle_hash"), "quarry_row", "left_semi")
    repeated = checkpointed(made.groupBy(F.col("row").alias("quarry_row")).count().where("count > 1").select("quarry_row"))
    if repeated.isEmpty():
        return stays.drop("quarry_row")
    once = stays.join(repeated, "quarry_row", "left_semi").dropDuplicates(["quarry_row"])
    return stays.join(repeated, "quarry_row", "left_anti").unionByName(once).drop("quarry_row")


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: each document as often as the schedule takes most of it, at most 3 times, in order of its slots.

    Null texts and texts without words are in no mix and go. Null sources are one source, null ids are
    ids like others. Rows equal in id, source and text are one document that is taken for all of them.
    Ties in slot go by the place on the source's line. Empty input: no rows.
    """
    prepare(spark)
    places = mixing.copies(*mixing.mix(docs)).withColumnsRenamed({"row": "quarry_row", "slot": "quarry_slot", "off": "quarry_off"})
    rows = docs.withColumn("quarry_row", row_hash("doc_id", "source", "text"))
    repeated = checkpointed(rows.groupBy("quarry_row").count().where("count > 1").select("quarry_row"))
    if not repeated.isEmpty():
        once = rows.join(repeated, "quarry_row", "left_semi").dropDuplicates(["quarry_row"])
        rows = rows.join(repeated, "quarry_row", "left_anti").unionByName(once)
    return rows.join(places.hint("shuffle_hash"), "quarry_row").orderBy("quarry_slot", "quarry_off").select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in windows; see packing.pack for nulls, empty texts and repeated rows."""
    return packing.pack(docs.select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", known_language),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("source_mix", source_mix),
    ("packing", packed),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = prepare(spark).read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs)
    return docs
