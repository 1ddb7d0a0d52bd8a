"""The corpus pipeline: five stages, each from documents to documents, the last
to piece ids. Each stage is written as Parquet and read again by the next."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegrid.llm import blocks, leaks, near, pieces, rules
from tidegrid.llm.queries import table, vocabulary
from tidegrid.session import settle, shared_dir

#: The stages that code pieces and drop merges by hash have no SQL form.
ORACLE_SQL = None


def _free(name: str) -> str:
    """A column name that no table has."""
    return f"__{name}_{uuid.uuid4().hex}"


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the policy `strict`: `prose`, and no insults."""
    return rules.passing(docs, "strict")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (a similarity of 0.8 or
    more), the one with the smallest id; of rows with the same id and text one, of rows without an id all."""
    own, kept, n = _free("id"), _free("kept"), _free("n")
    found = near.near_duplicates(docs, percent=80).where("doc_id is not null").groupBy(F.col("doc_id").alias(own))
    # Merged, not broadcast, so that the plan is the same at every size.
    found = settle(found.agg(F.max("kept").alias(kept), F.count("*").alias(n)), "kept")
    out = docs.join(found.hint("merge"), docs.doc_id == found[own], "left").where(F.col(own).isNull() | F.col(kept))
    twice = F.col(n) > 1
    if found.where(twice).isEmpty():
        return out.select(*docs.columns)
    again = out.where(twice).dropDuplicates(["doc_id", "text"])
    return out.where(F.col(own).isNull() | ~twice).unionAll(again).select(*docs.columns)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages of 35 words or more that occur elsewhere.
    n_chars, where there is one, follows a text that was cut; a document that lost
    all its words goes."""
    was = _free("was")
    cut = blocks.repeats(docs.withColumn(was, F.xxhash64("text")), cut=True)
    same = F.xxhash64("text") == F.col(was)
    cut = cut.where(same | F.col("text").rlike("[^\\x20\\x09-\\x0D]"))
    if "n_chars" in docs.columns:
        cut = cut.withColumn("n_chars", F.when(same, F.col("n_chars")).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType))
    return cut.select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark."""
    return leaks.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def piece_coding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, piece_ids with seeded merge dropout, their crc32,
    and whether decoding gives the text back."""
    path = vocabulary("piece_bpe_32k.model")
    coded = pieces.encode_and_decode(docs.select("doc_id", "lang", "source", "text"), path, p=0.1, seed=1)
    lossless = F.coalesce("text", F.lit("")) == F.col("decoded")
    return coded.select("doc_id", "lang", "source", "piece_ids", F.size("piece_ids").cast("long").alias("n_pieces"), F.col("piece_ids_crc32").alias("ids_crc32"), lossless.alias("lossless"))


STAGES = [
    ("quality_rules", quality),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("decontamination", decontamination),
    ("piece_coding", piece_coding),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = os.path.join(shared_dir(spark), f"stage-{name}-{uuid.uuid4().hex}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
