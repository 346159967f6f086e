"""Corpus pipeline: quality, near-duplicates, decontamination, mixing, token ids. Each stage is written as Parquet and read again by the next.

All stages but the last return the columns of `documents`, whatever they are named; rows of one id are told apart by their texts.
"""

from __future__ import annotations

import zlib

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm import decontaminate, mixing, quality, simhash, tokens
from tidemark.llm.common import table, written


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier finds good and not toxic."""
    return quality.kept(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest id of each class of like documents: five-word shingles, a similarity of 0.8 or more, proposed by SimHash and compared.

    A null id counts as larger than any; equal rows of one id and text are one document.
    """
    found = simhash.similar_documents(docs.select("doc_id", "text"), shingle=5, similarity=0.8)
    first = found.groupBy("class").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")).alias("m")).select("m.doc_id", "m.text_hash")
    rows = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"), F.struct(*docs.columns).alias("row"))
    kept = rows.join(first.hint("merge"), rows["doc_id"].eqNullSafe(first["doc_id"]) & (rows["text_hash"] == first["text_hash"]), "left_semi")
    return kept.dropDuplicates(["doc_id", "text_hash"]).select("row.*")


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage."""
    hits = decontaminate.decontaminate(docs.select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    bad = written(hits.select("doc_id", "text_hash").distinct(), "contaminated")
    same = docs["doc_id"].eqNullSafe(bad["doc_id"]) & (F.xxhash64(F.coalesce(docs["text"], F.lit(""))) == bad["text_hash"])
    return docs.join(bad, same, "left_anti")


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as the mix takes it.

    Rows of one id are told apart by source and text, and numbered where these are equal too, so that each row meets one row of the plan. Nothing is grouped
    by the id alone: rows without one are as many groups as texts.
    """
    text = F.xxhash64(F.coalesce("text", F.lit("")))
    nth = F.row_number().over(Window.partitionBy("doc_id", "source", "text_hash").orderBy(F.desc("copies")))
    plan = mixing.mix_sources(docs.select("doc_id", "text", "source")).select("doc_id", "source", "text_hash", "copies", nth.alias("nth")).where("copies > 0")
    rows = docs.select("doc_id", "source", text.alias("text_hash"), F.struct(*docs.columns).alias("row"))
    rows = rows.withColumn("nth", F.row_number().over(Window.partitionBy("doc_id", "source", "text_hash").orderBy("doc_id")))
    same = rows["nth"] == plan["nth"]
    for c in ("doc_id", "source", "text_hash"):
        same = same & rows[c].eqNullSafe(plan[c])
    return rows.join(plan, same).select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy")).select("row.*")


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids in bit-packed files; what they hold of each document."""
    return tokens.token_files(docs.select("doc_id", "text"), tokens.tokenizer_path(), end_id=2, fn=lambda ids: (zlib.crc32(ids.astype("<u4").tobytes()),), extra="ids_crc32 long", memory=60_000)  # workers that all stages share have less room


STAGES = [
    ("quality classifier", quality_stage),
    ("SimHash near-dedup", near_duplicate_stage),
    ("benchmark decontamination", decontaminate_stage),
    ("mixing sources to target weights", mix_stage),
    ("token-ID output", token_stage),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name.split()[0].lower())
    return docs


QUERIES = {"pipeline": run}
ORACLE: dict[str, str] = {}
