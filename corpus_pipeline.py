"""The training-data pipeline over documents: quality rules, near-dedup, repeated passages, source mix, token ids.

Each stage takes (spark, docs, sf_dir) and works on every row that the one before it kept; all but the last return the
columns of documents (COLUMNS, extra ones are dropped). Stages decide by row key (doc_id and a hash of the text).

Cases: null and empty texts are rejected by the first stage; an empty table passes through every stage; rows that repeat
in full are one document after the second stage; a document that the mix takes twice is two rows from there on.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestry.llm import minhash_dedup, mixing, quality_rules, sentence_pieces, substring_dedup
from attestry.llm.shared import keyed

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
KEY = ["_id", "_th"]
REST = ("lang", "source", "n_chars")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no base rule and no certified rule rejects."""
    judged = quality_rules.judge(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return keyed(docs, *REST).join(judged.where("kept").select(*KEY), KEY, "left_semi").select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (0.8 or more of five-word shingles): that with the smallest doc_id."""
    found = minhash_dedup.near_duplicates(docs, percent=80).where("kept").select(*KEY)
    return keyed(docs, *REST).join(found, KEY, "left_semi").dropDuplicates(KEY).select(*COLUMNS)


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that also stand elsewhere; a text that loses nothing stays as it is."""
    found = substring_dedup.remove_repeats(docs, carry=("text", "lang", "source"))
    text = F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("text"))
    return found.select("doc_id", text.alias("text"), "lang", "source").withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it."""
    taken = mixing.mix(docs).where("copies > 0").groupBy(*KEY).agg(F.max("copies").alias("copies"))
    rows = keyed(docs, *REST).join(taken, KEY)
    return rows.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select(*COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and ids of every row."""
    table = sentence_pieces.load(public_tokenizers.path("piece_bpe_32k.model"))
    return sentence_pieces.encode(docs, table, chunk_bytes=8 << 20).select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [("quality rules", quality), ("near duplicates", near_dedup), ("repeated passages", passages), ("source mix", mixed), ("token ids", tokens)]

#: SQL can express neither the anchors nor the lattice in reasonable time; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs
