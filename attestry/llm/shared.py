"""Row keys for documents and their words. Lineage is cut with written tables, never with executor-local copies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestry.functions.tables import shared_dir, written  # noqa: F401

#: The six ASCII white-space bytes that separate words.
SPACES = " \t\n\x0b\f\r"
#: Java regex of one word.
WORD = r"[^\x20\x09-\x0D]+"


def keyed(docs: DataFrame, *more: str) -> DataFrame:
    """_id and _th name a row by its doc_id and text; rows equal in both share a name. Null texts and ids keep theirs."""
    return docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("_id"),
        F.xxhash64(F.col("text"), F.col("doc_id").isNull()).alias("_th"),
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("text").cast("string").alias("text"),
        *more,
    )


def word_array(text: Column) -> Column:
    """The words of a text in order; none for null or white space."""
    trimmed = F.btrim(text, F.lit(SPACES))
    return F.when(F.length(trimmed) > 0, F.split(trimmed, r"[\x20\x09-\x0D]+")).otherwise(F.array().cast("array<string>"))
