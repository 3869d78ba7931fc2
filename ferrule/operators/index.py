"""The versioned chunk index: fingerprints, reuse, activation, clean-up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def fingerprint(content_hash: Column, config: str) -> Column:
    """What must be equal for work on a file to be reusable."""
    return F.sha2(F.concat_ws("|", content_hash, F.lit(config)), 256)


def duplicate_files(documents: DataFrame) -> DataFrame:
    """Files handed in again under one owner and base, with the first one's id. Null hashes are no duplicates."""
    w = Window.partitionBy("owner_id", "kb_id", "content_hash").orderBy("created_at", "document_id")
    rows = documents.filter("content_hash is not null").select("document_id", F.first("document_id").over(w).alias("first_id"), F.row_number().over(w).alias("n"))
    return rows.filter("n > 1").select("document_id", "first_id")


def reusable(chunks: DataFrame, target: int, before: int) -> DataFrame:
    """Chunks of version ``target`` whose (document, seq, content) version ``before`` holds already."""
    old = chunks.filter(F.col("index_version") == before).select("document_id", "seq", "content").distinct()
    return chunks.filter(F.col("index_version") == target).join(old, ["document_id", "seq", "content"], "left_semi")


def superseded(chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """Chunks of versions other than the document's active one."""
    active = documents.select("document_id", "active_index_version")
    return chunks.join(active, "document_id").filter("index_version != active_index_version").drop("active_index_version")


def activation(chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """``(document_id, expected, written, complete)`` of the active version; a chunk written twice counts once."""
    have = chunks.groupBy("document_id", F.col("index_version").alias("active_index_version")).agg(F.count_distinct("seq").alias("written"))
    rows = documents.filter("active_index_version is not null").join(have, ["document_id", "active_index_version"], "left")
    written = F.coalesce("written", F.lit(0))
    return rows.select("document_id", F.col("chunk_count").cast("long").alias("expected"), written.alias("written"), (F.col("chunk_count") == written).alias("complete"))


def with_source_url(chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """Chunks with their document's address where it has one, else their own."""
    new = documents.select("document_id", F.col("source_url").alias("_new"))
    return chunks.join(new, "document_id", "left").withColumn("source_url", F.coalesce("_new", "source_url")).drop("_new")


def orphans(stored: DataFrame, referenced: DataFrame, key: str) -> DataFrame:
    """Stored keys that nothing refers to."""
    return stored.join(referenced.select(key).distinct(), key, "left_anti")
