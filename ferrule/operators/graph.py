"""Keyword graph: terms of a chunk, edges between them, recall over one or two hops."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ferrule.functions import text as T

TERMS = 8


def entities(chunks: DataFrame, most: int = TERMS) -> DataFrame:
    """``(chunk_id, name)``: the ``most`` terms of each chunk with the highest tf-idf; ties by name."""
    # Texts are shuffled by chunk once; counting a chunk's terms then needs no shuffle of the tokens.
    tf = chunks.select("chunk_id", "content").repartition("chunk_id").select("chunk_id", F.explode(T.word_tokens(F.col("content"))).alias("name")).groupBy("chunk_id", "name").agg(F.count("*").alias("tf"))
    df = tf.groupBy("name").agg(F.count("*").alias("df"))
    n = chunks.agg(F.count("*").alias("n")).scalar()
    scored = tf.join(df, "name").withColumn("n", n).withColumn("score", F.round(F.col("tf") * F.log((F.col("n") + 1.0) / (F.col("df") + 1.0)), 6))
    place = F.row_number().over(Window.partitionBy("chunk_id").orderBy(F.desc("score"), "name"))
    return scored.withColumn("place", place).filter(F.col("place") <= most).select("chunk_id", "name")


def edges(found: DataFrame) -> DataFrame:
    """``(source, target, weight)``: pairs of terms of one chunk, source < target, and in how many."""
    names = found.groupBy("chunk_id").agg(F.array_sort(F.collect_set("name")).alias("names"))  # TERMS at most
    pairs = F.flatten(F.transform("names", lambda x, i: F.transform(F.slice(F.col("names"), i + 2, F.lit(TERMS)), lambda y: F.struct(x.alias("source"), y.alias("target")))))
    return names.select(F.explode(pairs).alias("p")).groupBy("p.source", "p.target").agg(F.count("*").alias("weight"))


def _first(rows: DataFrame, by: str, most: int) -> DataFrame:
    """The first ``most`` rows of each question; partitions cut their own before the shuffle."""
    place = F.row_number().over(Window.partitionBy("qid").orderBy(by))
    return rows.withColumn("_n", place).filter(F.col("_n") <= most).drop("_n")


def recall(seeds: DataFrame, found: DataFrame, hops: int = 2, most: int = 30) -> DataFrame:
    """``(qid, chunk_id, hop)``: chunks that hold a seed term (hop 0), or a term that shares a chunk with
    one reached before. ``seeds`` is (qid, name); a chunk's first hop counts.

    A question keeps ``most`` chunks of its seeds, and of each hop ``4 * most`` terms and ``2 * most`` chunks,
    the first by id or name: the limits of the search, without which a common term would reach everything.
    """
    reached = _first(seeds.join(found, "name").select("qid", "chunk_id").distinct(), "chunk_id", most).withColumn("hop", F.lit(0))
    frontier = reached
    for hop in range(1, hops):
        terms = _first(frontier.join(found, "chunk_id").select("qid", "name").distinct(), "name", 4 * most)
        chunk = terms.join(found, "name").select("qid", "chunk_id").distinct()
        frontier = _first(chunk.join(reached, ["qid", "chunk_id"], "left_anti"), "chunk_id", 2 * most).withColumn("hop", F.lit(hop))
        reached = reached.unionByName(frontier)
    return reached
