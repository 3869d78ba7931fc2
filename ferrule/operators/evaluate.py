"""Retrieval quality: relevance, per-query and mean metrics, and the gate against a baseline."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

TOLERANCE = {"hit_rate": 0.02, "mrr": 0.02}


def relevant(ranked: DataFrame, chunks: DataFrame, wanted: DataFrame) -> DataFrame:
    """``(qid, rank, relevant)``: a chunk is relevant if it holds all the keywords of (qid, keywords)."""
    rows = ranked.join(chunks.select("chunk_id", "content"), "chunk_id").join(wanted, "qid")
    return rows.select("qid", "rank", F.forall("keywords", lambda k: F.contains(F.col("content"), k)).alias("relevant"))


def metrics(judged: DataFrame, queries: DataFrame, at: int = 5) -> DataFrame:
    """One row: hit rate, mean reciprocal rank, un-normalised discounted gain and precision at ``at``.
    ``queries`` is (qid, answerable); unanswerable ones count as false positives if anything was found."""
    top = judged.filter(F.col("rank") <= at)
    best = top.groupBy("qid").agg(F.min(F.when(F.col("relevant"), F.col("rank"))).alias("first"), F.count("*").alias("found"),
                                  F.sum(F.col("relevant").cast("long")).alias("good"), F.sum(F.when(F.col("relevant"), 1 / F.log2(F.col("rank") + 1.0)).otherwise(0.0)).alias("dcg"))
    rows = queries.join(best, "qid", "left")
    yes, no = F.col("answerable"), ~F.col("answerable")
    mean = lambda on, x: F.round(F.avg(F.when(on, x)), 6)
    return rows.agg(F.count("*").alias("cases"), mean(yes, F.col("first").isNotNull().cast("double")).alias("hit_rate"), mean(yes, F.coalesce(1.0 / F.col("first"), F.lit(0.0))).alias("mrr"),
                    mean(yes, F.coalesce("dcg", F.lit(0.0))).alias("dcg"), mean(yes, F.coalesce(F.col("good") / F.lit(float(at)), F.lit(0.0))).alias("precision"),
                    mean(no, (F.coalesce("found", F.lit(0)) > 0).cast("double")).alias("no_answer_fp"))


def gate(report: DataFrame, baseline: dict[str, float]) -> DataFrame:
    """``(metric, value, baseline, ok)``: a metric may fall below its baseline by its tolerance."""
    rows = [F.struct(F.lit(k).alias("metric"), F.col(k).alias("value"), F.lit(v).alias("baseline"), (F.col(k) >= v - TOLERANCE.get(k, 0.0)).alias("ok")) for k, v in baseline.items()]
    return report.select(F.explode(F.array(*rows)).alias("x")).select("x.*")


def document_metrics(retrieved: DataFrame, wanted: DataFrame, at: int = 5) -> DataFrame:
    """``(qid, recall, ndcg)``: of the documents a question (qid, expected) should be answered from, the share
    among the first ``at`` retrieved (qid, rank, document), and their discounted gain against the best order.
    A document counts where it comes first; a question that expects none has null for both."""
    want = wanted.select("qid", F.explode(F.array_distinct("expected")).alias("document"))
    first = retrieved.filter(F.col("rank") <= at).groupBy("qid", "document").agg(F.min("rank").alias("rank"))
    hit = first.join(want, ["qid", "document"]).groupBy("qid").agg(F.count("*").alias("hits"), F.sum(1 / F.log2(F.col("rank") + 1.0)).alias("dcg"))
    sizes = want.groupBy("qid").agg(F.count("*").alias("n"))
    best = F.aggregate(F.sequence(F.lit(1), F.least("n", F.lit(at)).cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1.0))
    rows = wanted.select("qid").distinct().join(sizes, "qid", "left").join(hit, "qid", "left")
    return rows.select("qid", F.when(F.col("n") > 0, F.round(F.coalesce("hits", F.lit(0)) / F.col("n"), 6)).alias("recall"),
                       F.when(F.col("n") > 0, F.round(F.coalesce("dcg", F.lit(0.0)) / best, 6)).alias("ndcg"))


def percentile(rows: DataFrame, key: str, value: str, share: float) -> DataFrame:
    """``(key, value)``: the nearest-rank percentile, the smallest value with at least ``share`` of the values at
    or below it. Equal values are counted first, so a key's rows are never in one task."""
    counts = rows.filter(F.col(value).isNotNull()).groupBy(key, value).agg(F.count("*").alias("n"))
    by = Window.partitionBy(key)
    upto = F.sum("n").over(by.orderBy(value)) >= F.ceil(share * F.sum("n").over(by))
    return counts.withColumn("_in", upto).filter("_in").groupBy(key).agg(F.min(value).alias(value))


def group_means(scores: DataFrame, variant: str, dimension: str, value: str) -> DataFrame:
    """``(variant, dimension, cases, mean)`` of judged scores; null scores are no cases."""
    return scores.groupBy(variant, dimension).agg(F.count(value).alias("cases"), F.round(F.avg(F.col(value).cast("decimal(18,6)")), 4).cast("double").alias("mean"))


def compared(means: DataFrame, variant: str, dimension: str, one: str, other: str) -> DataFrame:
    """``(dimension, one, other, gain)``: the means of two variants side by side; null where one has none."""
    side = lambda v, name: means.filter(F.col(variant) == v).select(dimension, F.col("mean").alias(name))
    return side(one, "one").join(side(other, "other"), dimension, "full").withColumn("gain", F.round(F.col("other") - F.col("one"), 4))
