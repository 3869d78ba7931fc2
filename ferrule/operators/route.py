"""Which way a question is answered: social talk, an explicit profile, or one chosen by its words."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ferrule.functions import text as T

# Greetings, identifiers, and words that ask for relations or for meaning.
GREETING = r"(?i)^(你好|您好|hello|hi|谢谢|thanks)[!！。,.\s]*$"
IDENTIFIER = r"(?U)\b(?:[A-Z]{2,}[A-Z0-9_-]*|[A-Z]+-?[0-9]{2,}|[0-9]{3,})\b"
RELATION = ("关系", "关联", "影响", "上下游", "多跳")
MEANING = ("类似", "含义", "概念", "是什么")


def _any(text: Column, words: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, (F.contains(text, F.lit(w)) for w in words))


def route(questions: DataFrame, profile: str = "auto", bases: DataFrame | None = None) -> DataFrame:
    """``(id, query, mode, kb_id, needs_retrieval, reason)`` of questions (id, question): the cleaned query, the
    profile to take, and of ``bases`` (kb_id, kb_name) the first, by id, whose name the question mentions.

    Names are compared in any case; bases are few and broadcast after a check of their number, else they meet
    the questions by their name's first token. A null question is an empty one."""
    rows = questions.select("id", F.coalesce(T.clean_query(F.col("question")), F.lit("")).alias("query"))
    q = F.col("query")
    choices = [(q.rlike(GREETING), "none", "social_query")]
    if profile != "auto":
        choices.append((F.lit(True), profile, "explicit_profile"))
    choices += [(q.rlike(IDENTIFIER), "keyword", "exact_identifier"), (_any(q, RELATION), "graph", "relationship_query"), (_any(q, MEANING), "vector", "semantic_query"), (F.lit(True), "hybrid", "hybrid_default")]
    pick = reduce(lambda rest, c: F.when(c[0], F.struct(F.lit(c[1]).alias("mode"), F.lit(c[2]).alias("reason"))).otherwise(rest), reversed(choices[:-1]), F.struct(F.lit(choices[-1][1]).alias("mode"), F.lit(choices[-1][2]).alias("reason")))
    rows = rows.withColumn("x", pick).select("id", "query", "x.mode", "x.reason")
    if bases is None:
        rows = rows.withColumn("kb_id", F.lit(None).cast("string"))
    else:
        rows = rows.join(mentioned(rows, bases), "id", "left")
    return rows.select("id", "query", "mode", "kb_id", (F.col("mode") != "none").alias("needs_retrieval"), "reason")


FEW_BASES = 20_000  # names sent to all executors; more meet the questions by a token


def mentioned(rows: DataFrame, bases: DataFrame) -> DataFrame:
    """``(id, kb_id)``: the first base whose name a query (id, query) holds."""
    names = bases.select("kb_id", F.lower("kb_name").alias("name")).filter("name != ''").groupBy("name").agg(F.min("kb_id").alias("kb_id"))
    asked = rows.select("id", F.lower("query").alias("q"))
    if names.count() <= FEW_BASES:
        hit = asked.join(F.broadcast(names), F.contains("q", F.col("name")))
    else:
        keyed = names.withColumn("term", F.get(T.word_tokens(F.col("name")), F.lit(0)))
        by_term = asked.withColumn("term", F.explode(F.array_distinct(T.word_tokens(F.col("q"))))).join(keyed.filter("term is not null"), "term").filter(F.contains("q", F.col("name")))
        hit = by_term.select("id", "q", "name", "kb_id")
    first = F.row_number().over(Window.partitionBy("id").orderBy("kb_id"))
    return hit.withColumn("_n", first).filter("_n = 1").select("id", "kb_id")
