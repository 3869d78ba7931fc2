"""Checks around an answer: risky texts, evidence, citations."""

from __future__ import annotations

import re
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ferrule.functions import text as T
from ferrule.runtime import arrow_map

FACTOR, QUARANTINE, MIN_SCORE, MIN_CHUNKS = 0.3, 0.5, 0.012, 1


def risk_stats(df: DataFrame, key: str, text: str) -> DataFrame:
    """Texts of each risk by ``key``, the weighted share of risk, and the highest one."""
    risk = T.injection_risk(F.col(text))
    counts = df.select(key, risk.alias("risk")).groupBy(key).agg(
        F.count("*").alias("texts"), F.sum((F.col("risk") == "high").cast("long")).alias("high"), F.sum((F.col("risk") == "medium").cast("long")).alias("medium"))
    return counts.select("*", F.round((F.col("high") + 0.3 * F.col("medium")) / F.col("texts"), 6).alias("risk"),
                         F.when(F.col("high") > 0, "high").when(F.col("medium") > 0, "medium").otherwise("none").alias("highest"))


def quarantined(stats: DataFrame, ratio: float = QUARANTINE) -> DataFrame:
    return stats.filter((F.col("high") > 0) & (F.col("high") / F.col("texts") >= ratio))


def apply_policy(ranked: DataFrame, action: str = "downweight", factor: float = FACTOR) -> DataFrame:
    """Risky rows are kept (allow), dropped (remove) or scored lower (downweight). Needs text and score."""
    risky = T.injection_risk(F.col("text")) == "high"
    if action == "remove":
        return ranked.filter(~risky)
    return ranked if action == "allow" else ranked.withColumn("score", F.when(risky, F.col("score") * factor).otherwise(F.col("score")))


def gate(fused: DataFrame, queries: DataFrame) -> DataFrame:
    """Whether each query has enough evidence, and why not: chunks found, the best similarity and score,
    chunks found both by keyword and by a positive similarity, and the ids of risky ones, in order.

    ``fused`` is (qid, chunk_id, score, keyword_hit, similarity, text) of the few chunks a query keeps."""
    risk = T.injection_risk(F.col("text"))
    ids = lambda test: F.array_sort(F.collect_list(F.when(test, F.col("chunk_id"))))
    best = fused.withColumn("risk", risk).groupBy("qid").agg(
        F.count("*").alias("chunks"), F.max("similarity").alias("top_similarity"), F.max("score").alias("top_score"),
        F.sum((F.col("keyword_hit") & (F.col("similarity") > 0)).cast("long")).alias("cross_route_hits"), ids(F.col("risk") != "none").alias("suspicious"), ids(F.col("risk") == "high").alias("high_risk"))
    rows = queries.select("qid").join(best, "qid", "left")
    zero = lambda c, z: F.coalesce(c, F.lit(z)).alias(c)
    none = F.array().cast("array<long>")
    few, low = F.coalesce("chunks", F.lit(0)) < MIN_CHUNKS, F.col("top_score") < MIN_SCORE
    return rows.select("qid", zero("chunks", 0), zero("top_similarity", 0.0), zero("top_score", 0.0), zero("cross_route_hits", 0),
                       F.coalesce("suspicious", none).alias("suspicious"), F.coalesce("high_risk", none).alias("high_risk"),
                       F.when(few, "insufficient_evidence_count").when(low, "retrieval_score_below_threshold").otherwise("evidence_threshold_met").alias("reason"))


def factual_lines(answer: Column) -> Column:
    """Lines of twelve characters or more that are no heading or quotation."""
    lines = F.transform(F.split(answer, "\n"), lambda x: F.trim(x))
    return F.filter(lines, lambda x: (F.length(x) >= 12) & ~x.rlike("^[#>]"))


def citations(answer: Column) -> Column:
    return F.transform(F.regexp_extract_all(answer, F.lit(r"\[(\d+)\]"), 1), lambda x: x.cast("int"))


def citation_check(answers: DataFrame) -> DataFrame:
    """``(id, cited, invalid, uncited, valid)`` for rows (id, answer, sources): numbers cited, those
    outside 1..sources, factual lines (list items aside) without one, and whether all is well."""
    cited = F.array_sort(F.array_distinct(citations(F.col("answer"))))
    uncited = F.size(F.filter(factual_lines(F.col("answer")), lambda x: ~x.rlike(r"^[-*]|\[\d+\]")))
    rows = answers.withColumn("c", cited).withColumn("uncited", uncited)
    invalid = F.size(F.filter("c", lambda n: (n < 1) | (n > F.col("sources"))))
    return rows.select("id", F.size("c").alias("cited"), invalid.alias("invalid"), "uncited",
                       ((F.col("sources") > 0) & (F.size("c") > 0) & (invalid == 0) & (F.col("uncited") == 0)).alias("valid"))


RULES, LABEL, ITEM = ("---", "***", "___"), 12, "-*+0123456789.、 "


def _stays(line: str, sources: int, fenced: bool) -> bool:
    """Whether a line of an answer needs no citation, or has only citations of given sources."""
    if not line or line[0] in "#>" or line in RULES or line.startswith("```"):
        return True
    numbers = [int(n) for n in re.findall(r"\[(\d+)\]", line)]
    if numbers:
        return all(1 <= n <= sources for n in numbers)
    label = line.lstrip(ITEM)
    return not fenced and len(label) < LABEL and label.endswith((":", "："))


def repair_citations(answer: str | None, sources: int | None) -> str:
    """The answer without lines that cite nothing or a source that isn't there; headings, quotations, rules
    and short labels stay, and fences left empty go. Without an answer or sources nothing is left."""
    if not answer or not sources or sources < 0:
        return ""
    lines = answer.splitlines()
    fences = accumulate((line.strip().startswith("```") for line in lines), initial=0)
    kept = [line for line, before in zip(lines, fences) if _stays(line.strip(), sources, before % 2 == 1)]
    return re.sub(r"```[^\n]*\n\s*```", "", "\n".join(kept).strip()).strip()


def repaired_answers(answers: DataFrame) -> DataFrame:
    """``(id, answer, changed)`` of rows (id, answer, sources): ``repair_citations`` of each answer."""
    def run(c):
        fixed = [repair_citations(a, n) for a, n in zip(c["answer"], c["sources"])]
        return {"id": c["id"], "answer": fixed, "changed": [f != (a or "").strip() for f, a in zip(fixed, c["answer"])]}

    return arrow_map(answers.select("id", "answer", "sources"), run, f"id {answers.schema['id'].dataType.simpleString()}, answer string, changed boolean")


def cited_claims(answers: DataFrame, most: int = 6) -> DataFrame:
    """``(id, claim, sources)`` of the first ``most`` factual lines of (id, answer, sources) that cite
    only numbers in range: what an entailment check would be given."""
    rows = answers.select("id", F.col("sources").alias("_n"), F.posexplode(factual_lines(F.col("answer"))).alias("line", "claim"))
    rows = rows.withColumn("sources", F.array_distinct(citations(F.col("claim")))).filter((F.size("sources") > 0) & F.forall("sources", lambda n: (n >= 1) & (n <= F.col("_n"))))
    place = F.row_number().over(Window.partitionBy("id").orderBy("line"))
    return rows.withColumn("_p", place).filter(F.col("_p") <= most).select("id", "claim", "sources")


def extractive_answer(ranked: DataFrame, most: int = 5, width: int = 420) -> DataFrame:
    """An answer made of the first ``most`` excerpts, numbered, for each query."""
    line = F.concat(F.regexp_replace(F.substring(F.trim("text"), 1, width), r"\s+", " "), F.lit(" ["), F.col("rank").cast("string"), F.lit("]"))
    rows = ranked.filter(F.col("rank") <= most).select("qid", F.struct("rank", line.alias("line")).alias("x"))
    return rows.groupBy("qid").agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["line"]), "\n").alias("answer"))
