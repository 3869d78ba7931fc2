"""Around a model's answer: the context it is given, what it cost, and reading values out of its text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NOTHING = "（未检索到相关资料）"


def source_label(filename: Column, page: Column, section: Column, seq: Column, url: Column) -> Column:
    """Where a text comes from: file, page and section, or else its number, and its address."""
    some = lambda c: F.when(F.length(c.cast("string")) > 0, c)
    page = F.when(page != 0, page)
    return F.concat_ws(" · ", filename, F.concat(F.lit("第 "), page.cast("string"), F.lit(" 页")), F.concat(F.lit("章节: "), some(section)),
                       F.when(page.isNull() & some(section).isNull(), F.concat(F.lit("第 "), (seq + 1).cast("string"), F.lit(" 段"))), F.concat(F.lit("URL: "), some(url)))


def prompt_context(ranked: DataFrame, questions: DataFrame) -> DataFrame:
    """``(qid, context)``: the texts (qid, rank, label, text) of each question, a few, marked as untrusted
    and numbered in their order; a question without any gets a statement of that."""
    block = F.concat(F.lit('<untrusted_document source_id="'), F.col("n").cast("string"), F.lit('" source="'), F.col("label"), F.lit('">\n'), F.col("text"), F.lit("\n</untrusted_document>"))
    rows = ranked.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("rank", "label", "text"))).alias("rows"))
    rows = rows.select("qid", F.posexplode("rows").alias("i", "x")).select("qid", (F.col("i") + 1).alias("n"), "x.label", "x.text")
    rows = rows.groupBy("qid").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", block.alias("b")))), lambda x: x["b"]), "\n\n").alias("context"))
    return questions.select("qid").join(rows, "qid", "left").select("qid", F.coalesce("context", F.lit(NOTHING)).alias("context"))


def cost_micro(prompt_tokens: Column, completion_tokens: Column, per_million_in: float, per_million_out: float) -> Column:
    """Cost in millionths of the currency unit; null counts are none."""
    return F.rint(F.coalesce(prompt_tokens, F.lit(0)) * per_million_in + F.coalesce(completion_tokens, F.lit(0)) * per_million_out).cast("long")


def json_number(text: Column, name: str) -> Column:
    """The number under ``name`` of the first JSON object in a model's text; null if there is none."""
    held = F.regexp_extract(text, r"(?s)\{.*?\}", 0)
    return F.get_json_object(held, f"$.{name}").try_cast("double")


def has_shape(text: Column, schema: str) -> Column:
    """Whether a text is one JSON object with every field of ``schema`` (a DDL string) there and of its type."""
    parsed = F.from_json(text, schema, {"mode": "PERMISSIVE"})
    fields = [part.strip().split()[0] for part in schema.split(",")]
    test = F.lit(True)
    for f in fields:
        test = test & parsed[f].isNotNull()
    return F.coalesce(test, F.lit(False))


def reordered(ranked: DataFrame, order: DataFrame) -> DataFrame:
    """``ranked`` (qid, chunk_id, rank) with the places of a model's ``order`` (qid, place, index), whose indexes
    count the rows from 1. An index that isn't there or comes again is passed over; rows it leaves out follow
    in their old order."""
    first = order.groupBy("qid", "index").agg(F.min("place").alias("place"))
    rows = ranked.join(first.withColumnRenamed("index", "rank"), ["qid", "rank"], "left")
    rows = rows.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("place", F.lit(1 << 30)).alias("p"), "rank", "chunk_id"))).alias("x"))
    return rows.select("qid", F.posexplode("x").alias("i", "r")).select("qid", "r.chunk_id", (F.col("i") + 1).alias("rank"))


def carried_over(keywords: Column, before: Column) -> Column:
    """Keywords that the question before had as well."""
    return F.array_intersect(keywords, F.coalesce(before, F.array().cast("array<string>")))
