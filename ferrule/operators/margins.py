"""Running heads and feet of the pages of a document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SHARE = 0.6  # of a document's pages that a line must head or end to be a margin


def _lines(text: Column) -> Column:
    return F.filter(F.split(text, "\n"), lambda x: F.trim(x) != "")


def _form(line: Column) -> Column:
    """A line up to its numbers."""
    return F.regexp_replace(F.trim(line), "[0-9]+", "#")


def repeated_margins(pages: DataFrame, document: str, page: str, text: str, share: float = SHARE) -> DataFrame:
    """``(document, line, times, pages)``: first and last lines, up to numbers, on at least ``share`` of a
    document's pages and more than one. Empty pages count as pages."""
    edge = pages.select(document, page, _lines(F.col(text)).alias("l")).filter(F.size("l") > 0)
    edge = edge.select(document, page, F.explode(F.array(F.element_at("l", 1), F.element_at("l", -1))).alias("x"))
    edge = edge.select(document, page, _form(F.col("x")).alias("line")).distinct()
    n = pages.groupBy(document).agg(F.count_distinct(page).alias("pages"))
    rows = edge.groupBy(document, "line").agg(F.count("*").alias("times")).join(n, document)
    return rows.filter((F.col("times") >= share * F.col("pages")) & (F.col("times") > 1))


def without_margins(pages: DataFrame, document: str, page: str, text: str, share: float = SHARE) -> DataFrame:
    """The pages with their text's blank lines, and its first and last line where they are margins, left out.
    Null texts give no row."""
    found = repeated_margins(pages.filter(F.col(text).isNotNull()), document, page, text, share).groupBy(document).agg(F.collect_list("line").alias("_margins"))  # 4 at most at this share
    rows = pages.filter(F.col(text).isNotNull()).join(found, document, "left").withColumn("_l", _lines(F.col(text)))
    is_margin = lambda x: F.array_contains(F.coalesce("_margins", F.array().cast("array<string>")), _form(x))
    kept = F.filter("_l", lambda x, i: ~(((i == 0) | (i == F.size("_l") - 1)) & is_margin(x)))
    return rows.withColumn(text, F.array_join(kept, "\n")).drop("_l", "_margins")
