"""From ranked chunks to the context of an answer: near-duplicates, compression, order and budget."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ferrule.functions import text as T
from ferrule.runtime import arrow_map

ALIKE, LONG, TOKENS = 0.88, 900, 6000


def compress(text: Column, terms: Column) -> Column:
    """Texts of LONG or more characters are cut to the sentences that hold a term and their neighbours;
    without any, to the first LONG characters."""
    s = T.sentences(text)
    hits = F.transform(s, lambda x: F.exists(terms, lambda t: F.contains(F.lower(x), t)))
    near = F.filter(s, lambda x, i: F.exists(F.slice(hits, F.greatest(i, F.lit(1)), F.when(i > 0, 3).otherwise(2)), lambda h: h))
    kept = F.array_join(near, " ")
    return F.when(F.length(text) < LONG, text).when(F.length(kept) > 0, kept).otherwise(F.substring(text, 1, LONG))


def lost_in_middle(ranked: DataFrame) -> DataFrame:
    """``place``: the first rank first, the second last, odd ranks rising and even ones falling between."""
    n = F.count("*").over(Window.partitionBy("qid"))
    rank = F.row_number().over(Window.partitionBy("qid").orderBy("rank"))
    place = F.when(rank % 2 == 1, (rank + 1) / 2).otherwise(n - rank / 2 + 1)
    return ranked.withColumn("place", place.cast("int"))


def budgeted(ranked: DataFrame, tokens: int = TOKENS, alike: float = ALIKE) -> DataFrame:
    """``(qid, chunk_id, used)``: in the order of ranks, chunks that are no near-duplicate of a kept one
    and still fit the budget of half a token a character; one too large is passed over, not the end.

    A query has at most the few chunks its routes gave, so one fold a query holds little.
    """
    def fold(c):
        out = {"qid": [], "chunk_id": [], "used": []}
        for qid, rows in zip(c["qid"], c["rows"]):
            kept: list[set] = []
            used = 0
            for r in sorted(rows, key=lambda r: (r["rank"], r["chunk_id"])):
                s = re.sub(r"\s", "", r["text"] or "").lower()
                grams = {s[i : i + 3] for i in range(len(s) - 2)} or {s}
                if any(len(grams & k) / len(grams | k) >= alike for k in kept):
                    continue
                cost = len(r["text"] or "") // 2
                if used + cost > tokens:
                    continue
                kept.append(grams)
                used += cost
                for k, v in zip(out, (qid, r["chunk_id"], used)):
                    out[k].append(v)
        return out

    grouped = ranked.groupBy("qid").agg(F.collect_list(F.struct("rank", "chunk_id", "text")).alias("rows"))
    return arrow_map(grouped, fold, f"qid {ranked.schema['qid'].dataType.simpleString()}, chunk_id long, used int")
