"""Retrieval for batches of queries: routes, fusion, expansion and reranking.

A route is a DataFrame ``(qid, chunk_id, rank, score)``, ranks from 1. All orders are total.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ferrule.functions import text as T
from ferrule.runtime import arrow_map

CANDIDATES, RRF_K, TOP = 30, 60, 5
TILE = 128  # of these multiplied with a batch of vectors at once
QUERY_BLOCK = 20_000  # query vectors sent to the executors at once; more take more passes


def visible_chunks(chunks: DataFrame, documents: DataFrame, bases: DataFrame | None = None, members: DataFrame | None = None, user: str | None = None,
                   kb_id: str | None = None, quarantined: DataFrame | None = None) -> DataFrame:
    """Chunks of the active index version, in the document's own base, of documents that aren't being
    deleted nor ``quarantined`` (document_id). With ``members`` (workspace_id, user_id) and ``bases`` (kb_id,
    workspace_id) only those of workspaces of ``user``; with ``kb_id`` only those of one base. A chunk
    written twice counts once, the one written last. Chunks without a document are not visible.

    What decides is narrow: texts are joined by chunk once that is done, and only by whoever reads them.
    """
    live = documents.filter(~F.col("status").isin("deleting", "deleted"))
    if quarantined is not None:
        live = live.join(quarantined.select("document_id"), "document_id", "left_anti")
    if kb_id is not None:
        live = live.filter(F.col("kb_id") == kb_id)
    if members is not None:
        own = bases.join(members.filter(F.col("user_id") == user).select("workspace_id"), "workspace_id", "left_semi")
        live = live.join(own.select("kb_id"), "kb_id", "left_semi")
    live = live.select("document_id", "kb_id", F.col("active_index_version").alias("index_version"), "filename", "tags")
    narrow = chunks.select("chunk_id", "document_id", "kb_id", "seq", "index_version", "created_at").join(live, ["document_id", "kb_id", "index_version"])
    last = F.max(F.struct("created_at", "chunk_id", "filename", "tags")).alias("x")
    kept = narrow.groupBy("document_id", "seq", "index_version").agg(last).select("x.chunk_id", "x.filename", "x.tags")
    return chunks.join(kept, "chunk_id")


def with_metadata(chunks: DataFrame, content_types=None, sections=None, since=None, until=None, source_types=None, departments=None) -> DataFrame:
    """Chunks (with their document's columns, where those are asked for) that satisfy every filter given; a
    null value satisfies none."""
    one_of = {"content_type": content_types, "section": sections, "source_type": source_types, "department": departments}
    tests = [F.col(c).isin(*values) for c, values in one_of.items() if values]
    tests += [F.col("created_at") >= since] if since is not None else []
    tests += [F.col("created_at") < until] if until is not None else []
    return reduce(DataFrame.filter, tests, chunks)


def in_base(ranked: DataFrame, kb_id: str) -> DataFrame:
    """Rows of one base, with ``dropped``, the number of others their query had."""
    there = F.coalesce(F.col("kb_id") == kb_id, F.lit(False))
    others = F.sum((~there).cast("long")).over(Window.partitionBy("qid"))
    return ranked.withColumn("dropped", others).filter(there)


def with_tags(documents: DataFrame, tags: list[str]) -> DataFrame:
    """Documents that carry every one of the tags, in any case."""
    have = F.transform("tags", lambda t: F.lower(t))
    return reduce(DataFrame.filter, [F.array_contains(have, t.lower()) for t in tags], documents)


def _ranked(scored: DataFrame, order: list[Column], most: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("qid").orderBy(*order))
    return scored.withColumn("rank", rank).filter(F.col("rank") <= most)


def keyword_route(queries: DataFrame, chunks: DataFrame, most: int = CANDIDATES, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """Chunks sharing a term with the query: the ``most`` with the most occurrences, then ordered by
    BM25 over these candidates, with substring counts, lengths in characters and containment as df.

    ``queries`` is (qid, terms). Queries without terms and null contents match nothing.
    """
    asked = queries.select("qid", F.explode("terms").alias("term"))
    postings = chunks.select("chunk_id", F.explode(T.word_tokens(F.col("content"))).alias("term"))
    # Only the queries' terms go on, counted by chunk before they meet the queries, so that a term asked
    # for often isn't multiplied by its occurrences.
    counted = postings.join(asked.select("term").distinct(), "term", "left_semi").groupBy("chunk_id", "term").agg(F.count("*").alias("tf"))
    hits = counted.join(asked, "term").groupBy("qid", "chunk_id").agg(F.sum("tf").alias("hits"))
    best = _ranked(hits, [F.desc("hits"), F.asc("chunk_id")], most).select("qid", "chunk_id", F.col("rank").alias("first"))
    rows = best.join(chunks.select("chunk_id", F.lower("content").alias("body")), "chunk_id").join(queries.select("qid", "terms"), "qid")
    stats = rows.groupBy("qid").agg(F.avg(F.length("body")).alias("mean"), F.count("*").alias("n"))
    each = rows.withColumn("term", F.explode("terms")).withColumn("tf", T.occurrences(F.col("body"), F.col("term")))
    df = each.filter("tf > 0").groupBy("qid", "term").agg(F.count("*").alias("df"))
    each = each.filter("tf > 0").join(df, ["qid", "term"]).join(stats, "qid")
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.length("body") / F.col("mean")))
    scored = each.groupBy("qid", "chunk_id", "first").agg(F.round(F.sum(part), 6).alias("score"))
    return _ranked(scored, [F.desc("score"), F.asc("first")], most).select("qid", "chunk_id", "rank", "score")


def title_route(queries: DataFrame, chunks: DataFrame, most: int = CANDIDATES) -> DataFrame:
    """Chunks whose section, file name or tags hold one of the query's first four terms as a token."""
    asked = queries.select("qid", F.explode(F.slice("terms", 1, 4)).alias("term"))
    title = F.concat_ws(" ", "section", F.regexp_replace("filename", "[._]", " "), F.concat_ws(" ", "tags"))
    held = chunks.select("chunk_id", "document_id", "seq", F.explode(F.array_distinct(T.word_tokens(title))).alias("term"))
    hits = held.join(asked, "term").select("qid", "chunk_id", "document_id", "seq").distinct()
    return _ranked(hits, [F.asc("document_id"), F.asc("seq"), F.asc("chunk_id")], most).select("qid", "chunk_id", "rank", F.lit(1.0).alias("score"))


def vector_route(queries: DataFrame, vectors: DataFrame, most: int = CANDIDATES) -> DataFrame:
    """The ``most`` nearest vectors by cosine, exact, scores rounded to 6 digits, ties by id.

    ``queries`` is (qid, embedding), ``vectors`` (chunk_id, embedding), both of unit length. Query
    vectors go to the executors in blocks of QUERY_BLOCK; each batch of vectors is multiplied with the
    block and gives its own best ``most``, so only these are shuffled. Null vectors match nothing.
    """
    queries, vectors = queries.filter("embedding is not null"), vectors.filter("embedding is not null")
    spark, out = queries.sparkSession, None
    blocks = max(1, math.ceil(queries.count() / QUERY_BLOCK))
    for k in range(blocks):
        held = queries.filter(F.pmod(F.xxhash64("qid"), F.lit(blocks)) == k).toPandas()
        if held.empty:
            continue
        sent = spark.sparkContext.broadcast((held["qid"].to_numpy(), np.stack(held["embedding"].to_numpy()).astype(np.float64)))

        def nearest(c, sent=sent):
            qids, q = sent.value
            ids = np.asarray(c["chunk_id"])
            held = np.asarray(c["embedding"], np.float64).T
            out = {"qid": [], "chunk_id": [], "score": []}
            for a in range(0, len(q), TILE):
                scores = np.round(q[a : a + TILE] @ held, 6)
                k = max(0, scores.shape[1] - most)
                row, col = np.nonzero(scores >= np.partition(scores, k, axis=1)[:, k : k + 1])  # ties at the border too
                score = scores[row, col]
                order = np.lexsort((ids[col], -score, row))
                row, col, score = row[order], col[order], score[order]
                place = np.arange(len(row)) - np.searchsorted(row, row)
                keep = place < most
                out["qid"] += qids[a + row[keep]].tolist()
                out["chunk_id"] += ids[col[keep]].tolist()
                out["score"] += score[keep].tolist()
            return out

        kind = queries.schema["qid"].dataType.simpleString()
        part = arrow_map(vectors.select("chunk_id", "embedding"), nearest, f"qid {kind}, chunk_id long, score double")
        out = part if out is None else out.unionByName(part)
    if out is None:
        return queries.select("qid", F.lit(0).cast("long").alias("chunk_id"), F.lit(1).alias("rank"), F.lit(0.0).alias("score")).limit(0)
    return _ranked(out, [F.desc("score"), F.asc("chunk_id")], most).select("qid", "chunk_id", "rank", "score")


def best_of_variants(routes: DataFrame, most: int = CANDIDATES) -> DataFrame:
    """One route from those of several variants of a query: a chunk's best score, ranked anew."""
    best = routes.groupBy("qid", "chunk_id").agg(F.greatest(F.max("score"), F.lit(0.0)).alias("score"))
    return _ranked(best, [F.desc("score"), F.asc("chunk_id")], most).select("qid", "chunk_id", "rank", "score")


def fuse(routes: dict[str, DataFrame], k: int = RRF_K) -> DataFrame:
    """Reciprocal rank fusion: ``(qid, chunk_id, score, routes, keyword_hit, similarity)``, routes being how
    many found it, and similarity that of the vector route (0 where it didn't)."""
    every = reduce(DataFrame.unionByName, [r.select("qid", "chunk_id", "rank", "score" if "score" in r.columns else F.lit(0.0).alias("score"), F.lit(name).alias("route")) for name, r in routes.items()])
    return every.groupBy("qid", "chunk_id").agg(
        F.round(F.sum(1.0 / (k + F.col("rank"))), 8).alias("score"), F.count("*").alias("routes"), F.max(F.col("route") == "keyword").alias("keyword_hit"),
        F.coalesce(F.max(F.when(F.col("route") == "vector", F.col("score").cast("double"))), F.lit(0.0)).alias("similarity"))


def top(fused: DataFrame, most: int = TOP) -> DataFrame:
    return _ranked(fused, [F.desc("score"), F.asc("chunk_id")], most)


def one_per_parent(ranked: DataFrame, chunks: DataFrame) -> DataFrame:
    """The best chunk of each parent passage, with the passage as its text where there is one."""
    rows = ranked.join(chunks.select("chunk_id", "document_id", "parent_seq", "content", "parent_content"), "chunk_id")
    first = Window.partitionBy("qid", "document_id", "parent_seq").orderBy("rank")
    return rows.withColumn("_n", F.row_number().over(first)).filter("_n = 1").select("qid", "chunk_id", "rank", F.coalesce("parent_content", "content").alias("text"))


def with_neighbours(ranked: DataFrame, chunks: DataFrame, width: int = 1) -> DataFrame:
    """Each chunk's text with those up to ``width`` places before and after it in its document."""
    place = chunks.select("chunk_id", "document_id", "index_version", "seq")
    wanted = ranked.join(place, "chunk_id").withColumn("near", F.explode(F.sequence(F.col("seq") - width, F.col("seq") + width)))
    other = chunks.select("document_id", "index_version", F.col("seq").alias("near"), "content")
    rows = wanted.join(other, ["document_id", "index_version", "near"])
    merged = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("near", "content"))), lambda x: x["content"]), "\n")
    return rows.groupBy("qid", "chunk_id", "rank").agg(merged.alias("text"), F.count("*").alias("pieces"))


def rule_rerank(fused: DataFrame, queries: DataFrame, chunks: DataFrame) -> DataFrame:
    """Score plus 0.03 for each term in file name or section and 0.01 for each in the content, less
    0.25 for a second and further chunk of the same text."""
    rows = fused.join(chunks.select("chunk_id", "content", F.lower(F.concat_ws(" ", "filename", "section")).alias("title")), "chunk_id").join(queries.select("qid", "terms"), "qid")
    count = lambda where: F.size(F.filter("terms", lambda t: F.contains(where, t)))
    again = F.row_number().over(Window.partitionBy("qid", F.md5(T.squeezed(F.col("content")))).orderBy(F.desc("score"), "chunk_id")) > 1
    score = F.col("score") + 0.03 * count(F.col("title")) + 0.01 * count(F.lower("content")) - F.when(again, 0.25).otherwise(0.0)
    rows = rows.withColumn("score", F.round(score, 6)).select("qid", "chunk_id", "score")
    return _ranked(rows, [F.desc("score"), F.asc("chunk_id")], CANDIDATES * 4)
