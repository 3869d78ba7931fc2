"""The whole path from questions to checked context, for a batch of questions, and from files to an index."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ferrule.functions import text as T
from ferrule.operators import chunk, context, evidence, graph, index, retrieve, route
from ferrule.runtime import written


@dataclass(frozen=True)
class Profile:
    """Which routes and steps a search takes."""

    keyword: bool = True
    vector: bool = True
    title: bool = True
    graph: bool = False
    hops: int = 1  # an edge joins terms of one chunk, so further hops leave the questions' own terms
    rerank: bool = False
    parents: bool = False
    neighbours: int = 0
    top: int = retrieve.TOP
    candidates: int = retrieve.CANDIDATES
    policy: str = "downweight"


PROFILES = {
    "hybrid": Profile(), "vector": Profile(keyword=False), "flat": Profile(keyword=False), "keyword": Profile(vector=False), "graph": Profile(graph=True),
    "hybrid_rerank": Profile(rerank=True), "parent_child": Profile(parents=True), "neighbours": Profile(neighbours=1),
    "multi_query": Profile(), "hyde": Profile(),
}


def search_auto(questions: DataFrame, chunks: DataFrame, vectors: DataFrame | None = None, bases: DataFrame | None = None, **more) -> DataFrame:
    """``search`` of each question (qid, question[, embedding]) by the profile its words ask for, within the base
    it names; social talk finds nothing. Every profile searches its own questions."""
    asked = questions.withColumnRenamed("qid", "id")
    chosen = written(route.route(asked.select("id", "question"), bases=bases).select(F.col("id").alias("qid"), "mode", F.col("kb_id").alias("base")), "routes")
    modes = [r["mode"] for r in chosen.select("mode").distinct().toLocalIterator() if r["mode"] != "none"]  # five at most
    out = [search(questions.join(chosen.filter(F.col("mode") == m).select("qid"), "qid", "left_semi"), chunks, vectors, m, **more) for m in modes]
    if not out:
        return search(questions.limit(0), chunks, vectors, "hybrid", **more)
    found = reduce(DataFrame.unionByName, out)
    inside = found.join(chosen.select("qid", "base"), "qid").join(chunks.select("chunk_id", "kb_id"), "chunk_id").filter("base is null or base = kb_id")
    return inside.select(*found.columns)


def search(questions: DataFrame, chunks: DataFrame, vectors: DataFrame | None = None, profile: str | Profile = "hybrid", variants: DataFrame | None = None,
           cross_encoder: Callable[[DataFrame], DataFrame] | None = None, **changes) -> DataFrame:
    """``(qid, chunk_id, rank, score, routes, text)``: the best chunks of each question.

    ``questions`` is (qid, question[, embedding]); without embeddings, or without ``vectors``
    (chunk_id, embedding), the vector route is left out. ``chunks`` come from ``visible_chunks``.
    ``variants`` (qid, embedding) are further forms of a question (multi_query), or a made answer to it (hyde),
    which takes the place of its own embedding there. ``cross_encoder`` scores (qid, chunk_id, score, question,
    text) anew; without one the scores stay.
    """
    p = replace(PROFILES[profile] if isinstance(profile, str) else profile, **changes)
    asked = questions.select("qid", T.keywords(T.clean_query(F.col("question"))).alias("terms"))
    routes = {}
    if p.keyword:
        routes["keyword"] = retrieve.keyword_route(asked, chunks, p.candidates)
    if p.title:
        routes["title"] = retrieve.title_route(asked, chunks, p.candidates)
    if p.vector and vectors is not None and "embedding" in questions.columns:
        seen = vectors.join(chunks.select("chunk_id"), "chunk_id", "left_semi")
        own = questions.select("qid", "embedding")
        if variants is not None:
            forms = variants.select("qid", "embedding").join(own.select("qid"), "qid", "left_semi")
            # Where there is a made answer the question's own vector is not asked for.
            forms = own.join(forms.select("qid"), "qid", "left_anti").unionByName(forms) if profile == "hyde" else own.unionByName(forms)
            # Each form is a query of its own; a chunk's best score over the forms counts.
            forms = forms.withColumn("form", F.to_json(F.struct(F.col("qid").alias("q"), F.row_number().over(Window.partitionBy("qid").orderBy(F.to_json("embedding"))).alias("n"))))
            each = retrieve.vector_route(forms.select(F.col("form").alias("qid"), "embedding"), seen, p.candidates)
            kind = questions.schema["qid"].dataType.simpleString()
            routes["vector"] = retrieve.best_of_variants(each.withColumn("qid", F.get_json_object("qid", "$.q").cast(kind)), p.candidates)
        else:
            routes["vector"] = retrieve.vector_route(own, seen, p.candidates)
    if p.graph:
        found = graph.recall(asked.select("qid", F.explode("terms").alias("name")).distinct(), graph.entities(chunks), p.hops)
        routes["graph"] = retrieve.top(found.select("qid", "chunk_id", (-F.col("hop")).alias("score")), p.candidates)
    # A few rows a question, each needed several times below: written once, so that no route runs twice.
    fused = written(retrieve.fuse(routes), "fused")
    if p.rerank:
        scored = retrieve.rule_rerank(fused, asked, chunks).select("qid", "chunk_id", "score").join(fused.select("qid", "chunk_id", "routes"), ["qid", "chunk_id"])
    else:
        scored = fused
    if cross_encoder is not None:
        texts = scored.join(chunks.select("chunk_id", F.col("content").alias("text")), "chunk_id").join(questions.select("qid", "question"), "qid")
        scored = cross_encoder(texts).select("qid", "chunk_id", "score", "routes")
    if p.policy != "allow":
        texts = scored.join(chunks.select("chunk_id", F.col("content").alias("text")), "chunk_id")
        scored = evidence.apply_policy(texts, p.policy).drop("text")
    best = written(retrieve.top(scored, p.top), "best")
    if p.parents:
        text = retrieve.one_per_parent(best.select("qid", "chunk_id", "rank"), chunks)
    elif p.neighbours:
        text = retrieve.with_neighbours(best.select("qid", "chunk_id", "rank"), chunks, p.neighbours).drop("pieces")
    else:
        text = best.select("qid", "chunk_id", "rank").join(chunks.select("chunk_id", F.col("content").alias("text")), "chunk_id")
    return best.select("qid", "chunk_id", "score", "routes").join(text, ["qid", "chunk_id"]).select("qid", "chunk_id", "rank", "score", "routes", "text")


def answer_context(found: DataFrame, questions: DataFrame, tokens: int = context.TOKENS) -> DataFrame:
    """``(qid, chunk_id, place, text)``: the compressed texts that fit the budget, in reading order."""
    asked = questions.select("qid", T.keywords(F.col("question"), 12).alias("terms"))
    short = found.join(asked, "qid").withColumn("text", context.compress(F.col("text"), F.col("terms")))
    kept = context.budgeted(short.select("qid", "rank", "chunk_id", "text"), tokens).select("qid", "chunk_id")
    return context.lost_in_middle(short.join(kept, ["qid", "chunk_id"])).select("qid", "chunk_id", "place", "text")


def build_index(segments: DataFrame, version: int, config: str = "512/64/recursive", previous: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Chunks of a new index version from (document_id, seq, text) segments, and those of them that the
    ``previous`` chunks hold already and that need no new embedding. Ids come from the place and the
    content, so that a repeated run writes the same rows."""
    size, overlap, strategy = config.split("/")
    keyed = segments.select(F.to_json(F.struct("document_id", "seq")).alias("key"), "text")
    pieces = chunk.chunks(keyed, "key", "text", strategy, int(size), int(overlap))
    place = F.from_json("id", "document_id string, seq int")
    rows = pieces.select(place["document_id"].alias("document_id"), place["seq"].alias("parent_seq"), F.col("seq").alias("part"), "content")
    rows = rows.select("document_id", (F.col("parent_seq") * 100_000 + F.col("part")).alias("seq"), "parent_seq", F.lit(version).alias("index_version"), "content",
                       F.md5(F.concat_ws("|", "document_id", "parent_seq", "part", F.lit(version), "content")).alias("chunk_id"))
    if previous is None:
        return rows, rows.limit(0)
    both = previous.select("document_id", "seq", "index_version", "content").unionByName(rows.select("document_id", "seq", "index_version", "content"))
    before = previous.agg(F.max("index_version")).first()[0]
    return rows, index.reusable(both, version, before if before is not None else version)
