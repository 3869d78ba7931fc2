"""Further queries of the core, each over its whole tables, with their SQL: membership, the life of an ingestion,
metrics, and what surrounds a model's answer."""

from __future__ import annotations

from pyspark.sql import functions as F

from ferrule.functions import clean
from ferrule.operators import answers, evaluate, ingest, operations, retrieve
from ferrule.plans import search
from ferrule.plans.catalog import _ASKED, _FUSED, _ROLE, _TOP, _asked, _fused, _questions, query
from ferrule.runtime import table

NOW = "2025-06-01 00:00:00"
_NOW = f"TIMESTAMPTZ '{NOW}+00'"


def _now():
    return F.lit(NOW).cast("timestamp")


# Who sees what


@query(f"""WITH m AS (SELECT DISTINCT workspace_id, owner_id AS user_id, {_ROLE} AS role FROM knowledge_bases), u AS (SELECT min(user_id) AS u FROM m),
 q AS (SELECT document_id FROM kb_documents WHERE size_bytes % 11 = 0)
 SELECT chunk_id FROM (SELECT c.chunk_id, row_number() OVER (PARTITION BY c.document_id, c.seq, c.index_version ORDER BY c.created_at DESC NULLS LAST, c.chunk_id DESC) AS n FROM structured_chunks c
  JOIN kb_documents d ON c.document_id = d.document_id AND c.kb_id = d.kb_id AND c.index_version = d.active_index_version JOIN knowledge_bases k ON k.kb_id = d.kb_id
  WHERE d.status NOT IN ('deleting', 'deleted') AND k.workspace_id IN (SELECT workspace_id FROM m, u WHERE user_id = u) AND d.document_id NOT IN (SELECT document_id FROM q)) WHERE n = 1""")
def visible_to_member(spark, d):
    bases = table(spark, d, "knowledge_bases")
    members = bases.select("workspace_id", F.col("owner_id").alias("user_id")).distinct()
    docs = table(spark, d, "kb_documents")
    user = members.agg(F.min("user_id")).first()[0] or ""
    return retrieve.visible_chunks(table(spark, d, "structured_chunks"), docs, bases, members, user, quarantined=docs.filter("size_bytes % 11 = 0")).select("chunk_id")


@query("SELECT c.chunk_id, d.source_type, d.department FROM structured_chunks c JOIN kb_documents d USING (document_id) WHERE c.content_type = 'text' AND d.source_type IN ('api', 'url') AND d.department IN ('财务', 'Finance', '研发')")
def document_filter(spark, d):
    docs = table(spark, d, "kb_documents").select("document_id", "source_type", "department")
    rows = table(spark, d, "structured_chunks").join(docs, "document_id")
    return retrieve.with_metadata(rows, ["text"], source_types=["api", "url"], departments=["财务", "Finance", "研发"]).select("chunk_id", "source_type", "department")


@query()
def search_auto(spark, d):
    """Every question by the profile its words ask for, within the base it names."""
    return search.search_auto(*_questions(spark, d), bases=table(spark, d, "knowledge_bases"), policy="allow").select("qid", "chunk_id", "rank", "score")


@query()
def search_multi_query(spark, d):
    """Each question with the next two vectors as further forms of it."""
    asked, chunks, vectors = _questions(spark, d)
    forms = vectors.filter("chunk_id % 20 in (1, 2)").select((F.col("chunk_id") - F.col("chunk_id") % 20).alias("qid"), "embedding")
    return search.search(asked, chunks, vectors, "multi_query", variants=forms).select("qid", "chunk_id", "rank", "score")


@query()
def text_clean(spark, d):
    """Every segment's text, cleaned whole; compatibility forms are beyond the SQL."""
    return clean.cleaned(table(spark, d, "parsed_segments"), "segment_id", "text").withColumnRenamed("id", "segment_id")


# The life of an ingestion. A file's number of chunks stands for its attempts.


def _jobs(spark, d):
    return table(spark, d, "kb_documents").select(F.col("document_id").alias("job_id"), "status", "created_at", F.col("updated_at").alias("next_retry_at"), F.lit(None).cast("timestamp").alias("lease_until"), (F.coalesce("chunk_count", F.lit(0)) % 5).alias("attempts"))


@query(f"""SELECT document_id AS job_id, 'parsing' AS status, CAST(coalesce(chunk_count, 0) % 5 + 1 AS BIGINT) AS attempts FROM kb_documents WHERE status IN ('uploaded', 'queued', 'retrying') AND (updated_at IS NULL OR updated_at <= {_NOW})
 ORDER BY created_at ASC NULLS FIRST, document_id LIMIT 50""")
def ingest_claim(spark, d):
    return ingest.claimed(_jobs(spark, d), _now()).select("job_id", "status", F.col("attempts").cast("long").alias("attempts"))


@query(f"""SELECT document_id AS job_id, CASE WHEN coalesce(chunk_count, 0) % 5 >= 3 THEN 'failed' ELSE 'retrying' END AS status, coalesce(chunk_count, 0) % 5 >= 3 AS dead,
 CASE WHEN coalesce(chunk_count, 0) % 5 < 3 THEN CAST(least(300, 2 * pow(2, greatest(coalesce(chunk_count, 0) % 5 - 1, 0))) AS BIGINT) END AS pause FROM kb_documents WHERE status IN ('failed', 'retrying')""")
def ingest_retry(spark, d):
    rows = ingest.after_failure(_jobs(spark, d).filter("status in ('failed', 'retrying')"), _now())
    return rows.select("job_id", "status", "dead", (F.unix_timestamp("next_retry_at") - F.unix_timestamp(_now())).alias("pause"))


_STAGE = "CASE event_type WHEN 'view' THEN 'queued' WHEN 'click' THEN 'parsing' WHEN 'signup' THEN 'chunking' WHEN 'purchase' THEN 'embedding' ELSE 'failed' END"


@query()
def ingest_advance(spark, d):
    """A user's events are the moves of one job; moves that its state does not allow are refused."""
    moves = table(spark, d, "events").select(F.col("user_id").alias("job_id"), F.col("ts").cast("timestamp").alias("at"), F.expr(_STAGE).alias("to_status"))
    return ingest.advanced(moves).select("job_id", "to_status", "status", (F.col("to_status") == F.col("status")).alias("allowed"))


@query("SELECT chunk_id FROM structured_chunks t WHERE index_version != 2 OR EXISTS (SELECT 1 FROM structured_chunks o WHERE o.index_version = 1 AND o.document_id = t.document_id AND o.seq = t.seq AND o.content = t.content)")
def checkpoint_delete(spark, d):
    from ferrule.operators import index

    chunks = table(spark, d, "structured_chunks")
    return ingest.kept_checkpoint(chunks, 2, index.reusable(chunks, 2, 1)).select("chunk_id")


@query("SELECT 'documents' AS kind, count(*) AS n FROM kb_documents WHERE kb_id IS NULL OR kb_id NOT IN (SELECT kb_id FROM knowledge_bases WHERE department = '法务') UNION ALL SELECT 'chunks', count(*) FROM structured_chunks WHERE document_id IS NULL OR document_id NOT IN (SELECT document_id FROM kb_documents WHERE kb_id IN (SELECT kb_id FROM knowledge_bases WHERE department = '法务'))")
def cascade_delete(spark, d):
    bases = table(spark, d, "knowledge_bases")
    _, docs, chunks = ingest.cascaded(bases, table(spark, d, "kb_documents"), table(spark, d, "structured_chunks"), bases.filter("department = '法务'"))
    return docs.agg(F.count("*").alias("n")).select(F.lit("documents").alias("kind"), "n").unionByName(chunks.agg(F.count("*").alias("n")).select(F.lit("chunks").alias("kind"), "n"))


@query("SELECT event_id, ts < (SELECT max(ts) FROM events) - INTERVAL 10 DAYS AS archived FROM events")
def retention_purge(spark, d):
    events = table(spark, d, "events")
    kept, old = ingest.purged(events, "ts", F.lit(events.agg(F.max("ts")).first()[0]).cast(events.schema["ts"].dataType), 10)
    return kept.select("event_id", F.lit(False).alias("archived")).unionByName(old.select("event_id", F.lit(True).alias("archived")))


@query("SELECT event_id FROM events WHERE event_id % 3 != 0 UNION SELECT event_id FROM events WHERE event_id % 2 = 0")
def log_append(spark, d):
    events = table(spark, d, "events").select("event_id", "event_type")
    return ingest.appended(events.filter("event_id % 3 != 0"), events.filter("event_id % 2 = 0"), "event_id").select("event_id")


# Metrics


@query(f"""{_TOP}, got AS (SELECT t.qid, v.filename AS document, min(t.rank) AS rank FROM top t JOIN visible v USING (chunk_id) GROUP BY 1, 2), want AS (SELECT DISTINCT CAST(regexp_extract(id, '[0-9]+$') AS BIGINT) AS qid, unnest(expected_documents) AS document FROM golden_set WHERE CAST(regexp_extract(id, '[0-9]+$') AS BIGINT) % 20 = 0),
 n AS (SELECT qid, count(*) AS n FROM want GROUP BY qid), h AS (SELECT qid, count(*) AS hits, sum(1 / log2(rank + 1.0)) AS dcg FROM got JOIN want USING (qid, document) GROUP BY qid)
 SELECT a.qid, CASE WHEN n > 0 THEN round(coalesce(hits, 0) / n, 6) END AS recall, CASE WHEN n > 0 THEN round(coalesce(dcg, 0.0) / list_sum(list_transform(range(1, least(n, 5) + 1), lambda i: 1 / log2(i + 1.0))), 6) END AS ndcg
 FROM (SELECT DISTINCT qid FROM asked) a LEFT JOIN n USING (qid) LEFT JOIN h USING (qid)""")
def eval_documents(spark, d):
    fused, _, chunks = _fused(spark, d)
    got = retrieve.top(fused).join(chunks.select("chunk_id", F.col("filename").alias("document")), "chunk_id")
    number = F.regexp_extract("id", "[0-9]+$", 0).cast("long")
    wanted = table(spark, d, "golden_set").select(number.alias("qid"), F.col("expected_documents").alias("expected")).filter("qid % 20 = 0")
    return evaluate.document_metrics(got, wanted)


@query("SELECT event_type, quantile_disc(value, 0.95) AS value FROM events GROUP BY event_type")
def latency_p95(spark, d):
    return evaluate.percentile(table(spark, d, "events"), "event_type", "value", 0.95)


_SCORES = "CASE user_id % 2 WHEN 0 THEN 'rag' ELSE 'agent' END"


@query(f"SELECT {_SCORES} AS variant, event_type AS dimension, count(value) AS cases, CAST(round(avg(CAST(value AS DECIMAL(18,6))), 4) AS DOUBLE) AS mean FROM events GROUP BY 1, 2")
def judge_means(spark, d):
    rows = table(spark, d, "events").select(F.expr(_SCORES).alias("variant"), F.col("event_type").alias("dimension"), "value")
    return evaluate.group_means(rows, "variant", "dimension", "value")


@query(f"""WITH m AS (SELECT {_SCORES} AS variant, event_type AS dimension, CAST(round(avg(CAST(value AS DECIMAL(18,6))), 4) AS DOUBLE) AS mean FROM events GROUP BY 1, 2)
 SELECT dimension, a.mean AS one, b.mean AS other, round(b.mean - a.mean, 4) AS gain FROM (SELECT * FROM m WHERE variant = 'rag') a FULL JOIN (SELECT * FROM m WHERE variant = 'agent') b USING (dimension)""")
def variants_compared(spark, d):
    return evaluate.compared(judge_means(spark, d), "variant", "dimension", "rag", "agent")


@query("""WITH b AS (SELECT b AS upper, count(*) FILTER (value <= b) AS n FROM events, (SELECT unnest([1.0, 5.0, 10.0, 50.0, 100.0, 'inf'::DOUBLE]) AS b) GROUP BY b),
 w AS (SELECT upper, n, coalesce(lag(upper) OVER (ORDER BY upper), 0.0) AS low, coalesce(lag(n) OVER (ORDER BY upper), 0) AS below, max(n) OVER () * 0.9::DOUBLE AS want FROM b)
 SELECT round(CASE WHEN upper = 'inf'::DOUBLE THEN low ELSE low + (upper - low) * (want - below) / (n - below) END, 6) AS value FROM w WHERE n >= want AND n > 0 ORDER BY upper LIMIT 1""")
def latency_quantile(spark, d):
    return operations.histogram_quantile(operations.histogram(table(spark, d, "events"), "value", [1.0, 5.0, 10.0, 50.0, 100.0]), 0.9)


@query("""WITH r AS (SELECT event_type, ts, value, lag(value) OVER (PARTITION BY event_type, user_id ORDER BY ts, value) AS before, user_id FROM events)
 SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, user_id, CAST(sum(CAST(CASE WHEN before IS NULL THEN 0.0 WHEN value >= before THEN value - before ELSE value END AS DECIMAL(18,4))) AS DOUBLE) AS increase
 FROM (SELECT ts, value, user_id, lag(value) OVER (PARTITION BY user_id ORDER BY ts, value) AS before FROM events) GROUP BY 1, 2""")
def counter_increase(spark, d):
    return operations.increase(table(spark, d, "events").select("ts", "user_id", "value"), "user_id")


@query("SELECT 'documents' AS entity, count(*) AS n FROM documents UNION ALL SELECT 'chunks', count(*) FROM structured_chunks UNION ALL SELECT 'segments', count(*) FROM parsed_segments UNION ALL SELECT 'files', count(*) FROM kb_documents UNION ALL SELECT 'bases', count(*) FROM knowledge_bases")
def entity_counts(spark, d):
    names = {"documents": "documents", "chunks": "structured_chunks", "segments": "parsed_segments", "files": "kb_documents", "bases": "knowledge_bases"}
    parts = [table(spark, d, t).agg(F.count("*").alias("n")).select(F.lit(k).alias("entity"), "n") for k, t in names.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query("SELECT document_id, status, CAST(row_number() OVER (ORDER BY updated_at DESC NULLS LAST, document_id) AS BIGINT) AS place FROM kb_documents ORDER BY updated_at DESC NULLS LAST, document_id LIMIT 50")
def list_documents(spark, d):
    """The latest files, those without a time last: a page of fifty."""
    rows = table(spark, d, "kb_documents").orderBy(F.desc_nulls_last("updated_at"), "document_id").limit(50)
    from pyspark.sql import Window

    return rows.select("document_id", "status", F.row_number().over(Window.orderBy(F.desc_nulls_last("updated_at"), "document_id")).cast("long").alias("place"))


@query("SELECT chunk_id FROM structured_chunks ORDER BY md5(CAST(chunk_id AS VARCHAR)), chunk_id LIMIT 100")
def chunk_sample(spark, d):
    """A random sample of a hundred chunks that comes out the same every time."""
    return table(spark, d, "structured_chunks").select("chunk_id").orderBy(F.md5(F.col("chunk_id").cast("string")), "chunk_id").limit(100)


# Around a model's answer

_LABEL = "concat_ws(' · ', filename, CASE WHEN page != 0 THEN '第 ' || page || ' 页' END, CASE WHEN length(section) > 0 THEN '章节: ' || section END, CASE WHEN NOT coalesce(page != 0, false) AND NOT coalesce(length(section) > 0, false) THEN '第 ' || (seq + 1) || ' 段' END, CASE WHEN length(source_url) > 0 THEN 'URL: ' || source_url END)"


@query(f"""{_TOP}, x AS (SELECT t.qid, string_agg('<untrusted_document source_id="' || t.rank || '" source="' || {_LABEL} || '">' || chr(10) || v.content || chr(10) || '</untrusted_document>', chr(10) || chr(10) ORDER BY t.rank) AS context FROM top t JOIN visible v USING (chunk_id) GROUP BY t.qid)
 SELECT qid, coalesce(context, '{answers.NOTHING}') AS context FROM asked LEFT JOIN x USING (qid)""")
def prompt_context(spark, d):
    fused, asked, chunks = _fused(spark, d)
    label = answers.source_label(*[F.col(x) for x in ("filename", "page", "section", "seq", "source_url")])
    texts = retrieve.top(fused).join(chunks.select("chunk_id", label.alias("label"), F.col("content").alias("text")), "chunk_id").filter("text is not null")
    return answers.prompt_context(texts, asked)


@query("SELECT event_id, CAST(round_even(CAST(json_extract_string(props, '$.k') AS BIGINT) * 0.5 + user_id * 1.5, 0) AS BIGINT) AS micro FROM events")
def usage_cost(spark, d):
    return table(spark, d, "events").select("event_id", answers.cost_micro(F.get_json_object("props", "$.k").cast("long"), F.col("user_id"), 0.5, 1.5).alias("micro"))


@query("SELECT event_id, CAST(CAST(json_extract_string(props, '$.k') AS BIGINT) AS DOUBLE) AS k, true AS shaped FROM events")
def model_json(spark, d):
    text = F.concat(F.lit("Here it is: "), F.col("props"), F.lit(" as asked."))
    return table(spark, d, "events").select("event_id", answers.json_number(text, "k").alias("k"), answers.has_shape(F.col("props"), "k double").alias("shaped"))


@query(f"WITH {_FUSED}, top AS (SELECT qid, chunk_id, row_number() OVER (PARTITION BY qid ORDER BY score DESC, chunk_id) AS rank FROM fused) SELECT qid, chunk_id, row_number() OVER (PARTITION BY qid ORDER BY CASE rank WHEN 3 THEN 1 WHEN 1 THEN 2 ELSE 9 END, rank) AS rank FROM top WHERE rank <= 5")
def model_rerank(spark, d):
    """A model that puts the third first, then the first, names the third again and one that isn't there."""
    fused, asked, _ = _fused(spark, d)
    order = asked.select("qid", F.posexplode(F.array(F.lit(3), F.lit(1), F.lit(3), F.lit(99))).alias("place", "index"))
    return answers.reordered(retrieve.top(fused).select("qid", "chunk_id", "rank"), order).select("qid", "chunk_id", F.col("rank").cast("long").alias("rank"))


@query(f"WITH {_ASKED}, p AS (SELECT qid, terms, lag(terms) OVER (ORDER BY qid) AS before FROM asked) SELECT qid, array_to_string(list_filter(terms, lambda t: list_contains(coalesce(before, []), t)), ',') AS kept FROM p")
def keyword_carry_over(spark, d):
    """The terms that a question shares with the one before it."""
    from pyspark.sql import Window

    asked = _asked(spark, d).select("qid", "terms")
    before = F.lag("terms").over(Window.partitionBy(F.lit(1)).orderBy("qid"))  # a conversation's questions, every 20th of the golden set
    return asked.select("qid", F.array_join(answers.carried_over(F.col("terms"), before), ",").alias("kept"))
