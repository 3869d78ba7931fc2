"""Streams over several files and micro-batches, guarded queries, memories, citations, routes, ranges."""

import random

import pytest
from conftest import SMALL
from pyspark.sql import functions as F

from ferrule.operators import chunk, conversation, evidence, graph, margins, operations, retrieve, route
from ferrule.sources import parse
from ferrule.streaming import events


@pytest.fixture(scope="module")
def three_files(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("events")
    spark.read.parquet(f"{SMALL}/events.parquet").repartition(3, "event_id").write.parquet(str(folder / "events.parquet"))
    return str(folder)


def test_streams_over_three_batches(spark, three_files):
    batch = spark.read.parquet(f"{SMALL}/events.parquet")
    want = {r.user_id: (r.n, r.t) for r in batch.groupBy("user_id").agg(F.count("*").alias("n"), F.max_by("event_type", "event_id").alias("t")).collect()}
    state = events.run_to_table(events.latest_state(events.event_stream(spark, three_files), late="3650 days"), "update", ["user_id"])
    assert {r.user_id: (r.n, r.last_type) for r in state.collect()} == want
    once = events.run_to_table(events.once_each(events.event_stream(spark, three_files), "event_id", late="3650 days"), "append")
    assert sorted(r.event_id for r in once.collect()) == sorted(r.event_id for r in batch.select("event_id").distinct().collect())
    windows = events.run_to_table(events.windowed_counts(events.event_stream(spark, three_files), late="3650 days"))
    assert windows.agg(F.sum("events")).first()[0] == batch.count()


def test_update_needs_keys_and_empty_streams_give_empty_tables(spark, tmp_path):
    spark.read.parquet(f"{SMALL}/events.parquet").limit(0).write.parquet(str(tmp_path / "events.parquet"))
    stream = events.event_stream(spark, str(tmp_path))
    with pytest.raises(ValueError):
        events.run_to_table(stream, "update")
    assert events.run_to_table(events.once_each(stream, "event_id"), "append").count() == 0


@pytest.mark.parametrize("sql", ["with t as (select 1 as a) insert into read_only select * from t", "insert into read_only select 1", "select 1; select 2", "drop table read_only", "with t as (select 1 as a) insert overwrite read_only select * from t", "describe read_only", ""])
def test_only_select_is_run(spark, sql):
    spark.range(3).selectExpr("cast(id as int) as a").createOrReplaceTempView("read_only")
    with pytest.raises(ValueError):
        parse.read_query(spark, sql)
    assert parse.read_query(spark, "with t as (select a from read_only where a > 0) select count(*) as n from t").first().n == 2


def test_fixed_chunks_are_those_of_split(spark):
    texts = ["  a\t\tb \r\n\r\n\r\n\r\nc " + "x y " * 400, "", None, "   ", "short", "　wide　"]
    rows = chunk.chunks(spark.createDataFrame(list(enumerate(texts)), "i long, t string"), "i", "t", "fixed").collect()
    for i, t in enumerate(texts):
        assert [r.content for r in sorted(rows, key=lambda r: r.seq) if r.id == i] == chunk.split(t, "fixed"), t


def test_lasting_statements_come_without_a_shared_token(spark):
    texts = ["记住我喜欢简短的回答", "今天的天气很好", "my password: hunter2 and I prefer tea", "今天的天气很好", "what do you know", "报销流程在哪里", "x" * 590, "y" * 590, "z" * 590, "w" * 590]
    found = spark.createDataFrame([(i, i, t) for i, t in enumerate(texts)] + [(99, 99, None), (98, 98, "  ")], "message_id long, recency long, text string")
    asked = spark.createDataFrame([(1, "报销流程怎么走"), (2, "What do you know"), (3, "还记得我吗"), (4, None)], "qid long, question string")
    got = {}
    for r in sorted(conversation.rank_memories(found, asked).collect(), key=lambda r: (r.qid, r["rank"])):
        got.setdefault(r.qid, []).append(r)
    assert [r.message_id for r in got[1]][:3] == [5, 0, 2] and [r["rank"] for r in got[1]] == list(range(1, len(got[1]) + 1))
    assert "hunter2" not in "".join(r.text for r in got[1]) and sum(len(r.text) + 3 for r in got[1]) <= 1800
    assert 4 not in {r.message_id for r in got[2]}  # the question itself
    assert got[3][0].message_id == 0 and got[3][0].score == pytest.approx(4 + 1 + 3, abs=0.01)
    assert 1 not in [r.message_id for r in got[1]] or 3 not in [r.message_id for r in got[1]]
    assert conversation.rank_memories(found.limit(0), asked).count() == conversation.rank_memories(found, asked.limit(0)).count() == 0


@pytest.mark.parametrize("budget", [40, 1_800, 1 << 40])
def test_memories_without_pairs(spark, budget):
    """Every message shares a token with every question; what leaves the tasks doesn't grow with the pairs."""
    r = random.Random(4)
    words = "always use the 报销流程 report budget 仓库盘点 depot list port 审批".split()
    say = lambda n: " ".join(["common", *(r.choice(words) for _ in range(n))])
    texts = [say(r.choice((1, 2, 3, 5, 9, 90))) for _ in range(3_000)]
    found = spark.createDataFrame(list(enumerate(texts)), "recency int, text string").select(F.col("recency").alias("message_id"), "recency", "text").repartition(3)
    said = [say(4), say(2), "remember me " + say(3), texts[0], texts[0]]
    result = conversation.rank_memories(found, spark.createDataFrame(list(enumerate(said)), "qid int, question string"), budget=budget)
    assert "explode" not in result._jdf.queryExecution().optimizedPlan().toString()
    got = {}
    for x in sorted(result.collect(), key=lambda x: (x.qid, x["rank"])):
        got.setdefault(x.qid, []).append((x.message_id, x.score))
    first = {}
    for i, t in enumerate(texts):
        first.setdefault(t.strip()[:600].lower(), i)
    for q, question in enumerate(said):
        rows = []
        for key, i in first.items():
            lasting = any(s in key for s in conversation.LASTING)
            shared = len(conversation.python_tokens(key) & conversation.python_tokens(question.lower()))
            if key != question.lower():
                rows.append((-round(5 * shared + 4 * lasting + (1 - i / 3_000) + 3 * (lasting and "remember me" in question), 6), i, len(key) + 3))
        want, used = [], 0
        for score, i, size in sorted(rows):
            if len(want) < 6 and not (want and used + size > budget):
                want.append((i, pytest.approx(-score)))
                used += size
        assert got[q] == want
    held = spark.createDataFrame([(i, t, 0.5, False, i) for i, t in enumerate(texts)], "message_id int, text string, base double, lasting boolean, recency int").repartition(3)
    rows = conversation.reminded(held, [(q, x, False, ["common"]) for q, x in enumerate(said)], 6, False).groupBy("num").count().collect()
    assert len(rows) == len(said) and all(x["count"] <= 3 * 7 for x in rows)


def test_recency_over_ranges(spark):
    rows = spark.range(500).selectExpr("id as message_id", "'t' as text", "timestamp_seconds(id % 7) as at")
    got = {r.message_id: r.recency for r in conversation.by_recency(rows, "at").collect()}
    want = sorted(range(500), key=lambda i: (-(i % 7), -i))
    assert [got[i] for i in want] == list(range(500))


@pytest.mark.parametrize(("answer", "sources", "want"), [
    ("Claim one is here [1]\nNo source for this line\nClaim [9] is out of range", 3, "Claim one is here [1]"),
    ("# Head\n> quote\n---\n技术栈：\n- item with text and no number", 2, "# Head\n> quote\n---\n技术栈："),
    ("```\ncode without a source\n```\nText [2]", 2, "Text [2]"), ("```\nx = 1 [1]\n```", 1, "```\nx = 1 [1]\n```"),
    ("A label that is far too long to be one:\nok [1] and [2]", 1, ""), ("all good [1]", 0, ""), (None, 3, ""), ("", 3, "")])
def test_repair_citations(answer, sources, want):
    assert evidence.repair_citations(answer, sources) == want


def test_list_items_are_not_uncited(spark):
    rows = spark.createDataFrame([(1, 2, "- a list item without any number\nA long claim with a source [1]"), (2, 2, "A long claim without a source"), (3, 2, None)], "id long, sources int, answer string")
    assert {r.id: (r.uncited, r.valid) for r in evidence.citation_check(rows).collect() if r.id < 3} == {1: (0, True), 2: (1, False)}


def test_routes(spark):
    asked = spark.createDataFrame([("a", "你好！"), ("b", "AB-12 在哪"), ("c", "A与B的关系"), ("d", "区别是什么意思"), ("e", "what is it"), ("f", None), ("g", "Sales Base 的上下游")], "id string, question string")
    bases = spark.createDataFrame([("k2", "sales base"), ("k1", "Sales"), ("k9", ""), ("k8", None)], "kb_id string, kb_name string")
    got = {r.id: (r.mode, r.kb_id) for r in route.route(asked, bases=bases).collect()}
    assert got == {"a": ("none", None), "b": ("keyword", None), "c": ("graph", None), "d": ("vector", None), "e": ("hybrid", None), "f": ("hybrid", None), "g": ("graph", "k1")}
    assert {r.mode for r in route.route(asked, "vector").collect()} == {"none", "vector"}


def test_peak_over_ranges(spark):
    leases = spark.range(3000).selectExpr("id % 2 as k", "timestamp_seconds(id % 500 * 7) as start_ts", "timestamp_seconds(id % 500 * 7 + 60 + id % 5) as end_ts")
    rows = [(r.k, r.start_ts, r.end_ts) for r in leases.collect()]
    want = {k: max(sum(a <= t < b for kk, a, b in rows if kk == k) for kk, t, _ in rows[:500] if kk == k) for k in (0, 1)}
    assert {r.k: r.peak for r in operations.peak_concurrency(leases, "k").collect()} == want


def test_nearest_with_ties_and_tiles(spark, monkeypatch):
    data = [(i, [1.0, 0.0] if i % 3 else [0.6, 0.8]) for i in range(50)] + [(99, None)]
    v = spark.createDataFrame(data, "chunk_id long, embedding array<double>")
    q = spark.createDataFrame([(k, [1.0, 0.0]) for k in range(300)], "qid long, embedding array<double>")
    got = retrieve.vector_route(q, v, 5)
    assert got.count() == 1500
    assert [r.chunk_id for r in got.filter("qid = 299").orderBy("rank").collect()] == [1, 2, 4, 5, 7]


def test_visibility(spark):
    chunks = spark.createDataFrame([(1, "d", "k", 0, 2, "2025-01-01", "a"), (2, "d", "k", 0, 2, None, "b"), (3, "d", "other", 1, 2, "2025-01-01", "c"), (4, "e", "k2", 0, 1, "2025-01-01", "d"), (5, "f", "k", 0, 1, "2025-01-01", "e")],
                                   "chunk_id long, document_id string, kb_id string, seq int, index_version int, day string, content string").withColumn("created_at", F.to_timestamp("day"))
    docs = spark.createDataFrame([("d", "k", "ready", 2), ("e", "k2", "ready", 1), ("f", "k", "deleting", 1)], "document_id string, kb_id string, status string, active_index_version int").withColumn("filename", F.lit("f")).withColumn("tags", F.array(F.lit("t")))
    bases, members = spark.createDataFrame([("k", "w"), ("k2", "w2")], "kb_id string, workspace_id string"), spark.createDataFrame([("w", "u"), ("w", "u")], "workspace_id string, user_id string")
    seen = lambda **x: sorted(r.chunk_id for r in retrieve.visible_chunks(chunks, docs, **x).collect())
    assert seen() == [1, 4] and seen(kb_id="k2") == [4] and seen(bases=bases, members=members, user="u") == [1] and seen(bases=bases, members=members, user="x") == []
    assert seen(quarantined=docs.filter("document_id = 'd'")) == [4]


def test_graph_limits(spark):
    found = spark.range(400).selectExpr("id as chunk_id", "explode(array('common', concat('own', id))) as name")
    seeds = spark.createDataFrame([(1, "common")], "qid long, name string")
    assert graph.recall(seeds, found, most=10).groupBy("hop").count().orderBy("hop").collect() == [(0, 10), (1, 20)]


def test_margins(spark):
    pages = spark.createDataFrame([(i, "d", f"Head {i}\n\nbody {i}\nFoot") for i in range(4)] + [(9, "d", ""), (10, "d", None), (11, "e", "x\ny")], "p long, d string, t string")
    assert {(r.line, r.times, r.pages) for r in margins.repeated_margins(pages, "d", "p", "t").collect()} == {("Head #", 4, 6), ("Foot", 4, 6)}
    assert {r.p: r.t for r in margins.without_margins(pages, "d", "p", "t").collect()} == {0: "body 0", 1: "body 1", 2: "body 2", 3: "body 3", 9: "", 11: "x\ny"}
