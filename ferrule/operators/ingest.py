"""The life of a file's ingestion: claiming jobs, moving between stages, retries, and what is written or removed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ferrule.operators.operations import backoff

# The states a job may be claimed from, and where each stage may lead.
CLAIMABLE = ("uploaded", "queued", "retrying")
NEXT = {"uploaded": ("queued", "cancelled", "deleting"), "queued": ("parsing", "cancelled", "failed"), "parsing": ("chunking", "retrying", "failed", "cancelled"), "chunking": ("embedding", "retrying", "failed", "cancelled"),
        "embedding": ("ready", "retrying", "failed", "cancelled"), "retrying": ("queued", "parsing", "failed", "cancelled"), "ready": ("queued", "deleting"), "failed": ("retrying", "deleting"), "cancelled": ("queued", "deleting"), "deleting": ("deleted",), "deleted": ()}
MAX_ATTEMPTS = 3


def claimed(jobs: DataFrame, now: Column, most: int = 50, lease_seconds: int = 300) -> DataFrame:
    """The oldest ``most`` jobs (job_id, status, created_at, next_retry_at, lease_until, attempts) that are due and
    not leased, as the claim leaves them: stage parsing, one attempt more, leased until ``lease_seconds`` from now.
    Running jobs whose lease ran out are due too; a null time is one that has passed."""
    free = F.coalesce(F.col("lease_until") <= now, F.lit(True))
    waiting = F.col("status").isin(*CLAIMABLE) & F.coalesce(F.col("next_retry_at") <= now, F.lit(True))
    lost = F.col("status").isin("parsing", "chunking", "embedding") & F.col("lease_until").isNotNull()
    due = jobs.filter(free & (waiting | lost)).orderBy(F.asc_nulls_first("created_at"), "job_id").limit(most)
    return due.withColumns({"status": F.lit("parsing"), "attempts": F.coalesce("attempts", F.lit(0)) + 1, "lease_until": now + F.expr(f"INTERVAL {lease_seconds} SECONDS")})


def advanced(moves: DataFrame) -> DataFrame:
    """``(job_id, at, to_status, status)`` of moves (job_id, at, to_status): a move that its job's state before it
    doesn't allow is refused and leaves the state as it was. A job begins as uploaded; ties go by state.

    A job has few moves, so its fold is one array."""
    allowed = F.create_map(*[x for k, v in NEXT.items() for x in (F.lit(k), F.array(*[F.lit(s) for s in v]).cast("array<string>"))])
    rows = moves.groupBy("job_id").agg(F.array_sort(F.collect_list(F.struct("at", "to_status"))).alias("moves"))
    start = F.array(F.struct(F.lit(None).cast("timestamp").alias("at"), F.lit(None).cast("string").alias("to_status"), F.lit("uploaded").alias("status")))
    step = lambda done, m: F.concat(done, F.array(F.struct(m["at"].cast("timestamp").alias("at"), m["to_status"].alias("to_status"), F.when(F.array_contains(F.element_at(allowed, F.element_at(done, -1)["status"]), m["to_status"]), m["to_status"]).otherwise(F.element_at(done, -1)["status"]).alias("status"))))
    folded = F.aggregate("moves", start, step)
    return rows.select("job_id", F.explode(F.slice(folded, 2, F.size(folded))).alias("x")).select("job_id", "x.at", "x.to_status", "x.status")


def after_failure(failed: DataFrame, now: Column, most: int = MAX_ATTEMPTS) -> DataFrame:
    """``(job_id, status, next_retry_at, dead)`` of failed jobs (job_id, attempts): a further try after a
    growing pause, or, after ``most``, failed for good and to be listed as a dead letter."""
    done = F.coalesce("attempts", F.lit(0)) >= most
    pause = F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), backoff(F.coalesce("attempts", F.lit(0))).cast("decimal(18,6)"))
    return failed.select("job_id", F.when(done, "failed").otherwise("retrying").alias("status"), F.when(~done, now + pause).alias("next_retry_at"), done.alias("dead"))


def kept_checkpoint(chunks: DataFrame, target: int, reusable: DataFrame) -> DataFrame:
    """Chunks without those of version ``target`` whose (document_id, seq) isn't among the ``reusable`` ones."""
    good = reusable.select("document_id", "seq").distinct().withColumn("_good", F.lit(True))
    return chunks.join(good, ["document_id", "seq"], "left").filter((F.col("index_version") != target) | F.col("_good")).drop("_good")


def cascaded(bases: DataFrame, documents: DataFrame, chunks: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What is left of bases, documents and chunks when the bases in ``gone`` (kb_id) are deleted. A document of
    no base stays."""
    ids = gone.select("kb_id").distinct()
    lost = documents.join(ids, "kb_id", "left_semi").select("document_id")
    return bases.join(ids, "kb_id", "left_anti"), documents.join(ids, "kb_id", "left_anti"), chunks.join(lost, "document_id", "left_anti")


def purged(rows: DataFrame, when: str, now: Column, days: int) -> tuple[DataFrame, DataFrame]:
    """Rows to keep, and those older than ``days`` to archive first; rows without a time are kept."""
    old = F.coalesce(F.col(when) < now - F.expr(f"INTERVAL {days} DAYS"), F.lit(False))
    return rows.filter(~old), rows.filter(old)


def appended(log: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """A log with new rows after it; a key that is there already, or twice among the new, is written once."""
    place = F.row_number().over(Window.partitionBy(key).orderBy(*[F.col(c) for c in sorted(rows.columns) if c != key] or [F.col(key)]))
    new = rows.withColumn("_n", place).filter("_n = 1").drop("_n").join(log.select(key), key, "left_anti")
    return log.unionByName(new.select(*log.columns))
