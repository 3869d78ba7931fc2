"""Events and operations: queues, leases, audit chain, limits, service levels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ferrule.runtime import written


def backoff(attempt: Column, base: int = 2, most: int = 300) -> Column:
    """Seconds before the next try: base * 2^(attempt - 1), at most ``most``."""
    return F.least(F.lit(float(most)), base * F.pow(F.lit(2.0), F.greatest(attempt - 1, F.lit(0))))


def stale_leases(beats: DataFrame, now: Column, after_seconds: int = 300) -> DataFrame:
    """Holders whose last heartbeat is older than ``after_seconds``: ``(holder, last_beat)``."""
    last = beats.groupBy("holder").agg(F.max("ts").alias("last_beat"))
    return last.filter(F.col("last_beat") < now - F.expr(f"INTERVAL {after_seconds} SECONDS"))


def backlog(events: DataFrame, most: int = 50) -> DataFrame:
    """The next ``most`` pending events in the order of their time."""
    return events.filter("status = 'pending'").orderBy("ts", "event_id").limit(most)


def triage(letters: DataFrame, parents: DataFrame, now: Column, cooldown_hours: int = 1, most: int = 20) -> DataFrame:
    """The oldest ``most`` letters past the cooldown, to retry, or to discard where the parent is gone."""
    due = letters.filter(F.col("created_at") < now - F.expr(f"INTERVAL {cooldown_hours} HOURS")).orderBy("created_at", "letter_id").limit(most)
    gone = parents.select("parent_id", F.lit(True).alias("there"))
    return due.join(gone, "parent_id", "left").select("letter_id", F.when(F.col("there"), "retry").otherwise("discard").alias("action"))


def chained(rows: DataFrame, chain: str, order: list[str], payload: Column) -> DataFrame:
    """Each row's own hash and, as ``prev_hash``, that of the row before it in its chain."""
    own = rows.withColumn("entry_hash", F.sha2(payload, 256))
    return own.withColumn("prev_hash", F.coalesce(F.lag("entry_hash").over(Window.partitionBy(chain).orderBy(*order)), F.lit("")))


def broken_links(rows: DataFrame, chain: str, order: list[str], payload: Column) -> DataFrame:
    """Rows whose stored prev_hash or entry_hash is not what the chain makes it."""
    again = chained(rows.withColumnsRenamed({"entry_hash": "_e", "prev_hash": "_p"}), chain, order, payload)
    return again.filter((F.col("_e") != F.col("entry_hash")) | (F.col("_p") != F.col("prev_hash"))).drop("_e", "_p")


def peak_concurrency(leases: DataFrame, key: str) -> DataFrame:
    """The largest number of leases (start_ts, end_ts) open at once; one ending as another starts is over."""
    turns = leases.select(key, F.col("start_ts").alias("ts"), F.lit(1).alias("d")).unionAll(leases.select(key, F.col("end_ts").alias("ts"), F.lit(-1).alias("d")))
    # Turns at one time are summed first; then an open count needs one row a time.
    turns = turns.groupBy(key, "ts").agg(F.sum("d").alias("d"))
    # A hot key's times are cut into ranges: each range's peak is its own running sum on top of the sums of
    # the key's ranges before it.
    ranges = turns.repartitionByRange(key, "ts").select("*", F.spark_partition_id().alias("_part"))
    ranges = written(ranges, "turns")
    running = F.sum("d").over(Window.partitionBy(key, "_part").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0))
    own = ranges.withColumn("open", running).groupBy(key, "_part").agg(F.max("open").alias("top"), F.sum("d").alias("sum"))  # few rows a range
    before = F.coalesce(F.sum("sum").over(Window.partitionBy(key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return own.withColumn("top", F.col("top") + before).groupBy(key).agg(F.max("top").alias("peak"))


def over_limit(events: DataFrame, key: str, width: str = "1 minute", limit: int = 20) -> DataFrame:
    """Tumbling windows in which ``key`` has more events than the limit."""
    rows = events.groupBy(F.window("ts", width).alias("w"), key).agg(F.count("*").alias("n")).filter(F.col("n") > limit)
    return rows.select(F.col("w.start").alias("window_start"), key, "n")


def error_ratio(events: DataFrame, width: str = "1 hour", slide: str | None = None) -> DataFrame:
    """Events, errors and their ratio in each window."""
    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    rows = events.groupBy(w.alias("w")).agg(F.count("*").alias("events"), F.sum((F.col("event_type") == "error").cast("long")).alias("errors"))
    return rows.select(F.col("w.start").alias("window_start"), "events", "errors", F.round(F.col("errors") / F.col("events"), 6).alias("ratio"))


def burn_rate(ratios: DataFrame, target: float = 0.99) -> DataFrame:
    """How many times faster than allowed the error budget is used, and what is left of it."""
    allowed = 1 - target
    return ratios.select("window_start", F.round(F.col("ratio") / allowed, 4).alias("burn_rate"), F.greatest(F.lit(0.0), F.round(1 - F.col("ratio") / allowed, 4)).alias("budget_left"))


def histogram(events: DataFrame, value: str, bounds: list[float]) -> DataFrame:
    """Cumulative counts by upper bound, as a monitoring histogram has them; one pass, no shuffle of rows."""
    counts = events.agg(*[F.sum((F.col(value) <= b).cast("long")).alias(f"b{i}") for i, b in enumerate(bounds)], F.count(value).alias("all"))
    pairs = F.array(*[F.struct(F.lit(float(b)).alias("upper"), F.coalesce(f"b{i}", F.lit(0)).alias("n")) for i, b in enumerate(bounds)], F.struct(F.lit(float("inf")).alias("upper"), F.col("all").alias("n")))
    return counts.select(F.explode(pairs).alias("x")).select("x.upper", "x.n")


def sessions(events: DataFrame, key: str, gap: str = "6 hours") -> DataFrame:
    """Runs of a key's events with less than ``gap`` between neighbours."""
    rows = events.groupBy(F.session_window("ts", gap).alias("w"), key).agg(F.count("*").alias("n"))
    return rows.select(key, F.col("w.start").alias("session_start"), "n")


def usage_overview(events: DataFrame, value: str) -> DataFrame:
    return events.agg(F.count("*").alias("requests"), F.count_distinct("user_id").alias("users"), F.coalesce(F.round(F.sum(F.col(value).cast("decimal(18,4)")), 2), F.lit(0)).cast("double").alias("total"),
                      F.coalesce(F.avg(F.col(value).cast("decimal(18,4)")), F.lit(0)).cast("long").alias("mean"))


def usage_daily(events: DataFrame, value: str) -> DataFrame:
    """Requests, users and total by day; days without requests are not filled in."""
    return events.groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("requests"), F.count_distinct("user_id").alias("users"), F.sum(F.col(value).cast("decimal(18,4)")).cast("double").alias("total"))


def histogram_quantile(buckets: DataFrame, share: float) -> DataFrame:
    """The quantile that cumulative buckets (upper, n) tell, linear within its bucket as monitoring systems have
    it; in the open bucket it is the last bound."""
    w = Window.orderBy("upper")  # one row a bound
    rows = buckets.withColumn("low", F.coalesce(F.lag("upper").over(w), F.lit(0.0))).withColumn("below", F.coalesce(F.lag("n").over(w), F.lit(0)))
    total = buckets.agg(F.max("n")).scalar()
    rows = rows.withColumn("want", total * share).filter((F.col("n") >= F.col("want")) & (F.col("n") > 0))
    inside = F.col("low") + (F.col("upper") - F.col("low")) * (F.col("want") - F.col("below")) / (F.col("n") - F.col("below"))
    return rows.orderBy("upper").limit(1).select(F.round(F.when(F.col("upper") == float("inf"), F.col("low")).otherwise(inside), 6).alias("value"))


def increase(samples: DataFrame, key: str, width: str = "1 hour") -> DataFrame:
    """``(window_start, key, increase)`` of a counter's samples (ts, value): the sum of its rises, where a fall
    is a restart from zero. A sample's rise counts in its own window."""
    before = F.lag("value").over(Window.partitionBy(key).orderBy("ts", "value"))
    rise = F.when(before.isNull(), 0.0).when(F.col("value") >= before, F.col("value") - before).otherwise(F.col("value"))
    rows = samples.withColumn("rise", rise).groupBy(F.window("ts", width).alias("w"), key).agg(F.sum(F.col("rise").cast("decimal(18,4)")).cast("double").alias("increase"))
    return rows.select(F.col("w.start").alias("window_start"), key, "increase")
