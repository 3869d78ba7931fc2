"""Problem 8: mixing sources to target weights.

Method: every record gets a hash-random key; within its source it is placed by key range, the ranges'
token sums are turned into prefix sums, and each source is cut at its exact budget. A budget over
what a source holds is met by repeating it in epochs, at most ``max_repeats`` in all.
"""

from __future__ import annotations

import base64
import functools
import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ferrule.runtime import arrow_map, spread, table, written

TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
# Fixed value: the split pattern that belongs to the tokenizer file.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
RANGE_ROWS = 50_000  # rows of one source that share a key range, about


@functools.cache
def _encoding(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_counts(df: DataFrame, text: str = "text", tokenizer: str = TOKENIZER, name: str = "tokens") -> DataFrame:
    """``df`` without its text and with the text's number of tokens; 0 for null and empty texts."""
    keep = [c for c in df.columns if c != text]

    def count(c):
        enc = _encoding(tokenizer)
        return {k: c[k] for k in keep} | {name: [len(enc.encode_ordinary(t)) if t else 0 for t in c[text]]}

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name in keep)
    return arrow_map(spread(df), count, f"{schema}, {name} long")


def _random_key(*cols: str, seed: int) -> Column:
    return F.xxhash64(F.lit(seed), *cols)


def budgets(sizes: DataFrame, targets: DataFrame, total_tokens: int | None = None) -> DataFrame:
    """``(source, target_share, max_repeats, available, budget)`` of every target source.

    Without ``total_tokens`` the total is the largest at which every source present reaches its share
    of the total. With it, a source that cannot reach its budget gives all its repeats hold. A source
    without tokens has the budget 0 and shares are then taken among the others. There is one row a
    source, so this stays small whatever the corpus.
    """
    t = targets.groupBy("source").agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats")).filter("source is not null")
    t = t.join(sizes, "source", "left").withColumn("available", F.coalesce("available", F.lit(0)))
    ok = (F.col("available") > 0) & (F.col("target_share") > 0) & (F.col("max_repeats") > 0)
    t = t.withColumn("cap", F.when(ok, F.col("available") * F.col("max_repeats")).otherwise(0)).withColumn("share", F.when(ok, F.col("target_share")).otherwise(0.0))
    t = t.withColumns({"present": t.agg(F.sum("share")).scalar(), "most": t.agg(F.min(F.when(ok, F.col("cap") / F.col("share")))).scalar()})
    total = F.col("most") * F.col("present") if total_tokens is None else F.lit(float(total_tokens))
    wanted = F.when(F.col("present") > 0, F.floor(total * F.col("share") / F.col("present"))).otherwise(0)
    return t.select("source", "target_share", "max_repeats", "available", F.least(wanted, F.col("cap")).cast("long").alias("budget"))


def mix_sources(counted: DataFrame, targets: DataFrame, id_col: str = "doc_id", total_tokens: int | None = None, seed: int = 7) -> DataFrame:
    """Drawn records ``(id, source, epoch, tokens, used_tokens)`` from ``counted`` rows
    ``(id, source, tokens)``.

    ``used_tokens`` is below ``tokens`` only for the one record a source's budget ends in. Records of
    null or untargeted sources, and those without tokens, are not drawn; records stored twice count twice.
    """
    rows = counted.filter("tokens > 0 and source is not null")
    sizes = written(rows.groupBy("source").agg(F.sum("tokens").alias("available"), F.count("*").alias("n")), "p8-sizes")
    plan = budgets(sizes.select("source", "available"), targets, total_tokens).filter("budget > 0")
    most = sizes.agg(F.max("n")).first()[0] or 1
    ranges = 1 << max(0, math.ceil(math.log2(max(1, most / RANGE_ROWS))))
    # Keys are uniform, so ranges of equal width hold about equal numbers of a source's rows.
    keyed = rows.withColumn("key", _random_key(id_col, seed=seed)).withColumn("range", F.shiftrightunsigned("key", 64 - int(math.log2(ranges))).cast("long") if ranges > 1 else F.lit(0).cast("long"))
    sums = keyed.groupBy("source", "range").agg(F.sum("tokens").alias("in_range"))
    before = sums.select("source", "range", (F.sum("in_range").over(Window.partitionBy("source").orderBy("range")) - F.col("in_range")).alias("before"))
    inside = Window.partitionBy("source", "range").orderBy("key", id_col).rowsBetween(Window.unboundedPreceding, 0)
    placed = (keyed.withColumn("run", F.sum("tokens").over(inside)).join(before, ["source", "range"])
              .select(id_col, "source", "tokens", (F.col("before") + F.col("run") - F.col("tokens")).alias("start")))
    drawn = placed.join(plan, "source").withColumn("epochs", F.floor(F.col("budget") / F.col("available"))).withColumn("rest", F.col("budget") % F.col("available"))
    copies = F.col("epochs") + (F.col("start") < F.col("rest")).cast("long")
    drawn = drawn.filter(copies > 0).withColumn("epoch", F.explode(F.sequence(F.lit(1).cast("long"), copies)))
    last = F.least(F.col("tokens"), F.col("rest") - F.col("start"))
    return drawn.select(id_col, "source", F.col("epoch").cast("int").alias("epoch"), "tokens",
                        F.when(F.col("epoch") > F.col("epochs"), last).otherwise(F.col("tokens")).alias("used_tokens"))


def share_report(mix: DataFrame, targets: DataFrame) -> DataFrame:
    """``(source, target_share, actual_share, used_tokens, records, max_epoch)``: one row a target
    source; shares are of all tokens drawn, and a source with nothing drawn has 0."""
    used = mix.groupBy("source").agg(F.sum("used_tokens").alias("used_tokens"), F.count("*").alias("records"), F.max("epoch").alias("max_epoch"))
    t = targets.groupBy("source").agg(F.max("target_share").alias("target_share")).filter("source is not null").join(used, "source", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    t = t.select("source", "target_share", zero("used_tokens"), zero("records"), zero("max_epoch"))
    return t.withColumn("whole", t.agg(F.sum("used_tokens")).scalar()).select("source", "target_share", F.when(F.col("whole") > 0, F.col("used_tokens") / F.col("whole")).otherwise(0.0).alias("actual_share"), "used_tokens", "records", "max_epoch")


def _counted(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, targets = table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets")
    known = docs.select("doc_id", "source", "text").join(targets.select("source").distinct(), "source", "left_semi")
    return written(token_counts(known), "p8-tokens")


def p8_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(_counted(spark, sf_dir), table(spark, sf_dir, "mix_targets"))


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    targets = table(spark, sf_dir, "mix_targets")
    return share_report(mix_sources(_counted(spark, sf_dir), targets), targets)


QUERIES = {"p8_mix": p8_mix, "p8_shares": p8_shares}
