"""Rows, classes of equal rows, and pairs between the classes: shared by the operators on pairs.

``members`` is ``(field, id, rep, copies)``: each row with the smallest id of its class and the number of
its rows. ``pairs`` is ``(field, id_a, id_b)`` between representatives, id_a < id_b.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ferrule.runtime import dropped, written

EXPAND = 2_500  # pairs of rows that a pair of classes is expanded to; larger ones give each row's pair with the other class's representative


def expanded(pairs: DataFrame, members: DataFrame, inside: bool, most: int = EXPAND) -> DataFrame:
    """Pairs of rows from pairs of representatives and the membership.

    Two classes with up to ``most`` pairs of rows between them give all of these; larger ones give each
    row's pair with the other class's representative, and the membership tells the rest. With ``inside``
    the rows of one class are pairs as well, under the same rule.
    """
    groups = members.filter("copies > 1")
    size = groups.filter("id = rep").select("field", "rep", "copies")
    one = F.lit(1).cast("long")
    n = lambda x: size.select("field", F.col("rep").alias(f"id_{x}"), F.col("copies").alias(f"n_{x}"))
    sized = (pairs.select("field", "id_a", "id_b").join(n("a"), ["field", "id_a"], "left").join(n("b"), ["field", "id_b"], "left")
             .select("field", "id_a", "id_b", F.coalesce("n_a", one).alias("n_a"), F.coalesce("n_b", one).alias("n_b")).filter("n_a > 1 or n_b > 1"))
    of = lambda x: groups.select("field", F.col("rep").alias(f"id_{x}"), F.col("id").alias(x))
    every = sized.filter(F.col("n_a") * F.col("n_b") <= most).join(of("a"), ["field", "id_a"], "left").join(of("b"), ["field", "id_b"], "left")
    every = every.select("field", F.coalesce("a", "id_a").alias("a"), F.coalesce("b", "id_b").alias("b"))
    large = sized.filter(F.col("n_a") * F.col("n_b") > most)
    to_b = large.join(of("a"), ["field", "id_a"]).select("field", "a", F.col("id_b").alias("b"))
    to_a = large.join(of("b"), ["field", "id_b"]).select("field", F.col("id_a").alias("a"), "b")
    rows = every.unionByName(to_b).unionByName(to_a)
    if inside:
        few = groups.filter(F.col("copies") * F.col("copies") <= most)
        rows = rows.unionByName(few.select("field", "rep", F.col("id").alias("a")).join(few.select("field", "rep", F.col("id").alias("b")), ["field", "rep"]).filter("a < b").select("field", "a", "b"))
        rows = rows.unionByName(groups.filter((F.col("copies") * F.col("copies") > most) & (F.col("id") != F.col("rep"))).select("field", F.col("rep").alias("a"), F.col("id").alias("b")))
    rows = rows.select("field", F.least("a", "b").alias("id_a"), F.greatest("a", "b").alias("id_b")).filter("id_a != id_b")
    return pairs.select("field", "id_a", "id_b").unionByName(rows).distinct()


def components(pairs: DataFrame) -> DataFrame:
    """``(field, id, group_id)``: each id of the pairs with the smallest id it is linked to over any number
    of pairs. Larger and smaller neighbours take turns in moving to the least one until nothing changes;
    every step is a written table and only its size and a checksum come to the driver."""
    edges, state = written(pairs.select("field", F.col("id_b").alias("v"), F.col("id_a").alias("u")).distinct(), "links"), None
    while True:
        both = edges.unionByName(edges.select("field", F.col("u").alias("v"), F.col("v").alias("u")))
        least = both.groupBy("field", "v").agg(F.least(F.min("u"), F.first("v")).alias("m"))
        larger = both.join(least, ["field", "v"]).filter("u > v").select("field", F.col("u").alias("v"), F.col("m").alias("u")).distinct()
        low = larger.groupBy("field", "v").agg(F.min("u").alias("m"))
        smaller = larger.join(low, ["field", "v"]).select("field", F.explode(F.array("u", "v")).alias("v"), F.col("m").alias("u")).filter("v != u").distinct()
        after = written(smaller, "links")
        seen = after.agg(F.count("*"), F.sum(F.pmod(F.xxhash64("field", "v", "u"), F.lit(1 << 40)))).first()
        dropped(edges)
        edges = after
        if tuple(seen) == state:
            return edges.select("field", F.col("v").alias("id"), F.col("u").alias("group_id")).unionByName(edges.select("field", F.col("u").alias("id"), F.col("u").alias("group_id")).distinct())
        state = tuple(seen)
