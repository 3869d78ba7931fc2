"""Row visibility by role, and counts by tenant."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The roles that hold each permission.
ROLES = {
    "read": ("owner", "admin", "editor", "viewer", "auditor"), "query": ("owner", "admin", "editor", "viewer"), "write": ("owner", "admin", "editor"),
    "delete": ("owner", "admin"), "admin": ("owner", "admin"), "audit": ("owner", "admin", "auditor"),
}


def secure(df: DataFrame, memberships: DataFrame, user: str, permission: str, key: str = "workspace_id") -> DataFrame:
    """Rows of workspaces in which ``user`` has a role with the permission; a null key is never visible."""
    allowed = memberships.filter((F.col("user_id") == user) & F.col("role").isin(*ROLES[permission])).select(key)
    return df.join(allowed, key, "left_semi")


def document_counts(bases: DataFrame, documents: DataFrame) -> DataFrame:
    """Documents of every base, none included. Counted before the join, so a hot base isn't shuffled whole."""
    n = documents.groupBy("kb_id").agg(F.count("document_id").alias("documents"))
    return bases.select("kb_id").join(n, "kb_id", "left").select("kb_id", F.coalesce("documents", F.lit(0)).alias("documents"))


def quota(bases: DataFrame, documents: DataFrame, limit_bytes: int) -> DataFrame:
    """Bytes stored by workspace and whether they exceed the limit. Sizes are summed by base first."""
    size = documents.groupBy("kb_id").agg(F.sum(F.col("size_bytes").cast("long")).alias("bytes"))
    rows = bases.join(size, "kb_id", "left").groupBy("workspace_id").agg(F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"))
    return rows.select("workspace_id", "bytes", (F.col("bytes") > limit_bytes).alias("over"))


def departments(bases: DataFrame, documents: DataFrame) -> DataFrame:
    """The departments with documents in each workspace; pairs of a base are made distinct before the join."""
    held = documents.select("kb_id", "department").distinct()
    return bases.select("kb_id", "workspace_id").join(held, "kb_id").select("workspace_id", "department").distinct()
