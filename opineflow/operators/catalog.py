"""Catalog operators: integrity, versions, name history, lineage."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def orphans(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """Rows of ``child`` whose key has no parent."""
    return child.join(parent.select(F.col(parent_key).alias("__p")).distinct(), F.col(child_key) == F.col("__p"), "left_anti")


def versions(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """Version numbers from 1 within a key, and whether a row is the latest."""
    w, whole = Window.partitionBy(key).orderBy(*order), Window.partitionBy(key)
    return rows.withColumn("version_no", F.row_number().over(w)).withColumn("is_latest", F.col("version_no") == F.count("*").over(whole))


def name_history(rows: DataFrame, key: str, value: str, *order: str) -> DataFrame:
    """Type-2 history: a row opens when the value changes and closes when the next opens."""
    w = Window.partitionBy(key).orderBy(*order)
    changed = rows.withColumn("__before", F.lag(value).over(w)).where(F.col("__before").isNull() | (F.col("__before") != F.col(value))).drop("__before")
    closed = F.lead(order[0]).over(w)
    return changed.select(key, value, F.col(order[0]).alias("valid_from"), closed.alias("valid_to"), closed.isNull().alias("is_current"))


def lineage_closure(edges: DataFrame, rounds: int = 40) -> DataFrame:
    """Distinct (ancestor, descendant) pairs reachable over parent-child edges, cycles included.

    Each round joins the paths known with themselves, so paths of length n take log n rounds; it ends once no
    pair is new.  Rounds are cut by checkpoints in the shared folder."""
    paths = edges.where("parent is not null and child is not null").select(F.col("parent").alias("ancestor"), F.col("child").alias("descendant")).distinct()
    before = -1
    for _ in range(rounds):
        paths = paths.checkpoint() if edges.sparkSession.sparkContext.getCheckpointDir() else paths
        now = paths.count()
        if now == before:
            return paths
        before = now
        longer = paths.alias("x").join(paths.alias("y"), F.col("x.descendant") == F.col("y.ancestor")).select(F.col("x.ancestor").alias("ancestor"), F.col("y.descendant").alias("descendant"))
        paths = paths.unionByName(longer).distinct()
    raise RuntimeError(f"paths of over 2^{rounds} edges")


def reconcile(left: DataFrame, right: DataFrame, left_key: str, right_key: str) -> DataFrame:
    """Rows per key in both tables, keys of either side, nulls included, and whether they agree."""
    a = left.groupBy(F.col(left_key).alias("__a")).agg(F.count("*").alias("n_left"))
    b = right.groupBy(F.col(right_key).alias("__b")).agg(F.count("*").alias("n_right"))
    both = a.join(b, F.col("__a").eqNullSafe(F.col("__b")), "full").select(F.coalesce("__a", "__b").alias("key"), F.coalesce("n_left", F.lit(0)).alias("n_left"), F.coalesce("n_right", F.lit(0)).alias("n_right"))
    return both.withColumn("agrees", F.col("n_left") == F.col("n_right"))


def upsert(base: DataFrame, updates: DataFrame, key: str, version: str) -> DataFrame:
    """The row of the highest version of each key; of equal versions an update's.  One shuffle, merged before it."""
    rest = [c for c in base.columns if c not in (key, version)]
    both = base.withColumn("__new", F.lit(0)).unionByName(updates.select(base.columns).withColumn("__new", F.lit(1)))
    best = both.groupBy(key).agg(F.max(F.struct(version, "__new", *rest)).alias("r"))
    return best.select(key, F.col(f"r.{version}").alias(version), *[F.col(f"r.{c}").alias(c) for c in rest])
