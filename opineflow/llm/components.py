"""Connected components of an edge table, by shrinking to stars and alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, release

#: Up to so many edges are no work to deal out.
SMALL = 20_000


def _fingerprint(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("hi", "lo"))).first())


def _stars(edges: DataFrame, rounds: int) -> DataFrame:
    """(node, root) of a small graph.  Large stars tie larger neighbours to the least one, small stars the rest;
    minima are taken before the shuffle, and a hot node's edges are joined, not gathered."""
    before = _fingerprint(edges)
    together = (lambda df: df.coalesce(1)) if before[0] <= SMALL else (lambda df: df)  # a small graph's rounds need no shuffles
    for _ in range(rounds):
        now = together(edges)
        both = together(now.unionByName(now.select(F.col("lo").alias("hi"), F.col("hi").alias("lo")))).select(F.col("hi").alias("u"), F.col("lo").alias("v"))
        least = both.groupBy(F.col("u").alias("c")).agg(F.min("v").alias("m")).select("c", F.least("c", "m").alias("m"))
        large = both.join(least, F.col("u") == F.col("c")).where("v > u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        least = large.groupBy(F.col("hi").alias("c")).agg(F.min("lo").alias("m"))
        small = large.join(least, F.col("hi") == F.col("c"))
        small = together(small.select(F.col("lo").alias("hi"), F.col("m").alias("lo")).where("hi != lo").unionByName(least.select(F.col("c").alias("hi"), F.col("m").alias("lo"))))
        stars = materialize(small.select(F.greatest("hi", "lo").alias("hi"), F.least("hi", "lo").alias("lo")).distinct(), "stars")
        release(edges)
        edges, after = stars, _fingerprint(stars)
        if after == before:
            return edges.select(F.col("hi").alias("node"), F.col("lo").alias("root"))
        before = after
    raise RuntimeError(f"components did not settle in {rounds} rounds")


def components(edges: DataFrame, rounds: int = 50) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b) that isn't the least of its component.

    First every node is tied to its least neighbour and edges are redrawn between those; what were
    stars around their least node, as most groups of copies are, is settled by that.
    """
    edges = materialize(edges.select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).where("hi != lo").distinct(), "edges")
    parent = materialize(edges.groupBy("hi").agg(F.min("lo").alias("up")), "parents")
    up, over = parent.select(F.col("hi").alias("x"), F.col("up").alias("up_hi")), parent.select(F.col("hi").alias("y"), F.col("up").alias("up_lo"))
    # hubs have many edges: their parents come from a written table, so that AQE can split such joins
    redrawn = edges.join(up, F.col("hi") == F.col("x")).join(over, F.col("lo") == F.col("y"), "left").select("up_hi", F.coalesce("up_lo", "lo").alias("up_lo"))
    redrawn = redrawn.where("up_hi != up_lo").select(F.greatest("up_hi", "up_lo").alias("hi"), F.least("up_hi", "up_lo").alias("lo")).distinct()
    redrawn = materialize(redrawn, "redrawn")
    release(edges)
    if redrawn.isEmpty():
        return parent.select(F.col("hi").alias("node"), F.col("up").alias("root"))
    roots = _stars(redrawn, rounds)
    found = parent.join(roots, F.col("up") == F.col("node"), "left").select(F.col("hi").alias("node"), F.coalesce("root", "up").alias("root"))
    # nodes without a smaller neighbour that were tied to a smaller root through others
    rest = roots.join(parent.select(F.col("hi").alias("known")), F.col("node") == F.col("known"), "left_anti")
    return found.unionByName(rest.select("node", "root")).where("node != root")
