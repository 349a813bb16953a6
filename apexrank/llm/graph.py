"""Connected components of a link table by alternating large and small stars, wholly as aggregations and joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checked, settle


def _star(edges: DataFrame, rows: int, large: bool) -> DataFrame:
    """Hooks each node's larger (large) or smaller neighbours, and for small stars the node itself, to its least neighbour.

    The hub of a star may hold a third of all links: its minimum is pre-aggregated, and only that table meets the links again."""
    around = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    least = around.groupBy("u").agg(F.min("v").alias("m"))
    least = least.select("u", F.least("u", "m").alias("m"))
    if rows > 200_000:  # too many for a broadcast: written, so that the skewed side of the join can be split
        least = settle(least, "least")
    joined = around.join(checked(least, rows, 200_000), "u")
    if large:
        out = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.*")
    return out.where("u <> v").distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """(id, component) for each id of the links (a, b), ids of any order; component is the least id that links reach."""
    now = settle(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "links")
    seen = None
    while True:
        sums = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if sums == seen or not sums[0]:
            break
        seen = sums
        now = settle(_star(_star(now, sums[0], True), sums[0], False), "links")
    return now.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("id"), F.col("v").alias("component"))).distinct()
