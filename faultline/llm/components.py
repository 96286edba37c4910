"""Connected components of an edge table, by large-star and small-star steps.

Each step joins edges with the least neighbour of each node, which is combined
before the shuffle, so a node with very many edges is no hot task. The edges are
stored after each pair of steps. Null ends are dropped and loops add nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.sources.scratch import stored


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m"))
    least = least.select("u", F.least("u", "m").alias("m"))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """``edges`` run from larger to smaller nodes."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionAll(least.select("u", F.col("m").alias("v")))


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, label) for every node with an edge; the label is the least node."""
    known = edges.filter(F.col(a).isNotNull() & F.col(b).isNotNull())
    pair = known.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
    current, before = stored(pair.filter("u != v").distinct(), "edges"), None
    while True:
        state = current.agg(
            F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))
        ).first()
        if state == before:
            break
        before = state
        stars = _small_star(_large_star(current)).distinct()
        current = stored(stars, "edges")
    roots = current.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct()
    return current.select(F.col("u").alias("node"), F.col("v").alias("label")).unionAll(roots)
