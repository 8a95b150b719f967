"""Connected components by alternating large-star and small-star steps, every step a shuffle on all executors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import discard, stored


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component) for each point that is not the smallest of its component; ``component`` is that smallest point.

    Points without links to others, and links that hold a null, have no row. The smallest neighbour of each point comes
    from a combining aggregation, so a point with very many links costs one row per task there; the joins that follow
    are plain equi-joins, whose large partitions Spark splits. Each round is written to the shared folder, and the
    one before deleted. Rounds grow with the logarithm of the number of points.
    """
    links = edges.select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).where(F.col(a).isNotNull() & F.col(b).isNotNull()).where("hi <> lo").distinct()
    links = stored(links, "links")
    mark = _mark(links)
    while mark[0]:
        former, links = links, stored(_small_star(_large_star(links)), "links")
        discard(former)
        before, mark = mark, _mark(links)
        if mark == before:
            break
    return links.select(F.col("hi").alias("id"), F.col("lo").alias("component"))


def _mark(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("hi", "lo"))).first())


def _large_star(links: DataFrame) -> DataFrame:
    """Larger neighbours of each point are tied to its smallest neighbour, or to the point itself if it is smaller."""
    both = links.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(links.select("lo", "hi"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).where("hi <> lo").distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """Smaller neighbours of each point, and the point, are tied to the smallest of them."""
    least = links.groupBy("hi").agg(F.min("lo").alias("m"))
    rest = links.join(least, "hi").select(F.col("lo").alias("hi"), F.col("m").alias("lo")).where("hi <> lo")
    return rest.union(least.select("hi", "m")).distinct()
