"""Connected components of a table of links, by alternating star contractions.

Each round points the neighbours of a vertex to its smallest neighbour, first the larger ones, then
all that are not larger, until each component is a star around its smallest vertex. Rounds are
logarithmic in the size of a component, each is written to the shared folder, and no vertex gathers
its neighbours: minima are aggregates, joined back. Minima are merged, never sent through the driver.
"""

from pyspark.sql import DataFrame, functions as F

from poolwatch.llm.common import stored

MAX_ROUNDS = 60


def _least(pairs: DataFrame) -> DataFrame:
    """Smallest of each vertex u and its neighbours v."""
    return pairs.groupBy("u").agg(F.least(F.min("v"), F.min("u")).alias("m"))


def _stars(edges: DataFrame) -> bool:
    """Whether each vertex u has one smaller neighbour v, which has none itself."""
    ends = edges.select(F.col("u").alias("id"), F.lit(1).alias("up"), F.lit(0).alias("root")).unionByName(
        edges.select(F.col("v").alias("id"), F.lit(0).alias("up"), F.lit(1).alias("root")))
    each = ends.groupBy("id").agg(F.sum("up").alias("up"), F.max("root").alias("root"))
    return each.filter("up + root > 1").agg(F.count("*")).first()[0] == 0


def components(links: DataFrame) -> DataFrame:
    """(id, component): the smallest id reachable from every id that `links` (a, b) names."""
    edges = stored(
        links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u > v").distinct(),
        "links",
    )
    for _ in range(MAX_ROUNDS):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.join(_least(both).hint("merge"), "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.distinct()
        least = _least(large)
        small = large.join(least.hint("merge"), "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.unionByName(least.select("u", F.col("m").alias("v"))).filter("u > v").distinct()
        edges = stored(small, "links")
        if _stars(edges):
            ids = edges.select(F.col("u").alias("id"), F.col("v").alias("component"))
            return ids.unionByName(edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
    raise RuntimeError(f"no end after {MAX_ROUNDS} rounds")
