"""Graph operators: connected components and one-hop expansion."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from scholion.session import cut_lineage


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(vertex, component) for every vertex of ``links``; component is its smallest reachable vertex.

    Every round turns the links into stars: a vertex hands its larger neighbours to its smallest one (large star), then its
    smaller neighbours (small star). Links never grow in number, paths shorten by half or more, and a round ends with as
    many links as vertices, each to its component, when nothing moves any more. A hub meets its neighbours as rows of an
    aggregate and a join that AQE may split, never as a list. Each round is a reliable checkpoint.
    """
    pairs = links.select(F.least(a, b).alias("low"), F.greatest(a, b).alias("high")).where("low is not null and high is not null and low <> high")
    now, before = cut_lineage(pairs.distinct()), None
    while before != (before := _mark(now)):
        now = cut_lineage(_small_star(_large_star(now)))
    return now.select(F.col("high").alias("vertex"), F.col("low").alias("component")).unionByName(now.select(F.col("low").alias("vertex"), F.col("low").alias("component")).distinct())


def _mark(links: DataFrame) -> tuple:
    """Number of links and a digest that doesn't depend on their order."""
    return tuple(links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("low", "high").cast("decimal(38,0)"))).head())


def _large_star(links: DataFrame) -> DataFrame:
    """Links of every vertex's larger neighbours to the smallest among it and its neighbours."""
    both = links.select(F.col("low").alias("v"), F.col("high").alias("w")).unionByName(links.select(F.col("high").alias("v"), F.col("low").alias("w")))
    least = links.groupBy(F.col("high").alias("v")).agg(F.min("low").alias("least"))  # a vertex without a smaller neighbour is its own least
    linked = both.where("w > v").join(least, "v", "left").select(F.coalesce("least", "v").alias("low"), F.col("w").alias("high"))
    return linked.distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """Links of every vertex and its smaller neighbours to the smallest of them."""
    least = links.groupBy(F.col("high").alias("v")).agg(F.min("low").alias("least"))
    moved = links.join(least, F.col("high") == F.col("v")).select(F.col("least").alias("low"), F.col("low").alias("high")).where("low <> high")
    return moved.unionByName(least.select(F.col("least").alias("low"), F.col("v").alias("high"))).distinct()


def star_links(rows: DataFrame, node: str, *keys: str) -> DataFrame:
    """Links (a, b) from every node to the smallest node that shares a non-null key: as many links as nodes, never
    all pairs of a group."""
    out = None
    for key in keys:
        least = rows.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("__key")).agg(F.min(node).alias("a"))
        links = rows.join(least, F.col(key) == F.col("__key")).select("a", F.col(node).alias("b"))
        out = links if out is None else out.unionByName(links)
    return out


def one_hop(edges: DataFrame, seeds: DataFrame, source: str = "source", target: str = "target", seed: str = "seed") -> DataFrame:
    """(seed, direction, neighbour): distinct neighbours of the seeds along and against the edges, no recursion."""
    ahead = edges.join(seeds, edges[source] == seeds[seed]).select(F.col(seed), F.lit("references").alias("direction"), F.col(target).alias("neighbour"))
    back = edges.join(seeds, edges[target] == seeds[seed]).select(F.col(seed), F.lit("cited_by").alias("direction"), F.col(source).alias("neighbour"))
    return ahead.unionByName(back).distinct()


def frontier(edges: DataFrame, seeds: DataFrame, done: DataFrame, **names) -> DataFrame:
    """The next page of a resumable expansion: neighbours not delivered yet."""
    keys = ["seed", "direction", "neighbour"]
    return one_hop(edges, seeds, **names).join(done.select(*keys), keys, "left_anti")
