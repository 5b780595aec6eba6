"""Connected components of a graph that is too large for one machine.

Alternating large-star and small-star steps (Kiveris et al., "Connected Components in MapReduce and Beyond",
2014) turn every component into a star around its smallest node. Each round is a few shuffles of at most as many
links as came in; hubs only ever stand on the split side of a join, where adaptive execution deals them out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topspin.sources.sinks import discard, written


def _mark(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``(node, component)`` for every node of ``links``; ``component`` is the smallest node of the node's component.

    ``a`` and ``b`` may have any type that Spark can order. Links with a null end say nothing and are left out;
    loops, repeated and turned links do no harm. A node whose only link is a loop has no row.
    """
    links = links.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    links, path = written(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct())
    before, now = None, _mark(links)
    while now != before and now[0]:
        both = links.select(F.col("u").alias("n"), F.col("v").alias("x")).unionByName(links.select(F.col("v").alias("n"), F.col("u").alias("x")))
        # written first, as adaptive execution splits a hub's links only where nothing stands between shuffle and join
        least, aside = written(both.groupBy("n").agg(F.min("x").alias("m")).select("n", F.least("n", "m").alias("m")))
        large = both.where(F.col("x") > F.col("n")).join(least, "n").select(F.col("x").alias("u"), F.col("m").alias("v"))
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        links, new = written(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        discard(links.sparkSession, path, aside)
        path = new
        before, now = now, _mark(links)
    roots = links.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return links.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
