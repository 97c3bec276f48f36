"""Connected components of a link table, by alternating large-star and small-star steps (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymark.llm.shared import written


def components(links: DataFrame) -> DataFrame:
    """(node, root) for each node of links (u, v): root is the smallest node of the component.

    Both steps hand each neighbour to the smallest one seen, so a node with very many links is only ever the key of an
    aggregate and of a join that adaptive execution can split. Stops when a round changes no link."""
    links = _distinct(links.select("u", "v"))
    state = None
    while True:
        links = written(_small_star(_large_star(links)), "links")
        now = links.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
        if (now["n"], now["x"]) == state:
            break
        state = (now["n"], now["x"])
    roots = links.select(F.col("v").alias("node"), F.col("u").alias("root"))
    return roots.unionByName(links.select(F.col("u").alias("node"), F.col("u").alias("root")).distinct())


def _distinct(links: DataFrame) -> DataFrame:
    low, high = F.least("u", "v"), F.greatest("u", "v")
    return links.filter("u <> v").select(low.alias("u"), high.alias("v")).distinct()


def _both_ways(links: DataFrame) -> DataFrame:
    return links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _large_star(links: DataFrame) -> DataFrame:
    """Each node hands its larger neighbours to the smallest of its neighbours and itself."""
    both = _both_ways(links)
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return _distinct(both.filter("v > u").join(least, "u").select(F.col("m").alias("u"), "v"))


def _small_star(links: DataFrame) -> DataFrame:
    """Each node hands its smaller neighbours and itself to the smallest of them. links hold the smaller node in u."""
    down = links.select(F.col("v").alias("u"), F.col("u").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    near = down.join(least, "u")
    return _distinct(near.select(F.col("m").alias("u"), "v").unionByName(least.select(F.col("m").alias("u"), F.col("u").alias("v"))))
