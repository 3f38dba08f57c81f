"""Connected components of a distributed list of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvid.llm.shared import stored


def components(links: DataFrame, folder: str) -> DataFrame:
    """(id, component) for every id in ``links`` (u, v): the smallest id that links lead to.

    Each round hangs every node's larger neighbours on its smallest one, then its smaller
    neighbours (and itself) on its smallest one, until nothing changes; the number of rounds
    grows with the logarithm of the longest chain.  The links of a round are a stored table;
    only their number and a checksum reach the driver.  A node with very many links is
    aggregated before the shuffle, and joined as an ordinary join that Spark can split.
    """
    edges = links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    edges = stored(edges, f"{folder}/0")
    mark, k = None, 0
    while True:
        now = tuple(edges.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first())
        if now == mark:
            return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(
                edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
        mark, k = now, k + 1
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        edges = small.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        edges = stored(edges, f"{folder}/{k}")
