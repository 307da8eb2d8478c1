"""Connected components of an edge table, without collecting anything.

Alternating large-star and small-star steps: each node's neighbours are hooked
to the least of them by a minimum that is combined before the shuffle and a
join that adaptive execution can split, so a hub is many tasks' work. Each step
is written to the shared folder, which keeps the lineage short.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from protolake.llm.storage import stored


def _hook(pairs: DataFrame) -> DataFrame:
    """pairs (u, v): adds m, the least of u and its v."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("u", "m").alias("m"))
    return pairs.join(least, F.col("u") == F.col("k")).select("u", "v", "m")


def _large(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _hook(both).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()


def _small(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    hooked = _hook(down)
    return hooked.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(hooked.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()


def _stars(edges: DataFrame) -> bool:
    """True if every u has one v that is no u itself: then v is the least id of its component."""
    ends = edges.select(F.col("u").alias("id"), F.lit(1).alias("out"), F.lit(0).alias("into")).unionByName(edges.select(F.col("v").alias("id"), F.lit(0).alias("out"), F.lit(1).alias("into")))
    return ends.groupBy("id").agg(F.sum("out").alias("out"), F.max("into").alias("into")).filter("out > 1 or out = 1 and into = 1").isEmpty()


def components(links: DataFrame) -> DataFrame:
    """links (a, b): rows (id, component) of all linked ids; component is the least id reachable."""
    edges = stored(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "edges")
    while not _stars(edges):
        edges = stored(_small(_large(edges)), "edges")
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
