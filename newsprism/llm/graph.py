"""Connected components of a link table, as Spark joins (no links on the driver)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored


def local_roots(u: np.ndarray, v: np.ndarray, n: int) -> np.ndarray:
    """Smallest node reachable from each of 0..n-1 over links (u, v), inside one task."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[u], root[v])
        new = root.copy()
        np.minimum.at(new, root[u], low)
        np.minimum.at(new, root[v], low)
        new = new[new]
        while True:
            jump = new[new]
            if (jump == new).all():
                break
            new = jump
        if (new == root).all():
            return root
        root = new


def components(spark: SparkSession, links: DataFrame) -> DataFrame:
    """(node, component_id): the smallest node reachable from each linked node.

    ``links`` has columns a, b (longs, either direction, repeats allowed); nodes without links
    are not listed. Alternating large-star and small-star steps turn every component into a star
    around its smallest node; each step is one grouped minimum (partially aggregated) and one
    join that Spark may split on a hot node, and the number of steps grows with the logarithm of
    the longest chain. Null ends are ignored.
    """
    edges = stored(
        spark,
        links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .where("a is not null and b is not null and a <> b")
        .distinct(),
        "links",
    )
    done = edges.isEmpty()
    while not done:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = stored(
            spark,
            both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("m", "a")),
            "large-low",
        )
        large = (
            both.join(low, "a")
            .where("b > a and b <> m")
            .select(F.col("b").alias("a"), F.col("m").alias("b"))
        )
        large = stored(spark, large.distinct(), "large")
        low = stored(spark, large.groupBy("a").agg(F.min("b").alias("m")), "small-low")
        small = (
            large.join(low, "a")
            .select(F.explode(F.array("a", "b")).alias("a"), F.col("m").alias("b"))
            .where("a <> b")
            .distinct()
        )
        new = stored(spark, small, "links")
        # a star forest: no centre is itself a leaf, and every leaf has one centre
        inner = new.join(new.select(F.col("b").alias("a")).distinct(), "a", "left_semi")
        done = inner.isEmpty() and new.groupBy("a").count().where("count > 1").isEmpty()
        edges = new
    star = edges.select(F.col("a").alias("node"), F.col("b").alias("component_id"))
    return star.unionByName(
        edges.select(F.col("b").alias("node"), F.col("b").alias("component_id")).distinct()
    )
