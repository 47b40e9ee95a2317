"""Connected components of links, named by their smallest node."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrille.plans.stages import free, stored


def _oriented(links: DataFrame) -> DataFrame:
    return links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a <> b").distinct()


def _shortened(parents: DataFrame) -> DataFrame:
    """parents(node, parent) with each parent replaced by the last one above it: chains halve each round."""
    while True:
        above = parents.select(F.col("node").alias("parent"), F.col("parent").alias("over"))
        longer = stored(parents.join(above, "parent", "left").select("node", F.coalesce("over", "parent").alias("parent"), F.col("over").isNotNull().alias("moved")), "parents")
        free(parents)
        parents = stored(longer.select("node", "parent"), "parents")
        moved = not longer.filter("moved").isEmpty()
        free(longer)
        if not moved:
            return parents


def representatives(links: DataFrame) -> DataFrame:
    """(node, root) of all nodes of links(a, b): root is the smallest node that links reach, whatever their direction.

    A row for each node, never pairs of a component. Each round joins components to smaller neighbours, so rounds grow with the
    logarithm of a component's width; a node of very many links is summed in each task first.
    """
    open_ = stored(_oriented(links), "links")
    labels = stored(open_.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("root", F.col("node")), "roots")
    while not open_.isEmpty():
        parents = _shortened(stored(open_.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("parent")), "parents"))
        known = parents.select(F.col("node").alias("root"), "parent")
        renamed = stored(labels.join(known, "root", "left").select("node", F.coalesce("parent", "root").alias("root")), "roots")
        ends = open_
        for c in ("a", "b"):
            ends = ends.join(parents.select(F.col("node").alias(c), F.col("parent").alias(f"to_{c}")), c, "left")
        left = stored(_oriented(ends.select(F.coalesce("to_a", "a").alias("a"), F.coalesce("to_b", "b").alias("b"))), "links")
        free(open_, labels, parents)
        open_, labels = left, renamed
    free(open_)
    return labels
