"""Connected components of a link table by rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.llm import store


def components(edges: DataFrame, label: str) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b): root is the component's smallest node.

    Each round takes the smallest root among a node's neighbours and then the root's own root, so
    paths halve. Rounds are cut by tables in the shared folder; sums and minima are combined before
    each shuffle, and nothing is gathered on the driver but the number of changed nodes.
    """
    pair = lambda a, b: F.struct(F.col(a).alias("a"), F.col(b).alias("b"))
    both = edges.where("a != b").select(F.inline(F.array(pair("a", "b"), pair("b", "a")))).distinct()  # edges are computed once
    both = store.written(both, f"{label}-edges")
    roots = both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("a"), F.min("b")).alias("root"))
    stepped = store.written(roots.withColumn("was", F.col("root")), f"{label}-roots")
    while True:
        roots = stepped.select("node", "root")
        near = both.join(roots.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("near"))
        nearer = roots.join(near, "node", "left").select("node", F.col("root").alias("was"), F.least("root", F.coalesce("near", "root")).alias("mid"))
        up = roots.select(F.col("node").alias("mid"), F.col("root").alias("top"))
        last, stepped = stepped, store.written(nearer.join(up, "mid", "left").select("node", F.least("mid", F.coalesce("top", "mid")).alias("root"), "was"), f"{label}-roots")
        store.discard(last)
        if stepped.where("was != root").isEmpty():
            store.discard(both)
            return stepped.select("node", "root")
