"""Connected components of a graph given by its links, as joins and sums.

Each round every node takes the smallest label of itself and its neighbours, then the label of its
label. Rounds end when no label changes. A round's labels are written to the shared folder, so the
plan doesn't grow and a lost executor costs that round's tasks only. Nodes are in no order and no
group is gathered. A hub's links meet its label, and a large component's nodes the label of their
label, in spread_join(), so neither is one task's; smallest labels have partial minima before
their shuffle.

A link with a null end, or of a node with itself, links nothing; such ends are in the result only
if another link has them. Repeated links count once. No links give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import heavy_keys, removed, shared_dir, spread_join, stored

FEW = 10_000  # so many rows are one task's share, whatever their keys


def components(spark: SparkSession, links: DataFrame) -> DataFrame:
    """links: a, b. Returns node and component, the smallest node that it reaches; each node of a link once."""
    first = shared_dir(spark)
    both = stored(links.where("a <> b").select("a", "b").union(links.where("a <> b").select("b", "a")).distinct(), spark, first)
    n_links = both.count()
    hubs = heavy_keys(both.groupBy("b").agg(F.count(F.lit(1)).alias("n")), "b", "n", n_links) if n_links > FEW else []
    path = shared_dir(spark)
    labels = stored(both.groupBy("a").agg(F.min("b").alias("least")).select(F.col("a").alias("node"), F.least("a", "least").alias("component")), spark, path)
    n_nodes = labels.count() if n_links > FEW else n_links
    while True:
        seen = spread_join(both, labels.withColumnRenamed("node", "b"), "b", hubs).groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        lower = labels.join(seen, "node").select("node", F.col("component").alias("was"), F.least("component", "near").alias("next"))
        of = labels.select(F.col("node").alias("next"), F.col("component").alias("jump"))
        large = heavy_keys(labels.groupBy("component").agg(F.count(F.lit(1)).alias("n")), "component", "n", n_nodes) if n_nodes > FEW else []
        after = shared_dir(spark)
        new = stored(spread_join(lower, of, "next", large).select("node", F.least("next", "jump").alias("component"), (F.least("next", "jump") != F.col("was")).alias("changed")), spark, after)
        removed(spark, path)
        path, labels = after, new.select("node", "component")
        if not new.where("changed").limit(1).count():
            removed(spark, first)
            return labels
