"""Connected components of a table of links, in rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_counted, materialize


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, comp) of every node of the links; comp is the smallest node that can be reached.

    Each round takes the smallest label among a node's neighbours, then the label of its label, so the rounds grow with
    the logarithm of the longest path. Labels and links stay in tables; only the number of changed labels is collected.
    Nodes of very many links and labels of very many nodes are joined by broadcast, so no task gets all of their rows.
    Self-links and repeated links do no harm; no links, no rows.
    """
    both = links.select(F.col(a).alias("src"), F.col(b).alias("dst")).where("src <> dst")
    both = materialize(both.unionAll(both.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct(), "links")
    total = both.count()
    labels = both.groupBy("src").agg(F.min("dst").alias("dst"), F.count("*").alias("degree"))
    labels = materialize(labels.select(F.col("src").alias("node"), F.least("src", "dst").alias("comp"), "degree"), "labels")
    while total:
        near = join_counted(both, labels.select(F.col("node").alias("dst"), F.col("comp").alias("c"), "degree"), "dst", "degree", total)
        near = near.groupBy("src").agg(F.min("c").alias("c"))
        low = labels.join(near, F.col("node") == F.col("src")).select("node", "degree", F.col("comp").alias("old"), F.least("comp", "c").alias("comp"))
        low = materialize(low, "labels-low")
        ends = low.groupBy("comp").agg(F.count("*").alias("nodes"))
        ends = materialize(ends.join(low.select("node", F.col("comp").alias("end")), F.col("comp") == F.col("node")).drop("node"), "labels-ends")
        nxt = join_counted(low, ends, "comp", "nodes", total).select("node", "degree", "old", F.least("comp", "end").alias("comp"))
        nxt = materialize(nxt, "labels")
        labels = nxt.select("node", "comp", "degree")
        if not nxt.where("old <> comp").limit(1).count():
            break
    return labels.select("node", "comp")
