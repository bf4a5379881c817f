"""Connected components of a table of links, without bringing links or components to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved


def components(links: DataFrame) -> DataFrame:
    """node, label: the smallest node that each node of ``links`` (a long, b long) is connected with.

    Each round takes the smallest label of the neighbours and then the label of that label, so that the rounds grow with
    the logarithm of the longest path. Each round's labels are written to the shared folder. The nodes of a giant
    component meet on one label in the second join; the other side has one row for it, so that AQE's handling of skewed
    joins deals them to several tasks.
    """
    pairs = links.where("a <> b").select("a", "b")
    both = saved(pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    labels = saved(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("b")).select("node", F.least("node", "b").alias("label")), "labels")
    while True:
        near = both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("label").alias("near"))
        hooked = labels.join(near, F.col("node") == F.col("a")).select("node", F.col("label").alias("old"), F.least("label", "near").alias("mid"))
        known = labels.select(F.col("node").alias("mid"), F.col("label").alias("next"))
        moved = saved(hooked.join(known, "mid").select("node", "old", F.least("mid", "next").alias("label")), "labels")
        labels = moved.select("node", "label")
        if moved.where("label <> old").isEmpty():
            return labels
