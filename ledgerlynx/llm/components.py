"""Connected components of a distributed list of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlynx.llm.common import written


def components(links: DataFrame) -> DataFrame:
    """``node, class``: the least node of each connected set of ``links(a, b)``.

    Each round gives a node the least label among its neighbours and then the
    label of that label, so paths halve. A node with very many links is only
    summed up (least label, partial sums in each task) or on the side of a join
    that adaptive execution splits. Nodes and labels stay in tables.
    """
    both = written(links.where("a <> b").select("a", "b").union(links.where("a <> b").select("b", "a")).distinct(),
                   "component-links")
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("least"))
                     .select("node", F.least("node", "least").alias("class")), "component-labels")
    while True:
        near = both.join(labels.withColumnsRenamed({"node": "b", "class": "seen"}), "b") \
            .groupBy(F.col("a").alias("node")).agg(F.min("seen").alias("seen"))
        lowered = written(labels.join(near, "node").select("node", F.least("class", "seen").alias("new"), "class"),
                          "component-step")
        jumped = lowered.alias("x").join(
            lowered.select(F.col("node").alias("up"), F.col("new").alias("up_class")), F.col("x.new") == F.col("up"),
            "left").select("node", F.coalesce("up_class", "new").alias("new"), "class")
        labels = written(jumped, "component-labels")
        if labels.where("new <> class").isEmpty():
            return labels.select("node", F.col("new").alias("class"))
        labels = labels.select("node", F.col("new").alias("class"))
