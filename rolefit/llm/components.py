"""Connected components of a table of links."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rolefit.llm.common import stored


def components(links: DataFrame) -> DataFrame:
    """``node, component`` for every end of ``links(a, b)``: the least node it can reach.

    Every node takes the least label around it, then the label of its label, until none changes;
    labels are written out after each round, so no round depends on the tasks of earlier ones.
    """
    both = links.select(F.col("a").alias("node"), F.col("b").alias("other")).union(
        links.select(F.col("b").alias("node"), F.col("a").alias("other"))
    )
    both = stored(both.distinct(), "links")
    labels = stored(
        both.groupBy("node").agg(F.least(F.min("other"), F.first("node")).alias("component")), "labels"
    )
    while True:
        around = labels.select(F.col("node").alias("other"), F.col("component").alias("near"))
        least = both.join(around, "other").groupBy("node").agg(F.min("near").alias("near"))
        lower = labels.join(least, "node").select(
            "node", "component", F.least("component", "near").alias("now")
        )
        jump = labels.select(F.col("node").alias("now"), F.col("component").alias("far"))
        new = lower.join(jump, "now", "left").select(
            "node", "component", F.least("now", F.coalesce("far", "now")).alias("now")
        )
        new = stored(new, "labels")
        changed = new.filter("now < component").limit(1).count()
        labels = new.select("node", F.col("now").alias("component"))
        if not changed:
            return labels
