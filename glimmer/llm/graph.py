"""Connected components over a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glimmer.llm.common import cut, dropped


def components(links: DataFrame) -> DataFrame:
    """id and label (the smallest id reachable) for every id in ``links`` (columns a, b, long).

    Labels spread over links and then jump to their own label's label, so paths shorten by half a round; rounds end
    when no label changes. Only ids and labels move, and each round's table is written to the shared folder.
    """
    links = links.where("a <> b").select("a", "b")
    both = cut(links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).groupBy("a", "b").agg(F.lit(True).alias("one")).select("a", "b"))
    labels = cut(both.groupBy(F.col("a").alias("id")).agg(F.least(F.col("a"), F.min("b")).alias("label")))
    while True:
        near = both.join(labels, both.b == labels.id).groupBy("a").agg(F.min("label").alias("least"))
        spread = labels.join(near, labels.id == near.a, "left").select("id", F.col("label").alias("old"), F.least("label", F.coalesce("least", "label")).alias("label"))
        jump = labels.select(F.col("id").alias("to"), F.col("label").alias("further"))
        new = cut(spread.join(jump, spread.label == jump["to"], "left").select("id", "old", F.least("label", F.coalesce("further", "label")).alias("label")))
        dropped(labels)
        labels = new.select("id", "label")
        if not new.where("old <> label").limit(1).count():
            dropped(both)
            return labels
