"""Connected components of links, by passing the smallest id along and jumping to the label's label."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarn.llm.common import written


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node that has a link; the component is its smallest node.

    Each round is a join and a minimum over the links, its result written to the shared folder;
    rounds grow with the logarithm of the longest path where labels can jump. Links may repeat,
    point to themselves or come in any direction. No links give an empty table.
    """
    one = links.select(F.col(a).alias("u"), F.col(b).alias("v"))
    both = written(one.union(links.select(F.col(b).alias("u"), F.col(a).alias("v"))).where("u is not null and v is not null").distinct(), "links")
    labels = written(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("node"), F.least("u", "m").alias("label"), F.lit(True).alias("moved")), "labels")
    while not labels.where("moved").isEmpty():
        seen = labels.select(F.col("node").alias("v"), F.col("label").alias("theirs"))
        near = both.join(seen, "v").groupBy("u").agg(F.min("theirs").alias("near"))
        step = labels.join(near, F.col("node") == F.col("u")).select("node", F.col("label").alias("before"), F.least("label", "near").alias("next"))
        jump = labels.select(F.col("node").alias("to"), F.col("label").alias("far"))
        step = step.join(jump, F.col("next") == F.col("to"), "left").withColumn("label", F.least("next", "far"))
        labels = written(step.select("node", "label", (F.col("label") < F.col("before")).alias("moved")), "labels")
    return labels.select("node", F.col("label").alias("component"))
