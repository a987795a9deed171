"""Connected components by alternating joins; links and labels stay distributed."""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwell.llm.common import stored


def connected_components(links: DataFrame, one: str, two: str) -> DataFrame:
    """node, label (smallest node of its component) for every node that has a link.

    Large-star and small-star steps: a node hands its larger neighbours, then its smaller
    ones, to the smallest it knows. Each step only rewires edges, so their number never
    grows, and a step's result is a written table; the steps grow with the logarithm of the size. A star whose edges no longer change is
    done; hub nodes only enter map-side minima and an equi-join that can be split.
    """
    a, b = F.col(one), F.col(two)
    edges = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u != v").distinct()
    edges = stored(edges, "components-0")
    before = None
    for step in count(1):
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small_low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(small_low, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        edges = stored(small, f"components-{step}")
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    label = edges.select(F.col("u").alias("node"), F.col("v").alias("label"))
    return label.union(edges.select(F.col("v").alias("node"), F.col("v").alias("label"))).distinct()
