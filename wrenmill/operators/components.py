"""Connected components by alternating hooking to the least neighbour and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wrenmill.runtime import materialize, release, skew_lookup


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component): component is the least node; only nodes with an edge. Nulls and self-pairs give none."""
    clean = edges.filter(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).select(F.col(a).alias("u"), F.col(b).alias("v")).distinct()
    clean = materialize(clean, "components-edges")
    both = clean.unionByName(clean.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct()
    labels = materialize(both.select(F.col("u").alias("node")).distinct().withColumn("component", F.col("node")), "components-labels")
    while True:
        near = skew_lookup(both, labels.select(F.col("node").alias("v"), F.col("component").alias("cv")), "v").groupBy("u").agg(F.min("cv").alias("least"))
        hooked = labels.join(near.withColumnRenamed("u", "node"), "node").select("node", F.least("component", "least").alias("component"), F.col("component").alias("old"))
        hooked = materialize(hooked, "components-labels")
        jump = hooked.select(F.col("node").alias("component"), F.col("component").alias("further"))
        jumped = materialize(skew_lookup(hooked, jump, "component").select("node", F.coalesce("further", "component").alias("component"), "old"), "components-labels")
        changed = jumped.filter("component <> old").limit(1).count()
        release(labels, hooked)
        labels = jumped.drop("old")
        if not changed:
            return labels
