"""Queries of the grouped kernels: constrained merging and the structural backbone."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wrenmill.config import AssociationConfig
from wrenmill.operators import case_merge, hierarchy, relation_states
from wrenmill.plans import event_queries, hierarchy_queries
from wrenmill.runtime import materialize, table


def _decisions(spark: SparkSession, d: str) -> DataFrame:
    """Relation decisions with the case of both relations; decisions across cases are left out."""
    edges = table(spark, d, "relation_edges").filter("uid IS NOT NULL").select("case_id", F.explode("source_relation_ids").alias("r")).filter("r IS NOT NULL")
    case = edges.groupBy(F.regexp_replace("r", "^([^:]*):", "$1_").alias("r")).agg(F.min("case_id").alias("case_id"))
    n = relation_states.normalize_decisions(table(spark, d, "relation_decisions").distinct())
    side = lambda c, k: case.select(F.col("r").alias(c), F.col("case_id").alias(k))
    both = n.join(side("relation_a_id", "ca"), "relation_a_id").join(side("relation_b_id", "cb"), "relation_b_id").filter("ca = cb")
    return both.select(F.col("ca").alias("case_id"), F.col("relation_a_id").alias("a"), F.col("relation_b_id").alias("b"), F.col("relation_state").alias("state"), F.col("confidence").alias("support"), "confidence")


def g5_constrained_merge(spark: SparkSession, d: str) -> DataFrame:
    return case_merge.merge_cases(_decisions(spark, d))[0]


def g5_merge_actions(spark: SparkSession, d: str) -> DataFrame:
    return case_merge.merge_cases(_decisions(spark, d))[1]


def g24_backbone(spark: SparkSession, d: str) -> DataFrame:
    """Topics of all cases, from the association scores of the nearest cases; cases without a vector are their own topic."""
    c = AssociationConfig()
    cases = table(spark, d, "event_nodes").filter("uid IS NOT NULL AND case_id IS NOT NULL").select(F.col("case_id").alias("node")).distinct()
    _, feats, idf = hierarchy_queries._features(spark, d)
    edges = hierarchy.association_graph(materialize(event_queries._case_vectors(spark, d), "g24-vectors"), feats, idf, c)
    return case_merge.structural_backbone(materialize(edges, "g24-edges"), "a", "b", c.max_cluster, cases)


QUERIES = {f.__name__: f for f in (g5_constrained_merge, g5_merge_actions, g24_backbone)}
SQL: dict[str, str] = {}
