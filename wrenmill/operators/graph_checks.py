"""Rules that case graphs must keep, as one table of violations, and the statistics of a corpus of case graphs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wrenmill.functions import text as t
from wrenmill.operators import patterns


def case_documents(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(case_id, document_id): the documents that rows of a case lie in."""
    return nodes.select("case_id", "document_id").unionByName(edges.select("case_id", "document_id")).filter("case_id IS NOT NULL AND document_id IS NOT NULL").distinct()


def violations(nodes: DataFrame, edges: DataFrame, documents: DataFrame) -> DataFrame:
    """(rule, uid, case_id): repeated ids, ids in several cases, unknown roles and relation types, ends that lead nowhere or to another case, source documents of another case.

    Repeated rows of one uid count once as duplicates; a null role or type is unknown; null source documents are skipped.
    """
    row = lambda df, rule: df.select(F.lit(rule).alias("rule"), "uid", "case_id")
    unlike = lambda c, values: ~F.coalesce(F.col(c).isin(*values), F.lit(False))
    each = lambda df: df.filter("uid IS NOT NULL").groupBy("uid").agg(F.min("case_id").alias("case_id"), F.count(F.lit(1)).alias("k"), F.countDistinct("case_id").alias("cases"))
    known, lines = each(nodes), each(edges)
    ends = edges.select("uid", "case_id", F.explode(F.array("head_uid", "tail_uid")).alias("end")).join(known.select(F.col("uid").alias("end"), F.col("case_id").alias("node_case")), "end", "left")
    foreign = lambda df: df.select("uid", "case_id", F.explode("source_document_ids").alias("document_id")).filter("document_id IS NOT NULL AND case_id IS NOT NULL").join(documents, ["case_id", "document_id"], "left_anti").select("uid", "case_id").distinct()
    parts = [
        row(known.filter("k > 1"), "duplicate_node_uid"), row(lines.filter("k > 1"), "duplicate_edge_uid"), row(known.filter("cases > 1"), "cross_case_node"),
        row(nodes.filter(unlike("role", patterns.ROLES)), "unknown_role"), row(edges.filter(unlike("relation_type", t.RELATION_TYPES)), "unknown_relation"),
        row(ends.filter("node_case IS NULL"), "dangling_edge"), row(ends.filter("node_case <> case_id"), "cross_case_edge"),
        row(foreign(nodes), "cross_case_node_source"), row(foreign(edges), "cross_case_edge_source"),
    ]
    return reduce(DataFrame.unionByName, parts)


def summary(nodes: DataFrame, edges: DataFrame, documents: DataFrame) -> DataFrame:
    """One row of corpus statistics; a node or edge without named sources counts as one source."""
    n = lambda c: F.count(F.lit(1)).alias(c)
    sources = lambda c: F.max(F.greatest(F.lit(1), F.size(F.coalesce(c, F.array().cast("array<string>")))))
    usable = lambda df: df.filter("uid IS NOT NULL AND case_id IS NOT NULL")
    one = usable(nodes).groupBy("uid").agg(sources("source_event_ids").alias("s"), F.max(F.coalesce("source_span_valid", F.lit(False)).cast("int")).alias("v"))
    two = usable(edges).groupBy("uid").agg(sources("source_relation_ids").alias("s"))
    cases = nodes.select("case_id").unionByName(edges.select("case_id")).filter("case_id IS NOT NULL").distinct().agg(n("case_count"))
    docs = documents.groupBy("case_id").agg(n("k")).agg(F.coalesce(F.sum("k"), F.lit(0)).alias("document_count"), F.count_if(F.col("k") > 1).alias("multi_document_case_count"))
    a = one.agg(n("node_count"), F.coalesce(F.sum("s"), F.lit(0)).alias("source_event_count"), F.coalesce(F.sum("v"), F.lit(0)).alias("valid"))
    b = two.agg(n("edge_count"), F.coalesce(F.sum("s"), F.lit(0)).alias("source_relation_count"))
    bad = violations(nodes, edges, documents).filter("case_id IS NOT NULL").agg(F.countDistinct("case_id").alias("case_boundary_violation_count"))
    ratio = lambda x, y: F.col(x) / F.greatest(F.lit(1), F.col(y))
    # each side is one row
    full = reduce(lambda x, y: x.crossJoin(y), [cases, docs, a, b, bad])
    return full.select(
        "case_count", "document_count", "node_count", "edge_count", "source_event_count", "source_relation_count", ratio("node_count", "source_event_count").alias("event_reconstruction_ratio"),
        ratio("edge_count", "source_relation_count").alias("relation_reconstruction_ratio"), "multi_document_case_count", ratio("valid", "node_count").alias("source_span_provenance_rate"), "case_boundary_violation_count",
    )
