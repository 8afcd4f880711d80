"""Queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wrenmill.llm import bpe, entity_match, look_alikes, match_groups, mixing, sentences, subjects, vector_graph
from wrenmill.runtime import table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = vector_graph.near_pairs(table(spark, sf_dir, "document_vectors"), "document_id", "embedding", k=10, size=64)
    return pairs.select(F.col("a").alias("document_id_a"), F.col("b").alias("document_id_b"))


def p1_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries are the embeddings whose id is divisible by 100, against all."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return vector_graph.search(vectors, vectors.filter(F.col("vec_id") % 100 == 0), "vec_id", "embedding").select("query_id", "other", "rank")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = table(spark, sf_dir, "records")
    edges = table(spark, sf_dir, "relation_edges")
    sample = sentences.training_sample(records, edges.select("document_id", "evidence_text"), "document_id", "text", "evidence_text")
    chain = sentences.fit(sample)
    parts = [
        sentences.split(df, key, text, chain).select(F.lit(name).alias("table_name"), "row_key", "start_pos", "end_pos")
        for name, df, key, text in (("records", records, "document_id", "text"), ("relation_edges", edges, "uid", "evidence_text"))
    ]
    return parts[0].unionByName(parts[1])


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = look_alikes.same_look_pairs(table(spark, sf_dir, "records"), "document_id", "text")
    nodes = look_alikes.same_look_pairs(table(spark, sf_dir, "event_nodes"), "uid", "text", within="document_id")
    return records.select(F.lit("records").alias("table_name"), "key_a", "key_b").unionByName(
        nodes.select(F.lit("event_nodes").alias("table_name"), "key_a", "key_b")
    )


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return match_groups.relation_groups(table(spark, sf_dir, "relation_decisions"))


def p6_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entity_match.match(table(spark, sf_dir, "records"), table(spark, sf_dir, "work_orders"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p6_matches(spark, sf_dir).select("document_id", "entry_id")


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(table(spark, sf_dir, "documents"), "doc_id", "text")


def p9_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))[0]


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))[1]


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = subjects.subjects(table(spark, sf_dir, "documents"), table(spark, sf_dir, "subject_labels"), table(spark, sf_dir, "subject_areas"))
    return found.select("doc_id", "subject_id")


def p10_composition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return subjects.composition(p10_found(spark, sf_dir), table(spark, sf_dir, "subject_areas"))


QUERIES = {"p1_found": p1_found, "p1_search": p1_search, "p2_found": p2_found, "p3_found": p3_found, "p4_found": p4_found, "p6_found": p6_found, "p6_matches": p6_matches, "p8_ids": p8_ids, "p9_mix": p9_mix, "p9_shares": p9_shares, "p10_found": p10_found, "p10_composition": p10_composition}

SQL = {
    "p4_found": """
WITH RECURSIVE e AS (
  SELECT DISTINCT CASE WHEN strpos(relation_a_id, ':') > 0 THEN substr(relation_a_id, 1, strpos(relation_a_id, ':') - 1) || '_' || substr(relation_a_id, strpos(relation_a_id, ':') + 1) ELSE relation_a_id END AS a,
    CASE WHEN strpos(relation_b_id, ':') > 0 THEN substr(relation_b_id, 1, strpos(relation_b_id, ':') - 1) || '_' || substr(relation_b_id, strpos(relation_b_id, ':') + 1) ELSE relation_b_id END AS b
  FROM relation_decisions WHERE predicted_state IN ('equivalent', 'equivalent_relation')),
s AS (SELECT a, b FROM e WHERE a <> b UNION SELECT b, a FROM e WHERE a <> b),
reach AS (SELECT a AS node, a AS seen FROM s UNION SELECT r.node, s.b FROM reach r JOIN s ON r.seen = s.a)
SELECT node AS relation_id, min(seen) AS group_id FROM reach GROUP BY node""",
}
