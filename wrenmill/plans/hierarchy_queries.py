"""Queries of concepts, patterns, evidence, closure and risk over event nodes and relation edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wrenmill.operators import concepts, patterns
from wrenmill.operators import graph_checks as checks
from wrenmill.plans import text_queries as tq
from wrenmill.runtime import materialize, table


def _nodes(spark: SparkSession, d: str) -> DataFrame:
    return concepts.clean_nodes(table(spark, d, "event_nodes"))


def _exact(spark: SparkSession, d: str) -> DataFrame:
    """Nodes under concepts of equal normalized text."""
    n = _nodes(spark, d).filter("role IS NOT NULL AND text IS NOT NULL")
    v = concepts.t.concept_text(F.col("text"))
    value = F.when(F.length(v) > 0, v).otherwise(F.lower("text"))
    return n.select("uid", "case_id", "role", concepts.t.concept_id(F.col("role"), value).alias("concept_id"))


def _arcs(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    mapped = _exact(spark, d)
    return mapped, patterns.arcs(table(spark, d, "relation_edges"), mapped)


def g12_graph_checks(spark: SparkSession, d: str) -> DataFrame:
    """Violations of the graph rules by kind; a case's documents are those that its rows name."""
    n, e = table(spark, d, "event_nodes"), table(spark, d, "relation_edges")
    return checks.violations(n, e, checks.case_documents(n, e)).groupBy("rule").agg(F.count(F.lit(1)).alias("n"))


def g13_case_summary(spark: SparkSession, d: str) -> DataFrame:
    n = _nodes(spark, d).groupBy("case_id").agg(F.count(F.lit(1)).alias("n_nodes"), F.countDistinct("document_id").alias("n_documents"), F.countDistinct("role").alias("n_roles"))
    e = table(spark, d, "relation_edges").filter("uid IS NOT NULL").groupBy("case_id").agg(F.countDistinct("uid").alias("n_edges"))
    return n.filter("case_id IS NOT NULL").join(e, "case_id", "left").withColumn("n_edges", F.coalesce("n_edges", F.lit(0)))


def g13_corpus_summary(spark: SparkSession, d: str) -> DataFrame:
    """The corpus statistics as one row."""
    n, e = table(spark, d, "event_nodes"), table(spark, d, "relation_edges")
    s = checks.summary(n, e, checks.case_documents(n, e))
    return s.select(*[F.round(c, 6).alias(c) if c.endswith(("ratio", "rate")) else F.col(c) for c in s.columns])


def k3_near_mentions(spark: SparkSession, d: str) -> DataFrame:
    vals = materialize(concepts.values(_nodes(spark, d)), "k3-values")
    return concepts.near_values(vals).select("role", "a", "b", F.round("similarity", 6).alias("similarity"), "number_safe")


def g15_concepts(spark: SparkSession, d: str) -> DataFrame:
    return concepts.canonicalize(_nodes(spark, d))[1]


def g16_patterns(spark: SparkSession, d: str) -> DataFrame:
    _, arc = _arcs(spark, d)
    return patterns.instances(arc).groupBy("case_id", "signature", "pattern_id").agg(F.count(F.lit(1)).alias("n"))


def g19_pattern_support(spark: SparkSession, d: str) -> DataFrame:
    _, arc = _arcs(spark, d)
    return patterns.instances(arc).groupBy("pattern_id").agg(F.countDistinct("case_id").alias("support"), F.max(F.size("roles")).cast("bigint").alias("n_nodes"))


def s25_evidence_features(spark: SparkSession, d: str) -> DataFrame:
    mapped, arc = _arcs(spark, d)
    return patterns.features(mapped, arc, patterns.instances(arc)).filter("case_id IS NOT NULL")


def _features(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    # written once: every level of the paths and the features read the arcs again
    mapped = materialize(_exact(spark, d), "concepts")
    arc = materialize(patterns.arcs(table(spark, d, "relation_edges"), mapped), "arcs")
    inst = materialize(patterns.instances(arc), "patterns")
    feats = materialize(patterns.features(mapped, arc, inst).filter("case_id IS NOT NULL"), "features")
    return inst, feats, patterns.feature_idf(feats, feats.select("case_id").distinct().count())


def _evidence(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    inst, feats, idf = _features(spark, d)
    queries = feats.select("case_id").distinct().filter(F.regexp_extract("case_id", r"(\d+)$", 1).cast("bigint") % 100 == 0)
    return inst, feats, patterns.weighted_jaccard(queries, feats, idf)


def s24_weighted_jaccard(spark: SparkSession, d: str) -> DataFrame:
    return _evidence(spark, d)[2].select("query_case", "case_id", F.round("evidence", 6).alias("evidence"))


def g20_closure_risk(spark: SparkSession, d: str) -> DataFrame:
    """Closure and risk of every pair of cases that share a feature, all cases included; pairs without a potential signature have distortion 0, missing vectors a similarity of 0."""
    from wrenmill.plans import event_queries

    inst, feats, idf = _features(spark, d)
    full = patterns.assessed_pairs(inst, feats, idf, event_queries._case_vectors(spark, d))
    return full.select("a", "b", "potential", "admitted", "unsupported", "highest", "distortion", "truncated", patterns.risk(F.col("unsupported"), F.col("highest"), F.col("shared"), F.col("semantic"), F.col("evidence")).alias("risk"))


QUERIES = {f.__name__: f for f in (g12_graph_checks, g13_case_summary, g13_corpus_summary, k3_near_mentions, g15_concepts, g16_patterns, g19_pattern_support, s25_evidence_features, s24_weighted_jaccard, g20_closure_risk)}

_N = "n AS (SELECT uid, x.case_id AS case_id, x.role AS role, x.text AS text, x.document_id AS document_id FROM (SELECT uid, min(struct_pack(case_id, role, text, document_id)) AS x FROM event_nodes WHERE uid IS NOT NULL GROUP BY uid))"
_VALUE = f"CASE WHEN length({tq.concept('text')}) > 0 THEN {tq.concept('text')} ELSE lower(text) END"
_MAP = f"""{_N},
m AS (SELECT uid, case_id, role, 'C_' || substr(role, 1, 3) || '_' || substr(sha1(role || '|' || {_VALUE}), 1, 12) AS cid FROM n WHERE role IS NOT NULL AND text IS NOT NULL),
e0 AS (SELECT uid, x.* FROM (SELECT uid, min(struct_pack(case_id, head_uid, tail_uid, relation_type)) AS x FROM relation_edges WHERE uid IS NOT NULL AND head_uid IS NOT NULL AND tail_uid IS NOT NULL AND relation_type IS NOT NULL GROUP BY uid)),
e AS (SELECT uid AS edge, case_id, relation_type AS rel, CASE WHEN relation_type IN ('CAUSE', 'TREAT', 'VERIFY') THEN tail_uid ELSE head_uid END AS s, CASE WHEN relation_type IN ('CAUSE', 'TREAT', 'VERIFY') THEN head_uid ELSE tail_uid END AS t FROM e0),
a AS (SELECT e.*, x.role AS sr, x.cid AS sc, y.role AS tr, y.cid AS tc FROM e JOIN m x ON x.uid = s AND x.case_id = e.case_id JOIN m y ON y.uid = t AND y.case_id = e.case_id)"""
_ROLES = lambda n: ", ".join("'" + ">".join(p) + "'" for p in patterns.PATHS if len(p) == n)
_PAT = f"""{_MAP},
p2 AS (SELECT case_id, t AS last, sr || '>' || tr AS roles, sr || ':' || sc || '>' || tr || ':' || tc AS path, rel AS rels FROM a),
p3 AS (SELECT p2.case_id, a.t AS last, roles || '>' || tr AS roles, path || '>' || tr || ':' || tc AS path, rels || '|' || rel AS rels FROM p2 JOIN a ON a.case_id = p2.case_id AND a.s = last),
p4 AS (SELECT p3.case_id, a.t AS last, roles || '>' || tr AS roles, path || '>' || tr || ':' || tc AS path, rels || '|' || rel AS rels FROM p3 JOIN a ON a.case_id = p3.case_id AND a.s = last),
p5 AS (SELECT p4.case_id, a.t AS last, roles || '>' || tr AS roles, path || '>' || tr || ':' || tc AS path, rels || '|' || rel AS rels FROM p4 JOIN a ON a.case_id = p4.case_id AND a.s = last),
pt AS (SELECT case_id, path || '||' || rels AS signature, n AS nodes FROM (
  SELECT *, 2 AS n FROM p2 WHERE roles IN ({_ROLES(2)}) UNION ALL SELECT *, 3 FROM p3 WHERE roles IN ({_ROLES(3)}) UNION ALL SELECT *, 4 FROM p4 WHERE roles IN ({_ROLES(4)}) UNION ALL SELECT *, 5 FROM p5 WHERE roles IN ({_ROLES(5)})))"""
_FEATS = f"""{_PAT},
ft AS (SELECT DISTINCT * FROM (SELECT case_id, 'role_concept:' || role || ':' || cid AS feature FROM m UNION ALL SELECT case_id, 'arc:' || sr || ':' || sc || '>' || rel || '>' || tr || ':' || tc FROM a UNION ALL SELECT case_id, 'pattern:' || signature FROM pt) WHERE case_id IS NOT NULL)"""
_GRAMS = " UNION ALL ".join(f"SELECT role, value, n, unnest(list_transform(range(1, length(value) - {k - 2}), lambda i: substr(value, i::INT, {k}))) AS term FROM v WHERE length(value) >= {k}" for k in (2, 3, 4))
_CHECKS = """cdoc AS (SELECT DISTINCT case_id, document_id FROM (SELECT case_id, document_id FROM event_nodes UNION ALL SELECT case_id, document_id FROM relation_edges) WHERE case_id IS NOT NULL AND document_id IS NOT NULL),
f AS (SELECT uid, min(case_id) AS node_case, count(*) AS k FROM event_nodes WHERE uid IS NOT NULL GROUP BY uid),
ends AS (SELECT x.case_id, x.uid, f.node_case FROM (SELECT uid, case_id, unnest([head_uid, tail_uid]) AS e FROM relation_edges) x LEFT JOIN f ON f.uid = x.e),
src AS (SELECT 'cross_case_node_source' AS rule, uid, case_id, unnest(source_document_ids) AS document_id FROM event_nodes UNION ALL SELECT 'cross_case_edge_source', uid, case_id, unnest(source_document_ids) FROM relation_edges),
r AS (SELECT 'duplicate_node_uid' AS rule, uid, node_case AS case_id FROM f WHERE k > 1 UNION ALL SELECT 'duplicate_edge_uid', uid, min(case_id) FROM relation_edges WHERE uid IS NOT NULL GROUP BY uid HAVING count(*) > 1
  UNION ALL SELECT 'cross_case_node', uid, min(case_id) FROM event_nodes WHERE uid IS NOT NULL GROUP BY uid HAVING count(DISTINCT case_id) > 1
  UNION ALL SELECT 'unknown_role', uid, case_id FROM event_nodes WHERE NOT coalesce(role IN ('PHENOMENON', 'FAILURE', 'ROOT_CAUSE', 'ACTION', 'VERIFICATION'), FALSE)
  UNION ALL SELECT 'unknown_relation', uid, case_id FROM relation_edges WHERE NOT coalesce(relation_type IN ('CAUSE', 'TREAT', 'VERIFY', 'TEMPORAL'), FALSE)
  UNION ALL SELECT 'dangling_edge', uid, case_id FROM ends WHERE node_case IS NULL UNION ALL SELECT 'cross_case_edge', uid, case_id FROM ends WHERE node_case <> case_id
  UNION ALL SELECT DISTINCT rule, uid, case_id FROM src WHERE document_id IS NOT NULL AND case_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM cdoc WHERE cdoc.case_id = src.case_id AND cdoc.document_id = src.document_id))"""
SQL = {
    "g12_graph_checks": f"WITH {_CHECKS} SELECT rule, count(*) AS n FROM r GROUP BY rule",
    "g13_corpus_summary": f"""WITH {_CHECKS}, k AS (SELECT case_id FROM event_nodes WHERE case_id IS NOT NULL UNION SELECT case_id FROM relation_edges WHERE case_id IS NOT NULL),
n1 AS (SELECT uid, max(CASE WHEN source_span_valid THEN 1 ELSE 0 END) AS v, max(greatest(1, coalesce(len(source_event_ids), 0))) AS s FROM event_nodes WHERE uid IS NOT NULL AND case_id IS NOT NULL GROUP BY uid),
e1 AS (SELECT uid, max(greatest(1, coalesce(len(source_relation_ids), 0))) AS s FROM relation_edges WHERE uid IS NOT NULL AND case_id IS NOT NULL GROUP BY uid)
SELECT (SELECT count(*) FROM k) AS case_count, (SELECT count(*) FROM cdoc) AS document_count, (SELECT count(*) FROM n1) AS node_count, (SELECT count(*) FROM e1) AS edge_count,
  (SELECT coalesce(sum(s), 0)::BIGINT FROM n1) AS source_event_count, (SELECT coalesce(sum(s), 0)::BIGINT FROM e1) AS source_relation_count,
  round((SELECT count(*) FROM n1) / greatest(1, (SELECT sum(s) FROM n1)), 6) AS event_reconstruction_ratio, round((SELECT count(*) FROM e1) / greatest(1, (SELECT sum(s) FROM e1)), 6) AS relation_reconstruction_ratio,
  (SELECT count(*) FROM (SELECT case_id FROM cdoc GROUP BY case_id HAVING count(*) > 1)) AS multi_document_case_count, round((SELECT sum(v) FROM n1) / greatest(1, (SELECT count(*) FROM n1)), 6) AS source_span_provenance_rate,
  (SELECT count(DISTINCT case_id) FROM r WHERE case_id IS NOT NULL) AS case_boundary_violation_count""",
    "g13_case_summary": f"""WITH {_N}, e AS (SELECT case_id, count(DISTINCT uid) AS k FROM relation_edges WHERE uid IS NOT NULL GROUP BY case_id)
SELECT n.case_id, count(*) AS n_nodes, count(DISTINCT document_id) AS n_documents, count(DISTINCT role) AS n_roles, coalesce(max(e.k), 0) AS n_edges FROM n LEFT JOIN e USING (case_id) WHERE n.case_id IS NOT NULL GROUP BY n.case_id""",
    "k3_near_mentions": f"""WITH {_N}, v AS (SELECT role, {_VALUE} AS value, count(*) AS n, min(text) AS text FROM n WHERE role IS NOT NULL AND text IS NOT NULL GROUP BY ALL),
g AS (SELECT role, value, n, term, count(*) AS tf FROM ({_GRAMS}) GROUP BY ALL), df AS (SELECT role, term, sum(n) AS df FROM g GROUP BY ALL), dc AS (SELECT role, sum(n) AS docs FROM v GROUP BY role),
w AS (SELECT role, value, term, (1 + ln(tf)) * (ln((1 + docs) / (1 + df)) + 1) AS w FROM g JOIN df USING (role, term) JOIN dc USING (role)),
u AS (SELECT role, value, term, w / sqrt(sum(w * w) OVER (PARTITION BY role, value)) AS w FROM w),
s AS (SELECT x.role, x.value AS a, y.value AS b, sum(x.w * y.w) AS sim FROM u x JOIN u y ON x.role = y.role AND x.term = y.term AND x.value <> y.value GROUP BY ALL HAVING sum(x.w * y.w) >= 0.92),
t AS (SELECT *, row_number() OVER (PARTITION BY role, a ORDER BY round(sim, 9) DESC, b) AS k FROM s),
p AS (SELECT role, least(a, b) AS a, greatest(a, b) AS b, max(sim) AS sim FROM t WHERE k <= 10 GROUP BY ALL)
SELECT p.role, a, b, round(sim, 6) AS similarity, NOT (len({tq.units('x.text')}) > 0 AND len({tq.units('y.text')}) > 0 AND {tq.units('x.text')} <> {tq.units('y.text')}) AS number_safe
FROM p JOIN v x ON x.role = p.role AND x.value = a JOIN v y ON y.role = p.role AND y.value = b""",
    "g16_patterns": f"WITH {_PAT} SELECT case_id, signature, 'PAT_' || substr(sha1(signature), 1, 16) AS pattern_id, count(*) AS n FROM pt GROUP BY ALL",
    "g19_pattern_support": f"WITH {_PAT} SELECT 'PAT_' || substr(sha1(signature), 1, 16) AS pattern_id, count(DISTINCT case_id) AS support, max(nodes)::BIGINT AS n_nodes FROM pt GROUP BY signature",
    "s25_evidence_features": f"WITH {_FEATS} SELECT case_id, feature FROM ft",
    "s24_weighted_jaccard": f"""WITH {_FEATS}, nc AS (SELECT count(DISTINCT case_id) AS n FROM ft), idf AS (SELECT feature, ln(((SELECT n FROM nc) + 1) / (count(*) + 1)) + 1 AS idf FROM ft GROUP BY feature),
tot AS (SELECT case_id, sum(idf) AS total FROM ft JOIN idf USING (feature) GROUP BY case_id),
i AS (SELECT x.case_id AS query_case, y.case_id, sum(idf) AS shared FROM ft x JOIN ft y USING (feature) JOIN idf USING (feature) WHERE x.case_id <> y.case_id AND TRY_CAST(regexp_extract(x.case_id, '(\\d+)$', 1) AS BIGINT) % 100 = 0 GROUP BY ALL)
SELECT query_case, i.case_id, round(shared / (p.total + q.total - shared), 6) AS evidence FROM i JOIN tot p ON p.case_id = query_case JOIN tot q ON q.case_id = i.case_id""",
}

_NEAR_VALUES = SQL["k3_near_mentions"].split("\nSELECT p.role")[0].replace("WITH ", "WITH RECURSIVE ", 1)
SQL["g15_concepts"] = f"""{_NEAR_VALUES},
ps AS (SELECT p.role, a, b FROM p JOIN v x ON x.role = p.role AND x.value = a JOIN v y ON y.role = p.role AND y.value = b WHERE NOT (len({tq.units('x.text')}) > 0 AND len({tq.units('y.text')}) > 0 AND {tq.units('x.text')} <> {tq.units('y.text')})),
sy AS (SELECT role, a, b FROM ps UNION SELECT role, b, a FROM ps),
re AS (SELECT role, a AS node, a AS seen FROM sy UNION SELECT re.role, re.node, sy.b FROM re JOIN sy ON sy.role = re.role AND sy.a = re.seen),
cp AS (SELECT role, node AS value, min(seen) AS g FROM re GROUP BY ALL),
pl AS (SELECT v.role, v.value, v.n, coalesce(cp.g, v.value) AS g FROM v LEFT JOIN cp USING (role, value)),
lb AS (SELECT role, g, value AS label FROM pl QUALIFY row_number() OVER (PARTITION BY role, g ORDER BY n DESC, length(value) DESC, value) = 1),
mp AS (SELECT pl.role, pl.value, label FROM pl JOIN lb USING (role, g)),
nv AS (SELECT uid, case_id, role, {_VALUE} AS value FROM n WHERE role IS NOT NULL AND text IS NOT NULL)
SELECT 'C_' || substr(role, 1, 3) || '_' || substr(sha1(role || '|' || label), 1, 12) AS concept_id, role, label, count(*) AS member_count, count(DISTINCT case_id) AS case_count, count(DISTINCT value) AS variant_count
FROM nv JOIN mp USING (role, value) GROUP BY role, label"""
