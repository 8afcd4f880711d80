"""Queries of local graphs, event decisions and the reconstruction of case graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wrenmill.functions import text as t
from wrenmill.operators import case_graphs as cg
from wrenmill.operators import event_states, nested_tables, relation_states
from wrenmill.plans import core_pipeline_queries as cp
from wrenmill.plans import text_queries as tq
from wrenmill.runtime import materialize, table


def _local(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return cg.normalize_local_graphs(nested_tables.route(table(spark, d, "local_graphs")))


def g11_local_events(spark: SparkSession, d: str) -> DataFrame:
    return _local(spark, d)[0].select("event_id", "document_id", "event_type", "text", "start", "end", "evidence_text", F.round("score", 6).alias("score"))


def g11_local_relations(spark: SparkSession, d: str) -> DataFrame:
    return _local(spark, d)[1].select("relation_id", "document_id", "head", "relation_type", "tail", "evidence_text", F.round("score", 6).alias("score"))


def _events(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "event_nodes").filter("uid IS NOT NULL").groupBy("uid").agg(F.min(F.struct("case_id", "role", "text", "document_id", "score")).alias("n")).select("uid", "n.*")
    return n.filter("case_id IS NOT NULL").select(F.col("uid").alias("event_id"), "case_id", "document_id", F.col("role").alias("event_type"), "text", F.lit(None).cast("string").alias("evidence_text"), "score")


def _relations(spark: SparkSession, d: str) -> DataFrame:
    """Source relations; the least edge that names one stands for it."""
    e = table(spark, d, "relation_edges").filter("uid IS NOT NULL").withColumn("rid", F.explode("source_relation_ids")).filter("rid IS NOT NULL")
    least = F.min(F.struct("uid", "head_uid", "tail_uid", "relation_type", "evidence_text", "case_id", "document_id", "score"))
    one = e.groupBy(cg.spelled(F.col("rid")).alias("relation_id")).agg(least.alias("e")).select("relation_id", "e.*").filter("case_id IS NOT NULL")
    return one.select("relation_id", "case_id", "document_id", F.col("head_uid").alias("head"), "relation_type", F.col("tail_uid").alias("tail"), "evidence_text", "score")


def _relation_decisions(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "relation_decisions").distinct()
    score = r.select("decision_id", F.coalesce("equivalence_score", F.lit(0.0)).alias("equivalence_score")).groupBy("decision_id").agg(F.max("equivalence_score").alias("equivalence_score"))
    return relation_states.normalize_decisions(r).distinct().join(score, "decision_id", "left")


def d12_event_decisions(spark: SparkSession, d: str) -> DataFrame:
    """Stored decisions read as event decisions in their alternate spelling."""
    r = table(spark, d, "relation_decisions").select("decision_id", F.col("relation_a_id").alias("event_a"), F.col("relation_b_id").alias("event_b"), "predicted_state", F.col("equivalence_score").alias("score"), "confidence", F.col("decision_reasons").alias("reason_codes"))
    out = cg.normalize_event_decisions(r)
    return out.withColumns({"equivalence_support": F.round("equivalence_support", 6), "confidence": F.round("confidence", 6), "decision_reasons": F.array_join("decision_reasons", "|")})


def _derived(spark: SparkSession, d: str, relations: DataFrame, decisions: DataFrame) -> DataFrame:
    """Event decisions of the ends; the fallback support of two mentions fills the map."""
    # forms of each mention once, for all the pairs it is in
    n = _events(spark, d).select("event_id", F.struct(F.coalesce("event_type", F.lit("")).alias("role"), t.mention_form(F.coalesce("text", F.lit(""))).alias("form")).alias("node"))
    n = materialize(n, "mention-forms")
    of = lambda s, x: n.select(F.col("event_id").alias(f"{s}_{x}"), F.col("node").alias(f"{s}_{x}_node"))
    side = lambda x: relations.select(F.col("relation_id").alias(f"relation_{x}_id"), F.col("head").alias(f"head_{x}"), F.col("tail").alias(f"tail_{x}")).join(of("head", x), f"head_{x}", "left").join(of("tail", x), f"tail_{x}", "left")
    full = decisions.select("decision_id", "relation_a_id", "relation_b_id").distinct().join(side("a"), "relation_a_id").join(side("b"), "relation_b_id")
    none = F.struct(F.lit("").alias("role"), F.struct(F.lit("").alias("normal"), F.array().cast("array<string>").alias("grams")).alias("form"))
    full = full.withColumns({f"{e}_{x}_node": F.coalesce(f"{e}_{x}_node", none) for e in ("head", "tail") for x in "ab"})
    fits = {name: t.form_similarity(F.col(f"{a}_a_node.form"), F.col(f"{b}_b_node.form")) for name, a, b in cg.ENDPOINTS}
    full = full.withColumns({f"fit_{name}": fit for name, fit in fits.items()})
    entries = [x for name, a, b in cg.ENDPOINTS for x in (F.lit(name), event_states.fallback_of(F.col(f"fit_{name}"), F.col(f"{a}_a_node.role") == F.col(f"{b}_b_node.role")))]
    mapped = full.select("decision_id", "relation_a_id", "relation_b_id", F.create_map(*entries).alias("endpoint_mapping_support"))
    return cg.derive_event_decisions(relations, mapped)


def d14_derived_decisions(spark: SparkSession, d: str) -> DataFrame:
    out = _derived(spark, d, _relations(spark, d), _relation_decisions(spark, d))
    r = lambda c: F.round(c, 6).alias(c)
    return out.select("decision_id", "event_a_id", "event_b_id", "event_state", r("equivalence_support"), r("forbidden_risk"), r("confidence"), "hard_veto", F.array_join("decision_reasons", "|").alias("reasons"))


def _built(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    relations, decisions, events = (materialize(f(spark, d), "graph-input") for f in (_relations, _relation_decisions, _events))
    derived = materialize(_derived(spark, d, relations, decisions), "graph-input")
    documents = events.select("document_id", "case_id").unionByName(relations.select("document_id", "case_id")).filter("document_id IS NOT NULL").distinct()
    return cg.build(events, relations, documents, derived, decisions)


def g5_case_events(spark: SparkSession, d: str) -> DataFrame:
    return _built(spark, d)["event_events"]


def g8_case_relations(spark: SparkSession, d: str) -> DataFrame:
    return _built(spark, d)["relation_relations"]


def g8_review(spark: SparkSession, d: str) -> DataFrame:
    b = _built(spark, d)
    return b["event_review"].union(b["relation_review"])


def g9_violations(spark: SparkSession, d: str) -> DataFrame:
    return _built(spark, d)["violations"].groupBy("invariant").agg(F.count(F.lit(1)).alias("n"))


def g10_case_summary(spark: SparkSession, d: str) -> DataFrame:
    return _built(spark, d)["summary"]


def g10_ignored_decisions(spark: SparkSession, d: str) -> DataFrame:
    """Relation decisions without a known end, or across cases."""
    return cg.ignored(cg.within_case(_relation_decisions(spark, d), _relations(spark, d), "relation_id", "relation_a_id", "relation_b_id"))


QUERIES = {f.__name__: f for f in (g11_local_events, g11_local_relations, d12_event_decisions, d14_derived_decisions, g5_case_events, g8_case_relations, g8_review, g9_violations, g10_case_summary, g10_ignored_decisions)}

_SPELL = lambda x: f"regexp_replace({x}, '^([^:]*):', '\\1_')"
_GLOBAL = lambda x: f"CASE WHEN starts_with({x}, doc || '_') OR starts_with({x}, doc || ':') THEN {_SPELL(x)} ELSE doc || '_' || {x} END"
_KEPT = r"[^。！？；\n]"
_SAID = lambda s, e: f"CASE WHEN length(txt) > 0 AND {s} >= 0 AND {e} > {s} AND {e} <= length(txt) THEN regexp_replace(regexp_extract(substr(txt, 1, {s}), '{_KEPT}*$') || substr(txt, {s} + 1, {e} - {s}) || regexp_extract(substr(txt, {e} + 1), '^{_KEPT}*[。！？；\n]?'), '^{tq.WS}|{tq.WS}$', '', 'g') ELSE '' END"
# graphs with their line and reading order; the walk of the envelope SQL has none, and only the first of a document counts, equal ones being alike
_LISTS = cp._P7_LISTS.split("n AS (")[0].rstrip().rstrip(",")
_LOCAL = f"""{_LISTS.replace("SELECT CASE WHEN line LIKE", "SELECT line_no, CASE WHEN line LIKE").replace("SELECT l::JSON AS j FROM raw", "SELECT line_no, l::JSON AS j FROM raw").replace("SELECT j AS v FROM ok", "SELECT line_no, j AS v FROM ok").replace("SELECT x.value FROM w", "SELECT w.line_no, x.value FROM w").replace("g AS (SELECT v AS g FROM w", "g AS (SELECT line_no, v AS g FROM w").replace("SELECT g ->> '$.document_id' AS document_id,", "SELECT line_no, g, g ->> '$.document_id' AS document_id,")},
gf AS (SELECT document_id AS doc, coalesce(g ->> '$.text', '') AS txt, nodes, rels FROM (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY line_no) AS k FROM gg WHERE document_id IS NOT NULL) WHERE k = 1),
nn AS (SELECT doc, txt, x, i, coalesce(x ->> '$.event_id', x ->> '$.entity_id', x ->> '$.node_id') AS id FROM (SELECT doc, txt, unnest(CAST(nodes AS JSON[])) AS x, unnest(range(1, json_array_length(nodes)::BIGINT + 1)) AS i FROM gf)),
ev AS (SELECT *, {_GLOBAL('id')} AS event_id, upper(coalesce(x ->> '$.type', x ->> '$.entity_type', 'UNKNOWN')) AS event_type, coalesce(x ->> '$.text', x ->> '$.name', '') AS said,
  coalesce(TRY_CAST(x ->> '$.start' AS INT), -1) AS st, coalesce(TRY_CAST(x ->> '$.end' AS INT), -1) AS en FROM nn WHERE id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY doc, id ORDER BY i) = 1),
rr AS (SELECT doc, txt, x, i, coalesce(x ->> '$.relation_id', x ->> '$.id') AS id, coalesce(x ->> '$.head_event_id', x ->> '$.head', '') AS h, coalesce(x ->> '$.tail_event_id', x ->> '$.tail', '') AS t
  FROM (SELECT doc, txt, unnest(CAST(rels AS JSON[])) AS x, unnest(range(1, json_array_length(rels)::BIGINT + 1)) AS i FROM gf)),
re AS (SELECT rr.*, a.st AS hs, a.en AS he, b.st AS ts, b.en AS te FROM (SELECT * FROM rr WHERE id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY doc, id ORDER BY i) = 1) rr
  LEFT JOIN ev a ON a.doc = rr.doc AND a.id = h LEFT JOIN ev b ON b.doc = rr.doc AND b.id = t)"""
_LEAST_EDGE = f"""se AS (SELECT rid, x.* FROM (SELECT {_SPELL('rid')} AS rid, min(struct_pack(uid, head_uid, tail_uid, relation_type, evidence_text, case_id, document_id, score)) AS x
  FROM (SELECT *, unnest(source_relation_ids) AS rid FROM relation_edges WHERE uid IS NOT NULL) WHERE rid IS NOT NULL GROUP BY 1) WHERE x.case_id IS NOT NULL)"""
_EVENT_ALIASES = ", ".join(f"{tq.q(k)}: {tq.q(v)}" for k, v in cg.EVENT_STATES.items())
_ENDS = " UNION ALL ".join(f"SELECT '{name}' AS role, a.{x}_uid AS x, b.{y}_uid AS y FROM dd JOIN se a ON a.rid = ra JOIN se b ON b.rid = rb" for name, x, y in cg.ENDPOINTS)
SQL = {
    "g11_local_events": f"""{_LOCAL}
SELECT event_id, doc AS document_id, event_type, said AS text, st AS start, en AS "end", coalesce(nullif(x ->> '$.evidence_sentence', ''), {_SAID('st', 'en')}) AS evidence_text, round(CAST(coalesce(x ->> '$.score', x ->> '$.confidence') AS DOUBLE), 6) AS score FROM ev""",
    "g11_local_relations": f"""{_LOCAL}
SELECT {_GLOBAL('id')} AS relation_id, doc AS document_id, {_GLOBAL('h')} AS head, upper(coalesce(x ->> '$.type', x ->> '$.relation', x ->> '$.relation_type', 'UNKNOWN')) AS relation_type, {_GLOBAL('t')} AS tail,
  coalesce(nullif(coalesce(x ->> '$.evidence_text', x ->> '$.evidence_sentence'), ''), CASE WHEN hs IS NOT NULL AND ts IS NOT NULL THEN {_SAID('least(hs, ts)', 'greatest(he, te)')} END, '') AS evidence_text, round(CAST(coalesce(x ->> '$.score', x ->> '$.confidence') AS DOUBLE), 6) AS score FROM re""",
    "d12_event_decisions": f"""WITH d AS (SELECT *, coalesce(MAP {{{_EVENT_ALIASES}}}[coalesce(predicted_state, 'uncertain')], 'uncertain') AS event_state FROM relation_decisions)
SELECT coalesce(decision_id, '') AS decision_id, {_SPELL("coalesce(relation_a_id, '')")} AS event_a_id, {_SPELL("coalesce(relation_b_id, '')")} AS event_b_id, event_state, round(coalesce(equivalence_score, 0.0), 6) AS equivalence_support, 0.0::DOUBLE AS forbidden_risk,
  round(coalesce(nullif(confidence, 0), equivalence_score, 0.0), 6) AS confidence, event_state = 'forbidden' AS hard_veto, coalesce(array_to_string(decision_reasons, '|'), '') AS decision_reasons FROM d""",
    "d14_derived_decisions": f"""WITH {_LEAST_EDGE},
n AS (SELECT uid, coalesce(x.role, '') AS role, coalesce(x.text, '') AS text FROM (SELECT uid, min(struct_pack(case_id, role, text, document_id, score)) AS x FROM event_nodes WHERE uid IS NOT NULL GROUP BY uid) WHERE x.case_id IS NOT NULL),
dd AS (SELECT DISTINCT decision_id, {_SPELL("coalesce(relation_a_id, '')")} AS ra, {_SPELL("coalesce(relation_b_id, '')")} AS rb FROM relation_decisions),
en AS ({_ENDS}),
ft AS (SELECT en.role, least(x, y) AS a, greatest(x, y) AS b, coalesce(p.role, '') = coalesce(q.role, '') AS c, {tq.similar("coalesce(p.text, '')", "coalesce(q.text, '')")} AS fit FROM en LEFT JOIN n p ON p.uid = x LEFT JOIN n q ON q.uid = y WHERE x <> y),
gr AS (SELECT a, b, bool_or(c) AS same, max(CASE WHEN c THEN fit ELSE 0 END) AS support, max(CASE WHEN c THEN 0 ELSE fit END) AS risk, max(fit) AS confidence, array_to_string(list_sort(list(DISTINCT 'embedded_endpoint:' || role)), '|') AS reasons FROM ft WHERE fit >= 0.72 GROUP BY a, b)
SELECT 'S36_ED' || lpad((row_number() OVER (ORDER BY a || chr(1) || b))::VARCHAR, 6, '0') AS decision_id, a AS event_a_id, b AS event_b_id, CASE WHEN same THEN 'equivalent' ELSE 'related' END AS event_state,
  round(support, 6) AS equivalence_support, round(risk, 6) AS forbidden_risk, round(confidence, 6) AS confidence, FALSE AS hard_veto, reasons FROM gr""",
    "g10_ignored_decisions": f"""WITH {_LEAST_EDGE}, d AS (SELECT DISTINCT * FROM relation_decisions),
dd AS (SELECT DISTINCT decision_id, {_SPELL("coalesce(relation_a_id, '')")} AS ra, {_SPELL("coalesce(relation_b_id, '')")} AS rb, coalesce(MAP {{{", ".join(f"{tq.q(k)}: {tq.q(v)}" for k, v in relation_states.STATE_ALIASES.items())}}}[coalesce(predicted_state, 'uncertain')], 'uncertain') AS st,
  coalesce(nullif(confidence, 0), nullif(equivalence_score, 0), 0.0) AS cf, coalesce(array_to_string(list_filter(decision_reasons, lambda x: list_contains([{", ".join(tq.q(c) for c in relation_states.CONFLICT_CODES)}], x)), '|'), '') AS dims FROM d),
f AS (SELECT CASE WHEN a.case_id IS NULL OR b.case_id IS NULL THEN 'unknown' WHEN a.case_id <> b.case_id THEN 'cross_case' END AS fault FROM dd LEFT JOIN se a ON a.rid = ra LEFT JOIN se b ON b.rid = rb)
SELECT fault, count(*) AS n_decisions FROM f WHERE fault IS NOT NULL GROUP BY fault""",
}
