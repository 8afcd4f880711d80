"""Queries of event pairs, source ranking, case vectors and their neighbours."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wrenmill.config import AssociationConfig
from wrenmill.functions import text as t
from wrenmill.operators import concepts, event_states, resolution
from wrenmill.plans import hierarchy_queries as hq
from wrenmill.plans import text_queries as tq
from wrenmill.runtime import table


def _texts(spark: SparkSession, d: str) -> DataFrame:
    return tq.mentions(spark, d).filter("text IS NOT NULL").select("uid", "text")


def s7_token_idf(spark: SparkSession, d: str) -> DataFrame:
    return event_states.token_idf(_texts(spark, d), "text").select("token", "df", F.round("idf", 6).alias("idf"))


def s8_directed_coverage(spark: SparkSession, d: str) -> DataFrame:
    pairs = tq.mention_pairs(spark, d).select("uid", "a", "b")
    out = event_states.directed_coverage(pairs, event_states.token_idf(_texts(spark, d), "text"), "uid", "a", "b", 1.0)
    return out.select("uid", F.round("coverage", 6).alias("coverage"))


def s12_fallback_support(spark: SparkSession, d: str) -> DataFrame:
    p = tq.mention_pairs(spark, d)
    s = event_states.fallback_support(F.col("a"), F.col("b"), F.col("role_a") == F.col("role_b"))
    return p.select("uid", s.alias("s")).select("uid", F.round("s.support", 6).alias("support"), F.round("s.forbidden_risk", 6).alias("risk"), F.col("s.predicted_state").alias("state"))


def _labelled(spark: SparkSession, d: str) -> DataFrame:
    """Decisions as labelled pairs: the stored state is the label, the scores stand for the probabilities."""
    s = F.col("predicted_state")
    label = F.when(s.isin("equivalent", "equivalent_relation"), "equivalent").when(s.isin("conflicting", "conflicting_fact"), "forbidden").otherwise("related")
    r = table(spark, d, "relation_decisions").filter("equivalence_score IS NOT NULL AND confidence IS NOT NULL")
    return r.select("decision_id", label.alias("label"), F.col("equivalence_score").alias("pe"), (1 - F.col("confidence")).alias("pf"), (F.col("confidence") < 0.1).alias("hard"))


def d5_event_states(spark: SparkSession, d: str) -> DataFrame:
    return _labelled(spark, d).select("decision_id", "label", event_states.state_rule(F.col("pe"), F.col("pf"), F.col("hard"), 0.65, 0.45).alias("state"))


def d6_state_metrics(spark: SparkSession, d: str) -> DataFrame:
    m = event_states.grid_metrics(_labelled(spark, d), "label", "pe", "pf", "hard")
    return m.select("eq", "forb", "n", *[F.round(c, 6).alias(c) for c in ("macro_f1", "equivalent_precision", "equivalent_f1", "related_f1", "forbidden_f1", "violation_rate")])


def d7_thresholds(spark: SparkSession, d: str) -> DataFrame:
    return event_states.select_thresholds(event_states.grid_metrics(_labelled(spark, d), "label", "pe", "pf", "hard"))


def g6_ranked_events(spark: SparkSession, d: str) -> DataFrame:
    """The richest mention of each case and role: completeness, details, score, then the smaller id."""
    n = table(spark, d, "event_nodes").filter("uid IS NOT NULL").groupBy("uid").agg(F.min(F.struct("case_id", "role", "text", "score")).alias("n")).select("uid", "n.*")
    text = F.coalesce("text", F.lit(""))
    detail = t.detail_count(text)
    full = n.withColumn("details", detail).withColumn("completeness", F.length(F.regexp_replace(text, r"(?U)\s+", "")) + 6 * F.col("details"))
    w = Window.partitionBy("case_id", "role").orderBy(F.desc("completeness"), F.desc("details"), F.desc(F.coalesce("score", F.lit(0.0))), "uid")
    return full.withColumn("rank", F.row_number().over(w)).filter("rank = 1").select("case_id", "role", "uid", F.col("completeness").cast("bigint").alias("completeness"))


def g7_ranked_relations(spark: SparkSession, d: str) -> DataFrame:
    """The relation of each case and type with the longest evidence, then the higher score, then the smaller id."""
    e = table(spark, d, "relation_edges").filter("uid IS NOT NULL").groupBy("uid").agg(F.min(F.struct("case_id", "relation_type", "evidence_text", "score")).alias("e")).select("uid", "e.*")
    w = Window.partitionBy("case_id", "relation_type").orderBy(F.desc(F.length(F.coalesce("evidence_text", F.lit("")))), F.desc(F.coalesce("score", F.lit(0.0))), "uid")
    return e.withColumn("rank", F.row_number().over(w)).filter("rank = 1").select("case_id", "relation_type", "uid")


def _means(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Unit means of the vectors of rows sorted by case; a case may go on in the next batch."""

    def unit(ids: list[str], sums: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
        m = sums / counts[:, None]
        m = m / np.maximum(np.sqrt((m * m).sum(1)), 1e-12)[:, None]
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.ListArray.from_arrays(np.arange(0, m.size + 1, 64, dtype=np.int32), pa.array(m.ravel()))], ["case_id", "v"])

    last, total, count = None, None, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        ids = batch["case_id"].to_numpy(zero_copy_only=False)
        v = pc.list_flatten(batch["v"]).to_numpy(zero_copy_only=False).reshape(-1, 64)
        at = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]])
        names, sums, counts = list(ids[at]), np.add.reduceat(v, at, axis=0), np.diff(np.r_[at, len(ids)])
        if last is not None:
            if last == names[0]:
                sums[0] += total
                counts[0] += count
            else:
                names, sums, counts = [last, *names], np.vstack([total, sums]), np.r_[count, counts]
        last, total, count = names[-1], sums[-1], counts[-1]
        if len(names) > 1:
            yield unit(names[:-1], sums[:-1], counts[:-1])
    if last is not None:
        yield unit([last], np.array([total]), np.array([count]))


def _case_vectors(spark: SparkSession, d: str) -> DataFrame:
    """(case_id, v): unit mean of the vectors of a case's documents, in one pass over the documents sorted by case."""
    docs = concepts.clean_nodes(table(spark, d, "event_nodes")).filter("case_id IS NOT NULL AND document_id IS NOT NULL").select("case_id", "document_id").distinct()
    u = resolution.unit_vectors(table(spark, d, "document_vectors"))
    return docs.join(u, "document_id").repartition("case_id").sortWithinPartitions("case_id", "document_id").select("case_id", "v").mapInArrow(_means, "case_id string, v array<double>")


def s29_case_vectors(spark: SparkSession, d: str) -> DataFrame:
    return _case_vectors(spark, d).select("case_id", F.round(F.aggregate("v", F.lit(0.0), lambda a, x: a + x), 6).alias("total"))


def s27_association(spark: SparkSession, d: str) -> DataFrame:
    """Weighted sum of vector and evidence similarity of query cases and the cases that share a feature."""
    c = AssociationConfig()
    v = _case_vectors(spark, d)
    jac = hq._evidence(spark, d)[2]
    full = jac.join(v.select(F.col("case_id").alias("query_case"), F.col("v").alias("vq")), "query_case").join(v, "case_id")
    score = c.semantic_weight * resolution.cosine(F.col("vq"), F.col("v")) + c.evidence_weight * F.col("evidence")
    return full.select("query_case", "case_id", F.round(score, 6).alias("association"))


QUERIES = {f.__name__: f for f in (s7_token_idf, s8_directed_coverage, s12_fallback_support, d5_event_states, d6_state_metrics, d7_thresholds, g6_ranked_events, g7_ranked_relations, s29_case_vectors, s27_association)}

_KEEP = f"list_filter(list_distinct({tq.tokens('X')}), lambda k: length(k) > 1 OR regexp_matches(k, '\\p{{Nd}}'))"
_set = lambda x: _KEEP.replace("(X)", f"({x})")
_IDF = f"""tx AS (SELECT uid, text FROM {tq.MENTIONS} m WHERE text IS NOT NULL),
idf AS (SELECT token, count(*) AS df, ln(((SELECT count(*) FROM tx) + 1) / (count(*) + 1)) + 1 AS idf FROM (SELECT unnest({_set('text')}) AS token FROM tx) GROUP BY token)"""
_LAB = """lab AS (SELECT decision_id, CASE WHEN predicted_state IN ('equivalent', 'equivalent_relation') THEN 'equivalent' WHEN predicted_state IN ('conflicting', 'conflicting_fact') THEN 'forbidden' ELSE 'related' END AS label,
  equivalence_score AS pe, 1 - confidence AS pf, confidence < 0.1 AS hard FROM relation_decisions WHERE equivalence_score IS NOT NULL AND confidence IS NOT NULL)"""
_rule = lambda e, f: f"CASE WHEN pe >= {e} AND NOT hard THEN 'equivalent' WHEN pf >= {f} THEN 'forbidden' ELSE 'related' END"
_f1 = lambda s: f"coalesce(2.0 * count(*) FILTER (label = '{s}' AND p = '{s}') / nullif(count(*) FILTER (p = '{s}') + count(*) FILTER (label = '{s}'), 0), 0.0)"
_in = lambda s: f"(count(*) FILTER (p = '{s}' OR label = '{s}') > 0)::INT"
_GRID = f"""{_LAB}, gr AS (SELECT eq, forb FROM (SELECT unnest([0.55, 0.6, 0.65, 0.7, 0.75]::DOUBLE[]) AS eq), (SELECT unnest([0.35, 0.4, 0.45, 0.5, 0.55, 0.6]::DOUBLE[]) AS forb)),
pr AS (SELECT eq, forb, label, {_rule('eq', 'forb')} AS p FROM lab, gr),
me AS (SELECT eq, forb, count(*) AS n, ({_f1('equivalent')} + {_f1('related')} + {_f1('forbidden')}) / ({_in('equivalent')} + {_in('related')} + {_in('forbidden')}) AS macro_f1,
  coalesce(count(*) FILTER (label = 'equivalent' AND p = 'equivalent') / nullif(count(*) FILTER (p = 'equivalent'), 0), 0.0) AS equivalent_precision,
  {_f1('equivalent')} AS equivalent_f1, {_f1('related')} AS related_f1, {_f1('forbidden')} AS forbidden_f1,
  coalesce(count(*) FILTER (label = 'forbidden' AND p = 'equivalent') / nullif(count(*) FILTER (label = 'forbidden'), 0), 0.0) AS violation_rate FROM pr GROUP BY eq, forb)"""
SQL = {
    "s7_token_idf": f"WITH {_IDF} SELECT token, df, round(idf, 6) AS idf FROM idf",
    "s8_directed_coverage": f"""WITH {_IDF}, p AS (SELECT uid, {_set('a')} AS sa, {_set('b')} AS sb FROM {tq.PAIRS}),
l AS (SELECT uid, unnest(sa) AS token, sb FROM p), s AS (SELECT uid, sum(coalesce(idf, 1.0)) AS total, sum(CASE WHEN list_contains(sb, token) THEN coalesce(idf, 1.0) ELSE 0 END) AS hit FROM l LEFT JOIN idf USING (token) GROUP BY uid)
SELECT p.uid, round(coalesce(hit / total, 0.0), 6) AS coverage FROM p LEFT JOIN s USING (uid)""",
    "s12_fallback_support": f"""WITH f AS (SELECT uid, role_a = role_b AS c, {tq.similar('a', 'b')} AS fit FROM {tq.PAIRS})
SELECT uid, round(CASE WHEN c THEN fit ELSE 0.0 END, 6) AS support, round(CASE WHEN c THEN 0.0 ELSE fit END, 6) AS risk, CASE WHEN c AND fit >= 0.72 THEN 'equivalent_entity' ELSE 'related_not_equivalent' END AS state FROM f""",
    "d5_event_states": f"WITH {_LAB} SELECT decision_id, label, {_rule(0.65, 0.45)} AS state FROM lab",
    "d6_state_metrics": f"WITH {_GRID} SELECT eq, forb, n, " + ", ".join(f"round({c}, 6) AS {c}" for c in ("macro_f1", "equivalent_precision", "equivalent_f1", "related_f1", "forbidden_f1", "violation_rate")) + " FROM me",
    "d7_thresholds": f"""WITH {_GRID} SELECT eq AS equivalent_threshold, forb AS forbidden_threshold FROM me
ORDER BY (equivalent_precision >= 0.9 AND violation_rate <= 0.1) DESC, round(macro_f1, 9) DESC, round(least(related_f1, forbidden_f1), 9) DESC, round(equivalent_f1, 9) DESC, round(violation_rate, 9), eq, forb LIMIT 1""",
    "g6_ranked_events": f"""WITH n AS (SELECT uid, x.* FROM (SELECT uid, min(struct_pack(case_id, role, text, score)) AS x FROM event_nodes WHERE uid IS NOT NULL GROUP BY uid)),
f AS (SELECT *, len({tq.all_of("coalesce(text, '')", t.DETAIL)}) AS details FROM n), g AS (SELECT *, length(regexp_replace(coalesce(text, ''), '{tq.WS}', '', 'g')) + 6 * details AS completeness FROM f)
SELECT case_id, role, uid, completeness::BIGINT AS completeness FROM g QUALIFY row_number() OVER (PARTITION BY case_id, role ORDER BY completeness DESC, details DESC, coalesce(score, 0.0) DESC, uid) = 1""",
    "g7_ranked_relations": """WITH e AS (SELECT uid, x.* FROM (SELECT uid, min(struct_pack(case_id, relation_type, evidence_text, score)) AS x FROM relation_edges WHERE uid IS NOT NULL GROUP BY uid))
SELECT case_id, relation_type, uid FROM e QUALIFY row_number() OVER (PARTITION BY case_id, relation_type ORDER BY length(coalesce(evidence_text, '')) DESC, coalesce(score, 0.0) DESC, uid) = 1""",
}
