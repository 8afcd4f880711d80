"""Queries of case resolution and relation decisions."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wrenmill.operators import relation_states as r
from wrenmill.operators import resolution as res
from wrenmill.plans import text_queries as tq
from wrenmill.runtime import materialize, spread, table


def searched(spark: SparkSession, d: str) -> DataFrame:
    """The query set of searches: records whose number is divisible by 100."""
    ids = table(spark, d, "records").select("document_id").distinct()
    return ids.filter(F.regexp_extract("document_id", r"(\d+)$", 1).cast("bigint") % 100 == 0)


def _weights(spark: SparkSession, d: str) -> DataFrame:
    recs = res.clean_records(table(spark, d, "records"))
    return res.bm25_weights(res.tokenized(recs))


def s1_bm25_idf(spark: SparkSession, d: str) -> DataFrame:
    recs = res.clean_records(table(spark, d, "records"))
    tokens = res.tokenized(recs)
    return res.bm25_idf(res.postings(tokens), tokens.count()).select("token", "df", F.round("idf", 6).alias("idf"))


def s2_self_score(spark: SparkSession, d: str) -> DataFrame:
    return _weights(spark, d).groupBy("document_id").agg(F.round(F.sum("w"), 6).alias("own"))


def s3_symmetric_bm25(spark: SparkSession, d: str) -> DataFrame:
    return res.bm25_pairs(searched(spark, d), table(spark, d, "records")).select("query_id", "document_id", F.round("bm25", 6).alias("bm25"))


def s4_unit_vectors(spark: SparkSession, d: str) -> DataFrame:
    u = res.unit_vectors(table(spark, d, "document_vectors"))
    return u.select("document_id", F.round(F.aggregate("v", F.lit(0.0), lambda a, x: a + x), 6).alias("total"))


def s4_missing_vectors(spark: SparkSession, d: str) -> DataFrame:
    return res.missing_vectors(table(spark, d, "records"), res.unit_vectors(table(spark, d, "document_vectors")))


def _hybrid(spark: SparkSession, d: str) -> DataFrame:
    return res.hybrid(res.symmetric_bm25(searched(spark, d), _weights(spark, d)), res.unit_vectors(table(spark, d, "document_vectors")))


def s6_hybrid_score(spark: SparkSession, d: str) -> DataFrame:
    return _hybrid(spark, d).select("query_id", "document_id", F.round("cosine", 6).alias("cosine"), F.round("score", 6).alias("score"))


def k1_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Candidates of all records; every record is a query here, not only those of searched()."""
    return res.searched_candidates(None, table(spark, d, "records"), table(spark, d, "document_vectors")).select("query_id", "document_id", "rank")


def d1_slots(spark: SparkSession, d: str) -> DataFrame:
    return res.slots(res.clean_records(table(spark, d, "records"))).groupBy("document_id", "slot", "value", "modality", "confidence", "eligible").agg(F.count(F.lit(1)).alias("n"))


def d4_pair_decisions(spark: SparkSession, d: str) -> DataFrame:
    out = res.decisions(searched(spark, d), table(spark, d, "records"), table(spark, d, "document_vectors"))
    return out.select("query_id", "document_id", "rank", "conflicts", "hard", F.round("conflict_score", 2).alias("conflict_score"), F.round("final_score", 6).alias("final_score"), "same_case")


def g1_cases(spark: SparkSession, d: str) -> DataFrame:
    """Cases of all records; every record is a query here, not only those of searched()."""
    records = table(spark, d, "records")
    out = res.judged(res.all_candidates(records, table(spark, d, "document_vectors")), res.clean_records(records))
    pairs = out.select(F.col("query_id").alias("a"), F.col("document_id").alias("b"), F.col("final_score").alias("score"))
    return res.cluster(materialize(pairs, "case-pairs"), records, 0.40817840781035897)


def relation_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Decided relation pairs with their end texts; the least edge of a source relation id stands for it."""
    edges = table(spark, d, "relation_edges").filter("uid IS NOT NULL").select("uid", "head_uid", "tail_uid", "relation_type", "evidence_text", F.explode("source_relation_ids").alias("rid"))
    edges = edges.filter("rid IS NOT NULL").groupBy(F.regexp_replace("rid", "^([^:]*):", "$1_").alias("rid")).agg(F.min(F.struct("uid", "head_uid", "tail_uid", "relation_type", "evidence_text")).alias("e")).select("rid", "e.*")
    nodes = table(spark, d, "event_nodes").filter("uid IS NOT NULL").groupBy("uid").agg(F.min("text").alias("text"))
    full = edges.join(nodes.select(F.col("uid").alias("head_uid"), F.col("text").alias("head_text")), "head_uid", "left").join(nodes.select(F.col("uid").alias("tail_uid"), F.col("text").alias("tail_text")), "tail_uid", "left")
    side = lambda s: full.select(F.col("rid").alias(f"relation_{s}_id"), F.col("head_text").alias(f"head_text_{s}"), F.col("tail_text").alias(f"tail_text_{s}"), F.col("relation_type").alias(f"relation_type_{s}"), F.col("evidence_text").alias(f"evidence_sentence_{s}"))
    decided = r.normalize_decisions(table(spark, d, "relation_decisions").distinct()).select("decision_id", "relation_a_id", "relation_b_id", F.col("confidence").alias("given")).distinct()
    return decided.join(side("a"), "relation_a_id").join(side("b"), "relation_b_id")


def _featured(spark: SparkSession, d: str) -> DataFrame:
    f = r.features(spread(relation_pairs(spark, d)))
    # no encoder here: the lexical similarities stand in for the semantic ones
    stand_in = {"bge_direct_head_text": "direct_head_text", "bge_direct_tail_text": "direct_tail_text", "bge_reverse_head_text": "reverse_head_text", "bge_reverse_tail_text": "reverse_tail_text", "relation_semantic_similarity": "evidence_similarity"}
    return f.withColumns({k: F.col(v) for k, v in stand_in.items()})


def s13_relation_features(spark: SparkSession, d: str) -> DataFrame:
    names = (*r.TEXT_FEATURES, *r.CONFLICT_FEATURES)
    return _featured(spark, d).select("decision_id", "relation_a_id", "relation_b_id", *[F.round(n, 6).alias(n) for n in names])


def s15_equivalence_score(spark: SparkSession, d: str) -> DataFrame:
    return _featured(spark, d).select("decision_id", "relation_a_id", "relation_b_id", F.round(r.equivalence_score(), 6).alias("score"))


def s16_conflict_score(spark: SparkSession, d: str) -> DataFrame:
    return _featured(spark, d).select("decision_id", "relation_a_id", "relation_b_id", F.round(r.conflict_score(), 6).alias("score"))


def s18_veto_reasons(spark: SparkSession, d: str) -> DataFrame:
    return _featured(spark, d).select("decision_id", "relation_a_id", "relation_b_id", F.array_join(r.conflict_reasons(), "|").alias("conflicts"), F.array_join(r.veto_reasons(), "|").alias("vetoes"))


def d10_relation_states(spark: SparkSession, d: str) -> DataFrame:
    out = r.decide(_featured(spark, d), 0.35, 0.5, F.col("given"), 0.5, margin=0.05)
    return out.select("decision_id", "relation_a_id", "relation_b_id", "predicted_state", "graph_action", F.round("confidence", 6).alias("confidence"), F.array_join("reason_codes", "|").alias("reasons"))


def d13_normalized_decisions(spark: SparkSession, d: str) -> DataFrame:
    return r.normalize_decisions(table(spark, d, "relation_decisions"))


QUERIES = {f.__name__: f for f in (s1_bm25_idf, s2_self_score, s3_symmetric_bm25, s4_unit_vectors, s4_missing_vectors, s6_hybrid_score, k1_candidates, d1_slots, d4_pair_decisions, g1_cases, s13_relation_features, s15_equivalence_score, s16_conflict_score, s18_veto_reasons, d10_relation_states, d13_normalized_decisions)}

_RECS = "recs AS (SELECT document_id, coalesce(min(text), '') AS text FROM records WHERE document_id IS NOT NULL GROUP BY document_id)"
_BM25 = f"""{_RECS},
tok AS (SELECT document_id, {tq.tokens('text')} AS ts FROM recs),
stat AS (SELECT count(*) AS n, avg(len(ts)) AS average FROM tok),
post AS (SELECT document_id, len(ts) AS length, token, count(*) AS tf FROM (SELECT document_id, ts, unnest(ts) AS token FROM tok) GROUP BY ALL),
idf AS (SELECT token, count(*) AS df, ln(1 + ((SELECT n FROM stat) - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM post GROUP BY token),
w AS (SELECT document_id, token, idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * length / (SELECT average FROM stat))) AS w FROM post JOIN idf USING (token)),
own AS (SELECT document_id, sum(w) AS own FROM w GROUP BY document_id),
qs AS (SELECT DISTINCT document_id FROM records WHERE TRY_CAST(regexp_extract(document_id, '(\\d+)$', 1) AS BIGINT) % 100 = 0),
pairs AS (SELECT l.document_id AS query_id, r.document_id, sum(l.w) AS a, sum(r.w) AS b FROM w l JOIN w r USING (token)
  WHERE l.document_id IN (SELECT document_id FROM qs) AND l.document_id <> r.document_id GROUP BY ALL),
bm AS (SELECT query_id, p.document_id, least(1.0, greatest(0.0, (b / x.own + a / y.own) / 2)) AS bm25 FROM pairs p JOIN own x ON x.document_id = p.query_id JOIN own y ON y.document_id = p.document_id)"""
_UNIT = """u AS (SELECT document_id, list_transform(v, lambda x: x / greatest(sqrt(list_sum(list_transform(v, lambda y: y * y))), 1e-12)) AS v FROM (
  SELECT document_id, min(embedding::DOUBLE[]) AS v FROM document_vectors WHERE document_id IS NOT NULL AND len(embedding) = 64
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0 GROUP BY document_id))"""
_HYBRID = f"""{_BM25}, {_UNIT},
hy AS (SELECT query_id, bm.document_id, bm25, coalesce(least(1.0, greatest(0.0, list_dot_product(x.v, y.v))), 0.0) AS cosine
  FROM bm LEFT JOIN u x ON x.document_id = query_id LEFT JOIN u y ON y.document_id = bm.document_id),
sc AS (SELECT *, 0.75 * bm25 + 0.25 * cosine AS score FROM hy),
top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, document_id) AS rank FROM sc) WHERE rank <= 20)"""
_EVERY = re.sub(r"qs AS .*\n", "", _HYBRID).replace("l.document_id IN (SELECT document_id FROM qs) AND ", "")
_ENDS = "list_transform(regexp_extract_all(text, '[^。！？；\\n]*[。！？；\\n]|[^。！？；\\n]+$'), lambda p: p)"
_SLOTS = f"""sen AS (SELECT document_id, unnest({_ENDS}) AS s FROM recs),
sm AS (SELECT document_id, s, {tq.cases('s', (tq.t.SUSPECTED, 'suspected'), (tq.t.POSSIBLE, 'possible'), (tq.t.CONFIRMED, 'confirmed'), other='unknown')} AS modality FROM sen),
sv AS ({' UNION ALL '.join(f"SELECT document_id, modality, {tq.q(s)} AS slot, unnest({tq.all_of('s', p)}) AS value FROM sm" for s, p in tq.t.SLOT_PATTERNS.items())}),
sl AS (SELECT *, CASE WHEN slot IN ('component', 'phenomenon', 'damage_state') THEN CASE WHEN modality = 'confirmed' THEN 0.96 ELSE 0.9 END ELSE CASE WHEN modality = 'confirmed' THEN 0.84 ELSE 0.78 END END AS confidence,
  slot IN ('component', 'phenomenon', 'damage_state') AND modality NOT IN ('possible', 'suspected') AS eligible FROM sv)"""
_cat = lambda words: "list_filter([" + ", ".join(f"CASE WHEN regexp_matches(said, {tq.q('|'.join(ws))}) THEN {tq.q(c)} END" for c, ws in sorted(words.items())) + "], lambda x: x IS NOT NULL)"
_PROFILE = f"""pr AS (SELECT document_id, {_cat(res.SYSTEMS)} AS systems, {_cat(res.FAMILIES)} AS components, damage FROM (
  SELECT document_id, lower(coalesce(array_to_string(list_sort(list(DISTINCT value) FILTER (eligible)), ' '), '')) AS said,
    coalesce(list(DISTINCT value) FILTER (slot = 'damage_state' AND modality = 'confirmed'), []) AS damage FROM sl GROUP BY document_id))"""
_apart = lambda c: f"coalesce(len(x.{c}) > 0 AND len(y.{c}) > 0 AND NOT list_has_any(x.{c}, y.{c}), FALSE)"
_EDGE = """e AS (SELECT rid, e.* FROM (SELECT regexp_replace(rid, '^([^:]*):', '\\1_') AS rid, min(struct_pack(uid, head_uid, tail_uid, relation_type, evidence_text)) AS e
  FROM (SELECT *, unnest(source_relation_ids) AS rid FROM relation_edges WHERE uid IS NOT NULL) WHERE rid IS NOT NULL GROUP BY 1)),
n AS (SELECT uid, min(text) AS text FROM event_nodes WHERE uid IS NOT NULL GROUP BY uid),
fe AS (SELECT e.rid, coalesce(h.text, '') AS head_text, coalesce(t.text, '') AS tail_text, coalesce(upper(relation_type), '') AS rt, coalesce(evidence_text, '') AS ev FROM e LEFT JOIN n h ON h.uid = e.head_uid LEFT JOIN n t ON t.uid = e.tail_uid)"""
_STATES = ", ".join(f"{tq.q(k)}: {tq.q(v)}" for k, v in r.STATE_ALIASES.items())
_CODES = ", ".join(tq.q(c) for c in r.CONFLICT_CODES)
_DEC = f"""dec AS (SELECT decision_id, regexp_replace(coalesce(relation_a_id, ''), '^([^:]*):', '\\1_') AS relation_a_id, regexp_replace(coalesce(relation_b_id, ''), '^([^:]*):', '\\1_') AS relation_b_id,
  coalesce(MAP {{{_STATES}}}[coalesce(predicted_state, 'uncertain')], 'uncertain') AS relation_state,
  coalesce(nullif(confidence, 0), nullif(equivalence_score, 0), 0.0) AS confidence,
  coalesce(array_to_string(list_filter(decision_reasons, lambda x: list_contains([{_CODES}], x)), '|'), '') AS conflict_dimensions FROM relation_decisions)"""
_FEAT = f"""{_DEC}, {_EDGE},
p AS (SELECT DISTINCT decision_id, relation_a_id, relation_b_id, confidence AS given FROM dec),
j AS (SELECT p.*, a.head_text AS ha, a.tail_text AS ta, a.rt AS ra, a.ev AS ea, b.head_text AS hb, b.tail_text AS tb, b.rt AS rb, b.ev AS eb FROM p JOIN fe a ON a.rid = relation_a_id JOIN fe b ON b.rid = relation_b_id),
f0 AS (SELECT *, {tq.similar('ha', 'hb')} AS direct_head_text, {tq.similar('ta', 'tb')} AS direct_tail_text, {tq.similar('ha', 'tb')} AS reverse_head_text, {tq.similar('ta', 'hb')} AS reverse_tail_text,
  {tq.dice('ea', 'eb')} AS evidence_similarity, (ra = rb)::INT::DOUBLE AS relation_type_match,
  (ra IN ('CAUSE', 'TREAT', 'VERIFY', 'TEMPORAL') AND rb IN ('CAUSE', 'TREAT', 'VERIFY', 'TEMPORAL'))::INT::DOUBLE AS relation_role_compatible, 1.0::DOUBLE AS modality_match,
  ({tq.numeral('ha', 'hb')} OR {tq.numeral('ta', 'tb')})::INT::DOUBLE AS numeral_conflict, ({tq.negation('ha', 'hb')} OR {tq.negation('ta', 'tb')})::INT::DOUBLE AS negation_conflict,
  (list_sort([{tq.endpoint_state('ha')}, {tq.endpoint_state('hb')}]) = ['negative', 'repaired'] OR list_sort([{tq.endpoint_state('ta')}, {tq.endpoint_state('tb')}]) = ['negative', 'repaired'])::INT::DOUBLE AS maintenance_state_conflict FROM j),
f1 AS (SELECT *, least(direct_head_text, direct_tail_text) AS dir, least(reverse_head_text, reverse_tail_text) AS rev, greatest(direct_head_text, direct_tail_text) AS anchor FROM f0),
f AS (SELECT *, (greatest(rev, 0) > greatest(dir, 0) + 0.12 AND greatest(rev, 0) >= 0.42)::INT::DOUBLE AS reverse_direction_conflict,
  relation_type_match * least(dir, 0.45 + 0.55 * dir, 0.35 + 0.65 * evidence_similarity) AS eq,
  greatest(relation_type_match * (0.7 * (rev - dir) + 0.3 * rev) - (1 - relation_type_match), maintenance_state_conflict * (0.3 + 0.25 * anchor),
    CASE WHEN dir >= 0.55 THEN numeral_conflict * (0.3 + 0.25 * anchor) ELSE 0 END, CASE WHEN dir >= 0.45 THEN negation_conflict * (0.3 + 0.25 * anchor) ELSE 0 END) AS co FROM f1),
g AS (SELECT *, list_filter([CASE WHEN reverse_direction_conflict > 0 THEN 'reverse_direction' END, CASE WHEN maintenance_state_conflict > 0 AND anchor >= 0.45 THEN 'maintenance_state' END,
    CASE WHEN numeral_conflict > 0 AND dir >= 0.55 THEN 'numeral_conflict' END, CASE WHEN negation_conflict > 0 AND dir >= 0.45 THEN 'negation_conflict' END], lambda x: x IS NOT NULL) AS codes,
  list_filter([CASE WHEN numeral_conflict > 0 AND dir >= 0.55 THEN 'numeral_mismatch' END, CASE WHEN negation_conflict > 0 AND dir >= 0.45 THEN 'polarity_mismatch' END], lambda x: x IS NOT NULL) AS more FROM f)"""
_ID = "decision_id, relation_a_id, relation_b_id"
SQL = {
    "s1_bm25_idf": f"WITH {_BM25} SELECT token, df, round(idf, 6) AS idf FROM idf",
    "s2_self_score": f"WITH {_BM25} SELECT document_id, round(own, 6) AS own FROM own",
    "s3_symmetric_bm25": f"WITH {_BM25} SELECT query_id, document_id, round(bm25, 6) AS bm25 FROM bm",
    "s4_unit_vectors": f"WITH {_UNIT} SELECT document_id, round(list_sum(v), 6) AS total FROM u",
    "s4_missing_vectors": f"WITH {_UNIT} SELECT DISTINCT document_id FROM records WHERE document_id NOT IN (SELECT document_id FROM u)",
    "s6_hybrid_score": f"WITH {_HYBRID} SELECT query_id, document_id, round(cosine, 6) AS cosine, round(score, 6) AS score FROM sc",
    "k1_candidates": f"WITH {_EVERY} SELECT query_id, document_id, rank FROM top",
    "d1_slots": f"WITH {_RECS}, {_SLOTS} SELECT document_id, slot, value, modality, confidence::DOUBLE AS confidence, eligible, count(*) AS n FROM sl GROUP BY ALL",
    "d4_pair_decisions": f"""WITH {_HYBRID}, {_SLOTS}, {_PROFILE},
j AS (SELECT top.*, {_apart('systems')} AS sy, {_apart('components')} AS co, {_apart('damage')} AS da, coalesce(len(x.components) = 1 AND len(y.components) = 1, FALSE) AS single
  FROM top LEFT JOIN pr x ON x.document_id = query_id LEFT JOIN pr y ON y.document_id = top.document_id),
k AS (SELECT *, sy OR (co AND single) AS hard, list_filter([CASE WHEN sy THEN 'system_conflict' END, CASE WHEN NOT sy AND co THEN 'component_conflict' END, CASE WHEN da THEN 'cause_conflict' END], lambda x: x IS NOT NULL) AS ks FROM j)
SELECT query_id, document_id, rank, array_to_string(ks, '|') AS conflicts, hard, (CASE WHEN hard THEN 1.0 WHEN len(ks) > 0 THEN 0.35 ELSE 0.0 END)::DOUBLE AS conflict_score,
  round(CASE WHEN hard THEN 0.0 ELSE score END, 6) AS final_score, (CASE WHEN hard THEN 0.0 ELSE score END) > 0.40817840781035897 AS same_case FROM k""",
    "s13_relation_features": f"WITH {_FEAT} SELECT {_ID}, " + ", ".join(f"round({n}, 6) AS {n}" for n in (*r.TEXT_FEATURES, *r.CONFLICT_FEATURES)) + " FROM f",
    "s15_equivalence_score": f"WITH {_FEAT} SELECT {_ID}, round(eq, 6) AS score FROM f",
    "s16_conflict_score": f"WITH {_FEAT} SELECT {_ID}, round(co, 6) AS score FROM f",
    "s18_veto_reasons": f"WITH {_FEAT} SELECT {_ID}, array_to_string(codes, '|') AS conflicts, array_to_string(list_concat(codes, more), '|') AS vetoes FROM g",
    "d10_relation_states": f"""WITH {_FEAT},
h AS (SELECT *, CASE WHEN co >= 0.35 THEN 'conflicting' WHEN eq >= 0.5 AND len(codes) + len(more) = 0 THEN 'equivalent' WHEN abs(given - 0.5) <= 0.05 THEN 'uncertain' WHEN given >= 0.5 THEN 'complementary' ELSE 'unrelated' END AS st FROM g)
SELECT {_ID}, st AS predicted_state, MAP {{{', '.join(f'{tq.q(k)}: {tq.q(v)}' for k, v in r.ACTIONS.items())}}}[st] AS graph_action,
  round(CASE st WHEN 'conflicting' THEN least(1.0, 0.5 + abs(co - 0.35)) WHEN 'equivalent' THEN least(1.0, 0.5 + abs(eq - 0.5)) WHEN 'uncertain' THEN 1 - abs(given - 0.5) WHEN 'complementary' THEN given ELSE 1 - given END, 6) AS confidence,
  CASE st WHEN 'conflicting' THEN CASE WHEN len(codes) > 0 THEN array_to_string(codes, '|') ELSE 'conflict_score_threshold' END WHEN 'equivalent' THEN 'both_endpoints_admissible|relation_type_match'
    WHEN 'uncertain' THEN 'complementary_unrelated_margin' WHEN 'complementary' THEN array_to_string(list_concat(codes, more, ['shared_case_evidence', 'distinct_fact_scope']), '|') ELSE 'insufficient_endpoint_correspondence' END AS reasons FROM h""",
    "d13_normalized_decisions": f"WITH {_DEC} SELECT * FROM dec",
}
