"""Relation pairs: 27 features, derived supports, scores, reasons and the state decision, all as column expressions.

Missing mapping and semantic columns count as 0; a null text makes its similarities 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wrenmill.functions import text as t

# Features in order, states and their graph actions.
TEXT_FEATURES = ("direct_head_text", "direct_tail_text", "reverse_head_text", "reverse_tail_text", "evidence_similarity", "relation_type_match", "relation_role_compatible", "modality_match")
MAPPING_FEATURES = ("head_mapping_support", "tail_mapping_support", "reverse_head_mapping_support", "reverse_tail_mapping_support", "head_forbidden_risk", "tail_forbidden_risk")
CONFLICT_FEATURES = ("numeral_conflict", "negation_conflict", "maintenance_state_conflict", "reverse_direction_conflict")
SEMANTIC_FEATURES = (
    "bge_direct_head_text", "bge_direct_tail_text", "bge_reverse_head_text", "bge_reverse_tail_text", "bge_evidence_similarity",
    "relation_semantic_similarity", "action_semantic_similarity", "action_semantic_available", "narrative_position_similarity",
)
ACTIONS = {"equivalent": "merge", "complementary": "retain_parallel", "conflicting": "mark_conflict", "unrelated": "retain_separate", "uncertain": "retain_for_review"}
STATE_ALIASES = {
    "equivalent": "equivalent", "equivalent_relation": "equivalent", "complementary": "complementary", "complementary_fact": "complementary",
    "conflicting": "conflicting", "conflicting_fact": "conflicting", "unrelated": "unrelated", "unrelated_fact": "unrelated",
    "uncertain": "uncertain", "review": "uncertain",
}
CONFLICT_CODES = ("numeral_conflict", "numeric_conflict", "negation_conflict", "maintenance_state", "maintenance_state_conflict", "reverse_direction", "reverse_direction_conflict", "endpoint_forbidden")


def features(pairs: DataFrame) -> DataFrame:
    """Adds the 27 features to pairs with head_text_*, tail_text_*, relation_type_* and optional evidence, modality, mapping and semantic columns."""
    c = lambda name: F.coalesce(F.col(name), F.lit("")) if name in pairs.columns else F.lit("")
    number = lambda name: F.coalesce(F.col(name).cast("double"), F.lit(0.0)) if name in pairs.columns else F.lit(0.0)
    ha, hb, ta, tb = c("head_text_a"), c("head_text_b"), c("tail_text_a"), c("tail_text_b")
    ra, rb = F.upper(c("relation_type_a")), F.upper(c("relation_type_b"))
    modal = F.col("modality_a").eqNullSafe(F.col("modality_b")) if "modality_a" in pairs.columns else F.lit(True)
    either = lambda f: (f(ha, hb) | f(ta, tb)).cast("double")
    forms = {"__ha": ha, "__hb": hb, "__ta": ta, "__tb": tb}
    fit = lambda x, y: t.form_similarity(F.col(f"__{x}"), F.col(f"__{y}"))
    # every text is normalized and cut once, for the two others it meets
    out = pairs.withColumns({k: t.mention_form(v) for k, v in forms.items()}).withColumns(
        {
            "direct_head_text": fit("ha", "hb"), "direct_tail_text": fit("ta", "tb"),
            "reverse_head_text": fit("ha", "tb"), "reverse_tail_text": fit("ta", "hb"),
            "evidence_similarity": t.dice(c("evidence_sentence_a"), c("evidence_sentence_b")),
            "relation_type_match": (ra == rb).cast("double"), "relation_role_compatible": t.role_compatible(ra, rb).cast("double"),
            "modality_match": modal.cast("double"), **{f: number(f) for f in MAPPING_FEATURES},
            "numeral_conflict": either(t.numeral_conflict), "negation_conflict": either(t.negation_conflict), "maintenance_state_conflict": either(t.state_conflict),
            **{f: number(f) for f in SEMANTIC_FEATURES},
        }
    ).drop(*forms)
    reverse = F.greatest(F.least("reverse_head_text", "reverse_tail_text"), F.least("reverse_head_mapping_support", "reverse_tail_mapping_support"))
    direct = F.greatest(F.least("direct_head_text", "direct_tail_text"), F.least("head_mapping_support", "tail_mapping_support"))
    return out.withColumn("reverse_direction_conflict", ((reverse > direct + 0.12) & (reverse >= 0.42)).cast("double"))


def supports() -> dict[str, Column]:
    """The derived supports."""
    return {
        "direct_endpoint_support": F.least("direct_head_text", "direct_tail_text"),
        "mapping_endpoint_support": F.least("head_mapping_support", "tail_mapping_support"),
        "shared_endpoint_support": F.greatest("head_mapping_support", "tail_mapping_support", "reverse_head_mapping_support", "reverse_tail_mapping_support"),
        "bge_direct_endpoint_support": F.least("bge_direct_head_text", "bge_direct_tail_text"),
        "bge_reverse_endpoint_support": F.least("bge_reverse_head_text", "bge_reverse_tail_text"),
    }


def equivalence_score() -> Column:
    s = supports()
    semantic = F.when(F.col("action_semantic_available") > 0, F.greatest("relation_semantic_similarity", "action_semantic_similarity")).otherwise(F.col("relation_semantic_similarity"))
    return F.col("relation_type_match") * F.least(s["bge_direct_endpoint_support"], 0.45 + 0.55 * s["direct_endpoint_support"], 0.35 + 0.65 * semantic)


def conflict_score() -> Column:
    s = supports()
    anchor = 0.30 + 0.25 * F.greatest("direct_head_text", "direct_tail_text")
    aligned = s["direct_endpoint_support"]
    reverse, match = s["bge_reverse_endpoint_support"], F.col("relation_type_match")
    turned = match * (0.70 * (reverse - s["bge_direct_endpoint_support"]) + 0.30 * reverse) - (1.0 - match)
    cue = lambda name, least: F.when(aligned >= least, F.col(name) * anchor).otherwise(0.0)
    return F.greatest(turned, F.col("maintenance_state_conflict") * anchor, cue("numeral_conflict", 0.55), cue("negation_conflict", 0.45))


def _aligned() -> Column:
    s = supports()
    return F.greatest(s["direct_endpoint_support"], s["mapping_endpoint_support"])


def conflict_reasons(full: bool = True) -> Column:
    anchor = F.greatest("direct_head_text", "direct_tail_text", "head_mapping_support", "tail_mapping_support")
    on = lambda name: F.col(name) > 0
    parts = [F.when(on("reverse_direction_conflict"), "reverse_direction"), F.when(on("maintenance_state_conflict") & (anchor >= 0.45), "maintenance_state")]
    if full:
        parts += [F.when(on("numeral_conflict") & (_aligned() >= 0.55), "numeral_conflict"), F.when(on("negation_conflict") & (_aligned() >= 0.45), "negation_conflict")]
    return F.array_compact(F.array(*parts))


def veto_reasons(full: bool = True) -> Column:
    if not full:
        return F.array_distinct(conflict_reasons(False))
    risky = (F.greatest("head_forbidden_risk", "tail_forbidden_risk") >= 0.75) & (supports()["direct_endpoint_support"] >= 0.65)
    more = F.array_compact(
        F.array(
            F.when(risky, "endpoint_forbidden"),
            F.when((F.col("numeral_conflict") > 0) & (_aligned() >= 0.55), "numeral_mismatch"),
            F.when((F.col("negation_conflict") > 0) & (_aligned() >= 0.45), "polarity_mismatch"),
        )
    )
    return F.array_distinct(F.concat(conflict_reasons(True), more))


def decide(pairs: DataFrame, conflict_threshold: float, equivalent_threshold: float, probability: Column, probability_threshold: float, margin: float | None = None, full: bool = True) -> DataFrame:
    """Adds predicted_state, graph_action, confidence and reasons; conflict comes first, equivalence needs no veto, uncertainty only with a margin."""
    base = pairs.withColumns({"conflict_score": conflict_score(), "equivalence_score": equivalence_score(), "probability": probability, "vetoes": veto_reasons(full), "conflict_codes": conflict_reasons(full)})
    conflict = F.col("conflict_score") >= conflict_threshold
    equal = (F.col("equivalence_score") >= equivalent_threshold) & (F.size("vetoes") == 0)
    distance = F.abs(F.col("probability") - probability_threshold)
    unsure = distance <= margin if margin is not None else F.lit(False)
    both = F.col("probability") >= probability_threshold
    state = F.when(conflict, "conflicting").when(equal, "equivalent").when(unsure, "uncertain").when(both, "complementary").otherwise("unrelated")
    near = lambda c, th: F.least(F.lit(1.0), 0.5 + F.abs(F.col(c) - th))
    confidence = F.when(conflict, near("conflict_score", conflict_threshold)).when(equal, near("equivalence_score", equivalent_threshold)).when(unsure, 1.0 - distance).when(both, F.col("probability")).otherwise(1.0 - F.col("probability"))
    words = lambda *w: F.array(*[F.lit(x) for x in w])
    reasons = (
        F.when(conflict, F.when(F.size("conflict_codes") > 0, F.col("conflict_codes")).otherwise(words("conflict_score_threshold")))
        .when(equal, words("both_endpoints_admissible", "relation_type_match"))
        .when(unsure, words("complementary_unrelated_margin"))
        .when(both, F.concat("vetoes", words("shared_case_evidence", "distinct_fact_scope")))
        .otherwise(words("insufficient_endpoint_correspondence"))
    )
    action = F.create_map(*[F.lit(x) for kv in ACTIONS.items() for x in kv])
    return base.withColumn("predicted_state", state).withColumn("graph_action", action[F.col("predicted_state")]).withColumn("confidence", confidence).withColumn("reason_codes", reasons)


def normalize_decisions(rows: DataFrame) -> DataFrame:
    """Canonical state, '_' ids and a confidence in which 0 counts as missing; conflict codes in the order of the reasons."""
    spell = lambda c: F.regexp_replace(F.coalesce(F.col(c), F.lit("")), "^([^:]*):", "$1_")
    alias = F.create_map(*[F.lit(x) for kv in STATE_ALIASES.items() for x in kv])
    nonzero = lambda c: F.when(F.col(c) != 0, F.col(c))
    reasons = F.coalesce("decision_reasons", F.array().cast("array<string>"))
    return rows.select(
        "decision_id", spell("relation_a_id").alias("relation_a_id"), spell("relation_b_id").alias("relation_b_id"),
        F.coalesce(F.try_element_at(alias, F.coalesce("predicted_state", F.lit("uncertain"))), F.lit("uncertain")).alias("relation_state"),
        F.coalesce(nonzero("confidence"), nonzero("equivalence_score"), F.lit(0.0)).alias("confidence"),
        F.array_join(F.filter(reasons, lambda r: r.isin(*CONFLICT_CODES)), "|").alias("conflict_dimensions"),
    )
