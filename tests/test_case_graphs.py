"""Reconstruction of case graphs on small cases."""

import pytest
from pyspark.sql import functions as F

from wrenmill.operators import case_graphs as cg
from wrenmill.operators import nested_tables

EVENT = "event_id string, case_id string, document_id string, event_type string, text string, evidence_text string, score double"
RELATION = "relation_id string, case_id string, document_id string, head string, relation_type string, tail string, evidence_text string, score double"
EVENT_DECISION = "decision_id string, event_a string, event_b string, state string, score double, forbidden_risk double"
RELATION_DECISION = "decision_id string, relation_a_id string, relation_b_id string, relation_state string, confidence double, equivalence_score double, conflict_dimensions string"


def built(spark, events, relations=(), event_decisions=(), relation_decisions=()):
    e, r = spark.createDataFrame(list(events), EVENT), spark.createDataFrame(list(relations), RELATION)
    docs = e.select("document_id", "case_id").distinct()
    d = cg.normalize_event_decisions(spark.createDataFrame(list(event_decisions), EVENT_DECISION))
    return cg.build(e, r, docs, d, spark.createDataFrame(list(relation_decisions), RELATION_DECISION))


def event(i, case="C", doc="D", text="裂纹", kind="FAILURE"):
    return (i, case, doc, kind, text, None, 0.5)


def test_one_node_keeps_its_source(spark):
    b = built(spark, [event("D_E1", text="叶片裂纹2.5mm")])
    row = b["event_events"].collect()[0]
    assert (row.case_event_id, row.canonical_text, row.source_event_ids, row.source_document_ids) == ("C_E0001", "叶片裂纹2.5mm", ["D_E1"], ["D"])
    s = b["summary"].collect()[0]
    assert s.passed and (s.n_source_events, s.n_case_events, s.n_source_relations) == (1, 1, 0) and b["violations"].count() == 0


def test_a_related_pair_blocks_a_later_merge(spark):
    events = [event(x) for x in ("a", "b", "d")] + [event("z", case="K")]
    pairs = [("1", "a", "b", "equivalent", 0.9, 0.0), ("2", "b", "d", "equivalent_entity", 0.8, 0.0), ("3", "a", "d", "related", 0.1, 0.0), ("4", "a", "z", "equivalent", 1.0, 0.0), ("5", "a", "none", "equivalent", 1.0, 0.0), ("6", "d", "b", "review", 0.2, 0.0)]
    b = built(spark, events, event_decisions=pairs)
    assert {tuple(r) for r in b["event_mapping"].collect()} == {("a", "C", "C_E0001"), ("b", "C", "C_E0001"), ("d", "C", "C_E0002"), ("z", "K", "K_E0001")}
    assert {(r.review_type, r.a, r.b) for r in b["event_review"].collect()} == {("blocked_event_equivalence", "b", "d"), ("uncertain_event_pair", "d", "b")}
    assert {r.fault: r.n_decisions for r in b["ignored_events"].collect()} == {"cross_case": 1, "unknown": 1}


def test_relations_merge_only_on_equal_ends(spark):
    events = [event(x, doc=f"D{x[1]}", kind=k) for x, k in (("h1", "A"), ("h2", "A"), ("t1", "B"), ("t2", "B"), ("t3", "B"))]
    same = [("1", "h1", "h2", "equivalent", 0.9, 0.0), ("2", "t1", "t2", "equivalent", 0.9, 0.0)]
    rel = [("r1", "C", "D1", "h1", "CAUSE", "t1", "kurz", 0.5), ("r2", "C", "D2", "h2", "CAUSE", "t2", "länger als r1", 0.5), ("r3", "C", "D3", "h1", "CAUSE", "t3", "", 0.5), ("r4", "C", "D3", "h1", "TREAT", "gone", "x", None)]
    dec = [("1", "r1", "r2", "equivalent", 0.9, 0.9, ""), ("2", "r1", "r3", "equivalent", 0.9, 0.8, ""), ("3", "r2", "r3", "complementary", 0.7, 0.0, ""), ("4", "r3", "r4", "conflicting", 0.7, 0.0, "reverse_direction|numeral_conflict"), ("5", "r1", "r4", "uncertain", 0.5, 0.0, "")]
    b = built(spark, events, rel, same, dec)
    rows = {r.case_relation_id: r for r in b["relation_relations"].collect()}
    assert rows["C_R0001"].source_relation_ids == ["r1", "r2"] and rows["C_R0001"].relation_state == "equivalent" and rows["C_R0001"].complementary_with == ["C_R0002"]
    assert rows["C_R0002"].conflict_with == ["C_R0003"] and rows["C_R0003"].conflict_dimensions == ["numeral_conflict", "reverse_direction"] and rows["C_R0003"].review_status == "review_required"
    assert ("equivalent_relation_endpoint_mismatch", "r1", "r3") in {(r.review_type, r.a, r.b) for r in b["relation_review"].collect()}
    bad = {(r.invariant[:2], r.detail) for r in b["violations"].collect()}
    assert bad == {("02", "C_R0003"), ("03", "C_R0003"), ("14", "r3")}


def test_every_invariant_can_fail(spark):
    e = spark.createDataFrame([event("a"), event("b", text=None), event("x", doc=None)], EVENT)
    r = spark.createDataFrame([("r1", "C", "D", "a", "CAUSE", "b", "e", 0.5), ("r2", "C", "F", "a", "TREAT", "b", "e", 0.5), ("r9", "C", "D", "a", "CAUSE", "b", "e", 0.5)], RELATION)
    docs = spark.createDataFrame([("D", "C")], "document_id string, case_id string")
    ev = {
        "mapping": spark.createDataFrame([("a", "C", "E1"), ("b", "C", "E1")], "event_id string, case_id string, case_event_id string"),
        "events": spark.createDataFrame([("C", "E1", "other words", ["a", "b"], ["D", "F"]), ("C", "E2", "", [], ["D"])], "case_id string, case_event_id string, canonical_text string, source_event_ids array<string>, source_document_ids array<string>"),
        "actions": spark.createDataFrame([], "case_id string, a string, b string, action string"),
    }
    mapping = [("r1", "C", "R1", "a", "CAUSE", "b", "E1", "E1"), ("r2", "C", "R1", "a", "TREAT", "b", "E1", "E1")]
    rel = {
        "mapping": spark.createDataFrame(mapping, "relation_id string, case_id string, case_relation_id string, head string, relation_type string, tail string, head_case_event_id string, tail_case_event_id string"),
        "relations": spark.createDataFrame([("C", "R1", "E1", "E7", ["r1", "r2"], ["F"]), ("C", "R2", "", "E1", [], ["D"])], "case_id string, case_relation_id string, head_case_event_id string, tail_case_event_id string, source_relation_ids array<string>, source_document_ids array<string>"),
        "actions": ev["actions"],
    }
    pairs = cg.normalize_event_decisions(spark.createDataFrame([("1", "a", "b", "forbidden", 0.0, 0.9)], EVENT_DECISION))
    decided = spark.createDataFrame([("1", "r1", "r2", s, 0.5, 0.0, "") for s in ("conflicting", "complementary")], RELATION_DECISION)
    got = {v.invariant for v in cg.violations(e, r, docs, pairs, decided, ev, rel).collect()}
    assert got == set(cg.INVARIANTS)


def test_derived_decisions(spark):
    rel = spark.createDataFrame([("r1", "a", "b"), ("r2", "c", "d"), ("r3", "a", "e")], "relation_id string, head string, tail string")
    m = lambda fit, state, support=0.0, risk=0.0: {"support": support, "forbidden_risk": risk, "mention_fit": fit, "predicted_state": state}
    kind = "relation_a_id string, relation_b_id string, endpoint_mapping_support map<string,struct<support:double,forbidden_risk:double,mention_fit:double,predicted_state:string>>"
    rows = [("r1", "r2", {"head": m(0.9, "equivalent_entity", 0.9), "tail": m(0.5, "equivalent_entity", 0.5), "reverse_head": m(0.8, "odd")}), ("r2", "r1", {"head": m(0.75, "forbidden_merge", 0.0, 0.8)}), ("r1", "r3", {"head": m(1.0, "equivalent")}), ("r1", "gone", {"head": m(1.0, "equivalent")}), ("r1", "r2", None)]
    got = {(r.event_a_id, r.event_b_id): r for r in cg.derive_event_decisions(rel, spark.createDataFrame(rows, kind)).collect()}
    assert set(got) == {("a", "c"), ("a", "d")} and got["a", "d"].event_state == "uncertain"
    x = got["a", "c"]
    assert (x.decision_id, x.event_state, x.equivalence_support, x.forbidden_risk, x.confidence, x.hard_veto, x.decision_reasons) == ("S36_ED000001", "forbidden", 0.9, 0.8, 0.9, True, ["embedded_endpoint:head"])


def test_normalization_of_decisions(spark):
    rows = spark.createDataFrame([("x", "a:b:c", None, "entity", None, 0.0), (None, "p", "q", "forbidden", 0.4, None)], "annotation_id string, event_a string, event_b string, predicted_state string, score double, confidence double")
    a, b = cg.normalize_event_decisions(rows).orderBy(F.desc("decision_id")).collect()
    assert (a.decision_id, a.event_a_id, a.event_b_id, a.event_state, a.confidence, a.hard_veto) == ("x", "a_b:c", "", "uncertain", 0.0, False)
    assert (b.decision_id, b.event_state, b.equivalence_support, b.confidence, b.hard_veto, b.decision_reasons) == ("", "forbidden", 0.4, 0.4, True, [])


def test_local_graphs(spark):
    line = '{"document_id":"D","text":"第一句。叶片裂纹。已更换。","entities":[{"entity_id":1,"name":"叶片裂纹","entity_type":"failure","start":4,"end":8},{"entity_id":1,"name":"again"},{"node_id":"D:E2","text":"更换","start":-1}],"relations":[{"id":"R","head":1,"tail":"E9"},{"id":"S","head":1,"tail":1,"relation":"treat"}]}'
    lines = spark.createDataFrame([(2, line.replace("第一句", "later")), (1, line), (3, None)], "line_no bigint, line string")
    events, relations, docs = cg.normalize_local_graphs(nested_tables.route(lines))
    got = {r.event_id: r for r in events.collect()}
    assert set(got) == {"D_1", "D_E2"} and got["D_1"].event_type == "FAILURE" and got["D_1"].evidence_text == "叶片裂纹。" and got["D_E2"].evidence_text == ""
    rel = {r.relation_id: r for r in relations.collect()}
    assert rel["D_R"].tail == "D_E9" and rel["D_R"].evidence_text == "" and rel["D_S"].relation_type == "TREAT" and rel["D_S"].evidence_text == "叶片裂纹。"
    assert docs.count() == 1 and docs.first().text.startswith("第一句")


@pytest.mark.parametrize("table", ["event_events", "relation_relations", "violations", "summary"])
def test_empty(spark, table):
    assert built(spark, [])[table].count() == 0
