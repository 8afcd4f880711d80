import random

import pytest

from wrenmill.config import AssociationConfig, ResolutionConfig
from wrenmill.operators import concepts, patterns, relation_states, resolution
from wrenmill.operators.components import components
from wrenmill.runtime import skew_lookup


def naive_linkage(ids, sim, threshold):
    groups = [[x] for x in sorted(ids)]
    mean = lambda a, b: sum(sim.get((min(x, y), max(x, y)), 0.0) for x in a for y in b) / (len(a) * len(b))
    while len(groups) > 1:
        s, i, j = max((mean(groups[i], groups[j]), -i, -j) for i in range(len(groups)) for j in range(i + 1, len(groups)))
        if 1 - s >= 1 - threshold:
            break
        i, j = -i, -j
        groups[i] = sorted(groups[i] + groups.pop(j))
    return sorted(map(sorted, groups))


def test_average_linkage_equals_naive():
    rng = random.Random(2)
    for _ in range(30):
        ids = [f"d{i}" for i in range(rng.randint(1, 7))]
        sim = {(a, b): rng.random() for a in ids for b in ids if a < b and rng.random() < 0.8}
        assert sorted(resolution.average_linkage(ids, sim, 0.4)) == naive_linkage(ids, sim, 0.4)


def test_components_and_hot_hub(spark):
    edges = [("hub", f"x{i:03d}") for i in range(200)] + [("x000", "a"), ("p", "q"), ("q", "r"), (None, "z"), ("s", "s")]
    df = spark.createDataFrame(edges, "a string, b string")
    got = {r.node: r.component for r in components(df, "a", "b").collect()}
    assert got["hub"] == got["x199"] == "a" and got["r"] == "p" and "s" not in got and "z" not in got
    assert components(df.limit(0), "a", "b").count() == 0


def test_skew_lookup_keeps_all_rows(spark):
    big = spark.createDataFrame([("h", i) for i in range(50)] + [("c", 1), (None, 2), ("m", 3)], "k string, i int")
    small = spark.createDataFrame([("h", 1.0), ("c", 2.0)], "k string, v double")
    out = skew_lookup(big, small, "k", least=10)
    assert out.count() == 53 and out.filter("v = 1").count() == 50 and out.filter("v IS NULL").count() == 2


def test_state_conflict_comes_first(spark):
    row = {"decision_id": "x", "head_text_a": "轴承更换", "head_text_b": "轴承无法转动", "tail_text_a": "油封", "tail_text_b": "油封", "relation_type_a": "CAUSE", "relation_type_b": "cause"}
    for n in relation_states.SEMANTIC_FEATURES[:4] + ("relation_semantic_similarity",):
        row[n] = 0.95
    f = relation_states.features(spark.createDataFrame([row]))
    from pyspark.sql import functions as F

    out = relation_states.decide(f, 0.3, 0.4, F.lit(0.9), 0.5).first()
    assert out.predicted_state == "conflicting" and out.graph_action == "mark_conflict"


def test_weak_endpoint_bounds_score(spark):
    f = dict.fromkeys((*relation_states.TEXT_FEATURES, *relation_states.MAPPING_FEATURES, *relation_states.CONFLICT_FEATURES, *relation_states.SEMANTIC_FEATURES), 0.9) | {"relation_type_match": 1.0}
    rows = spark.createDataFrame([f, f | {"bge_direct_tail_text": 0.2}])
    got = [r[0] for r in rows.select(relation_states.equivalence_score().alias("s")).collect()]
    assert got[0] > 0.8 and got[1] == 0.2


def test_concepts_fold_duplicates_and_respect_numbers(spark):
    texts = ["主轴承内圈剥落损伤严重情况记录甲"] * 12 + ["主轴承内圈剥落损伤严重情况记录甲乙"] + ["间隙为0.2mm超限需要处理并复查确认一次", "间隙为0.8mm超限需要处理并复查确认一次", None, "  "]
    nodes = spark.createDataFrame([(f"u{i}", "c", "FAILURE", t, "d") for i, t in enumerate(texts)], "uid string, case_id string, role string, text string, document_id string")
    mapped, found = concepts.canonicalize(nodes)
    ids = {r.uid: r.concept_id for r in mapped.collect()}
    assert ids["u0"] == ids["u11"] and ids["u13"] != ids["u14"] and "u15" not in ids
    assert found.filter("member_count >= 12").count() == 1


def test_patterns_and_closure(spark):
    node = "uid string, case_id string, role string, concept_id string"
    rows = [(f"{c}{r}", c, role, f"C_{r}") for c in "xy" for r, role in zip("PFRAV", patterns.ROLES)]
    mapped = spark.createDataFrame(rows, node)
    edge = lambda c, i, h, t, k: (f"{c}{i}", c, f"{c}{h}", f"{c}{t}", k)
    edges = [edge("x", 1, "F", "P", "CAUSE"), edge("x", 2, "R", "F", "CAUSE"), edge("y", 1, "A", "R", "TREAT"), edge("y", 2, "V", "A", "VERIFY"), ("z", "y", None, "yP", "CAUSE"), ("w", "y", "yP", "none", "CAUSE")]
    arc = patterns.arcs(spark.createDataFrame(edges, "uid string, case_id string, head_uid string, tail_uid string, relation_type string"), mapped)
    inst = patterns.instances(arc)
    assert {(r.case_id, ">".join(x[0] for x in r.roles)) for r in inst.collect()} == {("x", "P>F"), ("x", "F>R"), ("y", "R>A"), ("y", "A>V"), ("y", "R>A>V")}
    out = patterns.closure(spark.createDataFrame([("x", "y")], "a string, b string"), inst).first()
    assert (out.potential, out.admitted, out.unsupported, out.highest, out.truncated) == (9, 5, 4, 5, False)


def test_configs_check_themselves():
    with pytest.raises(ValueError):
        ResolutionConfig(bm25_weight=0.5)
    with pytest.raises(ValueError):
        AssociationConfig(top_k=0)


def test_near_contexts(spark):
    unit = [1.0] + [0.0] * 63
    other = [0.0, 1.0] + [0.0] * 62
    rows = [("a", "FAILURE", "密封圈老化", ["d1"]), ("b", "FAILURE", "密封圈老化严重", ["d2"]), ("c", "FAILURE", "密封圈老化严重", ["d1"]), ("d", "FAILURE", "裂纹2mm", ["d3"]), ("e", "FAILURE", "裂纹3mm", ["d4"]), ("f", "ACTION", "密封圈老化", ["d5"]), ("g", "FAILURE", None, ["d6"]), ("h", "FAILURE", "密封圈老化", ["d7"])]
    nodes = spark.createDataFrame(rows, "uid string, role string, text string, documents array<string>")
    v = spark.createDataFrame([(r[0], other if r[0] == "h" else unit) for r in rows], "uid string, v array<double>")
    got = {(r.a, r.b): r for r in concepts.near_contexts(nodes, v).collect()}
    assert not any({"f", "g", "h"} & set(p) for p in got)
    assert got["a", "b"].accepted and not got["a", "c"].accepted and got["a", "c"].same_document and not got["d", "e"].number_safe and not got["a", "d"].anchored
    full = nodes.selectExpr("uid", "'x' AS case_id", "role", "text", "documents[0] AS document_id")
    ids = {r.uid: r.concept_id for r in concepts.canonicalize(full, contexts=concepts.near_contexts(nodes, v))[0].collect()}
    assert ids["a"] == ids["b"] == ids["c"] == ids["h"] and ids["d"] != ids["e"]
    assert concepts.near_contexts(nodes.limit(0), v).count() == 0
