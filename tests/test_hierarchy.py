"""Topics, role vectors, witnesses, catalog and lineage on small corpora."""

import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from wrenmill.config import AssociationConfig
from wrenmill.operators import case_merge, hierarchy as h
from wrenmill.runtime import numbered

NODE = "uid string, case_id string, role string, text string, document_id string"


def unit(*x):
    n = math.sqrt(sum(v * v for v in x))
    return [v / n for v in x] + [0.0] * (64 - len(x))


def corpus(spark):
    nodes = spark.createDataFrame([(f"{c}:{r[:1]}", c, r, text, f"D{c}") for c in ("c1", "c2", "c3") for r, text in (("ROOT_CAUSE", "密封圈老化开裂"), ("FAILURE", "滑油渗漏"))], NODE)
    vectors = spark.createDataFrame([("c1", unit(1.0, 0.0)), ("c2", unit(1.0, 0.01)), ("c3", unit(1.0, 0.02))], "case_id string, v array<double>")
    feats = spark.createDataFrame([(c, f"role_concept:{x}") for c in ("c1", "c2", "c3") for x in "ab"], "case_id string, feature string")
    inst = spark.createDataFrame(
        [(c, "FAILURE:x>ROOT_CAUSE:y||CAUSE", "PAT_1", ["FAILURE", "ROOT_CAUSE"], ["x", "y"], ["CAUSE"], [f"{c}:F", f"{c}:R"], [f"{c}:E"]) for c in ("c1", "c2", "c3")],
        "case_id string, signature string, pattern_id string, roles array<string>, concepts array<string>, relations array<string>, node_uids array<string>, edge_uids array<string>",
    )
    idf = feats.select("feature").distinct().withColumn("idf", F.lit(1.0))
    return nodes, vectors, feats, inst, idf


def test_three_alike_cases_without_backbone(spark):
    nodes, vectors, feats, inst, idf = corpus(spark)
    tree = h.build(nodes, inst, feats, idf, vectors, AssociationConfig(threshold=1.1))
    units = {r.unit_id: r for r in tree["units"].collect()}
    assert len(units) == 4 and {r.unit_id for r in tree["roots"].collect()} == {"R0000", next(u for u in ("C0000", "C0001", "C0002") if units[u].parent_id is None)}
    assert max(r.level for r in units.values()) == 1 and tree["members"].filter("unit_id = 'R0000'").count() == 2
    assert h.shared_patterns(tree["members"], inst).filter("support >= 2").count() == 1
    linked = h.build(nodes, inst, feats, idf, vectors)
    assert [r.unit_id for r in linked["roots"].collect()] == ["B0000"] and linked["matched"].count() == 0
    found = h.catalog(
        inst, nodes.select("uid", F.array("uid").alias("source_event_ids"), F.array("document_id").alias("source_document_ids"), F.array(F.struct(F.lit(1).alias("span_start"), F.lit(2).alias("span_end"))).alias("source_spans")),
        spark.createDataFrame([(f"c{i}:E", [f"r{i}"]) for i in (1, 2, 3)], "uid string, source_relation_ids array<string>"),
    )
    t = h.trace("B0000", "PAT_1", linked, found)
    assert t["case_ids"] == ["c1", "c2", "c3"] and t["source_relation_ids"] == ["r1", "r2", "r3"] and len(t["source_event_ids"]) == 6 and t["source_spans"][0]["document_id"] == "Dc1"
    with pytest.raises(KeyError):
        h.trace("B9", "PAT_1", linked, found)
    with pytest.raises(KeyError):
        h.trace("B0000", "PAT_9", linked, found)
    mapped = nodes.select("uid", "case_id", F.lit("K").alias("concept_id"))
    edges = spark.createDataFrame([("c1:E", "c1:F", "c1:R", "CAUSE")], "uid string, head_uid string, tail_uid string, relation_type string")
    kinds = Counter(r.edge_type for r in h.unified_edges(nodes, edges, mapped, inst, linked).collect())
    assert kinds == {"CAUSE": 1, "EVENT_TO_CANONICAL_CONCEPT": 6, "PATTERN_TO_CONCEPT": 2, "PATTERN_TO_SUPPORTING_CASE": 3, "TOPIC_TO_CONCEPT": 1, "TOPIC_TO_PATTERN": 1, "TOPIC_TO_COVERED_CASE": 3, "TOPIC_TO_CHILD_CASE": 3}


def test_role_vectors_by_definition(spark):
    rows = [("a", "c1", "ROOT_CAUSE", "密封老化", "d"), ("b", "c1", "ROOT_CAUSE", "Seal  老化", "d"), ("c", "c2", "ROOT_CAUSE", "老化", "d"), ("d", "c3", "ROOT_CAUSE", " ", "d"), ("e", "c4", "ACTION", "老化", "d"), ("f", None, "ROOT_CAUSE", "老化", "d"), ("g", "c5", "ROOT_CAUSE", None, "d")]
    grams = lambda t: Counter(t[i : i + n] for n in (2, 3, 4) for i in range(len(t) - n + 1))
    docs = {"c1": "密封老化；seal 老化", "c2": "老化"}
    every = [*docs.values(), "密封老化", "seal 老化", "老化"]
    df = Counter(g for t in every for g in set(grams(t)))
    got = {}
    for r in h.role_vectors(spark.createDataFrame(rows, NODE), "ROOT_CAUSE").collect():
        got.setdefault(r.case_id, {})[r.term] = r.w
    assert set(got) == set(docs)
    for c, text in docs.items():
        v = {g: (1 + math.log(k)) * (math.log((len(every) + 1) / (df[g] + 1)) + 1) for g, k in grams(text).items()}
        n = math.sqrt(sum(x * x for x in v.values()))
        assert set(got[c]) == set(v) and all(abs(got[c][g] - x / n) < 1e-12 for g, x in v.items())
    vectors = h.role_vectors(spark.createDataFrame(rows, NODE), "ROOT_CAUSE")
    members = spark.createDataFrame([("T", "c1"), ("T", "c2"), ("U", "c2"), ("V", "c9")], "unit_id string, case_id string")
    pairs = spark.createDataFrame([("T", "U"), ("T", "V")], "l string, r string")
    sims = {r.r: r.s for r in h.sparse_similarity(pairs, h.topic_vectors(members, vectors), "unit_id", "l", "r", "s").collect()}
    assert 0.5 < sims["U"] < 1 and sims["V"] == 0.0
    assert h.role_vectors(spark.createDataFrame([], NODE), "ROOT_CAUSE").count() == 0 and len(got["c1"]) > h.role_vectors(spark.createDataFrame(rows, NODE), "ROOT_CAUSE", most=3).filter("case_id = 'c1'").count()


def test_witness_and_rule(spark):
    roots = spark.createDataFrame([("a", "X"), ("b", "X"), ("c", "Y"), ("d", "Y")], "case_id string, root_id string")
    safe = "safe_or_low_risk_control"
    pairs = spark.createDataFrame([("a", "b", safe, 1.0), ("a", "c", "C_shared_anchor_path_divergence", 0.9), ("b", "c", safe, 0.2), ("b", "d", safe, 0.2), ("a", "d", safe, 0.01)], "a string, b string, risk string, role_similarity double")
    assert [tuple(r) for r in h.witnesses(pairs, roots).collect()] == [("X", "Y", "b", "d", safe, 0.2, True)]
    got = pairs.select(h.fused(F.col("a") == "a", F.col("risk"), F.col("role_similarity")).alias("x")).collect()
    assert [r.x for r in got] == [True, True, True, True, True]
    assert not spark.range(1).select(h.fused(F.lit(False), F.lit("A"), F.lit(0.9)).alias("x")).first().x


def test_reference_idf_and_unknown(spark):
    feats = spark.createDataFrame([("c", "x"), ("c", "y")], "case_id string, feature string")
    ref = spark.createDataFrame([("x", 1.5), ("z", 2.5)], "feature string, idf double")
    assert {r.feature: r.idf for r in h.reference_idf(feats, ref).collect()} == {"x": 1.5, "y": 2.5}
    assert {r.feature: r.idf for r in h.reference_idf(feats, ref, 0.5).collect()}["y"] == 0.5 and h.reference_idf(feats, ref.limit(0)).first().idf == 1.0
    assert [r.feature for r in h.unknown_features(feats, ref).collect()] == ["y"]


def test_numbering(spark):
    df = spark.createDataFrame([(g, f"{g}{i:03d}") for g in "ab" for i in range(150)] + [("c", "c")], "g string, k string").repartition(7)
    assert {(r.k, r.n) for r in numbered(df, "g", "k", "n").collect()} == {(f"{g}{i:03d}", i + 1) for g in "ab" for i in range(150)} | {("c", 1)}
    assert [r.n for r in numbered(df, None, "k", "n").orderBy("k").collect()] == list(range(1, 302)) and numbered(df.limit(0), None, "k", "n").count() == 0


def test_near_cases_of_equal_vectors(spark):
    v = spark.createDataFrame([(f"c{i}", unit(1.0, 0.0)) for i in range(4)] + [("z", unit(0.0, 1.0))], "case_id string, v array<double>")
    got = {(r.a, r.b) for r in case_merge.near_cases(v, 2).collect()}
    assert ("c0", "c1") in got and ("c0", "z") in got and all(a < b for a, b in got)
