"""Comparisons of cases where one case is large or near to many others, and matchings of large components."""

import time

import numpy as np
from pyspark.sql import functions as F

from wrenmill.operators import hierarchy, matching, patterns


def test_overlaps_of_long_and_short_lists_agree(spark, monkeypatch):
    rng = np.random.default_rng(5)
    rows = [(c, f"f{i}", float(i + 1)) for c, n in (("big", 40), ("c1", 6), ("c2", 5)) for i in rng.choice(50, n, replace=False).tolist()]
    has = {c: {f: w for k, f, w in rows if k == c} for c in ("big", "c1", "c2", "none")}
    pairs = spark.createDataFrame([("big", "c1"), ("c2", "big"), ("c1", "c2"), ("big", "none")], "a string, b string")
    lists = patterns.packed(spark.createDataFrame(rows, "k string, f string, w double"), "k", "f", "w")
    for most in (2000, 10, 0):
        monkeypatch.setattr(patterns, "LONG", most)
        for r in patterns.overlaps(pairs, lists, "a", "b").collect():
            both = has[r.a].keys() & has[r.b].keys()
            assert r["__shared"] == sum(has[r.a][f] for f in both) and r["__dot"] == sum(has[r.a][f] * has[r.b][f] for f in both)


def test_closure_of_a_large_case_agrees(spark, monkeypatch):
    rng = np.random.default_rng(7)
    role = {r: i for i, r in enumerate(("PHENOMENON", "FAILURE", "ROOT_CAUSE", "ACTION", "VERIFICATION"))}
    rows = []
    for case, n in (("big", 40), ("c1", 6), ("c2", 5)):
        steps = [patterns.STEPS[i] for i in rng.choice(5, n)]
        rows += [(case, f"{case}{i}", f"{p}{rng.integers(3)}", f"{q}{rng.integers(3)}", "R", p, q, f"{p}{rng.integers(3)}", f"{q}{rng.integers(3)}") for i, (p, q) in enumerate(steps)]
    arcs = spark.createDataFrame(rows, "case_id string, edge string, source string, target string, relation string, source_role string, target_role string, source_concept string, target_concept string")
    inst = patterns.instances(arcs.withColumns({"source_concept": F.col("source"), "target_concept": F.col("target")})).cache()
    pairs = spark.createDataFrame([("big", "c1"), ("c2", "big"), ("c1", "c2"), ("big", "none")], "a string, b string")
    found = {}
    for r in inst.select("case_id", "roles", "signature", "concepts").distinct().collect():
        found.setdefault(r.case_id, set()).add((tuple(r.roles), tuple(r.concepts)))
    for most in (2000, 10, 0):
        monkeypatch.setattr(patterns, "LONG", most)
        out = {(r.a, r.b): r for r in patterns.closure(pairs, inst).collect()}
        for a, b in (("big", "c1"), ("c2", "big"), ("c1", "c2"), ("big", "none")):
            known = found.get(a, set()) | found.get(b, set())
            steps = {x for x in known if len(x[0]) == 2}
            level, made = set(steps), set(steps)
            for _ in range(3):
                level = {(r + s[-1:], c + d[-1:]) for r, c in level for s, d in steps if r[-1] == s[0] and c[-1] == d[0]}
                made |= {x for x in level if x[0] in patterns.PATHS}
            lost = made - known
            got = out[a, b]
            assert (got.potential, got.admitted, got.unsupported, got.highest) == (len(made), len(made & known), len(lost), max((len(r) for r, _ in lost), default=0))
    assert role


def test_role_vectors_of_a_long_case_take_linear_time(spark):
    rows = [(f"u{i:05d}", "c", "ROOT_CAUSE", f"worn bearing {i} of the main shaft") for i in range(6000)]
    nodes = spark.createDataFrame(rows, "uid string, case_id string, role string, text string")
    began = time.time()
    assert hierarchy.role_vectors(nodes, "ROOT_CAUSE").count() > 1000
    assert time.time() - began < 60


def test_matching_of_a_large_component_searches_locally():
    rng = np.random.default_rng(11)
    n = 3000
    edges = {(min(a, b), max(a, b)): float(w) for (a, b), w in zip(rng.integers(0, n, (6 * n, 2)).tolist(), rng.random(6 * n)) if a != b}
    rows = [(f"{a:05d}", f"{b:05d}", w) for (a, b), w in edges.items()]
    began = time.time()
    found = matching.heaviest(rows)
    assert time.time() - began < 30 and len({x for p in found for x in p}) == 2 * len(found)


def test_context_nodes_share_the_vector_of_their_document(spark):
    from wrenmill.operators import concepts

    rng = np.random.default_rng(13)
    base = rng.standard_normal((3, 64))
    docs = [(f"D{i}", (base[i % 3] + 0.3 * rng.standard_normal(64)).astype(np.float32).tolist()) for i in range(12)]
    rows = [(f"u{i:02d}", ("PHENOMENON", "ACTION")[i % 2], f"text {i % 4}", [f"D{i % 12}"]) for i in range(40)]
    nodes = spark.createDataFrame(rows, "uid string, role string, text string, documents array<string>")
    key = nodes.select("uid", F.col("documents")[0].alias("key"))
    shared = spark.createDataFrame(docs, "key string, v array<float>")
    kept = lambda df: {(r.role, r.a, r.b, round(r.similarity, 9), r.accepted) for r in df.collect()}
    found = concepts.near_contexts(nodes, key, k=3, shared=shared)
    assert found.count() > 20 and kept(found) == kept(concepts.near_contexts(nodes, key.join(shared, "key").select("uid", "v"), k=3))
    groups = key.join(nodes, "uid").groupBy("key").agg(F.collect_list(F.when(F.col("role") == "ACTION", 3).otherwise(0)).alias("roles"), F.collect_list("uid").alias("uids")).join(shared, "key")
    assert {(r.a, r.b) for r in concepts.near_nodes(groups, 3, 0.72, block=5).collect()} == {(r.a, r.b) for r in found.collect()}
    unit = {d: np.array(v, float) / np.linalg.norm(np.array(v, float)) for d, v in docs}
    want = set()
    for u, r, _, (d,) in rows:
        near = sorted((-round(float(unit[d] @ unit[e]), 9), w) for w, q, _, (e,) in rows if q == r and w != u)[:3]
        want |= {tuple(sorted((u, w))) for s, w in near if -s >= 0.72}
    assert {(r.a, r.b) for r in found.collect()} == want
