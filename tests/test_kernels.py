import random

import numpy as np
import pytest

from wrenmill.operators import case_merge as k
from wrenmill.sources import files


def test_constrained_merge_against_definition(spark):
    rng = random.Random(4)
    for _ in range(60):
        ids = [f"e{i}" for i in range(6)]
        rows = [(a, b, rng.choice(["equivalent", "equivalent", "related"]), rng.random(), 0.5) for a in ids for b in ids if a < b and rng.random() < 0.5]
        root, actions = k.merge_case(rows)
        groups = {x: {x} for x in {y for r in rows for y in r[:2]}}
        bad = {(a, b) for a, b, s, *_ in rows if s != "equivalent"}
        for a, b, s, w, c in sorted((r for r in rows if r[2] == "equivalent"), key=lambda r: (-r[3], -r[4], r[0], r[1])):
            ga, gb = groups[a], groups[b]
            if ga is not gb and not any((min(x, y), max(x, y)) in bad for x in ga for y in gb):
                ga |= gb
                for x in ga:
                    groups[x] = ga
        assert root == {x: min(g) for x, g in groups.items()} and len(actions) == sum(r[2] == "equivalent" for r in rows)
    df = spark.createDataFrame([("c", "a", "b", "equivalent", 0.9, 0.9), ("c", "b", "d", "equivalent", 0.8, 0.8), ("c", "a", "d", "related", None, None), (None, "a", "b", "equivalent", 1.0, 1.0)], "case_id string, a string, b string, state string, support double, confidence double")
    got, acts = k.merge_cases(df)
    assert {r.source_id: r.root for r in got.collect()} == {"a": "a", "b": "a", "d": "d"} and {r.action for r in acts.collect()} == {"merged", "blocked"}


def test_core_numbers_by_definition():
    rng = random.Random(6)
    nb = {f"n{i}": set() for i in range(14)}
    for a in nb:
        for b in nb:
            if a < b and rng.random() < 0.3:
                nb[a].add(b)
                nb[b].add(a)
    core = k.core_numbers(nb)
    for c in range(max(core.values()) + 2):
        keep = set(nb)
        while weak := {n for n in keep if len(nb[n] & keep) < c}:
            keep -= weak
        assert keep == {n for n in nb if core[n] >= c}


def test_backbone_covers_and_bounds():
    clique = [(f"c{i:02d}", f"c{j:02d}") for i in range(25) for j in range(i)]
    parts = k.backbone([*clique, ("x", "y")], 20)
    assert sorted(map(len, parts)) == [2, 5, 20] and len(set().union(*parts)) == 27
    assert sorted(parts)[0] == [f"c{i:02d}" for i in range(20)]


def linked(nodes, edges):
    """Connected sets of nodes, by definition."""
    sets = [{n} for n in nodes]
    for a, b in edges:
        if a in nodes and b in nodes:
            x, y = next(s for s in sets if a in s), next(s for s in sets if b in s)
            if x is not y:
                sets.remove(y)
                x |= y
    return sets


def test_shell_groups_by_definition():
    """Every group is linked, within the bound or uncuttable, and the recursive cut at the upper median gives the same groups."""
    rng = random.Random(11)
    for _ in range(20):
        edges = {(f"n{min(a, b):02d}", f"n{max(a, b):02d}") for a, b in ((rng.randrange(30), int(30 * rng.random() ** 2)) for _ in range(90)) if a != b}
        nodes = {x for e in edges for x in e}
        near = {x: {b if a == x else a for a, b in edges if x in (a, b)} for x in nodes}
        core = k.core_numbers(near)

        def cut(group, core=core, edges=edges):
            shells = sorted({core[x] for x in group})
            upper = {x for x in group if core[x] > shells[len(shells) // 2]}
            if len(group) <= 6 or not upper:
                return [group]
            return [g for side in (upper, group - upper) for part in linked(side, edges) for g in cut(part)]

        want = {frozenset(g) for part in linked(nodes, edges) for g in cut(part) if len(g) <= 6}
        got = [frozenset(p) for p in k.backbone(sorted(edges), 6)]
        assert want <= set(got) and all(len(p) <= 6 and len(linked(p, edges)) == 1 for p in got)
        assert sorted(x for p in got for x in p) == sorted(nodes)


def test_config_ranges():
    from wrenmill.config import AssociationConfig, ResolutionConfig

    assert ResolutionConfig().top_k == 20 and AssociationConfig().max_cluster == 20
    for wrong in (lambda: ResolutionConfig(bm25_weight=0.5), lambda: ResolutionConfig(top_k=0), lambda: AssociationConfig(max_cluster=1), lambda: ResolutionConfig(threshold=1.1)):
        with pytest.raises(ValueError):
            wrong()


def test_files(spark, tmp_path):
    p = tmp_path / "a.jsonl"
    p.write_text('﻿{"document_id":"1","text":"x"}\n\n{"document_id":"2"}\n[1]\n', encoding="utf-8")
    assert files.read_jsonl(spark, str(p), "document_id string, text string").count() == 2
    with pytest.raises(Exception, match="no JSON object"):
        files.read_jsonl_strict(spark, str(p), "document_id string, text string").collect()
    q = tmp_path / "b.json"
    files.write_json({"assignments": {"d1": "C1"}}, str(q))
    assert [tuple(r) for r in files.read_assignments(spark, str(q)).collect()] == [("d1", "C1")]
    z = str(tmp_path / "v.npz")
    np.savez(z, document_ids=np.array(["a", "b"]), embeddings=np.eye(2, dtype=np.float32))
    df = files.read_npz(spark, z)
    files.write_npz(df, str(tmp_path / "w.npz"))
    assert files.read_npz(spark, str(tmp_path / "w.npz")).count() == 2
    files.write_jsonl(df, str(tmp_path / "out"))
    assert files.read_jsonl_strict(spark, str(tmp_path / "out"), "document_id string").count() == 2
