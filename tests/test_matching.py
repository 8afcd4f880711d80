import itertools
import random

from wrenmill.operators import matching as m


def best(edges):
    out = 0.0
    for r in range(len(edges) + 1):
        for some in itertools.combinations(edges, r):
            ends = [x for a, b, _ in some for x in (a, b)]
            if len(ends) == len(set(ends)):
                out = max(out, sum(w for *_, w in some))
    return out


def test_against_every_matching():
    rng = random.Random(3)
    for trial in range(400):
        n = rng.randrange(2, 9)
        pairs = [(f"v{i}", f"v{j}") for i in range(n) for j in range(i + 1, n) if rng.random() < 0.6]
        edges = [(a, b, rng.choice([rng.random(), float(rng.randrange(1, 5))])) for a, b in pairs][:13]
        got = m.heaviest(edges)
        w = {(a, b): x for a, b, x in edges}
        assert len({x for p in got for x in p}) == 2 * len(got)
        assert abs(sum(w[p] for p in got) - best(edges)) < 1e-6, (trial, edges, got)


def test_paths_and_frames(spark):
    path = lambda *ws: sorted(m.heaviest([(f"v{i}", f"v{i + 1}", float(w)) for i, w in enumerate(ws)]))
    assert path(1, 3, 1) == [("v1", "v2")] and path(2, 3, 2) == [("v0", "v1"), ("v2", "v3")]
    df = spark.createDataFrame([("a", "b", 1.0), ("b", "c", 3.0), ("c", "d", 1.0), ("x", "y", 0.5), ("y", "x", 0.7), ("z", "z", 9.0), (None, "a", 9.0)], "a string, b string, w double")
    assert sorted(tuple(r) for r in m.maximum_weight_matching(df, "a", "b", "w").collect()) == [("b", "c"), ("x", "y")]
    assert m.maximum_weight_matching(df.limit(0), "a", "b", "w").count() == 0


def test_larger_graph_ends():
    rng = random.Random(9)
    edges = {(f"v{min(i, j):03d}", f"v{max(i, j):03d}"): rng.random() for i, j in ((rng.randrange(300), rng.randrange(300)) for _ in range(1500)) if i != j}
    got = m.heaviest([(a, b, w) for (a, b), w in edges.items()])
    greedy, used = 0.0, set()
    for (a, b), w in sorted(edges.items(), key=lambda x: -x[1]):
        if not {a, b} & used:
            used |= {a, b}
            greedy += w
    assert sum(edges[p] for p in got) >= greedy and len({x for p in got for x in p}) == 2 * len(got)
