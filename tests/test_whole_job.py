"""Queries that must cover all records and cases, not only those whose number is divisible by 100."""

import __spark_entry__ as entry
import numpy as np

from wrenmill.operators import resolution


def write(spark, d, **tables):
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{d}/{name}.parquet")
    return str(d)


def axis(i):
    return [1.0 if k == i else 0.0 for k in range(64)]


RECORDS, VECTORS = "document_id string, text string", "document_id string, embedding array<double>"


def test_g1_cases_groups_records_that_are_no_query(spark, tmp_path):
    texts = {"D1": "oil pump bearing seized", "D2": "oil pump bearing seized", "D3": "cabin light broken again", "D4": None}
    d = write(spark, tmp_path, records=(list(texts.items()), RECORDS), document_vectors=([("D1", axis(0)), ("D2", axis(0)), ("D3", axis(1))], VECTORS))
    case = {r.document_id: r.case_id for r in entry.queries()["g1_cases"](spark, d).collect()}
    assert case["D1"] == case["D2"] and len(set(case.values())) == 3 and set(case) == set(texts)


def test_all_candidates_equal_the_search_with_all_queries(spark):
    rng = np.random.default_rng(3)
    words = [f"word{i}" for i in range(12)]
    rows = [(f"D{i:02d}", " ".join(rng.choice(words, 7))) for i in range(40)]
    records = spark.createDataFrame(rows, RECORDS)
    vectors = spark.createDataFrame([(i, rng.standard_normal(64).tolist()) for i, _ in rows[5:]], VECTORS)
    kept = lambda df: {(r.query_id, r.document_id): (r["rank"], round(r.score, 6)) for r in df.collect()}
    config = resolution.ResolutionConfig(top_k=4)
    assert kept(resolution.all_candidates(records, vectors, config, block=15)) == kept(resolution.decisions(records.select("document_id"), records, vectors, config))


NODES = "uid string, case_id string, document_id string, role string, text string, score double"
EDGES = "uid string, case_id string, head_uid string, tail_uid string, relation_type string"


def test_g20_lists_pairs_without_arcs_and_finds_near_vectors(spark, tmp_path):
    said = {"C_100": ["shared seal leak"] + [f"left finding {i}" for i in range(30)], "C_201": ["shared seal leak"] + [f"right finding {i}" for i in range(30)], "C_301": ["shared seal leak"]}
    nodes = [(f"{c}:{i}", c, f"D{c}", "PHENOMENON", x, 1.0) for c, xs in said.items() for i, x in enumerate(xs)]
    vectors = [("DC_100", axis(0)), ("DC_201", axis(0)), ("DC_301", axis(1))]
    d = write(spark, tmp_path, event_nodes=(nodes, NODES), relation_edges=([], EDGES), document_vectors=(vectors, VECTORS))
    got = {(r.a, r.b): (r.potential, r.distortion, r.truncated, r.risk) for r in entry.queries()["g20_closure_risk"](spark, d).collect()}
    assert got[("C_100", "C_201")] == (0, 0.0, False, "D_bge_high_structure_low")
    assert got[("C_100", "C_301")] == (0, 0.0, False, "safe_or_low_risk_control")


def test_g24_lists_all_cases_and_joins_those_that_are_no_query(spark, tmp_path):
    said = {"C_101": "seal leak", "C_102": "seal leak", "C_103": "cracked blade", "C_104": "lost rivet"}
    nodes = [(f"{c}:0", c, f"D{c}", "PHENOMENON", x, 1.0) for c, x in said.items()]
    vectors = [("DC_101", axis(0)), ("DC_102", axis(0)), ("DC_103", axis(1))]
    d = write(spark, tmp_path, event_nodes=(nodes, NODES), relation_edges=([], EDGES), document_vectors=(vectors, VECTORS))
    topic = {r.node: r.topic for r in entry.queries()["g24_backbone"](spark, d).collect()}
    assert topic == {"C_101": "C_101", "C_102": "C_101", "C_103": "C_103", "C_104": "C_104"}


def test_k1_candidates_of_records_that_are_no_query(spark, tmp_path):
    texts = {"D1": "oil pump bearing seized", "D2": "oil pump leaks", "D3": "cabin light broken", "D4": None}
    d = write(spark, tmp_path, records=(list(texts.items()), RECORDS), document_vectors=([("D1", axis(0)), ("D3", axis(0))], VECTORS))
    assert {tuple(r) for r in entry.queries()["k1_candidates"](spark, d).collect()} == {("D1", "D2", 1), ("D2", "D1", 1)}


def test_blocks_score_as_the_join_of_postings(spark, monkeypatch):
    rng = np.random.default_rng(9)
    rows = [(f"D{i:03d}", " ".join(rng.choice([f"w{k}" for k in range(30)], 6, p=np.arange(1, 31) / 465))) for i in range(120)] + [("D900", None)]
    records = spark.createDataFrame(rows, RECORDS)
    queries = records.select("document_id").filter("document_id LIKE '%0'")
    weights = resolution.bm25_weights(resolution.tokenized(resolution.clean_records(records)))
    kept = lambda df: {(r.query_id, r.document_id): round(r.bm25, 9) for r in df.collect()}
    assert kept(resolution.bm25_pairs(queries, records, block=50)) == kept(resolution.symmetric_bm25(queries, weights))
    docs = records.join(weights.groupBy("document_id").agg({"w": "sum"}), "document_id").toPandas()
    lists = weights.toPandas().groupby("document_id").agg(tokens=("token", lambda x: [hash(t) for t in x]), w=("w", list), own=("w", "sum")).reset_index()
    lists["v"] = None
    asked = lists.rename(columns={c: f"q_{c}" for c in lists})
    a, b, c = (resolution.Block(lists, common, rare).bm25(asked) for common, rare in ((2.0, 500), (2.0, 3), (0.1, 3)))
    assert len(docs) == len(lists) and np.allclose(a, b, atol=1e-12) and np.allclose(a, c, atol=1e-12)
    score = np.round(rng.random(5000), 3)
    assert (resolution.best_of(score, 20) == np.lexsort((np.arange(5000), -score))[:20]).all()


def test_g20_assesses_pairs_of_cases_that_are_no_query(spark, tmp_path):
    ends = {"C_101": ("P1", "R1"), "C_102": ("R1", "A1"), "C_103": ("P9", "R9")}
    role = {"P": "PHENOMENON", "R": "ROOT_CAUSE", "A": "ACTION"}
    nodes = [(f"{c}:{i}", c, f"D{c}", role[x[0]], f"text {x}", 1.0) for c, xs in ends.items() for i, x in enumerate(xs)]
    edges = [(f"{c}:e", c, f"{c}:0", f"{c}:1", "TEMPORAL") for c in ends]
    d = write(spark, tmp_path, event_nodes=(nodes, NODES), relation_edges=(edges, EDGES), document_vectors=([("DC_101", axis(0))], VECTORS))
    got = {(r.a, r.b): (r.potential, r.admitted, r.unsupported, r.highest, r.distortion, r.risk) for r in entry.queries()["g20_closure_risk"](spark, d).collect()}
    assert got == {("C_101", "C_102"): (3, 2, 1, 3, round(1 / 3, 6), "C_shared_anchor_path_divergence")}
