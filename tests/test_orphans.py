from datetime import datetime

from wrenmill.operators.orphan_references import maintenance_orphans, orphan_report, orphans

EDGE = "uid string, head_uid string, tail_uid string, loaded_at timestamp, ref_key string, t int"
NODE = "uid string, source_document_ids array<string>, loaded_at timestamp, deleted_at timestamp, first_loaded int"
RECORD = "document_id string, loaded_at timestamp, deleted_at timestamp"


def at(day):
    return datetime(2024, 1, day)


def run(spark, edges, nodes, records):
    out = maintenance_orphans(spark.createDataFrame(edges, EDGE), spark.createDataFrame(nodes, NODE), spark.createDataFrame(records, RECORD))
    return sorted(tuple(r) for r in out.select("field_name", "row_key", "ref_key", "reason", "period").collect())


def test_reasons_nulls_and_repeats(spark):
    edges = [("e1", "n1", "gone", at(5), "x", 1), ("e1", "n1", "gone", at(9), "x", 1), ("e2", "n2", "", at(5), None, None), ("e3", None, "n3", at(5), None, None)]
    nodes = [("n1", ["d1", None, "", "dx"], at(1), None, 1), ("n2", None, at(6), None, 1), ("n3", [], at(1), at(5), 1)]
    records = [("d1", at(1), None), (None, at(1), None)]
    assert run(spark, edges, nodes, records) == [
        ("head_uid", "e2", "n2", "late", "2024-01"),
        ("source_document_ids", "n1", "dx", "missing", "2024-01"),
        ("tail_uid", "e1", "gone", "missing", "2024-01"),
        ("tail_uid", "e3", "n3", "deleted", "2024-01"),
    ]


def test_empty_tables(spark):
    assert run(spark, [], [], []) == []
    assert run(spark, [("e", "a", "b", None, None, None)], [], []) == [("head_uid", "e", "a", "missing", None), ("tail_uid", "e", "b", "missing", None)]


def test_filter_beyond_the_broadcast_bound(spark):
    keys = [(f"k{i}", at(1), None) for i in range(500)]
    parents = spark.createDataFrame(keys, "ref_key string, first_loaded timestamp, deleted timestamp")
    refs = spark.createDataFrame([("t", "f", f"r{i}", f"k{i}", at(2)) for i in range(900)], "table_name string, field_name string, row_key string, ref_key string, t timestamp")
    out = orphans(refs, parents, max_words=64)
    assert {r.ref_key for r in out.collect()} == {f"k{i}" for i in range(500, 900)}
    assert orphan_report(out).collect()[0].n_references == 400
