import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from wrenmill.config import AssociationConfig
from wrenmill.sources import files


def test_config(tmp_path):
    p = tmp_path / "c.json"
    p.write_text(json.dumps({"hierarchy": {"association": {"threshold": 0.3}, "residual_types": ["a"]}}))
    c = files.read_config(str(p))
    assert files.required(c, "hierarchy", "association", "threshold") == 0.3
    with pytest.raises(KeyError, match="hierarchy.patterns"):
        files.required(c, "hierarchy", "patterns", "x")
    assert files.parameters(AssociationConfig, {"threshold": 0.3, "residual_types": ["a"]}).residual_types == ("a",)
    with pytest.raises(ValueError, match="unknown"):
        files.parameters(AssociationConfig, {"treshold": 1})
    p.write_text("[1]")
    with pytest.raises(ValueError, match="mapping"):
        files.read_config(str(p))
    q = tmp_path / "c.yaml"
    q.write_text("a: 1\n")
    try:
        import yaml  # noqa: F401
    except ImportError:
        with pytest.raises(RuntimeError, match="YAML"):
            files.read_config(str(q))
    else:
        assert files.read_config(str(q)) == {"a": 1}


def test_encoder_hook(spark):
    df = spark.createDataFrame([("a", "xx"), ("b", " "), ("c", None), (None, "x"), ("d", "xyz")], "document_id string, text string")
    load = lambda: lambda texts: np.array([[len(t), 0.0, 1.0] for t in texts])
    got = {r.document_id: r.embedding for r in files.encode(df, load, 3, batch=1).collect()}
    assert set(got) == {"a", "d"} and abs(sum(x * x for x in got["d"]) - 1) < 1e-6
    with pytest.raises(Exception, match="encoder gave"):
        files.encode(df, load, 4).collect()


def test_tables_and_case_graphs(spark, tmp_path):
    places = files.write_tables({"one": spark.range(3), "two": spark.range(2)}, str(tmp_path / "out"), "parquet")
    assert spark.read.parquet(places["one"]).count() == 3
    good = {
        "case_cluster_id": "C", "source_document_ids": ["D"], "validation": {"passed": True},
        "provenance": {"events": {"C_E0001": {"sources": [{"source_event_id": "D_1", "document_id": "D", "character_span": [2, 4], "text": "裂纹"}, {"source_event_id": "D_2", "document_id": "D", "character_span": [0, 2], "text": "叶片"}]}}, "relations": {}},
        "events": [{"case_event_id": "C_E0001", "event_type": "FAILURE", "canonical_text": "裂纹", "canonical_source_event_id": "D_1", "source_event_ids": ["D_1", "D_2"], "source_document_ids": ["D"], "extraction_scores": [0.2, 0.7]}, {"case_event_id": "C_E0002"}],
        "relations": [{"case_relation_id": "C_R0001", "head_case_event_id": "C_E0001", "tail_case_event_id": "C_E0002", "relation_type": "CAUSE", "source_document_ids": ["D"], "evidence_texts": ["ab", "abc"]}],
    }
    p = tmp_path / "g.jsonl"
    p.write_text(json.dumps(good, ensure_ascii=False) + "\n\n", encoding="utf-8")
    texts = spark.createDataFrame([("D", "叶片裂纹")], "document_id string, text string")
    nodes, edges = files.read_case_graphs(spark, str(p), texts)
    rows = {r.uid: r for r in nodes.collect()}
    a, b = rows["C_E0001"], rows["C_E0002"]
    assert (a.start_pos, a.end_pos, a.score, a.source_span_valid, a.document_id) == (2, 4, 0.7, True, "D") and (b.text, b.start_pos, b.source_span_valid, b.source_event_ids) == ("", -1, False, [])
    e = edges.first()
    assert (e.evidence_text, e.relation_state, e.document_id, e.score, e.conflict_with) == ("abc", "retained", "D", 0.0, [])
    assert not files.read_case_graphs(spark, str(p), texts.withColumn("text", F.lit("叶片")))[0].filter("source_span_valid").count()
    p.write_text(json.dumps({**good, "validation": {"passed": False}}), encoding="utf-8")
    with pytest.raises(Exception, match="did not pass"):
        files.read_case_graphs(spark, str(p))[0].collect()
