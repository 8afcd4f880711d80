import json

from wrenmill.operators import nested_tables as n

LINES = [
    '﻿{"document_id":"d1","nodes":[{"event_id":7,"node_id":"N1","views":[{"view":"rule","score":0.5},{"score":1}]},{"entity_id":"E2","views":null},5],"relations":[{"relation_id":"R1","head":"E2","tail":null}]}',
    '{"graphs":[{"document_id":"d2","nodes":null,"entities":[{"entity_id":1.50}]},{"document_id":"d3"}],"document_id":"x"}',
    '{"document_id":"d4","nodes":[{"event_id":"a"}]',
    "[1]", "null", "", "# text", '{"export":{"a":1}}', '{"document_id":"d5","nodes":[]} {}', '{"document_id": NaN}',
    '{"export":{"run":63,"graphs":[{"document_id":"d6","entities":[{"entity_id":"E1"}],"relations":[{"id":9,"head":"E1","tail":"E1"}]},7,{"odd":1}]}}',
    '{"a":{"b":[[{"c":{"graphs":[{"document_id":"d7","nodes":[{"node_id":"N7"}]}]}}]],"x":{"y":1}}}',
    '{"document_id":"d8","nodes":[{"event_id":"n8","document_id":"other","relations":[{"id":"inner"}]}],"note":{"nodes":[{"event_id":"hidden"}]}}',
]


def frame(spark, lines):
    return spark.createDataFrame([(i, x, "clash", 1) for i, x in enumerate(lines)], "line_no bigint, line string, document_id string, key int")


def test_links(spark):
    got = sorted(tuple(r) for r in n.parent_links(n.route(frame(spark, [*LINES, None, LINES[0]]))).collect())
    assert got == sorted(
        [
            ("d1", "node", "d1", "7"), ("d1", "node", "d1", "E2"), ("d1", "view", "7", "rule"), ("d1", "relation", "d1", "R1"), ("d1", "head", "R1", "E2"), ("d2", "node", "d2", "1.50"),
            ("d6", "node", "d6", "E1"), ("d6", "relation", "d6", "9"), ("d6", "head", "9", "E1"), ("d6", "tail", "9", "E1"), ("d7", "node", "d7", "N7"), ("d8", "node", "d8", "n8"),
        ]
    )


def test_variants_and_subtypes(spark):
    routed = n.route(frame(spark, LINES))
    shapes = {(r["class"], r.variant): r.n_objects for r in n.variants(routed).collect()}
    assert shapes[("alien", "struct<export:struct<a:bigint>>")] == 1 and shapes[("alien", "struct<odd:bigint>")] == 1
    table = n.subtype_table(routed["node"], "struct<entity_id:double>").collect()
    assert [(r.document_id, r.f_entity_id) for r in table] == [("d2", 1.5)]
    assert n.fields_of("struct<a:array<struct<x:bigint,y:null>>,b:boolean>") == {"a": "array<struct<x:bigint,y:null>>", "b": "boolean"}
    rows = n.subtype_table(routed["relation"], "struct<head:string,id:bigint,tail:string>").collect()
    assert [(r.parent_key, r.key, r.f_id, r.f_head) for r in rows] == [("d6", "9", 9, "E1")]


def test_states_and_empty(spark):
    run = n.Run(n.parse_object('{"a":[1,null,2.5],"b":true,"c":[{"d":1},{"d":"x"}],"e":[{"d":1},{"d":2}]}'))
    assert run.variant(run.top) == "struct<a:array<double>,b:boolean,c:array<struct<d:string>>,e:array<struct<d:bigint>>>"
    assert n.merge_states("bigint", "double") == "double" and n.merge_states("null", "string") == "string"
    assert n.parent_links(n.route(frame(spark, []))).count() == 0


def test_states_bottom_up():
    run = n.Run(json.loads('{"x":[{"nodes":[]}],"nodes":{"a":1}}', parse_int=n.Number))
    assert run.object_class(run.top) == "envelope" and [k for k, _ in run.accepted()] == ["graph"]
