"""Queries of the training-data operators that live in the core."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wrenmill.operators import nested_tables, orphan_references
from wrenmill.runtime import table


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = table(spark, sf_dir, "event_nodes")
    return orphan_references.maintenance_orphans(table(spark, sf_dir, "relation_edges"), nodes, table(spark, sf_dir, "records"))


def p5_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orphan_references.orphan_report(p5_found(spark, sf_dir))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nested_tables.parent_links(nested_tables.route(table(spark, sf_dir, "local_graphs"), with_payload=False))


def p7_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nested_tables.variants(nested_tables.route(table(spark, sf_dir, "local_graphs"), with_payload=False))


def p7_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the subtype table of views with a name, a score and a span."""
    views = nested_tables.route(table(spark, sf_dir, "local_graphs"))["view"]
    shape = "struct<score:double,span:struct<end:bigint,start:bigint>,view:string>"
    place = lambda end: F.get_json_object("f_span", f"$.{end}").cast("bigint").alias(f"span_{end}")
    return nested_tables.subtype_table(views, shape).select("document_id", "parent_key", "key", "ordinal", F.round("f_score", 6).alias("score"), place("start"), place("end"))


_P5_CASES = """
WITH nodes AS (SELECT uid, min(loaded_at) AS first_loaded, min(deleted_at) AS deleted FROM event_nodes WHERE uid IS NOT NULL GROUP BY uid),
docs AS (SELECT document_id, min(loaded_at) AS first_loaded, min(deleted_at) AS deleted FROM records WHERE document_id IS NOT NULL GROUP BY document_id),
edges AS (SELECT uid, min(loaded_at) AS t FROM relation_edges WHERE uid IS NOT NULL GROUP BY uid),
refs AS (
  SELECT DISTINCT 'relation_edges' AS table_name, 'head_uid' AS field_name, e.uid AS row_key, e.head_uid AS ref_key, x.t FROM relation_edges e JOIN edges x ON e.uid = x.uid
  UNION ALL
  SELECT DISTINCT 'relation_edges', 'tail_uid', e.uid, e.tail_uid, x.t FROM relation_edges e JOIN edges x ON e.uid = x.uid
  UNION ALL
  SELECT DISTINCT 'event_nodes', 'source_document_ids', n.uid, n.ref, x.first_loaded
  FROM (SELECT uid, unnest(source_document_ids) AS ref FROM event_nodes) n JOIN nodes x ON n.uid = x.uid),
known AS (
  SELECT r.*, p.first_loaded, p.deleted, p.uid IS NOT NULL AS hit FROM refs r LEFT JOIN nodes p ON r.ref_key = p.uid WHERE r.table_name = 'relation_edges'
  UNION ALL
  SELECT r.*, p.first_loaded, p.deleted, p.document_id IS NOT NULL FROM refs r LEFT JOIN docs p ON r.ref_key = p.document_id WHERE r.table_name = 'event_nodes'),
cases AS (
  SELECT table_name, field_name, row_key, ref_key,
    CASE WHEN NOT hit THEN 'missing' WHEN first_loaded > t THEN 'late' WHEN deleted <= t THEN 'deleted' END AS reason,
    strftime(t, '%Y-%m') AS period
  FROM known WHERE ref_key IS NOT NULL AND ref_key <> '')
"""

_P7_LISTS = """
WITH RECURSIVE raw AS (SELECT CASE WHEN line LIKE chr(65279) || '%' THEN substr(line, 2) ELSE line END AS l FROM local_graphs),
ok AS (SELECT l::JSON AS j FROM raw WHERE l IS NOT NULL AND json_valid(l) AND json_type(CASE WHEN json_valid(l) THEN l END) = 'OBJECT'),
w AS (
  SELECT j AS v FROM ok
  UNION ALL
  SELECT x.value FROM w, json_each(w.v) x
  WHERE x.type IN ('OBJECT', 'ARRAY') AND (json_type(w.v) = 'ARRAY' OR json_type(w.v, '$.graphs') = 'ARRAY' OR NOT (
    coalesce(json_type(w.v, '$.nodes'), '') = 'ARRAY' OR coalesce(json_type(w.v, '$.entities'), '') = 'ARRAY' OR coalesce(json_type(w.v, '$.relations'), '') = 'ARRAY'))),
g AS (SELECT v AS g FROM w WHERE json_type(v) = 'OBJECT' AND coalesce(json_type(v, '$.graphs'), '') <> 'ARRAY'),
gg AS (
  SELECT g ->> '$.document_id' AS document_id,
    CASE WHEN json_type(g, '$.nodes') = 'ARRAY' THEN json_extract(g, '$.nodes') WHEN json_type(g, '$.entities') = 'ARRAY' THEN json_extract(g, '$.entities') END AS nodes,
    CASE WHEN json_type(g, '$.relations') = 'ARRAY' THEN json_extract(g, '$.relations') END AS rels FROM g),
n AS (
  SELECT document_id, coalesce(x ->> '$.event_id', x ->> '$.entity_id', x ->> '$.node_id') AS id,
    CASE WHEN json_type(x, '$.views') = 'ARRAY' THEN json_extract(x, '$.views') END AS views
  FROM (SELECT document_id, unnest(CAST(nodes AS JSON[])) AS x FROM gg)),
v AS (SELECT document_id, id, w ->> '$.view' AS view FROM (SELECT document_id, id, unnest(CAST(views AS JSON[])) AS w FROM n)),
r AS (
  SELECT document_id, coalesce(x ->> '$.relation_id', x ->> '$.id') AS id, coalesce(x ->> '$.head_event_id', x ->> '$.head') AS head,
    coalesce(x ->> '$.tail_event_id', x ->> '$.tail') AS tail
  FROM (SELECT document_id, unnest(CAST(rels AS JSON[])) AS x FROM gg))
"""

SQL = {
    "p5_found": _P5_CASES + "SELECT * FROM cases WHERE reason IS NOT NULL",
    "p5_report": _P5_CASES
    + """SELECT table_name, field_name, reason, period, count(*) AS n_references, count(DISTINCT ref_key) AS n_keys
    FROM cases WHERE reason IS NOT NULL GROUP BY ALL""",
    "p7_found": _P7_LISTS + """SELECT DISTINCT * FROM (
  SELECT document_id, 'node' AS link, document_id AS parent_key, id AS child_key FROM n
  UNION ALL SELECT document_id, 'view', id, view FROM v
  UNION ALL SELECT document_id, 'relation', document_id, id FROM r
  UNION ALL SELECT document_id, 'head', id, head FROM r
  UNION ALL SELECT document_id, 'tail', id, tail FROM r)
WHERE child_key IS NOT NULL""",
    "p7_views": _P7_LISTS + """
SELECT document_id, id AS parent_key, w ->> '$.view' AS key, i - 1 AS ordinal, round(CAST(w ->> '$.score' AS DOUBLE), 6) AS score,
  CAST(w ->> '$.span.start' AS BIGINT) AS span_start, CAST(w ->> '$.span.end' AS BIGINT) AS span_end
FROM (SELECT document_id, id, unnest(CAST(views AS JSON[])) AS w, unnest(range(1, json_array_length(views)::BIGINT + 1)) AS i FROM n)
WHERE list_sort(json_keys(w)) = ['score', 'span', 'view'] AND json_type(w, '$.score') = 'DOUBLE' AND json_type(w, '$.view') = 'VARCHAR'
  AND list_sort(json_keys(w, '$.span')) = ['end', 'start'] AND contains(json_type(w, '$.span.start'), 'BIGINT') AND contains(json_type(w, '$.span.end'), 'BIGINT')""",
}

QUERIES = {"p5_found": p5_found, "p5_report": p5_report, "p7_found": p7_found, "p7_variants": p7_variants, "p7_views": p7_views}
