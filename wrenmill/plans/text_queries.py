"""Queries of the text functions over mentions, records and consecutive mentions of a document."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wrenmill.functions import text as t
from wrenmill.runtime import table


def mentions(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "event_nodes").select("uid", "document_id", "text", "role", "start_pos").distinct()


def mention_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Each mention with the next of its document: linear in the mentions, whatever a document's size."""
    w = Window.partitionBy("document_id").orderBy("start_pos", "uid")
    rows = mentions(spark, d).filter("text IS NOT NULL AND document_id IS NOT NULL")
    out = rows.select("uid", F.col("text").alias("a"), F.col("role").alias("role_a"), F.lead("text").over(w).alias("b"), F.lead("role").over(w).alias("role_b"))
    return out.filter("b IS NOT NULL")


MENTIONS = "(SELECT DISTINCT uid, document_id, text, role, start_pos FROM event_nodes)"
PAIRS = f"""(SELECT * FROM (SELECT uid, text AS a, role AS role_a, lead(text) OVER w AS b, lead(role) OVER w AS role_b
  FROM {MENTIONS} m WHERE text IS NOT NULL AND document_id IS NOT NULL WINDOW w AS (PARTITION BY document_id ORDER BY start_pos NULLS FIRST, uid)) WHERE b IS NOT NULL)"""


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def re2(pattern: str) -> str:
    """The same pattern for RE2."""
    for flag in ("(?U)", "(?iU)"):
        if pattern.startswith(flag):
            i = "(?i)" if "i" in flag else ""
            return i + pattern[len(flag) :].replace(r"\d", r"\p{Nd}").replace("[\\s", "[\\s\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}").replace(r"^\s+", "^" + WS).replace(r"\s+", WS)
    return pattern


WS = r"[\s\x{b}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"


def fold(x: str) -> str:
    return f"replace(lower({x}), 'ß', 'ss')"


def all_of(x: str, pattern: str) -> str:
    return f"regexp_extract_all({x}, {q(re2(pattern))})"


def grams(x: str, n: int) -> str:
    return f"list_transform(range(1, greatest(length({x}) - {n - 2}, 2)), lambda i: substr({x}, i::INT, {n}))"


def tokens(x: str) -> str:
    han = f"flatten(list_transform({all_of(fold(x), t.HAN_RUN)}, lambda r: list_concat({grams('r', 1)}, CASE WHEN length(r) > 1 THEN {grams('r', 2)} ELSE [] END)))"
    return f"list_concat({all_of(fold(x), t.LATIN_TOKEN)}, {han})"


def gram_set(x: str, n: int = 2) -> str:
    y = f"regexp_replace({fold(x)}, {q(WS)}, '', 'g')"
    return f"(CASE WHEN length({y}) = 0 THEN [] WHEN length({y}) < {n} THEN [{y}] ELSE list_distinct({grams(y, n)}) END)"


def dice(a: str, b: str) -> str:
    x, y = gram_set(a), gram_set(b)
    return f"(CASE WHEN len({x}) = 0 OR len({y}) = 0 THEN 0.0 ELSE 2.0 * len(list_intersect({x}, {y})) / (len({x}) + len({y})) END)"


def mention(x: str) -> str:
    return f"regexp_replace(regexp_replace({fold(x)}, {q(re2(t.MENTION_MARKS))}, '', 'g'), {q(t.MENTION_PREFIX)}, '')"


def similar(a: str, b: str) -> str:
    return f"(SELECT CASE WHEN length(x) = 0 OR length(y) = 0 THEN 0.0 WHEN x = y THEN 1.0 WHEN contains(x, y) OR contains(y, x) THEN greatest({dice('x', 'y')}, 0.82 + 0.18 * least(length(x), length(y)) / greatest(length(x), length(y))) ELSE {dice('x', 'y')} END FROM (SELECT {mention(a)} AS x, {mention(b)} AS y))"


def numbers(x: str) -> str:
    return f"list_sort(list_distinct({all_of(x, t.NUMBER)}))"


def numeral(a: str, b: str) -> str:
    return f"(len({numbers(a)}) > 0 AND len({numbers(b)}) > 0 AND {numbers(a)} <> {numbers(b)})"


def hit(x: str, words: str) -> str:
    return f"regexp_matches({x}, {q(words)})"


def negation(a: str, b: str) -> str:
    n = lambda x: hit(f"regexp_replace({x}, {q(t.QUESTION)}, '', 'g')", t.NEGATION)
    return f"({n(a)} <> {n(b)})"


def cases(x: str, *pairs: tuple[str, str], other: str) -> str:
    return "CASE " + " ".join(f"WHEN {hit(x, w)} THEN {q(s)}" for w, s in pairs) + f" ELSE {q(other)} END"


def event_state(x: str) -> str:
    return cases(x, (t.INSPECTION, "inspection"), (t.EVENT_NEGATIVE, "negative"), (t.EVENT_REPAIRED, "repaired"), other="neutral")


def endpoint_state(x: str) -> str:
    return cases(x, (t.INSPECTION, "inspection"), (t.ENDPOINT_NEGATIVE, "negative"), (t.ENDPOINT_REPAIRED, "repaired"), (t.ENDPOINT_FAILURE, "failure"), other="neutral")


def units(x: str) -> str:
    return f"list_sort(list_transform({all_of(x, t.NUMBER_UNIT)}, lambda u: lower(u)))"


def concept(x: str) -> str:
    out = f"regexp_replace(lower(trim(coalesce({x}, ''))), {q(re2(t.CONCEPT_MARKS))}, '', 'g')"
    for pattern, word in t.CONCEPT_SYNONYMS:
        out = f"regexp_replace({out}, {q(pattern)}, {q(word)}, 'g')"
    return out


def containment(a: str, b: str) -> str:
    g = lambda x: f"(CASE WHEN length({x}) = 0 THEN [] WHEN length({x}) < 2 THEN [{x}] ELSE list_distinct({grams(x, 2)}) END)"
    return f"(len(list_intersect({g(a)}, {g(b)}))::DOUBLE / greatest(1, least(len({g(a)}), len({g(b)}))))"


def A():  # noqa: N802
    return F.col("a")


def B():  # noqa: N802
    return F.col("b")


def X():  # noqa: N802
    return F.col("text")


SORT = lambda c: F.array_join(F.array_sort(c), "|")

#: name: (over mentions or pairs, column, SQL)
SCALARS = {
    "t1_domain_tokens": ("m", lambda: SORT(t.domain_tokens(X())), f"array_to_string(list_sort({tokens('text')}), '|')"),
    "t2_character_dice": ("p", lambda: F.round(t.dice(A(), B()), 6), f"round({dice('a', 'b')}, 6)"),
    "t3_normalize_mention": ("m", lambda: t.normalize_mention(X()), mention("text")),
    "t4_mention_similarity": ("p", lambda: F.round(t.mention_similarity(A(), B()), 6), f"round({similar('a', 'b')}, 6)"),
    "t5_token_set": ("m", lambda: SORT(t.token_set(X())), f"array_to_string(list_sort(list_filter(list_distinct({tokens('text')}), lambda k: length(k) > 1 OR regexp_matches(k, '\\p{{Nd}}'))), '|')"),
    "t6_numeral_conflict": ("p", lambda: t.numeral_conflict(A(), B()), numeral("a", "b")),
    "t7_negation_conflict": ("p", lambda: t.negation_conflict(A(), B()), negation("a", "b")),
    "t8_maintenance_state": ("m", lambda: t.event_state(X()), event_state("text")),
    "t9_endpoint_state": ("m", lambda: t.endpoint_state(X()), endpoint_state("text")),
    "t10_state_conflict": ("p", lambda: t.state_conflict(A(), B()), f"(list_sort([{endpoint_state('a')}, {endpoint_state('b')}]) = ['negative', 'repaired'])"),
    "t13_modality": ("m", lambda: t.modality(X()), cases("text", (t.SUSPECTED, "suspected"), (t.POSSIBLE, "possible"), (t.CONFIRMED, "confirmed"), other="unknown")),
    "t20_detail_count": ("m", lambda: t.detail_count(X()).cast("bigint"), f"len({all_of('text', t.DETAIL)})"),
    "t21_concept_text": ("m", lambda: t.concept_text(X()), concept("text")),
    "t22_number_safe": ("p", lambda: t.number_safe(A(), B()), f"NOT (len({units('a')}) > 0 AND len({units('b')}) > 0 AND {units('a')} <> {units('b')})"),
    "t23_gram_containment": ("p", lambda: F.round(t.gram_containment(A(), B()), 6), f"round({containment('a', 'b')}, 6)"),
    "t24_concept_id": ("m", lambda: t.concept_id(F.col("role"), t.concept_text(X())), f"'C_' || substr(role, 1, 3) || '_' || substr(sha1(role || '|' || {concept('text')}), 1, 12)"),
    "s11_event_hard_conflict": (
        "p", lambda: (F.col("role_a") != F.col("role_b")) | t.numeral_conflict(A(), B()) | t.negation_conflict(A(), B()) | t.state_conflict(A(), B(), t.event_state),
        f"(role_a <> role_b OR {numeral('a', 'b')} OR {negation('a', 'b')} OR list_sort([{event_state('a')}, {event_state('b')}]) = ['negative', 'repaired'])",
    ),
}


def _scalar(over: str, column) -> object:
    def run(spark: SparkSession, d: str) -> DataFrame:
        rows = mentions(spark, d).filter("text IS NOT NULL") if over == "m" else mention_pairs(spark, d)
        return rows.select("uid", column().alias("value"))

    return run


QUERIES = {name: _scalar(over, column) for name, (over, column, _) in SCALARS.items()}
SQL = {name: f"SELECT uid, {sql} AS value FROM {MENTIONS + ' m WHERE text IS NOT NULL' if over == 'm' else PAIRS}" for name, (over, _, sql) in SCALARS.items()}


def t11_role_compatible(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "relation_edges")
    w = Window.partitionBy("document_id").orderBy("uid", "relation_type")
    rows = e.filter("document_id IS NOT NULL").select("uid", "document_id", "relation_type").distinct()
    rows = rows.select("uid", F.col("relation_type").alias("l"), F.lead("relation_type").over(w).alias("r")).filter("r IS NOT NULL")
    return rows.select("uid", t.role_compatible(F.col("l"), F.col("r")).alias("value"))


def t12_sentence_spans(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "records").select("document_id", "text").distinct().filter("text IS NOT NULL")
    return r.select("document_id", F.inline(t.sentence_array(X()))).withColumnsRenamed({"start": "start_pos", "end": "end_pos"})


def t15_slot_values(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "records").select("document_id", "text").distinct().filter("text IS NOT NULL")
    named = lambda slot: (lambda v: F.struct(F.lit(slot).alias("slot"), v.alias("value")))
    found = F.flatten(F.array(*[F.transform(t.slot_values(X(), s), named(s)) for s in t.SLOT_PATTERNS]))
    return r.select("document_id", F.inline(found)).groupBy("document_id", "slot", "value").agg(F.count(F.lit(1)).alias("n"))


def t18_global_id(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "relation_decisions").select("decision_id", F.split_part("relation_a_id", F.lit("_"), F.lit(1)).alias("doc"), "relation_a_id").distinct()
    return e.filter("relation_a_id IS NOT NULL").select("decision_id", t.global_id(F.split_part("doc", F.lit(":"), F.lit(1)), F.col("relation_a_id")).alias("value"))


def t19_sentence_evidence(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "event_nodes").select("uid", "document_id", "start_pos", "end_pos").distinct()
    r = table(spark, d, "records").select("document_id", "text").distinct()
    return n.join(r, "document_id").filter("text IS NOT NULL AND start_pos IS NOT NULL AND end_pos IS NOT NULL").select("uid", t.sentence_evidence(X(), F.col("start_pos"), F.col("end_pos")).alias("value"))


QUERIES |= {f.__name__: f for f in (t11_role_compatible, t12_sentence_spans, t15_slot_values, t18_global_id, t19_sentence_evidence)}
_KNOWN = "('CAUSE', 'TREAT', 'VERIFY', 'TEMPORAL')"
SQL |= {
    "t11_role_compatible": f"""SELECT uid, upper(l) IN {_KNOWN} AND upper(r) IN {_KNOWN} AS value FROM (
  SELECT uid, relation_type AS l, lead(relation_type) OVER (PARTITION BY document_id ORDER BY uid, relation_type NULLS FIRST) AS r
  FROM (SELECT DISTINCT uid, document_id, relation_type FROM relation_edges WHERE document_id IS NOT NULL)) WHERE r IS NOT NULL""",
    "t12_sentence_spans": rf"""WITH r AS (SELECT DISTINCT document_id, text FROM records WHERE text IS NOT NULL),
p AS (SELECT document_id, unnest(regexp_extract_all(text, '[^。！？；\n]*[。！？；\n]|[^。！？；\n]+$')) AS part, generate_subscripts(regexp_extract_all(text, '[^。！？；\n]*[。！？；\n]|[^。！？；\n]+$'), 1) AS i FROM r),
s AS (SELECT *, coalesce(sum(length(part)) OVER (PARTITION BY document_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::INT AS pos FROM p),
u AS (SELECT *, regexp_replace(part, '^{WS}', '') AS tail FROM s)
SELECT document_id, (pos + length(part) - length(tail))::INT AS start_pos, (pos + length(part))::INT AS end_pos, regexp_replace(tail, '{WS}$', '') AS sentence FROM u WHERE length(tail) > 0""",
    "t15_slot_values": "WITH r AS (SELECT DISTINCT document_id, text FROM records WHERE text IS NOT NULL), v AS ("
    + " UNION ALL ".join(f"SELECT document_id, {q(s)} AS slot, unnest({all_of('text', p)}) AS value FROM r" for s, p in t.SLOT_PATTERNS.items())
    + ") SELECT document_id, slot, value, count(*) AS n FROM v GROUP BY ALL",
    "t18_global_id": """WITH e AS (SELECT DISTINCT decision_id, split_part(split_part(relation_a_id, '_', 1), ':', 1) AS doc, relation_a_id AS id FROM relation_decisions WHERE relation_a_id IS NOT NULL)
SELECT decision_id, CASE WHEN starts_with(id, doc || '_') OR starts_with(id, doc || ':') THEN regexp_replace(id, '^([^:]*):', '\\1_') ELSE doc || '_' || id END AS value FROM e""",
    "t19_sentence_evidence": rf"""SELECT uid, CASE WHEN length(text) > 0 AND s >= 0 AND e > s AND e <= length(text) THEN
  regexp_replace(regexp_replace(regexp_extract(substr(text, 1, s), '[^。！？；\n]*$') || substr(text, s + 1, e - s) || regexp_extract(substr(text, e + 1), '^[^。！？；\n]*[。！？；\n]?'), '^{WS}', ''), '{WS}$', '') ELSE '' END AS value
FROM (SELECT DISTINCT uid, document_id, start_pos AS s, end_pos AS e FROM event_nodes WHERE start_pos IS NOT NULL AND end_pos IS NOT NULL) n JOIN (SELECT DISTINCT document_id, text FROM records WHERE text IS NOT NULL) r USING (document_id)""",
}
