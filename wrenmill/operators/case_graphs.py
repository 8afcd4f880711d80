"""Case graphs from local events, relations and their pair decisions: normalization, event and relation layer, and the invariants.

Everything but the constrained merging of one linked group is a join, an aggregate or a window over columns. Null texts and evidence count as
empty, null scores as 0; decisions whose ends lie in different cases, or in none, take no part and are counted by ignored().
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wrenmill.functions import text as t
from wrenmill.operators.case_merge import merge_cases
from wrenmill.runtime import materialize, numbered

# States of event pairs and their aliases, the ends that a relation pair can map, the precedence of states, and the invariants.
EVENT_STATES = {
    "equivalent": "equivalent", "equivalent_entity": "equivalent", "related": "related", "related_not_equivalent": "related",
    "forbidden": "forbidden", "forbidden_merge": "forbidden", "uncertain": "uncertain", "review": "uncertain",
}
ENDPOINTS = (("head", "head", "head"), ("tail", "tail", "tail"), ("reverse_head", "head", "tail"), ("reverse_tail", "tail", "head"))
PRECEDENCE = ("forbidden", "equivalent", "uncertain", "related")
INVARIANTS = (
    "01_relation_heads_exist", "02_relation_tails_exist", "03_no_dangling_endpoints", "04_events_have_sources", "05_relations_have_sources", "06_event_case_boundary",
    "07_relation_case_boundary", "08_forbidden_events_not_merged", "09_conflicting_relations_not_collapsed", "10_complementary_relations_distinct",
    "11_equivalent_relation_compatibility", "12_event_document_trace", "13_relation_document_trace", "14_original_evidence_recoverable",
    "15_source_wording_and_values_preserved", "16_automatic_merges_retain_trace",
)
MENTION_FIT = 0.72


def either(df: DataFrame, kind: str, *names: str) -> Column:
    """The first of the columns that df has and that is not null."""
    return F.coalesce(*[F.col(n).cast(kind) for n in names if n in df.columns], F.lit(None).cast(kind))


def spelled(c: Column) -> Column:
    """Ids in the '_' spelling: the first ':' stands for '_'."""
    return F.regexp_replace(c, "^([^:]*):", "$1_")


def _nonzero(c: Column) -> Column:
    return F.when(c != 0, c)


def normalize_event_decisions(rows: DataFrame) -> DataFrame:
    """Canonical event decisions from either spelling of every column; a score of 0 counts as missing, unknown states as uncertain."""
    alias = F.create_map(*[F.lit(x) for kv in EVENT_STATES.items() for x in kv])
    state = F.coalesce(F.try_element_at(alias, F.coalesce(either(rows, "string", "event_state", "predicted_state", "state"), F.lit("uncertain"))), F.lit("uncertain"))
    support, score = _nonzero(either(rows, "double", "equivalence_support")), _nonzero(either(rows, "double", "score"))
    zero = F.lit(0.0)
    return rows.select(
        F.coalesce(either(rows, "string", "decision_id", "annotation_id"), F.lit("")).alias("decision_id"),
        spelled(F.coalesce(either(rows, "string", "event_a_id", "event_a"), F.lit(""))).alias("event_a_id"),
        spelled(F.coalesce(either(rows, "string", "event_b_id", "event_b"), F.lit(""))).alias("event_b_id"),
        state.alias("event_state"), F.coalesce(support, score, zero).alias("equivalence_support"),
        F.coalesce(either(rows, "double", "forbidden_risk"), zero).alias("forbidden_risk"),
        F.coalesce(_nonzero(either(rows, "double", "confidence")), support, score, zero).alias("confidence"),
        F.coalesce(either(rows, "boolean", "hard_veto"), state == "forbidden").alias("hard_veto"),
        F.coalesce(either(rows, "array<string>", "decision_reasons", "reason_codes"), F.array().cast("array<string>")).alias("decision_reasons"),
    )


def derive_event_decisions(relations: DataFrame, decisions: DataFrame, least: float = MENTION_FIT) -> DataFrame:
    """Event decisions that relation decisions imply for the ends of their relations.

    relations: relation_id, head, tail; decisions: relation_a_id, relation_b_id, endpoint_mapping_support (a map from end to
    support, forbidden_risk, mention_fit, predicted_state). One row per unordered pair of events: the state of the highest
    precedence, the maxima of its scores, the ends it comes from. Numbered in the order of the pairs.
    """
    side = lambda s: relations.select(F.col("relation_id").alias(f"relation_{s}_id"), F.col("head").alias(f"head_{s}"), F.col("tail").alias(f"tail_{s}"))
    both = decisions.join(side("a"), "relation_a_id").join(side("b"), "relation_b_id")
    ends = F.array(*[F.struct(F.lit(name).alias("role"), F.col(f"{a}_a").alias("x"), F.col(f"{b}_b").alias("y"), F.try_element_at("endpoint_mapping_support", F.lit(name)).alias("m")) for name, a, b in ENDPOINTS])
    long = both.select(F.inline(ends)).filter((F.coalesce(F.col("m.mention_fit"), F.lit(0.0)) >= least) & (F.col("x") != F.col("y")))
    alias = F.create_map(*[F.lit(x) for kv in EVENT_STATES.items() for x in kv])
    state = F.coalesce(F.try_element_at(alias, F.coalesce(F.col("m.predicted_state"), F.lit("related"))), F.lit("uncertain"))
    number = lambda c: F.coalesce(F.col(f"m.{c}"), F.lit(0.0))
    rows = long.select(F.least("x", "y").alias("event_a_id"), F.greatest("x", "y").alias("event_b_id"), "role", state.alias("s"), number("support").alias("support"), number("forbidden_risk").alias("risk"), number("mention_fit").alias("fit"))
    # the state of the highest precedence is the least place
    place = reduce(lambda c, x: c.when(F.col("s") == x[1], x[0]), list(enumerate(PRECEDENCE))[1:], F.when(F.col("s") == PRECEDENCE[0], 0))
    one = rows.groupBy("event_a_id", "event_b_id").agg(
        F.min(place).alias("place"), F.max("support").alias("equivalence_support"), F.max("risk").alias("forbidden_risk"), F.max(F.greatest("support", "risk", "fit")).alias("confidence"),
        F.array_sort(F.collect_set(F.concat(F.lit("embedded_endpoint:"), "role"))).alias("decision_reasons"), F.count(F.lit(1)).alias("n_sources"),
    )
    named = one.withColumn("event_state", F.element_at(F.array(*[F.lit(s) for s in PRECEDENCE]), F.col("place") + 1)).drop("place").withColumn("hard_veto", F.col("event_state") == "forbidden")
    keyed = named.withColumn("pair", F.concat_ws("\x01", "event_a_id", "event_b_id"))
    return numbered(keyed, None, "pair", "number").withColumn("decision_id", F.format_string("S36_ED%06d", "number")).drop("pair", "number")


def within_case(decisions: DataFrame, members: DataFrame, key: str, a: str, b: str) -> DataFrame:
    """Decisions with the case_id of both ends, or null where it is not the same; members: key, case_id."""
    side = lambda c, name: members.select(F.col(key).alias(c), F.col("case_id").alias(name))
    full = decisions.join(side(a, "ca"), a, "left").join(side(b, "cb"), b, "left")
    return full.withColumn("case_id", F.when(F.col("ca") == F.col("cb"), F.col("ca"))).withColumn("fault", F.when(F.col("ca").isNull() | F.col("cb").isNull(), "unknown").when(F.col("ca") != F.col("cb"), "cross_case")).drop("ca", "cb")


def ignored(placed: DataFrame) -> DataFrame:
    """Number of decisions that take no part, by fault."""
    return placed.filter("fault IS NOT NULL").groupBy("fault").agg(F.count(F.lit(1)).alias("n_decisions"))


def _grouped(members: DataFrame, key: str, merged: DataFrame, kind: str) -> DataFrame:
    """members with root, the least id of their group, and the numbered name of it."""
    placed = members.join(merged.select(F.col("source_id").alias(key), "root"), key, "left").withColumn("root", F.coalesce("root", key))
    placed = materialize(placed, "grouped")
    names = numbered(placed.filter(F.col("root") == F.col(key)).select("case_id", "root"), "case_id", "root", "number")
    name = F.concat("case_id", F.format_string(f"_{kind}%04d", "number")).alias("name")
    return placed.join(names.select("root", name), "root")


def event_layer(events: DataFrame, decisions: DataFrame) -> dict[str, DataFrame]:
    """Case events of source events (event_id, case_id, document_id, event_type, text, evidence_text, score) and normalized event decisions.

    mapping (event_id, case_id, case_event_id), events (one row per case event: the richest mention speaks for it), actions (case_id, a, b, action),
    review (case_id, review_type, a, b).
    """
    placed = materialize(within_case(decisions, events, "event_id", "event_a_id", "event_b_id").filter("case_id IS NOT NULL"), "event-decisions")
    merged, actions = merge_cases(placed.select("case_id", F.col("event_a_id").alias("a"), F.col("event_b_id").alias("b"), F.col("event_state").alias("state"), F.col("equivalence_support").alias("support"), "confidence"))
    mapping = materialize(_grouped(events, "event_id", merged, "E").withColumnRenamed("name", "case_event_id"), "event-mapping")
    text = F.coalesce("text", F.lit(""))
    full = mapping.withColumn("details", t.detail_count(text)).withColumn("size", F.length(F.regexp_replace(text, r"(?U)\s+", "")) + 6 * F.col("details"))
    best = F.min(F.struct((-F.col("size")).alias("r1"), (-F.col("details")).alias("r2"), (-F.coalesce("score", F.lit(0.0))).alias("r3"), "event_id", "event_type", text.alias("text")))
    docs = F.array_sort(F.collect_set("document_id"))
    each = full.groupBy("case_id", "case_event_id").agg(best.alias("b"), F.array_sort(F.collect_set("event_id")).alias("source_event_ids"), docs.alias("source_document_ids"))
    table = each.select("case_id", "case_event_id", "b.event_type", F.col("b.text").alias("canonical_text"), F.col("b.event_id").alias("canonical_source_event_id"), "source_event_ids", "source_document_ids")
    review = actions.filter("action = 'blocked'").select("case_id", F.lit("blocked_event_equivalence").alias("review_type"), "a", "b")
    unsure = placed.filter("event_state = 'uncertain'").select("case_id", F.lit("uncertain_event_pair"), "event_a_id", "event_b_id")
    return {"mapping": mapping.select("event_id", "case_id", "case_event_id"), "events": table, "actions": actions, "review": review.union(unsure)}


def relation_layer(relations: DataFrame, mapping: DataFrame, decisions: DataFrame) -> dict[str, DataFrame]:
    """Case relations of source relations (relation_id, case_id, document_id, head, relation_type, tail, evidence_text, score).

    mapping: event_layer()'s; decisions: normalized relation decisions (relation_a_id, relation_b_id, relation_state, confidence, equivalence_score,
    conflict_dimensions). Equivalent relations merge only if type and both mapped ends agree. Returns mapping (relation_id, case_relation_id and mapped ends), relations,
    links (case_relation_id, other, relation_state, conflict_dimensions), pairs (decisions on case relations), actions and review.
    """
    end = lambda c, name: mapping.select(F.col("event_id").alias(c), "case_id", F.col("case_event_id").alias(name))
    mapped = relations.join(end("head", "head_case_event_id"), ["head", "case_id"], "left").join(end("tail", "tail_case_event_id"), ["tail", "case_id"], "left")
    mapped = materialize(mapped.fillna("", ["head_case_event_id", "tail_case_event_id"]), "relations-mapped")
    placed = within_case(decisions, relations, "relation_id", "relation_a_id", "relation_b_id").filter("case_id IS NOT NULL")
    fact = F.struct("head_case_event_id", "relation_type", "tail_case_event_id")
    side = lambda s: mapped.select(F.col("relation_id").alias(f"relation_{s}_id"), fact.alias(f"fact_{s}"))
    placed = materialize(placed.join(side("a"), "relation_a_id").join(side("b"), "relation_b_id"), "relation-decisions")
    agree = (F.col("fact_a.head_case_event_id") != "") & (F.col("fact_a") == F.col("fact_b"))
    equivalent = F.col("relation_state") == "equivalent"
    usable = placed.filter(~equivalent | F.coalesce(agree, F.lit(False)))
    merged, actions = merge_cases(usable.select("case_id", F.col("relation_a_id").alias("a"), F.col("relation_b_id").alias("b"), F.col("relation_state").alias("state"), F.coalesce("equivalence_score", F.lit(0.0)).alias("support"), "confidence"))
    named = materialize(_grouped(mapped, "relation_id", merged, "R").withColumnRenamed("name", "case_relation_id"), "relation-mapping")
    evidence = F.coalesce("evidence_text", F.lit(""))
    best = F.min(F.struct((-F.length(evidence)).alias("r1"), (-F.coalesce("score", F.lit(0.0))).alias("r2"), "relation_id", "head_case_event_id", "relation_type", "tail_case_event_id"))
    each = named.groupBy("case_id", "case_relation_id").agg(
        best.alias("b"), F.array_sort(F.collect_set("relation_id")).alias("source_relation_ids"), F.array_sort(F.collect_set("document_id")).alias("source_document_ids")
    )
    name = lambda s: named.select(F.col("relation_id").alias(f"relation_{s}_id"), F.col("case_relation_id").alias(s))
    pairs = materialize(placed.join(name("a"), "relation_a_id").join(name("b"), "relation_b_id").select("case_id", "a", "b", "relation_state", "relation_a_id", "relation_b_id", "confidence", "conflict_dimensions"), "relation-pairs")
    apart = pairs.filter("a <> b AND relation_state IN ('complementary', 'conflicting')").select(F.inline(F.array(F.struct(F.col("a").alias("case_relation_id"), F.col("b").alias("other"), "relation_state", "conflict_dimensions"), F.struct(F.col("b").alias("case_relation_id"), F.col("a").alias("other"), "relation_state", "conflict_dimensions"))))
    links = apart.groupBy("case_relation_id", "other", "relation_state").agg(F.max("conflict_dimensions").alias("conflict_dimensions"))
    of = lambda state: F.array_sort(F.collect_set(F.when(F.col("relation_state") == state, F.col("other"))))
    dims = F.array_sort(F.array_remove(F.array_distinct(F.flatten(F.collect_list(F.when(F.col("relation_state") == "conflicting", F.split("conflict_dimensions", r"\|"))))), ""))
    linked = links.groupBy("case_relation_id").agg(of("complementary").alias("complementary_with"), of("conflicting").alias("conflict_with"), dims.alias("conflict_dimensions"))
    unsure = pairs.filter("relation_state = 'uncertain'")
    doubt = unsure.select(F.explode(F.array("a", "b")).alias("case_relation_id")).distinct().withColumn("doubt", F.lit(True))
    none = F.array().cast("array<string>")
    table = each.join(linked, "case_relation_id", "left").join(doubt, "case_relation_id", "left").select(
        "case_id", "case_relation_id", "b.head_case_event_id", "b.relation_type", "b.tail_case_event_id", F.when(F.size("source_relation_ids") > 1, "equivalent").otherwise("retained").alias("relation_state"),
        "source_relation_ids", "source_document_ids", *[F.coalesce(c, none).alias(c) for c in ("complementary_with", "conflict_with", "conflict_dimensions")], F.when(F.col("doubt"), "review_required").otherwise("not_required").alias("review_status"),
    )
    mismatch = placed.filter(equivalent & ~F.coalesce(agree, F.lit(False))).select("case_id", F.lit("equivalent_relation_endpoint_mismatch").alias("review_type"), F.col("relation_a_id").alias("a"), F.col("relation_b_id").alias("b"))
    blocked = actions.filter("action = 'blocked'").select("case_id", F.lit("blocked_relation_equivalence"), "a", "b")
    review = mismatch.union(blocked).union(unsure.select("case_id", F.lit("uncertain_relation_pair"), "relation_a_id", "relation_b_id"))
    return {"mapping": named.select("relation_id", "case_id", "case_relation_id", "head", "relation_type", "tail", "head_case_event_id", "tail_case_event_id"), "relations": table, "links": links, "pairs": pairs, "actions": actions, "review": review}


def violations(events: DataFrame, relations: DataFrame, documents: DataFrame, event_decisions: DataFrame, relation_decisions: DataFrame, ev: dict[str, DataFrame], rel: dict[str, DataFrame]) -> DataFrame:
    """(case_id, invariant, detail) of everything that breaks one of the INVARIANTS; documents: document_id, case_id."""
    rows = lambda df, n, detail: df.select("case_id", F.lit(INVARIANTS[n - 1]).alias("invariant"), F.col(detail).alias("detail"))
    ends = rel["relations"]
    known = ev["events"].select("case_event_id")
    lost = lambda c: ends.join(known.withColumnRenamed("case_event_id", c), c, "left_anti")
    heads, tails = lost("head_case_event_id"), lost("tail_case_event_id")
    inside = documents.select("document_id", "case_id").distinct()
    foreign = lambda df, key: df.select("case_id", key, F.explode("source_document_ids").alias("document_id")).join(inside, ["document_id", "case_id"], "left_anti")
    place = lambda m, key, name: (m.select(F.col(key).alias("a"), F.col(name).alias("pa")), m.select(F.col(key).alias("b"), F.col(name).alias("pb")))

    def together(decisions: DataFrame, a: str, b: str, mapping: DataFrame, key: str, name: str) -> DataFrame:
        x, y = place(mapping, key, name)
        case = mapping.select(F.col(name).alias("pa"), "case_id").distinct()
        return decisions.select(F.col(a).alias("a"), F.col(b).alias("b")).join(x, "a").join(y, "b").filter("pa = pb").join(case, "pa").withColumn("pair", F.concat_ws("|", "a", "b"))

    state = lambda s: relation_decisions.filter(F.col("relation_state") == s)
    mixed = rel["mapping"].groupBy("case_id", "case_relation_id").agg(F.countDistinct(F.struct("head_case_event_id", "relation_type", "tail_case_event_id")).alias("n")).filter("n > 1")
    empty = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    texts = ev["mapping"].join(events.select("event_id", "text"), "event_id")
    said = ev["events"].join(texts.select("case_event_id", F.coalesce("text", F.lit("")).alias("canonical_text")).distinct(), ["case_event_id", "canonical_text"], "left_anti")
    merges = lambda layer, key, name: layer["actions"].filter("action <> 'blocked'").select(F.col("a").alias(key)).join(layer["mapping"].select(key, name), key).select(name).distinct()
    silent = lambda df, sources, layer, key, name: df.filter(F.size(sources) > 1).join(merges(layer, key, name), name, "left_anti")
    parts = [
        rows(heads, 1, "case_relation_id"), rows(tails, 2, "case_relation_id"), rows(heads.unionByName(tails).distinct(), 3, "case_relation_id"),
        rows(ev["events"].filter(F.size("source_event_ids") == 0), 4, "case_event_id"), rows(events.join(ev["mapping"].select("event_id"), "event_id", "left_anti"), 4, "event_id"),
        rows(ends.filter(F.size("source_relation_ids") == 0), 5, "case_relation_id"), rows(relations.join(rel["mapping"].select("relation_id"), "relation_id", "left_anti"), 5, "relation_id"),
        rows(foreign(ev["events"], "case_event_id"), 6, "case_event_id"), rows(foreign(ends, "case_relation_id"), 7, "case_relation_id"),
        rows(together(event_decisions.filter("event_state = 'forbidden'"), "event_a_id", "event_b_id", ev["mapping"], "event_id", "case_event_id"), 8, "pair"),
        rows(together(state("conflicting"), "relation_a_id", "relation_b_id", rel["mapping"], "relation_id", "case_relation_id"), 9, "pair"),
        rows(together(state("complementary"), "relation_a_id", "relation_b_id", rel["mapping"], "relation_id", "case_relation_id"), 10, "pair"),
        rows(mixed, 11, "case_relation_id"), rows(events.join(inside, ["document_id", "case_id"], "left_anti"), 12, "event_id"), rows(relations.join(inside, ["document_id", "case_id"], "left_anti"), 13, "relation_id"),
        rows(events.filter(empty("text") & empty("evidence_text")), 14, "event_id"), rows(relations.filter(empty("evidence_text")), 14, "relation_id"), rows(said, 15, "case_event_id"),
        rows(silent(ev["events"], "source_event_ids", ev, "event_id", "case_event_id"), 16, "case_event_id"), rows(silent(ends, "source_relation_ids", rel, "relation_id", "case_relation_id"), 16, "case_relation_id"),
    ]
    return reduce(DataFrame.unionByName, parts).distinct()


def build(events: DataFrame, relations: DataFrame, documents: DataFrame, event_decisions: DataFrame, relation_decisions: DataFrame) -> dict[str, DataFrame]:
    """All tables of the case graphs: both layers, violations, the decisions left out and one summary row per case."""
    ev = event_layer(events, event_decisions)
    rel = relation_layer(relations, ev["mapping"], relation_decisions)
    bad = materialize(violations(events, relations, documents, event_decisions, relation_decisions, ev, rel), "violations")
    count = lambda df, name: df.groupBy("case_id").agg(F.count(F.lit(1)).alias(name))
    parts = [count(documents.select("document_id", "case_id").distinct(), "n_documents"), count(events, "n_source_events"), count(ev["events"], "n_case_events"), count(relations, "n_source_relations"), count(rel["relations"], "n_case_relations")]
    parts += [count(ev["review"].union(rel["review"]), "n_review"), bad.groupBy("case_id").agg(F.countDistinct("invariant").alias("n_failed"))]
    summary = reduce(lambda a, b: a.join(b, "case_id", "left"), parts).fillna(0).withColumn("passed", F.col("n_failed") == 0)
    out = {f"event_{k}": v for k, v in ev.items()} | {f"relation_{k}": v for k, v in rel.items()}
    return out | {"violations": bad, "summary": summary, "ignored_events": ignored(within_case(event_decisions, events, "event_id", "event_a_id", "event_b_id")), "ignored_relations": ignored(within_case(relation_decisions, relations, "relation_id", "relation_a_id", "relation_b_id"))}


# --- local graphs -------------------------------------------------------------------------------------------


def normalize_local_graphs(routed: dict[str, DataFrame]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Events, relations and documents of the supertype tables of nested_tables.route(): alternate names resolved, global ids, evidence from the text where none is given.

    Of graphs sent again the first line counts; nodes and relations without an id, and repeated ids of one document, keep the first row.
    """
    get = lambda *names: F.coalesce(*[F.get_json_object("payload", f"$.{n}") for n in names])
    graphs = routed["graph"].filter("document_id IS NOT NULL")
    first = graphs.groupBy("document_id").agg(F.min(F.struct("line_no", "graph_no", F.coalesce(get("text"), F.lit("")).alias("text"), get("case_cluster_id").alias("case_cluster_id"))).alias("g")).select("document_id", "g.*")
    first = materialize(first, "documents")
    chosen = first.select("document_id", "line_no", "graph_no", F.col("text").alias("source_text"))

    def rows(kind: str) -> DataFrame:
        own = routed[kind].filter("key IS NOT NULL").join(chosen, ["document_id", "line_no", "graph_no"])
        least = own.groupBy("document_id", "key").agg(F.min("ordinal").alias("ordinal"))
        return own.join(least, ["document_id", "key", "ordinal"])

    place = lambda c: F.coalesce(get(c).cast("int"), F.lit(-1))
    kind = lambda *names: F.upper(F.coalesce(get(*names), F.lit("UNKNOWN")))
    nodes = rows("node").withColumns({"start": place("start"), "end": place("end")})
    given = lambda *names: F.when(F.length(F.coalesce(get(*names), F.lit(""))) > 0, get(*names))
    events = nodes.select(
        t.global_id(F.col("document_id"), F.col("key")).alias("event_id"), F.col("key").alias("local_id"), "document_id", kind("type", "entity_type").alias("event_type"), F.coalesce(get("text", "name"), F.lit("")).alias("text"),
        "start", "end", F.coalesce(given("evidence_sentence"), t.sentence_evidence(F.col("source_text"), F.col("start"), F.col("end"))).alias("evidence_text"), get("score", "confidence").cast("double").alias("score"), get("modality").alias("modality"), get("state").alias("state"),
    )
    events = materialize(events, "local-events")
    end = lambda s: events.select("document_id", F.col("local_id").alias(s), F.col("start").alias(f"{s}_start"), F.col("end").alias(f"{s}_end"))
    rels = rows("relation").withColumns({"head": F.coalesce("head", F.lit("")), "tail": F.coalesce("tail", F.lit(""))}).join(end("head"), ["document_id", "head"], "left").join(end("tail"), ["document_id", "tail"], "left")
    found = F.when(F.col("head_start").isNotNull() & F.col("tail_start").isNotNull(), t.sentence_evidence(F.col("source_text"), F.least("head_start", "tail_start"), F.greatest("head_end", "tail_end")))
    whole = lambda c: t.global_id(F.col("document_id"), F.col(c))
    relations = rels.select(
        whole("key").alias("relation_id"), "document_id", whole("head").alias("head"), kind("type", "relation", "relation_type").alias("relation_type"), whole("tail").alias("tail"),
        F.coalesce(given("evidence_text", "evidence_sentence"), found, F.lit("")).alias("evidence_text"), get("score", "confidence").cast("double").alias("score"), get("modality").alias("modality"),
    )
    return events, relations, first.select("document_id", "text", "case_cluster_id")
