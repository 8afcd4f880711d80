"""Hierarchy of cases: association graph, role-aware sparse vectors, backbone topics, one layer of matched residual topics, catalog and unified graph.

Units are named by position: C%04d for cases in id order, B%04d for partitions in the order of their least case (those of one case keep the case unit but
use up a number), R%04d for matched pairs of roots. Cases without a vector or feature count as similarity 0.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wrenmill.config import AssociationConfig
from wrenmill.functions.text import bound
from wrenmill.operators import case_merge, matching, patterns, resolution
from wrenmill.runtime import materialize, numbered, spread


# --- role-aware sparse vectors ------------------------------------------------------------------------------


def _grams(text: Column, low: int, high: int) -> Column:
    def cut(t: Column) -> Column:
        # by an array of characters: a substring counts from the start of its text, which takes the square of a long one
        piece = lambda cs, n: lambda i: F.concat(*[F.get(cs, i + k) for k in range(n)])
        each = lambda cs: [F.when(F.size(cs) >= n, F.transform(F.sequence(F.lit(0), F.size(cs) - n), piece(cs, n))).otherwise(F.array().cast("array<string>")) for n in range(low, high + 1)]
        return bound(F.regexp_extract_all(t, F.lit("(?s)."), F.lit(0)), lambda cs: F.flatten(F.array(*each(cs))))

    return bound(F.regexp_replace(F.lower(text), r"(?U)\s\s+", " "), cut)


def role_vectors(nodes: DataFrame, role: str, low: int = 2, high: int = 4, most: int = 60_000) -> DataFrame:
    """(case_id, term, w): unit TF-IDF vectors of the texts that a case has in one role.

    Inverse document frequencies come from the case texts and every single mention; beyond `most` terms the commonest of the corpus are kept, by
    number, then term. Cases without a text of the role have no rows; nodes: uid, case_id, role, text.
    """
    own = nodes.filter((F.col("role") == role) & (F.length(F.regexp_replace(F.coalesce("text", F.lit("")), r"(?U)\s+", "")) > 0) & F.col("case_id").isNotNull())
    joined = own.groupBy("case_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("uid", "text"))), lambda x: x["text"]), "；").alias("text"))
    # equal mentions are one text with their number
    docs = joined.withColumn("n", F.lit(1)).unionByName(own.groupBy("text").agg(F.count(F.lit(1)).alias("n")).withColumn("case_id", F.lit(None).cast("string")))
    docs = materialize(docs.withColumn("doc", F.monotonically_increasing_id()), "role-texts")
    tf = spread(docs).select("doc", "case_id", "n", F.explode(_grams(F.col("text"), low, high)).alias("term")).groupBy("doc", "case_id", "n", "term").agg(F.count(F.lit(1)).alias("tf"))
    tf = materialize(tf, "role-terms")
    n = docs.agg(F.sum("n")).first()[0] or 0
    seen = tf.groupBy("term").agg(F.sum("n").alias("df"), F.sum(F.col("tf") * F.col("n")).alias("total")).orderBy(F.desc("total"), "term").limit(most)
    idf = seen.select("term", (F.log((F.lit(n) + 1.0) / (F.col("df") + 1.0)) + 1.0).alias("idf"))
    raw = tf.filter("case_id IS NOT NULL").join(idf, "term").select("case_id", "term", ((1.0 + F.log("tf")) * F.col("idf")).alias("w"))
    return _unit(raw, "case_id")


def _unit(rows: DataFrame, key: str) -> DataFrame:
    norm = rows.groupBy(key).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return rows.join(norm, key).select(key, "term", (F.col("w") / F.col("norm")).alias("w"))


def sparse_similarity(pairs: DataFrame, vectors: DataFrame, key: str, a: str, b: str, name: str) -> DataFrame:
    """pairs with the dot product of the sparse vectors of a and b, 0 where one has none."""
    return patterns.overlaps(pairs, patterns.packed(vectors, key, "term", "w"), a, b).drop("__shared").withColumnRenamed("__dot", name)


def topic_vectors(members: DataFrame, vectors: DataFrame) -> DataFrame:
    """(unit_id, term, w): unit sums of the leaf vectors of a unit's cases; the vocabulary and its weights stay those of the leaves."""
    sums = members.select("unit_id", "case_id").distinct().join(vectors, "case_id").groupBy("unit_id", "term").agg(F.sum("w").alias("w"))
    return _unit(sums, "unit_id")


# --- evidence of units --------------------------------------------------------------------------------------


def unit_features(members: DataFrame, feats: DataFrame) -> DataFrame:
    """(unit_id, feature): the union of the features of a unit's cases."""
    return members.select("unit_id", "case_id").join(feats, "case_id").select("unit_id", "feature").distinct()


def reference_idf(feats: DataFrame, reference: DataFrame, unseen: float | None = None) -> DataFrame:
    """(feature, idf) of the features at hand by a reference corpus; those it lacks take `unseen`, or its highest value, or 1."""
    fallback = reference.agg(F.coalesce(F.lit(unseen).cast("double"), F.max("idf"), F.lit(1.0)).alias("fallback"))
    return feats.select("feature").distinct().join(reference.select("feature", "idf"), "feature", "left").crossJoin(F.broadcast(fallback)).select("feature", F.coalesce("idf", "fallback").alias("idf"))


def unknown_features(feats: DataFrame, idf: DataFrame) -> DataFrame:
    """Features without a weight in the corpus; there must be none before units are compared."""
    return feats.select("feature").distinct().join(idf.select("feature"), "feature", "left_anti")


def unit_vectors(members: DataFrame, vectors: DataFrame, size: int = 64) -> DataFrame:
    """(unit_id, v): unit sum of the vectors v of a unit's cases, summed map-side per component."""
    sums = members.select("unit_id", "case_id").distinct().join(vectors, "case_id").groupBy("unit_id").agg(F.array(*[F.sum(F.col("v")[i]) for i in range(size)]).alias("m"))
    norm = F.greatest(F.sqrt(F.aggregate("m", F.lit(0.0), lambda a, x: a + x * x)), F.lit(1e-12))
    return sums.withColumn("norm", norm).select("unit_id", F.transform("m", lambda x: x / F.col("norm")).alias("v"))


def score_units(pairs: DataFrame, vectors: DataFrame, feats: DataFrame, idf: DataFrame, config: AssociationConfig = AssociationConfig()) -> DataFrame:
    """pairs (a, b) of units with semantic, evidence and association; vectors: unit_id, v; feats: unit_id, feature."""
    v = lambda s: vectors.select(F.col("unit_id").alias(s), F.col("v").alias(f"v{s}"))
    evidence = patterns.pair_jaccard(pairs, feats.withColumnRenamed("unit_id", "case_id"), idf)
    full = evidence.join(v("a"), "a", "left").join(v("b"), "b", "left")
    full = full.withColumn("semantic", F.coalesce(resolution.cosine(F.col("va"), F.col("vb")), F.lit(0.0))).drop("va", "vb")
    return full.withColumn("association", config.semantic_weight * F.col("semantic") + config.evidence_weight * F.col("evidence"))


def association_graph(vectors: DataFrame, feats: DataFrame, idf: DataFrame, config: AssociationConfig = AssociationConfig()) -> DataFrame:
    """(a, b, semantic, evidence, association) of the nearest cases by vector whose association reaches the threshold."""
    near = materialize(case_merge.near_cases(vectors, config.top_k), "near-cases").select("a", "b")
    scored = score_units(near, vectors.withColumnRenamed("case_id", "unit_id"), feats.withColumnRenamed("case_id", "unit_id"), idf, config)
    return scored.filter(F.col("association") >= config.threshold)


# --- units --------------------------------------------------------------------------------------------------


def leaf_units(cases: DataFrame) -> DataFrame:
    """(case_id, unit_id): C%04d in the order of the ids."""
    return numbered(cases.select("case_id").distinct(), None, "case_id", "n").select("case_id", F.format_string("C%04d", F.col("n") - 1).alias("unit_id"))


def backbone_units(partition: DataFrame, leaves: DataFrame) -> DataFrame:
    """(case_id, leaf_id, root_id) of a partition (node, topic): the root of a case is its topic, or its own leaf where it is alone."""
    sizes = partition.groupBy("topic").agg(F.count(F.lit(1)).alias("size"))
    named = numbered(sizes, None, "topic", "n").select("topic", "size", F.format_string("B%04d", F.col("n") - 1).alias("name"))
    full = partition.select(F.col("node").alias("case_id"), "topic").join(named, "topic").join(leaves.withColumnRenamed("unit_id", "leaf_id"), "case_id")
    return full.select("case_id", "leaf_id", F.when(F.col("size") > 1, F.col("name")).otherwise(F.col("leaf_id")).alias("root_id"))


def residual_rule(kind: Column, similarity: Column, config: AssociationConfig = AssociationConfig()) -> Column:
    """A residual is admitted if its type is allowed and the role similarity reaches the least."""
    return kind.isin(*config.residual_types) & (similarity >= config.residual_least)


def fused(backbone: Column, kind: Column, similarity: Column, config: AssociationConfig = AssociationConfig()) -> Column:
    """The backbone's own pairs stay; a typed residual may add others."""
    return backbone | residual_rule(kind, similarity, config)


def witnesses(pairs: DataFrame, roots: DataFrame, config: AssociationConfig = AssociationConfig()) -> DataFrame:
    """(left_root, right_root, a, b, risk, role_similarity, accepted) of every pair of roots: its strongest pair of cases.

    pairs: a, b, risk, role_similarity; the strongest is accepted before not, then by role similarity, then by the larger ids.
    """
    side = lambda s: roots.select(F.col("case_id").alias(s), F.col("root_id").alias(f"root_{s}"))
    apart = pairs.join(side("a"), "a").join(side("b"), "b").filter("root_a <> root_b").withColumn("accepted", residual_rule(F.col("risk"), F.col("role_similarity"), config))
    record = F.struct("a", "b", "risk", "role_similarity", "accepted")
    best = apart.groupBy(F.least("root_a", "root_b").alias("left_root"), F.greatest("root_a", "root_b").alias("right_root")).agg(F.max_by(record, F.struct("accepted", "role_similarity", "a", "b")).alias("w"))
    return best.select("left_root", "right_root", "w.*")


def residual_layer(found: DataFrame) -> DataFrame:
    """(left_root, right_root, topic_id): the maximum-weight matching of accepted witnesses, R%04d in the order of the pairs."""
    pairs = matching.maximum_weight_matching(found.filter("accepted"), "left_root", "right_root", "role_similarity").select(F.col("a").alias("left_root"), F.col("b").alias("right_root"))
    keyed = numbered(pairs.withColumn("pair", F.concat_ws("\x01", "left_root", "right_root")), None, "pair", "n")
    return keyed.select("left_root", "right_root", F.format_string("R%04d", F.col("n") - 1).alias("topic_id"))


def hierarchy(roots: DataFrame, matched: DataFrame) -> dict[str, DataFrame]:
    """units (unit_id, unit_type, level, parent_id), members (unit_id, case_id) and roots (unit_id) of backbone roots and matched pairs."""
    pair = matched.select("topic_id", F.explode(F.array("left_root", "right_root")).alias("root_id"))
    full = materialize(roots.join(pair, "root_id", "left"), "hierarchy")
    topic = F.col("root_id") != F.col("leaf_id")
    leaf = full.select(F.col("leaf_id").alias("unit_id"), F.lit("case").alias("unit_type"), F.lit(0).alias("level"), F.when(topic, F.col("root_id")).otherwise(F.col("topic_id")).alias("parent_id"))
    middle = full.filter(topic).select(F.col("root_id").alias("unit_id"), F.lit("topic").alias("unit_type"), F.lit(1).alias("level"), F.col("topic_id").alias("parent_id")).distinct()
    level = full.filter("topic_id IS NOT NULL").groupBy("topic_id").agg((F.max(topic.cast("int")) + 1).alias("level"))
    upper = level.select(F.col("topic_id").alias("unit_id"), F.lit("topic").alias("unit_type"), "level", F.lit(None).cast("string").alias("parent_id"))
    members = full.select(F.col("leaf_id").alias("unit_id"), "case_id").unionByName(full.filter(topic).select(F.col("root_id").alias("unit_id"), "case_id")).unionByName(full.filter("topic_id IS NOT NULL").select(F.col("topic_id").alias("unit_id"), "case_id"))
    units = leaf.unionByName(middle).unionByName(upper)
    return {"units": units, "members": members, "roots": units.filter("parent_id IS NULL").select("unit_id")}


def shared_patterns(members: DataFrame, inst: DataFrame) -> DataFrame:
    """(unit_id, pattern_id, support): patterns of a unit's cases with the number of those cases; shared ones have a support of 2 or more."""
    own = inst.select("case_id", "pattern_id").distinct()
    return members.join(own, "case_id").groupBy("unit_id", "pattern_id").agg(F.countDistinct("case_id").alias("support"))


# --- catalog, unified graph, lineage ------------------------------------------------------------------------


def catalog(inst: DataFrame, nodes: DataFrame, edges: DataFrame) -> dict[str, DataFrame]:
    """patterns (pattern_id, signature, support) and instances with the source events, relations, documents and spans of their nodes and edges.

    nodes: uid, source_event_ids, source_document_ids, source_spans; edges: uid, source_relation_ids. Documents and spans pair up by position.
    """
    keyed = inst.withColumn("instance_id", F.sha1(F.concat_ws("\x01", "pattern_id", "case_id", F.array_join("node_uids", "\x02"), F.array_join("edge_uids", "\x02")))).dropDuplicates(["instance_id"])
    n = nodes.select(F.col("uid").alias("node"), "source_event_ids", "source_document_ids", "source_spans")
    e = edges.select(F.col("uid").alias("edge"), "source_relation_ids")
    span = F.transform(F.arrays_zip("source_document_ids", "source_spans"), lambda x: F.struct(x["source_document_ids"].alias("document_id"), x["source_spans"]["span_start"].alias("span_start"), x["source_spans"]["span_end"].alias("span_end")))
    whole = lambda c: F.array_sort(F.array_distinct(F.filter(F.flatten(F.collect_list(c)), lambda x: x.isNotNull())))
    at_nodes = keyed.select("instance_id", F.explode("node_uids").alias("node")).join(n, "node").groupBy("instance_id").agg(whole("source_event_ids").alias("source_event_ids"), whole("source_document_ids").alias("source_document_ids"), whole(span).alias("source_spans"))
    at_edges = keyed.select("instance_id", F.explode("edge_uids").alias("edge")).join(e, "edge").groupBy("instance_id").agg(whole("source_relation_ids").alias("source_relation_ids"))
    instances = keyed.select("instance_id", "pattern_id", "case_id", "node_uids", "edge_uids").join(at_nodes, "instance_id", "left").join(at_edges, "instance_id", "left")
    return {"patterns": inst.groupBy("pattern_id", "signature").agg(F.countDistinct("case_id").alias("support")), "instances": instances}


def unified_edges(nodes: DataFrame, edges: DataFrame, mapped: DataFrame, inst: DataFrame, tree: dict[str, DataFrame]) -> DataFrame:
    """(namespace, edge_type, source_id, target_id): the factual, reference and hierarchical edges of the unified graph."""
    row = lambda df, space, kind, a, b: df.select(F.lit(space).alias("namespace"), (F.lit(kind) if isinstance(kind, str) else kind).alias("edge_type"), F.col(a).alias("source_id"), F.col(b).alias("target_id"))
    topics = tree["units"].filter("unit_type = 'topic'").select("unit_id")
    covered = tree["members"].join(topics, "unit_id")
    leaf = tree["members"].join(tree["units"].filter("unit_type = 'case'").select("unit_id"), "unit_id")
    child = tree["units"].filter("parent_id IS NOT NULL").select("unit_id", "unit_type", "parent_id")
    own = inst.select("case_id", "pattern_id").distinct()
    concepts = inst.select("pattern_id", F.explode("concepts").alias("concept_id")).distinct()
    return reduce(
        DataFrame.unionByName,
        [
            row(edges.select("head_uid", "tail_uid", "relation_type", "uid").distinct(), "factual", F.col("relation_type"), "head_uid", "tail_uid"),
            row(mapped.select("uid", "concept_id").distinct(), "reference", "EVENT_TO_CANONICAL_CONCEPT", "uid", "concept_id"),
            row(concepts, "reference", "PATTERN_TO_CONCEPT", "pattern_id", "concept_id"),
            row(own, "reference", "PATTERN_TO_SUPPORTING_CASE", "pattern_id", "case_id"),
            row(covered.join(mapped.select("case_id", "concept_id").distinct(), "case_id").select("unit_id", "concept_id").distinct(), "reference", "TOPIC_TO_CONCEPT", "unit_id", "concept_id"),
            row(covered.join(own, "case_id").select("unit_id", "pattern_id").distinct(), "reference", "TOPIC_TO_PATTERN", "unit_id", "pattern_id"),
            row(covered, "reference", "TOPIC_TO_COVERED_CASE", "unit_id", "case_id"),
            row(child.filter("unit_type = 'case'").join(leaf, "unit_id"), "hierarchical", "TOPIC_TO_CHILD_CASE", "parent_id", "case_id"),
            row(child.filter("unit_type = 'topic'"), "hierarchical", "TOPIC_TO_CHILD_TOPIC", "parent_id", "unit_id"),
        ],
    )


def lineage(instances: DataFrame, members: DataFrame) -> DataFrame:
    """(unit_id, pattern_id) with its cases and the source events, relations and documents of its instances in the unit's cases, as sorted sets."""
    own = members.join(instances, "case_id")
    whole = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c)
    return own.groupBy("unit_id", "pattern_id").agg(F.array_sort(F.collect_set("case_id")).alias("case_ids"), *[whole(c) for c in ("source_event_ids", "source_relation_ids", "source_document_ids", "source_spans")])


def trace(topic: str, pattern: str, tree: dict[str, DataFrame], found: dict[str, DataFrame]) -> dict:
    """The lineage of one topic and pattern; KeyError for an unknown one, ValueError if they do not belong together."""
    if not tree["units"].filter((F.col("unit_id") == topic) & (F.col("unit_type") == "topic")).limit(1).count():
        raise KeyError(f"no topic {topic}")
    if not found["patterns"].filter(F.col("pattern_id") == pattern).limit(1).count():
        raise KeyError(f"no pattern {pattern}")
    rows = lineage(found["instances"].filter(F.col("pattern_id") == pattern), tree["members"].filter(F.col("unit_id") == topic)).collect()
    if not rows:
        raise ValueError(f"topic {topic} has no case with pattern {pattern}")
    return rows[0].asDict(recursive=True)


def root_cause_pairs(pairs: DataFrame, inst: DataFrame, feats: DataFrame, idf: DataFrame, vectors: DataFrame, roles: DataFrame) -> DataFrame:
    """pairs (a, b) with semantic, evidence, closure, shared concepts, risk and role_similarity."""
    pairs = materialize(pairs.select("a", "b").distinct(), "risk-pairs")
    scored = score_units(pairs, vectors.withColumnRenamed("case_id", "unit_id"), feats.withColumnRenamed("case_id", "unit_id"), idf)
    common = patterns.overlaps(pairs, patterns.packed(feats.filter("feature LIKE 'role_concept:%'"), "case_id", "feature"), "a", "b").select("a", "b", F.col("__shared").alias("shared"))
    full = scored.join(patterns.closure(pairs, inst), ["a", "b"], "left").join(common, ["a", "b"], "left").fillna({"unsupported": 0, "highest": 0, "shared": 0})
    full = full.withColumn("risk", patterns.risk(F.col("unsupported"), F.col("highest"), F.col("shared"), F.col("semantic"), F.col("evidence")))
    return sparse_similarity(full, roles, "case_id", "a", "b", "role_similarity")


def backbone_roots(nodes: DataFrame, edges: DataFrame, config: AssociationConfig = AssociationConfig()) -> DataFrame:
    """(case_id, leaf_id, root_id) of the cases of `nodes`, by the backbone of association edges (a, b)."""
    cases = nodes.filter("case_id IS NOT NULL").select("case_id").distinct()
    partition = case_merge.structural_backbone(materialize(edges.select("a", "b"), "backbone-edges"), "a", "b", config.max_cluster, cases.withColumnRenamed("case_id", "node"))
    return materialize(backbone_units(materialize(partition, "partition"), leaf_units(cases)), "roots")


def build_witnesses(nodes: DataFrame, inst: DataFrame, feats: DataFrame, idf: DataFrame, vectors: DataFrame, config: AssociationConfig = AssociationConfig()) -> dict[str, DataFrame]:
    """The hierarchy before its matching: near pairs, backbone roots and witnesses."""
    near = materialize(case_merge.near_cases(vectors, config.top_k), "near-cases").select("a", "b")
    scored = materialize(root_cause_pairs(near, inst, feats, idf, vectors, role_vectors(nodes, config.residual_role)), "case-pairs")
    roots = backbone_roots(nodes, scored.filter(F.col("association") >= config.threshold), config)
    return {"pairs": scored, "backbone": roots, "witnesses": materialize(witnesses(scored, roots, config), "witnesses")}


def build(nodes: DataFrame, inst: DataFrame, feats: DataFrame, idf: DataFrame, vectors: DataFrame, config: AssociationConfig = AssociationConfig()) -> dict[str, DataFrame]:
    """The whole hierarchy of the cases of `nodes` (uid, case_id, role, text): near pairs, backbone roots, witnesses, matched pairs, units, members and roots."""
    found = build_witnesses(nodes, inst, feats, idf, vectors, config)
    matched = materialize(residual_layer(found["witnesses"]), "matched")
    return found | {"matched": matched} | hierarchy(found["backbone"], matched)
