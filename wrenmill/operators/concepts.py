"""Canonical concepts: equal normalized mentions, then near ones by character TF-IDF where their numbers allow.

Mentions fold to distinct (role, value) first, so a value that fills a third of all rows is one row of the search.
The similarity join is exact: only the rarest terms of a value, whose rest is too light to reach
the threshold, propose pairs. Nodes with a null text or role are left out.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wrenmill.functions import text as t
from wrenmill.operators.components import components
from wrenmill.runtime import materialize

THRESHOLD = 0.92
TOP_K = 10
CONTEXT_THRESHOLD = 0.72
CONTEXT_TOP_K = 50
ROLES = ("PHENOMENON", "FAILURE", "ROOT_CAUSE", "ACTION", "VERIFICATION")


def clean_nodes(nodes: DataFrame) -> DataFrame:
    """One row per uid."""
    return nodes.filter("uid IS NOT NULL").groupBy("uid").agg(F.min(F.struct("case_id", "role", "text", "document_id")).alias("n")).select("uid", "n.*")


def values(nodes: DataFrame) -> DataFrame:
    """(role, value, n, text): distinct normalized mentions with their number of nodes."""
    v = t.concept_text(F.col("text"))
    rows = nodes.filter("role IS NOT NULL AND text IS NOT NULL").select("role", F.when(F.length(v) > 0, v).otherwise(F.lower("text")).alias("value"), "text")
    return rows.groupBy("role", "value").agg(F.count(F.lit(1)).alias("n"), F.min("text").alias("text"))


def tfidf(vals: DataFrame, low: int = 2, high: int = 4) -> DataFrame:
    """(role, value, term, w): sublinear tf, smooth idf over nodes, unit length."""
    safe = None
    for n in range(low, high + 1):
        some = vals.filter(F.length("value") >= n).select("role", "value", "n", F.explode(F.transform(F.sequence(F.lit(1), F.length("value") - (n - 1)), _piece(n))).alias("term"))
        safe = some if safe is None else safe.unionByName(some)
    tf = safe.groupBy("role", "value", "n", "term").agg(F.count(F.lit(1)).alias("tf"))
    df = tf.groupBy("role", "term").agg(F.sum("n").alias("df"))
    docs = vals.groupBy("role").agg(F.sum("n").alias("docs"))
    w = (1 + F.log("tf")) * (F.log((1 + F.col("docs")) / (1 + F.col("df"))) + 1)
    raw = tf.join(df, ["role", "term"]).join(F.broadcast(docs), "role").select("role", "value", "term", w.alias("w"))
    norm = raw.groupBy("role", "value").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return raw.join(norm, ["role", "value"]).select("role", "value", "term", (F.col("w") / F.col("norm")).alias("w"))


def _piece(m: int):
    return lambda i: F.substring(F.col("value"), i, F.lit(m))


def near_values(vals: DataFrame, threshold: float = THRESHOLD, k: int = TOP_K) -> DataFrame:
    """(role, a, b, similarity, number_safe), a < b: pairs at or above the threshold that are among the k nearest of either."""
    terms = materialize(tfidf(vals), "concept-terms")
    df = terms.groupBy("role", "term").agg(F.count(F.lit(1)).alias("df"))
    rare = Window.partitionBy("role", "value").orderBy(F.desc("df"), "term").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # the terms kept are those without which the rest, the commonest terms, stays under the threshold
    kept = terms.join(df, ["role", "term"]).withColumn("rest", F.sum(F.col("w") * F.col("w")).over(rare)).filter(F.sqrt("rest") >= threshold - 1e-9).select("role", F.col("value").alias("a"), "term")
    found = kept.join(terms.select("role", F.col("value").alias("b"), "term"), ["role", "term"]).filter("a <> b").select("role", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    left = found.join(terms.select("role", F.col("value").alias("a"), "term", F.col("w").alias("wa")), ["role", "a"])
    dots = left.join(terms.select("role", F.col("value").alias("b"), "term", F.col("w").alias("wb")), ["role", "b", "term"]).groupBy("role", "a", "b").agg(F.sum(F.col("wa") * F.col("wb")).alias("similarity"))
    close = dots.filter(F.col("similarity") >= threshold)
    both = close.unionByName(close.select("role", F.col("b").alias("a"), F.col("a").alias("b"), "similarity"))
    w = Window.partitionBy("role", "a").orderBy(F.desc(F.round("similarity", 9)), "b")
    top = both.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
    pairs = top.groupBy("role", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.max("similarity").alias("similarity"))
    text = lambda s: vals.select("role", F.col("value").alias(s), F.col("text").alias(f"t{s}"))
    return pairs.join(text("a"), ["role", "a"]).join(text("b"), ["role", "b"]).select("role", "a", "b", "similarity", t.number_safe(F.col("ta"), F.col("tb")).alias("number_safe"))


def _near_nodes(k: int, least: float, batch: int = 64) -> Callable:
    """For every node of the groups asked, the k nearest nodes of its role in a block of groups with one vector each, if at `least` or above."""

    def units(rows: pd.Series) -> np.ndarray:
        x = np.array(rows.tolist(), np.float64)
        return x / np.maximum(np.sqrt((x * x).sum(1)), 1e-12)[:, None]

    def run(docs: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        names = ["p", "q", "s"]
        if not len(docs) or not len(asked):
            return pd.DataFrame([], columns=names)
        x = units(docs["v"])
        group, role, uid = np.repeat(np.arange(len(docs)), docs["roles"].map(len).to_numpy()), np.concatenate(docs["roles"].to_list()), np.concatenate(docs["uids"].to_list())
        place = np.argsort(np.argsort(uid, kind="stable"))
        nodes, start, count = {}, {}, {}
        for r in range(len(ROLES)):
            nodes[r] = np.flatnonzero(role == r)
            count[r] = np.bincount(group[nodes[r]], minlength=len(docs))
            start[r] = np.cumsum(count[r]) - count[r]
        out = []
        for c in range(0, len(asked), batch):
            some = asked.iloc[c : c + batch]
            scores = units(some["q_v"]) @ x.T
            for s, roles, uids in zip(scores, some["q_roles"], some["q_uids"]):
                hit = np.flatnonzero(s >= least - 1e-9)
                for r in set(roles.tolist()) if len(hit) else ():
                    n = count[r][hit]
                    at = nodes[r][np.repeat(start[r][hit] - np.cumsum(n) + n, n) + np.arange(n.sum())]
                    near = s[group[at]]
                    at = at[np.lexsort((place[at], -np.round(near, 9)))[: k + 1]]
                    for p in uids[roles == r]:
                        best = at[uid[at] != p][:k]
                        out.append((np.full(len(best), p, object), uid[best], s[group[best]]))
        return pd.DataFrame(dict(zip(names, (np.concatenate(v) for v in zip(*out)))) if out else [], columns=names)

    return run


def near_nodes(groups: DataFrame, k: int, least: float, block: int = 100_000) -> DataFrame:
    """(a, b, similarity), a < b: nodes of one role of which one is among the k nearest of the other, at `least` or above; ties by smaller id.

    groups: key, roles (places in ROLES), uids, v: nodes with one vector, which goes once for all of them and all roles. Exact: blocks of about `block` groups
    meet each other; what stays under `least` does not leave its task.
    """
    n = groups.count()
    blocks = max(1, -(-n // block))
    cores = groups.sparkSession.sparkContext.defaultParallelism
    parts = max(blocks, -(-cores // blocks)) if n > 2000 else blocks
    copies = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    number = lambda n: F.pmod(F.xxhash64("key"), F.lit(n)).cast("int")
    names = ("roles", "uids", "v")
    docs = groups.select(number(blocks).alias("block"), copies(parts).alias("part"), *names).repartition(blocks * parts, "block", "part")
    asked = groups.select(copies(blocks).alias("block"), number(parts).alias("part"), *[F.col(c).alias(f"q_{c}") for c in names]).repartition(blocks * parts, "block", "part")
    found = docs.groupBy("block", "part").cogroup(asked.groupBy("block", "part")).applyInPandas(_near_nodes(k, least), "p string, q string, s double")
    if blocks > 1:
        w = Window.partitionBy("p").orderBy(F.desc(F.round("s", 9)), "q")
        found = found.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= k)
    return found.groupBy(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b")).agg(F.max("s").alias("similarity"))


def near_contexts(nodes: DataFrame, vectors: DataFrame, threshold: float = CONTEXT_THRESHOLD, k: int = CONTEXT_TOP_K, shared: DataFrame | None = None) -> DataFrame:
    """(role, a, b, similarity, number_safe, anchored, same_document, accepted), a < b: nodes of one role whose context vectors are near.

    nodes: uid, role, text, documents (an array); vectors: uid, v; or uid, key, with shared: key, v, where nodes have vectors in common. A pair is among the k nearest of
    either node and at the threshold or above. It is accepted if its numbers allow, one text holds the other or they share 0.7 of their pairs of characters, and they lie
    in different documents or are equal. All nodes of a role are compared, in blocks; vectors need not have length 1.
    """
    v = t.concept_text(F.col("text"))
    known = nodes.filter("role IS NOT NULL AND text IS NOT NULL").withColumn("value", F.when(F.length(v) > 0, v).otherwise(F.lower("text"))).select("uid", "role", "text", "value", "documents")
    known = materialize(known, "context-nodes")
    if shared is None:
        vectors, shared = vectors.select("uid", F.col("uid").alias("key")), vectors.select(F.col("uid").alias("key"), "v")
    place = F.array_position(F.array(*[F.lit(r) for r in ROLES]), F.col("role")).cast("int") - 1
    mine = known.filter(F.col("role").isin(*ROLES)).select("uid", place.alias("role")).join(vectors.select("uid", "key"), "uid").groupBy("key").agg(F.collect_list(F.struct("role", "uid")).alias("l"))
    groups = materialize(mine.join(shared.select("key", "v"), "key").select("key", F.col("l")["role"].alias("roles"), F.col("l")["uid"].alias("uids"), "v"), "context-groups")
    near = near_nodes(groups, k, threshold)
    side = lambda s, *more: known.select(F.col("uid").alias(s), *more, *[F.col(c).alias(f"{c}_{s}") for c in ("text", "value", "documents")])
    full = near.filter(F.col("similarity") >= threshold).join(side("a", "role"), "a").join(side("b"), "b")
    a, b = F.col("value_a"), F.col("value_b")
    full = full.withColumns(
        {
            "number_safe": t.number_safe(F.col("text_a"), F.col("text_b")), "anchored": a.contains(b) | b.contains(a) | (t.gram_containment(a, b) >= 0.70),
            "same_document": F.coalesce(F.arrays_overlap("documents_a", "documents_b"), F.lit(False)),
        }
    )
    accepted = F.col("number_safe") & F.col("anchored") & (~F.col("same_document") | (a == b))
    return full.select("role", "a", "b", "similarity", "number_safe", "anchored", "same_document", accepted.alias("accepted"))


def canonicalize(nodes: DataFrame, threshold: float = THRESHOLD, k: int = TOP_K, contexts: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(uid, concept_id) of every node, and the concepts; the label is the commonest value, then the longest, then the first.

    contexts: near_contexts(), whose accepted pairs join the concepts of their values.
    """
    vals = materialize(values(nodes), "concept-values")
    near = near_values(vals, threshold, k).filter("number_safe")
    key = lambda c: F.concat_ws("\x01", "role", c)
    links = near.select(key("a").alias("a"), key("b").alias("b"))
    if contexts is not None:
        c = t.concept_text(F.col("text"))
        own = nodes.filter("role IS NOT NULL AND text IS NOT NULL").select("uid", "role", F.when(F.length(c) > 0, c).otherwise(F.lower("text")).alias("value"))
        side = lambda s: own.select(F.col("uid").alias(s), key("value").alias(f"k{s}"))
        links = links.unionByName(contexts.filter("accepted").select("a", "b").join(side("a"), "a").join(side("b"), "b").select(F.col("ka").alias("a"), F.col("kb").alias("b")))
    groups = components(links, "a", "b")
    placed = vals.withColumn("node", key("value")).join(groups, "node", "left").withColumn("g", F.coalesce("component", "node"))
    w = Window.partitionBy("role", "g").orderBy(F.desc("n"), F.desc(F.length("value")), "value")
    labels = placed.withColumn("rank", F.row_number().over(w)).filter("rank = 1").select("role", "g", F.col("value").alias("label"))
    named = materialize(placed.join(labels, ["role", "g"]).select("role", "value", "label", t.concept_id(F.col("role"), F.col("label")).alias("concept_id")), "concept-map")
    v = t.concept_text(F.col("text"))
    mapped = nodes.filter("role IS NOT NULL AND text IS NOT NULL").withColumn("value", F.when(F.length(v) > 0, v).otherwise(F.lower("text"))).join(named, ["role", "value"])
    concepts = mapped.groupBy("concept_id", "role", "label").agg(F.count(F.lit(1)).alias("member_count"), F.countDistinct("case_id").alias("case_count"), F.countDistinct("value").alias("variant_count"))
    return mapped.select("uid", "case_id", "role", "concept_id"), concepts
