"""Consolidating pairwise matches into groups by deterministic Borůvka hooking.

Every component selects its smallest outgoing edge under one total order of edges, (smaller label,
larger label), so the selected edges form trees whose only cycle is the mutual choice at the root.
The trees collapse by pointer doubling, edges are relabelled to the roots and deduplicated, and
rounds repeat until no edge is left: every component with an edge at least doubles, so the rounds
are at most log2 of the nodes. The maps of the rounds are composed from the last to the first,
and shrink geometrically, so all work is linear in nodes and edges up to the pointer doubling.

Nothing is collected but row counts and bounded lists of hot labels. A hub that holds a third of all
edges is served by skew_lookup(). Self-pairs and pairs with a null give no edge; repeated pairs count once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wrenmill.runtime import materialize, release, skew_lookup


def _select_smallest(edges: DataFrame) -> DataFrame:
    """(node, parent): for each label its smallest outgoing edge's other end; edges have u < v."""
    both = edges.select(
        F.inline(
            F.array(
                F.struct(F.col("u").alias("node"), F.col("u").alias("lo"), F.col("v").alias("hi")),
                F.struct(F.col("v").alias("node"), F.col("u").alias("lo"), F.col("v").alias("hi")),
            )
        )
    )
    best = both.groupBy("node").agg(F.min(F.struct("lo", "hi")).alias("e"))
    return best.select("node", F.when(F.col("node") == F.col("e.lo"), F.col("e.hi")).otherwise(F.col("e.lo")).alias("parent"))


def _collapse(choice: DataFrame) -> DataFrame:
    """(node, root) of each tree, by pointer doubling over the nodes that aren't yet at a root."""
    # the mutual choice: the smaller of the two becomes the root
    grand = skew_lookup(choice, choice.select(F.col("node").alias("parent"), F.col("parent").alias("grand")), "parent")
    is_root = (F.col("grand") == F.col("node")) & (F.col("node") < F.col("parent"))
    current = materialize(grand.select("node", F.when(is_root, F.col("node")).otherwise(F.col("parent")).alias("parent")), "p4-forest")
    while True:
        jump = current.select(F.col("node").alias("parent"), F.col("parent").alias("grand"))
        doubled = materialize(skew_lookup(current, jump, "parent").select("node", F.col("grand").alias("parent"), (F.col("grand") != F.col("parent")).alias("moved")), "p4-forest")
        moved = doubled.filter("moved").limit(1).count()
        release(current)
        current = doubled.drop("moved")
        if not moved:
            return current.withColumnRenamed("parent", "root")


def _relabel(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """Edges between the roots of their ends, without loops and repeats."""
    a = skew_lookup(edges, roots.select(F.col("node").alias("u"), F.col("root").alias("ru")), "u")
    b = skew_lookup(a, roots.select(F.col("node").alias("v"), F.col("root").alias("rv")), "v")
    return b.filter("ru <> rv").select(F.least("ru", "rv").alias("u"), F.greatest("ru", "rv").alias("v")).distinct()


def groups(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """(node, group_id) of every value that has a pair to a different one; group_id is the least node of the group."""
    edges = (
        pairs.filter(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
        .select(F.least(a, b).alias("u"), F.greatest(a, b).alias("v"))
        .distinct()
    )
    edges = materialize(edges, "p4-edges")
    levels: list[DataFrame] = []
    while edges.limit(1).count():
        roots = _collapse(_select_smallest(edges))
        left = materialize(_relabel(edges, roots), "p4-edges")
        release(edges)
        edges = left
        levels.append(roots)
    if not levels:
        return edges.select(F.col("u").alias("node"), F.col("u").alias("group_id"))
    whole = levels[-1]
    for level in reversed(levels[:-1]):
        up = whole.select(F.col("node").alias("root"), F.col("root").alias("top"))
        composed = skew_lookup(level, up, "root").select("node", F.coalesce("top", "root").alias("root"))
        whole = materialize(composed, "p4-map")
    least = whole.groupBy("root").agg(F.min("node").alias("group_id"))
    return skew_lookup(whole, least, "root").select("node", "group_id")


# The states that join two relations.
EQUIVALENT = ("equivalent", "equivalent_relation")


def relation_groups(decisions: DataFrame) -> DataFrame:
    """(relation_id, group_id) over equivalent decisions; ids take the '_' spelling, the first ':' standing for '_'."""
    spelled = lambda c: F.regexp_replace(c, "^([^:]*):", "$1_")
    pairs = decisions.filter(F.col("predicted_state").isin(*EQUIVALENT)).select(
        spelled(F.col("relation_a_id")).alias("a"), spelled(F.col("relation_b_id")).alias("b")
    )
    return groups(pairs, "a", "b").withColumnRenamed("node", "relation_id")
