"""Diagnostic patterns, evidence features and their comparison, closure and risk of case pairs.

Paths are at most four equi-joins of role-typed arcs; allowed paths have distinct roles, so they are simple by themselves.
Edges whose ends are null or lead to no node of the same case give no arc.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from wrenmill.functions import text as t
from wrenmill.operators import resolution
from wrenmill.operators.concepts import ROLES  # noqa: F401
from wrenmill.runtime import materialize

# The allowed role paths, and the relations whose diagnostic direction is reversed.
PATHS = (
    ("PHENOMENON", "FAILURE"),
    ("PHENOMENON", "ROOT_CAUSE"),
    ("FAILURE", "ROOT_CAUSE"),
    ("ROOT_CAUSE", "ACTION"),
    ("ACTION", "VERIFICATION"),
    ("PHENOMENON", "ROOT_CAUSE", "ACTION"),
    ("FAILURE", "ROOT_CAUSE", "ACTION"),
    ("ROOT_CAUSE", "ACTION", "VERIFICATION"),
    ("PHENOMENON", "ROOT_CAUSE", "ACTION", "VERIFICATION"),
    ("PHENOMENON", "FAILURE", "ROOT_CAUSE", "ACTION"),
    ("FAILURE", "ROOT_CAUSE", "ACTION", "VERIFICATION"),
    ("PHENOMENON", "FAILURE", "ROOT_CAUSE", "ACTION", "VERIFICATION"),
)
REVERSED = ("CAUSE", "TREAT", "VERIFY")


def arcs(edges: DataFrame, mapped: DataFrame) -> DataFrame:
    """(case_id, edge, source, target, relation, roles and concepts of both): edges in diagnostic direction."""
    e = edges.filter("uid IS NOT NULL AND head_uid IS NOT NULL AND tail_uid IS NOT NULL AND relation_type IS NOT NULL").groupBy("uid").agg(F.min(F.struct("case_id", "head_uid", "tail_uid", "relation_type")).alias("e")).select("uid", "e.*")
    turn = F.col("relation_type").isin(*REVERSED)
    e = e.select("case_id", F.col("uid").alias("edge"), F.when(turn, F.col("tail_uid")).otherwise(F.col("head_uid")).alias("source"), F.when(turn, F.col("head_uid")).otherwise(F.col("tail_uid")).alias("target"), F.col("relation_type").alias("relation"))
    side = lambda s: mapped.select("case_id", F.col("uid").alias(s), F.col("role").alias(f"{s}_role"), F.col("concept_id").alias(f"{s}_concept"))
    return e.join(side("source"), ["case_id", "source"]).join(side("target"), ["case_id", "target"])


def instances(arc: DataFrame, max_edges: int = 4) -> DataFrame:
    """(case_id, signature, pattern_id, roles, concepts, relations, node_uids, edge_uids) of every allowed path."""
    step = arc.select("case_id", "source", "target", "edge", "relation", "source_role", "target_role", "source_concept", "target_concept")
    allowed = set(PATHS)
    prefixes = {p[:n] for p in allowed for n in range(2, len(p) + 1)}
    one = step.select(
        "case_id", F.col("target").alias("last"), F.array("source_role", "target_role").alias("roles"), F.array("source_concept", "target_concept").alias("concepts"),
        F.array("relation").alias("relations"), F.array("source", "target").alias("node_uids"), F.array("edge").alias("edge_uids"),
    )
    ok = lambda n, paths: F.array_join("roles", ">").isin(*[">".join(p) for p in sorted(paths) if len(p) == n])
    level = one.filter(ok(2, prefixes))
    out = level.filter(ok(2, allowed))
    for n in range(3, max_edges + 2):
        nxt = step.select("case_id", F.col("source").alias("last"), "target", "edge", "relation", "target_role", "target_concept")
        level = level.join(nxt, ["case_id", "last"]).select(
            "case_id", F.col("target").alias("last"), F.concat("roles", F.array("target_role")).alias("roles"), F.concat("concepts", F.array("target_concept")).alias("concepts"),
            F.concat("relations", F.array("relation")).alias("relations"), F.concat("node_uids", F.array("target")).alias("node_uids"), F.concat("edge_uids", F.array("edge")).alias("edge_uids"),
        )
        level = level.filter(ok(n, prefixes))
        out = out.unionByName(level.filter(ok(n, allowed)))
    signature = t.pattern_signature(F.col("roles"), F.col("concepts"), F.col("relations"))
    return out.withColumn("signature", signature).withColumn("pattern_id", t.pattern_id(F.col("signature"))).drop("last")


def features(mapped: DataFrame, arc: DataFrame, inst: DataFrame, families: tuple[str, ...] = ("role_concept", "arc", "pattern")) -> DataFrame:
    """Distinct (case_id, feature) of the chosen families."""
    parts = {
        "role_concept": lambda: mapped.select("case_id", F.concat(F.lit("role_concept:"), "role", F.lit(":"), "concept_id").alias("feature")),
        "arc": lambda: arc.select("case_id", F.concat(F.lit("arc:"), "source_role", F.lit(":"), "source_concept", F.lit(">"), "relation", F.lit(">"), "target_role", F.lit(":"), "target_concept").alias("feature")),
        "pattern": lambda: inst.select("case_id", F.concat(F.lit("pattern:"), "signature").alias("feature")),
    }
    unknown = set(families) - set(parts)
    if unknown:
        raise ValueError(f"unknown families: {sorted(unknown)}")
    return reduce(DataFrame.unionByName, [parts[f]() for f in families]).distinct()


def feature_idf(feats: DataFrame, n_cases: int) -> DataFrame:
    return feats.groupBy("feature").agg(F.count(F.lit(1)).alias("df")).select("feature", "df", (F.log((F.lit(n_cases) + 1) / (F.col("df") + 1)) + 1).alias("idf"))


def weighted_jaccard(queries: DataFrame, feats: DataFrame, idf: DataFrame) -> DataFrame:
    """(query_case, case_id, evidence) of query cases and all that share a feature; only the intersection needs a join."""
    weighted = feats.join(idf.select("feature", "idf"), "feature")
    total = weighted.groupBy("case_id").agg(F.sum("idf").alias("total"))
    left = weighted.join(queries, "case_id", "left_semi").select(F.col("case_id").alias("query_case"), "feature", "idf")
    inter = left.join(feats, "feature").filter("query_case <> case_id").groupBy("query_case", "case_id").agg(F.sum("idf").alias("shared"))
    full = inter.join(total, "case_id").join(total.select(F.col("case_id").alias("query_case"), F.col("total").alias("own")), "query_case")
    return full.select("query_case", "case_id", (F.col("shared") / (F.col("total") + F.col("own") - F.col("shared"))).alias("evidence"))


#: Bits of a hash by which lists are sorted; the rows of a part of a batch have the others.
BITS = 49


def packed(rows: DataFrame, key: str, item: str, weight: str | None = None) -> DataFrame:
    """(key, f, w): the distinct items of each key as 64-bit hashes in one row, sorted by their low BITS, with their weights (1 where none is named)."""
    one = F.struct(F.xxhash64(item).bitwiseAND(F.lit((1 << BITS) - 1)).alias("k"), F.xxhash64(item).alias("f"), (F.col(weight) if weight else F.lit(1.0)).alias("w"))
    lists = rows.groupBy(F.col(key).alias("key")).agg(F.array_sort(F.collect_list(one)).alias("l"))
    return lists.select("key", F.col("l")["f"].alias("f"), F.col("l")["w"].alias("w"))


def _overlaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    most = 1 << (62 - BITS)
    for batch in (whole.slice(at, most) for whole in batches for at in range(0, whole.num_rows, most)):
        n = batch.num_rows
        keys, f, w = [], [], []
        for s in "ab":
            row = np.repeat(np.arange(n, dtype=np.int64), pc.fill_null(pc.list_value_length(batch[f"__f{s}"]), 0).to_numpy(zero_copy_only=False))
            f.append(pc.list_flatten(batch[f"__f{s}"]).to_numpy(zero_copy_only=False).astype(np.int64))
            w.append(pc.list_flatten(batch[f"__w{s}"]).to_numpy(zero_copy_only=False).astype(np.float64))
            keys.append((row << BITS) | (f[-1] & ((1 << BITS) - 1)))
        keys, f, w = np.concatenate(keys), np.concatenate(f), np.concatenate(w)
        # both halves are sorted, so this is one merge; an item of both sides stands beside itself, that of a first
        order = np.argsort(keys, kind="stable")
        keys, f, w = keys[order], f[order], w[order]
        at = np.flatnonzero((keys[1:] == keys[:-1]) & (f[1:] == f[:-1]))
        sums = [np.bincount(keys[at] >> BITS, weights=x, minlength=n).astype(np.float64) for x in (w[at], w[at] * w[at + 1])]
        kept = [c for c in batch.schema.names if not c.startswith("__")]
        yield pa.RecordBatch.from_arrays([*[batch[c] for c in kept], *[pa.array(x) for x in sums]], [*kept, "__shared", "__dot"])


#: Items beyond which a list is not carried by each pair of its key.
LONG = 2000


def _sized(pairs: DataFrame, sizes: DataFrame, a: str, b: str) -> tuple[DataFrame, DataFrame]:
    """pairs without a long list, and those with one, with its key as __long and the other as __short; sizes: key, n."""
    known = lambda c, s: sizes.filter(F.col("n") > LONG).select(F.col("key").alias(c), F.col("n").alias(f"__n{s}"))
    full = pairs.join(known(a, "a"), a, "left").join(known(b, "b"), b, "left")
    short = full.filter("__na IS NULL AND __nb IS NULL").select(*pairs.columns)
    left = F.coalesce("__na", F.lit(0)) >= F.coalesce("__nb", F.lit(0))
    long = full.filter("__na IS NOT NULL OR __nb IS NOT NULL").select(*pairs.columns, F.when(left, F.col(a)).otherwise(F.col(b)).alias("__long"), F.when(left, F.col(b)).otherwise(F.col(a)).alias("__short"))
    return short, long


def overlaps(pairs: DataFrame, lists: DataFrame, a: str, b: str) -> DataFrame:
    """pairs with __shared, the sum of the weights of the items of both, and __dot, that of the products of both weights; 0 without a common item.

    lists: packed(). A pair carries its two lists, not a row for every item. Where one of them is long, as that of a case near to many others, a row for
    every item of the other looks it up. __shared is for weights that are those of the item.
    """
    lists = materialize(lists, "packed")
    short, long = _sized(pairs, lists.select("key", F.size("f").alias("n")), a, b)
    side = lambda c, s: lists.select(F.col("key").alias(c), F.col("f").alias(f"__f{s}"), F.col("w").alias(f"__w{s}"))
    full = short.join(side(a, "a"), a, "left").join(side(b, "b"), b, "left")
    out = StructType([*[pairs.schema[c] for c in pairs.columns]]).add("__shared", "double").add("__dot", "double")
    near = full.select(*pairs.columns, "__fa", "__wa", "__fb", "__wb").mapInArrow(_overlaps, out)
    items = lists.select("key", F.explode(F.arrays_zip("f", "w")).alias("x")).select("key", F.col("x.f").alias("f"), F.col("x.w").alias("w"))
    asked = long.select("__long", "__short").distinct().join(items.select(F.col("key").alias("__short"), "f", F.col("w").alias("ws")), "__short")
    there = items.join(long.select(F.col("__long").alias("key")).distinct(), "key", "left_semi").withColumnRenamed("key", "__long")
    sums = asked.join(there, ["__long", "f"]).groupBy("__long", "__short").agg(F.sum("ws").alias("__shared"), F.sum(F.col("ws") * F.col("w")).alias("__dot"))
    far = long.join(sums, ["__long", "__short"], "left").select(*pairs.columns, *[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("__shared", "__dot")])
    return near.unionByName(far)


def pair_jaccard(pairs: DataFrame, feats: DataFrame, idf: DataFrame) -> DataFrame:
    """pairs (a, b) with evidence, 0 where they share no feature."""
    weighted = feats.join(idf.select("feature", "idf"), "feature")
    total = weighted.groupBy("case_id").agg(F.sum("idf").alias("total"))
    full = overlaps(pairs, packed(weighted, "case_id", "feature", "idf"), "a", "b").drop("__dot")
    full = full.join(total.select(F.col("case_id").alias("a"), F.col("total").alias("ta")), "a", "left").join(total.select(F.col("case_id").alias("b"), F.col("total").alias("tb")), "b", "left")
    evidence = F.when(F.col("__shared") > 0, F.col("__shared") / (F.col("ta") + F.col("tb") - F.col("__shared"))).otherwise(0.0)
    return full.withColumn("evidence", evidence).drop("__shared", "ta", "tb")


#: The steps of which the allowed paths consist.
STEPS = tuple(p for p in PATHS if len(p) == 2)


def case_steps(inst: DataFrame) -> DataFrame:
    """(case_id, steps, known): a case's 1-edge patterns as (place in STEPS, hashed start, hashed end, hash of the whole), and its longer signatures as (nodes, hash)."""
    node = lambda i: F.xxhash64(F.col("roles")[i], F.col("concepts")[i])
    which = F.array_position(F.array(*[F.lit(">".join(p)) for p in STEPS]), F.array_join("roles", ">")) - 1
    step = F.when(F.size("roles") == 2, F.array(which.cast("bigint"), node(0), node(1), F.xxhash64("signature")))
    longer = F.when(F.size("roles") > 2, F.array(F.size("roles").cast("bigint"), F.xxhash64("signature")))
    return inst.groupBy("case_id").agg(F.collect_set(step).alias("steps"), F.collect_set(longer).alias("known"))


class Chains:
    """Numbers of the paths (3, 4 and 5 nodes) that steps (by hash: place in STEPS, start, end) chain to along PATHS; they are counted, not listed.

    Every longer path goes over one step from root cause to action, so paths are counted by these: x paths of one step and z of two lead to its start, v steps leave its end.
    """

    def __init__(self, steps: dict[int, tuple[int, int, int]]) -> None:
        self.steps = steps
        self.x, self.z, self.v = ({} for _ in range(3))
        self.failures: dict[int, int] = {}
        self.after: dict[int, list[int]] = {}
        self.ahead: dict[int, list[int]] = {}
        self.behind: dict[int, list[int]] = {}
        for kind, p, q in steps.values():
            if kind == 0:
                self.failures[q] = self.failures.get(q, 0) + 1
            elif kind == 4:
                self.v[p] = self.v.get(p, 0) + 1
            else:
                if kind < 3:
                    self.x[q] = self.x.get(q, 0) + 1
                if kind == 2:
                    self.after.setdefault(p, []).append(q)
                if kind == 3:
                    self.ahead.setdefault(p, []).append(q)
                    self.behind.setdefault(q, []).append(p)
        for p, ends in self.after.items():
            if n := self.failures.get(p):
                for q in ends:
                    self.z[q] = self.z.get(q, 0) + n
        self.made = {3: 0, 4: 0, 5: 0}
        for p, ends in self.ahead.items():
            for q in ends:
                x, z, v = self.x.get(p, 0), self.z.get(p, 0), self.v.get(q, 0)
                self.made[3] += x + v
                self.made[4] += x * v + z
                self.made[5] += z * v

    def joined(self, more: dict[int, tuple[int, int, int]]) -> tuple[int, dict[int, int]]:
        """Numbers of steps and of paths with the steps of another case; only what its new steps touch is counted again."""
        new = [s for h, s in more.items() if h not in self.steps]
        if not new:
            return len(self.steps), self.made
        x, z, v, failures = ({} for _ in range(4))
        add = lambda d, k, n: d.__setitem__(k, d.get(k, 0) + n)
        for kind, p, q in new:
            if kind == 0:
                add(failures, q, 1)
            elif kind == 4:
                add(v, p, 1)
            elif kind < 3:
                add(x, q, 1)
        for p, n in failures.items():
            for q in self.after.get(p, ()):
                add(z, q, n)
        for kind, p, q in new:
            if kind == 2 and (n := self.failures.get(p, 0) + failures.get(p, 0)):
                add(z, q, n)
        made = dict(self.made)

        def count(p: int, q: int, old: bool) -> None:
            a, b, c = self.x.get(p, 0), self.z.get(p, 0), self.v.get(q, 0)
            dx, dz, dv = a + x.get(p, 0), b + z.get(p, 0), c + v.get(q, 0)
            made[3] += dx + dv - old * (a + c)
            made[4] += dx * dv + dz - old * (a * c + b)
            made[5] += dz * dv - old * b * c

        starts = x.keys() | z.keys()
        for p in starts:
            for q in self.ahead.get(p, ()):
                count(p, q, True)
        for q in v:
            for p in self.behind.get(q, ()):
                if p not in starts:
                    count(p, q, True)
        for kind, p, q in new:
            if kind == 3:
                count(p, q, False)
        return len(self.steps) + len(new), made


def _steps(*lists) -> dict[int, tuple[int, int, int]]:
    return {int(h): (int(kind), int(p), int(q)) for x in lists if x is not None for kind, p, q, h in x}


def _assessed(steps: int, made: dict[int, int], known: dict[int, int]) -> tuple[int, int, int, int]:
    """(potential, admitted, unsupported, highest) of the numbers of steps, of paths by nodes and of known signatures by nodes."""
    potential, admitted = steps + sum(made.values()), steps + sum(known.values())
    return potential, admitted, potential - admitted, max((n for n in made if made[n] > known.get(n, 0)), default=0)


def _closures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32())
    for batch in batches:
        rows = []
        for sa, ka, sb, kb in zip(*[batch[c].to_pylist() for c in ("sa", "ka", "sb", "kb")]):
            chains = Chains(_steps(sa, sb))
            rows.append(_assessed(len(chains.steps), chains.made, Counter({h: n for n, h in (*(ka or ()), *(kb or ()))}.values())))
        counts = [pa.array(x, t) for x, t in zip(zip(*rows) if rows else [[]] * 4, kinds)]
        yield pa.RecordBatch.from_arrays([batch["a"], batch["b"], *counts], ["a", "b", *CLOSURE])


def _closures_of(case: pd.DataFrame, others: pd.DataFrame) -> pd.DataFrame:
    """Closures of one large case with each of its others."""
    rows = []
    if len(case) and len(others):
        chains, known = Chains(_steps(case["steps"].iloc[0])), {int(h): int(n) for n, h in case["known"].iloc[0]}
        whole = Counter(known.values())
        for a, b, steps, longer in zip(others["a"], others["b"], others["s"], others["k"]):
            n, made = chains.joined(_steps(steps))
            more = {int(h): int(n) for n, h in (longer if longer is not None else ()) if int(h) not in known}
            rows.append((a, b, *_assessed(n, made, whole + Counter(more.values()))))
    return pd.DataFrame(rows, columns=["a", "b", *CLOSURE])


#: What closure() counts of a pair.
CLOSURE = ("potential", "admitted", "unsupported", "highest")


def closure(pairs: DataFrame, inst: DataFrame, cap: int = 20_000) -> DataFrame:
    """(a, b, potential, admitted, unsupported, highest, distortion, truncated): what the transitions of two cases recombine to.

    Potential signatures chain the 1-edge patterns of both cases along allowed paths by shared concept; those
    that neither case has are unsupported. Every signature of a case is such a chain, so the numbers of both suffice. Above the cap of paths
    a pair is truncated with distortion 1. Pairs of a large case are counted beside it, all others carry their steps.
    """
    cases = materialize(case_steps(inst), "case-steps")
    short, long = _sized(pairs.select("a", "b"), cases.select(F.col("case_id").alias("key"), (F.size("steps") + F.size("known")).alias("n")), "a", "b")
    side = lambda s: cases.select(F.col("case_id").alias(s), F.col("steps").alias(f"s{s}"), F.col("known").alias(f"k{s}"))
    full = short.join(side("a"), "a", "left").join(side("b"), "b", "left").filter("sa IS NOT NULL OR sb IS NOT NULL")
    kind = "a string, b string, potential bigint, admitted bigint, unsupported bigint, highest int"
    near = full.select("a", "b", "sa", "ka", "sb", "kb").mapInArrow(_closures, kind)
    others = long.join(cases.select(F.col("case_id").alias("__short"), F.col("steps").alias("s"), F.col("known").alias("k")), "__short", "left")
    far = cases.join(long.select(F.col("__long").alias("case_id")).distinct(), "case_id", "left_semi").groupBy("case_id").cogroup(others.groupBy("__long")).applyInPandas(_closures_of, kind)
    return distorted(near.unionByName(far), cap)


def distorted(sums: DataFrame, cap: int = 20_000) -> DataFrame:
    """Counts of closure() with distortion and truncated."""
    cut = F.col("potential") > cap
    return sums.withColumn("distortion", F.when(cut, 1.0).otherwise(F.coalesce(F.round(F.try_divide("unsupported", "potential"), 6), F.lit(0.0)))).withColumn("truncated", cut)


def _assessed_block(docs: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
    """Pairs of a case asked with a later one of the block that shares a feature: counts of the closure, shared concepts, semantic and evidence."""
    names = ["a", "b", *CLOSURE, "shared", "semantic", "evidence"]
    if not len(docs) or not len(asked):
        return pd.DataFrame([], columns=names)
    total, q_total = docs.sort_values("document_id")["own"].to_numpy(), asked["q_own"].to_numpy()
    ones = lambda x: x.map(lambda y: np.ones(len(y)))
    block = resolution.Block(docs.assign(own=1.0))
    anchors = resolution.Block(docs.assign(tokens=docs["anchors"], w=ones(docs["anchors"]), own=1.0))
    asked = asked.assign(q_own=1.0)
    q_anchors = asked.assign(q_tokens=asked["q_anchors"], q_w=ones(asked["q_anchors"]))
    known = lambda x: {int(h): int(n) for n, h in (x if x is not None else ())}
    docs = docs.sort_values("document_id", ignore_index=True)
    steps, longer = [_steps(x) for x in docs["steps"]], [known(x) for x in docs["known"]]
    whole = [Counter(x.values()) for x in longer]
    chains: list[Chains | None] = [None] * len(docs)
    out = []
    for at in range(0, len(asked), 32):
        some = asked.iloc[at : at + 32]
        shared, common = block.sums(some), np.rint(anchors.sums(q_anchors.iloc[at : at + 32]))
        cosine = np.clip(resolution._units(some["q_v"]) @ block.v.T, 0.0, 1.0)
        for row, (q, s, k) in enumerate(zip(some["q_document_id"], some["q_steps"], some["q_known"])):
            near = np.flatnonzero((shared[row] > 0) & (block.ids > q))
            mine, has = _steps(s), known(k)
            own, sizes = Chains(mine), Counter(has.values())
            counts = []
            for i in near.tolist():
                if len(steps[i]) < len(mine):
                    n, made = own.joined(steps[i])
                    more = whole[i] if has.keys().isdisjoint(longer[i]) else Counter(n for h, n in longer[i].items() if h not in has)
                    both = sizes + more
                else:
                    chains[i] = chains[i] or Chains(steps[i])
                    n, made = chains[i].joined(mine)
                    both = whole[i] + (sizes if has.keys().isdisjoint(longer[i]) else Counter(n for h, n in has.items() if h not in longer[i]))
                counts.append(_assessed(n, made, both))
            evidence = shared[row, near] / (total[near] + q_total[at + row] - shared[row, near])
            out.append(pd.DataFrame({"a": q, "b": block.ids[near], **dict(zip(CLOSURE, np.array(counts, np.int64).reshape(-1, 4).T)), "shared": common[row, near].astype(np.int64), "semantic": cosine[row, near], "evidence": evidence}))
    return pd.concat(out)[names]


def assessed_pairs(inst: DataFrame, feats: DataFrame, idf: DataFrame, vectors: DataFrame, block: int = 4_000) -> DataFrame:
    """(a, b, closure, shared, semantic, evidence), a < b, of all pairs of cases that share a feature, in blocks; the work and the rows grow with the square of the cases."""
    hashed = F.xxhash64("feature")
    lists = feats.join(idf.select("feature", "idf"), "feature").groupBy("case_id").agg(
        F.collect_list(F.struct(hashed.alias("f"), F.col("idf").alias("w"))).alias("l"), F.collect_list(F.when(F.col("feature").startswith("role_concept:"), hashed)).alias("anchors"), F.sum("idf").alias("own")
    )
    full = lists.join(case_steps(inst), "case_id", "left").join(vectors, "case_id", "left")
    full = materialize(full.select(F.col("case_id").alias("document_id"), F.col("l")["f"].alias("tokens"), F.col("l")["w"].alias("w"), "own", "v", "anchors", "steps", "known"), "case-evidence")
    kind = "a string, b string, potential bigint, admitted bigint, unsupported bigint, highest int, shared bigint, semantic double, evidence double"
    return distorted(resolution.in_blocks(full, None, block, _assessed_block, kind))


def risk(unsupported, highest, shared_concepts, semantic, evidence):
    """Risk class of a pair, in order: long unsupported chain, shared anchor, any unsupported, vectors near but structure apart, safe."""
    some = unsupported > 0
    return (
        F.when(some & (highest >= 4), "E_higher_order_cross_case_chain")
        .when(some & (shared_concepts > 0), "C_shared_anchor_path_divergence")
        .when(some, "A_local_edges_compose_without_case_support")
        .when((semantic >= 0.80) & (evidence <= 0.05), "D_bge_high_structure_low")
        .otherwise("safe_or_low_risk_control")
    )
