"""Most similar vectors for every vector: a neighbour graph by NN-descent, and greedy search over it.

1. Vectors are checked, made unit length, and equal ones folded into one node. 2. Random projection trees, fitted on a bounded sample, put
every node into one leaf per tree; the nearest within each leaf give the first graph. 3. NN-descent: in every round the nodes of a
leaf of the first tree, its region, meet all their neighbours and neighbours of neighbours, in both directions of the
edges, and keep the K most similar. The joins that find them carry numbers only; a vector is sent once to a region, however many of its nodes may
want it. No neighbour is sampled or left out, a hub comes to a region once. Rounds end when few edges change.

Regions reach Python as sorted streams, their own nodes first: these are bounded by the leaf, the rest passes in batches, so nothing
grows with the number of neighbours. Similarities are computed in doubles from unit vectors of floats.

Null vectors, wrong lengths, null or non-finite components and all-zero vectors take no part; of repeated
ids the vector least by its bytes counts. An empty table gives an empty result, a single vector no neighbour.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wrenmill.runtime import hash_sample, materialize, release, skew_lookup

#: Most vectors the trees are fitted on; all vectors are placed in them.
SAMPLE = 20_000
LEAF = 640
LEAF_MOST = 1600
TREES = 4
TRIALS = 6
MIDDLE = 0.25
KEEP = 16
FIRST = 10
ROUNDS = 8
CHANGED = 0.004
SEED = 20_231
#: Entry nodes of a search in each leaf: clusters far apart share no edge, so a search must enter the right one.
DOORS = 64


# --- nodes ------------------------------------------------------------------------------------------------


def usable_vectors(vectors: DataFrame, key: str, vector: str, size: int) -> DataFrame:
    """(id, v): one unit vector per id, as the bytes of its floats."""
    kind = vectors.schema[key].dataType.simpleString()
    some = vectors.filter(F.col(key).isNotNull() & (F.size(vector) == size)).select(F.col(key).alias("id"), F.col(vector).cast("array<double>").alias("v"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if not len(pdf):
                continue
            x = np.array([np.asarray(v, np.float64) for v in pdf["v"]])
            top = np.abs(x).max(1)
            fine = np.isfinite(x).all(1) & (top > 0)
            # scaled before squaring, so that no length over- or underflows; adding 0 makes -0 and 0 one
            y = x[fine] / top[fine, None]
            unit = (y / np.sqrt((y * y).sum(1))[:, None]).astype(np.float32) + np.float32(0)
            yield pd.DataFrame({"id": pdf["id"].to_numpy()[fine], "v": [u.tobytes() for u in unit]})

    return some.mapInPandas(run, f"id {kind}, v binary").groupBy("id").agg(F.min("v").alias("v"))


def fold(unit: DataFrame, k: int) -> DataFrame:
    """(node, v, ids, n): equal vectors as one node with the k + 1 smallest of its n ids, which can be anyone's neighbours."""
    salts = max(1, unit.count() // 100_000)
    part = unit.groupBy("v", F.pmod(F.xxhash64("id"), F.lit(salts)).alias("salt")).agg(F.slice(F.array_sort(F.collect_set("id")), 1, k + 1).alias("ids"), F.count(F.lit(1)).alias("n"))
    folded = part.groupBy("v").agg(F.slice(F.array_sort(F.flatten(F.collect_list("ids"))), 1, k + 1).alias("ids"), F.sum("n").alias("n"))
    return materialize(folded.withColumn("node", F.monotonically_increasing_id()), "p1-folded")


class Tree:
    """A random projection tree. Cuts lie at a random place of the middle of a line, through two rows
    (even) or random, so that the trees cut one cluster at different places; depth and leaves depend on the sample's size only."""

    def __init__(self, sample: np.ndarray, leaf: int, rng: np.random.Generator, even: bool = True) -> None:
        self.normal: list[np.ndarray] = []
        self.offset: list[float] = []
        self.child: list[list[int]] = []
        self.leaves = 0
        self.root = self._grow(sample, leaf, rng, even)

    def _grow(self, x: np.ndarray, leaf: int, rng: np.random.Generator, even: bool) -> int:
        if len(x) > leaf:
            for _ in range(TRIALS):
                a, b = x[rng.choice(len(x), 2, replace=False)]
                w = a - b if even else rng.standard_normal(x.shape[1]).astype(np.float32)
                side = x @ w
                cut = float(np.quantile(side, rng.uniform(MIDDLE, 1 - MIDDLE)))
                if 0 < (side > cut).sum() < len(x):
                    at = len(self.normal)
                    self.normal.append(w)
                    self.offset.append(cut)
                    self.child.append([0, 0])
                    low, high = x[side <= cut], x[side > cut]
                    self.child[at] = [self._grow(low, leaf, rng, even), self._grow(high, leaf, rng, even)]
                    return at
        self.leaves += 1
        return -self.leaves

    def place(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row."""
        out = np.zeros(len(x), np.int64)
        todo = [(self.root, np.arange(len(x)))]
        while todo:
            at, rows = todo.pop()
            if at < 0:
                out[rows] = -at
            elif len(rows):
                right = x[rows] @ self.normal[at] > self.offset[at]
                todo += [(self.child[at][0], rows[~right]), (self.child[at][1], rows[right])]
        return out


class Forest:
    """The trees, and beyond the sample's resolution signs of random projections that cut their leaves on."""

    def __init__(self, sample: np.ndarray, n: int, trees: int, seed: int) -> None:
        rng = np.random.default_rng(seed)
        leaf = max(8, int(LEAF * min(1.0, len(sample) / max(1, n))))
        self.trees = [Tree(sample, leaf, rng, i % 2 == 0) for i in range(trees)]
        self.bits = max(0, int(np.floor(np.log2(max(1.0, n / (LEAF * max(1, len(sample) // leaf)))))))
        self.planes = rng.standard_normal((trees, self.bits, sample.shape[1])).astype(np.float32) if self.bits else None

    def place(self, x: np.ndarray) -> np.ndarray:
        places = np.stack([t.place(x) for t in self.trees], 1)
        if self.planes is None:
            return places
        signs = [(x @ own.T > 0) @ (1 << np.arange(self.bits)) for own in self.planes]
        return (places << self.bits) | np.stack(signs, 1)


def forest(folded: DataFrame, n: int, trees: int = TREES, seed: int = SEED) -> Forest:
    """Fitted on at most SAMPLE vectors in hash order."""
    rows = hash_sample(folded.select("v"), ["v"], SAMPLE).collect()
    return Forest(_matrix([r[0] for r in rows]).astype(np.float32), n, trees, seed)


def _matrix(column: list[bytes] | pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.float32).reshape(len(column), -1).astype(np.float64)


def placed(rows: DataFrame, woods: Forest) -> DataFrame:
    """rows with the leaves of their vector v, one number per tree."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                yield pd.DataFrame({"node": pdf["node"], "v": pdf["v"], "leaves": list(woods.place(_matrix(pdf["v"]).astype(np.float32)))})

    return rows.select("node", "v").mapInPandas(run, "node bigint, v binary, leaves array<bigint>")


def blocks(nodes: DataFrame) -> DataFrame:
    """(node, tree, block): the leaf of each node in every tree, leaves above LEAF_MOST cut by a hash into parts below it."""
    leaves = nodes.select("node", F.posexplode("leaves").alias("tree", "leaf"))
    cuts = leaves.groupBy("tree", "leaf").agg(F.ceil(F.count(F.lit(1)) / F.lit(LEAF_MOST)).alias("cuts"))
    return leaves.join(cuts, ["tree", "leaf"]).select("node", "tree", F.xxhash64("tree", "leaf", F.pmod(F.xxhash64("node"), F.col("cuts"))).alias("block"))


# --- streams of sorted groups ------------------------------------------------------------------------------


class Nearest:
    """The k most similar rows so far of the nodes of one region."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, k: int) -> None:
        self.ids, self.x, self.k = ids, x, k
        self.q = np.full((len(ids), k), -1, np.int64)
        self.s = np.full((len(ids), k), -2.0)

    def meet(self, ids: np.ndarray, x: np.ndarray) -> None:
        sim = self.x @ x.T
        sim[self.ids[:, None] == ids[None, :]] = -2.0
        s = np.concatenate([self.s, sim], 1)
        q = np.concatenate([self.q, np.broadcast_to(ids, sim.shape)], 1)
        q[s <= -2.0] = -1
        top = np.argpartition(-s, self.k - 1, 1)[:, : self.k]
        self.s, self.q = np.take_along_axis(s, top, 1), np.take_along_axis(q, top, 1)

    def edges(self) -> pd.DataFrame:
        real = self.q >= 0
        return pd.DataFrame({"p": np.repeat(self.ids, real.sum(1)), "q": self.q[real], "s": self.s[real]})


EDGE = "p bigint, q bigint, s double"


def _meet(k: int) -> Callable:
    """Edges of the own rows of each block with the best of all its other rows; sorted by block, own rows first."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, own, state = None, [], None
        for pdf in batches:
            if not len(pdf):
                continue
            keys, mine, ids = pdf["block"].to_numpy(), pdf["own"].to_numpy(), pdf["node"].to_numpy()
            x = _matrix(pdf["v"])
            cuts = np.flatnonzero((np.diff(keys) != 0) | (np.diff(mine) != 0)) + 1
            for a, b in zip([0, *cuts], [*cuts, len(keys)]):
                if keys[a] != at:
                    if state is not None:
                        yield state.edges()
                    at, own, state = keys[a], [], None
                if mine[a]:
                    own.append((ids[a:b], x[a:b]))
                    continue
                if state is None:
                    state = Nearest(np.concatenate([o[0] for o in own]), np.concatenate([o[1] for o in own]), k)
                state.meet(ids[a:b], x[a:b])
        if state is not None:
            yield state.edges()

    return run


def _within(k: int) -> Callable:
    """The k best of each block's rows among themselves; a block has at most a little above LEAF_MOST rows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for pdf in batches:
            keys = pdf["block"].to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(keys)) + 1), len(keys)]
            for a, b in zip(cuts, cuts[1:]):
                if held and held[0]["block"].iloc[0] != keys[a]:
                    yield _among(pd.concat(held), k)
                    held = []
                if b > a:
                    held.append(pdf.iloc[a:b])
        if held:
            yield _among(pd.concat(held), k)

    return run


def _among(pdf: pd.DataFrame, k: int) -> pd.DataFrame:
    ids, x = pdf["node"].to_numpy(), _matrix(pdf["v"])
    state = Nearest(ids, x, min(k, max(1, len(ids) - 1)))
    state.meet(ids, x)
    return state.edges()


# --- the graph ----------------------------------------------------------------------------------------------


def best(edges: DataFrame, k: int) -> DataFrame:
    """The k most similar distinct q of each p, ties by smaller q."""
    w = Window.partitionBy("p").orderBy(F.desc("s"), "q")
    return edges.groupBy("p", "q").agg(F.max("s").alias("s")).withColumn("r", F.row_number().over(w)).filter(F.col("r") <= k).drop("r")


def neighbour_graph(nodes: DataFrame, n: int, keep: int = KEEP, rounds: int = ROUNDS, report: list | None = None) -> DataFrame:
    """(p, q, s): keep neighbours of each node, by NN-descent from the trees' leaves."""
    parts = max(nodes.sparkSession.sparkContext.defaultParallelism, -(-n // 25_000))
    cut = materialize(blocks(nodes), "p1-blocks")
    vectors = nodes.select("node", "v")
    inside = cut.join(vectors, "node").select("block", "node", "v").repartition(parts, "block").sortWithinPartitions("block")
    graph = materialize(best(inside.mapInPandas(_within(min(FIRST, keep)), EDGE), keep), "p1-graph")
    home = cut.filter("tree = 0").select("node", "block")
    own = home.join(vectors, "node").select("block", "node", "v", F.lit(True).alias("own"))
    for _ in range(rounds):
        both = materialize(graph.select("p", "q").unionByName(graph.select(F.col("q").alias("p"), F.col("p").alias("q"))).distinct(), "p1-both")
        first = materialize(both.join(home.withColumnRenamed("node", "p"), "p").select("block", F.col("q").alias("node")).distinct(), "p1-near")
        second = first.withColumnRenamed("node", "p").join(both, "p").select("block", F.col("q").alias("node")).distinct()
        meet = first.unionByName(second).distinct().join(vectors, "node").select("block", "node", "v", F.lit(False).alias("own"))
        rows = own.unionByName(meet).repartition(parts, "block").sortWithinPartitions("block", F.desc("own"))
        new = materialize(rows.mapInPandas(_meet(keep), EDGE), "p1-graph")
        changed = new.join(graph, ["p", "q"], "left_anti").count()
        release(graph, both, first)
        graph = new
        if report is not None:
            report.append(changed)
        if changed <= CHANGED * n * keep:
            break
    release(cut)
    return graph


def nearest(vectors: DataFrame, key: str, vector: str, k: int = 10, size: int = 64, keep: int = KEEP, rounds: int = ROUNDS, report: list | None = None) -> DataFrame:
    """(id, other, similarity, rank): the k most similar others of every usable vector; ties by smaller id."""
    spark = vectors.sparkSession
    unit = materialize(usable_vectors(vectors, key, vector, size), "p1-unit")
    kind = vectors.schema[key].dataType.simpleString()
    if unit.limit(2).count() < 2:
        return spark.createDataFrame([], f"id {kind}, other {kind}, similarity double, rank int")
    folded = fold(unit, k)
    distinct = folded.count()
    if distinct > 1:
        nodes = materialize(placed(folded, forest(folded, distinct)), "p1-nodes")
        close = neighbour_graph(nodes, distinct, max(keep, k), rounds, report)
    else:
        close = spark.createDataFrame([], EDGE)
    close = close.unionByName(folded.filter("n > 1").select(F.col("node").alias("p"), F.col("node").alias("q"), F.lit(1.0).alias("s")))
    members = folded.select(F.col("node").alias("q"), F.explode("ids").alias("other"))
    # a node's candidates: of the ids of its neighbours the k + 1 best suffice for each id of the node
    options = close.join(members, "q").select("p", "other", F.least(F.col("s"), F.lit(1.0)).alias("similarity"))
    single = folded.filter("n = 1").select(F.col("node").alias("p"), F.col("ids")[0].alias("id"))
    several = folded.filter("n > 1").select("v", F.col("node").alias("p"))
    owners = single.unionByName(skew_lookup(unit, several, "v", "inner").select("p", "id")) if several.limit(1).count() else single
    w = Window.partitionBy("p").orderBy(F.desc("similarity"), "other")
    short = options.withColumn("at", F.row_number().over(w)).filter(F.col("at") <= k + 1)
    pairs = skew_lookup(owners, short.groupBy("p").agg(F.collect_list(F.struct("at", "other", "similarity")).alias("list")), "p", "inner")
    ordered = F.filter(F.array_sort("list"), lambda x: x["other"] != F.col("id"))
    out = pairs.select("id", F.posexplode(F.slice(ordered, 1, k)).alias("pos", "x"))
    return out.select("id", F.col("x.other").alias("other"), F.col("x.similarity").alias("similarity"), (F.col("pos") + 1).alias("rank"))


def near_pairs(vectors: DataFrame, key: str, vector: str, k: int = 10, size: int = 64, report: list | None = None) -> DataFrame:
    """Distinct pairs (a, b), a < b, in which one is among the k most similar of the other."""
    out = nearest(vectors, key, vector, k, size, report=report)
    return out.select(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b")).distinct()


# --- search -------------------------------------------------------------------------------------------------


def _dot(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        if len(pdf):
            s = np.einsum("ij,ij->i", _matrix(pdf["vq"]), _matrix(pdf["v"]))
            yield pd.DataFrame({"ask": pdf["ask"], "node": pdf["node"], "s": s, "done": False})


def search(vectors: DataFrame, queries: DataFrame, key: str, vector: str, k: int = 10, size: int = 64, beam: int = 32, hops: int = 12) -> DataFrame:
    """(query_id, other, similarity, rank): the k most similar vectors of every query, by greedy search of the neighbour graph.

    Equal vectors are one node. A query enters at DOORS nodes of its leaf in every tree, expands the best unexpanded of its `beam` best nodes
    along the edges of both directions, and ends when none is left or after `hops`. The ids of the nodes found are listed last; the
    query's own id is no answer. Ties by smaller id; unusable vectors take no part on either side.
    """
    spark = vectors.sparkSession
    kind = vectors.schema[key].dataType.simpleString()
    unit = materialize(usable_vectors(vectors, key, vector, size), "search-unit")
    asked = materialize(usable_vectors(queries, key, vector, size).withColumn("node", F.monotonically_increasing_id()), "search-queries")
    if not unit.limit(1).count() or not asked.limit(1).count():
        return spark.createDataFrame([], f"query_id {kind}, other {kind}, similarity double, rank int")
    folded = fold(unit, k)
    n = folded.count()
    woods = forest(folded, n)
    nodes = materialize(placed(folded, woods), "search-nodes")
    edges = neighbour_graph(nodes, n).select("p", "q") if n > 1 else spark.createDataFrame([], "p bigint, q bigint")
    edges = materialize(edges.unionByName(edges.select(F.col("q").alias("p"), F.col("p").alias("q"))).distinct(), "search-edges")
    leaf = lambda df: df.select("node", F.posexplode("leaves").alias("tree", "leaf"))
    doors = leaf(nodes).groupBy("tree", "leaf", F.pmod(F.xxhash64("node"), F.lit(DOORS))).agg(F.min("node").alias("node"))
    ask = asked.select(F.col("node").alias("ask"), F.col("v").alias("vq"))
    fresh = leaf(placed(asked, woods)).withColumnRenamed("node", "ask").join(doors, ["tree", "leaf"]).select("ask", "node").distinct()
    best_first = Window.partitionBy("ask").orderBy(F.desc("s"), "node")
    held = None
    for _ in range(hops):
        new = fresh.join(ask, "ask").join(nodes.select("node", "v"), "node").select("ask", "node", "vq", "v").mapInPandas(_dot, "ask bigint, node bigint, s double, done boolean")
        every = new if held is None else held.unionByName(new)
        kept = materialize(every.withColumn("r", F.row_number().over(best_first)).filter(F.col("r") <= beam).drop("r"), "search-beam")
        frontier = kept.filter("NOT done")
        if not frontier.limit(1).count():
            held = kept
            break
        steps = frontier.select("ask", F.col("node").alias("p")).join(edges, "p").select("ask", F.col("q").alias("node")).distinct()
        fresh = materialize(steps.join(kept.select("ask", "node"), ["ask", "node"], "left_anti"), "search-steps")
        held = kept.withColumn("done", F.lit(True))
    found = held.join(folded.select("node", F.explode("ids").alias("other")), "node").join(asked.select(F.col("node").alias("ask"), F.col("id").alias("query_id")), "ask")
    ranked = Window.partitionBy("query_id").orderBy(F.desc("s"), "other")
    out = found.filter("other <> query_id").withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") <= k)
    return out.select("query_id", "other", F.least(F.col("s"), F.lit(1.0)).alias("similarity"), "rank")
