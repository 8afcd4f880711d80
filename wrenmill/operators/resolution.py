"""Case resolution: symmetric BM25, vector cosine, hybrid candidates, slot conflicts and the veto.

Searches take a set of query records against all records: with all records as queries this is the full self-join
of small corpora, with a fixed share it stays a linear share of the postings. A candidate shares a
token with its query; two records without one score at most the vector weight, below the threshold.
Null texts have no tokens and give no candidates; records without a usable vector count as cosine 0.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wrenmill.config import ResolutionConfig
from wrenmill.functions import text as t
from wrenmill.runtime import materialize, numbered, spread

# Words of systems and component families.
SYSTEMS = {
    "滑油系统": ("滑油", "回油", "油气分离"),
    "燃油系统": ("燃油", "喷嘴", "燃油泵"),
    "液压系统": ("液压", "作动筒"),
    "气路系统": ("气密", "引气", "气路", "燃烧室", "压气机", "涡轮"),
    "电气系统": ("传感器", "电缆", "插头", "信号", "电压"),
}
FAMILIES = {
    "轴承": ("轴承",),
    "管路": ("管", "软管", "接头"),
    "密封": ("o型圈", "密封圈", "封严"),
    "法兰机匣": ("法兰", "机匣", "端盖", "检查盖"),
    "转子叶片": ("转子", "涡轮", "压气机", "叶片", "导向器"),
    "齿轮传动": ("齿轮", "轴颈", "驱动轴"),
    "传感电气": ("传感器", "电缆", "插头"),
    "执行机构": ("作动筒", "活门", "泵"),
    "紧固件": ("螺栓", "螺母", "垫片", "支架"),
}
HARD_SLOTS = ("component", "phenomenon", "damage_state")


def clean_records(records: DataFrame) -> DataFrame:
    """One row (document_id, text) per id."""
    return records.filter("document_id IS NOT NULL").groupBy("document_id").agg(F.coalesce(F.min("text"), F.lit("")).alias("text"))


def tokenized(records: DataFrame) -> DataFrame:
    """(document_id, tokens), written once: every step of BM25 reads this table."""
    return materialize(spread(records).select("document_id", t.domain_tokens(F.col("text")).alias("tokens")), "case-tokens")


def postings(tokens: DataFrame) -> DataFrame:
    """(document_id, token, tf, length) of tokenized() records: term frequencies, map-side combined."""
    long = tokens.select("document_id", F.size("tokens").alias("length"), F.explode("tokens").alias("token"))
    return long.groupBy("document_id", "length", "token").agg(F.count(F.lit(1)).alias("tf"))


def bm25_idf(post: DataFrame, n_documents: int) -> DataFrame:
    df = post.groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    return df.select("token", "df", F.log(1 + (F.lit(n_documents) - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))


def bm25_weights(tokens: DataFrame, config: ResolutionConfig = ResolutionConfig()) -> DataFrame:
    """(document_id, token, w) of tokenized() records: what a token of the query adds to the document's score."""
    sizes = tokens.agg(F.count(F.lit(1)).alias("docs"), F.avg(F.size("tokens")).alias("average")).first()
    average = sizes["average"] or 1.0
    post = postings(tokens)
    tf = F.col("tf")
    norm = tf + config.k1 * (1 - config.b + config.b * F.col("length") / F.lit(float(average)))
    weighted = post.join(bm25_idf(post, sizes["docs"]), "token").select("document_id", "token", (F.col("idf") * tf * (config.k1 + 1) / norm).alias("w"))
    return materialize(weighted, "case-weights")


def symmetric_bm25(queries: DataFrame, weights: DataFrame) -> DataFrame:
    """(query_id, document_id, bm25): mean of both self-normalized directions, one postings join for both sums."""
    own = weights.groupBy("document_id").agg(F.sum("w").alias("own"))
    left = weights.join(queries.select("document_id"), "document_id", "left_semi").select(F.col("document_id").alias("query_id"), "token", F.col("w").alias("wq"))
    both = left.join(weights, "token").filter("query_id <> document_id").groupBy("query_id", "document_id").agg(F.sum("wq").alias("a"), F.sum("w").alias("b"))
    both = both.join(own.select(F.col("document_id").alias("query_id"), F.col("own").alias("oq")), "query_id").join(own, "document_id")
    score = (F.try_divide("b", "oq") + F.try_divide("a", "own")) / 2
    return both.select("query_id", "document_id", F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(score, F.lit(0.0)))).alias("bm25"))


def usable_vectors(vectors: DataFrame, size: int = 64) -> DataFrame:
    """(document_id, v): one vector per id; unusable ones are left out."""
    v = F.col("embedding").cast("array<double>")
    fine = F.coalesce((F.size(v) == size) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists(v, lambda x: x != 0), F.lit(False))
    return vectors.filter(F.col("document_id").isNotNull() & fine).groupBy("document_id").agg(F.min(v).alias("v"))


def unit_vectors(vectors: DataFrame, size: int = 64) -> DataFrame:
    """(document_id, v): one vector per id, of length 1 with a floor of 1e-12; unusable ones are left out."""
    one = usable_vectors(vectors, size)
    norm = F.greatest(F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)), F.lit(1e-12))
    return one.withColumn("norm", norm).select("document_id", F.transform("v", lambda x: x / F.col("norm")).alias("v"))


def missing_vectors(records: DataFrame, units: DataFrame) -> DataFrame:
    return records.select("document_id").distinct().join(units, "document_id", "left_anti")


def cosine(a: Column, b: Column) -> Column:
    """Dot product of unit vectors, clipped to [0, 1]."""
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)))


def hybrid(pairs: DataFrame, units: DataFrame, config: ResolutionConfig = ResolutionConfig()) -> DataFrame:
    """Pairs with cosine and the weighted score."""
    joined = pairs.join(units.select(F.col("document_id").alias("query_id"), F.col("v").alias("vq")), "query_id", "left").join(units, "document_id", "left")
    cos = F.coalesce(cosine(F.col("vq"), F.col("v")), F.lit(0.0))
    scored = joined.select("query_id", "document_id", "bm25", cos.alias("cosine"))
    return scored.withColumn("score", config.bm25_weight * F.col("bm25") + config.vector_weight * F.col("cosine"))


def candidates(scored: DataFrame, k: int) -> DataFrame:
    """The k best per query before any veto, ties by smaller id; ranks beyond k are pruned before the shuffle."""
    w = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "document_id")
    return scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def slots(records: DataFrame) -> DataFrame:
    """(document_id, slot, value, modality, confidence, eligible): rule mentions of every sentence."""
    s = records.select("document_id", F.explode(t.sentence_array(F.col("text"))["sentence"]).alias("sentence"))
    s = s.withColumn("modality", t.modality(F.col("sentence")))
    named = lambda slot: (lambda v: F.struct(F.lit(slot).alias("slot"), v.alias("value")))
    found = F.flatten(F.array(*[F.transform(t.slot_values(F.col("sentence"), x), named(x)) for x in t.SLOT_PATTERNS]))
    long = s.select("document_id", "modality", F.inline(found))
    base = F.when(F.col("slot").isin(*HARD_SLOTS), 0.90).otherwise(0.78)
    confidence = F.when(F.col("modality") == "confirmed", F.least(F.lit(0.98), base + 0.06)).otherwise(base)
    eligible = F.col("slot").isin(*HARD_SLOTS) & ~F.col("modality").isin("possible", "suspected")
    return long.select("document_id", "slot", "value", "modality", F.round(confidence, 2).alias("confidence"), eligible.alias("eligible"))


def profiles(records: DataFrame) -> DataFrame:
    """(document_id, systems, components, damage): categories of the eligible mentions and confirmed damage."""
    s = slots(records)
    text = s.groupBy("document_id").agg(
        F.lower(F.array_join(F.array_sort(F.collect_set(F.when(F.col("eligible"), F.col("value")))), " ")).alias("said"),
        F.array_sort(F.collect_set(F.when((F.col("slot") == "damage_state") & (F.col("modality") == "confirmed"), F.col("value")))).alias("damage"),
    )
    categories = lambda words: F.array_compact(F.array(*[F.when(F.col("said").rlike("|".join(ws)), F.lit(c)) for c, ws in sorted(words.items())]))
    return text.select("document_id", categories(SYSTEMS).alias("systems"), categories(FAMILIES).alias("components"), "damage")


def conflicts(pairs: DataFrame, profile: DataFrame, soft: float = 0.35) -> DataFrame:
    """Pairs with conflict kinds; disjoint systems are hard, else disjoint components (hard for two single ones); disjoint damage is soft."""
    p = lambda side, key: profile.select(F.col("document_id").alias(key), *[F.col(c).alias(f"{c}_{side}") for c in ("systems", "components", "damage")])
    full = pairs.join(p("a", "query_id"), "query_id", "left").join(p("b", "document_id"), "document_id", "left")
    apart = lambda c: F.coalesce((F.size(f"{c}_a") > 0) & (F.size(f"{c}_b") > 0) & ~F.arrays_overlap(f"{c}_a", f"{c}_b"), F.lit(False))
    system, component, damage = apart("systems"), apart("components"), apart("damage")
    single = (F.size("components_a") == 1) & (F.size("components_b") == 1)
    kinds = F.array_compact(F.array(F.when(system, "system_conflict"), F.when(~system & component, "component_conflict"), F.when(damage, "cause_conflict")))
    hard = system | (component & single)
    out = full.withColumn("conflicts", F.array_join(kinds, "|")).withColumn("hard", F.coalesce(hard, F.lit(False)))
    value = F.when(F.col("hard"), 1.0).when(F.size(kinds) > 0, soft).otherwise(0.0)
    return out.withColumn("conflict_score", value).drop("systems_a", "systems_b", "components_a", "components_b", "damage_a", "damage_b")


def judged(top: DataFrame, records: DataFrame, config: ResolutionConfig = ResolutionConfig()) -> DataFrame:
    """Candidates with conflicts and the score after the veto; only records that are a candidate or a query are searched for mentions."""
    top = materialize(top, "case-top")
    used = top.select(F.explode(F.array("query_id", "document_id")).alias("document_id")).distinct()
    records = spread(records.join(used, "document_id", "left_semi"))
    final = F.when(F.col("hard"), 0.0).otherwise(F.col("score"))
    return conflicts(top, profiles(records)).withColumn("final_score", final).withColumn("same_case", final > config.threshold)


def decisions(queries: DataFrame, records: DataFrame, vectors: DataFrame, config: ResolutionConfig = ResolutionConfig()) -> DataFrame:
    """Candidate decisions of the queries: scores, conflicts, and the score after the veto."""
    return judged(searched_candidates(queries, records, vectors, config), clean_records(records), config)


def _flat(rows: pd.Series, kind: type) -> np.ndarray:
    return np.concatenate([np.asarray(x, kind) for x in rows]) if len(rows) else np.zeros(0, kind)


def _units(rows: pd.Series) -> np.ndarray:
    none = np.zeros(64)
    return np.array([none if x is None else x for x in rows], np.float64).reshape(len(rows), 64)


class Block:
    """Postings of a block of documents, and the symmetric BM25 of all of them with a batch of queries; it is above 0 just for those that share a token.

    A token of more than `common` of the documents is a column of a dense product, one of up to `rare` documents is added with others at once.
    """

    def __init__(self, docs: pd.DataFrame, common: float = 0.25, rare: int = 500) -> None:
        docs = docs.sort_values("document_id", ignore_index=True)
        self.ids, self.v, n = docs["document_id"].to_numpy(), _units(docs["v"]), len(docs)
        self.place = {x: i for i, x in enumerate(self.ids)}
        own = docs["own"].to_numpy(np.float64)
        share = np.divide(1.0, own, out=np.zeros(n), where=own > 0)
        token, weight, at = _flat(docs["tokens"], np.int64), _flat(docs["w"], np.float64), np.repeat(np.arange(n), docs["tokens"].map(len).to_numpy())
        order = np.argsort(token, kind="stable")
        token, self.weight, self.at = token[order], weight[order] / 2, at[order]
        self.part = share[self.at] / 2
        self.terms, self.start, self.df = np.unique(token, return_index=True, return_counts=True)
        dense = np.flatnonzero(self.df > max(rare, common * n))
        self.rare = rare
        self.column = np.full(len(self.terms), -1)
        self.column[dense] = np.arange(len(dense))
        self.theirs, self.mine = np.zeros((len(dense), n)), np.zeros((len(dense), n))
        for c, k in enumerate(dense):
            here = slice(self.start[k], self.start[k] + self.df[k])
            self.theirs[c, self.at[here]], self.mine[c, self.at[here]] = self.weight[here], self.part[here]

    def bm25(self, some: pd.DataFrame) -> np.ndarray:
        out = self.sums(some)
        return np.minimum(out, 1.0, out=out)

    def sums(self, some: pd.DataFrame) -> np.ndarray:
        """Over the shared tokens, the mean of the document's weight in shares of the query's sum `own` and of the query's weight in shares of the document's."""
        m, n = len(some), len(self.ids)
        row, token, w = np.repeat(np.arange(m), some["q_tokens"].map(len).to_numpy()), _flat(some["q_tokens"], np.int64), _flat(some["q_w"], np.float64)
        own = some["q_own"].to_numpy(np.float64)
        inverse = np.divide(1.0, own, out=np.ones(m), where=own > 0)[row]
        if not len(self.terms) or not len(token):
            return np.zeros((m, n))
        k = np.minimum(np.searchsorted(self.terms, token), len(self.terms) - 1)
        known = self.terms[k] == token
        row, k, w, inverse = row[known], k[known], w[known], inverse[known]
        few = self.df[k] <= self.rare
        count = self.df[k][few]
        at = np.repeat(self.start[k][few] - np.cumsum(count) + count, count) + np.arange(count.sum())
        add = self.weight[at] * np.repeat(inverse[few], count) + self.part[at] * np.repeat(w[few], count)
        out = np.bincount(np.repeat(row[few] * n, count) + self.at[at], weights=add, minlength=m * n).astype(np.float64).reshape(m, n)
        column = self.column[k]
        if len(self.theirs):
            there, back = np.zeros((m, len(self.theirs))), np.zeros((m, len(self.theirs)))
            thick = column >= 0
            there[row[thick], column[thick]], back[row[thick], column[thick]] = inverse[thick], w[thick]
            out += there @ self.theirs
            out += back @ self.mine
        middle = np.flatnonzero(~few & (column < 0))
        for r, lo, df, x, y in zip(row[middle].tolist(), self.start[k[middle]].tolist(), self.df[k[middle]].tolist(), w[middle].tolist(), inverse[middle].tolist()):
            out[r][self.at[lo : lo + df]] += self.weight[lo : lo + df] * y + self.part[lo : lo + df] * x
        return out


def best_of(score: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties (to 9 digits) by place.

    The k-th highest of the maxima of pieces is a bound: only what reaches it is looked at.
    """
    n = len(score)
    pieces = 4 * k
    if n >= 8 * pieces:
        size = n // pieces
        tops = np.r_[score[: size * pieces].reshape(pieces, size).max(1), score[size * pieces :]]
        some = np.flatnonzero(score >= np.partition(tops, len(tops) - k)[len(tops) - k] - 2e-9)
    else:
        some = np.arange(n)
    return some[np.lexsort((some, -np.round(score[some], 9)))][:k]


def _search_block(config: ResolutionConfig, sharing: bool = False, batch: int = 32) -> Callable:
    """The top_k documents of a block for every query of another; every document is scored. sharing: only those with a token of the query."""

    def run(docs: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        names = ["query_id", "document_id", "bm25", "cosine", "score"]
        if not len(docs) or not len(asked):
            return pd.DataFrame([], columns=names)
        block = Block(docs)
        out = []
        k = min(config.top_k, len(block.ids))
        for c in range(0, len(asked), batch):
            some = asked.iloc[c : c + batch]
            cosines = _units(some["q_v"]) @ block.v.T
            np.minimum(np.maximum(cosines, 0.0, out=cosines), 1.0, out=cosines)
            bm25 = block.bm25(some)
            scores = config.vector_weight * cosines
            scores += config.bm25_weight * bm25
            if sharing:
                scores[bm25 <= 0] = -1.0
            for row, q in enumerate(some["q_document_id"]):
                if q in block.place:
                    scores[row, block.place[q]] = -1.0
                best = best_of(scores[row], k)
                best = best[scores[row, best] >= 0]
                out.append((np.full(len(best), q, object), block.ids[best], bm25[row, best], cosines[row, best], scores[row, best]))
        return pd.DataFrame(dict(zip(names, (np.concatenate(x) for x in zip(*out)))))

    return run


def _bm25_block(batch: int = 32) -> Callable:
    """The BM25 of all documents of a block that share a token with a query of another."""

    def run(docs: pa.Table, asked: pa.Table) -> pa.Table:
        schema = pa.schema([("query_id", pa.string()), ("document_id", pa.string()), ("bm25", pa.float64())])
        out = []
        if docs.num_rows and asked.num_rows:
            block, asked = Block(docs.to_pandas()), asked.to_pandas()
            ids = pa.array(block.ids, pa.string())
            for c in range(0, len(asked), batch):
                some = asked.iloc[c : c + batch]
                bm25 = block.bm25(some)
                names = some["q_document_id"].to_numpy()
                for row, q in enumerate(names):
                    if q in block.place:
                        bm25[row, block.place[q]] = 0.0
                row, at = np.nonzero(bm25)
                out.append(pa.table([pa.array(names, pa.string()).take(pa.array(row)), ids.take(pa.array(at)), pa.array(bm25[row, at])], schema=schema))
        return pa.concat_tables(out) if out else schema.empty_table()

    return run


def _lists(recs: DataFrame, vectors: DataFrame, config: ResolutionConfig) -> DataFrame:
    """(document_id, tokens, w, own, v) of all records, written once."""
    w = bm25_weights(tokenized(recs), config)
    lists = w.groupBy("document_id").agg(F.collect_list(F.struct(F.xxhash64("token").alias("t"), "w")).alias("l"), F.sum("w").alias("own"))
    full = recs.select("document_id").join(lists, "document_id", "left").join(unit_vectors(vectors), "document_id", "left")
    none = lambda c, kind: F.coalesce(c, F.array().cast(kind))
    full = full.select("document_id", none(F.col("l")["t"], "array<bigint>").alias("tokens"), none(F.col("l")["w"], "array<double>").alias("w"), F.coalesce("own", F.lit(0.0)).alias("own"), "v")
    return materialize(full, "case-lists")


def in_blocks(full: DataFrame, queries: DataFrame | None, block: int, run: Callable, schema: str, arrow: bool = False) -> DataFrame:
    """run(docs, asked) of every block of `full` with every part of the queries (document_id; all if None): nothing is left out, memory is bounded by the block."""
    n = full.count()
    blocks, tasks = max(1, -(-n // block)), 2 * full.sparkSession.sparkContext.defaultParallelism if n > 2000 else 1
    if queries is None:
        # records go to a task of every part, queries to one of every block: as many parts as blocks copy the least
        asking, parts = full, max(blocks, -(-tasks // blocks)) if n > 2000 else blocks
    else:
        # few queries: they are copied, the records go once
        asking, parts, blocks = materialize(full.join(queries.select("document_id").distinct(), "document_id", "left_semi"), "case-queries"), 1, max(blocks, tasks)
    spread = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    number = lambda k: F.pmod(F.xxhash64("document_id"), F.lit(k)).cast("int")
    docs = full.select(number(blocks).alias("block"), spread(parts).alias("part"), "*").repartition(blocks * parts, "block", "part")
    asked = asking.select(spread(blocks).alias("block"), number(parts).alias("part"), *[F.col(c).alias(f"q_{c}") for c in full.columns]).repartition(blocks * parts, "block", "part")
    both = docs.groupBy("block", "part").cogroup(asked.groupBy("block", "part"))
    return both.applyInArrow(run, schema) if arrow else both.applyInPandas(run, schema)


def searched_candidates(queries: DataFrame | None, records: DataFrame, vectors: DataFrame, config: ResolutionConfig = ResolutionConfig(), sharing: bool = True, block: int = 25_000) -> DataFrame:
    """The top_k others of every query (query_id, document_id, bm25, cosine, score, rank); queries: document_id, all records if None. sharing: only others with a token of the query.

    Blocks of at most about `block` records meet parts of the queries; the work grows with queries times records. Memory is bounded by the block.
    """
    full = _lists(clean_records(records), vectors, config)
    found = in_blocks(full, queries, block, _search_block(config, sharing), "query_id string, document_id string, bm25 double, cosine double, score double")
    return candidates(found, config.top_k)


def all_candidates(records: DataFrame, vectors: DataFrame, config: ResolutionConfig = ResolutionConfig(), block: int = 25_000) -> DataFrame:
    """The top_k others of every record, as all records were queries, also those without a shared token."""
    return searched_candidates(None, records, vectors, config, False, block)


def bm25_pairs(queries: DataFrame, records: DataFrame, config: ResolutionConfig = ResolutionConfig(), block: int = 25_000) -> DataFrame:
    """(query_id, document_id, bm25) of every query and all records that share a token with it: symmetric_bm25() without a row for every shared token."""
    recs = clean_records(records)
    w = bm25_weights(tokenized(recs), config)
    full = materialize(w.groupBy("document_id").agg(F.collect_list(F.struct(F.xxhash64("token").alias("t"), "w")).alias("l"), F.sum("w").alias("own")).select("document_id", F.col("l")["t"].alias("tokens"), F.col("l")["w"].alias("w"), "own", F.lit(None).cast("array<double>").alias("v")), "case-lists")
    return in_blocks(full, queries, block, _bm25_block(), "query_id string, document_id string, bm25 double", arrow=True)


def average_linkage(ids: list[str], similarity: dict[tuple[str, str], float], threshold: float) -> list[list[str]]:
    """Groups of average-linkage clustering; pairs without a similarity count as 0; merges need more than the threshold.

    Only pairs of groups with a similarity are held, so the cost goes with the pairs given, not with the square of the ids.
    """
    order = sorted(ids)
    at = {x: i for i, x in enumerate(order)}
    total: list[dict[int, float]] = [{} for _ in order]
    for (a, b), s in similarity.items():
        if a != b:
            total[at[a]][at[b]] = total[at[b]][at[a]] = s
    size = [1] * len(order)
    groups = [[x] for x in order]
    heap: list[tuple[float, int, int]] = []

    def offer(i: int, j: int) -> None:
        mean = total[i][j] / (size[i] * size[j])
        if 1.0 - mean < 1.0 - threshold:
            heapq.heappush(heap, (-mean, min(i, j), max(i, j)))

    for i, near in enumerate(total):
        for j in near:
            if i < j:
                offer(i, j)
    while heap:
        mean, i, j = heapq.heappop(heap)
        # an entry is stale if a side is gone or has grown since
        if j not in total[i] or -mean != total[i][j] / (size[i] * size[j]):
            continue
        gone, total[j] = total[j], {}
        del gone[i], total[i][j]
        size[i] += size[j]
        groups[i] += groups[j]
        groups[j] = []
        for k, s in gone.items():
            del total[k][j]
            total[i][k] = total[k][i] = total[i].get(k, 0.0) + s
        for k in total[i]:
            offer(i, k)
    return [sorted(g) for g in groups if g]


def cluster(pairs: DataFrame, ids: DataFrame, threshold: float) -> DataFrame:
    """(document_id, case_id) of all ids: linkage within the components of pairs above the threshold; cases numbered by least member.

    A merge needs a mean above the threshold, so at least one pair above it: components are closed under merging.
    """
    from wrenmill.operators.components import components

    used = pairs.filter("a IS NOT NULL AND b IS NOT NULL AND a <> b").groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.max("score").alias("score"))
    parts = components(used.filter(F.col("score") > threshold), "a", "b")
    inside = used.join(parts.select(F.col("node").alias("a"), "component"), "a").join(parts.select(F.col("node").alias("b"), F.col("component").alias("cb")), "b").filter("component = cb")

    def link(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        members = sorted(set(pdf["a"]) | set(pdf["b"]))
        groups = average_linkage(members, {(a, b): s for a, b, s in zip(pdf["a"], pdf["b"], pdf["score"])}, threshold)
        return pd.DataFrame([(m, g[0]) for g in groups for m in g], columns=["document_id", "first"])

    grouped = inside.select("component", "a", "b", "score").groupBy("component").applyInPandas(link, "document_id string, first string")
    every = ids.select("document_id").distinct().join(grouped, "document_id", "left").withColumn("first", F.coalesce("first", "document_id"))
    names = numbered(every.select("first").distinct(), None, "first", "place").select("first", F.format_string("CASE_%06d", "place").alias("case_id"))
    return every.join(names, "first").select("document_id", "case_id")


