"""Mixing sources to target weights of the total size in tokens.

Every document has a soft membership in the sources of the target table: the posterior of a multinomial classifier of its text, trained on
documents with a stored source, times what a stored source says. Labels are trusted as far as they prove right: the rate at which they err is
estimated by EM over the sample from where they disagree with the text, so a clean label leaves little to the text, and a document
without one is placed by its text alone. The classifier's posteriors are tempered by the power that gives held-out labels the highest likelihood.

Nonnegative rates, the times a document is used, are fitted by projected gradient least squares so that the expected tokens of each source
match its target; a rate never passes the cap of the source it most likely belongs to, nor that of a stored one. One iteration sums the tokens of each
source in the cluster and sends back one number per source; rates are functions of that history, so no state per document is kept
between iterations. Rates are drawn as whole copies by a hash of the id, the same in every run; the cut of the hash is
then set per source from a histogram, so that the drawn tokens, not only the expected ones, meet the rates.

The total defaults to the largest that all sources with documents can serve within their caps. Documents of sources
without a target, and texts without tokens, are not used. A source without documents reaches a share of 0 and is reported so.
Targets with a null share or source are left out; repeated target rows count once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wrenmill.llm import bpe, subjects
from wrenmill.runtime import hash_sample, materialize, release

#: Most labelled documents the classifier of sources is fitted on; a fifth of them is held out for its temper and the label error.
SAMPLE = 20_000
ITERATIONS = 12
TOLERANCE = 1e-4
#: Share of the total that small sources may together fall short of rather than hold the rest back.
SLACK = 0.0
#: Label error to start from, and the bins of the histogram of the draw.
ERROR, BINS = 0.02, 4096


def train(bag: subjects.Bag, y: np.ndarray, classes: int) -> np.ndarray:
    """Log weights (classes x buckets) of a multinomial classifier of sources, from documents of the classes y."""
    one = (np.arange(classes)[:, None] == y[None, :]).astype(float)
    counts = bag.counts(one[:, bag.document]) + 0.1
    return np.log(counts / counts.sum(1, keepdims=True)).astype(np.float32)


class Members:
    """Classifier of sources: weights, prior, temper, and how often a stored source is wrong."""

    def __init__(self, weight: np.ndarray, prior: np.ndarray, temper: float = 1.0, error: float = ERROR) -> None:
        self.weight, self.prior, self.temper, self.error = weight, prior, temper, error

    def by_text(self, bag: subjects.Bag) -> np.ndarray:
        """Posteriors (classes x documents) of the text alone."""
        s = bag.per_document(bag.sums(self.weight), np.add)
        return subjects.softmax(self.temper * s + np.log(np.maximum(self.prior, 1e-300))[:, None]) * (self.prior > 0)[:, None]

    def of(self, bag: subjects.Bag, stored: np.ndarray) -> np.ndarray:
        """Posteriors of text and stored source (its position, -1 for none)."""
        p = self.by_text(bag)
        k = len(p)
        says = np.where(np.arange(k)[:, None] == stored[None, :], 1 - self.error, self.error / max(1, k - 1))
        p = p * np.where(stored[None, :] >= 0, says, 1.0)
        return p / np.maximum(p.sum(0), 1e-300)


def fit_members(bag: subjects.Bag, y: np.ndarray, rest: subjects.Bag, z: np.ndarray, classes: int) -> Members:
    """The classifier of (bag, y) with temper and label error from the held-out (rest, z)."""
    # a source without any document has no members: nothing says what its texts would be
    prior = np.bincount(np.r_[y, z], minlength=classes) / max(1, len(y) + len(z))
    model = Members(train(bag, y, classes), prior)
    if len(z):
        at = np.arange(len(z))

        def likelihood(temper: float) -> float:
            model.temper = temper
            return float(np.log(np.maximum(model.by_text(rest)[z, at], 1e-12)).mean())

        model.temper = max((*(2.0**-i for i in range(12)), 0.0), key=likelihood)
        for _ in range(10):
            model.error = float(np.clip(1 - model.of(rest, z)[z, at].mean(), 1e-4, 0.5))
    return model


def _members(model: Members | None, sources: list[str]):
    at = {s: i for i, s in enumerate(sources)}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            stored = np.array([at.get(s, -1) if isinstance(s, str) else -1 for s in pdf["source"]], np.int64)
            if model is None:
                m = (np.arange(len(sources))[None, :] == stored[:, None]).astype(float)
            else:
                m = model.of(subjects.Bag(list(pdf["lens"]), list(pdf["toks"])), stored).T
            main = np.where(stored >= 0, stored, m.argmax(1) if len(m) else 0)
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "main": main.astype("int32"), "m": list(m)})

    return run


def _totals(history: list[np.ndarray], caps: np.ndarray, start: float):
    """Expected tokens of each source under the rates that the history of steps leads to."""
    k = len(caps)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(k)
        for pdf in batches:
            if len(pdf):
                m = np.array(pdf["m"].tolist())
                total += (rates(m, pdf["main"].to_numpy(), history, caps, start) * pdf["n_tokens"].to_numpy()) @ m
        yield pd.DataFrame({"s": range(k), "tokens": total})

    return run


def rates(m: np.ndarray, main: np.ndarray, history: list[np.ndarray], caps: np.ndarray, start: float) -> np.ndarray:
    """Projected gradient: after every step back into [0, cap of the main source]."""
    cap = caps[main]
    r = np.minimum(start, cap)
    for step in history:
        r = np.clip(r + m @ step, 0.0, cap)
    return r


def default_total(most: np.ndarray, share: np.ndarray, slack: float) -> float:
    """The largest total that all sources but some of together at most `slack` of the target can serve."""
    short = 0.0
    for i in np.argsort(np.where(share > 0, most / np.maximum(share, 1e-12), np.inf)):
        if share[i] > 0 and most[i] > 0 and short + share[i] > slack:
            return float(most[i] / share[i])
        short += share[i]
    return 0.0


def mix(documents: DataFrame, targets: DataFrame, total: float | None = None, slack: float = SLACK, tokenizer: str | None = None, iterations: int = ITERATIONS) -> tuple[DataFrame, DataFrame]:
    """(doc_id, source, n_tokens, rate, copies) of every document used, and per source target and reached share."""
    spark = documents.sparkSession
    wanted = targets.filter("source IS NOT NULL AND target_share IS NOT NULL").groupBy("source").agg(F.max("target_share").alias("w"), F.max("max_repeats").alias("c"))
    rows = wanted.orderBy("source").collect()
    sources = [r["source"] for r in rows]
    share = np.array([r["w"] for r in rows], float)
    caps = np.array([r["c"] if r["c"] is not None else 1 for r in rows], float)
    k = len(sources)
    docs = documents.filter("doc_id IS NOT NULL AND text IS NOT NULL")
    tokens = subjects.tokenized(docs.filter(F.col("source").isNull() | F.col("source").isin(sources)), "text", "doc_id", "source")
    rows = hash_sample(tokens.filter("source IS NOT NULL"), ["doc_id"], SAMPLE).toPandas()
    model = None
    if len(rows):
        y = np.array([sources.index(x) for x in rows["source"]])
        held = np.arange(len(rows)) % 5 == 4
        bag = lambda some: subjects.Bag(list(rows["lens"][some]), list(rows["toks"][some]))
        model = fit_members(bag(~held), y[~held], bag(held), y[held], k)
    counted = bpe.encode(docs, "doc_id", "text", tokenizer, count_only=True).filter("n_tokens > 0")
    members = tokens.mapInPandas(_members(model, sources), "doc_id bigint, main int, m array<double>")
    base = materialize(counted.join(members, "doc_id"), "p9-members")
    release(tokens)

    def totals(history: list[np.ndarray], start: float) -> np.ndarray:
        sums = base.select("main", "m", "n_tokens").mapInPandas(_totals(history, caps, start), "s int, tokens double").groupBy("s").agg(F.sum("tokens").alias("t")).collect()
        out = np.zeros(k)
        for r in sums:
            out[r["s"]] = r["t"]
        return out

    have = totals([], 1.0)
    most = have * caps
    open_ = (most > 0) & (share > 0)
    budget = float(total) if total else default_total(most, share, slack)
    goal = share * budget
    history: list[np.ndarray] = []
    for _ in range(iterations):
        reached = totals(history, 1.0)
        gap = np.where(open_, goal - reached, 0.0)
        if budget <= 0 or np.abs(gap).max() <= TOLERANCE * budget:
            break
        history.append(np.where(have > 0, gap / np.maximum(have, 1e-9), 0.0))
    schema = "doc_id bigint, n_tokens bigint, rate double, main int"

    def rate(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                main = pdf["main"].to_numpy()
                r = rates(np.array(pdf["m"].tolist()), main, history, caps, 1.0) if budget > 0 else np.zeros(len(main))
                yield pd.DataFrame({"doc_id": pdf["doc_id"], "n_tokens": pdf["n_tokens"], "rate": r, "main": main})

    # a document gets the copy of its fraction if its hash, in units of the fraction, lies below the cut of its source (1 by expectation)
    hashed = F.pmod(F.xxhash64("doc_id", F.lit(17)), F.lit(1 << 40)) / F.lit(float(1 << 40))
    fraction = (F.col("rate") - F.floor("rate")).alias("fraction")
    rated = materialize(base.mapInPandas(rate, schema).select("*", fraction).withColumn("place", F.when(F.col("fraction") > 1e-9, hashed / F.col("fraction"))), "p9-rates")
    binned = F.least(F.lit(2 * BINS), F.floor(F.col("place") * BINS)).cast("int")
    hist = rated.filter("place IS NOT NULL").groupBy("main", binned.alias("bin")).agg(F.sum("n_tokens").alias("t"), F.sum(F.col("n_tokens") * F.col("fraction")).alias("want")).toPandas()
    cuts = np.ones(k)
    for c, part in hist.groupby("main"):
        part = part.sort_values("bin")
        reached = np.r_[0.0, part["t"].cumsum().to_numpy(float)]
        cuts[c] = np.r_[0, part["bin"].to_numpy() + 1][np.abs(reached - part["want"].sum()).argmin()] / BINS
    cut = F.element_at(F.array(*[F.lit(float(x)) for x in cuts]), F.col("main") + 1) if k else F.lit(1.0)
    named = F.element_at(F.array(*[F.lit(x) for x in sources]), F.col("main") + 1) if k else F.lit(None).cast("string")
    drawn = rated.withColumn("copies", (F.floor("rate") + F.when(F.col("place") < cut, 1).otherwise(0)).cast("bigint")).withColumn("source", named)
    used = drawn.filter("copies > 0").select("doc_id", "source", "n_tokens", F.round("rate", 6).alias("rate"), "copies")
    sums = used.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("tokens"), F.count(F.lit(1)).alias("n_documents"), F.max("copies").alias("most_copies"))
    plan = spark.createDataFrame([(s, float(w), int(c)) for s, w, c in zip(sources, share, caps)], "source string, target_share double, max_repeats bigint")
    whole = sums.agg(F.sum("tokens").alias("whole"))
    n = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    report = plan.join(sums, "source", "left").crossJoin(F.broadcast(whole)).select(
        "source", "target_share", F.round(F.coalesce(F.try_divide("tokens", "whole"), F.lit(0.0)), 6).alias("reached_share"), "max_repeats", n("most_copies"), n("n_documents"), n("tokens")
    )
    return used, report
