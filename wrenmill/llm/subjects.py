"""Subject areas of documents: complement naive Bayes, refined by expectation-maximization, with calibrated posteriors.

A document may treat several subjects, so the model works on segments (sentences, or phrases in scripts without
end marks). Every text is cut and hashed once into a table of token numbers; all passes read that table.
1. From labelled documents: segment tokens counted for the document's labels, complement naive Bayes weights, a few EM rounds within the
allowed labels. 2. EM over all documents: every segment, labelled or not, adds its tokens to every class by its
posterior, the more the less its entropy (a segment without any subject adds next to nothing); the E-step is one narrow pass, the M-step one aggregation of per-task count matrices of fixed size. 3. A segment that names a subject in
passing is told by a logistic model of its tokens, learned from segments whose subject the annotators did not give. 4. Independent posteriors: for
each subject a logistic calibration of its evidence, drawn towards the one of all subjects where labels are few.

Stages 3 and 4 are fitted on held-out evidence: every labelled document is judged by the class counts less what it has added to them itself,
by its labels and in the corpus, which naive Bayes counts allow without fitting again.

Tokens are hashed into BUCKETS, so the broadcast model has a fixed size (BUCKETS x classes floats). At most SAMPLE
labelled documents are used, in hash order; everything else covers all documents. Null, blank and
subjectless texts get no row; labels with a null or unknown subject are left out; disputed labels need half of the document's annotators.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wrenmill.llm.entity_match import clean
from wrenmill.runtime import hash_sample, materialize

BUCKETS = 1 << 16
SAMPLE = 20_000
ALPHA = 0.05
LABEL_ROUNDS = 4
CORPUS_ROUNDS = 2
#: A segment's evidence for a subject counts towards the sum from here on; the strongest segment always counts.
STRONG = 0.3
#: A segment's subject is taken as known in the model of passing remarks from this posterior on.
SURE = 0.8
#: The shared calibration counts as much as so many labelled documents of a subject.
SHARED = 30.0

_cut = re.compile(r"[。！？；!?;\n।|]+|(?<=[a-zß-ÿ%℃\d)])\.\s+|\.\.\.|…+")
_thai = re.compile(r"[฀-๿]")
_pieces = re.compile(r"[a-zà-öø-ÿœß]{2,}(?:-[a-zà-öø-ÿœß]+)*|[ऀ-ॣ]+|[一-鿿]+|[぀-ヿ一-鿿]+|[฀-๿]+")


def segments(text: str) -> list[str]:
    c = clean(text)
    parts = _cut.split(c)
    if _thai.search(c):
        parts = [x for p in parts for x in (re.split(r"\s+", p) if _thai.search(p) else [p])]
    return [p for p in parts if p and p.strip()]


def buckets(segment: str) -> np.ndarray:
    """Hashed distinct tokens of a segment: words and neighbouring words, pairs and triples of characters in scripts without blanks."""
    out: set[str] = set()
    last = ""
    for w in _pieces.findall(segment):
        n = ord(w[0])
        if n < 0x980:
            out.add(w)
            if last:
                out.add(last + " " + w)
            last = w
        else:
            last = ""
            size = 3 if 0xE00 <= n < 0xE80 else 2
            out.update(w[i : i + size] for i in range(max(1, len(w) - size + 1)))
            if size == 3:
                out.update(w[i : i + 5] for i in range(max(0, len(w) - 4)))
            else:
                out.update(w[i : i + 3] for i in range(max(0, len(w) - 2)))
    return np.array(sorted({zlib.crc32(x.encode("utf-8", "surrogatepass")) % BUCKETS for x in out}), np.int64)



# --- token tables -------------------------------------------------------------------------------------------


def numbers(text: str) -> tuple[list[int], np.ndarray]:
    """Tokens of each segment of a text: their counts, and the token numbers end to end."""
    parts = [x for x in (buckets(s) for s in segments(text)) if len(x)]
    return [len(x) for x in parts], np.concatenate(parts) if parts else np.zeros(0, np.int64)


def tokenized(documents: DataFrame, text: str, *keep: str) -> DataFrame:
    """keep, lens, toks of every row whose text is not null; written once for all passes."""
    source = documents.filter(F.col(text).isNotNull()).select(*keep, F.col(text).alias("__text"))
    kinds = ", ".join(f"`{c}` {documents.schema[c].dataType.simpleString()}" for c in keep)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [numbers(t) for t in pdf["__text"]]
            out = pdf[list(keep)].copy()
            out["lens"], out["toks"] = [r[0] for r in rows], [r[1] for r in rows]
            yield out

    return materialize(source.mapInPandas(run, f"{kinds}, lens array<int>, toks array<int>"), "tokens")


class Bag:
    """The segments of many documents as flat arrays: tokens, the segment of each token and the document of each segment."""

    def __init__(self, lens: list, toks: list) -> None:
        counts = [len(x) for x in lens]
        self.documents = len(counts)
        size = np.concatenate([np.asarray(x, np.int64) for x in lens]) if sum(counts) else np.zeros(0, np.int64)
        self.tok = np.concatenate([np.asarray(x, np.int64) for x in toks]) if len(size) else np.zeros(0, np.int64)
        self.start = np.cumsum(size) - size
        self.segment = np.repeat(np.arange(len(size)), size)
        self.document = np.repeat(np.arange(len(counts)), counts)

    def sums(self, weight: np.ndarray) -> np.ndarray:
        """Sum of each row of weight over the tokens of each segment: rows x segments."""
        if not len(self.start):
            return np.zeros((len(weight), 0))
        return np.stack([np.add.reduceat(w[self.tok], self.start) for w in weight]).astype(np.float64)

    def counts(self, share: np.ndarray) -> np.ndarray:
        """Tokens counted by the shares (rows x segments) of their segments: rows x BUCKETS."""
        return np.stack([np.bincount(self.tok, p[self.segment], BUCKETS) for p in share])

    def per_document(self, value: np.ndarray, how: np.ufunc) -> np.ndarray:
        """rows x documents: how (maximum or add) over the segments of each document, 0 without any."""
        out = np.zeros((len(value), self.documents))
        if len(self.document):
            first = np.r_[0, np.flatnonzero(np.diff(self.document)) + 1]
            out[:, self.document[first]] = how.reduceat(value, first, axis=1)
        return out


# --- the model ----------------------------------------------------------------------------------------------


def softmax(s: np.ndarray) -> np.ndarray:
    e = np.exp(s - s.max(0, keepdims=True)) if s.size else s
    return e / e.sum(0, keepdims=True) if s.size else s


def complement(counts: np.ndarray) -> np.ndarray:
    """Weights (classes x buckets) of complement naive Bayes: how rare a token is in all other classes."""
    rest = counts.sum(0, keepdims=True) - counts + ALPHA
    weight = np.log(rest / rest.sum(1, keepdims=True))
    return (weight.mean(0, keepdims=True) - weight).astype(np.float32)


class Model:
    """Class counts per bucket, the complement weights derived from them, and the two logistic stages."""

    def __init__(self, counts: np.ndarray) -> None:
        self.counts = counts
        self.weight = complement(counts)
        self.passing = np.zeros(BUCKETS, np.float32)
        self.bias = 3.0
        self.calibration = np.tile([-4.0, 6.0, 0.5], (len(counts), 1))

    def posterior(self, bag: Bag) -> np.ndarray:
        return softmax(bag.sums(self.weight))

    def evidence(self, bag: Bag, posterior: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Per subject and document the strongest segment, and the log of the sum of the strong ones."""
        kept = 1 / (1 + np.exp(-(self.bias + bag.sums(self.passing[None, :]))))
        p = (self.posterior(bag) if posterior is None else posterior) * kept
        return bag.per_document(p, np.maximum), np.log1p(bag.per_document(np.where(p > STRONG, p, 0), np.add))

    def chances(self, bag: Bag) -> np.ndarray:
        """Subjects x documents."""
        top, total = self.evidence(bag)
        a, b, c = self.calibration.T[:, :, None]
        return (top > 0) / (1 + np.exp(-(a + b * top + c * total)))


def train(bag: Bag, labels: np.ndarray, rounds: int = LABEL_ROUNDS) -> Model:
    """Complement naive Bayes from labelled documents (labels: classes x documents), with EM over which label each segment belongs to."""
    allowed = labels[:, bag.document]
    model = Model(bag.counts(allowed / np.maximum(1, allowed.sum(0))))
    for _ in range(rounds):
        model = Model(bag.counts(softmax(np.where(allowed, bag.sums(model.weight), -1e9)) * allowed))
    return model


def shares(model: Model, bag: Bag) -> np.ndarray:
    """What each segment adds to each class: its posterior, weighted by how far its entropy stays under the highest possible."""
    p = model.posterior(bag)
    entropy = -(p * np.log(np.maximum(p, 1e-12))).sum(0)
    return p * (1 - entropy / np.log(max(2, len(p))))


def refine_corpus(tokens: DataFrame, model: Model, rounds: int = CORPUS_ROUNDS) -> tuple[Model, float]:
    """EM over all documents, and the weight of a corpus count. Tasks return count matrices of fixed size, summed in the cluster by bucket."""
    labelled, scale = model.counts, 0.0
    k = len(labelled)
    for _ in range(rounds):
        weight = model.weight

        def expect(batches: Iterator[pd.DataFrame], weight: np.ndarray = weight) -> Iterator[pd.DataFrame]:
            m = Model(np.ones((k, 1)))
            m.weight = weight
            counts = np.zeros((k, BUCKETS))
            for pdf in batches:
                bag = Bag(list(pdf["lens"]), list(pdf["toks"]))
                if len(bag.start):
                    counts += bag.counts(shares(m, bag))
            at = np.flatnonzero(counts.sum(0))
            for i in range(0, len(at), 5000):
                yield pd.DataFrame({"b": at[i : i + 5000], "n": list(counts[:, at[i : i + 5000]].T)})

        part = tokens.select("lens", "toks").mapInPandas(expect, "b bigint, n array<double>")
        sums = part.groupBy("b").agg(F.array(*[F.sum(F.col("n")[i]) for i in range(k)]).alias("n")).toPandas()
        counts = np.zeros((k, BUCKETS))
        if len(sums):
            counts[:, sums["b"].to_numpy()] = np.array(sums["n"].tolist()).T
        # labelled counts keep a say of their own
        scale = min(1.0, 4 * labelled.sum() / max(1.0, counts.sum()))
        model = Model(labelled + counts * scale)
    return model, scale


def held_out(model: Model, bag: Bag, labels: np.ndarray, scale: float) -> np.ndarray:
    """Posteriors of labelled segments, each document judged without its own part of the counts."""
    k = len(model.counts)
    allowed = labels[:, bag.document]
    added = softmax(np.where(allowed, bag.sums(model.weight), -1e9)) * allowed + scale * shares(model, bag)
    norm = (model.counts.sum(0) - model.counts + ALPHA).sum(1)
    score = np.zeros((k, len(bag.start)))
    ends = np.searchsorted(bag.document[bag.segment], np.arange(bag.documents + 1))
    for a, b in zip(ends, ends[1:]):
        if a == b:
            continue
        segment = bag.segment[a:b]
        own, at = np.unique(bag.tok[a:b], return_inverse=True)
        mine = np.stack([np.bincount(at, added[c, segment], len(own)) for c in range(k)])
        counts = np.maximum(model.counts[:, own] - mine, 0)
        weight = np.log((counts.sum(0) - counts + ALPHA) / norm[:, None])
        first = np.r_[0, np.flatnonzero(np.diff(segment)) + 1]
        score[:, segment[first]] = np.add.reduceat((weight.mean(0) - weight)[:, at], first, axis=1)
    return softmax(score)


def _logistic(x: np.ndarray, y: np.ndarray, center: np.ndarray | None = None, pull: float = 0.1) -> np.ndarray:
    """Weights of a logistic model, drawn towards center."""
    center = np.zeros(x.shape[1]) if center is None else center
    w = center.copy()
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + pull * np.eye(len(w))
        step = np.linalg.solve(h, x.T @ (p - y) + pull * (w - center))
        w -= step
        if np.abs(step).max() < 1e-7:
            break
    return w


def passing_remarks(bag: Bag, p: np.ndarray, labels: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights and bias of the logistic model of segments whose sure subject is one of the document's, by Adagrad over their tokens; p: posteriors."""
    sure = np.flatnonzero(p.max(0) > SURE) if p.size else []
    ends = np.r_[bag.start[1:], len(bag.tok)]
    xs = [bag.tok[bag.start[i] : ends[i]] for i in sure]
    ys = [float(labels[p[:, i].argmax(), bag.document[i]]) for i in sure]
    w, g = np.zeros(BUCKETS), np.full(BUCKETS, 1e-6)
    bias, gb = 2.0, 1e-6
    rng = np.random.default_rng(1)
    for _ in range(6):
        for i in rng.permutation(len(xs)):
            x = xs[i]
            p = 1 / (1 + np.exp(-(bias + w[x].sum())))
            d = p - ys[i]
            g[x] += d * d
            gb += d * d
            w[x] -= 0.1 * (d / np.sqrt(g[x]) + 2e-3 * w[x])
            bias -= 0.1 * d / np.sqrt(gb)
    return w.astype(np.float32), float(bias)


def calibrate(model: Model, bag: Bag, p: np.ndarray, y: np.ndarray) -> np.ndarray:
    """A calibration (classes x 3) for each subject, from the evidence that the posteriors p leave."""
    top, total = model.evidence(bag, p)
    x = np.stack([np.ones(top.shape), top, total], 2)
    flat = y.reshape(-1).astype(float)
    if not flat.size or flat.min() == flat.max():
        return model.calibration
    shared = _logistic(x.reshape(-1, 3), flat)
    # the pull is that of SHARED documents at a middling posterior
    return np.stack([_logistic(x[c], y[c].astype(float), shared, 0.25 * SHARED) for c in range(len(y))])


# --- the operator -------------------------------------------------------------------------------------------


def labelled_sample(documents: DataFrame, labels: DataFrame, areas: DataFrame, most: int = SAMPLE) -> tuple[list[tuple[str, list[int]]], list[int]]:
    """At most `most` labelled texts in hash order with their subjects as positions in the ordered list of subject ids."""
    ids = [(r[0], r[1]) for r in areas.filter("subject_id IS NOT NULL").select("subject_id", "subject_name").distinct().orderBy("subject_id").collect()]
    at = {name: i for i, (_, name) in enumerate(ids)}
    votes = (
        labels.filter("doc_id IS NOT NULL AND subject_name IS NOT NULL").filter(F.col("subject_name").isin(list(at)))
        .groupBy("doc_id", "subject_name").agg(F.countDistinct("annotator").alias("v"))
    )
    voters = labels.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.countDistinct("annotator").alias("n"))
    agreed = votes.join(voters, "doc_id").filter(F.col("v") * 2 >= F.col("n")).groupBy("doc_id").agg(F.sort_array(F.collect_set("subject_name")).alias("s"))
    rows = hash_sample(documents.filter("text IS NOT NULL").select("doc_id", "text").join(agreed, "doc_id"), ["doc_id"], most)
    return [(r["text"], [at[s] for s in r["s"]]) for r in rows.collect()], [i for i, _ in ids]


def fit(documents: DataFrame, labels: DataFrame, areas: DataFrame, tokens: DataFrame) -> tuple[Model | None, list[int]]:
    """The calibrated model of all labels; tokens: tokenized() documents."""
    sample, ids = labelled_sample(documents, labels, areas)
    if not sample or not ids:
        return None, ids

    cut = [numbers(t) for t, _ in sample]
    y = np.zeros((len(ids), len(sample)), bool)
    for i, (_, own) in enumerate(sample):
        y[own, i] = True
    bag = Bag([c[0] for c in cut], [c[1] for c in cut])
    model, scale = refine_corpus(tokens, train(bag, y))
    p = held_out(model, bag, y, scale)
    model.passing, model.bias = passing_remarks(bag, p, y)
    model.calibration = calibrate(model, bag, p, y)
    return model, ids


def assign(tokens: DataFrame, model: Model | None, ids: list[int], least: float = 0.5) -> DataFrame:
    """(doc_id, subject_id, posterior): the subjects of each document whose posterior reaches `least`; tokens: tokenized() documents."""
    schema = "doc_id bigint, subject_id bigint, posterior double"
    if model is None:
        return tokens.sparkSession.createDataFrame([], schema)
    weight, passing, bias, calibration = model.weight, model.passing, model.bias, model.calibration
    named = np.array(ids)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = Model(np.ones((len(weight), 1)))
        m.weight, m.passing, m.bias, m.calibration = weight, passing, bias, calibration
        for pdf in batches:
            p = m.chances(Bag(list(pdf["lens"]), list(pdf["toks"])))
            c, d = np.nonzero(p >= least)
            yield pd.DataFrame({"doc_id": pdf["doc_id"].to_numpy()[d], "subject_id": named[c], "posterior": p[c, d]})

    return tokens.select("doc_id", "lens", "toks").mapInPandas(run, schema)


def subjects(documents: DataFrame, labels: DataFrame, areas: DataFrame, least: float = 0.5) -> DataFrame:
    """(doc_id, subject_id, posterior) of all documents."""
    tokens = tokenized(documents, "text", "doc_id")
    return assign(tokens, *fit(documents, labels, areas, tokens), least)


def composition(assigned: DataFrame, areas: DataFrame) -> DataFrame:
    """Documents per subject and their share of all assignments."""
    counts = assigned.groupBy("subject_id").agg(F.count(F.lit(1)).alias("n_documents"))
    total = counts.agg(F.sum("n_documents").alias("total"))
    named = areas.select("subject_id", "subject_name").join(counts, "subject_id", "left").crossJoin(F.broadcast(total))
    n = F.coalesce("n_documents", F.lit(0))
    return named.select("subject_id", "subject_name", n.alias("n_documents"), F.round(F.try_divide(n, F.col("total")), 6).alias("share"))
