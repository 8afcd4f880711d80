"""Sentence boundaries across languages and scripts, by a linear-chain model with Viterbi decoding.

A text's gaps, the places where a sentence could end, are tagged B (boundary) or I (inside): gaps after
an end mark with its closing quotes, gaps with a line break and, in scripts without end marks,
every blank. Emission weights come from the marks, words, character classes and quotes around the gap,
transitions from the tag before.

Training data are passages known to begin and end with a sentence (the evidence passages of a record): the gaps at
their edges are B for certain, all others unknown. A logistic model of "known to be B" is fitted,
its output divided by the share of true boundaries that are known (measured on the known ones, by kind of gap), and the
chain is trained by the averaged perceptron on the tags this gives (also B: marks that end nothing but sentences, outside
quotes, and gaps before words that are known to begin sentences elsewhere), once as written and once with the end marks
taken out before line breaks, so that unpunctuated lines and scripts are learned. At most SAMPLE texts
per script are used (a bounded, documented sample by hash order); every text is then decoded whole.

Null and blank texts give no row. Offsets count code points from 0, end exclusive, without surrounding white space.
"""

from __future__ import annotations

import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wrenmill.runtime import hash_sample, materialize

SAMPLE = 1500
EPOCHS = 4
START_SHARE = 0.12

# Character classes.
END_MARKS = "。！？；.!?…।॥｡"
OPENERS = "“‘「『《（(«„[【"
SURE_MARKS = "。；।॥｡！？"
CLOSERS = "”’」』》）)»]】\"'"
QUOTE_OPEN = {"“": "”", "‘": "’", "「": "」", "『": "』", "«": "»", "„": "“"}
BLANK_SCRIPTS = (("th", 0x0E00, 0x0E7F), ("lo", 0x0E80, 0x0EFF), ("km", 0x1780, 0x17FF), ("my", 0x1000, 0x109F))

SCRIPT_PATTERNS = (("th", "[฀-๿]"), ("hi", "[ऀ-ॿ]"), ("ja", "[぀-ヿ]"), ("zh", "[一-鿿]"))


def script_of(text: str) -> str:
    for name, pattern in SCRIPT_PATTERNS:
        if re.search(pattern, text):
            return name
    return "lat"


_KIND: dict[str, str] = {}


def kind(c: str) -> str:
    """Class of a character: L lower, U upper, 0 digit, C ideograph, K kana, T Thai and such, D Devanagari, or the mark itself."""
    k = _KIND.get(c)
    if k is None:
        n = ord(c)
        if any(a <= n <= b for _, a, b in BLANK_SCRIPTS):
            k = "T"
        elif 0x3040 <= n <= 0x30FF:
            k = "K"
        elif 0x0900 <= n <= 0x097F and n not in (0x0964, 0x0965):
            k = "D"
        elif 0x3400 <= n <= 0x9FFF:
            k = "C"
        elif c.isdigit():
            k = "0"
        elif c.isalpha():
            k = "U" if c.isupper() else "L"
        else:
            k = c
        _KIND[c] = k
    return k


_PLAIN: dict[str, str] = {}


def plain(c: str) -> str:
    """One character for comparison: compatibility form where that is one character, '' for invisible ones."""
    p = _PLAIN.get(c)
    if p is None:
        if c == "\n" or c == "\r":
            p = "\n"
        elif unicodedata.category(c) in ("Cf", "Cc", "Mn") and c not in "\t\x0b\x0c\x1c\x1d\x1e\x1f\x85":
            p = "" if unicodedata.category(c) != "Mn" or ord(c) < 0x370 else c
        elif c.isspace():
            p = " "
        elif c in "！？；，：（）":
            p = c
        else:
            n = unicodedata.normalize("NFKC", c)
            p = n if len(n) == 1 else c
        _PLAIN[c] = p
    return p


class Gaps:
    """Gaps of one text: end of the left part and start of the right part, in the text as given, and their features."""

    def __init__(self, text: str) -> None:
        shown = [(p, i) for i, c in enumerate(text) if (p := plain(c))]
        s = "".join(p for p, _ in shown)
        at = [i for _, i in shown]
        self.left: list[int] = []
        self.right: list[int] = []
        self.features: list[list[str]] = []
        self.kinds: list[str] = []
        self.after: list[str] = []
        self.plain_end: list[bool] = []
        script = script_of(s)
        n = len(s)
        i = 0
        stack: list[str] = []
        while i < n:
            c = s[i]
            if stack and c == stack[-1]:
                stack.pop()
            elif c in QUOTE_OPEN:
                stack.append(QUOTE_OPEN[c])
            elif c == '"':
                stack.append('"')
            j = i + 1
            if c == " " or c == "\n":
                i = j
                continue
            mark = c in END_MARKS
            if mark:
                while j < n and s[j] in END_MARKS:
                    j += 1
            k = j
            closed = ""
            while mark and k < n:
                if s[k] == " " and k + 1 < n and s[k + 1] == "»" and stack and stack[-1] == "»":
                    k += 1
                own = bool(stack) and s[k] == stack[-1]
                if not own and (s[k] not in CLOSERS or s[k] in "\"'"):
                    break
                if stack and s[k] == stack[-1]:
                    stack.pop()
                closed += s[k]
                k += 1
            e = k
            m = e
            while m < n and s[m] in " \n":
                m += 1
            if m >= n:
                break
            ws = s[e:m]
            lines = ws.count("\n")
            blank_script = bool(ws) and (kind(c) == "T" or kind(s[m]) == "T")
            inner = mark and j == k and not ws and s[i:j] == "." and i and kind(s[i - 1]) == "0" and kind(s[m]) == "0"
            if (mark and not inner) or lines or blank_script:
                if not (mark and not ws and s[m] in "，、,:：;"):
                    self._add(s, at, i, j, e, m, closed, len(stack), lines, mark, script)
            i = max(k, j)

    def _add(self, s: str, at: list[int], i: int, j: int, e: int, m: int, closed: str, depth: int, lines: int, mark: bool, script: str) -> None:
        marks = s[i:j] if mark else ""
        w = i if mark else i + 1
        a = w
        cls = kind(s[w - 1]) if w else "^"
        while a and a > w - 12 and s[a - 1] not in " \n" and (kind(s[a - 1]) not in "CKT" or w - a < 3):
            a -= 1
        before = re.sub(r"\d", "0", s[a:w].lower())
        b = m
        while b < len(s) and b < m + 12 and s[b] not in " \n" and (kind(s[b]) not in "CK" or b - m < 3):
            b += 1
        after = re.sub(r"\d", "0", s[m:b].lower())
        nk = kind(s[m])
        ws = "N" if lines > 1 else "n" if lines else "_" if m > e else ""
        number = bool(re.match(r"\d{1,3}(?:[)）]|\.(?!\d))", s[m : m + 5]))
        start = max(s.rfind("\n", 0, i), -1) + 1
        own = bool(mark and marks == "." and re.fullmatch(r"\d{1,3}", s[start:i].strip() or "x")) or bool(mark and marks == "." and re.search(r"(?:^|[.。！？!?；;])\s*\d{1,3}$", s[max(0, i - 8) : i]))
        base = f"{marks[:3]}|{ws}"
        f = [
            f"b {base}", f"k {base}|{cls}|{nk}", f"q {base}|{min(depth, 2)}|{closed[:1]}|{nk}", f"d {min(depth, 2)}",
            f"p {before}|{base[:1]}", f"a {after}|{base[:1]}", f"a4 {after[:4]}|{ws}", f"a2 {after[:2]}|{marks[:1]}", f"p2 {before[-2:]}|{marks[:1]}",
            f"pk {before}|{nk}|{marks[:1]}", f"ka {cls}|{after}|{marks[:1]}", f"c {closed[:1]}|{after[:6]}", f"n {number}|{ws}|{bool(marks)}", f"o {own}",
            f"l {min(len(before), 4)}|{marks[:1]}|{nk}|{cls}", f"s {script}|{base}|{nk}",
        ]
        if not mark:
            f += [f"pa {before[-3:]}|{after[:3]}", f"u {ws}|{cls}|{nk}|{script}", f"t5 {after[:6]}", f"t8 {after[:9]}"]
        self.left.append(at[e - 1] + 1)
        self.right.append(at[m])
        self.features.append(f)
        self.after.append("" if nk in "0L" else f"{script} {after}")  # small words and numbers begin no sentence by themselves
        self.plain_end.append(not depth and not closed and ((marks[:1] or "x") in SURE_MARKS or (marks[:1] in ("!", "?") and nk == "U" and m > e)))
        self.kinds.append(f"{marks[:1]}|{ws}|{nk}|{script}|{min(depth, 1)}|{closed[:1]}")


class Chain:
    """Weights by feature for tag B against I, and the transition weights [tag before][tag]."""

    def __init__(self, weight: dict[str, float], step: np.ndarray) -> None:
        self.weight, self.step = weight, step

    def decode(self, features: list[list[str]]) -> list[bool]:
        """The best tag sequence, by Viterbi."""
        if not features:
            return []
        w, step = self.weight, self.step
        b0, b1 = 0.0, 0.0
        back: list[tuple[int, int]] = []
        for t, f in enumerate(features):
            e = sum(w.get(x, 0.0) for x in f)
            if t == 0:
                b0, b1 = step[1][0], step[1][1] + e
                back.append((0, 0))
                continue
            i0, i1 = b0 + step[0][0], b1 + step[1][0]
            j0, j1 = b0 + step[0][1], b1 + step[1][1]
            back.append((int(i1 > i0), int(j1 > j0)))
            b0, b1 = max(i0, i1), max(j0, j1) + e
        tag = int(b1 > b0)
        out = [tag]
        for t in range(len(features) - 1, 0, -1):
            tag = back[t][tag]
            out.append(tag)
        return [bool(x) for x in reversed(out)]


def known_edges(text: str, gaps: Gaps, passages: list[str]) -> list[bool]:
    """Whether each gap is the edge of a passage that stands in the text."""
    starts, ends = set(), set()
    for p in passages:
        p = p.strip()
        a = text.find(p) if p else -1
        while a >= 0:
            starts.add(a)
            ends.add(a + len(p))
            a = text.find(p, a + 1)
    return [r in starts or e in ends for e, r in zip(gaps.left, gaps.right)]


def _logistic(rows: list[list[str]], y: np.ndarray, epochs: int = 6) -> np.ndarray:
    """Probabilities of y by a sparse logistic model fitted with Adagrad."""
    index: dict[str, int] = {}
    ids = [np.array([index.setdefault(f, len(index)) for f in r]) for r in rows]
    w, g = np.zeros(len(index)), np.full(len(index), 1e-6)
    rng = np.random.default_rng(3)
    for _ in range(epochs):
        for i in rng.permutation(len(ids)):
            x = ids[i]
            p = 1 / (1 + np.exp(-w[x].sum()))
            d = p - y[i]
            g[x] += d * d
            w[x] -= 0.15 * (d / np.sqrt(g[x]) + 1e-4 * w[x])
    return np.array([1 / (1 + np.exp(-w[x].sum())) for x in ids])


def strip_marks(text: str, ends: list[int], instead: str = "\n") -> str:
    """The text without the end marks right before the given places, `instead` standing for each."""
    out, last = [], 0
    for e in ends:
        a = e
        while a > last and text[a - 1] in END_MARKS:
            a -= 1
        out.append(text[last:a])
        out.append(instead)
        last = e
    out.append(text[last:])
    return "".join(out)


def fit(sample: list[tuple[str, list[str]]], epochs: int = EPOCHS) -> Chain:
    """The chain, from (text, passages) rows."""
    texts = [(t, Gaps(t), ps) for t, ps in sample if t and t.strip()]
    texts = [(t, g, ps) for t, g, ps in texts if g.left]
    if not texts:
        return Chain({}, np.zeros((2, 2)))
    known = [known_edges(t, g, ps) for t, g, ps in texts]
    flat = [f for _, g, _ in texts for f in g.features]
    kinds = [k for _, g, _ in texts for k in g.kinds]
    y = np.array([k for ks in known for k in ks], float)
    p = _logistic(flat, y)
    # the share of true boundaries that are known, by kind of gap with shrinkage to the overall one
    overall = float(p[y > 0].mean()) if y.any() else 1.0
    total, count = defaultdict(float), defaultdict(float)
    for k, v, q in zip(kinds, y, p):
        if v:
            total[k] += q
            count[k] += 1
    share = {k: (total[k] + 5 * overall) / (count[k] + 5) for k in count}
    tag = (y > 0) | (p > 0.5 * np.array([min(overall, share.get(k, overall)) for k in kinds]))
    # sentences that seldom or never are passages: marks that are no abbreviation's, and beginnings known from elsewhere
    after = [x for _, g, _ in texts for x in g.after]
    seen, begun = defaultdict(int), defaultdict(float)
    for x, v in zip(after, y):
        seen[x] += 1
        begun[x] += v
    start = np.array([bool(x) and seen[x] >= 3 and begun[x] / seen[x] > START_SHARE for x in after])
    tag |= start | np.array([v for _, g, _ in texts for v in g.plain_end])
    chains: list[tuple[list[list[str]], list[bool]]] = []
    at = 0
    rng = np.random.default_rng(5)
    for t, g, _ in texts:
        tags = tag[at : at + len(g.left)].tolist()
        at += len(g.left)
        chains.append((g.features, tags))
        ends = [e for e, b in zip(g.left, tags) if b]
        if ends and rng.random() < 0.3:
            # in scripts that set sentences apart by blanks a blank stands for the mark or line break, in others a line break
            bare = strip_marks(t, ends, " " if script_of(t) == "th" else "\n")
            h = Gaps(bare)
            if h.left:
                goals, seen, shift = set(), 0, 0
                for e in ends:
                    a = e
                    while a > seen and t[a - 1] in END_MARKS:
                        a -= 1
                    goals.add(a + shift)
                    shift += a - e + 1
                    seen = e
                chains.append((h.features, [e in goals for e in h.left]))
    return _perceptron(chains, epochs)


def _perceptron(chains: list[tuple[list[list[str]], list[bool]]], epochs: int) -> Chain:
    w: dict[str, float] = defaultdict(float)
    total: dict[str, float] = defaultdict(float)
    step, step_total = np.zeros((2, 2)), np.zeros((2, 2))
    model = Chain(w, step)
    rng = np.random.default_rng(11)
    now = 0
    for _ in range(epochs):
        for i in rng.permutation(len(chains)):
            features, tags = chains[i]
            got = model.decode(features)
            now += 1
            if got == tags:
                continue
            a = b = 1
            for f, g, t in zip(features, got, tags):
                step[a][int(g)] -= 1
                step_total[a][int(g)] -= now
                step[b][int(t)] += 1
                step_total[b][int(t)] += now
                a, b = int(g), int(t)
                if g != t:
                    d = 1.0 if t else -1.0
                    for x in f:
                        w[x] += d
                        total[x] += d * now
    mean = {k: v - total[k] / (now + 1) for k, v in w.items()}
    return Chain({k: v for k, v in mean.items() if abs(v) > 1e-9}, step - step_total / (now + 1))


def spans(text: str, chain: Chain) -> list[tuple[int, int]]:
    """(start, end) of each sentence, by code points."""
    gaps = Gaps(text)
    cuts = [(e, r) for e, r, b in zip(gaps.left, gaps.right, chain.decode(gaps.features)) if b]
    out, start = [], 0
    for e, r in [*cuts, (len(text), len(text))]:
        a, b = start, e
        while a < b and (text[a].isspace() or not plain(text[a])):
            a += 1
        while b > a and (text[b - 1].isspace() or not plain(text[b - 1])):
            b -= 1
        if a < b:
            out.append((a, b))
        start = r
    return out


def training_sample(texts: DataFrame, passages: DataFrame, key: str, text: str, passage: str, most: int = SAMPLE) -> list[tuple[str, list[str]]]:
    """At most `most` texts per script in the order of a hash, with their passages; bounded whatever the input."""
    script = F.lit("lat")
    for name, pattern in reversed(SCRIPT_PATTERNS):
        script = F.when(F.col("__t").rlike(pattern), name).otherwise(script)
    rows = texts.filter(F.col(key).isNotNull() & F.col(text).isNotNull()).groupBy(F.col(key).alias("__k")).agg(F.min(text).alias("__t")).withColumn("__s", script)
    rows = materialize(rows.join(passages.select(F.col(key).alias("__k")).distinct(), "__k", "left_semi"), "p2-texts")
    picked = None
    for name in [n for n, _ in SCRIPT_PATTERNS] + ["lat"]:
        some = hash_sample(rows.filter(F.col("__s") == name), ["__k"], most * (2 if name == "lat" else 1))
        picked = some if picked is None else picked.unionByName(some)
    ps = passages.filter(F.col(passage).isNotNull()).select(F.col(key).alias("__k"), F.col(passage).alias("__p")).distinct()
    full = picked.join(ps, "__k").groupBy("__k", "__t").agg(F.sort_array(F.collect_list("__p")).alias("ps"))
    return [(r[0], list(r[1])) for r in full.orderBy("__k").select("__t", "ps").collect()]


def split(texts: DataFrame, key: str, text: str, chain: Chain) -> DataFrame:
    """(row_key, start_pos, end_pos): one row per sentence of each distinct (key, text)."""
    rows = texts.filter(F.col(text).isNotNull() & F.col(key).isNotNull()).select(F.col(key).cast("string").alias("row_key"), F.col(text).alias("__t")).distinct()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            keys, starts, ends = [], [], []
            for k, t in zip(pdf["row_key"], pdf["__t"]):
                for a, b in spans(t, chain):
                    keys.append(k)
                    starts.append(a)
                    ends.append(b)
            yield pd.DataFrame({"row_key": keys, "start_pos": np.array(starts, "int32"), "end_pos": np.array(ends, "int32")})

    return rows.mapInPandas(run, "row_key string, start_pos int, end_pos int")
