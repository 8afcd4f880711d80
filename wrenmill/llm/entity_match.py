"""Matching entities across sources without keys: records and work orders of one shop event.

Both sides become bags of attribute tokens: engine number, day, measured numbers, words, word beginnings (abbreviations) and
character pairs. An entry is a query of its tokens to the inverted index of the records, every token weighted by its BM25 idf
over all records (one occurrence of a token counts, length does not: b = 0) and by a weight of its attribute. A written engine
number stands for the known ones that equal it or share a deletion of one digit (a wrong, lost or doubled digit, two swapped), a written day
for the records of that day and the REACH days before. The score is a share of what the entry could reach at most.

Retrieval is exact for all pairs whose score reaches the entry's bound: LEAST, or the best score found so far less WIDE, whichever is
more (a runner-up further off changes nothing, gaps count up to WIDE). First come the pairs that agree in engine and day; they set the bounds. Then, for records that
agree in engine alone, day alone or neither, the tokens of the entry are taken from the rarest on until those left out, with what
engine and day could add, stay under the bound; only postings of (engine, token), (day, token) or (token) are read. A record
outside shares no such token, so its score is below the bound.

A match is mutual: the record is nearest to the entry, or equal to the nearest within TIE, and of the record's entries none is nearer by more than APART. Confidence is a
logistic function of the score's parts and its gap to the runner-up, calibrated against decoys: entries recombined at random from the attributes of three different
ones, whose nearest records are wrong for certain. With the odds o of real against decoy, and the share of real entries that behave
like decoys, the confidence is 1 - share / o, divided among the records within TIE that are not copies of each other (filed again), as only one of them is meant.

What agrees by chance grows with the tables: with many engines a wrong digit meets another engine of that day, with many records of a day the words meet another record.
So the logistic weighs words, numbers and gap apart for records that agree in engine and day, in engine alone and in no engine, and the share is that of entries with the same attributes.
A record whose engine or day contradicts the entry's has a share of 1.

Rows with a null id are left out; null or empty attributes are missing evidence, never a match. Repeated rows count once.
An empty side gives an empty result.
"""

from __future__ import annotations

import datetime as dt
import re
import unicodedata
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wrenmill.runtime import hash_sample, materialize, release

#: Days before the written one that a record may be of.
REACH = 2
#: Least score of a match, gap beyond which a runner-up does not count, differences that make no difference.
LEAST, WIDE, TIE, APART = 0.5, 0.3, 0.02, 0.3
#: Most entries that are recombined into decoys.
SAMPLE = 4000
#: Weights of the attributes: engine number, one that shares a deletion, day, measured number, word.
UNIT, NEAR, DAY, NUMBER, WORD = 3.0, 0.85, 3.0, 1.5, 0.25
#: Share of its mean weight that an attribute missing in the entry counts among what could be reached.
MISSING = 0.25

# Ways to write a day.
DATE_FORMATS = ("%Y-%m-%d", "%Y%m%d", "%Y/%m/%d", "%Y.%m.%d", "%d.%m.%Y", "%d %b %Y", "%d %B %Y", "%Y年%m月%d日")

_cf = re.compile("[​-‏⁠­﻿]")
_serial = re.compile(r"(?<!\d)\d{7}(?!\d)")
_number = re.compile(r"(?<![\d.,])(\d{1,4})[.,](\d{1,3})(?![\d]|[.,]\d)")
_word = re.compile(r"[a-zà-öø-ÿœß]{2,}|[ऀ-ॣ०-ॿ]+")
_runs = re.compile(r"[一-鿿]+|[぀-ヿ一-鿿]+|[฀-๿]+")


def clean(text: str | None) -> str:
    return _cf.sub("", unicodedata.normalize("NFKC", text or "")).casefold()


def code(token: str) -> int:
    return xxhash.xxh64_intdigest(token.encode("utf-8", "surrogatepass")) - (1 << 63)


def day_of(text: str | None) -> int | None:
    """Days since 1970 of a written day."""
    t = unicodedata.normalize("NFKC", text or "").strip()
    for f in DATE_FORMATS:
        try:
            return (dt.datetime.strptime(t, f) - dt.datetime(1970, 1, 1)).days
        except ValueError:
            continue
    return None


def tokens(text: str, extra: str = "") -> tuple[list[str], list[str], list[str]]:
    """Engine numbers, numbers, and word tokens of a cleaned text."""
    serials = list(dict.fromkeys(_serial.findall(extra) + re.findall(r"\d{6,8}$", extra.strip()) + re.findall(r"\d{7}$", extra.strip()) + _serial.findall(text)))
    rest = _serial.sub(" ", text)
    numbers = list(dict.fromkeys(f"{a}.{b}".rstrip("0").rstrip(".") for a, b in _number.findall(rest)))
    words: dict[str, None] = {}
    for w in _word.findall(rest):
        words[w] = None
        if len(w) >= 3:
            words["^" + w[:3]] = None
    for run in _runs.findall(rest):
        for i in range(max(1, len(run) - 1)):
            words[run[i : i + 2]] = None
    return serials, numbers, list(words)


BAG = "id string, day int, s array<string>, n array<bigint>, t array<bigint>"


def _bags(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = []
        for key, text, unit, day in zip(pdf["id"], pdf["text"], pdf["unit"], pdf["day"]):
            serials, numbers, words = tokens(clean(text), clean(unit))
            rows.append((key, day_of(day) if isinstance(day, str) else None, serials, [code("n" + x) for x in numbers], [code("t" + x) for x in words]))
        out = pd.DataFrame(rows, columns=["id", "day", "s", "n", "t"])
        out["day"] = out["day"].astype("Int32")
        yield out


def bags(rows: DataFrame, key: str, text: str, unit: str | None = None, day: str | None = None) -> DataFrame:
    """One bag of tokens per key; day is a written day or a timestamp column."""
    when = F.lit(None).cast("string")
    if day:
        when = F.date_format(day, "yyyy-MM-dd") if rows.schema[day].dataType.typeName().startswith(("timestamp", "date")) else F.col(day)
    picked = rows.filter(F.col(key).isNotNull()).groupBy(F.col(key).cast("string").alias("id")).agg(
        F.min(F.struct(F.col(text).cast("string").alias("text"), (F.col(unit) if unit else F.lit("")).alias("unit"), when.alias("day"))).alias("r")
    )
    return picked.select("id", "r.text", "r.unit", "r.day").mapInPandas(_bags, BAG)


def recombined(entries: DataFrame, most: int = SAMPLE) -> DataFrame:
    """At most `most` decoys: engine, day and words of three different entries each."""
    some = hash_sample(entries, ["id"], most).toPandas().sort_values("id", ignore_index=True)
    n = len(some)
    if n < 3:
        return entries.limit(0)
    # strides that differ from each other and from 0
    mixed = pd.DataFrame({"id": "decoy " + some["id"]})
    mixed["day"] = some["day"].to_numpy()[(np.arange(n) + max(1, n // 3)) % n]
    mixed["s"] = some["s"].to_numpy()
    for c in ("n", "t"):
        mixed[c] = some[c].to_numpy()[(np.arange(n) + max(2, 2 * n // 3)) % n]
    rows = [(r.id, None if pd.isna(r.day) else int(r.day), list(r.s), [int(x) for x in r.n], [int(x) for x in r.t]) for r in mixed.itertuples()]
    return entries.sparkSession.createDataFrame(rows, entries.schema)


# --- the index ----------------------------------------------------------------------------------------------


def idf(n: int, df: Column) -> Column:
    return F.log(1 + (F.lit(n) - df + 0.5) / (df + 0.5))


def _deletions(serial: Column) -> Column:
    """The number itself and it less any one digit."""
    return F.array_distinct(F.concat(F.array(serial), F.transform(F.sequence(F.lit(1), F.length(serial)), lambda i: F.concat(F.substr(serial, F.lit(1), i - 1), F.substr(serial, i + 1)))))


def units(entries: DataFrame, recs: DataFrame, n: int) -> DataFrame:
    """(e, units, most, known): the known engine numbers (unit, w, edits) that an entry's number may stand for, the weight of a match at best, and whether the number is known (3), near known ones (2) or neither (1)."""
    known = recs.select(F.explode("s").alias("unit")).groupBy("unit").agg(F.count(F.lit(1)).alias("df"))
    known = known.select("unit", (F.lit(UNIT) * idf(n, F.col("df"))).alias("w"))
    said = entries.select(F.col("id").alias("e"), F.explode("s").alias("said"))
    left = said.select("e", "said", F.explode(_deletions(F.col("said"))).alias("x"))
    right = known.select("unit", "w", F.explode(_deletions(F.col("unit"))).alias("x"))
    near = left.join(right, "x").groupBy("e", "unit").agg(F.max(F.when(F.col("said") == F.col("unit"), F.col("w")).otherwise(NEAR * F.col("w"))).alias("w"), F.min(F.levenshtein("said", "unit")).alias("edits"))
    unseen = UNIT * float(np.log(1 + (n + 0.5) / 0.5))
    lists = near.groupBy("e").agg(F.array_sort(F.collect_list(F.struct("unit", "w", "edits"))).alias("units"), F.max("w").alias("most"), F.min("edits").alias("edits"))
    known = F.when(F.col("edits") == 0, 3).when(F.col("edits").isNotNull(), 2).otherwise(1)
    return said.select("e").distinct().join(lists, "e", "left").withColumn("most", F.coalesce("most", F.lit(unseen))).withColumn("known", known).drop("edits")


def queries(entries: DataFrame, recs: DataFrame, postings: DataFrame, n: int) -> DataFrame:
    """Entries with the weights of all their attributes: e, day, days, dw, units, uw, known (0 without engine number), figures (the numbers), tok, w (the rarest first) and whole, the highest score possible."""
    df = postings.groupBy("tok").agg(F.count(F.lit(1)).alias("df"))
    terms = entries.select(F.col("id").alias("e"), F.explode(F.concat(F.transform("n", lambda x: F.struct(x.alias("tok"), F.lit(NUMBER).alias("f"))), F.transform("t", lambda x: F.struct(x.alias("tok"), F.lit(WORD).alias("f"))))).alias("x")).select("e", "x.tok", "x.f")
    w = (F.col("f") * idf(n, F.coalesce("df", F.lit(0)))).alias("w")
    lists = terms.join(df, "tok", "left").groupBy("e").agg(F.sort_array(F.collect_list(F.struct(w, "tok")), asc=False).alias("ts"))
    counts = recs.filter("day IS NOT NULL").groupBy("day").agg(F.count(F.lit(1)).alias("df"))
    dated = entries.filter("day IS NOT NULL").select(F.col("id").alias("e"), F.explode(F.sequence(F.col("day") - REACH, F.col("day"))).alias("day"))
    days = dated.join(counts, "day", "left").groupBy("e").agg((F.lit(DAY) * idf(n, F.coalesce(F.sum("df"), F.lit(0)))).alias("dw"))
    full = entries.select(F.col("id").alias("e"), "day", F.col("n").alias("figures")).join(lists, "e", "left").join(days, "e", "left").join(units(entries, recs, n), "e", "left")
    out = full.select(
        "e", "day", F.coalesce("dw", F.lit(0.0)).alias("dw"), F.coalesce("units", F.array().cast("array<struct<unit:string,w:double,edits:int>>")).alias("units"), F.coalesce("most", F.lit(0.0)).alias("uw"), F.coalesce("known", F.lit(0)).alias("known"), "figures",
        F.coalesce(F.col("ts.tok"), F.array().cast("array<bigint>")).alias("tok"), F.coalesce(F.col("ts.w"), F.array().cast("array<double>")).alias("w"),
    )
    mean = out.agg(*[F.coalesce(F.avg(F.when(F.col(c) > 0, F.col(c))), F.lit(0.0)).alias(f"mean_{c}") for c in ("uw", "dw")])
    share = lambda c: F.when(F.col(c) > 0, F.col(c)).otherwise(MISSING * F.col(f"mean_{c}"))
    whole = share("dw") + share("uw") + F.aggregate("w", F.lit(0.0), lambda a, x: a + x)
    return out.crossJoin(F.broadcast(mean)).withColumn("whole", whole).drop("mean_uw", "mean_dw").filter("whole > 0")


PARTS = ("same_unit", "one_edit", "other_unit", "same_day", "day_before", "two_before", "other_day", "cover", "figures", "other_figures", "known")


def scored(pairs: DataFrame, asked: DataFrame, recs: DataFrame) -> DataFrame:
    """(e, d, score) of distinct pairs, score as a share of the entry's whole, what every attribute says (PARTS), and bag, equal for copies of a record."""
    right = recs.select(F.col("id").alias("d"), F.col("day").alias("dday"), "s", F.concat("n", "t").alias("has"))
    full = pairs.join(asked, "e").join(right, "d")
    hit = F.filter("units", lambda x: F.array_contains("s", x["unit"]))
    near = F.col("dday").between(F.col("day") - REACH, F.col("day"))
    words = F.aggregate(F.zip_with("tok", "w", lambda t, w: F.when(F.array_contains("has", t), w).otherwise(0.0)), F.lit(0.0), lambda a, x: a + x)
    said = F.size(F.filter("figures", lambda x: F.array_contains("has", x)))
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("double")
    part = full.withColumn("hit", hit).select(
        "e", "d", "whole", "uw", F.coalesce(F.array_max(F.transform("hit", lambda x: x["w"])), F.lit(0.0)).alias("unit"), flag(F.array_min(F.transform("hit", lambda x: x["edits"])) == 1).alias("one_edit"),
        F.when(near, F.col("dw")).otherwise(0.0).alias("days"), words.alias("words"), F.aggregate("w", F.lit(0.0), lambda a, x: a + x).alias("mass"), ((F.col("uw") > 0) & (F.size("s") > 0)).alias("both"),
        flag(near).alias("same_day"), flag(F.col("dday") == F.col("day") - 1).alias("day_before"), flag(F.col("dday") == F.col("day") - 2).alias("two_before"), flag(~near).alias("other_day"),
        F.coalesce(F.try_divide(said, F.size("figures")), F.lit(0.0)).alias("figures"), flag((F.size("figures") > 0) & (said == 0)).alias("other_figures"), (F.col("known") == 3).cast("double").alias("known"),
        F.xxhash64(F.array_sort("s"), F.array_sort("has")).alias("bag"),
    )
    return part.select(
        "e", "d", "bag", ((F.col("unit") + F.col("days") + F.col("words")) / F.col("whole")).alias("score"), F.coalesce(F.try_divide("unit", "uw"), F.lit(0.0)).alias("same_unit"), "one_edit",
        (F.col("both") & (F.col("unit") == 0)).cast("double").alias("other_unit"), "same_day", "day_before", "two_before", "other_day", F.coalesce(F.try_divide("words", "mass"), F.lit(0.0)).alias("cover"), "figures", "other_figures", "known",
    )


def probes(asked: DataFrame) -> DataFrame:
    """(e, place, unit, day, tok): what has to be looked up so that no record at the entry's bound or above is missed.

    place says which attributes the record shares besides the token: unit, day or none. Where the attribute suffices, any record of it qualifies.
    """
    # a token is needed while it and the rarer ones' successors could still lift a record to the bound
    after = F.transform(F.sequence(F.lit(1), F.size("tok")), lambda i: F.aggregate(F.slice("w", i, F.size("w")), F.lit(0.0), lambda a, x: a + x))
    ranked = asked.filter(F.size("tok") > 0).withColumn("after", after).withColumn("need", F.col("bound") * F.col("whole"))
    eps = 1e-9
    least = lambda has: F.filter(F.transform(F.arrays_zip("tok", "after"), lambda x: F.when(x["after"] >= F.col("need") - has - eps, x["tok"])), lambda t: t.isNotNull())
    unit = ranked.select("e", "need", "tok", "after", F.explode("units").alias("u")).select("e", F.col("u.unit").alias("unit"), F.explode(least(F.col("u.w"))).alias("tok"))
    day = ranked.filter("day IS NOT NULL").select("e", F.explode(F.sequence(F.col("day") - REACH, F.col("day"))).alias("day"), least(F.col("dw")).alias("toks")).select("e", "day", F.explode("toks").alias("tok"))
    none = ranked.select("e", F.explode(least(F.lit(0.0))).alias("tok"))
    bare = asked.select("e", "whole", "bound", F.explode("units").alias("u")).filter(F.col("u.w") >= F.col("bound") * F.col("whole") - eps).select("e", F.col("u.unit").alias("unit"))
    within = asked.filter((F.col("dw") > 0) & (F.col("dw") >= F.col("bound") * F.col("whole") - eps)).select("e", F.explode(F.sequence(F.col("day") - REACH, F.col("day"))).alias("day"))
    blank = lambda c, kind: F.lit(None).cast(kind).alias(c)
    return (
        unit.select("e", F.lit("unit").alias("place"), "unit", blank("day", "int"), "tok")
        .unionByName(day.select("e", F.lit("day").alias("place"), blank("unit", "string"), "day", "tok"))
        .unionByName(none.select("e", F.lit("none").alias("place"), blank("unit", "string"), blank("day", "int"), "tok"))
        .unionByName(bare.select("e", F.lit("bare unit").alias("place"), "unit", blank("day", "int"), blank("tok", "bigint")))
        .unionByName(within.select("e", F.lit("bare day").alias("place"), blank("unit", "string"), "day", blank("tok", "bigint")))
    )


def retrieve(asked: DataFrame, recs: DataFrame, postings: DataFrame, least: float = LEAST) -> DataFrame:
    """(e, d, score): all pairs at the bound of their entry or above, exactly."""
    by_unit = recs.select(F.col("id").alias("d"), "day", F.explode("s").alias("unit"))
    agree = asked.filter("day IS NOT NULL").select("e", F.explode(F.sequence(F.col("day") - REACH, F.col("day"))).alias("day"), "units").select("e", "day", F.explode("units.unit").alias("unit"))
    first = materialize(scored(agree.join(by_unit, ["unit", "day"]).select("e", "d").distinct(), asked, recs), "p6-first")
    best = first.groupBy("e").agg(F.max("score").alias("best"))
    bounded = materialize(asked.join(best, "e", "left").withColumn("bound", F.greatest(F.lit(least), F.coalesce(F.col("best") - WIDE, F.lit(0.0)))).drop("best"), "p6-bounds")
    look = materialize(probes(bounded), "p6-probes")
    of = lambda place: look.filter(F.col("place") == place)
    found = of("bare unit").select("e", "unit").join(by_unit, "unit").select("e", "d")
    found = found.unionByName(of("bare day").select("e", "day").join(recs.select(F.col("id").alias("d"), "day"), "day").select("e", "d"))
    found = found.unionByName(of("unit").select("e", "unit", "tok").join(postings.select("d", "tok", F.explode("s").alias("unit")), ["unit", "tok"]).select("e", "d"))
    found = found.unionByName(of("day").select("e", "day", "tok").join(postings.select("d", "tok", "day"), ["day", "tok"]).select("e", "d"))
    found = found.unionByName(of("none").select("e", "tok").join(postings.select("d", "tok"), "tok").select("e", "d"))
    rest = scored(found.distinct().join(first.select("e", "d"), ["e", "d"], "left_anti"), asked, recs)
    every = first.unionByName(rest).join(bounded.select("e", "bound"), "e").filter(F.col("score") >= F.col("bound") - 1e-9).drop("bound")
    out = materialize(every, "p6-scored")
    release(first, bounded, look)
    return out


# --- calibration --------------------------------------------------------------------------------------------


#: What the calibration reads of an entry's nearest record.
INPUTS = (*PARTS, "gap")


def inputs() -> list[Column]:
    """Columns of the logistic: how engine and day agree, and cover, numbers and gap apart for each way of agreeing."""
    c = {x: F.col(x) for x in INPUTS}
    engine, day = c["same_unit"] > 0, c["same_day"] > 0
    exact, one = (c["same_unit"] == 1).cast("double"), c["one_edit"] * (c["same_unit"] < 1).cast("double")
    far = (engine & (c["same_unit"] < 1)).cast("double") - one
    ways = [(engine & day).cast("double"), (engine & ~day).cast("double"), (~engine).cast("double")]
    plain = [c[x] for x in ("other_unit", "same_day", "day_before", "two_before", "other_day", "known")] + [exact, one, far] + [x * c["same_day"] for x in (exact, one, far)] + [(one + far) * c["known"]]
    return plain + ways[1:] + [w * c[x] for w in ways for x in ("cover", "figures", "other_figures", "gap")]


def fit(real: np.ndarray, decoy: np.ndarray, n_real: int, n_decoy: int, rounds: int = 50) -> np.ndarray:
    """Weights of the log odds of real against decoy entries from the inputs of their nearest."""
    x = np.concatenate([real, decoy.reshape(-1, real.shape[1])])
    x = np.column_stack([np.ones(len(x)), x])
    y = np.r_[np.ones(len(real)), np.zeros(len(decoy))]
    # each kind counts by its share of all its entries, so that odds compare densities
    c = np.r_[np.full(len(real), 1.0 / n_real), np.full(len(decoy), 1.0 / n_decoy)] * n_real
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (c * p * (1 - p))[:, None]).T @ x + 0.5 * np.eye(len(w))
        step = np.linalg.solve(h, x.T @ (c * (p - y)) + 0.5 * w)
        w -= step
        if np.abs(step).max() < 1e-7:
            break
    return w


def alike(real: np.ndarray, decoy: np.ndarray, n_real: int, n_decoy: int, part: float = 0.25) -> float:
    """Share of real entries that are like decoys, from the log odds of those that reach a nearest record and the numbers of all.

    Compares how often either kind stays among the lowest odds (no LEAST score at all, or those under which `part` of the decoys lie),
    where decoys and unmatched entries are alike and matched ones hardly are.
    """
    lowest = 1 - len(decoy) / n_decoy
    cut = -np.inf if lowest >= part else np.sort(decoy)[min(len(decoy) - 1, int(np.ceil(part * n_decoy)) - (n_decoy - len(decoy)))]
    low = lambda z, n: (n - len(z) + (z <= cut).sum()) / n
    return float(min(1.0, low(real, n_real) / max(1e-9, low(decoy, n_decoy))))


#: Least decoys of a kind of entries to take its share by itself.
FEW = 40


def calibrated(near: DataFrame, asked: DataFrame) -> DataFrame:
    """near with alike and odds."""
    kind = asked.select("e", (F.col("known") * 2 + F.col("day").isNotNull().cast("int")).alias("kind"))
    near = near.join(kind, "e").withColumn("x", F.array(*inputs()))
    decoy = F.col("e").startswith("d").alias("decoy")
    counts = {(r["decoy"], r["kind"]): r["n"] for r in kind.groupBy(decoy, "kind").agg(F.count(F.lit(1)).alias("n")).collect()}
    tops = near.filter(F.col("score") == F.col("best")).groupBy("e", "kind").agg(F.min_by("x", "d").alias("x")).select("e", "kind", "x", decoy)
    reached = {(r["decoy"], r["kind"]): r["n"] for r in tops.groupBy("decoy", "kind").agg(F.count(F.lit(1)).alias("n")).collect()}
    sample = {d: hash_sample(tops.filter(F.col("decoy") == d), ["e"], 5 * SAMPLE).select("kind", "x").toPandas() for d in (False, True)}
    xs = {d: np.array([list(v) for v in sample[d]["x"]], float).reshape(-1, len(inputs())) for d in sample}
    all_of = lambda m, d: sum(v for k, v in m.items() if k[0] == d)
    # as many entries as the sampled ones stand for
    stand = {d: len(xs[d]) / max(1, all_of(reached, d)) for d in sample}
    if not len(xs[False]) or not all_of(counts, True):
        # nothing to calibrate on: agreement in engine and day, or in either and all words
        return near.withColumn("alike", F.lit(1.0)).withColumn("odds", F.exp(4 * F.col("same_unit") + 4 * F.col("same_day") + 4 * F.col("cover") + 2 * F.col("gap") - 3 * F.col("other_unit") - 3 * F.col("other_day") - 4)).drop("kind", "x")
    w = fit(xs[False], xs[True], max(1, round(all_of(counts, False) * stand[False])), max(1, round(all_of(counts, True) * (stand[True] or 1))))
    z = {d: xs[d] @ w[1:] + w[0] for d in sample}

    def share(kinds: set[int]) -> float:
        mine = {d: z[d][sample[d]["kind"].isin(kinds).to_numpy()] for d in sample}
        # numbers of all entries of these kinds, in the measure of the sample
        n = {d: sum(counts.get((d, k), 0) - reached.get((d, k), 0) for k in kinds) * (stand[d] or 1) + len(mine[d]) for d in sample}
        return alike(mine[False], mine[True], max(1, round(n[False])), max(1, round(n[True])))

    kinds = {k for _, k in counts}
    shares = {k: share({k} if counts.get((True, k), 0) >= FEW else kinds) for k in kinds}
    by_kind = F.element_at(F.create_map(*[F.lit(v) for k, s in sorted(shares.items()) for v in (k, s)]), F.col("kind"))
    odds = F.exp(F.least(F.lit(30.0), F.aggregate(F.zip_with("x", F.array(*[F.lit(float(v)) for v in w[1:]]), lambda a, b: a * b), F.lit(float(w[0])), lambda a, v: a + v)))
    # events of one engine resemble each other, which recombined decoys don't show: a contradicting day or engine gets no benefit of the entries that have a match
    against = (F.col("other_unit") > 0) | (F.col("other_day") > 0)
    return near.withColumn("alike", F.when(against, 1.0).otherwise(by_kind)).withColumn("odds", odds).drop("kind", "x")


def confident(near: DataFrame, asked: DataFrame) -> DataFrame:
    """near of the real entries with best, the highest score of the entry, and the confidence of every pair within TIE of it (0 for others)."""
    top = Window.partitionBy("e")
    near = near.withColumn("best", F.max("score").over(top)).withColumn("runner", F.max(F.when(F.col("score") < F.col("best") - TIE, F.col("score"))).over(top))
    # a runner-up under LEAST is not known: the gap is what is certain
    near = materialize(near.withColumn("gap", F.least(F.lit(WIDE), F.col("best") - F.coalesce("runner", F.lit(LEAST)))), "p6-near")
    tied = calibrated(near, asked).filter(~F.col("e").startswith("d")).withColumn("tied", F.col("score") >= F.col("best") - TIE)
    # records within TIE divide the confidence by their odds of a match; copies count once and each has the share of their record
    tied = tied.withColumn("lift", F.when(F.col("tied"), F.greatest(F.lit(1e-9), F.col("odds") - F.col("alike"))).otherwise(0.0))
    tied = tied.withColumn("copies", F.sum(F.col("tied").cast("int")).over(Window.partitionBy("e", "bag")))
    tied = tied.withColumn("lifts", F.sum(F.when(F.col("tied"), F.col("lift") / F.col("copies"))).over(top))
    sure = F.greatest(F.lit(0.0), 1 - F.col("alike") / F.col("odds"))
    return tied.withColumn("confidence", F.when(F.col("tied"), sure * F.least(F.lit(1.0), F.col("lift") / F.col("lifts"))).otherwise(0.0)).drop("tied", "lift", "copies", "lifts")


def match(records: DataFrame, entries: DataFrame, least: float = 0.5) -> DataFrame:
    """(document_id, entry_id, confidence); records: document_id, text, recorded_at; entries: entry_id, unit_ref, opened_on, summary."""
    recs = materialize(bags(records, "document_id", "text", None, "recorded_at"), "p6-records")
    real = materialize(bags(entries, "entry_id", "summary", "unit_ref", "opened_on"), "p6-entries")
    n = recs.count()
    if not n or not real.limit(1).count():
        return recs.select(F.col("id").alias("document_id"), F.col("id").alias("entry_id"), F.lit(0.0).alias("confidence")).limit(0)
    decoys = recombined(real)
    both = real.withColumn("decoy", F.lit(False)).unionByName(decoys.withColumn("decoy", F.lit(True))).withColumn("id", F.concat(F.when(F.col("decoy"), "d").otherwise("r"), F.col("id"))).drop("decoy")
    postings = materialize(recs.select(F.col("id").alias("d"), "day", "s", F.explode(F.concat("n", "t")).alias("tok")), "p6-postings")
    asked = materialize(queries(both, recs, postings, n), "p6-queries")
    near = retrieve(asked, recs, postings)
    trusted = confident(near, asked)
    mutual = trusted.withColumn("closest", F.max("score").over(Window.partitionBy("d")))
    kept = mutual.filter((F.col("score") >= F.col("best") - TIE) & (F.col("score") >= F.col("closest") - APART) & (F.col("confidence") >= least))
    return kept.select(F.col("d").alias("document_id"), F.substring("e", 2, 1 << 30).alias("entry_id"), "confidence")
