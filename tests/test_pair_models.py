"""Event features against plain Python, models on held-out rows, slots and evidence units against plain Python."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from wrenmill.operators import evidence_units as eu
from wrenmill.operators import pair_models as pm
from wrenmill.operators import relation_states


def test_paired_cosine_by_definition(spark):
    rng = random.Random(2)
    rows = [(i, "".join(rng.choice("叶片裂纹ab ") for _ in range(rng.randrange(0, 9))), "".join(rng.choice("叶片裂纹ab") for _ in range(rng.randrange(1, 9)))) for i in range(40)] + [(90, None, "裂纹")]
    grams = lambda t: Counter(t[i : i + n] for n in (2, 3, 4) for i in range(len(t) - n + 1))
    from re import sub

    texts = [sub(r"\s\s+", " ", (t or "").lower()) for r in rows for t in r[1:]]
    df = Counter(g for t in texts for g in grams(t))
    df = Counter(g for t in texts for g in set(grams(t)))

    def vector(t):
        v = {g: (1 + math.log(c)) * (math.log((len(texts) + 1) / (df[g] + 1)) + 1) for g, c in grams(t).items()}
        n = math.sqrt(sum(x * x for x in v.values())) or 1
        return {g: x / n for g, x in v.items()}

    got = {r.k: r.c for r in pm.paired_cosine(spark.createDataFrame(rows, "k int, a string, b string"), "k", "a", "b", "c").collect()}
    for i, (k, *_) in enumerate(rows):
        x, y = vector(texts[2 * i]), vector(texts[2 * i + 1])
        assert abs(got[k] - sum(w * y.get(g, 0) for g, w in x.items())) < 1e-9


def pairs(spark, n=240, seed=4):
    rng = random.Random(seed)
    parts, faults = ["轴承", "叶片", "机匣", "软管", "活门"], ["裂纹", "磨损", "松动", "泄漏"]
    rows = []
    for i in range(n):
        p, f = rng.choice(parts), rng.choice(faults)
        label = ("equivalent", "related", "forbidden")[i % 3]
        b = f"{p}出现{f}" if label == "equivalent" else f"{rng.choice(parts)}{rng.choice(faults)}" if label == "related" else f"{p}{f}{i % 7}mm"
        a = f"{p}{f}" if label != "forbidden" else f"{p}{f}{i % 7 + 1}mm"
        rows.append((i, a, b, f"检查{a}。", f"检查{b}。", "FAILURE", "FAILURE", "", "", label, f"g{i % 12}"))
    kind = "k int, event_text_a string, event_text_b string, evidence_text_a string, evidence_text_b string, event_type_a string, event_type_b string, modality_a string, modality_b string, label string, g string"
    return spark.createDataFrame(rows, kind)


def test_event_features_and_model(spark):
    rows = pm.materialize(pm.event_features(pairs(spark), "k"))
    one = rows.filter("event_text_a = '轴承裂纹' AND event_text_b LIKE '轴承出现裂纹'").limit(1).collect()
    for r in one:
        assert r.same_type == 1 and r.equal_mention == 0 and r.contained == 0 and r.marker_overlap == 1 and r.length_ratio == 4 / 6 and abs(r.length_gap - 2 / 50) < 1e-12
    assert rows.filter("label = 'forbidden' AND NOT hard_conflict").count() == 0 and rows.filter(" OR ".join(f"{c} IS NULL" for c in pm.EVENT_FEATURES)).count() == 0
    model = pm.EventStateModel(seeds=(1,), trees=15, folds=3).fit(rows.filter("k < 160"), "g")
    held = model.predict(rows.filter("k >= 160"))
    right = held.join(rows.select("k", F.col("label").alias("want")), "k").filter("predicted_state = want").count()
    assert right / held.count() > 0.75
    with pytest.raises(ValueError):
        pm.EventStateModel(seeds=(1,), trees=2).fit(rows.filter("label <> 'related'"))


def test_complementary_model(spark):
    rng = random.Random(5)
    rows = [(i, f"滑油{rng.choice('甲乙')}", "渗漏", f"滑油{rng.choice('甲乙')}" if i % 2 else "电缆断", "渗漏" if i % 2 else "短路", "CAUSE", "CAUSE", "complementary" if i % 2 else "unrelated", f"g{i % 9}") for i in range(120)]
    df = spark.createDataFrame(rows, "k int, head_text_a string, tail_text_a string, head_text_b string, tail_text_b string, relation_type_a string, relation_type_b string, label string, g string")
    feats = pm.materialize(relation_states.features(df))
    assert len(pm.complementary_vector()) == 21 and len(pm.complementary_vector(False)) == 16
    model = pm.ComplementaryModel().fit(feats.filter("k < 80"), "g")
    held = model.predict(feats.filter("k >= 80"))
    assert held.filter(f"(probability >= {model.threshold}) = (label = 'complementary')").count() / held.count() > 0.9 and 0.1 <= model.threshold <= 0.9
    with pytest.raises(ValueError):
        pm.ComplementaryModel().fit(feats.filter("label = 'unrelated'"))


def test_threshold_choice(spark):
    df = spark.createDataFrame([(1.0, 0.8), (1.0, 0.6), (0.0, 0.55), (0.0, 0.2)], "y double, p double")
    assert 0.55 < pm.select_threshold(df, "y", "p", 0.4) <= 0.6


def test_slots_and_faults(spark):
    text = "检查发现1号轴承磨损，叶片裂纹2mm。 可能泄漏！\n轴承更换轴承"
    recs = spark.createDataFrame([("d", text), ("n", None), ("e", "")], "document_id string, text string")
    slots = eu.slots_with_offsets(recs)
    rows = slots.collect()
    assert rows and all(text[r.start : r.end] == r.value and r.evidence_sentence in text for r in rows)
    assert {r.start for r in rows if r.slot == "component" and r.value == "轴承"} >= {text.rindex("\n轴承") + 1, text.rindex("轴承")}
    assert eu.slot_faults(slots, recs).count() == 0
    bad = slots.limit(1).withColumns({"start": F.lit(5), "end": F.lit(3), "modality": F.lit("sure"), "confidence": F.lit(2.0), "slot": F.lit("x"), "evidence_sentence": F.lit("not there"), "evidence_origin": F.lit(None).cast("string")})
    assert {r.fault for r in eu.slot_faults(bad, recs).collect()} == {"offsets", "modality", "confidence", "slot", "sentence_not_in_text", "evidence_origin"}


def test_units_by_definition(spark):
    import re

    rng = random.Random(6)
    texts = ["".join(rng.choice("甲乙丙丁，。； ,\n") for _ in range(rng.randrange(1, 60))) for _ in range(60)] + ["，".join("长" * 30 for _ in range(5)), "， "]
    df = spark.createDataFrame([(f"d{i}", t) for i, t in enumerate(texts)], "document_id string, text string")
    got = {r.document_id: r.u for r in df.select("document_id", eu.evidence_units(F.col("text"), 8).alias("u")).collect()}
    for i, text in enumerate(texts):
        want = []
        for s in (p.strip(" ，,") for p in re.split(r"[。！？；\n]+", text)):
            if not s:
                continue
            if len(s) <= 8:
                want.append(s)
                continue
            own = []
            for c in (c.strip() for c in re.split("[，,]+", s) if c.strip()):
                if own and len(own[-1] + "，" + c) <= 8:
                    own[-1] += "，" + c
                else:
                    own.append(c)
            want += own
        assert got[f"d{i}"] == (want or [text.strip()]), repr(text)
    spans = eu.text_units(df).collect()
    assert all(texts[int(r.document_id[1:])][r.start : r.end] == r.unit for r in spans if r.start >= 0 and "，" not in r.unit)


def test_event_contexts(spark):
    units = spark.createDataFrame([("d", 0, "a", 0, 5), ("d", 1, "b", 5, 9), ("d", 2, "c", 12, 20)], "document_id string, unit_idx int, unit string, start int, end int")
    events = spark.createDataFrame([("x", "d", 3, 7), ("y", "d", 10, 11), ("z", "d", 13, 14), ("w", "d", -1, -1), ("q", "other", 0, 1)], "uid string, document_id string, start int, end int")
    assert {(r.uid, r.unit_idx, r.aligned) for r in eu.event_contexts(events, units).collect()} == {("x", 0, True), ("y", 2, False), ("z", 2, True), ("w", 0, False)}
    vectors = units.select("document_id", "unit_idx", F.array(F.lit(1.0)).alias("embedding"))
    assert eu.event_contexts(events, units, vectors).filter("embedding IS NOT NULL").count() == 4
    with pytest.raises(ValueError):
        eu.event_contexts(events, units, vectors.filter("unit_idx > 0"))
