"""Slots with offsets and their checks; evidence units of a text, their spans, and the unit that an event lies in.

Offsets count code points from 0, end exclusive. Null texts give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wrenmill.functions import text as t
from wrenmill.operators.resolution import HARD_SLOTS

# Slots whose value is the match itself; the others take a window around it. The modalities and origins of a mention.
PLAIN_SLOTS = ("component", "location", "stage", "phenomenon", "damage_state")
WINDOW = (18, 28)
TRIM = " ，。；："
MODALITIES = ("confirmed", "possible", "suspected", "unknown")
ORIGINS = ("rule", "model", "human")
UNIT_MOST = 96


def _strip(text: Column, marks: str, left: bool = True, right: bool = True) -> Column:
    out = F.regexp_replace(text, f"^[{marks}]+", "") if left else text
    return F.regexp_replace(out, f"[{marks}]+\\z", "") if right else out


def slots_with_offsets(records: DataFrame) -> DataFrame:
    """(document_id, slot, value, evidence_sentence, start, end, confidence, modality, evidence_origin, eligible) of every rule mention, each (slot, start, end, value) once."""
    sentences = records.filter("text IS NOT NULL").select("document_id", F.explode(t.sentence_array(F.col("text"))).alias("s")).select("document_id", "s.*")
    found = F.flatten(F.array(*[_placed(F.col("sentence"), slot) for slot in t.SLOT_PATTERNS]))
    placed = sentences.select("document_id", "start", "sentence", F.inline(found))
    plain = F.col("slot").isin(*PLAIN_SLOTS)
    low = F.greatest(F.lit(0), F.col("at") - WINDOW[0])
    raw = F.substr("sentence", low + 1, F.least(F.length("sentence"), F.col("at") + F.length("value") + WINDOW[1]) - low)
    wide = _strip(raw, TRIM)
    lead = F.length(raw) - F.length(_strip(raw, TRIM, right=False))
    value = F.when(plain, F.col("value")).otherwise(wide)
    start = F.col("start") + F.when(plain, F.col("at")).otherwise(low + lead)
    modality = t.modality(F.col("sentence"))
    base = F.when(F.col("slot").isin(*HARD_SLOTS), 0.90).otherwise(0.78)
    confidence = F.when(modality == "confirmed", F.least(F.lit(0.98), base + 0.06)).otherwise(base)
    return placed.select(
        "document_id", "slot", value.alias("value"), F.col("sentence").alias("evidence_sentence"), start.cast("int").alias("start"), (start + F.length(value)).cast("int").alias("end"),
        F.round(confidence, 2).alias("confidence"), modality.alias("modality"), F.lit("rule").alias("evidence_origin"), ((confidence >= 0.90) & ~modality.isin("possible", "suspected")).alias("eligible"),
    ).dropDuplicates(["document_id", "slot", "start", "end", "value"])


def _placed(sentence: Column, slot: str) -> Column:
    """(slot, value, at) of the matches of a slot in order, each found from the end of the one before."""
    start = F.struct(F.lit(0).alias("next"), F.array().cast("array<struct<slot:string,value:string,at:int>>").alias("out"))

    def step(done: Column, v: Column) -> Column:
        at = (F.call_function("locate", v, sentence, done["next"] + 1) - 1).cast("int")
        return F.struct((at + F.length(v)).cast("int").alias("next"), F.concat(done["out"], F.array(F.struct(F.lit(slot).alias("slot"), v.alias("value"), at.alias("at")))).alias("out"))

    return F.aggregate(t.slot_values(sentence, slot), start, step, lambda done: done["out"])


def slot_faults(mentions: DataFrame, records: DataFrame) -> DataFrame:
    """(document_id, slot, start, fault) of mentions that break the schema or do not stand in their text."""
    full = mentions.join(records.select("document_id", "text"), "document_id", "left")
    text = F.coalesce("text", F.lit(""))
    empty = lambda c: F.coalesce(F.length(c), F.lit(0)) == 0
    inside = (F.col("start") >= 0) & (F.col("start") < F.col("end")) & (F.col("end") <= F.length(text))
    faults = F.array_compact(
        F.array(
            F.when(empty("document_id"), "document_id"), F.when(~F.coalesce(F.col("slot").isin(*t.SLOT_PATTERNS), F.lit(False)), "slot"), F.when(empty("value"), "value"), F.when(empty("evidence_sentence"), "evidence_sentence"),
            F.when(~F.coalesce(F.col("confidence").between(0, 1), F.lit(False)), "confidence"), F.when(~F.coalesce(F.col("modality").isin(*MODALITIES), F.lit(False)), "modality"),
            F.when(~F.coalesce(F.col("evidence_origin").isin(*ORIGINS), F.lit(False)), "evidence_origin"), F.when(~F.coalesce(inside, F.lit(False)), "offsets"),
            F.when(~F.contains(text, F.coalesce("evidence_sentence", F.lit(""))), "sentence_not_in_text"),
            F.when(inside & (F.substr(text, F.col("start") + 1, F.col("end") - F.col("start")) != F.col("value")), "span_differs"),
        )
    )
    return full.select("document_id", "slot", "start", F.explode(faults).alias("fault"))


# --- evidence units -----------------------------------------------------------------------------------------


def evidence_units(text: Column, most: int = UNIT_MOST) -> Column:
    """Units of a text in order: its sentences without outer blanks and commas; longer ones packed greedily from their clauses, joined by a comma."""
    sentences = F.filter(F.transform(F.split(text, "[。！？；\n]+"), lambda p: _strip(p, " ，,")), lambda p: F.length(p) > 0)

    def packed(sentence: Column) -> Column:
        clauses = F.filter(F.transform(F.split(sentence, "[，,]+"), lambda c: _strip(c, r"\s")), lambda c: F.length(c) > 0)

        def step(done: Column, clause: Column) -> Column:
            last = F.coalesce(F.try_element_at(done, F.lit(-1)), F.lit(""))
            joined = F.concat(last, F.lit("，"), clause)
            return F.when((F.size(done) == 0) | (F.length(joined) > most), F.concat(done, F.array(clause))).otherwise(F.concat(F.slice(done, 1, F.size(done) - 1), F.array(joined)))

        return F.aggregate(clauses, F.array().cast("array<string>"), step)

    units = F.flatten(F.transform(sentences, lambda s: F.when(F.length(s) <= most, F.array(s)).otherwise(packed(s))))
    return F.when(F.size(units) > 0, units).otherwise(F.array(_strip(text, r"\s")))


def unit_spans(text: Column, units: Column) -> Column:
    """(unit, start, end) of each unit: found from the end of the one before, else anywhere, else by its first clause; -1 where none is found."""
    blank = F.array().cast("array<struct<unit:string,start:int,end:int>>")

    def step(done: Column, unit: Column) -> Column:
        cursor = F.coalesce(F.try_element_at(done, F.lit(-1))["end"], F.lit(0))
        first = F.split(unit, "[，,]+")[0]
        find = lambda what, at: F.call_function("locate", what, text, at + 1) - 1
        ahead, anywhere, clause = find(unit, cursor), find(unit, F.lit(0)), find(first, cursor)
        start = F.when(ahead >= 0, ahead).when(anywhere >= 0, anywhere).otherwise(clause)
        end = F.when(start < 0, start).otherwise(F.least(F.length(text), start + F.length(unit)))
        return F.concat(done, F.array(F.struct(unit.alias("unit"), start.cast("int").alias("start"), end.cast("int").alias("end"))))

    return F.aggregate(units, blank, step)


def text_units(records: DataFrame, most: int = UNIT_MOST) -> DataFrame:
    """(document_id, unit_idx, unit, start, end) of every text that is not blank."""
    rows = records.filter("text IS NOT NULL").filter(F.length(F.trim("text")) > 0).withColumn("__units", evidence_units(F.col("text"), most))
    return rows.select("document_id", F.posexplode(unit_spans(F.col("text"), F.col("__units"))).alias("unit_idx", "u")).select("document_id", "unit_idx", "u.*")


def event_contexts(events: DataFrame, units: DataFrame, unit_vectors: DataFrame | None = None) -> DataFrame:
    """(uid, document_id, unit_idx, aligned) and, with unit_vectors (document_id, unit_idx, embedding), the vector: the unit with the largest overlap, the first of several, else the one that starts nearest.

    events: uid, document_id, start, end. Units and vectors of a document must be of one number.
    """
    joined = events.join(units.select("document_id", "unit_idx", F.col("start").alias("us"), F.col("end").alias("ue")), "document_id")
    overlap = F.greatest(F.lit(0), F.least("end", "ue") - F.greatest("start", "us"))
    # the largest overlap wins, then the first unit; without any overlap the nearest start, then the first
    key = F.struct(overlap.alias("o"), F.when(overlap > 0, 0).otherwise(-F.abs(F.col("us") - F.col("start"))).alias("d"), (-F.col("unit_idx")).alias("i"))
    best = joined.groupBy("uid", "document_id").agg(F.max(key).alias("k")).select("uid", "document_id", (-F.col("k.i")).alias("unit_idx"), (F.col("k.o") > 0).alias("aligned"))
    if unit_vectors is None:
        return best
    counts = units.groupBy("document_id").agg(F.count(F.lit(1)).alias("n")).join(unit_vectors.groupBy("document_id").agg(F.count(F.lit(1)).alias("m")), "document_id", "left")
    wrong = counts.filter("m IS NULL OR n <> m").limit(1).collect()
    if wrong:
        raise ValueError(f"evidence units and vectors differ for {wrong[0][0]}: {wrong[0][1]}, {wrong[0][2]}")
    return best.join(unit_vectors, ["document_id", "unit_idx"], "left")
