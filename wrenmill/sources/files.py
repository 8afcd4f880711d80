"""Readers and writers of JSONL, JSON, NPZ, YAML and case graphs, and the hook of an encoder; schemas are explicit, never inferred from data."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Mapping
from dataclasses import fields, is_dataclass
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_jsonl_strict(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Every line must be a JSON object; a blank or damaged line fails the read. The check runs where the rows are read."""
    lines = spark.read.text(path)
    parsed = F.from_json("value", f"{schema}, __damaged string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "__damaged"})
    rows = lines.select("value", parsed.alias("r"))
    bad = (F.length(F.trim("value")) == 0) | F.col("r").isNull() | F.col("r.__damaged").isNotNull() | ~F.ltrim("value").startswith("{")
    checked = rows.select(F.when(bad, F.raise_error(F.concat(F.lit("no JSON object: "), F.substring("value", 1, 80)))).alias("__fault"), "r")
    return checked.filter(F.col("__fault").isNull()).select("r.*").drop("__damaged")


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Skips blank lines and a byte-order mark; lines that are no JSON object give no row."""
    lines = spark.read.text(path).select(F.regexp_replace("value", "^﻿", "").alias("value")).filter(F.length(F.trim("value")) > 0)
    return lines.filter(F.ltrim("value").startswith("{")).select(F.from_json("value", schema).alias("r")).filter("r IS NOT NULL").select("r.*")


def read_assignments(spark: SparkSession, path: str) -> DataFrame:
    """(document_id, case_id) of a JSON object, by itself or under 'assignments'; anything else fails."""
    text = spark.read.text(path, wholetext=True).select(F.col("value"))
    inner = F.coalesce(F.get_json_object("value", "$.assignments"), F.col("value"))
    pairs = F.from_json(inner, "map<string,string>")
    checked = text.select(F.when(pairs.isNull() | ~F.ltrim(inner).startswith("{"), F.raise_error(F.lit("assignments must be a JSON object"))).alias("__fault"), pairs.alias("m"))
    return checked.filter(F.col("__fault").isNull()).select(F.explode("m").alias("document_id", "case_id"))


def read_npz(spark: SparkSession, path: str) -> DataFrame:
    """(document_id, embedding) of an embedding cache; lengths must agree and pickled objects are refused."""
    with np.load(path, allow_pickle=False) as z:
        ids, vectors = [str(x) for x in z["document_ids"]], np.asarray(z["embeddings"], np.float32)
    if len(ids) != len(vectors):
        raise ValueError("document_ids and embeddings differ in length")
    return spark.createDataFrame([(i, v.tolist()) for i, v in zip(ids, vectors)], "document_id string, embedding array<float>")


def read_npz_units(spark: SparkSession, path: str) -> DataFrame:
    """(document_id, unit_idx, embedding) of a ragged evidence-unit cache."""
    with np.load(path, allow_pickle=False) as z:
        ids, offsets, vectors = [str(x) for x in z["document_ids"]], z["unit_offsets"], np.asarray(z["unit_embeddings"], np.float32)
    if len(offsets) != len(ids) + 1 or int(offsets[-1]) != len(vectors):
        raise ValueError("unit_offsets do not fit")
    rows = [(d, j, vectors[k].tolist()) for i, d in enumerate(ids) for j, k in enumerate(range(int(offsets[i]), int(offsets[i + 1])))]
    return spark.createDataFrame(rows, "document_id string, unit_idx int, embedding array<float>")


def write_npz(df: DataFrame, path: str) -> None:
    """An embedding cache for exchange; of driver size by its format. Larger sets are written as parquet."""
    rows = df.select("document_id", "embedding").orderBy("document_id").collect()
    np.savez_compressed(path, document_ids=np.array([r[0] for r in rows]), embeddings=np.array([r[1] for r in rows], np.float32))


def write_json(value: object, path: str) -> None:
    """Indent 2, no escapes, a newline at the end; for small results."""
    Path(path).write_text(json.dumps(value, ensure_ascii=False, indent=2) + "\n", encoding="utf-8")


def write_jsonl(df: DataFrame, path: str) -> None:
    """One compact JSON object per row, written in parallel; null fields are kept."""
    df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("value")).write.text(path)


# --- configuration ------------------------------------------------------------------------------------------


def read_config(path: str) -> dict:
    """A mapping from a JSON file, or a YAML one where a YAML library is installed; anything else fails."""
    text = Path(path).read_text(encoding="utf-8")
    if path.endswith((".yaml", ".yml")):
        try:
            import yaml
        except ImportError as e:
            raise RuntimeError("reading YAML needs a YAML library; JSON works without") from e
        value = yaml.safe_load(text)
    else:
        value = json.loads(text)
    if not isinstance(value, dict):
        raise ValueError(f"{path} must hold a mapping")
    return value


def required(config: Mapping, *path: str) -> object:
    """The value at a path of keys; a missing one is named in full."""
    at: object = config
    for i, key in enumerate(path):
        if not isinstance(at, Mapping) or key not in at:
            raise KeyError(".".join(path[: i + 1]))
        at = at[key]
    return at


def parameters(kind: type, values: Mapping):
    """A parameter set of a dataclass from a mapping; unknown keys fail, lists become tuples."""
    if not is_dataclass(kind):
        raise TypeError(f"{kind} is no parameter set")
    unknown = set(values) - {f.name for f in fields(kind)}
    if unknown:
        raise ValueError(f"unknown parameters: {sorted(unknown)}")
    return kind(**{k: tuple(v) if isinstance(v, list) else v for k, v in values.items()})


# --- encoder hook, tables, case graphs ----------------------------------------------------------------------


def encode(records: DataFrame, load: Callable[[], Callable[[list[str]], np.ndarray]], size: int, batch: int = 64) -> DataFrame:
    """(document_id, embedding) of every record with a text, of length 1, by any encoder.

    load() gives a function from texts to an array of rows of `size` numbers; it is called once a task, where the model lives. Blank texts have no row.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load()
        for pdf in batches:
            for i in range(0, len(pdf), batch):
                some = pdf.iloc[i : i + batch]
                x = np.asarray(model(list(some["text"])), np.float64)
                if x.shape != (len(some), size):
                    raise ValueError(f"the encoder gave {x.shape}, not {(len(some), size)}")
                unit = x / np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-12)
                yield pd.DataFrame({"document_id": some["document_id"], "embedding": list(unit.astype(np.float32))})

    used = records.filter("document_id IS NOT NULL AND text IS NOT NULL").filter(F.length(F.trim("text")) > 0)
    return used.select("document_id", "text").mapInPandas(run, "document_id string, embedding array<float>")


def write_tables(tables: Mapping[str, DataFrame], folder: str, form: str = "json") -> dict[str, str]:
    """Every table into a folder of its name, in parallel; returns the places by name. form is any writer format of Spark."""
    places = {}
    for name, df in tables.items():
        places[name] = f"{folder.rstrip('/')}/{name}"
        df.write.format(form).save(places[name])
    return places


CASE_GRAPH = (
    "case_cluster_id string, source_document_ids array<string>, validation struct<passed:boolean>, "
    "provenance struct<events:map<string,struct<sources:array<struct<source_event_id:string,document_id:string,character_span:array<int>,text:string>>>>,relations:map<string,struct<sources:array<struct<document_id:string>>>>>, "
    "events array<struct<case_event_id:string,event_type:string,canonical_text:string,canonical_source_event_id:string,source_event_ids:array<string>,source_document_ids:array<string>,extraction_scores:array<double>>>, "
    "relations array<struct<case_relation_id:string,head_case_event_id:string,relation_type:string,tail_case_event_id:string,relation_state:string,source_relation_ids:array<string>,source_document_ids:array<string>,"
    "evidence_texts:array<string>,extraction_scores:array<double>,complementary_with:array<string>,conflict_with:array<string>,conflict_dimensions:array<string>>>"
)


def read_case_graphs(spark: SparkSession, path: str, texts: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of reconstructed case graphs in JSONL; a graph that did not pass its checks fails the read.

    texts (document_id, text), if given, decide source_span_valid: every source's span must hold its mention. Scores are the highest, evidence the longest; missing ones 0 and ''.
    """
    graphs = read_jsonl(spark, path, CASE_GRAPH)
    fault = F.when(~F.coalesce(F.col("validation.passed"), F.lit(False)), F.raise_error(F.concat(F.lit("case graph did not pass its checks: "), F.coalesce("case_cluster_id", F.lit("")))))
    graphs = graphs.withColumn("__fault", fault).filter(F.col("__fault").isNull())
    none = F.array().cast("array<string>")
    strings = lambda c: F.coalesce(F.col(c), none)
    e = graphs.select("case_cluster_id", "provenance", F.explode("events").alias("e"))
    sources = F.coalesce(F.try_element_at("provenance.events", F.col("e.case_event_id"))["sources"], F.array().cast("array<struct<source_event_id:string,document_id:string,character_span:array<int>,text:string>>"))
    e = e.withColumn("sources", sources)
    own = F.try_element_at(F.filter("sources", lambda x: x["source_event_id"] == F.col("e.canonical_source_event_id")), F.lit(1))
    e = e.withColumn("own", F.coalesce(own, F.try_element_at("sources", F.lit(1))))
    end = lambda span, i: F.coalesce(F.try_element_at(span, F.lit(i)), F.lit(-1))
    nodes = e.select(
        F.col("e.case_event_id").alias("uid"), F.col("case_cluster_id").alias("case_id"), F.coalesce("own.document_id", F.try_element_at("e.source_document_ids", F.lit(1)), F.lit("")).alias("document_id"), F.col("e.case_event_id").alias("event_id"),
        F.coalesce("e.canonical_text", F.lit("")).alias("text"), F.coalesce("e.event_type", F.lit("")).alias("role"), end(F.col("own.character_span"), 1).alias("start_pos"), end(F.col("own.character_span"), 2).alias("end_pos"),
        F.coalesce(F.array_max("e.extraction_scores"), F.lit(0.0)).alias("score"), strings("e.source_event_ids").alias("source_event_ids"), strings("e.source_document_ids").alias("source_document_ids"),
        F.transform("sources", lambda x: F.struct(end(x["character_span"], 1).alias("span_start"), end(x["character_span"], 2).alias("span_end"))).alias("source_spans"), F.coalesce("e.canonical_source_event_id", F.lit("")).alias("canonical_source_event_id"), "sources",
    )
    if texts is None:
        nodes = nodes.withColumn("source_span_valid", F.lit(False))
    else:
        each = nodes.select("uid", F.explode("sources").alias("s")).select("uid", "s.*").join(texts.select("document_id", F.col("text").alias("whole")), "document_id", "left")
        a, b = end(F.col("character_span"), 1), end(F.col("character_span"), 2)
        right = F.coalesce((a >= 0) & (a < b) & (b <= F.length("whole")) & (F.substr("whole", a + 1, b - a) == F.coalesce("text", F.lit(""))), F.lit(False))
        nodes = nodes.join(each.groupBy("uid").agg(F.bool_and(right).alias("source_span_valid")), "uid", "left").withColumn("source_span_valid", F.coalesce("source_span_valid", F.lit(False)))
    r = graphs.select("case_cluster_id", "provenance", F.explode("relations").alias("r"))
    first = F.try_element_at(F.try_element_at("provenance.relations", F.col("r.case_relation_id"))["sources"], F.lit(1))["document_id"]
    longest = F.aggregate(F.filter(strings("r.evidence_texts"), lambda x: x.isNotNull()), F.lit(""), lambda acc, x: F.when(F.length(x) > F.length(acc), x).otherwise(acc))
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    edges = r.select(
        F.col("r.case_relation_id").alias("uid"), F.col("case_cluster_id").alias("case_id"), F.coalesce(first, F.try_element_at("r.source_document_ids", F.lit(1)), F.lit("")).alias("document_id"), F.col("r.case_relation_id").alias("relation_id"),
        text("r.head_case_event_id").alias("head_uid"), text("r.tail_case_event_id").alias("tail_uid"), text("r.relation_type").alias("relation_type"), F.coalesce(F.array_max("r.extraction_scores"), F.lit(0.0)).alias("score"), longest.alias("evidence_text"),
        strings("r.source_relation_ids").alias("source_relation_ids"), strings("r.source_document_ids").alias("source_document_ids"), F.coalesce("r.relation_state", F.lit("retained")).alias("relation_state"),
        *[strings(f"r.{c}").alias(c) for c in ("complementary_with", "conflict_with", "conflict_dimensions")],
    )
    return nodes.drop("sources"), edges
