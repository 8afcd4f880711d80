"""Deeply nested JSON records as related flat tables.

A tree automaton reads every JSON value bottom-up. Leaves take a type state, arrays the least state that covers their elements, and an object the
signature of its (field, state) pairs together with two marks: it lists records itself (nodes, entities or relations), or a graph lies somewhere
below it. The marks decide the run at the top: an object with a list of `graphs`, or one without lists of its own above a graph at whatever
depth, is an envelope; an object with lists or a document_id is a graph; anything else is alien. Inside a graph the
lists give the classes node and relation, the list of a node the class view.

Objects are routed by class into supertype tables (one partition folder each) that keep the common keys, the parent link
and the variant, which is the object's signature; subtype_table() gives one variant with its own fields, typed by the automaton.

Lines that are no complete JSON object give nothing. A null array counts as absent, an element that
is no object is skipped, an object without an id keeps a null key and its ordinal. Numbers used as
ids keep the digits as written. A leading byte-order mark is dropped. Of a field given twice in one object the last counts.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache, reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wrenmill.runtime import materialize

# Alternate spellings, the first that is present wins.
NODE_ID = ("event_id", "entity_id", "node_id")
RELATION_ID = ("relation_id", "id")
HEAD_ID = ("head_event_id", "head")
TAIL_ID = ("tail_event_id", "tail")
NODE_LISTS = ("nodes", "entities")
RECORD_LISTS = ("nodes", "entities", "relations")

CLASSES = ("graph", "node", "view", "relation", "alien")

FLAT_SCHEMA = (
    "line_no bigint, graph_no int, document_id string, class string, ordinal int, parent_ordinal int, parent_key string, "
    "key string, head string, tail string, variant string, payload string"
)


class Number(str):
    """A JSON number kept as written."""

    whole = True


class Real(Number):
    whole = False


def _refuse(text: str) -> None:
    raise ValueError(f"no JSON number: {text}")


def parse_object(line: str | None) -> dict | None:
    """The JSON object that makes up the whole line, numbers as written, or None."""
    if line is None:
        return None
    try:
        value = json.loads(line.lstrip("﻿"), parse_int=Number, parse_float=Real, parse_constant=_refuse)
    except (ValueError, RecursionError):
        return None
    return value if isinstance(value, dict) else None


def leaf_state(value: object) -> str:
    if value is None:
        return "null"
    if isinstance(value, bool):
        return "boolean"
    if isinstance(value, Number):
        return "bigint" if value.whole else "double"
    return "string"


@lru_cache(maxsize=65_536)
def merge_states(a: str, b: str) -> str:
    """The least state that covers both: null below all, bigint below double, structures and arrays part by part, string on top."""
    if a == b or b == "null":
        return a
    if a == "null":
        return b
    if a.startswith("struct<") and b.startswith("struct<"):
        x, y = fields_of(a), fields_of(b)
        return "struct<" + ",".join(f"{k}:{merge_states(x.get(k, 'null'), y.get(k, 'null'))}" for k in sorted(x | y)) + ">"
    if a.startswith("array<") and b.startswith("array<"):
        return f"array<{merge_states(a[6:-1], b[6:-1])}>"
    return "double" if {a, b} == {"bigint", "double"} else "string"


def fields_of(variant: str) -> dict[str, str]:
    """The fields of a variant with their states, in order."""
    out: dict[str, str] = {}
    depth, start = 0, 0
    inner = variant[len("struct<") : -1]
    for i, c in enumerate([*inner, ","]):
        depth += (c == "<") - (c == ">")
        if c == "," and not depth and i > start:
            name, _, state = inner[start:i].partition(":")
            out[name] = state
            start = i + 1
    return out


class Run:
    """The automaton's run over one parsed line: the state of every object and whether a graph lies below it."""

    def __init__(self, top: dict) -> None:
        self.at: dict[int, tuple[str, bool]] = {}
        self.top = top
        self._up(top)

    def _up(self, value: object) -> tuple[str, bool]:
        """(state, a graph is here or below), children first."""
        if isinstance(value, dict):
            parts, below = [], False
            for k in sorted(value):
                state, found = self._up(value[k])
                parts.append(f"{k}:{state}")
                below |= found and k not in RECORD_LISTS
            state = "struct<" + ",".join(parts) + ">"
            self.at[id(value)] = (state, below)
            return state, below or self.lists(value) or "document_id" in value
        if isinstance(value, list):
            inner, below = "null", False
            for child in value:
                state, found = self._up(child)
                inner = merge_states(inner, state)
                below |= found
            return f"array<{inner}>", below
        return leaf_state(value), False

    @staticmethod
    def lists(value: dict) -> bool:
        return any(isinstance(value.get(k), list) for k in RECORD_LISTS)

    def variant(self, value: dict) -> str:
        return self.at[id(value)][0]

    def object_class(self, value: dict) -> str:
        """envelope, graph or alien; objects in the lists of a graph take their class from the list."""
        below = self.at[id(value)][1]
        if isinstance(value.get("graphs"), list) or (below and not self.lists(value)):
            return "envelope"
        return "graph" if self.lists(value) or "document_id" in value else "alien"

    def accepted(self) -> Iterator[tuple[str, dict]]:
        """The graphs and alien objects of the line in reading order; envelopes are opened at whatever depth they are."""
        todo: list[object] = [self.top]
        while todo:
            value = todo.pop()
            if isinstance(value, list):
                todo.extend(reversed(value))
            elif isinstance(value, dict):
                kind = self.object_class(value)
                if kind != "envelope":
                    yield kind, value
                    continue
                # only a list of graphs or a field above a graph is opened; the rest of an envelope is its own data
                todo.extend(reversed([v for k, v in value.items() if k == "graphs" or self._above(v)]))

    def _above(self, value: object) -> bool:
        if isinstance(value, list):
            return any(self._above(x) for x in value)
        return isinstance(value, dict) and self.object_class(value) != "alien"


def text_of(value: object) -> str | None:
    if value is None or isinstance(value, (dict, list)):
        return None
    if isinstance(value, bool):
        return "true" if value else "false"
    return str(value)


def first_of(value: dict, names: tuple[str, ...]) -> str | None:
    """The first spelling that is present and not null."""
    for name in names:
        if value.get(name) is not None:
            return text_of(value[name])
    return None


def dump(value: object) -> str:
    """JSON text with numbers as written."""
    if isinstance(value, dict):
        return "{" + ",".join(json.dumps(k, ensure_ascii=False) + ":" + dump(v) for k, v in value.items()) + "}"
    if isinstance(value, list):
        return "[" + ",".join(map(dump, value)) + "]"
    return str(value) if isinstance(value, Number) else json.dumps(value, ensure_ascii=False)


def _objects(value: object) -> list[tuple[int, dict]]:
    return [(i, x) for i, x in enumerate(value) if isinstance(x, dict)] if isinstance(value, list) else []


def flatten_object(line_no: int, top: dict, with_payload: bool = True) -> Iterator[tuple]:
    """All rows of one parsed line."""
    run = Run(top)
    body = dump if with_payload else lambda value: None
    for g, (kind, graph) in enumerate(run.accepted()):
        if kind == "alien":
            yield (line_no, g, None, "alien", g, None, None, None, None, None, run.variant(graph), body(graph))
            continue
        doc = text_of(graph.get("document_id"))
        lists = [graph[k] for k in NODE_LISTS if graph.get(k) is not None]
        own = {k: v for k, v in graph.items() if k not in RECORD_LISTS} if with_payload else None
        yield (line_no, g, doc, "graph", g, None, None, doc, None, None, run.variant(graph), body(own))
        for i, node in _objects(lists[0] if lists else None):
            key = first_of(node, NODE_ID)
            own = {k: v for k, v in node.items() if k != "views"} if with_payload else None
            yield (line_no, g, doc, "node", i, g, doc, key, None, None, run.variant(node), body(own))
            for j, view in _objects(node.get("views")):
                yield (line_no, g, doc, "view", j, i, key, text_of(view.get("view")), None, None, run.variant(view), body(view))
        for i, rel in _objects(graph.get("relations")):
            yield (line_no, g, doc, "relation", i, g, doc, first_of(rel, RELATION_ID), first_of(rel, HEAD_ID), first_of(rel, TAIL_ID), run.variant(rel), body(rel))


def _flatten(with_payload: bool):
    columns = [c.split(" ")[0] for c in FLAT_SCHEMA.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows: list[tuple] = []
            for line_no, line in zip(pdf["line_no"], pdf["line"]):
                top = parse_object(line)
                if top is not None:
                    rows.extend(flatten_object(line_no, top, with_payload))
                if len(rows) > 20_000:
                    yield _frame(rows, columns)
                    rows = []
            yield _frame(rows, columns)

    return run


def _frame(rows: list[tuple], columns: list[str]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=columns)
    for c in ("graph_no", "ordinal", "parent_ordinal"):
        out[c] = out[c].astype("Int32")
    return out


def flatten_lines(lines: DataFrame, with_payload: bool = True) -> DataFrame:
    """One row per object of every readable graph, in one narrow pass: no shuffle, no driver step.

    lines: line_no, line and any other columns, which are not read.
    """
    source = lines.select(F.col("line_no").cast("bigint").alias("line_no"), F.col("line").cast("string").alias("line"))
    return source.mapInPandas(_flatten(with_payload), FLAT_SCHEMA)


def route(lines: DataFrame, with_payload: bool = True) -> dict[str, DataFrame]:
    """The supertype tables graph, node, view, relation and alien, written once, one folder per class.

    Every table keeps line_no, graph_no, document_id, ordinal, parent_ordinal, parent_key, key, variant and payload; relation also head and tail.
    """
    flat = materialize(flatten_lines(lines, with_payload), "nested", by="class")
    return tables(flat)


def tables(flat: DataFrame) -> dict[str, DataFrame]:
    """The supertype tables of flattened lines."""
    shared = ["line_no", "graph_no", "document_id", "ordinal", "parent_ordinal", "parent_key", "key", "variant", "payload"]
    return {c: flat.filter(F.col("class") == c).select(*shared, *(["head", "tail"] if c == "relation" else [])) for c in CLASSES}


def variants(routed: dict[str, DataFrame]) -> DataFrame:
    """Number of objects per class and structural variant."""
    each = [df.groupBy(F.lit(c).alias("class"), "variant").agg(F.count(F.lit(1)).alias("n_objects")) for c, df in routed.items()]
    return reduce(DataFrame.unionByName, each)


def subtype_table(table: DataFrame, variant: str) -> DataFrame:
    """The rows of one variant with its own fields (f_name) typed by the automaton; nested fields stay JSON text."""
    typed = {k: s if s in ("bigint", "double", "boolean") else "string" for k, s in fields_of(variant).items()}
    rows = table.filter(F.col("variant") == variant)
    keep = [c for c in table.columns if c not in ("variant", "payload")]
    if not typed:
        return rows.select(*keep)
    parsed = F.from_json("payload", ", ".join(f"`{k}` {t}" for k, t in typed.items()))
    return rows.select(*keep, *[parsed.getField(k).alias(f"f_{k}") for k in typed])


def parent_links(routed: dict[str, DataFrame]) -> DataFrame:
    """Distinct (document_id, link, parent_key, child_key) from the supertype tables; links without a child key give no row."""
    link = lambda c, name, parent, child: routed[c].select("document_id", F.lit(name).alias("link"), F.col(parent).alias("parent_key"), F.col(child).alias("child_key"))
    each = [link("node", "node", "parent_key", "key"), link("view", "view", "parent_key", "key"), link("relation", "relation", "parent_key", "key")]
    each += [link("relation", "head", "key", "head"), link("relation", "tail", "key", "tail")]
    return reduce(DataFrame.unionByName, each).filter("child_key IS NOT NULL").distinct()
