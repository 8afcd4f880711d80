"""Token ids of a public byte-level BPE tokenizer by merge replay over the words of the corpus.

1. Texts are cut into words; 2. the distinct words of the whole corpus become one table; 3. the merges are replayed over that table:
its words stand end to end in a symbol array, with an inverted index from token pair to the positions where it stands. Merges are applied in
rank order: a merge visits only its own positions, joins the two symbols and enters the new pairs of the two neighbours. As no pair
spans two words, each part of the table replays all ranks over its own words, and every word of the corpus is replayed once. 4. The ids are joined back to
the words of each text, frequent words by broadcast (skew_lookup), and put together in order.

Null and empty texts both give the empty list. Texts are whole whatever their length; a word
without any break is one run of the array, for n symbols O(n log n).
"""

from __future__ import annotations

import heapq
import json
import os
from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wrenmill.runtime import materialize, skew_lookup

TOKENIZER_DIR = "/opt/tokenizers"

#: Fixed value: the word pattern of byte-level BPE vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

_loaded: dict[str, "Merges"] = {}


def byte_letters() -> dict[str, int]:
    """The printable letter of each byte: printable Latin-1 stands for itself, the rest follows from U+0100 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    letters = {chr(b): b for b in shown}
    for i, b in enumerate(b for b in range(256) if b not in set(shown)):
        letters[chr(256 + i)] = b
    return letters


class Merges:
    """Ids of the single bytes and of all merges, by pair of ids, with their rank."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab = model["vocab"]
        self.byte_id = [0] * 256
        for letter, byte in byte_letters().items():
            self.byte_id[byte] = vocab[letter]
        self.merge: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            self.merge.setdefault((vocab[left], vocab[right]), (rank, vocab[left + right]))
        self.words = regex.compile(PATTERN)


def merges(path: str) -> Merges:
    if path not in _loaded:
        _loaded[path] = Merges(path)
    return _loaded[path]


def replay(words: list[str], m: Merges) -> list[list[int]]:
    """Ids of each word, all merges applied over all words at once in rank order."""
    symbol: list[int] = []
    starts: list[int] = []
    for w in words:
        starts.append(len(symbol))
        symbol.extend([m.byte_id[b] for b in w.encode("utf-8", "surrogatepass")])
        symbol.append(-1)
    n = len(symbol)
    after = list(range(1, n + 1))
    before = list(range(-1, n - 1))
    index: dict[tuple[int, int], list[int]] = {}
    for i in range(n - 1):
        pair = (symbol[i], symbol[i + 1])
        if pair in m.merge:
            index.setdefault(pair, []).append(i)
    heap = [(m.merge[pair][0], pair) for pair in index]
    heapq.heapify(heap)
    while heap:
        _, pair = heapq.heappop(heap)
        places = index.pop(pair, None)
        if not places:
            continue
        a, b = pair
        new = m.merge[pair][1]
        touched: dict[tuple[int, int], None] = {}
        for i in sorted(places):
            j = after[i]
            if symbol[i] != a or j >= n or symbol[j] != b:
                continue
            k = after[j]
            symbol[i], symbol[j] = new, -2
            after[i] = k
            if k < n:
                before[k] = i
            h = before[i]
            for p, q in ((h, i), (i, k)):
                if 0 <= p and q < n:
                    near = (symbol[p], symbol[q])
                    if near in m.merge:
                        if near not in index:
                            index[near] = []
                            touched[near] = None
                        index[near].append(p)
        for near in touched:
            heapq.heappush(heap, (m.merge[near][0], near))
    out = []
    for s in starts:
        ids = []
        while symbol[s] != -1:
            ids.append(symbol[s])
            s = after[s]
        out.append(ids)
    return out


def _cut(path: str, key: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = merges(path)
        for pdf in batches:
            yield pd.DataFrame({key: pdf[key], "__words": [m.words.findall(t) if t else [] for t in pdf["__text"]]})

    return run


def _replayed(path: str, most: int = 200_000):
    """The word table's parts; most characters of words stand in one symbol array."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = merges(path)
        held: list[str] = []
        size = 0
        for pdf in batches:
            for w in pdf["__word"]:
                held.append(w)
                size += len(w)
                if size > most:
                    yield pd.DataFrame({"__word": held, "__ids": replay(held, m)})
                    held, size = [], 0
        if held:
            yield pd.DataFrame({"__word": held, "__ids": replay(held, m)})

    return run


def encode(texts: DataFrame, key: str, text: str, tokenizer: str | None = None, count_only: bool = False) -> DataFrame:
    """(key, ids) of every row, or (key, n_tokens) with count_only; key keeps its type, other columns are not read."""
    path = tokenizer or os.path.join(TOKENIZER_DIR, "byte_bpe_50k.json")
    kind = texts.schema[key].dataType.simpleString()
    source = texts.select(F.col(key), F.col(text).cast("string").alias("__text"))
    cut = source.mapInPandas(_cut(path, key), f"`{key}` {kind}, __words array<string>")
    cut = materialize(cut.withColumn("__row", F.monotonically_increasing_id()), "p8-words")
    placed = cut.select("__row", F.posexplode("__words").alias("__pos", "__word"))
    words = placed.select("__word").distinct().mapInPandas(_replayed(path), "__word string, __ids array<int>")
    words = materialize(words, "p8-table")
    if count_only:
        sized = skew_lookup(placed, words.select("__word", F.size("__ids").alias("__n")), "__word")
        sums = sized.groupBy("__row").agg(F.sum("__n").alias("__n"))
        return cut.select("__row", key).join(sums, "__row", "left").select(key, F.coalesce("__n", F.lit(0)).cast("bigint").alias("n_tokens"))
    found = skew_lookup(placed, words, "__word")
    whole = found.groupBy("__row").agg(F.collect_list(F.struct("__pos", "__ids")).alias("__l"))
    ids = F.flatten(F.transform(F.array_sort("__l"), lambda x: x["__ids"]))
    return cut.select("__row", key).join(whole.select("__row", ids.alias("ids")), "__row", "left").select(key, F.coalesce("ids", F.array().cast("array<int>")).alias("ids"))
