"""Visually identical text with different characters, brought to one canonical form.

Characters fall into three classes by their normalization properties: stable ones; S, which have another
canonical form but meet no neighbour; and M, combining marks and all that may compose with what stands before.
One pattern isolates the unstable segments, an M run always with the character before it; only these segments are
normalized and spliced into the unchanged rest. The JVM screens texts first, and those of plain
characters never reach Python.

The canonical form folds width and style, the storage of accents, kinds of blanks and hyphens and
letters of other alphabets with the shape of a Latin one, and drops invisible characters. It keeps letter case,
accents, raised, lowered, circled and fraction figures, and the number of blanks and line breaks.

Null texts stay null; blank texts take part in no pair. Texts are whole whatever their length.
"""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wrenmill.runtime import materialize

# Letters of other alphabets with the shape of a Latin letter.
SAME_SHAPE = {
    "А": "A", "В": "B", "Е": "E", "Ѕ": "S", "І": "I", "Ј": "J", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "Х": "X", "Ү": "Y",
    "а": "a", "е": "e", "ѕ": "s", "і": "i", "ј": "j", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
    "ο": "o", "ϲ": "c", "Ϲ": "C", "ϳ": "j",
}

# Hyphens of one look, line breaks, and the decompositions that change the look.
HYPHENS = "‐‑‒–−﹣－"
LINE_BREAKS = "\u0085  "
KEPT_DECOMPOSITIONS = ("<super>", "<sub>", "<circle>", "<fraction>")

#: Code points that can have a normalization property at all; ideographs, syllables and private ones are stable.
RANGES = ((0x80, 0x3400), (0xA000, 0xAC00), (0xD7A4, 0xD800), (0xF900, 0x20000), (0x2F800, 0x2FA20), (0xE0000, 0xE1000))


def invisible(c: str) -> bool:
    """Format characters, variation selectors and other default-ignorable ones."""
    n = ord(c)
    return unicodedata.category(c) == "Cf" or n in (0x034F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x3164, 0xFFA0) or 0x180B <= n <= 0x180F or 0xFE00 <= n <= 0xFE0F or 0xE0100 <= n <= 0xE01EF


def form(c: str) -> str:
    """The decomposed canonical form of one character."""
    if invisible(c):
        return ""
    if c in LINE_BREAKS:
        return "\n"
    if c in HYPHENS:
        return "-"
    if unicodedata.category(c) == "Zs" or c == "\t":
        return " "
    if unicodedata.decomposition(c).startswith(KEPT_DECOMPOSITIONS):
        return c
    out = unicodedata.normalize("NFKD", c)
    if out != c:
        # a compatibility form may itself hold a kept or an invisible character
        out = "".join(SAME_SHAPE.get(x, x) for x in out if not invisible(x))
        if c not in ("¨", "¯", "´", "¸") and out.startswith(" ") and len(out) > 1:
            out = out[1:] if unicodedata.combining(out[1]) == 0 else out
        return out
    return SAME_SHAPE.get(c, c)


class Properties:
    """The two unstable classes as a pattern, and the form of every unstable character."""

    def __init__(self) -> None:
        single, mark = [], []
        self.forms: dict[str, str] = {"\t": " "}
        for a, b in RANGES:
            for n in range(a, b):
                c = chr(n)
                if unicodedata.category(c) in ("Cn", "Co", "Cs"):
                    continue
                f = form(c)
                meets = unicodedata.combining(f[0]) != 0 or not unicodedata.is_normalized("NFC", "a" + f[0]) or unicodedata.category(f[0]) in ("Mn", "Mc") if f else False
                jamo = 0x1161 <= n <= 0x1175 or 0x11A8 <= n <= 0x11C2
                if f != c or meets or jamo:
                    self.forms[c] = f
                if meets or jamo:
                    mark.append(n)
                elif unicodedata.normalize("NFC", f) != c:
                    single.append(n)
        s, m = _class([9, *single]), _class(mark)
        self.segments = re.compile(f"[^{m}]?[{s}]*[{m}][{s}{m}]*|[{s}]+", re.DOTALL)


def _class(points: list[int]) -> str:
    """The inside of a character class."""
    parts, i = [], 0
    while i < len(points):
        j = i
        while j + 1 < len(points) and points[j + 1] == points[j] + 1:
            j += 1
        parts.append(f"\\U{points[i]:08x}" + (f"-\\U{points[j]:08x}" if j > i else ""))
        i = j + 1
    return "".join(parts)


_properties: list[Properties] = []
_known: dict[str, str] = {}


def _segment(m: re.Match) -> str:
    s = m.group()
    out = _known.get(s)
    if out is None:
        forms = _properties[0].forms
        out = unicodedata.normalize("NFC", unicodedata.normalize("NFD", "".join(forms.get(c) if c in forms else c for c in unicodedata.normalize("NFD", s))))
        if len(_known) < 100_000:
            _known[s] = out
    return out


def canonical(text: str) -> str:
    """The canonical form of a text."""
    if not _properties:
        _properties.append(Properties())
    out = _properties[0].segments.sub(_segment, text)
    return out.replace("\r\n", "\n").replace("\r", "\n") if "\r" in out else out


#: Texts of these characters alone are canonical already.
STABLE = r"^[\n\x20-\x7E“”‘’„«»。、「」『』\x{4E00}-\x{9FFF}\x{3041}-\x{3096}\x{30A1}-\x{30FA}\x{C0}-\x{FF}]*$"


@F.pandas_udf(T.StringType())
def _canonical(texts: pd.Series) -> pd.Series:
    seen: dict[str, str] = {}
    out = []
    for t in texts:
        if t is None:
            out.append(None)
            continue
        c = seen.get(t)
        if c is None:
            c = seen[t] = canonical(t)
        out.append(c)
    return pd.Series(out, dtype=object)


def canonical_column(text: Column) -> Column:
    """The canonical form of a column; plain texts stay in the JVM."""
    return F.coalesce(_canonical(F.when(~text.rlike(STABLE), text)), text)


def same_look_pairs(rows: DataFrame, key: str, text: str, within: str | None = None) -> DataFrame:
    """(key_a, key_b), key_a < key_b: keys whose texts aren't blank, look the same and differ, of one value of `within` if given.

    Only hashes of 128 bits travel. Looks with one spelling alone are left before any pair is made.
    """
    keep = [F.col(key).alias("__k"), F.col(text).alias("__t")] + ([F.col(within).alias("__w")] if within else [])
    some = rows.select(*keep).filter("__k IS NOT NULL AND __t IS NOT NULL" + (" AND __w IS NOT NULL" if within else ""))
    seen = some.withColumn("__c", canonical_column(F.col("__t"))).filter(F.length(F.trim(F.translate("__c", "\n\r\t\x0b\x0c", "     "))) > 0)
    place = [F.col("__w")] if within else []
    # written once: the hashes feed the search for mixed looks and both sides of the join
    hashed = seen.select(
        "__k",
        F.xxhash64("__c", *place).alias("c1"),
        F.xxhash64(F.lit(1), "__c", *place).alias("c2"),
        F.xxhash64("__t").alias("r1"),
    ).distinct()
    hashed = materialize(hashed, "p3-looks")
    mixed = hashed.groupBy("c1", "c2").agg((F.min("r1") != F.max("r1")).alias("mixed")).filter("mixed").select("c1", "c2")
    left = hashed.join(mixed, ["c1", "c2"], "left_semi")
    a = left.select("c1", "c2", F.col("__k").alias("key_a"), F.col("r1").alias("ra"))
    b = left.select("c1", "c2", F.col("__k").alias("key_b"), F.col("r1").alias("rb"))
    return a.join(b, ["c1", "c2"]).filter("ra <> rb AND key_a < key_b").select("key_a", "key_b").distinct()
