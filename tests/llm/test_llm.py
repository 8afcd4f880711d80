import math
import os
import random
import unicodedata
from datetime import datetime

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from wrenmill.llm import bpe, entity_match, look_alikes, match_groups, mixing, queries, sentences, subjects, vector_graph

# --- vectors


def brute_pairs(ids, m, k):
    s = m @ m.T
    out = set()
    for i in range(len(ids)):
        order = sorted((j for j in range(len(ids)) if j != i), key=lambda j: (-round(s[i, j], 12), ids[j]))[:k]
        out |= {(min(ids[i], ids[j]), max(ids[i], ids[j])) for j in order}
    return out


def test_neighbours_against_brute_force(spark):
    rng = np.random.default_rng(1)
    centers = rng.standard_normal((12, 64))
    m = centers[rng.integers(0, 12, 400)] + 0.3 * rng.standard_normal((400, 64))
    ids = [f"d{i:04d}" for i in range(400)]
    rows = [(i, [float(x) for x in v * s], "clash") for i, v, s in zip(ids, m, rng.random(400) + 0.5)]
    rows += [rows[0], ("bad1", None, ""), ("bad2", [0.0] * 64, ""), ("bad3", [float("nan")] * 64, ""), ("bad4", [1.0] * 63, ""), (None, [1.0] * 64, "")]
    df = spark.createDataFrame(rows, "document_id string, embedding array<float>, node string")
    got = {(r.a, r.b) for r in vector_graph.near_pairs(df, "document_id", "embedding").collect()}
    want = brute_pairs(ids, (m / np.linalg.norm(m, axis=1)[:, None]), 10)
    assert len(got & want) / len(want) > 0.98 and len(got & want) / len(got) > 0.98


def test_equal_vectors_and_few(spark):
    v = [[1.0] + [0.0] * 63] * 15 + [[0.0, 1.0] + [0.0] * 62]
    df = spark.createDataFrame([(f"d{i:02d}", x) for i, x in enumerate(v)], "document_id string, embedding array<float>")
    got = {}
    for r in vector_graph.nearest(df, "document_id", "embedding").collect():
        got.setdefault(r.id, []).append((r["rank"], r.other))
    assert [o for _, o in sorted(got["d14"])] == [f"d{i:02d}" for i in range(10)]
    assert [o for _, o in sorted(got["d00"])] == [f"d{i:02d}" for i in range(1, 11)] and len(got["d15"]) == 10
    assert vector_graph.near_pairs(df.limit(0), "document_id", "embedding").count() == 0
    assert vector_graph.near_pairs(df.limit(1), "document_id", "embedding").count() == 0


def test_greedy_search_against_brute_force(spark):
    rng = np.random.default_rng(2)
    centers = rng.standard_normal((8, 64))
    m = centers[rng.integers(0, 8, 600)] + 0.5 * rng.standard_normal((600, 64))
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(m)] + [(900, None)], "i bigint, v array<float>")
    got = {}
    for r in vector_graph.search(df, df.filter("i % 20 = 0"), "i", "v").collect():
        got.setdefault(r.query_id, set()).add(r.other)
    u = m / np.linalg.norm(m, axis=1)[:, None]
    hits = sum(len(got[q] & set(x for x in np.argsort(-(u @ u[q]))[:11] if x != q)) for q in range(0, 600, 20))
    assert hits / 300 >= 0.95
    assert vector_graph.search(df.limit(0), df, "i", "v").count() == 0


def test_descent_over_many_leaves(spark):
    """20,000 vectors in some 30 leaves a tree: one descent round must mend what the leaves cut apart; search is measured on the same graph."""
    rng = np.random.default_rng(8)
    n = 20_000
    m = (rng.standard_normal((300, 64))[rng.integers(0, 300, n)] + 0.7 * rng.standard_normal((n, 64))).astype(np.float32)
    m[-40:] = m[0]
    pdf = pd.DataFrame({"i": np.arange(n), "v": list(m)})
    df = vector_graph.materialize(spark.createDataFrame(pdf, "i bigint, v array<float>"))
    u = m / np.linalg.norm(m, axis=1)[:, None]
    report = []
    got = {}
    for r in vector_graph.nearest(df, "i", "v", report=report).filter("id % 100 = 0").collect():
        got.setdefault(r.id, set()).add(r.other)
    found = {}
    for r in vector_graph.search(df, df.filter("i % 100 = 0"), "i", "v").collect():
        found.setdefault(r.query_id, set()).add(r.other)
    want = {q: {int(x) for x in np.lexsort((np.arange(n), -np.round(u @ u[q], 6)))[:11] if x != q} for q in range(0, n, 100)}
    hit = lambda out: sum(len(out[q] & set(sorted(w)[:10] if q == 0 else w)) for q, w in want.items()) / (10 * len(want))
    assert report[0] > 1000 and hit(got) >= 0.98 and hit(found) >= 0.9


# --- sentences


def test_sentences_of_clear_texts():
    a, b = "增压泵滴漏，读数2.5mm。", "原因为气蚀。"
    sample = [(a + b, [a, b]), ("Gap was 1.5 mm, see Fig. 1.2 for it. Team replaced it.", ["Gap was 1.5 mm, see Fig. 1.2 for it.", "Team replaced it."])] * 30
    chain = sentences.fit(sample)
    assert sentences.spans(a + b, chain) == [(0, len(a)), (len(a), len(a + b))]
    text = "  Gap was 1.5 mm, see Fig. 1.2 for it. Team replaced it.\n"
    assert [text[x:y] for x, y in sentences.spans(text, chain)] == ["Gap was 1.5 mm, see Fig. 1.2 for it.", "Team replaced it."]
    assert sentences.spans(" \n​", chain) == [] and sentences.spans("Heading", chain) == [(0, 7)]
    assert sentences.fit([]).decode([]) == []


def test_viterbi_is_the_best_sequence():
    rng = random.Random(3)
    feats = [[f"f{rng.randint(0, 4)}"] for _ in range(7)]
    chain = sentences.Chain({f"f{i}": rng.uniform(-2, 2) for i in range(5)}, np.array([[0.3, -0.7], [-0.2, 0.9]]))

    def score(tags):
        s, last = 0.0, 1
        for f, t in zip(feats, tags):
            s += chain.step[last][int(t)] + (chain.weight[f[0]] if t else 0)
            last = int(t)
        return s

    every = [[bool(n >> i & 1) for i in range(7)] for n in range(128)]
    assert math.isclose(score(chain.decode(feats)), max(map(score, every)))


def test_sentences_cover_texts(spark):
    df = spark.createDataFrame([("a", "X.\n\nY", 1), ("b", None, 1), ("c", " ", 1), ("a", "X.\n\nY", 1)], "k string, t string, row_key int")
    out = sentences.split(df, "k", "t", sentences.Chain({}, np.array([[0.0, 1.0], [0.0, 1.0]]))).collect()
    assert sorted((r.row_key, r.start_pos, r.end_pos) for r in out) == [("a", 0, 2), ("a", 4, 5)]


# --- look-alikes


def test_canonical_equals_whole_text_normalization():
    rng = random.Random(5)
    alphabet = "abe１ａＡѕо́̈​­ ²①½ﬁ⼈人ﾀﾞガ-‑ 　。，한하中é"
    for _ in range(400):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 12)))
        whole = "".join(look_alikes.form(c) if ord(c) > 127 else c for c in unicodedata.normalize("NFD", text))
        want = unicodedata.normalize("NFC", unicodedata.normalize("NFD", whole))
        got = look_alikes.canonical(text)
        assert got == want and look_alikes.canonical(got) == got, ascii(text)


def test_what_changes_the_look_and_what_does_not(spark):
    c = look_alikes.canonical
    assert c("ＴＲ２‑４　Ωа") == c("TR2-4 Ωa") and c("é") == "é" and c("a​b") == "ab" and c("⼈") == "人"
    assert c("m²") != c("m2") and c("A") != c("a") and c("é") != c("e") and c("a  b") != c("a b") and c("車") != c("车")
    df = spark.createDataFrame([("1", "Ａ b"), ("2", "A b"), ("3", "A b"), ("4", " "), ("5", "　"), ("6", None), ("7", "x")], "k string, t string")
    assert sorted(tuple(r) for r in look_alikes.same_look_pairs(df, "k", "t").collect()) == [("1", "2"), ("1", "3")]
    assert look_alikes.same_look_pairs(df.limit(0), "k", "t").count() == 0


# --- groups


def test_groups_against_union_find(spark):
    rng = random.Random(7)
    pairs = [(f"n{rng.randint(0, 150)}", f"n{rng.randint(0, 150)}") for _ in range(110)] + [(f"c{i:03d}", f"c{i + 1:03d}") for i in range(60)] + [("hub", f"h{i}") for i in range(80)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        if a != b:
            ra, rb = find(a), find(b)
            parent[max(ra, rb)] = min(ra, rb)
    df = spark.createDataFrame([*pairs, (None, "n1"), ("lone", "lone")], "a string, b string")
    got = {r.node: r.group_id for r in match_groups.groups(df, "a", "b").collect()}
    assert got == {x: find(x) for x in parent}
    assert match_groups.groups(df.limit(0), "a", "b").count() == 0


# --- tokens


@pytest.mark.skipif(not os.path.exists(bpe.TOKENIZER_DIR), reason="no tokenizer files")
def test_ids_equal_the_public_tokenizer(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(f"{bpe.TOKENIZER_DIR}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    texts = ["", None, " ", "Hello  world's\n\n", "增压泵滴漏", "aaaa" * 500, "<|endoftext|>", "日本語" * 300, "été 12 345,6", "\U0001f600‍"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r.doc_id: list(r.ids) for r in bpe.encode(df, "doc_id", "text").collect()}
    assert got == {i: t.encode(x or "", add_special_tokens=False).ids for i, x in enumerate(texts)}
    assert bpe.encode(df.limit(0), "doc_id", "text").count() == 0


# --- matching


# --- mixing and subjects


def test_mixing_reaches_targets(spark):
    docs = [(i, "word " * (5 + i % 7), ["a", "b", "c", "other"][i % 4]) for i in range(800)] + [(900, None, "a"), (901, "", "b"), (902, "word word", None)]
    d = spark.createDataFrame(docs, "doc_id bigint, text string, source string")
    t = spark.createDataFrame([("a", 0.6, 2), ("b", 0.3, 1), ("c", 0.1, 1), ("none", 0.0, 1)], "source string, target_share double, max_repeats bigint")
    used, report = mixing.mix(d, t)
    shares = {r.source: r for r in report.collect()}
    assert abs(shares["a"].reached_share - 0.6) < 0.03 and abs(shares["b"].reached_share - 0.3) < 0.03 and shares["none"].reached_share == 0
    assert all(r.most_copies <= r.max_repeats for r in shares.values()) and used.filter("source = 'other'").count() == 0
    assert mixing.mix(d.limit(0), t)[0].count() == 0


def test_subjects_held_out(spark):
    rng = random.Random(9)
    words = {"fuel": ["fuel pump dripping", "nozzle flow low", "metering valve stuck"], "oil": ["oil filter foaming", "bearing seal leak", "scavenge line clogged"], "law": ["audit clause missing", "certificate expired", "directive deadline"]}
    names = list(words)
    docs, labels, truth = [], [], {}
    for i in range(240):
        s = rng.sample(names, rng.choice([1, 1, 2]))
        docs.append((i, ". ".join(rng.choice(words[x]) + " was found" for x in s for _ in range(2)) + ". Work closed. Paperwork follows."))
        truth[i] = set(s)
        labels += [(i, x, "a1") for x in s] if i < 120 else []
    docs += [(300, None), (301, "  "), (302, "Work closed.")]
    d = spark.createDataFrame(docs, "doc_id bigint, text string")
    areas = spark.createDataFrame([(k + 1, n) for k, n in enumerate(names)], "subject_id bigint, subject_name string")
    lab = spark.createDataFrame([*labels, (1, None, "a1"), (None, "fuel", "a1"), (2, "unknown", "a2")], "doc_id bigint, subject_name string, annotator string")
    got = {}
    for r in subjects.subjects(d.withColumn("lens", F.lit("clash")), lab, areas).collect():
        got.setdefault(r.doc_id, set()).add(names[r.subject_id - 1])
    held = range(120, 240)
    assert sum(got.get(i, set()) == truth[i] for i in held) / len(held) > 0.9 and not {300, 301, 302} & set(got)
    assert subjects.subjects(d, lab.limit(0), areas).count() == 0 and subjects.subjects(d.limit(0), lab, areas).count() == 0


def test_queries_have_functions():
    assert {"p1_found", "p2_found", "p3_found", "p4_found", "p6_found", "p8_ids", "p9_mix", "p10_found"} <= set(queries.QUERIES)
