"""Retrieval of entity matching against scoring every pair, and the edges of the operator."""

import datetime as dt
import random

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from wrenmill.llm import entity_match as m


def tables(spark, n=60, seed=3, engines=20, months=1):
    rng = random.Random(seed)
    words = ["oil", "pump", "leak", "seal", "crack", "valve", "hose", "blade", "滑油渗漏", "更换密封圈", "燃烧室裂纹"]
    records, entries = [], []
    for i in range(n):
        unit, day, month = f"{rng.randrange(engines) * 739:07d}" if i % 3 else "1234567", rng.randrange(1, 26), 1 + rng.randrange(months)
        said = " ".join(rng.sample(words, 4))
        records.append((f"D{i:03d}", f"unit LX4-{unit} {said} gap {rng.randrange(9)}.{rng.randrange(99)} mm", f"2023-{month:02d}-{day:02d} 08:00:00"))
        if i % 2:
            typed = unit if i % 4 else unit[:3] + unit[4] + unit[3] + unit[5:]
            entries.append((f"W{i:03d}", f"LX4-{typed}" if i % 5 else None, f"2023-{month:02d}-{day + i % 3:02d}" if i % 7 else None, " ".join(rng.sample(said.split(), 2))))
    r = spark.createDataFrame(records, "document_id string, text string, recorded_at string").withColumn("recorded_at", F.to_timestamp("recorded_at"))
    return r, spark.createDataFrame(entries, "entry_id string, unit_ref string, opened_on string, summary string")


def test_retrieval_is_exact(spark):
    r, e = tables(spark)
    recs = m.materialize(m.bags(r, "document_id", "text", None, "recorded_at"))
    ents = m.materialize(m.bags(e, "entry_id", "summary", "unit_ref", "opened_on"))
    postings = m.materialize(recs.select(F.col("id").alias("d"), "day", "s", F.explode(F.concat("n", "t")).alias("tok")))
    asked = m.materialize(m.queries(ents, recs, postings, recs.count()))
    every = m.scored(asked.select("e").crossJoin(recs.select(F.col("id").alias("d"))), asked, recs).toPandas()
    near_day = every[(every.same_day > 0) & (every.same_unit > 0)].groupby("e").score.max()
    for least in (0.2, 0.5):
        got = {(x.e, x.d): x.score for x in m.retrieve(asked, recs, postings, least).collect()}
        bound = {k: max(least, near_day.get(k, 0.0) - m.WIDE) for k in every.e.unique()}
        want = {(x.e, x.d) for x in every.itertuples() if x.score >= bound[x.e] - 1e-9}
        assert set(got) == want and len(want) > 20
        assert all(abs(got[(x.e, x.d)] - x.score) < 1e-9 for x in every.itertuples() if (x.e, x.d) in got)


def test_matches_and_edges(spark):
    r, e = tables(spark, 300, engines=9000, months=12)
    got = m.match(r, e.unionByName(e.limit(3))).collect()
    right = sum(x.document_id[1:] == x.entry_id[1:] for x in got)
    assert right >= 0.8 * e.count() and right >= 0.75 * len(got) and all(0.5 <= x.confidence <= 1 for x in got)
    assert m.match(r.limit(0), e).count() == 0 and m.match(r, e.limit(0)).count() == 0
    odd = spark.createDataFrame([(None, "x", None, "y"), ("W1", None, None, None), ("W2", "", "soon", "")], e.schema)
    assert m.match(r.withColumn("score", F.lit(1)).withColumn("unit", F.lit("x")), odd).count() == 0


def test_tokens():
    serials, numbers, words = m.tokens(m.clean("LX4-1234567 ｇａｐ 2,50 mm 滑油渗漏"), m.clean("s/n lx47654321"))
    assert "1234567" in serials and "7654321" in serials and numbers == ["2.5"] and {"gap", "^gap", "滑油", "油渗"} <= set(words)
    assert m.day_of("2023年5月4日") == m.day_of("4 May 2023") == m.day_of("04.05.2023") and m.day_of("soon") is None


def busy(n=3000, seed=5):
    """Records and entries as in large tables: an engine number is more than half of an entry, and most are near to several others; the pairs, and those that share no word."""
    rng = random.Random(seed)
    words = [a + b for a in ("oil", "fuel", "seal", "fan", "hose", "gear") for b in ("leak", "crack", "wear", "noise")]
    engines = [f"{x:07d}" for x in rng.sample(range(20 * n), n // 2)]
    day = lambda: str(dt.date(2021, 1, 1) + dt.timedelta(rng.randrange(60)))
    records, entries, pairs, foreign = [], [], set(), set()
    for i in range(n):
        unit, on, said = rng.choice(engines), day(), rng.sample(words, 3)
        records.append((f"D{i}", f"unit LX4-{unit} {' '.join(said)} found", f"{on} 08:00:00"))
        if i % 10 < 6:
            pairs.add((f"D{i}", f"W{i}"))
            if i % 20 == 0:
                foreign.add((f"D{i}", f"W{i}"))
            entries.append((f"W{i}", f"LX4-{unit}", on, "sonstige Arbeit erledigt" if i % 20 == 0 else " ".join(said[: 1 + i % 3])))
        else:
            entries.append((f"X{i}", f"LX4-{int(unit) + 4321000:07d}", day(), " ".join(rng.sample(words, 1 + i % 3))))
    return spark_rows(records, "document_id string, text string, recorded_at string"), spark_rows(entries, "entry_id string, unit_ref string, opened_on string, summary string"), pairs, foreign


def spark_rows(rows, schema):
    return SparkSession.getActiveSession().createDataFrame(rows, schema)


def test_engine_and_day_suffice_in_large_tables(spark):
    records, entries, pairs, foreign = busy()
    # a record filed again is a match as well; two records that differ in the engine alone are not both meant by an entry without one
    records = records.unionByName(spark_rows([("C1", "unit LX4-7000001 fanwear found", "2021-01-05 08:00:00"), ("C2", "unit LX4-7000001 fanwear found", "2021-01-05 08:00:00")], records.schema))
    records = records.unionByName(spark_rows([("T1", "unit LX4-8000001 aileron stuck", "2021-01-05 08:00:00"), ("T2", "unit LX4-9000002 aileron stuck", "2021-01-05 08:00:00")], records.schema))
    entries = entries.unionByName(spark_rows([("C", "LX4-7000001", "2021-01-05", "fanwear"), ("T", None, "2021-01-05", "aileron stuck")], entries.schema))
    got = {(x.document_id, x.entry_id) for x in m.match(records.withColumn("recorded_at", F.to_timestamp("recorded_at")), entries).collect()}
    assert {("C1", "C"), ("C2", "C")} <= got and not {("T1", "T"), ("T2", "T")} <= got
    assert len(foreign & got) >= 0.9 * len(foreign) and len(pairs & got) >= 0.95 * len(pairs) and len(pairs & got) >= 0.95 * len(got)
