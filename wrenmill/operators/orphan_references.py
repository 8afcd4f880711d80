"""References to records that do not exist.

A Bloom filter of the parent keys, built and probed as DataFrame expressions, proves most orphans
without a join; only filter-positive references are verified by an exact join. The filter is a
table of 64-bit words: a key sets BITS bits of one word, words are combined with bit_or. Their number follows that of
the parents (BITS_PER_KEY bits each), so the share of false positives stays the same at any size. Up to MAX_WORDS (16 MB of longs) the
words are broadcast; a larger filter is partitioned by word, and references meet their word by a shuffle that carries no parent key.

Nulls and empty strings are no references. A parent key with a null is ignored. Repeated rows count
once, by their first load time. Rows without a load time can be 'missing' but neither late nor deleted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wrenmill.runtime import materialize, skew_lookup

BITS = 4
BITS_PER_KEY = 16
MAX_WORDS = 1 << 21


def _word(key: Column, words: int) -> Column:
    return F.pmod(F.shiftright(F.xxhash64(key), 20), F.lit(words))


def _mask(key: Column) -> Column:
    """BITS bits of a 64-bit word, taken from an independent hash in 6-bit slices."""
    h = F.xxhash64(key, F.lit(7))
    one = F.lit(1).cast("bigint")
    mask = F.lit(0).cast("bigint")
    for i in range(BITS):
        at = F.shiftright(h, 6 * i).bitwiseAND(F.lit(63).cast("bigint")).cast("int")
        mask = mask.bitwiseOR(F.call_function("shiftleft", one, at))
    return mask


def bloom_words(parents: DataFrame, key: str, n_parents: int) -> tuple[DataFrame, int]:
    """The filter as (word, bits), one row per non-empty word, and the number of words it addresses."""
    words = max(64, n_parents * BITS_PER_KEY // 64 + 1)
    bits = (
        parents.filter(F.col(key).isNotNull())
        .select(_word(F.col(key), words).alias("__word"), _mask(F.col(key)).alias("__m"))
        .groupBy("__word")
        .agg(F.bit_or("__m").alias("__bits"))
    )
    return bits, words


def first_loads(rows: DataFrame, key: str, loaded: str = "loaded_at", deleted: str | None = "deleted_at") -> DataFrame:
    """Per key the first load time and the first deletion time (columns ref_key, first_loaded, deleted)."""
    gone = F.min(deleted) if deleted else F.lit(None).cast("timestamp")
    return (
        rows.filter(F.col(key).isNotNull())
        .groupBy(F.col(key).alias("ref_key"))
        .agg(F.min(loaded).alias("first_loaded"), gone.alias("deleted"))
    )


def orphans(references: DataFrame, parents: DataFrame, n_parents: int | None = None, max_words: int = MAX_WORDS) -> DataFrame:
    """Orphan references with their reason and month.

    references: table_name, field_name, row_key, ref_key, t (first load of the referring row), distinct.
    parents: ref_key, first_loaded, deleted, unique on ref_key (see first_loads).
    """
    if n_parents is None:
        n_parents = parents.count()
    bits, words = bloom_words(parents, "ref_key", n_parents)
    refs = references.filter(F.col("ref_key").isNotNull() & (F.col("ref_key") != ""))
    mask = _mask(F.col("ref_key"))
    probed = (
        refs.withColumn("__word", _word(F.col("ref_key"), words))
        .join(F.broadcast(bits) if words <= max_words else bits, "__word", "left")
        .withColumn("__maybe", F.coalesce(F.col("__bits").bitwiseAND(mask) == mask, F.lit(False)))
        .drop("__word", "__bits")
    )
    sure = probed.filter(~F.col("__maybe")).withColumn("reason", F.lit("missing"))
    found = F.struct("first_loaded", "deleted", F.lit(True).alias("hit"))
    checked = skew_lookup(probed.filter("__maybe"), parents.select("ref_key", found.alias("__p")), "ref_key")
    checked = checked.withColumn(
        "reason",
        F.when(F.col("__p").isNull(), "missing")
        .when(F.col("__p.first_loaded") > F.col("t"), "late")
        .when(F.col("__p.deleted") <= F.col("t"), "deleted"),
    ).filter("reason IS NOT NULL")
    out = ["table_name", "field_name", "row_key", "ref_key", "reason", F.date_format("t", "yyyy-MM").alias("period")]
    return sure.select(*out).unionByName(checked.select(*out))


def maintenance_orphans(edges: DataFrame, nodes: DataFrame, records: DataFrame) -> DataFrame:
    """Orphans of relation_edges.head_uid, tail_uid (to event_nodes.uid) and event_nodes.source_document_ids (to records)."""
    node_keys = materialize(first_loads(nodes, "uid"), "p5-nodes")
    record_keys = materialize(first_loads(records, "document_id"), "p5-records")
    ends = F.array(
        F.struct(F.lit("head_uid").alias("field_name"), F.col("head_uid").alias("ref_key")),
        F.struct(F.lit("tail_uid").alias("field_name"), F.col("tail_uid").alias("ref_key")),
    )
    edge_refs = (
        edges.select("uid", "loaded_at", F.inline(ends))
        .filter("ref_key IS NOT NULL AND ref_key <> ''")
        .groupBy(F.col("uid").alias("row_key"), "field_name", "ref_key")
        .agg(F.min("loaded_at").alias("seen"))
    )
    edge_first = first_loads(edges, "uid", deleted=None).select(F.col("ref_key").alias("row_key"), F.col("first_loaded").alias("t"))
    edge_refs = edge_refs.join(edge_first, "row_key").select(
        F.lit("relation_edges").alias("table_name"), "field_name", "row_key", "ref_key", "t"
    )
    node_refs = (
        nodes.select(F.col("uid").alias("row_key"), F.explode("source_document_ids").alias("ref_key"))
        .filter("ref_key IS NOT NULL AND ref_key <> ''")
        .distinct()
        .join(node_keys.select(F.col("ref_key").alias("row_key"), F.col("first_loaded").alias("t")), "row_key")
        .select(F.lit("event_nodes").alias("table_name"), F.lit("source_document_ids").alias("field_name"), "row_key", "ref_key", "t")
    )
    return orphans(edge_refs, node_keys).unionByName(orphans(node_refs, record_keys))


def orphan_report(found: DataFrame) -> DataFrame:
    """Orphans counted per table, field, reason and month."""
    return found.groupBy("table_name", "field_name", "reason", "period").agg(
        F.count(F.lit(1)).alias("n_references"), F.countDistinct("ref_key").alias("n_keys")
    )
