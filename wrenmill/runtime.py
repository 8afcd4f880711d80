"""Session, table access, lineage cuts and skew-aware lookups shared by all operators."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def session(cpus: int | str = 8, shuffle_partitions: int = 8, memory: str = "12g") -> SparkSession:
    """A local session for tests and benchmarks; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("wrenmill")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", memory)
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One driver table; columns and filters are pruned by Catalyst at the parquet scan."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder for lineage cuts: spark.checkpoint.dir; only a local session may go without one, in tests."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        master = spark.sparkContext.master
        if not re.fullmatch(r"local(\[[^\]]*\])?", master):
            raise RuntimeError(f"spark.checkpoint.dir must name a folder that all of {master} shares")
        where = f"file://{os.path.join(tempfile.gettempdir(), 'wrenmill-checkpoints')}"
    return where.rstrip("/")


def materialize(df: DataFrame, name: str = "cut", partitions: int | None = None, by: str | None = None) -> DataFrame:
    """Write df to a table in the shared folder, one folder per value of `by` if given, and read it back.

    Cuts lineage without keeping blocks on executors, so a lost executor costs nothing, and gives
    the planner true sizes. Empty frames keep their schema.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/wrenmill/{name}-{uuid.uuid4().hex}"
    writer = (df.coalesce(partitions) if partitions else df).write
    (writer.partitionBy(by) if by else writer).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """df over all cores, for steps whose work per row outweighs the move of a small table; adaptive planning sizes partitions by bytes alone."""
    spark = df.sparkSession
    return df.repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))))


def release(*frames: DataFrame | None) -> None:
    """Delete the tables that materialize() wrote for frames no longer needed by any plan."""
    for df in frames:
        if df is None:
            continue
        jvm = df.sparkSession._jvm
        conf = df.sparkSession._jsc.hadoopConfiguration()
        tables = {m.group() for f in df.inputFiles() if (m := re.match(r".*/wrenmill/[^/]+-[0-9a-f]{32}(?=/)", f))}
        for name in tables:
            path = jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(conf).delete(path, True)


def hot_keys(big: DataFrame, key: str, least: int = 200_000, most: int = 1000) -> DataFrame:
    """The `most` largest keys of big with more than `least` rows; any other key holds at most max(least, rows / most) rows."""
    counts = big.groupBy(key).agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") > least)
    return counts.orderBy(F.desc("__n"), key).limit(most).select(key)


def skew_lookup(big: DataFrame, small: DataFrame, key: str, how: str = "left", least: int = 200_000, most: int = 1000) -> DataFrame:
    """big joined to small (unique on key) where single keys may hold a large share of big.

    Rows of hot keys take a broadcast join against at most `most` rows of small; the rest a shuffled
    join. The hot list is found by one map-side-combined count. No row is dropped or capped.
    """
    hot = [r[0] for r in hot_keys(big, key, least, most).collect() if r[0] is not None]
    if not hot:
        return big.join(small, key, how)
    spark = big.sparkSession
    names = spark.createDataFrame([(k,) for k in hot], big.select(key).schema)
    heavy = small.join(F.broadcast(names), key, "left_semi")
    a = big.join(F.broadcast(names), key, "left_semi").join(F.broadcast(heavy), key, how)
    b = big.join(F.broadcast(names), key, "left_anti").join(small, key, how)
    return a.unionByName(b)


def hash_sample(df: DataFrame, keys: list[str], most: int) -> DataFrame:
    """At most `most` rows in the order of a hash of the keys, the same in every run.

    Rows above a threshold of the hash are dropped in the scan, so all partitions together send about `most` rows, whatever their number.
    """
    n = df.count()
    place = F.pmod(F.xxhash64(*keys), F.lit(1 << 40))
    if n > most:
        # four standard deviations above the expected number, so that the threshold practically never leaves fewer than `most`
        df = df.filter(place < F.lit(int((1 << 40) * min(1.0, (most + 4 * most**0.5 + 16) / n))))
    return df.orderBy(place, *keys).limit(most)


def numbered(df: DataFrame, group: str | None, order: str, name: str) -> DataFrame:
    """df with `name`: 1, 2, 3 ... in the order of a unique column, within each group if one is named.

    Rows are range-partitioned, numbered inside their partition, and shifted by the counts of the partitions before, so no group and no
    table goes through one task; only one row per group and partition meets in the shift.
    """
    keys = [group, order] if group else [order]
    cut = materialize(df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("__part", F.spark_partition_id()), "numbered")
    by = ["__part", *([group] if group else [])]
    inside = cut.withColumn("__at", F.row_number().over(Window.partitionBy(*by).orderBy(order)))
    counts = cut.groupBy(*by).agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(*([group] if group else [F.lit(1)])).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    shift = counts.withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n")
    return inside.join(shift, by).withColumn(name, F.col("__at") + F.col("__before")).drop("__part", "__at", "__before")
