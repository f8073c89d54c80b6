"""What the corpus operators share: tables, materialisation, ranks and row keys."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Words are runs of anything but the ASCII white space characters.
WORD = r"[^\x20\x09-\x0D]+"

_fallback_dirs: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or what ``setCheckpointDir`` was given.

    Only a local session without either (a test) gets a temporary folder; a cluster without one is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _fallback_dirs:
        _fallback_dirs[app] = tempfile.mkdtemp(prefix="shelfmark-")
    return f"file://{_fallback_dirs[app]}"


def written(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """``df`` as a table in the shared folder, read back, and where it is.

    This cuts the lineage: later reads neither recompute the plan nor depend on
    the executors that ran it.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def materialise(df: DataFrame, name: str) -> DataFrame:
    return written(df, name)[0]


def discard(spark: SparkSession, *paths: str) -> None:
    """Deletes written tables that nothing reads any more."""
    for path in paths:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def row_hash(column: str = "text") -> Column:
    """A 64-bit hash of a text; null and empty differ."""
    return F.xxhash64(F.coalesce(F.col(column), F.lit("")), F.col(column).isNull())


def fresh_names(df: DataFrame, *wanted: str) -> list[str]:
    """Names for working columns that clash with none of ``df``'s, in any case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once per row, however often it is used."""
    return F.element_at(F.transform(F.array(value), body), 1)


def sorted_slices(df: DataFrame, order: list[Column], name: str, per_partition: int = 1) -> DataFrame:
    """``df`` range-partitioned and written, with ``slice``: the number of its range.

    Ranges come from a sample, so they differ between runs; written once, they no
    longer change. Results must not depend on where the cuts fall.
    """
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions")) * per_partition
    cut = df.repartitionByRange(n, *order).withColumn("slice", F.spark_partition_id())
    return materialise(cut, name)


def with_rank(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Adds ``rank``, 0-based over the whole table in ``order``, without one task for all rows."""
    cut = sorted_slices(df, order, name)
    counts = cut.groupBy("slice").agg(F.count(F.lit(1)).alias("n"))
    # One row per slice: as many as there are shuffle partitions.
    before = counts.select(
        "slice",
        F.coalesce(F.sum("n").over(Window.orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"),
    )
    within = Window.partitionBy("slice").orderBy(*order)
    return (
        cut.withColumn("nth", F.row_number().over(within))
        .join(before, "slice")
        .withColumn("rank", F.col("before") + F.col("nth") - 1)
        .drop("slice", "nth", "before")
    )
