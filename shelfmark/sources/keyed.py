"""Tables with one row a key: a staged write, a merge inside hash buckets, and an overwrite of the buckets touched.

A table is a folder of Parquet files by ``bucket``, a hash of the key. A batch is staged first; its rows meet those of the
buckets that it touches and no others, the batch's row of a key replaces the table's, and the merged buckets are written apart. Only when they are complete
do they replace the buckets of the table. A job that dies before leaves the old table; one that dies while buckets are replaced is
finished by the next ``upsert`` or ``recover``, from the merged buckets, which are deleted last. A table has one writer at a time.
"""

from __future__ import annotations

import uuid

from py4j.java_gateway import JavaObject
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

BUCKET = "bucket"
BUCKETS = 64
#: Folders that readers of the table do not see.
STAGED, MERGED = "_staged", "_merged"


def _files(spark: SparkSession, path: str) -> tuple[JavaObject, type]:
    to_path = spark._jvm.org.apache.hadoop.fs.Path
    return to_path(path).getFileSystem(spark._jsc.hadoopConfiguration()), to_path


def _delete(spark: SparkSession, path: str) -> None:
    files, to_path = _files(spark, path)
    files.delete(to_path(path), True)


def _children(spark: SparkSession, path: str) -> list[str]:
    files, to_path = _files(spark, path)
    return sorted(s.getPath().getName() for s in files.listStatus(to_path(path))) if files.exists(to_path(path)) else []


def bucket_of(keys: list[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def exists(spark: SparkSession, path: str) -> bool:
    """Whether the table has rows, or had."""
    return any(c.startswith(f"{BUCKET}=") for c in _children(spark, path))


def read_keyed(spark: SparkSession, path: str, schema=None) -> DataFrame:
    """The table's rows; an empty frame of ``schema`` if it does not exist and a schema is given."""
    try:
        return (spark.read.schema(schema) if schema is not None else spark.read).parquet(path).drop(BUCKET)
    except AnalysisException as missing:
        if schema is None or missing.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return spark.createDataFrame([], schema).drop(BUCKET)


def newest_by_key(rows: DataFrame, keys: list[str], order: list[str | Column]) -> DataFrame:
    """One row a key, the last in ``order``. A window with a limit of one: rows that lose within a task are not shuffled."""
    last = Window.partitionBy(*keys).orderBy(*(F.desc(c) if isinstance(c, str) else c.desc() for c in order))
    return rows.withColumn("_place", F.row_number().over(last)).filter("_place = 1").drop("_place")


def _replace(spark: SparkSession, path: str, name: str) -> None:
    """Moves complete merged buckets into the table. Doing it again gives the same table."""
    merged = f"{path}/{MERGED}/{name}"
    spark.read.parquet(merged).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(BUCKET).parquet(path)
    _delete(spark, merged)


def recover(spark: SparkSession, path: str) -> list[str]:
    """Finishes what a job left complete, drops what it left unfinished; returns the names of finished merges."""
    done = []
    for name in _children(spark, f"{path}/{MERGED}"):
        if "_SUCCESS" in _children(spark, f"{path}/{MERGED}/{name}"):
            _replace(spark, path, name)
            done.append(name)
    _delete(spark, f"{path}/{MERGED}")
    _delete(spark, f"{path}/{STAGED}")
    return done


def stage(rows: DataFrame, path: str, keys: list[str], order: list[str | Column], buckets: int = BUCKETS, bucket_keys: list[str] | None = None, numbered: bool = False) -> str:
    """Writes a batch, one row a key, beside the table and returns its name; ``numbered`` rows get it as ``edition``, and an ``id``, close to those of others in the bucket."""
    name = uuid.uuid4().hex
    batch = newest_by_key(rows, keys, order).withColumn(BUCKET, bucket_of(bucket_keys or keys, buckets)).repartition(BUCKET)
    if numbered:
        batch = batch.sortWithinPartitions(BUCKET).withColumn("edition", F.lit(name)).withColumn("id", F.monotonically_increasing_id())
    batch.write.partitionBy(BUCKET).parquet(f"{path}/{STAGED}/{name}")
    return name


def merge(spark: SparkSession, path: str, name: str, keys: list[str], order: list[str | Column]) -> None:
    """Merges a staged batch with the buckets that it touches, and replaces those."""
    staged_path = f"{path}/{STAGED}/{name}"
    touched = [int(c.split("=")[1]) for c in _children(spark, staged_path) if c.startswith(f"{BUCKET}=")]
    if touched:
        staged = spark.read.parquet(staged_path)
        old = read_keyed_buckets(spark, path, staged, touched)
        both = old.withColumn("_new", F.lit(0)).unionByName(staged.withColumn("_new", F.lit(1)), allowMissingColumns=True)
        merged = newest_by_key(both, keys, [F.col("_new"), *order]).drop("_new")
        # Rows of a bucket stay together: a file or a few for each.
        merged.repartition(BUCKET).write.partitionBy(BUCKET).parquet(f"{path}/{MERGED}/{name}")
        _replace(spark, path, name)
    _delete(spark, staged_path)


def rewrite(spark: SparkSession, path: str, rows: DataFrame) -> None:
    """Puts ``rows``, which have a bucket, in place of all that the table holds in their buckets."""
    name = uuid.uuid4().hex
    rows.write.partitionBy(BUCKET).parquet(f"{path}/{MERGED}/{name}")
    if any(c.startswith(f"{BUCKET}=") for c in _children(spark, f"{path}/{MERGED}/{name}")):
        _replace(spark, path, name)
    else:
        _delete(spark, f"{path}/{MERGED}/{name}")


def read_keyed_buckets(spark: SparkSession, path: str, like: DataFrame, touched: list[int]) -> DataFrame:
    """Rows of some buckets, with ``bucket``; the filter prunes folders. ``like`` has the columns of a table that does not exist yet."""
    try:
        table = spark.read.parquet(path)
    except AnalysisException as missing:
        if missing.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return like.limit(0)
    return table.filter(F.col(BUCKET).isin(touched))


def upsert(rows: DataFrame, path: str, keys: list[str], order: list[str | Column], buckets: int = BUCKETS, bucket_keys: list[str] | None = None) -> None:
    """Saves ``rows``: each replaces the table's row of its key; of several in ``rows`` the last in ``order`` counts. The same rows again change nothing.

    ``buckets`` and ``bucket_keys`` (a part of the key; all of it, if not given) belong to the table: use the same every time.
    ``buckets`` should grow with the table, so that a bucket fits a task.
    """
    spark = rows.sparkSession
    recover(spark, path)
    merge(spark, path, stage(rows, path, keys, order, buckets, bucket_keys), keys, order)
