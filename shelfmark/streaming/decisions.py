"""The endless cycle as one streaming job: state rows arrive, decisions and history are appended."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from shelfmark.operators import history as h
from shelfmark.sources.keyed import BUCKET, BUCKETS, exists, read_keyed_buckets, recover, upsert

SEEN = "seen_at"
STATE = f"{h.KEY} string, {h.AT} long, {h.COMMIT} string, {h.BRANCH} string, {SEEN} timestamp, {BUCKET} int"


def newest_state(batch: DataFrame) -> DataFrame:
    """One row a repository of a micro-batch: the newest; of equal times, the greater commit."""
    others = [c for c in batch.columns if c != "repo_name"]
    return batch.groupBy("repo_name").agg(F.max_by(F.struct(*others), F.struct("event_time", "commit_sha")).alias("n")).select("repo_name", "n.*")


def latest_states(history: DataFrame) -> DataFrame:
    """A row a repository: its last investigation, and when its state was last seen."""
    return h.latest_investigation(history.select(h.KEY, h.AT, h.COMMIT, h.BRANCH)).withColumn(SEEN, F.lit(None).cast("timestamp"))


def _written(spark: SparkSession, path: str) -> bool:
    """Whether a batch's folder is complete."""
    place = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def stream_decisions(arriving: DataFrame, history_path: str, latest_path: str, decisions_path: str, checkpoint: str, force_first: bool = False, buckets: int = BUCKETS, **trigger) -> StreamingQuery:
    """Starts the query over ``arriving`` (repo_name, commit_sha, branch_name, event_time).

    Latest states are a keyed table, one row a repository in ``buckets`` hash buckets. Each micro-batch keeps the newest state of a
    repository, reads the buckets of its repositories and compares with them, so no batch reads the history or rewrites the
    portfolio, and a return to an earlier commit is a change like any other. States that are not newer than the last one seen of
    their repository (repeats, late rows) are ignored. What is redone is stamped with its event time.

    Decisions and history go to folders named by the batch, then states are merged by key. A batch that runs again after it wrote its
    decisions takes those, whatever of the rest it had done; before that it has changed nothing. ``force_first`` holds for the first batch only.
    """
    spark: SparkSession = arriving.sparkSession
    recover(spark, latest_path)
    if not exists(spark, latest_path):  # the very first start, or one that did not get so far
        upsert(latest_states(spark.read.parquet(history_path)), latest_path, [h.KEY], [h.AT], buckets)

    def decide(batch: DataFrame, number: int) -> None:
        recover(spark, latest_path)
        decided_path = f"{decisions_path}/batch={number}"
        if not _written(spark, decided_path):
            if batch.isEmpty():
                return
            newest = newest_state(batch)
            key = F.col("repo_name")
            touched = [r[0] for r in newest.select(F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")).distinct().collect()]
            latest = read_keyed_buckets(spark, latest_path, spark.createDataFrame([], STATE), touched).drop(BUCKET)
            seen = latest.select(F.col(h.KEY).alias("repo_name"), SEEN)
            fresh = newest.join(seen, "repo_name", "left").filter(F.col(SEEN).isNull() | (F.col("event_time") > F.col(SEEN))).drop(SEEN)
            h.investigation_decision(fresh, latest, force=force_first and number == 0).write.mode("overwrite").parquet(decided_path)
        decided = spark.read.parquet(decided_path)
        row = decided.select(
            F.col("repo_name").alias(h.KEY), F.unix_timestamp("event_time").alias(h.AT), F.col("commit_sha").alias(h.COMMIT), F.col("branch_name").alias(h.BRANCH), F.col("event_time").alias(SEEN), "needs_investigation", "last_timestamp"
        )
        done = row.filter("needs_investigation")
        done.select(h.KEY, h.AT, F.lit("investigation").alias(h.KIND), h.COMMIT, h.BRANCH).write.mode("overwrite").parquet(f"{history_path}/batch={number}")
        # What was not redone has the commit and branch of its last investigation, and keeps that one's time.
        at = F.when(F.col("needs_investigation"), F.col(h.AT)).otherwise(F.col("last_timestamp"))
        upsert(row.select(h.KEY, at.alias(h.AT), h.COMMIT, h.BRANCH, SEEN), latest_path, [h.KEY], [SEEN], buckets)

    return arriving.writeStream.foreachBatch(decide).option("checkpointLocation", checkpoint).outputMode("append").trigger(**(trigger or {"availableNow": True})).start()
