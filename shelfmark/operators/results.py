"""Step results: cache look-ups, contexts, and the merge of new and cached results."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfmark.functions.text import ttl_at
from shelfmark.functions.text import not_expired as _not_expired
from shelfmark.sources.keyed import upsert

KEYS = ["repo_name", "step_name", "commit_sha", "prompt_version"]
UNORDERED = 999


def union_steps(base: DataFrame, more: DataFrame) -> DataFrame:
    """Base steps, then those of a type, order and repeats kept: (ordinal, step_name, ...). Catalogues are configuration; one number comes to the driver."""
    shift = base.agg(F.coalesce(F.max("ordinal") + 1, F.lit(0))).first()[0]
    return base.unionByName(more.withColumn("ordinal", F.col("ordinal") + F.lit(shift)), allowMissingColumns=True)


def order_steps(steps: DataFrame, by: list[str]) -> DataFrame:
    """Adds ``position`` from 0: by ``order``, missing as 999, then by place in the configuration."""
    order = Window.partitionBy(*by).orderBy(F.coalesce("order", F.lit(UNORDERED)), "ordinal")
    return steps.withColumn("position", F.row_number().over(order) - 1)


def plan_tasks(repos: DataFrame, steps: DataFrame) -> DataFrame:
    """A task for each repository and step of its type. The step table is configuration; Spark broadcasts it if it is small."""
    return repos.join(steps, "repo_type").drop("repo_type")


def latest_result(results: DataFrame, keys: list[str] = KEYS, wanted: DataFrame | None = None) -> DataFrame:
    """The newest row of each key, expired or not; of those of ``wanted``'s keys only, if given. Of equal times the greatest content.

    Keys and times come first: they are all that the aggregate reads and deals out. The rows that they name are joined then, so stored
    texts move once at most, and not at all where the named keys are few enough to be broadcast.
    """
    stamp = F.coalesce("created_at", F.lit(-(1 << 63)))
    stamps = results.select(*keys, stamp.alias("_stamp"))
    if wanted is not None:
        stamps = stamps.join(wanted.select(*keys), keys, "left_semi")
    newest = stamps.groupBy(*keys).agg(F.max("_stamp").alias("_newest")).withColumnsRenamed({k: f"_of_{k}" for k in keys})
    same = stamp == F.col("_newest")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_of_{k}"))
    ties = Window.partitionBy(*keys, "_newest").orderBy(F.desc("content"))
    rows = results.join(newest, same).withColumn("_place", F.row_number().over(ties)).filter("_place = 1")
    return rows.select(*keys, *(c for c in results.columns if c not in keys))


def not_expired(rows: DataFrame, now: int, ttl: str = "ttl_at") -> DataFrame:
    return rows.filter(_not_expired(F.col(ttl), F.lit(now)))


def cache_lookup(tasks: DataFrame, results: DataFrame, now: int, forced: str | None = None) -> DataFrame:
    """tasks + (cached, content, reason). The newest result is tested for expiry, so an expired one hides an older live one.

    ``forced``: the step that is never taken from the cache.
    """
    live = not_expired(latest_result(results, wanted=tasks), now).select(*KEYS, "content")
    found = tasks.join(live, KEYS, "left")
    hit = F.coalesce(F.col("content") != "", F.lit(False))
    if forced is not None:
        hit = hit & (F.col("step_name") != forced)
    at = F.concat(F.lit("commit "), F.substring("commit_sha", 1, 8), F.lit(" v"), "prompt_version")
    reason = F.when(hit, F.concat(F.lit("Using cached result from "), at)).otherwise(F.concat(F.lit("No cached result for this prompt at "), at))
    return found.select(*tasks.columns, hit.alias("cached"), F.when(hit, F.col("content")).alias("content"), reason.alias("reason"))


def result_rows(outcomes: DataFrame, now: int, ttl_days: int = 90) -> DataFrame:
    """Rows to append for finished tasks."""
    return outcomes.select(*KEYS, "content", F.lit(now).cast("long").alias("created_at"), ttl_at(F.lit(now).cast("long"), days=F.lit(ttl_days)).alias("ttl_at"))


def append_results(outcomes: DataFrame, path: str, now: int, ttl_days: int = 90) -> None:
    """Saves finished tasks in the table of results, which has one row for each repository, step, commit and prompt version: a later result replaces an earlier one."""
    upsert(result_rows(outcomes, now, ttl_days), path, KEYS, [F.col("created_at"), F.col("content")])


def step_context(edges: DataFrame, results: DataFrame) -> DataFrame:
    """repo_name, step_name, context: results of the steps a step builds on, in configured order, under their names.

    A step builds on a handful of others, so the lists are short.
    """
    known = results.filter(F.col("content").isNotNull()).select("repo_name", F.col("step_name").alias("ctx_step"), "content")
    parts = edges.join(known, ["repo_name", "ctx_step"]).select("repo_name", "step_name", F.struct("ctx_ordinal", F.concat(F.lit("## "), "ctx_step", F.lit("\n\n"), "content").alias("part")).alias("p"))
    return parts.groupBy("repo_name", "step_name").agg(F.array_join(F.transform(F.array_sort(F.collect_list("p")), lambda p: p["part"]), "\n\n").alias("context"))


def combine_results(steps: DataFrame, new: DataFrame, cached: DataFrame) -> DataFrame:
    """repo_name, ordinal, step_name, description, content, version, cached.

    A new result counts even if it is empty; else a cached one that is not, of whatever
    version; the version shown is the present one. Rows without content are left out.
    """
    n = new.select("repo_name", "step_name", F.col("content").alias("new_content"), F.lit(True).alias("is_new"))
    c = cached.select("repo_name", "step_name", F.col("content").alias("old_content"))
    both = steps.join(n, ["repo_name", "step_name"], "left").join(c, ["repo_name", "step_name"], "left")
    taken = both.withColumn("cached", F.col("is_new").isNull()).withColumn("content", F.when(F.col("cached"), F.col("old_content")).otherwise(F.col("new_content")))
    return taken.filter(F.coalesce("content", F.lit("")) != "").select("repo_name", "ordinal", "step_name", "description", "content", "version", "cached")


def combine_stats(combined: DataFrame) -> DataFrame:
    return combined.groupBy("repo_name").agg(F.count_if("cached").alias("cached_steps"), F.count_if(~F.col("cached")).alias("new_steps"))


def missing_results(steps: DataFrame, results: DataFrame) -> DataFrame:
    """Tracked steps without a result."""
    return steps.join(results.select("repo_name", "step_name"), ["repo_name", "step_name"], "left_anti")


def completeness(steps: DataFrame, results: DataFrame) -> DataFrame:
    """repo_name, tracked, missing (required steps by ordinal, comma-joined), has_monitoring, error.

    With steps that name ``monitoring``, its absence is an error.
    """
    have = results.filter(F.coalesce("content", F.lit("")) != "").select("repo_name", "step_name", F.lit(True).alias("have")).distinct()
    rows = steps.join(have, ["repo_name", "step_name"], "left")
    absent = F.col("have").isNull() & F.coalesce("required", F.lit(True))
    is_monitoring = F.col("step_name") == "monitoring"
    out = rows.groupBy("repo_name").agg(
        F.count(F.lit(1)).alias("tracked"), F.array_join(F.transform(F.array_sort(F.collect_list(F.when(absent, F.struct("ordinal", "step_name")))), lambda s: s["step_name"]), ",").alias("missing"),
        F.coalesce(F.bool_or(is_monitoring & F.col("have")), F.lit(False)).alias("has_monitoring"), F.bool_or(is_monitoring).alias("wants"),
    )
    return out.select("repo_name", "tracked", "missing", "has_monitoring", F.when(F.col("wants") & ~F.col("has_monitoring"), "monitoring is missing").alias("error"))
