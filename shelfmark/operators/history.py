"""Investigation history: the latest runs, and what must be run again.

Saves of one repository and time replace each other; history has no expiry. Times are seconds since 1970; ``now`` is always
an argument. ``state`` holds the present commit and branch of each repository.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfmark.functions.text import DAY_SECONDS
from shelfmark.sources.keyed import upsert

KEY, AT, COMMIT, BRANCH, KIND = "repository_name", "analysis_timestamp", "latest_commit", "branch_name", "analysis_type"


def latest_investigation(history: DataFrame, kind: str | None = None) -> DataFrame:
    """The newest row per repository (of one type, if given); equal times: the greater commit.

    ``max_by`` sums up map-side, so a repository with very many rows is one row a task in the shuffle.
    """
    rows = history if kind is None else history.filter(F.col(KIND) == kind)
    others = [c for c in history.columns if c != KEY]
    newest = rows.groupBy(KEY).agg(F.max_by(F.struct(*others), F.struct(AT, COMMIT)).alias("newest"))
    return newest.select(KEY, *(F.col(f"newest.{c}").alias(c) for c in others))


def recent(history: DataFrame, by: str = KEY, limit: int = 10) -> DataFrame:
    """The newest ``limit`` rows per repository or per type, with their ``rank`` from 1. Each task keeps its first few only."""
    order = Window.partitionBy(by).orderBy(F.col(AT).desc(), F.col(COMMIT).desc())
    return history.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limit)


def prompt_diff(current: Column, previous: Column) -> Column:
    """Why a repository's prompts ask for a new run; null if they do not.

    ``current`` is an array of (prompt, version) in step order, ``previous`` a map; version
    1 is assumed where none was kept. All per row: no prompt is exploded.
    """
    tracked = F.coalesce(F.size(F.map_keys(previous)), F.lit(0))
    tracked = F.greatest(tracked, F.lit(0))
    updated = F.get(F.filter(current, lambda p: p["version"] != "1"), F.lit(0))
    changed = F.get(F.filter(current, lambda p: p["version"] != F.coalesce(F.try_element_at(previous, p["prompt"]), F.lit("1"))), F.lit(0))
    removed = F.get(F.array_sort(F.array_except(F.map_keys(previous), F.transform(current, lambda p: p["prompt"]))), F.lit(0))
    untracked = F.when(updated.isNotNull(), F.format_string("Prompt '%s' updated to v%s (no previous version tracking)", updated["prompt"], updated["version"]))
    against = (
        F.when(F.size(current) != tracked, F.format_string("Prompt count changed (%d → %d)", tracked, F.size(current)))
        .when(changed.isNotNull(), F.format_string("Prompt '%s' version changed (v%s → v%s)", changed["prompt"], F.coalesce(F.try_element_at(previous, changed["prompt"]), F.lit("1")), changed["version"]))
        .when(removed.isNotNull(), F.format_string("Prompt '%s' was removed", removed))
    )
    return F.when(current.isNull() | (F.size(current) <= 0), None).when(tracked == 0, untracked).otherwise(against)


def first_change(current: Column, previous: Column) -> Column:
    """The first prompt in step order whose version differs from the one kept."""
    return F.get(F.filter(current, lambda p: p["version"] != F.coalesce(F.try_element_at(previous, p["prompt"]), F.lit("1"))), F.lit(0))["prompt"]


def removed_prompts(current: Column, previous: Column) -> Column:
    return F.array_sort(F.array_except(F.map_keys(previous), F.transform(current, lambda p: p["prompt"])))


def investigation_decision(state: DataFrame, history: DataFrame, force: bool | str = False) -> DataFrame:
    """state + (needs_investigation, reason, last_timestamp). The first reason that fits counts; uncommitted changes do not.

    ``state`` may carry ``prompt_versions`` (array of prompt, version), ``history`` the same name as a map.
    ``force`` is a constant or the name of a boolean column of ``state``.
    """
    last = latest_investigation(history)
    prompts = "prompt_versions" in state.columns and "prompt_versions" in history.columns
    last = last.select(KEY, F.col(AT).alias("last_timestamp"), F.col(COMMIT).alias("last_commit"), F.col(BRANCH).alias("last_branch"), *([F.col("prompt_versions").alias("last_versions")] if prompts else []))
    both = state.join(last, state["repo_name"] == last[KEY], "left").drop(KEY)
    short = lambda c: F.substring(c, 1, 8)
    seen = F.when(F.coalesce("last_commit", F.lit("")) == "", "unknown").otherwise(short(F.col("last_commit")))
    at = F.date_format(F.timestamp_seconds("last_timestamp"), "yyyy-MM-dd'T'HH:mm:ss")
    by_prompt = prompt_diff(F.col("prompt_versions"), F.col("last_versions")) if prompts else F.lit(None).cast("string")
    forced = F.col(force) if isinstance(force, str) else F.lit(force)
    why = (
        F.when(forced, "Force flag enabled")
        .when(F.col("last_timestamp").isNull(), "No previous investigation found")
        .when(~F.col("commit_sha").eqNullSafe(F.col("last_commit")), F.concat(F.lit("New commits detected (current: "), short(F.col("commit_sha")), F.lit(", last: "), seen, F.lit(")")))
        .when(~F.col("branch_name").eqNullSafe(F.col("last_branch")), F.concat(F.lit("Branch changed (current: "), F.col("branch_name"), F.lit(", last: "), F.coalesce("last_branch", F.lit("None")), F.lit(")")))
        .otherwise(by_prompt)
    )
    decided = both.withColumn("why", why)
    return decided.select(
        *state.columns, F.col("why").isNotNull().alias("needs_investigation"),
        F.coalesce("why", F.concat(F.lit("No changes since last investigation on "), at, F.lit("+00:00"))).alias("reason"), "last_timestamp",
    )


def prompt_metadata(steps: DataFrame, by: str) -> DataFrame:
    """count and versions (a map) per ``by``; steps are few per key."""
    entries = F.array_sort(F.collect_set(F.struct("prompt", "version")))
    return steps.groupBy(by).agg(entries.alias("entries")).select(by, F.size("entries").alias("count"), F.map_from_entries("entries").alias("versions"))


def cycle_summary(outcomes: DataFrame) -> DataFrame:
    """One row: total, successful, skipped, failed (any other status)."""
    status = F.col("status")
    return outcomes.agg(
        F.count(F.lit(1)).alias("total"), F.count_if(status == "success").alias("successful"), F.count_if(status == "skipped").alias("skipped"),
        F.count_if(status.isNull() | ~status.isin("success", "skipped")).alias("failed"),
    )


def history_rows(runs: DataFrame, now: int, ttl_days: int = 90) -> DataFrame:
    """Rows to append for finished runs: stamped, with prompt metadata and time to live."""
    versions = F.map_from_entries(F.transform("prompt_versions", lambda p: F.struct(p["prompt"], p["version"])))
    return runs.select(
        F.col("repo_name").alias(KEY), F.col("repo_url").alias("repository_url"), F.lit(now).cast("long").alias(AT), F.lit("investigation").alias(KIND),
        F.col("commit_sha").alias(COMMIT), F.col("branch_name").alias(BRANCH), versions.alias("prompt_versions"), F.size("prompt_versions").alias("prompt_count"),
        F.col("analysis_summary").alias("analysis_data"), F.timestamp_seconds(F.lit(now)).alias("created_at"), F.timestamp_seconds(F.lit(now)).alias("updated_at"),
        F.lit(now + ttl_days * DAY_SECONDS).cast("long").alias("ttl_at"),
    )


#: What makes two saves of history the same.
HISTORY_KEYS = [KEY, AT]


def append_history(runs: DataFrame, path: str, now: int, ttl_days: int = 90) -> None:
    """Saves finished runs in the history table, which has one row for each repository and time: the same run again replaces its row."""
    upsert(history_rows(runs, now, ttl_days), path, HISTORY_KEYS, [F.col("updated_at"), F.col(COMMIT)])


#: Rules a row must meet: table of (column, rule name, condition that breaks it, other columns that it reads).
def rules() -> list[tuple]:
    c = F.col
    blank = lambda name: c(name).isNull() | (F.trim(c(name)) == "")
    return [
        ("repo_name", "blank", blank("repo_name")), ("branch_name", "blank", blank("branch_name")), ("reason", "blank", blank("reason")),
        ("commit_sha", "shorter than 7", c("commit_sha").isNull() | (F.length(F.trim(c("commit_sha"))) < 7)), ("repo_url", "not http", ~F.coalesce(c("repo_url").rlike("^https?://"), F.lit(False))),
        ("analysis_timestamp", "negative", F.coalesce(c("analysis_timestamp") < 0, F.lit(True))), ("status", "unknown", ~F.coalesce(c("status").isin("success", "failed", "skipped"), F.lit(False))),
        ("ttl_days", "outside 1 to 365", ~F.coalesce(c("ttl_days").between(1, 365), F.lit(False))),
        ("prompt_version", "blank", blank("prompt_version")), ("temperature", "outside 0 to 1", ~F.coalesce(c("temperature").between(0, 1), F.lit(True))),
        ("cached", "without a reason", F.coalesce(c("cached"), F.lit(False)) & blank("cache_reason"), "cache_reason"),
        *((n, "above total", F.coalesce(c(n) > c("total"), F.lit(False)), "total") for n in ("successful", "failed", "skipped")),
        ("total", "less than its parts", F.coalesce(c("successful") + c("failed") + c("skipped") > c("total"), F.lit(False)), "successful", "failed", "skipped"),
        ("prompt_versions", "blank version", F.coalesce(F.exists(F.map_values("prompt_versions"), lambda v: v.isNull() | (F.trim(v) == "")), F.lit(False))),
    ]


def validate_rows(rows: DataFrame, key: str = "repo_name", checks: list[tuple] | None = None) -> DataFrame:
    """key, column, rule: a row for each rule that a row breaks. Rules on columns that are not there do not apply."""
    broken = [F.when(test, F.struct(F.lit(column).alias("column"), F.lit(rule).alias("rule"))) for column, rule, test, *others in (checks or rules()) if {column, *others} <= set(rows.columns)]
    return rows.select(key, F.explode(F.filter(F.array(*broken), lambda v: v.isNotNull())).alias("v")).select(key, "v.column", "v.rule")
