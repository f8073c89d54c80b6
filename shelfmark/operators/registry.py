"""Registry sync: which listed repositories come in, which are skipped, and why."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.functions.text import detect_repo_type

#: Repository types that have steps of their own.
TYPES = ("backend", "frontend", "mobile", "libraries", "infra-as-code", "generic")
ARCHIVED, INACTIVE = "archived", "no commits in past 1 year"
YEAR_SECONDS = 365 * 86_400
NO_DESCRIPTION = "No description available"


def valid_repos(registry: DataFrame) -> DataFrame:
    return registry.filter(F.coalesce("url", F.lit("")) != "")


def with_repo_type(registry: DataFrame, types: tuple[str, ...] = TYPES) -> DataFrame:
    """Missing and unknown types become generic. The types are a handful of constants, so no join."""
    return registry.withColumn("type", F.when(F.col("type").isin(*types), F.col("type")).otherwise("generic"))


def resolve_repo(asked: DataFrame, registry: DataFrame) -> DataFrame:
    """identifier -> repo_name, repo_url, repo_type, error. URLs name themselves, all else is looked up."""
    r = registry.select(F.col("repo_name").alias("known"), "url", "type")
    is_url = F.col("identifier").startswith("http")
    joined = asked.join(r, (F.col("identifier") == F.col("known")) & ~is_url, "left")
    bare = F.element_at(F.split(F.regexp_replace("identifier", "/+$", ""), "/"), -1)
    named = F.when(is_url, F.regexp_replace(bare, r"\.git$", "")).otherwise(F.col("known"))
    return joined.select(
        "identifier", named.alias("repo_name"), F.when(is_url, F.col("identifier")).otherwise(F.col("url")).alias("repo_url"),
        F.when(is_url, "generic").when(F.col("known").isNotNull(), F.coalesce("type", F.lit("generic"))).alias("repo_type"),
        F.when(named.isNull(), F.concat(F.lit("Repository '"), "identifier", F.lit("' not found"))).alias("error"),
    )


def new_repos(listing: DataFrame, registry: DataFrame) -> DataFrame:
    return listing.join(registry.select("repo_name"), "repo_name", "left_anti")


def sync_candidates(listing: DataFrame, registry: DataFrame, skip: DataFrame, now: int) -> DataFrame:
    """Unknown and unskipped listed repositories with ``decision``: active, or the reason to skip them.

    ``last_commit_at`` null counts as active; ``empty`` repositories (if that column is there) do not.
    """
    fresh = new_repos(listing, registry).join(skip.select("repo_name"), "repo_name", "left_anti")
    stale = F.unix_timestamp("last_commit_at") < now - YEAR_SECONDS
    if "empty" in listing.columns:
        stale = stale | F.col("empty")
    reason = F.when(F.coalesce("archived", F.lit(False)), ARCHIVED).when(stale, INACTIVE).otherwise("active")
    return fresh.withColumn("decision", reason)


def merge_registry(registry: DataFrame, listing: DataFrame) -> DataFrame:
    """Existing rows stay as they are; new ones get a type from name, description and language."""
    language = F.col("language") if "language" in listing.columns else F.lit("")
    fresh = new_repos(listing, registry).select(
        "repo_name", "url", F.when(F.coalesce("description", F.lit("")) == "", NO_DESCRIPTION).otherwise(F.col("description")).alias("description"),
        detect_repo_type(F.col("repo_name"), F.col("description"), language).alias("type"),
    )
    return registry.select("repo_name", "url", "description", "type").unionByName(fresh)


def merge_skip_list(skip: DataFrame, found: DataFrame) -> DataFrame:
    """A newly found reason replaces an old one."""
    both = skip.select("repo_name", "reason", F.lit(0).alias("age")).unionByName(found.select("repo_name", "reason", F.lit(1).alias("age")))
    return both.groupBy("repo_name").agg(F.max_by("reason", F.struct("age", "reason")).alias("reason"))


def type_distribution(registry: DataFrame) -> DataFrame:
    return registry.groupBy(F.coalesce("type", F.lit("generic")).alias("type")).agg(F.count(F.lit(1)).alias("repos")).orderBy("type")


def sync_summary(registry: DataFrame, candidates: DataFrame) -> DataFrame:
    """One row: existing, skipped, new, total."""
    marks = registry.select(F.lit("existing").alias("mark")).unionByName(candidates.select(F.when(F.col("decision") == "active", "new").otherwise("skipped").alias("mark")))
    n = lambda mark: F.count_if(F.col("mark") == mark)
    return marks.agg(n("existing").alias("existing"), n("skipped").alias("skipped"), n("new").alias("new"), (n("existing") + n("new")).alias("total"))


