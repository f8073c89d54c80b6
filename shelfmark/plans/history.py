"""History queries: orders stand for investigations, customers for repositories, lineitem for prompt versions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.operators import history as h
from shelfmark.sources.keyed import read_keyed
from shelfmark.sources.shared import shared_path

PLANS: dict = {}
#: Fixed value: a date with about four fifths of the orders before it.
CUT = "1997-03-01"


def plan(sql: str | None = None):
    def keep(f):
        PLANS[f.__name__] = (f, sql)
        return f

    return keep


def _read(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def history_table(spark, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "orders").select(
        F.col("o_custkey").cast("string").alias(h.KEY), F.unix_timestamp("o_orderdate").alias(h.AT), F.col("o_orderstatus").alias(h.KIND),
        F.format_string("%012d", "o_orderkey").alias(h.COMMIT), F.col("o_orderpriority").alias(h.BRANCH),
    )


_H = "(SELECT CAST(o_custkey AS VARCHAR) AS repository_name, CAST(epoch(o_orderdate) AS BIGINT) AS analysis_timestamp, o_orderstatus AS analysis_type, printf('%012d', o_orderkey) AS latest_commit, o_orderpriority AS branch_name FROM orders)"


@plan(f"SELECT * EXCLUDE rn FROM (SELECT *, row_number() OVER (PARTITION BY repository_name ORDER BY analysis_timestamp DESC, latest_commit DESC) AS rn FROM {_H}) WHERE rn = 1")
def latest_investigation(spark, sf_dir):
    return h.latest_investigation(history_table(spark, sf_dir))


@plan(f"SELECT * EXCLUDE rn FROM (SELECT *, row_number() OVER (PARTITION BY repository_name ORDER BY analysis_timestamp DESC, latest_commit DESC) AS rn FROM {_H} WHERE analysis_type = 'F') WHERE rn = 1")
def latest_analysis(spark, sf_dir):
    return h.latest_investigation(history_table(spark, sf_dir), "F")


@plan(f"SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY repository_name ORDER BY analysis_timestamp DESC, latest_commit DESC) AS INT) AS rank FROM {_H}) WHERE rank <= 10")
def recent_analyses(spark, sf_dir):
    return h.recent(history_table(spark, sf_dir))


@plan(f"SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY analysis_type ORDER BY analysis_timestamp DESC, latest_commit DESC) AS INT) AS rank FROM {_H}) WHERE rank <= 10")
def recent_by_type(spark, sf_dir):
    return h.recent(history_table(spark, sf_dir), h.KIND)


def state_table(spark, sf_dir: str) -> DataFrame:
    """Each customer's newest order; every third repeats the last run before the cut, every seventh but for the branch."""
    newest = h.latest_investigation(history_table(spark, sf_dir))
    before = h.latest_investigation(past(spark, sf_dir)).select(F.col(h.KEY).alias("k"), F.col(h.COMMIT).alias("old_commit"), F.col(h.BRANCH).alias("old_branch"))
    number = F.col(h.KEY).cast("long")
    joined = newest.join(before, newest[h.KEY] == before["k"], "left")
    same = (number % 3 == 0) | (number % 7 == 0)
    return joined.select(
        F.col(h.KEY).alias("repo_name"), F.when(same, F.coalesce("old_commit", h.COMMIT)).otherwise(F.col(h.COMMIT)).alias("commit_sha"),
        F.when(number % 3 == 0, F.coalesce("old_branch", h.BRANCH)).otherwise(F.col(h.BRANCH)).alias("branch_name"),
    )


def past(spark, sf_dir: str) -> DataFrame:
    return history_table(spark, sf_dir).filter(F.col(h.AT) < F.unix_timestamp(F.lit(f"{CUT} 00:00:00")))


_PAST = f"(SELECT * FROM {_H} WHERE analysis_timestamp < CAST(epoch(TIMESTAMP '{CUT}') AS BIGINT))"
_LAST = f"(SELECT * EXCLUDE rn FROM (SELECT *, row_number() OVER (PARTITION BY repository_name ORDER BY analysis_timestamp DESC, latest_commit DESC) AS rn FROM {_PAST}) WHERE rn = 1)"
_NEW = f"(SELECT * EXCLUDE rn FROM (SELECT *, row_number() OVER (PARTITION BY repository_name ORDER BY analysis_timestamp DESC, latest_commit DESC) AS rn FROM {_H}) WHERE rn = 1)"
_DECISION = f"""WITH last AS {_LAST}, state AS (SELECT n.repository_name AS repo_name,
CASE WHEN CAST(n.repository_name AS BIGINT) % 3 = 0 OR CAST(n.repository_name AS BIGINT) % 7 = 0 THEN coalesce(l.latest_commit, n.latest_commit) ELSE n.latest_commit END AS commit_sha,
CASE WHEN CAST(n.repository_name AS BIGINT) % 3 = 0 THEN coalesce(l.branch_name, n.branch_name) ELSE n.branch_name END AS branch_name FROM {_NEW} n LEFT JOIN last l USING (repository_name)),
decided AS (SELECT s.*, l.analysis_timestamp AS last_timestamp, CASE WHEN FORCED THEN 'Force flag enabled' WHEN l.repository_name IS NULL THEN 'No previous investigation found'
WHEN s.commit_sha <> l.latest_commit THEN 'New commits detected (current: ' || substr(s.commit_sha, 1, 8) || ', last: ' || substr(l.latest_commit, 1, 8) || ')'
WHEN s.branch_name <> l.branch_name THEN 'Branch changed (current: ' || s.branch_name || ', last: ' || l.branch_name || ')' END AS why FROM state s LEFT JOIN last l ON l.repository_name = s.repo_name)
"""
_SHOWN = "SELECT repo_name, commit_sha, branch_name, why IS NOT NULL AS needs_investigation, coalesce(why, 'No changes since last investigation on ' || strftime(make_timestamp(last_timestamp * 1000000), '%Y-%m-%dT%H:%M:%S') || '+00:00') AS reason, last_timestamp FROM decided"


@plan(_DECISION.replace("FORCED", "false") + _SHOWN)
def investigation_decision(spark, sf_dir):
    return h.investigation_decision(state_table(spark, sf_dir), past(spark, sf_dir))


@plan(_DECISION.replace("FORCED", "CAST(s.repo_name AS BIGINT) % 5 = 0") + _SHOWN.replace("branch_name,", "branch_name, CAST(repo_name AS BIGINT) % 5 = 0 AS force,", 1))
def force_override(spark, sf_dir):
    state = state_table(spark, sf_dir).withColumn("force", F.col("repo_name").cast("long") % 5 == 0)
    return h.investigation_decision(state, past(spark, sf_dir), force="force")


@plan(_DECISION.replace("FORCED", "false") + """, outcomes AS (SELECT CASE WHEN why IS NULL THEN 'skipped' WHEN CAST(repo_name AS BIGINT) % 11 = 0 THEN 'failed' ELSE 'success' END AS status FROM decided)
SELECT count(*) AS total, count(*) FILTER (status = 'success') AS successful, count(*) FILTER (status = 'skipped') AS skipped, count(*) FILTER (status NOT IN ('success', 'skipped')) AS failed FROM outcomes""")
def cycle_summary(spark, sf_dir):
    decided = h.investigation_decision(state_table(spark, sf_dir), past(spark, sf_dir))
    status = F.when(~F.col("needs_investigation"), "skipped").when(F.col("repo_name").cast("long") % 11 == 0, "failed").otherwise("success")
    return h.cycle_summary(decided.select(status.alias("status")))


def versions(spark, sf_dir: str) -> DataFrame:
    """repo_name, current (array of prompt, version in order), previous (map): line numbers before and after a date."""
    li = _read(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("repo_name"), F.concat("l_returnflag", "l_linestatus", (F.col("l_partkey") % 2).cast("string")).alias("prompt"), "l_linenumber", (F.col("l_shipdate") < F.lit(f"{CUT} 00:00:00").cast("timestamp")).alias("old"))
    per = li.groupBy("repo_name", "prompt").agg(F.max(F.when(F.col("old"), F.col("l_linenumber"))).alias("was"), F.max(F.when(~F.col("old"), F.col("l_linenumber"))).alias("is"))
    kept = per.filter(~((F.col("repo_name") % 4 == 0) & F.col("prompt").startswith("R")) | F.col("is").isNull())
    row = lambda c: F.when(F.col(c).isNotNull(), F.struct("prompt", F.least(F.col(c), F.lit(7)).cast("string").alias("version")))
    return kept.groupBy("repo_name").agg(
        F.array_sort(F.collect_list(row("is"))).alias("current"),
        F.map_from_entries(F.when(F.col("repo_name") % 5 == 0, F.array().cast("array<struct<prompt:string,version:string>>")).otherwise(F.array_sort(F.collect_list(row("was"))))).alias("previous"),
    )


_V = f"""WITH li AS (SELECT l_suppkey AS repo_name, l_returnflag || l_linestatus || (l_partkey % 2) AS prompt, l_linenumber, l_shipdate < TIMESTAMP '{CUT}' AS old FROM lineitem),
per AS (SELECT repo_name, prompt, max(l_linenumber) FILTER (old) AS was, max(l_linenumber) FILTER (NOT old) AS "is" FROM li GROUP BY ALL),
kept AS (SELECT * FROM per WHERE NOT (repo_name % 4 = 0 AND starts_with(prompt, 'R')) OR "is" IS NULL),
repos AS (SELECT DISTINCT repo_name FROM kept),
cur AS (SELECT repo_name, prompt, CAST(least("is", 7) AS VARCHAR) AS version FROM kept WHERE "is" IS NOT NULL), prev AS (SELECT repo_name, prompt, CAST(least(was, 7) AS VARCHAR) AS version FROM kept WHERE was IS NOT NULL AND repo_name % 5 <> 0),
n AS (SELECT repo_name, (SELECT count(*) FROM cur c WHERE c.repo_name = r.repo_name) AS nc, (SELECT count(*) FROM prev p WHERE p.repo_name = r.repo_name) AS np FROM repos r),
chg AS (SELECT c.repo_name, min(c.prompt) AS prompt FROM cur c LEFT JOIN prev p USING (repo_name, prompt) WHERE c.version <> coalesce(p.version, '1') GROUP BY 1),
upd AS (SELECT repo_name, min(prompt) AS prompt FROM cur WHERE version <> '1' GROUP BY 1),
gone AS (SELECT p.repo_name, list(p.prompt ORDER BY p.prompt) AS prompts FROM prev p ANTI JOIN cur c USING (repo_name, prompt) GROUP BY 1)
"""


_PROMPT_REASON = """SELECT n.repo_name, CASE WHEN nc = 0 THEN NULL WHEN np = 0 THEN CASE WHEN upd.prompt IS NOT NULL THEN 'Prompt ''' || upd.prompt || ''' updated to v' || (SELECT version FROM cur c WHERE c.repo_name = n.repo_name AND c.prompt = upd.prompt) || ' (no previous version tracking)' END
WHEN nc <> np THEN 'Prompt count changed (' || np || ' → ' || nc || ')' WHEN chg.prompt IS NOT NULL THEN 'Prompt ''' || chg.prompt || ''' version changed (v' || coalesce((SELECT version FROM prev p WHERE p.repo_name = n.repo_name AND p.prompt = chg.prompt), '1') || ' → v' || (SELECT version FROM cur c WHERE c.repo_name = n.repo_name AND c.prompt = chg.prompt) || ')'
WHEN gone.prompts IS NOT NULL THEN 'Prompt ''' || gone.prompts[1] || ''' was removed' END AS reason FROM n LEFT JOIN chg USING (repo_name) LEFT JOIN upd USING (repo_name) LEFT JOIN gone USING (repo_name)"""


@plan(_V + _PROMPT_REASON)
def prompt_version_diff(spark, sf_dir):
    return versions(spark, sf_dir).select("repo_name", h.prompt_diff(F.col("current"), F.col("previous")).alias("reason"))


@plan(_V + f""", reasons AS ({_PROMPT_REASON}), s AS (SELECT repo_name, CASE WHEN repo_name % 6 = 1 THEN 'abcdef0123' ELSE '0123456789' END AS commit_sha, CASE WHEN repo_name % 10 = 3 THEN 'dev' ELSE 'main' END AS branch_name, CASE WHEN repo_name % 13 <> 2 THEN 1000000 + repo_name END AS last_timestamp, reason FROM reasons),
d AS (SELECT *, CASE WHEN last_timestamp IS NULL THEN 'No previous investigation found' WHEN commit_sha <> '0123456789' THEN 'New commits detected (current: abcdef01, last: 01234567)' WHEN branch_name <> 'main' THEN 'Branch changed (current: dev, last: main)' ELSE reason END AS why FROM s)
SELECT repo_name, why IS NOT NULL AS needs_investigation, coalesce(why, 'No changes since last investigation on ' || strftime(make_timestamp(last_timestamp * 1000000), '%Y-%m-%dT%H:%M:%S') || '+00:00') AS reason, last_timestamp FROM d""")
def decision_with_prompts(spark, sf_dir):
    """Commits, branches and prompt versions in one decision: suppliers as repositories with the prompts of ``versions``, some with a new commit, another branch or no history."""
    number = F.col("repo_name")
    v = versions(spark, sf_dir)
    state = v.select("repo_name", F.when(number % 6 == 1, "abcdef0123").otherwise("0123456789").alias("commit_sha"), F.when(number % 10 == 3, "dev").otherwise("main").alias("branch_name"), F.col("current").alias("prompt_versions"))
    history = v.filter(number % 13 != 2).select(number.alias(h.KEY), (number + 1_000_000).alias(h.AT), F.lit("investigation").alias(h.KIND), F.lit("0123456789").alias(h.COMMIT), F.lit("main").alias(h.BRANCH), F.col("previous").alias("prompt_versions"))
    return h.investigation_decision(state, history).select("repo_name", "needs_investigation", "reason", "last_timestamp")


@plan(_V + "SELECT n.repo_name, chg.prompt AS first_changed FROM n LEFT JOIN chg USING (repo_name)")
def first_change_reason(spark, sf_dir):
    return versions(spark, sf_dir).select("repo_name", h.first_change(F.col("current"), F.col("previous")).alias("first_changed"))


@plan(_V + "SELECT n.repo_name, coalesce(array_to_string(gone.prompts, ','), '') AS removed FROM n LEFT JOIN gone USING (repo_name)")
def removed_prompts(spark, sf_dir):
    return versions(spark, sf_dir).select("repo_name", F.array_join(h.removed_prompts(F.col("current"), F.col("previous")), ",").alias("removed"))


@plan("""WITH v AS (SELECT l_suppkey AS repo_name, l_returnflag || l_linestatus AS prompt, CAST(max(l_linenumber) AS VARCHAR) AS version FROM lineitem GROUP BY ALL)
SELECT repo_name, CAST(count(*) AS INT) AS count, string_agg(prompt || '=' || version, ',' ORDER BY prompt) AS versions FROM v GROUP BY 1""")
def prompt_metadata(spark, sf_dir):
    li = _read(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("repo_name"), F.concat("l_returnflag", "l_linestatus").alias("prompt")).agg(F.max("l_linenumber").cast("string").alias("version"))
    meta = h.prompt_metadata(li, "repo_name")
    return meta.select("repo_name", "count", F.array_join(F.transform(F.map_entries("versions"), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",").alias("versions"))


@plan("""WITH r AS (SELECT CAST(o_orderkey AS VARCHAR) AS repo_name, CASE WHEN o_orderkey % 9 = 0 THEN ' ' ELSE o_orderpriority END AS branch_name, substr(md5(CAST(o_orderkey AS VARCHAR)), 1, CAST(4 + o_orderkey % 8 AS INT)) AS commit_sha,
CASE o_orderstatus WHEN 'F' THEN 'failed' WHEN 'O' THEN 'success' ELSE 'pending' END AS status, CAST(floor(o_totalprice) AS BIGINT) % 400 AS ttl_days, CASE WHEN o_orderkey % 4 = 0 THEN 'ftp://x' ELSE 'https://x' END AS repo_url,
CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE '1' END AS prompt_version, (o_orderkey % 13) / 10.0 AS temperature, o_orderkey % 2 = 0 AS cached, CASE WHEN o_orderkey % 3 = 0 THEN 'seen' END AS cache_reason, 10 AS total, o_orderkey % 12 AS successful, 2 AS failed, 1 AS skipped FROM orders),
v AS (SELECT repo_name, 'branch_name' AS "column", 'blank' AS rule FROM r WHERE trim(branch_name) = '' UNION ALL SELECT repo_name, 'commit_sha', 'shorter than 7' FROM r WHERE length(commit_sha) < 7
UNION ALL SELECT repo_name, 'status', 'unknown' FROM r WHERE status = 'pending' UNION ALL SELECT repo_name, 'ttl_days', 'outside 1 to 365' FROM r WHERE ttl_days NOT BETWEEN 1 AND 365 UNION ALL SELECT repo_name, 'repo_url', 'not http' FROM r WHERE repo_url LIKE 'ftp%'
UNION ALL SELECT repo_name, 'prompt_version', 'blank' FROM r WHERE prompt_version = '' UNION ALL SELECT repo_name, 'temperature', 'outside 0 to 1' FROM r WHERE temperature > 1
UNION ALL SELECT repo_name, 'cached', 'without a reason' FROM r WHERE cached AND cache_reason IS NULL UNION ALL SELECT repo_name, 'successful', 'above total' FROM r WHERE successful > 10
UNION ALL SELECT repo_name, 'total', 'less than its parts' FROM r WHERE successful + 3 > 10) SELECT * FROM v""")
def validate_rows(spark, sf_dir):
    key = F.col("o_orderkey")
    rows = _read(spark, sf_dir, "orders").select(
        key.cast("string").alias("repo_name"), F.when(key % 9 == 0, " ").otherwise(F.col("o_orderpriority")).alias("branch_name"), F.substring(F.md5(key.cast("string")), F.lit(1), (4 + key % 8).cast("int")).alias("commit_sha"),
        F.when(F.col("o_orderstatus") == "F", "failed").when(F.col("o_orderstatus") == "O", "success").otherwise("pending").alias("status"),
        (F.floor("o_totalprice").cast("long") % 400).alias("ttl_days"), F.when(key % 4 == 0, "ftp://x").otherwise("https://x").alias("repo_url"),
        F.when(key % 5 == 0, "").otherwise("1").alias("prompt_version"), ((key % 13) / 10).alias("temperature"), (key % 2 == 0).alias("cached"), F.when(key % 3 == 0, "seen").alias("cache_reason"),
        F.lit(10).alias("total"), (key % 12).alias("successful"), F.lit(2).alias("failed"), F.lit(1).alias("skipped"),
    )
    return h.validate_rows(rows)


@plan("""SELECT CAST(o_orderkey AS VARCHAR) AS repository_name, CAST(1706659200 AS BIGINT) AS analysis_timestamp, printf('%012d', o_orderkey) AS latest_commit, o_orderpriority AS branch_name, 1 AS prompt_count, 'all=' || o_shippriority_x AS versions, CAST(1706659200 + 90 * 86400 AS BIGINT) AS ttl_at FROM (SELECT *, CASE WHEN o_orderkey % 4 = 2 THEN 9 ELSE 1 + o_orderkey % 3 END AS o_shippriority_x FROM orders)""")
def append_history(spark, sf_dir):
    """Saved in three runs, of which the last repeats some of the first with other versions, and read back: one row a key."""
    o = _read(spark, sf_dir, "orders").select(
        F.col("o_orderkey").cast("string").alias("repo_name"), F.lit("https://x").alias("repo_url"), F.format_string("%012d", "o_orderkey").alias("commit_sha"), F.col("o_orderpriority").alias("branch_name"),
        F.array(F.struct(F.lit("all").alias("prompt"), (1 + F.col("o_orderkey") % 3).cast("string").alias("version"))).alias("prompt_versions"), F.col("o_orderstatus").alias("analysis_summary"),
    )
    path = shared_path(spark, "history")
    number = F.col("repo_name").cast("long")
    other = F.array(F.struct(F.lit("all").alias("prompt"), F.lit("9").alias("version")))
    for runs in (o.withColumn("prompt_versions", other).filter(number % 2 == 0), o.filter(number % 2 == 1), o.filter(number % 4 == 0)):
        h.append_history(runs, path, 1_706_659_200)
    rows = read_keyed(spark, path)
    return rows.select(h.KEY, h.AT, h.COMMIT, h.BRANCH, "prompt_count", F.concat(F.lit("all="), F.try_element_at("prompt_versions", F.lit("all"))).alias("versions"), "ttl_at")
