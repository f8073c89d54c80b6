"""Result and document queries: events are cached results, turns of conversations are sections."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.operators import documents as d
from shelfmark.operators import results as r
from shelfmark.operators import search
from shelfmark.sources.keyed import read_keyed
from shelfmark.sources.shared import shared_path

PLANS: dict = {}
NOW = 1_706_659_200  # Fixed value: 2024-01-31.


def plan(sql: str | None = None):
    def keep(f):
        PLANS[f.__name__] = (f, sql)
        return f

    return keep


def _read(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---- cached results ----------------------------------------------------------


def results(spark, sf_dir: str) -> DataFrame:
    at = F.unix_timestamp("ts")
    k = F.get_json_object("props", "$.k").cast("long")
    return _read(spark, sf_dir, "events").select(
        F.col("user_id").cast("string").alias("repo_name"), F.col("event_type").alias("step_name"), F.md5((F.col("user_id") % 3).cast("string")).alias("commit_sha"), (1 + F.col("event_id") % 2).cast("string").alias("prompt_version"),
        F.when(F.col("event_id") % 11 == 0, "").otherwise(F.concat(F.lit("r"), F.col("event_id").cast("string"))).alias("content"), at.alias("created_at"), F.when(k % 10 == 0, 0).otherwise(at + k % 30 * 86_400).alias("ttl_at"), F.col("event_id").alias("id"),
    ).withColumn("created_at", F.col("created_at") * 1_000_000 + F.col("id") % 1_000_000).drop("id")


def tasks(spark, sf_dir: str) -> DataFrame:
    e = _read(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("repo_name"), F.col("event_type").alias("step_name"), F.md5((F.col("user_id") % 4).cast("string")).alias("commit_sha")).distinct()
    return e.withColumn("prompt_version", (1 + F.col("repo_name").cast("long") % 3).cast("string"))


_R = """WITH results AS (SELECT CAST(user_id AS VARCHAR) AS repo_name, event_type AS step_name, md5(CAST(user_id % 3 AS VARCHAR)) AS commit_sha, CAST(1 + event_id % 2 AS VARCHAR) AS prompt_version,
CASE WHEN event_id % 11 = 0 THEN '' ELSE 'r' || event_id END AS content, CAST(floor(epoch(ts)) AS BIGINT) * 1000000 + event_id % 1000000 AS created_at,
CASE WHEN CAST(json_extract(props, '$.k') AS BIGINT) % 10 = 0 THEN 0 ELSE CAST(floor(epoch(ts)) AS BIGINT) + CAST(json_extract(props, '$.k') AS BIGINT) % 30 * 86400 END AS ttl_at FROM events),
latest AS (SELECT * EXCLUDE rn FROM (SELECT *, row_number() OVER (PARTITION BY repo_name, step_name, commit_sha, prompt_version ORDER BY created_at DESC, content DESC) AS rn FROM results) WHERE rn = 1),
tasks AS (SELECT DISTINCT CAST(user_id AS VARCHAR) AS repo_name, event_type AS step_name, md5(CAST(user_id % 4 AS VARCHAR)) AS commit_sha, CAST(1 + user_id % 3 AS VARCHAR) AS prompt_version FROM events)
"""
_LOOKUP = _R + f""", live AS (SELECT * FROM latest WHERE NOT (ttl_at > 0 AND {NOW} > ttl_at)),
looked AS (SELECT t.*, coalesce(l.content, '') <> '' AND t.step_name <> 'FORCED' AS cached, l.content AS old FROM tasks t LEFT JOIN live l USING (repo_name, step_name, commit_sha, prompt_version))
SELECT repo_name, step_name, commit_sha, prompt_version, cached, CASE WHEN cached THEN old END AS content, CASE WHEN cached THEN 'Using cached result from commit ' ELSE 'No cached result for this prompt at commit ' END || substr(commit_sha, 1, 8) || ' v' || prompt_version AS reason FROM looked"""


@plan(_R + "SELECT * FROM latest")
def latest_result(spark, sf_dir):
    return r.latest_result(results(spark, sf_dir))


@plan(_R + f"SELECT * FROM results WHERE NOT (ttl_at > 0 AND {NOW} > ttl_at)")
def not_expired(spark, sf_dir):
    return r.not_expired(results(spark, sf_dir), NOW)


@plan(_LOOKUP.replace("FORCED", ""))
def cache_lookup(spark, sf_dir):
    return r.cache_lookup(tasks(spark, sf_dir), results(spark, sf_dir), NOW)


@plan(_LOOKUP.replace("FORCED", "click"))
def force_section(spark, sf_dir):
    return r.cache_lookup(tasks(spark, sf_dir), results(spark, sf_dir), NOW, forced="click")


@plan(_R + f"SELECT repo_name, step_name, commit_sha, prompt_version, CASE WHEN CAST(repo_name AS BIGINT) % 2 = 0 THEN step_name || ' done' ELSE 'first' END AS content, {NOW} - CASE WHEN CAST(repo_name AS BIGINT) % 2 = 0 THEN 0 ELSE 5 END AS created_at, {NOW} - CASE WHEN CAST(repo_name AS BIGINT) % 2 = 0 THEN 0 ELSE 5 END + 90 * 86400 AS ttl_at FROM tasks")
def append_results(spark, sf_dir):
    """Saved twice, the second time half of the tasks with another result, and read back: one row a key."""
    path = shared_path(spark, "results")
    done = tasks(spark, sf_dir).withColumn("content", F.concat("step_name", F.lit(" done")))
    r.append_results(done.withColumn("content", F.lit("first")), path, NOW - 5)
    r.append_results(done.filter("cast(repo_name as long) % 2 = 0"), path, NOW)
    return read_keyed(spark, path)


# ---- steps and sections ------------------------------------------------------


def sections(spark, sf_dir: str) -> DataFrame:
    """repo_name, ordinal, step_name, description, content, version."""
    return _read(spark, sf_dir, "conversations").select(
        F.col("conv_id").cast("string").alias("repo_name"), F.col("turn").cast("int").alias("ordinal"), F.concat("role", F.lit("_"), F.col("turn").cast("string")).alias("step_name"),
        F.when(F.col("turn") % 2 == 0, F.concat(F.lit("about "), "role")).alias("description"), F.col("text").alias("content"), (1 + F.col("turn") % 2).cast("string").alias("version"),
    )


_S = """WITH sections AS (SELECT CAST(conv_id AS VARCHAR) AS repo_name, CAST(turn AS INT) AS ordinal, role || '_' || turn AS step_name, CASE WHEN turn % 2 = 0 THEN 'about ' || role END AS description, text AS content, CAST(1 + turn % 2 AS VARCHAR) AS version, conv_id, turn FROM conversations),
new AS (SELECT repo_name, step_name, CASE WHEN turn % 5 = 0 THEN '' ELSE content END AS content FROM sections WHERE conv_id % 2 = 0 AND turn % 3 <> 0), cached AS (SELECT repo_name, step_name, CASE WHEN turn = 1 THEN '' ELSE 'old ' || content END AS content FROM sections WHERE (conv_id + turn) % 4 <> 0),
combined AS (SELECT s.repo_name, s.ordinal, s.step_name, s.description, CASE WHEN n.repo_name IS NOT NULL THEN n.content ELSE c.content END AS content, s.version, n.repo_name IS NULL AS cached
FROM sections s LEFT JOIN new n USING (repo_name, step_name) LEFT JOIN cached c USING (repo_name, step_name))
"""


def _new(s: DataFrame) -> DataFrame:
    return s.filter((F.col("repo_name").cast("long") % 2 == 0) & (F.col("ordinal") % 3 != 0)).select("repo_name", "step_name", F.when(F.col("ordinal") % 5 == 0, "").otherwise(F.col("content")).alias("content"))


def _cached(s: DataFrame) -> DataFrame:
    return s.filter((F.col("repo_name").cast("long") + F.col("ordinal")) % 4 != 0).select("repo_name", "step_name", F.when(F.col("ordinal") == 1, "").otherwise(F.concat(F.lit("old "), "content")).alias("content"))


@plan(_S + "SELECT repo_name, ordinal, step_name, description, md5(content) AS content, version, cached FROM combined WHERE coalesce(content, '') <> ''")
def combine_results(spark, sf_dir):
    s = sections(spark, sf_dir)
    return r.combine_results(s, _new(s), _cached(s)).withColumn("content", F.md5("content"))


@plan(_S + "SELECT repo_name, count(*) FILTER (cached) AS cached_steps, count(*) FILTER (NOT cached) AS new_steps FROM combined WHERE coalesce(content, '') <> '' GROUP BY 1")
def combine_stats(spark, sf_dir):
    s = sections(spark, sf_dir)
    return r.combine_stats(r.combine_results(s, _new(s), _cached(s)))


@plan(_S + "SELECT repo_name, step_name FROM sections ANTI JOIN cached USING (repo_name, step_name)")
def missing_results(spark, sf_dir):
    s = sections(spark, sf_dir)
    return r.missing_results(s.select("repo_name", "step_name"), _cached(s))


@plan(_S + """, steps AS (SELECT repo_name, ordinal, CASE WHEN turn = 2 THEN 'monitoring' ELSE step_name END AS step_name, turn % 4 <> 3 AS required FROM sections),
have AS (SELECT DISTINCT repo_name, CASE WHEN turn = 2 AND conv_id % 3 <> 0 THEN 'monitoring' ELSE step_name END AS step_name FROM sections WHERE (conv_id + turn) % 4 <> 0 AND turn <> 1)
SELECT s.repo_name, count(*) AS tracked, coalesce(string_agg(s.step_name, ',' ORDER BY ordinal) FILTER (h.repo_name IS NULL AND required), '') AS missing, coalesce(bool_or(s.step_name = 'monitoring' AND h.repo_name IS NOT NULL), false) AS has_monitoring,
CASE WHEN bool_or(s.step_name = 'monitoring') AND NOT bool_or(s.step_name = 'monitoring' AND h.repo_name IS NOT NULL) THEN 'monitoring is missing' END AS error FROM steps s LEFT JOIN have h USING (repo_name, step_name) GROUP BY 1""")
def completeness(spark, sf_dir):
    s = sections(spark, sf_dir)
    named = F.when(F.col("ordinal") == 2, "monitoring").otherwise(F.col("step_name"))
    steps = s.select("repo_name", "ordinal", named.alias("step_name"), (F.col("ordinal") % 4 != 3).alias("required"))
    have = _cached(s.withColumn("step_name", F.when(F.col("repo_name").cast("long") % 3 != 0, named).otherwise(F.col("step_name"))))
    return r.completeness(steps, have)


@plan("""WITH steps AS (SELECT * FROM (VALUES ('AUTOMOBILE', 0, 'hl_overview'), ('AUTOMOBILE', 1, 'APIs'), ('BUILDING', 0, 'hl_overview'), ('MACHINERY', 0, 'DBs')) v(repo_type, ordinal, step_name)) SELECT CAST(c_custkey AS VARCHAR) AS repo_name, ordinal, step_name FROM customer JOIN steps ON c_mktsegment = repo_type""")
def plan_tasks(spark, sf_dir):
    steps = spark.createDataFrame([("AUTOMOBILE", 0, "hl_overview"), ("AUTOMOBILE", 1, "APIs"), ("BUILDING", 0, "hl_overview"), ("MACHINERY", 0, "DBs")], "repo_type string, ordinal int, step_name string")
    repos = _read(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("repo_name"), F.col("c_mktsegment").alias("repo_type"))
    return r.plan_tasks(repos, steps)


@plan(_S + """, edges AS (SELECT b.repo_name, b.step_name, a.ordinal AS ctx_ordinal, a.step_name AS ctx_step FROM sections a JOIN sections b ON a.repo_name = b.repo_name AND b.turn IN (a.turn + 1, a.turn + 2))
SELECT e.repo_name, e.step_name, md5(string_agg('## ' || ctx_step || chr(10) || chr(10) || c.content, chr(10) || chr(10) ORDER BY ctx_ordinal)) AS context FROM edges e JOIN cached c ON c.repo_name = e.repo_name AND c.step_name = e.ctx_step GROUP BY 1, 2""")
def step_context(spark, sf_dir):
    s = sections(spark, sf_dir)
    by_place = s.select("repo_name", F.col("ordinal").alias("ctx_ordinal"), F.col("step_name").alias("ctx_step"), F.explode(F.array(F.col("ordinal") + 1, F.col("ordinal") + 2)).alias("ordinal"))
    edges = by_place.join(s.select("repo_name", "ordinal", "step_name"), ["repo_name", "ordinal"]).drop("ordinal")
    return r.step_context(edges, _cached(s)).withColumn("context", F.md5("context"))


@plan("""WITH b AS (SELECT n_nationkey AS ordinal, n_name AS step_name FROM nation), m AS (SELECT s_suppkey AS ordinal, s_name AS step_name FROM supplier) SELECT CAST(ordinal AS BIGINT) AS ordinal, step_name FROM b UNION ALL SELECT ordinal + (SELECT max(ordinal) + 1 FROM b), step_name FROM m""")
def union_steps(spark, sf_dir):
    base = _read(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("ordinal"), F.col("n_name").alias("step_name"))
    return r.union_steps(base, _read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("ordinal"), F.col("s_name").alias("step_name")))


@plan("""SELECT CAST(conv_id AS VARCHAR) AS repo_name, turn, row_number() OVER (PARTITION BY conv_id ORDER BY coalesce(CASE WHEN turn % 3 = 0 THEN 5 - turn END, 999), turn) - 1 AS position FROM conversations""")
def order_steps(spark, sf_dir):
    c = _read(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string").alias("repo_name"), "turn", F.col("turn").alias("ordinal"), F.when(F.col("turn") % 3 == 0, 5 - F.col("turn")).alias("order"))
    return r.order_steps(c, ["repo_name"]).select("repo_name", "turn", F.col("position").cast("long").alias("position"))


# ---- documents ---------------------------------------------------------------

_DOC = "string_agg('# ' || step_name || chr(10) || chr(10) || CASE WHEN coalesce(description, '') <> '' THEN description || chr(10) || chr(10) ELSE '' END || content, chr(10) || chr(10) ORDER BY ordinal)"


@plan(_S + f"SELECT repo_name, md5({_DOC}) AS document FROM sections GROUP BY 1")
def assemble_document(spark, sf_dir):
    return d.assemble_document(sections(spark, sf_dir)).withColumn("document", F.md5("document"))


@plan(_S + """, t AS (SELECT *, upper(substr(split_part(step_name, '_', 1), 1, 1)) || substr(split_part(step_name, '_', 1), 2) || ' ' || split_part(step_name, '_', 2) AS title, row_number() OVER (PARTITION BY repo_name ORDER BY ordinal) AS i FROM sections)
SELECT repo_name, md5('## Table of Contents' || chr(10) || chr(10) || string_agg(i || '. [' || title || '](#' || step_name || ')' || chr(10), '' ORDER BY i) || chr(10) || chr(10) || '---' || chr(10) || chr(10) ||
string_agg('## ' || title || ' {#' || step_name || '}' || chr(10) || chr(10) || CASE WHEN coalesce(description, '') <> '' THEN '*' || description || '*' || chr(10) || chr(10) ELSE '' END || content, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY i)) AS document FROM t GROUP BY 1""")
def assemble_document_toc(spark, sf_dir):
    return d.assemble_document_toc(sections(spark, sf_dir)).withColumn("document", F.md5("document"))


@plan(_S + f"SELECT repo_name || '.arch.md' AS file_name, md5({_DOC}) AS document FROM sections GROUP BY repo_name")
def write_documents(spark, sf_dir):
    """Written a file each and read back."""
    path = shared_path(spark, "documents")
    d.write_documents(d.assemble_document(sections(spark, sf_dir)), path)
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file_name"), F.md5("value").alias("document"))


@plan(_S + f"SELECT repo_name || '.arch.md' AS file_name, md5({_DOC}) AS document FROM sections GROUP BY repo_name")
def export_documents(spark, sf_dir):
    path = shared_path(spark, "export")
    d.export_documents(d.assemble_document(sections(spark, sf_dir)), path)
    return spark.read.parquet(path).withColumn("document", F.md5("document"))


@plan(_S + """, a AS (SELECT conv_id // 2 AS pair, turn, content FROM sections WHERE conv_id % 2 = 0), b AS (SELECT conv_id // 2 AS pair, s.turn, CASE WHEN s.turn % 2 = 0 THEN a.content ELSE s.content END AS content FROM sections s LEFT JOIN a ON a.pair = conv_id // 2 AND a.turn = s.turn WHERE conv_id % 2 = 1)
SELECT pair, turn, CASE WHEN b.pair IS NULL THEN 'only-left' WHEN a.pair IS NULL THEN 'only-right' WHEN a.content IS NOT DISTINCT FROM b.content THEN 'same' ELSE 'different' END AS status FROM a FULL JOIN b USING (pair, turn)""")
def diff_documents(spark, sf_dir):
    c = _read(spark, sf_dir, "conversations").select(F.floor(F.col("conv_id") / 2).alias("pair"), "turn", F.col("text").alias("content"), (F.col("conv_id") % 2).alias("side"))
    left, right = c.filter("side = 0").drop("side"), c.filter("side = 1").drop("side")
    other = left.select("pair", "turn", F.col("content").alias("theirs"))
    right = right.join(other, ["pair", "turn"], "left").select("pair", "turn", F.when(F.col("turn") % 2 == 0, F.col("theirs")).otherwise(F.col("content")).alias("content"))
    return d.diff_documents(left, right, ["pair", "turn"])


@plan(_S + "SELECT repo_name, step_name, CAST((length(lower(content)) - length(replace(lower(content), 'the', ''))) / 3 AS BIGINT) AS hits FROM sections WHERE contains(lower(content), 'the')")
def search_documents(spark, sf_dir):
    return d.search_documents(sections(spark, sf_dir), "The")


_HITS = "CAST((length(lower(content)) - length(replace(lower(content), '{0}', ''))) / {1} AS BIGINT)"


@plan(_S + ", now AS (SELECT repo_name, step_name, CASE WHEN conv_id % 7 = 0 THEN 'entirely other words ' || turn ELSE content END AS content FROM sections)" + f"""
SELECT 'the' AS term, repo_name, step_name, {_HITS.format('the', 3)} AS hits FROM now WHERE contains(lower(content), 'the')
UNION ALL SELECT 'other words', repo_name, step_name, {_HITS.format('other words', 11)} FROM now WHERE contains(lower(content), 'other words')
UNION ALL SELECT 'e and tion', repo_name, step_name, {_HITS.format('e', 1)} + {_HITS.format('tion', 4)} FROM now WHERE contains(lower(content), 'e') AND contains(lower(content), 'tion')""")
def search_index(spark, sf_dir):
    """An index of all sections, brought up to date after every seventh conversation changed, and searched for a short, a long and two terms."""
    path = shared_path(spark, "index")
    before = sections(spark, sf_dir).select("repo_name", "step_name", "content")
    number = F.col("repo_name").cast("long")
    changed = before.filter(number % 7 == 0).withColumn("content", F.concat(F.lit("entirely other words "), F.element_at(F.split("step_name", "_"), -1)))
    for rows in (before, changed):
        search.update_index(rows, path, buckets=8)
    found = [search.search_index(spark, path, *terms, buckets=8).select(F.lit(name).alias("term"), "repo_name", "step_name", "hits") for name, terms in (("the", ["The"]), ("other words", ["other WORDS"]), ("e and tion", ["e", "tion"]))]
    return found[0].unionByName(found[1]).unionByName(found[2])


@plan("""WITH s AS (SELECT CAST(conv_id AS VARCHAR) AS repo_name, 's' || turn AS step_name, CASE WHEN (conv_id + turn) % 3 = 0 THEN 'No data processing detected in ' || role ELSE text END AS content FROM conversations)
SELECT repo_name, step_name, bool_or(NOT starts_with(lower(trim(content)), 'no data processing detected')) AS found FROM s GROUP BY ALL""")
def absent_sections(spark, sf_dir):
    """The coverage of all sections, in rows; the matrix of the same name is a pivot of it."""
    s = _read(spark, sf_dir, "conversations").select(
        F.col("conv_id").cast("string").alias("repo_name"), F.concat(F.lit("s"), F.col("turn").cast("string")).alias("step_name"),
        F.when((F.col("conv_id") + F.col("turn")) % 3 == 0, F.concat(F.lit("No data processing detected in "), "role")).otherwise(F.col("text")).alias("content"),
    )
    return d.section_coverage(s)
