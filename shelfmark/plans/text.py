"""Queries of the column functions over the test tables, with the same rows in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.functions import text as t

PLANS: dict = {}


def plan(sql: str | None = None):
    """Registers a query under its function's name."""

    def keep(f):
        PLANS[f.__name__] = (f, sql)
        return f

    return keep


def _read(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@plan(r"""SELECT page_id, regexp_replace(regexp_replace(string_split(regexp_replace(url, '/+$', ''), '/')[-1], '\.git$', ''), '[^\p{L}\p{N}_\-.]', '_', 'g') AS repo_name FROM pages""")
def repo_name_from_url(spark, sf_dir):
    return _read(spark, sf_dir, "pages").select("page_id", t.repo_name_from_url(F.col("url")).alias("repo_name"))


@plan(r"""SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(url, '^(https://|http://|git@|ssh://)', ''), '[/\\:*?"<>|@#]', '_', 'g'), '_+', '_', 'g'), '^[_.]+|[_.]+$', '', 'g') AS file_key FROM pages""")
def safe_key(spark, sf_dir):
    return _read(spark, sf_dir, "pages").select("page_id", t.safe_key(F.col("url")).alias("file_key"))


@plan("""WITH k AS (SELECT l_orderkey, l_linenumber, 'repo' || l_suppkey || '_' || l_returnflag || l_linestatus || '_' || md5(CAST(l_orderkey AS VARCHAR)) || '_v' || l_linenumber AS key FROM lineitem)
SELECT l_orderkey, l_linenumber, key, regexp_extract(key, '^(.*)_([^_]*)_([^_]*)_v(.*)$', 1) AS repo_name, regexp_extract(key, '^(.*)_([^_]*)_([^_]*)_v(.*)$', 2) AS step_name,
regexp_extract(key, '^(.*)_([^_]*)_([^_]*)_v(.*)$', 3) AS commit_sha, regexp_extract(key, '^(.*)_([^_]*)_([^_]*)_v(.*)$', 4) AS prompt_version FROM k""")
def result_key(spark, sf_dir):
    li = _read(spark, sf_dir, "lineitem")
    key = t.result_key(F.concat(F.lit("repo"), "l_suppkey"), F.concat("l_returnflag", "l_linestatus"), F.md5(F.col("l_orderkey").cast("string")), F.col("l_linenumber").cast("string"))
    return li.select("l_orderkey", "l_linenumber", key.alias("key")).select("*", *(c.alias(n) for n, c in t.parse_result_key(F.col("key")).items()))


@plan(r"""WITH k AS (SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(url, '^(https://|http://|git@|ssh://)', ''), '[/\\:*?"<>|@#]', '_', 'g'), '_+', '_', 'g'), '_.') || '_' || CASE WHEN page_id % 2 = 0 THEN 'full' ELSE 'quick' END AS key FROM pages)
SELECT page_id, key, regexp_extract(key, '^(.*)_([^_]*)$', 1) AS repo_name, regexp_extract(key, '^(.*)_([^_]*)$', 2) AS analysis_type FROM k""")
def history_file_key(spark, sf_dir):
    kind = F.when(F.col("page_id") % 2 == 0, "full").otherwise("quick")
    keyed = _read(spark, sf_dir, "pages").select("page_id", t.history_file_key(F.col("url"), kind).alias("key"))
    return keyed.select("*", *(c.alias(n) for n, c in t.parse_history_file_key(F.col("key")).items()))


@plan(r"""WITH u AS (SELECT page_id, CASE page_id % 3 WHEN 0 THEN url WHEN 1 THEN replace(url, '://', '://user:tok' || page_id || '@') ELSE regexp_replace(url, '^[a-z]+://', 'git@') END AS url FROM pages)
SELECT page_id, CASE WHEN NOT regexp_matches(url, '^https?://') THEN url WHEN regexp_matches(url, '^https?://[^/?#]*@') THEN regexp_replace(url, '^(https?://)[^/?#]*@', '\1') || ' (authentication hidden)'
ELSE replace(url, 'utm_source', '***HIDDEN***') END AS shown FROM u""")
def sanitize_url(spark, sf_dir):
    url = F.col("url")
    made = F.when(F.col("page_id") % 3 == 0, url).when(F.col("page_id") % 3 == 1, F.replace(url, F.lit("://"), F.concat(F.lit("://user:tok"), F.col("page_id").cast("string"), F.lit("@")))).otherwise(F.regexp_replace(url, "^[a-z]+://", "git@"))
    return _read(spark, sf_dir, "pages").withColumn("url", made).select("page_id", t.sanitize_url(url, "utm_source").alias("shown"))


@plan(r"""WITH u AS (SELECT page_id, CASE page_id % 8 WHEN 0 THEN 'https://github.com' WHEN 1 THEN 'https://gitlab.com' WHEN 2 THEN 'https://gitlab.firm.example' WHEN 3 THEN 'https://bitbucket.org' WHEN 4 THEN 'https://dev.azure.com'
WHEN 5 THEN 'https://git-codecommit.eu-west-1.amazonaws.com' WHEN 6 THEN 'https://firm.visualstudio.com' ELSE 'https://git.example' END || regexp_replace(url, '^.*?://[^/]*', '') AS url FROM pages)
SELECT page_id, CASE WHEN contains(url, 'git-codecommit') AND contains(url, 'amazonaws.com') THEN 'codecommit' WHEN contains(url, 'github.com') THEN 'github'
WHEN contains(url, 'gitlab.com') OR contains(regexp_extract(url, '://([^/]*)', 1), 'gitlab.') THEN 'gitlab' WHEN contains(url, 'bitbucket.org') OR contains(regexp_extract(url, '://([^/]*)', 1), 'bitbucket.') THEN 'bitbucket'
WHEN contains(url, 'dev.azure.com') OR contains(url, 'visualstudio.com') THEN 'azure_devops' END AS provider FROM u""")
def url_provider(spark, sf_dir):
    hosts = F.array(*map(F.lit, ("https://github.com", "https://gitlab.com", "https://gitlab.firm.example", "https://bitbucket.org", "https://dev.azure.com", "https://git-codecommit.eu-west-1.amazonaws.com", "https://firm.visualstudio.com", "https://git.example")))
    url = F.concat(F.get(hosts, (F.col("page_id") % 8).cast("int")), F.regexp_replace("url", "^.*?://[^/]*", ""))
    return _read(spark, sf_dir, "pages").select("page_id", url.alias("url")).select("page_id", t.url_provider(F.col("url")).alias("provider"))


_HUB_SQL = r"""WITH b AS (SELECT page_id, regexp_replace(regexp_replace(url, '[?#].*$', '') || CASE WHEN page_id % 3 = 0 THEN '.git' ELSE '' END, '/+$', '') AS base FROM pages),
s AS (SELECT page_id, base, len(list_filter(string_split(regexp_extract(regexp_replace(base, '^.*?://', ''), '^[^/]*/(.*)$', 1), '/'), lambda x: x <> '')) >= 2 AS whole FROM b) """


@plan(_HUB_SQL + """SELECT page_id, CASE WHEN whole THEN CASE WHEN base LIKE '%.git' THEN base ELSE base || '.git' END ELSE base || '/hub.git' END AS hub_url FROM s""")
def hub_repo_url(spark, sf_dir):
    base = F.concat(F.regexp_replace("url", "[?#].*$", ""), F.when(F.col("page_id") % 3 == 0, ".git").otherwise(""))
    return _read(spark, sf_dir, "pages").select("page_id", t.hub_repo_url(base, F.lit("hub")).alias("hub_url"))


@plan(_HUB_SQL + r"""SELECT page_id, CASE WHEN whole THEN regexp_replace(regexp_replace(base, '\.git$', ''), '/+$', '') ELSE base || '/hub' END AS web_url FROM s""")
def hub_web_url(spark, sf_dir):
    base = F.concat(F.regexp_replace("url", "[?#].*$", ""), F.when(F.col("page_id") % 3 == 0, ".git").otherwise(""))
    return _read(spark, sf_dir, "pages").select("page_id", t.hub_web_url(base, F.lit("hub")).alias("web_url"))


# Fixed values, written out once more for the SQL so that it does not follow the operator.
TYPE_RULES_SQL = """CASE
WHEN (contains(n, 'mobile') OR contains(n, 'ios') OR contains(n, 'android') OR contains(n, 'react-native')) OR lang = 'swift' THEN 'mobile'
WHEN (contains(n, 'terraform') OR contains(n, 'infra') OR contains(n, 'helm') OR contains(n, 'k8s') OR contains(n, 'kubernetes') OR contains(n, 'ansible') OR contains(n, 'cloudformation')) OR lang = 'hcl' THEN 'infra-as-code'
WHEN (contains(n, 'sdk') OR contains(n, 'lib') OR contains(n, 'library') OR contains(n, 'client') OR contains(n, 'api-client') OR contains(n, 'package')) OR (contains(d, 'sdk') OR contains(d, 'library') OR contains(d, 'package') OR contains(d, 'client library')) THEN 'libraries'
WHEN lang IN ('javascript', 'typescript') AND ((contains(n, 'frontend') OR contains(n, 'ui') OR contains(n, 'web') OR contains(n, 'portal') OR contains(n, 'dashboard') OR contains(n, 'admin')) OR (NOT (contains(n, 'service') OR contains(n, 'api') OR contains(n, 'server') OR contains(n, 'backend') OR contains(n, 'worker')) AND (contains(n, 'react') OR contains(n, 'vue') OR contains(n, 'angular')))) THEN 'frontend'
WHEN lang = 'vue' THEN 'frontend'
WHEN lang IN ('python', 'ruby', 'go', 'java', 'c#', 'rust') OR (contains(n, 'service') OR contains(n, 'api') OR contains(n, 'server') OR contains(n, 'backend') OR contains(n, 'worker') OR contains(n, 'processor')) THEN 'backend'
ELSE 'generic' END"""
_ASKS_SQL = """(contains(lower(p), 'dependencies') OR contains(lower(p), 'packages') OR contains(lower(p), 'requirements') OR contains(lower(p), 'libraries') OR contains(lower(p), 'npm') OR contains(lower(p), 'pip') OR contains(lower(p), 'gem') OR contains(lower(p), 'cargo') OR contains(lower(p), 'maven') OR contains(lower(p), 'gradle') OR contains(lower(p), 'nuget') OR contains(lower(p), 'pyproject') OR contains(lower(p), 'package.json') OR contains(lower(p), 'gemfile') OR contains(lower(p), '{repo_deps}'))"""
_LANGS = ("JavaScript", "Python", "Swift", "HCL", "Vue", "TypeScript", "C", "Go", "")
_NAMES = ("shop-ui", "billing-api", "tools", "android-app", "react-shop", "infra-live", "py-client", "event-worker", "docs", "vue-admin", "data")
_SUPPLIER_SQL = (
    "SELECT s_suppkey, lower((['" + "', '".join(_NAMES) + "'])[s_suppkey % " + str(len(_NAMES)) + " + 1]) AS n, lower(CASE WHEN s_nationkey % 7 = 0 THEN 'a package of ' ELSE '' END || s_name) AS d, lower((['" + "', '".join(_LANGS) + "'])[s_suppkey % " + str(len(_LANGS)) + " + 1]) AS lang FROM supplier"
)


@plan(f"SELECT s_suppkey, {TYPE_RULES_SQL} AS repo_type FROM ({_SUPPLIER_SQL})")
def detect_repo_type(spark, sf_dir):
    pick = lambda words: F.get(F.array(*map(F.lit, words)), (F.col("s_suppkey") % len(words)).cast("int"))
    description = F.concat(F.when(F.col("s_nationkey") % 7 == 0, "a package of ").otherwise(""), "s_name")
    return _read(spark, sf_dir, "supplier").select("s_suppkey", t.detect_repo_type(pick(_NAMES), description, pick(_LANGS)).alias("repo_type"))


@plan("""SELECT o_orderkey, CASE WHEN o_orderpriority IS NULL OR o_orderpriority IN ('', 'HEAD') OR o_orderkey % 5 = 0 THEN 'detached-' || substr(md5(CAST(o_orderkey AS VARCHAR)), 1, 8) ELSE o_orderpriority END AS branch FROM orders""")
def branch_label(spark, sf_dir):
    branch = F.when(F.col("o_orderkey") % 5 == 0, "HEAD").otherwise(F.col("o_orderpriority"))
    return _read(spark, sf_dir, "orders").select("o_orderkey", t.branch_label(branch, F.md5(F.col("o_orderkey").cast("string"))).alias("branch"))


# Conversations as prompts: some with a version line, some with a broken one.
def _prompts():
    return F.concat(F.when(F.col("turn") % 3 == 0, F.concat(F.lit("version="), (F.col("conv_id") % 7).cast("string"), F.lit("\n\n \n"))).when(F.col("turn") % 3 == 1, "version = 2\n").otherwise(""), "text")


_PROMPTS_SQL = "(SELECT conv_id, turn, role, CASE turn % 3 WHEN 0 THEN 'version=' || (conv_id % 7) || chr(10) || chr(10) || ' ' || chr(10) WHEN 1 THEN 'version = 2' || chr(10) ELSE '' END || text AS content FROM conversations)"


@plan(f"""SELECT conv_id, turn, CASE WHEN starts_with(string_split(content, chr(10))[1], 'version=') AND trim(string_split(string_split(content, chr(10))[1], '=')[2]) <> '' THEN trim(string_split(string_split(content, chr(10))[1], '=')[2]) ELSE '1' END AS version FROM {_PROMPTS_SQL}""")
def prompt_version(spark, sf_dir):
    return _read(spark, sf_dir, "conversations").select("conv_id", "turn", t.prompt_version(_prompts()).alias("version"))


@plan(rf"""SELECT conv_id, turn, md5(regexp_replace(content, '\A(?:version[^\n]*(?:\n|\z)(?:[^\S\n]*(?:\n|\z))*)', '')) AS cleaned FROM {_PROMPTS_SQL}""")
def clean_prompt(spark, sf_dir):
    return _read(spark, sf_dir, "conversations").select("conv_id", "turn", F.md5(t.clean_prompt(_prompts())).alias("cleaned"))


@plan("SELECT doc_id, CAST(coalesce(floor(length(text) / 3.5), 0) AS BIGINT) AS tokens FROM documents")
def estimate_tokens(spark, sf_dir):
    return _read(spark, sf_dir, "documents").select("doc_id", t.estimate_tokens(F.col("text")).alias("tokens"))


@plan("SELECT doc_id, floor(length(text) / 3.5) > 500 AS batched FROM documents")
def needs_batching(spark, sf_dir):
    return _read(spark, sf_dir, "documents").select("doc_id", t.needs_batching(F.col("text"), 500).alias("batched"))


@plan(f"""WITH p AS (SELECT conv_id, turn, text || CASE turn % 3 WHEN 0 THEN ' see {{repo_deps}}' WHEN 1 THEN ' Pip' ELSE '' END AS p, CASE WHEN conv_id % 2 = 0 THEN role || ' 1.0' ELSE '' END AS d FROM conversations)
SELECT conv_id, turn, {_ASKS_SQL} AS asks, md5(CASE WHEN d <> '' AND {_ASKS_SQL} THEN replace(p, '{{repo_deps}}', d) WHEN d <> '' THEN p ELSE replace(p, '{{repo_deps}}', 'No dependency files found!') END) AS filled FROM p""")
def needs_dependencies(spark, sf_dir):
    p = F.concat("text", F.when(F.col("turn") % 3 == 0, " see {repo_deps}").when(F.col("turn") % 3 == 1, " Pip").otherwise(""))
    d = F.when(F.col("conv_id") % 2 == 0, F.concat("role", F.lit(" 1.0"))).otherwise("")
    return _read(spark, sf_dir, "conversations").select("conv_id", "turn", p.alias("p"), d.alias("d")).select("conv_id", "turn", t.needs_dependencies(F.col("p")).alias("asks"), F.md5(t.with_dependencies(F.col("p"), F.col("d"))).alias("filled"))


_LIMIT = 300


@plan(f"""WITH x AS (SELECT doc_id, repeat('Read this. ', CAST(doc_id % 120 AS INT)) AS template, text AS structure, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE repeat('Seen. ', CAST(doc_id % 200 AS INT)) END AS context FROM documents),
n AS (SELECT *, CAST(floor(length(template) / 3.5) AS BIGINT) AS t, CAST(floor(length(structure) / 3.5) AS BIGINT) AS s, CAST(coalesce(floor(length(context) / 3.5), 0) AS BIGINT) AS c FROM x),
m AS (SELECT *, t + s + c - {_LIMIT} AS e, coalesce(context, '') <> '' AS has FROM n),
r AS (SELECT *, e <= 0 AS fits, s > e AS cut, has AND e - c <= 0 AS dropped, CAST(floor((s - e) * 3.5) AS BIGINT) AS room, CAST(greatest(floor(greatest({_LIMIT} - t, 0) * 3.5), 1000) AS BIGINT) AS rest FROM m)
SELECT doc_id, length(CASE WHEN fits OR cut OR dropped OR t <= {_LIMIT} THEN template ELSE substr(template, 1, 10000) || chr(10) || chr(10) || '... [TEMPLATE TRUNCATED: showing first 10,000 of ' || format('{{:,}}', CAST(floor(t * 3.5) AS BIGINT)) || ' characters to fit within {_LIMIT} token limit] ...' END) AS template_chars,
md5(CASE WHEN fits THEN structure WHEN cut THEN substr(structure, 1, room) || chr(10) || chr(10) || '... [TRUNCATED: showing first ' || format('{{:,}}', room) || ' of ' || format('{{:,}}', length(structure)) || ' characters to fit within {_LIMIT} token limit] ...'
WHEN dropped THEN structure ELSE substr(structure, 1, rest) || chr(10) || chr(10) || '... [TRUNCATED] ...' END) AS structure_md5, CASE WHEN fits OR cut THEN length(context) END AS context_chars FROM r""")
def fit_prompt(spark, sf_dir):
    docs = _read(spark, sf_dir, "documents").select(
        "doc_id", F.repeat(F.lit("Read this. "), (F.col("doc_id") % 120).cast("int")).alias("template"), F.col("text").alias("structure"),
        F.when(F.col("doc_id") % 3 != 0, F.repeat(F.lit("Seen. "), (F.col("doc_id") % 200).cast("int"))).alias("context"),
    )
    fitted = t.fit_prompt(F.col("template"), F.col("structure"), F.col("context"), _LIMIT)
    return docs.select("doc_id", F.length(fitted["template"]).cast("long").alias("template_chars"), F.md5(fitted["structure"]).alias("structure_md5"), F.length(fitted["context"]).cast("long").alias("context_chars"))


@plan("""SELECT conv_id, turn, md5(replace(replace('Look at {repo_structure} now.{previous_context}Say more.', '{repo_structure}', text), '{previous_context}', CASE WHEN turn > 0 THEN chr(10) || chr(10) || '## Previous Analysis Context' || chr(10) || chr(10) || role || chr(10) || chr(10) ELSE '' END)) AS prompt,
replace(replace(replace('{batch_index}/{total_batches} {batch_languages}', '{batch_index}', CAST(turn + 1 AS VARCHAR)), '{total_batches}', CAST(conv_id AS VARCHAR)), '{batch_languages}', role) AS batch FROM conversations""")
def render_prompt(spark, sf_dir):
    prompt = t.render_prompt(F.lit("Look at {repo_structure} now.{previous_context}Say more."), F.col("text"), F.when(F.col("turn") > 0, F.col("role")))
    batch = t.render_batch_prompt(F.lit("{batch_index}/{total_batches} {batch_languages}"), F.col("turn"), F.col("conv_id"), F.col("role"))
    return _read(spark, sf_dir, "conversations").select("conv_id", "turn", F.md5(prompt).alias("prompt"), batch.alias("batch"))


@plan(r"""WITH d AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'x' ELSE '[[ ' || text || ' ]] [[b]]' END AS t FROM documents)
SELECT doc_id, CASE WHEN trim(regexp_extract(t, '(?s)\[\[(.*?)\]\]', 1)) = '' THEN 'unknown_repo' ELSE regexp_replace(trim(regexp_extract(t, '(?s)\[\[(.*?)\]\]', 1)), '[^\p{L}\p{N}_\-.]', '_', 'g') END AS name FROM d""")
def bracket_name(spark, sf_dir):
    made = F.when(F.col("doc_id") % 3 == 0, "x").otherwise(F.concat(F.lit("[[ "), "text", F.lit(" ]] [[b]]")))
    return _read(spark, sf_dir, "documents").select("doc_id", t.bracket_name(made).alias("name"))


@plan("""WITH x AS (SELECT o_orderkey, CAST(floor(o_totalprice * o_totalprice / 64) AS BIGINT) AS b FROM orders),
v AS (SELECT o_orderkey, b, CASE WHEN b < 1024 THEN 0 WHEN b < 1048576 THEN 1 WHEN b < 1073741824 THEN 2 WHEN b < 1099511627776 THEN 3 ELSE 4 END AS p FROM x)
SELECT o_orderkey, CAST(round_even(b / pow(1024, p), 1) AS DECIMAL(18,1)) || ' ' || (['B', 'KB', 'MB', 'GB', 'TB'])[p + 1] AS size FROM v""")
def human_size(spark, sf_dir):
    n = F.floor(F.col("o_totalprice") * F.col("o_totalprice") / 64).cast("long")
    return _read(spark, sf_dir, "orders").select("o_orderkey", t.human_size(n).alias("size"))


@plan("SELECT event_id, CAST(floor(epoch(ts)) AS BIGINT) + (event_id % 90) * 86400 AS by_days, CAST(floor(epoch(ts)) AS BIGINT) + 120 * 60 AS by_minutes FROM events")
def ttl_at(spark, sf_dir):
    at = F.unix_timestamp("ts")
    return _read(spark, sf_dir, "events").select("event_id", t.ttl_at(at, days=F.col("event_id") % 90).alias("by_days"), t.ttl_at(at, minutes=F.lit(120)).alias("by_minutes"))


@plan("SELECT DISTINCT role || '_' || CASE WHEN turn % 2 = 0 THEN 'data' ELSE 'map' END AS name, upper(substr(role, 1, 1)) || lower(substr(role, 2)) || CASE WHEN turn % 2 = 0 THEN ' Data' ELSE ' Map' END AS heading FROM conversations")
def section_heading(spark, sf_dir):
    name = F.concat("role", F.when(F.col("turn") % 2 == 0, "_data").otherwise("_map"))
    return _read(spark, sf_dir, "conversations").select(name.alias("name")).distinct().select("name", t.section_heading(F.col("name")).alias("heading"))
