"""Registry queries: customers are listed repositories, every third is known, some are skipped, archived or quiet."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.functions.text import detect_repo_type
from shelfmark.operators import registry as r
from shelfmark.plans.text import TYPE_RULES_SQL
from shelfmark.sources import registry as src
from shelfmark.sources.shared import shared_path

PLANS: dict = {}
NOW = 883_612_800  # Fixed value: 1998-01-01.
_NAMES = ("shop-ui", "billing-api", "tools", "android-app", "react-shop", "infra-live", "py-client", "event-worker", "docs", "vue-admin", "data")
_LANGS = ("JavaScript", "Python", "Swift", "HCL", "Vue", "TypeScript", "C", "Go", "")


def plan(sql: str | None = None):
    def keep(f):
        PLANS[f.__name__] = (f, sql)
        return f

    return keep


def _read(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def listing(spark, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    pick = lambda words: F.get(F.array(*map(F.lit, words)), (key % len(words)).cast("int"))
    last = _read(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_orderdate").alias("last_commit_at"))
    return _read(spark, sf_dir, "customer").join(last, "c_custkey", "left").select(
        F.concat(pick(_NAMES), F.lit("-"), key.cast("string")).alias("repo_name"), F.concat(F.lit("https://git.example/"), key.cast("string")).alias("url"),
        F.when(key % 4 == 0, None).otherwise(F.concat(F.lit("a "), F.lower("c_mktsegment"), F.when(key % 13 == 0, " sdk").otherwise(""))).alias("description"),
        pick(_LANGS).alias("language"), (F.col("c_acctbal") < 0).alias("archived"), "last_commit_at", key.alias("key"),
    )


def registry(spark, sf_dir: str) -> DataFrame:
    known = listing(spark, sf_dir).filter("key % 3 = 0")
    return known.select("repo_name", F.when(F.col("key") % 12 == 0, "").otherwise(F.col("url")).alias("url"), "description", F.when(F.col("key") % 5 == 0, None).when(F.col("key") % 7 == 0, "desktop").otherwise("backend").alias("type"))


def skip(spark, sf_dir: str) -> DataFrame:
    return listing(spark, sf_dir).filter("key % 17 = 0").select("repo_name", F.lit("by hand").alias("reason"))


def _list(words) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


_L = f"""WITH last AS (SELECT o_custkey, max(o_orderdate) AS last_commit_at FROM orders GROUP BY 1),
listing AS (SELECT ({_list(_NAMES)})[c_custkey % {len(_NAMES)} + 1] || '-' || c_custkey AS repo_name, 'https://git.example/' || c_custkey AS url,
CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE 'a ' || lower(c_mktsegment) || CASE WHEN c_custkey % 13 = 0 THEN ' sdk' ELSE '' END END AS description, ({_list(_LANGS)})[c_custkey % {len(_LANGS)} + 1] AS language, c_acctbal < 0 AS archived, last_commit_at, c_custkey AS key
FROM customer LEFT JOIN last ON o_custkey = c_custkey),
registry AS (SELECT repo_name, CASE WHEN key % 12 = 0 THEN '' ELSE url END AS url, description, CASE WHEN key % 5 = 0 THEN NULL WHEN key % 7 = 0 THEN 'desktop' ELSE 'backend' END AS type FROM listing WHERE key % 3 = 0),
skip AS (SELECT repo_name, 'by hand' AS reason FROM listing WHERE key % 17 = 0),
cand AS (SELECT *, CASE WHEN archived THEN '{r.ARCHIVED}' WHEN epoch(last_commit_at) < {NOW - r.YEAR_SECONDS} THEN '{r.INACTIVE}' ELSE 'active' END AS decision FROM listing WHERE repo_name NOT IN (SELECT repo_name FROM registry) AND repo_name NOT IN (SELECT repo_name FROM skip)),
typed AS (SELECT repo_name, url, description, {TYPE_RULES_SQL} AS type FROM (SELECT *, lower(repo_name) AS n, lower(coalesce(description, '')) AS d, lower(language) AS lang FROM listing)),
merged AS (SELECT * FROM registry UNION ALL SELECT repo_name, url, CASE WHEN coalesce(description, '') = '' THEN '{r.NO_DESCRIPTION}' ELSE description END, type FROM typed WHERE repo_name NOT IN (SELECT repo_name FROM registry))
"""


@plan(_L + "SELECT * FROM registry WHERE url <> ''")
def valid_repos(spark, sf_dir):
    return r.valid_repos(registry(spark, sf_dir))


@plan(_L + f"SELECT repo_name, url, description, CASE WHEN type IN {r.TYPES} THEN type ELSE 'generic' END AS type FROM registry")
def with_repo_type(spark, sf_dir):
    return r.with_repo_type(registry(spark, sf_dir))


@plan(_L + r""", asked AS (SELECT CASE key % 4 WHEN 0 THEN url || '.git' WHEN 1 THEN 'no-' || repo_name ELSE repo_name END AS identifier FROM listing)
SELECT identifier, CASE WHEN identifier LIKE 'http%' THEN regexp_replace(string_split(identifier, '/')[-1], '\.git$', '') ELSE repo_name END AS repo_name, CASE WHEN identifier LIKE 'http%' THEN identifier ELSE url END AS repo_url,
CASE WHEN identifier LIKE 'http%' THEN 'generic' WHEN repo_name IS NOT NULL THEN coalesce(type, 'generic') END AS repo_type, CASE WHEN identifier NOT LIKE 'http%' AND repo_name IS NULL THEN 'Repository ''' || identifier || ''' not found' END AS error
FROM asked LEFT JOIN registry ON identifier = repo_name""")
def resolve_repo(spark, sf_dir):
    asked = listing(spark, sf_dir).select(F.when(F.col("key") % 4 == 0, F.concat("url", F.lit(".git"))).when(F.col("key") % 4 == 1, F.concat(F.lit("no-"), "repo_name")).otherwise(F.col("repo_name")).alias("identifier"))
    return r.resolve_repo(asked, registry(spark, sf_dir))


@plan(_L + "SELECT repo_name, decision FROM cand")
def sync_candidates(spark, sf_dir):
    return r.sync_candidates(listing(spark, sf_dir), registry(spark, sf_dir), skip(spark, sf_dir), NOW).select("repo_name", "decision")


@plan(_L + "SELECT repo_name, url FROM listing WHERE repo_name NOT IN (SELECT repo_name FROM registry)")
def new_repos(spark, sf_dir):
    return r.new_repos(listing(spark, sf_dir), registry(spark, sf_dir)).select("repo_name", "url")


@plan(_L + "SELECT * FROM merged")
def merge_registry(spark, sf_dir):
    return r.merge_registry(registry(spark, sf_dir), listing(spark, sf_dir))


@plan(_L + ", found AS (SELECT repo_name, 'archived' AS reason FROM listing WHERE archived) SELECT * FROM found UNION ALL SELECT * FROM skip WHERE repo_name NOT IN (SELECT repo_name FROM found)")
def merge_skip_list(spark, sf_dir):
    found = listing(spark, sf_dir).filter("archived").select("repo_name", F.lit(r.ARCHIVED).alias("reason"))
    return r.merge_skip_list(skip(spark, sf_dir), found)


@plan(_L + "SELECT coalesce(type, 'generic') AS type, count(*) AS repos FROM merged GROUP BY 1")
def type_distribution(spark, sf_dir):
    return r.type_distribution(r.merge_registry(registry(spark, sf_dir), listing(spark, sf_dir)))


@plan(_L + "SELECT (SELECT count(*) FROM registry) AS existing, count(*) FILTER (decision <> 'active') AS skipped, count(*) FILTER (decision = 'active') AS new, (SELECT count(*) FROM registry) + count(*) FILTER (decision = 'active') AS total FROM cand")
def sync_summary(spark, sf_dir):
    known = registry(spark, sf_dir)
    return r.sync_summary(known, r.sync_candidates(listing(spark, sf_dir), known, skip(spark, sf_dir), NOW))


@plan(_L + "SELECT repo_name, coalesce(url, '') AS url, coalesce(description, '') AS description, coalesce(type, 'generic') AS type FROM registry")
def write_registry(spark, sf_dir):
    """Written as its JSON document and read back."""
    path = shared_path(spark, "registry")
    src.write_registry(registry(spark, sf_dir), path, default="")
    return src.read_registry(spark, path)


@plan(_L + """SELECT repo_name, url, type, 'team ' || repo_name AS owner FROM registry WHERE url <> '' UNION ALL SELECT repo_name, url, type, NULL FROM typed WHERE repo_name NOT IN (SELECT repo_name FROM registry WHERE url <> '')
UNION ALL SELECT '_comment_1', NULL, NULL, 'what "follows"' UNION ALL SELECT '_comment', NULL, 'generic', 'kept'""")
def update_registry(spark, sf_dir):
    """A registry with comments and a field of its own in every entry, brought up to date from the listing, and read back with all that it holds."""
    path, target = shared_path(spark, "registry"), shared_path(spark, "registry")
    owned = r.valid_repos(registry(spark, sf_dir)).withColumn("owner", F.concat(F.lit("team "), "repo_name"))
    entries = owned.select(F.col("repo_name").alias("name"), F.to_json(F.struct("url", "description", "type", "owner")).alias("raw"))
    comment = spark.createDataFrame([("_comment_1", '"what \\"follows\\""')], "name string, raw string")
    src.write_entries(entries.unionByName(comment), path, src._REGISTRY_HEAD + '"default": "generic", "_comment": "kept", "repositories": {', "}}")
    fresh = listing(spark, sf_dir)
    typed = fresh.select("repo_name", "url", "description", detect_repo_type(F.col("repo_name"), F.col("description"), F.col("language")).alias("type"))
    src.update_registry(spark, path, target, typed)
    found, fields = src.read_document(spark, target)
    of = lambda name: F.get_json_object("raw", f"$.{name}")
    text = F.get(F.from_json(F.concat(F.lit("["), "raw", F.lit("]")), "array<string>"), F.lit(0))
    is_entry = F.col("raw").startswith("{")
    rows = found.select(F.col("name").alias("repo_name"), of("url").alias("url"), of("type").alias("type"), F.when(is_entry, of("owner")).otherwise(text).alias("owner"))
    beside = spark.createDataFrame([("_comment", None, fields["default"], fields["_comment"])], rows.schema)
    return rows.unionByName(beside)


FOREIGN = 65_536  # entries of a document that another tool might have written


@plan("SELECT 'doc-' || doc_id AS repo_name, source AS url, text AS description, lang AS type FROM documents")
def read_foreign_registry(spark, sf_dir):
    """Every document is an entry; its text is full of whatever JSON escapes. Entries lie in large documents, read in byte ranges."""
    path = shared_path(spark, "foreign-registry")
    entry = F.struct(F.col("source").alias("url"), F.col("text").alias("description"), F.col("lang").alias("type"), F.array(F.struct(F.col("n_chars").alias("size"))).alias("parts"))
    docs = _read(spark, sf_dir, "documents").select(
        F.floor(F.col("doc_id") / FOREIGN).alias("document"), F.lit(1).alias("place"), F.col("doc_id").alias("name"),
        F.concat(F.lit(',"doc-'), F.col("doc_id").cast("string"), F.lit('": '), F.to_json(entry)).alias("value"),
    )
    head, tail = '{"default": "main", "limits": {"parts": {"most": 1}}, "repositories": {"_comment": "{"', '}, "done": true}'
    ends = F.explode(F.array(*(F.struct(F.lit(place).alias("place"), F.lit(value).alias("value")) for place, value in ((0, head), (2, tail)))))
    both = docs.select("document").distinct().select("document", ends.alias("e")).select("document", "e.place", F.lit(None).cast("long").alias("name"), "e.value")
    rows = docs.unionByName(both).repartition("document").sortWithinPartitions("document", "place", "name")
    rows.select("document", "value").write.partitionBy("document").text(path)
    return src.read_registry(spark, path)


@plan(_L + "SELECT repo_name, url, description, type FROM registry WHERE url <> ''")
def read_registry(spark, sf_dir):
    """A document with comments among the entries."""
    path = shared_path(spark, "registry")
    entries = r.valid_repos(registry(spark, sf_dir)).select(F.col("repo_name").alias("name"), F.to_json(F.struct("url", "description", "type")).alias("raw"))
    comment = spark.createDataFrame([("_comment_1", '"what follows"')], "name string, raw string")
    src.write_entries(entries.unionByName(comment), path, src._REGISTRY_HEAD + '"default": "", "repositories": {', "}}")
    return src.read_registry(spark, path)


@plan(_L + "SELECT * FROM skip")
def read_skip_list(spark, sf_dir):
    path = shared_path(spark, "skip")
    src.write_skip_list(skip(spark, sf_dir), path)
    return src.read_skip_list(spark, path)


@plan(_L + """SELECT (['github', 'gitlab', 'bitbucket', 'azure_devops', 'codecommit'])[key % 5 + 1] AS provider, repo_name, url, coalesce(description, '') AS description, CASE WHEN key % 5 IN (0, 2) THEN language END AS language, CASE WHEN key % 5 IN (0, 1) THEN archived ELSE false END AS archived FROM listing""")
def read_listing(spark, sf_dir):
    """Customers dealt to five providers' page formats, ten a page, and read back."""
    rows = listing(spark, sf_dir)
    c = F.col
    entries = {
        "github": (0, F.struct(c("repo_name").alias("name"), c("url").alias("html_url"), "description", "language", "archived"), None),
        "gitlab": (1, F.struct(c("repo_name").alias("path_with_namespace"), F.lit("x").alias("name"), c("url").alias("http_url_to_repo"), "description", "archived"), None),
        "bitbucket": (2, F.struct(c("repo_name").alias("full_name"), F.lit("x").alias("name"), "description", "language", F.struct(F.array(F.struct(F.lit("ssh").alias("name"), F.lit("git@x").alias("href")), F.struct(F.lit("https").alias("name"), c("url").alias("href"))).alias("clone")).alias("links")), "values"),
        "azure_devops": (3, F.struct(c("repo_name").alias("name"), c("url").alias("remoteUrl"), F.struct("description").alias("project")), "value"),
        "codecommit": (4, F.struct(c("repo_name").alias("repositoryName"), c("url").alias("cloneUrlHttp"), c("description").alias("repositoryDescription")), None),
    }
    paths = {}
    for provider, (rest, entry, field) in entries.items():
        page = rows.filter(c("key") % 5 == rest).groupBy(F.floor(c("key") / 50).alias("page")).agg(F.collect_list(entry).alias("all"))
        paths[provider] = shared_path(spark, f"listing-{provider}")
        document = F.to_json(F.struct(c("all").alias(field))) if field else F.to_json("all")
        # A line holds one page, and a file the pages of a task.
        page.select(document.alias("value")).write.text(paths[provider])
    return src.read_listing(spark, paths, lines=True).drop("last_commit_at")
