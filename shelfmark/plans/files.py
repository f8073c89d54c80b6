"""File and manifest queries: documents are files of their source, pages are paths of their host."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.functions.digest import digest_tree
from shelfmark.operators import dependencies as dep
from shelfmark.operators import files as f
from shelfmark.operators import manifests as m
from shelfmark.sources import files as src
from shelfmark.sources.shared import shared_path

PLANS: dict = {}
BUDGET = 2_000


def plan(sql: str | None = None):
    def keep(f_):
        PLANS[f_.__name__] = (f_, sql)
        return f_

    return keep


def _read(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---- trees -------------------------------------------------------------------


def paths(spark, sf_dir: str) -> DataFrame:
    """The paths of pages below their hosts, some deeper and some below pruned directories."""
    p = F.regexp_replace(F.regexp_replace("url", "^.*?://[^/]*/", ""), "[?#].*$", "")
    p = F.concat(F.regexp_replace(p, "/$", ""), F.when(F.col("page_id") % 4 == 0, "/a/b/c/d.txt").when(F.col("page_id") % 4 == 1, "/x/y.md").when(F.col("page_id") % 9 == 2, "/node_modules/z.js").otherwise(""))
    return _read(spark, sf_dir, "pages").select(F.regexp_extract("url", "://([^/]*)", 1).alias("repo_name"), p.alias("path"))


_P = r"""WITH paths AS (SELECT regexp_extract(url, '://([^/]*)', 1) AS repo_name, regexp_replace(regexp_replace(regexp_replace(url, '^.*?://[^/]*/', ''), '[?#].*$', ''), '/$', '') ||
CASE WHEN page_id % 4 = 0 THEN '/a/b/c/d.txt' WHEN page_id % 4 = 1 THEN '/x/y.md' WHEN page_id % 9 = 2 THEN '/node_modules/z.js' ELSE '' END AS path FROM pages), kept AS (SELECT *, string_split(path, '/') AS parts FROM paths WHERE NOT contains(path, 'node_modules/')),
dirs AS (SELECT DISTINCT repo_name, i AS level, parts[1:i] AS d FROM kept, (VALUES (1), (2), (3)) v(i) WHERE len(parts) > i),
files AS (SELECT DISTINCT repo_name, parts FROM kept WHERE len(parts) <= 3), hidden AS (SELECT repo_name, parts[1:3] AS d, count(*) AS n FROM kept WHERE len(parts) = 4 GROUP BY ALL), nested AS (SELECT DISTINCT repo_name, parts[1:3] AS d, parts[4] AS name FROM kept WHERE len(parts) > 4)
"""


@plan(_P + "SELECT repo_name, path FROM kept")
def prune_paths(spark, sf_dir):
    return f.prune_paths(paths(spark, sf_dir))


_TREE = """, lines AS (SELECT repo_name, list_transform(d, lambda x: '1' || x) AS place, repeat('  ', level) || d[level] || '/' AS line FROM dirs
UNION ALL SELECT repo_name, list_transform(parts[1:len(parts) - 1], lambda x: '1' || x) || ['0' || parts[len(parts)]], repeat('  ', CAST(len(parts) AS INT)) || parts[len(parts)] FROM files
UNION ALL SELECT repo_name, list_transform(d, lambda x: '1' || x) || ['0' || name], repeat('  ', 4) || name || '/ [NESTED]' FROM nested UNION ALL SELECT repo_name, list_transform(d, lambda x: '1' || x) || ['1'], repeat('  ', 4) || '[' || n || ' files]' FROM hidden)
"""


def _digest_sql(piece: str, source: str) -> str:
    """The digest tree of pieces, whose digested text is ``piece``."""
    return f""", hashed AS (SELECT repo_name, md5({piece}) AS h FROM {source}), buckets AS (SELECT repo_name, substr(h, 1, 3) AS bucket, md5(string_agg(h, '' ORDER BY h)) AS h FROM hashed GROUP BY 1, 2)
SELECT repo_name, md5(string_agg(h, '' ORDER BY bucket)) AS digest FROM buckets GROUP BY 1"""


@plan(_P + _TREE + "SELECT repo_name, md5('Repository: ' || repo_name || chr(10) || repeat('=', length(repo_name) + 12) || chr(10) || chr(10) || string_agg(line, chr(10) ORDER BY place)) AS tree FROM lines GROUP BY 1")
def tree_lines(spark, sf_dir):
    """The whole tree of every host as one text."""
    return f.tree_lines(paths(spark, sf_dir), icons=False).withColumn("tree", F.md5("tree"))


@plan(_P + _TREE + ", pieces AS (SELECT repo_name, array_to_string(place, '/') AS place, line FROM lines UNION ALL SELECT DISTINCT repo_name, '', 'Repository: ' || repo_name || chr(10) || repeat('=', length(repo_name) + 12) FROM lines)" + _digest_sql("place || chr(10) || line", "pieces"))
def tree_digest(spark, sf_dir):
    """Trees of whole hosts, as digests of their lines."""
    pieces = f.tree_pieces(paths(spark, sf_dir), icons=False).withColumn("place", F.array_join("place", "/"))
    return digest_tree(pieces, ["repo_name"], ["place", "text"], "digest")


@plan(_P + "SELECT r.repo_name, (SELECT count(*) FROM dirs x WHERE x.repo_name = r.repo_name) AS dirs, (SELECT count(*) FROM files x WHERE x.repo_name = r.repo_name) AS files, (SELECT count(*) FROM nested x WHERE x.repo_name = r.repo_name) AS nested FROM (SELECT DISTINCT repo_name FROM kept) r")
def structure_stats(spark, sf_dir):
    return f.structure_stats(paths(spark, sf_dir))


@plan("""WITH s AS (SELECT source AS repo_name, CAST(sum(strlen(text)) AS BIGINT) AS bytes, count(*) AS files FROM documents GROUP BY 1),
v AS (SELECT *, CASE WHEN bytes < 1024 THEN 0 WHEN bytes < 1048576 THEN 1 WHEN bytes < 1073741824 THEN 2 WHEN bytes < 1099511627776 THEN 3 ELSE 4 END AS p FROM s)
SELECT repo_name, bytes, files, CAST(round_even(bytes / pow(1024, p), 1) AS DECIMAL(18,1)) || ' ' || (['B', 'KB', 'MB', 'GB', 'TB'])[p + 1] || ' (' || files || ' files)' AS size FROM v""")
def repo_size(spark, sf_dir):
    return f.repo_size(_read(spark, sf_dir, "documents").select(F.col("source").alias("repo_name"), F.octet_length("text").alias("length")))


# ---- manifests ---------------------------------------------------------------

_FILE_NAMES = ("requirements.txt", "package.json", "Gemfile", "x.csproj", "poetry.lock", "package-lock.json", "dev-requirements.txt", "node_modules/package.json", "main.py", "Dockerfile", "a.gemspec", "go.sum", "go.mod", "requirements-dev.txt", "my.Pipfile.lock")


def named_files(spark, sf_dir: str) -> DataFrame:
    name = F.get(F.array(*map(F.lit, _FILE_NAMES)), (F.col("doc_id") % len(_FILE_NAMES)).cast("int"))
    return _read(spark, sf_dir, "documents").select(F.col("source").alias("repo_name"), F.concat("lang", F.lit("/"), F.col("doc_id").cast("string"), F.lit("/"), name).alias("path"), F.col("text").alias("content"))


# Fixed values, written out once more for the SQL so that it does not follow the operator.
_PATTERN_ROWS = """('Python', 'production', 0, 'requirements.txt'), ('Python', 'production', 1, 'requirements-prod.txt'), ('Python', 'production', 2, 'requirements-production.txt'), ('Python', 'production', 3, 'pyproject.toml'), ('Python', 'production', 4, 'setup.py'), ('Python', 'production', 5, 'setup.cfg'), ('Python', 'production', 6, 'Pipfile'), ('Python', 'production', 7, 'environment.yml'), ('Python', 'production', 8, 'environment.yaml'), ('Python', 'production', 9, 'conda.yml'), ('Python', 'production', 10, 'conda.yaml'),
('Python', 'dev', 0, 'requirements-dev.txt'), ('Python', 'dev', 1, 'requirements-test.txt'), ('Python', 'dev', 2, 'requirements-development.txt'), ('Python', 'dev', 3, 'test-requirements.txt'), ('Python', 'dev', 4, 'dev-requirements.txt'),
('JavaScript', 'production', 0, 'package.json'), ('JavaScript', 'production', 1, 'bower.json'), ('JavaScript', 'production', 2, 'lerna.json'),
('Ruby', 'production', 0, 'Gemfile'), ('Ruby', 'production', 1, '*.gemspec'),
('Go', 'production', 0, 'go.mod'), ('Go', 'production', 1, 'Gopkg.toml'),
('Rust', 'production', 0, 'Cargo.toml'),
('Java', 'production', 0, 'pom.xml'), ('Java', 'production', 1, 'build.gradle'), ('Java', 'production', 2, 'build.gradle.kts'), ('Java', 'production', 3, 'settings.gradle'), ('Java', 'production', 4, 'settings.gradle.kts'),
('CSharp', 'production', 0, '*.csproj'), ('CSharp', 'production', 1, '*.fsproj'), ('CSharp', 'production', 2, '*.vbproj'), ('CSharp', 'production', 3, 'packages.config'), ('CSharp', 'production', 4, 'Directory.Build.props'),
('PHP', 'production', 0, 'composer.json'),
('Other', 'production', 0, 'Dockerfile'), ('Other', 'production', 1, 'docker-compose.yml'), ('Other', 'production', 2, 'docker-compose.yaml'), ('Other', 'production', 3, '.tool-versions')"""
_BARRED = """(language = 'Python' AND (contains(name, 'Pipfile.lock') OR contains(name, 'poetry.lock'))) OR
(language = 'JavaScript' AND (contains(name, 'package-lock.json') OR contains(name, 'yarn.lock') OR contains(name, 'pnpm-lock.yaml') OR contains(name, 'node_modules'))) OR
(language = 'Ruby' AND (contains(name, 'Gemfile.lock'))) OR
(language = 'Go' AND (contains(name, 'go.sum') OR contains(name, 'Gopkg.lock'))) OR
(language = 'Rust' AND (contains(name, 'Cargo.lock'))) OR
(language = 'CSharp' AND (contains(name, 'packages.lock.json'))) OR
(language = 'PHP' AND (contains(name, 'composer.lock')))"""
_M = f"""WITH pats AS (SELECT * FROM (VALUES {_PATTERN_ROWS}) v(language, dep_type, pattern_ordinal, pattern)),
named AS (SELECT source AS repo_name, lang || '/' || doc_id || '/' || ({list(_FILE_NAMES)})[doc_id % {len(_FILE_NAMES)} + 1] AS path FROM documents),
found AS (SELECT repo_name, '/' || path AS full_path, language, dep_type, pattern_ordinal, string_split(path, '/')[-1] AS name FROM named JOIN pats ON CASE WHEN starts_with(pattern, '*') THEN ends_with(string_split(path, '/')[-1], substr(pattern, 2)) ELSE string_split(path, '/')[-1] = pattern END),
manifests AS (SELECT repo_name, language, dep_type, pattern_ordinal, full_path FROM found WHERE dep_type = 'dev' OR NOT ({_BARRED}))
"""


@plan(_M + "SELECT * FROM manifests")
def match_manifests(spark, sf_dir):
    return m.match_manifests(named_files(spark, sf_dir)).select("repo_name", "language", "dep_type", "pattern_ordinal", "full_path")


@plan(_M + "SELECT repo_name, count(*) AS files, count(DISTINCT language) AS languages, 'Found ' || count(*) || ' dependency files across ' || count(DISTINCT language) || ' languages' AS message FROM manifests GROUP BY 1")
def manifest_counts(spark, sf_dir):
    return m.manifest_counts(m.match_manifests(named_files(spark, sf_dir)))


def dependency_files(spark, sf_dir: str) -> DataFrame:
    d = _read(spark, sf_dir, "documents")
    return d.select(
        F.col("source").alias("repo_name"), F.col("lang").alias("language"), F.when(F.col("doc_id") % 4 == 0, "dev").otherwise("production").alias("dep_type"), (F.col("doc_id") % 3).cast("int").alias("pattern_ordinal"),
        F.format_string("/%09d", "doc_id").alias("full_path"), F.col("text").alias("content"),
    )


_D = """WITH RECURSIVE d AS (SELECT source AS repo_name, lang AS language, CASE WHEN doc_id % 4 = 0 THEN 'dev' ELSE 'production' END AS dep_type, CAST(doc_id % 3 AS INT) AS pattern_ordinal, printf('/%09d', doc_id) AS full_path, text AS content FROM documents),
blocks AS (SELECT *, '**File:** `' || full_path || '`' || chr(10) || chr(10) || '```' || chr(10) || content || chr(10) || '```' || chr(10) AS block FROM d),
kinds AS (SELECT repo_name, language, dep_type, CASE dep_type WHEN 'production' THEN '#### Production Dependencies' ELSE '#### Developer-Only Dependencies' END || chr(10) || chr(10) || string_agg(block, chr(10) ORDER BY full_path) AS text FROM blocks GROUP BY 1, 2, 3),
langs AS (SELECT repo_name, language, '### ' || language || chr(10) || chr(10) || string_agg(text, chr(10) ORDER BY dep_type DESC) AS text FROM kinds GROUP BY 1, 2)
"""


@plan(_D + """, pieces AS (SELECT repo_name, language, CASE dep_type WHEN 'production' THEN '0' ELSE '1' END AS kind, full_path, block AS text FROM blocks WHERE block IS NOT NULL),
heads AS (SELECT DISTINCT repo_name, language, kind, '' AS full_path, CASE kind WHEN '0' THEN '#### Production Dependencies' ELSE '#### Developer-Only Dependencies' END || chr(10) || chr(10) AS text FROM pieces
UNION ALL SELECT DISTINCT repo_name, language, '', '', '### ' || language || chr(10) || chr(10) FROM pieces UNION ALL SELECT DISTINCT repo_name, '', '', '', '## Dependencies' || chr(10) || chr(10) FROM pieces),
both_rows AS (SELECT * FROM pieces UNION ALL SELECT * FROM heads)""" + _digest_sql("language || chr(10) || kind || chr(10) || full_path || chr(10) || text", "both_rows"))
def dependency_digest(spark, sf_dir):
    """The dependency texts of whole repositories, as digests of their pieces."""
    return digest_tree(m.dependency_pieces(dependency_files(spark, sf_dir), ["repo_name"]), ["repo_name"], ["language", "kind", "full_path", "text"], "digest")


_PACK = _D + f""", lt AS (SELECT repo_name, language, CAST(floor(length('## Dependencies' || chr(10) || chr(10) || text) / 3.5) AS BIGINT) AS language_tokens FROM langs),
o AS (SELECT d.*, CAST(floor((length(full_path) + length(content) + 22) / 3.5) AS BIGINT) AS tokens, language_tokens, row_number() OVER (PARTITION BY repo_name, language ORDER BY dep_type DESC, pattern_ordinal, full_path) AS rn FROM d JOIN lt USING (repo_name, language)),
walk AS (SELECT repo_name, language, rn, tokens AS held, 0 AS sub_batch FROM o WHERE rn = 1 AND language_tokens > {BUDGET}
UNION ALL SELECT o.repo_name, o.language, o.rn, CASE WHEN w.held + o.tokens > {BUDGET} THEN o.tokens ELSE w.held + o.tokens END, CASE WHEN w.held + o.tokens > {BUDGET} THEN w.sub_batch + 1 ELSE w.sub_batch END FROM walk w JOIN o ON o.repo_name = w.repo_name AND o.language = w.language AND o.rn = w.rn + 1),
packed AS (SELECT o.repo_name, o.language, o.dep_type, o.pattern_ordinal, o.full_path, coalesce(w.sub_batch, 0) AS sub_batch, CASE WHEN w.rn IS NULL THEN o.language_tokens ELSE CAST(sum(o.tokens) OVER (PARTITION BY o.repo_name, o.language, w.sub_batch) AS BIGINT) END AS batch_tokens FROM o LEFT JOIN walk w USING (repo_name, language, rn))
"""


@plan(_PACK + """, rows AS (SELECT p.repo_name, p.language, p.sub_batch, p.dep_type, p.full_path, b.block FROM packed p JOIN blocks b USING (repo_name, language, dep_type, full_path)),
shown AS (SELECT repo_name, language, sub_batch, dep_type, CASE dep_type WHEN 'production' THEN '#### Production Dependencies' ELSE '#### Developer-Only Dependencies' END || chr(10) || chr(10) || string_agg(block, chr(10) ORDER BY full_path) AS text FROM rows GROUP BY 1, 2, 3, 4)
SELECT repo_name, language, CAST(sub_batch AS BIGINT) AS sub_batch, md5('## Dependencies' || chr(10) || chr(10) || '### ' || language || chr(10) || chr(10) || string_agg(text, chr(10) ORDER BY dep_type DESC)) AS formatted FROM shown GROUP BY 1, 2, 3""")
def format_dependencies(spark, sf_dir):
    """The text of every batch; a batch holds what a token budget allows, or one file."""
    files = dependency_files(spark, sf_dir)
    batches = m.pack_batches(files, BUDGET).select("repo_name", "language", "dep_type", "full_path", "sub_batch")
    texts = m.format_dependencies(files.join(batches, ["repo_name", "language", "dep_type", "full_path"]).withColumn("of", F.col("language")), ["repo_name", "of", "sub_batch"])
    return texts.select("repo_name", F.col("of").alias("language"), F.col("sub_batch").cast("long").alias("sub_batch"), F.md5("formatted").alias("formatted"))


@plan(_PACK + "SELECT * FROM packed")
def pack_batches(spark, sf_dir):
    return m.pack_batches(dependency_files(spark, sf_dir), BUDGET)


@plan(_PACK + """, b AS (SELECT repo_name, language, sub_batch, count(*) AS files, max(batch_tokens) AS estimated_tokens FROM packed GROUP BY 1, 2, 3)
SELECT *, row_number() OVER (PARTITION BY repo_name ORDER BY language, sub_batch) - 1 AS batch_index, count(*) OVER (PARTITION BY repo_name) AS total_batches FROM b""")
def number_batches(spark, sf_dir):
    return m.number_batches(m.pack_batches(dependency_files(spark, sf_dir), BUDGET)).withColumn("batch_index", F.col("batch_index").cast("long"))


def manifest_texts(spark, sf_dir: str) -> DataFrame:
    """Suppliers as repositories whose manifests, of four formats in turn, list the parts that they sold: a file for each return flag and status. Every ninth file is cut off, which only some formats notice."""
    li = _read(spark, sf_dir, "lineitem").join(_read(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    sold = li.select(F.col("l_suppkey").alias("repo_name"), F.col("l_returnflag").alias("flag"), (F.col("l_linestatus") == "F").alias("dev"), F.concat(F.replace("p_brand", F.lit("#"), F.lit("_")), F.lit("-"), F.col("p_size").cast("string")).alias("name"), F.col("p_size").cast("string").alias("size"))
    # Dealt once, for what is distinct and for the files.
    sold = sold.repartition("repo_name", "flag", "dev").distinct()
    kind = F.col("repo_name") % 4
    line = (
        F.when(kind == 0, F.concat("name", F.lit("=="), "size", F.lit(".0")))
        .when(kind == 1, F.concat(F.lit('"'), "name", F.lit('": "^'), "size", F.lit('.0"')))
        .when(kind == 2, F.concat(F.lit("<dependency><groupId>g</groupId><artifactId>"), "name", F.lit("</artifactId><version>"), "size", F.lit(".0</version>"), F.when(F.col("dev"), "<scope>test</scope>").otherwise(""), F.lit("</dependency>")))
        .otherwise(F.concat("name", F.lit(' = { version = "'), "size", F.lit('.0" }')))
    )
    files = sold.groupBy("repo_name", "flag", "dev").agg(F.sort_array(F.collect_list(line)).alias("lines"))
    joined = lambda sep: F.array_join("lines", sep)
    name = F.when(kind == 0, F.when(F.col("dev"), "requirements-dev.txt").otherwise("requirements.txt")).when(kind == 1, "package.json").when(kind == 2, "pom.xml").otherwise("Cargo.toml")
    text = (
        F.when(kind == 0, joined("\n"))
        .when(kind == 1, F.concat(F.when(F.col("dev"), '{"devDependencies": {').otherwise('{"dependencies": {'), joined(", "), F.lit("}}")))
        .when(kind == 2, F.concat(F.lit("<project><dependencies>"), joined(""), F.lit("</dependencies></project>")))
        .otherwise(F.concat(F.when(F.col("dev"), "[dev-dependencies]\n").otherwise("[dependencies]\n"), joined("\n")))
    )
    whole = F.when(F.col("repo_name") % 9 == 5, F.substring(text, 1, 20)).otherwise(text)
    return files.select(F.col("repo_name").cast("string").alias("repo_name"), F.concat("flag", F.when(F.col("dev"), "/dev/").otherwise("/"), name).alias("path"), whole.alias("content"))


def dependencies(spark, sf_dir: str) -> DataFrame:
    return dep.read_dependencies(manifest_texts(spark, sf_dir).filter("cast(repo_name as long) % 9 <> 5")).filter("error IS NULL")


_SOLD = """WITH sold AS (SELECT DISTINCT l_suppkey AS k, l_returnflag AS flag, l_linestatus = 'F' AS dev, replace(p_brand, '#', '_') || '-' || p_size AS plain, p_size FROM lineitem JOIN part ON l_partkey = p_partkey),
deps AS (SELECT k, CAST(k AS VARCHAR) AS repo_name, '/' || flag || CASE WHEN dev THEN '/dev/' ELSE '/' END || CASE k % 4 WHEN 0 THEN CASE WHEN dev THEN 'requirements-dev.txt' ELSE 'requirements.txt' END WHEN 1 THEN 'package.json' WHEN 2 THEN 'pom.xml' ELSE 'Cargo.toml' END AS full_path,
CASE WHEN dev THEN 'dev' ELSE 'production' END AS dep_type, CASE WHEN k % 4 = 2 THEN 'g:' ELSE '' END || plain AS name, CASE k % 4 WHEN 0 THEN '==' WHEN 1 THEN '^' ELSE '' END AS operator, p_size || '.0' AS version FROM sold)
"""


@plan(_SOLD + """, whole AS (SELECT repo_name, full_path, dep_type, name, operator || version AS "constraint", operator, version, NULL AS error FROM deps WHERE k % 9 <> 5),
cut AS (SELECT DISTINCT k, repo_name, full_path FROM deps WHERE k % 9 = 5 AND k % 4 <> 0)
SELECT * FROM whole UNION ALL SELECT repo_name, full_path, 'production', NULL, NULL, NULL, NULL, 'cannot be read: ' || string_split(full_path, '/')[-1] FROM cut""")
def read_dependencies(spark, sf_dir):
    """Rows of whole manifests, and an error for each that is cut off (a requirements file has no end to miss, so those are left whole or out)."""
    return dep.read_dependencies(manifest_texts(spark, sf_dir).filter("cast(repo_name as long) % 9 <> 5 or cast(repo_name as long) % 4 <> 0"))


_DEP = _SOLD + ", n AS (SELECT *, regexp_replace(lower(name), '[-_. ]', '', 'g') AS dependency FROM deps WHERE k % 9 <> 5) "


@plan(_DEP + "SELECT repo_name, dependency, string_agg(DISTINCT full_path, ',' ORDER BY full_path) AS paths, bool_or(dep_type = 'production') AS is_production FROM n GROUP BY 1, 2")
def dependency_catalog(spark, sf_dir):
    return m.dependency_catalog(dependencies(spark, sf_dir)).withColumn("paths", F.array_join("paths", ","))


@plan(_DEP + ", cat AS (SELECT DISTINCT regexp_replace(lower(replace(p_brand, '#', '') || '_' || p_size), '[-_. ]', '', 'g') AS dependency, p_type AS technology FROM part) SELECT repo_name, technology, CAST(count(*) AS BIGINT) AS uses FROM n JOIN cat USING (dependency) GROUP BY 1, 2")
def detect_technologies(spark, sf_dir):
    catalogue = _read(spark, sf_dir, "part").select(F.concat(F.replace("p_brand", F.lit("#"), F.lit("")), F.lit("_"), F.col("p_size").cast("string")).alias("name"), F.col("p_type").alias("technology"))
    return m.detect_technologies(dependencies(spark, sf_dir), catalogue)


#: A small selector table in the shape of a configuration.
_SELECTORS = (
    ("infra-as-code", "files", "SHIP"), ("infra-as-code", "directories", "AIR"), ("frontend", "files", "A"), ("frontend", "files", "R"), ("frontend", "dependencies", "O"), ("backend", "files", "N"), ("backend", "directories", "F"), ("backend", "keywords", "1"), ("libraries", "directories", "O"), ("libraries", "keywords", "2"),
)


@plan(f"""WITH sel AS (SELECT * FROM (VALUES {", ".join(map(str, _SELECTORS))}) v(repo_type, dimension, pattern)), sig AS (SELECT DISTINCT l_partkey AS repo_name, dimension, pattern FROM lineitem, LATERAL (VALUES ('files', l_returnflag), ('directories', l_linestatus), ('dependencies', l_linestatus), ('keywords', CAST(l_linenumber AS VARCHAR))) v(dimension, pattern)),
size AS (SELECT repo_type, dimension, count(*) AS patterns FROM sel GROUP BY 1, 2), hits AS (SELECT repo_name, repo_type, dimension, count(*) AS hits FROM sig JOIN sel USING (dimension, pattern) GROUP BY 1, 2, 3),
sc AS (SELECT repo_name, repo_type, round(sum(CASE dimension WHEN 'files' THEN 0.5 WHEN 'directories' THEN 0.3 WHEN 'dependencies' THEN 0.15 ELSE 0.05 END * hits / patterns), 9) AS score FROM hits JOIN size USING (repo_type, dimension) GROUP BY 1, 2),
best AS (SELECT *, row_number() OVER (PARTITION BY repo_name ORDER BY score DESC, list_position(['infra-as-code', 'libraries', 'frontend', 'backend', 'generic'], repo_type)) AS rn FROM sc WHERE score >= 0.15)
SELECT r.repo_name, coalesce(repo_type, 'generic') AS repo_type, CAST(coalesce(score, 0) AS DOUBLE) AS score FROM (SELECT DISTINCT repo_name FROM sig) r LEFT JOIN best b ON b.repo_name = r.repo_name AND rn = 1""")
def score_repo_types(spark, sf_dir):
    pairs = F.array(*(F.struct(F.lit(d).alias("dimension"), v.alias("value")) for d, v in (("files", F.col("l_returnflag")), ("directories", F.col("l_linestatus")), ("dependencies", F.col("l_linestatus")), ("keywords", F.col("l_linenumber").cast("string")))))
    signals = _read(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("repo_name"), F.explode(pairs).alias("s")).select("repo_name", "s.*")
    return m.score_repo_types(signals, spark.createDataFrame(list(_SELECTORS), "repo_type string, dimension string, pattern string"))


# ---- manifest texts ----------------------------------------------------------


@plan("""SELECT p_partkey, 'production' AS dep_type, '' AS mark, CASE WHEN p_partkey % 3 = 0 THEN '{broken' ELSE '{' || chr(10) || '  "dependencies": {' || chr(10) || '    "' || p_brand || '": "' || p_size || '"' || chr(10) || '  }' || chr(10) || '}' END AS content FROM part
UNION ALL SELECT p_partkey, 'dev', ' (dev)', '{' || chr(10) || '  "devDependencies": {' || chr(10) || '    "' || p_type || '": "1"' || chr(10) || '  }' || chr(10) || '}' FROM part WHERE p_partkey % 3 <> 0 AND p_partkey % 2 = 0""")
def package_json_sections(spark, sf_dir):
    """Parts as package files: every third is broken JSON."""
    d = _read(spark, sf_dir, "part")
    text = F.when(F.col("p_partkey") % 3 == 0, F.lit("{broken")).otherwise(F.to_json(F.struct(F.map_from_arrays(F.array("p_brand"), F.array(F.col("p_size").cast("string"))).alias("dependencies"), F.when(F.col("p_partkey") % 2 == 0, F.map_from_arrays(F.array("p_type"), F.array(F.lit("1")))).alias("devDependencies"))))
    rows = d.select("p_partkey", F.explode(m.package_json_sections(text)).alias("p"))
    return rows.select("p_partkey", "p.*")


@plan("""WITH g AS (SELECT p_partkey, p_size % 3 = 0 AS dev FROM part), r AS (SELECT p_partkey, 'production' AS dep_type, '' AS mark, 'gem a' || CASE WHEN dev THEN '' ELSE chr(10) || '  gem b' END || chr(10) || 'gem c' || p_partkey AS content FROM g UNION ALL SELECT p_partkey, 'dev', ' (dev/test)', '  gem b' FROM g WHERE dev)
SELECT * FROM r""")
def gemfile_groups(spark, sf_dir):
    group = F.when(F.col("p_size") % 3 == 0, "group :development, :test do").otherwise("group :production do")
    text = F.concat(F.lit("gem a\n"), group, F.lit("\n  gem b\n"), F.when(F.col("p_size") % 3 == 0, "end\n").otherwise(""), F.lit("gem c"), F.col("p_partkey").cast("string"))
    return _read(spark, sf_dir, "part").select("p_partkey", F.explode(m.gemfile_groups(text)).alias("p")).select("p_partkey", "p.*")


@plan("""SELECT p_partkey, 'production' AS dep_type, '' AS mark, CASE WHEN p_partkey % 5 = 0 THEN '[broken' ELSE 'dependencies = ["' || p_brand || '", "' || p_size || '"]' || chr(10) END AS content FROM part
UNION ALL SELECT p_partkey, 'dev', ' (dev)', 'optional-dependencies = { "test" = ["' || p_brand || '"] }' || chr(10) FROM part WHERE p_partkey % 5 <> 0 AND p_partkey % 2 = 0""")
def pyproject_sections(spark, sf_dir):
    key = F.col("p_partkey")
    good = F.concat(F.lit('[project]\ndependencies = ["'), "p_brand", F.lit('", "'), F.col("p_size").cast("string"), F.lit('"]\n'), F.when(key % 2 == 0, F.concat(F.lit('[project.optional-dependencies]\ntest = ["'), "p_brand", F.lit('"]\n'))).otherwise(""))
    return _read(spark, sf_dir, "part").select("p_partkey", F.explode(m.pyproject_sections(F.when(key % 5 == 0, "[broken").otherwise(good))).alias("p")).select("p_partkey", "p.*")


@plan("SELECT 'repo' || c_nationkey AS repo_name, c_mktsegment || '/part.txt' AS path, CAST(count(*) AS VARCHAR) || chr(10) AS content, CAST(length(CAST(count(*) AS VARCHAR)) + 1 AS BIGINT) AS length FROM customer GROUP BY c_nationkey, c_mktsegment")
def read_repo_files(spark, sf_dir):
    """A tree of small files written from customers, and read back."""
    root = shared_path(spark, "tree")
    rows = _read(spark, sf_dir, "customer").groupBy("c_nationkey", "c_mktsegment").agg(F.count(F.lit(1)).cast("string").alias("value"))
    rows.select(F.concat(F.lit("repo"), F.col("c_nationkey").cast("string")).alias("r"), F.col("c_mktsegment").alias("s"), "value").repartition("r", "s").write.partitionBy("r", "s").text(root)
    found = src.read_repo_files(spark, root, "part-*")
    # Spark names its folders key=value and its files part-...; take both back to plain names.
    return found.select(F.regexp_replace("repo_name", "^r=", "").alias("repo_name"), F.regexp_replace(F.regexp_replace("path", "^s=", ""), "/part-[^/]*$", "/part.txt").alias("path"), "content", "length")


@plan("""WITH b AS (SELECT n_nationkey AS k, row_number() OVER (ORDER BY n_nationkey) - 1 AS ordinal FROM nation), r AS (SELECT c_custkey, c_name FROM customer)
SELECT c_name AS repo_type, CAST(ordinal AS INT) AS ordinal, 'n' || k AS step_name, CAST(k % 4 AS VARCHAR) AS version FROM r, b UNION ALL SELECT c_name, CAST((SELECT count(*) FROM b) AS INT), 'own' || c_custkey, '1' FROM r""")
def read_steps(spark, sf_dir):
    """Nations as base steps, one step of its own for each customer."""
    nations = _read(spark, sf_dir, "nation")
    step = lambda key, prefix: F.struct(F.concat(F.lit(prefix), key.cast("string")).alias("name"), F.concat(key.cast("string"), F.lit(".md")).alias("file"))
    base = nations.agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col("n_nationkey").alias("o"), step(F.col("n_nationkey"), "n").alias("s")))), lambda x: x["s"]).alias("processing_order")).select(F.lit("base").alias("repo_type"), F.to_json(F.struct("processing_order")).alias("value"))
    # Files of their own names, which have no prompt text.
    named = F.struct(F.concat(F.lit("own"), F.col("c_custkey").cast("string")).alias("name"), F.concat(F.lit("own"), F.col("c_custkey").cast("string"), F.lit(".md")).alias("file"))
    own = _read(spark, sf_dir, "customer").select(F.col("c_name").alias("repo_type"), F.to_json(F.struct(F.lit("../base").alias("extends"), F.array(named).alias("additional_prompts"))).alias("value"))
    prompts = nations.select(F.concat(F.col("n_nationkey").cast("string"), F.lit(".md")).alias("file"), F.concat(F.lit("version="), (F.col("n_nationkey") % 4).cast("string"), F.lit("\ntext")).alias("content"))
    return src.read_steps(base.unionByName(own), prompts).select("repo_type", "ordinal", "step_name", "version")
