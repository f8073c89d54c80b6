"""Dependency manifests: found by name, parted into production and development, packed into batches."""

from __future__ import annotations

import json
import tomllib
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from shelfmark.functions.text import BATCH_TOKENS, CHARS_PER_TOKEN, NO_DEPENDENCIES
from shelfmark.operators.files import prune_paths
from shelfmark.sources.shared import shared_path

# Manifest names by language, in the order in which they are looked for; what a production name must not contain.
MANIFESTS = (
    ("Python", "production", ("requirements.txt", "requirements-prod.txt", "requirements-production.txt", "pyproject.toml", "setup.py", "setup.cfg", "Pipfile", "environment.yml", "environment.yaml", "conda.yml", "conda.yaml")),
    ("Python", "dev", ("requirements-dev.txt", "requirements-test.txt", "requirements-development.txt", "test-requirements.txt", "dev-requirements.txt")),
    ("JavaScript", "production", ("package.json", "bower.json", "lerna.json")),
    ("Ruby", "production", ("Gemfile", "*.gemspec")),
    ("Go", "production", ("go.mod", "Gopkg.toml")),
    ("Rust", "production", ("Cargo.toml",)),
    ("Java", "production", ("pom.xml", "build.gradle", "build.gradle.kts", "settings.gradle", "settings.gradle.kts")),
    ("CSharp", "production", ("*.csproj", "*.fsproj", "*.vbproj", "packages.config", "Directory.Build.props")),
    ("PHP", "production", ("composer.json",)),
    ("Other", "production", ("Dockerfile", "docker-compose.yml", "docker-compose.yaml", ".tool-versions")),
)
EXCLUDED = {
    "Python": ("Pipfile.lock", "poetry.lock"), "JavaScript": ("package-lock.json", "yarn.lock", "pnpm-lock.yaml", "node_modules"), "Ruby": ("Gemfile.lock",), "Go": ("go.sum", "Gopkg.lock"),
    "Rust": ("Cargo.lock",), "CSharp": ("packages.lock.json",), "PHP": ("composer.lock",),
}
FILE = "repo_name", "language", "dep_type", "pattern_ordinal", "full_path", "content"


def patterns(spark: SparkSession) -> DataFrame:
    """language, dep_type, pattern_ordinal, pattern: under fifty constant rows."""
    rows = [(lang, kind, i, p) for lang, kind, names in MANIFESTS for i, p in enumerate(names)]
    return spark.createDataFrame(rows, "language string, dep_type string, pattern_ordinal int, pattern string")


def match_manifests(files: DataFrame, prune: bool = False) -> DataFrame:
    """Manifests among files (repo_name, path, ...): each with language, dep_type and pattern_ordinal; full_path begins with ``/``.

    A name is looked up as it is and by its suffix, so one join serves both kinds of pattern.
    """
    seen = prune_paths(files) if prune else files
    name = F.element_at(F.split("path", "/"), -1)
    suffix = F.concat(F.lit("*."), F.element_at(F.split(F.col("file_name"), r"\."), -1))
    keys = F.when(F.col("file_name").contains("."), F.array("file_name", suffix)).otherwise(F.array("file_name"))
    named = seen.withColumn("file_name", name).withColumn("pattern", F.explode(keys))
    found = named.join(F.broadcast(patterns(files.sparkSession)), "pattern")
    barred = F.lit(False)
    for language, words in EXCLUDED.items():
        for word in words:
            barred = barred | ((F.col("language") == language) & F.col("file_name").contains(word))
    kept = found.filter((F.col("dep_type") == "dev") | ~barred)
    return kept.withColumn("full_path", F.concat(F.lit("/"), F.regexp_replace("path", "^/+", ""))).drop("pattern", "file_name")


# ---- splitting ---------------------------------------------------------------


def _package_json(text: str) -> list[tuple[str, str, str]]:
    try:
        data = json.loads(text)
    except ValueError:
        return [("production", "", text)]
    out = []
    for kind, mark, wanted in (("production", "", ("dependencies", "peerDependencies")), ("dev", " (dev)", ("devDependencies",))):
        part = {k: data[k] for k in wanted if data.get(k)} if isinstance(data, dict) else {}
        if part:
            out.append((kind, mark, json.dumps(part, indent=2)))
    return out


def _toml(value) -> str:
    """A value in TOML's inline form."""
    if isinstance(value, dict):
        return "{ " + ", ".join(f"{json.dumps(k)} = {_toml(v)}" for k, v in value.items()) + " }"
    if isinstance(value, list):
        return "[" + ", ".join(map(_toml, value)) + "]"
    return json.dumps(value, ensure_ascii=False, default=str)


def _pyproject(text: str) -> list[tuple[str, str, str]]:
    try:
        data = tomllib.loads(text)
    except tomllib.TOMLDecodeError:
        return [("production", "", text)]
    project, poetry = data.get("project", {}), data.get("tool", {}).get("poetry", {})
    dev = [f"{name} = {_toml(of[name])}\n" for name, of in (("dev-dependencies", poetry), ("optional-dependencies", project)) if name in of]
    parts = (("production", "", f"dependencies = {_toml(project['dependencies'])}\n" if "dependencies" in project else ""), ("dev", " (dev)", "\n".join(dev)))
    return [p for p in parts if p[2].strip()]


_SPLITTERS = {"package.json": _package_json, "pyproject.toml": _pyproject}


def _split_with(name: str):
    cut = _SPLITTERS[name]

    def parts(text: str) -> list[tuple[str, str, str]]:
        try:
            return cut(text)
        except Exception:  # of any shape: one file must not fail the job
            return [("production", "", text)]

    @F.pandas_udf("array<struct<dep_type:string,mark:string,content:string>>")
    def split(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [] if t is None else [dict(zip(("dep_type", "mark", "content"), p)) for p in parts(t)])

    return split


def package_json_sections(content: Column) -> Column:
    """(dep_type, mark, content) of each part of a package.json; a file that is unreadable or of another shape is production as a whole."""
    return _split_with("package.json")(content)


# White space but for the line end, in any script.
_BLANK = r"[\t\x0B\f\r \x1C-\x1F\x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000]"
_INK = _BLANK.replace("[", "[^", 1).replace("]", "\\n]")
_GROUP = rf"^{_BLANK}*group (?={_BLANK}*{_INK})"
_END = rf"^{_BLANK}*end"


def gemfile_groups(content: Column) -> Column:
    """(dep_type, mark, content) of each part of a Gemfile: groups for development or test, and all else.

    The file is cut before each line that opens or ends a group; a cut's own first line and that of the cut before say
    whose its lines are.
    """
    cuts = F.split(content, rf"\n(?={_BLANK}*(?:group {_BLANK}*{_INK}|end))")
    opens = lambda cut: cut.rlike(_GROUP) & F.substring_index(cut, "\n", 1).rlike(":development|:test")

    def owned(cut: Column, before: Column) -> Column:
        # The line that opens a group goes, and so does an end, unless no development group is open.
        head = cut.rlike(_GROUP) | (cut.rlike(_END) & F.coalesce(opens(before), F.lit(False)))
        body = F.when(~head, cut).when(cut.contains("\n"), F.substring(cut, F.locate("\n", cut) + 1, F.length(cut)))
        return F.struct(opens(cut).alias("dev"), body.alias("body"))

    def parts(lines: Column) -> Column:
        of = lambda kind, mark, own: F.struct(F.lit(kind).alias("dep_type"), F.lit(mark).alias("mark"), F.array_join(F.transform(F.filter(lines, own), lambda x: x["body"]), "\n").alias("content"))
        both = F.array(of("production", "", lambda x: ~x["dev"]), of("dev", " (dev/test)", lambda x: x["dev"]))
        return F.filter(both, lambda p: p["content"].rlike(_INK))

    once = F.element_at(F.transform(F.array(cuts), lambda c: F.transform(c, lambda cut, i: owned(cut, F.get(c, i - 1)))), 1)
    found = F.element_at(F.transform(F.array(once), parts), 1)
    return F.when(content.isNotNull(), found).otherwise(F.filter(found, lambda p: F.lit(False)))


def pyproject_sections(content: Column) -> Column:
    return _split_with("pyproject.toml")(content)


def split_manifests(manifests: DataFrame) -> DataFrame:
    """Each manifest's parts as rows. Only JSON and TOML files go through Python."""
    cut_by = {"package.json": package_json_sections, "Gemfile": gemfile_groups, "pyproject.toml": pyproject_sections}
    base = F.element_at(F.split("full_path", "/"), -1)
    marked = manifests.withColumn("_base", base)
    whole = marked.filter(~((F.col("dep_type") == "production") & F.col("_base").isin(*cut_by)))
    out = whole.select(*FILE)
    for name, cut in cut_by.items():
        some = marked.filter((F.col("dep_type") == "production") & (F.col("_base") == name))
        rows = some.withColumn("_parts", cut(F.col("content"))).withColumn("_p", F.explode("_parts"))
        out = out.unionByName(rows.select("repo_name", "language", F.col("_p.dep_type").alias("dep_type"), "pattern_ordinal", F.concat("full_path", "_p.mark").alias("full_path"), F.col("_p.content").alias("content")))
    return out


# ---- formatting --------------------------------------------------------------

_OPEN, _HEAD = "## Dependencies\n", {"production": "#### Production Dependencies\n", "dev": "#### Developer-Only Dependencies\n"}


def _block(path: Column, content: Column) -> Column:
    return F.concat(F.lit("**File:** `"), path, F.lit("`\n\n```\n"), content, F.lit("\n```\n"))


def dependency_pieces(files: DataFrame, by: list[str]) -> DataFrame:
    """by, language, kind, full_path, text, gap: the text of ``format_dependencies`` in rows, a heading or file each; null sorts first."""
    shown = files.withColumn("text", _block(F.col("full_path"), F.col("content"))).filter("text IS NOT NULL").withColumn("kind", F.when(F.col("dep_type") == "production", 0).otherwise(1))
    none, no_gap = F.lit(None).cast("string"), F.lit("").alias("gap")
    head = F.when(F.col("kind") == 0, _HEAD["production"] + "\n").otherwise(_HEAD["dev"] + "\n")
    kinds = shown.select(*by, "language", "kind").distinct()
    langs = kinds.select(*by, "language").distinct()
    rows = shown.select(*by, "language", "kind", "full_path", "text", F.lit("\n").alias("gap"))
    rows = rows.unionByName(kinds.select(*by, "language", "kind", none.alias("full_path"), head.alias("text"), no_gap))
    rows = rows.unionByName(langs.select(*by, "language", F.lit(None).cast("int").alias("kind"), none.alias("full_path"), F.concat(F.lit("### "), "language", F.lit("\n\n")).alias("text"), no_gap))
    return rows.unionByName(langs.select(*by).distinct().select(*by, none.alias("language"), F.lit(None).cast("int").alias("kind"), none.alias("full_path"), F.lit(_OPEN + "\n").alias("text"), no_gap))


def format_dependencies(files: DataFrame, by: list[str]) -> DataFrame:
    """by + formatted: languages sorted, production before development, files by path, contents fenced.

    One text a group: for groups that a token budget bounds, such as batches. ``dependency_pieces`` has whole repositories in rows.
    """
    shown = files.withColumn("_block", _block(F.col("full_path"), F.col("content"))).filter("_block IS NOT NULL")
    kind = F.when(F.col("dep_type") == "production", 0).otherwise(1).alias("kind")
    # Texts move once: headings stand before the first file of a language or kind, as the one before it tells.
    rows = shown.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("language", kind, "full_path", F.col("_block").alias("block")))).alias("_files"))

    def piece(x: Column, i: Column) -> Column:
        before = F.get(F.col("_files"), i - 1)
        new_language = (i == 0) | ~before["language"].eqNullSafe(x["language"])
        head = F.when(x["kind"] == 0, _HEAD["production"] + "\n").otherwise(_HEAD["dev"] + "\n")
        return F.concat(F.when(new_language, F.concat(F.lit("### "), x["language"], F.lit("\n\n"))).otherwise(""), F.when(new_language | (before["kind"] != x["kind"]), head).otherwise(""), x["block"])

    return rows.select(*by, F.concat(F.lit(_OPEN + "\n"), F.array_join(F.transform("_files", piece), "\n")).alias("formatted"))


def with_dependency_text(repos: DataFrame, formatted: DataFrame) -> DataFrame:
    """Every repository with its dependency text; a fixed sentence where there is none."""
    return repos.join(formatted, "repo_name", "left").withColumn("formatted", F.coalesce("formatted", F.lit(NO_DEPENDENCIES)))


# ---- packing -----------------------------------------------------------------


def _tokens(chars: Column) -> Column:
    return F.floor(chars / F.lit(CHARS_PER_TOKEN)).cast("long")


def pack_batches(files: DataFrame, budget: int = BATCH_TOKENS, fan_in: int = 64) -> DataFrame:
    """repo_name, language, dep_type, pattern_ordinal, full_path, sub_batch, batch_tokens for every file.

    A language that fits the budget is one batch, estimated by its formatted text. Else its
    files are walked in order and a batch ends before the file that would exceed the budget; a
    file above it stands alone; a file without content counts nothing. Texts are read once, to be
    counted; from there on only counts move. The walk has a reset, which no window frame expresses:
    files are sorted into parts, and where a language spans several, each part says what leaves it
    for any count of tokens that enters. Such answers are joined ``fan_in`` parts at a time, so
    that a task holds at most ``fan_in`` times the files that fit in one budget.
    """
    spark = files.sparkSession
    kind = F.when(F.col("dep_type") == "production", 0).otherwise(1)
    chars = F.length(F.concat(F.lit("**File:** `"), "full_path", F.lit("`\n```\n"), "content", F.lit("\n```\n")))
    shown = F.length(_block(F.col("full_path"), F.col("content"))) + 1
    keep = ["repo_name", "language", "dep_type", "pattern_ordinal", "full_path"]
    path = shared_path(spark, "file-sizes")
    files.select(*keep, kind.alias("kind"), F.coalesce(_tokens(chars), F.lit(0)).alias("tokens"), shown.alias("shown")).write.parquet(path)
    slim = spark.read.parquet(path)
    heads = F.max(F.when(F.col("kind") == 0, len(_HEAD["production"]) + 1).otherwise(0)) + F.max(F.when(F.col("kind") == 1, len(_HEAD["dev"]) + 1).otherwise(0))
    total = slim.groupBy("repo_name", "language").agg(_tokens(F.sum("shown") + heads + F.lit(len(_OPEN) + 1 + 6) + F.length(F.col("language")) - 1).alias("language_tokens"))
    sized = slim.join(total, ["repo_name", "language"])
    fits = F.col("language_tokens") <= budget
    small = sized.filter(fits).select(*keep, F.lit(0).alias("sub_batch"), F.col("language_tokens").alias("batch_tokens"))

    place, one = ["repo_name", "language", "kind", "pattern_ordinal", "full_path"], ["repo_name", "language", "part"]
    path = shared_path(spark, "sorted-files")
    sized.filter(~fits).select(*keep, "kind", "tokens").repartitionByRange(*place).withColumn("part", F.spark_partition_id()).write.parquet(path)
    parts = spark.read.parquet(path)
    # Fewer languages than parts go on from one part to the next.
    several = parts.groupBy("repo_name", "language").agg(F.min("part").alias("a"), F.max("part").alias("b")).filter("a < b").select("repo_name", "language")
    entering = _entering(parts, several, budget, fan_in)
    numbered = parts.join(F.broadcast(entering), one, "left").groupBy(*one).applyInPandas(_walk(budget, place, [*keep, "tokens", "sub_batch"]), StructType([*(parts.schema[c] for c in [*keep, "tokens"]), *StructType.fromDDL("sub_batch int").fields]))
    batch = Window.partitionBy("repo_name", "language", "sub_batch")
    return small.unionByName(numbered.withColumn("batch_tokens", F.sum("tokens").over(batch)).drop("tokens"))


def _entering(parts: DataFrame, several: DataFrame, budget: int, fan_in: int) -> DataFrame:
    """repo_name, language, part, held, batch: the tokens that the open batch holds where a part begins, and its number.

    Up: what leaves a part becomes what leaves ``fan_in`` parts in a row, until ``fan_in`` rows of parts are left.
    Down: what enters a row of parts becomes what enters each of them. The first file of all finds a full batch -1.
    """
    spark = parts.sparkSession
    key, up = [parts.schema[c] for c in ("repo_name", "language")], F.floor(F.col("node") / fan_in).alias("up")
    table = StructType([*key, *StructType.fromDDL("node long, until long, held long, batches long, last boolean").fields])
    state = StructType([*key, *StructType.fromDDL("node long, held_before long, batch_before int").fields])
    slices = int(spark.conf.get("spark.sql.shuffle.partitions"))
    levels = [parts.join(F.broadcast(several), ["repo_name", "language"]).groupBy("repo_name", "language", "part").applyInPandas(_leaving(budget), table)]
    while slices > fan_in:
        path = shared_path(spark, "leaving")
        levels[-1].write.parquet(path)
        levels[-1] = spark.read.parquet(path)
        levels.append(levels[-1].groupBy("repo_name", "language", up).applyInPandas(_in_a_row(budget, fan_in), table))
        slices = -(-slices // fan_in)
    states = several.select("repo_name", "language", F.lit(0).cast("long").alias("up"), F.lit(budget + 1).cast("long").alias("held_before"), F.lit(-1).alias("batch_before"))
    for level in reversed(levels):
        # One state a row of parts: fewer than there are parts.
        asked = level.withColumn("up", F.floor(F.col("node") / fan_in)).join(F.broadcast(states), ["repo_name", "language", "up"])
        states = asked.groupBy("repo_name", "language", "up").applyInPandas(_before_each(budget), state).withColumnRenamed("node", "up")
    return states.select("repo_name", "language", F.col("up").cast("int").alias("part"), "held_before", "batch_before")


def _starts(tokens, budget: int):
    """Sums before each file, and for each file where the batch after the one that it starts would start."""
    sums = np.concatenate([[0], np.cumsum(np.asarray(tokens, dtype=np.int64))])
    after = np.maximum(np.searchsorted(sums[1:], budget + sums[:-1], side="right"), np.arange(1, len(sums)))
    return sums, after


class _Leaving(NamedTuple):
    """What leaves some files: the first ``until`` that does not fit beside the tokens that enter gives the tokens held and batches started; if all fit, ``total`` is added and no batch starts."""

    until: np.ndarray
    held: np.ndarray
    batches: np.ndarray
    total: int

    def through(self, held, budget: int):
        at = np.searchsorted(self.until, budget - held, side="right")
        found, at = at < len(self.until), np.minimum(at, len(self.until) - 1)
        return np.where(found, self.held[at], held + self.total), np.where(found, self.batches[at], 0)

    def frame(self, group: pd.DataFrame, node: int) -> pd.DataFrame:
        """As rows, the last for the total; neighbours with one outcome are one row."""
        until, held, batches = self.until, self.held, self.batches
        rises = np.concatenate([[True], until[1:] > until[:-1]])
        until, held, batches = until[rises], held[rises], batches[rises]
        ends = np.concatenate([(held[1:] != held[:-1]) | (batches[1:] != batches[:-1]), [True]])
        n = int(ends.sum())
        rows = {"until": [*until[ends], 0], "held": [*held[ends], self.total], "batches": [*batches[ends], 0], "last": [False] * n + [True]}
        return pd.DataFrame({"repo_name": group["repo_name"].iloc[0], "language": group["language"].iloc[0], "node": node, **rows})


def _nodes(group: pd.DataFrame):
    """(node, what leaves it) in order."""
    for node, rows in group.sort_values(["node", "last", "until"]).groupby("node", sort=True):
        inner = rows[~rows["last"]]
        yield node, _Leaving(*(inner[c].to_numpy(np.int64) for c in ("until", "held", "batches")), int(rows["held"].iloc[-1]))


def _leaving(budget: int):
    """What leaves a part: a row for each of its files that can be the first to start a batch there."""

    def leaving(group: pd.DataFrame) -> pd.DataFrame:
        part = int(group["part"].iloc[0])
        group = group.sort_values(["kind", "pattern_ordinal", "full_path"], kind="stable")
        sums, after = _starts(group["tokens"], budget)
        n = len(after)
        held, batches = np.zeros(n, dtype=np.int64), np.ones(n, dtype=np.int64)
        for i in range(n - 1, -1, -1):
            if after[i] < n:
                held[i], batches[i] = held[after[i]], batches[after[i]] + 1
            else:
                held[i] = sums[n] - sums[i]
        m = min(int(np.searchsorted(sums[1:], budget, side="right")) + 1, n)
        return _Leaving(sums[1 : m + 1], held[:m], batches[:m], int(sums[n])).frame(group, part)

    return leaving


def _in_a_row(budget: int, fan_in: int):
    """What leaves the nodes of a group, one after the other, as one node."""

    def in_a_row(group: pd.DataFrame) -> pd.DataFrame:
        found, node = None, 0
        for node, then in _nodes(group):
            if found is None:
                found = then
                continue
            held, more = then.through(found.held, budget)
            # Files beyond the first that exceeds the budget are never the first to start a batch.
            m = int(np.searchsorted(then.until, budget - found.total, side="right")) + 1 if found.total <= budget else 0
            found = _Leaving(
                np.concatenate([found.until, found.total + then.until[:m]]), np.concatenate([held, then.held[:m]]),
                np.concatenate([found.batches + more, then.batches[:m]]), found.total + then.total,
            )
        return found.frame(group, int(node) // fan_in)

    return in_a_row


def _before_each(budget: int):
    """What enters each node of a group, from what enters the first."""

    def before_each(group: pd.DataFrame) -> pd.DataFrame:
        held, batch, out = int(group["held_before"].iloc[0]), int(group["batch_before"].iloc[0]), []
        for node, then in _nodes(group):
            out.append((group["repo_name"].iloc[0], group["language"].iloc[0], int(node), held, batch))
            held, more = (int(v) for v in then.through(held, budget))
            batch += more
        return pd.DataFrame(out, columns=["repo_name", "language", "node", "held_before", "batch_before"])

    return before_each


def _walk(budget: int, place: list[str], columns: list[str]):
    def walk(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(place[2:], kind="stable")
        sums, after = _starts(group["tokens"], budget)
        n, r = len(after), group.iloc[0]
        held, batch = (budget + 1, -1) if pd.isna(r["batch_before"]) else (int(r["held_before"]), int(r["batch_before"]))
        at = int(np.searchsorted(sums[1:], budget - held, side="right"))
        of = np.full(n, batch, dtype=np.int32)
        while at < n:
            batch, end = batch + 1, int(after[at])
            of[at:end], at = batch, end
        group["sub_batch"] = of
        return group[columns]

    return walk


def number_batches(packed: DataFrame) -> DataFrame:
    """repo_name, language, sub_batch, files, estimated_tokens, batch_index (from 0, languages sorted), total_batches."""
    batches = packed.groupBy("repo_name", "language", "sub_batch").agg(F.count(F.lit(1)).alias("files"), F.max("batch_tokens").alias("estimated_tokens"))
    repo = Window.partitionBy("repo_name")
    return batches.withColumn("batch_index", F.row_number().over(repo.orderBy("language", "sub_batch")) - 1).withColumn("total_batches", F.count(F.lit(1)).over(repo))


# ---- summaries ---------------------------------------------------------------


def manifest_counts(files: DataFrame) -> DataFrame:
    """repo_name, files, languages, message."""
    n = files.groupBy("repo_name").agg(F.count(F.lit(1)).alias("files"), F.count_distinct("language").alias("languages"))
    return n.withColumn("message", F.format_string("Found %d dependency files across %d languages", "files", "languages"))


def normal_name(name: Column) -> Column:
    """Names compare without case and separators."""
    return F.regexp_replace(F.lower(name), r"[-_. ]", "")


def dependency_catalog(dependencies: DataFrame) -> DataFrame:
    """repo_name, dependency, paths, is_production from (repo_name, name, full_path, dep_type): one row a dependency."""
    keyed = dependencies.withColumn("dependency", normal_name(F.col("name")))
    return keyed.groupBy("repo_name", "dependency").agg(F.sort_array(F.collect_set("full_path")).alias("paths"), F.bool_or(F.col("dep_type") == "production").alias("is_production"))


def detect_technologies(dependencies: DataFrame, catalogue: DataFrame) -> DataFrame:
    """repo_name, technology, uses: dependency names found in a catalogue (name, technology)."""
    known = catalogue.select(normal_name(F.col("name")).alias("dependency"), "technology").distinct()
    named = dependencies.withColumn("dependency", normal_name(F.col("name"))).groupBy("repo_name", "dependency").agg(F.count(F.lit(1)).alias("uses"))
    return named.join(known, "dependency").groupBy("repo_name", "technology").agg(F.sum("uses").alias("uses"))


WEIGHTS = {"files": 0.5, "directories": 0.3, "dependencies": 0.15, "keywords": 0.05}
PRIORITY = ("infra-as-code", "libraries", "frontend", "backend", "generic")
LEAST_SCORE = 0.15


def score_repo_types(signals: DataFrame, selectors: DataFrame) -> DataFrame:
    """repo_name, repo_type, score. signals: (repo_name, dimension, value); selectors: (repo_type, dimension, pattern).

    A dimension scores the share of its patterns that match; dimensions are weighted; the best
    type of at least ``LEAST_SCORE`` wins, ties by priority, else generic.
    """
    size = selectors.groupBy("repo_type", "dimension").agg(F.count(F.lit(1)).alias("patterns"))
    values = signals.select("repo_name", "dimension", F.col("value").alias("pattern")).distinct()
    hits = values.join(selectors, ["dimension", "pattern"]).groupBy("repo_name", "repo_type", "dimension").agg(F.count_distinct("pattern").alias("hits"))
    weight = F.lit(0.0)
    for name, w in WEIGHTS.items():
        weight = F.when(F.col("dimension") == name, w).otherwise(weight)
    scores = hits.join(size, ["repo_type", "dimension"]).groupBy("repo_name", "repo_type").agg(F.round(F.sum(weight * F.col("hits") / F.col("patterns")), 9).alias("score"))
    rank = F.array_position(F.array(*map(F.lit, PRIORITY)), F.col("repo_type"))
    best = scores.filter(F.col("score") >= LEAST_SCORE).groupBy("repo_name").agg(F.max_by(F.struct("repo_type", "score"), F.struct("score", -rank)).alias("b"))
    return signals.select("repo_name").distinct().join(best, "repo_name", "left").select("repo_name", F.coalesce("b.repo_type", F.lit("generic")).alias("repo_type"), F.coalesce("b.score", F.lit(0.0)).alias("score"))
