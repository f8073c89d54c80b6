"""Dependencies as rows, read out of manifest texts.

One expression a format: requirement lines, go.mod and Gradle by regular expressions, JSON as VARIANT, XML by ``from_xml``, so most
files never leave the JVM. Only TOML (pyproject.toml, Cargo.toml, Pipfile) is read by Python, in Arrow batches. A reader gives an
array of (dep_type, name, constraint) a file, or null for a file that it cannot read, which becomes one row with an error.
"""

from __future__ import annotations

import tomllib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ENTRIES = "array<struct<dep_type:string,name:string,constraint:string>>"
#: Places of dependencies in JSON manifests: (file name, field, dep_type).
JSON_FIELDS = (
    ("package.json", "dependencies", "production"), ("package.json", "peerDependencies", "production"), ("package.json", "optionalDependencies", "production"), ("package.json", "devDependencies", "dev"),
    ("composer.json", "require", "production"), ("composer.json", "require-dev", "dev"),
)
_MAVEN = "dependency: array<struct<groupId: string, artifactId: string, version: string, scope: string>>"
POM = f"properties map<string, string>, dependencies struct<{_MAVEN}>, dependencyManagement struct<dependencies: struct<{_MAVEN}>>, _corrupt_record string"
PROJECT = "ItemGroup array<struct<PackageReference: array<struct<_Include: string, _Version: string, Version: string, _PrivateAssets: string, PrivateAssets: string>>>>, _corrupt_record string"
PACKAGES = "package array<struct<_id: string, _version: string, _developmentDependency: string>>, _corrupt_record string"
GRADLE = r"""(?m)^\s*(\w*(?:[iI]mplementation|[aA]pi|[cC]ompileOnly|[rR]untimeOnly|developmentOnly|annotationProcessor))[ (]+["']([^:"'\s]+:[^:"'\s]+)(?::([^"'@\s]+))?"""


def _entry(dep_type, name: Column, constraint: Column) -> Column:
    kind = F.lit(dep_type) if isinstance(dep_type, str) else dep_type
    return F.struct(kind.alias("dep_type"), F.trim(name).alias("name"), F.nullif(F.trim(constraint), F.lit("")).alias("constraint"))


def _once(value: Column, of: Callable[[Column], Column]) -> Column:
    """``of`` a value that is worked out once a row: inside lambdas a column would be worked out anew for each element."""
    return F.get(F.transform(F.array(value), of), F.lit(0))


def _distinct(entries: Column) -> Column:
    """Entries once each, sorted: in structs, ``array_distinct`` compares all pairs."""
    return _once(F.sort_array(entries), lambda s: F.filter(s, lambda e, i: (i == 0) | ~e.eqNullSafe(F.get(s, i - 1))))


def _none() -> Column:
    return F.array().cast(ENTRIES)


def requirement(line: Column, dep_type) -> Column:
    """The entry of one requirement, such as ``name[extra]>=1,<2; marker`` or ``name @ url``."""
    name = F.regexp_extract(line, r"^\s*([A-Za-z0-9][A-Za-z0-9._-]*)", 1)
    rest = F.regexp_extract(line, r"^\s*[A-Za-z0-9][A-Za-z0-9._-]*\s*(?:\[[^\]]*\])?\s*\(?([^;)]*)", 1)
    return _entry(dep_type, name, F.regexp_replace(rest, r"\s+", ""))


def requirement_lines(content: Column, dep_type: Column) -> Column:
    """Lines of a requirements file, without comments, options and paths; a line may go on after a backslash."""
    lines = F.split(F.regexp_replace(content, r"\\\r?\n", " "), r"\r?\n")
    bare = F.transform(lines, lambda x: F.regexp_replace(F.regexp_replace(F.regexp_replace(x, r"(^|\s)#.*$", ""), r"\s--\S+.*$", ""), r"^\s+|\s+$", ""))
    return F.transform(F.filter(bare, lambda x: x.rlike(r"^[A-Za-z0-9][A-Za-z0-9._-]*\s*($|[\[(<>=!~;@,])")), lambda x: requirement(x, dep_type))


def go_requirements(content: Column) -> Column:
    """``require`` lines and blocks of a go.mod."""
    bare = F.regexp_replace(content, r"//[^\n]*", "")
    blocks = F.array_join(F.regexp_extract_all(bare, F.lit(r"(?m)^\s*require\s*\(([^)]*)\)"), F.lit(1)), "\n")
    lines = F.concat(F.split(blocks, "\n"), F.regexp_extract_all(bare, F.lit(r"(?m)^\s*require\s+([^\s(]+[ \t]+\S+)"), F.lit(1)))
    shape = r"^\s*(\S+)\s+(v\S+)\s*$"
    return F.transform(F.filter(lines, lambda x: x.rlike(shape)), lambda x: _entry("production", F.regexp_extract(x, shape, 1), F.regexp_extract(x, shape, 2)))


def gem_lines(content: Column) -> Column:
    """``gem`` lines of a Gemfile; those in a group for development or test are for development."""
    from shelfmark.operators.manifests import gemfile_groups

    def of(part: Column) -> Column:
        gems = F.regexp_extract_all(part["content"], F.lit(r"""(?m)^\s*gem\s+["'][^"']+["'](?:\s*,\s*["'][^"']+["'])*"""), F.lit(0))
        rest = lambda g: F.regexp_replace(F.regexp_replace(g, r"""^\s*gem\s+["'][^"']+["']\s*,?\s*""", ""), r"""["'\s]""", "")
        return F.transform(gems, lambda g: _entry(part["dep_type"], F.regexp_extract(g, r"""["']([^"']+)["']""", 1), rest(g)))

    return F.flatten(F.transform(gemfile_groups(content), of))


def gradle_lines(content: Column) -> Column:
    """``configuration "group:name:version"`` lines; test and development configurations are for development."""
    found = F.regexp_extract_all(content, F.lit(GRADLE), F.lit(0))
    kind = lambda x: F.when(F.lower(F.regexp_extract(x, GRADLE, 1)).rlike("test|development"), "dev").otherwise("production")
    return F.transform(found, lambda x: _entry(kind(x), F.regexp_extract(x, GRADLE, 2), F.regexp_extract(x, GRADLE, 3)))


def json_fields(content: Column, file_name: str) -> Column:
    """Maps of name to constraint in a JSON object; a value that is no text has no constraint. Platform names (php, ext-*) go."""
    text = lambda x: F.when(F.schema_of_variant(x) == "STRING", F.try_variant_get(x, "$", "string"))

    def of(value: Column, field: str, kind: str) -> Column:
        entries = F.map_entries(F.try_variant_get(value, f"$['{field}']", "map<string,variant>"))
        return F.coalesce(F.transform(entries, lambda e: _entry(kind, e["key"], text(e["value"]))), _none())

    def fields(value: Column) -> Column:
        found = F.concat(*(of(value, field, kind) for name, field, kind in JSON_FIELDS if name == file_name))
        if file_name == "composer.json":
            found = F.filter(found, lambda e: ~e["name"].rlike("^(php|hhvm|(ext|lib|php)-.*|composer(-.*)?)$"))
        return F.when(F.schema_of_variant(value).startswith("OBJECT"), found)

    return _once(F.try_parse_json(content), fields)


def _xml(content: Column, schema: str) -> Column:
    return F.from_xml(content, schema, {"ignoreNamespace": "true", "mode": "PERMISSIVE"})


def maven_dependencies(content: Column) -> Column:
    """Dependencies of a pom.xml: versions by property, or else by the managed dependencies; scope ``test`` is for development."""
    key = lambda d: F.concat_ws(":", F.trim(d["groupId"]), F.trim(d["artifactId"]))
    kind = lambda d: F.when(F.trim(d["scope"]) == "test", "dev").otherwise("production")

    def version(d: Column, properties: Column, managed: Column) -> Column:
        inherited = F.element_at(F.transform(F.filter(managed, lambda m: key(m) == key(d)), lambda m: m["version"]), 1)
        given = F.trim(F.coalesce(d["version"], F.when(F.exists(managed, lambda m: key(m) == key(d)), inherited)))
        named = F.regexp_extract(given, r"^\$\{([^}]+)\}$", 1)
        return F.when(named != "", F.coalesce(F.try_element_at(properties, named), given)).otherwise(given)

    def entries(pom: Column) -> Column:
        managed = F.coalesce(pom["dependencyManagement"]["dependencies"]["dependency"], F.array().cast("array<struct<groupId:string,artifactId:string,version:string,scope:string>>"))
        found = _once(managed, lambda m: F.transform(pom["dependencies"]["dependency"], lambda d: _entry(kind(d), key(d), version(d, pom["properties"], m))))
        return F.when(pom["_corrupt_record"].isNull(), F.coalesce(found, _none()))

    return _once(_xml(content, POM), entries)


def package_references(content: Column) -> Column:
    """PackageReference items of a .NET project; private assets are for development."""
    kind = lambda r: F.when(F.coalesce(r["_PrivateAssets"], r["PrivateAssets"]) == "all", "dev").otherwise("production")

    def entries(project: Column) -> Column:
        items = F.flatten(F.filter(F.transform(project["ItemGroup"], lambda g: g["PackageReference"]), lambda r: r.isNotNull()))
        found = F.transform(F.filter(items, lambda r: r["_Include"].isNotNull()), lambda r: _entry(kind(r), r["_Include"], F.coalesce(r["_Version"], r["Version"])))
        return F.when(project["_corrupt_record"].isNull(), F.coalesce(found, _none()))

    return _once(_xml(content, PROJECT), entries)


def packages_config(content: Column) -> Column:
    kind = lambda p: F.when(p["_developmentDependency"] == "true", "dev").otherwise("production")

    def entries(packages: Column) -> Column:
        found = F.transform(packages["package"], lambda p: _entry(kind(p), p["_id"], p["_version"]))
        return F.when(packages["_corrupt_record"].isNull(), F.coalesce(found, _none()))

    return _once(_xml(content, PACKAGES), entries)


# ---- TOML --------------------------------------------------------------------


def _constraint(value) -> str | None:
    if isinstance(value, dict):
        value = value.get("version")
    return value if isinstance(value, str) else None


def _tables(data: dict, *places: tuple[str, str]) -> Iterator[tuple[str, str, str | None]]:
    for place, kind in places:
        table = data.get(place)
        for name, value in table.items() if isinstance(table, dict) else ():
            yield kind, name, _constraint(value)


def _pyproject(data: dict) -> Iterator[tuple[str, str, str | None]]:
    """(kind, requirement, None) for requirement texts, which SQL parts, and (kind, name, constraint) for tables."""
    project, poetry = data.get("project", {}), data.get("tool", {}).get("poetry", {})
    yield from (("production:text", text, None) for text in project.get("dependencies", ()))
    for groups in (project.get("optional-dependencies", {}), data.get("dependency-groups", {})):
        yield from (("dev:text", text, None) for group in groups.values() for text in group if isinstance(text, str))
    yield from ((kind, name, c) for kind, name, c in _tables(poetry, ("dependencies", "production"), ("dev-dependencies", "dev")) if name != "python")
    for group in poetry.get("group", {}).values():
        yield from _tables(group, ("dependencies", "dev"))


_CARGO = (("dependencies", "production"), ("build-dependencies", "production"), ("dev-dependencies", "dev"))


def _cargo(data: dict) -> Iterator[tuple[str, str, str | None]]:
    yield from _tables(data, *_CARGO)
    yield from _tables(data.get("workspace", {}), ("dependencies", "production"))
    for target in data.get("target", {}).values():
        yield from _tables(target, *_CARGO)


def _pipfile(data: dict) -> Iterator[tuple[str, str, str | None]]:
    yield from _tables(data, ("packages", "production"), ("dev-packages", "dev"))


TOML_FILES: dict[str, Callable] = {"pyproject.toml": _pyproject, "Cargo.toml": _cargo, "Pipfile": _pipfile}


def _toml_entries(names: Column, texts: Column) -> Column:
    def read(name, text):
        try:
            return [dict(zip(("dep_type", "name", "constraint"), e)) for e in TOML_FILES[name](tomllib.loads(text))]
        except Exception:  # broken, or of another shape: one file must not fail the job
            return None

    @F.pandas_udf(ENTRIES)
    def entries(names: pd.Series, texts: pd.Series) -> pd.Series:
        return pd.Series([read(n, t) for n, t in zip(names, texts)], dtype=object)

    return entries(names, texts)


def toml_dependencies(file_name: Column, content: Column) -> Column:
    """Entries of the formats in TOML_FILES."""
    text = lambda e: F.endswith(e["dep_type"], F.lit(":text"))
    kind = lambda e: F.substring_index(e["dep_type"], ":", 1)
    return F.transform(_toml_entries(file_name, content), lambda e: F.when(text(e), requirement(e["name"], kind(e))).otherwise(_entry(e["dep_type"], e["name"], e["constraint"])))


# ---- all formats -------------------------------------------------------------


def _read_in_sql(base: Column) -> list[tuple[Column, Column]]:
    """(which files, their entries) of the formats that SQL functions read."""
    content, dep_type = F.col("content"), F.col("dep_type")
    return [
        (base.rlike(r"^([\w.-]*requirements[\w.-]*)\.txt$"), requirement_lines(content, dep_type)), (base == "go.mod", go_requirements(content)), (base == "Gemfile", gem_lines(content)),
        (base.rlike(r"^build\.gradle(\.kts)?$"), gradle_lines(content)), (base == "package.json", json_fields(content, "package.json")), (base == "composer.json", json_fields(content, "composer.json")),
        (base == "pom.xml", maven_dependencies(content)), (base.rlike(r"\.(cs|fs|vb)proj$"), package_references(content)), (base == "packages.config", packages_config(content)),
    ]


def constraint_parts(constraint: Column) -> tuple[Column, Column]:
    """(operator, version) of a constraint's first part: ``^1.2`` is ("^", "1.2"), a bare version has the empty operator."""
    shape = r"^\s*(===|[=~^<>!]=?>?)?\s*v?([0-9][^\s,|;]*)?"
    return F.when(constraint.isNotNull(), F.regexp_extract(constraint, shape, 1)), F.nullif(F.regexp_extract(constraint, shape, 2), F.lit(""))


def dependency_rows(manifests: DataFrame) -> DataFrame:
    """repo_name, full_path, dep_type, name, constraint, operator, version, error of manifests (repo_name, full_path, dep_type, content).

    A row a dependency, repeats within a file once; a file that is broken, or has no text, is one row with ``error`` and without a
    name. Files of formats without a reader give no rows. Narrow: nothing is shuffled, a file's entries stay in its task.
    """
    named = manifests.select("repo_name", "full_path", "dep_type", "content", F.element_at(F.split("full_path", "/"), -1).alias("base"))
    base = F.col("base")
    formats = _read_in_sql(base)
    entries, known = F.lit(None).cast(ENTRIES), F.lit(False)
    for which, found in reversed(formats):
        entries, known = F.when(which, found).otherwise(entries), known | which
    in_toml = base.isin(*TOML_FILES)
    columns = ["repo_name", "full_path", "dep_type"]
    read = named.filter(known & ~in_toml).select(*columns, entries.alias("entries")).unionByName(named.filter(in_toml).select(*columns, toml_dependencies(base, F.col("content")).alias("entries")))
    # A row of an entry must not carry all entries of its file.
    marked = read.withColumn("broken", F.col("entries").isNull())
    rows = marked.select(*columns, "broken", F.explode_outer(_distinct(F.filter("entries", lambda e: e["name"] != ""))).alias("entry")).filter(F.col("entry").isNotNull() | F.col("broken"))
    operator, version = constraint_parts(F.col("entry.constraint"))
    error = F.when(F.col("broken"), F.concat(F.lit("cannot be read: "), F.element_at(F.split("full_path", "/"), -1)))
    return rows.select("repo_name", "full_path", F.coalesce("entry.dep_type", "dep_type").alias("dep_type"), "entry.name", "entry.constraint", operator.alias("operator"), version.alias("version"), error.alias("error"))


def read_dependencies(files: DataFrame) -> DataFrame:
    """``dependency_rows`` of the manifests among files (repo_name, path, content)."""
    from shelfmark.operators.manifests import match_manifests

    return dependency_rows(match_manifests(files, prune=True))
