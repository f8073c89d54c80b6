"""Registry, skip list and provider listings: JSON in, tables out, and back."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from shelfmark.sources.split_json import member_entries

REGISTRY = "repo_name string, url string, description string, type string"
_ENTRY = "url string, description string, type string"
# How the first line begins of a document that has an entry a line. JSON lets white space stand there.
_REGISTRY_HEAD, _SKIP_HEAD = "{ \t", "{\t "
LISTING = "provider string, repo_name string, url string, description string, language string, archived boolean, last_commit_at timestamp"


def _whole(spark: SparkSession, path: str, whole: bool = True) -> DataFrame | None:
    """The document at ``path`` as one row, or a row a line if not ``whole``; null where there is none."""
    try:
        return spark.read.text(path, wholetext=whole, lineSep=None if whole else "\n")
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def parse_registry(documents: DataFrame, text: str = "value") -> DataFrame:
    """repo_name, url, description, type for each entry of ``repositories`` that is an object; comments are strings and go."""
    entries = F.from_json(F.get_json_object(text, "$.repositories"), "map<string,string>")
    raw = documents.select(F.explode(entries).alias("repo_name", "raw")).filter(F.col("raw").startswith("{"))
    return raw.select("repo_name", F.from_json("raw", _ENTRY).alias("e")).select("repo_name", "e.*")


def _lines(spark: SparkSession, path: str, head: str, kind: str = "") -> DataFrame | None:
    """name, raw for each entry (that begins like ``kind``) of a document with an entry a line below ``head``, as ``write_entries`` writes it; null for any other."""
    try:
        lines = spark.read.text(path)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    if lines.filter(F.col("value").startswith(head)).isEmpty():
        return None
    entry = F.from_json(F.concat(F.lit("{"), F.regexp_replace("value", "^,", ""), F.lit("}")), "map<string,string>")
    return lines.filter(F.col("value").rlike(r'^,?"[^"\\]*+(?:\\.[^"\\]*+)*+":' + kind)).select(F.explode(entry).alias("name", "raw"))


def read_registry(spark: SparkSession, path: str) -> DataFrame:
    """A registry that ``write_registry`` wrote is read line by line; any other document is read in byte ranges, entry by entry.

    No document at ``path`` is an empty registry, and so is one that is cut off.
    """
    lines = _lines(spark, path, _REGISTRY_HEAD, r"\{")
    if lines is None:
        try:
            lines = member_entries(spark, path, "repositories").filter("is_object")
        except AnalysisException as missing:
            if missing.getCondition() != "PATH_NOT_FOUND":
                raise
            return spark.createDataFrame([], REGISTRY)
    return lines.select(F.col("name").alias("repo_name"), F.from_json("raw", _ENTRY).alias("e")).select("repo_name", "e.*")


def read_skip_list(spark: SparkSession, path: str) -> DataFrame:
    """repo_name, reason. A list that ``write_skip_list`` wrote is read line by line; any other document is read whole."""
    lines = _lines(spark, path, _SKIP_HEAD)
    if lines is not None:
        return lines.select(F.col("name").alias("repo_name"), F.col("raw").alias("reason"))
    found = _whole(spark, path)
    if found is None:
        return spark.createDataFrame([], "repo_name string, reason string")
    return found.select(F.explode(F.from_json("value", "map<string,string>")).alias("repo_name", "reason"))


def _first(*names: Column) -> Column:
    return F.coalesce(*(F.when(n != "", n) for n in names))


# Where each provider keeps name, URL and description.
_SHAPES = {
    "github": ("array<struct<name:string,html_url:string,description:string,language:string,archived:boolean,pushed_at:timestamp>>", None),
    "gitlab": ("array<struct<path_with_namespace:string,name:string,http_url_to_repo:string,description:string,archived:boolean,last_activity_at:timestamp>>", None),
    "bitbucket": ("struct<values:array<struct<full_name:string,name:string,description:string,language:string,updated_on:timestamp,links:struct<clone:array<struct<name:string,href:string>>>>>>", "values"),
    "azure_devops": ("struct<value:array<struct<name:string,remoteUrl:string,project:struct<description:string>>>>", "value"),
    "codecommit": ("array<struct<repositoryName:string,cloneUrlHttp:string,repositoryDescription:string,lastModifiedDate:timestamp>>", None),
}


def _listed(provider: str, r: Column) -> dict[str, Column]:
    none = F.lit(None)
    if provider == "github":
        return {"repo_name": r["name"], "url": r["html_url"], "description": r["description"], "language": r["language"], "archived": r["archived"], "last_commit_at": r["pushed_at"]}
    if provider == "gitlab":
        return {"repo_name": _first(r["path_with_namespace"], r["name"]), "url": r["http_url_to_repo"], "description": r["description"], "language": none, "archived": r["archived"], "last_commit_at": r["last_activity_at"]}
    if provider == "bitbucket":
        https = F.get(F.filter(r["links"]["clone"], lambda link: link["name"] == "https"), F.lit(0))["href"]
        return {"repo_name": _first(r["full_name"], r["name"]), "url": https, "description": r["description"], "language": r["language"], "archived": none, "last_commit_at": r["updated_on"]}
    if provider == "azure_devops":
        return {"repo_name": r["name"], "url": r["remoteUrl"], "description": r["project"]["description"], "language": none, "archived": none, "last_commit_at": none}
    return {"repo_name": r["repositoryName"], "url": r["cloneUrlHttp"], "description": r["repositoryDescription"], "language": none, "archived": none, "last_commit_at": r["lastModifiedDate"]}


def parse_listing(pages: DataFrame, provider: str, text: str = "value") -> DataFrame:
    """One schema for all providers, from landed API pages (a JSON document a row)."""
    kind, field = _SHAPES[provider]
    page = F.from_json(text, kind)
    rows = pages.select(F.explode(page[field] if field else page).alias("r"))
    c = _listed(provider, F.col("r"))
    return rows.select(
        F.lit(provider).alias("provider"), c["repo_name"].alias("repo_name"), c["url"].alias("url"), F.coalesce(c["description"], F.lit("")).alias("description"),
        c["language"].cast("string").alias("language"), F.coalesce(c["archived"].cast("boolean"), F.lit(False)).alias("archived"), c["last_commit_at"].cast("timestamp").alias("last_commit_at"),
    )


def read_listing(spark: SparkSession, paths: dict[str, str], lines: bool = False) -> DataFrame:
    """All providers' landed pages (provider -> folder of JSON documents) as one table.

    A file is a page, or with ``lines`` each of its lines is one, so that files need not grow in number with the pages.
    """
    out = spark.createDataFrame([], LISTING)
    for provider, path in paths.items():
        found = _whole(spark, path, whole=not lines)
        if found is not None:
            out = out.unionByName(parse_listing(found, provider))
    return out


def write_entries(entries: DataFrame, path: str, head: str, tail: str) -> None:
    """Writes (name, raw: JSON of the entry) as one JSON object, an entry a line, by name; its parts in the order of their names are the document.

    A name that is missing or stands twice is an error, as it is in a map.
    """
    names = entries.groupBy("name").agg(F.count(F.lit(1)).alias("n")).agg(F.min("name").alias("first"), F.max("n").alias("most"), F.count_if(F.col("name").isNull()).alias("nameless")).first()
    if names["nameless"] or (names["most"] or 0) > 1:
        raise ValueError("an entry's name is missing or stands twice")
    quoted = F.regexp_extract(F.to_json(F.array("name")), r"(?s)^\[(.*)\]$", 1)
    line = F.concat(F.when(F.col("name") == F.lit(names["first"]), "").otherwise(","), quoted, F.lit(":"), "raw")
    ends = entries.sparkSession.createDataFrame([(0, "", head), (2, "", tail)], "place int, name string, value string")
    rows = ends.unionByName(entries.select(F.lit(1).alias("place"), "name", line.alias("value")))
    rows.orderBy("place", "name").select("value").write.mode("overwrite").text(path)


def write_registry(registry: DataFrame, path: str, default: str | None, comment: str | None = None, notes: dict[str, str] | None = None) -> None:
    """Writes the registry's document, ``notes`` as comments among its entries; a registry without a default is an error."""
    if default is None:
        raise ValueError("the registry has no default")
    entry = F.struct(F.coalesce("url", F.lit("")).alias("url"), F.coalesce("description", F.lit("")).alias("description"), F.coalesce("type", F.lit("generic")).alias("type"))
    entries = registry.select(F.col("repo_name").alias("name"), F.to_json(entry).alias("raw"))
    if notes:
        entries = entries.unionByName(registry.sparkSession.createDataFrame([(k, json.dumps(v)) for k, v in notes.items()], "name string, raw string"))
    fields = {"default": default, **({"_comment": comment} if comment is not None else {})}
    write_entries(entries, path, _REGISTRY_HEAD + json.dumps(fields)[1:-1] + ', "repositories": {', "}}")


def read_document(spark: SparkSession, path: str) -> tuple[DataFrame, dict[str, str | None]]:
    """All of a registry: (name, raw JSON) of every entry, comments among them, and the fields beside the entries."""
    lines = _lines(spark, path, _REGISTRY_HEAD)
    if lines is not None:
        head = spark.read.text(path).filter(F.col("value").startswith(_REGISTRY_HEAD)).first()[0]
        # A comment's text loses its quotes when it is read as a string.
        raw = F.when(F.col("raw").startswith("{"), F.col("raw")).otherwise(F.regexp_extract(F.to_json(F.array("raw")), r"(?s)^\[(.*)\]$", 1))
        fields = json.loads(head + "}}")
        return lines.select("name", raw.alias("raw")), {k: v for k, v in fields.items() if k != "repositories"}
    found = _whole(spark, path)
    if found is None:
        return spark.createDataFrame([], "name string, raw string"), {}
    entries = found.select(F.explode(F.from_json(F.get_json_object("value", "$.repositories"), "map<string,string>")).alias("name", "raw"))
    raw = F.when(F.col("raw").startswith("{"), F.col("raw")).otherwise(F.regexp_extract(F.to_json(F.array("raw")), r"(?s)^\[(.*)\]$", 1))
    # The fields beside the entries are a handful.
    beside = found.select(F.explode(F.map_filter(F.from_json("value", "map<string,string>"), lambda k, _: k != "repositories")).alias("k", "v")).collect()
    return entries.select("name", raw.alias("raw")), {r["k"]: r["v"] for r in beside}


def update_registry(spark: SparkSession, source: str, target: str, fresh: DataFrame) -> None:
    """Writes the registry at ``source`` with the entries of ``fresh`` (repo_name, url, description, type) that it lacks to ``target``.

    Whatever it holds stays as it is: entries with unknown fields, comments, and the fields beside the entries. A
    registry without a default is an error.
    """
    entries, fields = read_document(spark, source)
    if fields.get("default") is None:
        raise ValueError("the registry has no default")
    new = fresh.join(entries.select(F.col("name").alias("repo_name")), "repo_name", "left_anti").select(F.col("repo_name").alias("name"), F.to_json(F.struct("url", "description", "type")).alias("raw"))
    write_entries(entries.unionByName(new), target, _REGISTRY_HEAD + json.dumps(fields)[1:-1] + ', "repositories": {', "}}")


def write_skip_list(skipped: DataFrame, path: str) -> None:
    """Writes (repo_name, reason) as one JSON object, an entry a line."""
    reason = F.coalesce(F.regexp_extract(F.to_json(F.array("reason")), r"(?s)^\[(.*)\]$", 1), F.lit("null"))
    write_entries(skipped.select(F.col("repo_name").alias("name"), reason.alias("raw")), path, _SKIP_HEAD, "}")
