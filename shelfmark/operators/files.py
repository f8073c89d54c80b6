"""File trees: pruning, listing and sizes. Rows are (repo_name, path, ...)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.functions.text import human_size

DEPTH = 3
# Directories that are not looked into.
PRUNED = (".git", "node_modules", "__pycache__", ".venv", "venv", ".env", "dist", "build", ".next", ".nuxt", "coverage", ".pytest_cache", ".mypy_cache", ".tox", "egg-info", ".eggs")
DIR_ICON, FILE_ICON = "\U0001f4c1", "\U0001f4c4"


def _parts(path: Column) -> Column:
    return F.filter(F.split(path, "/"), lambda p: p != "")


def prune_paths(files: DataFrame) -> DataFrame:
    """Without files below a pruned directory; a file may have such a name itself."""
    parts = _parts(F.col("path"))
    return files.filter(~F.exists(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), lambda d: d.isin(*PRUNED) | d.endswith(".egg-info")))


def _nodes(files: DataFrame, depth: int) -> DataFrame:
    """repo_name, level, kind, name, place: the distinct nodes that a tree of ``depth`` shows, before any is counted.

    ``place`` sorts a tree: below a directory first its files, then its directories, each by name.
    A path gives at most ``depth`` + 1 nodes.
    """
    parts = F.col("parts")
    dirs = F.size(parts) - 1
    inside = lambda n: F.transform(F.slice(parts, F.lit(1), n), lambda d: F.concat(F.lit("1"), d))
    node = lambda level, kind, name, place: F.struct(level.cast("int").alias("level"), F.lit(kind).alias("kind"), name.alias("name"), place.alias("place"))
    of_dirs = F.when(dirs > 0, F.transform(F.sequence(F.lit(1), F.least(dirs, F.lit(depth))), lambda i: node(i, "dir", F.get(parts, i - 1), inside(i))))
    last = F.element_at(parts, -1)
    leaf = (
        F.when(dirs < depth, node(dirs, "file", last, F.concat(inside(dirs), F.array(F.concat(F.lit("0"), last)))))
        .when(dirs == depth, node(F.lit(depth), "hidden", F.lit(""), F.concat(inside(F.lit(depth)), F.array(F.lit("1")))))
        .otherwise(node(F.lit(depth), "nested", F.get(parts, F.lit(depth)), F.concat(inside(F.lit(depth)), F.array(F.concat(F.lit("0"), F.get(parts, F.lit(depth)))))))
    )
    cut = files.select("repo_name", _parts(F.col("path")).alias("parts")).filter(F.size("parts") > 0)
    empty = F.array().cast("array<struct<level:int,kind:string,name:string,place:array<string>>>")
    return cut.select("repo_name", F.explode(F.concat(F.coalesce(of_dirs, empty), F.array(leaf))).alias("n")).select("repo_name", "n.*")


def tree_pieces(files: DataFrame, depth: int = DEPTH, icons: bool = True) -> DataFrame:
    """repo_name, place, text, gap: a heading (place null) and the lines of the tree in rows. Distinct nodes are summed up map-side."""
    nodes = _nodes(prune_paths(files), depth).groupBy("repo_name", "level", "kind", "name", "place").agg(F.count(F.lit(1)).alias("n"))
    d, f = (f"{DIR_ICON} ", f"{FILE_ICON} ") if icons else ("", "")
    pad = lambda more: F.repeat(F.lit("  "), F.col("level") + more)
    line = (
        F.when(F.col("kind") == "dir", F.concat(pad(0), F.lit(d), "name", F.lit("/")))
        .when(F.col("kind") == "file", F.concat(pad(1), F.lit(f), "name"))
        .when(F.col("kind") == "nested", F.concat(pad(1), F.lit(d), "name", F.lit("/ [NESTED]")))
        .otherwise(F.concat(pad(1), F.lit("["), F.col("n").cast("string"), F.lit(" files]")))
    )
    head = F.concat(F.lit("Repository: "), "repo_name")
    heads = nodes.select("repo_name").distinct().select("repo_name", F.lit(None).cast("array<string>").alias("place"), F.concat(head, F.lit("\n"), F.repeat(F.lit("="), F.length(head))).alias("text"), F.lit("\n\n").alias("gap"))
    return heads.unionByName(nodes.select("repo_name", "place", line.alias("text"), F.lit("\n").alias("gap")))


#: Parts of a place that name a group of lines: below it they are put together apart.
GROUP = 2


def tree_lines(files: DataFrame, depth: int = DEPTH, icons: bool = True) -> DataFrame:
    """repo_name, tree: the pieces of a tree as one text; ``tree_pieces`` has them as rows.

    Lines are sorted and joined for each place of two parts first, in as many tasks as there are, so a repository only joins their texts, in order.
    """
    pieces = tree_pieces(files, depth, icons).withColumn("place", F.coalesce("place", F.array()))
    ordered = lambda by: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(by, "text"))), lambda x: x["text"]), "\n")
    below = pieces.filter(F.size("place") > 0).withColumn("group", F.slice("place", 1, GROUP)).groupBy("repo_name", "group").agg(ordered("place").alias("text"))
    heads = pieces.filter(F.size("place") == 0).select("repo_name", F.col("place").alias("group"), F.concat("text", F.lit("\n")).alias("text"))
    return heads.unionByName(below).groupBy("repo_name").agg(ordered("group").alias("tree"))


def structure_stats(files: DataFrame, depth: int = DEPTH) -> DataFrame:
    """repo_name, dirs, files, nested: what a tree shows."""
    nodes = _nodes(prune_paths(files), depth).distinct()
    return nodes.groupBy("repo_name").agg(*(F.count_if(F.col("kind") == k).alias(n) for k, n in (("dir", "dirs"), ("file", "files"), ("nested", "nested"))))


def repo_size(files: DataFrame) -> DataFrame:
    """repo_name, bytes, files, size."""
    sums = files.groupBy("repo_name").agg(F.sum("length").alias("bytes"), F.count(F.lit(1)).alias("files"))
    return sums.withColumn("size", F.concat(human_size(F.col("bytes")), F.lit(" ("), F.col("files").cast("string"), F.lit(" files)")))
