"""A manifest of a dataset as a Merkle tree: content-addressed records, and a descent from the root for any leaves.

Leaves are digests of rows, in order of doc_id within a source. Every 16 consecutive nodes become one, up to
one subroot a source; the subroots, in order of source, become the root by the same rule. The store is a table
of records, digest -> digests of the children. A request for a leaf is its source's place and its rank; base-16 digits
of both name the child to take at every node below the root. Requests that share a node descend as one row, so the
root is read once and no node is a hot key; a step collects the children that were not taken, and the path is reversed at the
bottom, where it is shared by the leaves of one parent. Only the root's digest and the depths of the trees reach the driver.

Nulls and edge cases: a null is part of a leaf as ``-``; the null source comes first, so does a null doc_id, which is never
tampered with. Rows of one doc_id follow each other by digest; rows alike in all columns are leaves of their own. Texts of any
length are hashed whole. An empty table has no root and gives an empty result; extra columns are no part of a leaf.
"""

from __future__ import annotations

import string
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.common import discard, materialise, with_rank, written

FANOUT = 16
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Of the ids whose CRC-32 this divides, the text is tampered with.
TAMPERED = 5


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def field(value: Column) -> Column:
    """A value with its length, so that no two rows run together alike."""
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_table(docs: DataFrame) -> DataFrame:
    """source, doc_id, leaf, changed: the leaf's digest, and the digest after tampering (the same where none took place)."""
    lower = F.translate("text", string.ascii_uppercase, string.ascii_lowercase)
    of = lambda text: digest(*(field(text if c == "text" else F.col(c)) for c in FIELDS))
    touched = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % TAMPERED == 0, F.lit(False))
    return docs.select("source", "doc_id", of(F.col("text")).alias("leaf"), F.when(touched, of(lower)).alias("changed")).withColumn("changed", F.coalesce("changed", "leaf"))


def _depth(nodes: Column) -> Column:
    """Levels above so many nodes: the hexadecimal digits of the greatest rank, none above a single node."""
    return F.when(nodes > 1, F.length(F.hex(nodes - 1))).otherwise(0)


class Manifest(NamedTuple):
    """records: digest, children. places: tree, rank, doc_id, leaf, changed. trees: tree, source, depth, subroot. root is None for no rows."""

    records: DataFrame
    places: DataFrame
    trees: DataFrame
    root: str | None
    depth: int


def _grow(nodes: DataFrame, name: str) -> tuple[list[DataFrame], DataFrame]:
    """Records of each level above ``nodes`` (tree, rank, digest, depth), and tree, digest of the tops."""
    levels: list[DataFrame] = []
    tops = nodes.filter("depth = 0").select("tree", "digest")
    highest = nodes.agg(F.max("depth")).first()[0] or 0
    below = nodes
    for level in range(1, highest + 1):
        runs = below.filter(F.col("depth") >= level).groupBy("tree", F.shiftright("rank", 4).alias("rank"), "depth")
        children = F.transform(F.array_sort(F.collect_list(F.struct(F.col("rank").alias("at"), "digest"))), lambda c: c["digest"])
        below = materialise(runs.agg(children.alias("children")).withColumn("digest", digest(F.array_join("children", ""))), f"{name}-{level}")
        levels.append(below.select("digest", "children"))
        tops = tops.unionByName(below.filter(F.col("depth") == level).select("tree", "digest"))
    return levels, tops


def build(docs: DataFrame) -> Manifest:
    """Hashes every row once, ranks the leaves within their sources, and writes the records level by level."""
    spark = docs.sparkSession
    # A number of the written row, so that rows alike in everything are dealt evenly too.
    leaves, leaves_path = written(leaf_table(docs).withColumn("nth_row", F.monotonically_increasing_id()), "leaves")
    first = [F.col("source").asc_nulls_first(), F.col("doc_id").asc_nulls_first(), F.col("leaf"), F.col("nth_row")]
    ranked, ranked_path = written(with_rank(leaves, first, "ordered-leaves"), "ranked-leaves")
    per_source = ranked.groupBy("source").agg(F.min("rank").alias("start"), F.count(F.lit(1)).alias("n"))
    sources = materialise(with_rank(per_source, [F.col("source").asc_nulls_first()], "ordered-sources").withColumnRenamed("rank", "tree").withColumn("depth", _depth(F.col("n"))), "sources")
    of = sources.withColumnRenamed("source", "of")
    placed = ranked.join(of, F.col("source").eqNullSafe(F.col("of"))).select("tree", (F.col("rank") - F.col("start")).alias("rank"), "doc_id", "leaf", "changed", "depth")
    places = materialise(placed, "places")
    discard(spark, leaves_path, ranked_path)
    levels, subroots = _grow(places.select("tree", "rank", F.col("leaf").alias("digest"), "depth"), "records")
    trees = materialise(sources.join(subroots.withColumnRenamed("digest", "subroot"), "tree").select("tree", "source", "depth", "subroot"), "trees")
    top_depth = trees.agg(_depth(F.count(F.lit(1)))).first()[0]
    top_levels, tops = _grow(trees.select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("rank"), F.col("subroot").alias("digest"), F.lit(top_depth).alias("depth")), "top-records")
    records = leaves.select(F.col("leaf").alias("digest"), F.array("leaf").alias("children")).limit(0) if not levels and not top_levels else None
    for level in levels + top_levels:
        records = level if records is None else records.unionByName(level)
    root = tops.first()
    return Manifest(materialise(records.dropDuplicates(["digest"]), "all-records"), places, trees, root["digest"] if root else None, top_depth)


def _step(frontier: DataFrame, records: DataFrame, wanted: DataFrame) -> DataFrame:
    """The nodes below ``frontier`` (tree, rank, digest, path) that requests want (tree, rank), each with what was not taken on its path."""
    opened = frontier.join(records, "digest").select("tree", F.col("rank").alias("above"), "path", "children", F.posexplode("children").alias("digit", "digest"))
    rank = (F.col("above") * FANOUT + F.col("digit")).alias("rank")
    return opened.select("tree", rank, "digest", F.concat("path", F.array(_untaken(F.col("children"), F.col("digit")))).alias("path")).join(wanted, ["tree", "rank"], "left_semi")


def _untaken(children: Column, digit: Column) -> Column:
    before, after = F.slice(children, F.lit(1), digit), F.slice(children, digit + 2, F.lit(FANOUT))
    return F.struct(F.array_join(before, "").alias("before"), F.array_join(after, "").alias("after"))


def paths(manifest: Manifest, requests: DataFrame) -> DataFrame:
    """requests (tree, rank, ...) + subroot, path: what stands before and after on every level, from the leaf up."""
    none = F.array().cast("array<struct<before:string,after:string>>")
    zero = F.lit(0).cast("long")
    parents = materialise(requests.select("tree", F.shiftright("rank", 4).alias("rank")).distinct(), "wanted")
    wanted_trees = parents.select("tree").distinct()
    frontier = requests.sparkSession.range(1).select(zero.alias("tree"), zero.alias("rank"), F.lit(manifest.root).alias("digest"), none.alias("path"))
    for level in range(manifest.depth - 1, -1, -1):
        frontier = _step(frontier, manifest.records, wanted_trees.select(zero.alias("tree"), F.shiftright("tree", 4 * level).alias("rank")).distinct())
    starts = materialise(frontier.select(F.col("rank").alias("tree"), F.col("digest").alias("subroot"), "path").join(manifest.trees.select("tree", "depth"), "tree"), "starts")
    highest = starts.agg(F.max("depth")).first()[0] or 0
    at = lambda level: starts.filter(F.col("depth") == level).select("tree", zero.alias("rank"), F.col("subroot").alias("digest"), "path")
    frontier = at(highest)
    for level in range(highest - 1, 0, -1):
        wanted = parents.select("tree", F.shiftright("rank", 4 * (level - 1)).alias("rank")).distinct()
        frontier = _step(frontier, manifest.records, wanted).unionByName(at(level))
    # At level 1 a record's children are leaves: one row a parent, opened by the last digit of each of its requests.
    last = frontier.join(manifest.records, "digest").select("tree", F.col("rank").alias("parent"), "path", "children")
    if highest:  # a lone leaf is its source's subroot
        last = last.unionByName(at(0).select("tree", F.col("rank").alias("parent"), "path", F.lit(None).cast("array<string>").alias("children")))
    else:
        last = at(0).select("tree", F.col("rank").alias("parent"), "path", F.lit(None).cast("array<string>").alias("children"))
    last = last.join(starts.select("tree", "subroot"), "tree")
    asked = requests.withColumn("parent", F.shiftright("rank", 4)).join(last, ["tree", "parent"])
    own = F.when(F.col("children").isNull(), none).otherwise(F.array(_untaken(F.col("children"), (F.col("rank") % FANOUT).cast("int"))))
    return asked.select(*requests.columns, "subroot", F.concat(own, F.reverse("path")).alias("path"))


def proof_digest(path: Column) -> Column:
    """H of the siblings, level by level, left to right."""
    return digest(F.array_join(F.transform(path, lambda s: F.concat(s["before"], s["after"])), ""))


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(path, leaf, lambda below, s: digest(s["before"], below, s["after"]))


def verify(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified for every row."""
    manifest = build(docs)
    proven = paths(manifest, manifest.places.drop("depth"))
    out = proven.select("doc_id", "leaf", "subroot", F.lit(manifest.root).alias("root"), proof_digest(F.col("path")).alias("proof_sha256"), folded(F.col("changed"), F.col("path")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def _levels_sql(name: str, levels: int) -> str:
    """``name``_0 (k, idx, d) and ``name``_leaf_0 (k, idx, f, proof, ...) level by level; a tree of one node stays as it is."""
    out = []
    for i in range(levels):
        out += [
            f"{name}_w{i} AS (SELECT *, count(*) OVER (PARTITION BY k) > 1 AS grown, coalesce(string_agg(d, '') OVER (PARTITION BY k, idx // 16 ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS bef, "
            f"coalesce(string_agg(d, '') OVER (PARTITION BY k, idx // 16 ORDER BY idx ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS aft FROM {name}_{i})",
            f"{name}_leaf_{i + 1} AS (SELECT l.* REPLACE (l.idx // 16 AS idx, CASE WHEN grown THEN sha256(bef || f || aft) ELSE f END AS f, CASE WHEN grown THEN proof || bef || aft ELSE proof END AS proof) FROM {name}_leaf_{i} l JOIN {name}_w{i} w ON w.k = l.k AND w.idx = l.idx)",
            f"{name}_{i + 1} AS (SELECT k, idx // 16 AS idx, CASE WHEN any_value(grown) THEN sha256(string_agg(d, '' ORDER BY idx)) ELSE any_value(d) END AS d FROM {name}_w{i} GROUP BY k, idx // 16)",
        ]
    return ",\n".join(out)


def _leaf_sql(text: str) -> str:
    return "sha256(" + " || ".join(f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR) END" for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"


#: The same rows in SQL, for up to 16**5 rows a source and 16**3 sources.
MANIFEST_SQL = f"""
WITH crc AS (SELECT doc_id, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))),
  lambda acc, x: list_reduce(list_prepend(xor(acc, x), [CAST(0 AS BIGINT), 0, 0, 0, 0, 0, 0, 0]), lambda a, z: CASE WHEN a & 1 = 1 THEN xor(a >> 1, CAST(3988292384 AS BIGINT)) ELSE a >> 1 END)), CAST(4294967295 AS BIGINT)) % 5 = 0 AS touched FROM documents),
leaves AS (SELECT d.doc_id, source, {_leaf_sql('text')} AS leaf, CASE WHEN touched THEN {_leaf_sql("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} ELSE {_leaf_sql('text')} END AS changed FROM documents d JOIN crc USING (doc_id)),
placed AS (SELECT *, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS k, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx FROM leaves),
s_0 AS (SELECT k, idx, leaf AS d FROM placed), s_leaf_0 AS (SELECT doc_id, k, idx, leaf, changed AS f, '' AS proof FROM placed),
{_levels_sql('s', 5)},
t_0 AS (SELECT 0 AS k, k AS idx, d FROM s_5), t_leaf_0 AS (SELECT doc_id, 0 AS k, l.k AS idx, leaf, f, proof, d AS subroot FROM s_leaf_5 l JOIN s_5 s ON s.k = l.k),
{_levels_sql('t', 3)}
SELECT doc_id, leaf, subroot, d AS root, sha256(proof) AS proof_sha256, f AS folded_root, f = d AS verified FROM t_leaf_3, t_3
"""
