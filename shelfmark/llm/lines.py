"""Line dedup by overlapping three-line windows.

Every run of three consecutive lines of a document is hashed. Of equal windows anywhere
in the corpus the first stays, by doc_id and place; the lines that the later ones cover
are merged and removed. A removed line always has an equal line earlier on, so the
first copy of every line survives.

Nulls and edge cases: a null text stays null; a text of fewer than three lines has no
window and stays as it is; windows of blank lines only do not count; a text whose lines
all go becomes empty, its row stays. Null ids come first. Rows alike in id and text are
one document and get the same result. Columns beside text (and n_chars) are kept as
they are, whatever their names.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.common import fresh_names, let, materialise, row_hash

WINDOW = 3


def windows(docs: DataFrame, text: str = "text", size: int = WINDOW) -> DataFrame:
    """doc_id, text_hash, pos (from 0), w1, w2: a 128-bit hash of each window, its halves from two hashes of each line."""

    def hashed(line_hashes):
        def one(i):
            lines = [F.get(line_hashes, i + k) for k in range(size)]
            blank = functools.reduce(lambda a, b: a & b, (line["blank"] for line in lines))
            return F.struct(i.alias("pos"), F.xxhash64(*(line["a"] for line in lines)).alias("w1"), F.xxhash64(F.lit(1), *(line["b"] for line in lines)).alias("w2"), blank.alias("blank"))

        return F.transform(F.sequence(F.lit(0), F.size(line_hashes) - size), one)

    def twice(line):
        blank = F.trim(line) == ""
        return F.struct(F.when(blank, 0).otherwise(F.xxhash64(line)).alias("a"), F.when(blank, 0).otherwise(F.xxhash64(F.lit(1), line)).alias("b"), blank.alias("blank"))

    rows = docs.select("doc_id", row_hash(text).alias("text_hash"), F.transform(F.split(F.col(text), "\n"), twice).alias("hashes"))
    found = rows.filter(F.size("hashes") >= size).select("doc_id", "text_hash", F.explode(let(F.col("hashes"), hashed)).alias("w"))
    return found.filter(~F.col("w.blank")).select("doc_id", "text_hash", "w.pos", "w.w1", "w.w2")


def covered_lines(docs: DataFrame, text: str = "text", size: int = WINDOW) -> DataFrame:
    """doc_id, text_hash, gone: the places of the lines that later windows cover."""
    found = materialise(windows(docs, text, size), "windows")
    place = F.struct(F.col("doc_id").isNotNull().alias("has_id"), "doc_id", "text_hash", "pos")
    # Partial sums first, so a window that fills a third of the corpus is a row a task here.
    repeated = found.groupBy("w1", "w2").agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("first")).filter("n > 1").drop("n")
    later = found.join(repeated, ["w1", "w2"]).filter(place != F.col("first"))
    starts = later.groupBy("doc_id", "text_hash").agg(F.collect_set("pos").alias("starts"))
    return starts.select("doc_id", "text_hash", F.array_distinct(F.flatten(F.transform("starts", lambda p: F.sequence(p, p + (size - 1))))).alias("gone"))


def _without(text, gone):
    """The text without the lines at the places ``gone``; both are read once, whatever their number."""

    def rest(lines):
        return F.transform(F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), gone), lambda i: F.get(lines, i))

    return F.array_join(let(F.split(text, "\n"), rest), "\n")


def drop_repeated_lines(docs: DataFrame, text: str = "text", size: int = WINDOW) -> DataFrame:
    """The documents without the lines of later windows; n_chars, where there is one, follows the text."""
    key, gone_id, gone_hash, places = fresh_names(docs, "line_key", "gone_id", "gone_hash", "gone")
    gone = covered_lines(docs, text, size).withColumnsRenamed({"doc_id": gone_id, "text_hash": gone_hash, "gone": places})
    mine = docs.withColumn(key, row_hash(text))
    joined = mine.join(gone, F.col("doc_id").eqNullSafe(F.col(gone_id)) & (F.col(key) == F.col(gone_hash)), "left")
    touched = F.col(places).isNotNull()
    clean = F.when(touched, _without(F.col(text), F.col(places))).otherwise(F.col(text))
    changed = {text: clean}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(touched, F.length(clean)).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)
    return joined.select(*(changed.get(c, F.col(f"`{c}`")).alias(c) for c in docs.columns))


def line_report(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_removed, clean_sha256 for every document."""
    gone = covered_lines(docs).withColumnsRenamed({"doc_id": "gone_id", "text_hash": "gone_hash"})
    mine = docs.select("doc_id", "text", row_hash().alias("line_key_"))
    joined = mine.join(gone, mine["doc_id"].eqNullSafe(gone["gone_id"]) & (mine["line_key_"] == gone["gone_hash"]), "left")
    split = F.split(F.coalesce("text", F.lit("")), "\n")
    clean = F.when(F.col("gone").isNull(), F.coalesce("text", F.lit(""))).otherwise(_without(F.col("text"), F.col("gone")))
    return joined.select("doc_id", F.size(split).cast("long").alias("n_lines"), F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_removed"), F.sha2(clean, 256).alias("clean_sha256"))


#: The same rows in SQL, on the lines themselves instead of their hashes.
LINE_REPORT_SQL = """
WITH docs AS (SELECT doc_id, text, coalesce(text, '') AS t FROM documents),
lines AS (SELECT doc_id, t, unnest(string_split(t, chr(10))) AS line, generate_subscripts(string_split(t, chr(10)), 1) - 1 AS pos FROM docs),
norm AS (SELECT doc_id, pos, CASE WHEN trim(line, ' ') = '' THEN '' ELSE line END AS line FROM lines),
runs AS (SELECT doc_id, pos, line AS a, lead(line) OVER w AS b, lead(line, 2) OVER w AS c FROM norm WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
wins AS (SELECT * FROM runs WHERE c IS NOT NULL AND (a <> '' OR b <> '' OR c <> '')),
later AS (SELECT doc_id, pos FROM (SELECT doc_id, pos, row_number() OVER (PARTITION BY a, b, c ORDER BY doc_id, pos) AS rn FROM wins) WHERE rn > 1),
gone AS (SELECT DISTINCT doc_id, pos + k AS pos FROM later, (VALUES (0), (1), (2)) AS v(k)),
kept AS (SELECT l.doc_id, string_agg(l.line, chr(10) ORDER BY l.pos) AS clean FROM lines l ANTI JOIN gone g USING (doc_id, pos) GROUP BY l.doc_id),
removed AS (SELECT doc_id, count(*) AS n_removed FROM gone GROUP BY doc_id)
SELECT d.doc_id, CAST(len(string_split(d.t, chr(10))) AS BIGINT) AS n_lines, coalesce(r.n_removed, 0) AS n_removed, sha256(coalesce(k.clean, '')) AS clean_sha256
FROM docs d LEFT JOIN kept k USING (doc_id) LEFT JOIN removed r USING (doc_id)
"""
