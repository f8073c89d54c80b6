"""One large JSON document of entries, read in byte ranges by many tasks.

Spark's text reader cuts a file at every closing brace, in any split of it. Whether such a piece begins inside a string, and how deep,
follows from the pieces before it. A first pass walks each split for both ways in which it may begin and leaves one row of sums; those are
added up on the driver like the list of the splits themselves. A second pass, which then knows where every split begins, puts
pieces between two ends of an entry together in the task that reads them. Only an entry that runs across splits is put together by a shuffle.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.sources.shared import shared_path

#: What an array adds to the depth: more than objects ever do, so that nothing in an array is at depth one or two.
ARRAY = 1 << 32
#: An entry ends where an object ends at these depths.
ENDS = (0, 1, 2)
#: Texts are given out whenever they have so many bytes.
BATCH = 1 << 24

_SUMS = "file string, block long, bytes long, read long, quotes long, depth array<long>, ends array<map<long,long>>"
_SUMS_ARROW = pa.schema([("file", pa.string()), ("block", pa.int64()), ("bytes", pa.int64()), ("read", pa.int64()), ("quotes", pa.int64()), ("depth", pa.list_(pa.int64())), ("ends", pa.list_(pa.map_(pa.int64(), pa.int64())))])
_TEXTS = "file string, entry long, block long, whole boolean, before long, after long, member long, text binary"
_TEXTS_ARROW = pa.schema([("file", pa.string()), ("entry", pa.int64()), ("block", pa.int64()), ("whole", pa.bool_()), ("before", pa.int64()), ("after", pa.int64()), ("member", pa.int64()), ("text", pa.binary())])

_ESCAPED = re.compile(rb"\\[\s\S]")


def _counted(piece: bytes) -> tuple[int, tuple[int, int]]:
    """Quotes of a piece, and what it opens if it begins outside a string or inside one: braces, and ``ARRAY`` times the brackets that open less those that close.

    No piece begins behind a backslash, as JSON does not escape braces.
    """
    parts = (_ESCAPED.sub(b"", piece) if b"\\" in piece else piece).split(b'"')
    opened = lambda code: code.count(b"{") + ARRAY * (code.count(b"[") - code.count(b"]"))
    return len(parts) - 1, (opened(b"".join(parts[::2])), opened(b"".join(parts[1::2])))


def _by_split(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(file, block, bytes), its pieces; all pieces of a split come one after the other."""
    rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True))
    return groupby(rows, key=lambda row: row[:3])


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row a split: its quotes, and for both ways to begin how deep it goes, and how many objects end at its lowest depths, counted from where it begins."""
    for (file, block, size), rows in _by_split(batches):
        read, quotes, depth, ends = 0, 0, [0, 0], [Counter(), Counter()]
        for *_, piece in rows:
            read += len(piece) + 1
            here, opened = _counted(piece)
            for way in (0, 1):
                closes = (way + quotes + here) % 2 == 0
                depth[way] += opened[(way + quotes) % 2] - closes
                if closes:
                    ends[way][depth[way]] += 1
            quotes += here
        # A document is never below depth zero, so an object that ends higher than this ends no entry.
        low = [{d: n for d, n in e.items() if d <= min(e) + max(ENDS)} for e in ends]
        yield pa.RecordBatch.from_pylist([{"file": file, "block": block, "bytes": size, "read": read, "quotes": quotes, "depth": depth, "ends": [list(e.items()) for e in low]}], schema=_SUMS_ARROW)


def _starts(sums: list) -> dict[tuple[str, int], tuple[int, int, int, int]]:
    """(file, block) to how a split begins: inside a string or not, its depth, the entries and the objects of the root that ended earlier; none of documents that do not end."""
    starts = {}
    for file, splits in groupby(sorted(sums, key=lambda r: (r["file"], r["block"])), key=lambda r: r["file"]):
        inside, depth, entry, member, read, of = 0, 0, 0, 0, 0, {}
        for r in splits:
            of[file, r["block"]] = (inside, depth, entry, member)
            ends = r["ends"][inside]
            entry += sum(ends.get(d - depth, 0) for d in ENDS)
            member += ends.get(1 - depth, 0)
            depth += r["depth"][inside]
            inside = (inside + r["quotes"]) % 2
            read += r["read"]
        # What follows the last closing brace is a piece without one; a byte order mark is not read.
        open_end = read - r["bytes"] in (1, -2)
        if depth + open_end == 0 and not inside:
            starts |= of
    return starts


def _joined(starts: dict[tuple[str, int], tuple[int, int, int, int]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Pieces to texts of entries, ``whole`` unless a text begins or ends in another split."""

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for (file, block, _), rows in _by_split(batches):
            if (file, block) not in starts:
                continue
            inside, depth, entry, member = starts[file, block]
            held, before, of, begun = [], depth, member, block == 0
            for *_, piece in rows:
                quotes, opened = _counted(piece)
                held.append(piece)
                closes = (inside + quotes) % 2 == 0
                depth += opened[inside] - closes
                inside = (inside + quotes) % 2
                if closes and depth in ENDS:
                    yield file, entry, block, begun, before if before in ENDS else -1, depth, of, b"}".join(held) + b"}"
                    entry, member = entry + 1, member + (depth == 1)
                    held, before, of, begun = [], depth, member, True
            if held:
                yield file, entry, block, False, before if before in ENDS else -1, depth, of, b"}".join(held) + b"}"

    def batched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        give = lambda: pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _TEXTS_ARROW, strict=True)], schema=_TEXTS_ARROW)
        for row in texts(batches):
            rows.append(row)
            size += len(row[-1])
            if size >= BATCH:
                yield give()
                rows, size = [], 0
        if rows:
            yield give()

    return batched


def entry_texts(spark: SparkSession, path: str) -> DataFrame:
    """file, entry, before, after, member, json: what stands in a document between two ends of objects at depth one or two, in braces of its own.

    ``before`` and ``after`` are the depths at which it begins and ends, and ``member`` counts the objects in the root that ended earlier. A document
    whose braces or quotes do not end gives no rows. Texts are written once to the shared folder, as several readers follow, each of which reads some depths only.
    """
    m = F.col("_metadata")
    pieces = spark.read.text(path, lineSep="}").select(m["file_path"].alias("file"), m["file_block_start"].alias("block"), m["file_size"].alias("bytes"), F.col("value").cast("binary").alias("value"))
    # A row a split.
    starts = _starts(pieces.mapInArrow(_sums, _SUMS).collect())
    written = shared_path(spark, "entries")
    pieces.mapInArrow(_joined(starts), _TEXTS).withColumn("text", F.col("text").cast("string")).write.partitionBy("whole", "before").parquet(written)
    texts = spark.read.schema(_TEXTS.replace("binary", "string")).parquet(written)
    columns = ["file", "entry", "before", "after", "member", "text"]
    parts = texts.filter("not whole").groupBy("file", "entry").agg(F.sort_array(F.collect_list(F.struct("block", "text", "before", "after", "member"))).alias("p"))
    first, last = F.col("p")[0], F.element_at("p", -1)
    across = parts.select("file", "entry", first["before"].alias("before"), last["after"].alias("after"), first["member"].alias("member"), F.array_join(F.col("p")["text"], "").alias("text"))
    entries = texts.filter("whole").select(*columns).unionByName(across)
    before, after, text = F.col("before"), F.col("after"), F.col("text")
    begun = F.when(before == 0, text).otherwise(F.concat(F.lit("{"), F.regexp_replace(text, r"^\s*,", "")))
    closing = F.when(before == 2, after - 1).otherwise(after)
    json = F.concat(begun, F.repeat(F.lit("}"), F.greatest(F.least(closing, F.lit(2)), F.lit(0)).cast("int")))
    # Nothing that follows the root counts.
    return entries.filter((before > 0) | (F.col("entry") == 0)).select("file", "entry", "before", "after", "member", json.alias("json"))


def member_entries(spark: SparkSession, path: str, member: str) -> DataFrame:
    """name, raw, is_object for every entry of the object ``member`` in the root of the document at ``path``."""
    texts = entry_texts(spark, path).withColumn("fields", F.from_json("json", "map<string,string>"))
    inner = F.col("fields")[member]
    # An object that ends at depth one or two is the last field of its text.
    of_root = (F.col("after") == 2) | (F.try_element_at(F.map_keys("fields"), F.lit(-1)) == member)
    heads = texts.filter((F.col("before") < 2) & of_root & inner.startswith("{"))
    # A row a file: of members of one name the last counts.
    of = heads.groupBy("file").agg(F.max("member").alias("member"))
    at_head = heads.withColumn("fields", F.from_json(inner, "map<string,string>"))
    behind = texts.filter("before = 2")
    found = at_head.unionByName(behind).join(F.broadcast(of), ["file", "member"]).select("after", F.size("fields").alias("n"), F.posexplode_outer("fields").alias("nth", "name", "raw"))
    # An inner one is planned with a filter that parses all texts once more.
    found = found.filter("name is not null")
    return found.select("name", "raw", ((F.col("after") == 2) & (F.col("nth") == F.col("n") - 1)).alias("is_object"))
