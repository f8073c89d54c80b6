"""A foreign registry document is read in many byte ranges, and gives the rows of the whole document."""

import json
import random
from itertools import groupby

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from shelfmark.sources import split_json
from shelfmark.sources.registry import parse_registry, read_registry
from shelfmark.sources.split_json import member_entries


def rows(frame):
    return sorted((tuple(r) for r in frame.collect()), key=repr)


def document(seed):
    pick = random.Random(seed)
    odd = ["}", "{", '"', "\\", '\\"', "},", ',"a":{', "]", "é", "\n", "plain words ", "\\}", ""]
    text = lambda: "".join(pick.choice(odd) for _ in range(pick.randrange(6)))
    repositories = {}
    for k in range(pick.randrange(40)):
        if pick.random() < 0.2:
            repositories[f"_note{k}"] = text()
        else:
            more = {"topics": [{"n": text()}, {}]} if pick.random() < 0.3 else {"owner": {"name": text(), "in": {}}} if pick.random() < 0.3 else {}
            repositories[f"r{k}{text()}"] = {"url": text(), "description": text(), **more, "type": "generic"}
    repositories |= {"listed": [{"a": text()}, [{}]]} if pick.random() < 0.5 else {}
    beside = {"lists": [{"repositories": {"x": {}}}], "settings": {"x": {"y": text()}, "z": 1}, "default": text(), "empty": {}}
    fields = [("repositories", repositories), *beside.items()]
    pick.shuffle(fields)
    return json.dumps(dict(fields), ensure_ascii=pick.random() < 0.5, indent=pick.choice([None, None, 2])) + pick.choice(["", "\n", "  \n"])


@pytest.mark.parametrize("size", [97, 1 << 27])
def test_documents_in_byte_ranges(spark, tmp_path, size):
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
    try:
        for seed in range(4):
            path = tmp_path / f"{seed}.json"
            path.write_text(document(seed), encoding="utf-8")
            whole = spark.read.text(str(path), wholetext=True)
            entries = json.loads(path.read_text(encoding="utf-8"))["repositories"]
            # Read whole, a comment that begins like an object counts as one.
            objects = {n for n, v in entries.items() if isinstance(v, dict)}
            assert rows(read_registry(spark, str(path))) == rows(parse_registry(whole).filter(F.col("repo_name").isin(objects)))
            assert {(r["name"], r["is_object"]) for r in member_entries(spark, str(path), "repositories").collect()} == {(n, n in objects) for n in entries}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_many_tasks_read_one_line(spark, tmp_path):
    path = tmp_path / "line.json"
    path.write_text(json.dumps({"default": "d", "repositories": {f"r{k}": {"url": f"u{k}", "description": "d" * 90, "type": "generic"} for k in range(2000)}}))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16384")
    try:
        assert spark.read.text(str(path), lineSep="}").rdd.getNumPartitions() > 8
        assert {r["repo_name"]: r["url"] for r in read_registry(spark, str(path)).collect()} == {f"r{k}": f"u{k}" for k in range(2000)}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


@pytest.mark.parametrize("text", ["", "{}", '{"repositories": {}}', '{"repositories": "x"}', '{"repositories": {"a": {"url": "u"}}', '{"repositories": {"a": {"url": "u', "[]"])
def test_documents_without_entries(spark, tmp_path, text):
    path = tmp_path / "d.json"
    path.write_text(text)
    assert rows(read_registry(spark, str(path))) == []
    assert rows(read_registry(spark, str(tmp_path / "none.json"))) == []


def test_texts_are_read_twice_and_not_dealt(spark, tmp_path):
    """One pass for the sums and one for the texts; no reader of the result walks the document again, or sorts its texts into windows."""
    path = tmp_path / "d.json"
    path.write_text(document(1), encoding="utf-8")
    plan = member_entries(spark, str(path), "repositories")._jdf.queryExecution().optimizedPlan().toString()
    assert "parquet" in plan and "Window" not in plan and "MapInArrow" not in plan


@pytest.mark.parametrize("seed", range(30))
def test_any_split_gives_the_same_texts(seed):
    """Entries of a document in one split, and in splits at any of its pieces."""
    raw = document(seed).encode()
    pieces = raw.split(b"}")
    pieces = pieces if pieces[-1] else pieces[:-1]
    cut, found = random.Random(seed), []
    for share in (0, 0.3, 0.9):
        rows, block = [], 0
        for at, piece in enumerate(pieces):
            block = at if cut.random() < share else block
            rows.append({"file": "f", "block": block, "bytes": len(raw), "value": piece})
        batches = [pa.RecordBatch.from_pylist(rows[i : i + 7]) for i in range(0, len(rows), 7)]
        sums = [r | {"ends": [dict(e) for e in r["ends"]]} for b in split_json._sums(iter(batches)) for r in b.to_pylist()]
        texts = [r for b in split_json._joined(split_json._starts(sums))(iter(batches)) for r in b.to_pylist()]
        entries = [(e, list(g)) for e, g in groupby(texts, key=lambda r: r["entry"])]
        found.append([(e, g[0]["before"], g[-1]["after"], g[0]["member"], b"".join(r["text"] for r in g)) for e, g in entries])
    assert found[0] and found[0] == found[1] == found[2]
