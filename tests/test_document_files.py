"""The sink of document files: clashes, failing tasks, repeats, and the list against the disk."""

import pytest
from pyspark.sql import functions as F

from shelfmark.operators import documents
from shelfmark.sources.document_files import FORMAT, DocumentFilesWriter, register


def frame(spark, *rows):
    return spark.createDataFrame(list(rows), "repo_name string, document string").repartition(3)


def on_disk(folder):
    return {p.name: p.read_text() for p in folder.iterdir()} if folder.exists() else {}


def test_list_equals_the_disk(spark, tmp_path):
    out = tmp_path / "out"
    rows = frame(spark, *((f"r{i}", f"text {i}\nÄ") for i in range(50)), ("a/b", "slash"), ("", "no name"), ("none", None), (None, "x"), ("empty", ""))
    listed = sorted(r["file_name"] for r in documents.write_documents(rows, str(out)).collect())
    assert listed == sorted(on_disk(out)) and len(listed) == 51
    assert on_disk(out)["a_b.arch.md"] == "slash" and on_disk(out)["r7.arch.md"] == "text 7\nÄ"


@pytest.mark.parametrize("names", [("a/b", "a_b"), ("a", "a"), ("x\\y", "x/y")])
def test_clashing_names_are_an_error_before_anything_is_visible(spark, tmp_path, names):
    with pytest.raises(ValueError, match="overwrite each other"):
        documents.write_documents(frame(spark, ("fine", "1"), *((n, "2") for n in names)), str(tmp_path / "out"))
    assert on_disk(tmp_path / "out") == {}


def test_again_replaces_and_overwrite_clears(spark, tmp_path):
    out = tmp_path / "out"
    documents.write_documents(frame(spark, ("a", "1"), ("b", "1")), f"file://{out}")
    documents.write_documents(frame(spark, ("b", "2"), ("c", "2")), f"file://{out}")
    assert on_disk(out) == {"a.arch.md": "1", "b.arch.md": "2", "c.arch.md": "2"}
    documents.write_documents(frame(spark, ("d", "3")), f"file://{out}", overwrite=True)
    assert on_disk(out) == {"d.arch.md": "3"}


def test_failed_tasks_leave_no_files(spark, tmp_path):
    out = tmp_path / "out"
    register(spark)
    rows = spark.range(40).repartition(4).select(F.concat(F.lit("f"), "id").alias("file_name"), F.when(F.col("id") == 33, F.raise_error(F.lit("lost"))).otherwise("text").alias("document"))
    with pytest.raises(Exception, match="lost"):
        rows.write.format(FORMAT).mode("append").option("path", str(out)).save()
    assert on_disk(out) == {}


def test_an_attempt_that_does_not_count_leaves_no_files(tmp_path):
    writer = DocumentFilesWriter(str(tmp_path), False)
    first, again = (writer.write(iter([{"file_name": "a", "document": text}])) for text in ("first", "again"))
    assert first.folder != again.folder
    writer.commit([again, None])
    assert {p.name: p.read_text() for p in tmp_path.iterdir()} == {"a": "again"}


def test_searches_for_odd_terms(spark):
    rows = spark.createDataFrame([("r", "s", "The the İ x"), ("q", "s", None)], "repo_name string, step_name string, content string")
    assert documents.search_documents(rows, "").collect() == []
    assert [tuple(r) for r in documents.search_documents(rows, "THE").collect()] == [("r", "s", 2)]
