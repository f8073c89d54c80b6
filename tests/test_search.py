"""The index against a scan; what a search and an update read and write."""

import re

import pytest

from shelfmark.operators import documents, results, search

TEXTS = [("r", "a", "The THE theatre, other words"), ("r", "b", "aaaa aaa"), ("q", "a", "ÄÖ straße 日本語 other"), ("q", "b", ""), ("q", "c", None), ("p", "a", "x"), ("p", "b", "100% of [a-z] words\nother\twords other words")]
SCHEMA = "repo_name string, step_name string, content string"


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    path = f"file://{tmp_path_factory.mktemp('index')}/i"
    search.update_index(spark.createDataFrame(TEXTS, SCHEMA), path, buckets=16)
    return path


def rows(frame):
    return sorted(tuple(r) for r in frame.collect())


@pytest.mark.parametrize("term", ["the", "t", "aa", "aaa", "other words", "ß", "日本語", "äö str", "[a-z]", "0%", "zzz", "not there at all", ""])
def test_search_equals_the_scan(spark, index, term):
    assert rows(search.search_index(spark, index, term, buckets=16)) == rows(documents.search_documents(spark.createDataFrame(TEXTS, SCHEMA), term))


def test_several_terms(spark, index):
    for terms in (("other", "words"), ("t", "e"), ("the", "the")):
        want = sorted((r, s, sum(c.lower().count(t) for t in terms)) for r, s, c in TEXTS if c and all(t in c.lower() for t in terms))
        assert want and rows(search.search_index(spark, index, *terms, buckets=16)) == want
    assert rows(search.search_index(spark, index, "other", "zzz", buckets=16)) == rows(search.search_index(spark, index, buckets=16)) == []


def test_a_search_reads_one_bucket(spark, index):
    plan = search.found_runs(spark, index, ["the"], 16)._jdf.queryExecution().executedPlan().toString()
    filters = re.search(r"PartitionFilters: \[(.*?)\], PushedFilters", plan).group(1)
    assert re.search(r"bucket#\d+ = \d+|bucket#\d+ IN \(\d+\)", filters) and "run" in re.search(r"PushedFilters: \[(.*?)\], ReadSchema", plan).group(1)


def test_updates_replace_a_section_and_leave_others(spark, tmp_path):
    path = f"file://{tmp_path}/i"
    search.update_index(spark.createDataFrame(TEXTS, SCHEMA), path, buckets=16)
    now = [("r", "a", "entirely new"), ("r", "b", "aaaa aaa"), ("p", "b", None), ("n", "n", "the newest")]
    assert rows(search.changed_sections(spark.createDataFrame(now, SCHEMA), path).select("repo_name", "step_name")) == [("n", "n"), ("p", "b"), ("r", "a")]
    search.update_index(spark.createDataFrame(now, SCHEMA), path, buckets=16)
    merged = [t for t in TEXTS if t[:2] not in {n[:2] for n in now}] + now
    for term in ("the", "other words", "new", "aa", "words"):
        assert rows(search.search_index(spark, path, term, buckets=16)) == rows(documents.search_documents(spark.createDataFrame(merged, SCHEMA), term)), term


def test_cache_lookup_moves_keys_first(spark):
    """No content in what aggregates deal out; equal times and repeats give one row."""
    stored = [("r", "s", "c", "1", "old", 1, 0), ("r", "s", "c", "1", "a", 2, 0), ("r", "s", "c", "1", "b", 2, 0), ("r", "s", "c", "1", "b", 2, 0), (None, "s", "c", "1", "null key", 2, 0), ("q", "s", "c", "1", "no time", None, 0)]
    table = spark.createDataFrame(stored, "repo_name string, step_name string, commit_sha string, prompt_version string, content string, created_at long, ttl_at long")
    latest = results.latest_result(table)
    assert sorted((r["content"] for r in latest.collect())) == ["b", "no time", "null key"]
    plan = results.latest_result(table, wanted=table.select(*results.KEYS))._jdf.queryExecution().optimizedPlan().toString()
    below = [part for part in plan.split("Aggregate [")[1:]]
    assert below and "content" not in below[0].split("\n")[0]
    tasks = spark.createDataFrame([("r", "s", "c", "1"), ("x", "s", "c", "1")], "repo_name string, step_name string, commit_sha string, prompt_version string")
    assert sorted((r["repo_name"], r["content"]) for r in results.cache_lookup(tasks, table, 5).collect()) == [("r", "b"), ("x", None)]


def test_an_update_leaves_the_postings_that_are_there(spark, tmp_path):
    """What an update writes grows with the change; a text that comes back counts once, and dead postings go without a change to any search."""
    path = f"file://{tmp_path}/i"
    search.update_index(spark.createDataFrame(TEXTS, SCHEMA), path, buckets=4)
    files = lambda: {f: f.stat().st_mtime_ns for f in (tmp_path / "i" / "postings").glob("bucket=*/*.parquet")}
    entries = lambda: spark.read.parquet(f"{path}/postings").selectExpr("sum(size(hits))").first()[0]
    first, held = files(), entries()
    for content in ("b", "The THE theatre, other words"):
        search.update_index(spark.createDataFrame([("r", "a", content)], SCHEMA), path, buckets=4)
        assert first.items() <= files().items()
    last = files()
    search.update_index(spark.createDataFrame([("r", "a", content)], SCHEMA), path, buckets=4)
    assert files() == last and entries() > held
    want = {term: rows(documents.search_documents(spark.createDataFrame(TEXTS, SCHEMA), term)) for term in ("the", "other words", "aa", "b")}
    assert {term: rows(search.search_index(spark, path, term, buckets=4)) for term in want} == want
    search.drop_dead(spark, path)
    assert entries() == held
    assert {term: rows(search.search_index(spark, path, term, buckets=4)) for term in want} == want


def test_runs_are_counted_from_the_left(spark, monkeypatch):
    texts = ["", "a", "aaaaa", "ababab aba", "日本日本日", "the the\n😀😀😀"]
    for low in texts:
        assert search.runs(low) == {low[i : i + n]: low.count(low[i : i + n]) for n in (1, 2, 3) for i in range(len(low) - n + 1)}
    monkeypatch.setattr(search, "ENTRIES", 3)
    batch = search.pa.RecordBatch.from_pydict({"edition": ["e"] * 6, "home": [0, 0, 0, 1, 1, 1], "id": [5, 6, 7, 8, 9, 1 << 33], "low": texts})
    found = {(p["run"], p["base"] + at): n for b in search.cut([batch, batch.slice(0, 0)]) for p in b.to_pylist() for at, n in zip(p["places"], p["hits"], strict=True)}
    assert found == {(run, i): n for i, low in zip([5, 6, 7, 8, 9, 1 << 33], texts, strict=True) for run, n in search.runs(low).items()}


def test_an_index_without_contents(spark, tmp_path):
    path = f"file://{tmp_path}/i"
    search.update_index(spark.createDataFrame([("p", "a", None), ("p", "b", "")], SCHEMA), path, buckets=4)
    for term in ("a", "not there"):
        assert rows(search.search_index(spark, path, term, buckets=4)) == []
    search.drop_dead(spark, path)
    search.update_index(spark.createDataFrame([("p", "a", "now there")], SCHEMA), path, buckets=4)
    assert rows(search.search_index(spark, path, "there", buckets=4)) == [("p", "a", 1)]
