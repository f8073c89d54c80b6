"""Tables with one row a key: repeats, late batches, and jobs that die half way."""

import pytest

from shelfmark.operators import history, results
from shelfmark.sources import keyed

SCHEMA = "k string, v long, at long"
ORDER = ["at", "v"]


def rows(spark, *data):
    return spark.createDataFrame(list(data), SCHEMA)


def table(spark, path):
    return [tuple(r) for r in keyed.read_keyed(spark, path, SCHEMA).select("k", "v", "at").orderBy("k", "v").collect()]


def test_saves_replace_by_key(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    assert table(spark, path) == []
    first = rows(spark, ("a", 1, 1), ("a", 2, 3), ("b", 1, 1), (None, 1, 1))
    for _ in range(2):
        keyed.upsert(first, path, ["k"], ORDER)
        assert table(spark, path) == [(None, 1, 1), ("a", 2, 3), ("b", 1, 1)]
    keyed.upsert(rows(spark, ("b", 7, 0), ("c", 1, 1), (None, 2, 2)), path, ["k"], ORDER)
    assert set(table(spark, path)) == {("a", 2, 3), ("b", 7, 0), ("c", 1, 1), (None, 2, 2)}
    keyed.upsert(spark.createDataFrame([], SCHEMA), path, ["k"], ORDER)
    assert len(table(spark, path)) == 4


def test_only_touched_buckets_are_written(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    keyed.upsert(rows(spark, *((f"k{i}", i, 1) for i in range(200))), path, ["k"], ORDER, buckets=16)
    before = {f: f.stat().st_mtime_ns for f in tmp_path.glob("t/bucket=*/*.parquet")}
    keyed.upsert(rows(spark, ("k3", 9, 2)), path, ["k"], ORDER, buckets=16)
    after = {f for f in tmp_path.glob("t/bucket=*/*.parquet")}
    changed = {f.parent.name for f in after ^ set(before)}
    assert len({f.parent.name for f in before}) == 16 and len(changed) == 1
    assert not list(tmp_path.glob("t/_merged/*")) and not list(tmp_path.glob("t/_staged/*"))
    assert len(table(spark, path)) == 200 and ("k3", 9, 2) in table(spark, path)


def test_a_crash_before_the_merge_leaves_the_old_table(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    keyed.upsert(rows(spark, ("a", 1, 1)), path, ["k"], ORDER)
    keyed.stage(rows(spark, ("a", 2, 2), ("b", 2, 2)), path, ["k"], ORDER)  # and no merge
    assert table(spark, path) == [("a", 1, 1)]
    assert keyed.recover(spark, path) == [] and table(spark, path) == [("a", 1, 1)]


def test_a_crash_while_buckets_are_replaced_is_finished(spark, tmp_path, monkeypatch):
    path = f"file://{tmp_path}/t"
    keyed.upsert(rows(spark, ("a", 1, 1), ("b", 1, 1), ("c", 1, 1)), path, ["k"], ORDER)

    def dies(*_):
        raise RuntimeError("driver lost")

    with monkeypatch.context() as m:
        m.setattr(keyed, "_replace", dies)
        with pytest.raises(RuntimeError):
            keyed.upsert(rows(spark, ("a", 2, 2), ("d", 2, 2)), path, ["k"], ORDER)
    assert table(spark, path) == [("a", 1, 1), ("b", 1, 1), ("c", 1, 1)]
    for lost in tmp_path.glob("t/bucket=*"):  # as if it had died between taking old buckets away and putting new ones there
        if any(r["k"] == "a" for r in spark.read.parquet(f"file://{lost}").collect()):
            for f in lost.iterdir():
                f.unlink()
            lost.rmdir()
    assert len(keyed.recover(spark, path)) == 1
    assert table(spark, path) == [("a", 2, 2), ("b", 1, 1), ("c", 1, 1), ("d", 2, 2)]


def test_the_same_run_twice_is_one_row(spark, tmp_path):
    runs = spark.createDataFrame([("r", "https://x", "abcdefg", "main", [("p", "1")], "s")], "repo_name string, repo_url string, commit_sha string, branch_name string, prompt_versions array<struct<prompt:string,version:string>>, analysis_summary string")
    for now in (100, 100, 200):
        history.append_history(runs, f"file://{tmp_path}/h", now)
    assert sorted(r["analysis_timestamp"] for r in keyed.read_keyed(spark, f"file://{tmp_path}/h").collect()) == [100, 200]
    outcome = spark.createDataFrame([("r", "s", "c", "1", "text")], "repo_name string, step_name string, commit_sha string, prompt_version string, content string")
    for now in (100, 100, 200):
        results.append_results(outcome, f"file://{tmp_path}/r", now)
    assert [r["created_at"] for r in keyed.read_keyed(spark, f"file://{tmp_path}/r").collect()] == [200]
