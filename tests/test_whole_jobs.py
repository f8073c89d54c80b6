"""Queries on tables that the small test tables are too small or too tidy for."""

import hashlib

import duckdb
import pytest

import __spark_entry__ as entry


@pytest.fixture
def table(tmp_path):
    """Writes a table of ``sql`` as ``name`` and returns the folder."""

    def write(name: str, sql: str) -> str:
        duckdb.sql(sql).write_parquet(f"{tmp_path}/{name}.parquet")
        return str(tmp_path)

    return write


def both(spark, folder: str, name: str, *tables: str) -> tuple[list[tuple], list[tuple]]:
    """Rows of a query and of its SQL."""
    con = duckdb.connect()
    for t in tables:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    want = con.sql(entry.oracle_sql()[name])
    got = entry.queries()[name](spark, folder).select(*want.columns)
    return sorted((tuple(r) for r in got.collect()), key=repr), sorted(want.fetchall(), key=repr)


def test_reduce_tree_of_eight_levels(spark, table):
    """Levels as many as the texts need; a repository of blanks fails; turns beyond a thousand keep their order."""
    folder = table("conversations", """SELECT i // 2 * 5 AS conv_id, CASE WHEN i % 2 = 1 THEN 5000 ELSE 0 END AS turn, 'user' AS role, repeat('text ' || i || chr(10), 160) AS text FROM range(1, 12_000) t(i)
UNION ALL SELECT 1, 0, 'user', '  ' || chr(10) UNION ALL SELECT 2, 0, 'user', 'one'""")
    got, want = both(spark, folder, "reduce_tree", "conversations")
    assert got == want and len(got) == 3 and sorted(r[-1] for r in got) == [1, 1, 8] and sorted(r[1] for r in got) == ["failed", "success", "success"]


def test_tree_lines_has_whole_hosts(spark, table):
    """A host whose pages lie in no folder has a tree, and a host with folders has one tree with its top-level files."""
    folder = table("pages", "SELECT * FROM (VALUES (3, 'https://a.org/top'), (7, 'https://b.org/top'), (6, 'https://b.org/f/g/h/i/j'), (5, 'https://b.org/f'), (10, 'https://b.org/e/x')) v(page_id, url)")
    got, want = both(spark, folder, "tree_lines", "pages")
    assert got == want and [r[0] for r in got] == ["a.org", "b.org"]
    assert got[0][1] == hashlib.md5(b"Repository: a.org\n=================\n\n  top").hexdigest()


def test_pages_of_a_listing_share_files(spark, tmp_path):
    """Pages on lines of one file are what pages in files of their own are."""
    from shelfmark.sources import registry

    pages = ['[{"name": "a", "html_url": "u", "description": "line\\nbreak"}, {"name": "b"}]', '[{"name": "c", "archived": true}]', "[]"]
    for n, page in enumerate(pages):
        (tmp_path / "files" / str(n)).parent.mkdir(exist_ok=True)
        (tmp_path / "files" / str(n)).write_text(page)
    (tmp_path / "lines").write_text("\n".join(pages))
    apart, together = (sorted(map(tuple, registry.read_listing(spark, {"github": f"file://{tmp_path}/{n}"}, lines=n == "lines").collect())) for n in ("files", "lines"))
    assert apart == together and [r[1] for r in together] == ["a", "b", "c"]
