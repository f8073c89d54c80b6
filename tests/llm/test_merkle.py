"""The manifest against a tree in plain Python."""

import hashlib
import string
import zlib

import pytest
from pyspark.sql import functions as F

from shelfmark.llm import merkle
from shelfmark.llm.common import table
from tests.llm.odd import TEXTS, no_documents, odd_documents

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row, text):
    return digest("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (row["doc_id"], row["source"], row["lang"], row["n_chars"], text)))


def climb(nodes):
    levels = [nodes]
    while len(nodes) > 1:
        nodes = [digest("".join(nodes[i : i + 16])) for i in range(0, len(nodes), 16)]
        levels.append(nodes)
    return levels


def siblings(levels, at):
    for level in levels[:-1]:
        first = at // 16 * 16
        yield "".join(level[first:at]), "".join(level[at + 1 : first + 16])
        at //= 16


def slow_manifest(rows):
    sources = {}
    for r in rows:
        sources.setdefault(r["source"], []).append(r)
    order = sorted(sources, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in order:
        sources[s].sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r, r["text"])))
        trees[s] = climb([leaf(r, r["text"]) for r in sources[s]])
    top = climb([trees[s][-1][0] for s in order])
    for place, s in enumerate(order):
        for i, r in enumerate(sources[s]):
            path, text = [*siblings(trees[s], i), *siblings(top, place)], r["text"]
            if text is not None and r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0:
                text = text.translate(LOWER)
            value = leaf(r, text)
            for before, after in path:
                value = digest(before + value + after)
            yield r["doc_id"], leaf(r, r["text"]), trees[s][-1][0], top[-1][0], digest("".join(a + b for a, b in path)), value, value == top[-1][0]


def check(docs):
    got = sorted((tuple(r) for r in merkle.verify(docs).collect()), key=str)
    assert got == sorted(slow_manifest(docs.collect()), key=str)
    return got


def test_manifest_against_a_plain_tree(spark, data):
    got = check(table(spark, data, "documents"))
    assert 0 < sum(not r[-1] for r in got) < len(got) / 3


@pytest.mark.parametrize("sizes", [{"a": 1}, {"a": 16, "b": 17}, {"a": 257, None: 1}, {f"s{i:03d}": 1 + i % 3 for i in range(40)}])
def test_depths(spark, sizes):
    rows = [(k, s, "en", 1, "T") for k, s in enumerate(s for s, n in sizes.items() for _ in range(n))]
    check(spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string"))


def test_odd_rows(spark):
    check(odd_documents(spark))
    check(odd_documents(spark, TEXTS[:1]))
    check(odd_documents(spark, [TEXTS[10]] * 40))
    assert merkle.verify(no_documents(spark)).collect() == []


def test_paths_of_a_few_leaves_read_few_records(spark, data):
    """Only what is asked for descends, and its path is the same."""
    docs = table(spark, data, "documents")
    manifest = merkle.build(docs)
    some = manifest.places.filter("doc_id % 97 = 0").drop("depth")
    got = {r["doc_id"]: r["proof"] for r in merkle.paths(manifest, some).select("doc_id", merkle.proof_digest(F.col("path")).alias("proof")).collect()}
    want = {r[0]: r[4] for r in slow_manifest(docs.collect()) if r[0] % 97 == 0}
    assert got == want
