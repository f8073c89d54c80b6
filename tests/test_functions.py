"""Column functions on single cases."""

import math
import random

import pytest
from pyspark.sql import functions as F

from shelfmark.functions import text as t


def values(spark, column, rows, schema="v string"):
    frame = spark.createDataFrame([r if isinstance(r, tuple) else (r,) for r in rows], schema).coalesce(1)
    return [r[0] for r in frame.select(column).collect()]


def test_repo_names(spark):
    got = values(spark, t.repo_name_from_url(F.col("v")), ["https://x.com/a/b.git", "https://x.com/a/b/", "git@x.com:b.git", "/tmp/some dir/", "ssh://h/ü b.git", None])
    assert got == ["b", "b", "b", "some_dir", "ü_b", None]


def test_safe_keys(spark):
    assert values(spark, t.safe_key(F.col("v")), ["https://github.com/o/r", "git@h:o/r.git", "__a//b__", "x|y@z#", "."]) == ["github.com_o_r", "h_o_r.git", "a_b", "x_y_z", ""]


def test_result_keys_come_back(spark):
    key = t.result_key(*(F.lit(x) for x in ("my_repo", "APIs", "abc1234", "2")))
    back = t.parse_result_key(key)
    assert values(spark, F.concat_ws("|", *back.values()), ["x"]) == ["my_repo|APIs|abc1234|2"]


@pytest.mark.parametrize(
    ("url", "want"),
    [
        ("https://user:pw@host.com:8080/a?b#c", "https://host.com:8080/a?b#c (authentication hidden)"), ("http://tok@h/a", "http://h/a (authentication hidden)"), ("git@h:a", "git@h:a"),
        ("https://h/SECRET/a", "https://h/***HIDDEN***/a"), ("https://h/a@b", "https://h/a@b"), ("", ""),
    ],
)
def test_sanitized_urls(spark, url, want):
    assert values(spark, t.sanitize_url(F.col("v"), "SECRET"), [url]) == [want]


@pytest.mark.parametrize(
    ("base", "repo", "web"),
    [
        ("https://github.com/org", "https://github.com/org/hub.git", "https://github.com/org/hub"), ("https://github.com/org/repo", "https://github.com/org/repo.git", "https://github.com/org/repo"),
        ("https://github.com/org/repo.git", "https://github.com/org/repo.git", "https://github.com/org/repo"), ("https://github.com/org/", "https://github.com/org/hub.git", "https://github.com/org/hub"),
        ("https://h/org/digit.git", "https://h/org/digit.git", "https://h/org/digit"),
    ],
)
def test_hub_urls(spark, base, repo, web):
    assert values(spark, F.concat_ws(" ", t.hub_repo_url(F.col("v"), F.lit("hub")), t.hub_web_url(F.col("v"), F.lit("hub"))), [base]) == [f"{repo} {web}"]


def test_prompt_versions_and_cleaning(spark):
    prompts = ["version=3\n\n \nBody\nversion=4", "Body only", "version=invalid\nx", "version=\nx", "version 2\nx", "", None, "version=1", "a\nversion=5", "version=2=3\nx"]
    assert values(spark, t.prompt_version(F.col("v")), prompts) == ["3", "1", "invalid", "1", "1", "1", "1", "1", "1", "2"]
    assert values(spark, t.clean_prompt(F.col("v")), prompts) == ["Body\nversion=4", "Body only", "x", "x", "x", "", None, "", "a\nversion=5", "x"]


def test_repo_types(spark):
    rows = [("ios-app", None, "Python"), ("x", None, "Swift"), ("infra-live", None, None), ("calibre", None, None), ("a", "client library", None), ("build", None, "TypeScript"), ("react-api", None, "JavaScript"), ("react-shop", None, "JavaScript"), ("z", None, "Vue"), ("z", None, "Go"), ("worker", None, None), ("z", None, None)]
    got = values(spark, t.detect_repo_type(F.col("n"), F.col("d"), F.col("l")), rows, "n string, d string, l string")
    assert got == ["mobile", "mobile", "infra-as-code", "libraries", "libraries", "frontend", "backend", "frontend", "frontend", "backend", "backend", "generic"]


def test_sizes(spark):
    sizes = [0, 1023, 1024, 1280, 1331, 1 << 20, (1 << 30) * 3 // 2, 1 << 40, 1 << 52]
    assert values(spark, t.human_size(F.col("v")), sizes, "v long") == ["0.0 B", "1023.0 B", "1.0 KB", "1.2 KB", "1.3 KB", "1.0 MB", "1.5 GB", "1.0 TB", "4096.0 TB"]


def tokens(text):
    return int(len(text) / 3.5) if text else 0


def fitted(template, structure, context, limit):
    """The rule in plain Python."""
    over = tokens(template) + tokens(structure) + tokens(context) - limit
    if over <= 0:
        return template, structure, context
    if tokens(structure) > over:
        n = int((tokens(structure) - over) * 3.5)
        return template, f"{structure[:n]}\n\n... [TRUNCATED: showing first {n:,} of {len(structure):,} characters to fit within {limit:,} token limit] ...", context
    if context and over - tokens(context) <= 0:
        return template, structure, None
    n = max(int(max(limit - tokens(template), 0) * 3.5), 1000)
    cut = structure[:n] + "\n\n... [TRUNCATED] ..."
    if tokens(template) > limit:
        k = max(int((limit - 2000) * 3.5), 10_000)
        shown = int(tokens(template) * 3.5)
        template = f"{template[:k]}\n\n... [TEMPLATE TRUNCATED: showing first {k:,} of {shown:,} characters to fit within {limit:,} token limit] ..."
    return template, cut, None


def test_fit_prompt_on_random_sizes(spark):
    rng = random.Random(5)
    sizes = [0, 3, 700, 1000, 3499, 3500, 7000, 12_000, 40_000]
    rows = [("t" * rng.choice(sizes), "s" * rng.choice(sizes), rng.choice([None, "", "c" * rng.choice(sizes)])) for _ in range(150)]
    for limit in (900, 3000):
        frame = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, t string, s string, c string")
        cut = t.fit_prompt(F.col("t"), F.col("s"), F.col("c"), limit)
        got = frame.select("i", *(c.alias(n) for n, c in cut.items())).orderBy("i").collect()
        for row, r in zip(rows, got):
            assert (r["template"], r["structure"], r["context"]) == fitted(*row, limit), (limit, tuple(map(lambda x: len(x or ""), row)))


def test_tokens_round_down(spark):
    texts = ["", None, "abc", "abcd", "x" * 7, "é" * 8]
    assert values(spark, t.estimate_tokens(F.col("v")), texts) == [math.floor(len(x or "") / 3.5) for x in texts]


def test_expiry(spark):
    rows = [(0, 10), (None, 10), (10, 10), (9, 10)]
    assert values(spark, t.not_expired(F.col("a").cast("long"), F.col("b").cast("long")), rows, "a int, b int") == [True, True, True, False]
