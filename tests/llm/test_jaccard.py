"""The Jaccard join against all pairs that share a shingle."""

import random
import re
import string

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from shelfmark.llm import jaccard
from shelfmark.llm.common import table
from tests.llm.odd import no_documents, odd_documents

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def words_set(text):
    words = WORD.findall((text or "").translate(LOWER))
    return {tuple(words[k : k + 5]) for k in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} if words else set()


def slow_components(rows):
    sets, parent, holders = [words_set(t) for _, t in rows], list(range(len(rows))), {}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, own in enumerate(sets):
        shared = {}
        for g in own:
            for other in holders.setdefault(g, []):
                shared[other] = shared.get(other, 0) + 1
            holders[g].append(k)
        for other, n in shared.items():
            if 100 * n >= 80 * (len(own) + len(sets[other]) - n):
                parent[top(other)] = top(k)
    least = {}
    for k, (i, _) in enumerate(rows):
        least.setdefault(top(k), []).append(i)
    return sorted(((i, len(sets[k]), min((x for x in least[top(k)] if x is not None), default=None)) for k, (i, _) in enumerate(rows)), key=str)


def check(docs, **options):
    got = sorted((tuple(r) for r in jaccard.jaccard_components(docs, **options).collect()), key=str)
    assert got == slow_components([(r["doc_id"], r["text"]) for r in docs.collect()])
    return got


@pytest.mark.parametrize("options", [{}, {"piece": 3, "piece_shingles": 1000}])
def test_documents_against_all_pairs(spark, data, options):
    got = check(table(spark, data, "documents"), **options)
    assert len({r[2] for r in got}) < len(got)


@pytest.mark.parametrize("options", [{}, {"piece": 20, "piece_shingles": 3000}])
def test_groups_around_the_threshold(spark, options):
    """Near copies of one text and of its beginnings, some within the threshold and some not, in whole and in cut tiles."""
    rng = random.Random(1)
    base, rows = [f"w{rng.randrange(3000)}" for _ in range(150)], []
    for i in range(300):
        words = base[: rng.choice([3, 6, 20, 60, 150])]
        for _ in range(rng.randrange(0, len(words) // 20 + 1)):
            words[rng.randrange(len(words))] = f"x{rng.randrange(10)}"
        rows.append((i, " ".join(words)))
    check(spark.createDataFrame(rows, "doc_id long, text string"), **options)


def test_large_group_and_a_common_passage(spark):
    """A third of all rows near copies of one text, a third with one passage in common: cut tiles give what whole ones do."""
    rng = random.Random(2)
    word = lambda: f"w{rng.randrange(10**6)}"
    base, passage, rows = [word() for _ in range(100)], [word() for _ in range(40)], []
    for i in range(600):
        near = [*base]
        near[rng.randrange(100)] = word()
        rows.append((i, " ".join((near, passage + [word() for _ in range(60)], [word() for _ in range(80)])[i % 3])))
    got = check(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), piece=64, piece_shingles=4000)
    assert sum(r[2] == 0 for r in got) == 200


def test_odd_rows(spark):
    check(odd_documents(spark))
    assert jaccard.jaccard_components(no_documents(spark)).collect() == []


members = st.sets(st.integers(-(2**63), 2**63 - 1), min_size=1, max_size=300)


@settings(max_examples=60, deadline=None)
@given(members, members, members)
def test_bitmaps_never_hide_a_link(common, a, b):
    x, y = (np.array(sorted(common | s), np.int64) for s in (a, set(list(b)[: len(common) // 5])))
    maps = [jaccard.bitmap(s, jaccard.width(len(s))).tobytes() for s in (x, y)]
    none = [np.zeros(0, np.int64)] * 2
    few = jaccard.marked_few([len(x), len(y)], maps, none, [2, 2])
    many = jaccard.marked(np.array([len(x), len(y)]), maps, none, np.array([2, 2]))
    exact = 100 * len(set(x) & set(y)) >= 80 * len(set(x) | set(y))
    assert jaccard.linked(x, y) == exact and few == many.tolist()
    assert few == [True, True] or not exact
    if exact:
        assert set(x[: jaccard.prefix_length(len(x))]) & set(y[: jaccard.prefix_length(len(y))])
