"""Collocations against counts in plain Python, filters against plain counters."""

import re
import string
from collections import Counter, defaultdict

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from shelfmark.llm import collocations
from shelfmark.llm.common import table
from tests.llm.odd import no_documents, odd_documents

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def slow_collocations(rows):
    counts, totals, out = defaultdict(Counter), Counter(), []
    for lang, text in rows:
        for piece in re.split(r"[.,;:!?\n\x0b\x0c\r]", (text or "").translate(LOWER)):
            words = re.findall(r"[^ \t]+", piece)
            totals[lang or "und"] += len(words)
            for n in range(1, 5):
                counts[lang or "und"].update(tuple(words[i : i + n]) for i in range(len(words) - n + 1))
    for lang, f in counts.items():
        candidates, kept = {p: a for p, a in f.items() if len(p) > 1 and a >= 30}, []
        for p, a in candidates.items():
            if any(len(q) > len(p) and 100 * b >= 80 * a and any(q[i : i + len(p)] == p for i in range(len(q))) for q, b in candidates.items()):
                continue
            score, k = min((2_000_000 * a // (f[p[:k]] + f[p[k:]]), k) for k in range(1, len(p)))
            kept.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(kept)[:2000], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, totals[lang], -score))
    return sorted(out)


def check(docs):
    got = sorted(tuple(r) for r in collocations.collocations(docs).collect())
    assert got == slow_collocations([(r["lang"], r["text"]) for r in docs.collect()])
    return got


def test_documents_against_plain_counts(spark, data):
    assert check(table(spark, data, "documents"))


def test_small_chunks_and_many_flushes(spark, data, monkeypatch):
    """Filters sent early and in many buckets give the same counts. Parameters are set where the tasks read them, on a local master."""
    docs = table(spark, data, "documents").repartition(3)
    want = sorted(tuple(r) for r in collocations.collocations(docs).collect())
    monkeypatch.setattr(collocations, "BUCKET_WORDS", 1 << 12)
    assert sorted(tuple(r) for r in collocations.collocations(docs).collect()) == want


def test_phrases_overlaps_and_ties(spark):
    rows = [("a a a a a.", "en")] * 30 + [("New York, new york! New\tYork\nnew york city", None)] * 15 + [("x y. x y", "fr"), ("p q", "fr")] * 30 + [("één twee, één twee", "nl")] * 15
    docs = spark.createDataFrame(rows, "text string, lang string")
    got = check(docs)
    assert [r[:4] for r in got if r[0] == "fr"] == [("fr", 1, "x y", 60), ("fr", 2, "p q", 30)]


def test_odd_rows(spark):
    check(odd_documents(spark, [(1, "word0 word1 word2 word3 word4 word5", "en", "a")] * 31 + [(None, None, None, None), (2, "", "de", None), (3, "\x00   a b .", "de", "a")] * 2))
    assert collocations.collocations(odd_documents(spark)).count() > 0
    assert collocations.collocations(no_documents(spark)).collect() == []


ids = st.integers(0, 2**64 - 1)


@settings(max_examples=80, deadline=None)
@given(st.integers(2, 4).flatmap(lambda n: st.lists(st.tuples(st.tuples(*[ids] * n), st.integers(1, 2**40)), max_size=40)), st.integers(0, 12))
def test_filters_give_back_what_they_count(entries, bucket_bits):
    if not entries:
        return
    grams, counts = np.array([g for g, _ in entries], np.uint64), np.array([c for _, c in entries], np.int64)
    got = Counter()
    for bucket, blob in collocations.filters(*collocations.merged(np.concatenate((grams, grams)), np.concatenate((counts, counts))), bucket_bits):
        for gram, count in zip(*collocations.decode(blob, bucket, bucket_bits)):
            got[tuple(gram.tolist())] += int(count)
    want = Counter()
    for g, c in entries:
        want[g] += 2 * c
    assert got == want


@given(st.lists(ids, min_size=1, max_size=20))
def test_permutation_can_be_undone(values):
    x = np.array(values, np.uint64)
    assert (collocations.unmixed(collocations.mixed(x)) == x).all()


def test_long_texts_are_cut_between_pieces():
    text = b"a b\n" * 10 + b"c " * 2_000_000 + b"\nd e"

    class Batch:
        num_rows = 1

        def column(self, i):
            import pyarrow as pa

            return pa.array(["en"]) if i == 0 else pa.array([text.decode()])

    parts = [chunk for _, chunk in collocations._chunks([Batch()])]
    pieces = lambda x: [p for p in x.split(b"\n") if p]
    assert [p for part in parts for p in pieces(part)] == pieces(text) and len(parts) > 1
