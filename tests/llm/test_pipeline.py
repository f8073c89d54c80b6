"""Every stage of the pipeline against a brute-force version on what the stage before kept."""

from collections import Counter

import public_tokenizers
import pytest

from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from shelfmark.llm import mixing, packing, quality
from shelfmark.llm.common import materialise, table
from tests.llm.odd import no_documents, odd_documents
from tests.llm.test_operators import check_packed, classes, deduped, slow_fingerprint


@pytest.fixture(scope="module")
def steps(spark, data):
    docs = [table(spark, data, "documents")]
    for name, stage in pipeline.STAGES:
        docs.append(materialise(stage(spark, docs[-1], data), name))
    return docs


def rows(df):
    return Counter(map(tuple, df.select("doc_id", "text", "lang", "source", "n_chars").collect()))


def test_stages_keep_the_columns(steps):
    assert len(pipeline.STAGES) == 5 and all(s.columns == steps[0].columns for s in steps[:-1])


def test_quality_stage(spark, data, steps):
    good = {r["doc_id"] for r in quality.score_quality(steps[0], table(spark, data, "labels")).filter("predicted = 1").collect()}
    assert rows(steps[1]) == Counter({r: n for r, n in rows(steps[0]).items() if r[0] in good})


def test_line_stage(steps):
    before = rows(steps[1])
    clean = deduped([r[:2] for r in before])
    assert rows(steps[2]) == Counter({(i, clean[i, t], lang, src, len(clean[i, t])): n for (i, t, lang, src, _), n in before.items()})


def test_near_copy_stage(steps):
    before, after = rows(steps[2]), rows(steps[3])
    prints = {r: slow_fingerprint(r[1]) for r in before}
    of = classes(prints.values())
    least = {}
    for r, p in prints.items():
        least[of[p]] = min(least.get(of[p], r[0]), r[0])
    assert after == Counter({r: 1 for r, p in prints.items() if r[0] == least[of[p]]})


def test_mixing_stage(steps):
    copies = {r["doc_id"]: r["copies"] for r in mixing.mix(steps[3]).collect()}
    assert rows(steps[4]) == Counter({r: copies[r[0]] for r in rows(steps[3]) if copies[r[0]]})


def test_packing_stage(steps):
    encoder = packing.Encoder(public_tokenizers.path(packing.VOCABULARY))
    check_packed(steps[5].collect(), encoder, [r[1] for r, n in rows(steps[4]).items() for _ in range(n)], packing.CAPACITY)


def test_run(spark, data, steps):
    assert pipeline.run(spark, data).count() == steps[5].count()


def test_stages_on_empty_tables(spark, data, steps):
    docs = no_documents(spark)
    for _, stage in pipeline.STAGES:
        docs = materialise(stage(spark, docs, data), "none")
        assert docs.count() == 0
    assert docs.columns == steps[5].columns


def test_stages_on_odd_rows(spark, data, steps):
    """Nulls, empty and long texts, ties and repeats: each stage against the plain rule, on what the one before kept."""
    odd = odd_documents(spark)
    key = lambda df: Counter((r["doc_id"], r["text"]) for r in df.collect())
    scores = {(r["doc_id"], r["text"]): r["score"] for r in odd.select("doc_id", "text", quality.quality_score(F.col("text"), quality.train(odd, table(spark, data, "labels"))).alias("score")).collect()}
    good = materialise(pipeline.quality_classifier(spark, odd, data), "odd")
    assert key(good) == Counter({r: n for r, n in key(odd).items() if scores[r] >= 0.5})
    lined = materialise(pipeline.line_dedup(spark, odd, data), "odd")
    clean = deduped(list(key(odd)))
    want = Counter()
    for r, n in key(odd).items():
        want[r[0], clean[r]] += n
    assert key(lined) == want
    once = materialise(pipeline.simhash_near_dedup(spark, lined, data), "odd")
    prints = {r: slow_fingerprint(r[1]) for r in key(lined)}
    of = classes(prints.values())
    assert sorted(of[prints[r]] for r in key(once).elements()) == sorted(set(of.values()))
    mixed = materialise(pipeline.source_mixing(spark, odd, data), "odd")
    copies = Counter()
    for r in mixing.mix(odd).collect():
        copies[r["doc_id"]] += r["copies"]
    assert Counter(r["doc_id"] for r in mixed.collect()) == +copies
    encoder = packing.Encoder(public_tokenizers.path(packing.VOCABULARY))
    check_packed(pipeline.best_fit_packing(spark, odd, data).collect(), encoder, [r[1] for r in key(odd).elements()], packing.CAPACITY)
    assert all(s.columns == odd.columns for s in (good, lined, once, mixed))
