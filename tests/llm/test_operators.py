"""Each operator against a brute-force version, and on odd and empty tables."""

import hashlib
import math
import re
import time
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from shelfmark.llm import fingerprints, html, langid, lines, media, mixing, packing, quality, simhash, urls
from shelfmark.llm.common import table
from tests.llm.odd import TEXTS, no_documents, odd_documents

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def docs(spark, data):
    return table(spark, data, "documents")


@pytest.fixture(scope="module")
def texts(docs):
    return {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}


# ---- 1 mixing ----------------------------------------------------------------


def targets(sizes, weights=(5, 2, 1), cap=3):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, full = sum(sizes.values()), set()
    while True:
        left = total - sum(cap * sizes[s] for s in full)
        open_ = [s for s in names if s not in full]
        level = left / sum(weight[s] for s in open_) if open_ and total else 0
        over = {s for s in open_ if level * weight[s] >= cap * sizes[s]}
        if not over or not total:
            return {s: cap * sizes[s] if s in full else level * weight[s] for s in names}
        full |= over


def test_mixing_targets_and_totals(docs):
    rows = mixing.mix(docs).collect()
    sizes = Counter()
    for r in rows:
        sizes[r["source"]] += r["size"]
    want = targets(sizes)
    taken = Counter()
    for r in rows:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(want[r["source"]])
        assert r["taken"] % max(r["size"], 1) == 0 and r["taken"] <= 3 * r["size"]
        taken[r["source"]] += r["taken"]
    assert sum(want.values()) == pytest.approx(sum(sizes.values()))
    for s in sizes:
        assert abs(taken[s] - want[s]) <= max(r["size"] for r in rows if r["source"] == s)
    key = lambda r: (r["doc_id"], r["taken"])
    assert sorted(map(key, rows)) == sorted(map(key, mixing.mix(docs.repartition(7)).collect()))


def test_mixing_tree_of_small_leaves(docs):
    """With leaves of four rows the tree has several levels; every document gets one of the two whole numbers beside its rate."""
    rows = mixing.mix(docs, leaf=4).collect()
    for s in {r["source"] for r in rows}:
        mine = [r for r in rows if r["source"] == s]
        rate = min(3.0, mine[0]["target"] / mine[0]["source_size"])
        assert all(r["copies"] in (math.floor(rate), math.ceil(rate)) for r in mine)
        assert abs(sum(r["taken"] for r in mine) - mine[0]["target"]) <= max(r["size"] for r in mine)


def test_mixing_of_large_documents_keeps_to_the_words(spark):
    """Two documents that hold most of their source's words, beside small ones, and sources of few documents."""
    rows = [(k, "w " * n, "a") for k, n in enumerate([3_000, 2_000, *range(1, 61)])] + [(100 + k, "w " * (k % 90 + 5), s) for k in range(400) for s in ("b", "c", None)[k % 3 : k % 3 + 1]]
    mixed = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    for s in ("a", "b", "c", None):
        mine = [r for r in mixed if r["source"] == s]
        assert abs(sum(r["taken"] for r in mine) - mine[0]["target"]) <= (60 if s == "a" else 95)
    assert all(r["copies"] <= 3 for r in mixed)


@given(st.lists(st.integers(0, 5_000), max_size=40), st.lists(st.integers(1, mixing.UNIT - 1), min_size=1, max_size=3), st.integers(0, 1 << 60))
@settings(max_examples=120, deadline=None)
def test_sweep_keeps_the_words(sizes, fractions, seed):
    """Words stay, and of the documents with one fraction and with words at most one is left between none and all."""
    sizes = sorted(sizes, reverse=True)
    mass = [fractions[(seed + i) % len(fractions)] for i in range(len(sizes))]
    swept = mixing.sweep(sizes, mass, [seed + 7919 * i for i in range(len(sizes))])
    assert all(0 <= m <= mixing.UNIT for m in swept)
    before, after = (sum(m * n for m, n in zip(masses, sizes)) / mixing.UNIT for masses in (mass, swept))
    assert after == pytest.approx(before, abs=1e-3)
    for f in set(mass):
        assert sum(1 for m, n, old in zip(swept, sizes, mass) if old == f and n and 1e-6 < m / mixing.UNIT < 1 - 1e-6) <= 1


def test_sweep_is_fair():
    sizes, mass = [900, 500, 400, 300, 200, 200, 60, 1], [mixing.UNIT * 3 // 10] * 8
    runs = [mixing.sweep(sizes, mass, [k * 101 + i for i in range(8)]) for k in range(4000)]
    assert np.allclose(np.mean(runs, axis=0) / mixing.UNIT, 0.3, atol=0.03)


@given(st.lists(st.integers(0, mixing.UNIT - 1), max_size=40), st.integers(0, 5))
@settings(max_examples=60, deadline=None)
def test_pivot_keeps_the_sum(mass, level):
    won, left = mixing.pivot(list(mass), list(range(len(mass))), level)
    assert sum(won) * mixing.UNIT + sum(left) == sum(mass) and sum(1 for m in left if m) <= 1 and set(won) <= {0, 1}


def test_pivot_is_fair():
    hits = np.mean([mixing.pivot([mixing.UNIT // 4] * 4, [k * 31 + i for i in range(4)], 0)[0] for k in range(3000)], axis=0)
    assert np.allclose(hits, 0.25, atol=0.04)


def test_mixing_odd_rows(spark):
    odd = odd_documents(spark)
    rows = mixing.mix(odd).collect()
    assert Counter((r["doc_id"], r["size"]) for r in rows) == Counter((i, len(WORD.findall(t or ""))) for i, t, *_ in TEXTS)
    mixed = mixing.mixture(odd)
    assert mixed.columns == odd.columns and mixed.count() == sum(r["copies"] for r in rows)
    assert mixing.mixture(no_documents(spark)).count() == 0 and mixing.mix(no_documents(spark)).count() == 0


def test_mixing_of_a_document_that_repeats(spark):
    """Rows alike are one unit: their copies differ by one at most and sum to what the unit gets."""
    rows = [(1, "one two three", "a", i) for i in range(500)] + [(None, "four five", "a", i) for i in range(301)] + [(i, "six " * (i % 9), "b", i) for i in range(2, 200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, other int").repartition(5)
    mixed = mixing.mix(docs).collect()
    copies = Counter()
    for r in mixed:
        copies[r["doc_id"]] += r["copies"]
    for i, n in ((1, 500), (None, 301)):
        mine = [r["copies"] for r in mixed if r["doc_id"] == i]
        rate = next(r["target"] / r["source_size"] for r in mixed if r["doc_id"] == i)
        assert len(mine) == n and max(mine) - min(mine) <= 1 and abs(sum(mine) - n * rate) <= 1
    taken = Counter(r["doc_id"] for r in mixing.mixture(docs).collect())
    assert taken == +copies
    assert max(Counter((r["doc_id"], r["other"]) for r in mixing.mixture(docs).collect()).values()) <= 3


# ---- 2 fingerprints ----------------------------------------------------------


def shingles(text, n):
    w = WORD.findall(text)
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def test_fingerprints_against_exact_likeness(docs, texts):
    rows = sorted(fingerprints.fingerprint_table(docs).collect(), key=lambda r: r["doc_id"])
    errors = []
    for i, r in enumerate(rows):
        text, after = texts[r["doc_id"]], texts[rows[(i + 1) % len(rows)]["doc_id"]]
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        assert r["n_chars"] == len(text) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        errors += [r["near_edited"] - jaccard(shingles(text, 5), shingles(edited, 5)), r["near_next"] - jaccard(shingles(text, 5), shingles(after, 5))]
    assert np.abs(errors).max() < 0.16 and abs(np.mean(errors)) < 0.01
    by_text = {}
    for r in rows:
        assert by_text.setdefault(texts[r["doc_id"]], r["fingerprint"]) == r["fingerprint"]


def test_next_document_across_slices(spark):
    """Every row meets the next in order, wherever slices are cut; rows alike are one document."""
    rows = [(i // 2 if i % 7 else None, f"text {i} " * (i % 5 + 1)) for i in range(120)]
    rows += rows[:10]
    order = sorted(set(rows), key=lambda r: (r[0] is not None, r[0] or 0))
    got = fingerprints.fingerprint_table(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert len(got) == len(rows)
    sha = lambda t, u: hashlib.sha256((t[: len(t) - len(t) // 2] + u[: len(t) // 2]).encode()).hexdigest()
    edits = Counter((r["doc_id"], r["edited_sha256"]) for r in got)
    for i, t in {r for r in rows if rows.count(r) > 1}:
        assert any(n > 1 for (j, _), n in edits.items() if j == i)
    alone = {i: t for i, t in order if i is not None and sum(j == i for j, _ in order) == 1}
    for k, (i, t) in enumerate(order):
        after = order[(k + 1) % len(order)]
        if i in alone and (after[0] in alone):
            assert edits[i, sha(t, after[1])]
    if len(set(rows)) > 1:
        one = fingerprints.fingerprint_table(spark.createDataFrame([(1, "a b c d e f")], "doc_id long, text string")).collect()
        assert one[0]["near_next"] == 1.0 and one[0]["edited_sha256"] == sha("a b c d e f", "a b c d e f")


def test_fingerprints_odd_rows(spark):
    rows = fingerprints.fingerprint_table(odd_documents(spark)).collect()
    assert len(rows) == len(TEXTS) and all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in rows)
    assert {r["fingerprint"] for r in rows if r["n_chars"] == 0} == {"00" * fingerprints.BINS}
    assert fingerprints.fingerprint_table(no_documents(spark)).count() == 0


# ---- 3 quality ---------------------------------------------------------------


def test_quality_on_held_out_labels(spark, docs, data):
    labels = table(spark, data, "labels")
    scored = {r["doc_id"]: r for r in quality.score_quality(docs, labels).collect()}
    assert len(scored) == docs.count()
    right = [scored[r["doc_id"]]["predicted"] == r["quality"] for r in labels.collect() if scored[r["doc_id"]]["held_out"]]
    assert np.mean(right) >= 0.85
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) for i, r in scored.items())


def test_quality_gradient():
    rng = np.random.default_rng(0)
    bags = [rng.normal(size=(rng.integers(1, 5), quality.FEATURES)) for _ in range(40)]
    labels = np.array([float(b[:, 2].max() > 0.8) for b in bags])
    before, after = quality.fit(bags, labels, epochs=1), quality.fit(bags, labels, epochs=200)
    loss = lambda m: -np.mean(np.log(np.where(labels == 1, quality.score_bags(m, bags), 1 - quality.score_bags(m, bags)) + 1e-9))
    assert loss(after) < 0.5 * loss(before)


def slow_scores(m, bag):
    """Gated attention over the passages of one document, in plain loops."""
    h = [np.tanh(((x - m["mean"]) / m["scale"]) @ m["encode"] + m["encode_bias"]) for x in bag]
    e = [sum(m["attend"][k] * np.tanh(v @ m["content"][:, k]) / (1 + np.exp(-(v @ m["gate"][:, k]))) for k in range(quality.GATES)) for v in h]
    a = np.exp(np.array(e) - max(e))
    z = sum(w * v for w, v in zip(a / a.sum(), h))
    return 1 / (1 + np.exp(-(z @ m["score"] + m["score_bias"][0])))


def test_quality_model_against_plain_loops():
    """Scores equal those of plain loops; one step of the descent moves along the loss's numeric gradient."""
    rng = np.random.default_rng(4)
    bags = [rng.normal(size=(k % 4 + 1, quality.FEATURES)) for k in range(12)]
    labels = np.array([float(b[:, 0].mean() > 0) for b in bags])
    m = quality.fit(bags, labels, epochs=30)
    assert np.allclose(quality.score_bags(m, bags), [slow_scores(m, b) for b in bags])

    def loss(model):
        p = np.array([slow_scores(model, b) for b in bags])
        return -np.mean(labels * np.log(p) + (1 - labels) * np.log(1 - p))

    start, one = quality.fit(bags, labels, epochs=0), quality.fit(bags, labels, epochs=1)
    for k in ("encode", "content", "gate", "attend", "score"):  # the first step of the optimiser has the gradient's signs
        flat = start[k].reshape(-1)
        for i in range(0, flat.size, max(1, flat.size // 5)):
            up = {**start, k: start[k].copy()}
            up[k].reshape(-1)[i] += 1e-5
            slope = (loss(up) - loss(start)) / 1e-5 + quality.DECAY * flat[i]
            moved = one[k].reshape(-1)[i] - flat[i]
            assert abs(slope) < 1e-4 or np.sign(moved) == -np.sign(slope)


def slow_passages(text):
    """Some of a passage's features, word by word."""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    for at in range(0, len(words), quality.PASSAGE):
        w = words[at : at + quality.PASSAGE]
        joined = "".join(w)
        letters = max(1, sum(c.isascii() and c.isalpha() for c in joined))
        yield len(set(w)) / len(w), sum(a == b for a, b in zip(w, w[1:])) / len(w), sum(c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ" for c in joined) / letters, sum(len(x.encode()) <= 3 for x in w) / len(w)


def test_quality_features_against_plain_words(texts):
    for text in [*list(texts.values())[:60], "A", "a a a B " * 50, "x\ty\nz " * 40]:
        rows = quality.passages(text)
        want = np.array(list(slow_passages(text)))
        assert len(rows) == max(1, len(want))
        if len(want):
            assert np.allclose(rows[:, [2, 3, 4, 9]], want, atol=1e-5)


def test_quality_odd_rows(spark):
    odd = odd_documents(spark)
    labels = spark.createDataFrame([(1, 1), (2, 1), (None, 0), (5, None), (7, 0), (7, 0)], "doc_id long, quality int")
    rows = quality.score_quality(odd, labels).collect()
    assert len(rows) == len(TEXTS) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in rows)
    none = labels.filter("false")
    assert {round(r["score"], 6) for r in quality.score_quality(odd, none).collect()} == {0.5}
    assert quality.drop_low_quality(odd, none).columns == odd.columns
    assert quality.score_quality(no_documents(spark), labels).count() == 0


# ---- 4 URLs ------------------------------------------------------------------


def judged(url):
    m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (re.sub("[A-Z]", lambda c: c[0].lower(), m[1]), m[2]) if m else ("", "")
    best = max(((h + p, v) for v, h, p in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)), key=lambda x: len(x[0]), default=(None, None))
    return host, path, *best


def test_url_rules_against_brute_force(spark, data):
    extra = [None, "", "no scheme", "http://", "HTTPS://WWW.Example.ORG/es/x?y#z", "http://org", "http://org/", "x://a.com/fr", "x://a.com/fr/", "x://b.example.org/en/15", "x://notexample.org/en/1", "x://com/de/?q", "x://a.b#c", "\n://\n.org/\n"]
    pages = table(spark, data, "pages").select("page_id", "url").unionByName(spark.createDataFrame([(-i, u) for i, u in enumerate(extra, 1)], "page_id long, url string"))
    given_urls = {r["page_id"]: r["url"] for r in pages.collect()}
    rows = urls.judge_urls(pages).collect()
    assert len(rows) == len(given_urls)
    for r in rows:
        host, path, rule, verdict = judged(given_urls[r["page_id"]])
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule)
        assert r["verdict"] == (verdict or ("block" if r["block_score"] >= 0.5 else "allow"))


def test_url_classifier(spark):
    hosts = [("casino-bets.example.net", "block"), ("m.cheap-casino.example.com", "block"), ("blog.adult-ads.example.net", "block"), ("library.example.net", "allow"), ("www.reading-station.example.com", "allow")]
    pages = spark.createDataFrame([(i, f"https://{h}/en/{i}7") for i, (h, _) in enumerate(hosts)], "page_id long, url string")
    assert [r["verdict"] for r in urls.judge_urls(pages).orderBy("page_id").collect()] == [v for _, v in hosts]
    assert urls.judge_urls(pages.filter("false")).count() == 0


def test_url_descent_against_plain_weights(spark):
    """The descent on coefficients of examples equals one on the weights themselves."""
    labelled = urls.LABELLED[::9]
    frame = spark.createDataFrame([(i, h, p) for i, (_, h, p) in enumerate(labelled)], "i int, host string, path string")
    rows = {r["i"]: r["g"] for r in frame.select("i", urls.grams(F.col("host"), F.col("path"), 512).alias("g")).collect()}
    x = np.stack([np.bincount(rows[i], minlength=512) for i in range(len(labelled))]).astype(float)
    x = np.hstack([x / np.linalg.norm(x, axis=1, keepdims=True), np.ones((len(x), 1))])
    y, w = np.array([float(v == "block") for v, *_ in labelled]), np.zeros(513)
    for _ in range(urls.EPOCHS):
        w = (1 - urls.RATE * urls.DECAY) * w + urls.RATE * x.T @ (y - 1 / (1 + np.exp(-(x @ w))))
    weights, intercept = urls.train(spark, labelled, 512)
    assert np.allclose(weights, w[:512]) and np.isclose(intercept, w[512])


def test_urls_odd_rows(spark):
    rows = [(1, "https://free-casino.example.com/x", "a", "b", 0.5), (1, "https://free-casino.example.com/x", "a", "b", 0.5), (None, None, None, None, None), (3, "x://" + "a" * 100_000 + "/de/", "", "", 1.0), (4, "", None, "c", 0.1)]
    pages = spark.createDataFrame(rows, "page_id long, url string, host string, verdict string, block_score double")
    got = urls.judge_urls(pages).collect()
    assert len(got) == 5 and {(r["host"], r["path"]) for r in got if r["page_id"] in (None, 4)} == {("", "")}
    assert len({tuple(r) for r in got if r["page_id"] == 1}) == 1 and all(r["verdict"] in ("allow", "block") and r["rule"] is None for r in got)


# ---- 5 lines -----------------------------------------------------------------


def deduped(rows):
    """(doc_id, text) -> text, by walking the documents in order."""
    seen, out = set(), {}
    for doc_id, text in sorted(set(rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        parts = (text or "").split("\n")
        keys = ["" if not p.strip(" ") else p for p in parts]
        gone = set()
        for i in range(len(parts) - 2):
            w = tuple(keys[i : i + 3])
            if any(w):
                gone |= {i, i + 1, i + 2} if w in seen else set()
                seen.add(w)
        out[doc_id, text] = text if not gone else "\n".join(p for i, p in enumerate(parts) if i not in gone)
    return out


def test_lines_against_brute_force(docs, texts):
    want = deduped(texts.items())
    got = {r["doc_id"]: r["text"] for r in lines.drop_repeated_lines(docs).collect()}
    assert got == {i: want[i, t] for i, t in texts.items()}
    report = {r["doc_id"]: r for r in lines.line_report(docs).collect()}
    for i, t in texts.items():
        assert report[i]["clean_sha256"] == hashlib.sha256(got[i].encode()).hexdigest() and report[i]["n_lines"] == len(t.split("\n"))


def test_lines_odd_rows(spark):
    odd = odd_documents(spark)
    out = lines.drop_repeated_lines(odd)
    assert out.columns == odd.columns
    rows = out.collect()
    assert Counter((r["doc_id"], r["text"]) for r in rows if r["doc_id"] != 2 and r["doc_id"] != 12) == Counter((i, t) for i, t, *_ in TEXTS if i != 2 and i != 12)
    assert {r["doc_id"]: r["text"] for r in rows if r["doc_id"] in (2, 12)} == {2: "And another end.", 12: "a"}
    assert lines.drop_repeated_lines(no_documents(spark)).count() == 0 and lines.line_report(no_documents(spark)).count() == 0


# ---- 6 HTML ------------------------------------------------------------------


@pytest.mark.parametrize(
    ("page", "want"),
    [
        (None, ""), ("", ""), ("<p></p>", ""), ("plain words only", "plain words only"), ("<article><h1>A &amp; B</h1><p>one\n two<br>three</p></article>", "A & B\none two\nthree"),
        ("<nav><a>Home</a></nav><div class='ad'>Buy now or never again my friend</div><article><p>Real <b>text</b> here</p></article><footer>Foot</footer>", "Real text here"),
        ("<article><p>one two three</p><div class='comments'><p>first!</p></div><p>four five six</p></article>", "one two three\nfour five six"),
        ("<script>var t='</p><p>no'</script><p>yes yes yes</p><style>p{}</style>", "yes yes yes"), ("<p>unclosed <b>bold <p>next &lt;p&gt;", "unclosed bold\nnext <p>"),
        ("<article><p>Lists</p><ul><li>Salt</li><li>Oil</li></ul></article><div><a>x</a></div>", "Lists\nSalt\nOil"), ("<!-- <p>hidden</p> --><p>shown is this</p>", "shown is this"),
    ],
)
def test_html_cases(page, want):
    assert html.main_text(page) == want


def test_html_extracts_whole_articles(spark, data):
    import html as h

    pages = {r["page_id"]: r["html"] for r in table(spark, data, "pages").collect()}
    rows = html.extract_text(table(spark, data, "pages")).collect()
    assert len(rows) == len(pages)
    for r in rows:
        body = re.search(r"(?s)<article>(.*?)</article>", pages[r["page_id"]])[1]
        blocks = (re.sub(r"\s+", " ", h.unescape(re.sub(r"</?b>", "", b))).strip() for b in re.split(r"</?(?:h1|p|br)>", body))
        assert r["text"] == "\n".join(filter(None, blocks)) and r["n_chars"] == len(r["text"])
    odd = spark.createDataFrame([(None, None, None, 1), (1, "u", "", 2), (1, "u", "<p>" * 50_000 + "deep words", 3)], "page_id long, url string, html string, text int")
    assert sorted(r["n_chars"] for r in html.extract_text(odd).collect()) == [0, 0, 10]


LONG = "words enough to carry the score of a page"


@pytest.mark.parametrize(
    ("page", "want"),
    [
        (f"<div class='content no-sidebar'><p>{LONG}</p></div>", LONG), (f"<div class='has-sidebar'><p>{LONG}</p></div>", LONG),
        (f"<article><h2 id='search-party'>A search</h2><p>{LONG}</p><section id='related-work'><h2 id='social-life'>Others</h2><p>{LONG}</p></section></article>", f"A search\n{LONG}\nOthers\n{LONG}"),
        (f"<article><h2 class='header'>Kept too</h2><p class='comment'>so is this</p><p>{LONG}</p></article>", f"Kept too\nso is this\n{LONG}"),
        (f"<article><p>{LONG} <a title='the hidden valley'>below the hill</a> and {LONG}</p></article>", f"{LONG} below the hill and {LONG}"),
        (f"<article><p>one <span hidden>gone</span> two</p><p hidden>gone<p>{LONG}</article>", f"one two\n{LONG}"),
        (f"<article><p>{LONG}</p><ul><li hidden>gone<ul><li>gone</li></ul><li>an item that is shown</ul></article>", f"{LONG}\nan item that is shown"),
        (f"<article><p>{LONG}</p><div class='x ad-banner'>gone</div><div class='site-footer'>gone</div><div id='Comments'>gone<div>gone</div></div><div style='display: none'>gone</div><div aria-hidden=true>gone</div><p>{LONG}</p></article>", f"{LONG}\n{LONG}"),
    ],
)
def test_html_leaves_out_only_what_is_named_whole(page, want):
    assert html.main_text(page) == want


@pytest.mark.parametrize(
    ("page", "want"),
    [
        (f"<article><h1>Title</h1><div><p>{LONG}</p></div><div>two words</div></article><div><a>Next</a></div>", f"Title\n{LONG}\ntwo words"),
        (f"<main><div>Title</div><div>{LONG}</div><ul><li><a>One</a></li><li><a>Two</a></li></ul></main>", f"Title\n{LONG}\nOne\nTwo"),
        (f"<body><div><div>Title</div><div>By A</div><div>{LONG}</div><div>{LONG}</div><div>The end</div></div></body>", f"Title\nBy A\n{LONG}\n{LONG}\nThe end"),
        (f"<body><div><div>{LONG}</div><ul><li><a>One</a></li><li><a>Two</a></li><li><a>Three</a></li></ul></div><div><ul><li><a>Next</a></li><li><a>Back</a></li></ul></div></body>", f"{LONG}\nOne\nTwo\nThree"),
        (f"<article><p><a>Linked</a></p><article><p>{LONG}</p></article><p>{LONG}</p><p><a>Last</a></p></article>", f"Linked\n{LONG}\n{LONG}\nLast"),
        (f"<h1>Before it</h1><article><p>{LONG}</p><p>Ann</article>", f"Before it\n{LONG}\nAnn"),
    ],
)
def test_html_keeps_short_first_and_last_blocks(page, want):
    assert html.main_text(page) == want


def test_html_header_of_an_article_and_of_the_site():
    page = f"<body><header><p>The Daily Page, since 1901</p></header><article><header><h1>Title</h1></header><p>{LONG}</p><footer>filed under</footer></article></body>"
    assert html.main_text(page) == f"Title\n{LONG}"
    assert html.main_text("<div class='ad'>only an advert</div>") == "only an advert"
    assert html.main_text(f"<article><p>one two <span class='share' hidden>x</span> three {LONG}</p></article>") == f"one two three {LONG}"


NOISE = "some words that belong to no article at all"
AROUND = ("comments-area", "comment-list", "user-comments", "reader-comments", "comment-body", "comment-content", "post-comments", "sidebar-left", "ad-slot", "ad_container", "cookie-bar", "related-posts", "article-share", "newsletter-signup", "post-navigation", "page-footer")


@pytest.mark.parametrize("name", AROUND)
def test_html_names_of_several_words_go(name):
    assert html.main_text(f"<article><h1>Title</h1><p>{LONG}</p><div class='{name}'><p>{NOISE}</p></div><p>{LONG}</p></article>") == f"Title\n{LONG}\n{LONG}"
    assert html.main_text(f"<main><h1>Title</h1><p>{LONG}</p><section class='x {name}'><ol><li>{NOISE}</li></ol></section></main>") == f"Title\n{LONG}"
    assert html.main_text(f"<div><h1>Title</h1><p>{LONG}</p><p>{LONG}</p></div><div class='{name}'><p>{NOISE}</p></div>") == f"Title\n{LONG}\n{LONG}"


@pytest.mark.parametrize(
    "name",
    ["has-sidebar", "no-sidebar", "post-header", "page-header", "content-area", "post-body", "entry-content", "article-text", "list-view", "left-column", "content-sidebar-wrap", "tag-ads", "ad-free", "story-body", "main-content", "body-text", "item-list"],
)
def test_html_names_of_several_words_stay(name):
    assert html.main_text(f"<div class='{name}'><h1>Title</h1><p>{LONG}</p><p>{LONG}</p></div><div class='footer'><p>{NOISE}</p></div>") == f"Title\n{LONG}\n{LONG}"


def test_html_words_around_names_say_nothing():
    """What labelled pages put before and behind names, around articles and in them alike, is learned to be harmless."""
    names = html.learned()["name"]
    assert all(names[f".{w}"] > html.TELLING for w in (*html.BEFORE, *html.BEHIND))
    kinds = (html.MENUS, html.HEADERS, html.ADVERTS, html.NOTICES, html.SIDEBARS, html.COMMENTS, html.FOOTERS)
    assert all(names[f".{w}"] <= html.TELLING for kind in kinds for w in kind if w and not w.startswith("<"))


def test_html_ids_of_headings_are_not_names():
    page = f"<article><h1>Title</h1><p>{LONG}</p><section id='{{}}'><p>{LONG}</p></section></article>"
    for slug in ("related-work", "search-algorithms", "comments-on-method"):
        assert html.main_text(page.format(slug)) == f"Title\n{LONG}\n{LONG}"
    assert html.main_text(page.format("comment-list")) == f"Title\n{LONG}"


def articles_of(pages):
    import html as h

    for page in pages:
        body = re.search(r"(?s)<article>(.*?)</article>", page)[1]
        blocks = (re.sub(r"\s+", " ", h.unescape(re.sub(r"</?b>", "", b))).strip() for b in re.split(r"</?(?:h1|p|br)>", body))
        plain = re.sub(r"<(/?)(article|nav|footer)>", r"<\1div>", page).replace(' class="ad"', "")
        yield plain, "\n".join(filter(None, blocks))


def test_html_scan_decides_where_nothing_is_named(spark, data, monkeypatch):
    """Pages of nothing but divs: the scan finds the articles, and without it none is right."""
    pages = list(articles_of(r["html"] for r in table(spark, "/root/testdata/sf0.01", "pages").collect()))
    unnamed = html.learned() | {"name": {}}
    for weights in (html.learned(), unnamed):
        assert np.mean([html.main_text(page, weights) == want for page, want in pages]) >= 0.9
    monkeypatch.setattr(html, "best_run", lambda words, gaps: (0, len(words), 1.0))
    assert np.mean([html.main_text(page) == want for page, want in pages]) < 0.1


@given(st.lists(st.tuples(st.integers(-9, 9), st.integers(-9, 0)), max_size=14))
@settings(max_examples=200, deadline=None)
def test_html_best_run_against_all_runs(pairs):
    words, gaps = [w for w, _ in pairs], [g for _, g in pairs]
    of = lambda i, j: sum(words[i:j]) + sum(gaps[i + 1 : j])
    best = max([of(i, j) for i in range(len(words)) for j in range(i + 1, len(words) + 1)], default=0)
    first, behind, total = html.best_run(words, gaps)
    assert total == max(best, 0) and (not total or of(first, behind) == total)


def test_html_weights_of_labelled_pages():
    """On the labelled pages the regression tells blocks apart, tags are negative, and most best runs are the articles."""
    weights, right = html.learned(), []
    assert max(weights["tag"].values()) < 0
    for blocks, marks in html.labelled():
        words, gaps = html.scores(blocks, weights)
        first, behind, _ = html.best_run(words, gaps)
        chosen = [first <= i < behind and w > 0 for i, w in enumerate(words)]
        right.append(np.mean([c == m for c, m in zip(chosen, marks)]))
    assert np.mean(right) > 0.9


@pytest.mark.parametrize("broken", ["<a ", "<p>", '<a "', "<!-- ", "<div", "a<b ", "<div class='x'>", "</div>"])
def test_html_reads_broken_pages_in_linear_time(broken):
    took = []
    for size in (250_000, 1_000_000):
        page = "<article><p>some words</p>" + broken * (size // len(broken))
        start = time.process_time()
        html.main_text(page)
        took.append(time.process_time() - start)
    assert took[1] < 8 * took[0] + 0.5


# ---- 7 languages -------------------------------------------------------------


def test_languages_held_out(docs):
    want = {r["doc_id"]: r["lang"] for r in docs.collect()}
    rows = langid.identify(docs).collect()
    assert len(rows) == len(want) and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    assert np.mean([r["lang_pred"] == want[r["doc_id"]] for r in rows if r["held_out"]]) >= 0.9


def test_languages_odd_rows(spark):
    rows = langid.identify(odd_documents(spark)).collect()
    assert len(rows) == len(TEXTS) and sum(r["lang_pred"] == "und" for r in rows) == 5
    nothing = odd_documents(spark).filter("lang is null")
    assert {r["lang_pred"] for r in langid.identify(nothing).collect()} == {"und"} and langid.identify(no_documents(spark)).count() == 0


def slow_ftrl(samples, classes, epochs):
    """The update rule of one coordinate at a time, as published, in plain loops."""
    z, n, bias, bias_n = {}, {}, [0.0] * classes, [0.0] * classes

    def weight(k):
        zk, nk = z.get(k, 0.0), n.get(k, 0.0)
        if abs(zk) <= langid.L1:
            return 0.0
        return -(zk - (langid.L1 if zk > 0 else -langid.L1)) / ((langid.BETA + nk**0.5) / langid.ALPHA + langid.L2)

    for epoch in range(epochs):
        for i in np.random.default_rng(epoch).permutation(len(samples)):
            ids, x, label = samples[i]
            w = {(f, c): weight((f, c)) for f in ids for c in range(classes)}
            logit = [sum(v * w[f, c] for f, v in zip(ids, x)) + bias[c] for c in range(classes)]
            e = [np.exp(v - max(logit)) for v in logit]
            for c in range(classes):
                p = e[c] / sum(e) - (c == label)
                for f, v in zip(ids, x):
                    g, old = v * p, n.get((f, c), 0.0)
                    n[f, c] = old + g * g
                    z[f, c] = z.get((f, c), 0.0) + g - (n[f, c] ** 0.5 - old**0.5) / langid.ALPHA * w[f, c]
                bias_n[c] += p * p
                bias[c] -= 0.1 * p / (1 + bias_n[c] ** 0.5)
    return {k: weight(k) for k in z}, bias


def test_ftrl_against_plain_loops():
    rng = np.random.default_rng(2)
    samples = [(np.unique(rng.integers(0, 40, 6)), None, int(rng.integers(3))) for _ in range(30)]
    samples = [(np.append(i, 41), np.append(rng.random(len(i)) * 3, 1e-4), label) for i, _, label in samples]
    weights, bias = langid.ftrl(samples, 3, epochs=2)
    slow, slow_bias = slow_ftrl(samples, 3, 2)
    assert np.allclose(bias, slow_bias) and all(np.isclose(weights[k], v) for k, v in slow.items())
    assert np.count_nonzero(weights) == sum(v != 0 for v in slow.values()) and not weights[41].any()


def test_languages_learn_from_rows_without_id(spark):
    words = {"en": "the house and the river", "de": "das haus und der fluss"}
    docs = spark.createDataFrame([(None, f"{words[k]} {i % 7} {'x' * (i % 3)}", k) for i in range(60) for k in words], "doc_id long, text string, lang string")
    rows = langid.identify(docs).collect()
    assert len(rows) == 120 and {r["lang_pred"] for r in rows} == set(words) and not any(r["held_out"] for r in rows)


def test_temperature_softens_overconfidence():
    logits = np.array([[8.0, 0.0]] * 10)
    assert langid.calibrate(logits, np.array([0] * 7 + [1] * 3)) > 2


# ---- 8 SimHash ---------------------------------------------------------------


def slow_fingerprint(text):
    words = WORD.findall(re.sub("[A-Z]", lambda c: c[0].lower(), text or ""))
    all_shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in all_shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(prints):
    """fingerprint -> a representative, by comparing all pairs."""
    u = np.array(sorted(set(prints)), np.uint64)
    of = {int(x): int(x) for x in u}

    def root(x):
        while of[x] != x:
            x = of[x]
        return x

    for i, x in enumerate(u):
        for y in u[i + 1 :][np.bitwise_count(u[i + 1 :] ^ x) <= 4]:
            of[root(int(y))] = root(int(x))
    return {x: root(x) for x in of}


@pytest.mark.parametrize("options", [{}, {"piece": 16}])
def test_simhash_against_all_pairs(docs, texts, options):
    prints = {i: slow_fingerprint(t) for i, t in texts.items()}
    assert all(simhash.fingerprint(t) == prints[i] for i, t in texts.items())
    of = classes(prints.values())
    least = {}
    for i, p in prints.items():
        least[of[p]] = min(i, least.get(of[p], i))
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(docs, **options).collect()}
    assert got == {i: least[of[p]] for i, p in prints.items()}


@pytest.mark.parametrize("piece", [simhash.PIECE, 8])
def test_links_find_every_close_pair(spark, piece):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 64, 60, np.uint64, endpoint=False)
    prints = set(map(int, base))
    for b in base[:40]:
        for n in range(1, 7):
            prints.add(int(b) ^ sum(1 << int(i) for i in rng.choice(64, n, replace=False)))
    for n in range(1, 30):  # a chain and a dense ball
        prints |= {(1 << n) - 1, 1 << n}
    frame = spark.createDataFrame([(int(np.uint64(p).astype(np.int64)),) for p in prints], "fp long")
    edges = simhash.links(frame, piece=piece)
    of = classes(prints)
    mask = (1 << 64) - 1
    roots = {r["node"] & mask: r["root"] & mask for r in simhash.components(edges).collect()}
    mine = {p: roots.get(p, p) for p in prints}
    assert len(set(zip((of[p] for p in prints), (mine[p] for p in prints)))) == len(set(of.values())) == len(set(mine.values()))


def test_close_prints_meet_at_an_anchor():
    """Random pairs within four bits share an anchor, wherever the bits are."""
    rng = np.random.default_rng(5)
    x = rng.integers(0, 1 << 64, 3000, np.uint64, endpoint=False)
    y = np.array([int(b) ^ sum(1 << int(i) for i in rng.choice(64, rng.integers(1, 5), replace=False)) for b in x], np.uint64)
    at = [set(zip(*map(np.ndarray.tolist, simhash.anchors(p)))) for p in (x, y)]
    assert {i for i, _ in at[0] & at[1]} == set(range(3000)) and len(at[0]) < 33 * 3000


def test_components_of_a_chain_take_few_rounds(spark, monkeypatch):
    """A chain whose numbers are in order, a star and a ring: one root each, in about log n rounds."""
    names = []
    keep = simhash.written
    monkeypatch.setattr(simhash, "written", lambda df, name: names.append(name) or keep(df, name))
    chain = [(i, i + 1) for i in range(1000)]
    star = [(5000, 5000 + i) for i in range(1, 300)]
    ring = [(9000 + i, 9000 + (i + 1) % 50) for i in range(50)]
    rows = simhash.components(spark.createDataFrame(chain + star + ring, "a long, b long")).collect()
    roots = {}
    for r in rows:
        roots.setdefault(r["root"], set()).add(r["node"])
    assert sorted(map(len, roots.values())) == [50, 300, 1001]
    assert names.count("hops") <= 12


def test_golay_code_covers_everything():
    values = np.random.default_rng(1).integers(0, 1 << 23, 20_000).astype(np.uint32)
    low, high, error = simhash._code()
    wrong = error[low[values & 0xFFF] ^ high[values >> 12]]
    assert np.bitwise_count(wrong).max() == 3
    code = values ^ wrong
    assert not (low[code & 0xFFF] ^ high[code >> 12]).any()


def test_simhash_odd_rows(spark):
    odd = odd_documents(spark)
    rows = simhash.simhash_components(odd).collect()
    assert len(rows) == len(TEXTS)
    assert {r["component_id"] for r in rows if r["fingerprint"] == "0" * 16} == {3}
    kept = simhash.drop_near_duplicates(odd)
    assert kept.columns == odd.columns and kept.count() == len({(r["fingerprint"]) for r in rows})
    assert simhash.simhash_components(no_documents(spark)).count() == 0 and simhash.drop_near_duplicates(no_documents(spark)).count() == 0


# ---- 9 packing ---------------------------------------------------------------


@pytest.fixture(scope="module")
def encoder():
    return packing.Encoder(public_tokenizers.path(packing.VOCABULARY))


def ids_of(encoder, text):
    return [*encoder.tokenizer.encode(text or "", add_special_tokens=False).ids, packing.END_ID]


def check_packed(rows, encoder, wanted, capacity):
    """Pieces are the documents' tokens; sequences are gapless and not too long."""
    pieces = Counter()
    for text in wanted:
        ids = ids_of(encoder, text)
        for k in range(0, len(ids), capacity):
            part = ids[k : k + capacity]
            pieces[k // capacity, k, len(part), zlib.crc32(np.array(part, "<u4").tobytes())] += 1
    assert Counter((r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == pieces
    held = {}
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == held.get(r["sequence_id"], 0)
        held[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(held.values(), default=0) <= capacity
    return len(held)


def test_packing_round_trip(docs, texts, encoder):
    rows = packing.pack(docs).collect()
    n = check_packed(rows, encoder, texts.values(), packing.CAPACITY)
    assert n <= 1.02 * -(-sum(r["length"] for r in rows) // packing.CAPACITY) + 1


def test_packing_odd_rows(spark, encoder):
    check_packed(packing.pack(odd_documents(spark), 64).collect(), encoder, [t for _, t, *_ in TEXTS], 64)
    assert packing.pack(no_documents(spark)).count() == 0


def best_fit_by_rounds(lengths, capacity):
    """Supersteps in plain loops: each gap takes the largest piece that wants it; the number of sequences, and the fill of each."""
    left, gaps, opened, fits = sorted(lengths, reverse=True), [], 0, False
    while left:
        if not fits:
            new = -(-sum(left) // capacity)
            gaps, opened = gaps + [capacity] * new, opened + new
        rest, narrowed = [], []
        for x in left:
            mine = min((g for g in gaps if g >= x), default=None)
            if mine is None:
                rest.append(x)
            else:
                gaps.remove(mine)
                narrowed.append(mine - x)
        fits = len(rest) < len(left) and any(g >= rest[-1] for g in gaps + narrowed) if rest else False
        left, gaps = rest, gaps + narrowed
    return opened, sorted(gaps)


@pytest.mark.parametrize("slice_rows", [1 << 16, 300, 40, 1])
def test_supersteps_against_plain_best_fit(spark, slice_rows):
    """In one slice and over many: as many sequences as plain loops, and the same gaps left."""
    rng = np.random.default_rng(8)
    lengths = [*rng.integers(1, 65, 300).tolist(), *[64] * 9, *[1] * 30, *[33] * 20]
    rows = spark.createDataFrame([(i, 0, 0, n, i) for i, n in enumerate(lengths)], "doc_id long, piece int, start long, length long, ids_crc32 long")
    placed = packing.place_pieces(rows, 64, slice_rows).collect()
    held = {}
    for r in sorted(placed, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == held.get(r["sequence_id"], 0)
        held[r["sequence_id"]] = r["offset"] + r["length"]
    opened, gaps = best_fit_by_rounds(lengths, 64)
    assert len(placed) == len(lengths) and sorted(r["length"] for r in placed) == sorted(lengths)
    assert len(held) == opened and sorted(64 - n for n in held.values()) == gaps


@given(st.lists(st.tuples(st.integers(1, 9), st.booleans()), max_size=40), st.lists(st.integers(0, 40), max_size=4))
@settings(max_examples=200, deadline=None)
def test_sweep_matches_brackets(elements, cuts):
    """A sweep gives every piece the smallest free gap, largest pieces first; cut into slices, what is left has the heights of the whole."""
    elements.sort(key=lambda e: (-e[0], e[1]))
    sizes, kinds = [n for n, _ in elements], [k for _, k in elements]
    found, alone, left = packing.sweep(sizes, kinds, list(range(len(sizes))))
    free, want = [i for i, k in enumerate(kinds) if not k], {}
    for i in (i for i, k in enumerate(kinds) if k):
        mine = min((sizes[g] for g in free if sizes[g] >= sizes[i]), default=None)
        if mine is not None:
            want[i] = mine
            free.remove(next(g for g in reversed(free) if sizes[g] == mine))
    assert {i: g for i, (_, g) in found.items()} == want and sorted(left) == free and not set(alone) & set(want)


def test_words_encode_like_the_tokenizer(encoder, texts):
    odd = ["", "a", "<|endoftext|>", "x<|startoftext|>y", "ΣΑΣ", "İi", "ǅ", "é", "don't", "we'll", "I'M", "123abc", "\x1c\x1dq", "ﬁ", "日本語", "👩‍👩‍👧", "'s", "×÷", "ß", "...", "#%&'s", "a\u0301", "\u0345"]
    words = {w for t in texts.values() for w in t.replace("\n", " ").split(" ")} | {c + s for c in map(chr, range(33, 0x250)) for s in ("", "'S", "1")} | set(odd)
    words = sorted(words)
    want = encoder.tokenizer.encode_batch(words, add_special_tokens=False)
    assert [w for w, e in zip(words, want) if np.frombuffer(encoder.word(w), "<u4").tolist() != e.ids] == []
    for t in [*texts.values(), " ".join(odd), "\n\n".join(odd)]:
        assert np.frombuffer(encoder.ids(t), "<u4").tolist() == encoder.tokenizer.encode(t, add_special_tokens=False).ids


# ---- 10 media ----------------------------------------------------------------


@given(st.binary(max_size=9000), st.sampled_from([media.XIPH, media.FIXED, media.EBML_LACING, media.NO_LACING]), st.integers(1, 700))
@settings(max_examples=80, deadline=None)
def test_matroska_round_trip(payload, lacing, frame):
    if lacing == media.NO_LACING:
        stored = media.mux(payload, frame=frame)
    else:
        stored = media.mux(payload, frame=frame, lacing=lacing)
    assert media.read_payload(stored) == payload
    found = media.packets(stored)
    assert [p[3] for p in found] == [len(payload[i : i + frame]) for i in range(0, len(payload), frame)]
    assert [p[1] for p in found] == sorted(p[1] for p in found)
    segment = stored.index(media._id(media.SEGMENT))
    _, body, _ = media.read_vint(stored, segment + 4)
    for _, track, at in media.cue_points(stored):
        assert track == 1 and stored[body + at : body + at + 4] == media._id(media.CLUSTER)


def test_matroska_of_unknown_sizes_and_block_groups():
    unknown = b"\x01" + b"\xff" * 7
    block = media.vint(2) + b"\x00\x05\x00" + b"abc"
    group = media.element(media.BLOCK_GROUP, media.element(media.BLOCK, block) + media.element(media.BLOCK_DURATION, b"\x01"))
    clusters = b"".join(media._id(media.CLUSTER) + unknown + media.element(media.TIMESTAMP, bytes([t])) + group for t in (10, 20))
    stored = media._id(media.SEGMENT) + unknown + clusters
    assert [(t, ms, stored[a : a + n]) for t, ms, a, n, _ in media.packets(stored)] == [(2, 15, b"abc"), (2, 25, b"abc")]


def test_matroska_key_frames_of_block_groups():
    """A group's block is a key frame unless the group refers to another frame, before or behind the block; only that group changes."""
    block = media.element(media.BLOCK, media.vint(1) + b"\x00\x00\x00" + b"abc")
    refers = media.element(media.REFERENCE_BLOCK, b"\xff")
    groups = b"".join(media.element(media.BLOCK_GROUP, body) for body in (block, block + refers, refers + block, block))
    stored = media.element(media.SEGMENT, media.element(media.CLUSTER, media.element(media.TIMESTAMP, b"\x01") + groups))
    assert [key for *_, key in media.packets(stored)] == [True, False, False, True]
    simple = media.element(media.SIMPLE_BLOCK, media.vint(1) + b"\x00\x00\x80" + b"abc")
    assert [key for *_, key in media.packets(media.element(media.SEGMENT, media.element(media.CLUSTER, groups + simple)))][-1]


def test_media_digest(spark, docs, texts):
    for r in media.media_digest(docs).collect():
        payload, n = media.payload_of(texts[r["doc_id"]])
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
        assert r["payload_bytes"] % 192 == 0 and r["payload_bytes"] >= max(n, 192)
    odd = odd_documents(spark)
    assert media.media_digest(odd).count() == len(TEXTS) and media.media_digest(no_documents(spark)).count() == 0
    stored = media.to_media(odd.filter("doc_id <= 2").select("doc_id", "text"))
    rows = media.packet_table(stored, "doc_id").collect()
    assert {(r["doc_id"], r["packet"], r["track"], r["byte_length"]) for r in rows} == {(1, 0, 1, 192), (2, 0, 1, 192)}


def test_packets_of_cut_and_broken_files(spark):
    """Whatever a file is cut to, its packets are the first of the whole file's; damaged bytes never fail the job."""
    stored = media.mux(bytes(range(256)) * 30, lacing=media.XIPH)
    whole = media.packets(stored)
    for at in range(0, len(stored), 7):
        found = media.readable_packets(stored[:at])
        assert [p[:3] for p in found] == [p[:3] for p in whole[: len(found)]]
    rng = np.random.default_rng(6)
    files = [None, b"", b"\x00" * 9, *(bytes(b ^ (rng.random() < 0.02) * int(rng.integers(256)) for b in stored) for _ in range(40))]
    rows = media.packet_table(spark.createDataFrame([(i, f) for i, f in enumerate(files)] + [(99, stored)], "k long, media binary"), "k").collect()
    assert sum(r["k"] == 99 for r in rows) == len(whole) and not any(r["k"] < 3 for r in rows)
