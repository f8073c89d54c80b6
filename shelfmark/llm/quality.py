"""Quality classifier: attention-based multiple-instance learning.

A document is a bag of passages of ``PASSAGE`` words; only the bag has a label. Each
passage is described by its shape (letter case, symbols, repeats, word lengths), encoded
by a small layer, weighted by gated attention, and the weighted mean of the encodings is
scored. Gradient descent over every passage of at most ``FIT_DOCUMENTS`` labelled documents
fits encoder, attention and score together; scoring reads every passage of every document.

Nulls and edge cases: a null or empty text is one passage without words. Labels that are
null are left out; without labels of both kinds every score is the share of label 1 (0.5
without any). Repeated rows get equal scores, and rows alike in id and text are learned from once; an empty table gives an empty result; extra
columns are dropped by ``score_quality`` and kept by ``drop_low_quality``.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.common import fresh_names, row_hash

PASSAGE = 64
FIT_DOCUMENTS = 4000
EPOCHS = 300
HIDDEN, GATES = 16, 8
LEARNING_RATE, DECAY = 0.02, 1e-4
FOLDS, HELD_OUT = 3, 1
FEATURES = 12

# Byte classes: 0 other, 1 a-z, 2 A-Z, 3 digit, 4 white space, 5 sentence mark, 6 symbol, 7 first byte beyond ASCII.
_CLASS = np.zeros(256, np.uint8)
_CLASS[ord("a") : ord("z") + 1], _CLASS[ord("A") : ord("Z") + 1], _CLASS[ord("0") : ord("9") + 1] = 1, 2, 3
_CLASS[[9, 10, 11, 12, 13, 32]], _CLASS[[ord(c) for c in ".,;:?'\"()-"]] = 4, 5
_CLASS[[ord(c) for c in "!#$%&*+/<=>@[\\]^_`{|}~"]], _CLASS[0xC0:] = 6, 7
_PLACE = np.random.default_rng(7).integers(1, 1 << 63, 64, np.int64).astype(np.uint64) | np.uint64(1)


def passages(text: str | None) -> np.ndarray:
    """A row of shape features for each passage of the whole text."""
    data = np.frombuffer((text or "").encode("utf-8"), np.uint8)
    kind = _CLASS[data]
    inside = np.concatenate(([False], kind != 4))
    starts = np.nonzero(inside[1:] & ~inside[:-1])[0]
    if not len(starts):
        return np.zeros((1, FEATURES), np.float32)
    first = np.arange(0, len(starts), PASSAGE)
    edges = starts[first]
    words = np.diff(np.append(first, len(starts))).astype(np.float32)
    counts = np.stack([np.add.reduceat((kind == k), edges, dtype=np.int64) for k in range(1, 8)], axis=1).astype(np.float32)
    lower, upper, digit, space, mark, symbol, wide = counts.T
    chars = np.maximum(counts.sum(axis=1) - space, 1)
    letters = np.maximum(lower + upper, 1)
    begun = np.zeros(len(data), np.int64)
    begun[starts] = starts
    place = np.arange(len(data)) - np.maximum.accumulate(begun)
    value = np.where(kind == 4, 0, data.astype(np.uint64) + 1) * _PLACE[place & 63]
    word = np.add.reduceat(value, starts, dtype=np.uint64)
    same = np.concatenate(([False], word[1:] == word[:-1]))
    same[first] = False
    of = np.repeat(np.arange(len(first)), words.astype(np.int64))
    order = np.lexsort((word, of))
    w, o = word[order], of[order]
    new = np.concatenate(([True], (w[1:] != w[:-1]) | (o[1:] != o[:-1])))
    distinct = np.bincount(o[new], minlength=len(first))
    length = np.add.reduceat(kind != 4, starts, dtype=np.int64)
    short = np.add.reduceat(length <= 3, first, dtype=np.int64)
    single = np.add.reduceat((length == 1) & (kind[starts] == 6), first, dtype=np.int64)
    last = kind[starts + length - 1]
    ends_in_symbol = np.add.reduceat(last == 6, first, dtype=np.int64)
    return np.stack(
        [
            np.log1p(words) / np.log(PASSAGE + 1), chars / words / 10, distinct / words, np.add.reduceat(same, first, dtype=np.int64) / words,
            upper / letters, digit / chars, mark / chars, symbol / chars, wide / chars, short / words, single / words, ends_in_symbol / words,
        ],
        axis=1,
    ).astype(np.float32)


# ---- model -------------------------------------------------------------------


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def _forward(m: dict[str, np.ndarray], x: np.ndarray, first: np.ndarray, size: np.ndarray) -> dict[str, np.ndarray]:
    """first, size: where each document's passages begin and how many there are."""
    h = np.tanh(((x - m["mean"]) / m["scale"]) @ m["encode"] + m["encode_bias"])
    t, s = np.tanh(h @ m["content"]), _sigmoid(h @ m["gate"])
    e = (t * s) @ m["attend"]
    e = np.exp(e - np.repeat(np.maximum.reduceat(e, first), size))
    a = e / np.repeat(np.add.reduceat(e, first), size)
    z = np.add.reduceat(a[:, None] * h, first, axis=0)
    return {"h": h, "t": t, "s": s, "a": a, "z": z, "score": _sigmoid(z @ m["score"] + m["score_bias"])}


def fit(bags: list[np.ndarray], labels: np.ndarray, epochs: int = EPOCHS, seed: int = 1) -> dict[str, np.ndarray]:
    """Weights learned from bags of passage features and one 0/1 label a bag."""
    labels = np.asarray(labels, np.float64)
    rng = np.random.default_rng(seed)
    x = np.concatenate([b.astype(np.float64) for b in bags]) if bags else np.zeros((1, FEATURES))
    draw = lambda *shape: rng.normal(0, 1 / np.sqrt(shape[0]), shape)
    m = {"mean": x.mean(axis=0), "scale": x.std(axis=0) + 1e-3, "encode": draw(FEATURES, HIDDEN), "encode_bias": np.zeros(HIDDEN), "content": draw(HIDDEN, GATES), "gate": draw(HIDDEN, GATES), "attend": draw(GATES), "score": draw(HIDDEN), "score_bias": np.zeros(1)}
    if len(set(labels.tolist())) < 2:
        share = (labels.mean() * len(labels) + 0.5) / (len(labels) + 1) if len(labels) else 0.5
        return m | {"score": np.zeros(HIDDEN), "score_bias": np.array([np.log(share / (1 - share))])}
    size = np.array([len(b) for b in bags])
    first = np.concatenate(([0], np.cumsum(size)[:-1]))
    scaled = (x - m["mean"]) / m["scale"]
    learned = ("encode", "encode_bias", "content", "gate", "attend", "score", "score_bias")
    one, two = {k: np.zeros_like(m[k]) for k in learned}, {k: np.zeros_like(m[k]) for k in learned}
    for step in range(1, epochs + 1):
        f = _forward(m, x, first, size)
        h, t, s, a = f["h"], f["t"], f["s"], f["a"]
        g = (f["score"] - labels) / len(labels)
        per = np.repeat(g, size)
        pull = per * (h @ m["score"])
        de = a * (pull - np.repeat(np.add.reduceat(a * pull, first), size))
        dgate = de[:, None] * m["attend"][None, :]
        dt, ds = dgate * s * (1 - t * t), dgate * t * s * (1 - s)
        dh = (a * per)[:, None] * m["score"][None, :] + dt @ m["content"].T + ds @ m["gate"].T
        da = dh * (1 - h * h)
        grad = {"encode": scaled.T @ da, "encode_bias": da.sum(axis=0), "content": h.T @ dt, "gate": h.T @ ds, "attend": (t * s).T @ de, "score": f["z"].T @ g, "score_bias": np.array([g.sum()])}
        for k in learned:
            d = grad[k] + DECAY * m[k]
            one[k] = 0.9 * one[k] + 0.1 * d
            two[k] = 0.999 * two[k] + 0.001 * d * d
            m[k] = m[k] - LEARNING_RATE * (one[k] / (1 - 0.9**step)) / (np.sqrt(two[k] / (1 - 0.999**step)) + 1e-8)
    return m


def score_bags(model: dict[str, np.ndarray], bags: list[np.ndarray]) -> np.ndarray:
    size = np.array([len(b) for b in bags])
    return _forward(model, np.concatenate(bags).astype(np.float64), np.concatenate(([0], np.cumsum(size)[:-1])), size)["score"]


# ---- tables ------------------------------------------------------------------


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % FOLDS == HELD_OUT, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, fit_documents: int = FIT_DOCUMENTS) -> dict[str, np.ndarray]:
    """Fits on labelled documents outside the held-out fold, those of the least hashes of their ids and texts."""
    usable = labels.filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    texts = docs.select("doc_id", "text", row_hash().alias("text_hash"))
    named = texts.select("doc_id", "text_hash").join(usable, "doc_id").distinct()
    # At most ``fit_documents`` documents, however often their rows repeat.
    sample = named.orderBy(F.xxhash64("doc_id"), "doc_id", "text_hash").limit(fit_documents)
    once = texts.join(F.broadcast(sample), ["doc_id", "text_hash"]).groupBy("doc_id", "text_hash", "quality").agg(F.first("text").alias("text"))

    @F.pandas_udf("binary")
    def described(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: passages(t).tobytes())

    rows = once.select("doc_id", "quality", described("text").alias("bag")).collect()
    rows.sort(key=lambda r: (r["doc_id"], bytes(r["bag"])))
    return fit([np.frombuffer(bytes(r["bag"]), np.float32).reshape(-1, FEATURES) for r in rows], np.array([r["quality"] for r in rows]))


def quality_score(text: Column, model: dict[str, np.ndarray]) -> Column:
    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        out = [score_bags(model, [passages(t) for t in texts[at : at + 256]]) for at in range(0, len(texts), 256)]
        return pd.Series(np.concatenate(out) if out else np.zeros(0))

    return score(text)


def score_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every document."""
    scored = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), quality_score(F.col("text"), train(docs, labels)).alias("score"))
    return scored.withColumn("predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0))


def drop_low_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that score at least 0.5, as they are."""
    [score] = fresh_names(docs, "quality_score")
    return docs.withColumn(score, quality_score(F.col("text"), train(docs, labels))).filter(F.col(score) >= 0.5).select(*docs.columns)
