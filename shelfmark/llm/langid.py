"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Character n-grams of one to three are hashed into ``BUCKETS`` columns. Document
frequencies are counted over all documents that may be learned from; the weights come from
follow-the-regularised-leader (FTRL-proximal) with an elastic-net penalty over at most
``FIT_PER_LANGUAGE`` documents of each language, and a temperature fitted on a fifth of
those calibrates the probabilities. Prediction reads every text whole.

Nulls and edge cases: null, empty and letterless texts are ``und`` with score 0, as is
every text where nothing can be learned. Rows with a null lang are not learned from;
rows with a null id are learned from and never held out. Repeated rows get equal results, and
rows alike in id, lang and text are learned from once;
an empty table gives an empty result; extra columns are dropped.
"""

from __future__ import annotations

import functools

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfmark.llm.common import row_hash

BUCKET_BITS = 15
BUCKETS = 1 << BUCKET_BITS
FIT_PER_LANGUAGE = 500
#: Parts in which a language's documents are looked through for those to learn from.
PARTS = 64
EPOCHS = 4
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.02, 0.02
#: Brings term frequencies, which sum to 1 for a text, near 1 each.
SCALE = 60.0
FOLDS, HELD_OUT = 5, 0
UNKNOWN = "und"


@functools.lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Whether a code point is a letter."""
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def gram_ids(text: str | None) -> np.ndarray:
    """Bucket of every n-gram of the lower-cased text, all but letters as spaces; empty without letters."""
    points = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), "<u4")
    letter = _letters()[points]
    if not letter.any():
        return np.zeros(0, np.uint32)
    c = np.full(len(points) + 2, 32, np.uint32)
    c[1:-1] = np.where(letter, points, 32)
    a, b = c * np.uint32(0x9E3779B1), c * np.uint32(0x85EBCA6B)
    two = a[:-1] ^ (b[1:] + np.uint32(0x165667B1))
    three = (two[:-1] ^ c[2:]) * np.uint32(0xC2B2AE35)
    shift = np.uint32(32 - BUCKET_BITS)
    return np.concatenate((a * np.uint32(0x27D4EB2F) >> shift, two * np.uint32(0x9E3779B1) >> shift, (three ^ three >> np.uint32(15)) * np.uint32(0x27D4EB2F) >> shift))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % FOLDS == HELD_OUT, F.lit(False))


def document_frequencies(docs: DataFrame) -> np.ndarray:
    """Documents that hold each bucket's n-grams, over all of ``docs``; the last entry is the number of documents."""

    def count(batches):
        seen = np.zeros(BUCKETS + 1, np.int64)
        for batch in batches:
            for t in batch.column(0):
                here = np.zeros(BUCKETS + 1, bool)
                here[gram_ids(t.as_py())] = here[BUCKETS] = True
                seen += here
        bucket = np.nonzero(seen)[0]
        yield pa.RecordBatch.from_arrays([pa.array(bucket, pa.int64()), pa.array(seen[bucket], pa.int64())], names=["bucket", "n"])

    # A row a bucket: at most BUCKETS + 1 come to the driver.
    rows = docs.select("text").mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(BUCKETS + 1, np.int64)
    out[rows["bucket"]] = rows["n"]
    return out


class Model:
    def __init__(self, languages: list[str], table: np.ndarray, bias: np.ndarray, temperature: float):
        #: ``table`` holds weight times IDF, a row a language, so that a text's logits are means over its n-grams.
        self.languages, self.table, self.bias, self.temperature = languages, table, bias, temperature

    def predict(self, text: str | None) -> tuple[str, float]:
        ids = gram_ids(text)
        if not len(ids) or not self.languages:
            return UNKNOWN, 0.0
        counts = np.bincount(ids, minlength=BUCKETS)
        z = (self.table @ counts / len(ids) * SCALE + self.bias) / self.temperature
        p = np.exp(z - z.max())
        best = int(p.argmax())
        return self.languages[best], float(p[best] / p.sum())


def ftrl(samples: list[tuple[np.ndarray, np.ndarray, int]], classes: int, epochs: int = EPOCHS) -> tuple[np.ndarray, np.ndarray]:
    """(weights, bias): one pass of updates a document and epoch, on the buckets that it holds."""
    z, n = np.zeros((BUCKETS, classes)), np.zeros((BUCKETS, classes))
    bias, bias_n = np.zeros(classes), np.zeros(classes)

    def weights(z, n):
        return np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    for epoch in range(epochs):
        for i in np.random.default_rng(epoch).permutation(len(samples)):
            ids, x, label = samples[i]
            w = weights(z[ids], n[ids])
            logits = x @ w + bias
            p = np.exp(logits - logits.max())
            p /= p.sum()
            p[label] -= 1
            g = x[:, None] * p
            before = n[ids]
            after = before + g * g
            z[ids] += g - (np.sqrt(after) - np.sqrt(before)) / ALPHA * w
            n[ids] = after
            bias_n += p * p
            bias -= 0.1 * p / (1 + np.sqrt(bias_n))
    return weights(z, n), bias


def calibrate(logits: np.ndarray, labels: np.ndarray) -> float:
    """The temperature of the least negative log-likelihood, by golden-section search over its logarithm."""

    def loss(t: float) -> float:
        z = logits / np.exp(t)
        z = z - z.max(axis=1, keepdims=True)
        return float((np.log(np.exp(z).sum(axis=1)) - z[np.arange(len(z)), labels]).mean())

    if not len(labels):
        return 1.0
    lo, hi, ratio = np.log(0.1), np.log(10.0), (5**0.5 - 1) / 2
    for _ in range(40):
        a, b = hi - ratio * (hi - lo), lo + ratio * (hi - lo)
        lo, hi = (lo, b) if loss(a) <= loss(b) else (a, hi)
    return float(np.exp((lo + hi) / 2))


def train(docs: DataFrame, per_language: int = FIT_PER_LANGUAGE) -> Model:
    usable = docs.filter(F.col("lang").isNotNull() & ~held_out(F.col("doc_id"))).select("doc_id", "lang", "text", row_hash().alias("text_hash"))
    frequency = document_frequencies(usable)
    idf = np.log((1 + frequency[BUCKETS]) / (1 + frequency[:BUCKETS])) + 1
    # The first few of each part of a language, of each eight parts, then of the language: no more than eight times as many come together.
    ids = usable.select("doc_id", "lang", "text_hash").distinct().withColumn("part", F.pmod(F.xxhash64(F.lit(PARTS), "doc_id", "text_hash"), F.lit(PARTS)))
    ids = ids.withColumn("eighth", F.col("part") % 8)
    for group in (["lang", "part"], ["lang", "eighth"], ["lang"]):
        order = Window.partitionBy(*group).orderBy(F.xxhash64("doc_id"), "doc_id", "text_hash")
        ids = ids.withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= per_language).drop("nth")
    ids = ids.select(F.col("doc_id").alias("id"), F.col("lang").alias("of"), F.col("text_hash").alias("hash"))

    @F.pandas_udf("struct<ids:binary,counts:binary>")
    def described(texts: pd.Series) -> pd.DataFrame:
        found = [np.unique(gram_ids(t), return_counts=True) for t in texts]
        return pd.DataFrame({"ids": [i.astype(np.uint32).tobytes() for i, _ in found], "counts": [c.astype(np.uint32).tobytes() for _, c in found]})

    # At most ``per_language`` documents a language, however often their rows repeat.
    same = F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("lang") == F.col("of")) & (F.col("text_hash") == F.col("hash"))
    once = usable.join(F.broadcast(ids), same).groupBy("doc_id", "lang", "text_hash").agg(F.first("text").alias("text"))
    rows = once.select("doc_id", "lang", described("text").alias("grams")).collect()
    rows = sorted((r for r in rows if len(r["grams"]["ids"])), key=lambda r: (r["lang"], r["doc_id"] is not None, r["doc_id"] or 0, bytes(r["grams"]["ids"])))
    languages = sorted({r["lang"] for r in rows})
    if not languages:
        return Model([], np.zeros((0, BUCKETS)), np.zeros(0), 1.0)
    samples = []
    for r in rows:
        i, c = (np.frombuffer(bytes(r["grams"][k]), np.uint32) for k in ("ids", "counts"))
        samples.append((i, c / c.sum() * idf[i] * SCALE, languages.index(r["lang"])))
    fitted = [s for k, s in enumerate(samples) if k % 5 or len(samples) < 20]
    weights, bias = ftrl(fitted, len(languages))
    kept = [s for k, s in enumerate(samples) if not k % 5]
    logits = np.stack([x @ weights[i] + bias for i, x, _ in kept])
    temperature = calibrate(logits, np.array([label for _, _, label in kept]))
    return Model(languages, np.ascontiguousarray((weights * idf[:, None]).T), bias, temperature)


def identify(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every document."""
    model = model or train(docs)

    @F.pandas_udf("struct<lang_pred:string,score:double>")
    def predict(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([model.predict(t) for t in texts], columns=["lang_pred", "score"])

    return docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), predict("text").alias("p")).select("doc_id", "held_out", "p.lang_pred", "p.score")
