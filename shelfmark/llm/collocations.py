"""Phrase collocations counted in quotient filters.

A word's id is a 64-bit hash of its language and itself. An n-gram of ids is permuted so that it can be got back: the last id is mixed
with the others. The top bits of the result name a bucket, the next ones the quotient, a place in the bucket's filter; the
remainder, the bits that are left and the other ids, is kept whole, so counts are exact. A filter is sorted, holds runs of
remainders by quotient in two bits a place, and counts in one byte each where they fit. Every task keeps sorted counts of what
it reads and sends one filter for each bucket; filters of one bucket are merged where they meet. The number of buckets follows
the number of words, so a merge stays small; the permutation spreads n-grams evenly, and a very common one is one entry of each filter.

Passes: words; pairs of frequent words; threes and fours of frequent pairs. What may be frequent is told by a bit array of a
fixed size (8 MB), all that is broadcast: a bit set by accident costs a counter, never a result.

Nulls and edge cases: a null text has no words; a null language is ``und``. Rows count whatever their id, repeated rows
each time. Texts of any length are read whole, in pieces of lines of text. Ties follow the phrase's bytes. An empty
table, or one without frequent phrases, gives an empty result; extra columns are dropped.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfmark.llm.common import discard, written

LEAST = 30
LONGEST = 4
TOP = 2000
#: A longer candidate with this share (hundredths) of a phrase's occurrences stands for it.
STANDS_FOR = 80
SCALE = 2_000_000
NO_LANGUAGE = "und"
#: Bits of the array that tells what may be frequent.
FREQUENT_BITS = 1 << 26
#: Words of the corpus that share a bucket.
BUCKET_WORDS = 1 << 20
#: n-grams that a task holds before it sends filters.
HELD = 1 << 20
#: Bytes of text whose words are numbered together.
CHUNK = 1 << 21
SEED = 43
#: The multipliers of a well-known 64-bit mixing function.
MULTIPLIERS = (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)
SHIFTS = (30, 27, 31)
ENDS = bytes.maketrans(b".,;:!?\x0b\x0c\r\t", b"\n\n\n\n\n\n\n\n\n ")


# ---- permutation -------------------------------------------------------------


def mixed(x: np.ndarray) -> np.ndarray:
    for shift, by in zip(SHIFTS, MULTIPLIERS):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(by)
    return x ^ (x >> np.uint64(SHIFTS[-1]))


def _unshifted(x: np.ndarray, shift: int) -> np.ndarray:
    """The y with y ^ (y >> shift) = x."""
    out, at = x, shift
    while at < 64:
        out = x ^ (out >> np.uint64(shift))
        at += shift
    return out


def unmixed(x: np.ndarray) -> np.ndarray:
    x = _unshifted(x, SHIFTS[-1])
    for shift, by in zip(SHIFTS[-2::-1], MULTIPLIERS[::-1]):
        x = _unshifted(x * np.uint64(pow(by, -1, 1 << 64)), shift)
    return x


def _of_others(grams: np.ndarray) -> np.ndarray:
    out = np.zeros(len(grams), np.uint64)
    for i in range(grams.shape[1] - 1):
        out = mixed(out ^ grams[:, i])
    return out


def permuted(grams: np.ndarray) -> np.ndarray:
    """One number for each n-gram (a row of ids); with the other ids it gives the last one back."""
    return mixed(grams[:, -1] ^ _of_others(grams))


def restored(number: np.ndarray, others: np.ndarray) -> np.ndarray:
    last = np.zeros((len(others), 1), np.uint64)
    grams = np.concatenate((others, last), axis=1)
    grams[:, -1] = unmixed(number) ^ _of_others(grams)
    return grams


# ---- counting quotient filters -----------------------------------------------


def merged(grams: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct n-grams in the order of their numbers, their summed counts, the numbers."""
    number = permuted(grams)
    order = np.argsort(number, kind="stable")
    number, grams, counts = number[order], grams[order], counts[order]
    differs = (grams[1:] != grams[:-1]).any(axis=1)
    if (differs & (number[1:] == number[:-1])).any():  # two n-grams of one number may lie in any order
        order = np.lexsort((*grams.T, number))
        number, grams, counts = number[order], grams[order], counts[order]
        differs = (grams[1:] != grams[:-1]).any(axis=1)
    starts = np.concatenate(([0], np.nonzero(differs)[0] + 1)) if len(grams) else np.zeros(0, np.int64)
    return grams[starts], np.add.reduceat(counts, starts) if len(grams) else counts, number[starts]


def encode(grams: np.ndarray, counts: np.ndarray, number: np.ndarray, bucket_bits: int) -> bytes:
    """The filter of one bucket: sorted distinct n-grams whose numbers share their first ``bucket_bits`` bits."""
    size = max(len(grams) - 1, 0).bit_length()
    left = 64 - bucket_bits - size
    within = number << np.uint64(bucket_bits) if bucket_bits else number
    quotient = (within >> np.uint64(64 - size)).astype(np.int64) if size else np.zeros(len(grams), np.int64)
    remainder = number & np.uint64((1 << left) - 1)
    # A one for each remainder, after a zero for each place passed.
    runs = np.zeros(len(grams) + (1 << size), np.uint8)
    runs[np.arange(len(grams)) + quotient] = 1
    wide = -(-left // 8)
    small = np.minimum(counts, 255).astype(np.uint8)
    return b"".join((
        bytes((grams.shape[1], size, wide)), len(grams).to_bytes(8, "little"), np.packbits(runs).tobytes(), remainder.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :wide].tobytes(),
        grams[:, :-1].astype("<u8").tobytes(), small.tobytes(), counts[small == 255].astype("<u8").tobytes(),
    ))


def decode(blob: bytes, bucket: int, bucket_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """n-grams and counts of a filter."""
    words, size, wide = blob[:3]
    n, at = int.from_bytes(blob[3:11], "little"), 11
    bits = n + (1 << size)
    quotient = np.nonzero(np.unpackbits(np.frombuffer(blob, np.uint8, -(-bits // 8), at))[:bits])[0] - np.arange(n)
    at += -(-bits // 8)
    remainder = np.zeros((n, 8), np.uint8)
    remainder[:, :wide] = np.frombuffer(blob, np.uint8, n * wide, at).reshape(n, wide)
    at += n * wide
    others = np.frombuffer(blob, "<u8", n * (words - 1), at).reshape(n, words - 1)
    at += 8 * n * (words - 1)
    counts = np.frombuffer(blob, np.uint8, n, at).astype(np.int64)
    counts[counts == 255] = np.frombuffer(blob, "<u8", -1, at + n).astype(np.int64)
    left = 64 - bucket_bits - size
    high = quotient.astype(np.uint64) << np.uint64(left) if left < 64 else np.zeros(n, np.uint64)
    number = remainder.view("<u8")[:, 0] | high | np.uint64(bucket << (64 - bucket_bits) if bucket_bits else 0)
    return restored(number, others.astype(np.uint64)), counts


def filters(grams: np.ndarray, counts: np.ndarray, number: np.ndarray, bucket_bits: int):
    """(bucket, filter) for each bucket of merged n-grams."""
    if not len(grams):
        return
    bucket = number >> np.uint64(64 - bucket_bits) if bucket_bits else np.zeros(len(number), np.uint64)
    starts = np.concatenate(([0], np.nonzero(bucket[1:] != bucket[:-1])[0] + 1, [len(number)]))
    for a, b in zip(starts[:-1].tolist(), starts[1:].tolist()):
        yield int(bucket[a]), encode(grams[a:b], counts[a:b], number[a:b], bucket_bits)


# ---- reading -----------------------------------------------------------------


def _chunks(batches):
    """(language, bytes): texts of a language together, a line break between them; long texts in parts that end with a line or a piece."""
    held: dict[str, list[bytes]] = {}
    size: dict[str, int] = {}
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            raw = (text.as_py() or "").encode("utf-8").lower().translate(ENDS)  # only A-Z change
            while raw:
                cut = len(raw) if len(raw) <= CHUNK else raw.rfind(b"\n", 0, CHUNK) + 1 or raw.find(b"\n") + 1 or len(raw)
                held.setdefault(lang, []).append(raw[:cut])
                size[lang] = size.get(lang, 0) + cut
                raw = raw[cut:]
                if size[lang] >= CHUNK:
                    yield lang, b"\n".join(held.pop(lang))
                    size[lang] = 0
    for lang, parts in held.items():
        yield lang, b"\n".join(parts)


def numbered(chunk: bytes) -> tuple[list[bytes], np.ndarray]:
    """Distinct words, the line break and the empty word first, and the place of each word in them; breaks stay, empty words go."""
    known: dict[bytes, int] = {b"\n": 0, b"": 1}
    codes = np.array([known.setdefault(w, len(known)) for w in chunk.replace(b"\n", b" \n ").split(b" ")], np.int64)
    return list(known), codes[codes != 1]


def word_id(lang: str, word: bytes) -> int:
    return xxhash.xxh64_intdigest(lang.encode() + b"\0" + word, SEED)


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64), pa.int64())


def word_counts(docs: DataFrame) -> DataFrame:
    """lang, word, id, f: each task's counts; a null word counts all words."""

    def count(batches):
        for lang, chunk in _chunks(batches):
            words, codes = numbered(chunk)
            times = np.bincount(codes, minlength=len(words))[2:]
            names = [w.decode() for w in words[2:]]
            ids = np.fromiter((word_id(lang, w) for w in words[2:]), np.uint64, len(names))
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * (len(names) + 1), pa.string()), pa.array([None, *names], pa.string()), _signed(np.concatenate((np.zeros(1, np.uint64), ids))), pa.array(np.concatenate(([times.sum()], times)), pa.int64())], names=["lang", "word", "id", "f"]
            )

    return docs.mapInArrow(count, "lang string, word string, id long, f long")


def _has(bits: np.ndarray, number: np.ndarray) -> np.ndarray:
    at = (number & np.uint64(FREQUENT_BITS - 1)).astype(np.int64)
    return bits[at >> 3] >> (at & 7).astype(np.uint8) & 1 == 1


def bit_array(frequent: DataFrame) -> np.ndarray:
    """Bits of the ``number`` of each row: at most FREQUENT_BITS / 64 rows come to the driver, whatever the table's size."""
    at = F.col("number").bitwiseAND(FREQUENT_BITS - 1)
    slots = frequent.groupBy(F.shiftright(at, 6).alias("slot")).agg(F.bit_or(F.expr(f"shiftleft(1L, int((number & {FREQUENT_BITS - 1}) & 63))")).alias("bits")).toArrow()
    out = np.zeros(FREQUENT_BITS // 64, np.int64)
    out[slots.column("slot").to_numpy()] = slots.column("bits").to_numpy()
    return out.view(np.uint8)


def grams_of(codes: np.ndarray, ids: np.ndarray, usable: np.ndarray, pairs: np.ndarray | None, sizes: tuple[int, ...]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """n -> distinct n-grams and counts, of usable words in a row; of those above two words, only where all ``pairs`` may be frequent."""
    n_words, ok = len(ids), usable[codes]
    out: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    both = np.nonzero(ok[:-1] & ok[1:])[0]
    pair = codes[both] * n_words + codes[both + 1]
    found, of, times = np.unique(pair, return_inverse=True, return_counts=True)
    two = ids[np.stack((found // n_words, found % n_words), axis=1)]
    if 2 in sizes:
        out[2] = two, times
    if pairs is not None:
        keep = _has(pairs, permuted(two))
        starts = np.full(len(codes), -1)
        starts[both] = np.where(keep[of], of, -1)
        here, place = np.nonzero(starts >= 0)[0], starts
        gram, parts = starts, two
        for n in range(3, max(sizes) + 1):
            here = here[here + n - 2 < len(codes)]
            here = here[place[here + n - 2] >= 0]
            code = gram[here] * n_words + codes[here + n - 1]
            found, of, times = np.unique(code, return_inverse=True, return_counts=True)
            parts = np.concatenate((parts[found // n_words], ids[found % n_words][:, None]), axis=1)
            gram = np.full(len(codes), -1)
            gram[here] = of
            if n in sizes:
                out[n] = parts, times
    return out


def gram_filters(docs: DataFrame, frequent_words, frequent_pairs, sizes: tuple[int, ...], bucket_bits: int) -> DataFrame:
    """lang, n, bucket, filter: what each task counted. ``frequent_*`` are broadcast bit arrays."""

    def count(batches):
        words_bits, pairs_bits = frequent_words.value, frequent_pairs.value if frequent_pairs else None
        held: dict[tuple[str, int], list[tuple[np.ndarray, np.ndarray]]] = {}
        rows: dict[tuple[str, int], int] = {}

        def sent(key, grams, counts, number):
            made = list(filters(grams, counts, number, bucket_bits))
            yield pa.RecordBatch.from_arrays([pa.array([key[0]] * len(made), pa.string()), pa.array([key[1]] * len(made), pa.int32()), pa.array([b for b, _ in made], pa.int64()), pa.array([f for _, f in made], pa.binary())], names=["lang", "n", "bucket", "filter"])

        def together(key):
            grams, counts = (np.concatenate(x) for x in zip(*held[key]))
            return merged(grams, counts)

        for lang, chunk in _chunks(batches):
            words, codes = numbered(chunk)
            ids = np.fromiter((word_id(lang, w) for w in words), np.uint64, len(words))
            usable = _has(words_bits, ids)
            usable[:2] = False
            for n, (grams, times) in grams_of(codes, ids, usable, pairs_bits, sizes).items():
                key = (lang, n)
                held.setdefault(key, []).append((grams, times))
                rows[key] = rows.get(key, 0) + len(grams)
            while sum(rows.values()) > HELD:
                key = max(rows, key=rows.get)
                grams, counts, number = together(key)
                if len(held[key]) > 1 and len(grams) < rows[key] // 2:
                    held[key], rows[key] = [(grams, counts)], len(grams)
                else:
                    yield from sent(key, grams, counts, number)
                    held.pop(key), rows.pop(key)
        for key in held:
            yield from sent(key, *together(key))

    return docs.mapInArrow(count, "lang string, n int, bucket long, filter binary")


def merge_filters(sent: DataFrame, bucket_bits: int, least: int = LEAST) -> DataFrame:
    """lang, ids, f, number of the n-grams counted ``least`` times or more: filters of a bucket meet and are merged as they pass."""
    dealt = sent.repartition("lang", "n", "bucket").sortWithinPartitions("lang", "n", "bucket")

    def frequent(of, blobs):
        grams, counts = (np.concatenate(x) for x in zip(*(decode(b, of[2], bucket_bits) for b in blobs)))
        grams, counts, number = merged(grams, counts)
        keep = counts >= least
        flat = pa.array(grams[keep].view(np.int64).ravel(), pa.int64())
        ids = pa.ListArray.from_arrays(pa.array(np.arange(keep.sum() + 1) * of[1], pa.int32()), flat)
        return pa.RecordBatch.from_arrays([pa.array([of[0]] * int(keep.sum()), pa.string()), ids, pa.array(counts[keep], pa.int64()), _signed(number[keep])], names=["lang", "ids", "f", "number"])

    def merge(batches):
        at, held = None, []
        for batch in batches:
            for lang, n, bucket, blob in zip(*(c.to_pylist() for c in batch.columns)):
                if (lang, n, bucket) != at:
                    if held:
                        yield frequent(at, held)
                    at, held = (lang, n, bucket), []
                held.append(blob)
        if held:
            yield frequent(at, held)

    return dealt.mapInArrow(merge, "lang string, ids array<long>, f long, number long")


# ---- phrases -----------------------------------------------------------------


def phrase_counts(docs: DataFrame, least: int = LEAST, longest: int = LONGEST) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(grams, words, totals): lang, ids, f of all frequent phrases, single words too; lang, id, word of frequent words; lang, n of all words."""
    spark = docs.sparkSession
    read = docs.select(F.coalesce("lang", F.lit(NO_LANGUAGE)).alias("lang"), "text")
    counted, _ = written(word_counts(read).groupBy("lang", "word", "id").agg(F.sum("f").alias("f")).filter((F.col("f") >= least) | F.col("word").isNull()), "words")
    totals, words = counted.filter("word IS NULL").select("lang", F.col("f").alias("n")), counted.filter("word IS NOT NULL")
    if not words.groupBy("id").agg(F.count(F.lit(1)).alias("words")).filter("words > 1").isEmpty():
        raise ValueError("two frequent words have one id: choose another SEED")
    all_words = totals.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    bucket_bits = max(0, (all_words // BUCKET_WORDS).bit_length())
    usable = spark.sparkContext.broadcast(bit_array(words.select(F.col("id").alias("number"))))
    pairs, _ = written(merge_filters(gram_filters(read, usable, None, (2,), bucket_bits), bucket_bits, least), "pairs")
    grams = words.select("lang", F.array("id").alias("ids"), "f").unionByName(pairs.drop("number"))
    if longest > 2:
        known = spark.sparkContext.broadcast(bit_array(pairs.select("number")))
        more, _ = written(merge_filters(gram_filters(read, usable, known, tuple(range(3, longest + 1)), bucket_bits), bucket_bits, least), "longer")
        grams = grams.unionByName(more.drop("number"))
    return grams, words.select("lang", "id", "word"), totals


def scored(grams: DataFrame) -> DataFrame:
    """lang, ids, a, l, r, score of phrases of two words and more, by their lowest-scoring cut."""
    phrases = grams.filter(F.size("ids") > 1).select("lang", "ids", F.col("f").alias("a"))
    cut = phrases.withColumn("k", F.explode(F.sequence(F.lit(1), F.size("ids") - 1)))
    cut = cut.withColumn("first", F.slice("ids", F.lit(1), F.col("k"))).withColumn("rest", F.slice("ids", F.col("k") + 1, F.size("ids")))
    firsts = grams.select("lang", F.col("ids").alias("first"), F.col("f").alias("l"))
    rests = grams.select("lang", F.col("ids").alias("rest"), F.col("f").alias("r"))
    both = cut.join(firsts, ["lang", "first"]).join(rests, ["lang", "rest"])
    score = F.expr(f"CAST({SCALE} AS DECIMAL(18, 0)) * CAST(a AS DECIMAL(20, 0)) div CAST(l + r AS DECIMAL(20, 0))")
    lowest = both.groupBy("lang", "ids").agg(F.first("a").alias("a"), F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut"))
    return lowest.select("lang", "ids", "a", "cut.l", "cut.r", "cut.score")


def undominated(phrases: DataFrame) -> DataFrame:
    """Those that no longer candidate stands for."""
    size = F.size("ids")
    inner = F.flatten(F.transform(F.sequence(F.lit(2), size - 1), lambda n: F.transform(F.sequence(F.lit(1), size - n + 1), lambda i: F.slice("ids", i, n))))
    longer = phrases.filter(size > 2).select("lang", F.explode(F.array_distinct(inner)).alias("ids"), "a").groupBy("lang", "ids").agg(F.max("a").alias("longer"))
    return phrases.join(longer, ["lang", "ids"], "left").filter(F.col("longer").isNull() | (100 * F.col("longer") < STANDS_FOR * F.col("a"))).drop("longer")


def collocations(docs: DataFrame, top: int = TOP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's first ``top``."""
    grams, words, totals = phrase_counts(docs)
    per_lang = Window.partitionBy("lang")
    # Ties of the last place stay until the phrases' words are known; Spark keeps each task's first before it deals rows out.
    best = undominated(scored(grams)).withColumn("place", F.rank().over(per_lang.orderBy(F.desc("score"), F.desc("a")))).filter(F.col("place") <= top)
    kept, path = written(best.drop("place"), "best-phrases")
    spelled = kept.select("lang", "ids", F.posexplode("ids").alias("at", "id")).join(words, ["lang", "id"]).groupBy("lang", "ids").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "word"))), lambda w: w["word"]), " ").alias("phrase"))
    ranked = kept.join(spelled, ["lang", "ids"]).withColumn("rank", F.row_number().over(per_lang.orderBy(F.desc("score"), F.desc("a"), "phrase")).cast("long")).filter(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", F.col("score").cast("long").alias("score"))


#: The same rows in SQL, on the phrases themselves.
COLLOCATIONS_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents
),
ws AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
starts AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM ws),
runs AS (SELECT lang, array_to_string(w[i : i + k - 1], ' ') AS p, k FROM starts, (VALUES (1), (2), (3), (4)) AS v(k) WHERE i + k - 1 <= len(w)),
grams AS MATERIALIZED (SELECT lang, p, k, count(*) AS f FROM runs GROUP BY ALL),
totals AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM grams WHERE k = 1 GROUP BY lang),
frequent AS MATERIALIZED (SELECT lang, p, k, f, string_split(p, ' ') AS w FROM grams WHERE f >= 30),
cands AS MATERIALIZED (SELECT * FROM frequent WHERE k > 1),
parted AS MATERIALIZED (SELECT lang, p, f AS a, v.k, array_to_string(w[1 : v.k], ' ') AS first, array_to_string(w[v.k + 1 :], ' ') AS rest FROM cands c, (VALUES (1), (2), (3)) AS v(k) WHERE v.k < c.k),
cuts AS (
  SELECT c.lang, c.p, c.a, x.f AS l, y.f AS r, CAST(CAST(2000000 AS HUGEINT) * c.a // (x.f + y.f) AS BIGINT) AS score, c.k
  FROM parted c JOIN frequent x ON x.lang = c.lang AND x.p = c.first JOIN frequent y ON y.lang = c.lang AND y.p = c.rest
),
lowest AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, k) = 1),
inner_phrases AS (SELECT c.lang, c.f AS a, array_to_string(c.w[s.i : s.i + v.k - 1], ' ') AS p FROM cands c, (VALUES (2), (3)) AS v(k), (VALUES (1), (2), (3)) AS s(i) WHERE v.k < c.k AND s.i + v.k - 1 <= c.k),
longer AS (SELECT lang, p, max(a) AS a FROM inner_phrases GROUP BY ALL),
kept AS (SELECT l.* FROM lowest l LEFT JOIN longer g USING (lang, p) WHERE g.a IS NULL OR 100 * g.a < 80 * l.a),
named AS (SELECT lang, p AS phrase, a, l, r, score FROM kept),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM named)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
"""
