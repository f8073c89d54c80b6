"""Document fingerprints: one-permutation MinHash with optimal densification, in SQL expressions.

Every shingle of five words is hashed once. The top bits of the hash name one of
``BINS`` bins, the rest is its value, and a bin keeps its least value. An empty bin copies
a filled one, found along a fixed random order of its own, so that two documents
fill it from the same bin as often as they should. The low ``BITS`` bits of every bin are
the fingerprint; likeness corrects for bits that agree by chance.

Nulls and edge cases: a null text counts as the empty text. A text without words has a
fingerprint of zeros only; it is like another such text (1) and unlike all others (0). A
text of fewer than five words is one shingle. Rows alike in id and text are one
document and get equal results; ids may repeat with different texts and be null (first).
An empty table gives an empty result; extra columns are dropped.
"""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfmark.llm.common import let, row_hash, sorted_slices

SHINGLE = 5
BIN_BITS = 8
BINS = 1 << BIN_BITS
BITS = 8
HALF = 1 << (BITS - 1)
#: Filled bins are looked for at this many places before all are compared.
PROBES = 12
#: Slices of the documents' order for each shuffle partition, and how many of their bounds a search skips at once.
SLICES, STRIDE = 4, 64
WORD_GAP = r"[\x20\x09-\x0D]+"

_shift = 64 - BIN_BITS
_rng = random.Random(11)
# The order in which bin i looks at the others: place t is (step[i] * t + start[i]) mod BINS, with odd steps.
_STEP = [_rng.randrange(1, BINS, 2) for _ in range(BINS)]
_START = [_rng.randrange(BINS) for _ in range(BINS)]
_BACK = [pow(s, -1, BINS) for s in _STEP]


def _numbers(values: list[int]) -> Column:
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<int>")


def shingle_hashes(text: Column, size: int = SHINGLE) -> Column:
    """A hash for each run of ``size`` words, repeats kept; one for a shorter text; none without words."""
    words = F.filter(F.split(text, WORD_GAP), lambda w: w != "")
    hashed = F.transform(words, lambda w: F.xxhash64(w))

    def runs(h: Column) -> Column:
        def one(i):
            return F.xxhash64(*(F.get(h, i + k) for k in range(size)))

        return (
            F.when(F.size(h) >= size, F.transform(F.sequence(F.lit(0), F.size(h) - size), one))
            .when(F.size(h) > 0, F.array(F.xxhash64(h)))
            .otherwise(F.array().cast("array<bigint>"))
        )

    return let(hashed, runs)


def bins(hashes: Column) -> Column:
    """The least value of each bin, null where a bin is empty; an empty array without hashes."""
    # A mark that no value exceeds stands at the end of every bin, so each bin shows up in the sorted hashes.
    marks = F.transform(F.sequence(F.lit(0), F.lit(BINS - 1)), lambda b: F.shiftleft(b.cast("long"), _shift).bitwiseOR(F.lit((1 << _shift) - 1)))

    def least(h: Column) -> Column:
        first = F.filter(h, lambda v, i: (i == 0) | (F.shiftrightunsigned(v, _shift) != F.shiftrightunsigned(F.get(h, i - 1), _shift)))
        # Sorted as signed numbers the upper half of the bins comes first.
        low = F.lit((1 << _shift) - 1)
        value = F.transform(first, lambda v: F.when(v.bitwiseAND(low) == low, None).otherwise(v.bitwiseAND(low)))
        return let(value, lambda x: F.concat(F.slice(x, BINS // 2 + 1, BINS // 2), F.slice(x, 1, BINS // 2)))

    return let(hashes, lambda h: F.when(F.size(h) == 0, F.array().cast("array<bigint>")).otherwise(let(F.sort_array(F.concat(h, marks)), least)))


def densified(found: Column) -> Column:
    """Empty bins filled from the first filled one in their own order."""

    def filled(b: Column) -> Column:
        step, start, back = (_numbers(x) for x in (_STEP, _START, _BACK))
        places = F.filter(F.sequence(F.lit(0), F.lit(BINS - 1)), lambda j: F.get(b, j).isNotNull())

        def fill(x: Column, i: Column, filled_places: Column) -> Column:
            at = lambda t: (F.get(step, i) * t + F.get(start, i)).bitwiseAND(F.lit(BINS - 1))
            turn = F.array_min(F.transform(filled_places, lambda j: ((j - F.get(start, i)) * F.get(back, i)).bitwiseAND(F.lit(BINS - 1))))
            return F.coalesce(x, *(F.get(b, at(F.lit(t))) for t in range(PROBES)), F.get(b, at(turn)))

        return let(places, lambda p: F.transform(b, lambda x, i: fill(x, i, p)))

    return let(found, lambda b: F.when(F.size(b) == 0, b).otherwise(filled(b)))


def low_bits(text: Column) -> Column:
    """The kept bits of every bin, as a signed byte; an empty array for a text without words."""
    kept = lambda v: (v.bitwiseAND(F.lit((1 << BITS) - 1)) - HALF).cast("tinyint")
    return let(densified(bins(shingle_hashes(text))), lambda b: F.transform(b, kept))


def packed(kept: Column) -> Column:
    """The bits of the bins as hexadecimal digits, zeros for a text without words."""
    digits = BITS // 4
    return F.when(F.size(kept) == 0, "0" * (digits * BINS)).otherwise(F.array_join(F.transform(kept, lambda v: F.lower(F.lpad(F.hex(v + F.lit(HALF)), digits, "0"))), ""))


def likeness(a: Column, b: Column) -> Column:
    """The estimated share of common shingles, 0 to 1, from the kept bits, free of agreement by chance."""
    chance = 1.0 / (1 << BITS)
    same = F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda equal: equal)) / F.lit(float(BINS))
    return F.when(a == b, 1.0).when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(F.greatest(F.lit(0.0), (same - chance) / (1 - chance)))


def _at_most(bounds: Column, key: Column) -> Column:
    """How many of the sorted bounds are at most ``key``: first among every ``STRIDE``th, then among those behind it."""
    coarse = F.size(F.filter(F.filter(bounds, lambda b, i: i % STRIDE == 0), lambda b: b <= key))
    fine = lambda c: (c - 1) * STRIDE + F.size(F.filter(F.slice(bounds, (c - 1) * STRIDE + 1, F.lit(STRIDE)), lambda b: b <= key))
    return let(coarse, fine)


def beside_the_next(texts: DataFrame) -> DataFrame:
    """doc_id, text, kept, n, next_text, next_kept: every document (rows alike: one, n times) beside the next in order, the last beside the first.

    The documents are dealt once, into slices of the order whose first keys are known; the first of each slice is
    also dealt to the slice before as a guest, so that the last one there finds its next.
    """
    order = [F.col("doc_id").asc_nulls_first(), F.col("text_hash")]
    place = F.struct(F.col("doc_id").isNotNull().alias("has_id"), "doc_id", "text_hash")
    keys = sorted_slices(texts.groupBy("doc_id", "text_hash").agg(F.count(F.lit(1)).alias("n")), order, "keys", SLICES)
    # One row of as many keys as there are slices: ``SLICES`` times the shuffle partitions.
    all_bounds = keys.groupBy("slice").agg(F.min(place).alias("first")).agg(F.array_sort(F.collect_list("first")).alias("bounds"))
    bounds = F.col("bounds")
    mine = texts.withColumn("kept", low_bits(F.col("text"))).withColumn("bounds", all_bounds.scalar()).withColumn("mine", _at_most(bounds, place))
    host = lambda s, guest: F.struct(s.alias("slice"), F.lit(guest).alias("guest"))
    before = F.when(F.col("mine") > 1, F.col("mine") - 1).otherwise(F.size(bounds))
    hosts = F.when(F.get(bounds, F.col("mine") - 1) == place, F.array(host(F.col("mine"), False), host(before, True))).otherwise(F.array(host(F.col("mine"), False)))
    dealt = mine.withColumn("host", F.explode(hosts)).select("host.slice", "host.guest", "doc_id", "text_hash", "text", "kept")
    dealt = dealt.repartition(int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")), "slice")
    if keys.filter("n > 1").isEmpty():
        once = dealt.withColumn("n", F.lit(1))
    else:
        once = dealt.groupBy("slice", "guest", "doc_id", "text_hash").agg(F.first("text").alias("text"), F.first("kept").alias("kept"), F.count(F.lit(1)).cast("int").alias("n"))
    within = Window.partitionBy("slice").orderBy("guest", *order)
    found = once.withColumn("next_text", F.lead("text").over(within)).withColumn("next_kept", F.lead("kept").over(within))
    return found.filter(~F.col("guest")).select("doc_id", "text", "kept", "n", "next_text", "next_kept")


def fingerprint_table(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next for every document.

    The edited text ends in the start of the next document instead of its own last half. Texts are dealt once.
    """
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("text_hash", row_hash())
    found = beside_the_next(texts).withColumn("n_chars", F.length("text").cast("long"))
    half = F.floor(F.col("n_chars") / 2)
    edited = found.withColumn("edited", F.concat(F.substring("text", F.lit(1), (F.col("n_chars") - half).cast("int")), F.substring("next_text", F.lit(1), half.cast("int"))))
    # Computed once, for all that follows read only its few bytes.
    kept = edited.select("doc_id", "n", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "kept", low_bits(F.col("edited")).alias("edited_kept"), "next_kept")
    printed = kept.withColumn("copy", F.explode(F.sequence(F.lit(1), "n")))
    return printed.select(
        "doc_id", "n_chars", "edited_sha256", packed(F.col("kept")).alias("fingerprint"), packed(F.col("edited_kept")).alias("edited_fingerprint"),
        likeness(F.col("kept"), F.col("edited_kept")).alias("near_edited"), likeness(F.col("kept"), F.col("next_kept")).alias("near_next"),
    )
