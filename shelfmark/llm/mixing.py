"""Mixing sources to target weights by pivotal dependent rounding.

A source's documents all get the same fractional number of copies: its target words
over its size. Whole copies are taken at once; the fractions are rounded in pairs. A
pair moves mass from one to the other at random until one of them is 0 or 1, so the
sum stays what it was and each document keeps its expected copies. Two fractions of
a leaf are paired as they are. Where documents of a leaf have the same fraction, the largest is paired first, with the bundle of
all smaller ones: their common fraction is one side of the pair, and what moves is words, so that the words
stay at the target as well, down to the smallest document. Leaves are runs of documents of like size, largest first, and of
bounded number; they are rounded side by side and leave one fraction each, and these are paired again in a reduction tree, by
source, up to one per source. Every document of every table goes this way.

Fractions are whole multiples of 2**-40, so that sums are exact; random numbers come
from hashes of the rows, so that reruns agree.

Nulls and edge cases: a null or empty text has size 0 and takes 0 words; a source of
size 0 has target 0; null is a source of its own, ranked last; rows alike in id, text and
source are one unit whose copies they share evenly; an empty table gives an empty result;
extra columns are dropped by ``mix`` and kept by ``mixture``.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfmark.llm.common import WORD, fresh_names, materialise, row_hash, with_rank

WEIGHTS = (5, 2, 1)
CAP = 3
UNIT = 1 << 40
#: Documents that a leaf of the tree holds on average, and fractions that a node above joins.
LEAF = 4096
FAN_IN = 64
SEED = 20_240_131
_MASK = (1 << 64) - 1


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """source, source_size, target from a table of (source, source_size), one row a source.

    Targets share all words by weight; none exceeds ``cap`` times its source, and the
    excess goes to the others. Sources are a table like any other; only sums leave it.
    """
    ranked = with_rank(sizes, [F.col("source").asc_nulls_last()], "sources")
    rows = materialise(
        ranked.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int")).cast("double")), "weights"
    )
    most = F.col("source_size") * F.lit(float(cap))
    total = rows.agg(F.sum("source_size")).first()[0] or 0
    level, full = 0.0, -1
    while True:  # the words that one unit of weight stands for rise until no further source is full
        over = F.lit(level) * F.col("weight") >= most
        n, held, open_weight = rows.agg(F.count_if(over), F.sum(F.when(over, most)), F.sum(F.when(~over, F.col("weight")))).first()
        if n == full or not open_weight or not total:
            break
        full, level = n, (total - (held or 0.0)) / open_weight
    return rows.select("source", "source_size", F.least(most, F.lit(level) * F.col("weight")).alias("target"))


def _mix64(x: int) -> int:
    """A well-mixed 64-bit number for each 64-bit number."""
    x = (x + 0x9E3779B97F4A7C15) & _MASK
    x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & _MASK
    x = (x ^ x >> 27) * 0x94D049BB133111EB & _MASK
    return x ^ x >> 31


def pivot(mass: list[int], key: list[int], level: int) -> tuple[list[int], list[int]]:
    """(copies won, fraction left) for fractions of ``UNIT``; all but one end at 0."""
    won, held = [0] * len(mass), None
    for i, b in enumerate(mass):
        if not b:
            continue
        if held is None:
            held = i
            continue
        a = mass[held]
        both = a + b
        roll = _mix64(key[i] ^ _mix64(level ^ key[held]))
        if both <= UNIT:  # one gets all, the other nothing
            winner, loser = (held, i) if roll * both >> 64 < a else (i, held)
            mass[winner], mass[loser] = both, 0
            held = winner
        else:  # one becomes a whole copy, the other keeps what is over
            winner, loser = (held, i) if roll * (2 * UNIT - both) >> 64 < UNIT - b else (i, held)
            won[winner], mass[winner], mass[loser] = 1, 0, both - UNIT
            held = loser
        if mass[held] == UNIT:
            won[held], mass[held] = won[held] + 1, 0
        if not mass[held]:
            held = None
    return won, mass


def sweep(size: list[int], mass: list[int], key: list[int]) -> list[int]:
    """The fractions (of ``UNIT``) after each document was paired with all smaller ones that have its fraction, bundled.

    Sizes fall. A pair moves words between the document and its bundle until the document is taken whole or not at all, or all
    of the bundle are; the bundle keeps one common fraction. The words stay what they were (but for less than 2**-40 of
    them a pair), and so do the expected copies of each document.
    """
    mass = list(mass)
    alike: dict[int, list[int]] = {}
    for i, m in enumerate(mass):
        if m:
            alike.setdefault(m, []).append(i)
    for common, members in alike.items():
        after = sum(size[i] for i in members)
        for i in members:
            s, after = size[i], after - size[i]
            held, follow = common * s, common * after
            gain, loss = min(UNIT * s - held, follow), min(held, UNIT * after - follow)
            mass[i] = common
            if not gain + loss:  # no words follow, or all that follow are integral
                continue
            if _mix64(key[i] ^ _mix64(s)) * (gain + loss) >> 64 < loss:
                mass[i], common = (held + gain) // s, (follow - gain) // after
            else:
                mass[i], common = (held - loss) // s, (follow + loss) // after
    return mass


def _round(rows: DataFrame, by: list[str], level: int, last: bool) -> DataFrame:
    """One level of the tree: every group rounds its fractions to at most one, or to none on the last level."""

    def settle(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        size, key = group["size"].to_pylist(), group["key"].to_pylist()
        order = sorted(range(len(size)), key=lambda i: (-size[i], key[i]))
        mass, copies = group["mass"].to_pylist(), group["copies"].to_pylist()
        sizes, keys = [size[i] for i in order], [key[i] & _MASK for i in order]
        swept = sweep(sizes, [mass[i] for i in order], keys)
        won, left = pivot([m % UNIT for m in swept], keys, level)
        won = [w + m // UNIT for w, m in zip(won, swept)]
        for i, w, m in zip(order, won, left):
            if m and last:  # a single fraction: a copy with that probability
                w, m = w + (_mix64(key[i] & _MASK ^ _mix64(level)) * UNIT >> 64 < m), 0
            copies[i], mass[i] = copies[i] + w, m
        for name, values in (("copies", copies), ("mass", mass)):
            group = group.set_column(group.schema.get_field_index(name), name, pa.array(values, pa.int64()))
        return group

    return rows.groupBy(*by).applyInArrow(settle, rows.schema)


def _units(docs: DataFrame, weights: tuple[int, ...], cap: int, leaf: int, text: str) -> DataFrame:
    """doc_id, text_hash, source, size, n (rows alike in all of these), source_size, target, copies (of all n together)."""
    sized = docs.select("doc_id", row_hash(text).alias("text_hash"), "source", word_count(F.col(text)).alias("size"))
    # Rows alike are one unit with so many times the copies: a document that repeats without end is one fraction.
    units = materialise(sized.groupBy("doc_id", "text_hash", "source", "size").agg(F.count(F.lit(1)).alias("n")), "units")
    # Size classes a fifth apart, so at most some 200. Classes of few documents share a run with the next smaller ones, large
    # classes are dealt to leaves; the largest documents of a source have as many others in their leaf as one can hold.
    bin_of = F.floor(F.log2(F.col("size") + 1.0) * 4).cast("int")
    binned = units.withColumn("bin", bin_of)
    bins = materialise(binned.groupBy("source", "bin").agg(F.sum(F.col("size") * F.col("n")).alias("words"), F.count(F.lit(1)).alias("in_bin")), "bins")
    targets = source_targets(bins.groupBy("source").agg(F.sum("words").alias("source_size")), weights, cap)
    plan = (
        bins.withColumnRenamed("source", "s").withColumnRenamed("bin", "b")
        .join(targets, F.col("s").eqNullSafe(F.col("source"))).drop("source")
        .withColumn("run", F.floor((F.sum("in_bin").over(Window.partitionBy("s").orderBy(F.desc("b"))) - F.col("in_bin")) / leaf).cast("int"))
        .withColumn("leaves", F.ceil(F.sum("in_bin").over(Window.partitionBy("s", "run")) / leaf).cast("int"))
        .select("s", "b", "source_size", "target", "run", "leaves")
    )
    plan = materialise(plan, "plan")
    rate = F.when(F.col("source_size") > 0, F.least(F.lit(float(cap)), F.col("target") / F.col("source_size"))).otherwise(0.0) * F.col("n")
    mass = F.round((F.col("rate") - F.floor("rate")) * F.lit(UNIT)).cast("long")
    rows = (
        binned.join(plan, F.col("source").eqNullSafe(F.col("s")) & (F.col("bin") == F.col("b")))
        .withColumn("rate", rate).withColumn("mass", mass)
        .withColumn("key", F.xxhash64(F.lit(SEED), "doc_id", "text_hash", "source"))
        .select(
            "doc_id", "text_hash", "source", "size", "n", "source_size", "target", "key", "run", F.pmod("key", F.col("leaves")).cast("int").alias("leaf"),
            (F.floor("rate").cast("long") + F.when(F.col("mass") >= UNIT, 1).otherwise(0)).alias("copies"), F.when(F.col("mass") >= UNIT, 0).otherwise(F.col("mass")).alias("mass"),
        )
    )
    settled: list[DataFrame] = []
    nodes = plan.agg(F.max("leaves")).first()[0] or 0
    by, level = ["source", "run", "leaf"], 0
    while True:
        last = by == ["source"]
        done = materialise(_round(rows, by, level, last), "rounded")
        settled.append(done.filter("mass = 0"))
        rows = done.filter("mass > 0").withColumn("leaf", F.floor(F.col("leaf") / FAN_IN).cast("int"))
        if last:
            break
        by, nodes, level = (by, -(-nodes // FAN_IN), level + 1) if nodes > 1 else (["source"], nodes, level + 1)
    out = settled[0]
    for s in settled[1:]:
        out = out.unionByName(s)
    return out.select("doc_id", "text_hash", "source", "size", "n", "source_size", "target", "copies")


def _share(copies, n, nth):
    """The copies of the ``nth`` (from 1) of ``n`` rows that have so many together: they differ by one at most."""
    return (F.floor(copies / n) + F.when(nth <= copies % n, 1).otherwise(0)).cast("long")


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP, leaf: int = LEAF, text: str = "text") -> DataFrame:
    """doc_id, text_hash, source, size, source_size, target, copies, taken for every document."""
    rows = _units(docs, weights, cap, leaf, text).withColumn("nth", F.explode(F.sequence(F.lit(1), "n")))
    rows = rows.withColumn("copies", _share(F.col("copies"), F.col("n"), F.col("nth")))
    return rows.select("doc_id", "text_hash", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mixture(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """The documents of the mix, each as often as it is taken; columns as given.

    Rows alike in id, text and source share their copies. Which of them gets the odd one is settled by their numbers
    within the slices of a written table, so that no unit is gathered in one task.
    """
    key, of_id, of_hash, of_source, n, total, part, nth, before, copy = fresh_names(docs, "row_key", "of_id", "of_hash", "of_source", "alike", "copies", "part", "nth", "before", "copy")
    units = _units(docs, weights, cap, LEAF, "text").select(F.col("doc_id").alias(of_id), F.col("text_hash").alias(of_hash), F.col("source").alias(of_source), F.col("n").alias(n), F.col("copies").alias(total))
    units = materialise(units, "copies")
    mine = docs.withColumn(key, row_hash())
    joined = mine.join(units, F.col("doc_id").eqNullSafe(F.col(of_id)) & (F.col(key) == F.col(of_hash)) & F.col("source").eqNullSafe(F.col(of_source)))
    even = F.col(total) % F.col(n) == 0
    taken = joined.filter(even & (F.col(total) > 0)).withColumn(copy, F.explode(F.sequence(F.lit(1), (F.col(total) / F.col(n)).cast("int")))).select(*docs.columns)
    if units.filter(~even).isEmpty():
        return taken
    odd = materialise(joined.filter(~even).withColumn(part, F.spark_partition_id()), "odd-rows")
    unit = [of_id, of_hash, of_source]
    counts = odd.groupBy(*unit, part).agg(F.count(F.lit(1)).alias(nth))
    # A row a slice of each unit.
    earlier = F.coalesce(F.sum(nth).over(Window.partitionBy(*unit).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select(*unit, part, earlier.alias(before))
    numbered = odd.withColumn(nth, F.row_number().over(Window.partitionBy(*unit, part).orderBy(of_hash))).alias("o")
    same = [F.col(f"o.{c}").eqNullSafe(F.col(f"c.{c}")) for c in (*unit, part)]
    placed = numbered.join(counts.alias("c"), same[0] & same[1] & same[2] & same[3])
    times = _share(F.col(total), F.col(n), F.col(nth) + F.col(f"c.{before}")).cast("int")
    return taken.unionByName(placed.filter(times > 0).withColumn(copy, F.explode(F.sequence(F.lit(1), times))).select(*(F.col(f"o.`{c}`") for c in docs.columns)))
