"""SimHash near-duplicates by anchor-point covering.

Fingerprints of 64 bits are cut into three blocks. The codewords of the binary Golay
code of length 23 cover a block: every block value lies within three bits of exactly one
codeword, its home. The anchors are pairs of codewords of two blocks. Two fingerprints
that differ in at most four bits differ in at most two bits of some two blocks; a point
midway is then within one bit of both, and its home is an anchor within the covering
radius plus one of both. So each fingerprint is replicated to every anchor that is the home
of a point within one bit (half of the two bits), some 29 in all, and all that meet at an
anchor are compared. There are 3 * 2**24 anchors, so groups stay small; the plan is the same
at all sizes and finds every link.

Nulls and edge cases: a null or empty text, or one without words, has fingerprint zero
and is linked like any other. Rows with a null id take part but never give a component
its id; a component of such rows only has a null id. Repeated rows are kept, each with its component.
An empty table gives an empty result; extra columns are dropped.
"""

from __future__ import annotations

import functools
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.common import discard, fresh_names, materialise, row_hash, written

SHINGLE = 4
SEED = 42
THRESHOLD = 4
BLOCKS = ((0, 22), (22, 21), (43, 21))
#: Rows of one anchor that are compared in one piece; larger anchors are split into pairs of pieces.
PIECE = 8192
#: Groups of up to this many rows are compared side by side.
FEW = 4
BITS, CHECK_BITS, RADIUS = 23, 11, 3
#: Fixed value: a generator polynomial of the binary Golay code.
GENERATOR = 0b101011100011


# ---- fingerprints ------------------------------------------------------------


def fingerprint(text: str | None) -> int:
    """A bit is set if it is set in over half of the shingles' hashes."""
    words = (text or "").encode("utf-8").lower().split()  # bytes: only A-Z change, only ASCII white space parts
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = min(SHINGLE, len(words))
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist())), np.uint64)
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, text_hash, fp (signed 64-bit)."""
    key = docs.schema["doc_id"].dataType.simpleString()

    def digest(batches):
        for b in batches:
            fps = np.array([fingerprint(t.as_py()) for t in b.column(2)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fps, pa.int64())], names=["doc_id", "text_hash", "fp"])

    return docs.select("doc_id", row_hash(text).alias("text_hash"), text).mapInArrow(digest, f"doc_id {key}, text_hash long, fp long")


# ---- anchors -----------------------------------------------------------------


@functools.lru_cache(maxsize=1)
def _code() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Check values of the low 12 and the high bits, and the error that each check value stands for."""

    def rest(v: int) -> int:
        for i in range(BITS - 1, CHECK_BITS - 1, -1):
            if v >> i & 1:
                v ^= GENERATOR << (i - CHECK_BITS)
        return v

    single = [rest(1 << i) for i in range(BITS)]
    low = np.zeros(1 << 12, np.uint32)
    high = np.zeros(1 << 11, np.uint32)
    for i in range(12):
        low[np.arange(1 << 12) >> i & 1 == 1] ^= np.uint32(single[i])
    for i in range(11):
        high[np.arange(1 << 11) >> i & 1 == 1] ^= np.uint32(single[12 + i])
    error = np.zeros(1 << CHECK_BITS, np.uint32)
    for weight in range(1, RADIUS + 1):
        for bits in combinations(range(BITS), weight):
            error[functools.reduce(int.__xor__, (single[i] for i in bits))] = sum(1 << i for i in bits)
    return low, high, error


def home(values: np.ndarray) -> np.ndarray:
    """The number of the only codeword within the covering radius of each block value."""
    low, high, error = _code()
    return (values ^ error[low[values & 0xFFF] ^ high[values >> 12]]) >> CHECK_BITS


def _near(values: np.ndarray, width: int) -> np.ndarray:
    """Homes of all values that differ in up to one bit: a row for each value, the first column its own home."""
    flips = np.array([0, *(1 << i for i in range(width))], np.uint32)
    return home(values[:, None] ^ flips[None, :])


def anchors(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Parallel arrays: index into ``fps``, anchor key."""
    cut = [((fps >> np.uint64(s)) & np.uint64((1 << w) - 1)).astype(np.uint32) for s, w in BLOCKS]
    near = [_near(c, w).astype(np.int64) for c, (_, w) in zip(cut, BLOCKS)]
    rows, keys = [], []
    for b, (i, j) in enumerate(combinations(range(len(BLOCKS)), 2)):
        key = np.concatenate((near[i] << 12 | near[j][:, :1], near[i][:, :1] << 12 | near[j]), axis=1)
        key.sort(axis=1)
        first = np.ones(key.shape, bool)
        first[:, 1:] = key[:, 1:] != key[:, :-1]
        rows.append(np.nonzero(first)[0])
        keys.append(key[first] | b << 24)
    return np.concatenate(rows), np.concatenate(keys)


def anchor_rows(distinct: DataFrame) -> DataFrame:
    """fp -> (anchor, fp)."""

    def replicate(batches):
        for batch in batches:
            all_fps = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for at in range(0, len(all_fps), 1000):
                fps = all_fps[at : at + 1000]
                row, key = anchors(fps)
                yield pa.RecordBatch.from_arrays([pa.array(key.astype(np.int32), pa.int32()), pa.array(fps[row].view(np.int64), pa.int64())], names=["anchor", "fp"])

    return distinct.select("fp").mapInArrow(replicate, "anchor int, fp long")


def _forest(fps: np.ndarray, first: np.ndarray, second: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """Links between ``fps[first]`` and ``fps[second]`` as stars: one link from each linked fingerprint to its tree's root."""
    label = np.arange(len(fps))
    others = fps[second]
    for at in range(0, len(first), 256):
        rows = first[at : at + 256]
        close = np.bitwise_count(fps[rows][:, None] ^ others[None, :]) <= threshold
        for r in np.nonzero(close.sum(axis=1) > (np.isin(rows, second)))[0]:
            met = np.unique(label[np.append(second[close[r]], rows[r])])
            if len(met) > 1:
                label[np.isin(label, met)] = met[0]
    linked = np.nonzero(label != np.arange(len(fps)))[0]
    return fps[linked], fps[label[linked]]


def _few(group: np.ndarray, fps: np.ndarray, size: np.ndarray, threshold: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links within the groups of at most ``FEW`` rows; rows of a group stand together."""
    out = []
    for step in range(1, FEW):
        same = np.nonzero((group[step:] == group[:-step]) & (size[step:] <= FEW))[0]
        x, y = fps[same], fps[same + step]
        close = (np.bitwise_count(x ^ y) <= threshold) & (x != y)
        out.append((y[close], x[close]))
    return out


def links(distinct: DataFrame, threshold: int = THRESHOLD, piece: int = PIECE) -> DataFrame:
    """(a, b): links that join the same fingerprints as all links within ``threshold`` bits would."""
    rows, path = written(anchor_rows(distinct), "anchors")
    hot = rows.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > piece).select("anchor", F.ceil(F.col("n") / piece).cast("int").alias("cuts"))
    cut = rows.join(hot, "anchor", "left").withColumn("cuts", F.coalesce("cuts", F.lit(1)))
    own = F.pmod(F.xxhash64("fp"), F.col("cuts")).cast("int")
    # A row of a hot anchor stands with its own piece in a part with every piece: 0 in the first of the two, 1 in the second.
    met = cut.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)))
    part = F.least("own", "other") * F.col("cuts") + F.greatest("own", "other")
    side = F.when(F.col("own") == F.col("other"), 2).when(F.col("own") < F.col("other"), 0).otherwise(1)
    dealt = met.select("anchor", part.alias("part"), "fp", side.cast("int").alias("side")).repartition("anchor", "part").sortWithinPartitions("anchor", "part")

    def compare(batches):
        held: list[np.ndarray] = [np.zeros(0, np.int64)] * 4

        def settle(a, p, f, s):
            new = np.concatenate(([True], (a[1:] != a[:-1]) | (p[1:] != p[:-1])))
            lows = np.nonzero(new)[0]
            sizes = np.diff(np.append(lows, len(a)))
            group = np.cumsum(new) - 1
            fps = f.view(np.uint64)
            out = _few(group, fps, sizes[group], threshold)
            for g in np.nonzero(sizes > FEW)[0].tolist():
                here = slice(lows[g], lows[g] + sizes[g])
                found, at = np.unique(fps[here], return_inverse=True)
                first, second = (at, at) if s[here.start] == 2 else (at[s[here] == 0], at[s[here] == 1])
                if len(first) and len(second) and len(found) > 1:
                    out.append(_forest(found, first, second, threshold))
            x, y = (np.concatenate(side) for side in zip(*out))
            return pa.RecordBatch.from_arrays([pa.array(x.view(np.int64), pa.int64()), pa.array(y.view(np.int64), pa.int64())], names=["a", "b"])

        for batch in batches:
            new = [batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(4)]
            held = [np.concatenate(x) for x in zip(held, new)]
            a, p = held[0], held[1]
            last = np.nonzero((a != a[-1]) | (p != p[-1]))[0]
            if len(last):
                whole = last[-1] + 1
                yield settle(*(x[:whole] for x in held))
                held = [x[whole:] for x in held]
        if len(held[0]):
            yield settle(*held)

    found = materialise(dealt.mapInArrow(compare, "a long, b long"), "links")
    discard(distinct.sparkSession, path)
    return found


# ---- components --------------------------------------------------------------


def components(edges: DataFrame) -> DataFrame:
    """node -> root for every node of an edge, a written table.

    Each round every node hops to the neighbour (or stays) that a hash of the round ranks least, then to where that one
    hopped, and the graph is contracted. Ranks are random, so a round leaves a fixed share of the nodes at most,
    whatever their order: rounds grow with the logarithm of the longest component. What a round wrote is deleted once the next has read it.
    """
    spark = edges.sparkSession
    graph, path = written(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a != b").distinct(), "edges")
    hops: list[DataFrame] = []
    paths: list[str] = []
    while not graph.isEmpty():
        rank = lambda c: F.struct(F.xxhash64(F.lit(len(hops)), c), F.col(c).alias("at"))  # noqa: B023, E731
        both = graph.unionByName(graph.select(F.col("b").alias("a"), F.col("a").alias("b")))
        near, near_path = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min(rank("b")), F.first(rank("a"))).getField("at").alias("root")), "near")
        hop, hop_path = written(near.join(near.select(F.col("node").alias("root"), F.col("root").alias("next")), "root").select("node", F.col("next").alias("root")), "hops")
        hops.append(hop)
        to_a = hop.select(F.col("node").alias("a"), F.col("root").alias("ra"))
        to_b = hop.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        before = path
        graph, path = written(
            graph.join(to_a, "a").join(to_b, "b").filter("ra != rb").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct(), "edges"
        )
        discard(spark, before, near_path)
        paths.append(hop_path)
    if not hops:
        found = graph.select(F.col("a").alias("node"), F.col("b").alias("root"))
    else:
        found = hops[0]
    for hop in hops[1:]:
        found = found.join(hop.select(F.col("node").alias("root"), F.col("root").alias("next")), "root", "left").select("node", F.coalesce("next", "root").alias("root"))
    roots = materialise(found, "roots")
    discard(spark, path, *paths)
    return roots


def near_duplicates(docs: DataFrame, threshold: int = THRESHOLD, piece: int = PIECE) -> DataFrame:
    """doc_id, text_hash, fp, component_id, keeper (the id and text hash of the row that stands for the component)."""
    if not 0 <= threshold <= THRESHOLD:
        raise ValueError(f"blocks and anchors cover up to {THRESHOLD} differing bits")
    marked = materialise(fingerprints(docs), "fingerprints")
    # Of equal fingerprints, the least id stands for all; a null id only if there is no other.
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash"))
    distinct = materialise(marked.groupBy("fp").agg(first.alias("least")), "distinct")
    roots = components(links(distinct, threshold, piece))
    least = distinct.join(roots, distinct["fp"] == roots["node"]).groupBy("root").agg(F.min("least").alias("least"))
    linked = roots.join(least, "root").select(F.col("node").alias("fp"), F.col("least").alias("of_all"))
    # A table of its own: then both sides of the last join are dealt out for it, and Spark can split a fingerprint that very many rows share.
    classes = materialise(distinct.join(linked, "fp", "left").select("fp", F.coalesce("of_all", "least").alias("least")), "classes")
    return marked.join(classes, "fp").select("doc_id", "text_hash", "fp", F.col("least.doc_id").alias("component_id"), F.struct("least.doc_id", "least.text_hash").alias("keeper"))


def simhash_components(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits), component_id."""
    return near_duplicates(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """The documents with one of each component left; of rows alike in id and text, one."""
    found = near_duplicates(docs)
    kept = found.filter(F.col("doc_id").eqNullSafe(F.col("keeper.doc_id")) & (F.col("text_hash") == F.col("keeper.text_hash"))).groupBy("doc_id", "text_hash").agg(F.count(F.lit(1)).alias("copies"))
    kept = materialise(kept, "kept")
    key, kept_id, kept_hash = fresh_names(docs, "text_key", "kept_id", "kept_hash")
    mine, named = docs.withColumn(key, row_hash()), kept.select(F.col("doc_id").alias(kept_id), F.col("text_hash").alias(kept_hash))
    left = mine.join(named, F.col("doc_id").eqNullSafe(F.col(kept_id)) & (F.col(key) == F.col(kept_hash)), "left_semi")
    if not kept.filter("copies > 1").isEmpty():  # rows alike in id and text
        left = left.dropDuplicates(["doc_id", key])
    return left.drop(key)
