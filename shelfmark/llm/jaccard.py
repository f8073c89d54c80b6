"""N-gram Jaccard join: size-banded tiles, bitmap signatures, exact intersections.

A document's set is its distinct word shingles as sorted 64-bit hashes. Equal sets are one class before anything else.

Tiles. In the order of hashes two linked sets share one of their first n - ceil(0.8 n) + 1 members. As hashes fall at random,
28 members are enough: a pair whose first 28 of the union all lie outside the intersection has a chance below 0.2**28, less than
that of two 64-bit hashes being equal by accident, on which every hashed set relies. A tile is a shared member and a
band of sizes (a factor of 1.25): only sets of one band and the next can link. A class is in 28 tiles at most, however long its text.

Signatures. Bit (hash mod width) of a set's bitmap is the parity of its members there; the width follows the size, a wider bitmap
folds to a narrower one. Bits that differ bound the members that differ from below, and so the overlap from above. This stage
moves bitmaps only and marks those rows of a tile that have a partner there; a pair counts in the first tile that it shares.

Intersections. For marked rows the texts are read again and whole sets go to their tiles. A pair of one component already is not
compared; a tile emits a forest of links. A tile above a bound is cut into pieces; all of them meet a few leaders first, components are
found, and only rows that the tile's largest component does not hold meet all pieces: a group of near copies costs in
proportion to its rows. The last step contracts the graph of links.

Nulls and edge cases: a null or empty text, or one without words, has an empty set and is linked with nothing, not even with
another one; fewer than five words are one shingle. Rows with a null id take part but never give a component its id. Repeated
rows are kept, each with its component. Very long texts are whole sets. An empty table gives an empty result; extra columns are dropped.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.common import discard, row_hash, written
from shelfmark.llm.simhash import components

SHINGLE = 5
SEED = 42
#: The least share of the union, in hundredths.
PERCENT = 80
#: Members of a set that name its tiles.
PREFIX = 28
#: Least and greatest width of a bitmap, powers of two.
BITS = (64, 4096)
#: Rows of a tile that are compared by bitmap in one piece.
PIECE = 8192
#: Shingles of a tile that are intersected in one piece.
PIECE_SHINGLES = 1 << 21
#: Rows of a cut tile, as expected, that meet all of its pieces first.
LEADERS = 16
#: Groups of up to this many rows are compared pair by pair, as numbers.
FEW = 6
#: Shared members of a large group that tell in which tile a pair counts.
TOLD = 256


# ---- sets --------------------------------------------------------------------


def shingle_set(text: str | None) -> np.ndarray:
    """Distinct shingles as sorted signed 64-bit hashes."""
    words = (text or "").encode("utf-8").lower().split()  # bytes: only A-Z change, only ASCII white space parts
    if not words:
        return np.zeros(0, np.int64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = min(SHINGLE, len(words))
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist())), np.uint64)
    return np.unique(hashes.view(np.int64))


def width(n: int) -> int:
    return min(max(1 << (int(n) - 1).bit_length(), BITS[0]), BITS[1])


def bitmap(members: np.ndarray, bits: int) -> np.ndarray:
    """Parities of the members at each bit, as bytes."""
    return np.packbits(np.bincount(members & (bits - 1), minlength=bits) & 1, bitorder="little")


def prefix_length(n: int) -> int:
    return min(n + (-PERCENT * n // 100) + 1, PREFIX)


def shingle_sets(docs: DataFrame, text: str = "text", members: bool = False) -> DataFrame:
    """doc_id, text_hash, n, set_key (null for no words), and prefix and bits, or all members."""
    key = docs.schema["doc_id"].dataType.simpleString()
    tail = [("members", pa.binary())] if members else [("prefix", pa.list_(pa.int64())), ("bits", pa.binary())]

    def digest(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                b = batch.slice(at, 256)
                sets = [shingle_set(t.as_py()) for t in b.column(2)]
                keys = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
                columns = [b.column(0), b.column(1), pa.array([len(s) for s in sets], pa.int64()), pa.array(keys, pa.binary())]
                if members:
                    columns.append(pa.array([s.tobytes() for s in sets], pa.binary()))
                else:
                    columns.append(pa.array([s[: prefix_length(len(s))] for s in sets], pa.list_(pa.int64())))
                    columns.append(pa.array([bitmap(s, width(len(s))).tobytes() if len(s) else b"" for s in sets], pa.binary()))
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "text_hash", "n", "set_key", *(c for c, _ in tail)])

    extra = "members binary" if members else "prefix array<long>, bits binary"
    return docs.select("doc_id", row_hash(text).alias("text_hash"), text).mapInArrow(digest, f"doc_id {key}, text_hash long, n long, set_key binary, {extra}")


# ---- tiles by bitmap ---------------------------------------------------------


def _pieces(rows: DataFrame, weight: Column, most: int) -> DataFrame:
    """tile, cuts of the tiles whose weight is above ``most``."""
    return rows.groupBy("tile").agg(F.sum(weight).alias("weight")).filter(F.col("weight") > most).select("tile", F.ceil(F.col("weight") / most).cast("int").alias("cuts"))


def _own(cuts: Column) -> Column:
    return F.pmod(F.xxhash64("set_key"), cuts).cast("int")


def _paired(rows: DataFrame) -> DataFrame:
    """Rows of a tile in ``cuts`` pieces stand in a part with every piece: side 0 in the first of the two, 1 in the second, 2 where both are one."""
    met = rows.withColumn("own", _own(F.col("cuts"))).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)))
    part = F.least("own", "other") * F.col("cuts") + F.greatest("own", "other")
    side = F.when(F.col("own") == F.col("other"), 2).when(F.col("own") < F.col("other"), 0).otherwise(1)
    return met.withColumn("part", part).withColumn("side", side.cast("int")).drop("own", "other", "cuts")


def _fold(rows: np.ndarray, words: int) -> np.ndarray:
    """Bitmaps (a row each, 64-bit words) at a smaller width."""
    return np.bitwise_xor.reduce(rows.reshape(len(rows), -1, words), axis=1)


def _at_width(bits: list[bytes], wide: np.ndarray, bits_wanted: int) -> np.ndarray:
    """All of ``bits`` at one width; ``wide`` holds their own."""
    out = np.zeros((len(bits), bits_wanted // 64), np.uint64)
    for w in np.unique(wide):
        at = np.nonzero(wide == w)[0]
        out[at] = _fold(np.frombuffer(b"".join(bits[i] for i in at), "<u8").reshape(len(at), -1), bits_wanted // 64)
    return out


def _differing(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Bits that differ between all rows of ``a`` and all of ``b``."""
    out = np.zeros((len(a), len(b)), np.uint16)
    for word in range(a.shape[1]):
        out += np.bitwise_count(a[:, word, None] ^ b[None, :, word])
    return out


def _may_link(n: np.ndarray, m: np.ndarray, differing: np.ndarray) -> np.ndarray:
    """From |x & y| <= (|x| + |y| - differing) / 2, and sizes within PERCENT."""
    both = n[:, None] + m[None, :]
    return (2 * PERCENT * both <= (100 + PERCENT) * (both - differing)) & (100 * np.minimum(n[:, None], m[None, :]) >= PERCENT * np.maximum(n[:, None], m[None, :]))


def _band(n: np.ndarray) -> np.ndarray:
    return np.floor(np.log(n) / np.log(100 / PERCENT) + 1e-9).astype(np.int64)


def _told(earlier: list[np.ndarray]) -> np.ndarray:
    """Which of the most common earlier members each row has, as bits."""
    flat = np.concatenate(earlier)
    found, at, times = np.unique(flat, return_inverse=True, return_counts=True)
    common = np.argsort(-times, kind="stable")[:TOLD]
    place = np.full(len(found), -1)
    place[common[times[common] > 1]] = np.arange((times[common] > 1).sum())
    out = np.zeros((len(earlier), TOLD // 64), np.uint64)
    rows, bit = np.repeat(np.arange(len(earlier)), [len(e) for e in earlier]), place[at]
    rows, bit = rows[bit >= 0], bit[bit >= 0]
    np.bitwise_or.at(out, (rows, bit // 64), np.uint64(1) << (bit % 64).astype(np.uint64))
    return out


def marked_few(n: list[int], bits: list[bytes], earlier: list[np.ndarray], side: list[int]) -> list[bool]:
    """``marked`` for a handful of rows."""
    out = [False] * len(n)
    maps = [int.from_bytes(b, "little") for b in bits]
    for i in range(len(n)):
        for j in range(i):
            small, large = sorted((n[i], n[j]))
            if 100 * small < PERCENT * large or not (side[i] == 2 or side[i] != side[j]):
                continue
            a, b = maps[i], maps[j]
            wide = [8 * len(bits[i]), 8 * len(bits[j])]
            if wide[0] != wide[1]:
                to = min(wide)
                if wide[0] > to:
                    a = _fold_number(a, wide[0], to)
                else:
                    b = _fold_number(b, wide[1], to)
            if 2 * PERCENT * (small + large) <= (100 + PERCENT) * (small + large - (a ^ b).bit_count()) and not set(earlier[i]) & set(earlier[j]):
                out[i] = out[j] = True
    return out


def _fold_number(value: int, bits: int, to: int) -> int:
    while bits > to:
        bits //= 2
        value = (value >> bits) ^ (value & ((1 << bits) - 1))
    return value


def marked(n: np.ndarray, bits: list[bytes], earlier: list[np.ndarray], side: np.ndarray) -> np.ndarray:
    """Rows that may link with another row of the tile, not counting pairs that share an earlier tile."""
    out = np.zeros(len(n), bool)
    band, wide, told = _band(n), np.array([8 * len(b) for b in bits]), _told(earlier)
    for b in np.unique(band):
        own, met = np.nonzero(band == b)[0], np.nonzero((band == b) | (band == b + 1))[0]
        to = int(wide[own].min())
        mine, theirs = _at_width([bits[i] for i in own], wide[own], to), _at_width([bits[i] for i in met], wide[met], to)
        for at in range(0, len(own), 256):
            rows = own[at : at + 256]
            close = _may_link(n[rows], n[met], _differing(mine[at : at + 256], theirs)) & (rows[:, None] != met[None, :])
            close &= (side[rows][:, None] == 2) | (side[rows][:, None] != side[met][None, :])
            for word in range(told.shape[1]):
                close &= told[rows, word][:, None] & told[met, word][None, :] == 0
            out[rows] |= close.any(axis=1)
            out[met] |= close.any(axis=0)
    return out


def _groups(batches, columns: int):
    """Runs of equal (tile, part), the first two columns of sorted rows, as lists of columns; a run may span batches."""
    held: list[pa.RecordBatch] = []
    at = None

    def whole(parts):
        return [pa.chunked_array([p.column(i) for p in parts]).combine_chunks() for i in range(2, columns)]

    for batch in batches:
        if not batch.num_rows:
            continue
        tile, part = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)
        cuts = [0, *(np.nonzero((tile[1:] != tile[:-1]) | (part[1:] != part[:-1]))[0] + 1).tolist(), batch.num_rows]
        for low, high in zip(cuts, cuts[1:]):
            here = (int(tile[low]), int(part[low]))
            if here != at:
                if held:
                    yield at[0], whole(held)
                held, at = [], here
            held.append(batch.slice(low, high - low))
    if held:
        yield at[0], whole(held)


def partners(rows: DataFrame, piece: int = PIECE) -> DataFrame:
    """(tile, set_key) of the rows (tile, set_key, n, bits, earlier) that have a partner in their tile."""
    cut = rows.join(_pieces(rows, F.lit(1), piece), "tile", "left").withColumn("cuts", F.coalesce("cuts", F.lit(1)))
    dealt = _paired(cut).select("tile", "part", "set_key", "n", "bits", "earlier", "side").repartition("tile", "part").sortWithinPartitions("tile", "part")

    def mark(batches):
        tiles: list[int] = []
        keys: list[bytes] = []
        for tile, (key, n, bits, earlier, side) in _groups(batches, 7):
            if len(key) < 2:
                continue
            sizes, sides, maps = n.to_numpy(), side.to_numpy(), bits.to_pylist()
            if len(key) <= FEW:
                found = marked_few(sizes.tolist(), maps, earlier.to_pylist(), sides.tolist())
            else:
                bounds, flat = earlier.offsets.to_numpy(), earlier.values.to_numpy()
                found = marked(sizes, maps, [flat[a:b] for a, b in zip(bounds, bounds[1:])], sides)
            names = [k for k, yes in zip(key.to_pylist(), found) if yes]
            keys += names
            tiles += [tile] * len(names)
            if len(keys) > 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(tiles, pa.int64()), pa.array(keys, pa.binary())], names=["tile", "set_key"])
                tiles, keys = [], []
        yield pa.RecordBatch.from_arrays([pa.array(tiles, pa.int64()), pa.array(keys, pa.binary())], names=["tile", "set_key"])

    return dealt.mapInArrow(mark, "tile long, set_key binary")


# ---- exact intersections -----------------------------------------------------


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    """Of sorted sets, whether PERCENT of the union is shared."""
    at = np.searchsorted(b, a)
    same = int((b[np.minimum(at, len(b) - 1)] == a).sum())
    return 100 * same >= PERCENT * (len(a) + len(b) - same)


def forest(sets: list[np.ndarray], side: np.ndarray) -> list[tuple[int, int]]:
    """Links that join the same sets as all links between rows of sides that meet would."""
    order = np.argsort([len(s) for s in sets], kind="stable")
    sets, side = [sets[i] for i in order], side[order]
    n = np.array([len(s) for s in sets])
    wide = np.array([width(x) for x in n])
    label = np.arange(len(sets))
    maps: dict[int, np.ndarray] = {}
    out = []
    for i in range(len(sets) - 1):
        last = np.searchsorted(n, n[i] * 100 // PERCENT, side="right")
        met = np.arange(i + 1, last)
        met = met[(label[met] != label[i]) & ((side[i] == 2) | (side[met] != side[i]))]
        if not len(met):
            continue
        w = int(wide[i])
        if w not in maps:  # rows are in order of size: all that a row of this width meets are wider or as wide
            low, high = np.searchsorted(n, n[wide == w][0]), np.searchsorted(n, n[wide == w][-1] * 100 // PERCENT, side="right")
            maps = {w: np.zeros((len(sets), w // 64), np.uint64)}
            for j in range(low, high):
                maps[w][j] = bitmap(sets[j], w).view("<u8")
        close = met[_may_link(n[i : i + 1], n[met], _differing(maps[w][i : i + 1], maps[w][met]))[0]]
        for j in close.tolist():
            if label[j] != label[i] and linked(sets[i], sets[j]):
                label[label == label[j]] = label[i]
                out.append((int(order[i]), int(order[j])))
    return out


def intersect(rows: DataFrame) -> DataFrame:
    """(a, b): forests of the links within each (tile, part) of rows (tile, part, set_key, members, side)."""
    dealt = rows.select("tile", "part", "set_key", "members", "side").repartition("tile", "part").sortWithinPartitions("tile", "part")

    def compare(batches):
        for _, (key, members, side) in _groups(batches, 5):
            if len(key) < 2:
                continue
            first = {k: i for i, k in enumerate(key.to_pylist())}  # a leader stands in its own piece twice
            at = np.array(sorted(first.values()))
            names = [k.as_py() for k in key.take(pa.array(at))]
            sets = [np.frombuffer(m.as_buffer(), np.int64) for m in members.take(pa.array(at))]
            found = forest(sets, side.to_numpy()[at])
            yield pa.RecordBatch.from_arrays([pa.array([names[i] for i, _ in found], pa.binary()), pa.array([names[j] for _, j in found], pa.binary())], names=["a", "b"])

    return dealt.mapInArrow(compare, "a binary, b binary")


def _led(rows: DataFrame) -> DataFrame:
    """Rows of a cut tile by piece, and some leaders with every piece."""
    leads = (F.col("cuts") > 1) & (F.pmod(F.xxhash64(F.lit(1), "set_key"), F.col("rows")) < LEADERS)
    parts = F.when(leads, F.sequence(F.lit(0), F.col("cuts") - 1)).otherwise(F.array(_own(F.col("cuts"))))
    return rows.withColumn("part", F.explode(parts)).withColumn("side", F.lit(2))


def _rest(rows: DataFrame, piece: int) -> DataFrame:
    """Of cut tiles with components (root): rows outside of the tile's largest component with each other and with all of it."""
    sizes = rows.groupBy("tile", "root").agg(F.sum("n").alias("n"))
    tops = sizes.groupBy("tile").agg(F.max_by("root", F.struct("n", "root")).alias("top"), F.max("n").alias("top_n"), F.sum("n").alias("all_n"))
    cuts = lambda n: F.greatest(F.ceil(n / piece), F.lit(1)).cast("int")
    plan = tops.filter("all_n > top_n").select("tile", "top", cuts(F.col("all_n") - F.col("top_n")).alias("cuts"), cuts(F.col("top_n")).alias("top_cuts"))
    told = rows.join(plan, "tile")
    outside = told.filter("root != top")
    within = _paired(outside.drop("top", "top_cuts"))
    with_top = outside.withColumn("own", _own(F.col("cuts"))).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("top_cuts") - 1))).withColumn("side", F.lit(0))
    top = told.filter("root = top").withColumn("other", _own(F.col("top_cuts"))).withColumn("own", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1))).withColumn("side", F.lit(1))
    columns = ["tile", "part", "set_key", "members", "side"]
    number = F.col("cuts") * F.col("cuts") + F.col("own") * F.col("top_cuts") + F.col("other")
    return within.select(columns).unionByName(with_top.unionByName(top).withColumn("part", number).select(columns))


# ---- the join ----------------------------------------------------------------


def similar_classes(docs: DataFrame, piece: int = PIECE, piece_shingles: int = PIECE_SHINGLES) -> tuple[DataFrame, DataFrame]:
    """(rows, classes): doc_id, n, set_key of every document; set_key, least (struct with doc_id) of every class of equal sets, over all sets that it reaches."""
    spark = docs.sparkSession
    sets, _ = written(shingle_sets(docs), "sets")
    first = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")
    classes, classes_path = written(sets.filter("n > 0").groupBy("set_key").agg(F.min(first).alias("least"), F.max("n").alias("n"), F.first("prefix").alias("prefix"), F.first("bits").alias("bits")), "set-classes")
    light = classes.select("set_key", F.explode("prefix").alias("tile"))
    shared = light.groupBy("tile").agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1").select("tile")
    places = light.join(shared, "tile").groupBy("set_key").agg(F.array_sort(F.collect_list("tile")).alias("tiles"))
    rows = classes.join(places, "set_key").select("set_key", "n", "bits", "tiles", F.posexplode("tiles").alias("nth", "tile"))
    tiles, tiles_path = written(partners(rows.select("tile", "set_key", "n", "bits", F.slice("tiles", F.lit(1), F.col("nth")).alias("earlier")), piece), "tiles")
    marks = tiles.distinct()
    # Texts of the marked classes' first rows, read again.
    wanted = classes.join(marks.select("set_key").distinct(), "set_key", "left_semi").select(F.col("least.doc_id").alias("of_id"), F.col("least.text_hash").alias("of_hash"))
    texts = docs.select("doc_id", "text", row_hash().alias("of_text")).join(wanted, F.col("doc_id").eqNullSafe(F.col("of_id")) & (F.col("of_text") == F.col("of_hash")), "left_semi")
    whole = shingle_sets(texts, members=True).groupBy("set_key").agg(F.first("members").alias("members"), F.max("n").alias("n"))
    placed, placed_path = written(marks.join(whole, "set_key"), "marked-sets")
    sizes = placed.groupBy("tile").agg(F.sum("n").alias("weight"), F.count(F.lit(1)).alias("rows")).filter(F.col("weight") > piece_shingles)
    cut, cut_path = written(sizes.select("tile", F.ceil(F.col("weight") / piece_shingles).cast("int").alias("cuts"), "rows"), "cut-tiles")
    dealt = placed.join(cut, "tile", "left").withColumn("cuts", F.coalesce("cuts", F.lit(1))).withColumn("rows", F.coalesce("rows", F.lit(1)))
    links, links_path = written(intersect(_led(dealt)), "set-links")
    roots = components(links)
    if not cut.isEmpty():
        known = placed.join(cut.select("tile"), "tile", "left_semi").join(roots.withColumnRenamed("node", "set_key"), "set_key", "left").withColumn("root", F.coalesce("root", "set_key"))
        more, more_path = written(intersect(_rest(known, piece_shingles)), "more-set-links")
        roots = components(links.unionByName(more))
        discard(spark, more_path)
    least = classes.join(roots.withColumnRenamed("node", "set_key"), "set_key").groupBy("root").agg(F.min("least").alias("of_all"))
    reached = roots.join(least, "root").select(F.col("node").alias("set_key"), "of_all")
    named, _ = written(classes.select("set_key", "least").join(reached, "set_key", "left").select("set_key", F.coalesce("of_all", "least").alias("least")), "named-classes")
    discard(spark, classes_path, tiles_path, placed_path, cut_path, links_path)
    return sets.select("doc_id", "n", "set_key"), named


def jaccard_components(docs: DataFrame, piece: int = PIECE, piece_shingles: int = PIECE_SHINGLES) -> DataFrame:
    """doc_id, n_shingles, component_id: the least doc_id that links reach."""
    rows, classes = similar_classes(docs, piece, piece_shingles)
    found = rows.filter("n > 0").join(classes, "set_key").select("doc_id", F.col("n").alias("n_shingles"), F.col("least.doc_id").alias("component_id"))
    return found.unionByName(rows.filter("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))


#: The same rows in SQL, on the shingles themselves.
JACCARD_SQL = r"""
WITH RECURSIVE ws AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
long AS (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM ws WHERE len(w) >= 5),
sh AS MATERIALIZED (SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS s FROM long UNION ALL SELECT doc_id, array_to_string(w, ' ') FROM ws WHERE len(w) BETWEEN 1 AND 4),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM sh GROUP BY 1),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
links AS MATERIALIZED (SELECT a, b FROM shared JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 80 * (x.n + y.n - i)),
both_ways AS MATERIALIZED (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(a, b) AS (SELECT a, b FROM both_ways UNION SELECT r.a, l.b FROM reach r JOIN both_ways l ON l.a = r.b),
least_of AS (SELECT a, min(b) AS b FROM reach GROUP BY 1)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, least(d.doc_id, coalesce(r.b, d.doc_id)) AS component_id FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN least_of r ON r.a = d.doc_id
"""
