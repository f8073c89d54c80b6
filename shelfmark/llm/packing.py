"""Best-fit packing of tokenised documents into fixed-length sequences.

Bulk-synchronous best fit. Documents are cut only where they are longer than a sequence; as
many empty sequences are opened as all tokens need. In each superstep the pieces that are
left and the gaps of the sequences are range-sorted by size together, largest first, gaps
before pieces of their size, ties by rank. A sweep over that order gives every piece its
successor: the smallest gap before it that no larger piece, nor one of a lower rank, has
taken. That is the matching of closing with opening brackets, so it runs over the slices
of the order side by side: each slice matches what it can with a stack, and what is left is
matched across slices by its height, the number of gaps less the number of pieces up to
there. Each sequence takes a piece at most; then gaps are updated and the next superstep
begins. When no piece fits any gap, further sequences are opened. As soon as one slice holds
all that is left, the last supersteps run in its task.

Nulls and edge cases: a null or empty text is one piece of the end token; documents
with equal or null ids are packed as documents of their own; an empty table gives an
empty result; extra columns are dropped.
"""

from __future__ import annotations

import functools
import json
import re
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfmark.llm.common import materialise

CAPACITY = 2048
END_ID = 0
VOCABULARY = "word_bpe_49k.json"
#: Pieces and gaps that a slice of the order holds, as long as there are no more slices than shuffle partitions.
SLICE = 1 << 16
#: Words whose ids a worker remembers.
REMEMBER = 500_000


# ---- tokens ------------------------------------------------------------------


#: Words that need no Unicode care: printable ASCII and precomposed Latin letters.
PLAIN = re.compile("[!-~\u00c0-\u024f]+")
#: Fixed value: how the vocabulary's file parts lower-cased text.
PARTS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
#: A byte that UTF-8 never has; it stands for the end of a word.
WORD_END = b"\xff"


@functools.lru_cache(maxsize=1)
def _load(path: str):
    """The tokenizer; and, for single words, its merges as byte ranks with the ids they stand for."""
    import tiktoken
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    model = json.loads(tokenizer.to_str())["model"]
    # The usual alphabet of byte-level vocabularies: printable Latin-1 stands for itself, the other bytes follow from 256.
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in own]
    shown = {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}
    suffix = model["end_of_word_suffix"]

    def raw(token: str) -> bytes:
        end = token.endswith(suffix)
        return bytes(shown[sign] for sign in (token[: -len(suffix)] if end else token)) + WORD_END * end

    ranks = {bytes([b]): b for b in range(256)}
    ids = [-1] * 256
    for sign, byte in shown.items():
        ids[byte] = model["vocab"][sign]
    for sign, byte in shown.items():
        ranks[bytes([byte]) + WORD_END] = len(ids)
        ids.append(model["vocab"][sign + suffix])
    for pair in model["merges"]:
        first, second = pair.split(" ") if isinstance(pair, str) else pair
        ranks[raw(first) + raw(second)] = len(ids)
        ids.append(model["vocab"][first + second])
    bpe = tiktoken.Encoding("words", pat_str=r"\S+", mergeable_ranks=ranks, special_tokens={})
    return tokenizer, bpe._core_bpe.encode_single_piece, np.array(ids, "<u4")


class Encoder:
    """Ids of whole texts, as the tokenizer gives them.

    The vocabulary never joins what white space parts, so each space-separated word is
    encoded once and remembered. Plain words take their merges from byte ranks; all others
    go through the tokenizer itself.
    """

    def __init__(self, path: str):
        self.tokenizer, self.merge, self.of_rank = _load(path)
        self.known: dict[str, bytes] = {}
        self.parts: dict[str, bytes] = {}

    def part(self, part: str) -> bytes:
        if (found := self.parts.get(part)) is None:
            if len(self.parts) > REMEMBER:
                self.parts.clear()
            found = self.parts[part] = self.of_rank[self.merge(part.encode("utf-8") + WORD_END)].tobytes()
        return found

    def word(self, word: str) -> bytes:
        """Little-endian unsigned 32-bit ids of a word."""
        if PLAIN.fullmatch(word) and "<|" not in word:
            low = word.lower()
            return self.part(low) if low.isalpha() else b"".join(map(self.part, PARTS.findall(low)))
        return np.array(self.tokenizer.encode(word, add_special_tokens=False).ids, "<u4").tobytes()

    def ids(self, text: str) -> bytes:
        words = text.replace("\n", " ").split(" ")
        known = self.known
        try:
            return b"".join([known[w] for w in words])
        except KeyError:
            if len(known) > REMEMBER:
                known.clear()
            for w in words:
                if w not in known:
                    known[w] = self.word(w)
            return b"".join([known[w] for w in words])


@functools.lru_cache(maxsize=1)
def _encoder(path: str) -> Encoder:
    """One encoder, and so one memory of words, for all tasks of a worker."""
    return Encoder(path)


def pieces(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str = VOCABULARY, text: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: the documents' tokens, cut at ``capacity``."""
    key = docs.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]

    def cut(batches):
        encoder = _encoder(public_tokenizers.path(vocabulary))
        end, step = np.array([END_ID], "<u4").tobytes(), 4 * capacity
        for batch in batches:
            owner, rows = [], []
            for i, t in enumerate(batch.column(1)):
                ids = encoder.ids(t.as_py() or "") + end
                for k, at in enumerate(range(0, len(ids), step)):
                    owner.append(i)
                    part = ids[at : at + step]
                    rows.append((k, k * capacity, len(part) // 4, zlib.crc32(part)))
            cols = list(zip(*rows)) if rows else [[]] * 4
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owner, pa.int64())), pa.array(cols[0], pa.int32()), *(pa.array(c, pa.int64()) for c in cols[1:])], names=names)

    return docs.select("doc_id", text).mapInArrow(cut, f"doc_id {key}, piece int, start long, length long, ids_crc32 long")


# ---- supersteps --------------------------------------------------------------


def sweep(sizes: list[int], is_piece: list[bool], names: list[int]) -> tuple[dict[int, tuple[int, int]], list[int], list[int]]:
    """Of elements in order: (sequence, gap) for each piece that finds one, by place; places of the other pieces; places of the gaps left.

    ``names`` are the gaps' sequences.
    """
    found, alone, stack = {}, [], []
    for i, piece in enumerate(is_piece):
        if not piece:
            stack.append(i)
        elif stack:
            gap = stack.pop()
            found[i] = names[gap], sizes[gap]
        else:
            alone.append(i)
    return found, alone, stack


def _swept(elements: DataFrame, slices: int) -> DataFrame:
    """The elements with ``slice``, ``height`` in it, and, where a piece found a gap in its slice, ``sequence`` and ``gap``; gaps that were found are gone."""
    order = [F.col("size").desc(), F.col("is_piece"), F.col("tie")]
    dealt = elements.repartitionByRange(slices, *order) if slices > 1 else elements.coalesce(1)

    def settle(batches):
        held = list(batches)
        if not held:
            return
        table = pa.Table.from_batches(held)
        names = table["sequence"].to_pylist()
        found, alone, left = sweep(table["size"].to_pylist(), table["is_piece"].to_pylist(), names)
        sequence, gap, height = ([None] * table.num_rows for _ in range(3))
        for i, (taken, size) in found.items():
            sequence[i], gap[i] = taken, size
        for k, i in enumerate(alone):
            height[i] = -k
        for k, i in enumerate(left, 1):
            height[i], sequence[i] = k - len(alone), names[i]
        keep = pa.array(sorted([*found, *alone, *left]), pa.int64())
        here = pa.array([TaskContext.get().partitionId()] * table.num_rows, pa.int32())
        columns = {"slice": here, "height": pa.array(height, pa.int64()), "sequence": pa.array(sequence, pa.int64()), "gap": pa.array(gap, pa.int64())}
        out = pa.table({c: table[c] for c in ("size", "is_piece", "tie", "row")} | columns).take(keep)
        yield from out.combine_chunks().to_batches(max_chunksize=1 << 14)

    kinds = {f.name: f.dataType.simpleString() for f in elements.schema}
    shape = ", ".join(f"{c} {kinds[c]}" for c in ("size", "is_piece", "tie", "row"))
    return dealt.sortWithinPartitions(*order).mapInArrow(settle, f"{shape}, slice int, height long, sequence long, gap long")


def _across(swept: DataFrame) -> DataFrame:
    """What slices left, matched by height: closing brackets meet the opening one before them at the same height.

    A slice leaves one piece and one gap of a height at most, so a height has two rows a slice.
    """
    left = swept.filter(~F.col("is_piece") | F.col("gap").isNull())
    totals = left.groupBy("slice").agg(F.sum(F.when(F.col("is_piece"), -1).otherwise(1)).alias("total"))
    # One row a slice.
    before = totals.select("slice", F.coalesce(F.sum("total").over(Window.orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    placed = left.join(F.broadcast(before), "slice").withColumn("height", F.col("height") + F.col("before"))
    of_height = Window.partitionBy("height").orderBy("slice", F.col("is_piece").desc())
    gap_before = F.lag(F.when(~F.col("is_piece"), F.struct("sequence", "size"))).over(of_height)
    taken = F.coalesce(F.lead("is_piece").over(of_height), F.lit(False)) & ~F.col("is_piece")
    met = placed.withColumn("met", gap_before).withColumn("taken", taken).filter(~F.col("taken"))
    piece = F.col("is_piece")
    return met.select("size", "is_piece", "tie", "row", F.when(piece, F.col("met.sequence")).otherwise(F.col("sequence")).alias("sequence"), F.when(piece, F.col("met.size")).cast("long").alias("gap"))


def supersteps(pieces: list[int], gaps: list[tuple[int, int]], capacity: int, opened: int) -> list[tuple[int, int]]:
    """(sequence, gap) for every piece, by place, from supersteps over what one slice holds. ``gaps``: (gap, sequence); further sequences are numbered from ``opened``."""
    out: list[tuple[int, int]] = [(0, 0)] * len(pieces)
    left, fits = sorted(range(len(pieces)), key=lambda i: -pieces[i]), True
    while left:
        if not fits:
            new = -(-sum(pieces[i] for i in left) // capacity)
            gaps, opened = gaps + [(capacity, opened + k) for k in range(new)], opened + new
        order = sorted([(-g, 0, at) for at, (g, _) in enumerate(gaps)] + [(-pieces[i], 1, i) for i in left])
        found, _, _ = sweep([-n for n, _, _ in order], [kind == 1 for _, kind, _ in order], [gaps[at][1] if not kind else 0 for _, kind, at in order])
        free = {sequence: gap for gap, sequence in gaps}
        for at, (sequence, gap) in found.items():
            i = order[at][2]
            out[i], free[sequence] = (sequence, gap), gap - pieces[i]
        placed = {order[at][2] for at in found}
        left = [i for i in left if i not in placed]
        least = pieces[left[-1]] if left else 0
        gaps = [(gap, sequence) for sequence, gap in free.items() if gap >= least]
        fits = bool(placed and gaps)
    return out


def _finished(elements: DataFrame, capacity: int, opened: int) -> DataFrame:
    """size, row, sequence, gap of every piece: all supersteps that are left, once a single slice holds all elements."""

    def settle(batches):
        held = list(batches)
        if not held:
            return
        table = pa.Table.from_batches(held)
        is_piece = np.array(table["is_piece"].to_pylist())
        of_pieces, of_gaps = table.filter(pa.array(is_piece)), table.filter(pa.array(~is_piece))
        placed = supersteps(of_pieces["size"].to_pylist(), list(zip(of_gaps["size"].to_pylist(), of_gaps["sequence"].to_pylist())), capacity, opened)
        columns = [pa.array(c, pa.int64()) for c in (zip(*placed) if placed else ([], []))]
        out = pa.table({"size": of_pieces["size"], "row": of_pieces["row"], "sequence": columns[0], "gap": columns[1]})
        yield from out.combine_chunks().to_batches(max_chunksize=1 << 14)

    row = elements.schema["row"].dataType.simpleString()
    return elements.coalesce(1).sortWithinPartitions(F.col("size").desc(), "is_piece", "tie").mapInArrow(settle, f"size int, row {row}, sequence long, gap long")


def place_pieces(rows: DataFrame, capacity: int = CAPACITY, slice_rows: int = SLICE) -> DataFrame:
    """Adds sequence_id and offset to a table of pieces (read more than once)."""
    spark = rows.sparkSession
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]
    pieces_left = rows.select(
        F.col("length").cast("int").alias("size"), F.lit(True).alias("is_piece"), F.xxhash64("doc_id", "piece", "ids_crc32").alias("tie"),
        F.struct(*names).alias("row"), F.lit(None).cast("long").alias("sequence"),
    )
    row_type = pieces_left.schema["row"].dataType

    def empty(first: int, n: int) -> DataFrame:
        opened = spark.range(first, first + n).withColumnRenamed("id", "sequence")
        return opened.select(F.lit(capacity).alias("size"), F.lit(False).alias("is_piece"), F.xxhash64("sequence").alias("tie"), F.lit(None).cast(row_type).alias("row"), "sequence")

    summed = lambda df: df.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("tokens"), F.min("size").alias("least")).first()
    left, placements, opened, gaps, open_gaps = summed(pieces_left), [], 0, None, 0
    most = int(spark.conf.get("spark.sql.shuffle.partitions"))
    fits = False
    while left["n"]:
        if not fits:  # no piece fits any gap
            new = -(-left["tokens"] // capacity)
            fresh = empty(opened, new)
            gaps, open_gaps, opened = fresh if gaps is None else gaps.unionByName(fresh), open_gaps + new, opened + new
        if left["n"] + open_gaps <= slice_rows:
            placements.append(materialise(_finished(pieces_left.unionByName(gaps), capacity, opened), "finished"))
            break
        slices = max(1, min(most, (left["n"] + open_gaps) // slice_rows))
        swept = materialise(_swept(pieces_left.unionByName(gaps), slices), "swept")
        found = [swept.filter("is_piece AND gap IS NOT NULL")]
        rest = swept.drop("slice", "height")
        if slices > 1:
            rest = materialise(_across(swept), "across")
            found.append(rest.filter("is_piece AND gap IS NOT NULL"))
        pieces_left = rest.filter("is_piece AND gap IS NULL").select("size", "is_piece", "tie", "row", "sequence")
        matched = [f.select("size", "row", "sequence", "gap") for f in found]
        now = matched[0] if len(matched) == 1 else matched[0].unionByName(matched[1])
        before, left = left["n"], summed(pieces_left)
        fits = left["n"] < before
        placements.append(now)
        least = left["least"] or 0
        narrowed = now.select((F.col("gap") - F.col("size")).cast("int").alias("size"), F.lit(False).alias("is_piece"), F.xxhash64("sequence").alias("tie"), F.lit(None).cast(row_type).alias("row"), "sequence")
        same = rest.filter("NOT is_piece").select("size", "is_piece", "tie", "row", "sequence")
        # Gaps that no piece fits any more are out.
        gaps = same.unionByName(narrowed).filter(F.col("size") >= F.lit(least))
        open_gaps = gaps.count() if left["n"] else 0
        fits = fits and open_gaps > 0
    if not placements:
        return rows.select(*names, F.lit(None).cast("long").alias("sequence_id"), F.lit(None).cast("long").alias("offset")).limit(0)
    every = functools.reduce(DataFrame.unionByName, placements)
    return every.select("row.*", F.col("sequence").alias("sequence_id"), (F.lit(capacity) - F.col("gap")).cast("long").alias("offset"))


def pack(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    return place_pieces(materialise(pieces(docs, capacity, vocabulary), "pieces"), capacity)
