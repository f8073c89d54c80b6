"""Digests of long texts that stand in rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Hexadecimal digits that name a bucket: 4096 of them a key.
SPREAD = 3


def piece_digest(*parts: str) -> Column:
    """MD5 of a piece with its place; nulls are empty."""
    return F.md5(F.concat_ws("\n", *(F.coalesce(F.col(p).cast("string"), F.lit("")) for p in parts)))


def digest_tree(pieces: DataFrame, by: list[str], parts: list[str], out: str, spread: int = SPREAD) -> DataFrame:
    """by, out: a digest of each key's pieces that does not depend on how rows are dealt.

    A piece's digest covers its place (all of ``parts`` but the text) and its text, so the set of pieces is the text. Digests fall into buckets
    by their first digits; a bucket's digest is the MD5 of its sorted pieces, a key's that of its buckets in order. A key with a third of all
    rows is 4096 groups, and none of them holds a text.
    """
    d = pieces.select(*by, piece_digest(*parts).alias("d"))
    buckets = d.groupBy(*by, F.substring("d", 1, spread).alias("b")).agg(F.md5(F.array_join(F.array_sort(F.collect_list("d")), "")).alias("d"))
    return buckets.groupBy(*by).agg(F.md5(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("b", "d"))), lambda x: x["d"]), "")).alias(out))
