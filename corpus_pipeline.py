"""A corpus from raw documents to training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes it as
Parquet and reads it back as the next stage's documents. All stages but the last return
the columns of ``documents``. Extra columns are kept as they are, whatever their names; an
empty table gives an empty one at every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from shelfmark.llm import lines, mixing, packing, quality, simhash
from shelfmark.llm.common import materialise, table


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go.

    A null or empty text is scored as one passage without words. Rows alike get equal scores, so all of them stay or go.
    """
    return quality.drop_low_quality(docs, table(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of repeated three-line windows go, but for the first.

    No row goes: a text whose lines all go becomes empty, a null text stays null. Rows alike in id and text are one
    document and change alike; null ids come first. n_chars follows the text.
    """
    return lines.drop_repeated_lines(docs)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: the one of the least id, of equal ids the least text hash.

    Null, empty and wordless texts are copies of each other. A row without id stays only where its group has no id; of
    rows alike in id and text, one stays.
    """
    return simhash.drop_near_duplicates(docs)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents stand in the result as often as the mix takes them, up to three times.

    Documents without words have no size; they are taken at the rate of their source like any other. A null source is
    one of its own, ranked last. Rows alike in id, text and source share their copies evenly.
    """
    return mixing.mixture(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their place in a sequence.

    A null or empty text is one piece of the end token; rows that repeat are packed each.
    """
    return packing.pack(docs)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("line_dedup", line_dedup),
    ("simhash_near_dedup", simhash_near_dedup),
    ("source_mixing", source_mixing),
    ("best_fit_packing", best_fit_packing),
]

#: SQL cannot express the learned classifier, the anchors or the token ids.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return docs
