"""Rows that operators must bear: nulls in every column, empty and very long texts, ties, repeats, clashing extra columns."""

from pyspark.sql import DataFrame

EXTRA = "size long, Text_Hash string, gone string, row_key string, nth int, copies string, text_key string, quality_score string, line_key string, fp string, length string, bin string, leaf string, rank string"
LONG = " ".join(f"word{i % 977}" for i in range(60_000))
TEXTS = [
    (1, "One two three four five six.\nA second line here.\nA third one too.\nAnd the last.", "en", "a"),
    (2, "One two three four five six.\nA second line here.\nA third one too.\nAnd another end.", "en", "a"),
    (3, "", "en", "a"), (4, None, "de", "b"), (5, "kurz", None, "b"), (6, "   \t \n ", "de", None), (7, LONG, "en", None), (8, LONG, "en", "c"),
    (None, "no id at all in this row", "en", "c"), (None, None, None, None), (9, "same row", "fr", "a"), (9, "same row", "fr", "a"), (9, "same id, other text", "fr", "a"),
    (10, "ümläut ñ 日本語 👩‍👩‍👧 ﬁ", "de", "b"), (11, "\n\n\n\n", "de", "b"), (12, "a\na\na\na\na", "de", "b"),
]


def odd_documents(spark, rows=TEXTS) -> DataFrame:
    n = len(EXTRA.split(","))
    data = [(i, t, lang, src, None if t is None else len(t), *([7] + ["x"] * 3 + [5] + ["x"] * (n - 5))) for i, t, lang, src in rows]
    return spark.createDataFrame(data, f"doc_id long, text string, lang string, source string, n_chars long, {EXTRA}").repartition(3)


def no_documents(spark) -> DataFrame:
    return odd_documents(spark).filter("false")
