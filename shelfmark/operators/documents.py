"""Documents: sections put together per repository, written, compared and searched."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.functions.text import section_heading
from shelfmark.sources.document_files import FORMAT, register
from shelfmark.sources.shared import discard, shared_path

#: What a section says when it found nothing.
ABSENT = (
    "no feature flag usage detected", "no monitoring or observability detected", "no authentication mechanisms detected", "no data processing detected", "no llm usage detected",
)
SUFFIX = ".arch.md"


def assemble_document(results: DataFrame) -> DataFrame:
    """repo_name, document: sections in order, each under its name, with its description if it has one. Some twenty sections a repository."""
    text = F.concat(F.lit("# "), "step_name", F.lit("\n\n"), F.when(F.coalesce("description", F.lit("")) != "", F.concat("description", F.lit("\n\n"))).otherwise(""), "content")
    rows = results.groupBy("repo_name").agg(F.array_sort(F.collect_list(F.struct("ordinal", text.alias("text")))).alias("s"))
    return rows.select("repo_name", F.array_join(F.transform("s", lambda s: s["text"]), "\n\n").alias("document"))


def assemble_document_toc(results: DataFrame) -> DataFrame:
    """repo_name, document: a numbered table of contents, then the sections under anchored headings."""
    title = section_heading(F.col("step_name"))
    anchor = F.concat(F.lit("#"), "step_name")
    entry = F.concat(F.lit(". ["), title, F.lit("]("), anchor, F.lit(")\n"))
    about = F.when(F.coalesce("description", F.lit("")) != "", F.concat(F.lit("*"), "description", F.lit("*\n\n"))).otherwise("")
    text = F.concat(F.lit("## "), title, F.lit(" {"), anchor, F.lit("}\n\n"), about, "content")
    rows = results.groupBy("repo_name").agg(F.array_sort(F.collect_list(F.struct("ordinal", entry.alias("entry"), text.alias("text")))).alias("s"))
    contents = F.concat(F.lit("## Table of Contents\n\n"), F.array_join(F.transform("s", lambda s, i: F.concat((i + 1).cast("string"), s["entry"])), ""))
    return rows.select("repo_name", F.array_join(F.concat(F.array(contents), F.transform("s", lambda s: s["text"])), "\n\n---\n\n").alias("document"))


def saved_documents(documents: DataFrame) -> DataFrame:
    """file_name, document of those that have a name and content."""
    full = documents.filter((F.coalesce("repo_name", F.lit("")) != "") & (F.coalesce("document", F.lit("")) != ""))
    return full.select(F.concat("repo_name", F.lit(SUFFIX)).alias("file_name"), "document")


def file_names(saved: DataFrame) -> DataFrame:
    """Names without folders: slashes become underscores, for a document is one file of one folder."""
    return saved.withColumn("file_name", F.regexp_replace("file_name", r"[/\\\\]", "_"))


def write_documents(documents: DataFrame, path: str, overwrite: bool = False) -> DataFrame:
    """Writes each document to a file of its own below ``path``, a folder that the executors share, and returns the list of files, a written table.

    Names that are the same, or become the same as files, are an error before anything is written. Files appear when all tasks
    have succeeded; a file of an earlier run with the same name is replaced, with ``overwrite`` all others go. The sink counts the files of
    every task before it moves them, so the list is what is on disk.
    """
    spark = documents.sparkSession
    named = file_names(saved_documents(documents))
    # Texts are written once, so that the names that are checked are those of the files.
    kept = shared_path(spark, "documents")
    named.write.parquet(kept)
    rows = spark.read.schema(named.schema).parquet(kept)
    clashes = rows.groupBy("file_name").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").orderBy("file_name").limit(10).collect()
    if clashes:
        discard(spark, kept)
        raise ValueError("documents would overwrite each other: " + ", ".join(f"{r['file_name']} ({r['n']} times)" for r in clashes))
    register(spark)
    rows.write.format(FORMAT).mode("overwrite" if overwrite else "append").option("path", path).save()
    listed = shared_path(spark, "saved-files")
    rows.select("file_name").write.parquet(listed)
    discard(spark, kept)
    return spark.read.schema("file_name string").parquet(listed)


def export_documents(documents: DataFrame, path: str) -> None:
    """All documents as one table."""
    saved_documents(documents).write.mode("overwrite").parquet(path)


def diff_documents(left: DataFrame, right: DataFrame, by: list[str]) -> DataFrame:
    """by + status: only-left, only-right, same or different. Each side has a row a section (``by``) and its content."""
    a = left.select(*by, F.col("content").alias("a"), F.lit(True).alias("in_a"))
    b = right.select(*by, F.col("content").alias("b"), F.lit(True).alias("in_b"))
    status = F.when(F.col("in_b").isNull(), "only-left").when(F.col("in_a").isNull(), "only-right").when(F.col("a").eqNullSafe(F.col("b")), "same").otherwise("different")
    return a.join(b, by, "full_outer").select(*by, status.alias("status"))


def search_documents(sections: DataFrame, term: str) -> DataFrame:
    """Sections that hold a term in any case, with the number of hits; the empty term finds nothing."""
    if not term:
        return sections.select("repo_name", "step_name", F.lit(0).cast("long").alias("hits")).limit(0)
    low = F.lower("content")
    hits = ((F.length(low) - F.length(F.replace(low, F.lit(term.lower()), F.lit("")))) / len(term.lower())).cast("long")
    return sections.filter(low.contains(term.lower())).select("repo_name", "step_name", hits.alias("hits"))


def section_coverage(sections: DataFrame) -> DataFrame:
    """repo_name, step_name, found: false where every section of that step says that it found nothing."""
    low = F.lower(F.trim("content"))
    nothing = F.lit(False)
    for sentence in ABSENT:
        nothing = nothing | low.startswith(sentence)
    return sections.groupBy("repo_name", "step_name").agg(F.bool_or(~nothing).alias("found"))


def absent_sections(sections: DataFrame, steps: list[str]) -> DataFrame:
    """Coverage as a matrix: a column a step, true where the section found something, false where it says it did not, null where there is none."""
    return section_coverage(sections).groupBy("repo_name").pivot("step_name", steps).agg(F.bool_or("found"))
