"""An inverted index of document sections, for terms of any length in any case.

Lower-cased contents are cut into their runs of one, two and three characters. A posting says which of some neighbouring sections
hold a run, and how often, and lies in the folder of its run's bucket, so a search reads the buckets of the term's runs and no others. Up to three
characters the postings are the answer. A longer term is in sections only that hold all of its runs; the contents of those are read, by
their own buckets, and searched. Contents are a keyed table. An update numbers the sections that it changes anew and adds their postings, so
what it writes grows with the change, not with the index. Postings whose number no section has any more count for nothing; ``drop_dead`` takes them out.
"""

from __future__ import annotations

import functools
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate, chain

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.sources.keyed import BUCKET, STAGED, bucket_of, merge, read_keyed, recover, rewrite, stage

SECTION = ["repo_name", "step_name"]
#: What numbers a section: the update that wrote it, its bucket among the contents, and an id.
NUMBER = ["edition", "home", "id"]
CONTENTS = "repo_name string, step_name string, content string, edition string, id long, bucket int"
POSTINGS = "run string, edition string, home int, base long, places array<int>, hits array<int>"
RUN = 3
BUCKETS = 64
#: Candidates up to this many are looked up by bucket; more are found by a join over all contents.
FEW = 1000
#: A posting is of sections whose ids are closer than this. Postings are given out whenever they have so many entries, which bounds a task's memory.
SPAN, ENTRIES = 1 << 15, 300_000


def occurrences(low: Column, term: Column) -> Column:
    """How often a term stands in a text, without overlaps, from the left."""
    return ((F.length(low) - F.length(F.replace(low, term, F.lit("")))) / F.length(term)).cast("long")


def runs(low: str) -> dict[str, int]:
    """Distinct runs of up to RUN characters, and how often each stands in a text, without overlaps, from the left."""
    found = Counter(low)
    for n in range(2, RUN + 1):
        found.update(map("".join, zip(*(low[k:] for k in range(n)))))  # noqa: B905
    # Only a run that ends as it begins can overlap itself.
    return {run: low.count(run) if len(run) > 1 and run[0] == run[-1] else n for run, n in found.items()}


def _posted(held: dict[str, tuple[list, list]], edition: str, home: int, base: int) -> pa.RecordBatch:
    ends = pa.array(accumulate((len(places) for places, _ in held.values()), initial=0), pa.int32())
    places, hits = (pa.ListArray.from_arrays(ends, pa.array(chain.from_iterable(h[side] for h in held.values()), pa.int32())) for side in (0, 1))
    same = lambda value, kind: pa.array([value] * len(held), kind)
    columns = {"run": pa.array(held, pa.string()), "edition": same(edition, pa.string()), "home": same(home, pa.int32()), "base": same(base, pa.int64()), "places": places, "hits": hits}
    return pa.RecordBatch.from_pydict(columns)


def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Postings of sections (edition, home, id, low) that come by number."""
    held: dict[str, tuple[list, list]] = {}
    entries, of = 0, None
    for batch in batches:
        for edition, home, number, low in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if of and (of[:2] != (edition, home) or number - of[2] >= SPAN or entries >= ENTRIES):
                yield _posted(held, *of)
                held, entries, of = {}, 0, None
            of = of or (edition, home, number)
            found = runs(low)
            entries += len(found)
            for run, n in found.items():
                places, hits = held.get(run) or held.setdefault(run, ([], []))
                places.append(number - of[2])
                hits.append(n)
    if held:
        yield _posted(held, *of)


def postings(sections: DataFrame) -> DataFrame:
    """run, edition, home, base, places, hits of numbered sections: the k-th of ``places`` and ``hits`` are of the section ``base`` + place. Texts are dealt once, neighbours together."""
    low = sections.select("edition", F.col(BUCKET).alias("home"), "id", F.lower("content").alias("low")).filter("low <> ''")
    dealt = low.repartition("home", F.floor(F.col("id") / 4096)).sortWithinPartitions("home", "id")
    return dealt.mapInArrow(cut, POSTINGS)


def _dealt(of: DataFrame) -> DataFrame:
    """By bucket, a large one in several tasks, and by run, so that a search skips most of a file."""
    return of.hint("rebalance", BUCKET).sortWithinPartitions(BUCKET, "run")


def changed_sections(sections: DataFrame, path: str) -> DataFrame:
    """Sections that are new or differ from the index."""
    known = read_keyed(sections.sparkSession, f"{path}/contents", CONTENTS).select(*SECTION, F.col("content").alias("_old"))
    both = sections.select(*SECTION, "content").join(known, SECTION, "left")
    return both.filter(~F.col("content").eqNullSafe(F.col("_old")) | F.col("_old").isNull()).drop("_old")


def update_index(sections: DataFrame, path: str, buckets: int = BUCKETS) -> None:
    """Brings the index below ``path`` up to date with ``sections`` (repo_name, step_name, content): only what changed is cut and written.

    Sections that are not given stay as they are; a null content takes a section out.
    """
    spark = sections.sparkSession
    contents, posted = f"{path}/contents", f"{path}/postings"
    recover(spark, contents)
    recover(spark, posted)
    edition = stage(changed_sections(sections, path), contents, SECTION, ["content"], buckets, numbered=True)
    # Postings come first: until contents have the new numbers a search finds what it found before, and the same update starts again.
    new = postings(spark.read.schema(CONTENTS).parquet(f"{contents}/{STAGED}/{edition}"))
    _dealt(new.withColumn(BUCKET, bucket_of(["run"], buckets))).write.mode("append").partitionBy(BUCKET).parquet(posted)
    merge(spark, contents, edition, SECTION, ["content"])


def _numbers(spark: SparkSession, path: str) -> DataFrame:
    """What numbers the index's sections, and their contents."""
    return spark.read.schema(CONTENTS).parquet(f"{path}/contents").withColumnRenamed(BUCKET, "home")


def drop_dead(spark: SparkSession, path: str) -> None:
    """Writes the postings anew without sections that changed since. A bucket in which all are dead stays as it is."""
    posted = f"{path}/postings"
    recover(spark, posted)
    of = [BUCKET, "run", "edition", "home", "base"]
    entries = spark.read.schema(f"{POSTINGS}, {BUCKET} int").parquet(posted).select(*of, F.inline(F.arrays_zip("places", "hits"))).withColumn("id", F.col("base") + F.col("places"))
    alive = entries.join(_numbers(spark, path).select(*NUMBER), NUMBER, "left_semi")
    e = F.sort_array(F.collect_list(F.struct("places", "hits")))
    kept = alive.groupBy(*of).agg(e.alias("e")).select(*of, F.col("e.places").alias("places"), F.col("e.hits").alias("hits"))
    rewrite(spark, posted, _dealt(kept))


def _term_runs(term: str) -> list[str]:
    return [term] if len(term) <= RUN else sorted({term[i : i + RUN] for i in range(len(term) - RUN + 1)})


def _buckets(spark: SparkSession, values: list[tuple], keys: list[str], buckets: int) -> list[int]:
    """The buckets of some keys, worked out as the tables do."""
    rows = spark.createDataFrame(values, ", ".join(f"{k} string" for k in keys))
    return sorted(r[0] for r in rows.select(bucket_of(keys, buckets)).distinct().collect())


def found_runs(spark: SparkSession, path: str, terms: list[str], buckets: int = BUCKETS) -> DataFrame:
    """run, edition, home, id, hits for the runs of some terms; reads their buckets only."""
    wanted = sorted({run for t in terms for run in _term_runs(t)})
    table = spark.read.schema(f"{POSTINGS}, {BUCKET} int").parquet(f"{path}/postings").filter(F.col(BUCKET).isin(_buckets(spark, [(w,) for w in wanted], ["run"], buckets)))
    entries = table.filter(F.col("run").isin(wanted)).select("run", "edition", "home", "base", F.inline(F.arrays_zip("places", "hits")))
    return entries.select("run", "edition", "home", (F.col("base") + F.col("places")).alias("id"), F.col("hits").cast("long").alias("hits"))


def search_index(spark: SparkSession, path: str, *terms: str, buckets: int = BUCKETS) -> DataFrame:
    """repo_name, step_name, hits: sections that hold all terms, and how often; an empty term, or none, finds nothing."""
    low = [t.lower() for t in terms]
    if not low or "" in low:
        return spark.createDataFrame([], "repo_name string, step_name string, hits long")
    wanted = {t: _term_runs(t) for t in dict.fromkeys(low)}
    found = found_runs(spark, path, low, buckets)
    n_runs = len({run for of in wanted.values() for run in of})
    # Only sections of today have their numbers among the contents.
    contents = _numbers(spark, path)
    if all(len(of) == 1 and of[0] == t for t, of in wanted.items()):
        hits = F.sum(functools.reduce(lambda a, t: a + F.when(F.col("run") == t, F.col("hits") * low.count(t)).otherwise(0), wanted, F.lit(0)))
        of_all = found.groupBy(*NUMBER).agg(F.count(F.lit(1)).alias("runs"), hits.alias("hits")).filter(F.col("runs") == n_runs)
        return of_all.join(contents, NUMBER).select(*SECTION, "hits")
    candidates = found.groupBy(*NUMBER).agg(F.count(F.lit(1)).alias("runs")).filter(F.col("runs") == n_runs).select(*NUMBER)
    some = candidates.limit(FEW + 1).collect()
    if not some:
        return spark.createDataFrame([], "repo_name string, step_name string, hits long")
    if len(some) <= FEW:
        contents = contents.filter(F.col("home").isin(sorted({r["home"] for r in some})))
    text = F.lower("content")
    each = [occurrences(text, F.lit(t)) for t in low]
    rows = contents.join(candidates, NUMBER, "left_semi").filter(functools.reduce(lambda a, b: a & b, (text.contains(t) for t in wanted)))
    return rows.select(*SECTION, functools.reduce(lambda a, b: a + b, each).alias("hits"))
