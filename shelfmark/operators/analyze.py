"""A user's function over tasks, batch by batch: prompt in, text out; failures become rows."""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfmark.functions.text import BATCH_TOKENS, CHARS_PER_TOKEN
from shelfmark.sources.shared import discard, shared_path


def local_analyzer(prompt: str) -> str:
    """A deterministic stand-in for a model: size and digest of the prompt."""
    return f"{len(prompt)} characters, {prompt.count(chr(10)) + 1} lines, {hashlib.md5(prompt.encode()).hexdigest()}"


def _outcome(analyzer: Callable[[str], str], text: str | None) -> tuple[str, str | None, str | None]:
    """status, content, error of one call."""
    if text is None or not text.strip():
        return "failed", None, "empty prompt"
    try:
        return "success", analyzer(text), None
    except Exception as failure:  # the row says what happened
        return "failed", None, f"{type(failure).__name__}: {failure}"


def analyze_tasks(tasks: DataFrame, analyzer: Callable[[str], str] = local_analyzer, prompt: str = "prompt") -> DataFrame:
    """tasks (without the prompt) + (status, content, error). An empty prompt is an error; an exception fails its row only.

    Narrow: a task's partition is where it is. A task that runs again after a lost executor calls the function again; ``analyze_once`` does not.
    """
    keep = [c for c in tasks.columns if c != prompt]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in tasks.select(*keep).schema) + ", status string, content string, error string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = pd.DataFrame([_outcome(analyzer, p) for p in batch[prompt]], columns=["status", "content", "error"], index=batch.index)
            yield pd.concat([batch[keep], out], axis=1)

    return tasks.select(*keep, prompt).mapInPandas(run, schema)


def analyze_once(tasks: DataFrame, log_path: str, analyzer: Callable[[str], str] = local_analyzer, prompt: str = "prompt", every: int = 8) -> DataFrame:
    """What ``analyze_tasks`` gives, with one call for each distinct prompt, however often tasks run.

    Outcomes are kept in a log below ``log_path``, a folder that the executors share: small files, one for ``every`` calls, in a folder for the
    first two digits of the prompts' SHA-256. Prompts are sorted by digest, so a task reads each of its folders before the first
    call that belongs there; what an earlier attempt, job or run has logged is not called again, except for failures of earlier runs. A task that
    dies repeats the calls since its last file, ``every`` at most (1: none). Two attempts at the same time may both call.
    """
    from shelfmark.sources.document_files import _open

    spark, run = tasks.sparkSession, uuid.uuid4().hex
    key = "prompt_digest"
    while key in tasks.columns:
        key += "_"
    marked = tasks.withColumn(key, F.when(F.trim(F.col(prompt)) != "", F.sha2(F.col(prompt), 256)))
    asked = marked.filter(F.col(key).isNotNull()).groupBy(key).agg(F.first(prompt).alias("text")).sortWithinPartitions(key)

    def logged(system, folder: str) -> dict[str, dict]:
        from pyarrow import fs

        known: dict[str, dict] = {}
        for f in system.get_file_info(fs.FileSelector(folder, allow_not_found=True)):
            with system.open_input_stream(f.path) as lines:
                rows = [json.loads(line) for line in lines.read().decode("utf-8").splitlines()]
            known |= {r["digest"]: r for r in rows if r["status"] == "success" or r["run"] == run}
        return known

    def call(batches):
        system, base = _open(log_path)
        at, known, pending = None, {}, []

        def flush():
            if pending:
                system.create_dir(f"{base}/{at}", recursive=True)
                name = f"{base}/{at}/{uuid.uuid4().hex}"
                with system.open_output_stream(f"{name}.part") as out:
                    out.write("".join(json.dumps(p) + "\n" for p in pending).encode("utf-8"))
                system.move(f"{name}.part", f"{name}.jsonl")
                pending.clear()

        for batch in batches:
            out = []
            for digest, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if digest[:2] != at:
                    flush()
                    at = digest[:2]
                    known = logged(system, f"{base}/{at}")
                if digest not in known:
                    status, content, error = _outcome(analyzer, text)
                    known[digest] = {"digest": digest, "run": run, "status": status, "content": content, "error": error}
                    pending.append(known[digest])
                    if len(pending) >= every:
                        flush()
                out.append([digest, *(known[digest][c] for c in ("status", "content", "error"))])
            flush()
            yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.string()) for c in zip(*out)] if out else [pa.array([], pa.string())] * 4, names=[key, "status", "content", "error"])

    outcomes, _ = _kept(asked.mapInArrow(call, f"{key} string, status string, content string, error string"), "outcomes")
    empty = F.col(key).isNull()
    joined = marked.drop(prompt).join(outcomes, key, "left")
    result = joined.withColumn("status", F.when(empty, "failed").otherwise(F.col("status"))).withColumn("error", F.when(empty, "empty prompt").otherwise(F.col("error")))
    return result.select(*tasks.drop(prompt).columns, "status", "content", "error")


#: Characters of a reduce prompt, if not given: the batch budget of dependency lists.
REDUCE_CHARS = int(BATCH_TOKENS * CHARS_PER_TOKEN)


def packed_in_order(parts: DataFrame, budget: int) -> DataFrame:
    """parts (repo_name, at, text) + pack: the number of the prompt that each part goes to, from 0, in order.

    A new prompt begins where the characters before reach a further multiple of half the budget: parts of up to half the budget
    make prompts of up to the budget. A prefix sum, so that no walk is needed; a repository has its batches in one sorted run.
    """
    before = F.sum(F.length("text") + len(_GAP)).over(Window.partitionBy("repo_name").orderBy("at").rowsBetween(Window.unboundedPreceding, -1))
    return parts.withColumn("pack", F.floor(F.coalesce(before, F.lit(0)) / F.lit(budget // 2)).cast("long"))


_GAP = "\n\n"


def pieces_within(parts: DataFrame, most: int) -> DataFrame:
    """Parts (repo_name, at, text) of at most ``most`` characters: longer ones are cut, in order."""
    cuts = F.greatest(F.ceil(F.length("text") / most), F.lit(1)).cast("int")
    rows = parts.withColumn("cuts", cuts).withColumn("cut", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)))
    return rows.select("repo_name", F.struct("at", "cut").alias("at"), F.when(F.col("cuts") == 1, F.col("text")).otherwise(F.substring(F.col("text"), F.col("cut") * most + 1, F.lit(most))).alias("text"))


def reduce_tree(parts: DataFrame, analyzer: Callable[[str], str] = local_analyzer, budget: int = REDUCE_CHARS) -> DataFrame:
    """repo_name, status, content, error, levels from texts (repo_name, at, text) in the order of ``at``.

    Level by level, a repository's texts are packed in order into prompts of at most ``budget`` characters, and each prompt's answer
    is a text of the next level, until one prompt holds all that is left: that is the last call. Texts above half the budget are cut, so no
    prompt is above it. A failed call's error stands in its place; a repository whose last call fails has failed. If answers do not get shorter,
    levels would never end: then, or when a level has as many prompts as the one before, it is an error. Every level is a written table.
    """
    if budget < 16:
        raise ValueError("a prompt needs room for two texts")
    spark = parts.sparkSession
    now, path = _kept(pieces_within(parts.select("repo_name", F.struct("at").alias("at"), "text"), budget // 2 - len(_GAP)), "reduce-parts")
    done: DataFrame | None = None
    level, most_before = 1, None
    while True:
        packs = packed_in_order(now, budget).groupBy("repo_name", "pack").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "text"))), lambda p: p["text"]), _GAP).alias("prompt"))
        # Which repositories are down to one prompt is known before the calls.
        single = packs.withColumn("packs", F.count(F.lit(1)).over(Window.partitionBy("repo_name")))
        answered, answered_path = _kept(analyze_tasks(single, analyzer), f"reduce-{level}")
        ended = answered.filter("packs = 1").select("repo_name", "status", "content", "error", F.lit(level).alias("levels"))
        done = ended if done is None else done.unionByName(ended)
        discard(spark, path)
        rest = answered.filter("packs > 1")
        most = rest.agg(F.max("packs")).first()[0]
        if not most:
            return done
        if most_before is not None and most >= most_before:
            raise ValueError(f"answers are too long to be reduced: {most} prompts of a repository stay at level {level}")
        text = F.when(F.col("status") == "success", F.col("content")).otherwise(F.concat(F.lit("failed: "), "error"))
        now, path = _kept(pieces_within(rest.select("repo_name", F.struct("pack").alias("at"), text.alias("text")), budget // 2 - len(_GAP)), "reduce-parts")
        level, most_before = level + 1, most


def _kept(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def map_reduce_analyze(batches: DataFrame, map_analyzer: Callable[[str], str] = local_analyzer, reduce_analyzer: Callable[[str], str] = local_analyzer, step: str = "dependencies", budget: int = REDUCE_CHARS) -> DataFrame:
    """repo_name, step_name, status, content, error from (repo_name, batch_index, prompt).

    The batches' texts, in order, are what is reduced, by one call a repository where they fit ``budget`` characters and by a tree of calls
    where they do not; failed batches are left out and named.
    """
    mapped = analyze_tasks(batches, map_analyzer)
    head = F.concat(F.lit("## Batch "), (F.col("batch_index") + 1).cast("string"))
    text = F.when(F.col("status") == "success", F.concat(head, F.lit(_GAP), "content")).otherwise(F.concat(head, F.lit(" failed")))
    reduced = reduce_tree(mapped.select("repo_name", F.col("batch_index").alias("at"), text.alias("text")), reduce_analyzer, budget)
    return reduced.select("repo_name", F.lit(step).alias("step_name"), "status", "content", "error")
