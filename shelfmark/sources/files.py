"""Files of repositories, and step catalogues."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.functions.text import prompt_version


def read_repo_files(spark: SparkSession, root: str, name_glob: str | None = None) -> DataFrame:
    """repo_name, path, content, length below ``root/<repo_name>/``; what is not UTF-8 is left out.

    ``name_glob`` filters names before any content is read.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if name_glob:
        reader = reader.option("pathGlobFilter", name_glob)
    files = reader.load(root)
    below = F.regexp_replace(F.col("path"), "^.*?" + _escaped(root.split(":", 1)[-1].strip("/")) + "/", "")
    text = F.col("content").cast("string")
    return files.filter(F.expr("is_valid_utf8(cast(content as string))")).select(
        F.substring_index(below, "/", 1).alias("repo_name"), F.regexp_replace(below, "^[^/]*/", "").alias("path"), text.alias("content"), F.col("length"),
    )


def _escaped(text: str) -> str:
    return "".join(c if c.isalnum() or c in "/_-" else "\\" + c for c in text)


STEP = "struct<name:string,file:string,description:string,required:boolean,order:int,context:array<struct<type:string,val:string>>>"


def read_steps(configurations: DataFrame, prompts: DataFrame) -> DataFrame:
    """Steps by type from configuration documents (repo_type, value) and prompt texts (file, content).

    A configuration that extends the base gets the base's steps first. repo_type, ordinal,
    step_name, file, description, required, order, context (step names), version.
    """
    shape = f"struct<extends:string,processing_order:array<{STEP}>,additional_prompts:array<{STEP}>>"
    parsed = configurations.select("repo_type", F.from_json("value", shape).alias("c"))
    nothing = F.array().cast(f"array<{STEP}>")
    base = parsed.filter("repo_type = 'base'").select(F.col("repo_type").alias("base_type"), F.col("c.processing_order").alias("base"))
    own = F.concat(F.coalesce("c.processing_order", nothing), F.coalesce("c.additional_prompts", nothing))
    extending = parsed.filter("repo_type <> 'base'").withColumn("base_type", F.when(F.col("c.extends").isNotNull(), "base"))
    all_steps = extending.join(base, "base_type", "left").select("repo_type", F.concat(F.coalesce("base", nothing), own).alias("steps"))
    rows = all_steps.select("repo_type", F.posexplode("steps").alias("ordinal", "s"))
    read = prompts.select(F.col("file").alias("prompt_file"), prompt_version(F.col("content")).alias("version"))
    return rows.join(read, F.col("s.file") == F.col("prompt_file"), "left").select(
        "repo_type", "ordinal", F.col("s.name").alias("step_name"), "s.file", "s.description", F.coalesce("s.required", F.lit(True)).alias("required"), "s.order",
        F.transform(F.filter(F.coalesce("s.context", F.array().cast("array<struct<type:string,val:string>>")), lambda x: x["type"] == "step"), lambda x: x["val"]).alias("context"), F.coalesce("version", F.lit("1")).alias("version"),
    )
