"""Interval logs in case folders: two CSV files a case, cleaned into intervals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TOOL_COLUMNS = ("install_case_part", "install_case_time", "uninstall_case_part", "uninstall_case_time", "arm", "commercial_toolname", "groundtruth_toolname", "case")
TASK_COLUMNS = ("index", "start_part", "start_time", "stop_part", "stop_time", "duration", "taskname", "groundtruth_taskname", "matched_description", "case")


def _schema(columns: Sequence[str]) -> str:
    return ", ".join(f"`{c}` string" for c in columns)


def read_csv(spark: SparkSession, path: str, columns: Sequence[str], deep: bool = False) -> DataFrame:
    """All columns as text, quotes doubled inside quotes, fields over several lines allowed; ``deep`` reads the files at any depth."""
    return spark.read.schema(_schema(columns)).option("recursiveFileLookup", str(deep).lower()).csv(path, header=True, quote='"', escape='"', multiLine=True)


def read_cases(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """The two logs of every case folder below ``root``; hidden folders are skipped, a folder with one log only is an error."""
    here = lambda name: read_csv(spark, f"{root}/[!.]*/{name}.csv", TOOL_COLUMNS if name == "tools" else TASK_COLUMNS)
    found = spark.read.format("binaryFile").load(f"{root}/[!.]*/*.csv").select(F.regexp_extract("path", r"([^/]+)/([^/]+)\.csv$", 1).alias("folder"), F.regexp_extract("path", r"([^/]+)/([^/]+)\.csv$", 2).alias("file"))
    alone = found.where(F.col("file").isin("tools", "tasks")).groupBy("folder").agg(F.count_distinct("file").alias("n")).where("n = 1").limit(5).collect()
    if alone:
        raise ValueError(f"only one of the two logs in {sorted(r.folder for r in alone)}")
    return here("tools"), here("tasks")


def seconds(text: Column) -> Column:
    """h:m:s.f as seconds, null where it can't be read; hours and minutes are whole, of any size."""
    parts = F.split(F.trim(text), ":")
    number = lambda i, kind: F.trim(F.get(parts, F.lit(i))).try_cast(kind)
    return F.when(F.size(parts) == 3, number(0, "long") * 3600 + number(1, "long") * 60 + number(2, "double"))


def part_label(text: Column) -> Column:
    """Any spelling of a number as ``%.1f``, other text trimmed."""
    n = F.trim(text).try_cast("double")
    return F.coalesce(F.when(n.isNotNull(), F.format_string("%.1f", n)), F.trim(text))


def known_class(text: Column, vocabulary: Sequence[str]) -> Column:
    """The class in lower case if the vocabulary has it, else null."""
    name = F.lower(F.trim(text))
    return F.when(name.isin(*vocabulary), name)


def _kept(df: DataFrame) -> DataFrame:
    return df.where("cls is not null and part = part_b and start is not null and stop is not null and stop > start").drop("part_b")


def clean_tools(raw: DataFrame, vocabulary: Sequence[str]) -> DataFrame:
    """case, part, start, stop, cls: repeats dropped on the raw payload first, then what can't be an interval."""
    once = raw.dropDuplicates(["case", "install_case_part", "install_case_time", "uninstall_case_part", "uninstall_case_time", "arm", "groundtruth_toolname"])
    return _kept(once.select("case", part_label(F.col("install_case_part")).alias("part"), part_label(F.col("uninstall_case_part")).alias("part_b"), seconds(F.col("install_case_time")).alias("start"), seconds(F.col("uninstall_case_time")).alias("stop"), known_class(F.col("groundtruth_toolname"), vocabulary).alias("cls")))


def clean_tasks(raw: DataFrame, vocabulary: Sequence[str]) -> DataFrame:
    """case, part, start, stop, cls, description (null if blank)."""
    once = raw.dropDuplicates(["case", "start_part", "start_time", "stop_part", "stop_time", "groundtruth_taskname"])
    return _kept(once.select("case", part_label(F.col("start_part")).alias("part"), part_label(F.col("stop_part")).alias("part_b"), F.trim("start_time").try_cast("double").alias("start"), F.trim("stop_time").try_cast("double").alias("stop"), known_class(F.col("groundtruth_taskname"), vocabulary).alias("cls"), F.nullif(F.trim("matched_description"), F.lit("")).alias("description")))
