"""Sample cases as pairs of JSON files, lists of lines, and one response a case."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.forms import response_text
from .files import write_named


def read_sample_cases(spark: SparkSession, root: str, suffix: str = "_question") -> DataFrame:
    """case, question, references of the files <case>.json (an array of strings) and <case><suffix>.json (a string) at any depth.

    Read lazily: a case without a question, without references or of another form fails its task.
    A question without references is no case.
    """
    raw = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").text(root, wholetext=True)
    path = F.col("_metadata.file_path")
    stem = F.regexp_extract(path, r"([^/]+)\.json$", 1)
    asks = stem.endswith(suffix)
    files = raw.select(F.regexp_extract(path, r"^(.*/)[^/]*$", 1).alias("folder"), F.regexp_replace(stem, f"{suffix}$", "").alias("case"), asks.alias("asks"), F.trim("value").alias("value"))
    question = F.get(F.from_json(F.max(F.when(F.col("asks"), F.concat(F.lit("["), "value", F.lit("]")))), "array<string>"), F.lit(0))
    references = F.from_json(F.max(F.when(~F.col("asks"), F.col("value"))), "array<string>")
    pairs = files.groupBy("folder", "case").agg(question.alias("question"), references.alias("references"), F.count_if(~F.col("asks")).alias("n")).where("n > 0")
    fail = lambda why: F.raise_error(F.concat(F.lit("case "), F.col("case"), F.lit(f": {why}")))
    asked = F.coalesce("question", fail("no question").cast("string"))
    known = F.when(F.coalesce(F.size("references") > 0, F.lit(False)), F.col("references")).otherwise(fail("no references").cast("array<string>"))
    return pairs.select("case", asked.alias("question"), known.alias("references"))


def read_candidates(spark: SparkSession, path: str, cases: DataFrame) -> DataFrame:
    """``cases(case, ...)`` with the answer that a JSON object of case to answer has for each.

    A file that is no object, an answer that is no string, a case without an answer and an answer without a case are errors.
    """
    raw = spark.read.text(path, wholetext=True).select(F.trim("value").alias("value"))
    fail = lambda why: F.raise_error(F.concat(*(w if isinstance(w, Column) else F.lit(w) for w in why)))
    text = F.when(raw["value"].startswith("{"), raw["value"]).otherwise(fail([f"{path}: no object of case to answer"]).cast("string"))
    entries = raw.select(F.explode(F.variant_get(F.parse_json(text), "$", "map<string,variant>")).alias("case", "v"))
    answer = F.when(F.schema_of_variant("v") == "STRING", F.variant_get("v", "$", "string")).otherwise(fail(["the answer of ", F.col("case"), " is no string"]).cast("string"))
    both = cases.join(entries.select("case", answer.alias("answer"), F.lit(True).alias("_has")), "case", "full_outer").withColumn("_known", F.col(next(c for c in cases.columns if c != "case")).isNotNull())
    said = F.when(F.col("_has").isNull(), fail(["no answer for ", F.col("case")]).cast("string")).when(~F.col("_known"), fail(["an answer for the unknown case ", F.col("case")]).cast("string")).otherwise(F.col("answer"))
    return both.select(*cases.columns, said.alias("answer"))


def data_set_text(train: str, val: str, classes: Sequence[str]) -> str:
    """The description of a detection data set: its classes in order and its two lists of files."""
    return "\n".join([f"nc: {len(classes)}", "names:", *(f"- {c}" for c in classes), f"train: {train}", f"val: {val}"]) + "\n"


def write_data_set(spark: SparkSession, path: str, train: str, val: str, classes: Sequence[str]) -> None:
    """That description as a text file below ``path``."""
    spark.createDataFrame([(data_set_text(train, val, classes).rstrip("\n"),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def write_lines(df: DataFrame, path: str, column: str, order: str) -> None:
    """One text line a row, in the order of a column over the files' names."""
    df.orderBy(order).select(F.col(column).cast("string").alias("value")).write.mode("overwrite").text(path)


def write_responses(answers: DataFrame, path: str, fallback: str, foldered: bool = False) -> None:
    """``answers(case, answer)`` as a folder a case with the JSON-encoded answer; none is ever empty.  What ``path`` held before goes.

    ``foldered`` keeps them for ``files.read_named``.
    """
    plain = F.regexp_replace(F.url_encode(F.coalesce(F.col("case").cast("string"), F.lit("__HIVE_DEFAULT_PARTITION__"))), r"\+", "%20")
    named = answers.select(F.concat(F.lit("case="), plain, F.lit("/part-00000.txt")).alias("name"), response_text(F.col("answer"), fallback).alias("value"))
    write_named(named, path, "value", foldered=foldered)
