"""What several operators share: the scratch folder, materialising, words, hashes."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

VOCABULARY = "word_bpe_49k.json"


def vocabulary_path(name: str = VOCABULARY) -> str:
    """Where a public tokenizer's vocabulary file is installed."""
    import public_tokenizers

    return public_tokenizers.path(name)


_LOCAL: dict[str, str] = {}  # application id: its temporary folder


def scratch(spark: SparkSession) -> str:
    """A new folder name below spark.checkpoint.dir, the folder all executors share.

    Only on one machine (a local master) a temporary folder takes its place where that setting is
    absent; on a cluster that is an error.  What is written there outlives the result that reads
    it, so the folder is cleared by whoever set it.
    """
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        app = spark.sparkContext.applicationId
        top = _LOCAL.get(app) or _LOCAL.setdefault(app, tempfile.mkdtemp(prefix="spanlab-"))
    return f"{top.rstrip('/')}/{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """``df`` written once to the shared folder and read again: lineage ends there."""
    spark = df.sparkSession
    path = scratch(spark)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def shielded(df: DataFrame, *used: str) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """``df`` with all columns but the ``used`` ones renamed by place, and what gives the names back.

    Operators that keep extra columns work behind it, so no name they use can clash.
    """
    own = df.columns
    inner = [c if c in used else f"__c{i}" for i, c in enumerate(own)]
    return df.toDF(*inner), lambda out: out.select(*inner).toDF(*own)


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z and nothing else."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is evaluated once, however often ``use`` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


RUNNING = 64


def running(values: Column, join: Callable[[Column, Column], Column] = lambda a, b: a + b, levels: int = 2) -> Column:
    """For each of an array of non-negative longs, 0 joined with all before it (by default their sum).

    Chunks of RUNNING are joined up first and then gone through, each from what was before it, so
    that an array of n costs about n * RUNNING steps and not n * n.
    """
    zero = F.lit(0).cast("long")

    def through(chunk: Column, first: Column) -> Column:
        start = F.struct(first.alias("at"), F.array().cast("array<long>").alias("out"))
        step = lambda acc, x: F.struct(join(acc["at"], x).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out"))
        return F.aggregate(chunk, start, step, lambda acc: acc["out"])

    if not levels:
        return through(values, zero)
    cut = lambda v: F.transform(F.sequence(F.lit(0), F.greatest(F.size(v) - 1, F.lit(0)), F.lit(RUNNING)), lambda a: F.slice(v, a + 1, RUNNING))
    whole = lambda chunks: running(F.transform(chunks, lambda c: F.aggregate(c, zero, join)), join, levels - 1)
    return let(let(values, cut), lambda chunks: let(whole(chunks), lambda before: F.flatten(F.transform(chunks, lambda c, i: through(c, F.get(before, i))))))


def mixed(h: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values over the whole range (a finaliser of the multiply-xorshift kind)."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0x9E3779B97F4A7C15)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))
