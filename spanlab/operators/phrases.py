"""Phrases of a table of any size in texts: leftmost, longest, none inside another."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import words_only


def phrase_join(texts: DataFrame, key: str, text: str, phrases: DataFrame, phrase: str, lengths: int = 8) -> DataFrame:
    """key, at (the first word's place from 0), and the columns of the phrase that stands there.

    Texts and phrases are compared as ``words_only`` leaves them.  Every run of words of a length that some phrase has is
    joined with the phrases by equality, so the cost follows the text, not the number of phrases, and the phrases
    are broadcast only where the optimizer finds them small.  Of the hits of a text the leftmost counts, of those the longest,
    and what it covers starts no other.  A phrase of more than ``lengths`` words is an error; one given twice gives its hit once
    for each row.
    """
    own = phrases.withColumn("_p", words_only(F.col(phrase))).where("_p != ''").withColumn("_n", F.size(F.split("_p", " ")))
    used = own.agg(F.array_sort(F.collect_set(F.when(F.col("_n") <= lengths, F.col("_n")).otherwise(F.raise_error(F.lit(f"a phrase of more than {lengths} words")).cast("int")))).alias("_ns"))  # one row, ``lengths`` entries at most
    words = texts.select(key, words_only(F.col(text)).alias("_t")).where("_t != ''").select(key, F.split("_t", " ").alias("_w"))
    runs = words.crossJoin(F.broadcast(used)).select(key, F.posexplode("_w").alias("at", "_first"), "_w", "_ns").select(key, "at", "_w", F.explode("_ns").alias("_n"))
    runs = runs.where(F.col("at") + F.col("_n") <= F.size("_w")).select(key, "at", "_n", F.array_join(F.slice("_w", F.col("at") + 1, F.col("_n")), " ").alias("_p"))
    hits = runs.join(own.select("_p").distinct(), "_p").groupBy(key).agg(F.array_sort(F.collect_list(F.struct("at", (-F.col("_n")).alias("less"), F.col("_p").alias("p")))).alias("_h"))
    none = F.array().cast("array<struct<at:int,less:int,p:string>>")
    step = lambda acc, x: F.when(x["at"] >= acc["free"], F.struct((x["at"] - x["less"]).alias("free"), F.concat(acc["kept"], F.array(x)).alias("kept"))).otherwise(acc)
    kept = F.aggregate("_h", F.struct(F.lit(0).alias("free"), none.alias("kept")), step, lambda acc: acc["kept"])
    found = hits.select(key, F.explode(kept).alias("h")).select(key, F.col("h.at").cast("long").alias("at"), F.col("h.p").alias("_p"))
    return found.alias("f").join(own.alias("o"), F.col("f._p") == F.col("o._p")).select(f"f.{key}", "f.at", *(f"o.{c}" for c in phrases.columns))
