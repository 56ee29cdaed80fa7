"""The registered queries of the operators in this subpackage; each derives its digest columns from its operator's output."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontaminate, divergence, html_text, jaccard, lexical, license_scan, lm_score, packing, quality, repeats, secret_scan, sql, token_files
from .common import vocabulary_path


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


CHAT_PROBE = r"\### Assistant: </turn> ok"


def op1_chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(CHAT_PROBE).alias("text"))
    made = chat.windows(table.unionByName(probe), budget=1024, history=256, history_turns=2)
    read = made.select("conv_id", "window", F.slice(chat.parse(F.col("formatted")), (F.col("n_context") + 1).cast("int"), F.col("n_new").cast("int")).alias("turns"), chat.under_loss(F.col("formatted"), F.col("loss_spans")).alias("loss"), F.length("formatted").alias("chars"))
    text = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    rows = read.select("conv_id", "chars", F.size("turns").alias("n"), F.struct("window", text.alias("text"), "loss").alias("w"))
    rows = rows.groupBy("conv_id").agg(F.sum("n").alias("n_turns"), F.sum("chars").alias("formatted_chars"), F.array_sort(F.collect_list("w")).alias("ws"))
    whole = lambda part: F.array_join(F.transform("ws", lambda w: w[part]), "")
    return rows.select("conv_id", "n_turns", F.sha2(whole("text"), 256).alias("turns_sha256"), F.length(whole("loss")).cast("long").alias("loss_chars"), F.sha2(whole("loss"), 256).alias("loss_sha256"), "formatted_chars")


def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return html_text.extract(pages).withColumn("n_chars", F.length("text").cast("long"))


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    ratios = secret_scan.train(secret_scan.labelled_samples(spark))
    found = secret_scan.scan(_table(spark, sf_dir, "documents").select("doc_id", "text"), ratios)
    n = lambda kind: F.size(F.filter("base", lambda s: s["rank"] == secret_scan.KINDS.index(kind))).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", n("assign"), n("access"), n("hex"), F.sha2(secret_scan.joined(F.col("base")), 256).alias("base_sha256"), secret_scan.joined(F.col("every")).alias("spans"))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack(_table(spark, sf_dir, "documents"), vocabulary_path(), end_id=1, capacity=4096)
    return packed.drop("ids")


def op5_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.score(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    found = license_scan.scan(docs, license_scan.word_order(docs))
    words, labels = F.transform("places", lambda p: p["word"]), F.transform("places", lambda p: p["label"])
    own = F.transform("matches", lambda m: m["label"])
    text = lambda a: F.array_join(F.array_sort(F.array_distinct(a)), ",")
    best = F.coalesce(F.array_max(F.transform("matches", lambda m: m["score"])), F.lit(0.0))
    return found.select(
        "doc_id",
        "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.array_min(words).alias("first_word"),
        F.array_max(words).alias("last_word"),
        text(labels).alias("base_labels"),
        text(F.concat(labels, own)).alias("labels"),
        best.alias("score"),
    )


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.assess(docs, quality.fit(docs, _table(spark, sf_dir, "labels")))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, benchmark = _table(spark, sf_dir, "documents").select("doc_id", "text"), _table(spark, sf_dir, "benchmark")
    found = decontaminate.hits(docs, benchmark)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.components(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = token_files.write_tokens(_table(spark, sf_dir, "documents"), vocabulary_path(), end_id=2)
    records = token_files.read_tokens(manifest)
    return records.select("doc_id", "start", F.expr("octet_length(ids) div 4").cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = lexical.build(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return lexical.search(index, _table(spark, sf_dir, "benchmark").select("item_id", "text"), k=50)


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(_table(spark, sf_dir, "documents").select("text", "lang", "source"))


def op13_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeats.remove(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


QUERIES = {f.__name__: f for f in (op1_chat_windows, op2_html_text, op3_secret_scan, op4_best_fit_packing, op5_lm_score, op6_license_scan, op7_quality_rules, op8_decontamination, op9_jaccard_join, op10_token_files, op11_lexical_search, op12_source_divergence, op13_repeated_passages)}
ORACLES: dict[str, str] = {"op1_chat_windows": sql.OP1, "op6_license_scan": sql.OP6, "op8_decontamination": sql.OP8, "op9_jaccard_join": sql.OP9, "op11_lexical_search": sql.OP11, "op12_source_divergence": sql.OP12, "op13_repeated_passages": sql.OP13}
