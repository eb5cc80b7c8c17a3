"""The opN_ queries: each applies its operator, with production parameters, to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sensorloom.llm import collision_ann, context_tree, decontaminate, jaccard_join, language_id, lexical_search, line_dedup, mixing, periodic_runs, pii, suffix_dedup, suffix_trees, warc
from sensorloom.llm.oracles import ORACLES as ORACLES


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents")).withColumn("rate", F.round("rate", 6))


def op2_context_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context_tree.score(_table(spark, sf_dir, "documents"), word_contexts=False)


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.report(_table(spark, sf_dir, "documents"), length=200)


def op4_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.derive(warc.responses_from_pages(_table(spark, sf_dir, "pages")))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(_table(spark, sf_dir, "documents"))


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.components(_table(spark, sf_dir, "documents"), words=4, num=85, den=100)


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.matches(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "n_windows", "best_start", "best_similarity")


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_report(_table(spark, sf_dir, "documents"), min_docs=10)


def op9_collision_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collision_ann.nearest(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    fold = language_id.fold(F.col("doc_id"), 5)
    model = language_id.fit(docs, usable=fold != 0)
    found = language_id.identify(docs, model, ["doc_id"])
    held = F.coalesce(language_id.fold(F.col("doc_id"), 5) == 0, F.lit(False))
    return found.select("doc_id", held.alias("held_out"), "lang_pred", F.col("lang_score").alias("score"), F.col("lang_accepted").alias("accepted"))


def _with_planted_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, text; where crc32(doc_id) ends in 0 the words from one on repeat those of a first period, as the contract has it."""
    h = F.crc32(F.col("doc_id").cast("string"))
    planted = docs.select("doc_id", "text", h.alias("h"), F.when(h % 10 == 0, F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))).alias("w")).withColumn("n", F.size("w"))
    planted = planted.withColumn("g", F.floor(F.col("h") / 10)).withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")).cast("int"))
    planted = planted.withColumn("p", (1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8))).cast("int"))
    period = F.slice("w", F.col("a") + 1, F.col("p"))
    rest = F.slice(F.flatten(F.array_repeat(period, F.ceil((F.col("n") - F.col("a")) / F.col("p")).cast("int"))), F.lit(1), F.col("n") - F.col("a"))
    return planted.select("doc_id", F.when(F.col("n") > 0, F.concat_ws(" ", F.concat(F.slice("w", F.lit(1), F.col("a")), rest))).otherwise(F.col("text")).alias("text"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.report(_with_planted_repeats(_table(spark, sf_dir, "documents")))


def op12_suffix_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_trees.report(_table(spark, sf_dir, "documents"), length=50)


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.search(lexical_search.index(_table(spark, sf_dir, "documents")), _table(spark, sf_dir, "benchmark"), k=10)


QUERIES = {f.__name__: f for f in (op1_mixing, op2_context_tree, op3_suffix_dedup, op4_warc_derivatives, op5_pii, op6_jaccard_join, op7_decontamination, op8_line_dedup, op9_collision_ann, op10_language_id, op11_periodic_runs, op12_suffix_trees, op13_lexical_search)}
