"""The registered queries of the text operators, with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import conversation_repair, decontamination, html_text, language_id, license_scan, packing, quality_classifier, quality_rules, repeats, sharding, simhash, spelling, toxicity
from .common import table
from .oracles import ORACLE_SQL


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts by weak supervision; texts that fail the base rules are out whatever the posterior."""
    rated = quality_rules.rated(table(spark, sf_dir, "documents"))
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return rated.withColumn("base_failed", base).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & F.col("good")).alias("kept"), "posterior",
    )


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that the chain holds toxic, out of all documents."""
    return toxicity.probabilities(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).where("toxic")


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extracted(table(spark, sf_dir, "pages"))


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.digests(table(spark, sf_dir, "documents"))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.sharded(table(spark, sf_dir, "documents"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identified(table(spark, sf_dir, "documents"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults, cheapest edits and digests of the damaged conversations, a row for each original one."""
    conversations = table(spark, sf_dir, "conversations")
    return conversation_repair.audited(conversations, conversation_repair.damaged(conversations))


def op12_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of license phrases and labels of license notices, for every document."""
    return license_scan.scanned(table(spark, sf_dir, "documents"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all documents, the commoner words that they are one edit from, and where those lead."""
    return spelling.variants(table(spark, sf_dir, "documents"))


__all__ = ["ORACLE_SQL", "QUERIES"]

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_rules": op1_quality_rules,
    "op2_packing": op2_packing,
    "op3_toxicity": op3_toxicity,
    "op4_simhash": op4_simhash,
    "op5_html_text": op5_html_text,
    "op6_quality_classifier": op6_quality_classifier,
    "op7_repeats": op7_repeats,
    "op8_sharding": op8_sharding,
    "op9_decontamination": op9_decontamination,
    "op10_language_id": op10_language_id,
    "op11_conversation_repair": op11_conversation_repair,
    "op12_license_scan": op12_license_scan,
    "op13_spelling_variants": op13_spelling_variants,
}
