"""The numbered queries of this package, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm.base import table
from docloom.llm.chat import ORACLE as CHAT_SQL
from docloom.llm.chat import rendered
from docloom.llm.decontaminate import ORACLE as DECONTAMINATE_SQL
from docloom.llm.decontaminate import contamination
from docloom.llm.filter_audit import ORACLE as AUDIT_SQL
from docloom.llm.filter_audit import filter_audit
from docloom.llm.language_id import language_id
from docloom.llm.length_histogram import length_histogram, token_lengths
from docloom.llm.license_scan import license_scan
from docloom.llm.license_scan import oracle as license_sql
from docloom.llm.line_quality import ORACLE as LINE_QUALITY_SQL
from docloom.llm.line_quality import line_quality
from docloom.llm.packing import pack
from docloom.llm.periodic_runs import periodic_runs, run_digests, with_planted_tails
from docloom.llm.simhash import near_duplicates
from docloom.llm.token_store import stored_documents
from docloom.llm.toxicity import toxicity
from docloom.llm.url_filter import ORACLE as URL_SQL
from docloom.llm.url_filter import RULES, url_verdicts


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_verdicts(table(spark, sf_dir, "pages"), RULES)


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


def op3_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_quality(table(spark, sf_dir, "documents")).drop("_id", "_hash")


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("_id", "_hash")


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id(table(spark, sf_dir, "documents"))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rendered(table(spark, sf_dir, "conversations"))


def op9_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored_documents(table(spark, sf_dir, "documents"))


def op10_length_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return length_histogram(token_lengths(table(spark, sf_dir, "documents"))).withColumn("quantile", F.round("quantile", 9))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_digests(periodic_runs(with_planted_tails(table(spark, sf_dir, "documents"))))


def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_url_filter, op2_packing, op3_line_quality, op4_decontamination, op5_language_id, op6_license_scan, op7_simhash, op8_chat, op9_token_store, op10_length_histogram, op11_periodic_runs, op12_toxicity, op13_filter_audit)}
ORACLES: dict[str, str] = {"op6_license_scan": license_sql(), "op1_url_filter": URL_SQL, "op8_chat": CHAT_SQL, "op3_line_quality": LINE_QUALITY_SQL, "op4_decontamination": DECONTAMINATE_SQL, "op13_filter_audit": AUDIT_SQL}
