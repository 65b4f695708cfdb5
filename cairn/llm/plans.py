"""Queries of the language-data problems."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cairn.llm.address import locations, same_location
from cairn.llm.canonical import map_entries, unmatched
from cairn.llm.entity import match_entities
from cairn.llm.mixing import measured, mix, share_report
from cairn.llm.packing import fill_report, pack_documents
from cairn.llm.pii import find_personal, redact
from cairn.sources.tables import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return map_entries(table(spark, d, "intake"), table(spark, d, "canon"))


def p1_unmatched(spark: SparkSession, d: str) -> DataFrame:
    return unmatched(table(spark, d, "intake"), table(spark, d, "canon"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return match_entities(table(spark, d, "sites"), table(spark, d, "nad")).select("site_id", "uuid")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return same_location(table(spark, d, "x"), table(spark, d, "taf"))


def p4_locations(spark: SparkSession, d: str) -> DataFrame:
    return locations(table(spark, d, "x"), table(spark, d, "taf"))


def p7_containers(spark: SparkSession, d: str) -> DataFrame:
    return pack_documents(table(spark, d, "documents"), 2048)


def p7_fill(spark: SparkSession, d: str) -> DataFrame:
    return fill_report(p7_containers(spark, d), 2048)


def p8_mixture(spark: SparkSession, d: str) -> DataFrame:
    return mix(measured(table(spark, d, "documents")), table(spark, d, "mix_target"))


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    return share_report(p8_mixture(spark, d), table(spark, d, "mix_target"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return find_personal(table(spark, d, "documents"))


def p9_redacted(spark: SparkSession, d: str) -> DataFrame:
    return redact(table(spark, d, "documents"))


QUERIES = {f.__name__: f for f in (p1_found, p1_unmatched, p3_found, p4_found, p4_locations, p7_containers, p7_fill, p8_mixture, p8_shares, p9_found, p9_redacted)}

SQL: dict[str, str] = {}
