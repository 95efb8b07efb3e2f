"""The queries of the problems that this package solves, over the whole tables of a data directory."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cardloom.llm import canonical, mixing, name_variants, ocr_repair, packing, shared_spans, soft_linkage
from cardloom.operators.linkage import mapping
from cardloom.runtime import table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p1_confidence(spark, sf_dir).select("db_id", "card")


def p1_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = mapping(table(spark, sf_dir, "card_mapping"))
    return soft_linkage.link(table(spark, sf_dir, "card_transcription"), table(spark, sf_dir, "db_record"), known)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ocr_repair.find_noise(table(spark, sf_dir, "card_transcription"), table(spark, sf_dir, "db_record"))


def p2_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ocr_repair.repaired(table(spark, sf_dir, "card_transcription"), table(spark, sf_dir, "db_record"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    titles = canonical.disguised_keys(table(spark, sf_dir, "db_record"), "db_id", "title")
    cards = canonical.disguised_keys(table(spark, sf_dir, "card_transcription"), "card", "transcription")
    return titles.select(F.lit("title").alias("field"), "rec_key").unionByName(cards.select(F.lit("transcription").alias("field"), "rec_key"))


def p4_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    titles = table(spark, sf_dir, "db_record").select("db_id", "title").distinct()
    return canonical.canonicalize(titles, "title", into="canon").select("db_id", "canon", "is_disguised")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return name_variants.variant_pairs(name_variants.name_clusters(table(spark, sf_dir, "db_record")))


def p6_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.fill_containers(table(spark, sf_dir, "documents"), table(spark, sf_dir, "container_size"))


def p6_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.fill_report(p6_bins(spark, sf_dir), table(spark, sf_dir, "container_size"))


def p6_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, kinds = table(spark, sf_dir, "documents"), table(spark, sf_dir, "container_size")
    return packing.fill_checks(packing.fill_containers(docs, kinds), docs, kinds)


def p7_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_target"))


def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_report(p7_mix(spark, sf_dir), table(spark, sf_dir, "mix_target"))


def p7_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_checks(p7_mix(spark, sf_dir), table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_target"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shared_spans.shared_spans(table(spark, sf_dir, "documents"))


def p8_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shared_spans.shared_share(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (p1_found, p1_confidence, p2_found, p2_paragraphs, p4_found, p4_titles, p5_found, p6_bins, p6_fill, p6_checks, p7_mix, p7_shares, p7_checks, p8_found, p8_share)
    return {f.__name__: f for f in found}
