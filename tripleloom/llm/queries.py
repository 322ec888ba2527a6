"""Queries of the training-data operators over the test tables, and their SQL where there is any."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tripleloom.llm import leakage, lookalike, mapping, markup, names, nearcopies, pairs, scans, stuffing, tokenise
from tripleloom.session import table


def _named(name: str, df: DataFrame) -> DataFrame:
    return df.select(F.lit(name).alias("record_table"), *df.columns)


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearcopies.repeated_records(table(spark, sf_dir, "qa_records"))


def p1_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearcopies.classed_records(table(spark, sf_dir, "qa_records"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    units = markup.markup_found(table(spark, sf_dir, "evidence_units"), "unit_id", "text")
    pages = markup.markup_found(table(spark, sf_dir, "restorations"), "restoration_id", "markdown")
    return _named("evidence_units", units).unionByName(_named("restorations", pages))


def p2_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    units = markup.render_markup(table(spark, sf_dir, "evidence_units"), "unit_id", "text")
    pages = markup.render_markup(table(spark, sf_dir, "restorations"), "restoration_id", "markdown")
    return _named("evidence_units", units).unionByName(_named("restorations", pages)).select("record_table", "record_id", "clean_text").distinct()


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs.broken_pairs(table(spark, sf_dir, "qa_records"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    sources = (("evidence_units", "unit_id", "text"), ("candidate_entities", "name_id", "label"), ("query_terms", "mention_id", "mention"))
    found = [_named(name, lookalike.changed_records(table(spark, sf_dir, name), key, column)) for name, key, column in sources]
    return found[0].unionByName(found[1]).unionByName(found[2])


def p4_canonical_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "candidate_entities").select("name_id", "label")
    return lookalike.canonicalise(rows, "label").distinct()


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scans.scan_noise(scans.page_rows(table(spark, sf_dir, "evidence_units"), table(spark, sf_dir, "restorations")))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return names.link_names(names.name_rows(table(spark, sf_dir, "candidate_entities"), table(spark, sf_dir, "ontology_terms")))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = mapping.free_values(*(table(spark, sf_dir, name) for name in ("query_terms", "term_choices", "candidate_entities")))
    return mapping.map_values(values, table(spark, sf_dir, "reference_terms"))


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenise.encode_table(table(spark, sf_dir, "documents"), "doc_id", "text")


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.leaked(table(spark, sf_dir, "documents"), "doc_id", "text", table(spark, sf_dir, "eval_items"), "item_id", "text")


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stuffing.stuffed_pages(table(spark, sf_dir, "documents"), "doc_id", "text")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (p1_found, p1_classes, p2_found, p2_clean, p3_found, p4_found, p4_canonical_labels, p5_found, p6_found, p7_found, p8_ids, p9_found, p10_found)
}
SQL: dict[str, str] = {}
