"""The pN_ queries over the tables of a folder, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from docframe.llm import langid, leakage, overlap, packing, pieces, quota, spans, splits


def _read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return splits.tied_groups(_read(spark, folder, "docs"), _read(spark, folder, "paragraphs_df"))


def p1_splits(spark: SparkSession, folder: str) -> DataFrame:
    return splits.assign_splits(*(_read(spark, folder, t) for t in ("docs", "paragraphs_df", "split_targets")))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return pieces.split_oversized(_read(spark, folder, "instruction_records")).where("piece = 0 and pieces > 1").select("record_id")


def p2_pieces(spark: SparkSession, folder: str) -> DataFrame:
    return pieces.split_oversized(_read(spark, folder, "instruction_records"))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return spans.shared_pairs(_read(spark, folder, "styles_df"))


def p3_shared_lengths(spark: SparkSession, folder: str) -> DataFrame:
    return spans.shared_lengths(_read(spark, folder, "styles_df"))


def p3_shared_by_type(spark: SparkSession, folder: str) -> DataFrame:
    return spans.shared_by_type(_read(spark, folder, "styles_df"))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return overlap.overlaps(_read(spark, folder, "instruction_records")).select("record_id_a", "record_id_b")


def p4_overlap_report(spark: SparkSession, folder: str) -> DataFrame:
    return overlap.overlap_report(_read(spark, folder, "instruction_records"))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return quota.coverage(_read(spark, folder, "instruction_records"), _read(spark, folder, "label_targets")).where("not met").select("label")


def p5_coverage(spark: SparkSession, folder: str) -> DataFrame:
    return quota.coverage(_read(spark, folder, "instruction_records"), _read(spark, folder, "label_targets"))


def p5_sample(spark: SparkSession, folder: str) -> DataFrame:
    return quota.sample(_read(spark, folder, "instruction_records"), _read(spark, folder, "label_targets"))


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return packing.oversized(_read(spark, folder, "documents"))


def p6_containers(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(_read(spark, folder, "documents"))


def p6_fill_report(spark: SparkSession, folder: str) -> DataFrame:
    return packing.fill_report(_read(spark, folder, "documents"))


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    found = leakage.leaks(_read(spark, folder, "documents"), _read(spark, folder, "eval_items"))
    return found.where("verbatim").select("doc_id", "item_id").distinct()


def p7_leaked_items(spark: SparkSession, folder: str) -> DataFrame:
    return leakage.leaked_items(_read(spark, folder, "documents"), _read(spark, folder, "eval_items"))


def p7_near_passages(spark: SparkSession, folder: str) -> DataFrame:
    return leakage.near_passages(_read(spark, folder, "documents"), _read(spark, folder, "eval_items"))


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    return langid.wrong_labels(_read(spark, folder, "documents"))


def p8_languages(spark: SparkSession, folder: str) -> DataFrame:
    return langid.languages(_read(spark, folder, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name[0] == "p" and name[1].isdigit() and callable(f)}


_FOLD = "lower(strip_accents(trim({})))"

_SQL = {
    "p2_found": "SELECT record_id FROM instruction_records WHERE length(input) > 1500",
    "p5_found": f"""
        WITH r AS (SELECT trim(regexp_replace({_FOLD.format('output')}, '\\.$', '')) AS name FROM instruction_records),
        n AS (SELECT name, count(*) AS available FROM r GROUP BY name),
        s AS (SELECT floor(count(*) * 0.1) AS size FROM r)
        SELECT t.label FROM label_targets t CROSS JOIN s LEFT JOIN n ON n.name = {_FOLD.format('t.label')}
        WHERE coalesce(available, 0) < t.share * s.size OR coalesce(available, 0) < t.min_rows""",
    "p6_found": r"""
        SELECT doc_id FROM documents
        WHERE len(regexp_extract_all(text, '[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s\x{0B}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+')) > 1024""",
}


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
