"""Lengths, counts and time statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def length_by_section(styles: DataFrame, document: int | None = None) -> DataFrame:
    """(document, section, text_type, length): the summed lengths of excerpts."""
    rows = styles if document is None else styles.where(F.col("document") == document)
    return rows.groupBy("document", "section", "text_type").agg(F.sum("length").alias("length"))


def time_analysis(stats: DataFrame, docs: DataFrame, by_type: bool = False, kind: str | None = None) -> DataFrame:
    """Mean length by year and section (and text type), 0 where there is none; 'Pending' is left out.

    The grid is that of the years, sections and text types that occur, dimensions of a few hundred rows at most.
    """
    years = docs.where(F.col("year").isNotNull() & (F.lit(True) if kind is None else F.col("type") == kind)).select(F.col("id").alias("document"), "year")
    rows = stats.where("section is not null and section <> 'Pending' and text_type is not null").join(years, "document")
    keys = ["year", "section", "text_type"] if by_type else ["year", "section"]
    means = rows.groupBy(*keys).agg(F.avg("length").alias("avg_length"))
    grid = means.select("year").distinct()
    for k in keys[1:]:
        grid = grid.crossJoin(F.broadcast(means.select(k).distinct()))
    return grid.join(means, keys, "left").select(*keys, F.coalesce("avg_length", F.lit(0.0)).alias("avg_length"))


def count_paragraphs(docs: DataFrame, paragraphs: DataFrame) -> DataFrame:
    """Documents with the number of their paragraphs and of their sections."""
    counts = paragraphs.groupBy(F.col("document").alias("id")).agg(F.count("*").alias("num_paragraphs"), F.countDistinct("section").alias("num_sections"))
    return docs.select("id").join(counts, "id", "left").na.fill(0, ["num_paragraphs", "num_sections"])


def mode_first(rows: DataFrame, keys: list[str], value: str, order: str) -> DataFrame:
    """The most frequent value of each group; of equals the one seen first."""
    counted = rows.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("n"), F.min(order).alias("first"))
    return counted.groupBy(*keys).agg(F.max_by(value, F.struct("n", -F.col("first"))).alias(value))


def word_frequencies(texts: DataFrame, column: str = "text", most: int | None = None) -> DataFrame:
    """(word, n): words of letters, lower case, with how often they occur; the most frequent only if asked."""
    words = texts.select(F.explode(F.regexp_extract_all(F.lower(column), F.lit(r"\p{L}+"), F.lit(0))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    return words if most is None else words.orderBy(F.desc("n"), "word").limit(most)


def label_statistics(records: DataFrame, labels: list[str]) -> DataFrame:
    """(label, train, val, test, input_length): counts by split and mean words of each label of a fixed list."""
    names = records.sparkSession.createDataFrame([(k, x) for k, x in enumerate(labels)], "ord int, label string")
    size = F.size(F.filter(F.split("input", r"(?U)\s+"), lambda w: w != ""))
    rows = records.select(F.lower(F.trim("output")).alias("label"), F.lower(F.trim("split")).alias("split"), size.alias("n"))
    counts = rows.groupBy("label").agg(*(F.count(F.when(F.col("split") == s, 1)).alias(s) for s in ("train", "val", "test")), F.avg("n").alias("input_length"))
    return F.broadcast(names).join(counts, "label", "left").na.fill(0, ["train", "val", "test"]).drop("ord")
