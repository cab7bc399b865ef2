"""Readers and writers: CSV, JSON lists and lines, tagged text, and pluggable document parsers."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DOCS = "id bigint, name string, type string, year int, num_sections int, num_paragraphs int"
PARAGRAPHS = "id bigint, document bigint, paragraph_id int, previous int, next int, length int, document_pos int, section string, function string, text string"
STYLES = "id bigint, document bigint, paragraph_id int, section string, text_type string, text_type_es string, length int, document_pos int, paragraph_pos int, text string"
RECORDS = "instruction string, input string, output string"


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A CSV table with a header, by a fixed schema; fields may hold line breaks."""
    return spark.read.schema(schema).csv(path, header=True, multiLine=True, escape='"', quote='"', enforceSchema=False, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


def write_csv(df: DataFrame, path: str, sep: str = ",") -> None:
    df.write.mode("overwrite").csv(path, header=True, escape='"', quote='"', sep=sep, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


def read_records(spark: SparkSession, path: str, prompt: str = "instruction", lines: bool = False) -> DataFrame:
    """(prompt, text, label) of instruction records in JSON lists, or lines; ``prompt`` names the instruction's field."""
    raw = spark.read.schema(f"{prompt} string, input string, output string").json(path, multiLine=not lines)
    return raw.select(F.col(prompt).alias("prompt"), F.col("input").alias("text"), F.col("output").alias("label"))


def read_splits(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """Records of several files, each row with its split's name."""
    out = None
    for split, path in paths.items():
        one = spark.read.schema(RECORDS).json(path, multiLine=True).withColumn("split", F.lit(split))
        out = one if out is None else out.unionByName(one)
    return out


def write_records(df: DataFrame, path: str) -> None:
    """One JSON object a line, in parallel."""
    df.write.mode("overwrite").json(path)


def write_text(df: DataFrame, path: str, column: str, by: list[str] | None = None) -> None:
    """A text column as files, in folders by ``by``."""
    writer = df.select(*(by or []), F.col(column).alias("value")).write.mode("overwrite")
    (writer.partitionBy(*by) if by else writer).text(path)


def read_texts(spark: SparkSession, path: str, glob: str = "*", recursive: bool = True) -> DataFrame:
    """(path, text) of whole files, folders flattened."""
    return spark.read.text(path, wholetext=True, pathGlobFilter=glob, recursiveFileLookup=recursive).select(F.input_file_name().alias("path"), F.col("value").alias("text"))


def parse_files(spark: SparkSession, path: str, parser: Callable[[bytes], Iterable[dict]], schema: str, glob: str = "*", skip: DataFrame | None = None) -> DataFrame:
    """Rows that a parser yields for each binary file (PDF, RTF, ZIP), with the file's path; paths in ``skip`` are left out.

    The parser is a plug-in: a function of a file's bytes that yields dictionaries with the schema's fields.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", True).load(path).select("path", "content")
    if skip is not None:
        files = files.join(skip.select("path"), "path", "left_anti")
    names = [f.split()[0] for f in schema.split(",")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at, content in batch[["path", "content"]].itertuples(index=False):
                rows = [{"path": at} | row for row in parser(content)]
                yield pd.DataFrame(rows, columns=["path", *names])

    return files.mapInPandas(run, f"path string, {schema}")


def unzip(content: bytes) -> Iterator[dict]:
    """A parser for ZIP archives: the name and bytes of each member."""
    import io
    import zipfile

    with zipfile.ZipFile(io.BytesIO(content)) as z:
        for name in z.namelist():
            yield {"name": name, "bytes": z.read(name)}


def ensure_table(spark: SparkSession, name: str, schema: str, path: str | None = None) -> bool:
    """A catalog table, made if it is missing, at a path if one is given; whether it was made."""
    if spark.catalog.tableExists(name):
        return False
    place = f" LOCATION '{path}'" if path else ""
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({schema}) USING parquet{place}")
    return True


def append(df: DataFrame, name: str) -> None:
    df.write.insertInto(name)


def new_files(names: DataFrame, done: DataFrame) -> DataFrame:
    """The names whose output does not exist yet."""
    return names.join(done, names.columns[0], "left_anti")
