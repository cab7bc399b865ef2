"""Truth tables of the scalar functions."""

import pytest
from pyspark.sql import functions as F

from docframe.functions import labels, markup, numerals, text


def values(spark, rows, expression):
    df = spark.createDataFrame([(k, r) for k, r in enumerate(rows)], "k int, x string")
    return [r[1] for r in df.select("k", expression(F.col("x")).alias("v")).orderBy("k").collect()]


def test_roman_round_trip(spark):
    df = spark.range(0, 4000).select(F.col("id").cast("int").alias("n"))
    assert df.where(numerals.roman_to_int(numerals.int_to_roman(F.col("n"))) != F.col("n")).count() == 0


def test_roman_values(spark):
    assert values(spark, ["IV", "IIII", "", "MIXA", None], numerals.roman_to_int) == [4, 4, 0, -2, None]


def test_next_number(spark):
    assert values(spark, ["IV.-", "12.", "A.", "abc", "", None], numerals.next_number) == [5, 13, -1, -2, -2, None]


@pytest.mark.parametrize(
    ("given", "expected"),
    [("I. ANTECEDENTES", ("rom-dot", "I")), ("IV- DEMANDA", ("rom-hyphen", "IV")), ("II.- X", ("rom-dot", "II-")), ("12. HECHOS", ("ara-dot", "12")),
     ("3- HECHOS", ("ara-hyphen", "3")), ("A. x", ("alpha-dot", "A ")), ("nada", ("unknown", "-1")), (". x", ("rom-dot", ""))],
)
def test_numeral_format(spark, given, expected):
    got = values(spark, [given], lambda c: numerals.numeral_format(c))[0]
    assert tuple(got) == expected


def test_upper_ratio(spark):
    assert values(spark, ["ABcd", "", None], numerals.upper_ratio) == [0.5, None, None]
    assert values(spark, ["AÑ 1", "Ab", "12", ""], numerals.is_upper) == [True, False, False, False]


def test_tags(spark):
    t = "<paragraph>\n<bold12>A</bold12>\n</paragraph><font=Arial12>x</font>"
    assert values(spark, [t, "no tags", None], markup.first_open_tag) == ["paragraph", "d'oh", None]
    assert values(spark, [t], markup.tag_set) == [["bold12", "font", "font=Arial12", "paragraph"]]
    assert values(spark, [t], markup.raw_text) == ["\nA\nx"]
    assert values(spark, ["<bold12> </bold12>x<paragraph>\n\n</paragraph>"], markup.clean_xml) == ["x"]
    assert values(spark, ["bold12", "x", ""], markup.trailing_number) == [12, None, None]


def test_between_tags(spark):
    rows = ["a<b>c</b>d", "</b><b>x</b>", "<b>open", None]
    assert [r and r["text"] for r in values(spark, rows, lambda c: markup.between_tags(c, "b"))] == ["c", "x", None, None]
    assert [r and r["start"] for r in values(spark, rows, lambda c: markup.between_tags(c, "b"))] == [1, 4, None, None]


def test_paragraph_slices(spark):
    t = "<paragraph>uno.\n</paragraph><paragraph></paragraph>"
    assert values(spark, [t], markup.paragraphs) == [["uno.\n", ""]]
    assert values(spark, [t], lambda c: markup.paragraphs(c, drop_last=True)) == [["uno.", ""]]


def test_labels(spark):
    assert values(spark, ["La Decisión y pruebas", "x", None], labels.first_label) == ["decisión", "none", None]
    assert values(spark, ["II. HECHOS", "VII. D E C I S I Ó N", "x", None], labels.section_name) == ["Factual Background", "Decision", "Pending", None]
    assert values(spark, ["a b  c", "a b", None], lambda c: labels.truncate_words(c, 2)) == ["a b", "a b", None]
    assert values(spark, ["x ## a ## b ", "x"], lambda c: labels.response_tail(c, "##")) == ["b", "x"]


def test_accents(spark):
    assert values(spark, ["  Ñandú éxito ", None], text.fold) == ["nandu exito", None]
