"""Queries over small tables, compared with plain Python."""

from itertools import groupby

import pytest

from docframe.functions import labels
from docframe.queries import queries

PARAGRAPHS = "id bigint, document bigint, paragraph_id int, section string, text string, length int, ingested_at timestamp"
FONTS = ("Times-Bold", "Arial-BoldItalic", "Courier", "Times-Italic")


@pytest.fixture
def folder(tmp_path):
    return str(tmp_path)


def write(spark, folder, name, rows, schema):
    spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{name}.parquet")


def glyph_font(k, paragraph):
    return FONTS[(k // 7 + paragraph) % 4], 8 + k // 14 % 3 * 2.5


def test_glyphs_of_all_documents_and_whole_texts(spark, folder):
    texts = {(1, 0): "añ😀 " * 50, (1, 1): "x", (1, 2): "", (1, 3): None, (50, 0): "b" * 130, (70001, 2): "c d"}
    write(spark, folder, "paragraphs_df", [(k, d, p, "header", t, len(t or ""), None) for k, ((d, p), t) in enumerate(texts.items())], PARAGRAPHS)
    true = set()
    for (d, p), t in texts.items():
        runs = groupby(enumerate(t or "", 1), lambda x: glyph_font(x[0], p))
        true |= {(d, p, run, *font, "".join(ch for _, ch in chars)) for run, (font, chars) in enumerate(runs, 1)}
    found = [(r["document"], r["element"], r["run"], r["fontname"], r["size"], r["text"]) for r in queries()["glyph_runs"](spark, folder).collect()]
    assert len(found) == len(true) and set(found) == true
    labels = {(r["fontname"], r["size"]) for r in queries()["font_label"](spark, folder).collect()}
    assert labels == {r[3:5] for r in true}


def test_texts_of_all_documents_come_back(spark, folder):
    rows = [(0, 1, 0, "a"), (1, 1, 1, "b\nc\r\nd"), (2, 29, 0, ""), (3, 30, 0, "e"), (4, 70001, 0, "f"), (5, 70001, 1, None), (6, -3, 0, "g"), (7, None, 0, "h")]
    write(spark, folder, "paragraphs_df", [(k, d, p, "header", t, 0, None) for k, d, p, t in rows], PARAGRAPHS)
    found = {r["document"]: r["paragraphs"] for r in queries()["src_text"](spark, folder).collect()}
    assert found == {1: 2, 29: 1, 30: 1, 70001: 1, -3: 1, None: 1}


def test_documents_of_all_languages_become_text(spark, folder):
    rows = [(1, "<p>Un texte</p>\n<b>gras</b>", "fr"), (2, "<p>Un texto</p>\r\n\tmás ", "es"), (3, "sin etiqueta", None), (4, "", "de"), (5, None, "fr"), (6, "bon", "French"), (6, "bon", "French"), (None, "x\ty", "en")]
    write(spark, folder, "documents", rows, "doc_id bigint, text string, lang string")
    found = [(r["doc_id"], r["text"]) for r in queries()["xml_to_text_files"](spark, folder).collect()]
    true = [(1, "Un texte gras"), (2, "Un texto  \tmás"), (3, "sin etiqueta"), (4, ""), (6, "bon"), (6, "bon"), (None, "x\ty")]
    assert sorted(found, key=str) == sorted(true, key=str)


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_closest_alias_of_long_paragraphs(spark, folder):
    rows = [(0, "antecedentes"), (1, "x" * 74), (2, "resuelve " * 9), (3, "consideraciones de la corte y otras cosas que no caben en un titulo " * 3), (4, None), (5, "")]
    write(spark, folder, "paragraphs_df", [(k, 1, k, "header", t, 0, None) for k, t in rows], PARAGRAPHS)
    pairs = [(s, a) for s, aliases in labels.SECTIONS.items() for a in aliases]
    true = set()
    for k, t in rows:
        if t is not None:
            d, at = min((levenshtein(t, a), at) for at, (_, a) in enumerate(pairs))
            true.add((k, *pairs[at], d))
    assert {(r["id"], r["section"], r["alias"], r["distance"]) for r in queries()["closest_alias"](spark, folder).collect()} == true
