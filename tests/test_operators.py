"""Small documents for the operators of sequences, sections, statistics and sampling."""

import json
import os
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from docframe.operators import evaluate, joins, prompts, sampling, sections, segment, stats
from docframe.plans.lineage import materialise, release
from docframe.sources import files
from docframe.streaming import ingest

PARAGRAPHS = "id bigint, document bigint, paragraph_id int, section string, text string, length int"


def paragraphs(spark, texts, document=1, section="header"):
    return spark.createDataFrame([(100 * document + k, document, k, section, t, len(t or "")) for k, t in enumerate(texts)], PARAGRAPHS)


def styles(spark, rows):
    return spark.createDataFrame([(k, 1, p, pos, kind, t, len(t)) for k, (p, pos, kind, t) in enumerate(rows)], "id bigint, document bigint, paragraph_id int, paragraph_pos int, text_type string, text string, length int")


def test_section_starts_reject_and_accept(spark):
    p = paragraphs(spark, ["I. ANTECEDENTES", "II. DEMANDA", "I. CONSIDERACIONES", "x", "XV. DECISION", "", None, "IV. PRUEBAS", "V." , "III. " + "z" * 80])
    formats = sections.section_format(p)
    assert formats.collect()[0]["format"] == "rom-dot"
    got = {r["paragraph_id"] for r in sections.section_starts(p, formats).collect()}
    assert got == {0, 1, 7}


def test_format_from_the_paragraph_before(spark):
    p = paragraphs(spark, ["3-", "ANTECEDENTES", "x"])
    assert sections.section_format(p).collect()[0]["format"] == "ara-hyphen"


def test_fill_and_boundaries(spark):
    p = paragraphs(spark, ["a", "b", "c", "d"])
    starts = spark.createDataFrame([(1, 1, "X"), (1, 3, "Y")], "document bigint, paragraph_id int, section string")
    filled = segment.section_fill(p, starts)
    assert [r["section"] for r in filled.orderBy("paragraph_id").collect()] == ["header", "X", "X", "Y"]
    assert sorted(r["paragraph_id"] for r in segment.boundary_filter(filled).collect()) == [0, 1, 3]


def test_signature_gap(spark):
    texts = ["x"] * 20
    texts[2] = texts[10] = texts[19] = "Notifíquese y cúmplase."
    s = styles(spark, [(k, 0, "plain", t) for k, t in enumerate(texts)])
    got = [r["section"] for r in sections.signatures(paragraphs(spark, texts), s).orderBy("paragraph_id").collect()]
    assert got == ["header"] * 11 + ["Signature Block"] * 9  # the gap of 8 after the first is too small
    quoted = styles(spark, [(k, 0, "quote", t) for k, t in enumerate(texts)])
    assert set(r["section"] for r in sections.signatures(paragraphs(spark, texts), quoted).collect()) == {"header"}


def test_dissents_number_and_slack(spark):
    texts = ["x", "SALVAMENTO DE VOTO", "y", "ACLARACIÓN DE VOTO" + "z" * 200, "SALVAMENTO PARCIAL", "w"]
    s = styles(spark, [(k, 0, "emphasis", t if k != 3 else t[:18]) for k, t in enumerate(texts)])
    got = [r["section"] for r in sections.dissents(paragraphs(spark, texts), s).orderBy("paragraph_id").collect()]
    assert got == ["header", *["Dissenting Opinion - 1"] * 3, *["Dissenting Opinion - 2"] * 2]


def test_footnotes(spark):
    s = styles(spark, [(0, 0, "plain", "a" * 20), (0, 20, "footnote", "12"), (1, 0, "footnote_quote", "b" * 20), (1, 20, "plain", "c"), (1, 21, "emphasis", "D")])
    got = [r["text_type"] for r in sections.footnotes(s).orderBy("id").collect()]
    assert got == ["plain", "footnote_number", "footnote_quote", "footnote", "footnote_emphasis"]


@pytest.mark.parametrize(("n", "rows"), [(1, [1]), (4, [4]), (5, [5]), (6, [5, 1]), (11, [5, 5, 1])])
def test_merge_chunks(spark, n, rows):
    got = segment.merge_chunks(paragraphs(spark, [str(k) for k in range(n)])).orderBy("part").collect()
    assert [r["rows"] for r in got] == rows
    assert " ".join(r["text"] for r in got) == " ".join(map(str, range(n)))


@pytest.mark.parametrize(("n", "firsts"), [(1, [0]), (5, [0, 3]), (6, [0, 3]), (12, [0, 3, 6, 9])])
def test_sliding_chunks(spark, n, firsts):
    got = segment.sliding_chunks(paragraphs(spark, [str(k) for k in range(n)])).orderBy("first").collect()
    assert [r["first"] for r in got] == firsts
    with pytest.raises(ValueError):
        segment.sliding_chunks(paragraphs(spark, ["a"]), 3, 3)


def test_excerpts_and_body(spark):
    text = "<document>\n<paragraph>\n<bold14>TITULO</bold14>\n</paragraph>\n<paragraph>\n<regular12>uno </regular12><italic12>dos</italic12><regular8>3</regular8>\n</paragraph></document>"
    tagged = spark.createDataFrame([(1, text), (2, ""), (3, None)], "document bigint, text string")
    got = segment.excerpt_split(tagged).orderBy("paragraph_id", "run").collect()
    assert [(r["text_type"], r["text_type_es"], r["paragraph_pos"]) for r in got] == [("title_emphasis", "título_énfasis", 0), ("plain", "normal", 0), ("quote", "cita", 4), ("footnote", "pie de página", 7)]
    table = segment.paragraph_table(tagged).orderBy("paragraph_id").collect()
    assert [(r["previous"], r["next"]) for r in table] == [(-1, 1), (0, -1)]


def test_latest_row_wins(spark):
    rows = spark.createDataFrame([(1, 7, 0, "old", 1), (2, 7, 0, "new", 2), (3, 8, 0, "only", 1)], "id bigint, document bigint, paragraph_id int, text string, ingested_at int")
    assert sorted(r["text"] for r in segment.latest(rows, ["document", "paragraph_id"]).collect()) == ["new", "only"]


@pytest.mark.parametrize("n", [0, 10, 11])
def test_split_sizes(spark, n):
    rows = spark.range(n).withColumnRenamed("id", "record_id")
    got = {r["new_split"]: r["count"] for r in sampling.split(rows, "record_id").groupBy("new_split").count().collect()}
    assert got == ({} if not n else {"train": 7, "val": 2, "test": n - 9})


def test_rank_is_whole_and_stable(spark):
    rows = spark.range(500).withColumnRenamed("id", "record_id")
    one = {r["record_id"]: r["rank"] for r in sampling.hash_rank(rows, "record_id").collect()}
    two = {r["record_id"]: r["rank"] for r in sampling.hash_rank(rows.repartition(7), "record_id").collect()}
    assert one == two and sorted(one.values()) == list(range(1, 501))


def test_names(spark):
    df = spark.createDataFrame([(x,) for x in ["T-123-05", "C-001-91", "SU123-99", "A012-2010", "X-1", "t-040-20.pdf", None]], "name string")
    got = [tuple(r[0]) for r in df.select(joins.parse_name(F.col("name"))).collect()]
    assert got == [("T", 2005), ("C", 1991), ("SU", 1999), ("A", 2010), (None, None), ("T", 2020), (None, None)]


def test_align_moves_on(spark):
    e = spark.createDataFrame([(1, 0, 0, 0, "uno"), (1, 1, 0, 3, "dos"), (1, 2, 1, 0, "uno"), (1, 3, 1, 9, "nunca")], "document bigint, id bigint, paragraph_id int, paragraph_pos int, text string")
    t = spark.createDataFrame([(1, "uno dos uno")], "document bigint, text string")
    assert [r["start"] for r in joins.align(e, t).orderBy("id").collect()] == [0, 4, 8, -1]


def test_align_shrinks_short_excerpts(spark):
    e = spark.createDataFrame([(1, 0, 0, 0, "uno dos tres cuatro"), (1, 1, 1, 0, "cinco"), (1, 2, 2, 0, "a " * 9 + "b"), (1, 3, 3, 0, "nada de eso"), (1, 4, 4, 0, " ")], "document bigint, id bigint, paragraph_id int, paragraph_pos int, text string")
    t = spark.createDataFrame([(1, "x uno dos tres cinco " + "a " * 9 + "c")], "document bigint, text string")
    assert [r["start"] for r in joins.align(e, t).orderBy("id").collect()] == [2, 15, 21, -1, 22]


def test_unique_containing(spark):
    p = paragraphs(spark, ["la casa grande", "la casa", "otra"], section="S")
    texts = spark.createDataFrame([(1, 1, "grande"), (1, 2, "casa"), (1, 3, "nada"), (1, 4, "")], "document bigint, text_id bigint, text string")
    got = {r["text_id"]: r["section"] for r in joins.unique_containing(texts, p).collect()}
    assert got == {1: "S", 2: "unmatched", 3: "unmatched", 4: "unmatched"}


def test_evaluation(spark):
    rows = spark.createDataFrame([("a", "a"), ("a", "b"), (" b", "b "), (None, "a"), ("a", None)], "t string, p string")
    assert evaluate.accuracy(rows, "t", "p").first()[0] == pytest.approx(0.2)
    assert evaluate.accuracy_strip(rows, "t", "p").first()[0] == pytest.approx(2 / 3)
    report = {r["label"]: r for r in evaluate.class_report(rows, "t", "p").collect()}
    assert report["a"]["precision"] == pytest.approx(0.5) and report["a"]["recall"] == pytest.approx(1 / 3)
    assert report["b"]["f1"] == 0.0


def test_prompts(spark):
    pool = spark.createDataFrame([(k, f"in{k}", f"out{k}") for k in range(5)], "shot_id int, input string, output string")
    rows = spark.createDataFrame([(1, "un texto bastante largo"), (2, "corto")], "record_id int, input string")
    shots = sampling.sample_shots(rows, pool, 4)
    assert all(len({s["input"] for s in r["shots"]}) == 4 for r in shots.collect())
    assert [r["record_id"] for r in prompts.few_shot_records(shots, "p").collect()] == [1]
    assert prompts.predict(rows, lambda xs: ["La decisión"] * len(xs)).collect()[0]["prediction"] == "decisión"
    with pytest.raises(ValueError):
        prompts.to_records(rows, "", "input", "input")
    with pytest.raises(ValueError):
        sampling.sample_shots(rows, pool, 6)


def test_time_grid_has_zeros(spark):
    s = spark.createDataFrame([(1, "A", "plain", 10), (2, "B", "plain", 4), (2, "Pending", "plain", 9)], "document bigint, section string, text_type string, length int")
    d = spark.createDataFrame([(1, "T", 2000), (2, "C", 2001)], "id bigint, type string, year int")
    got = {(r["year"], r["section"]): r["avg_length"] for r in stats.time_analysis(stats.length_by_section(s), d).collect()}
    assert got == {(2000, "A"): 10.0, (2000, "B"): 0.0, (2001, "A"): 0.0, (2001, "B"): 4.0}


def test_files_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([("i", 'a "quoted"\nline ', "x"), ("i", None, "y")], files.RECORDS)
    files.write_csv(rows, str(tmp_path / "csv"))
    assert sorted(map(str, files.read_csv(spark, str(tmp_path / "csv"), files.RECORDS).collect())) == sorted(map(str, rows.collect()))
    (tmp_path / "a.json").write_text(json.dumps([{"instruction": "i", "input": "t", "output": "l"}]))
    assert files.read_records(spark, str(tmp_path / "a.json")).collect()[0].asDict() == {"prompt": "i", "text": "t", "label": "l"}
    assert files.read_splits(spark, {"train": str(tmp_path / "a.json")}).collect()[0]["split"] == "train"


def test_materialise_and_release(spark):
    table = materialise(spark.range(3).toDF("x"), "t")
    paths = [p.removeprefix("file://") for p in table.inputFiles()]
    assert table.count() == 3 and all(map(os.path.exists, paths))
    release(table)
    assert not any(map(os.path.exists, paths))


def test_stream(spark, tmp_path):
    texts = spark.createDataFrame([(1, "<paragraph>uno</paragraph><paragraph>dos</paragraph>")], "document bigint, text string")
    texts.write.parquet(str(tmp_path / "in"))
    stream = ingest.read_stream(spark, str(tmp_path / "in"), texts.schema)
    ingest.run_batches(stream, segment.paragraph_table, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2


def test_broken_paragraphs_join_their_host(spark):
    rows = [
        (1, 0, "\n<regular12>Uno dos</regular12>\n"), (1, 1, "\n<regular12>y tres</regular12>\n"),
        (1, 2, "\n<regular8>a</regular8><regular8>b</regular8><regular8>c</regular8><bold12>d</bold12><italic12>E f</italic12>\n"),
        (1, 3, "\n<regular12>palabra</regular12>\n"), (1, 4, "\n<regular12>Página No. 3</regular12>\n"), (1, 5, "\n<regular12>Cuatro</regular12>\n"), (1, 6, "\n<bold12>cinco seis</bold12>\n"),
        (1, 7, None), (2, 0, "\n<regular12>sin huésped</regular12>\n"), (2, 1, ""),
    ]
    paragraphs = spark.createDataFrame(rows, "document bigint, paragraph_id int, text string")
    body = spark.createDataFrame([(1, 12), (2, 12)], "document bigint, body int")
    got = {(r["document"], r["paragraph_id"]): r["text"] for r in segment.paragraph_repair(paragraphs, body).collect()}
    assert set(got) == {(1, 0), (1, 4), (1, 5), (1, 7), (2, 1)}
    # Of distinct tags most have size 12, so the paragraph with three runs of size 8 is joined too.
    assert got[1, 0] == "\n<regular12>Uno dos y tres</regular12>\n " + rows[2][2] and got[1, 5] == rows[5][2] + " " + rows[6][2]


def test_prefixes_of_any_length(spark):
    cases = spark.createDataFrame([(1, "T-123-05"), (2, "T-1"), (3, "C-9"), (4, None)], "id bigint, name string")
    names = spark.createDataFrame([("T-",), ("T-1",), ("C",), ("T-123-05",), ("X",), (None,), ("t",), ("T-",)], "name string")
    assert sorted(tuple(r) for r in joins.by_prefix(cases, names).collect()) == [("C", 3), ("T-", 1), ("T-1", 1), ("T-123-05", 1)]
    assert joins.by_prefix(cases.limit(0), names).count() == 0


@pytest.mark.parametrize("most", [300, 1_000_000])
def test_unique_containing_as_by_comparing_all(spark, monkeypatch, most):
    """A long document is cut into blocks of either side; no text is compared with every paragraph."""
    r = random.Random(most)
    word = lambda n: "".join(r.choice("abñ😀 ") for _ in range(n))
    texts = [None, "", *(word(r.randint(1, 60)) for _ in range(120))]
    bodies = [(r.choice([1, 1, 1, 2, 3, None]), r.choice(texts), r.choice(["x", "y", None])) for _ in range(240)]
    part = lambda b: (lambda k: b[k : k + r.randint(1, 40)])(r.randint(0, len(b)))
    asked = [(r.choice([1, 1, 2, 3, 4, None]), r.choice([k, k, k, 7, None]), r.choice([None, "", word(3), *[part(r.choice(bodies)[1] or "a")] * 6])) for k in range(400)]
    n, section = Counter(), {}
    for d, i, t in asked:
        hits = [s for of, b, s in bodies if t and d is not None and of == d and b and t in b]
        n[d, i] += len(hits)
        section |= {(d, i): s for s in hits}
    true = Counter((d, i, (section[d, i] if i is not None and n[d, i] == 1 else None) or "unmatched") for d, i, _ in asked)
    monkeypatch.setattr(joins, "TEXTS", most)
    monkeypatch.setattr(joins, "BODIES", most)
    found = joins.unique_containing(spark.createDataFrame(asked, "document bigint, text_id bigint, text string"), spark.createDataFrame(bodies, "document bigint, text string, section string"))
    assert Counter(map(tuple, found.collect())) == true and sum(n for (*_, s), n in true.items() if s != "unmatched") > 5
    physical = found._jdf.queryExecution().executedPlan().toString()
    assert "Contains(" not in physical
