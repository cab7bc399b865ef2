"""The section engine: formats, starts, names, dissents, signatures and footnotes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docframe.functions.labels import PENDING, SECTIONS, categorise, closest_alias, section_name
from docframe.functions.numerals import clean_spaces, is_upper, next_number, numeral_format, words
from docframe.functions.text import strip
from docframe.operators.segment import paragraph_order, section_fill
from docframe.plans.lineage import materialise

# The words that headings are looked for by, and those that close a decision.
HEADINGS = ["ANTECEDENTES", "CONSIDERACIONES", "NORMA DEMANDADA", "NORMA ACUSADA", "DEMANDA", "DECISION", "DECISIÓN"]
CLOSING = "notifíquese|cúmplase|publíquese|líbrese|notifiquese|líbrense|cumplase"
FUZZY, GAP, SLACK = 30, 8, 100
# How a heading of either arabic format begins.
ARABIC_START = {"ara-hyphen": r"^\b\d+\b[ ]*[-][^0-9]", "ara-dot": r"^\d+[ ]*[\.][ ]*[-]*[A-Z]{2,}"}


def section_format(paragraphs: DataFrame) -> DataFrame:
    """(document, format): the most frequent numeral format of the first paragraph with each heading word.

    A heading without a numeral takes that of the paragraph before it; of equally frequent formats the first counts.
    """
    before = F.lag("text").over(paragraph_order())
    rows = paragraphs.where("text is not null").select("document", "paragraph_id", "text", before.alias("before"))
    hits = rows.select("document", "paragraph_id", "text", "before", F.explode(F.filter(F.array(*map(F.lit, HEADINGS)), lambda k: F.col("text").contains(k))).alias("keyword"))
    first = hits.groupBy("document", "keyword").agg(F.min_by(F.struct("paragraph_id", "text", "before"), "paragraph_id").alias("p")).select("document", "p.*").distinct()
    first = first.withColumn("own", numeral_format(F.left(strip(F.col("text")), F.lit(15)))["format"])
    subject = F.when(F.col("own") == "unknown", strip(F.col("before")))
    first = first.withColumn("other", numeral_format(subject)["format"])
    found = first.select("document", "paragraph_id", F.when(F.col("own") != "unknown", F.col("own")).otherwise(F.coalesce("other", F.lit("unknown"))).alias("format")).where("format <> 'unknown'")
    counted = found.groupBy("document", "format").agg(F.count("*").alias("n"), F.min("paragraph_id").alias("first"))
    return counted.groupBy("document").agg(F.max_by("format", F.struct("n", -F.col("first"))).alias("format"))


def _candidates(rows: DataFrame) -> DataFrame:
    """(document, paragraph_id, roman, n) of (document, paragraph_id, text, format): the number after the one that a possible heading begins with.

    Each step is a column of its own, so that no expression is computed twice.
    """
    roman = F.col("format").startswith("rom")
    rows = rows.where((roman & (F.length("text") < 75)) | (~roman & F.col("text").rlike(r"^(?U)\s*\d")))
    rows = rows.withColumn("head", F.left(strip(F.col("text")), F.lit(15)))
    rows = rows.withColumn("token", words(clean_spaces(F.left("head", F.lit(10)))))
    fits = lambda w: F.when(F.col("format") == "rom-hyphen", w.rlike("^[MDCLXVI]*-$")).otherwise(w.rlike(r"^[MDCLXVI]*\.-?$"))
    first = F.try_element_at(F.filter(words(clean_spaces(F.col("token")[0])), fits), F.lit(1))
    is_arabic = ((F.col("format") == "ara-hyphen") & F.col("head").rlike(ARABIC_START["ara-hyphen"])) | ((F.col("format") == "ara-dot") & F.col("head").rlike(ARABIC_START["ara-dot"]))
    number = F.when(roman, F.when(F.size("token") > 1, first)).when(is_arabic, words(F.col("head"))[0])
    return rows.withColumn("number", number).select("document", "paragraph_id", roman.alias("roman"), next_number(F.col("number")).alias("n"))


def section_starts(paragraphs: DataFrame, formats: DataFrame) -> DataFrame:
    """(document, paragraph_id): headings whose number does not fall behind the last accepted one, nor, for roman numerals, leap by ten.

    The scan is greedy and depends on order, so each document's few candidates are folded in an array.
    """
    rows = _candidates(paragraphs.join(formats, "document").select("document", "paragraph_id", "text", "format"))
    listed = rows.groupBy("document").agg(F.first("roman").alias("roman"), F.array_sort(F.collect_list(F.when(F.col("n").isNotNull(), F.struct("paragraph_id", "n")))).alias("xs"))
    start = F.struct(F.lit(-1).alias("at"), F.array().cast("array<int>").alias("ids"))

    def step(acc: Column, x: Column) -> Column:
        good = (x["n"] >= acc["at"]) & (~F.col("roman") | (x["n"] - acc["at"] < 10))
        return F.struct(F.when(good, x["n"]).otherwise(acc["at"]).alias("at"), F.when(good, F.concat(acc["ids"], F.array(x["paragraph_id"]))).otherwise(acc["ids"]).alias("ids"))

    return listed.select("document", F.explode(F.aggregate("xs", start, step)["ids"]).alias("paragraph_id"))


def name_starts(paragraphs: DataFrame, starts: DataFrame) -> DataFrame:
    """(document, paragraph_id, section): starts named by the dictionary, or by the nearest alias below FUZZY edits."""
    rows = paragraphs.join(starts, ["document", "paragraph_id"], "left_semi").select("document", "paragraph_id", "text")
    rows = rows.withColumn("known", section_name(F.left("text", F.lit(50))))
    rows = rows.withColumn("near", closest_alias(F.when(F.col("known") == PENDING, F.col("text")), SECTIONS, FUZZY - 1))
    name = F.when(F.col("known") != PENDING, F.col("known")).when(F.col("near.distance") < FUZZY, F.col("near.section")).otherwise(F.lit(PENDING))
    return rows.select("document", "paragraph_id", name.alias("section"))


def starts_without_number(paragraphs: DataFrame, styles: DataFrame) -> DataFrame:
    """(document, paragraph_id): for each alias in capitals its first paragraph, if all its excerpts are plain emphasis."""
    aliases = [a.upper() for xs in SECTIONS.values() for a in xs]
    hit = F.filter(F.array(*(F.when(F.col("text").rlike(a), F.lit(k)) for k, a in enumerate(aliases))), lambda x: x.isNotNull())
    rows = paragraphs.where(F.col("text").rlike("|".join(aliases))).select("document", "paragraph_id", F.explode(hit).alias("alias"))
    first = rows.groupBy("document", "alias").agg(F.min("paragraph_id").alias("paragraph_id")).select("document", "paragraph_id").distinct()
    types = styles.groupBy("document", "paragraph_id").agg(F.bool_and(F.coalesce(F.col("text_type") == "emphasis", F.lit(False))).alias("strong"))
    return first.join(types.where("strong"), ["document", "paragraph_id"], "left_semi")


def dissents(paragraphs: DataFrame, styles: DataFrame) -> DataFrame:
    """Paragraphs with the section 'Dissenting Opinion - n' from each dissent's heading to the next or the document's end."""
    t, low = F.col("text"), F.lower("text")
    heading = (
        ((F.col("text_type") == "emphasis") | is_upper(t)) & ~t.rlike(r"^(?U)\d+")
        & (low.contains("salvamento") | low.contains("aclaración de voto"))
        & ~low.contains("motivo") & ~low.contains("fundamentos") & ~low.contains("razones") & ~low.contains("razón")
    )
    marks = styles.where(heading).select("document", "paragraph_id", F.length("text").alias("head"))
    whole = paragraphs.select("document", "paragraph_id", F.length("text").alias("size"))
    good = marks.join(whole, ["document", "paragraph_id"]).where(F.col("size") < F.col("head") + SLACK).groupBy("document", "paragraph_id").agg(F.count("*").alias("k"))
    number = F.sum("k").over(paragraph_order().rowsBetween(W.unboundedPreceding, 0))
    starts = good.select("document", "paragraph_id", F.concat(F.lit("Dissenting Opinion - "), number.cast("string")).alias("section"))
    return section_fill(paragraphs, starts)


def signatures(paragraphs: DataFrame, styles: DataFrame) -> DataFrame:
    """Paragraphs with those after a closing formula, in its section, set to 'Signature Block'.

    A formula counts if an excerpt with it is neither quote nor footnote, and the next formula in the document is more
    than GAP paragraphs off or there is none.
    """
    closing = F.lower("text").rlike(CLOSING)
    real = styles.where(closing & (F.coalesce(~F.col("text_type").isin("quote", "footnote"), F.lit(True)))).select("document", "paragraph_id").distinct().withColumn("real", F.lit(True))
    hits = paragraphs.where(closing).select("document", "paragraph_id", "section")
    gap = F.lead("paragraph_id").over(paragraph_order()) - F.col("paragraph_id")
    last = hits.withColumn("gap", gap).join(real, ["document", "paragraph_id"]).where(f"gap is null or gap > {GAP}")
    begin = last.groupBy("document", "section").agg(F.min("paragraph_id").alias("begin"))
    joined = paragraphs.join(begin, ["document", "section"], "left")
    return joined.withColumn("section", F.when(F.col("paragraph_id") > F.col("begin"), "Signature Block").otherwise(F.col("section"))).select(*paragraphs.columns)


def footnotes(styles: DataFrame) -> DataFrame:
    """Excerpts with short footnotes inside a paragraph made footnote numbers and a footnote's paragraph all footnote."""
    one = F.when(F.col("text_type").contains("footnote") & (F.col("paragraph_pos") > 5) & (F.col("length") < 10), "footnote_number").otherwise(F.col("text_type"))
    rows = styles.withColumn("t", one)
    has = F.max(F.coalesce(F.col("t").contains("footnote") & (F.col("t") != "footnote_number"), F.lit(False))).over(W.partitionBy("document", "paragraph_id"))
    new = F.when(has & ~F.col("t").contains("footnote"), F.when(F.col("t") == "plain", "footnote").otherwise(F.concat(F.lit("footnote_"), F.col("t")))).otherwise(F.col("t"))
    return rows.withColumn("text_type", new).drop("t")


def integrity(paragraphs: DataFrame) -> DataFrame:
    """(document, first, last, missing): the numbers of the document's sections, and those between them that lack."""
    heads = paragraphs.where("section is not null").groupBy("document", "section").agg(F.min_by("text", "paragraph_id").alias("text"), F.min("paragraph_id").alias("paragraph_id"))
    number = next_number(F.regexp_extract(strip(F.col("text")), r"^([MDCLXVI]+|[0-9]+)[ ]*[.-]", 1)) - 1
    rows = heads.select("document", F.when(F.col("section") == "header", 0).otherwise(number).alias("n")).where("n >= 0")
    return rows.groupBy("document").agg(F.min("n").alias("first"), F.max("n").alias("last"), F.array_sort(F.collect_set("n")).alias("ns")).select(
        "document", "first", "last", F.array_except(F.sequence("first", "last"), "ns").alias("missing")
    )


def push_sections(paragraphs: DataFrame, styles: DataFrame) -> DataFrame:
    """Excerpts with the section of their paragraph; those of unknown paragraphs keep their own."""
    by_key = paragraphs.select("document", "paragraph_id", F.col("section").alias("new"))
    return styles.join(by_key, ["document", "paragraph_id"], "left").withColumn("section", F.coalesce("new", "section")).drop("new")


def annotate(paragraphs: DataFrame, styles: DataFrame) -> DataFrame:
    """Paragraphs with sections found from their text: numbered headings, or capitals where a document has none; then dissents and signatures."""
    plain, styles = materialise(paragraphs.withColumn("section", F.lit("header")), "plain"), materialise(styles, "styles")
    formats = materialise(section_format(plain), "formats")
    numbered = section_starts(plain, formats)
    rest = starts_without_number(plain, styles).join(formats, "document", "left_anti")
    filled = materialise(section_fill(plain, name_starts(plain, numbered.unionByName(rest))), "filled")
    return signatures(materialise(dissents(filled, styles), "dissents"), styles)


def fuzzy_pending(paragraphs: DataFrame) -> DataFrame:
    """(document, paragraph_id, section, alias, distance): the nearest alias of each run of pending paragraphs' first."""
    from docframe.operators.segment import boundary_filter

    near = closest_alias(F.lower("text"), SECTIONS)
    return boundary_filter(paragraphs).where(F.col("section") == PENDING).select("document", "paragraph_id", near["section"].alias("section"), near["alias"].alias("alias"), near["distance"].alias("distance"))


def categorised(paragraphs: DataFrame) -> DataFrame:
    return paragraphs.select("document", "paragraph_id", categorise(F.left("text", F.lit(50)), SECTIONS).alias("section"))
