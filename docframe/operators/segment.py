"""Sequences within documents: paragraphs, excerpts, fonts, intervals and chunks.

Everything is a window over one hash partitioning by document; dictionaries are generated expressions.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docframe.functions import markup
from docframe.functions.numerals import is_upper


def paragraph_order():
    """The window of a document's paragraphs in order (a function: windows need a session)."""
    return W.partitionBy("document").orderBy("paragraph_id")


def latest(table: DataFrame, keys: list[str], when: str = "ingested_at", tie: str = "id") -> DataFrame:
    """The row last ingested of each key; rows with a null key part are kept by that key too.

    A window and not an aggregate of whole rows, so that only the columns used later are read and shuffled, and copies
    fall away before the shuffle.
    """
    w = W.partitionBy(*keys).orderBy(F.desc_nulls_last(when), F.desc_nulls_last(tie))
    return table.withColumn("_place", F.row_number().over(w)).where("_place = 1").drop("_place")


def paragraph_table(tagged: DataFrame, drop_last: bool = False) -> DataFrame:
    """(document, paragraph_id, previous, next, length, document_pos, section, function, text) of (document, text).

    length counts the raw paragraph, text is without newlines at its ends; previous and next are -1 at the ends.
    """
    rows = tagged.select("document", F.posexplode(markup.paragraphs(F.col("text"), drop_last=drop_last)).alias("paragraph_id", "raw"))
    w = W.partitionBy("document").orderBy("paragraph_id")
    raw = markup.raw_text(F.col("raw"))
    return rows.select(
        "document", "paragraph_id",
        F.lag("paragraph_id", 1, -1).over(w).alias("previous"), F.lead("paragraph_id", 1, -1).over(w).alias("next"),
        F.length(raw).alias("length"),
        F.coalesce(F.sum(F.length(raw)).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("document_pos"),
        F.lit("header").alias("section"), F.lit("Pending").alias("function"),
        F.regexp_replace(raw, r"^\n+|\n+$", "").alias("text"),
    )


def text_type(tag: Column, text: Column, body: Column, names=("title", "page_number", "footnote", "emphasis", "quote", "plain")) -> Column:
    """The type of a tagged run from its font size, words and style; a tag without a size has no size part."""
    title, page, foot, emphasis, quote, plain = names
    size = markup.trailing_number(tag)
    by_size = F.when(size > body, title).when(text.startswith("Página No."), page).when(size <= body - 4, foot)
    is_page = F.coalesce(by_size == page, F.lit(False))
    upper = is_upper(text) & ~F.coalesce(by_size == title, F.lit(False))
    strong = F.when(~is_page & (upper | tag.contains("bold")), emphasis)
    cited = F.when(~is_page & tag.contains("italic"), quote)
    out = F.concat_ws("_", by_size, strong, cited)
    return F.when(out == "", plain).otherwise(out)


TYPES_ES = ("título", "número de página", "pie de página", "énfasis", "cita", "normal")


def font_mode(tagged: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """(keys, body): the size most frequent among the distinct tags of each group; of equals the greatest."""
    tags = tagged.select(*keys, F.explode(markup.tag_set(F.col(text))).alias("tag")).distinct()
    sizes = tags.withColumn("size", markup.trailing_number(F.col("tag"))).where("size is not null").groupBy(*keys, "size").count()
    return sizes.groupBy(*keys).agg(F.max_by("size", F.struct("count", "size")).alias("body"))


def excerpt_split(tagged: DataFrame) -> DataFrame:
    """The tagged runs of each paragraph of (document, text), typed by the document's body size and placed."""
    paragraphs = tagged.select("document", F.posexplode(markup.paragraphs(F.col("text"))).alias("paragraph_id", "raw"))
    plain = markup.raw_text(F.col("raw"))
    w = W.partitionBy("document").orderBy("paragraph_id")
    paragraphs = paragraphs.withColumn("start", F.coalesce(F.sum(F.length(plain)).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    rows = paragraphs.select("document", "paragraph_id", "start", F.posexplode(markup.runs(F.col("raw"))).alias("run", "r"))
    rows = rows.select("document", "paragraph_id", "start", "run", "r.tag", "r.text")
    before = W.partitionBy("document", "paragraph_id").orderBy("run").rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumn("length", F.length("text")).withColumn("paragraph_pos", F.coalesce(F.sum("length").over(before), F.lit(0)))
    body = font_mode(tagged, ["document"])
    return rows.join(body, "document", "left").select(
        "document", "paragraph_id", "run", text_type(F.col("tag"), F.col("text"), F.col("body")).alias("text_type"),
        text_type(F.col("tag"), F.col("text"), F.col("body"), TYPES_ES).alias("text_type_es"),
        "length", (F.col("start") + F.col("paragraph_pos")).alias("document_pos"), "paragraph_pos", "text",
    )


def semantic_xml(styles: DataFrame) -> DataFrame:
    """(document, text): the document rebuilt with its text types as tags."""
    run = F.concat(F.lit("<"), "text_type", F.lit(">"), "text", F.lit("</"), "text_type", F.lit(">"))
    paragraphs = styles.groupBy("document", "paragraph_id").agg(F.array_sort(F.collect_list(F.struct("paragraph_pos", "id", run.alias("run")))).alias("runs"))
    inner = F.array_join(F.transform("runs", lambda r: F.coalesce(r["run"], F.lit(""))), "\n")
    one = paragraphs.select("document", "paragraph_id", F.concat(F.lit("<paragraph>\n"), inner, F.lit("\n</paragraph>")).alias("p"))
    whole = one.groupBy("document").agg(F.array_sort(F.collect_list(F.struct("paragraph_id", "p"))).alias("ps"))
    return whole.select("document", F.concat(F.lit("<document>\n"), F.array_join(F.transform("ps", lambda x: x["p"]), "\n"), F.lit("\n</document>")).alias("text"))


def glyph_runs(glyphs: DataFrame) -> DataFrame:
    """(document, page, element, run, label_font, size, text): consecutive characters of one font and size."""
    w = W.partitionBy("document", "page", "element").orderBy("line", "pos")
    turn = F.coalesce((F.lag("fontname").over(w) != F.col("fontname")) | (F.lag("size").over(w) != F.col("size")), F.lit(True))
    rows = glyphs.withColumn("turn", turn.cast("int")).withColumn("run", F.sum("turn").over(w.rowsBetween(W.unboundedPreceding, 0)))
    return rows.groupBy("document", "page", "element", "run").agg(
        F.first("fontname").alias("fontname"), F.first("size").alias("size"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "pos", "ch"))), lambda x: x["ch"]), "").alias("text"),
    )


def font_label(name: Column, size: Column) -> Column:
    """Style word and size, rounded half to even, as in bold_italic12."""
    upper = F.upper(name)
    bold, italic = upper.contains("BOLD"), upper.contains("ITALIC")
    style = F.when(bold & italic, "bold_italic").when(bold, "bold").when(italic, "italic").otherwise("regular")
    return F.concat(style, F.bround(size, 0).cast("int").cast("string"))


def page_numbers(elements: DataFrame) -> DataFrame:
    """Elements (document, page, element, text) whose text is the page's number read 'Página No. n'; one is added to a page without."""
    plain = F.trim("text")
    mine = (F.length(plain) < 5) & plain.rlike("^[0-9]+$") & (plain.try_cast("int") == F.col("page"))
    rows = elements.withColumn("is_number", F.coalesce(mine, F.lit(False)))
    shown = F.concat(F.lit("Página No. "), F.col("page").cast("string"))
    kept = rows.select("document", "page", "element", F.when(F.col("is_number"), shown).otherwise(F.col("text")).alias("text"))
    lacking = rows.groupBy("document", "page").agg(F.max("is_number").alias("has"), (F.max("element") + 1).alias("element")).where(~F.col("has"))
    return kept.unionByName(lacking.select("document", "page", "element", shown.alias("text")))


def section_fill(paragraphs: DataFrame, starts: DataFrame) -> DataFrame:
    """Each paragraph with the section that started last at or before it; before the first, its own."""
    rows = paragraphs.join(starts.select("document", "paragraph_id", F.col("section").alias("_start")), ["document", "paragraph_id"], "left")
    filled = F.last("_start", ignorenulls=True).over(paragraph_order().rowsBetween(W.unboundedPreceding, 0))
    return rows.withColumn("section", F.coalesce(filled, "section")).drop("_start")


def boundary_filter(paragraphs: DataFrame) -> DataFrame:
    """The first paragraph of each consecutive run of one section in a document."""
    before = F.lag("section").over(paragraph_order())
    first = F.lag("paragraph_id").over(paragraph_order()).isNull()
    return paragraphs.withColumn("turn", first | ~before.eqNullSafe(F.col("section"))).where("turn").drop("turn")


def previous_block(styles: DataFrame) -> DataFrame:
    """Each excerpt with the type and text of the one before it in its paragraph."""
    w = W.partitionBy("document", "paragraph_id").orderBy("paragraph_pos", "id")
    return styles.withColumn("previous_type", F.lag("text_type").over(w)).withColumn("previous_text", F.lag("text").over(w))


def merge_chunks(paragraphs: DataFrame, n: int = 3, label: str = "section") -> DataFrame:
    """(document, chunk, label, rows, text): consecutive paragraphs of one label joined, at most n + 2 together."""
    turn = ~F.lag(label).over(paragraph_order()).eqNullSafe(F.col(label)) | F.lag("paragraph_id").over(paragraph_order()).isNull()
    rows = paragraphs.withColumn("run", F.sum(turn.cast("int")).over(paragraph_order().rowsBetween(W.unboundedPreceding, 0)))
    place = F.row_number().over(W.partitionBy("document", "run").orderBy("paragraph_id")) - 1
    rows = rows.withColumn("part", F.floor(place / (n + 2)).cast("int"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("paragraph_id", F.coalesce("text", F.lit("")).alias("text")))), lambda x: x["text"]), " ")
    return rows.groupBy("document", "run", "part").agg(F.first(label).alias("label"), F.count("*").alias("rows"), joined.alias("text"))


def sliding_chunks(paragraphs: DataFrame, n: int = 5, overlap: int = 2, wrap: bool = True, none: str = "Sin sección") -> DataFrame:
    """(document, first, label, input): windows of n paragraphs, each n - overlap after the one before.

    The label is the last section in the window that differs from the first paragraph's and is known; else ``none``.
    """
    if not 0 <= overlap < n:
        raise ValueError("0 <= overlap < n is needed")
    step = n - overlap
    place = (F.row_number().over(paragraph_order()) - 1).cast("int")
    rows = paragraphs.select("document", "paragraph_id", "section", F.coalesce("text", F.lit("")).alias("text"), place.alias("at"))
    # The windows that hold the paragraph at place k start at multiples of the step from k - n + 1 to k.
    low = F.greatest(F.lit(0), F.ceil((F.col("at") - n + 1) / step)).cast("int")
    rows = rows.withColumn("w", F.explode(F.sequence(low, F.floor(F.col("at") / step).cast("int"))))
    parts = F.array_sort(F.collect_list(F.struct("at", "section", "text")))
    rows = rows.groupBy("document", "w").agg(parts.alias("ps"))
    text = F.array_join(F.transform("ps", lambda p: markup.wrap(p["text"]) if wrap else markup.raw_text(p["text"])), "" if wrap else "\n")
    other = F.filter("ps", lambda p: (p["section"] != F.col("ps")[0]["section"]) & (p["section"] != "unmatched"))
    return rows.select("document", (F.col("w") * step).alias("first"), F.coalesce(F.try_element_at(other, F.lit(-1))["section"], F.lit(none)).alias("label"), text.alias("input"))


def paragraph_repair(paragraphs: DataFrame, body: DataFrame) -> DataFrame:
    """Paragraphs (document, paragraph_id, text) with those broken over pages joined to their host.

    One that begins in lower case in the body's size goes to the nearest earlier kept paragraph of the same font size
    that is no page number; single stray words and paragraphs without a host are dropped.  The host's text changes as
    it grows, so this is done document by document in Python.
    """
    import re
    from collections import Counter

    def body_size(p: str):
        """The size most frequent among the distinct tags; of equals the greatest."""
        sizes = Counter(int(m[1]) for m in (re.search(r"(\d+)$", tag) for tag in set(re.findall(r"</?([^( /><.)]+)>", p))) if m)
        return max(sizes, key=lambda s: (sizes[s], s)) if sizes else None

    def first_size(p: str) -> int:
        tag = re.search(r"<(\w+)>", p)
        number = tag and re.search(r"(\d+)$", tag[1])
        return int(number[1]) if number else 0

    def run(key: tuple, table: pd.DataFrame) -> pd.DataFrame:
        size = table["body"].iloc[0]
        kept: list[list] = []
        # The kept paragraphs that can be hosts; the last one takes the next broken paragraph.
        hosts: list[int] = []

        def can_host(p: str) -> bool:
            return body_size(p) == size and "Página No." not in p and first_size(p) >= size

        for pid, text in table.sort_values("paragraph_id")[["paragraph_id", "text"]].itertuples(index=False):
            text = text or ""
            plain = re.sub(r"<[^>]*>", "", text).strip()
            if not (plain and plain[0].islower() and body_size(text) == size):
                kept.append([pid, text])
                if can_host(text):
                    hosts.append(len(kept) - 1)
                continue
            if len(plain.split(" ")) == 1 or not hosts:
                continue
            host = kept[hosts[-1]]
            first, last = re.search(r"<(\w+)>", text), re.findall(r"</(\w+)>", host[1])
            if first and last and first[1] == last[-1]:
                host[1] = host[1][: host[1].rindex(f"</{last[-1]}>")] + " " + text[first.end() :]
            else:
                host[1] = host[1] + " " + text
            host[1] = host[1].replace("  ", " ")
            if not can_host(host[1]):
                hosts.pop()
        return pd.DataFrame({"document": key[0], "paragraph_id": [k[0] for k in kept], "text": [k[1] for k in kept]})

    return paragraphs.select("document", "paragraph_id", "text").join(body, "document", "left").groupBy("document").applyInPandas(run, "document bigint, paragraph_id int, text string")
