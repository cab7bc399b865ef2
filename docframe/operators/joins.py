"""Lookups and joins of documents, paragraphs and excerpts."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docframe.operators import containment
from docframe.plans.lineage import materialise

#: Characters of the texts and of the paragraphs in one block of ``unique_containing``.
TEXTS, BODIES = 16_000_000, 2_000_000


def base_name(name: Column) -> Column:
    """The last part of a path, without its extension."""
    return F.regexp_replace(F.substring_index(name, "/", -1), r"\.[A-Za-z]{1,5}$", "")


def parse_name(name: Column) -> Column:
    """Struct (type, year) of a document's name: T-123-05, C-001-91, SU123-99, A012-2010; nulls if unrecognised."""
    upper = F.upper(F.regexp_replace(F.trim(name), r"\.[A-Za-z]{1,5}$", ""))
    parts = F.split(upper, "-")
    kind = F.when(upper.startswith("T"), "T").when(upper.startswith("C"), "C").when(upper.startswith("SU"), "SU").when(upper.startswith("A"), "A")
    digits = F.when(kind.isin("T", "C"), F.try_element_at(parts, F.lit(3))).when(kind.isin("SU", "A"), F.try_element_at(parts, F.lit(2)))
    number = F.when(digits.rlike("^[0-9]{1,4}$"), digits).try_cast("int")
    year = F.when(number >= 100, number).when(number > 90, 1900 + number).when(number.isNotNull(), 2000 + number)
    known = upper.rlike(r"^(T|C)-[^-]+-[0-9]{1,4}$|^(SU|A)[^-]*-[0-9]{1,4}$")
    return F.struct(F.when(known, kind).alias("type"), F.when(known, year).alias("year"))


def ids_by_name(names: DataFrame, docs: DataFrame) -> DataFrame:
    """(name, id): the first document with the same name, extension and folder aside."""
    first = docs.where("name is not null").groupBy(base_name(F.col("name")).alias("key")).agg(F.min("id").alias("id"))
    return names.withColumn("key", base_name(F.col("name"))).join(first, "key", "left").select("name", "id")


def by_prefix(cases: DataFrame, names: DataFrame) -> DataFrame:
    """(name, id): the first case whose name begins with each name, taken literally, however short.

    Each case name is entered under all its beginnings, the first id of each kept before the shuffle; an empty name
    begins every case name.  Names that begin none, and nulls, have no rows.
    """
    every = F.explode(F.transform(F.sequence(F.lit(0), F.length("name")), lambda k: F.left(F.col("name"), k)))
    first = cases.where("name is not null").select("id", every.alias("name")).groupBy("name").agg(F.min("id").alias("id"))
    return names.where("name is not null").select("name").distinct().join(first, "name").select("name", "id")


def upsert_documents(known: DataFrame, names: DataFrame) -> DataFrame:
    """(id, name): known documents and new names, numbered on from the greatest known id in order of name."""
    new = names.select("name").distinct().join(known, "name", "left_anti")
    from docframe.operators.sampling import hash_rank

    top = known.agg(F.coalesce(F.max("id"), F.lit(-1)).alias("top"))
    added = hash_rank(new, "name").crossJoin(F.broadcast(top)).select((F.col("top") + F.col("rank")).alias("id"), "name")
    return known.select("id", "name").unionByName(added)


def combine_collections(first: DataFrame, second: DataFrame, key: str = "id", refer: str | None = None) -> DataFrame:
    """Rows of both, ids of the second moved up behind the first's; ``refer`` names a column moved with them."""
    shift = first.agg((F.coalesce(F.max(refer or key), F.lit(-1)) + 1).alias("_shift"))
    moved = second.crossJoin(F.broadcast(shift)).withColumn(refer or key, F.col(refer or key) + F.col("_shift")).drop("_shift")
    return first.unionByName(moved)


def unique_exact(texts: DataFrame, styles: DataFrame) -> DataFrame:
    """(text_id, id, text_type): texts that equal exactly one excerpt."""
    once = styles.where("text is not null").groupBy("text").agg(F.count("*").alias("n"), F.min("id").alias("id"), F.min("text_type").alias("text_type")).where("n = 1")
    return texts.where("text is not null").join(once.drop("n"), "text").select("text_id", "id", "text_type")


def unique_containing(texts: DataFrame, paragraphs: DataFrame, none: str = "unmatched") -> DataFrame:
    """(document, text_id, section): the section of the only paragraph of the document that contains the text.

    Texts and paragraphs meet in blocks of whole documents, a long document's in blocks of parts of either; in a block
    substrings are looked up by hash (``containment.count``), so no text is compared with every paragraph.
    """
    texts = texts.select("document", "text_id", "text")
    t = texts.where((F.length("text") > 0) & F.col("document").isNotNull())
    p = paragraphs.select(*(F.col(c).alias(to) for c, to in (("document", "document"), ("text", "body"), ("section", "section")))).where((F.length("body") > 0) & F.col("document").isNotNull())
    sizes = t.select("document", F.length("text").alias("x"), F.lit(0).alias("y")).unionByName(p.select("document", F.lit(0).alias("x"), F.length("body").alias("y")))
    sizes = materialise(sizes.groupBy("document").agg(F.sum("x").alias("of_texts"), F.sum("y").alias("of_bodies")).where("of_texts > 0 and of_bodies > 0"), "containing_sizes")
    blocks = F.lit(int((sizes.agg(F.sum("of_bodies")).first()[0] or 0) // BODIES + 1))
    long = sizes.where((F.col("of_texts") > TEXTS) | (F.col("of_bodies") > BODIES))
    long = long.select("document", F.floor(F.col("of_texts") / TEXTS + 1).cast("int").alias("of_texts"), F.floor(F.col("of_bodies") / BODIES + 1).cast("int").alias("of_bodies"))

    def placed(df: DataFrame, text: str, own: str, other: str) -> DataFrame:
        """Rows of either side with their block, once for each part of the other side."""
        parted = df.join(F.broadcast(long), "document", "left").withColumn("part", F.pmod(F.xxhash64(*df.columns), F.col(own)).cast("int"))
        parted = parted.withColumn("beside", F.explode(F.when(F.col(other).isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col(other) - 1))))
        place = F.when(F.col("part").isNull(), F.struct(F.lit(None).cast(df.schema["document"].dataType).alias("of"), F.pmod(F.xxhash64("document"), blocks).cast("int").alias("t"), F.lit(0).alias("b")))
        pair = ("part", "beside") if own == "of_texts" else ("beside", "part")
        return parted.select(*df.columns, place.otherwise(F.struct(F.col("document").alias("of"), F.col(pair[0]).alias("t"), F.col(pair[1]).alias("b"))).alias("block"))

    kinds = {f.name: f.dataType.simpleString() for f in [*t.schema.fields, *p.schema.fields]}
    left, right = placed(t, "text", "of_texts", "of_bodies"), placed(p, "body", "of_bodies", "of_texts")
    hits = left.groupBy("block").cogroup(right.groupBy("block")).applyInArrow(containment.count, f"document {kinds['document']}, text_id {kinds['text_id']}, n int, section {kinds['section']}")
    one = hits.groupBy("document", "text_id").agg(F.sum("n").alias("n"), F.min("section").alias("section")).where("n = 1").drop("n")
    return texts.select("document", "text_id").join(one, ["document", "text_id"], "left").withColumn("section", F.coalesce("section", F.lit(none)))


def align(excerpts: DataFrame, tagged: DataFrame) -> DataFrame:
    """(document, id, start): where ordered excerpts stand in their document's text, by a cursor that only moves on.

    An excerpt not found whole is looked for by a prefix of ten words, shrunk while it is not found and grown while it
    is found more than once; a cursor is state along a document, so this runs document by document in Python.
    """

    def run(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        text, cursor, out = (right["text"].iloc[0] if len(right) else "") or "", 0, []
        for i, t in left.sort_values(["paragraph_id", "paragraph_pos", "id"])[["id", "text"]].itertuples(index=False):
            at = text.find(t, cursor) if t else -1
            if at < 0 and t:
                words, tried = t.split(), set()
                k = min(10, len(words))
                while 0 < k <= len(words) and k not in tried:
                    tried.add(k)
                    part = " ".join(words[:k])
                    n = text.count(part, cursor)
                    if n == 1:
                        at = text.find(part, cursor)
                        break
                    k += 1 if n > 1 else -1
            out.append(at)
            if at >= 0:
                cursor = at + 1
        ids = left.sort_values(["paragraph_id", "paragraph_pos", "id"])["id"]
        return pd.DataFrame({"document": key[0], "id": ids.to_numpy(), "start": pd.array(out, dtype="Int64")}) if len(left) else pd.DataFrame({"document": [], "id": [], "start": []})

    return excerpts.groupBy("document").cogroup(tagged.groupBy("document")).applyInPandas(run, "document bigint, id bigint, start bigint")
