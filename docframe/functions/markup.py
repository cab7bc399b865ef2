"""Tagged text, read by pattern and never by an XML parser, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NO_TAG = "d'oh"
_OPEN, _CLOSE = r"<([^( /><.)]+)>", r"</([^( ><.)]+)>"


def paragraphs(text: Column, tag: str = "paragraph", drop_last: bool = False) -> Column:
    """What stands between each opening tag and the next closing one, without its last character if asked."""
    found = F.regexp_extract_all(text, F.lit(f"(?s)<{tag}>(.*?)</{tag}>"), F.lit(1))
    return F.transform(found, lambda p: F.left(p, F.greatest(F.length(p) - 1, F.lit(0)))) if drop_last else found


def first_open_tag(text: Column) -> Column:
    found = F.regexp_extract(text, r"(?U)<(\w+)>", 1)
    return F.when(found == "", NO_TAG).otherwise(found)


def first_open_tag_any(text: Column) -> Column:
    """The first opening tag with its attributes."""
    found = F.regexp_extract(text, r"<([^/][^>]*)>", 1)
    return F.when(found == "", NO_TAG).otherwise(found)


def last_close_tag(text: Column) -> Column:
    return F.try_element_at(F.regexp_extract_all(text, F.lit(r"(?U)</(\w+)>"), F.lit(1)), F.lit(-1))


def open_tag_set(text: Column) -> Column:
    return F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit(_OPEN), F.lit(1))))


def tag_set(text: Column) -> Column:
    return F.array_sort(F.array_distinct(F.concat(*(F.regexp_extract_all(text, F.lit(p), F.lit(1)) for p in (_OPEN, _CLOSE)))))


def strip_tags(text: Column, tags: Column) -> Column:
    """Without the opening and closing forms of the tags; a font tag is closed by </font>."""
    def without(t: Column, tag: Column) -> Column:
        close = F.when(tag.startswith("font"), "</font>").otherwise(F.concat(F.lit("</"), tag, F.lit(">")))
        return F.replace(F.replace(t, F.concat(F.lit("<"), tag, F.lit(">")), F.lit("")), close, F.lit(""))

    return F.aggregate(tags, text, without)


def raw_text(text: Column) -> Column:
    return strip_tags(text, tag_set(text))


def strip_paragraphs(list_: Column) -> Column:
    """Each paragraph without its tags and outer white space."""
    return F.transform(list_, lambda p: F.regexp_replace(strip_tags(p, open_tag_set(p)), r"(?U)^\s+|\s+$", ""))


def between_tags(text: Column, tag: str, after_open: bool = True) -> Column:
    """Struct (text, tagged, start, end) from the first opening tag to the first closing one (after it, or anywhere).

    Offsets count from 0 and include the tags; null if either tag is missing.
    """
    opening, closing = f"<{tag}>", "</font>" if tag.startswith("font") else f"</{tag}>"
    start = F.locate(opening, text)
    end = F.when(start > 0, F.locate(closing, text, 1)) if not after_open else F.call_function("locate", F.lit(closing), text, F.greatest(start, F.lit(1)))
    inner = F.substring(text, start + len(opening), F.greatest(end - start - len(opening), F.lit(0)))
    whole = F.substring(text, start, F.greatest(end + len(closing) - start, F.lit(0)))
    return F.when((start > 0) & (end > 0), F.struct(inner.alias("text"), whole.alias("tagged"), (start - 1).alias("start"), (end - 1 + len(closing)).alias("end")))


def tag_instance(text: Column, tag: str) -> Column:
    """From the first '<tag' to its closing tag, the opening cut to '<tag'; null if there is none."""
    opening, closing = f"<{tag}", f"</{tag}>"
    start = F.locate(opening, text)
    close = F.call_function("locate", F.lit(closing), text, F.greatest(start, F.lit(1)))
    return F.when((start > 0) & (close > 0), F.substring(text, start, close + len(closing) - start))


def trailing_number(text: Column) -> Column:
    return F.regexp_extract(text, r"(\d+)$", 1).try_cast("int")


def clean_xml(text: Column) -> Column:
    """Without empty paragraphs and, in one pass, empty pairs of tags."""
    return F.regexp_replace(F.replace(text, F.lit("<paragraph>\n\n</paragraph>"), F.lit("")), r"(?U)<\w+>[ ]*</\w+>", "")


def wrap(text: Column) -> Column:
    return F.concat(F.lit("<paragraph>"), text, F.lit("\n</paragraph>\n"))


def runs(text: Column) -> Column:
    """The tagged runs of a paragraph, in order: array of (tag, text)."""
    pattern = r"(?Us)<(\w+)>(.*?)</\1>"
    tags, texts = (F.regexp_extract_all(text, F.lit(pattern), F.lit(k)) for k in (1, 2))
    return F.arrays_zip(tags.alias("tag"), texts.alias("text"))
