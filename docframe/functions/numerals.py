"""Roman, arabic and alphabetical numerals in text, as column expressions that stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The letters of roman numerals, and the signs of a numeral with theirs values in falling order.
ROMAN = {"M": 1000, "D": 500, "C": 100, "L": 50, "X": 10, "V": 5, "I": 1}
SIGNS = ((1000, "M"), (900, "CM"), (500, "D"), (400, "CD"), (100, "C"), (90, "XC"), (50, "L"), (40, "XL"), (10, "X"), (9, "IX"), (5, "V"), (4, "IV"), (1, "I"))


def words(text: Column) -> Column:
    """The words between white space."""
    return F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")


def clean_spaces(text: Column) -> Column:
    """One space after full stops and hyphens, none before, runs of spaces made one."""
    for old, new in ((".", ". "), (" .", "."), (" -", "-"), ("-", "- ")):
        text = F.replace(text, F.lit(old), F.lit(new))
    return squeeze_spaces(text)


def squeeze_spaces(text: Column) -> Column:
    return F.regexp_replace(text, " +", " ")


def upper_ratio(text: Column) -> Column:
    """Share of upper-case letters among the characters; null for an empty text."""
    return F.try_divide(upper_count(text), F.length(text))


def upper_count(text: Column) -> Column:
    return F.length(F.regexp_replace(text, r"[^\p{Lu}]", ""))


def roman_words(text: Column) -> Column:
    """The words made of roman letters only."""
    return F.filter(words(text), lambda w: w.rlike("^[MDCLXVI]+$"))


def roman_by_format(text: Column) -> Column:
    """Struct (pure, dot, hyphen) of the roman numerals by what follows them; a lone dot or hyphen counts."""
    w = words(clean_spaces(text))
    pure = "^[MDCLXVI]+$"
    dot = r"^([MDCLXVI]*\.|[MDCLXVI]*\.-)$"
    return F.struct(
        F.filter(w, lambda x: x.rlike(pure)).alias("pure"),
        F.filter(w, lambda x: x.rlike(dot)).alias("dot"),
        F.filter(w, lambda x: x.rlike("^[MDCLXVI]*-$") & ~x.rlike(dot)).alias("hyphen"),
    )


def numerals_any(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"(?U)\b\d+\b[\.-]"), F.lit(0))


def arabic_by_format(text: Column) -> Column:
    """Struct (hyphen, dot) of the arabic numerals followed by either."""
    return F.struct(
        F.regexp_extract_all(text, F.lit(r"(?U)\b\d+\b-"), F.lit(0)).alias("hyphen"),
        F.regexp_extract_all(text, F.lit(r"(?U)\b\d+\b\."), F.lit(0)).alias("dot"),
    )


def alpha_by_format(text: Column) -> Column:
    """Struct (hyphen, dot) of a single capital at the start followed by either; empty if there is none."""
    return F.struct(F.regexp_extract(text, "^[A-Z] *- *", 0).alias("hyphen"), F.regexp_extract(text, r"^[A-Z] *\. *", 0).alias("dot"))


def numeral_format(text: Column) -> Column:
    """Struct (format, number) of the first numeral, by fixed priority of formats; ('unknown', '-1') if none."""
    w = words(clean_spaces(text))
    found = [
        ("ara-hyphen", F.regexp_extract(text, r"(?U)\b\d+\b-", 0), "-"),
        ("ara-dot", F.regexp_extract(text, r"(?U)\b\d+\b\.", 0), "."),
        ("rom-hyphen", F.try_element_at(F.filter(w, lambda x: x.rlike("^[MDCLXVI]*-$")), F.lit(1)), "-"),
        ("rom-dot", F.try_element_at(F.filter(w, lambda x: x.rlike(r"^[MDCLXVI]*\.-?$")), F.lit(1)), "."),
        ("alpha-hyphen", F.regexp_extract(text, "^[A-Z] *- *", 0), "-"),
        ("alpha-dot", F.regexp_extract(text, r"^[A-Z] *\. *", 0), "."),
    ]
    kinds = [F.when(x != "", F.struct(F.lit(name).alias("format"), F.replace(x, F.lit(sign), F.lit("")).alias("number"))) for name, x, sign in found]
    return F.coalesce(*kinds, F.when(text.isNotNull(), F.struct(F.lit("unknown").alias("format"), F.lit("-1").alias("number"))))


def roman_to_int(text: Column) -> Column:
    """Value of a roman numeral, smaller signs before greater ones taken off; -2 if a letter is no sign, 0 if empty."""
    value = lambda c: sum((F.when(c == k, v).otherwise(0) for k, v in ROMAN.items()), F.lit(0))
    zero = F.struct(F.lit(0).alias("total"), F.lit(0).alias("last"))
    step = lambda acc, c: F.struct(
        (acc.total + value(c) - F.when(value(c) > acc.last, 2 * acc.last).otherwise(0)).alias("total"), value(c).alias("last")
    )
    letters = F.filter(F.split(text, ""), lambda c: c != "")
    return F.when(text.rlike("[^MDCLXVI]"), -2).otherwise(F.aggregate(letters, zero, step, lambda acc: acc.total))


def int_to_roman(number: Column) -> Column:
    """The roman numeral of a number; '' for 0, null below."""
    rest, out = number.cast("int"), F.lit("")
    for value, sign in SIGNS:
        out = F.concat(out, F.repeat(F.lit(sign), F.floor(rest / value).cast("int")))
        rest = rest % value
    return F.when(number >= 0, out)


def is_upper(text: Column) -> Column:
    """Whether a text has letters with case, all of them upper."""
    return (text == F.upper(text)) & (text != F.lower(text))


def next_number(text: Column) -> Column:
    """The number after a roman or arabic one (spaces, dots and hyphens ignored); -1 for other capitals, else -2."""
    plain = F.regexp_replace(text, "[ .-]", "")
    return F.when(is_upper(plain), roman_to_int(plain) + 1).when(plain.rlike("^[0-9]+$"), F.try_add(plain.try_cast("int"), F.lit(1))).when(text.isNotNull(), F.lit(-2))
