"""All queries of the core, each with SQL that computes the same from the same tables, where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docframe.functions import labels, markup, numerals, text as texts
from docframe.operators import evaluate, joins, prompts, sampling, sections, segment, stats
from docframe.plans.lineage import fresh_path, materialise
from docframe.sources import files
from docframe.streaming import ingest

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a function of the tables' reader under a name."""

    def register(f: Callable[[Tables], DataFrame]) -> Callable:
        _QUERIES[name] = lambda spark, folder: f(Tables(spark, folder))
        if sql:
            _SQL[name] = sql
        return f

    return register


class Tables:
    """The tables of a folder; ``P``, ``S`` and ``D`` hold the rows of paragraphs, excerpts and documents last ingested."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getitem__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @property
    def P(self) -> DataFrame:
        return segment.latest(self["paragraphs_df"], ["document", "paragraph_id"])

    @property
    def S(self) -> DataFrame:
        return segment.latest(self["styles_df"], ["document", "paragraph_id", "paragraph_pos"])

    @property
    def D(self) -> DataFrame:
        return segment.latest(self["docs"], ["id"], tie="name")

    @property
    def R(self) -> DataFrame:
        return self["instruction_records"]


# --- SQL that the texts below share -------------------------------------------------------------------------------
_WS = r"[\s\x{0B}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def _last(table: str, keys: str, tie: str = "id") -> str:
    return f"(SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY ingested_at DESC NULLS LAST, {tie} DESC NULLS LAST) AS rn FROM {table}) WHERE rn = 1)"


_P = _last("paragraphs_df", "document, paragraph_id")
_S = _last("styles_df", "document, paragraph_id, paragraph_pos")
_D = _last("docs", "id", "name")


def _words_sql(x: str) -> str:
    return f"list_filter(regexp_split_to_array({x}, '{_WS}+'), lambda w: w <> '')"


def _strip_sql(x: str) -> str:
    return f"regexp_replace({x}, '^{_WS}+|{_WS}+$', '', 'g')"


def _clean_sql(x: str) -> str:
    return f"regexp_replace(replace(replace(replace(replace({x}, '.', '. '), ' .', '.'), ' -', '-'), '-', '- '), ' +', ' ', 'g')"


def _q(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _joined(xs) -> F.Column:
    return F.array_join(xs, "|")


# --- filters and projections --------------------------------------------------------------------------------------
@query("flt_eq", f"SELECT id, document FROM {_P} WHERE section = 'Decision' AND function IS NOT NULL")
def _(t):
    return t.P.where("section = 'Decision' and function is not null").select("id", "document")


@query("flt_neg_isin", f"SELECT id, text_type FROM {_S} WHERE text_type NOT IN ('quote', 'footnote')")
def _(t):
    return t.S.where(~F.col("text_type").isin("quote", "footnote")).select("id", "text_type")


@query("flt_regex", f"SELECT id FROM {_P} WHERE regexp_matches(text, '(?i)sentencia c-[0-9]+ de (19|20)[0-9]+')")
def _(t):
    return t.P.where(F.coalesce(F.col("text").rlike("(?iu)sentencia c-[0-9]+ de (19|20)[0-9]+"), F.lit(False))).select("id")


@query("flt_isupper", f"SELECT id FROM {_P} WHERE text = upper(text) AND text <> lower(text)")
def _(t):
    return t.P.where(numerals.is_upper(F.col("text"))).select("id")


@query("flt_min_len", "SELECT record_id, length(input) AS chars FROM instruction_records WHERE length(input) > 12")
def _(t):
    return t.R.where(F.length("input") > prompts.LEAST_LENGTH).select("record_id", F.length("input").cast("long").alias("chars"))


@query("row_range", "SELECT record_id, rank FROM (SELECT record_id, row_number() OVER (ORDER BY md5(record_id::VARCHAR), record_id) AS rank FROM instruction_records) WHERE rank BETWEEN 100 AND 199")
def _(t):
    return sampling.hash_rank(t.R, "record_id").where("rank between 100 and 199").select("record_id", "rank")


@query("rename_drop_select", "SELECT record_id, input AS text, output AS label FROM instruction_records")
def _(t):
    return t.R.withColumnsRenamed({"input": "text", "output": "label"}).drop("instruction", "split", "source", "created_at", "document")


@query("const_project", "SELECT record_id, 'Clasifique el texto.' AS instruction FROM instruction_records")
def _(t):
    return prompts.replace_prompt(t.R, "Clasifique el texto.").select("record_id", "instruction")


@query("dropna", "SELECT record_id FROM instruction_records WHERE input IS NOT NULL AND output IS NOT NULL AND split IS NOT NULL")
def _(t):
    return t.R.na.drop(subset=["input", "output", "split"]).select("record_id")


@query("coalesce_section", f"SELECT p.id, coalesce(nullif(p.section, 'Pending'), 'header') AS section FROM {_P} p")
def _(t):
    return t.P.select("id", F.coalesce(F.nullif("section", F.lit("Pending")), F.lit("header")).alias("section"))


@query("get_section_names", f"SELECT document, paragraph_id, text FROM {_P} WHERE regexp_matches(text, '^([IVXLC]+|[0-9]+)[.-]') AND length(text) < 75")
def _(t):
    return t.P.where(F.col("text").rlike("^([IVXLC]+|[0-9]+)[.-]") & (F.length("text") < 75)).select("document", "paragraph_id", "text")


@query("case_update", f"SELECT id, CASE WHEN text_type = 'title_emphasis' AND paragraph_pos > 0 THEN 'emphasis' ELSE text_type END AS text_type FROM {_S}")
def _(t):
    return t.S.select("id", F.when((F.col("text_type") == "title_emphasis") & (F.col("paragraph_pos") > 0), "emphasis").otherwise(F.col("text_type")).alias("text_type"))


# --- numerals -----------------------------------------------------------------------------------------------------
@query("upper_ratio", f"SELECT id, length(regexp_replace(text, '[^\\p{{Lu}}]', '', 'g'))::INTEGER AS upper_count, CASE WHEN length(text) > 0 THEN round(length(regexp_replace(text, '[^\\p{{Lu}}]', '', 'g')) / length(text), 9) END AS ratio FROM {_P}")
def _(t):
    return t.P.select("id", numerals.upper_count(F.col("text")).alias("upper_count"), F.round(numerals.upper_ratio(F.col("text")), 9).alias("ratio"))


@query("roman_words", f"SELECT id, array_to_string(list_filter({_words_sql('text')}, lambda w: regexp_full_match(w, '[MDCLXVI]+')), '|') AS numerals FROM {_P}")
def _(t):
    return t.P.select("id", _joined(numerals.roman_words(F.col("text"))).alias("numerals"))


_CLEAN_WORDS = _words_sql(_clean_sql("text"))
_DOT = r"([MDCLXVI]*\.|[MDCLXVI]*\.-)"


@query("roman_by_format", f"""SELECT id, array_to_string(list_filter(w, lambda x: regexp_full_match(x, '[MDCLXVI]+')), '|') AS pure,
    array_to_string(list_filter(w, lambda x: regexp_full_match(x, '{_DOT}')), '|') AS dot,
    array_to_string(list_filter(w, lambda x: regexp_full_match(x, '[MDCLXVI]*-')), '|') AS hyphen FROM (SELECT id, {_CLEAN_WORDS} AS w FROM {_P})""")
def _(t):
    r = numerals.roman_by_format(F.col("text"))
    return t.P.select("id", *(_joined(r[k]).alias(k) for k in ("pure", "dot", "hyphen")))


@query("numerals_any", f"SELECT id, array_to_string(regexp_extract_all(text, '\\b\\d+\\b[\\.-]'), '|') AS numerals FROM {_P}")
def _(t):
    return t.P.select("id", _joined(numerals.numerals_any(F.col("text"))).alias("numerals"))


@query("arabic_by_format", f"SELECT id, array_to_string(regexp_extract_all(text, '\\b\\d+\\b-'), '|') AS hyphen, array_to_string(regexp_extract_all(text, '\\b\\d+\\b\\.'), '|') AS dot FROM {_P}")
def _(t):
    a = numerals.arabic_by_format(F.col("text"))
    return t.P.select("id", _joined(a["hyphen"]).alias("hyphen"), _joined(a["dot"]).alias("dot"))


@query("alpha_by_format", f"SELECT id, regexp_extract(text, '^[A-Z] *- *') AS hyphen, regexp_extract(text, '^[A-Z] *\\. *') AS dot FROM {_P}")
def _(t):
    a = numerals.alpha_by_format(F.col("text"))
    return t.P.select("id", a["hyphen"].alias("hyphen"), a["dot"].alias("dot"))


def _format_sql(x: str) -> str:
    w = _words_sql(_clean_sql(x))
    hyphens, dots = f"list_filter({w}, lambda v: regexp_full_match(v, '[MDCLXVI]*-'))", f"list_filter({w}, lambda v: regexp_full_match(v, '{_DOT}'))"
    return f"""CASE WHEN len(regexp_extract_all({x}, '\\b\\d+\\b-')) > 0 THEN ['ara-hyphen', replace(regexp_extract({x}, '\\b\\d+\\b-'), '-', '')]
        WHEN len(regexp_extract_all({x}, '\\b\\d+\\b\\.')) > 0 THEN ['ara-dot', replace(regexp_extract({x}, '\\b\\d+\\b\\.'), '.', '')]
        WHEN len({hyphens}) > 0 THEN ['rom-hyphen', replace({hyphens}[1], '-', '')]
        WHEN len({dots}) > 0 THEN ['rom-dot', replace({dots}[1], '.', '')]
        WHEN regexp_matches({x}, '^[A-Z] *-') THEN ['alpha-hyphen', replace(regexp_extract({x}, '^[A-Z] *- *'), '-', '')]
        WHEN regexp_matches({x}, '^[A-Z] *\\.') THEN ['alpha-dot', replace(regexp_extract({x}, '^[A-Z] *\\. *'), '.', '')]
        WHEN {x} IS NOT NULL THEN ['unknown', '-1'] END"""


@query("numeral_format", f"SELECT id, f[1] AS format, f[2] AS number FROM (SELECT id, {_format_sql('h')} AS f FROM (SELECT id, left({_strip_sql('text')}, 15) AS h FROM {_P}))")
def _(t):
    f = numerals.numeral_format(F.left(texts.strip(F.col("text")), F.lit(15)))
    return t.P.select("id", f["format"].alias("format"), f["number"].alias("number"))


_ROMAN_SQL = """(SELECT sum(CASE WHEN v < coalesce(nx, 0) THEN -v ELSE v END)::INTEGER FROM (
    SELECT v, lead(v) OVER (ORDER BY k) AS nx FROM (SELECT unnest(range(1, length(r) + 1)) AS k, CASE substr(r, k, 1) WHEN 'M' THEN 1000 WHEN 'D' THEN 500 WHEN 'C' THEN 100 WHEN 'L' THEN 50 WHEN 'X' THEN 10 WHEN 'V' THEN 5 ELSE 1 END AS v)))"""
_TENS = "['', 'X', 'XX', 'XXX', 'XL', 'L', 'LX', 'LXX', 'LXXX', 'XC']"
_TO_ROMAN = f"repeat('M', n // 1000) || {_TENS.replace('L', '%').replace('C', 'M').replace('X', 'C').replace('%', 'D')}[n // 100 % 10 + 1] || {_TENS}[n // 10 % 10 + 1] || {_TENS.replace('X', 'I').replace('L', 'V').replace('C', 'X')}[n % 10 + 1]"


@query("int_to_roman", f"SELECT DISTINCT n, {_TO_ROMAN} AS roman FROM (SELECT (l_partkey % 4000)::INTEGER AS n FROM lineitem)")
def _(t):
    n = t["lineitem"].select((F.col("l_partkey") % 4000).cast("int").alias("n")).distinct()
    return n.select("n", numerals.int_to_roman(F.col("n")).alias("roman"))


@query("roman_to_int", "SELECT DISTINCT (l_partkey % 4000)::INTEGER AS n, (l_partkey % 4000)::INTEGER AS value, -2 AS bad FROM lineitem")
def _(t):
    n = t["lineitem"].select((F.col("l_partkey") % 4000).cast("int").alias("n")).distinct()
    roman = numerals.int_to_roman(F.col("n"))
    return n.select("n", numerals.roman_to_int(roman).alias("value"), numerals.roman_to_int(F.concat(roman, F.lit("z"))).alias("bad"))


@query("next_number", f"""SELECT id, CASE WHEN h IS NULL THEN NULL WHEN h = upper(h) AND h <> lower(h) THEN CASE WHEN regexp_matches(h, '[^MDCLXVI]') THEN -1 ELSE x + 1 END
    WHEN regexp_full_match(h, '[0-9]+') THEN try_cast(h AS INTEGER) + 1 ELSE -2 END AS next FROM (
    SELECT *, (SELECT sum(CASE WHEN v < coalesce(nx, 0) THEN -v ELSE v END)::INTEGER FROM (SELECT c.v, lead(c.v) OVER (ORDER BY c.k) AS nx FROM (SELECT k, CASE substr(h, k, 1) WHEN 'M' THEN 1000 WHEN 'D' THEN 500 WHEN 'C' THEN 100 WHEN 'L' THEN 50 WHEN 'X' THEN 10 WHEN 'V' THEN 5 WHEN 'I' THEN 1 END AS v FROM range(1, 11) r(k) WHERE k <= length(h)) c)) AS x
    FROM (SELECT id, regexp_replace(({_words_sql('left(text, 10)')})[1], '[ .-]', '', 'g') AS h FROM {_P}))""")
def _(t):
    token = F.try_element_at(numerals.words(F.left("text", F.lit(10))), F.lit(1))
    return t.P.select("id", numerals.next_number(token).alias("next"))


# --- labels -------------------------------------------------------------------------------------------------------
def _category_sql(x: str) -> str:
    cases = " ".join(f"WHEN regexp_matches(lower({x}), {_q('|'.join(a))}) THEN {_q(s)}" for s, a in labels.SECTIONS.items())
    return f"CASE {cases} WHEN {x} IS NOT NULL THEN 'Pending' END"


@query("section_name", f"SELECT id, {_category_sql('left(text, 50)')} AS section FROM {_P}")
def _(t):
    return t.P.select("id", labels.section_name(F.left("text", F.lit(50))).alias("section"))


@query("categorise", f"SELECT record_id, CASE WHEN regexp_matches(input, 'tutela|amparo') THEN 'rights' WHEN regexp_matches(input, 'sanci.n|multa') THEN 'penalty' WHEN input IS NOT NULL THEN 'Pending' END AS category FROM instruction_records")
def _(t):
    return t.R.select("record_id", labels.categorise(F.col("input"), {"rights": ["tutela", "amparo"], "penalty": ["sanci.n", "multa"]}, case=True).alias("category"))


@query("section_dictionary", " UNION ALL ".join(f"SELECT {k} AS section_ord, {_q(s)} AS section, {j} AS alias_ord, {_q(a)} AS alias" for k, (s, xs) in enumerate(labels.SECTIONS.items()) for j, a in enumerate(xs)))
def _(t):
    return t.spark.createDataFrame([(k, s, j, a) for k, (s, xs) in enumerate(labels.SECTIONS.items()) for j, a in enumerate(xs)], "section_ord int, section string, alias_ord int, alias string")


_ALIASES = "(VALUES " + ", ".join(f"({k}, {_q(s)}, {_q(a)})" for k, (s, a) in enumerate((s, a) for s, xs in labels.SECTIONS.items() for a in xs)) + ") a(ord, section, alias)"


@query("closest_alias", f"""SELECT id, arg_min(section, d * 1000 + ord) AS section, arg_min(alias, d * 1000 + ord) AS alias, min(d)::INTEGER AS distance FROM (
    SELECT p.id, a.*, levenshtein(regexp_replace(strip_accents(lower(p.text)), '[^\\x00-\\x7F]', '?', 'g'), a.alias) AS d FROM {_P} p, {_ALIASES} WHERE p.text IS NOT NULL) GROUP BY id""")
def _(t):
    return _closest(t.P.where("text is not null"))


def _closest(paragraphs: DataFrame) -> DataFrame:
    c = labels.closest_alias(F.regexp_replace(texts.unaccent(F.lower("text")), r"[^\x00-\x7F]", "?"), labels.SECTIONS)
    return paragraphs.select("id", c["section"].alias("section"), c["alias"].alias("alias"), c["distance"].alias("distance"))


_LABEL_VALUES = "[" + ", ".join(_q(x) for x in labels.LABELS) + "]"


def _first_label_sql(x: str) -> str:
    return f"""CASE WHEN {x} IS NOT NULL THEN coalesce((SELECT arg_min(l, instr(lower({x}), l) * 100 + o) FROM (SELECT unnest({_LABEL_VALUES}) AS l, unnest(range({len(labels.LABELS)})) AS o) WHERE instr(lower({x}), l) > 0), 'none') END"""


@query("first_label_in_text", f"SELECT record_id, {_first_label_sql('input')} AS label FROM instruction_records")
def _(t):
    return t.R.select("record_id", labels.first_label(F.col("input")).alias("label"))


@query("extract_class", "SELECT record_id, CASE " + " ".join(f"WHEN contains(output, {_q(c)}) THEN {_q(c)}" for c in labels.LABELS) + " WHEN output IS NOT NULL THEN 'no class' END AS class FROM instruction_records")
def _(t):
    return t.R.select("record_id", labels.contained_class(F.col("output")).alias("class"))


@query("truncate_words", f"SELECT record_id, CASE WHEN len(w) > 50 THEN array_to_string(w[1:50], ' ') ELSE input END AS text FROM (SELECT record_id, input, {_words_sql('input')} AS w FROM instruction_records)")
def _(t):
    return t.R.select("record_id", labels.truncate_words(F.col("input"), 50).alias("text"))


@query("word_count", f"SELECT record_id, len({_words_sql('input')})::INTEGER AS words FROM instruction_records WHERE input IS NOT NULL")
def _(t):
    return t.R.where("input is not null").select("record_id", labels.word_count(F.col("input")).alias("words"))


@query("response_tail", f"SELECT record_id, CASE WHEN contains(input, ', ') THEN {_strip_sql('list_last(string_split(input, chr(44) || chr(32)))')} ELSE input END AS response FROM instruction_records")
def _(t):
    return t.R.select("record_id", labels.response_tail(F.col("input"), ", ").alias("response"))


@query("string_primitives", f"SELECT id, substr(text, 3, 20) AS part, trim(text, ' ') AS stripped, replace(text, 'el ', 'EL ') AS replaced, instr(text, 'de')::INTEGER AS place, starts_with(text, 'El') AS starts, (CASE WHEN contains(text, 'de') THEN length(text) - instr(reverse(text), 'ed') ELSE 0 END)::INTEGER AS last FROM {_P}")
def _(t):
    c = F.col("text")
    last = F.when(c.contains("de"), F.length(c) - F.instr(F.reverse(c), "ed")).otherwise(0)
    return t.P.select("id", F.substring(c, 3, 20).alias("part"), F.trim(c).alias("stripped"), F.replace(c, F.lit("el "), F.lit("EL ")).alias("replaced"), F.instr(c, "de").alias("place"), c.startswith("El").alias("starts"), F.when(c.isNull(), 0).otherwise(last).alias("last"))


# --- markup -------------------------------------------------------------------------------------------------------
_OPEN_RE, _CLOSE_RE = r"<([^( /><.)]+)>", r"</([^( ><.)]+)>"


@query("paragraphs_v1", "SELECT record_id, (unnest(range(len(ps))))::INTEGER AS paragraph_id, left(unnest(ps), -1) AS text FROM (SELECT record_id, regexp_extract_all(input, '(?s)<paragraph>(.*?)</paragraph>', 1) AS ps FROM instruction_records)")
def _(t):
    return t.R.select("record_id", F.posexplode(markup.paragraphs(F.col("input"), drop_last=True)).alias("paragraph_id", "text"))


@query("paragraphs_v2", "SELECT record_id, (unnest(range(len(ps))))::INTEGER AS paragraph_id, unnest(ps) AS text FROM (SELECT record_id, regexp_extract_all(input, '(?s)<paragraph>(.*?)</paragraph>', 1) AS ps FROM instruction_records)")
def _(t):
    return t.R.select("record_id", F.posexplode(markup.paragraphs(F.col("input"))).alias("paragraph_id", "text"))


@query("first_open_tag", "SELECT record_id, coalesce(nullif(regexp_extract(input, '<([\\p{L}\\p{N}_]+)>', 1), ''), 'd''oh') AS tag FROM instruction_records WHERE input IS NOT NULL")
def _(t):
    return t.R.where("input is not null").select("record_id", markup.first_open_tag(F.col("input")).alias("tag"))


@query("first_open_tag_any", "SELECT record_id, coalesce(nullif(regexp_extract(input, '<([^/][^>]*)>', 1), ''), 'd''oh') AS tag FROM instruction_records WHERE input IS NOT NULL")
def _(t):
    return t.R.where("input is not null").select("record_id", markup.first_open_tag_any(F.col("input")).alias("tag"))


@query("last_close_tag", "SELECT record_id, list_last(regexp_extract_all(input, '</([\\p{L}\\p{N}_]+)>', 1)) AS tag FROM instruction_records WHERE input IS NOT NULL")
def _(t):
    return t.R.where("input is not null").select("record_id", markup.last_close_tag(F.col("input")).alias("tag"))


@query("tag_set", f"SELECT record_id, array_to_string(list_sort(list_distinct(list_concat(regexp_extract_all(input, '{_OPEN_RE}', 1), regexp_extract_all(input, '{_CLOSE_RE}', 1)))), '|') AS tags FROM instruction_records WHERE input IS NOT NULL")
def _(t):
    return t.R.where("input is not null").select("record_id", _joined(markup.tag_set(F.col("input"))).alias("tags"))


@query("open_tag_set", f"SELECT record_id, array_to_string(list_sort(list_distinct(regexp_extract_all(input, '{_OPEN_RE}', 1))), '|') AS tags FROM instruction_records WHERE input IS NOT NULL")
def _(t):
    return t.R.where("input is not null").select("record_id", _joined(markup.open_tag_set(F.col("input"))).alias("tags"))


@query("strip_tags", "SELECT record_id, replace(replace(input, '<paragraph>', ''), '</paragraph>', '') AS text FROM instruction_records")
def _(t):
    return t.R.select("record_id", markup.strip_tags(F.col("input"), F.array(F.lit("paragraph"))).alias("text"))


@query("raw_text", "SELECT record_id, regexp_replace(input, '</?[^( /><.)]+>', '', 'g') AS text FROM instruction_records")
def _(t):
    return t.R.select("record_id", markup.raw_text(F.col("input")).alias("text"))


@query("strip_paragraph_list", f"SELECT record_id, array_to_string(list_transform(regexp_extract_all(input, '(?s)<paragraph>(.*?)</paragraph>', 1), lambda p: {_strip_sql('regexp_replace(p, chr(60) || chr(47) || chr(63) || chr(91) || chr(94) || chr(62) || chr(93) || chr(43) || chr(62), chr(0)[1:0], chr(103))')}), '|') AS text FROM instruction_records WHERE input IS NOT NULL".replace("chr(60) || chr(47) || chr(63) || chr(91) || chr(94) || chr(62) || chr(93) || chr(43) || chr(62), chr(0)[1:0], chr(103)", "'</?[^( /><.)]+>', '', 'g'"))
def _(t):
    return t.R.where("input is not null").select("record_id", _joined(markup.strip_paragraphs(markup.paragraphs(F.col("input")))).alias("text"))


@query("strip_json", "SELECT record_id, regexp_replace(input, '</?[^( /><.)]+>', '', 'g') AS input FROM instruction_records WHERE input IS NOT NULL")
def _(t):
    return t.R.where("input is not null").withColumn("input", markup.strip_tags(F.col("input"), markup.open_tag_set(F.col("input")))).select("record_id", "input")


_BETWEEN = "SELECT record_id, substr(input, s + 11, e - s - 11) AS text, substr(input, s, e + 12 - s) AS tagged, (s - 1)::INTEGER AS start, (e + 11)::INTEGER AS stop FROM (SELECT record_id, input, instr(input, '<paragraph>') AS s, instr(input, '</paragraph>') AS e FROM instruction_records) WHERE s > 0 AND e > 0"


def _between(t, after: bool) -> DataFrame:
    b = markup.between_tags(F.col("input"), "paragraph", after)
    return t.R.select("record_id", b.alias("b")).where("b is not null").select("record_id", "b.text", "b.tagged", F.col("b.start").alias("start"), F.col("b.end").alias("stop"))


@query("between_tags", _BETWEEN.replace(", substr(input, s, e + 12 - s) AS tagged, (s - 1)::INTEGER AS start, (e + 11)::INTEGER AS stop", ""))
def _(t):
    return _between(t, False).select("record_id", "text")


@query("between_tags2", _BETWEEN)
def _(t):
    return _between(t, False)


@query("between_tags3", _BETWEEN)
def _(t):
    return _between(t, True)


@query("tag_instances", "SELECT record_id, substr(input, s, e + 12 - s) AS instance FROM (SELECT record_id, input, instr(input, '<paragraph') AS s, instr(input, '</paragraph>') AS e FROM instruction_records) WHERE s > 0 AND e > 0")
def _(t):
    return t.R.select("record_id", markup.tag_instance(F.col("input"), "paragraph").alias("instance")).where("instance is not null")


@query("trailing_number", "SELECT id, try_cast(regexp_extract(name, '(\\d+)$', 1) AS INTEGER) AS number FROM docs WHERE name IS NOT NULL")
def _(t):
    return t["docs"].where("name is not null").select("id", markup.trailing_number(F.col("name")).alias("number"))


@query("clean_xml", "SELECT record_id, regexp_replace(replace(input, '<paragraph>' || chr(10) || chr(10) || '</paragraph>', ''), '<[\\p{L}\\p{N}_]+>[ ]*</[\\p{L}\\p{N}_]+>', '', 'g') AS text FROM instruction_records")
def _(t):
    return t.R.select("record_id", markup.clean_xml(F.col("input")).alias("text"))


@query("squeeze_spaces", "SELECT record_id, regexp_replace(input, ' +', ' ', 'g') AS text FROM instruction_records")
def _(t):
    return t.R.select("record_id", numerals.squeeze_spaces(F.col("input")).alias("text"))


@query("clean_spaces", f"SELECT id, {_clean_sql('text')} AS text FROM {_P}")
def _(t):
    return t.P.select("id", numerals.clean_spaces(F.col("text")).alias("text"))


@query("wrap_paragraphs", f"SELECT document, string_agg('<paragraph>' || text || chr(10) || '</paragraph>' || chr(10), '' ORDER BY paragraph_id) AS text FROM {_P} WHERE text IS NOT NULL GROUP BY document")
def _(t):
    rows = t.P.where("text is not null").groupBy("document").agg(F.array_sort(F.collect_list(F.struct("paragraph_id", "text"))).alias("ps"))
    return rows.select("document", F.array_join(F.transform("ps", lambda p: markup.wrap(p["text"])), "").alias("text"))


_TYPED = f"(SELECT * FROM {_S} WHERE text IS NOT NULL AND text_type IS NOT NULL)"


def _typed(t) -> DataFrame:
    return t.S.where("text is not null and text_type is not null")


@query("semantic_xml", f"""SELECT document, '<document>' || chr(10) || string_agg(p, chr(10) ORDER BY paragraph_id) || chr(10) || '</document>' AS text FROM (
    SELECT document, paragraph_id, '<paragraph>' || chr(10) || string_agg('<' || text_type || '>' || text || '</' || text_type || '>', chr(10) ORDER BY paragraph_pos, id) || chr(10) || '</paragraph>' AS p FROM {_TYPED} GROUP BY ALL) GROUP BY document""")
def _(t):
    return segment.semantic_xml(_typed(t))


# --- segments -----------------------------------------------------------------------------------------------------
_TAG = "CASE WHEN text_type LIKE 'title%' THEN 'bold14' WHEN text_type LIKE 'emphasis%' THEN 'bold12' WHEN text_type LIKE '%quote' THEN 'italic12' WHEN text_type LIKE 'footnote%' THEN 'regular8' ELSE 'regular12' END"


def _tagged(t) -> DataFrame:
    """Tagged text of each document, made from its excerpts, with fonts for types."""
    return segment.semantic_xml(_typed(t).where(~F.col("text").contains("<")).withColumn("text_type", F.expr(_TAG)))


_RUNS = f"""(SELECT document, dense_rank() OVER (PARTITION BY document ORDER BY paragraph_id)::INTEGER - 1 AS paragraph_id, row_number() OVER (PARTITION BY document, paragraph_id ORDER BY paragraph_pos, id)::INTEGER - 1 AS run, {_TAG} AS tag, text
    FROM {_TYPED} WHERE NOT contains(text, '<'))"""


@query("paragraph_table", f"""SELECT document, paragraph_id, lag(paragraph_id, 1, -1) OVER w AS previous, lead(paragraph_id, 1, -1) OVER w AS next, length, coalesce(sum(length) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS document_pos, text FROM (
    SELECT document, paragraph_id, length(raw)::INTEGER AS length, trim(raw, chr(10)) AS text FROM (SELECT document, paragraph_id, chr(10) || string_agg(text, chr(10) ORDER BY run) || chr(10) AS raw FROM {_RUNS} GROUP BY ALL)) WINDOW w AS (PARTITION BY document ORDER BY paragraph_id)""")
def _(t):
    return segment.paragraph_table(_tagged(t)).select("document", "paragraph_id", "previous", "next", "length", "document_pos", "text")


@query("font_mode", f"SELECT document, arg_max(size, n * 100 + size)::INTEGER AS body FROM (SELECT document, regexp_extract(tag, '\\d+$')::INTEGER AS size, count(DISTINCT tag) AS n FROM {_RUNS} GROUP BY ALL) GROUP BY document")
def _(t):
    return segment.font_mode(_tagged(t), ["document"])


@query("paragraph_font", f"SELECT document, paragraph_id, arg_max(size, n * 100 + size)::INTEGER AS body FROM (SELECT document, paragraph_id, regexp_extract(tag, '\\d+$')::INTEGER AS size, count(DISTINCT tag) AS n FROM {_RUNS} GROUP BY ALL) GROUP BY ALL")
def _(t):
    rows = _tagged(t).select("document", F.posexplode(markup.paragraphs(F.col("text"))).alias("paragraph_id", "raw"))
    return segment.font_mode(rows, ["document", "paragraph_id"], "raw")


_BODY = f"(SELECT document, arg_max(size, n * 100 + size) AS body FROM (SELECT document, regexp_extract(tag, '\\d+$')::INTEGER AS size, count(DISTINCT tag) AS n FROM {_RUNS} GROUP BY ALL) GROUP BY document)"
_TYPE_SQL = """coalesce(nullif(concat_ws('_', by_size, CASE WHEN NOT coalesce(by_size = 'page_number', false) AND ((text = upper(text) AND text <> lower(text) AND NOT coalesce(by_size = 'title', false)) OR contains(tag, 'bold')) THEN 'emphasis' END, CASE WHEN NOT coalesce(by_size = 'page_number', false) AND contains(tag, 'italic') THEN 'quote' END), ''), 'plain')"""


@query("excerpt_split", f"""SELECT document, paragraph_id, run, {_TYPE_SQL} AS text_type, length, paragraph_pos, (start + paragraph_pos)::BIGINT AS document_pos, text FROM (
    SELECT r.*, length(text)::INTEGER AS length, coalesce(sum(length(text)) OVER (PARTITION BY document, paragraph_id ORDER BY run ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS paragraph_pos, start,
        CASE WHEN regexp_extract(tag, '\\d+$')::INTEGER > body THEN 'title' WHEN starts_with(text, 'Página No.') THEN 'page_number' WHEN regexp_extract(tag, '\\d+$')::INTEGER <= body - 4 THEN 'footnote' END AS by_size
    FROM {_RUNS} r JOIN {_BODY} b USING (document) JOIN (SELECT document, paragraph_id, coalesce(sum(l) OVER (PARTITION BY document ORDER BY paragraph_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM (SELECT document, paragraph_id, sum(length(text) + 1) + 1 AS l FROM {_RUNS} GROUP BY ALL)) USING (document, paragraph_id))""")
def _(t):
    return segment.excerpt_split(_tagged(t)).drop("text_type_es")


@query("text_type", f"""SELECT id, {_TYPE_SQL} AS text_type FROM (SELECT id, text, {_TAG} AS tag, CASE WHEN regexp_extract({_TAG}, '\\d+$')::INTEGER > 12 THEN 'title' WHEN starts_with(text, 'Página No.') THEN 'page_number' WHEN regexp_extract({_TAG}, '\\d+$')::INTEGER <= 8 THEN 'footnote' END AS by_size FROM {_TYPED})""")
def _(t):
    return _typed(t).select("id", segment.text_type(F.expr(_TAG), F.col("text"), F.lit(12)).alias("text_type"))


@query("add_info", f"SELECT id, concat_ws('_', nullif(section, ''), text_type) AS info FROM {_S}")
def _(t):
    return t.S.select("id", F.concat_ws("_", F.nullif("section", F.lit("")), "text_type").alias("info"))


_FONTS = "['Times-Bold', 'Arial-BoldItalic', 'Courier', 'Times-Italic']"
_GLYPHS = f"(SELECT document, 1 AS page, paragraph_id AS element, k AS pos, substr(text, k, 1) AS ch, {_FONTS}[(k // 7 + paragraph_id) % 4 + 1] AS fontname, (8 + (k // 14) % 3 * 2.5)::DOUBLE AS size FROM (SELECT *, unnest(range(1, length(text) + 1)) AS k FROM {_P} WHERE length(text) > 0))"


def _glyphs(paragraphs: DataFrame) -> DataFrame:
    """Glyphs of paragraphs, in fonts that change every seven characters."""
    rows = paragraphs.where("length(text) > 0").withColumn("k", F.explode(F.sequence(F.lit(1), F.length("text"))))
    font = F.array(*(F.lit(x) for x in ("Times-Bold", "Arial-BoldItalic", "Courier", "Times-Italic")))[((F.floor(F.col("k") / 7) + F.col("paragraph_id")) % 4).cast("int")]
    return rows.select("document", F.lit(1).alias("page"), F.col("paragraph_id").alias("element"), F.lit(1).alias("line"), F.col("k").alias("pos"), F.col("text").substr(F.col("k"), F.lit(1)).alias("ch"), font.alias("fontname"), (8 + F.floor(F.col("k") / 14) % 3 * 2.5).cast("double").alias("size"))


@query("glyph_runs", f"""SELECT document, page, element, run, first(fontname) AS fontname, first(size) AS size, string_agg(ch, '' ORDER BY pos) AS text FROM (
    SELECT *, sum(turn) OVER (PARTITION BY document, element ORDER BY pos)::BIGINT AS run FROM (SELECT *, CASE WHEN lag(fontname) OVER w = fontname AND lag(size) OVER w = size THEN 0 ELSE 1 END AS turn FROM {_GLYPHS} WINDOW w AS (PARTITION BY document, element ORDER BY pos))) GROUP BY document, page, element, run""")
def _(t):
    return segment.glyph_runs(_glyphs(t.P))


def _font_labels(glyphs: DataFrame) -> DataFrame:
    return glyphs.select("fontname", "size").distinct().withColumn("label", segment.font_label(F.col("fontname"), F.col("size")))


@query("font_label", f"SELECT DISTINCT fontname, size, CASE WHEN contains(upper(fontname), 'BOLD') AND contains(upper(fontname), 'ITALIC') THEN 'bold_italic' WHEN contains(upper(fontname), 'BOLD') THEN 'bold' WHEN contains(upper(fontname), 'ITALIC') THEN 'italic' ELSE 'regular' END || round_even(size, 0)::INTEGER AS label FROM {_GLYPHS}")
def _(t):
    return _font_labels(_glyphs(t.P))


_ELEMENTS = f"(SELECT document, (paragraph_id // 5 + 1)::INTEGER AS page, paragraph_id AS element, CASE WHEN paragraph_id % 10 = 4 THEN ' ' || (paragraph_id // 5 + 1) || ' ' ELSE text END AS text FROM {_P} WHERE text IS NOT NULL)"


@query("page_number_inject", f"""WITH e AS (SELECT *, coalesce(length(trim(text, ' ')) < 5 AND regexp_full_match(trim(text, ' '), '[0-9]+') AND try_cast(trim(text, ' ') AS INTEGER) = page, false) AS mine FROM {_ELEMENTS})
    SELECT document, page, element, CASE WHEN mine THEN 'Página No. ' || page ELSE text END AS text FROM e UNION ALL SELECT document, page, max(element) + 1, 'Página No. ' || page FROM e GROUP BY document, page HAVING NOT bool_or(mine)""")
def _(t):
    page = (F.floor(F.col("paragraph_id") / 5) + 1).cast("int")
    rows = t.P.where("text is not null").select("document", page.alias("page"), F.col("paragraph_id").alias("element"), F.when(F.col("paragraph_id") % 10 == 4, F.concat(F.lit(" "), page.cast("string"), F.lit(" "))).otherwise(F.col("text")).alias("text"))
    return segment.page_numbers(rows)


@query("paragraph_repair")
def _(t):
    rows = _tagged(t).select("document", F.posexplode(markup.paragraphs(F.col("text"))).alias("paragraph_id", "text"))
    return segment.paragraph_repair(rows, segment.font_mode(_tagged(t), ["document"]))


@query("sanitize_doc")
def _(t):
    rows = _tagged(t).select("document", F.posexplode(markup.paragraphs(markup.clean_xml(F.col("text")))).alias("paragraph_id", "text"))
    fixed = segment.paragraph_repair(rows, segment.font_mode(_tagged(t), ["document"]))
    whole = fixed.groupBy("document").agg(F.array_sort(F.collect_list(F.struct("paragraph_id", "text"))).alias("ps"))
    return whole.select("document", F.array_join(F.transform("ps", lambda p: markup.wrap(p["text"])), "").alias("text"))


_HEADS = f"(SELECT document, paragraph_id, {_category_sql('left(text, 50)')} AS section FROM {_P} WHERE regexp_matches(text, '^([IVX]+|[0-9]+|[A-Z])[.-]') AND length(text) < 75)"


def _heads(t) -> DataFrame:
    return t.P.where(F.col("text").rlike("^([IVX]+|[0-9]+|[A-Z])[.-]") & (F.length("text") < 75)).select("document", "paragraph_id", labels.section_name(F.left("text", F.lit(50))).alias("section"))


@query("section_fill", f"SELECT p.id, coalesce(last_value(h.section IGNORE NULLS) OVER (PARTITION BY p.document ORDER BY p.paragraph_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), p.section) AS section FROM {_P} p LEFT JOIN {_HEADS} h USING (document, paragraph_id)")
def _(t):
    return segment.section_fill(t.P, _heads(t)).select("id", "section")


@query("join_range", f"""WITH h AS (SELECT *, lead(paragraph_id, 1, 1000000000) OVER (PARTITION BY document ORDER BY paragraph_id) AS stop FROM {_HEADS}) SELECT p.id, h.section FROM {_P} p JOIN h ON p.document = h.document AND p.paragraph_id >= h.paragraph_id AND p.paragraph_id < h.stop""")
def _(t):
    return segment.section_fill(t.P.withColumn("section", F.lit(None).cast("string")), _heads(t)).where("section is not null").select("id", "section")


@query("opinion_ffill", f"SELECT id, last_value(nullif(section, 'Pending') IGNORE NULLS) OVER (PARTITION BY document ORDER BY paragraph_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS section FROM {_P}")
def _(t):
    w = segment.paragraph_order().rowsBetween(-(2**63), 0)
    return t.P.select("id", F.last(F.nullif("section", F.lit("Pending")), ignorenulls=True).over(w).alias("section"))


@query("opinion_counter", f"SELECT id, sum((contains(lower(text), 'salvamento') AND text = upper(text))::INTEGER) OVER (PARTITION BY document ORDER BY paragraph_id)::BIGINT AS opinions FROM {_P} WHERE text IS NOT NULL")
def _(t):
    flag = (F.lower("text").contains("salvamento") & (F.col("text") == F.upper("text"))).cast("int")
    return t.P.where("text is not null").select("id", F.sum(flag).over(segment.paragraph_order()).alias("opinions"))


@query("boundary_filter", f"SELECT id, section FROM (SELECT id, section, lag(section) OVER w AS b, row_number() OVER w AS k FROM {_P} WINDOW w AS (PARTITION BY document ORDER BY paragraph_id)) WHERE k = 1 OR b IS DISTINCT FROM section")
def _(t):
    return segment.boundary_filter(t.P).select("id", "section")


@query("prev_block", f"SELECT id, lag(text_type) OVER w AS previous_type, lag(text) OVER w AS previous_text FROM {_S} WINDOW w AS (PARTITION BY document, paragraph_id ORDER BY paragraph_pos, id)")
def _(t):
    return segment.previous_block(t.S).select("id", "previous_type", "previous_text")


@query("merge_chunks", f"""SELECT document, run, part, first(section) AS label, count(*) AS rows, string_agg(coalesce(text, ''), ' ' ORDER BY paragraph_id) AS text FROM (
    SELECT *, ((row_number() OVER (PARTITION BY document, run ORDER BY paragraph_id) - 1) // 5)::INTEGER AS part FROM (SELECT *, sum(turn) OVER (PARTITION BY document ORDER BY paragraph_id)::BIGINT AS run FROM (
        SELECT *, (row_number() OVER w = 1 OR lag(section) OVER w IS DISTINCT FROM section)::INTEGER AS turn FROM {_P} WINDOW w AS (PARTITION BY document ORDER BY paragraph_id)))) GROUP BY document, run, part""")
def _(t):
    return segment.merge_chunks(t.P)


def _sliding_sql(wrap: bool) -> str:
    piece = "'<paragraph>' || t || chr(10) || '</paragraph>' || chr(10)" if wrap else "regexp_replace(t, '</?[^( /><.)]+>', '', 'g')"
    return f"""WITH p AS (SELECT document, section, coalesce(text, '') AS t, row_number() OVER (PARTITION BY document ORDER BY paragraph_id) - 1 AS k FROM {_P}),
    w AS (SELECT DISTINCT document, k AS first FROM p WHERE k % 3 = 0),
    c AS (SELECT w.document, w.first, p.k, p.section, p.t, first_value(p.section) OVER (PARTITION BY w.document, w.first ORDER BY p.k) AS head FROM w JOIN p ON p.document = w.document AND p.k BETWEEN w.first AND w.first + 4)
    SELECT document, first::INTEGER AS first, coalesce(arg_max(section, k) FILTER (WHERE section <> head AND section <> 'unmatched'), 'Sin sección') AS label, string_agg({piece}, {"''" if wrap else "chr(10)"} ORDER BY k) AS input FROM c GROUP BY document, first"""


@query("sliding_chunks", _sliding_sql(True))
def _(t):
    return segment.sliding_chunks(t.P)


@query("sliding_chunks_plain", _sliding_sql(False))
def _(t):
    return segment.sliding_chunks(t.P, wrap=False)


# --- section engine -----------------------------------------------------------------------------------------------
_KEYWORDS = "[" + ", ".join(_q(k) for k in sections.HEADINGS) + "]"
_FORMATS = f"""(SELECT document, arg_max(format, n * 1000000 - first) AS format FROM (SELECT document, format, count(*) AS n, min(paragraph_id) AS first FROM (
    SELECT document, paragraph_id, CASE WHEN own <> 'unknown' THEN own ELSE coalesce(other, 'unknown') END AS format FROM (SELECT document, paragraph_id, ({_format_sql('h')})[1] AS own, ({_format_sql('b')})[1] AS other FROM (
        SELECT DISTINCT document, p.paragraph_id AS paragraph_id, left({_strip_sql('p.text')}, 15) AS h, {_strip_sql('p.before')} AS b FROM (
            SELECT document, keyword, arg_min({{'paragraph_id': paragraph_id, 'text': text, 'before': before}}, paragraph_id) AS p FROM (SELECT document, paragraph_id, text, before, unnest({_KEYWORDS}) AS keyword FROM (SELECT *, lag(text) OVER (PARTITION BY document ORDER BY paragraph_id) AS before FROM {_P}) WHERE text IS NOT NULL) WHERE contains(text, keyword) GROUP BY document, keyword))))
    WHERE format <> 'unknown' GROUP BY document, format) GROUP BY document)"""


@query("section_format", f"SELECT document, format FROM {_FORMATS}")
def _(t):
    return sections.section_format(t.P)


@query("section_starts", f"""WITH RECURSIVE f AS MATERIALIZED {_FORMATS}, c AS MATERIALIZED (SELECT document, paragraph_id, n, roman, row_number() OVER (PARTITION BY document ORDER BY paragraph_id) AS k FROM (
      SELECT document, paragraph_id, starts_with(format, 'rom') AS roman,
        CASE WHEN starts_with(format, 'rom') THEN CASE WHEN length(text) < 75 AND len(tok) > 1 AND regexp_full_match(tok[1], CASE format WHEN 'rom-dot' THEN '[MDCLXVI]+\\.-?' ELSE '[MDCLXVI]+-' END) THEN list_position(romans, regexp_replace(tok[1], '[.-]', '', 'g')) + 1 WHEN length(text) < 75 AND len(tok) > 1 AND regexp_full_match(tok[1], CASE format WHEN 'rom-dot' THEN '\\.-?' ELSE '-' END) THEN -2 END
          WHEN regexp_matches(h, CASE format WHEN 'ara-hyphen' THEN '^\\b\\d+\\b[ ]*[-][^0-9]' WHEN 'ara-dot' THEN '^\\d+[ ]*[\\.][ ]*[-]*[A-Z]{{2,}}' ELSE '^$x' END) THEN coalesce(try_cast(regexp_replace(hw[1], '[.-]', '', 'g') AS INTEGER) + 1, -2) END AS n
      FROM (SELECT document, paragraph_id, text, format, {_words_sql(_clean_sql(f"left({_strip_sql('text')}, 10)"))} AS tok, left({_strip_sql('text')}, 15) AS h, {_words_sql(f"left({_strip_sql('text')}, 15)")} AS hw,
        (SELECT list({_TO_ROMAN} ORDER BY n) FROM (SELECT unnest(range(1, 200)) AS n)) AS romans FROM {_P} JOIN f USING (document))) WHERE n IS NOT NULL),
    s AS (SELECT document, 0::BIGINT AS k, -1::BIGINT AS at, false AS good, -1 AS paragraph_id FROM (SELECT DISTINCT document FROM c)
      UNION ALL SELECT c.document, c.k, CASE WHEN c.n >= s.at AND (NOT c.roman OR c.n - s.at < 10) THEN c.n ELSE s.at END, c.n >= s.at AND (NOT c.roman OR c.n - s.at < 10), c.paragraph_id FROM s JOIN c ON c.document = s.document AND c.k = s.k + 1)
    SELECT document, paragraph_id FROM s WHERE good""")
def _(t):
    paragraphs = materialise(t.P, "paragraphs")
    return sections.section_starts(paragraphs, sections.section_format(paragraphs))


def _sectioned(t) -> DataFrame:
    plain = materialise(t.P.withColumn("section", F.lit("header")), "plain")
    starts = materialise(sections.section_starts(plain, sections.section_format(plain)), "starts")
    return segment.section_fill(plain, sections.name_starts(plain, starts))


@query("section_names")
def _(t):
    paragraphs = materialise(t.P, "paragraphs")
    return sections.name_starts(paragraphs, sections.section_starts(paragraphs, sections.section_format(paragraphs)))


@query("section_lengths")
def _(t):
    return _sectioned(t).groupBy("section").agg(F.count("*").alias("paragraphs"), F.sum("length").alias("length"))


_UPPER = [(k, a.upper()) for k, a in enumerate(a for xs in labels.SECTIONS.values() for a in xs)]


@query("sections_no_number", f"""SELECT DISTINCT f.document, f.paragraph_id FROM (SELECT document, a.k, min(paragraph_id) AS paragraph_id FROM {_P} p, (VALUES {', '.join(f"({k}, {_q(a)})" for k, a in _UPPER)}) a(k, alias) WHERE regexp_matches(text, alias) GROUP BY ALL) f
    JOIN (SELECT document, paragraph_id FROM {_S} GROUP BY ALL HAVING bool_and(coalesce(text_type = 'emphasis', false))) USING (document, paragraph_id)""")
def _(t):
    return sections.starts_without_number(t.P, t.S)


_LAST_BEFORE = "last_value(s IGNORE NULLS) OVER (PARTITION BY document ORDER BY paragraph_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"


@query("dissents", f"""WITH p AS {_P}, m AS (SELECT document, paragraph_id, count(*) AS k FROM {_S} s JOIN (SELECT document, paragraph_id, length(text) AS size FROM p) USING (document, paragraph_id)
      WHERE (text_type = 'emphasis' OR (text = upper(text) AND text <> lower(text))) AND NOT regexp_matches(text, '^\\d+') AND (contains(lower(text), 'salvamento') OR contains(lower(text), 'aclaración de voto'))
        AND NOT regexp_matches(lower(text), 'motivo|fundamentos|razones|razón') AND size < length(text) + 100 GROUP BY ALL),
    n AS (SELECT document, paragraph_id, 'Dissenting Opinion - ' || sum(k) OVER (PARTITION BY document ORDER BY paragraph_id) AS s FROM m)
    SELECT id, coalesce({_LAST_BEFORE}, section) AS section FROM p LEFT JOIN n USING (document, paragraph_id)""")
def _(t):
    return sections.dissents(t.P, t.S).select("id", "section")


@query("signatures", f"""WITH p AS {_P}, c AS (SELECT *, lead(paragraph_id) OVER (PARTITION BY document ORDER BY paragraph_id) - paragraph_id AS gap FROM p WHERE regexp_matches(lower(text), '{sections.CLOSING}')),
    r AS (SELECT DISTINCT document, paragraph_id FROM {_S} WHERE regexp_matches(lower(text), '{sections.CLOSING}') AND coalesce(text_type NOT IN ('quote', 'footnote'), true)),
    b AS (SELECT document, section, min(paragraph_id) AS start FROM c JOIN r USING (document, paragraph_id) WHERE gap IS NULL OR gap > 8 GROUP BY ALL)
    SELECT p.id, CASE WHEN p.paragraph_id > b.start THEN 'Signature Block' ELSE p.section END AS section FROM p LEFT JOIN b ON p.document = b.document AND p.section = b.section""")
def _(t):
    return sections.signatures(t.P, t.S).select("id", "section")


@query("assign_section", f"SELECT id, CASE WHEN paragraph_id > 10 AND section = 'Decision' THEN 'Signature Block' ELSE section END AS section FROM {_P}")
def _(t):
    return t.P.select("id", F.when((F.col("paragraph_id") > 10) & (F.col("section") == "Decision"), "Signature Block").otherwise(F.col("section")).alias("section"))


@query("footnotes", f"""SELECT id, CASE WHEN has AND NOT contains(t, 'footnote') THEN CASE WHEN t = 'plain' THEN 'footnote' ELSE 'footnote_' || t END ELSE t END AS text_type FROM (
    SELECT *, bool_or(coalesce(contains(t, 'footnote') AND t <> 'footnote_number', false)) OVER (PARTITION BY document, paragraph_id) AS has FROM (SELECT id, document, paragraph_id, CASE WHEN contains(text_type, 'footnote') AND paragraph_pos > 5 AND length < 10 THEN 'footnote_number' ELSE text_type END AS t FROM {_S}))""")
def _(t):
    return sections.footnotes(t.S).select("id", "text_type")


@query("integrity")
def _(t):
    return sections.integrity(t.P).select("document", "first", "last", _joined(F.col("missing").cast("array<string>")).alias("missing"))


@query("annotate_all")
def _(t):
    return sections.annotate(t.P, t.S).select("id", "document", "paragraph_id", "section")


@query("fuzzy_pending")
def _(t):
    return sections.fuzzy_pending(t.P)


# --- joins and documents ------------------------------------------------------------------------------------------
@query("join_left_equi", f"SELECT s.id, coalesce(p.section, s.section) AS section FROM {_S} s LEFT JOIN {_P} p USING (document, paragraph_id)")
def _(t):
    return sections.push_sections(t.P, t.S).select("id", "section")


@query("join_lookup", f"SELECT p.id, d.name FROM {_P} p JOIN {_D} d ON d.id = p.document")
def _(t):
    return t.P.join(t.D.select(F.col("id").alias("document"), "name"), "document").select("id", "name")


@query("join_semi", f"SELECT id FROM {_P} WHERE document IN (SELECT id FROM {_D} WHERE year >= 2010)")
def _(t):
    return t.P.join(t.D.where("year >= 2010").select(F.col("id").alias("document")), "document", "left_semi").select("id")


@query("join_exists", f"SELECT id FROM {_P} p WHERE EXISTS (SELECT 1 FROM {_S} s WHERE s.document = p.document AND s.paragraph_id = p.paragraph_id AND s.text_type NOT IN ('quote', 'footnote')) AND NOT EXISTS (SELECT 1 FROM {_S} s WHERE s.document = p.document AND s.paragraph_id = p.paragraph_id AND s.text_type = 'page_number')")
def _(t):
    good = t.S.where(~F.col("text_type").isin("quote", "footnote")).select("document", "paragraph_id")
    bad = t.S.where("text_type = 'page_number'").select("document", "paragraph_id")
    return t.P.join(good, ["document", "paragraph_id"], "left_semi").join(bad, ["document", "paragraph_id"], "left_anti").select("id")


@query("join_asof", f"SELECT id, lag(text_type) OVER (PARTITION BY document, paragraph_id ORDER BY paragraph_pos, id) AS before FROM {_S}")
def _(t):
    return segment.previous_block(t.S).select("id", F.col("previous_type").alias("before"))


@query("join_unique_exact", f"SELECT t.id AS text_id, s.id, s.text_type FROM {_P} t JOIN (SELECT text, min(id) AS id, min(text_type) AS text_type FROM {_S} WHERE text IS NOT NULL GROUP BY text HAVING count(*) = 1) s ON s.text = t.text")
def _(t):
    return joins.unique_exact(t.P.select(F.col("id").alias("text_id"), "text"), t.S)


@query("join_theta_contains", f"""SELECT t.document, t.id AS text_id, coalesce(u.section, 'unmatched') AS section FROM (SELECT * FROM {_S} WHERE text_type = 'quote') t LEFT JOIN (
    SELECT t.document, t.id, min(p.section) AS section FROM (SELECT * FROM {_S} WHERE text_type = 'quote' AND length(text) > 0) t JOIN {_P} p ON p.document = t.document AND contains(p.text, t.text) GROUP BY ALL HAVING count(*) = 1) u USING (document, id)""")
def _(t):
    quotes = t.S.where("text_type = 'quote'").select("document", F.col("id").alias("text_id"), "text")
    return joins.unique_containing(materialise(quotes, "quotes"), materialise(t.P.select("document", "text", "section"), "paragraphs"))


@query("join_cross", f"SELECT y.year, s.section, t.text_type FROM (SELECT DISTINCT year FROM {_D} WHERE year IS NOT NULL) y, (SELECT DISTINCT section FROM {_P} WHERE section IS NOT NULL) s, (SELECT DISTINCT text_type FROM {_S} WHERE text_type IS NOT NULL) t")
def _(t):
    years, names, types = t.D.where("year is not null").select("year").distinct(), t.P.where("section is not null").select("section").distinct(), t.S.where("text_type is not null").select("text_type").distinct()
    return years.crossJoin(F.broadcast(names)).crossJoin(F.broadcast(types))


@query("text_align")
def _(t):
    typed = _typed(t)
    return joins.align(typed.select("document", "id", "paragraph_id", "paragraph_pos", "text"), segment.semantic_xml(typed))


_UP = "regexp_replace(upper(regexp_replace(trim(name), '\\.[A-Za-z]{1,5}$', '')), '^$', '')"
_BASE = "regexp_replace(list_last(string_split(name, '/')), '\\.[A-Za-z]{1,5}$', '')"


@query("doc_name_parse", f"""SELECT id, CASE WHEN y IS NOT NULL THEN type END AS type, CASE WHEN y >= 100 THEN y WHEN y > 90 THEN 1900 + y ELSE 2000 + y END AS year FROM (SELECT id,
    CASE WHEN regexp_matches(u, '^T') THEN 'T' WHEN regexp_matches(u, '^C') THEN 'C' WHEN regexp_matches(u, '^SU') THEN 'SU' WHEN regexp_matches(u, '^A') THEN 'A' END AS type,
    try_cast(CASE WHEN regexp_full_match(u, '(T|C)-[^-]+-[0-9]{{1,4}}') OR regexp_full_match(u, '(SU|A)[^-]*-[0-9]{{1,4}}') THEN list_last(string_split(u, '-')) END AS INTEGER) AS y FROM (SELECT id, {_UP} AS u FROM docs))""")
def _(t):
    parsed = joins.parse_name(F.col("name"))
    return t["docs"].select("id", parsed["type"].alias("type"), parsed["year"].alias("year"))


@query("doc_id_lookup", f"SELECT d.name, u.id FROM docs d LEFT JOIN (SELECT {_BASE} AS key, min(id) AS id FROM docs WHERE name IS NOT NULL GROUP BY 1) u ON u.key = regexp_replace(list_last(string_split(d.name, '/')), '\\.[A-Za-z]{{1,5}}$', '')")
def _(t):
    return joins.ids_by_name(t["docs"].select("name"), t["docs"])


@query("decision_id_lookup", "SELECT '/data/in/' || d.name || '.xml' AS name, u.id FROM docs d JOIN (SELECT name, min(id) AS id FROM docs WHERE NOT contains(name, '.') GROUP BY 1) u ON u.name = d.name")
def _(t):
    docs = t["docs"].where(~F.col("name").contains("."))
    return joins.ids_by_name(docs.select(F.concat(F.lit("/data/in/"), "name", F.lit(".xml")).alias("name")), docs)


@query("meta_prefix_lookup", "SELECT n.name, min(d.id) AS id FROM (SELECT DISTINCT left(name, k) AS name FROM docs, (VALUES (1), (2), (5), (7)) v(k) WHERE length(name) >= k) n JOIN docs d ON starts_with(d.name, n.name) GROUP BY n.name")
def _(t):
    size = F.explode(F.array(*map(F.lit, (1, 2, 5, 7)))).alias("k")
    names = t["docs"].select("name", size).where(F.length("name") >= F.col("k")).select(F.left("name", F.col("k")).alias("name")).distinct()
    return joins.by_prefix(t["docs"], names)


@query("doc_upsert", f"""WITH k AS (SELECT id, name FROM {_D} WHERE name IS NOT NULL AND id % 3 <> 0), n AS (SELECT DISTINCT name FROM docs WHERE name IS NOT NULL AND name NOT IN (SELECT name FROM k))
    SELECT id, name FROM k UNION ALL SELECT (SELECT max(id) FROM k) + row_number() OVER (ORDER BY md5(name), name), name FROM n""")
def _(t):
    known = t.D.where("name is not null and id % 3 <> 0").select("id", "name")
    return joins.upsert_documents(known, t["docs"].where("name is not null").select("name"))


@query("combine_collections", f"SELECT id, section FROM {_P} UNION ALL SELECT id + (SELECT max(id) + 1 FROM {_P}), section FROM {_P} WHERE section = 'header'")
def _(t):
    rows = t.P.select("id", "section")
    return joins.combine_collections(rows, rows.where("section = 'header'"))


# --- statistics ---------------------------------------------------------------------------------------------------
_STATS = f"(SELECT document, section, text_type, sum(length)::BIGINT AS length FROM {_S} GROUP BY ALL)"


@query("agg_length", f"SELECT * FROM {_STATS}")
def _(t):
    return stats.length_by_section(t.S)


@query("agg_sections", f"SELECT * FROM {_STATS}")
def _(t):
    return stats.length_by_section(t.S)


def _time_sql(by_type: bool) -> str:
    keys = "year, section, text_type" if by_type else "year, section"
    grid = " CROSS JOIN ".join(f"(SELECT DISTINCT {k} FROM m)" for k in keys.split(", "))
    return f"""WITH m AS (SELECT {keys}, avg(length) AS a FROM {_STATS} s JOIN {_D} d ON d.id = s.document WHERE year IS NOT NULL AND section <> 'Pending' AND text_type IS NOT NULL GROUP BY {keys}), g AS (SELECT * FROM {grid})
    SELECT {keys}, round(coalesce(a, 0), 6)::DOUBLE AS avg_length FROM g LEFT JOIN m USING ({keys})"""


@query("time_analysis", _time_sql(False))
def _(t):
    return stats.time_analysis(stats.length_by_section(t.S), t.D).withColumn("avg_length", F.round("avg_length", 6))


@query("time_analysis_by_type", _time_sql(True))
def _(t):
    return stats.time_analysis(stats.length_by_section(t.S), t.D, by_type=True).withColumn("avg_length", F.round("avg_length", 6))


@query("count_paragraphs", f"SELECT d.id, coalesce(n, 0) AS num_paragraphs, coalesce(s, 0) AS num_sections FROM {_D} d LEFT JOIN (SELECT document AS id, count(*) AS n, count(DISTINCT section) AS s FROM {_P} GROUP BY 1) USING (id)")
def _(t):
    return stats.count_paragraphs(t.D, t.P)


@query("value_counts", f"SELECT document, count(*) AS n FROM {_P} WHERE regexp_matches(lower(text), '{sections.CLOSING}') GROUP BY document")
def _(t):
    return t.P.where(F.lower("text").rlike(sections.CLOSING)).groupBy("document").agg(F.count("*").alias("n"))


@query("first_per_group", f"SELECT document, section, min(paragraph_id) AS paragraph_id, arg_min(id, paragraph_id) AS id FROM {_P} WHERE section IS NOT NULL GROUP BY document, section")
def _(t):
    return t.P.where("section is not null").groupBy("document", "section").agg(F.min("paragraph_id").alias("paragraph_id"), F.min_by("id", "paragraph_id").alias("id"))


@query("distinct", f"SELECT DISTINCT section, text_type FROM {_S}")
def _(t):
    return t.S.select("section", "text_type").distinct()


@query("mode_first", f"SELECT document, arg_max(text_type, n * 1000000000 - f) AS text_type FROM (SELECT document, text_type, count(*) AS n, min(id) AS f FROM {_S} WHERE text_type IS NOT NULL GROUP BY ALL) GROUP BY document")
def _(t):
    return stats.mode_first(t.S, ["document"], "text_type", "id")


@query("min_max_missing", f"SELECT document, min(paragraph_id) AS low, max(paragraph_id) AS high, (max(paragraph_id) - min(paragraph_id) + 1 - count(*))::BIGINT AS missing FROM {_P} GROUP BY document")
def _(t):
    ids = t.P.groupBy("document").agg(F.min("paragraph_id").alias("low"), F.max("paragraph_id").alias("high"), F.collect_set("paragraph_id").alias("ids"))
    return ids.select("document", "low", "high", F.size(F.array_except(F.sequence("low", "high"), "ids")).cast("long").alias("missing"))


@query("word_cloud", f"SELECT word, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(text), '\\p{{L}}+')) AS word FROM {_P}) GROUP BY word")
def _(t):
    return stats.word_frequencies(t.P)


@query("word_freq", f"""SELECT word, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(b), '\\p{{L}}+')) AS word FROM (SELECT text_type, lag(text) OVER (PARTITION BY document, paragraph_id ORDER BY paragraph_pos, id) AS b FROM {_S}) WHERE text_type = 'quote') WHERE regexp_matches(word, '(ó|aron|ieron)$') GROUP BY word""")
def _(t):
    before = segment.previous_block(t.S).where("text_type = 'quote'")
    return stats.word_frequencies(before, "previous_text").where(F.col("word").rlike("(ó|aron|ieron)$"))


@query("label_stats", f"""SELECT l.label, count(*) FILTER (WHERE s = 'train') AS train, count(*) FILTER (WHERE s = 'val') AS val, count(*) FILTER (WHERE s = 'test') AS test, round(avg(n), 6) AS input_length
    FROM (SELECT unnest({_LABEL_VALUES}) AS label) l LEFT JOIN (SELECT lower(trim(output, ' ')) AS label, lower(trim(split, ' ')) AS s, len({_words_sql('input')}) AS n FROM instruction_records) r USING (label) GROUP BY l.label""")
def _(t):
    return stats.label_statistics(t.R, labels.LABELS).withColumn("input_length", F.round("input_length", 6))


# --- sets, sampling -----------------------------------------------------------------------------------------------
@query("sort", f"SELECT id, row_number() OVER (PARTITION BY document ORDER BY paragraph_id, paragraph_pos, id)::INTEGER AS place FROM {_S}")
def _(t):
    w = segment.W.partitionBy("document").orderBy("paragraph_id", "paragraph_pos", "id")
    return t.S.select("id", F.row_number().over(w).alias("place"))


@query("limit_first", f"SELECT document, arg_min(id, paragraph_id) AS id FROM {_P} GROUP BY document")
def _(t):
    return t.P.groupBy("document").agg(F.min_by("id", "paragraph_id").alias("id"))


@query("union_all", "SELECT id, section FROM paragraphs_df UNION ALL SELECT id, section FROM styles_df")
def _(t):
    return t["paragraphs_df"].select("id", "section").unionByName(t["styles_df"].select("id", "section"))


@query("union_distinct", "SELECT section FROM paragraphs_df UNION SELECT section FROM styles_df")
def _(t):
    return t["paragraphs_df"].select("section").union(t["styles_df"].select("section")).distinct()


@query("difference", "SELECT DISTINCT doc_id FROM paragraphs_df WHERE doc_id NOT IN (SELECT id FROM docs WHERE id IS NOT NULL)")
def _(t):
    return t["paragraphs_df"].select("doc_id").distinct().join(t["docs"].select(F.col("id").alias("doc_id")), "doc_id", "left_anti").where("doc_id is not null")


_RANK = "row_number() OVER (ORDER BY md5(record_id::VARCHAR || '{0}'), record_id)"


@query("split", f"SELECT record_id, CASE WHEN k <= floor(n * 0.7::DOUBLE) THEN 'train' WHEN k <= floor(n * 0.7::DOUBLE) + floor(n * 0.2::DOUBLE) THEN 'val' ELSE 'test' END AS new_split FROM (SELECT record_id, {_RANK.format('')} AS k, count(*) OVER () AS n FROM instruction_records)")
def _(t):
    return sampling.split(t.R, "record_id").select("record_id", "new_split")


@query("balance", f"SELECT record_id FROM instruction_records WHERE output IS DISTINCT FROM 'sin sección' UNION ALL SELECT record_id FROM (SELECT record_id, {_RANK.format('42')} AS k, count(*) OVER () AS n FROM instruction_records WHERE output = 'sin sección') WHERE k <= floor(n * 0.05::DOUBLE)")
def _(t):
    return sampling.balance(t.R, "record_id", "output", "sin sección").select("record_id")


@query("hf_split", f"SELECT record_id, CASE WHEN k <= 200 THEN 'test' ELSE 'train' END AS new_split FROM (SELECT record_id, {_RANK.format('42')} AS k FROM instruction_records)")
def _(t):
    return sampling.holdout(t.R, "record_id", 200).select("record_id", "new_split")


_POOL = "(SELECT item_id AS shot_id, text AS input, output FROM eval_items WHERE suite = 'secciones_v1' AND lang = 'es')"
_SHOTS = f"""(SELECT r.record_id, r.input, list({{'input': s.input, 'output': s.output}} ORDER BY s.h) AS shots FROM instruction_records r JOIN (
    SELECT * FROM (SELECT r.record_id, p.input, p.output, md5(r.record_id || '|' || p.shot_id || '|') AS h, row_number() OVER (PARTITION BY r.record_id ORDER BY md5(r.record_id || '|' || p.shot_id || '|')) AS k FROM instruction_records r, {_POOL} p) WHERE k <= 4) s USING (record_id) GROUP BY ALL)"""


def _shots(t) -> DataFrame:
    pool = t["eval_items"].where("suite = 'secciones_v1' and lang = 'es'").select(F.col("item_id").alias("shot_id"), F.col("text").alias("input"), "output")
    return sampling.sample_shots(t.R, pool, 4)


@query("sample_k", f"SELECT record_id, array_to_string(list_transform(shots, lambda s: s.output), '|') AS outputs FROM {_SHOTS}")
def _(t):
    return _shots(t).select("record_id", _joined(F.transform("shots", lambda s: s["output"])).alias("outputs"))


@query("icl_sample", f"SELECT record_id, array_to_string(list_transform(shots, lambda s: left(s.input, 40)), '|') AS inputs FROM {_SHOTS}")
def _(t):
    return _shots(t).select("record_id", _joined(F.transform("shots", lambda s: F.left(s["input"], F.lit(40)))).alias("inputs"))


# --- prompts ------------------------------------------------------------------------------------------------------
_NL = "chr(10)"
_DEMOS = f"array_to_string(list_transform(shots, lambda s: '### Input:' || {_NL} || s.input || {_NL} || '### Response:' || {_NL} || s.output || {_NL} || {_NL}), '')"


@query("few_shot_text", f"SELECT record_id, {_DEMOS} AS text FROM {_SHOTS}")
def _(t):
    return _shots(t).select("record_id", prompts.few_shot_text(F.col("shots")).alias("text"))


@query("few_shot_records", f"SELECT record_id, 'few-shot' AS description, '### Response:' AS response_split, 'Clasifique.' AS instruction, {_DEMOS} AS demo_part, '### Input:' || {_NL} || input || {_NL} || '### Response:' || {_NL} AS query_part FROM {_SHOTS} WHERE length(input) > 12")
def _(t):
    return prompts.few_shot_records(_shots(t), "Clasifique.")


@query("chat_messages", f"SELECT record_id, 10 AS messages, 'system' AS first_role, input AS last_content FROM {_SHOTS} WHERE input IS NOT NULL")
def _(t):
    rows = _shots(t).where("input is not null").withColumn("m", prompts.chat_messages("Clasifique.", F.col("shots"), F.col("input")))
    return rows.select("record_id", F.size("m").alias("messages"), F.col("m")[0]["role"].alias("first_role"), F.element_at("m", -1)["content"].alias("last_content"))


@query("prompt", f"SELECT record_id, '### Instruction:' || {_NL} || instruction || {_NL} || {_NL} || '### Input:' || {_NL} || (CASE WHEN len(w) > 100 THEN array_to_string(w[1:100], ' ') ELSE input END) || {_NL} || '### Response:' || {_NL} AS prompt FROM (SELECT *, {_words_sql('input')} AS w FROM instruction_records)")
def _(t):
    return t.R.select("record_id", prompts.prompt_text(F.col("instruction"), F.col("input"), most_words=100).alias("prompt"))


@query("prompt_seq2seq", f"SELECT record_id, '### Instruction:' || {_NL} || instruction || {_NL} || {_NL} || '### Input:' || {_NL} || input || {_NL} || '### Response:' || {_NL} AS inputs, output AS labels FROM instruction_records")
def _(t):
    s = prompts.seq2seq(F.col("instruction"), F.col("input"), F.col("output"))
    return t.R.select("record_id", s["inputs"].alias("inputs"), s["labels"].alias("labels"))


@query("df_to_json", "SELECT 'Clasifique.' AS instruction, text AS input, section AS output FROM paragraphs_df")
def _(t):
    return prompts.to_records(t["paragraphs_df"], "Clasifique.", "text", "section")


@query("gpt_zero", f"SELECT record_id, answer, {_first_label_sql('answer')} AS prediction FROM (SELECT record_id, left(input, 200) AS answer FROM instruction_records WHERE length(input) > 12)")
def _(t):
    return prompts.predict(t.R.select("record_id", "input"), lambda xs: [x[:200] for x in xs]).select("record_id", "answer", "prediction")


# --- evaluation ---------------------------------------------------------------------------------------------------
_PREDICTED = f"(SELECT record_id, lower(trim(output, ' ')) AS label, {_first_label_sql('input')} AS prediction FROM instruction_records)"


def _predicted(t) -> DataFrame:
    return t.R.select("record_id", F.lower(F.trim("output")).alias("label"), labels.first_label(F.col("input")).alias("prediction"))


@query("accuracy", f"SELECT round(avg(coalesce(label = prediction, false)::INTEGER), 9) AS accuracy FROM {_PREDICTED}")
def _(t):
    return evaluate.accuracy(_predicted(t), "label", "prediction").select(F.round("accuracy", 9).alias("accuracy"))


@query("accuracy_strip", f"SELECT round(avg((trim(label, ' ') = trim(prediction, ' '))::INTEGER), 9) AS accuracy FROM {_PREDICTED} WHERE prediction IS NOT NULL")
def _(t):
    return evaluate.accuracy_strip(_predicted(t), "label", "prediction").select(F.round("accuracy", 9).alias("accuracy"))


_REPORT = f"""(WITH p AS {_PREDICTED}, c AS (SELECT label FROM p WHERE label IS NOT NULL UNION SELECT prediction FROM p WHERE prediction IS NOT NULL),
    k AS (SELECT c.label, count(*) FILTER (WHERE p.label = c.label AND p.prediction = c.label) AS tp, count(*) FILTER (WHERE p.prediction = c.label) AS said, count(*) FILTER (WHERE p.label = c.label) AS support FROM c, p GROUP BY c.label),
    r AS (SELECT label, CASE WHEN said > 0 THEN tp / said ELSE 0.0 END AS precision, CASE WHEN support > 0 THEN tp / support ELSE 0.0 END AS recall, support FROM k)
    SELECT label, precision, recall, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0 END AS f1, support FROM r)"""


@query("class_report", f"SELECT label, round(precision, 9)::DOUBLE AS precision, round(recall, 9)::DOUBLE AS recall, round(f1, 9)::DOUBLE AS f1, support FROM {_REPORT}")
def _(t):
    r = evaluate.class_report(_predicted(t), "label", "prediction")
    return r.select("label", *(F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")), "support")


@query("class_report_averages", f"SELECT 'macro' AS kind, round(avg(precision), 9)::DOUBLE AS precision, round(avg(recall), 9)::DOUBLE AS recall, round(avg(f1), 9)::DOUBLE AS f1 FROM {_REPORT} UNION ALL SELECT 'weighted', round(sum(precision * support) / sum(support), 9)::DOUBLE, round(sum(recall * support) / sum(support), 9)::DOUBLE, round(sum(f1 * support) / sum(support), 9)::DOUBLE FROM {_REPORT}")
def _(t):
    r = evaluate.report_averages(evaluate.class_report(_predicted(t), "label", "prediction"))
    return r.select("kind", *(F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")))


# --- sources, sinks, streams --------------------------------------------------------------------------------------
def _fresh(t, name: str) -> str:
    return fresh_path(t.spark, name)


@query("src_csv", "SELECT id, document, paragraph_id, text_type, text FROM styles_df WHERE text IS NOT NULL AND text <> ''")
def _(t):
    path = _fresh(t, "csv")
    files.write_csv(t["styles_df"].where("text is not null and text <> ''").select("id", "document", "paragraph_id", "text_type", "text"), path)
    return files.read_csv(t.spark, path, "id bigint, document bigint, paragraph_id int, text_type string, text string")


@query("src_json", "SELECT instruction AS prompt, input AS text, output AS label FROM instruction_records")
def _(t):
    path = _fresh(t, "json")
    files.write_records(t.R.select("instruction", "input", "output"), path)
    return files.read_records(t.spark, path, lines=True)


@query("src_json_v2", "SELECT instruction AS prompt, input AS text, output AS label FROM instruction_records WHERE split = 'val'")
def _(t):
    path = _fresh(t, "json")
    files.write_records(t.R.where("split = 'val'").select(F.col("instruction").alias("prompt"), "input", "output"), path)
    return files.read_records(t.spark, path, prompt="prompt", lines=True)


@query("src_json_split", "SELECT split, count(*) AS n FROM instruction_records WHERE split IN ('train', 'val', 'test') GROUP BY split")
def _(t):
    paths = {s: _fresh(t, s) for s in ("train", "val", "test")}
    for s, path in paths.items():
        files.write_records(t.R.where(F.col("split") == s).select("instruction", "input", "output"), path)
    out = [t.spark.read.schema(files.RECORDS).json(p).withColumn("split", F.lit(s)) for s, p in paths.items()]
    return out[0].unionByName(out[1]).unionByName(out[2]).groupBy("split").agg(F.count("*").alias("n"))


@query("src_text", f"SELECT document, count(*) AS paragraphs FROM {_P} WHERE text IS NOT NULL GROUP BY document")
def _(t):
    return _text_round_trip(t, t.P.where("text is not null"))


def _text_round_trip(t, paragraphs: DataFrame) -> DataFrame:
    """Paragraphs by document, counted in the tagged text that is written for it and read again."""
    path = _fresh(t, "text")
    rows = paragraphs.repartition("document").withColumn("line", markup.wrap(F.regexp_replace("text", r"[\r\n]+", " ")))
    files.write_text(rows, path, "line", ["document"])
    read = files.read_texts(t.spark, path, "*.txt").withColumn("document", F.regexp_extract("path", "document=(-?\\d+)", 1).try_cast("long"))
    return read.select("document", F.explode(markup.paragraphs(F.col("text")))).groupBy("document").agg(F.count("*").alias("paragraphs"))


@query("parse_files", "SELECT 'a.zip' AS archive, 'text.txt' AS name, 12 AS bytes")
def _(t):
    import io
    import zipfile

    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        z.writestr("text.txt", "doce letras.")
    path = _fresh(t, "zip")
    target = t.spark._jvm.org.apache.hadoop.fs.Path(f"{path}/a.zip")
    out = target.getFileSystem(t.spark._jsc.hadoopConfiguration()).create(target)
    out.write(bytearray(buffer.getvalue()))
    out.close()
    rows = files.parse_files(t.spark, path, files.unzip, "name string, bytes binary", "*.zip")
    return rows.select(F.substring_index("path", "/", -1).alias("archive"), "name", F.length("bytes").alias("bytes"))


@query("src_hf_json", "SELECT instruction AS prompt, input AS text, output AS label FROM instruction_records WHERE split = 'train'")
def _(t):
    path = _fresh(t, "jsonl")
    files.write_records(t.R.where("split = 'train'").select("instruction", "input", "output"), path)
    return files.read_records(t.spark, path, lines=True)


@query("src_json_test", "SELECT input AS text, lower(trim(output, ' ')) AS label FROM instruction_records WHERE split = 'test'")
def _(t):
    path = _fresh(t, "json")
    files.write_records(t.R.where("split = 'test'").select("instruction", "input", "output"), path)
    return files.read_records(t.spark, path, lines=True).select("text", F.lower(F.trim("label")).alias("label"))


@query("sink_csv", f"SELECT text_type, count(*) AS n FROM {_S} GROUP BY text_type")
def _(t):
    path = _fresh(t, "csv")
    files.write_csv(t.S.select("id", "text_type"), path, sep="\t")
    return t.spark.read.schema("id bigint, text_type string").csv(path, header=True, sep="\t").groupBy("text_type").agg(F.count("*").alias("n"))


@query("sink_json", "SELECT record_id, input FROM instruction_records WHERE input IS NOT NULL")
def _(t):
    path = _fresh(t, "json")
    files.write_records(t.R.where("input is not null").select("record_id", "input"), path)
    return t.spark.read.schema("record_id bigint, input string").json(path)


@query("sink_text", f"SELECT count(*) AS documents FROM (SELECT DISTINCT document FROM {_TYPED})")
def _(t):
    path = _fresh(t, "xml")
    files.write_text(segment.semantic_xml(_typed(t)).withColumn("text", F.regexp_replace("text", "[\r\n]", " ")), path, "text", ["document"])
    return files.read_texts(t.spark, path, "*.txt").agg(F.count("*").alias("documents"))


@query("xml_to_text_files", "SELECT doc_id, trim(regexp_replace(regexp_replace(text, '</?[^( /><.)]+>', '', 'g'), '[\\r\\n]', ' ', 'g'), ' ') AS text FROM documents WHERE text IS NOT NULL")
def _(t):
    # A line for each document, so that the number of files doesn't grow with that of documents.
    path = _fresh(t, "raw")
    rows = t["documents"].where("text is not null").select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc_id"), F.trim(F.regexp_replace(markup.raw_text(F.col("text")), "[\r\n]", " ")).alias("text"))
    files.write_text(rows.withColumn("line", F.concat_ws("\t", "doc_id", "text")), path, "line")
    tab = F.instr("value", "\t")
    return t.spark.read.text(path).select(F.substring_index("value", "\t", 1).try_cast("bigint").alias("doc_id"), F.col("value").substr(tab + 1, F.length("value")).alias("text"))


@query("skip_existing", "SELECT DISTINCT name FROM docs WHERE name IS NOT NULL AND name NOT IN (SELECT name FROM docs WHERE name IS NOT NULL AND id % 2 = 0)")
def _(t):
    names = t["docs"].where("name is not null").select("name").distinct()
    return files.new_files(names, t["docs"].where("id % 2 = 0").select("name"))


@query("db_create_insert", "SELECT DISTINCT fontname AS name, size, 'x' AS label FROM (SELECT 'Times-Bold' AS fontname, 12.0::DOUBLE AS size UNION ALL SELECT 'Arial', 9.5)")
def _(t):
    path = _fresh(t, "fonts")
    table = "docframe_fonts_" + path[-8:]
    files.ensure_table(t.spark, table, "name string, size double, label string", path)
    assert not files.ensure_table(t.spark, table, "name string, size double, label string", path)
    files.append(t.spark.createDataFrame([("Times-Bold", 12.0, "x"), ("Arial", 9.5, "x")], "name string, size double, label string"), table)
    return t.spark.table(table)


@query("chunk_corpus", f"""WITH p AS (SELECT p.document, p.k, coalesce(p.text, '') AS t, coalesce(u.section, 'unmatched') AS section FROM (SELECT *, row_number() OVER (PARTITION BY document ORDER BY paragraph_id) - 1 AS k FROM {_P}) p
      LEFT JOIN (SELECT a.document, a.id, min(b.section) AS section FROM {_P} a JOIN {_P} b ON a.document = b.document AND contains(b.text, a.text) AND length(a.text) > 0 GROUP BY ALL HAVING count(*) = 1) u ON u.document = p.document AND u.id = p.id),
    w AS (SELECT DISTINCT document, k AS first FROM p WHERE k % 3 = 0),
    c AS (SELECT w.document, w.first, p.k, p.section, first_value(p.section) OVER (PARTITION BY w.document, w.first ORDER BY p.k) AS head FROM w JOIN p ON p.document = w.document AND p.k BETWEEN w.first AND w.first + 4)
    SELECT document, first::INTEGER AS first, coalesce(arg_max(section, k) FILTER (WHERE section <> head AND section <> 'unmatched'), 'Sin sección') AS label FROM c GROUP BY document, first""")
def _(t):
    paragraphs = materialise(t.P, "paragraphs")
    found = joins.unique_containing(paragraphs.select("document", F.col("id").alias("text_id"), F.coalesce("text", F.lit("")).alias("text")), paragraphs)
    rows = paragraphs.drop("section").join(found.select("document", F.col("text_id").alias("id"), "section"), ["document", "id"])
    return segment.sliding_chunks(rows).select("document", "first", "label")


@query("verbs", f"SELECT id, array_to_string(list_filter(regexp_extract_all(lower(text), '\\p{{L}}+'), lambda w: regexp_matches(w, '(ó|aron|ieron)$')), '|') AS verbs FROM {_P}")
def _(t):
    import re

    def tagger(text: str) -> list[str]:
        return [w for w in re.findall(r"[^\W\d_]+", text.lower()) if re.search("(?:ó|aron|ieron)$", w)]

    return prompts.tagged_words(t.P.select("id", "text"), tagger).select("id", _joined("words").alias("verbs"))


@query("gpt_few", f"SELECT record_id, 'decisión' AS prediction FROM instruction_records WHERE length(input) > 12")
def _(t):
    return prompts.predict_few_shot(_shots(t), "Clasifique.", lambda xs: ["Es la decisión."] * len(xs)).select("record_id", "prediction")


@query("event_windows", "SELECT time_bucket(INTERVAL '1 hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def _(t):
    return ingest.event_windows(t["events"]).withColumn("total", F.round("total", 4))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
