"""Labels and section names found in text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The labels of sections in Spanish, in the order that breaks ties.
LABELS = [
    "encabezado", "antecedentes", "pretensiones", "intervenciones", "intervención del procurador", "norma(s) demandada(s)",
    "actuaciones en sede revisión", "pruebas", "audiencia(s) pública(s)", "competencia", "consideraciones de la corte",
    "síntesis de la decisión", "decisión", "firmas", "salvamento de voto", "sin sección",
]

# Section names and their aliases as patterns, in order of priority.
SECTIONS = {
    "Factual Background": ["antecedente", "hechos", "informaci.n preliminar"],
    "Prior Rulings": [
        "decisiones objeto de", "decisi.n objeto de", "sentencia revisada", "sentencias revisadas", "fallos que se revisan",
        "sentencias objeto de revisi.n", "actuaci.n judicial", "actuaciones objeto de deci.n", "tr.mite surtido en sede de revisi.n",
        "fallo materia de revisi.n", "primera instancia", "actuaci.n procesal", "tr.mite legislativo y actuaci.n de la corte",
        "caso concreto", "casos concretos", "segunda instancia", "actuaci.on procesal", "sentencia que se revisa",
        "actuaciones en sede de revisi.n", "decisiones judiciales que se revisa",
    ],
    "Court's Analysis": ["consideraciones", "fundamentos", "fundamento jur.dico", "revisi.n por la corte constitucional"],
    "Challenged Statute(s)": [
        "norma acusada", "norma demandada", "normas acusadas", "normas demandadas", "texto del decreto", "texto de la ley",
        "norma bajo examen", "disposici.n acusada", "del texto legal objeto", "norma objeto", "ordenamiento acusado", "texto de la",
        "texto del", "textos legales", "texto revisado",
    ],
    "Plaintiff's Allegations": ["la demanda", "demanda", "los cargos", "impugnaci.n"],
    "Decision": ["decisi.n", "d e c i s i . n"],
    "Third-Party Intervention": ["intervenciones", "intervenci.n de terceros", "intervenci.n"],
    "Summary of Findings": ["s.ntesis del fallo", "conclusi.n"],
    "Exhibits": ["pruebas", "material probatorio aportado", "prueba practicada", "material probatorio"],
    "Third-Party Intervention: Procurador": ["procurador", "procuradur", "ministerio p.blico", "concepto fiscal", "naci.n"],
    "Jurisdiction": ["competencia"],
    "Hearings": ["audiencia"],
}
PENDING = "Pending"


def categorise(text: Column, dictionary: dict[str, list[str]], case: bool = False) -> Column:
    """The first category with an alias that matches; 'Pending' if none does."""
    subject = text if case else F.lower(text)
    out = F
    for name, aliases in dictionary.items():
        out = out.when(subject.rlike("|".join(aliases)), name)
    return out.when(text.isNotNull(), PENDING)


def section_name(text: Column, case: bool = False) -> Column:
    return categorise(text, SECTIONS, case)


def closest_alias(text: Column, dictionary: dict[str, list[str]], most: int | None = None) -> Column:
    """Struct (distance, ord, section, alias) of the alias nearest by edit distance; the first of equals.

    With ``most`` it is null if none is that near; texts longer than every alias by more are not compared at all.
    """
    pairs = [(s, a) for s, aliases in dictionary.items() for a in aliases]
    if most is not None:
        text = F.when(F.length(text) <= max(len(a) for _, a in pairs) + most, text)

    def one(k: int, section: str, alias: str) -> Column:
        distance = F.levenshtein(text, F.lit(alias), most) if most is not None else F.levenshtein(text, F.lit(alias))
        out = F.struct(distance.alias("distance"), F.lit(k).alias("ord"), F.lit(section).alias("section"), F.lit(alias).alias("alias"))
        return F.when(distance >= 0, out) if most is not None else out

    return F.array_min(F.array(*(one(k, s, a) for k, (s, a) in enumerate(pairs))))


def first_label(text: Column, labels: list[str] = LABELS) -> Column:
    """The label that stands first in the lower-cased text, earlier labels first at equal places; 'none' if none."""

    def found(low: Column) -> Column:
        places = (F.struct(F.instr(low, x).alias("at"), F.lit(k).alias("ord"), F.lit(x).alias("label")) for k, x in enumerate(labels))
        return F.coalesce(F.array_min(F.filter(F.array(*places), lambda p: p["at"] > 0))["label"], F.lit("none"))

    # The lambda's variable holds the lower-cased text, which is computed once and not for each label.
    return F.when(text.isNotNull(), F.transform(F.array(F.lower(text)), found)[0])


def contained_class(text: Column, classes: list[str] = LABELS) -> Column:
    """The first class, in the classes' order, that the text contains; 'no class' if none."""
    return F.coalesce(*(F.when(text.contains(c), c) for c in classes), F.when(text.isNotNull(), "no class"))


def truncate_words(text: Column, most: int) -> Column:
    """The first words, joined by single spaces, of a text with more; any other as it is."""
    w = F.filter(F.split(text, r"(?U)\s+"), lambda x: x != "")
    return F.when(F.size(w) > most, F.array_join(F.slice(w, 1, most), " ")).otherwise(text)


def word_count(text: Column) -> Column:
    return F.size(F.filter(F.split(text, r"(?U)\s+"), lambda x: x != ""))


def response_tail(text: Column, mark: str) -> Column:
    """What follows the last mark, without outer white space; the whole text if there is no mark."""
    tail = F.regexp_replace(F.substring_index(text, mark, -1), r"(?U)^\s+|\s+$", "")
    return F.when(text.contains(mark), tail).otherwise(text)
