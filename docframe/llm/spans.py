"""Long exact spans shared between excerpts.

A window of WINDOW characters is hashed only at places whose number modulo PERIOD is in a difference cover.  For any
two places some offset below PERIOD brings both into the cover at once, so two texts with a run of LEAST = WINDOW +
PERIOD - 1 equal characters share an aligned anchor inside it.  Anchors are extended to the whole run and checked
character by character.  Equal texts form a class and are compared once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from docframe.llm.words import CHUNK, chunks, mix, powers
from docframe.plans.lineage import materialise

LEAST = 160
# A perfect difference set modulo 57; every remainder is the difference of two of its members.
COVER, PERIOD = (0, 1, 3, 13, 32, 36, 43, 52), 57


def window_hashes(texts: list[str], width: int, places: Callable[[np.ndarray], np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, place, hash) of the windows of ``width`` characters at the places that a mask of their numbers keeps."""
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    starts = np.cumsum(lengths) - lengths
    owner = np.repeat(np.arange(len(texts)), lengths)
    place = np.arange(len(codes)) - starts[owner]
    at = np.nonzero((place + width <= lengths[owner]) & places(place))[0]
    up, down = powers(len(codes))
    sums = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum((codes + np.uint64(1)) * up[: len(codes)], out=sums[1:])
    return owner[at], place[at], mix((sums[at + width] - sums[at]) * down[at])


def _in_cover(place: np.ndarray) -> np.ndarray:
    member = np.zeros(PERIOD, bool)
    member[list(COVER)] = True
    return member[place % PERIOD]


def _windows(width: int, places: Callable) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, classes = batch["text"].to_pylist(), np.array(batch["cls"].to_pylist(), object)
            for s in chunks(texts, CHUNK):
                owner, place, hashes = window_hashes(texts[s], width, places)
                yield pa.RecordBatch.from_arrays([pa.array(classes[s][owner], pa.string()), pa.array(place.astype(np.int32)), pa.array(hashes.view(np.int64))], ["cls", "place", "h"])

    return run


def _runs(a: str, b: str, shift: int, least: int) -> list[tuple[int, int]]:
    """(start in a, length) of the runs of at least ``least`` equal characters, b read ``shift`` characters further."""
    low, high = max(0, -shift), min(len(a), len(b) - shift)
    x = np.frombuffer(a[low:high].encode("utf-32-le", "surrogatepass"), np.uint32)
    y = np.frombuffer(b[low + shift : high + shift].encode("utf-32-le", "surrogatepass"), np.uint32)
    turns = np.diff(np.concatenate([[0], (x == y).astype(np.int8), [0]]))
    first, last = np.nonzero(turns == 1)[0], np.nonzero(turns == -1)[0]
    return [(low + int(s), int(e - s)) for s, e in zip(first, last) if e - s >= least]


def _extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for x, y, shifts, a, b in zip(*(batch[c].to_pylist() for c in ("cls_a", "cls_b", "shifts", "text_a", "text_b"))):
            for shift in shifts:
                rows += [(x, y, s, s + shift, n) for s, n in _runs(a, b, shift, LEAST)]
        columns = list(zip(*rows)) if rows else [[]] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32()))], ["cls_a", "cls_b", "start_a", "start_b", "length"])


def members(styles: DataFrame, key: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """The long excerpts (id, excerpt, cls), and the classes of equal texts (cls, text, low, high).

    excerpt is the key that copies share; low and high are the least and greatest excerpt of a class, which differ if
    the text stands in more than one.
    """
    key = F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in ("document", "paragraph_id", "paragraph_pos"))) if key is None else key
    rows = styles.where(F.length("text") >= LEAST).select("id", key.alias("excerpt"), F.md5(F.encode("text", "utf-8")).alias("cls"), "text")
    classes = rows.groupBy("cls").agg(F.first("text").alias("text"), F.min("excerpt").alias("low"), F.max("excerpt").alias("high"))
    return materialise(rows.drop("text"), "p3_members"), materialise(classes, "p3_classes")


def class_spans(classes: DataFrame) -> DataFrame:
    """(cls_a, cls_b, start_a, start_b, length): all longest runs of at least LEAST characters that two classes share."""
    anchors = materialise(classes.mapInArrow(_windows(LEAST - PERIOD + 1, _in_cover), "cls string, place int, h bigint"), "p3_anchors")
    a, b = anchors.alias("a"), anchors.alias("b")
    pairs = (
        a.join(b, (F.col("a.h") == F.col("b.h")) & (F.col("a.cls") < F.col("b.cls")))
        .groupBy(F.col("a.cls").alias("cls_a"), F.col("b.cls").alias("cls_b"))
        .agg(F.collect_set(F.col("b.place") - F.col("a.place")).alias("shifts"))
    )
    texts = classes.select("cls", "text")
    return (
        pairs.join(texts.select(F.col("cls").alias("cls_a"), F.col("text").alias("text_a")), "cls_a")
        .join(texts.select(F.col("cls").alias("cls_b"), F.col("text").alias("text_b")), "cls_b")
        .select("cls_a", "cls_b", "shifts", "text_a", "text_b")
        .mapInArrow(_extend, "cls_a string, cls_b string, start_a int, start_b int, length int")
    )


def shared_pairs(styles: DataFrame) -> DataFrame:
    """(id_a, id_b), id_a < id_b, of the rows of different excerpts with a run of LEAST equal characters.

    Null and shorter texts share nothing; a text repeated under one excerpt's key forms no pair with itself; an empty
    table gives no rows.
    """
    rows, classes = members(styles)
    links = class_spans(classes).select("cls_a", "cls_b").distinct()
    links = links.unionByName(classes.where("low < high").select(F.col("cls").alias("cls_a"), F.col("cls").alias("cls_b")))
    a = rows.select(F.col("cls").alias("cls_a"), F.col("id").alias("id_a"), F.col("excerpt").alias("excerpt_a"))
    b = rows.select(F.col("cls").alias("cls_b"), F.col("id").alias("id_b"), F.col("excerpt").alias("excerpt_b"))
    return (
        links.join(a, "cls_a").join(b, "cls_b")
        .where((F.col("excerpt_a") != F.col("excerpt_b")) & ((F.col("cls_a") != F.col("cls_b")) | (F.col("id_a") < F.col("id_b"))))
        .select(F.least("id_a", "id_b").alias("id_a"), F.greatest("id_a", "id_b").alias("id_b"))
    )


def shared_lengths(styles: DataFrame) -> DataFrame:
    """(id, text_type, length, shared): of each excerpt, how many characters stand in shared runs of another excerpt.

    No pairs are formed: classes with a shared anchor hash all their windows of LEAST characters, and a window shared
    by two excerpts covers its characters.  Null texts have length null and nothing shared.
    """
    rows, classes = members(styles)
    anchors = classes.mapInArrow(_windows(LEAST - PERIOD + 1, _in_cover), "cls string, place int, h bigint")
    anchors = materialise(anchors.join(classes.select("cls", "low", "high"), "cls").select("h", "cls", "low", "high"), "p3_marks")
    met = anchors.groupBy("h").agg(F.min("low").alias("least"), F.max("high").alias("most")).where("least < most").select("h")
    touched = anchors.join(met, "h", "left_semi").select("cls").distinct()
    windows = (
        classes.join(touched, "cls", "left_semi").select("cls", "text").mapInArrow(_windows(LEAST, lambda place: place >= 0), "cls string, place int, h bigint")
        .join(classes.select("cls", "low", "high"), "cls")
    )
    windows = materialise(windows, "p3_windows")
    shared = windows.groupBy("h").agg(F.min("low").alias("least"), F.max("high").alias("most")).where("least < most").select("h")
    order = W.partitionBy("cls").orderBy("place")
    step = F.least(F.lit(LEAST), F.coalesce(F.col("place") - F.lag("place").over(order), F.lit(LEAST)))
    covered = windows.join(shared, "h", "left_semi").select("cls", "place", step.alias("step")).groupBy("cls").agg(F.sum("step").alias("shared"))
    by_id = rows.join(covered, "cls").select("id", "shared")
    return styles.select("id", "text_type", F.length("text").alias("length")).join(by_id, "id", "left").select("id", "text_type", "length", F.coalesce("shared", F.lit(0)).cast(T.LongType()).alias("shared"))


def shared_by_type(styles: DataFrame) -> DataFrame:
    """For each text type: excerpts, those with shared spans, characters and shared characters."""
    return shared_lengths(styles).groupBy("text_type").agg(
        F.count("*").alias("excerpts"), F.count(F.when(F.col("shared") > 0, 1)).alias("sharing"), F.sum("length").alias("chars"), F.sum("shared").alias("shared_chars")
    )
