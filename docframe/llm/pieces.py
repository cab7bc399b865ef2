"""Cutting oversized texts at natural boundaries, with overlap.

Every character's offset serves as the prefix sum of sizes; paragraph, line, sentence and word ends form sorted arrays
in which the last boundary under the limit is found by binary search.  A cut is moved back to the best kind of
boundary available, the next piece begins up to OVERLAP characters before it, and only a text without any boundary is
cut hard (never between a letter and its combining accents).
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LIMIT, OVERLAP = 1500, 200
#: Ends of paragraphs, lines, sentences and words, best first.
_KINDS = (
    re.compile(r"</paragraph>\s*|\r?\n[ \t]*\r?\n\s*"),
    re.compile(r"\r\n|\n|\r"),
    re.compile(r"[.!?…][\"'»”)\]]*\s+|</\w+>\s*"),
    re.compile(r"\s+"),
)
#: A better kind of boundary is taken if it leaves the piece at least this part of the limit.
_LEAST = 0.5


def cut(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int]]:
    """(start, end) of the pieces; each begins at or before the end of the one before, and all cover the text."""
    if limit <= 0 or not 0 <= overlap < limit:
        raise ValueError("0 <= overlap < limit is needed")
    if len(text) <= limit:
        return [(0, len(text))]
    ends = [[m.end() for m in kind.finditer(text)] for kind in _KINDS]
    pieces, start, last = [], 0, 0
    while len(text) - start > limit:
        end = 0
        for floor in (max(last, start + int(limit * _LEAST)), last):
            for bounds in ends:
                k = bisect_right(bounds, start + limit) - 1
                if k >= 0 and bounds[k] > floor:
                    end = bounds[k]
                    break
            if end:
                break
        if not end:
            end = start + limit
            while end > last + 1 and unicodedata.combining(text[end]):
                end -= 1
        pieces.append((start, end))
        last, begin = end, end - overlap
        for bounds in ends[1:]:
            k = bisect_left(bounds, begin)
            if k < len(bounds) and bounds[k] < end:
                begin = bounds[k]
                break
        else:
            while begin < end and unicodedata.combining(text[begin]):
                begin += 1
        start = max(begin, start + 1)
    return [*pieces, (start, len(text))]


def _split(limit: int, overlap: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for key, text in zip(batch["id"].to_pylist(), batch["text"].to_pylist()):
                places = cut(text, limit, overlap)
                last = 0
                for k, (a, b) in enumerate(places):
                    rows.append((key, k, len(places), a, b, last - a if k else 0, text[a:b]))
                    last = b
            columns = list(zip(*rows)) if rows else [[]] * 7
            kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["id", "piece", "pieces", "start", "end", "overlap", "text"])

    return run


def split_oversized(records: DataFrame, key: str = "record_id", text: str = "input", limit: int = LIMIT, overlap: int = OVERLAP, keep_short: bool = False) -> DataFrame:
    """(key, piece, pieces, start, end, overlap, text) of the texts over the limit, of others too with ``keep_short``.

    Sizes are code points.  Null texts have no rows, an empty text one empty piece with ``keep_short``; repeated rows
    come once each; an empty table gives no rows.
    """
    rows = records.select(F.col(key).alias("id"), F.col(text).alias("text")).where(F.col("text").isNotNull())
    if not keep_short:
        rows = rows.where(F.length("text") > limit)
    out = rows.mapInArrow(_split(limit, overlap), "id bigint, piece int, pieces int, start bigint, end bigint, overlap int, text string")
    return out.withColumnRenamed("id", key)
