"""Filling containers of fixed capacity with texts, by sums of squares.

Each item goes where the sum, over gaps, of the squared number of open containers with that gap becomes smallest.
Only ids and sizes are shuffled.  Items are packed in parts of a bounded number, in random order; what a part leaves
open is less than a few containers, so the loss does not grow with the number of parts' items.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docframe.plans.lineage import materialise

CAPACITY = 1024
ITEMS_AT_ONCE = 50_000
#: Containers with a greater part empty at the end are packed again.
LOOSE = 0.02
#: A token: a run of letters, digits and underscores, or of other characters that are not white space.
TOKEN = r"(?U)[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]+"


def token_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(TOKEN))


def tokenizer_count(text: Column, path: str) -> Column:
    """Tokens of a public tokenizer, whose file (a ``tokenizers`` JSON) all executors can read at ``path``."""

    @F.pandas_udf("int")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.encode_special_tokens = True
        for texts in batches:
            known = texts[texts.notna()]
            sizes = [len(e.ids) for e in tokenizer.encode_batch(known.tolist(), add_special_tokens=False)]
            yield pd.Series(sizes, index=known.index, dtype="Int32").reindex(texts.index)

    return count(text)


def sum_of_squares(sizes: np.ndarray, capacity: int = CAPACITY) -> np.ndarray:
    """The container of each size, in the order given; sizes are from 1 to the capacity."""
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    count = np.zeros(capacity + 1, np.int64)
    out = np.empty(len(sizes), np.int64)
    bins = 0
    for k, size in enumerate(sizes.tolist()):
        # Squares change by 1 - 2 N[g] where a container leaves gap g, and by 2 N[h] + 1 where it comes to gap h > 0.
        change = 2 * (count[: capacity - size + 1] - count[size:])
        change[0] += 1
        change[1:] += 2
        change = np.where(count[size:] > 0, change, np.iinfo(np.int64).max)
        fresh = 2 * count[capacity - size] + 1 if size < capacity else 0
        at = int(change.argmin())
        if change[at] <= fresh:
            bin_, gap = open_bins[at + size].pop(), at
            count[at + size] -= 1
        else:
            bin_, gap = bins, capacity - size
            bins += 1
        out[k] = bin_
        if gap:
            open_bins[gap].append(bin_)
            count[gap] += 1
    return out


def tighten(sizes: np.ndarray, bins: np.ndarray, capacity: int = CAPACITY) -> np.ndarray:
    """The same, with the items of containers left over LOOSE empty packed again, largest first, each where it fits best.

    Sums of squares leave some containers open when the items end; this is kept only if it needs fewer containers.
    """
    if not len(sizes):
        return bins
    loose = np.bincount(bins, sizes)[bins] < (1 - LOOSE) * capacity
    items = np.nonzero(loose)[0]
    items = items[np.argsort(-sizes[items], kind="stable")]
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    count = np.zeros(capacity + 1, np.int64)
    again, used = np.empty(len(items), np.int64), 0
    for k, size in enumerate(sizes[items].tolist()):
        fits = np.flatnonzero(count[size:])
        if len(fits):
            gap = size + int(fits[0])
            bin_ = open_bins[gap].pop()
            count[gap] -= 1
        else:
            gap, bin_, used = capacity, used, used + 1
        again[k] = bin_
        open_bins[gap - size].append(bin_)
        count[gap - size] += 1
    if used >= len(np.unique(bins[items])):
        return bins
    out = bins.copy()
    kept = np.unique(bins[~loose], return_inverse=True)
    out[~loose] = kept[1]
    out[items] = len(kept[0]) + again
    return out


def _pack(capacity: int):
    def run(key: tuple, table: pd.DataFrame) -> pd.DataFrame:
        table = table.sort_values(["h", "doc_id", "piece"])
        sizes = table["tokens"].to_numpy()
        return pd.DataFrame({"doc_id": table["doc_id"], "piece": table["piece"], "tokens": table["tokens"], "part": key[0], "place": tighten(sizes, sum_of_squares(sizes, capacity), capacity)})

    return run


def pack(documents: DataFrame, size: Column | None = None, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, tokens, container): the container of each text, or of each piece of a larger one.

    A text is split only if it is larger than a container, into full pieces and a rest.  Texts without tokens (null,
    empty, blank) need no room: one row with 0 tokens and no container.  Repeated rows are packed once each; an empty
    table gives no rows.  ``size`` is the number of tokens, by default that of TOKEN in the text.
    """
    sizes = documents.select(F.col(key).alias("doc_id"), F.coalesce(token_count(F.col(text)) if size is None else size, F.lit(0)).alias("n"))
    pieces = sizes.select(
        "doc_id",
        F.posexplode(F.when(F.col("n") <= capacity, F.array("n")).otherwise(
            F.concat(F.array_repeat(F.lit(capacity), F.floor(F.col("n") / capacity).cast("int")), F.when(F.col("n") % capacity > 0, F.array((F.col("n") % capacity).cast("int"))).otherwise(F.array().cast("array<int>")))
        )).alias("piece", "tokens"),
    )
    loose = F.col("tokens").between(1, capacity - 1)
    pieces = materialise(pieces, "p6_pieces")
    parts = pieces.where(loose).count() // ITEMS_AT_ONCE + 1
    spread = F.xxhash64("doc_id", "piece", F.lit("order"))
    placed = (
        pieces.where(loose)
        .select("doc_id", "piece", "tokens", spread.alias("h"), F.pmod(F.shiftright(spread, 7), F.lit(parts)).cast("int").alias("part"))
        .groupBy("part")
        .applyInPandas(_pack(capacity), "doc_id bigint, piece int, tokens int, part int, place bigint")
    )
    filled = placed.select("doc_id", "piece", "tokens", F.concat_ws("-", F.lit("s"), "part", "place").alias("container"))
    whole = pieces.where(~loose).select("doc_id", "piece", "tokens", F.when(F.col("tokens") > 0, F.concat_ws("-", F.lit("f"), "doc_id", "piece")).alias("container"))
    return filled.unionByName(whole)


def oversized(documents: DataFrame) -> DataFrame:
    """(doc_id) of the texts that were split over containers."""
    return pack(documents).where("piece > 0").select("doc_id").distinct()


def fill_report(documents: DataFrame) -> DataFrame:
    """Containers by how full they are, in twentieths of the capacity."""
    tokens = pack(documents).where("container is not null").groupBy("container").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("items"))
    return tokens.groupBy(F.ceil(F.col("tokens") * 20 / CAPACITY).alias("twentieths")).agg(F.count("*").alias("containers"), F.sum("items").alias("items"), F.sum("tokens").alias("tokens"))
