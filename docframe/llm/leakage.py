"""Held-out items that occur, whole or in part, in training documents.

Two kinds of windows get a 64-bit SimHash.  Parts: every run of WINDOW words of an item and of a document, by word
shingles; four Hamming blocks of 16 bits hold all pairs at most RADIUS = 3 bits apart, so equal runs, at distance 0,
are never missed.  Whole items: every run of as many words as an item has, by pairs of words, which few edits touch;
the four blocks of an item are entered with all values at most BLOCK_RADIUS bits off, so no pair at most NEAR = 11
bits apart is missed.  Candidates are verified by the exact weighted similarity of their shingles (weights: rarity
among the items' windows).  A run as long as an item is judged only if enough of its shingles occur in the items for
that similarity, which loses nothing.

The documents are scanned once and never shuffled.  The items are the query set: they are taken in blocks of at most
ITEM_CHARS characters, each broadcast in turn, so that what is broadcast is bounded whatever their number.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docframe.llm.words import chunks, shingles, word_hashes

#: Words of a window and of a shingle.  A window has SLOTS shingles, a power of two.
WINDOW, SHINGLE = 20, 5
SLOTS = WINDOW - SHINGLE + 1
RADIUS, BLOCKS, BLOCK_BITS = 3, 4, 16
SIMILARITY = 0.8
#: Whole items: how far fingerprints may be apart, and how far one of their blocks then is at most.
BLOCK_RADIUS = 2
NEAR = (BLOCK_RADIUS + 1) * BLOCKS - 1
#: Characters of items in one broadcast.
ITEM_CHARS = 16_000_000
_AT_ONCE = 100_000


def window_fingerprints(marks: np.ndarray) -> np.ndarray:
    """The SimHash of each run of SLOTS shingles: for each bit, whether at least half of the shingles have it."""
    if len(marks) < SLOTS:
        return np.empty(0, np.uint64)
    votes = np.unpackbits(marks.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    step = 1
    while step < SLOTS:
        votes = votes[:-step] + votes[step:]
        step *= 2
    return np.packbits(votes >= SLOTS // 2, axis=1, bitorder="little").view(np.uint64).ravel()


def _vote_sums(marks: np.ndarray) -> np.ndarray:
    """For each place how many of the marks before it have each of the 64 bits."""
    sums = np.zeros((len(marks) + 1, 64), np.int32)
    np.cumsum(np.unpackbits(marks.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"), axis=0, out=sums[1:])
    return sums


def _prints(sums: np.ndarray, first: np.ndarray, words: np.ndarray) -> np.ndarray:
    """The SimHash of runs of words, from the sums of the marks of their pairs of words."""
    if not len(first):
        return np.empty(0, np.uint64)
    votes = sums[first + words - 1] - sums[first]
    return np.packbits(2 * votes >= (words - 1)[:, None], axis=1, bitorder="little").view(np.uint64).ravel()


class Windows:
    """All windows of some texts: fingerprint, shingles and whole-window hash."""

    def __init__(self, texts: list[str | None]):
        words, offsets = word_hashes(texts)
        n = np.diff(offsets)
        self.words, self.offsets = words, offsets
        self.marks = shingles(words, SHINGLE)
        prints = window_fingerprints(self.marks)
        owner = np.repeat(np.arange(len(n)), n)[: len(prints)]
        place = np.arange(len(prints)) - offsets[:-1][owner]
        self.at = np.nonzero(place + WINDOW <= n[owner])[0]
        self.owner, self.place, self.prints = owner[self.at], place[self.at], prints[self.at]
        self.whole = shingles(words, WINDOW)[self.at]

    def shingles_of(self, which: np.ndarray) -> np.ndarray:
        return self.marks[self.at[which][:, None] + np.arange(SLOTS)]


class ItemIndex:
    """The windows of a block of items, by each block of their fingerprints' bits."""

    def __init__(self, ids: list, texts: list[str | None]):
        self.ids = ids
        self.windows = w = Windows(texts)
        self.by_block = []
        for b in range(BLOCKS):
            value = self._block(w.prints, b)
            order = np.argsort(value, kind="stable")
            self.by_block.append((order, np.searchsorted(value[order], np.arange((1 << BLOCK_BITS) + 1))))
        every = np.sort(w.shingles_of(np.arange(len(w.at))), axis=1).ravel() if len(w.at) else np.empty(0, np.uint64)
        self.known, self.often = np.unique(every, return_counts=True)
        self._enter_whole_items()

    def _enter_whole_items(self) -> None:
        """Fingerprints of the whole items, found by length, block and block value."""
        w, n = self.windows, np.diff(self.windows.offsets)
        self.long = np.nonzero(n >= WINDOW)[0]
        self.sizes = np.unique(n[self.long])
        self.bags = [np.unique(w.marks[w.offsets[i] : w.offsets[i + 1] - SHINGLE + 1], return_counts=True) for i in self.long]
        self.bag_weights = [(self.weights(m) * c).sum() for m, c in self.bags]
        sums = _vote_sums(shingles(w.words, 2))
        self.prints = _prints(sums, w.offsets[self.long], n[self.long])
        bits = 1 << np.arange(BLOCK_BITS)
        near = np.array([0, *bits, *(a | b for k, a in enumerate(bits) for b in bits[:k])], np.int64)
        keys = [((n[self.long] << 20)[:, None] | (b << BLOCK_BITS) | (self._block(self.prints, b)[:, None] ^ near)).ravel() for b in range(BLOCKS)]
        entry = np.tile(np.repeat(np.arange(len(self.long), dtype=np.int32), len(near)), BLOCKS)
        keys = np.concatenate(keys)
        order = np.argsort(keys, kind="stable")
        self.keys, self.entries = keys[order], entry[order]
        # Which shingles occur in the items, by their lower bits: others may seem to, none is overlooked.
        self.filter = np.zeros(1 << max(16, int(np.ceil(np.log2(8 * len(self.known) + 1)))), bool)
        self.filter[(self.known & np.uint64(len(self.filter) - 1)).astype(np.int64)] = True

    def whole(self, windows: Windows) -> list[tuple[int, int, int, float]]:
        """(text, item, first word, similarity) of runs of an item's length that are similar to it."""
        if not len(self.long):
            return []
        offsets, n = windows.offsets, np.diff(windows.offsets)
        seen = np.zeros(len(windows.words) + 1, np.int64)
        known = self.filter[(windows.marks & np.uint64(len(self.filter) - 1)).astype(np.int64)]
        seen[1 : len(known) + 1] = np.cumsum(known)
        seen[len(known) + 1 :] = seen[len(known)]
        out = []
        least = SIMILARITY * (self.sizes[0] - SHINGLE + 1)
        for d in np.nonzero((n >= self.sizes[0]) & (seen[offsets[1:]] - seen[offsets[:-1]] >= least))[0]:
            a, b = int(offsets[d]), int(offsets[d + 1])
            at, size = [], []
            for k in self.sizes[self.sizes <= b - a].tolist():
                first = np.arange(a, b - k + 1)
                first = first[seen[first + k - SHINGLE + 1] - seen[first] >= SIMILARITY * (k - SHINGLE + 1)]
                at.append(first)
                size.append(np.full(len(first), k))
            at, size = np.concatenate(at), np.concatenate(size)
            if not len(at):
                continue
            prints = _prints(_vote_sums(shingles(windows.words[a:b], 2)), at - a, size)
            which, items = self._near(prints, size)
            for x, i in zip(which.tolist(), items.tolist()):
                score = self._alike(windows.marks[at[x] : at[x] + size[x] - SHINGLE + 1], i)
                if score >= SIMILARITY:
                    out.append((int(d), int(self.long[i]), int(at[x] - a), score))
        return out

    def _near(self, prints: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All (window, whole item) of one length whose fingerprints are at most NEAR bits apart."""
        both = []
        for b in range(BLOCKS):
            key = (size << 20) | (b << BLOCK_BITS) | self._block(prints, b)
            first, last = np.searchsorted(self.keys, key), np.searchsorted(self.keys, key, "right")
            count = last - first
            x = np.repeat(np.arange(len(prints)), count)
            i = self.entries[np.repeat(first, count) + np.arange(len(x)) - np.repeat(np.cumsum(count) - count, count)]
            good = np.bitwise_count(prints[x] ^ self.prints[i]) <= NEAR
            both.append(x[good] * len(self.long) + i[good])
        both = np.unique(np.concatenate(both))
        return both // len(self.long), both % len(self.long)

    def _alike(self, marks: np.ndarray, i: int) -> float:
        """Weight of the shingles in common of a run and a whole item over that of all, counted as bags."""
        mine, often = np.unique(marks, return_counts=True)
        theirs, count = self.bags[i]
        _, x, y = np.intersect1d(mine, theirs, assume_unique=True, return_indices=True)
        weight = self.weights(mine)
        common = (weight[x] * np.minimum(often[x], count[y])).sum()
        return float(common / ((weight * often).sum() + self.bag_weights[i] - common))

    @staticmethod
    def _block(prints: np.ndarray, b: int) -> np.ndarray:
        return ((prints >> np.uint64(b * BLOCK_BITS)) & np.uint64((1 << BLOCK_BITS) - 1)).astype(np.int64)

    def candidates(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All (window of the argument, window of an item) whose fingerprints are at most RADIUS bits apart."""
        left, right = [], []
        for b, (order, starts) in enumerate(self.by_block):
            value = self._block(prints, b)
            first = starts[value]
            count = starts[value + 1] - first
            busy = np.nonzero(count)[0]
            if not len(busy):
                continue
            cuts = np.searchsorted(np.cumsum(count[busy]), np.arange(0, count[busy].sum(), 4_000_000)[1:])
            for some in np.split(busy, cuts):
                k = count[some]
                a = np.repeat(some, k)
                i = order[np.repeat(first[some], k) + np.arange(len(a)) - np.repeat(np.cumsum(k) - k, k)]
                near = np.bitwise_count(prints[a] ^ self.windows.prints[i]) <= RADIUS
                left.append(a[near])
                right.append(i[near])
        if not left:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        n = max(1, len(self.windows.at))
        both = np.unique(np.concatenate(left) * n + np.concatenate(right))
        return both // n, both % n

    def weights(self, marks: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.known, marks), max(0, len(self.known) - 1))
        often = np.where(self.known[at] == marks, self.often[at], 0)
        return np.log1p((1 + len(self.windows.at)) / (1 + often))

    def similarity(self, windows: Windows, a: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Weight of the shingles in common over the weight of all shingles of both windows, as sets."""
        out = np.empty(len(a))
        for s in range(0, len(a), _AT_ONCE):
            x, y = windows.shingles_of(a[s : s + _AT_ONCE]), self.windows.shingles_of(i[s : s + _AT_ONCE])
            one_x, one_y = (np.triu((z[:, None, :] == z[:, :, None]), 1).sum(axis=1) == 0 for z in (x, y))
            wx, wy = self.weights(x) * one_x, self.weights(y) * one_y
            common = (wx * (x[:, :, None] == y[:, None, :]).any(axis=2)).sum(axis=1)
            out[s : s + _AT_ONCE] = common / (wx.sum(axis=1) + wy.sum(axis=1) - common)
        return out


def _scan(shared, key: str, text: str) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index: ItemIndex = shared.value
        for batch in batches:
            ids, texts = batch[key].to_pylist(), batch[text].to_pylist()
            rows: list[tuple] = []
            for s in chunks(texts):
                windows = Windows(texts[s])
                a, i = index.candidates(windows.prints)
                exact = windows.whole[a] == index.windows.whole[i]
                score = np.ones(len(a))
                score[~exact] = index.similarity(windows, a[~exact], i[~exact])
                good = np.nonzero(score >= SIMILARITY)[0]
                a, i, exact, score = a[good], i[good], exact[good], score[good]
                doc, item, first = windows.owner[a], index.windows.owner[i], windows.place[a]
                last = first + WINDOW
                if near := index.whole(windows):
                    d, t, f, v = map(np.array, zip(*near))
                    doc, item, first, score = np.append(doc, d), np.append(item, t), np.append(first, f), np.append(score, v)
                    last, exact = np.append(last, f + np.diff(index.windows.offsets)[t]), np.append(exact, np.zeros(len(d), bool))
                if not len(doc):
                    continue
                both, place = np.unique(doc * len(index.ids) + item, return_inverse=True)
                top, hits = np.zeros(len(both)), np.bincount(place)
                np.maximum.at(top, place, score)
                same = np.bincount(place, weights=exact) > 0
                low, high = np.full(len(both), np.iinfo(np.int64).max), np.zeros(len(both), np.int64)
                np.minimum.at(low, place, first)
                np.maximum.at(high, place, last)
                rows += [
                    (ids[s.start + d], index.ids[t], bool(e), float(v), int(h), int(f), int(z))
                    for d, t, e, v, h, f, z in zip((both // len(index.ids)).tolist(), (both % len(index.ids)).tolist(), same, top, hits, low, high)
                ]
            columns = list(zip(*rows)) if rows else [[] for _ in range(7)]
            kinds = (pa.int64(), pa.int64(), pa.bool_(), pa.float64(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["doc_id", "item_id", "verbatim", "similarity", "windows", "first_word", "end_word"])

    return run


def leaks(documents: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """A row for each document and item of which a passage occurs in it, verbatim or almost: of WINDOW words, or the whole item.

    (doc_id, item_id, verbatim, similarity, windows, first_word, end_word): verbatim tells whether WINDOW consecutive
    words are equal, similarity is that of the best window of either size, the places are word numbers in the document.  Null and
    blank texts and those of fewer than WINDOW words have no rows; repeated document rows come once each; empty tables
    give an empty result.
    """
    spark = documents.sparkSession
    items = items.select(F.col(item_key).alias("id"), F.col(item_text).alias("text")).where("text is not null")
    chars = items.agg(F.sum(F.length("text"))).first()[0] or 0
    # Blocks are filled by hash, so they are planned half full.
    blocks = -(-chars // (ITEM_CHARS // 2)) or 1
    scanned = documents.select(F.col(key).alias("doc_id"), F.col(text).alias("text")).where("text is not null")
    found = None
    for b in range(blocks):
        part = items.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == b).toArrow()
        index = ItemIndex(part["id"].to_pylist(), part["text"].to_pylist())
        if b and not len(index.windows.at):
            continue
        one = scanned.mapInArrow(_scan(spark.sparkContext.broadcast(index), "doc_id", "text"), "doc_id bigint, item_id bigint, verbatim boolean, similarity double, windows bigint, first_word bigint, end_word bigint")
        found = one if found is None else found.unionByName(one)
    return found


def leaked_items(documents: DataFrame, items: DataFrame) -> DataFrame:
    """For each item that leaked: documents with it, documents with a verbatim passage, and the best similarity."""
    return leaks(documents, items).groupBy("item_id").agg(
        F.countDistinct("doc_id").alias("documents"), F.countDistinct(F.when(F.col("verbatim"), F.col("doc_id"))).alias("verbatim_documents"), F.max("similarity").alias("best_similarity")
    )


def near_passages(documents: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id, similarity, first_word, end_word) of passages that are almost an item, with no WINDOW words in a row equal."""
    return leaks(documents, items).where("not verbatim").groupBy("doc_id", "item_id").agg(F.max("similarity").alias("similarity"), F.min("first_word").alias("first_word"), F.max("end_word").alias("end_word"))
