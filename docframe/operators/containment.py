"""Which texts stand in which longer ones, by hashes of substrings.

Each text has an anchor, its first 2**k characters (the greatest power of two that it has).  Hashes of all substrings of
those sizes are looked up among the anchors; where one is found, the substrings of the lengths of the anchor's texts are
looked up among the texts.  The work grows with the characters, not with pairs; what is found is compared as strings.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_SHIFT, _MIX1, _MIX2 = np.uint64(33), np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
#: Characters hashed at a time; a longer text is handled alone.
CHUNK = 100_000


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _SHIFT)) * _MIX1
    h = (h ^ (h >> _SHIFT)) * _MIX2
    return h ^ (h >> _SHIFT)


def _slices(lengths: np.ndarray) -> Iterator[slice]:
    start, total = 0, 0
    for i, n in enumerate(lengths.tolist()):
        if total and total + n > CHUNK:
            yield slice(start, i)
            start, total = i, 0
        total += n
    if start < len(lengths):
        yield slice(start, len(lengths))


class _Substrings:
    """Hashes of the substrings of some texts laid end to end."""

    def __init__(self, texts: list[str], lengths: np.ndarray):
        codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1)
        self.size = len(codes)
        up = np.full(self.size, _BASE, np.uint64)
        self.down = np.full(self.size, _INVERSE, np.uint64)
        up[:1] = self.down[:1] = 1
        np.multiply.accumulate(up, out=up)
        np.multiply.accumulate(self.down, out=self.down)
        self.sums = np.zeros(self.size + 1, np.uint64)
        np.cumsum(codes * up, out=self.sums[1:])
        self.ends = np.cumsum(lengths)

    def hash(self, at: np.ndarray, length, salt) -> np.ndarray:
        return ((self.sums[at + length] - self.sums[at]) * self.down[at] + salt) * _MIX1

    def all(self, length: int, salts: np.ndarray) -> np.ndarray:
        """The hashes of that length at every place with so many characters, with the salts of the places."""
        h = self.sums[length:] - self.sums[: len(self.sums) - length]
        h *= self.down[: len(h)]
        h += salts[: len(h)]
        h *= _MIX1
        return h


def _salt(documents: np.ndarray, length) -> np.ndarray:
    return _mix(documents + np.asarray(length).astype(np.uint64) * np.uint64(_BASE))


class _Known:
    """Distinct hashes, and the number of each that is asked for."""

    def __init__(self, hashes: np.ndarray):
        self.hashes = hashes
        self.bits = max(16, len(hashes).bit_length() + 4)
        self.some = np.zeros(1 << self.bits, bool)
        self.some[(hashes >> np.uint64(64 - self.bits)).astype(np.int64)] = True

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(which of h are known, their numbers)."""
        which = np.nonzero(self.some[(h >> np.uint64(64 - self.bits)).astype(np.int64)])[0]
        number = np.minimum(np.searchsorted(self.hashes, h[which]), len(self.hashes) - 1)
        good = self.hashes[number] == h[which]
        return which[good], number[good]


def _repeated(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each index as often as its count says, and which of its times it is."""
    index = np.repeat(np.arange(len(counts)), counts)
    return index, np.arange(len(index)) - np.repeat(np.cumsum(counts) - counts, counts)


def count(left: pa.Table, right: pa.Table) -> pa.Table:
    """(document, text_id, n, section) of the texts (left) that bodies (right) of their document contain.

    n is 1 or, for any greater number, 2; the section is that of the first body found.
    """
    out = pa.schema([left.schema.field("document"), left.schema.field("text_id"), ("n", pa.int32()), right.schema.field("section")])
    if not len(left) or not len(right):
        return out.empty_table()
    numbers: dict = {}
    row = np.array([numbers.setdefault(key, len(numbers)) for key in zip(left["document"].to_pylist(), left["text"].to_pylist())])
    documents: dict = {}
    texts, text_doc = [t for _, t in numbers], np.array([documents.setdefault(d, len(documents)) for d, _ in numbers], np.uint64)
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    power = np.frexp(lengths)[1] - 1
    anchors, whole = np.empty(len(texts), np.uint64), np.empty(len(texts), np.uint64)
    for s in _slices(lengths):
        sub = _Substrings(texts[s], lengths[s])
        at, size = sub.ends - lengths[s], 1 << power[s].astype(np.int64)
        anchors[s] = sub.hash(at, size, _salt(text_doc[s], size))
        whole[s] = sub.hash(at, lengths[s], _salt(text_doc[s], lengths[s]))
    # For each anchor the lengths of its texts; for each hash of a whole text the texts (one, but for collisions).
    order = np.lexsort((lengths, anchors))
    fresh = np.ones(len(order), bool)
    fresh[1:] = (anchors[order][1:] != anchors[order][:-1]) | (lengths[order][1:] != lengths[order][:-1])
    hashes, first, many = np.unique(anchors[order][fresh], return_index=True, return_counts=True)
    known, their = _Known(hashes), lengths[order][fresh]
    by_hash = np.argsort(whole, kind="stable")
    hashes, begin, texts_of = np.unique(whole[by_hash], return_index=True, return_counts=True)
    full, sizes = _Known(hashes), 1 << np.unique(power).astype(np.int64)

    bodies = right["body"].to_pylist()
    body_doc = np.array([documents.get(d, -1) for d in right["document"].to_pylist()])
    use = np.nonzero(body_doc >= 0)[0]
    bodies, body_doc, n_body = [bodies[i] for i in use], body_doc[use].astype(np.uint64), np.array([len(bodies[i]) for i in use], np.int64)
    found, place = np.zeros(len(texts), np.int32), np.full(len(texts), -1)
    for s in _slices(n_body):
        sub = _Substrings(bodies[s], n_body[s])
        owner = np.repeat(np.arange(s.start, s.stop), n_body[s])
        end = np.repeat(sub.ends, n_body[s])
        pairs = []
        for size in sizes[sizes <= sub.size].tolist():
            at, number = known.find(sub.all(size, np.repeat(_salt(body_doc[s], size), n_body[s])))
            again, turn = _repeated(many[number])
            at, length = at[again], their[first[number][again] + turn]
            good = at + length <= end[at]
            at, length = at[good], length[good]
            which, number = full.find(sub.hash(at, length, _salt(body_doc[owner[at]], length)))
            again, turn = _repeated(texts_of[number])
            pairs.append(np.unique(by_hash[begin[number][again] + turn] * len(bodies) + owner[at[which]][again]))
        for pair in np.concatenate(pairs).tolist() if pairs else ():
            text, body = divmod(pair, len(bodies))
            if found[text] < 2 and texts[text] in bodies[body] and text_doc[text] == body_doc[body]:
                found[text] += 1
                place[text] = body
    rows = np.nonzero(found[row])[0]
    sections = right["section"].take(pa.array(use[place[row[rows]]]))
    mine = left.take(pa.array(rows))
    return pa.table([mine["document"], mine["text_id"], pa.array(found[row[rows]]), sections], schema=out)
