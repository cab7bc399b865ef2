"""Each operator against brute force or an exact round trip, with nulls, blanks, ties, repeats, empty tables and clashing columns."""

import difflib
import random
import unicodedata
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from docframe.llm import langid, leakage, overlap, packing, pieces, quota, spans, splits
from docframe.llm.words import word_hashes, words_of

WORDS = [f"{a}{b}" for a in "ba ce di fo gu la me ni po ru sa te".split() for b in "ban cer dil fon gur lam men nip por rus".split()]


def text(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def edited(rng, t, share):
    out = []
    for w in t.split():
        x = rng.random()
        if x < share / 3:
            continue
        out.append(rng.choice(WORDS) if x < 2 * share / 3 else w)
        if 2 * share / 3 <= x < share:
            out.append(rng.choice(WORDS))
    return " ".join(out)


# --- p1 -----------------------------------------------------------------------------------------------------------
DOCS = "id bigint, author string, case_files string, doc int, key string"


def test_author_and_case_keys(spark):
    rows = [("Dr. Ana Pérez-Gil",), ("PEREZ GIL, ANA",), ("M.P. ana  Pérez Gil",), ("sin ponente",), ("Sala Plena",), ("N.N.",), ("",), (None,), ("Ana Pérez",)]
    got = [r[0] for r in spark.createDataFrame(rows, "a string").select(splits.author_key(F.col("a"))).collect()]
    assert got == ["ana gil perez"] * 3 + [None] * 6
    rows = [("exp. No. D-0042 y T–7",), ("expediente E 1007",), ("d42",), ("",), (None,), ("TED-5",)]
    got = [r[0] for r in spark.createDataFrame(rows, "c string").select(splits.case_keys(F.col("c"))).collect()]
    assert got == [["D42", "T7"], ["E1007"], ["D42"], [], None, []]


def test_groups_carry_over_a_chain_and_a_hub(spark):
    chain = [(k, None, f"D-{k} T-{k + 1}".replace("T", "D"), 0, "x") for k in range(40)]
    hub = [(k, "Ana Gil Paz", None, 0, "x") for k in range(100, 300)]
    alone = [(500, None, None, 0, None), (501, "sin ponente", "", 0, None), (None, "Ana Gil Paz", None, 0, None), (0, None, None, 0, None)]
    docs = spark.createDataFrame(chain + hub + alone, DOCS)
    got = {r["doc_id"]: r["component"] for r in splits.groups(docs).collect()}
    assert {got[k] for k in range(40)} == {0} and {got[k] for k in range(100, 300)} == {100}
    assert got[500] == 500 and got[501] == 501 and None not in got
    paragraphs = spark.createDataFrame([(k,) for k in [3, 4, 100, 500, 501, 999]], "doc_id bigint")
    found = {(r["doc_id"], r["group_id"]) for r in splits.tied_groups(docs, paragraphs).collect()}
    assert found == {(3, 3), (4, 3)}


def test_splits_keep_groups_and_shares(spark):
    rng = random.Random(1)
    docs = spark.createDataFrame([(k, f"Ana Gil P{'abcdefghij'[k % 10]}{'abcdefghij'[k // 10 % 10]}z" if k % 3 else None, None, 0, "x") for k in range(300)], DOCS)
    paragraphs = spark.createDataFrame([(k,) for k in range(310) for _ in range(rng.randint(1, 9))] + [(None,)], "doc_id bigint")
    targets = spark.createDataFrame([("train", 0.7), ("val", 0.2), ("test", 0.1)], "split string, share double")
    rows = splits.assign_splits(docs, paragraphs, targets).collect()
    assert len(rows) == 311
    by_group: dict = {}
    for r in rows:
        by_group.setdefault(r["component"], set()).add(r["split"])
    assert all(len(s) == 1 for s in by_group.values())
    total = sum(r["paragraphs"] for r in rows)
    for split, share in (("train", 0.7), ("val", 0.2), ("test", 0.1)):
        assert abs(sum(r["paragraphs"] for r in rows if r["split"] == split) / total - share) < 0.02


def test_splits_of_many_parts(spark, monkeypatch):
    """Parts folded in a tree of several levels keep the shares as one heap does."""
    monkeypatch.setattr(splits, "GROUPS_AT_ONCE", 40)
    rng = np.random.default_rng(5)
    weights = (rng.pareto(2, 3000) * 3 + 1).astype(int)
    sums = []
    for part in range(75):
        w = weights[part::75]
        sums += [(part, b, int(x)) for b, x in enumerate(np.bincount(splits.difference(w.astype(float), splits.BINS), w, splits.BINS)) if x]
    monkeypatch.setattr(splits, "VECTORS_AT_ONCE", 4)
    shares = {"train": 0.7, "val": 0.2, "test": 0.1}
    df = spark.createDataFrame(sums, "part int, slot int, weight bigint")
    got = {(r["part"], r["slot"]): r["split"] for r in splits._bins_to_splits(df, 75, shares).collect()}
    total = sum(x for *_, x in sums)
    for split, share in shares.items():
        assert abs(sum(x for p, b, x in sums if got[p, b] == split) / total - share) < 0.005


def test_splits_of_nothing(spark):
    docs, paragraphs = spark.createDataFrame([], DOCS), spark.createDataFrame([], "doc_id bigint")
    targets = spark.createDataFrame([("train", 1.0)], "split string, share double")
    assert splits.tied_groups(docs, paragraphs).count() == 0
    assert splits.assign_splits(docs, paragraphs, targets).count() == 0


def test_differencing_is_balanced():
    w = np.random.default_rng(0).pareto(2, 5000) + 1
    bins = splits.difference(w, 20)
    sums = np.bincount(bins, w, 20)
    assert sums.max() - sums.min() < 0.01 * sums.mean()
    assert len(splits.difference(np.array([]), 5)) == 0


# --- p2 -----------------------------------------------------------------------------------------------------------
@pytest.mark.parametrize("seed", range(4))
def test_pieces_cover_and_overlap(seed):
    rng = random.Random(seed)
    t = "".join(rng.choice(["palabra ", "fin. ", "\n", "\n\n", "x" * 50, "¿sí? ", "é", "</paragraph>"]) for _ in range(600))
    got = pieces.cut(t, 300, 40)
    assert got[0][0] == 0 and got[-1][1] == len(t)
    for (a, b), (c, d) in zip(got, got[1:]):
        assert b - a <= 300 and a < c <= b and b - c <= 40 and d > b
    whole, end = "", 0
    for a, b in got:
        whole += t[end:b]
        end = b
    assert whole == t
    assert all(not unicodedata.combining(t[b]) for _, b in got[:-1])


def test_pieces_prefer_paragraphs_and_cut_hard():
    t = "a" * 900 + "\n\n" + "b" * 300 + ". " + "c" * 700
    assert pieces.cut(t, 1500, 200)[0] == (0, 902)
    assert [b - a for a, b in pieces.cut("z" * 4000, 1500, 200)] == [1500, 1500, 1400]
    with pytest.raises(ValueError):
        pieces.cut("a", 10, 10)


def test_pieces_of_odd_rows(spark):
    rows = [(1, None, "k"), (2, "", "k"), (3, "x" * 1500, "k"), (4, "x" * 1501, "k"), (4, "x" * 1501, "k"), (None, "y" * 1600, None)]
    df = spark.createDataFrame(rows, "record_id bigint, input string, piece string")
    got = pieces.split_oversized(df).groupBy("record_id").count().collect()
    assert {r["record_id"]: r["count"] for r in got} == {4: 4, None: 2}
    assert pieces.split_oversized(df, keep_short=True).where("record_id in (2, 3)").count() == 2
    assert pieces.split_oversized(df.limit(0)).count() == 0


# --- p3 -----------------------------------------------------------------------------------------------------------
STYLES = "id bigint, document bigint, paragraph_id int, paragraph_pos int, text_type string, text string, cls string, h int"


def test_cover_has_every_difference():
    assert {(a - b) % spans.PERIOD for a in spans.COVER for b in spans.COVER} == set(range(spans.PERIOD))


def brute_spans(rows):
    pairs, covered = set(), {}
    for (i, a), (j, b) in combinations([(r[:4], r[5]) for r in rows if r[5]], 2):
        if i[1:] == j[1:]:
            continue
        windows = {b[k : k + 160] for k in range(len(b) - 159)}
        if any(a[k : k + 160] in windows for k in range(len(a) - 159)):
            pairs.add((min(i[0], j[0]), max(i[0], j[0])))
        for x, y, own in ((a, windows, i[0]), (b, {a[k : k + 160] for k in range(len(a) - 159)}, j[0])):
            for k in range(len(x) - 159):
                if x[k : k + 160] in y:
                    covered.setdefault(own, set()).update(range(k, k + 160))
    return pairs, {k: len(v) for k, v in covered.items()}


@pytest.mark.parametrize("seed", range(2))
def test_spans_against_brute_force(spark, seed):
    rng = random.Random(seed)
    passages = [text(rng, 60)[:n] for n in (159, 160, 161, 250, 300)]
    rows = []
    for k in range(60):
        p = rng.choice(passages)
        t = text(rng, rng.randint(0, 20)) + p + text(rng, rng.randint(0, 20)) if k % 2 else text(rng, rng.randint(1, 60))
        rows.append((k, k // 3, 0, k % 3, "plain", t, "c", 1))
    rows += [(100, 0, 0, 1, "plain", rows[1][5], "c", 1), (101, 50, 0, 0, None, rows[1][5], "c", 1), (102, 60, 0, 0, "plain", None, "c", 1), (103, 61, 0, 0, "plain", "", "c", 1), (104, 50, 0, 0, "q", rows[1][5] + "x", None, 1)]
    df = spark.createDataFrame(rows, STYLES)
    pairs, covered = brute_spans(rows)
    found = [(r["id_a"], r["id_b"]) for r in spans.shared_pairs(df).collect()]
    assert len(found) == len(set(found)) and set(found) == pairs
    got = {r["id"]: r["shared"] for r in spans.shared_lengths(df).collect()}
    assert {k: v for k, v in got.items() if v} == covered and len(got) == len(rows)
    assert spans.shared_pairs(df.limit(0)).count() == 0 and spans.shared_by_type(df).count() > 0


# --- p4 -----------------------------------------------------------------------------------------------------------
RECORDS = "record_id bigint, input string, split string, source string, n int, cls bigint"


def brute_overlaps(rows):
    out = set()
    words = {r[0]: words_of(r[1]) for r in rows}
    for a in rows:
        for b in rows:
            if (a[2] or "").strip().lower() == "train" and (b[2] or "").strip().lower() in ("val", "test") and words[a[0]] and words[b[0]]:
                x, y = words[a[0]], words[b[0]]
                if overlap.common_words(x, y) >= overlap.need(max(len(x), len(y))):
                    out.add((min(a[0], b[0]), max(a[0], b[0])))
    return out


def test_common_words():
    assert overlap.common_words(list("abcde"), list("xaybzcde")) == 5
    assert overlap.common_words([], list("ab")) == 0 and overlap.common_words(list("ab"), list("ba")) == 1


@pytest.mark.parametrize("seed", range(2))
def test_overlaps_against_brute_force(spark, seed):
    rng = random.Random(seed)
    rows, k = [], 0
    for _ in range(70):
        t = text(rng, rng.choice([1, 3, 4, 5, 6, 9, 12, 18, 30, 60, 150]))
        for _ in range(rng.randint(1, 3)):
            rows.append((k, edited(rng, t, rng.choice([0, 0.05, 0.1])) or "uno", rng.choice(["train", "Train ", "val", " TEST", None, "dev"]), rng.choice(["a", None]), 1, 2))
            k += 1
    rows += [(900, None, "val", "a", 1, 2), (901, "<p></p>", "test", "a", 1, 2), (902, " ", "train", "a", 1, 2), (903, rows[0][1].upper() + "!", "val", "a", 1, 2), (904, rows[0][1], "train", "a", 1, 2)]
    df = spark.createDataFrame(rows, RECORDS)
    found = [(r["record_id_a"], r["record_id_b"]) for r in overlap.overlaps(df).collect()]
    true = brute_overlaps(rows)
    assert len(found) == len(set(found)) and set(found) == true
    report = overlap.overlap_report(df).collect()
    assert sum(r["pairs"] for r in report) == len(true)
    assert sum(r["records"] for r in report) == sum((r[2] or "").strip().lower() in ("val", "test") for r in rows)


def test_overlaps_of_a_large_group_of_near_copies(spark):
    rng = random.Random(5)
    base = text(rng, 80)
    rows = [(k, edited(rng, base, 0.03), "train" if k % 2 else "val", "a", 1, 2) for k in range(120)]
    df = spark.createDataFrame(rows, RECORDS)
    assert {(r[0], r[1]) for r in overlap.overlaps(df).collect()} == brute_overlaps(rows)
    assert overlap.overlaps(df.limit(0)).count() == 0


def test_overlaps_found_by_a_common_shingle_alone(spark):
    rng = random.Random(11)
    head, tail = text(rng, 10).split(), text(rng, 5).split()
    rows = [(k, " ".join([*head, *text(rng, 35).split(), *tail]), "val", "a", 1, 2) for k in range(40)]
    for k, kept in enumerate((0, 5, 45)):
        w = rows[k][1].split()
        for at in range(0, 50, 5):
            if at != kept:
                w[at + 2] = f"otra{k}"
        rows.append((100 + k, " ".join(w), "train", "a", 1, 2))
    df = spark.createDataFrame(rows, RECORDS)
    true = brute_overlaps(rows)
    assert {(k, 100 + k) for k in range(3)} <= true
    assert {(r["record_id_a"], r["record_id_b"]) for r in overlap.overlaps(df).collect()} == true
    assert sum(r["pairs"] for r in overlap.overlap_report(df).collect()) == len(true)


@pytest.mark.parametrize("edit", ["every fifth replaced", "every fifth left out", "one in four added"])
def test_overlaps_with_evenly_spread_edits(spark, edit):
    rng = random.Random(6)
    rows, k = [], 0
    for n in [20, 22, 25, 29, 31, 40, 50, 64, 100, 200, 333, 1000]:
        for shift in range(4):
            w = text(rng, n).split()
            if edit == "every fifth replaced":
                v = [f"otra{k}" if i % 5 == shift else x for i, x in enumerate(w)]
            elif edit == "every fifth left out":
                v = [x for i, x in enumerate(w) if i % 5 != shift or i >= 5 * (n // 5)]
            else:
                v = [y for i, x in enumerate(w) for y in ([f"mas{i}", x] if i % 4 == shift and i // 4 < n // 4 else [x])]
            rows += [(k, " ".join(w), "val", "a", 1, 2), (k + 1, " ".join(v), "train", "a", 1, 2)]
            k += 2
    true = {(i, i + 1) for i in range(0, k, 2) if overlap.common_words(words_of(rows[i][1]), words_of(rows[i + 1][1])) >= overlap.need(max(len(rows[i][1].split()), len(rows[i + 1][1].split())))}
    assert len(true) > k // 3
    assert {(r[0], r[1]) for r in overlap.overlaps(spark.createDataFrame(rows, RECORDS)).collect()} == true


def test_overlaps_of_texts_that_repeat_themselves(spark):
    rng = random.Random(8)
    base = ["no " * 3000, "la ley dice " * 500, text(rng, 30) + " eco" * 900]
    rows = [(k, base[k % 3] + " " + text(rng, k % 5), "train" if k < 6 else "val", "a", 1, 2) for k in range(12)]
    assert {(r[0], r[1]) for r in overlap.overlaps(spark.createDataFrame(rows, RECORDS)).collect()} == brute_overlaps(rows)


@pytest.mark.parametrize("vocabulary", [120, 12])
def test_overlaps_with_words_left_out_and_others_added_elsewhere(spark, vocabulary):
    """A fifth of the words of either side is on its own, never at one place: no run of three words is left."""
    rng = random.Random(9)
    rows, k, own = [], 0, set()
    for n in [20, 23, 25, 30, 40, 43, 44, 55, 64, 90, 100, 135, 160, 190, 195, 196, 200, 240, 333, 1000]:
        for shift in range(3):
            w = [rng.choice(WORDS[:vocabulary]) for _ in range(n)]
            left, more = n // 5, n // 5
            v = []
            for i, x in enumerate(w):
                if i % 5 == (shift + 2) % 5 and more:
                    v.append(rng.choice(WORDS[:vocabulary]) if vocabulary < 50 else f"mas{i}")
                    more -= 1
                if i % 5 == shift and left:
                    left -= 1
                else:
                    v.append(x)
            rows += [(k, " ".join(w), "val" if shift else "train", "a", 1, 2), (k + 1, " ".join(v), "train" if shift else "test", "a", 1, 2)]
            own.add((k, k + 1))
            k += 2
    true = brute_overlaps(rows)
    assert len(true & own) == len(own)
    assert {(r[0], r[1]) for r in overlap.overlaps(spark.createDataFrame(rows, RECORDS)).collect()} == true


def test_records_of_common_words_meet_in_groups_and_others_seldom():
    rng = random.Random(12)
    common = [f"voz{k}" for k in range(120)]
    e = [[x for _ in range(9) for x in (*rng.sample(common, 8), f"nombre{rng.randrange(10**9)}")] for _ in range(60)]
    t = [[f"otro{i}" if x.startswith("nombre") else x for i, x in enumerate(w)] for w in e]
    (he, oe), (ht, ot) = (word_hashes([" ".join(w) for w in side]) for side in (e, t))
    ranks = np.zeros(1 << overlap.SKETCH_BITS, np.uint16)
    cells = (overlap.shingles(word_hashes([" ".join(common)])[0], 1) & np.uint64(len(ranks) - 1)).astype(np.int64)
    ranks[cells] = np.arange(1, len(common) + 1)
    keys = [[{*()} for _ in e] for _ in "et"]
    for side, h, o in ((0, he, oe), (1, ht, ot)):
        for who, key, _ in overlap._grouped(h, o, np.ones(len(e), bool), (ranks > 0, ranks), side == 0):
            for i, k in zip(who.tolist(), key.tolist()):
                keys[side][i].add(k)
    met = {(i, j) for i, a in enumerate(keys[0]) for j, b in enumerate(keys[1]) if a & b}
    assert {(i, i) for i in range(len(e))} <= met and len(met) < len(e) ** 2 // 10


# --- p5 -----------------------------------------------------------------------------------------------------------
OUTPUTS = "record_id bigint, output string, label string, signature string"
TARGETS = "label string, share double, min_rows int"


def test_quota(spark):
    rows = [(k, ["Decisión.", " decision ", "DECISIÓN", "pruebas", "N/A", None, ""][k % 7], "x", "y") for k in range(700)] + [(900, "firmas", "x", "y")]
    df = spark.createDataFrame(rows, OUTPUTS)
    targets = spark.createDataFrame([("decisión", 0.5, 3), ("pruebas", 0.45, 3), ("firmas", 0.05, 3), ("nada", 0.0, 0)], TARGETS)
    got = {r["label"]: r for r in quota.coverage(df, targets).collect()}
    assert got["decisión"]["available"] == 300 and got["decisión"]["met"] and got["pruebas"]["met"] and got["nada"]["met"]
    assert not got["firmas"]["met"] and got["firmas"]["taken"] == 1
    rows = quota.sample(df, targets).collect()
    assert len(rows) == 70 and len({r["id"] for r in rows}) == 70
    count = {s: sum(r["signature"] == s for r in rows) for s in ("decision", "pruebas", "firmas", None)}
    # The rows that firmas lacks are made up by others, so that no label exceeds its share by more than a row.
    assert count["firmas"] == 1 and count[None] <= 3 and abs(count["decision"] - 35) <= 1 and abs(count["pruebas"] - 31.5) <= 3
    assert quota.sample(df.limit(0), targets).count() == 0
    assert {r["label"] for r in quota.coverage(df.limit(0), targets).where("met").collect()} == {"nada"}


def test_plan_keeps_floors_and_size():
    take = quota.plan({"a": 1000, "b": 5, None: 500}, {"a": (0.5, 3), "b": (0.0, 4)}, 100)
    assert sum(take.values()) == 100 and take["b"] >= 4
    assert quota.plan({}, {"a": (1.0, 3)}, 10) == {}
    assert sum(quota.plan({"a": 4}, {"a": (1.0, 3)}, 10).values()) == 4


def test_plan_of_targets_that_cannot_be_met(spark):
    take = quota.plan({"a": 100, "b": 100}, {"a": (0.5, 30), "b": (0.5, 30)}, 20)
    assert sum(take.values()) == 20 and abs(take["a"] - take["b"]) <= 1
    many = 4 * 10**9
    take = quota.plan({"a": many, "b": many, None: many}, {"a": (0.3, 0), "b": (0.7, 0)}, 10**9, {"a": 333_000_000, "b": 334_000_000, None: 332_000_000})
    assert take == {"a": 300_000_000, "b": 700_000_000, None: 0}
    df = spark.createDataFrame([(k, "abc"[k % 3], "x", "y") for k in range(360)], OUTPUTS)
    targets = spark.createDataFrame([("a", 0.9, 0), ("b", 0.05, 0), ("c", 0.05, 20)], TARGETS)
    got = {r["label"]: r for r in quota.coverage(df, targets).collect()}
    assert sum(r["taken"] for r in got.values()) == 36 and got["c"]["taken"] == 20
    assert not got["a"]["met"] and got["c"]["met"] and got["a"]["available"] > got["a"]["wanted"] > got["a"]["taken"]


# --- p6 -----------------------------------------------------------------------------------------------------------
def test_packing_fits_and_wastes_little():
    rng = np.random.default_rng(2)
    sizes = rng.integers(1, 700, 4000)
    bins = packing.tighten(sizes, packing.sum_of_squares(sizes, 1024), 1024)
    full = np.bincount(bins, sizes)
    assert full.max() <= 1024 and full.min() > 0 and full.sum() / (1024 * len(full)) > 0.98
    none = np.array([], int)
    assert len(packing.tighten(none, packing.sum_of_squares(none))) == 0


def test_containers_of_odd_texts(spark):
    rows = [(1, "a " * 1024, 1), (2, "a " * 1025, 1), (3, None, 1), (4, "", 1), (5, " \n", 1), (6, "b, c", 1), (6, "b, c", 1), (7, "x " * 3000, 1)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, tokens int")
    got = packing.pack(df).collect()
    assert sum(r["tokens"] for r in got if r["doc_id"] == 7) == 3000 and {r["piece"] for r in got if r["doc_id"] == 7} == {0, 1, 2}
    assert sum(r["tokens"] for r in got if r["doc_id"] == 6) == 6
    assert all((r["container"] is None) == (r["tokens"] == 0) for r in got)
    fill: dict = {}
    for r in got:
        fill[r["container"]] = fill.get(r["container"], 0) + r["tokens"]
    assert max(fill.values()) <= 1024
    assert sorted(r[0] for r in packing.oversized(df).collect()) == [2, 7]
    assert packing.pack(df.limit(0)).count() == 0


def test_tokens(spark):
    df = spark.createDataFrame([("Hola, ¿qué_tal? áb",)], "t string")
    assert df.select(packing.token_count(F.col("t"))).first()[0] == 8


# --- p7 -----------------------------------------------------------------------------------------------------------
def test_leaks_against_brute_force(spark):
    rng = random.Random(3)
    items = [(k, text(rng, rng.choice([10, 19, 20, 40, 80])), "d") for k in range(30)] + [(100, None, "d"), (101, "", "d"), (102, "igual", "d")]
    docs = []
    for k in range(120):
        parts = [text(rng, rng.randint(0, 60))]
        w = rng.choice(items[:30])[1].split()
        n = rng.choice([15, 19, 20, 25, 80])
        at = rng.randint(0, max(0, len(w) - n))
        parts.append("<b>" + ", ".join(w[at : at + n]).upper() + "</b>")
        docs.append((k, " ".join(parts + [text(rng, 9)]), "v"))
    docs += [(500, None, "v"), (501, "", "v"), (502, items[3][1], "v"), (502, items[3][1], "v"), (503, " ".join(i[1] or "" for i in items), "v")]
    true = set()
    for d, t, _ in docs:
        w = words_of(t)
        mine = {tuple(w[k : k + 20]) for k in range(len(w) - 19)}
        for i, s, _ in items:
            v = words_of(s)
            if any(tuple(v[k : k + 20]) in mine for k in range(len(v) - 19)):
                true.add((d, i))
    ddf, idf = spark.createDataFrame(docs, "doc_id bigint, text string, item_id string"), spark.createDataFrame(items, "item_id bigint, text string, doc_id string")
    assert {(r["doc_id"], r["item_id"]) for r in leakage.leaks(ddf, idf).where("verbatim").collect()} == true
    assert leakage.leaks(ddf.limit(0), idf).count() == 0 and leakage.leaks(ddf, idf.limit(0)).count() == 0


def test_near_passages_are_verified():
    rng = random.Random(9)
    item = text(rng, 40)
    w = item.split()
    w[39] = "otra"
    index = leakage.ItemIndex([1], [item])
    windows = leakage.Windows([" ".join(w)])
    a, i = index.candidates(windows.prints)
    assert set(zip(a.tolist(), i.tolist())) >= {(k, k) for k in range(20)}
    assert index.similarity(windows, np.array([20]), np.array([20]))[0] < 1


def test_hamming_blocks_miss_nothing():
    rng = np.random.default_rng(1)
    index = leakage.ItemIndex([0], [text(random.Random(2), 300)])
    flips = index.windows.prints.copy()
    for _ in range(3):
        flips ^= np.uint64(1) << rng.integers(0, 64, len(flips)).astype(np.uint64)
    a, i = index.candidates(flips)
    found = set(zip(a.tolist(), i.tolist()))
    near = np.bitwise_count(flips[:, None] ^ index.windows.prints[None, :]) <= 3
    assert found == set(zip(*map(np.ndarray.tolist, np.nonzero(near))))


def bag_similarity(index, a, b):
    x, y = ({m: c for m, c in zip(*np.unique(leakage.shingles(leakage.word_hashes([t])[0], 5), return_counts=True))} for t in (a, b))
    weight = {m: index.weights(np.array([m], np.uint64))[0] for m in x | y}
    total = lambda f: sum(weight[m] * f(x.get(m, 0), y.get(m, 0)) for m in weight)
    return total(min) / total(max)


@pytest.mark.parametrize("edit", ["edge word", "inner word", "one in sixty", "sentence moved", "words left out"])
def test_near_items_are_found(edit):
    """At least nine in ten of the texts whose similarity to an item is 0.8 or more, and none below."""
    rng = random.Random(4)
    items = [text(rng, rng.choice([20, 24, 50, 60, 75, 120, 180, 240])) for _ in range(160)]
    index = leakage.ItemIndex(list(range(len(items))), items)
    true = found = 0
    for k, item in enumerate(items):
        w = item.split()
        if edit == "edge word":
            w[-1] = "otra"
        elif edit == "inner word":
            w[rng.randrange(len(w))] = "otra"
        elif edit == "one in sixty":
            for at in range(30, len(w), 60):
                w[at] = "otra"
        elif edit == "sentence moved":
            w = w[12:18] + w[:12] + w[18:]
        else:
            w = w[: len(w) // 2] + w[len(w) // 2 + 2 :] + ["y", "o"]
        near = " ".join(w)
        rows = index.whole(leakage.Windows([text(rng, 30) + " " + near + " " + text(rng, 30)]))
        assert all(v >= 0.8 for *_, v in rows)
        if bag_similarity(index, item, near) >= 0.8:
            true += 1
            found += any(i == k for _, i, _, _ in rows)
    assert true > 30 and found >= 0.9 * true


# --- p8 -----------------------------------------------------------------------------------------------------------
SAMPLES = {
    "es": "La sentencia fue notificada al demandante por el juzgado de la ciudad. El recurso no prospera porque la norma exige otra cosa. Los hechos de este proceso son claros y la prueba es suficiente para decidir.",
    "en": "The judgment was served upon the claimant by the court of the city. The appeal fails because the statute requires something else. The facts of this case are clear and the evidence is enough to decide.",
    "fr": "Le jugement a été notifié au demandeur par le tribunal de la ville. Le recours échoue parce que la loi exige autre chose. Les faits de cette affaire sont clairs et la preuve suffit pour décider.",
    "pt": "A sentença foi notificada ao autor pelo juízo da cidade. O recurso não procede porque a norma exige outra coisa. Os fatos deste processo são claros e a prova é suficiente para decidir a questão.",
    "it": "La sentenza è stata notificata al ricorrente dal tribunale della città. Il ricorso non riesce perché la legge richiede altro. I fatti di questa causa sono chiari e la prova è sufficiente per decidere.",
    "de": "Das Urteil wurde dem Kläger durch das Gericht der Stadt zugestellt. Die Berufung scheitert, weil das Gesetz etwas anderes verlangt. Die Tatsachen dieses Falles sind klar und der Beweis genügt für die Entscheidung.",
}


@pytest.fixture(scope="module")
def model():
    texts, names = [], []
    rng = random.Random(0)
    for lang, t in SAMPLES.items():
        sentences = t.split(". ")
        for k in range(40):
            rng.shuffle(sentences)
            texts.append(". ".join(sentences))
            names.append(lang if k else "de")
    return langid.fit(texts, names)


def test_labels(spark):
    rows = [("es",), ("es-CO",), ("Español",), ("ENG",), ("français",), ("und",), ("",), (None,), ("Deutsch",), ("pt_BR",), ("zh",)]
    got = [r[0] for r in spark.createDataFrame(rows, "x string").select(langid.label_language(F.col("x"))).collect()]
    assert got == ["es", "es", "es", "en", "fr", None, None, None, "de", "pt", None]


def test_languages_of_documents(spark, model):
    mixed = SAMPLES["es"] + "\n" + SAMPLES["fr"] + "\r\n" + SAMPLES["es"]
    phrase = SAMPLES["es"] + " (stare decisis et non quieta movere)."
    rows = [(1, SAMPLES["es"], "es-CO"), (2, SAMPLES["en"], None), (3, SAMPLES["de"].upper(), "fr"), (4, mixed, "es"), (5, phrase, "es"), (6, None, "es"), (7, "", None), (8, " 12 \n", None), (9, SAMPLES["it"], "und"), (9, SAMPLES["it"], "und")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id bigint, text string, lang string, spoken int")
    found = sorted((r["doc_id"], r["lang"]) for r in langid.wrong_labels(df, model).collect())
    assert found == [(2, "en"), (3, "de"), (4, "es"), (4, "fr"), (9, "it")]
    segments = langid.languages(df, model).where("doc_id = 4").orderBy("segment").collect()
    assert [(r["first_line"], r["end_line"], r["lang"]) for r in segments] == [(0, 1, "es"), (1, 2, "fr"), (2, 3, "es")]
    assert all(0 <= r["confidence"] <= 1 for r in segments)


def test_short_lines_in_another_language(spark, model):
    short = "The court of the city decided it. The claimant was not there."
    rows = [(1, SAMPLES["es"] + "\n" + short + "\n" + SAMPLES["es"]), (2, SAMPLES["es"] + "\nCf. The Register.\n" + SAMPLES["es"]), (3, SAMPLES["es"] + "\n" + SAMPLES["es"])]
    assert 25 < sum(c.isalpha() for c in short) < 80
    df = spark.createDataFrame([(*r, "es") for r in rows], "doc_id bigint, text string, lang string")
    assert sorted((r["doc_id"], r["lang"]) for r in langid.wrong_labels(df, model).collect()) == [(1, "en"), (1, "es")]


def test_no_labels_and_no_rows(spark):
    df = spark.createDataFrame([(1, "un texto sin etiqueta", None)], "doc_id bigint, text string, lang string")
    assert langid.languages(df).count() == 1
    assert langid.wrong_labels(df.limit(0)).count() == 0


def test_difflib_agrees_on_equal_runs():
    a, b = "x" * 5 + "abc" * 60, "y" * 9 + "abc" * 60
    (start, length), = spans._runs(a, b, 4, 160)
    match = difflib.SequenceMatcher(None, a, b, autojunk=False).find_longest_match()
    assert (start, length) == (match.a, match.size)


def test_postings_are_joined_a_slice_at_a_time(spark, monkeypatch):
    """Shuffle files of a fraction of the keys stand beside the postings; every key is in one slice."""
    rows = [(k, " ".join(f"w{k // 2}x{j}" for j in range(40)) + (" more" if k % 2 else ""), "val" if k % 2 else "train", "s", 1, k) for k in range(60)]
    joined, seen = overlap._joined, []
    monkeypatch.setattr(overlap, "_joined", lambda index, probe, k: seen.append((k, index.count(), joined(index, probe, k).count())) or joined(index, probe, k))
    found = {(r["record_id_a"], r["record_id_b"]) for r in overlap.overlaps(spark.createDataFrame(rows, RECORDS)).collect()}
    assert found == {(k, k + 1) for k in range(0, 60, 2)}
    assert [k for k, *_ in seen] == list(range(overlap.SLICES)) and all(0 < n < of for _, of, n in seen)
