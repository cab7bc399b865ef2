"""Splits that keep related records together.

Documents tied by an author or a case file form groups (connected components by alternating large-star and small-star
rounds, each round's edges written to the shared folder).  The groups' weights are balanced by largest differencing
into many equal bins: every task differences a bounded number of groups into one vector of bins, the vectors are
differenced with each other, and whole bins go to the split that lacks most of its share.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docframe.functions.text import fold, unaccent
from docframe.plans.lineage import materialise, release

BINS = 200
#: Groups that one task balances.
GROUPS_AT_ONCE = 20_000
#: Vectors of bins that one task differences with each other, and the most splits.
VECTORS_AT_ONCE, MOST_SPLITS = 100, 1000

# Titles before names, and words of fillers that name nobody.
TITLES = "dr dra mp mag ponente magistrado magistrada doctor doctora sr sra".split()
FILLERS = "sin por asignar sala plena nn anonimo desconocido ninguno reservado pendiente".split()


def author_key(author: Column) -> Column:
    """The words of a full name (given name and both surnames) in sorted order; null for fillers and parts of names."""
    plain = F.regexp_replace(F.regexp_replace(fold(author), r"\.", ""), r"[^\p{L}]+", " ")
    words = F.array_sort(F.filter(F.split(F.trim(plain), " +"), lambda w: (w != "") & ~w.isin(TITLES)))
    return F.when((F.size(words) >= 3) & ~F.arrays_overlap(words, F.array(*map(F.lit, FILLERS))), F.array_join(words, " "))


def case_keys(case_files: Column) -> Column:
    """The case files named in a text: a letter D, T or E and a number, without leading zeros."""
    found = F.regexp_extract_all(F.upper(unaccent(case_files)), F.lit(r"(?<![\p{L}\p{N}])([DTE][^\p{L}\p{N}]{0,3}[0-9]+)"), F.lit(1))
    return F.transform(found, lambda x: F.concat(F.substring(x, 1, 1), F.regexp_replace(F.regexp_replace(x, r"^[^0-9]*", ""), r"^0+(?=[0-9])", "")))


def ties(docs: DataFrame) -> DataFrame:
    """(doc, key): what ties documents together."""
    keys = F.array_union(
        F.array_compact(F.array(F.concat(F.lit("author "), author_key(F.col("author"))))),
        F.coalesce(F.transform(case_keys(F.col("case_files")), lambda c: F.concat(F.lit("case "), c)), F.array().cast("array<string>")),
    )
    return docs.select(F.col("id").alias("doc"), F.explode(keys).alias("key")).where("doc is not null").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component): each node of the edges (u, v) with the smallest node it is connected to."""
    edges = materialise(edges.where("u <> v").select("u", "v").distinct(), "p1_edges")
    seen = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        low = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(low, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))).alias("e")).select("e.*")
        after = materialise(small.where("u <> v").distinct(), "p1_edges")
        state = after.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        release(edges)
        edges = after
        if state == seen:
            break
        seen = state
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()


def groups(docs: DataFrame) -> DataFrame:
    """(doc_id, component) of every id in docs; an id tied to none is its own component.

    Repeated ids take part with all their rows; null ids are left out; an empty table gives no rows.
    """
    tied = materialise(ties(docs), "p1_ties")
    hubs = tied.groupBy("key").agg(F.min("doc").alias("hub"))
    found = components(tied.join(hubs, "key").select(F.col("doc").alias("u"), F.col("hub").alias("v")))
    ids = docs.select(F.col("id").alias("node")).where("node is not null").distinct()
    return ids.join(found, "node", "left").select(F.col("node").alias("doc_id"), F.coalesce("component", "node").alias("component"))


def tied_groups(docs: DataFrame, paragraphs: DataFrame) -> DataFrame:
    """(doc_id, group_id) of the ids in both tables whose group has at least two such ids; group_id is the smallest.

    Documents that only one table knows still tie others together; null ids have no rows; an empty table gives none.
    """
    both = groups(docs).join(paragraphs.select("doc_id").distinct(), "doc_id", "left_semi")
    both = materialise(both, "p1_both")
    sizes = both.groupBy("component").agg(F.min("doc_id").alias("group_id"), F.count("*").alias("n")).where("n > 1")
    return both.join(sizes, "component").select("doc_id", "group_id")


def difference(weights: np.ndarray, bins: int) -> np.ndarray:
    """Largest differencing: the bin of each weight, the bins in falling order of their sums.

    Partial solutions are vectors of bin sums; the two with the largest spreads are combined, the fullest bins of one
    with the emptiest of the other, until one is left.
    """
    heap: list[tuple] = [(-float(w), k, None, None) for k, w in enumerate(weights)]
    heapq.heapify(heap)

    def opened(entry: tuple) -> tuple[np.ndarray, list[list[int]]]:
        spread, k, sums, slots = entry
        if sums is None:
            sums = np.zeros(bins)
            sums[0] = -spread
            slots = [[k], *([] for _ in range(bins - 1))]
        return sums, slots

    while len(heap) > 1:
        one, other = heapq.heappop(heap), heapq.heappop(heap)
        (x, p), (y, q) = opened(one), opened(other)
        total = x + y[::-1]
        new = np.argsort(-total, kind="stable")
        slots = [p[i] + q[-1 - i] if p[i] and q[-1 - i] else p[i] or q[-1 - i] for i in new.tolist()]
        total = total[new]
        heapq.heappush(heap, (-float(total[0] - total[-1]), one[1], total, slots))
    out = np.zeros(len(weights), np.int64)
    if heap:
        for b, members in enumerate(opened(heap[0])[1]):
            out[members] = b
    return out


def _balance(key: tuple, table: pd.DataFrame) -> pd.DataFrame:
    table = table.sort_values(["weight", "component"], ascending=[False, True])
    bins = difference(table["weight"].to_numpy(float), BINS)
    return pd.DataFrame({"part": key[0], "component": table["component"], "weight": table["weight"], "slot": bins})


def _fold(key: tuple, table: pd.DataFrame) -> pd.DataFrame:
    """(part, slot, upper, place): the place of each bin of some parts in the vector that they are differenced into."""
    vectors = table.pivot(index="part", columns="slot", values="weight").reindex(columns=range(BINS)).fillna(0)
    values, total, out = vectors.to_numpy(float), np.zeros(BINS), []
    for k in np.argsort(-(values.max(axis=1) - values.min(axis=1)), kind="stable"):
        place = np.empty(BINS, int)
        place[np.argsort(-values[k], kind="stable")] = np.argsort(total, kind="stable")
        np.add.at(total, place, values[k])
        out.append(pd.DataFrame({"part": vectors.index[k], "slot": range(BINS), "upper": key[0], "place": place}))
    return pd.concat(out)


def _bins_to_splits(sums: DataFrame, parts: int, shares: dict[str, float]) -> DataFrame:
    """(part, slot, split) of sums (part, slot, weight): the parts' vectors are folded in a tree of tasks to one, whose bins alone come to the driver."""
    spark = sums.sparkSession
    maps = []
    while True:
        # At least one fold, so that a single part is handled like many.
        upper = sums.withColumn("upper", F.floor(F.col("part") / VECTORS_AT_ONCE).cast("int"))
        maps.append(materialise(upper.groupBy("upper").applyInPandas(_fold, "part int, slot int, upper int, place int"), "p1_fold"))
        folded = maps[-1].join(sums, ["part", "slot"], "left").groupBy(F.col("upper").alias("part"), F.col("place").alias("slot")).agg(F.coalesce(F.sum("weight"), F.lit(0)).cast("bigint").alias("weight"))
        sums = materialise(folded, "p1_sums")
        parts = -(-parts // VECTORS_AT_ONCE)
        if parts <= 1:
            break
    top = np.zeros(BINS)
    for r in sums.where("part = 0").collect():
        top[r["slot"]] = r["weight"]
    splits = _allocate(top, shares) if shares else [""] * BINS
    lookup = spark.createDataFrame([(0, k, s) for k, s in enumerate(splits)], "upper int, place int, split string")
    for fold in reversed(maps):
        lookup = fold.join(lookup, ["upper", "place"]).select("part", "slot", "split").withColumnsRenamed({"part": "upper", "slot": "place"})
    return lookup.withColumnsRenamed({"upper": "part", "place": "slot"})


def _allocate(sums: np.ndarray, shares: dict[str, float]) -> list[str]:
    """Whole bins, fullest first, to the split that lacks most."""
    lack = {s: share * sums.sum() for s, share in shares.items()}
    out = [""] * len(sums)
    for b in np.argsort(-sums, kind="stable"):
        split = max(lack, key=lambda s: (lack[s], s))
        out[b] = split
        lack[split] -= sums[b]
    return out


def assign_splits(docs: DataFrame, paragraphs: DataFrame, targets: DataFrame) -> DataFrame:
    """(doc_id, component, paragraphs, split) of every doc_id of the paragraphs; tied ones share their split.

    Ids that docs does not know, and null ids taken together, are groups of their own.  With one group over a split's
    whole share, that split gets more than its share; the rest is balanced around it.
    """
    listed = targets.where("split is not null and share > 0").limit(MOST_SPLITS + 1).collect()
    if len(listed) > MOST_SPLITS:
        raise ValueError(f"over {MOST_SPLITS} splits")
    shares = {r["split"]: float(r["share"]) for r in listed}
    sizes = paragraphs.groupBy("doc_id").agg(F.count("*").alias("paragraphs"))
    tied = groups(docs)
    rows = sizes.join(tied, "doc_id", "left").select("doc_id", F.coalesce("component", "doc_id").alias("component"), "paragraphs")
    rows = materialise(rows, "p1_rows")
    weights = materialise(rows.groupBy("component").agg(F.sum("paragraphs").alias("weight")), "p1_weights")
    parts = weights.count() // GROUPS_AT_ONCE + 1
    slots = weights.withColumn("part", F.pmod(F.xxhash64("component"), F.lit(parts)).cast("int")).groupBy("part").applyInPandas(_balance, "part int, component bigint, weight bigint, slot int")
    slots = materialise(slots, "p1_slots")
    lookup = _bins_to_splits(slots.groupBy("part", "slot").agg(F.sum("weight").alias("weight")), parts, shares)
    by_group = slots.join(lookup, ["part", "slot"]).select("component", "split")
    return rows.join(by_group, rows["component"].eqNullSafe(by_group["component"])).select("doc_id", rows["component"], "paragraphs", "split")
