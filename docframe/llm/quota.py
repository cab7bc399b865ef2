"""A sample whose categories match target proportions.

Rows are grouped by category signature; only the counts of signatures, whose number the targets bound, come to the
driver.  The counts of a random sample, drawn by hash and brought to the floors and the size, are repaired by
exchanging counts between signatures as long as that lowers the deviation from the targets.  They are then materialised
by the rows' hashes: histograms of the hashes find the bucket in which each signature's last row lies, and only rows
of those buckets are ranked.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from docframe.functions.text import fold
from docframe.plans.lineage import materialise

PART = 0.1
BUCKET_BITS, LEVELS = 12, 2
MOST_LABELS = 100_000


def category(value: Column) -> Column:
    """A category compared without case, accents, outer blanks and a final period."""
    return F.regexp_replace(fold(F.regexp_replace(fold(value), r"\.$", "")), r"^$", "")


def plan(available: dict[str | None, int], targets: dict[str, tuple[float, int]], size: int, start: dict[str | None, int] | None = None) -> dict[str | None, int]:
    """How many rows of each signature to take, ``size`` in all (or as many as there are).

    ``start`` has the counts of a random sample, by default the expected ones.  Floors that together exceed the size are
    cut in proportion, so the sample never grows beyond it.
    """
    names = sorted(available, key=lambda s: (s is None, s or ""))
    if not names:
        return {}
    have = np.array([available[s] for s in names], np.int64)
    size = int(min(size, have.sum()))
    floor = _within(np.array([min(available[s], targets[s][1]) if s in targets else 0 for s in names], np.int64), size)
    goal = np.array([targets[s][0] * size if s in targets else 0.0 for s in names])
    first = np.floor(have * (size / max(1, have.sum()))).astype(np.int64) if start is None else np.array([start.get(s, 0) for s in names], np.int64)
    take = np.clip(first, floor, have)
    # A random sample is a few rows off the size: rows go where most are over, and come where most lack.
    while (off := int(take.sum()) - size) != 0:
        room = take - floor if off > 0 else have - take
        k = int(np.where(room > 0, (take - goal) * np.sign(off), -np.inf).argmax())
        rest = np.delete((take - goal) * np.sign(off), k)[np.delete(room, k) > 0]
        step = int(max(1, (take[k] - goal[k]) * np.sign(off) - rest.max())) if len(rest) else abs(off)
        take[k] -= np.sign(off) * min(step, room[k], abs(off))
    while True:
        over, under = take - goal, goal - take
        give = np.where((take > floor) & (over > 0), over, -np.inf)
        get = np.where((take < have) & (under > 0), under, -np.inf)
        if give.max() == -np.inf or get.max() == -np.inf:
            break
        s, t = int(give.argmax()), int(get.argmax())
        k = int(min(max(1, np.floor(min(over[s], under[t]))), take[s] - floor[s], have[t] - take[t]))
        before = abs(over[s]) + abs(under[t])
        if abs(over[s] - k) + abs(under[t] - k) >= before - 1e-9:
            break
        take[s] -= k
        take[t] += k
    return dict(zip(names, take.tolist()))


def _within(floor: np.ndarray, size: int) -> np.ndarray:
    """Floors cut in proportion where they exceed the size together, by largest remainders."""
    if floor.sum() <= size:
        return floor
    exact = floor * (size / floor.sum())
    out = np.floor(exact).astype(np.int64)
    out[np.argsort(out - exact, kind="stable")[: size - int(out.sum())]] += 1
    return out


def _rows(records: DataFrame, targets: DataFrame, key: str, column: str, part: float, seed: int) -> tuple[DataFrame, dict, dict, dict, int]:
    """Rows (id, signature, h), the targets by signature, and the counts of all rows and of a random sample by signature."""
    listed = targets.where("label is not null").select(category(F.col("label")).alias("name"), "label", "share", "min_rows").limit(MOST_LABELS + 1).collect()
    if len(listed) > MOST_LABELS:
        raise ValueError(f"over {MOST_LABELS} target labels")
    wanted = {r["name"]: (r["label"], float(r["share"] or 0), int(r["min_rows"] or 0)) for r in listed}
    # At most MOST_LABELS short strings, checked above.
    known = F.broadcast(targets.where("label is not null").select(category(F.col("label")).alias("signature")).distinct())
    rows = records.select(F.col(key).alias("id"), category(F.col(column)).alias("name"), F.xxhash64(key, F.lit(seed)).alias("h"))
    rows = rows.join(known, F.col("name") == F.col("signature"), "left").select("id", "signature", "h")
    drawn = F.xxhash64("h", F.lit("draw")).cast("double") < (2 * part - 1) * 2.0**63
    counts = rows.groupBy("signature").agg(F.count("*").alias("n"), F.count(F.when(drawn, 1)).alias("drawn")).collect()
    return rows, wanted, {r["signature"]: r["n"] for r in counts}, {r["signature"]: r["drawn"] for r in counts}, sum(r["n"] for r in counts)


def coverage(records: DataFrame, targets: DataFrame, key: str = "record_id", column: str = "output", part: float = PART) -> DataFrame:
    """(label, share, min_rows, wanted, available, taken, met) of each target label, as written there.

    met tells whether the repaired sample has min_rows of the label and all rows that its share asks for; a share that
    is no whole number of rows may be rounded down, unless there are no more rows.  Null and unknown outputs count for
    the size only; of an empty table only labels without min_rows are met; targets with null labels are left out.
    """
    spark = records.sparkSession
    _, wanted, counts, drawn, total = _rows(records, targets, key, column, part, 0)
    size = int(total * part)
    take = plan(counts, {n: (s, m) for n, (_, s, m) in wanted.items()}, size, drawn)

    def met(name: str, share: float, floor: int) -> bool:
        taken, there = take.get(name, 0), counts.get(name, 0)
        return taken >= floor and (taken >= share * size or (taken > share * size - 1 and there >= share * size))

    table = [(label, s, m, s * size, counts.get(n, 0), take.get(n, 0), met(n, s, m)) for n, (label, s, m) in wanted.items()]
    return spark.createDataFrame(table, "label string, share double, min_rows int, wanted double, available bigint, taken bigint, met boolean")


def sample(records: DataFrame, targets: DataFrame, key: str = "record_id", column: str = "output", part: float = PART, seed: int = 0) -> DataFrame:
    """(id, signature): a sample of ``part`` of the rows; signature is null for rows of no target label.

    Rows with a null or unknown output are taken only where labelled rows are short.  Repeated rows count once each;
    rows with equal ids are told apart only by chance order; an empty table gives no rows.
    """
    spark = records.sparkSession
    rows, wanted, counts, drawn, total = _rows(records, targets, key, column, part, seed)
    take = plan(counts, {n: (s, m) for n, (_, s, m) in wanted.items()}, int(total * part), drawn)
    edge = spark.createDataFrame([(n, int(k)) for n, k in take.items()], "name string, rest bigint")
    out = None
    # Twice the bucket of the hash is found in which a signature's last row lies; only that bucket's rows are ranked.
    for level in range(LEVELS):
        rows = rows.withColumn("bucket", F.pmod(F.shiftrightunsigned("h", 20 + level * BUCKET_BITS), F.lit(1 << BUCKET_BITS)).cast("int"))
        sizes = rows.groupBy("signature", "bucket").agg(F.count("*").alias("k"))
        upto = F.sum("k").over(W.partitionBy("signature").orderBy("bucket"))
        sizes = sizes.withColumn("before", upto - F.col("k")).join(F.broadcast(edge), F.col("signature").eqNullSafe(F.col("name")))
        last = sizes.where((F.col("before") < F.col("rest")) & (F.col("before") + F.col("k") >= F.col("rest")))
        # A row for each target label at most.
        last = materialise(last.select("name", F.col("bucket").alias("last"), (F.col("rest") - F.col("before")).alias("rest")), "p5_edge")
        near = rows.join(F.broadcast(last), F.col("signature").eqNullSafe(F.col("name"))).where("bucket <= last")
        full = near.where("bucket < last").select("id", "signature")
        out = full if out is None else out.unionByName(full)
        rows, edge = near.where("bucket = last").select("id", "signature", "h"), last.select("name", "rest")
    rank = F.row_number().over(W.partitionBy("signature").orderBy("h", "id"))
    cut = rows.withColumn("rank", rank).join(F.broadcast(edge), F.col("signature").eqNullSafe(F.col("name"))).where("rank <= rest").select("id", "signature")
    return out.unionByName(cut)
