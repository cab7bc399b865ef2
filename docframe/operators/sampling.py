"""Reproducible splits and samples, by hash rank instead of a random generator."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

BUCKET_DIGITS = 3


def hash_key(key: str, seed: str = "") -> Column:
    return F.md5(F.concat(F.col(key).cast("string"), F.lit(seed)))


def hash_rank(rows: DataFrame, key: str, seed: str = "", name: str = "rank", by: list[str] | None = None) -> DataFrame:
    """Each row's rank, from 1, by the hash of its key, in each group of ``by``.

    Rows are ranked inside buckets of the hash's first digits, in parallel, and the ranks shifted by the sizes of the
    buckets before: no task sorts all rows.
    """
    by = by or []
    h = hash_key(key, seed)
    rows = rows.withColumn("_h", h).withColumn("_b", F.substring("_h", 1, BUCKET_DIGITS))
    sizes = rows.groupBy(*by, "_b").agg(F.count("*").alias("_n"))
    w = W.partitionBy(*by).orderBy("_b") if by else W.orderBy("_b")
    before = sizes.select(*by, "_b", F.coalesce(F.sum("_n").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    inner = F.row_number().over(W.partitionBy(*by, "_b").orderBy("_h", key))
    return rows.withColumn("_r", inner).join(F.broadcast(before), [*by, "_b"]).withColumn(name, (F.col("_r") + F.col("_before")).cast("long")).drop("_h", "_b", "_r", "_before")


def split(records: DataFrame, key: str, train: float = 0.7, val: float = 0.2, seed: str = "") -> DataFrame:
    """Rows with a split of exact sizes: floor(train n), floor(val n), and the rest for test."""
    ranked = hash_rank(records, key, seed)
    total = records.agg(F.count("*").alias("_t"))
    part = F.when(F.col("rank") <= F.floor(F.col("_t") * train), "train").when(F.col("rank") <= F.floor(F.col("_t") * train) + F.floor(F.col("_t") * val), "val").otherwise("test")
    return ranked.crossJoin(F.broadcast(total)).withColumn("new_split", part).drop("rank", "_t")


def balance(records: DataFrame, key: str, field: str, majority: str, keep: float = 0.05, seed: str = "42") -> DataFrame:
    """All rows of the other values and floor(keep n) of the majority's; rows with a null field are others."""
    mine = F.coalesce(F.col(field) == majority, F.lit(False))
    ranked = hash_rank(records.where(mine), key, seed)
    total = records.where(mine).agg(F.count("*").alias("_t"))
    few = ranked.crossJoin(F.broadcast(total)).where(F.col("rank") <= F.floor(F.col("_t") * keep)).drop("rank", "_t")
    return records.where(~mine).unionByName(few)


def holdout(records: DataFrame, key: str, rows: int, seed: str = "42") -> DataFrame:
    """Rows marked test for an absolute number of them, train for the rest."""
    return hash_rank(records, key, seed).withColumn("new_split", F.when(F.col("rank") <= rows, "test").otherwise("train")).drop("rank")


def sample_shots(records: DataFrame, pool: DataFrame, k: int, key: str = "record_id", seed: str = "", most: int = 200) -> DataFrame:
    """Each row with ``shots``, k of a small pool (input, output) drawn without replacement by hash of row and shot.

    The pool becomes an array that every row carries, so it is checked to have at most ``most`` rows.
    """
    listed = pool.select("shot_id", "input", "output").orderBy("shot_id").limit(most + 1).collect()
    if len(listed) > most:
        raise ValueError(f"the pool has over {most} rows")
    if len(listed) < k:
        raise ValueError("the pool has fewer rows than shots are wanted")
    shots = F.array(*(F.struct(F.lit(r["shot_id"]).alias("shot_id"), F.lit(r["input"]).alias("input"), F.lit(r["output"]).alias("output")) for r in listed))
    keyed = F.transform(shots, lambda s: F.struct(F.md5(F.concat_ws("|", F.col(key), s["shot_id"].cast("string"), F.lit(seed))).alias("h"), s.alias("s")))
    return records.withColumn("shots", F.transform(F.slice(F.array_sort(keyed), 1, k), lambda x: F.struct(x["s"]["input"].alias("input"), x["s"]["output"].alias("output"))))
