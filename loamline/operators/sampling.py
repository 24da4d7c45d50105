"""Exact stratified samples and grow-only splits.

Order inside a stratum is that of md5(seed:id), then id, so it is the same
on any partitioning and stays as rows are added.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SEED = 42


def shuffled(seed: int, key: str) -> list[Column]:
    return [F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"))), F.col(key)]


def ranked(df: DataFrame, strata: list[str], key: str, seed: int) -> DataFrame:
    """Adds _rn, the place in the stratum's shuffled order, and _size, the stratum's rows.

    Places are counted in bins of the hash and the bins summed up, so a stratum
    that holds a third of all rows is no single task.
    """
    by_hash = shuffled(seed, key)
    binned = df.withColumn("_hash", by_hash[0]).withColumn("_bin", F.substring("_hash", 1, 3))
    counts = binned.groupBy(*strata, "_bin").agg(F.count("*").alias("_n"))
    w = Window.partitionBy(*strata)
    before = F.coalesce(F.sum("_n").over(w.orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select(*[F.col(c).alias(f"_s_{c}") for c in strata], F.col("_bin").alias("_b"), before.alias("_before"), F.sum("_n").over(w).alias("_size"))
    same = [binned[c].eqNullSafe(counts[f"_s_{c}"]) for c in strata]
    placed = binned.join(counts, [*same, binned["_bin"] == counts["_b"]])
    place = F.row_number().over(Window.partitionBy(*strata, "_bin").orderBy("_hash", key))
    return placed.withColumn("_rn", F.col("_before") + place).select(*df.columns, "_rn", "_size")


def quotas(df: DataFrame, n: int | Column, strata: list[str], order: str) -> DataFrame:
    """Rows to take from each stratum: the whole part of its share, then one each by descending remainder.

    Ties go to the stratum that appears first; full strata are passed over.
    """
    sizes = df.groupBy(*strata).agg(F.count("*").alias("size"), F.min(order).alias("first"))
    everything = Window.partitionBy()
    s = sizes.withColumn("n", n if isinstance(n, Column) else F.lit(n))
    s = s.withColumn("part", F.col("n") * (F.col("size") / F.sum("size").over(everything))).withColumn("base", F.least(F.floor("part"), F.col("size")))
    s = s.withColumn("short", F.col("n") - F.sum("base").over(everything)).withColumn("open", F.col("base") < F.col("size"))
    turn = F.row_number().over(Window.partitionBy("open").orderBy((F.col("part") - F.floor("part")).desc(), "first"))
    return s.withColumn("turn", turn).select(*strata, (F.col("base") + (F.col("open") & (F.col("turn") <= F.col("short"))).cast("int")).alias("quota"))


def stratified_sample(df: DataFrame, n: int | Column | None, strata: list[str], key: str, order: str, seed: int = SEED) -> DataFrame:
    """``n`` rows (a number, or a column over no rows, such as a scalar subquery) in proportion to their strata; all without n or if there are no more."""
    if n is None:
        return df
    q = quotas(df, n, strata, order).withColumnsRenamed({s: f"_{s}" for s in strata})
    rows = ranked(df, strata, key, seed)
    same = [rows[s].eqNullSafe(q[f"_{s}"]) for s in strata]
    return rows.join(q, same).filter("_rn <= quota").select(*df.columns)


def plain_sample(df: DataFrame, k: int, key: str, seed: int = SEED + 1) -> DataFrame:
    return df.orderBy(*shuffled(seed, key)).limit(k)


def assign_splits(df: DataFrame, strata: list[str], key: str, *, n: int | None = None, excluded: DataFrame | None = None, order: str | None = None, test: float = 0.10, val: float = 0.10, seed: int = SEED) -> DataFrame:
    """New split members (key, strata, split) among anonymised rows that have none yet.

    ``n`` is the number of members in all, those there included; excluded ids are
    never added. In each stratum the first int(N * test) of the shuffled order are
    test, the next int(N * val) val, the rest train.
    """
    rows = df.filter("anonymise")
    free = rows.filter("split is null")
    if excluded is not None:
        free = free.join(excluded.select(key).distinct(), key, "left_anti")
    if n is not None:
        members = rows.filter("split is not null").agg(F.count("*")).scalar()
        free = stratified_sample(free, F.greatest(F.lit(0), F.lit(n) - members), strata, key, order or key, seed)
    n_test, n_val = F.floor(F.col("_size") * test), F.floor(F.col("_size") * val)
    split = F.when(F.col("_rn") <= n_test, "test").when(F.col("_rn") <= n_test + n_val, "val").otherwise("train")
    return ranked(free, strata, key, seed).select(key, *strata, split.alias("split"))


def split_counts(df: DataFrame) -> DataFrame:
    """One row: members of each split, zeros included."""
    return df.agg(*[F.coalesce(F.sum((F.col("split") == s).cast("long")), F.lit(0)).alias(f"n_{s}") for s in ("train", "val", "test")])


def crosstab(df: DataFrame, strata: list[str]) -> DataFrame:
    """Members of each stratum by split, with the share of each split in percent."""
    out = df.groupBy(*strata).pivot("split", ["train", "val", "test"]).count().na.fill(0, ["train", "val", "test"])
    total = F.col("train") + F.col("val") + F.col("test")
    share = lambda s: F.coalesce(F.try_divide(F.col(s) * 100.0, total), F.lit(0.0))
    return out.select(*strata, "train", "val", "test", total.alias("total"), *[share(s).alias(f"pct_{s}") for s in ("train", "val", "test")])


def extract_subset(df: DataFrame, kind: str, strata: list[str], key: str, order: str, *, target: int | None = None, excluded: DataFrame | None = None, seed: int = SEED) -> DataFrame:
    """Split members of a type without excluded ids, sampled down to the target."""
    rows = df.filter((F.col("type_exemple") == kind) & F.col("split").isNotNull())
    if excluded is not None:
        rows = rows.join(excluded.select(key).distinct(), key, "left_anti")
    return stratified_sample(rows, target, strata, key, order, seed)


def subset_report(df: DataFrame, kind: str, excluded: DataFrame, key: str, target: int) -> DataFrame:
    """One row: before, excluded, available and how many are missing to the target."""
    rows = df.filter((F.col("type_exemple") == kind) & F.col("split").isNotNull())
    marked = rows.join(excluded.select(key, F.lit(True).alias("_out")).distinct(), key, "left")
    out = marked.agg(F.count("*").alias("avant"), F.count("_out").alias("exclus"))
    return out.withColumn("disponibles", F.col("avant") - F.col("exclus")).withColumn("manque", F.greatest(F.lit(target) - F.col("disponibles"), F.lit(0)))


def capped_per_group(df: DataFrame, group: str, order: list[str], k: int | None) -> DataFrame:
    """The first k rows of each group; no k, all."""
    if k is None:
        return df
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(group).orderBy(*order))).filter(F.col("_rn") <= k).drop("_rn")


def remaining(candidates: DataFrame, done: DataFrame, key: str, order: str, target: int) -> DataFrame:
    """The next candidates, in order, up to a target that counts those done."""
    left = max(0, target - done.select(key).distinct().count())
    return candidates.join(done.select(key).distinct(), key, "left_anti").orderBy(order).limit(left)


def waves(source: DataFrame, done: DataFrame, limit: int | None, strata: list[str], key: str, order: str) -> DataFrame:
    """What the next wave works on: rows not done yet, at most ``limit`` of them in proportion to their strata."""
    rows = source.join(done.select(key).distinct(), key, "left_anti")
    return stratified_sample(rows, limit, strata, key, order)


def as_text(table: DataFrame, strata: list[str], width: int = 24) -> DataFrame:
    """A crosstab as lines of fixed width, one a stratum, percentages to one decimal."""
    name = F.rpad(F.concat_ws(" / ", *strata), width, " ")
    # format_number rounds ties to even, as Python does
    cells = [F.format_string("%8d (%5s %%)", F.col(s), F.format_number(F.col(f"pct_{s}"), 1)) for s in ("train", "val", "test")]
    return table.select(*strata, F.concat_ws(" ", name, *cells, F.lpad(F.col("total").cast("string"), 8, " ")).alias("ligne"))
