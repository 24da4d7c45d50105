"""Exact dedup and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


#: Parts of a key's rows that are ranked apart first, so that a key with a third of all rows is no single task.
SALTS = 64


def first_wins(df: DataFrame, key: str, order: str) -> tuple[DataFrame, DataFrame]:
    """The first row of each key by ``order`` (then by a hash of the row), and all the others.

    The first is a minimum, which is taken before rows are moved. The others are
    ranked by parts of their key, then the firsts of the parts.
    """
    place = F.struct(F.col(order).alias("o"), F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]).alias("h"))
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), F.col(key).alias("k"), place.alias("place"))
    first = rows.groupBy("k").agg(F.min_by("row", "place").alias("row")).select("row.*")
    rank = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy("place"))
    parts = rows.withColumn("salt", F.pmod("place.h", F.lit(SALTS))).withColumn("rn", rank("k", "salt"))
    later = parts.filter("rn = 1").withColumn("rn", rank("k")).unionByName(parts.filter("rn > 1")).filter("rn > 1")
    return first, later.select("row.*")


def duplicate_counts(df: DataFrame) -> DataFrame:
    """One row: lignes and duplicate_rate, the share of rows that repeat an earlier one in all columns (0 for none). Rows are told apart by 128 bits of hash."""
    counts = df.select(F.unhex(F.md5(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}))).alias("row")).groupBy("row").count()
    n, d = F.coalesce(F.sum("count"), F.lit(0)), F.count("*")
    return counts.agg(n.alias("lignes"), F.coalesce(F.try_divide(n - d, n), F.lit(0.0)).alias("duplicate_rate"))


def duplicate_rate(df: DataFrame) -> DataFrame:
    return duplicate_counts(df).select("duplicate_rate")


def not_yet_tried(grid: DataFrame, tried: DataFrame, on: list[str]) -> DataFrame:
    """The first combination of the grid, by ``pos``, that was not tried."""
    return grid.join(tried.select(*on).distinct(), on, "left_anti").orderBy("pos").limit(1)


def expanded_grid(base: DataFrame, name: str, values: list[float]) -> DataFrame:
    """The base row once for each value of one axis, with its place as pos."""
    return base.select("*", F.posexplode(F.array(*map(F.lit, values))).alias("pos", name))


def id_sets(left: DataFrame, right: DataFrame, key: str = "identifiant") -> dict[str, DataFrame]:
    a, b = left.select(key).distinct(), right.select(key).distinct()
    return {"union": a.union(b).distinct(), "intersection": a.intersect(b), "difference": a.subtract(b)}
