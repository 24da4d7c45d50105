"""As-of lookups in runs of any length.

Rows are dealt by range of (group, order), so one long group lies over many tasks. Each part hands on
the last and the first value that it has; these few rows, in the order of the parts, tell what comes
before and after each part, and the rest is looked up inside it. Looking ahead sorts the other way
round: a frame up to the end of the window would be read anew for each row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loamline.sources.files import staged

_BACK = (Window.unboundedPreceding, Window.currentRow)


def with_neighbours(rows: DataFrame, group: str, order: str, value: str, *, before: str | None = None, after: str | None = None, parts: int | None = None) -> DataFrame:
    """Adds ``before``, the last value that is not null up to the row, and ``after``, the first from the row on; the row's own counts for both.

    ``order`` should be unique in a group: rows that tie are in any order. A null group is
    a group of its own; groups without values get nulls. ``parts`` sets the number of ranges, else
    Spark's settings do. Rows are written once, so that all lookups see the same parts.
    """
    by = [F.col(group), F.col(order)]
    dealt = rows.repartitionByRange(parts, *by) if parts else rows.repartitionByRange(*by)
    dealt = staged(dealt.withColumn("_part", F.spark_partition_id()), "asof")
    there = F.when(F.col(value).isNotNull(), F.col(order))
    edges = dealt.groupBy(group, "_part").agg(F.max_by(value, there).alias("_last"), F.min_by(value, there).alias("_first"))
    along, back = (Window.partitionBy(group).orderBy(o).rowsBetween(Window.unboundedPreceding, -1) for o in (F.col("_part"), F.col("_part").desc()))
    carried = edges.select(F.col(group).alias("_g"), F.col("_part").alias("_p"), F.last("_last", ignorenulls=True).over(along).alias("_before"), F.last("_first", ignorenulls=True).over(back).alias("_after"))
    own = Window.partitionBy(group, "_part")
    out = dealt.join(carried, dealt[group].eqNullSafe(carried["_g"]) & (dealt["_part"] == carried["_p"]))
    if before:
        out = out.withColumn(before, F.coalesce(F.last(value, ignorenulls=True).over(own.orderBy(order).rowsBetween(*_BACK)), F.col("_before")))
    if after:
        out = out.withColumn(after, F.coalesce(F.last(value, ignorenulls=True).over(own.orderBy(F.col(order).desc()).rowsBetween(*_BACK)), F.col("_after")))
    return out.select(*rows.columns, *[c for c in (before, after) if c])
