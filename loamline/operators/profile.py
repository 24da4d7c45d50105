"""Profiles of raw tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loamline.functions.json_values import printed
from loamline.operators.dedup import duplicate_counts


def columns(df: DataFrame) -> DataFrame:
    """By column: colonne, taux_manquant (nulls; NaN too for floats) and longueur_moyenne (of texts, lists and dicts as Python prints them, None for null; null for others)."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        missing = c.isNull() | F.isnan(c) if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else c.isNull()
        textual = isinstance(f.dataType, (T.StringType, T.ArrayType, T.StructType, T.MapType))
        length = F.avg(F.length(printed(c, f.dataType))) if textual else F.lit(None).cast("double")
        out.append(F.struct(F.lit(f.name).alias("colonne"), F.coalesce(F.avg(missing.cast("int")), F.lit(0.0)).alias("taux_manquant"), length.alias("longueur_moyenne")))
    return df.agg(F.array(*out).alias("p")).select(F.explode("p").alias("p")).select("p.*")


def by_block(df: DataFrame, order: str, rows: int) -> DataFrame:
    """Rows and missing rates for each block of ``rows`` ordinals."""
    names = [c for c in df.columns if c != order]
    return df.groupBy(F.floor(F.col(order) / rows).alias("bloc")).agg(F.count("*").alias("lignes"), *[F.avg(F.col(f"`{c}`").isNull().cast("int")).alias(f"manquant_{c}") for c in names])


def tables(named: dict[str, DataFrame]) -> DataFrame:
    """table, lignes and duplicate_rate of several tables."""
    parts = [duplicate_counts(d).select(F.lit(n).alias("table"), "lignes", "duplicate_rate") for n, d in named.items()]
    return reduce(DataFrame.unionByName, parts)
