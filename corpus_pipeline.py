"""A training corpus in five stages, each written as Parquet and read by the next.

Each function takes (spark, docs, sf_dir) and returns a DataFrame; all but the last
return the columns of ``docs``, whatever their names: those that the stages don't use go
with their row. Rows are dropped by doc_id (null included) and text, so rows that share
a doc_id are judged each by its own text. Texts are read whole, however long. An empty
table gives an empty one at every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamline.llm import decontamination, line_dedup, minhash_dedup, mixing, quality_crf
from loamline.llm.common import staged, table


def _matched(docs: DataFrame, rows: DataFrame, how: str) -> DataFrame:
    """The rows of docs whose doc_id (null included) and text are (left_semi) or aren't (left_anti) in rows, a table of its own: then Spark knows how few they are."""
    rows = rows.select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"))
    return docs.join(rows, docs["doc_id"].eqNullSafe(rows["_id"]) & (F.xxhash64(docs["text"]) == rows["_key"]), how)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that the line CRF scores 0.3 or more, a tie at 0.3 included; trained on labelled rows that are not held out.

    Null and empty texts score as one empty line and stay or go by that; repeated rows
    fare alike. Without labels everything stays.
    """
    model = quality_crf.train(docs, table(spark, sf_dir, "labels"))
    return quality_crf.only_good(docs, model)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Deletes later copies of repeated line runs of 50 words or more; documents that lose every line go, the others stay.

    The first copy is that of the least doc_id (nulls last), then of the least hash of
    the text, then line. Null and empty texts have no runs and stay as they are. Rows
    equal in doc_id and text lose the same lines.
    """
    report = "_runs"
    while report in docs.columns:
        report += "_"
    out = line_dedup.drop_repeated_runs(docs, min_words=50, report=report)
    return out.filter((F.col(f"`{report}`.n_removed") == 0) | (F.col(f"`{report}`.n_removed") < F.col(f"`{report}`.n_lines"))).drop(report)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of near duplicates (five-word shingles, similarity 0.8): that with the least doc_id (nulls last), then the least hash of the text, then of the row.

    Null, empty and blank texts are near nothing and all stay, repeated ones too. Rows
    equal in doc_id and text, but for blank ones, are one group: one stays.
    """
    members = minhash_dedup.group_members(docs)
    dropped = staged(members.filter("not first or n > 1").select("doc_id", "text_key"), "dropped")
    repeated = staged(members.filter("first and n > 1").select("doc_id", "text_key"), "repeated")
    out = _matched(docs, dropped, "left_anti")
    if repeated.isEmpty():
        return out
    # of rows equal in doc_id and text, one; the minimum is taken before rows are moved
    row = F.min_by(F.struct(*[F.col(f"`{c}`") for c in docs.columns]), F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns])).alias("row")
    return out.union(_matched(docs, repeated, "left_semi").groupBy("doc_id", F.xxhash64("text").alias("_key")).agg(row).select("row.*"))


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps rows whose text is without any ten-word window of a benchmark item; null and empty texts have none and stay, repeated rows fare alike."""
    judged = decontamination.judged_texts(docs, table(spark, sf_dir, "benchmark"), window=10)
    return _matched(docs, staged(judged.filter("contaminated").select("doc_id", "text_key").distinct(), "dropped"), "left_anti")


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, size, source_size, target and taken of the documents that the mix takes, all sources at weights 5, 2, 1 in turn.

    Null and empty texts have no words and are not taken; a null source is a source of
    its own. Ties of the sampling order go by doc_id, then the text's hash; each of
    repeated rows is taken or not by its own place.
    """
    return mixing.mix(docs, weights=(5.0, 2.0, 1.0), cap=3, seed=42).filter("taken > 0")


STAGES = [("quality", quality), ("line_dedup", lines), ("near_dedup", near_duplicates), ("decontamination", decontaminated), ("mixing", mixed)]

#: The first stage is a trained model, which SQL can't express; tests look for planted rows in each stage's result, and compare the operators with brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
