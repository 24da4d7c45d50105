"""Append-only logs as streams: metrics with live verdicts, audit events, resumable masking."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from loamline import schemas
from loamline.operators.curves import live_verdicts, wide
from loamline.operators.dedup import first_wins
from loamline.sources import versions
from loamline.sources.files import exists, folders, read_table


def metric_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of long metric files (run, etape, nom, valeur, horodatage) as they appear."""
    schema = T.StructType([T.StructField("run", T.StringType()), *schemas.METRIC.fields])
    rows = spark.readStream.schema(schema).json(folder)
    return rows.withColumn("horodatage", F.coalesce("horodatage", F.lit(0.0)))


def latest_metrics(stream: DataFrame) -> DataFrame:
    """The last value by time of each run, step and name: state of one row for each."""
    return stream.groupBy("run", "etape", "nom").agg(F.max_by("valeur", "horodatage").alias("valeur"), F.max("horodatage").alias("horodatage"))


def follow_metrics(spark: SparkSession, folder: str, path: str, checkpoint: str) -> StreamingQuery:
    """Keeps a Parquet table of the latest metrics, over what there is.

    Each batch writes a version of its own, from the version before and the values that
    changed, so a reader never meets a table that is being rewritten.
    """

    def version(batch: DataFrame, number: int) -> None:
        before = _latest(batch.sparkSession, path, number - 1)
        rows = batch if before is None else before.join(batch, ["run", "etape", "nom"], "left_anti").unionByName(batch)
        rows.write.mode("overwrite").parquet(f"{path}/version={number}")

    out = latest_metrics(metric_stream(spark, folder)).writeStream.outputMode("update").foreachBatch(version)
    return out.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _latest(spark: SparkSession, path: str, upto: int | None = None) -> DataFrame | None:
    """The last whole version of a table of metrics, at most number ``upto``."""
    numbers = sorted((int(v.removeprefix("version=")) for v in folders(spark, path) if exists(spark, f"{path}/{v}/_SUCCESS")), reverse=True)
    kept = [n for n in numbers if upto is None or n <= upto]
    return spark.read.parquet(f"{path}/version={kept[0]}") if kept else None


def live(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    """Verdicts of all runs in a table of latest metrics; a last step that is not whole is left out."""
    rows = _latest(spark, path)
    if rows is None:
        raise FileNotFoundError(path)
    return live_verdicts(wide(rows.withColumn("ord", F.col("horodatage")), names))


def append_audit(events: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Audit events at the end of a JSON-lines log; those there are never touched."""
    return events.writeStream.outputMode("append").format("json").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def resume(stream: DataFrame, path: str, schema, work: Callable[[DataFrame], DataFrame], checkpoint: str, key: str = "identifiant") -> StreamingQuery:
    """Works off a stream of rows, passing over ids that the output has; a repeated batch adds nothing."""

    def one(batch: DataFrame, _: int) -> None:
        done = read_table(batch.sparkSession, path, schema, required=False).select(key)
        work(first_wins(batch.join(done, key, "left_anti"), key, key)[0]).write.mode("append").json(path)

    return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def resume_once(stream: DataFrame, path: str, schema, work: Callable[[DataFrame], DataFrame], checkpoint: str, key: str = "identifiant", buckets: int = 64) -> StreamingQuery:
    """As ``resume``, into a table of ``versions``: a batch reads only the buckets that its ids fall into, and one that was published before a failure counts once.

    ``schema`` is that of the output, which has the key; ``work`` may drop rows, and these are tried again when they come again.
    """

    def one(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        was = versions.current(spark, path)
        if was.has(checkpoint, number):
            return
        done = versions.sharing(batch, path, schema, key=key, version=was).select(key)
        rows = first_wins(batch.join(done, key, "left_anti"), key, key)[0]
        versions.upsert(work(rows), path, key=key, order=key, buckets=buckets, writer=checkpoint, batch=number, since=was)

    return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
