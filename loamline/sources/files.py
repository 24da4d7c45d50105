"""Scans, keyed tables and sinks over JSON, CSV and Parquet files."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loamline import schemas

FORMATS = {".csv": "csv", ".jsonl": "jsonl", ".json": "json", ".parquet": "parquet"}


def _path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    p, fs = _path(spark, path)
    return fs.exists(p)


def folders(spark: SparkSession, path: str) -> list[str]:
    """Names of what is in a folder; none if it is missing."""
    p, fs = _path(spark, path)
    return [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []


def scratch(spark: SparkSession) -> str:
    """A new folder for tables that a query writes and reads again, in the folder that driver and executors share (``spark.checkpoint.dir``); on a single machine without that setting, a local one."""
    shared = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        shared = "file://" + tempfile.mkdtemp(prefix="spark-loamline-")
    return f"{shared.rstrip('/')}/tables-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to a new scratch folder and read back: what is read twice then agrees, and a lost executor costs no more than a task."""
    path = f"{scratch(df.sparkSession)}/{name}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def read_corpus(spark: SparkSession, path: str, schema: T.StructType | None = None, chunk: int | None = None) -> DataFrame:
    """A raw corpus by its suffix: .csv, .jsonl, .json (one array) or .parquet.

    ``chunk`` is accepted for callers that read in blocks; Spark splits files by
    itself. Missing paths and other suffixes are errors at once.
    """
    kind = FORMATS.get("." + path.rstrip("/").rpartition(".")[2].lower())
    if kind is None:
        raise ValueError(f"unsupported suffix: {path}")
    if not exists(spark, path):
        raise FileNotFoundError(path)
    reader = spark.read if schema is None else spark.read.schema(schema)
    if kind == "csv":
        reader = reader.options(header=True, multiLine=True, escape='"', **({"inferSchema": True} if schema is None else {}))
        return reader.csv(path)
    if kind == "json":
        return reader.option("multiLine", True).json(path)
    return reader.parquet(path) if kind == "parquet" else reader.json(path)


def read_hub(spark: SparkSession, path: str, split: str = "train") -> DataFrame:
    """A hub corpus that was saved before: a folder for each split, in Parquet or JSON lines."""
    folder = f"{path}/{split}"
    if not exists(spark, folder):
        raise FileNotFoundError(folder)
    p, fs = _path(spark, folder)
    names = [s.getPath().getName() for s in fs.listStatus(p)]
    return spark.read.parquet(folder) if any(n.endswith(".parquet") for n in names) else spark.read.json(folder)


def read_table(spark: SparkSession, path: str, schema: T.StructType, *, required: bool = True) -> DataFrame:
    """A keyed JSON-lines table; blank lines are skipped. An optional one that is missing is empty."""
    if not exists(spark, path) and not recovered(spark, path):
        if required:
            raise FileNotFoundError(path)
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def matching(df: DataFrame, criteria: dict[str, object]) -> DataFrame:
    """Rows that equal all criteria, null-safely; a column that is not there counts as null."""
    tests = [(F.col(c) if c in df.columns else F.lit(None)).eqNullSafe(F.lit(v)) for c, v in criteria.items()]
    return df.filter(reduce(lambda a, b: a & b, tests)) if tests else df


def lookup(df: DataFrame, identifiant: str, key: str = "identifiant") -> DataFrame:
    """The first row of the id, or none."""
    return df.filter(F.col(key) == identifiant).limit(1)


def identifiers(df: DataFrame, key: str = "identifiant") -> DataFrame:
    return df.select(key).distinct()


def latest_per_key(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last row of each key by ``order``, then by a hash of the row, so reruns agree on ties."""
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    last = F.max_by(row, F.struct(F.col(order), F.xxhash64(*[F.col(f"`{c}`") for c in df.columns])))
    return df.groupBy(*keys).agg(last.alias("_row")).select("_row.*")


def upserted(old: DataFrame, new: DataFrame, key: str = "identifiant", order: str | None = None) -> DataFrame:
    """Old rows with new ones in place of those of the same key; of new rows of one key the last by ``order`` wins."""
    new = latest_per_key(new, [key], order) if order else new.dropDuplicates([key])
    return old.join(new.select(key), key, "left_anti").unionByName(new.select(*old.columns))


def recovered(spark: SparkSession, path: str) -> bool:
    """Puts back the table that an ``overwrite`` had set aside when it was cut short, if there is one: the new one, written whole, or else the old."""
    p, fs = _path(spark, path)
    if not fs.exists(p.getParent()):
        return False
    beside = [s.getPath() for s in fs.listStatus(p.getParent())]
    whole = [b for b in beside if b.getName().startswith(p.getName() + ".new-") and fs.exists(_path(spark, f"{b.toString()}/_SUCCESS")[0])]
    old = [b for b in beside if b.getName().startswith(p.getName() + ".old-")]
    return bool(old) and fs.rename((whole or old)[0], p)


def overwrite(df: DataFrame, path: str) -> None:
    """Replace a JSON-lines table that ``df`` may be read from: write beside it, then swap by renaming. ``read_table`` recovers from a swap that was cut short."""
    spark = df.sparkSession
    beside, old = f"{path}.new-{uuid.uuid4().hex}", f"{path}.old-{uuid.uuid4().hex}"
    df.write.json(beside)
    there, fs = _path(spark, path)
    if fs.exists(there) and not fs.rename(there, _path(spark, old)[0]):
        raise OSError(f"can't move {path}")
    if not fs.rename(_path(spark, beside)[0], there):
        raise OSError(f"can't move {beside}")
    fs.delete(_path(spark, old)[0], True)


def upsert(spark: SparkSession, path: str, schema: T.StructType, new: DataFrame, key: str = "identifiant", order: str | None = None) -> None:
    overwrite(upserted(read_table(spark, path, schema, required=False), new, key, order), path)


def append(df: DataFrame, path: str) -> None:
    """Rows after those there; keys may repeat."""
    df.write.mode("append").json(path)


def decisions(spark: SparkSession, path: str) -> DataFrame:
    """The last decision of each candidate; decisions are appended, so a later one replaces an earlier."""
    return latest_per_key(read_table(spark, path, schemas.DECISION, required=False), schemas.DECISION_KEY, "horodatage")


def sampled_ids(registry: DataFrame, stratum: str) -> DataFrame:
    return registry.filter(F.col("strate") == stratum).select("identifiant").distinct()


def metric_log(spark: SparkSession, path: str) -> DataFrame:
    """Long metric rows; a malformed line is an error, a missing time is 0."""
    rows = spark.read.schema(schemas.METRIC).option("mode", "FAILFAST").json(path)
    return rows.withColumn("horodatage", F.coalesce("horodatage", F.lit(0.0)))


def runs(spark: SparkSession, root: str) -> DataFrame:
    """Names of the folders under ``root`` that hold a metriques.jsonl, sorted."""
    files = spark.read.text(f"{root}/*/metriques.jsonl").select("_metadata.file_path").distinct()
    return files.select(F.regexp_extract("file_path", r"([^/]+)/metriques\.jsonl", 1).alias("run")).orderBy("run")


def start_run(metrics: DataFrame, parameters: DataFrame, root: str, run: str) -> None:
    """A run begins anew: its metrics are replaced and its parameters written."""
    metrics.write.mode("overwrite").json(f"{root}/{run}/metriques.jsonl")
    parameters.write.mode("overwrite").json(f"{root}/{run}/parametres.json")


def log_metrics(metrics: DataFrame, root: str, run: str) -> None:
    append(metrics, f"{root}/{run}/metriques.jsonl")


def not_imported(found: DataFrame, done: DataFrame, force: bool = False) -> DataFrame:
    """Runs that were not imported yet, or all."""
    return found if force else found.join(done, "run", "left_anti")


def milliseconds(seconds) -> object:
    """Epoch seconds as whole milliseconds, as metric servers take them."""
    return (seconds * 1000).cast("long")


def routed(df: DataFrame) -> DataFrame:
    """Rows with their split in one spelling (validation is val, any case); others have null."""
    name = F.lower(F.trim("split"))
    return df.withColumn("split", F.when(name.isin("val", "validation"), "val").when(name.isin("train", "test"), name))


def write_splits(df: DataFrame, path: str) -> dict[str, int]:
    """One pass into train, val and test folders; returns rows of each and how many were ignored, counted as they are written."""
    seen = Observation()
    rows = routed(df).observe(seen, *[F.count_if(F.col("split").eqNullSafe(s)).alias(s or "ignores") for s in ("train", "val", "test", None)])
    rows.filter("split is not null").write.partitionBy("split").mode("overwrite").json(path)
    return {s: seen.get[s] for s in ("train", "val", "test", "ignores")}


def export_exclusions(df: DataFrame, path: str) -> None:
    """Sorted by id over part files whose names are in order."""
    df.orderBy("identifiant").write.mode("overwrite").json(path)


def write_subset(df: DataFrame, path: str, excluded: DataFrame | None = None, exclusions: str | None = None) -> int:
    """A subset as JSON lines, and the ids that were left out of it as another table; returns the rows written, counted as they are."""
    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("overwrite").json(path)
    if excluded is not None and exclusions is not None:
        export_exclusions(excluded, exclusions)
    return seen.get["n"]


def dump_corpus(corpus: DataFrame, path: str, progress: Callable[[int], None] | None = None) -> int:
    """A hub corpus as JSON lines; returns the rows written and tells them to ``progress`` if there is one."""
    n = write_subset(corpus, path)
    if progress is not None:
        progress(n)
    return n


def read_checkpoints(spark: SparkSession, path: str) -> DataFrame:
    """The checkpoint table with the kind of each (dpo if its parameters have a beta, else sft); empty if there is none."""
    return schemas.with_kind(read_table(spark, path, schemas.CHECKPOINT, required=False))


def save_checkpoints(spark: SparkSession, path: str, new: DataFrame) -> None:
    """New checkpoints in place of those of the same id; fields that are null are left out, so sft rows have no beta."""
    upsert(spark, path, schemas.CHECKPOINT, new.select(*schemas.CHECKPOINT.names))


def run_parameters(found: DataFrame, parameters: DataFrame) -> DataFrame:
    """Runs with the parameters that were written for them, null where there are none."""
    return found.join(parameters, "run", "left")


def reformulated(spark: SparkSession, path: str) -> DataFrame:
    """The reformulated answers, the last of each row by time; none if the table is missing. They are appended as they come."""
    return latest_per_key(read_table(spark, path, schemas.REFORMULATED, required=False), ["identifiant"], "horodatage")


def save_preferences(spark: SparkSession, path: str, triplets: DataFrame) -> None:
    """Preference triplets in place of those of the same id."""
    upsert(spark, path, schemas.PREFERENCE, triplets.select(*schemas.PREFERENCE.names), order="chosen")


def preferences(spark: SparkSession, path: str) -> DataFrame:
    """The table of preference triplets; empty if it is missing."""
    return read_table(spark, path, schemas.PREFERENCE, required=False)
