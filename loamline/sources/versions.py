"""Tables in versions: appends that count once, and merges that rewrite only the buckets they touch.

A table is a folder of Parquet data and a folder ``_versions`` with one small JSON file a version:
which data folders make up each bucket of the key (or the log, if there is no key), and the last batch
of each writer. A version is published by renaming a file to the next number without overwriting; of
two writers that began at the same version one succeeds. Readers take the last version, whose folders
nobody changes, so they see a table whole. A batch that was published is passed over when it comes again.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamline.sources.files import _path, folders, latest_per_key, staged

LOG = "log"


class Conflict(RuntimeError):
    """Another writer published the version first; nothing of this one is in the table."""


@dataclass(frozen=True)
class Version:
    """State of a table: data folders by bucket (``log`` without a key), and the last batch of each writer."""

    number: int = -1
    key: str | None = None
    buckets: int = 0
    data: dict[str, list[str]] = field(default_factory=dict)
    done: dict[str, int] = field(default_factory=dict)

    def has(self, writer: str | None, batch: int | None) -> bool:
        return writer is not None and batch is not None and self.done.get(writer, -1) >= batch


def _name(number: int) -> str:
    return f"{number:012d}.json"


def current(spark: SparkSession, path: str, number: int | None = None) -> Version:
    """The last version of a table, or the one of a number; number -1 and no data if there is none."""
    names = sorted(n for n in folders(spark, f"{path}/_versions") if n.endswith(".json") and not n.startswith("."))
    if number is not None:
        if _name(number) not in names:
            raise FileNotFoundError(f"{path}: version {number}")
        names = [_name(number)]
    if not names:
        return Version()
    p, fs = _path(spark, f"{path}/_versions/{names[-1]}")
    stream = fs.open(p)
    try:
        return Version(**json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")))
    finally:
        stream.close()


def publish(spark: SparkSession, path: str, version: Version) -> None:
    """Makes ``version`` the last one, if its number is still free."""
    beside, fs = _path(spark, f"{path}/_versions/.new-{uuid.uuid4().hex}")
    stream = fs.create(beside, False)
    stream.write(bytearray(json.dumps(version.__dict__).encode()))
    stream.close()
    hadoop = spark._jvm.org.apache.hadoop.fs
    target = fs.makeQualified(_path(spark, f"{path}/_versions/{_name(version.number)}")[0])
    plain = spark.sparkContext._gateway.new_array(hadoop.Options.Rename, 1)
    plain[0] = hadoop.Options.Rename.NONE
    try:
        hadoop.FileContext.getFileContext(target.toUri(), spark._jsc.hadoopConfiguration()).rename(fs.makeQualified(beside), target, plain)
    except Exception as error:
        fs.delete(beside, False)
        if "FileAlreadyExists" in str(error):
            raise Conflict(f"{path}: version {version.number} is there") from error
        raise


def read(spark: SparkSession, path: str, schema, version: Version | None = None) -> DataFrame:
    """The rows of a table, as of its last version or a given one; a missing table is empty."""
    version = version or current(spark, path)
    return _read(spark, path, schema, [d for each in version.data.values() for d in each])


def _read(spark: SparkSession, path: str, schema, data: list[str]) -> DataFrame:
    return spark.read.schema(schema).parquet(*[f"{path}/{d}" for d in data]) if data else spark.createDataFrame([], schema)


def append(df: DataFrame, path: str, *, writer: str | None = None, batch: int | None = None) -> bool:
    """Rows after those there. With a writer and the number of its batch, a batch that is in the table already is passed over (False).

    Other writers don't matter: rows are written once, and published after whatever came between.
    """
    spark = df.sparkSession
    was = current(spark, path)
    if was.key is not None:
        raise ValueError(f"{path} is keyed by {was.key}")
    if was.has(writer, batch):
        return False
    data = f"data/{uuid.uuid4().hex}"
    df.write.parquet(f"{path}/{data}")
    while True:
        was = current(spark, path)
        if was.has(writer, batch):
            return False
        done = was.done | ({writer: batch} if writer is not None else {})
        try:
            publish(spark, path, replace(was, number=was.number + 1, data=was.data | {LOG: [*was.data.get(LOG, []), data]}, done=done))
            return True
        except Conflict:
            continue


def compact(spark: SparkSession, path: str, schema) -> None:
    """The appends of a log as one folder, in a new version."""
    was = current(spark, path)
    if len(was.data.get(LOG, [])) > 1:
        data = f"data/{uuid.uuid4().hex}"
        read(spark, path, schema, was).write.parquet(f"{path}/{data}")
        publish(spark, path, replace(was, number=was.number + 1, data={LOG: [data]}))


def _bucket(key: str, buckets: int):
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def sharing(keys: DataFrame, path: str, schema, *, key: str = "identifiant", version: Version | None = None) -> DataFrame:
    """The rows of those buckets of a table that ``keys`` fall into: all rows with such a key are among them."""
    spark = keys.sparkSession
    version = version or current(spark, path)
    if not version.buckets:
        return spark.createDataFrame([], schema)
    touched = [str(r["b"]) for r in keys.select(_bucket(key, version.buckets).alias("b")).distinct().collect()]
    return _read(spark, path, schema, [d for b in touched for d in version.data.get(b, [])])


def upsert(new: DataFrame, path: str, *, order: str, key: str = "identifiant", buckets: int = 64, writer: str | None = None, batch: int | None = None, since: Version | None = None) -> bool:
    """``new`` rows in place of those of the same key; of several the last by ``order`` counts.

    Rows lie in buckets by the hash of their key; those that ``new`` touches are written anew,
    the others stay as they are. ``buckets`` is fixed by the first upsert. A batch of a
    writer that was merged is passed over (False). If another version came between,
    since the table was read (or since the version given), this is a ``Conflict``.
    """
    spark = new.sparkSession
    was = since or current(spark, path)
    if was.has(writer, batch):
        return False
    if was.key not in (None, key):
        raise ValueError(f"{path} is keyed by {was.key}")
    n = was.buckets or buckets
    last = staged(latest_per_key(new, [key], order), "upsert")
    old = sharing(last, path, last.schema, key=key, version=was)
    rows = old.join(last.select(key), key, "left_anti").unionByName(last)
    data = f"data/{uuid.uuid4().hex}"
    rows.withColumn("_bucket", _bucket(key, n)).repartition("_bucket").write.partitionBy("_bucket").parquet(f"{path}/{data}")
    written = {f.removeprefix("_bucket="): [f"{data}/{f}"] for f in folders(spark, f"{path}/{data}") if f.startswith("_bucket=")}
    done = was.done | ({writer: batch} if writer is not None else {})
    publish(spark, path, replace(was, number=was.number + 1, key=key, buckets=n, data=was.data | written, done=done))
    return True


def vacuum(spark: SparkSession, path: str, keep: int = 2) -> int:
    """Deletes versions but the last ``keep``, and data that none of these has; returns how many folders went. Not while others write."""
    names = sorted(n for n in folders(spark, f"{path}/_versions") if n.endswith(".json") and not n.startswith("."))
    kept = [current(spark, path, int(n.removesuffix(".json"))) for n in names[-keep:]]
    used = {d for v in kept for each in v.data.values() for d in each}
    there = []
    for d in folders(spark, f"{path}/data"):
        inner = [f"data/{d}/{f}" for f in folders(spark, f"{path}/data/{d}") if f.startswith("_bucket=")]
        there += inner or [f"data/{d}"]
    gone = [d for d in there if d not in used]
    for name in [f"_versions/{n}" for n in names[:-keep]] + gone:
        p, fs = _path(spark, f"{path}/{name}")
        fs.delete(p, True)
    return len(gone)
