"""Metrics rebuilt from the text of a training log.

Lines (run, ord, line) carry an explicit ordinal; progress bars give steps and elapsed
time, printed dicts the metrics.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loamline.functions.json_values import python_dict
from loamline.operators.asof import with_neighbours
from loamline.operators.curves import nearest_steps
from loamline.sources.files import staged

#: A training bar (step, total, minutes, seconds), the stamp in a run's name, a commit, and metric names.
BAR = r"([0-9]+)/([0-9]+)\s*\[([0-9]+):([0-9]+)<[^,\n]+,\s*[0-9.]+s/it\]"
STAMP = r"run-([0-9]{8}T[0-9]{6})Z"
COMMIT = r"@ git\+https://[^\s]+@([0-9a-f]{40})"
NAMES = {"loss": "perte_train", "grad_norm": "norme_gradient", "learning_rate": "learning_rate", "mean_token_accuracy": "mean_token_accuracy", "entropy": "entropy", "eval_loss": "perte_validation", "eval_mean_token_accuracy": "eval_mean_token_accuracy", "eval_entropy": "eval_entropy"}


#: Line ends beside those that Spark splits at (line feed, carriage return, both).
LINE_ENDS = r"[\x0B\x0C\x1C-\x1E\x85\u2028\u2029]"


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """run (file name), ord and line of text logs of any size, lines as Python's splitlines has them.

    A log is read in ranges of bytes, by as many tasks as it fills. Lines are written once with their range
    and place in it; the numbers of lines of the ranges before, a row a range, give the ordinals. One of ``LINE_ENDS`` at
    the very end of a log leaves an empty last line, which splitlines leaves out.
    """
    name = F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)(\.[^.]*)?$", 1)
    parts = F.split("value", LINE_ENDS)
    raw = spark.read.text(path).select(name.alias("run"), F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_start"), F.explode(parts).alias("line"))
    lines = staged(raw.withColumn("_at", F.monotonically_increasing_id()), "lines")
    ranges = lines.groupBy("_file", "_start").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    before = Window.partitionBy("_file").orderBy("_start").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.withColumn("_base", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    return lines.join(ranges, ["_file", "_start"]).select("run", (F.col("_base") + F.col("_at") - F.col("_first")).cast("int").alias("ord"), "line")


def bars(lines: DataFrame) -> DataFrame:
    """run, ord, etape, total and ecoule (seconds) of each progress bar; a line may hold several."""
    found = lines.select("run", "ord", F.posexplode(F.regexp_extract_all("line", F.lit(BAR), F.lit(0))).alias("nth", "bar"))
    part = lambda i: F.regexp_extract("bar", BAR, i).cast("int")
    return found.select("run", "ord", "nth", part(1).alias("etape"), part(2).alias("total"), (part(3) * 60 + part(4)).alias("ecoule"))


def elapsed(lines: DataFrame) -> DataFrame:
    """run, total (the largest denominator), etape, ecoule (the last printed) and place (of the step's first bar)."""
    place = F.struct("ord", "nth")
    b = bars(lines).groupBy("run", "total", "etape").agg(F.max_by("ecoule", place).alias("ecoule"), F.min(place).alias("place"))
    most = b.groupBy("run").agg(F.max("total").alias("total"))
    return b.join(most, ["run", "total"])


def anchors(lines: DataFrame) -> DataFrame:
    """run and t0, epoch seconds of the first stamp."""
    stamped = lines.withColumn("s", F.regexp_extract("line", STAMP, 1)).filter("s <> ''")
    first = stamped.groupBy("run").agg(F.min_by("s", "ord").alias("s"))
    return first.select("run", F.unix_timestamp(F.to_timestamp("s", "yyyyMMdd'T'HHmmss")).cast("double").alias("t0"))


def filled_steps(rows: DataFrame, run: str, order: str, step: str, name: str, parts: int | None = None) -> DataFrame:
    """Adds ``name``, the last step of the run there was up to the row, 0 before any. A run may lie over many tasks."""
    return with_neighbours(rows, run, order, step, before=name, parts=parts).withColumn(name, F.coalesce(name, F.lit(0)))


def replayed(lines: DataFrame) -> DataFrame:
    """run, etape, nom, valeur, horodatage of every metric that the log prints.

    Train metrics take the last full bar's step before them, evaluations their epoch
    times the steps of one (rounded half to even); time is the anchor plus the
    elapsed time at that step, or at the nearest (the first printed of two). Runs whose
    steps don't divide by their epochs are an error.
    """
    steps = elapsed(lines)
    total = steps.select("run", "total").distinct()
    first = F.regexp_extract("line", BAR, 2)
    rows = lines.join(total, "run").withColumn("is_bar", first == F.col("total").cast("string"))
    rows = filled_steps(rows.withColumn("step", F.when(F.col("is_bar"), F.regexp_extract("line", BAR, 1).try_cast("int"))), "run", "ord", "step", "seen")
    rows = rows.filter("not is_bar").withColumn("m", python_dict(F.col("line"))).filter("m is not null")
    epochs = F.rint(F.max(F.coalesce(F.try_element_at("m", F.lit("epoch")), F.lit(0.0)))).cast("int")
    rows = rows.join(rows.groupBy("run").agg(epochs.alias("epochs")), "run")
    wrong = (F.col("epochs") <= 0) | (F.col("total") % F.greatest("epochs", F.lit(1)) != 0)
    each = F.when(wrong, F.raise_error(F.lit("steps don't divide by epochs"))).otherwise((F.col("total") / F.col("epochs")).cast("int"))
    step = F.when(F.map_contains_key("m", "eval_loss"), F.rint(F.try_element_at("m", F.lit("epoch")) * each).cast("int")).otherwise(F.col("seen"))
    metrics = rows.select("run", step.alias("etape"), "ord", "m")
    near = nearest_steps(metrics.select("run", "etape", "ord", "m"), steps.select("run", "etape", "place"), "run", tie="place")
    timed = near.join(steps.select("run", F.col("etape").alias("etape_train"), "ecoule"), ["run", "etape_train"]).join(anchors(lines), "run")
    names = F.create_map(*[F.lit(x) for kv in NAMES.items() for x in kv])
    long = timed.select("run", "etape", "ord", (F.col("t0") + F.col("ecoule")).alias("horodatage"), F.explode("m").alias("key", "valeur"))
    return long.withColumn("nom", F.try_element_at(names, F.col("key"))).filter("nom is not null and valeur is not null").select("run", "etape", "nom", "valeur", "horodatage", "ord")


def commits(lines: DataFrame) -> DataFrame:
    """run and sha, the first installed commit that the log names."""
    named = lines.withColumn("sha", F.regexp_extract("line", COMMIT, 1)).filter("sha <> ''")
    return named.groupBy("run").agg(F.min_by("sha", "ord").alias("sha"))


def counters(lines: DataFrame, names: list[str]) -> DataFrame:
    """run, nom and valeur of 'name: number' or 'name=number' lines, the last of each name."""
    found = [lines.select("run", "ord", F.lit(n).alias("nom"), F.regexp_extract("line", rf"\Q{n}\E\s*[:=]\s*([0-9]+)", 1).alias("v")) for n in names]
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    return every.filter("v <> ''").groupBy("run", "nom").agg(F.max_by(F.col("v").cast("long"), "ord").alias("valeur"))
