"""Training curves: long metrics to wide, nearest steps, verdicts, best trials."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loamline.operators.asof import with_neighbours

TRAIN, VALID, GRAD = "perte_train", "perte_validation", "norme_gradient"
DROP, RISE, EXPLODED, LAST = 0.05, 0.05, 10.0, 3


def wide(points: DataFrame, names: list[str], run: str = "run", order: str = "ord") -> DataFrame:
    """A row for each run and step, a column for each name; of several values of one name the last wins, missing ones are null."""
    return points.groupBy(run, "etape").pivot("nom", names).agg(F.max_by("valeur", order))


def complete_steps(w: DataFrame) -> DataFrame:
    return w.filter(F.col(TRAIN).isNotNull() & F.col(GRAD).isNotNull())


def present(w: DataFrame, names: list[str]) -> list[str]:
    """The names that have a value in any row, in the order given."""
    there = [n for n in names if n in w.columns]
    row = w.agg(*[F.count(n).alias(n) for n in there]).first() if there else {}
    return [n for n in there if row[n] > 0]


def ends(curve: DataFrame, run: str = "run") -> DataFrame:
    """First and last point of each run by step."""
    point = F.struct(TRAIN, VALID, GRAD)
    return curve.groupBy(run).agg(F.min_by(point, "etape").alias("premier"), F.max_by(point, "etape").alias("dernier"), F.count("*").alias("n"))


def relative_drop(first: Column, last: Column) -> Column:
    return F.when(first == 0, 0.0).otherwise((first - last) / first)


def _odd(c: str) -> Column:
    return F.coalesce(F.isnan(c) | (F.abs(c) == float("inf")), F.lit(False))


def validation_rise(curve: DataFrame, run: str = "run", k: int = LAST) -> DataFrame:
    """hausse: last less first of the last k validation losses there are; null with fewer than two."""
    by_step = Window.partitionBy(run).orderBy(F.col("etape").desc())
    rows = curve.filter(F.col(VALID).isNotNull()).withColumn("rn", F.row_number().over(by_step)).filter(F.col("rn") <= k)
    return rows.groupBy(run).agg(F.when(F.count("*") >= 2, F.max_by(VALID, "etape") - F.min_by(VALID, "etape")).alias("hausse"))


def verdicts(curve: DataFrame, run: str = "run", least: int = 1) -> DataFrame:
    """run, n and verdict of each run's curve (etape, TRAIN, VALID, GRAD).

    In this order: instable (a value that is no finite number, or gradients that
    grew tenfold while the loss rose), sous_apprentissage (the loss fell by less
    than 5 %), surapprentissage (the last validation losses rose by more than
    0.05), saine. Runs of fewer than ``least`` points have none.
    """
    e = ends(curve, run)
    odd = curve.groupBy(run).agg(F.bool_or(_odd(TRAIN) | _odd(GRAD) | _odd(VALID)).alias("odd"))
    d = e.join(odd, run).join(validation_rise(curve, run), run, "left")
    g0, g1, t0, t1 = F.col(f"premier.{GRAD}"), F.col(f"dernier.{GRAD}"), F.col(f"premier.{TRAIN}"), F.col(f"dernier.{TRAIN}")
    exploded = (g0 > 0) & (g1 / F.nullif(g0, F.lit(0.0)) >= EXPLODED) & (t1 > t0)
    verdict = F.when(F.col("odd") | exploded, "instable").when(relative_drop(t0, t1) < DROP, "sous_apprentissage").when(F.col("hausse") > RISE, "surapprentissage").otherwise("saine")
    return d.select(run, "n", F.when(F.col("n") >= least, verdict).alias("verdict"))


def live_verdicts(w: DataFrame, run: str = "run") -> DataFrame:
    """Verdicts of runs that are still being logged, with a message; two complete steps are needed."""
    curve = complete_steps(w)
    known = verdicts(curve, run, least=2)
    valid = curve.groupBy(run).agg((F.count(VALID) > 0).alias("has_valid"))
    all_runs = w.select(run).distinct().join(known, run, "left").join(valid, run, "left")
    message = F.when(F.coalesce("n", F.lit(0)) < 2, "pas assez de points complets").when(~F.col("has_valid"), "sans perte de validation").otherwise("")
    return all_runs.select(run, "verdict", message.alias("message"))


def nearest_steps(evals: DataFrame, train: DataFrame, run: str = "run", tie: str | None = None, parts: int | None = None) -> DataFrame:
    """Each evaluation (run, etape, ord, value columns) with the nearest train step, as etape_train.

    Of two equally near the smaller step wins, or the one of the smaller ``tie``
    column of ``train`` (of any type that has an order). Each different (run, etape) is looked up
    once, over as many tasks as the steps fill, and evaluations are joined to their own;
    no pairs are formed. Runs without train steps and evaluations without a step give nothing.
    """
    steps = train.filter("etape is not null").groupBy(run, F.col("etape").cast("int").alias("etape")).agg((F.min(tie) if tie else F.min(F.lit(0))).alias("tie"))
    steps = steps.select(run, "etape", F.struct("etape", "tie").alias("s"), F.lit(False).alias("asked"))
    wanted = evals.filter("etape is not null").select(run, F.col("etape").cast("int").alias("etape"), F.lit(True).alias("asked")).distinct()
    keys = steps.unionByName(wanted, allowMissingColumns=True).groupBy(run, "etape").agg(F.max("s").alias("s"), F.bool_or("asked").alias("asked"))
    rows = with_neighbours(keys, run, "etape", "s", before="lo", after="hi", parts=parts).filter("asked and (lo is not null or hi is not null)")
    far = lambda c: F.struct(F.abs(F.col(f"{c}.etape") - F.col("etape")).alias("d"), F.col(f"{c}.tie").alias("tie"), F.col(f"{c}.etape").alias("etape"))
    near = F.when(F.col("lo").isNull(), far("hi")).when(F.col("hi").isNull(), far("lo")).otherwise(F.least(far("lo"), far("hi")))
    near = rows.select(F.col(run).alias("_run"), F.col("etape").alias("_etape"), near["etape"].alias("etape_train"))
    points = evals.withColumn("etape", F.col("etape").cast("int"))
    found = points.join(near, points[run].eqNullSafe(near["_run"]) & (points["etape"] == near["_etape"]))
    return found.select(run, "etape", *[c for c in evals.columns if c not in (run, "etape")], "etape_train")


def curve_from_log(log: DataFrame, run: str = "run") -> DataFrame:
    """Trainer log rows (run, ord, step, loss, grad_norm, eval_loss) as a curve: evaluations go to the nearest train step, the last one of a step wins."""
    train = log.filter("loss is not null and step is not null").groupBy(run, F.col("step").cast("int").alias("etape")).agg(F.max_by(F.struct("loss", F.coalesce("grad_norm", F.lit(0.0)).alias("grad_norm")), "ord").alias("t"))
    evals = log.filter("eval_loss is not null and step is not null").select(run, F.col("step").cast("int").alias("etape"), "ord", "eval_loss")
    at = nearest_steps(evals, train.select(run, "etape"), run).groupBy(run, F.col("etape_train").alias("etape")).agg(F.max_by("eval_loss", "ord").alias(VALID))
    return train.join(at, [run, "etape"], "left").select(run, "etape", F.col("t.loss").alias(TRAIN), VALID, F.col("t.grad_norm").alias(GRAD))


def long_points(curve: DataFrame, run: str = "run") -> DataFrame:
    """The curve as (run, etape, nom, valeur), missing validation losses left out."""
    return curve.unpivot([run, "etape"], [TRAIN, VALID, GRAD], "nom", "valeur").filter("valeur is not null")


def final_metrics(log: DataFrame, names: list[str], run: str = "run") -> DataFrame:
    """The last value of each name over the log (run, ord, name columns)."""
    return last_values(log.unpivot([run, "ord"], names, "nom", "valeur").filter("valeur is not null"), run)


def last_values(long: DataFrame, run: str = "run") -> DataFrame:
    """The last value of each name of a long log (run, ord, nom, valeur)."""
    return long.groupBy(run, "nom").agg(F.max_by("valeur", "ord").alias("valeur"))


def last_row(w: DataFrame, names: list[str], run: str = "run") -> DataFrame:
    """Each run's values at its last step, 0 where missing."""
    return w.groupBy(run).agg(*[F.coalesce(F.max_by(n, "etape"), F.lit(0.0)).alias(n) for n in names])


def best_trial(trials: DataFrame) -> DataFrame:
    """Of trials (ord, verdict, perte_train, perte_validation at the last point): healthy ones first, then the least final loss, then the first."""
    return trials.orderBy((F.col("verdict") != "saine").cast("int"), F.coalesce(VALID, TRAIN), "ord").limit(1)
