"""As-of lookups over many tasks, and exact quantiles, against brute force."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from loamline.operators import asof, curves, evaluate, log_replay


@pytest.mark.parametrize("parts", [None, 1, 7, 40])
def test_neighbours(spark, parts):
    rng = random.Random(1)
    rows = [("hot", o, rng.choice([None, None, None, o * 10])) for o in range(500)] + [(f"r{i}", o, rng.choice([None, o])) for i in range(30) for o in range(rng.randrange(6))] + [(None, 1, None), (None, 2, 5), (None, 4, None), ("none", 1, None)]
    df = spark.createDataFrame(rows, "run string, ord int, v int").repartition(5)
    got = {(r.run, r.ord): (r.lo, r.hi) for r in asof.with_neighbours(df, "run", "ord", "v", before="lo", after="hi", parts=parts).collect()}
    assert len(got) == len(rows)
    for run, o, _ in rows:
        mine = sorted((p, v) for g, p, v in rows if g == run and v is not None)
        assert got[run, o] == (next((v for p, v in reversed(mine) if p <= o), None), next((v for p, v in mine if p >= o), None))


def test_one_run_lies_over_many_tasks(spark):
    df = spark.range(20_000).select(F.lit("r").alias("run"), F.col("id").alias("ord"), F.when(F.col("id") % 999 == 5, F.col("id")).alias("step"))
    out = log_replay.filled_steps(df, "run", "ord", "step", "seen", parts=16)
    sizes = [r["n"] for r in out.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()]
    assert max(sizes) < 20_000
    want = {o: max((s for s in range(5, o + 1, 999)), default=0) for o in range(0, 20_000, 37)}
    assert {r.ord: r.seen for r in out.filter("ord % 37 = 0").collect()} == want


@pytest.mark.parametrize("parts", [None, 9])
def test_nearest_steps(spark, parts):
    rng = random.Random(2)
    train = [(r, s, rng.randrange(5)) for r in ("a", "b", None) for s in rng.sample(range(300), 60)] + [("a", 7, 3), ("a", 7, 0)]
    evals = [(rng.choice(["a", "b", "c", None]), rng.randrange(-20, 330), o, float(o)) for o in range(400)] + [("a", 100, 1000 + k, 1.0) for k in range(200)] + [("a", None, 2000, 0.0)]
    t = spark.createDataFrame(train, "run string, etape int, place int")
    e = spark.createDataFrame(evals, "run string, etape int, ord int, valeur double").repartition(3)
    for tie in (None, "place"):
        got = sorted((r.ord, r.etape, r.valeur, r.etape_train) for r in curves.nearest_steps(e, t, "run", tie=tie, parts=parts).collect())
        want = []
        for run, step, o, v in evals:
            mine = {}
            for g, s, p in train:
                if g == run:
                    mine[s] = min(p, mine.get(s, 99)) if tie else 0
            if mine and step is not None:
                want.append((o, step, v, min(mine, key=lambda s: (abs(s - step), mine[s], s))))
        assert got == sorted(want)


def test_places_of_many_bars_in_a_line(spark):
    """Over a thousand bars in one line come before those of the next line."""
    bar = lambda step: f"{step}/5000 [00:{step % 60:02d}<00:01, 1.0s/it]"
    lines = spark.createDataFrame([("r", 0, "\r".join(bar(s) for s in range(1, 1500))), ("r", 1, bar(2000)), ("r", 2, bar(3) + bar(2000))], "run string, ord int, line string")
    places = {r.etape: tuple(r.place) for r in log_replay.elapsed(lines).collect()}
    assert places[1499] == (0, 1498) and places[2000] == (1, 0) and places[3] == (0, 2)


def quantile(values, q):
    """With NaN as the greatest, between two values in proportion."""
    v = sorted(values, key=lambda x: (math.isnan(x), x))
    at = (len(v) - 1) * q
    a, b, part = v[math.floor(at)], v[math.ceil(at)], at - math.floor(at)
    return a if part == 0 else a * (1 - part) + b * part


def same(a, b):
    return (math.isnan(a) and math.isnan(b)) or a == b or math.isclose(a, b, rel_tol=1e-12)


@pytest.mark.parametrize("in_order", [100_000, 20])
def test_exact_quantiles(spark, monkeypatch, in_order):
    monkeypatch.setattr(evaluate, "IN_ORDER", in_order)
    rng = np.random.default_rng(3)
    inf, nan = float("inf"), float("nan")
    groups = {"tail": list(np.exp(rng.standard_normal(3000) * 8)), "ties": [1.0] * 2000 + [2.0] * 1999 + list(rng.standard_normal(50)), "odd": [inf, -inf, nan, 1.0, 2.0, 5.0], "inf": [1.0, 2.0, inf], "one": [3.0], "ends": [-inf, inf], "low": [-inf, 2.0], "nans": [nan, nan, 1.0], None: list(rng.integers(0, 9, 500).astype(float))}
    rows = [(g, float(x)) for g, v in groups.items() for x in v] + [("tail", None), ("empty", None)]
    df = spark.createDataFrame(rows, "g string, x double").repartition(4)
    probabilities = [0.0, 0.01, 0.5, 0.99, 1.0]
    got = {(r.g, r.q): r.value for r in evaluate.exact_quantiles(df, "x", probabilities, ["g"]).collect()}
    assert got.keys() == {(g, q) for g in groups for q in probabilities}
    assert all(same(got[g, q], quantile(v, q)) for g, v in groups.items() for q in probabilities), [(g, q, got[g, q], quantile(v, q)) for g, v in groups.items() for q in probabilities if not same(got[g, q], quantile(v, q))]


@pytest.mark.parametrize(("values", "want"), [([1.0, 2.0, float("inf")], 2.0), ([1.0, 2.0], 1.5), ([], None), ([1e308, -1e308, 5.0], 5.0)])
def test_exact_median(spark, values, want):
    assert evaluate.exact_median(spark.createDataFrame([(v,) for v in values], "x double"), "x").first().median == want


def test_exact_sums(spark):
    rng = random.Random(5)
    draw = [lambda: round(rng.random() * 500, 2), lambda: rng.gauss(0, 1) * 10 ** rng.randrange(-12, 12), lambda: math.ldexp(rng.random() - 0.5, rng.randrange(-1074, 900)), lambda: rng.choice([1, -1]) * 2.0 ** rng.randrange(-1020, 1000)]
    groups = {f"g{g}": [draw[g % 4]() for _ in range(rng.randrange(1, 400))] for g in range(80)}
    groups |= {"none": [None], "zero": [None, 0.0], "inf": [math.inf, 1.0], "nan": [math.inf, -math.inf], "far": [1e100, 1.0, -1e100], "apart": [0.1, -0.1], "least": [5e-324, 5e-324], "most": [1.7e308, -1.7e308, 3.0], None: [1.5, None, 2.25]}
    rows = [(g, x) for g, xs in groups.items() for x in xs]
    sums = []
    for parts in (1, 9):
        rng.shuffle(rows)
        df = spark.createDataFrame(rows, "g string, x double").repartition(parts)
        sums.append({r.g: r.s for r in evaluate.exact_sums(df, "x", ["g"], "s").collect()})
    assert repr(sorted(sums[0].items(), key=str)) == repr(sorted(sums[1].items(), key=str))
    got = sums[0]
    assert [got[k] for k in ("none", "zero", "inf", "far", "apart", "least", "most", None)] == [None, 0.0, math.inf, 1.0, 0.0, 1e-323, 3.0, 3.75] and math.isnan(got["nan"])
    for g in (g for g in groups if str(g).startswith("g")):
        want = math.fsum(groups[g])
        assert abs(got[g] - want) <= 2 * math.ulp(want), g
