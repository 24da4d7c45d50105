"""Answer metrics: exact match, token F1, level accuracy, latency."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loamline.functions import json_values as js
from loamline.functions import text as tx
from loamline.sources.files import staged


def exact_match(expected: Column, got: Column) -> Column:
    return tx.normalised(expected) == tx.normalised(got)


def exact_match_rate(df: DataFrame, expected: str, got: str) -> DataFrame:
    return df.agg(F.coalesce(F.avg(exact_match(F.col(expected), F.col(got)).cast("int")), F.lit(0.0)).alias("exact_match_rate"))


def token_f1(df: DataFrame, key: str, expected: str, got: str) -> DataFrame:
    """key and f1 by the multiset of common tokens: 1 if both sides are empty, 0 if one is or nothing is common. Each row by itself; nothing is shuffled."""
    e, g = tx.tokens(tx.normalised(F.col(expected))), tx.tokens(tx.normalised(F.col(got)))

    def f1(s: Column) -> Column:
        n, k = F.size(s["a"]), F.size(s["b"])
        score = lambda m: F.when((n == 0) & (k == 0), 1.0).when((n == 0) | (k == 0) | (m == 0), 0.0).otherwise(2.0 * m / (n + k))
        return tx.bound(common_tokens(s["a"], s["b"]), score)

    return df.select(key, tx.bound(F.struct(e.alias("a"), g.alias("b")), f1).alias("f1"))


def mean_token_f1(df: DataFrame, key: str, expected: str, got: str) -> DataFrame:
    return token_f1(df, key, expected, got).agg(F.coalesce(F.avg("f1"), F.lit(0.0)).alias("token_f1"))


def _numbered(tokens: Column) -> Column:
    """Each token with its number among equal ones, as one text: so equal multisets have equal sets."""

    def numbered(each: Column) -> Column:
        first = tx.running(F.transform(each, lambda t, i: F.when((i > 0) & (F.get(each, i - 1) == t), 0).otherwise(i)), F.greatest)
        places = F.zip_with(F.transform(each, lambda t, i: F.struct(t.alias("t"), i.alias("i"))), first, lambda x, f: F.concat(x["t"], F.lit(" "), (x["i"] - f).cast("string")))
        return places

    return tx.bound(F.array_sort(tokens), numbered)


def common_tokens(a: Column, b: Column) -> Column:
    """Size of the multiset intersection of two token arrays of one row, by sorting each: n log n."""
    return F.size(F.array_intersect(_numbered(a), _numbered(b)))


def level_accuracy(df: DataFrame, expected: str, got: str) -> DataFrame:
    """paires, comparables (a level on both sides), corrects and justesse (null if none is comparable)."""
    a, b = js.level(F.col(expected)), js.level(F.col(got))
    rows = df.select(a.alias("a"), b.alias("b"))
    out = rows.agg(F.count("*").alias("paires"), F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("comparables"), F.count_if(F.col("a") == F.col("b")).alias("corrects"))
    return out.withColumn("justesse", F.try_divide(F.col("corrects"), F.nullif(F.col("comparables"), F.lit(0))))


def latency(df: DataFrame, seconds: str = "secondes", failed: str = "echec") -> DataFrame:
    """exemples, echecs and latence_moyenne over successes; an error without examples or successes."""
    out = df.agg(F.count("*").alias("exemples"), F.count_if(failed).alias("echecs"), F.avg(F.when(~F.col(failed), F.col(seconds))).alias("latence_moyenne"))
    checked = F.when((F.col("exemples") == 0) | F.col("latence_moyenne").isNull(), F.raise_error(F.lit("no example succeeded"))).otherwise(F.col("latence_moyenne"))
    return out.withColumn("latence_moyenne", checked)


#: Values of a bracket that are put in order; points of the grid that a bracket is taken from; accuracy of the sketch.
IN_ORDER, GRID, ACCURACY = 100_000, 200, 10_000


def _brackets(rows: DataFrame, state: DataFrame, keys: list[str]) -> DataFrame:
    """For each key and quantile: rows below its bracket, rows in it, and a grid of quantiles of those in it."""
    share = F.array(*[F.lit(k / GRID) for k in range(GRID + 1)])
    inside = F.when(F.col("v").between(F.col("lo"), F.col("hi")), F.col("v"))
    both = rows.join(state, keys)
    sketch = F.percentile_approx(F.when(F.col("n_in") > IN_ORDER, inside), share, F.lit(ACCURACY))
    return both.groupBy(*keys, "q", "rank", "lo", "hi").agg(F.count_if(F.col("v") < F.col("lo")).alias("below"), F.count(inside).alias("n_in"), sketch.alias("grid"))


def exact_quantiles(df: DataFrame, c: str, probabilities: list[float], by: list[str] | None = None) -> DataFrame:
    """by, q and value: exact quantiles of a column for each group, between two values in proportion.

    Nulls are left out; infinities and NaN have their places (NaN is the greatest). Brackets that hold
    the wanted ranks come from a sketch of each group and are narrowed by further ones until few enough
    values lie in them, all groups and quantiles at once; only these are put in order. A group
    without values gives no row.
    """
    keys = by or []
    named = [F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]
    # null groups: a struct is never null, and joins as equal
    group = F.struct(*named) if keys else F.struct(F.lit(0).alias("_k0"))
    rows = df.select(group.alias("g"), F.col(c).cast("double").alias("v")).filter("v is not null")
    inf = float("inf")
    finite = ~F.isnan("v") & (F.abs("v") != inf)
    heads = rows.groupBy("g").agg(F.count("*").alias("n"), F.count_if(F.col("v") == -inf).alias("low"), F.count_if(finite).alias("mid"), F.count_if(F.col("v") == inf).alias("high"), F.min(F.when(finite, F.col("v"))).alias("lo"), F.max(F.when(finite, F.col("v"))).alias("hi"))
    wanted = heads.select("*", F.explode(F.array(*map(F.lit, probabilities))).alias("q")).withColumn("at", (F.col("n") - 1) * F.col("q"))
    # the two ranks between which a quantile lies, of all values, and which kind of value is there
    ranks = staged(wanted.select("g", "q", "at", "low", "mid", "high", "lo", "hi", F.explode(F.array_distinct(F.array(F.floor("at"), F.ceil("at")))).alias("rank")), "ranks")
    where = F.when(F.col("rank") < F.col("low"), F.lit(-inf)).when(F.col("rank") < F.col("low") + F.col("mid"), F.lit(None)).when(F.col("rank") < F.col("low") + F.col("mid") + F.col("high"), F.lit(inf)).otherwise(F.lit(float("nan")))
    is_finite = (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("low") + F.col("mid"))
    rows, keys_in = rows.filter(finite), ["g"]
    state = ranks.filter(is_finite).select("g", "q", (F.col("rank") - F.col("low")).alias("rank"), "lo", "hi", F.col("mid").alias("n_in"))
    done = []
    while True:
        seen = staged(_brackets(rows, state.select("g", "q", "rank", "lo", "hi", "n_in"), keys_in), "brackets")
        # the bracket's grid points around the rank, with room for the sketch's error
        share = (F.col("rank") - F.col("below") + 0.5) / F.col("n_in") * GRID
        room = 2 + 2 * GRID / ACCURACY
        low, high = F.get("grid", F.greatest(F.floor(share - room), F.lit(0)).cast("int")), F.get("grid", F.least(F.ceil(share + room), F.lit(GRID)).cast("int"))
        open_ = F.coalesce((F.col("n_in") > IN_ORDER) & ((low > F.col("lo")) | (high < F.col("hi"))), F.lit(False))
        done.append(seen.filter(~open_).select("g", "q", "rank", "lo", "hi", "below"))
        state = staged(seen.filter(open_).select("g", "q", "rank", low.alias("lo"), high.alias("hi"), "n_in"), "narrower")
        if state.isEmpty():
            break
    last = done[0]
    for more in done[1:]:
        last = last.union(more)
    counts = rows.join(last, "g").filter(F.col("v").between(F.col("lo"), F.col("hi"))).groupBy("g", "q", "rank", "below", "v").agg(F.count("*").alias("k"))
    upto = Window.partitionBy("g", "q", "rank").orderBy("v").rowsBetween(Window.unboundedPreceding, -1)
    placed = counts.withColumn("first", F.col("below") + F.coalesce(F.sum("k").over(upto), F.lit(0)))
    found = placed.filter((F.col("first") <= F.col("rank")) & (F.col("rank") < F.col("first") + F.col("k"))).select("g", "q", "rank", "v")
    shifted = ranks.select("g", "q", "at", F.col("rank").alias("r"), F.when(is_finite, F.col("rank") - F.col("low")).alias("rank"), where.alias("odd"))
    values = shifted.join(found, ["g", "q", "rank"], "left").withColumn("x", F.coalesce("odd", "v"))
    two = values.groupBy("g", "q", "at").agg(F.min_by("x", "r").alias("a"), F.max_by("x", "r").alias("b"))
    part = F.col("at") - F.floor("at")
    odd = F.isnan("a") | F.isnan("b") | (F.abs("a") == inf) | (F.abs("b") == inf)
    value = F.when(part == 0, F.col("a")).when(odd, F.col("a") * (1 - part) + F.col("b") * part).otherwise(F.col("a") + (F.col("b") - F.col("a")) * part)
    return two.select(*[F.col(f"g._k{i}").alias(k) for i, k in enumerate(keys)], "q", value.alias("value"))


def exact_median(df: DataFrame, c: str) -> DataFrame:
    """One row, median: the exact median of a column, null without values."""
    return exact_quantiles(df, c, [0.5]).agg(F.max("value").alias("median"))


def exact_sums(df: DataFrame, c: str, by: list[str], name: str) -> DataFrame:
    """``by`` and the sum of a column for each group, the same to the last digit in whatever order and parts the rows come.

    A double is a whole number of millions of a scale, a power of two near to it, and a rest of 60 binary digits:
    these are added as whole numbers, and only the sums of the scales are rounded. Nulls are left out (a group of nulls has null), infinities
    and NaN add up as ever.
    """
    v, inf, unit = F.col("_v"), float("inf"), 1 << 60
    rows = df.select(*by, F.col(c).cast("double").alias("_v"))
    scale = F.when((F.abs(v) != inf) & ~F.isnan(v) & (v != 0), F.floor(F.log2(F.abs(v)) / 20) * 20)
    # to a scale and back in two steps, as the power of the least scale is no finite double
    half = lambda sign: F.pow(F.lit(2.0), sign * F.col("_scale") / 2)
    rows = rows.select(*by, "_v", scale.alias("_scale")).withColumn("_s", v * half(-1) * half(-1))
    whole = F.col("_s").cast("long")
    rest = ((F.col("_s") - whole) * float(unit)).cast("long")
    sums = rows.groupBy(*by, "_scale").agg(F.sum(whole).alias("_n"), F.sum(rest.cast("decimal(20,0)")).alias("_r"), F.sum(F.when(F.col("_scale").isNull(), v)).alias("_odd"))
    over, left = F.expr(f"_r div {unit}BD"), F.expr(f"_r % {unit}BD")
    x = ((F.col("_n") + over).cast("double") + left.cast("double") / float(unit)) * half(1) * half(1)
    parts = sums.select(*by, "_odd", F.when(F.col("_scale").isNotNull(), F.struct("_scale", x.alias("x"))).alias("p"))
    out = parts.groupBy(*by).agg(F.array_sort(F.collect_list("p")).alias("p"), F.max("_odd").alias("_odd"))
    total = F.aggregate("p", F.lit(0.0), lambda a, p: a + p["x"]) + F.coalesce("_odd", F.lit(0.0))
    return out.select(*by, F.when((F.size("p") > 0) | F.col("_odd").isNotNull(), total).alias(name))


def latency_summary(df: DataFrame, name: str, contains: str, seconds: str, ok: str) -> DataFrame:
    """nombre, moyenne, mediane (exact), minimum and maximum of successes whose name contains a text; 0 and nulls if none."""
    rows = df.filter(F.col(name).contains(contains) & F.col(ok))
    out = rows.agg(F.count("*").alias("nombre"), F.avg(seconds).alias("moyenne"), F.min(seconds).alias("minimum"), F.max(seconds).alias("maximum"))
    return out.select("nombre", "moyenne", exact_median(rows, seconds).scalar().alias("mediane"), "minimum", "maximum")


def bounded_sample(df: DataFrame, order: str, k: int = 20) -> DataFrame:
    """The first k rows, for a report to look at."""
    return df.orderBy(order).limit(k)
