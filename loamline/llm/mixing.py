"""Mixing sources to target weights by Pareto order sampling.

Every source gets a share of the mix by its weight, at most ``CAP`` times its own
size. A document enters floor(target / size of source) whole copies for certain;
for what is left, documents are ranked by the odds of a random number over the odds
of their inclusion and taken in that order until the source's words are reached.
Random numbers are hashes of doc_id, so reruns agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loamline.llm.common import staged

CAP = 3
#: Bins of the sampling order, in which words are summed before the bin that holds
#: the cut is ordered document by document.
BINS = 4096


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...], cap: float = CAP) -> DataFrame:
    """source, source_size and target of the table (source, source_size), a row for each source; sources are few enough for one task.

    Sources in code point order, null last, take the weights in turn. Resharing the
    excess of capped sources by weight ends at target = min(cap * size, level *
    weight) for one level common to all; sources sorted by cap * size / weight give
    it from running sums.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    each = F.array(*map(F.lit, map(float, weights)))
    s = sizes.withColumn("w", F.element_at(each, (F.row_number().over(by_name) - 1) % len(weights) + 1)).withColumn("cap", F.col("source_size") * float(cap))
    by_level = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    everything = by_level.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    s = s.select("source", "source_size", "w", "cap", F.sum("source_size").over(everything).alias("all"), (F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0.0))).alias("w_left"), F.coalesce(F.sum("cap").over(before), F.lit(0.0)).alias("capped"))
    # with this and all later sources uncapped, the level would be
    s = s.withColumn("level", (F.col("all") - F.col("capped")) / F.col("w_left"))
    level = F.max(F.when(F.col("level") * F.col("w") <= F.col("cap"), F.col("level"))).over(Window.partitionBy())
    return s.select("source", "source_size", F.least(F.col("cap"), F.coalesce(level * F.col("w"), F.col("cap"))).alias("target"))


def mix(docs: DataFrame, *, weights: tuple[float, ...] = (5.0, 2.0, 1.0), cap: float = CAP, seed: int = 42) -> DataFrame:
    """How many words of each document the mix takes.

    ``docs`` needs doc_id, source and text; other columns are ignored. Returns, per
    row, doc_id, size (words), source_size, target (its source's) and taken (words,
    repeats counted; a whole multiple of size, at most ``cap`` times it). The last
    document of a source's order enters if at least half of it fits, so a source
    misses its target by half a document at most. Inclusion odds grow with
    the logarithm of a document's size. Rows with one doc_id share their
    random number and follow each other, by the hash of their texts where they tie. Null and empty texts
    have size 0 and take nothing, a null source is a source; an empty table gives
    an empty result.
    """
    rows = docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("doc_id"))).alias("r"), F.xxhash64("text").alias("tie"))
    rows = staged(rows, "sizes")
    by_source = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.sum(F.col("size") * F.log1p("size")).alias("weighted"))
    goals = targets(by_source.select("source", "source_size"), weights, cap)
    goals = goals.join(by_source.select(F.col("source").alias("s"), "weighted"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    ratio = F.col("target") / F.col("source_size")
    goals = staged(goals.withColumn("copies", F.when(F.col("source_size") > 0, F.least(F.floor(ratio + 1e-9), F.lit(int(cap)))).otherwise(0)).withColumn("rest", F.greatest(F.col("target") - F.col("copies") * F.col("source_size"), F.lit(0.0))), "goals")

    # inclusion probability: the share that is left, by log size about the source's mean
    g = goals.withColumnRenamed("source", "g_source")
    d = rows.join(g, rows["source"].eqNullSafe(g["g_source"])).drop("g_source")
    share = F.when(F.col("source_size") > 0, F.col("rest") / F.col("source_size")).otherwise(0.0)
    mean = F.col("weighted") / F.greatest(F.col("source_size"), F.lit(1))
    p = F.least(share * F.log1p("size") / F.greatest(mean, F.lit(1e-9)), F.lit(0.999999))
    u = (F.conv(F.substring("r", 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)
    odds = (u / (1 - u)) / (p / (1 - p))
    d = d.withColumn("q", F.when((F.col("rest") > 0) & (F.col("size") > 0) & (F.col("copies") < int(cap)), odds))
    d = d.withColumn("bin", F.floor(F.col("q") / (1 + F.col("q")) * BINS).cast("int"))
    # words before each bin, then the order inside the bin of the cut
    sums = d.filter("q is not null").groupBy("source", "bin").agg(F.sum("size").alias("in_bin"), F.first("rest").alias("rest"))
    upto = Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("before", F.coalesce(F.sum("in_bin").over(upto), F.lit(0)))
    cut = staged(sums.filter("before < rest and before + in_bin >= rest").groupBy("source").agg(F.min_by(F.struct("bin", "before"), "bin").alias("cut")), "cut").withColumnRenamed("source", "c_source")
    d = d.join(cut, d["source"].eqNullSafe(cut["c_source"]), "left").drop("c_source")
    inside = Window.partitionBy("source").orderBy("q", "doc_id", "tie").rowsBetween(Window.unboundedPreceding, -1)
    plain = d.filter("q is null or cut is null or bin <> cut.bin").withColumn("more", F.col("q").isNotNull() & (F.col("cut").isNull() | (F.col("bin") < F.col("cut.bin"))))
    near = d.filter("q is not null and bin = cut.bin").withColumn("before", F.col("cut.before") + F.coalesce(F.sum("size").over(inside), F.lit(0)))
    near = near.withColumn("more", F.col("before") + F.col("size") / 2 <= F.col("rest")).drop("before")
    taken = F.col("size") * (F.col("copies") + F.col("more").cast("long"))
    return plain.unionByName(near).select("doc_id", "size", "source_size", "target", taken.cast("long").alias("taken"))
