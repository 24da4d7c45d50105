"""Line dedup by prefix doubling over line-ID sequences.

Documents are sequences of line IDs. Suffixes are sorted by their first line, then
by their first 2, 4, 8 ... lines: a round ranks the pairs (rank here, rank 2^k lines
on). Equal ranks after k rounds are the intervals of the suffix array whose longest
common prefix is 2^k lines or more. Suffixes alone in their interval are unique from
there on and leave the sort, so rounds work on repeated lines only.

A run is worth deleting from ``min_words`` words on. The interval of all suffixes that
share a run of any length is named by the two ranks that cover the run, those of its
first and of its last 2^k lines. For each line the intervals of the shortest such
runs that start and that end there are looked up; all copies but the first are
deleted. A line of a maximal repeated run has ``min_words`` words up to the run's end, and
then the run that starts at the line is inside it, or the shortest run that ends at
that end reaches back to the line: together they add up to the maximal repeated runs,
whole, and doubling ends with the longest of the shortest runs.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loamline.llm.common import discard, staged

DOC = ["doc_id", "text_key"]
_WORD = r"[^\x20\x09-\x0D]+"


def _ranked(counts: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once, with a rank in their order."""
    return staged(counts.filter("n > 1").select(*keys).orderBy(*keys).withColumn("rank", F.monotonically_increasing_id()), "ranks")


def _shortest_runs(active: DataFrame, min_words: int) -> DataFrame:
    """Adds len and back: lines of the shortest runs of repeated lines with ``min_words`` words that start and that end here, or null.

    back is null too where the run is also the shortest from its first line.
    """
    by_pos = Window.partitionBy(*DOC).orderBy("pos")
    island = Window.partitionBy(*DOC, "island")
    before = island.orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    out = active.withColumn("island", F.col("pos") - F.row_number().over(by_pos)).withColumn("base", F.coalesce(F.sum("w").over(before), F.lit(0)))
    out = out.withColumn("total", F.sum("w").over(island)).withColumn("start", F.min("pos").over(island)).withColumn("end", F.max("pos").over(island) + 1)
    out = out.withColumn("through", F.col("base") + F.col("w"))
    beyond = F.min("pos").over(island.orderBy("base").rangeBetween(min_words, Window.unboundedFollowing))
    stop = F.coalesce(beyond, F.when(F.col("total") - F.col("base") >= min_words, F.col("end")))
    # lines that can go and leave min_words words up to here, and their words
    spare = island.orderBy("through").rangeBetween(Window.unboundedPreceding, -min_words)
    first, ahead = F.coalesce(F.max("pos").over(spare) + 1, F.col("start")), F.coalesce(F.max("through").over(spare), F.lit(0))
    back = F.when(F.col("base") - ahead >= min_words, F.col("pos") - first + 1)
    return out.withColumn("len", stop - F.col("pos")).withColumn("back", back).select(*DOC, "pos", "rank", "end", "len", "back")


def repeated_runs(docs: DataFrame, *, min_words: int = 50) -> DataFrame:
    """The line runs to delete: doc_id, text_key (xxhash64 of the text), runs (array of first line, lines; maximal, 0-based)."""
    lines = docs.select("doc_id", F.xxhash64("text").alias("text_key"), F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    lines = staged(lines.select(*DOC, "pos", F.unhex(F.md5("line")).alias("id"), F.regexp_count("line", F.lit(_WORD)).alias("w")).distinct(), "lines")
    ranks = _ranked(lines.groupBy("id").agg(F.count("*").alias("n")), ["id"])
    active = staged(_shortest_runs(lines.join(ranks, "id").select(*DOC, "pos", "w", "rank"), min_words), "active")
    discard(lines, ranks)
    longest = active.agg(F.max(F.greatest("len", "back"))).first()[0] or 0
    backward = staged(active.filter("back is not null").select(F.col("doc_id").alias("bd"), F.col("text_key").alias("bt"), (F.col("pos") - F.col("back") + 1).alias("bp"), F.col("back").alias("b_len")), "backward")

    # each table goes as soon as the next one is written, so two levels at most are there at a time
    level, found = active, []
    k = 0
    while longest >= 1 << k:
        # suffixes whose run has 2^k lines or more, but fewer than 2^(k+1)
        ahead = Window.partitionBy(*DOC).orderBy("pos")
        due = F.col("len").between(1 << k, (2 << k) - 1)
        here = level.filter(due).select(*DOC, "pos", "len", "rank")
        if k:  # runs of one line start and end there alike
            ends = backward.filter(F.col("b_len").between(1 << k, (2 << k) - 1))
            ends = ends.join(level, level["doc_id"].eqNullSafe(ends["bd"]) & (level["text_key"] == ends["bt"]) & (level["pos"] == ends["bp"]))
            here = here.union(ends.select(*DOC, "pos", F.col("b_len").alias("len"), "rank"))
        # the second half of the cover starts len - 2^k lines on
        here = here.withColumn("pos2", F.col("pos") + F.col("len") - (1 << k))
        there = level.select(F.col("doc_id").alias("d"), F.col("text_key").alias("t"), F.col("pos").alias("pos2"), F.col("rank").alias("rank2"))
        cover = here.join(there, here["doc_id"].eqNullSafe(there["d"]) & (here["text_key"] == there["t"]) & (here["pos2"] == there["pos2"])).select(*DOC, "pos", "len", "rank", "rank2")
        cover, name = staged(cover, "cover"), ["rank", "rank2", "len"]
        firsts = cover.groupBy(*name).agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), *DOC, "pos")).alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n")
        # a passage may stand in most documents; as both sides are tables, the join can be broadcast by size or split where it is skewed
        firsts = staged(firsts, "firsts")
        own = F.struct(F.col("doc_id").isNull().alias("no_id"), *DOC, "pos")
        later = cover.join(firsts, name).filter(~own.eqNullSafe(F.col("first"))).select(*DOC, "pos", "len")
        # written at once: a plan over all levels would be large
        found.append(staged(later, "later"))
        discard(cover, firsts)
        k += 1
        if longest >= 1 << k:
            half = 1 << (k - 1)
            on = F.max("rank").over(ahead.rangeBetween(half, half))
            pairs = level.withColumn("rank2", on).filter("rank2 is not null")
            pairs = pairs.filter(F.col("pos") + (1 << k) <= F.col("end"))
            ranks = _ranked(pairs.groupBy(F.col("rank").alias("r1"), F.col("rank2").alias("r2")).agg(F.count("*").alias("n")), ["r1", "r2"])
            above = staged(pairs.join(ranks.withColumnRenamed("rank", "to"), (F.col("rank") == F.col("r1")) & (F.col("rank2") == F.col("r2"))).select(*DOC, "pos", F.col("to").alias("rank"), "end", "len"), "level")
            discard(level, ranks)
            level = above
    runs = reduce(DataFrame.union, found) if found else level.filter("false").select(*DOC, "pos", "len")
    deleted = runs.select(*DOC, F.explode(F.sequence("pos", F.col("pos") + F.col("len") - 1)).alias("pos")).distinct()
    islands = deleted.withColumn("island", F.col("pos") - F.row_number().over(Window.partitionBy(*DOC).orderBy("pos")))
    spans = islands.groupBy(*DOC, "island").agg(F.min("pos").alias("first_line"), F.count("*").cast("int").alias("n_lines"))
    out = staged(spans.groupBy(*DOC).agg(F.array_sort(F.collect_list(F.struct("first_line", "n_lines"))).alias("runs")), "runs")
    discard(level, backward, *found)
    return out


def drop_repeated_runs(docs: DataFrame, *, min_words: int = 50, report: str = "_runs") -> DataFrame:
    """Documents without the later copies of repeated line runs of ``min_words`` words or more.

    ``docs`` needs doc_id and text. Returns all its columns, with text (and n_chars,
    if there) as it is after deletion, and a struct ``report``: n_lines (before),
    n_removed, runs (first line and lines of each maximal deleted run); it takes the
    place of a column of that name. Texts are read whole, however long. The first
    copy by doc_id (nulls last) and line stays. Copies within one document count;
    rows equal in doc_id and text are one document and lose the same lines. Null
    texts stay null, empty ones empty; an empty table gives an empty result.
    """
    cut = repeated_runs(docs, min_words=min_words).select(F.col("doc_id").alias("_d"), F.col("text_key").alias("_t"), F.col("runs").alias("_r"))
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.xxhash64("text").alias("key"))
    # sorted at every size: the runs grow with the corpus
    joined = whole.join(cut.hint("merge"), whole["row.doc_id"].eqNullSafe(cut["_d"]) & (whole["key"] == cut["_t"]), "left")
    lines = F.split("row.text", "\n")
    kept = F.filter(lines, lambda _, i: ~F.exists("_r", lambda r: (i >= r["first_line"]) & (i < r["first_line"] + r["n_lines"])))
    text = F.when(F.col("_r").isNull(), F.col("row.text")).otherwise(F.array_join(kept, "\n"))
    removed = F.aggregate(F.coalesce("_r", F.array().cast("array<struct<first_line:int,n_lines:int>>")), F.lit(0), lambda n, r: n + r["n_lines"])
    columns = {"text": text, "n_chars": F.length(text).cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {"text": text}
    told = F.struct(F.when(F.col("row.text").isNull(), 0).otherwise(F.size(lines)).alias("n_lines"), removed.alias("n_removed"), F.col("_r").alias("runs"))
    return joined.select(*[columns.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns if c != report], told.alias(report))
