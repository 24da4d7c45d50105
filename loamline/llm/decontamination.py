"""Benchmark decontamination over a distributed positional inverted index.

Benchmark texts are cut into windows of consecutive words. Every corpus term that
occurs in a window is counted over the whole corpus, and each window is anchored
at its rarest terms. Neighbouring windows share most anchors, so what is looked up are
the distinct pairs of terms at a distance, each once for all windows that have it.
The index stores the postings (document, position) of all anchor terms, with documents by
numbers, as these are shorter than their keys. For phrases, the postings of the rarest term, shifted back by its offset
in the window, give the possible starts; intersecting them with the shifted postings of
the second leaves almost only true matches, which are then compared word by word; texts without
any are kept out of that by a filter of fixed size. For
proximity matches, in which words may be missing or stand a few places off, the
shifted postings of any two of the ``missing + 2`` rarest terms are intersected with that
slack (at least two of them must be there), and the words of each candidate are counted
near their places. All steps are DataFrame operations.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loamline.llm.common import ascii_lower, discard, staged

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
KEY = ["doc_id", "text_key"]


def words(text: Column) -> Column:
    """The words of a text with A-Z lower-cased; null has none."""
    return F.regexp_extract_all(ascii_lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def _few(terms: DataFrame, name: str) -> DataFrame:
    """Terms of the benchmark as a table of its own in few files: Spark then knows their size, and broadcasts them to the postings only below its threshold."""
    return staged(terms.coalesce(4), name)


def windows(benchmark: DataFrame, size: int) -> tuple[DataFrame, DataFrame]:
    """The distinct windows (win, terms), and which item has which (win, item)."""
    item = benchmark.select(F.col("item_id").cast("string").alias("item"), words(F.col("text")).alias("w")).filter(F.size("w") > 0)
    last = F.greatest(F.lit(1), F.size("w") - (size - 1))
    each = item.select("item", F.explode(F.transform(F.sequence(F.lit(1), last), lambda i: F.slice(F.col("w"), i, size))).alias("terms"))
    each = staged(each.withColumn("win", F.sha2(F.array_join("terms", " "), 256)), "windows")
    return each.groupBy("win").agg(F.first("terms").alias("terms")), each.select("win", "item").filter("item is not null").distinct()


def _may_miss(terms: Column, missing: int) -> Column:
    """How many of a window's words may be missing: ``missing``, but two words are there at least, or the only one."""
    return F.greatest(F.lit(0), F.least(F.lit(missing), F.size(terms) - 2))


def anchored(tokens: DataFrame, wins: DataFrame) -> DataFrame:
    """Each window with its terms, rarest over all documents first: win, terms, r (array of n, term, at)."""
    terms = wins.select("win", "terms", F.posexplode("terms").alias("at", "term"))
    vocabulary = _few(terms.select("term").distinct(), "vocabulary")
    counts = tokens.select(F.explode("words").alias("term")).join(vocabulary, "term").groupBy("term").agg(F.count("*").alias("n"))
    # at most a row for each term of the benchmark, in a table of known size
    ranked = terms.join(_few(counts, "term-counts"), "term", "left").groupBy("win")
    return ranked.agg(F.first("terms").alias("terms"), F.sort_array(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "term", "at"))).alias("r"))


def _terms_of(wins: DataFrame, missing: int | None, phrases: bool) -> DataFrame:
    """Pairs of anchors of each window (w, term, at, n, term2, at2, n2, phrase): for phrases its two rarest terms, for proximity any two of the rarest, two more than may be missing.

    A lone word has no second. Terms that the corpus lacks are left out, and with one no
    phrase can occur.
    """
    pair = lambda x, y, phrase: F.struct(x["term"].alias("term"), x["at"].alias("at"), x["n"].alias("n"), y["term"].alias("term2"), y["at"].alias("at2"), y["n"].alias("n2"), F.lit(phrase).alias("phrase"))
    first, second = F.get("r", F.lit(0)), F.get("r", F.lit(1))
    whole = wins.filter(first["n"] > 0).select("w", pair(first, second, True).alias("p")).select("w", "p.*")
    if missing is None:
        return whole
    there = wins.select("w", F.filter(F.slice("r", F.lit(1), _may_miss(F.col("terms"), missing) + 2), lambda x: x["n"] > 0).alias("r"))
    pairs = F.flatten(F.transform("r", lambda x, i: F.transform(F.filter("r", lambda y, j: j > i), lambda y: pair(x, y, False))))
    near = there.select("w", F.explode(pairs).alias("p")).select("w", "p.*")
    # a lone word's phrase is its proximity match
    return whole.unionByName(near) if phrases else near.unionByName(whole.filter("term2 is null").withColumn("phrase", F.lit(False)))


#: Words of a block of positions.
BLOCK = 256
#: Postings of a term that one task reads; terms with more are dealt by document over several.
POSTINGS = 1 << 17


def _numbered(pairs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Terms (term, tid, parts), the distinct pairs to look up (e, tid, parts, tid2, delta, phrase), and the windows that have them (e, w, at)."""
    terms = pairs.select("term", "n").union(pairs.filter("term2 is not null").select("term2", "n2")).distinct()
    parts = F.floor(F.col("n") / POSTINGS).cast("int") + 1
    terms = _few(terms.select("term", F.monotonically_increasing_id().alias("tid"), parts.alias("parts")), "anchor-terms")
    seconds = terms.select(F.col("term").alias("term2"), F.col("tid").alias("tid2"))
    pairs = pairs.join(terms, "term").join(seconds, "term2", "left")
    pairs = staged(pairs.select("w", "tid", "parts", "at", F.coalesce("tid2", F.lit(-1)).alias("tid2"), F.coalesce(F.col("at2") - F.col("at"), F.lit(0)).alias("delta"), "phrase"), "numbered-pairs")
    own = ["tid", "tid2", "delta", "phrase"]
    entries = staged(pairs.select(*own, "parts").distinct().withColumn("e", F.monotonically_increasing_id()), "entries")
    members = staged(pairs.join(entries.drop("parts"), own).select("e", "w", "at"), "members")
    discard(pairs)
    return terms, entries, members


def _starts(index: DataFrame, entries: DataFrame, members: DataFrame, rows: DataFrame, slack: int) -> DataFrame:
    """Where a pair's terms stand at their distance, exactly for phrases, ``2 * slack`` words off it at most for others: doc_id, text_key, w, spots (array of start, phrase).

    The start is that of the first term. Positions are compared by blocks that few
    distances cross, so the join stays an equality join and most rows meet one block.
    The index names documents by their numbers in ``rows`` (row, doc_id, text_key).
    """
    salted = entries.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    found = index.join(salted, ["tid", "salt"]).select("row", "e", "pos", "tid2", "delta", "phrase")
    alone = found.filter("tid2 < 0").select("row", "e", "pos", "phrase")
    width = max(4 * slack + 1, BLOCK)
    due, off = F.col("pos") + F.col("delta"), F.when(F.col("phrase"), 0).otherwise(2 * slack)
    left = found.filter("tid2 >= 0").withColumn("block", F.explode(F.array_distinct(F.array(F.floor((due - off) / width), F.floor((due + off) / width)))))
    second = entries.filter("tid2 >= 0").select(F.col("tid2").alias("tid")).distinct()
    right = index.join(second, "tid", "left_semi").select("row", "tid", F.col("pos").alias("p2"), F.floor(F.col("pos") / width).alias("block"))
    same = (left["row"] == right["row"]) & (left["tid2"] == right["tid"]) & (left["block"] == right["block"])
    met = left.join(right, same & (F.abs(right["p2"] - left["pos"] - left["delta"]) <= F.when(left["phrase"], 0).otherwise(2 * slack)), "left_semi").select("row", "e", "pos", "phrase")
    starts = alone.union(met).join(rows.select("row", *KEY), "row").join(members, "e").select(*KEY, "w", (F.col("pos") - F.col("at")).alias("start"), "phrase")
    return starts.filter("not phrase or start >= 0").groupBy(*KEY, "w").agg(F.collect_set(F.struct("start", "phrase")).alias("spots"))


#: Rows of the filter of texts and bits of a row as a power of two (4 KB): 8 MB in all, however many documents there are.
FILTER_ROWS, ROW_BITS = 2000, 15


def _likely(texts: DataFrame, keys: DataFrame) -> DataFrame:
    """Texts (with text_key) that have the bit of one of the distinct keys (t): all that have a key, and few others, which the join proper drops.

    The bits are broadcast, which their fixed number allows. With as many keys as bits most
    texts pass, and the join moves them.
    """
    place = lambda key: F.pmod(key, F.lit(FILTER_ROWS << ROW_BITS))
    filter_row, bit = lambda key: F.shiftright(place(key), ROW_BITS), lambda key: place(key).bitwiseAND(F.lit((1 << ROW_BITS) - 1))
    # keys are hashes, so no row of the filter is hot; dealt by row, each is filled in one place
    bits = keys.select(filter_row(F.col("t")).alias("_row"), bit(F.col("t")).alias("_bit")).repartition("_row").groupBy("_row").agg(F.bitmap_construct_agg("_bit").alias("_bits"))
    here = bit(F.col("text_key"))
    byte = F.conv(F.hex(F.substring("_bits", (F.shiftright(here, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    mask = F.get(F.array(*[F.lit(1 << k) for k in range(8)]), here.bitwiseAND(F.lit(7)).cast("int"))
    return texts.withColumn("_row", filter_row(F.col("text_key"))).join(F.broadcast(bits), "_row").filter(byte.bitwiseAND(mask) != 0).select(*texts.columns)


def _stands_near(words_: Column, f: Column, missing: int, slack: int) -> Column:
    """Whether all but ``missing`` of the terms stand within ``slack`` of their places, for a start within ``slack`` of the given one."""
    size, missing = F.size(f["terms"]), _may_miss(f["terms"], missing)
    part = lambda at, n: F.slice(words_, F.greatest(at, F.lit(0)) + 1, F.greatest(F.least(n, n + at), F.lit(0)))
    about = part(f["start"] - 2 * slack, size + 4 * slack)
    enough = F.size(F.array_intersect(f["terms"], about)) >= F.size(F.array_distinct(f["terms"])) - missing

    def at(s: Column) -> Column:
        there = F.filter(F.sequence(F.lit(0), size - 1), lambda i: F.array_contains(part(s + i - slack, F.lit(2 * slack + 1)), F.get(f["terms"], i)))
        return F.size(there) >= size - missing

    return F.when(enough, F.exists(F.sequence(f["start"] - slack, f["start"] + slack), at)).otherwise(False)


def contamination(docs: DataFrame, benchmark: DataFrame, *, window: int = 10, near: tuple[int, int] | None = None) -> DataFrame:
    """Exact and, with ``near`` (missing, slack), near occurrences of benchmark windows in documents.

    ``docs`` needs doc_id and text, ``benchmark`` item_id and text; other columns are
    ignored. A window is ``window`` consecutive words of an item, or all of its words
    if it has fewer but any. Returns, per input row, doc_id, n_words, n_hit (words inside
    an occurrence), n_items and items_sha256 (items with an occurring window, as
    sorted comma-joined strings), n_near (with ``near``) and contaminated (n_hit > 0).

    n_near counts the windows that have a proximity match: all but ``missing`` of their
    words stand within ``slack`` words of their places, counted from some start. Two of the
    words of short windows must be there at least, of a lone word itself. Exact occurrences
    are proximity matches too; ``proximity`` lists the matches.

    Null and empty texts have no words. Items without words match nothing, items
    with a null id count as hits but are not listed, and repeated items count once.
    Rows that share a doc_id are judged by their own texts; repeated rows get
    equal results. With an empty benchmark nothing is hit. Texts are read whole, however
    long.
    """
    return judged_texts(docs, benchmark, window=window, near=near).drop("text_key")


def _candidates(docs: DataFrame, benchmark: DataFrame, window: int, near: tuple[int, int] | None, *, phrases: bool = True) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Numbers of words of all rows (doc_id, text_key, n_words), items of windows (w, item), and what to compare word by word (doc_id, text_key, words, found: array of start, terms, w, exact)."""
    rows = docs.select("doc_id", F.xxhash64("text").alias("text_key"), words(F.col("text")).alias("words"))
    # the number of a row is given as the table is written
    tokens = staged(rows.withColumn("n_words", F.size("words").cast("long")).withColumn("row", F.monotonically_increasing_id()), "tokens")
    wins, items = windows(benchmark, window)
    # windows and terms go by numbers from here on, which are given as the tables are written
    wins = staged(anchored(tokens, wins).withColumn("w", F.monotonically_increasing_id()), "anchors")
    pairs = staged(_terms_of(wins, near[0] if near else None, phrases), "pairs")
    terms, entries, members = _numbered(pairs)
    salt = F.pmod(F.xxhash64("row"), F.col("parts")).cast("int").alias("salt")
    postings = tokens.select("row", F.posexplode("words").alias("pos", "term")).join(terms, "term")
    index = staged(postings.select("tid", "pos", "row", salt), "index")
    # of the words only their number is read from here on
    counted = staged(tokens.drop("words"), "counts")
    discard(tokens)
    starts = staged(_starts(index, entries, members, counted, near[1] if near else 0), "starts")
    discard(index, pairs, terms, entries, members)

    # the few that are left; of other texts only those move whose keys share a bit with one of theirs
    by_doc = starts.join(wins.select("w", "terms"), "w").groupBy(*KEY).agg(F.collect_list(F.struct("w", "terms", "spots")).alias("found"))
    by_doc = by_doc.select(F.col("doc_id").alias("d"), F.col("text_key").alias("t"), "found")
    keys = staged(starts.select(F.col("text_key").alias("t")).distinct(), "hit-texts")
    # a semi-join by the keys would not do: Spark moves it below the filter, and with it all texts
    texts = _likely(docs.select("doc_id", F.xxhash64("text").alias("text_key"), "text"), keys)
    whole = texts.join(by_doc, texts["doc_id"].eqNullSafe(by_doc["d"]) & (texts["text_key"] == by_doc["t"]))
    # written, so that the words are not cut anew for every candidate inside the filter
    written = staged(whole.select(*KEY, words(F.col("text")).alias("words"), "found"), "candidates")
    spots = lambda f: F.transform(f["spots"], lambda x: F.struct(x["start"].alias("start"), f["terms"].alias("terms"), f["w"].alias("w"), x["phrase"].alias("exact")))
    whole = written.withColumn("found", F.flatten(F.transform("found", spots)))
    whole._staged_path = written._staged_path
    items = _few(items.join(wins.select("w", "win"), "win").select("w", "item"), "items")
    discard(wins, starts, keys)
    return counted, items, whole


def judged_texts(docs: DataFrame, benchmark: DataFrame, *, window: int = 10, near: tuple[int, int] | None = None) -> DataFrame:
    """``contamination`` with text_key (xxhash64 of the text) after doc_id: both name the row that was judged. Without ``near`` (missing, slack) no proximity matches are looked for."""
    tokens, items, whole = _candidates(docs, benchmark, window, near)
    true = F.filter("found", lambda f: f["exact"] & (F.slice(F.col("words"), f["start"] + 1, F.size(f["terms"])) == f["terms"]))
    close = F.filter("found", lambda f: ~f["exact"] & _stands_near(F.col("words"), f, *near)) if near else F.slice("found", 1, 0)
    exact = whole.select(*KEY, true.alias("found"), F.size(F.array_distinct(F.transform(F.concat(true, close), lambda f: f["w"]))).cast("long").alias("n_near")).filter((F.size("found") > 0) | (F.col("n_near") > 0))
    spans = F.transform("found", lambda f: F.sequence(f["start"], f["start"] + F.size(f["terms"]) - 1))
    exact = staged(exact.select(*KEY, "n_near", F.size(F.array_distinct(F.flatten(spans))).cast("long").alias("n_hit"), F.array_distinct(F.transform("found", lambda f: f["w"])).alias("wins")).distinct(), "exact")
    discard(whole)

    listed = exact.select(*KEY, F.explode("wins").alias("w")).join(items, "w").groupBy(*KEY).agg(F.array_sort(F.collect_set("item")).alias("items"))
    listed = listed.select(F.col("doc_id").alias("d"), F.col("text_key").alias("t"), "items")
    hits = exact.select(*KEY, "n_hit", "n_near").join(listed, exact["doc_id"].eqNullSafe(listed["d"]) & (exact["text_key"] == listed["t"]), "left").select(F.col("doc_id").alias("d"), F.col("text_key").alias("t"), "n_hit", "n_near", "items")
    out = tokens.select(*KEY, "n_words")
    out = out.join(hits, out["doc_id"].eqNullSafe(hits["d"]) & (out["text_key"] == hits["t"]), "left")
    n_hit, n_near, listed_items = F.coalesce("n_hit", F.lit(0).cast("long")), F.coalesce("n_near", F.lit(0).cast("long")), F.coalesce("items", F.array().cast("array<string>"))
    return out.select(*KEY, "n_words", n_hit.alias("n_hit"), F.size(listed_items).cast("long").alias("n_items"), F.sha2(F.array_join(listed_items, ","), 256).alias("items_sha256"), *([n_near.alias("n_near")] if near else []), (n_hit > 0).alias("contaminated"))


def proximity(docs: DataFrame, benchmark: DataFrame, *, window: int = 10, slack: int = 5, missing: int = 1) -> DataFrame:
    """The proximity matches, a row for each document and window: doc_id, win, start and shift.

    What matches is defined in ``contamination``. shift sums how far the words that are
    there stand from their places, at the start where most are there and the sum is least; it is 0 for
    phrases.
    """
    _, _, whole = _candidates(docs, benchmark, window, (missing, slack), phrases=False)
    likely = F.filter("found", lambda f: _stands_near(F.col("words"), f, missing, slack))
    each = whole.select(*KEY, "words", F.explode(likely).alias("f")).select(*KEY, "words", "f.terms", "f.w", F.explode(F.sequence(F.col("f.start") - slack, F.col("f.start") + slack)).alias("start"))
    # the distance of each word that is there: the least d with the word d places off
    offs = lambda i: F.filter(F.sequence(F.lit(0), F.lit(slack)), lambda d: F.coalesce((F.get("words", F.col("start") + i - d) == F.get("terms", i)) | (F.get("words", F.col("start") + i + d) == F.get("terms", i)), F.get("words", F.col("start") + i - d) == F.get("terms", i), F.get("words", F.col("start") + i + d) == F.get("terms", i)))
    found = F.filter(F.transform(F.sequence(F.lit(0), F.size("terms") - 1), lambda i: F.get(offs(i), F.lit(0))), lambda d: d.isNotNull())
    shift = F.aggregate("d", F.lit(0), lambda s, d: s + d)
    each = each.withColumn("d", found).filter(F.size("d") >= F.size("terms") - _may_miss(F.col("terms"), missing)).withColumn("shift", shift)
    best = F.min_by(F.struct("start", "shift"), F.struct(-F.size("d"), "shift", "start"))
    win = F.sha2(F.array_join(F.first("terms"), " "), 256).alias("win")
    return each.groupBy(*KEY, "w").agg(best.alias("b"), win).select("doc_id", "win", "b.*")
