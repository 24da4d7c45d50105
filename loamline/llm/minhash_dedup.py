"""MinHash near-duplicate groups by a multi-index Hamming join.

A signature holds ``CHUNKS * WIDTH`` MinHash values cut to ``BITS`` bits. Two
signatures that differ in at most ``2 * CHUNKS - 1`` positions must, by the
pigeonhole principle, have a chunk with at most one differing position, so it is
enough to index every chunk once per position left out (one allowed error). At a
similarity of exactly 0.8 a chunk has at most one error with probability 0.655;
all of 12 chunks fail together for 3 pairs in a million.

Equal shingle sets fall into one class before anything is paired. Within an index
bucket members are first compared with one centre only, the member that shares
most buckets. Where a bucket still holds several components, the members outside its
largest meet those of that component, and each other, by the rarest prints of their
whole sets (prefix filter); a bound of the common part from the prints, which is never
too small, leaves only pairs that may link. No link between different texts is lost:
every pair that shares a bucket is inside one component already, ruled out by its
prints, or compared on its full shingle sets.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamline.llm.common import discard, staged

CHUNKS, WIDTH, BITS = 12, 6, 16
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (multiply and shift)."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


_SEEDS = _mix(np.arange(1, CHUNKS * WIDTH + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_POWERS = np.full(1 << 10, 0x100000001B3, dtype=np.uint64)
_POWERS[0] = 1
_POWERS = np.cumprod(_POWERS, dtype=np.uint64)


def _powers(n: int) -> np.ndarray:
    global _POWERS
    while len(_POWERS) < n:
        _POWERS = np.concatenate([_POWERS, _POWERS * (_POWERS[-1] * np.uint64(0x100000001B3))])
    return _POWERS


#: Long texts are hashed in parts of so many bytes, cut at white space, for bounded memory.
PART = 1 << 20
_GAP = re.compile(rb"[\x20\x09-\x0D]")


def word_hashes(data: bytes) -> np.ndarray:
    """A 64-bit hash of each word (bytes other than space and U+0009-U+000D), A-Z lower-cased."""
    out, at = [], 0
    while len(data) - at > PART and (gap := _GAP.search(data, at + PART)):
        out.append(_word_hashes(data[at : gap.end()]))
        at = gap.end()
    return np.concatenate([*out, _word_hashes(data[at:])])


def _word_hashes(data: bytes) -> np.ndarray:
    raw = np.frombuffer(data, dtype=np.uint8)
    word = ~_SPACE[raw]
    edge = np.diff(word.astype(np.int8), prepend=0, append=0)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(starts):
        return np.empty(0, dtype=np.uint64)
    lengths = ends - starts
    first = starts[0]
    at = np.arange(first, len(raw)) - np.repeat(starts, np.diff(np.r_[starts, len(raw)]))
    np.minimum(at, lengths.max(), out=at)
    values = (_FOLD[raw[first:]].astype(np.uint64) + np.uint64(1)) * _powers(int(lengths.max()) + 1)[at] * word[first:]
    return _mix(np.add.reduceat(values, starts - first) + lengths.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def shingle_set(text: str | None, size: int) -> np.ndarray:
    """Sorted distinct hashes of the text's ``size``-word shingles.

    Fewer words make one shingle of the whole sequence; no words, an empty set.
    """
    words = word_hashes((text or "").encode("utf-8", "surrogatepass"))
    if not len(words):
        return words
    n = max(1, len(words) - size + 1)
    out = np.full(n, min(len(words), size), dtype=np.uint64)
    for k in range(min(size, len(words))):
        out = _mix(out * np.uint64(0x9E3779B97F4A7C15) + words[k : k + n])
    return np.unique(out)


def _signature(shingles: np.ndarray) -> np.ndarray:
    best = np.full(len(_SEEDS), np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(shingles), 2048):  # bounded memory for long texts
        np.minimum(best, ((shingles[at : at + 2048] ^ _SEEDS[:, None]) * _M1).min(axis=1), out=best)
    return (_mix(best) & np.uint64((1 << BITS) - 1)).astype(np.int32)


def _index_keys(signatures: np.ndarray) -> np.ndarray:
    """For each row, a key for every chunk and every position left out of it."""
    rows = signatures.reshape(-1, CHUNKS, WIDTH).astype(np.uint64)
    out = np.empty((len(rows), CHUNKS, WIDTH), dtype=np.uint64)
    for left_out in range(WIDTH):
        key = np.broadcast_to(np.arange(CHUNKS, dtype=np.uint64) * np.uint64(WIDTH) + np.uint64(left_out + 1), rows.shape[:2]).copy()
        for k in range(WIDTH):
            if k != left_out:
                key = _mix(key * np.uint64(0x9E3779B97F4A7C15) + rows[:, :, k])
        out[:, :, left_out] = key
    return out.reshape(len(rows), CHUNKS * WIDTH).view(np.int64)


def _lists(rows: np.ndarray, kind: pa.DataType) -> pa.Array:
    width = rows.shape[1]
    return pa.ListArray.from_arrays(pa.array(np.arange(0, rows.size + 1, width, dtype=np.int32)), pa.array(rows.ravel(), type=kind))


def _signed(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(at, 512) for at in range(0, batch.num_rows, 512)):
                counts, classes, signatures = [], [], []
                for text in part.column("text"):
                    shingles = shingle_set(text.as_py(), size)
                    counts.append(len(shingles))
                    # two sums of mixed hashes name the set; equal sets, and only they, agree
                    sums = [int(_mix(shingles ^ np.uint64(s)).sum(dtype=np.uint64)) for s in (0x1234567, 0x89ABCDE)]
                    classes.append(sums[0].to_bytes(8, "big") + sums[1].to_bytes(8, "big") if len(shingles) else None)
                    signatures.append(_signature(shingles))
                rows = np.array(signatures, dtype=np.int32).reshape(-1, CHUNKS * WIDTH)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("text_key"), pa.array(counts, pa.int64()), pa.array(classes, pa.binary()), _lists(_index_keys(rows), pa.int64())],
                    names=["doc_id", "text_key", "n_shingles", "cls", "keys"],
                )

    return run


def _confirm(size: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple[bytes | None, np.ndarray] = (None, np.empty(0, dtype=np.uint64))
        for batch in batches:
            a, b, same = [], [], []
            for ka, kb, ta, tb in zip(*(batch.column(c) for c in ("a", "b", "text_a", "text_b")), strict=True):
                a.append(ka.as_py())
                b.append(kb.as_py())
                if a[-1] != last[0]:
                    last = (a[-1], shingle_set(ta.as_py(), size))
                other = shingle_set(tb.as_py(), size)
                both = len(np.intersect1d(last[1], other, assume_unique=True))
                same.append(100 * both >= percent * (len(last[1]) + len(other) - both))
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], names=["a", "b"]).filter(pa.array(same, pa.bool_()))

    return run


def _printed(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, folded, prints = [], [], []
            for text in batch.column("text"):
                shingles = shingle_set(text.as_py(), size)
                short = np.unique((shingles >> np.uint64(33)).astype(np.int32))
                counts.append(len(shingles))
                folded.append(len(shingles) - len(short))
                prints.append(short)
            yield pa.RecordBatch.from_arrays([batch.column("cls"), pa.array(counts, pa.int32()), pa.array(folded, pa.int32()), pa.array(prints, pa.list_(pa.int32()))], names=["cls", "n", "folded", "prints"])

    return run


def components(edges: DataFrame) -> DataFrame:
    """Connected components (node, comp) of the edges (a, b) by contraction.

    Each round points every node at its least neighbour, follows the pointers once
    more and contracts. Nodes are named by hashes, so chains of pointers stay short
    and the rounds grow with the logarithm of the nodes. The pointers to a hub have
    one unique row on the other side of each join, so adaptive execution can split them.
    """
    left, names = staged(edges.select("a", "b").distinct(), "edges"), None
    while not left.isEmpty():
        both = left.union(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = staged(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("to")), "pointers")
        jump = staged(least.join(least.select(F.col("a").alias("to"), F.col("to").alias("to2")), "to").select("a", F.col("to2").alias("to")), "pointers")
        if names is None:
            moved = jump.select(F.col("a").alias("node"), F.col("to").alias("comp"))
        else:
            moved = names.join(jump.withColumnRenamed("a", "comp"), "comp", "left").select("node", F.coalesce("to", "comp").alias("comp"))
        moved = staged(moved, "components")
        ends = left.join(jump, "a").select(F.col("to").alias("x"), F.col("b").alias("a")).join(jump, "a").select(F.col("x").alias("a"), F.col("to").alias("b"))
        fewer = staged(ends.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
        discard(least, jump, left, *([] if names is None else [names]))
        left, names = fewer, moved
    discard(left)
    return names if names is not None else edges.sparkSession.createDataFrame([], "node binary, comp binary")


def _sharing_rare_prints(ends: DataFrame, prints: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of ``ends`` (main, cls, comp, is_out), one of them outside the main component, that may be similar enough.

    Two sets that agree in ``percent`` share a print among the rarest n - ceil(n *
    percent / 100) + 1 of each (prefix filter), and from the first one that they share
    on there must be enough prints left. So members meet by what is rare in both.
    """
    often = prints.select(F.explode("prints").alias("p")).groupBy("p").agg(F.count("*").alias("f"))
    ordered = prints.select("cls", "n", "folded", F.explode("prints").alias("p")).join(often, "p").groupBy("cls", "n", "folded").agg(F.sort_array(F.collect_list(F.struct("f", "p"))).alias("r"))
    rare = F.slice(F.transform("r", lambda s: s["p"]), F.lit(1), F.col("n") - F.ceil(F.col("n") * percent / 100).cast("int") + 1)
    ordered = staged(ordered.select("cls", "n", "folded", rare.alias("rare")), "rare")
    each = ends.join(ordered.select("cls", "n", "folded", F.posexplode("rare").alias("at", "p")), "cls")
    x, y = (each.select("main", "p", *[F.col(c).alias(f"{c}_{side}") for c in ("cls", "comp", "n", "folded", "at", "is_out")]) for side in "xy")
    x = x.filter("is_out_x")
    needed = F.ceil((F.col("n_x") + F.col("n_y")) * percent / (100 + percent) - 1e-9) - F.least("folded_x", "folded_y")
    left = F.least(F.col("n_x") - F.col("folded_x") - F.col("at_x"), F.col("n_y") - F.col("folded_y") - F.col("at_y"))
    sized = F.least("n_x", "n_y") * 100 >= F.greatest("n_x", "n_y") * percent
    met = x.join(y, ["main", "p"]).filter((F.col("comp_x") != F.col("comp_y")) & (~F.col("is_out_y") | (F.col("cls_x") < F.col("cls_y"))) & sized & (left >= needed))
    out = staged(met.select(F.least("cls_x", "cls_y").alias("a"), F.greatest("cls_x", "cls_y").alias("b")).distinct(), "sharing")
    discard(ordered)
    return out


def _grouped(docs: DataFrame, shingle_words: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """Every row with the class of its shingle set (doc_id, text_key, n_shingles, cls; null if empty), and the classes with their components (cls, first_id, comp)."""
    docs = docs.select("doc_id", "text", F.xxhash64("text").alias("text_key"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    signed = staged(docs.mapInArrow(_signed(shingle_words), f"doc_id {kind}, text_key bigint, n_shingles bigint, cls binary, keys array<bigint>"), "signatures")

    # one row per class: the least (doc_id, text) stands for it
    classes = signed.filter("cls is not null").groupBy("cls").agg(F.min(F.struct("doc_id", "text_key")).alias("rep"), F.min("doc_id").alias("first_id"), F.first("n_shingles").alias("n"), F.first("keys").alias("keys"))
    classes = staged(classes, "classes")
    indexed = classes.select("cls", F.explode("keys").alias("key"))
    shared = indexed.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").select("key")
    members = staged(indexed.join(shared, "key"), "members")

    # texts of the classes that share a bucket with another
    wanted = members.select("cls").distinct().join(classes.select("cls", "rep", "n"), "cls")
    wanted = wanted.select("cls", "n", F.col("rep.text_key").alias("text_key"), F.col("rep.doc_id").alias("id"))
    texts = docs.join(wanted, (docs.text_key == wanted.text_key) & docs.doc_id.eqNullSafe(wanted.id)).select("cls", "n", "text").dropDuplicates(["cls"])
    texts = staged(texts, "texts")

    def confirmed(pairs: DataFrame) -> DataFrame:
        sizes = texts.select("cls", "n")
        pairs = pairs.join(sizes.toDF("a", "na"), "a").join(sizes.toDF("b", "nb"), "b")
        pairs = pairs.filter(F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent).select("a", "b")
        whole = texts.select("cls", "text")
        return pairs.join(whole.toDF("b", "text_b"), "b").join(whole.toDF("a", "text_a"), "a").select("a", "b", "text_a", "text_b").mapInArrow(_confirm(shingle_words, percent), "a binary, b binary")

    # the member that shares most, over all its buckets, is the centre: copies with few edits come first
    shares = members.join(members.groupBy("key").agg(F.count("*").alias("n")), "key").groupBy("cls").agg(F.sum("n").alias("shares"))
    centres = members.join(shares, "cls").groupBy("key").agg(F.max(F.struct("shares", "cls")).alias("c")).select("key", F.col("c.cls").alias("a"))
    tried = staged(members.join(centres, "key").filter("cls <> a").select("a", F.col("cls").alias("b")).distinct(), "tried")
    links = staged(confirmed(tried), "links")
    grouped = components(links)

    # buckets that still hold several components: who is outside the largest, and of which
    placed = members.join(grouped.toDF("cls", "comp"), "cls", "left").withColumn("comp", F.coalesce("comp", "cls"))
    open_keys = placed.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo <> hi").select("key")
    placed = staged(placed.join(open_keys, "key"), "open")
    largest = placed.groupBy("key", "comp").agg(F.count("*").alias("n")).groupBy("key").agg(F.max(F.struct("n", "comp")).alias("m")).select("key", F.col("m.comp").alias("main"))
    outside = staged(placed.join(largest, "key").filter("comp <> main").select("main", "cls", "comp").distinct(), "outside")
    mains = outside.select("main").distinct()
    inside = grouped.toDF("cls", "comp").join(mains.withColumnRenamed("main", "comp"), "comp").select(F.col("comp").alias("main"), "cls", "comp")
    inside = inside.union(mains.select("main", F.col("main").alias("cls"), F.col("main").alias("comp"))).distinct()
    ends = staged(outside.withColumn("is_out", F.lit(True)).union(inside.withColumn("is_out", F.lit(False))), "ends")
    prints = staged(texts.join(ends.select("cls").distinct(), "cls").select("cls", "text").mapInArrow(_printed(shingle_words), "cls binary, n int, folded int, prints array<int>"), "prints")
    met = staged(_sharing_rare_prints(ends, prints, percent).join(tried, ["a", "b"], "left_anti"), "met")
    x, y = (prints.select(*[F.col(c).alias(f"{c}_{side}") for c in prints.columns]).withColumnRenamed(f"cls_{side}", side) for side in ("a", "b"))
    most = F.size(F.array_intersect("prints_a", "prints_b")) + F.least("folded_a", "folded_b")  # of the common shingles, never too few
    pairs = met.join(x, "a").join(y, "b").filter(100 * most >= percent * (F.col("n_a") + F.col("n_b") - most)).select("a", "b")
    more = staged(confirmed(pairs), "links")
    if not more.isEmpty():
        grouped = components(links.union(more))
    discard(members, texts, tried, links, placed, outside, ends, prints, met, more)

    return signed.select("doc_id", "text_key", "n_shingles", "cls"), classes.select("cls", "first_id").join(grouped.toDF("cls", "comp"), "cls", "left").withColumn("comp", F.coalesce("comp", "cls"))


def near_duplicates(docs: DataFrame, *, shingle_words: int = 5, percent: int = 80) -> DataFrame:
    """Group documents whose shingle sets have a Jaccard similarity of ``percent`` or more.

    ``docs`` needs doc_id and text; other columns are ignored. Returns doc_id,
    n_shingles, component_id (least doc_id that can be reached over links, the
    document's own included) and kept (doc_id = component_id), one row per input row.

    A null, empty or blank text has an empty set and links with nothing. Texts of
    fewer than ``shingle_words`` words are one shingle. Equal sets share a component,
    repeated rows with one doc_id too. Null doc_ids take part, but are no
    component_id unless a component has no other; they are kept only then. Texts
    are read whole; an empty table gives an empty result.
    """
    signed, named = _grouped(docs, shingle_words, percent)
    heads = named.groupBy("comp").agg(F.min("first_id").alias("component_id"))
    by_class = named.join(heads, "comp").select("cls", "component_id")
    out = signed.select("doc_id", "n_shingles", "cls").join(by_class, "cls", "left")
    component = F.when(F.col("cls").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def group_members(docs: DataFrame, *, shingle_words: int = 5, percent: int = 80) -> DataFrame:
    """The members of the groups of two rows or more, so that one row of each can be chosen.

    Returns doc_id, text_key (xxhash64 of the text), n (rows with both) and first:
    true for one member of each group, that with the least doc_id (nulls last), then
    the least text_key. Groups and arguments are those of ``near_duplicates``.
    """
    signed, named = _grouped(docs, shingle_words, percent)
    placed = signed.filter("cls is not null").join(named.select("cls", "comp"), "cls").groupBy("comp", "doc_id", "text_key").agg(F.count("*").alias("n"))
    placed = staged(placed, "placed")
    own = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_key")
    heads = placed.groupBy("comp").agg(F.min(own).alias("head"), F.sum("n").alias("rows")).filter("rows > 1")
    return placed.join(heads, "comp").select("doc_id", "text_key", "n", own.eqNullSafe(F.col("head")).alias("first"))
