"""Near duplicates of embeddings by a random-projection tree forest.

Equal vectors become one class with a count. Every tree cuts the classes of a label in two,
again and again: a level projects all vectors on one random direction, and a node is split where the
fewest of its vectors lie near the threshold. Vectors nearer to the threshold than
``SPILL`` times the spread of a pair that just links go to both sides. The thresholds of a
node come from quantile sketches over all of its vectors, so nothing is fitted on the driver.

A node ends as a leaf when it is small enough, or when no direction parts it without too
many vectors near the threshold: then it is dense, mostly links, and splitting would lose them.
Leaves are compared exactly in double precision, large ones in pairs of blocks, so no task holds a
whole dense group. A pair is counted in one leaf only, the least that both are in, so counts add
up without any list of pairs; of a leaf's links the edges of a spanning forest go on to the union.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamline.llm.common import discard, staged
from loamline.llm.minhash_dedup import components

#: Levels that one pass over the nodes adds; half the overlap of a split, in standard deviations of a linking pair's difference; the most of a node that may lie in it.
LEVELS, SPILL, CROWD = 8, 0.35, 0.35
#: Vectors of a block; rows of a piece of its matrix.
BLOCK, PIECE = 2048, 512
_GRID = [round(0.05 * k, 2) for k in range(1, 20)]
_CLASS = ["label", "h1", "h2"]


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def _unit(vectors: np.ndarray) -> np.ndarray:
    """Rows of length one; scaled by the largest component first, so squares neither overflow nor vanish."""
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))


def _projected(seed: int, depth: int, threshold: float):
    """cls, tree, node and the projections on the next directions, in standard deviations of a pair that just links."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        directions: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            trees, sizes = (batch.column(c).to_numpy() for c in ("tree", "dim"))
            out = np.zeros((batch.num_rows, LEVELS), dtype=np.float32)
            for tree, dim in {(int(t), int(d)) for t, d in zip(trees, sizes, strict=True)}:
                if (tree, dim) not in directions:
                    made = np.random.default_rng([seed, depth, tree, dim]).standard_normal((dim, LEVELS))
                    directions[tree, dim] = made / np.sqrt((made * made).sum(axis=0)) * math.sqrt(dim / (2 - 2 * threshold))
                here = np.flatnonzero((trees == tree) & (sizes == dim))
                out[here] = _unit(_matrix(batch.column("vec").take(pa.array(here)))) @ directions[tree, dim]
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, out.size + 1, LEVELS, dtype=np.int32)), pa.array(out.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("cls"), batch.column("tree"), batch.column("node"), lists], names=["cls", "tree", "node", "p"])

    return run


def _thresholds(leaf: int):
    """node and the thresholds of its next levels: null where a level is not split."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for n, grids in zip(batch.column("n").to_pylist(), batch.column("grids").to_pylist(), strict=True):
                wanted = max(1, min(LEVELS, math.ceil(math.log2(n / leaf))))
                at: list[float | None] = []
                for q in (np.array(g) for g in grids):
                    middle = q[4:15]  # from a quarter to three quarters
                    crowd = (np.abs(q[None, :] - middle[:, None]) < SPILL).sum(axis=1) / len(q)
                    best = min(range(len(middle)), key=lambda k: (crowd[k], abs(k - 5)))
                    fits = crowd[best] <= CROWD and sum(x is not None for x in at) < wanted
                    at.append(float(middle[best]) if fits else None)
                rows.append(at)
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(rows, pa.list_(pa.float32()))], names=["node", "at"])

    return run


def _routed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each node below that a vector goes to. A node that no level splits stays and is stuck."""
    for batch in batches:
        if not batch.num_rows:
            continue
        cls, tree, node = (batch.column(c).to_numpy() for c in ("cls", "tree", "node"))
        p, at = (np.array(batch.column(c).flatten().to_numpy(zero_copy_only=False), dtype=np.float32).reshape(-1, LEVELS) for c in ("p", "at"))
        stuck = np.isnan(at).all(axis=1)
        row, path = np.arange(len(cls)), np.ones(len(cls), dtype=np.uint64)
        for k in range(LEVELS):
            x, t = p[row, k], at[row, k]
            split = ~np.isnan(t)
            left, right = ~split | (x <= t + np.float32(SPILL)), split & (x >= t - np.float32(SPILL))
            step = path[left] * np.where(split[left], np.uint64(2), np.uint64(1))
            path = np.concatenate([step, path[right] * np.uint64(2) + np.uint64(1)])
            row = np.concatenate([row[left], row[right]])
        with np.errstate(over="ignore"):
            child = node[row].view(np.uint64) ^ (path * np.uint64(0x9E3779B97F4A7C15))
            child = (child ^ (child >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        child = np.where(stuck[row], node[row], child.view(np.int64))
        yield pa.RecordBatch.from_arrays([pa.array(cls[row]), pa.array(tree[row]), pa.array(child), pa.array(stuck[row])], names=["cls", "tree", "node", "stuck"])


def _spanning(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of n points the least point that it is linked with, over any number of links."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        while not np.array_equal(new, new[new]):
            new = new[new]
        if np.array_equal(new, root):
            return root
        root = new


def _compared(threshold: float):
    """Of one leaf, or of a pair of its blocks: (cls, links) with the vectors that it links with here, and (cls, other) edges."""

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.combine_chunks()
        get = lambda c: rows.column(c).to_numpy()
        cls, weight, block, leaf = get("cls"), get("n"), get("block"), get("leaf")[0]
        x, y = get("x")[0], get("y")[0]
        vectors = _unit(_matrix(rows.column("vec").chunk(0)))
        lists = rows.column("leaves").chunk(0)
        owner, ids = np.repeat(np.arange(len(cls)), np.diff(lists.offsets.to_numpy())), lists.flatten().to_numpy()
        owner, ids = owner[ids < leaf], ids[ids < leaf]
        _, ids = np.unique(ids, return_inverse=True)
        shared = np.bincount(ids) > 1 if len(ids) else np.zeros(0, dtype=bool)
        earlier = np.zeros((len(cls), int(shared.sum())), dtype=np.float32)
        place = np.cumsum(shared) - 1
        several = shared[ids] if len(ids) else np.zeros(0, dtype=bool)
        earlier[owner[several], place[ids[several]]] = 1

        links, ends = np.zeros(len(cls), dtype=np.int64), []
        first, second = np.flatnonzero(block == x), np.flatnonzero(block == y)
        for i in range(0, len(first), PIECE):
            a = first[i : i + PIECE]
            for j in range(0 if x != y else i, len(second), PIECE):
                b = second[j : j + PIECE]
                linked = vectors[a] @ vectors[b].T >= threshold
                if x == y and i == j:
                    linked = np.triu(linked, 1)
                if earlier.shape[1] and linked.any():
                    linked &= earlier[a] @ earlier[b].T == 0
                at, to = np.nonzero(linked)
                if len(at):
                    links[a] += linked @ weight[b]
                    links[b] += weight[a] @ linked
                    root = _spanning(len(a) + len(b), at, to + len(a))
                    both = np.concatenate([a, b])
                    moved = root != np.arange(len(root))
                    ends.append((both[moved], both[root[moved]]))
        found = np.flatnonzero(links)
        # the pieces' forests as one: at most an edge a vector leaves the task
        a, b = (np.concatenate(e) for e in zip(*ends, strict=True)) if ends else (np.zeros(0, dtype=np.int64),) * 2
        root = _spanning(len(cls), a, b)
        moved = np.flatnonzero(root != np.arange(len(root)))
        none = lambda n: pa.nulls(n, pa.int64())
        return pa.table({"cls": np.concatenate([cls[found], cls[moved]]), "links": pa.concat_arrays([pa.array(links[found]), none(len(moved))]), "other": pa.concat_arrays([none(len(found)), pa.array(cls[root[moved]])])})

    return run


def leaves_of(classes: DataFrame, *, threshold: float, trees: int, leaf: int, seed: int) -> DataFrame:
    """(cls, node) of all leaves with two classes or more. ``classes`` needs cls, label, dim, vec."""
    # labels with few vectors are one leaf, the same in all trees
    sizes = classes.groupBy("label", "dim").agg(F.count("*").alias("of_label"))
    placed = classes.select("cls", "label", "dim").join(sizes, ["label", "dim"])
    few = F.col("of_label") <= 2 * leaf
    first = placed.select("cls", "label", "dim", few.alias("few"), F.explode(F.when(few, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.lit(trees - 1)))).alias("tree"))
    first = staged(first.select("cls", "few", "tree", F.xxhash64("label", "dim", "tree").alias("node")), "nodes")
    closed, left = [first.filter("few").select("cls", "node")], first.filter("not few").select("cls", "tree", "node")
    used, depth = [first], 0
    while not left.isEmpty():
        vectors = classes.select("cls", "dim", "vec")
        projected = staged(left.join(vectors, "cls").select("cls", "tree", "node", "dim", "vec").mapInArrow(_projected(seed, depth, threshold), "cls bigint, tree int, node bigint, p array<float>"), "projected")
        grids = [F.percentile_approx(F.get("p", F.lit(k)), F.array(*map(F.lit, _GRID)), F.lit(1000)) for k in range(LEVELS)]
        splits = staged(projected.groupBy("node").agg(F.count("*").alias("n"), F.array(*grids).alias("grids")).mapInArrow(_thresholds(leaf), "node bigint, at array<float>"), "splits")
        routed = staged(projected.join(splits, "node").select("cls", "tree", "node", "p", "at").mapInArrow(_routed, "cls bigint, tree int, node bigint, stuck boolean"), "routed")
        # open nodes are few next to vectors: each has more than twice ``leaf`` of them
        large = staged(routed.filter("not stuck").groupBy("node").agg(F.count("*").alias("n")).filter(F.col("n") > 2 * leaf).select("node"), "large")
        closed.append(routed.join(large, "node", "left_anti").select("cls", "node"))
        left = staged(routed.join(large, "node", "left_semi").select("cls", "tree", "node"), "nodes")
        discard(projected, splits)
        used += [routed, large, left]
        depth += 1
    every = closed[0]
    for more in closed[1:]:
        every = every.union(more)
    # a vector may reach a node in one way only, so rows are unique
    alone = every.groupBy("node").agg(F.count("*").alias("in_leaf")).filter("in_leaf > 1")
    out = staged(every.join(alone, "node"), "leaves")
    discard(*used)
    return out


def linked(classes: DataFrame, *, threshold: float = 0.93, trees: int = 8, leaf: int = 256, seed: int = 13) -> DataFrame:
    """(cls, links, other): numbers of vectors linked with each class, and edges that span the components."""
    leaves = leaves_of(classes, threshold=threshold, trees=trees, leaf=leaf, seed=seed)
    of_class = leaves.groupBy("cls").agg(F.sort_array(F.collect_list("node")).alias("leaves"))
    blocks = F.ceil(F.col("in_leaf") / BLOCK).cast("int")
    rows = leaves.join(of_class, "cls").join(classes.select("cls", "n", "vec"), "cls").withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("cls", "n", "vec", "leaves", "block", F.col("node").alias("leaf"), F.least("block", "with").alias("x"), F.greatest("block", "with").alias("y"))
    out = staged(rows.groupBy("leaf", "x", "y").applyInArrow(_compared(threshold), "cls bigint, links bigint, other bigint"), "linked")
    discard(leaves)
    return out


def near_vectors(vectors: DataFrame, *, threshold: float = 0.93, trees: int = 8, leaf: int = 256, seed: int = 13) -> DataFrame:
    """Links and components of vectors with equal labels and a cosine of ``threshold`` or more.

    ``vectors`` needs vec_id, embedding (an array of numbers) and label; other columns are
    ignored. Returns vec_id, n_links (other rows linked directly), component_id (least
    vec_id that can be reached over links, the row's own included) and kept (vec_id =
    component_id), one row per input row.

    Links are exact, none is made below the threshold; one is lost if its vectors share no leaf in
    any tree. Labels of up to twice ``leaf`` different vectors are compared whole. Rows with a null
    label, a null, empty or zero vector, or a null or non-finite component link with
    nothing; nor do vectors of different lengths. Equal vectors of a label are linked, repeated rows
    too. Null vec_ids take part, but are no component_id unless a component has no other. An
    empty table gives an empty result.
    """
    kind = vectors.schema["vec_id"].dataType
    vec = F.col("embedding").cast("array<double>")
    sound = F.col("label").isNotNull() & (F.size(vec) > 0) & ~F.exists(vec, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))) & F.exists(vec, lambda v: v != 0)
    rows = vectors.select("vec_id", "label", "embedding", F.coalesce(sound, F.lit(False)).alias("sound"), F.xxhash64("embedding").alias("h1"), F.xxhash64(F.lit(7), "embedding").alias("h2"))
    ids = staged(rows.select("vec_id", F.when(F.col("sound"), F.col("label")).alias("label"), "h1", "h2"), "vector-ids")
    classes = rows.filter("sound").groupBy(*_CLASS).agg(F.min("vec_id").alias("first_id"), F.count("*").alias("n"), F.first("embedding").alias("vec"))
    classes = staged(classes.select(F.monotonically_increasing_id().alias("cls"), *_CLASS, "first_id", "n", F.size("vec").alias("dim"), "vec"), "vector-classes")
    found = linked(classes, threshold=threshold, trees=trees, leaf=leaf, seed=seed)
    links = found.filter("links is not null").groupBy("cls").agg(F.sum("links").alias("links"))
    # hashed names keep the chains of pointers short
    edges = found.filter("other is not null").select(F.xxhash64("cls").alias("a"), F.xxhash64("other").alias("b"))
    named = classes.select("cls", *_CLASS, "first_id", "n", F.xxhash64("cls").alias("node"))
    if edges.isEmpty():
        placed = named.withColumn("comp", F.col("node"))
    else:
        placed = named.join(components(edges), "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    placed = staged(placed.join(links, "cls", "left"), "vector-components")
    heads = placed.groupBy("comp").agg(F.min("first_id").alias("component_id"))
    by_class = placed.join(heads, "comp").select(*_CLASS, (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component_id")
    by_class = staged(by_class, "vectors-judged")
    discard(classes, found, placed)
    out = ids.join(by_class, _CLASS, "left")
    component = F.when(F.col("n_links").isNull(), F.col("vec_id")).otherwise(F.col("component_id")).cast(kind)
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id")).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
