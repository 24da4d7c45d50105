"""Conversation structure repair at least cost.

A conversation's roles should read: a system turn or none, then user and assistant in
turn; or nothing at all. Each row is kept, given another role or deleted, and empty turns may be
inserted anywhere, each at a cost. The roles put out so far leave a grammar in one of
four states, so the least cost (and, among equal ones, the least audit) of each state is
all that a prefix has to remember.

Rows are ordered over the whole table and dealt by hash into batches of bounded size. In a
batch one recursive DuckDB query advances all conversations by one turn a step and keeps the
minimum of each (conversation, state). Long conversations are cut into segments: a segment is
solved from each of the four states, and segments, with their costs from state to state, are
turns of a shorter conversation that the same query solves. So a conversation with a third of all
rows is many units, and no batch has to hold it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import duckdb
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loamline.llm.common import discard, staged

#: Turns of a segment (as a power of two), segments that are joined at a time, weight (in rows) of a batch.
SEGMENT, FAN, BATCH = 8, 64, 20_000
RANK_ROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
_SPACES = " \t\n\x0b\x0c\r"
#: States: nothing yet, after a system turn, after a user's, after an assistant's.
_AFTER = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}
#: Inserts that end a conversation in each state.
_ENDING = {0: 0, 1: 2, 2: 1, 3: 0}
_EDGES = "array<struct<f:int,t:int,cost:bigint,audit:string>>"
_INITIALS = ["s", "u", "a", ""]


def _moves() -> list[tuple[int, int, int, int, str]]:
    """(kind, from, to, cost, edits) of a row, inserts before it included. Kind 0 has to go; 1 to 4 are whole rows, 5 to 8 truncated ones, by initial."""
    reached = {(f, f): "" for f in range(4)}
    for _ in range(2):
        for (f, g), done in list(reached.items()):
            for role in "ua":
                if g in _AFTER[role]:
                    reached.setdefault((f, _AFTER[role][g]), done + "I")
    best: dict[tuple[int, int, int], tuple[int, str]] = {}
    for kind in range(9):
        initial, more = _INITIALS[(kind - 1) % 4], TRUNCATED * (kind > 4)
        for (f, g), inserts in reached.items():
            ways = [(g, DELETE, "D")]
            if kind:
                ways += [(_AFTER[initial][g], more, "K")] if g in _AFTER.get(initial, {}) else []
                ways += [(_AFTER[role][g], RANK_ROLE + more, "R") for role in "ua" if g in _AFTER[role]]
            for t, cost, edit in ways:
                found = (cost + INSERT * len(inserts), inserts + edit)
                best[kind, f, t] = min(best.get((kind, f, t), found), found)
    return [(*k, *v) for k, v in best.items()]


_SOLVE = """
WITH RECURSIVE items AS MATERIALIZED (
  SELECT dense_rank() OVER (ORDER BY conv_id, unit) AS u, row_number() OVER (PARTITION BY conv_id, unit ORDER BY place) AS i, * FROM batch
), edges AS MATERIALIZED (
  {edges}
), best(u, f, s, i, m) USING KEY (u, f, s) AS (
  SELECT u, f, f, 0::BIGINT, {{'cost': 0::BIGINT, 'audit': ''}} FROM (SELECT DISTINCT u FROM items), (VALUES (0), (1), (2), (3)) v(f)
  UNION
  SELECT b.u, b.f, e.t, b.i + 1, min({{'cost': b.m.cost + e.cost, 'audit': b.m.audit || e.audit}})
  FROM best b JOIN edges e ON e.u = b.u AND e.i = b.i + 1 AND e.f = b.s GROUP BY b.u, b.f, e.t, b.i
), whole AS (
  SELECT u, count(*) AS n, any_value(conv_id) AS conv_id, any_value(unit) AS unit, arg_min(first, i) AS first, arg_max(last, i) AS last, sum(illegal + met)::BIGINT AS illegal
  FROM (SELECT *, (lag(last) OVER w IS NOT NULL AND lag(last) OVER w || first NOT IN ('su', 'ua', 'au'))::BIGINT AS met FROM items WINDOW w AS (PARTITION BY u ORDER BY i)) GROUP BY u
)
SELECT w.conv_id, w.unit, w.first, w.last, w.illegal, list({{'f': b.f, 't': b.s, 'cost': b.m.cost, 'audit': b.m.audit}}) AS edges
FROM whole w JOIN best b ON b.u = w.u AND b.i = w.n GROUP BY ALL
"""
_BY_KIND = f"SELECT u, i, f, t, cost, audit FROM items JOIN (VALUES {', '.join(map(str, _moves()))}) m(kind, f, t, cost, audit) USING (kind)"
_BY_SEGMENT = "SELECT u, i, e.f AS f, e.t AS t, e.cost AS cost, e.audit AS audit FROM (SELECT u, i, unnest(edges) AS e FROM items)"


def _solver(edges: str):
    def run(batch: pa.Table) -> pa.Table:
        con = duckdb.connect(config={"threads": 1})
        con.register("batch", batch)
        kinds = pa.list_(pa.struct([("f", pa.int32()), ("t", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())]))
        schema = pa.schema([batch.schema.field("conv_id"), ("unit", pa.int64()), ("first", pa.string()), ("last", pa.string()), ("illegal", pa.int64()), ("edges", kinds)])
        out = con.sql(_SOLVE.format(edges=edges)).to_arrow_table().cast(schema)
        con.close()
        return out

    return run


def _solved(items: DataFrame, edges: str) -> DataFrame:
    """One row a unit: first and last initial, illegal neighbours, and the least (cost, audit) from state to state. ``items`` has a column weight."""
    total = items.agg(F.sum("weight")).first()[0] or 0
    dealt = items.drop("weight").withColumn("batch", F.pmod(F.xxhash64("conv_id", "unit"), F.lit(int(total) // BATCH + 1)))
    run = _solver(edges)
    kind = items.schema["conv_id"].dataType.simpleString()
    return dealt.groupBy("batch").applyInArrow(lambda t: run(t.drop_columns(["batch"])), f"conv_id {kind}, unit bigint, first string, last string, illegal bigint, edges {_EDGES}")


def ordered(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text in the order of their conversations, with a growing number ``at``; written once.

    By turn (nulls first), then role, the text's first 100 characters and its md5; nulls in
    role and text count as one space. Equal rows may be dealt to several tasks.
    """
    rows = conversations.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
    by = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role"), F.col("start"), F.col("digest"), F.col("salt")]
    rows = rows.withColumn("start", F.substring("text", 1, 100)).withColumn("digest", F.md5("text")).withColumn("salt", F.monotonically_increasing_id())
    return staged(rows.repartitionByRange(*by).sortWithinPartitions(*by).select("conv_id", "turn", "role", "text", F.monotonically_increasing_id().alias("at")), "turns")


def _same(a: Column, b: Column) -> Column:
    return a.eqNullSafe(b)


def _with_faults(turns: DataFrame) -> DataFrame:
    """Adds fault (blank, duplicate, truncated or null): the first that holds."""
    bare = F.rtrim(F.col("text"), F.lit(_SPACES))
    facts = turns.select("conv_id", "turn", "at", F.substring("role", 1, 1).alias("initial"), F.unhex(F.md5(F.concat(F.length("role"), F.lit(":"), "role", "text"))).alias("key"), (bare == "").alias("blank"), (~F.substring(bare, -1, 1).isin(".", "!", "?")).alias("open"))
    facts = staged(facts, "facts")
    # of repeated turns alone; a repeated key is one row of this table, so its rows can be split
    seen = facts.groupBy("conv_id", "key").agg(F.min("at").alias("first_at"), F.count("*").alias("n")).filter("n > 1").select(F.col("conv_id").alias("c"), F.col("key").alias("k"), "first_at")
    seen = staged(seen, "repeated")
    out = facts.join(seen, _same(facts["conv_id"], seen["c"]) & (facts["key"] == seen["k"]), "left")
    fault = F.when(F.col("blank"), "blank").when(F.col("at") > F.col("first_at"), "duplicate").when(F.col("open"), "truncated")
    out = staged(out.select("conv_id", "turn", "at", "initial", fault.alias("fault")), "faults")
    discard(facts, seen)
    return out


def repair_plans(turns: DataFrame) -> DataFrame:
    """What is wrong with each conversation of ``ordered`` turns, and its cheapest repair.

    Returns conv_id, gaps, blank, duplicate, truncated, illegal, cost and audit: edits of rows
    in order (K keep, R other role, D delete) and inserts (I), as ``cheapest edits`` of the module. A null
    conv_id is one conversation. Conversations without rows are not in it; an empty table gives none.
    """
    faults = _with_faults(turns)
    count = lambda name: F.count_if(F.col("fault") == name).alias(name)
    counts = faults.groupBy("conv_id").agg(F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).cast("long").alias("gaps"), *map(count, ("blank", "duplicate", "truncated")))
    initial = sum((F.when(F.col("initial") == c, n + 1).otherwise(0) for n, c in enumerate("sua")), F.lit(0))
    initial = F.when(initial == 0, 4).otherwise(initial)
    kind = F.when(F.coalesce(F.col("fault").isin("blank", "duplicate"), F.lit(False)), 0).otherwise(initial + F.when(F.col("fault") == "truncated", 4).otherwise(0))
    items = faults.select("conv_id", F.shiftright("at", SEGMENT).alias("unit"), F.col("at").alias("place"), F.col("initial").alias("first"), F.col("initial").alias("last"), F.lit(0).cast("long").alias("illegal"), kind.cast("int").alias("kind"), F.lit(1).alias("weight"))
    solved, done = staged(_solved(items, _BY_KIND), "segments"), []
    while True:
        # conversations in one piece are done, the others are joined, FAN segments at a time
        pieces = staged(solved.groupBy("conv_id").agg(F.count("*").alias("n")).filter("n > 1").select(F.col("conv_id").alias("c")), "pieces")
        if pieces.isEmpty():
            done.append(solved)
            break
        done.append(staged(solved.join(pieces, _same(solved["conv_id"], pieces["c"]), "left_anti"), "done"))
        left = solved.join(pieces, _same(solved["conv_id"], pieces["c"]), "left_semi")
        places = left.select(F.col("conv_id").alias("c"), F.col("unit").alias("place"), F.row_number().over(Window.partitionBy("conv_id").orderBy("unit")).alias("nth"))
        left = left.join(places, _same(left["conv_id"], places["c"]) & (left["unit"] == places["place"]))
        size = F.aggregate("edges", F.lit(0), lambda n, e: n + F.length(e["audit"]))
        items = left.select("conv_id", ((F.col("nth") - 1) / FAN).cast("long").alias("unit"), "place", "first", "last", "illegal", "edges", (4 + size / 16).alias("weight"))
        fewer = staged(_solved(items, _BY_SEGMENT), "segments")
        discard(pieces, solved)
        solved = fewer
    whole = done[0]
    for more in done[1:]:
        whole = whole.union(more)
    ending = F.transform(F.filter("edges", lambda e: e["f"] == 0), lambda e: F.struct((e["cost"] + sum(F.when(e["t"] == s, INSERT * n).otherwise(0) for s, n in _ENDING.items())).alias("cost"), F.concat(e["audit"], F.element_at(F.array(*[F.lit("I" * _ENDING[s]) for s in range(4)]), e["t"] + 1)).alias("audit")))
    best = whole.select(F.col("conv_id").alias("c"), "illegal", F.array_min(ending).alias("m"))
    out = counts.join(best, _same(counts["conv_id"], best["c"])).select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", F.col("m.cost").alias("cost"), F.col("m.audit").alias("audit"))
    out = staged(out, "plans")
    discard(faults, pieces, *done)
    return out


def _followed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[object, str, str, str] | tuple[object, None, None, None]]:
    """(conv_id, edit, role, text) of each turn put out; (conv_id, None, None, None) ends a conversation.

    A conversation's first row has its audit, the others are its turns in order.
    """
    conv, audit, at, state, begun = None, "", 0, 0, False

    def role_next() -> str:
        return "assistant" if state == 2 else "user"

    def inserts() -> Iterator[tuple[object, str, str, str]]:
        nonlocal at, state
        while at < len(audit) and audit[at] == "I":
            role = role_next()
            at, state = at + 1, _AFTER[role[0]][state]
            yield conv, "I", role, ""

    for batch in batches:
        for c, plan, role, text in zip(*(batch.column(k).to_pylist() for k in ("conv_id", "audit", "role", "text")), strict=True):
            if plan is not None:
                if begun:
                    yield from inserts()
                    yield conv, None, None, None
                conv, audit, at, state, begun = c, plan, 0, 0, True
                continue
            yield from inserts()
            edit, at = audit[at], at + 1
            if edit != "D":
                role = role if edit == "K" else role_next()
                state = _AFTER[role[0]][state]
                yield conv, edit, role, text
    if begun:
        yield from inserts()
        yield conv, None, None, None


def _told(kind: pa.DataType):
    def turns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, n = [], 0
        schema = pa.schema([("conv_id", kind), ("place", pa.int64()), ("edit", pa.string()), ("role", pa.string()), ("text", pa.string())])
        for conv, edit, role, text in _followed(batches):
            n = 0 if edit is None else n + 1
            if edit is not None:
                rows.append({"conv_id": conv, "place": n, "edit": edit, "role": role, "text": text})
            if len(rows) == 2000:
                yield pa.RecordBatch.from_pylist(rows, schema)
                rows = []
        yield pa.RecordBatch.from_pylist(rows, schema)

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, digest, n = [], hashlib.sha256(), 0
        schema = pa.schema([("conv_id", kind), ("n_turns", pa.int64()), ("digest", pa.string())])
        for conv, edit, role, text in _followed(batches):
            if edit is None:
                rows.append({"conv_id": conv, "n_turns": n, "digest": digest.hexdigest()})
                digest, n = hashlib.sha256(), 0
            else:
                digest.update(f"{chr(10) if n else ''}{role}:{text}".encode())
                n += 1
            if len(rows) == 2000:
                yield pa.RecordBatch.from_pylist(rows, schema)
                rows = []
        yield pa.RecordBatch.from_pylist(rows, schema)

    return turns, digests


def _applied(turns: DataFrame, plans: DataFrame) -> DataFrame:
    """Each conversation's audit, then its turns, in one task after the other: they are streamed, whatever their number."""
    first = plans.select("conv_id", F.lit(-1).cast("long").alias("at"), "audit", F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"))
    both = first.union(turns.select("conv_id", "at", F.lit(None).cast("string"), "role", "text"))
    return both.repartition("conv_id").sortWithinPartitions("conv_id", "at")


def _functions(turns: DataFrame):
    return _told(turns.limit(0).select("conv_id").toArrow().schema.field("conv_id").type)


def repaired_turns(turns: DataFrame, plans: DataFrame) -> DataFrame:
    """The repaired conversations: conv_id, place (from 1), edit (K, R or I), role, text."""
    kind = turns.schema["conv_id"].dataType.simpleString()
    return _applied(turns, plans).mapInArrow(_functions(turns)[0], f"conv_id {kind}, place bigint, edit string, role string, text string")


def repaired_digests(turns: DataFrame, plans: DataFrame) -> DataFrame:
    """conv_id, n_turns and the sha256 of the repaired turns, as ``role:text`` lines; a digest is taken as turns pass, so no conversation is held whole."""
    kind = turns.schema["conv_id"].dataType.simpleString()
    return _applied(turns, plans).mapInArrow(_functions(turns)[1], f"conv_id {kind}, n_turns bigint, digest string")


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows of ``conversations`` with the faults of a bad log, by the crc32 of ``conv_id:turn`` modulo 20: 0 dropped, 1 without text, 2 without ``.!?``, 3 twice, 4 as user; nulls count as one space."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn"))) % 20
    rows = conversations.select("conv_id", "turn", text("role").alias("role"), text("text").alias("text"), fault.alias("fault")).filter("fault <> 0")
    rows = rows.select("conv_id", "turn", F.when(F.col("fault") == 4, "user").otherwise(F.col("role")).alias("role"), F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"), "fault")
    return rows.withColumn("copy", F.explode(F.sequence(F.lit(1), F.when(F.col("fault") == 3, 2).otherwise(1)))).select("conv_id", "turn", "role", "text")


def repair_report(conversations: DataFrame, rows: DataFrame) -> DataFrame:
    """One row for every conv_id of ``conversations``: faults and repair of its ``rows``.

    Returns conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit and
    repaired_sha256. Conversations of which ``rows`` has nothing get zeros, an empty audit and
    the hash of the empty string. A null conv_id is one conversation. Extra columns are
    ignored; equal rows are separate turns, the later ones duplicates; an empty table gives no rows.
    """
    turns = ordered(rows)
    plans = repair_plans(turns)
    digests = staged(repaired_digests(turns, plans), "digests").select(F.col("conv_id").alias("c"), "digest")
    found = plans.join(digests, _same(plans["conv_id"], digests["c"])).drop("c")
    ids = conversations.select(F.col("conv_id").alias("id")).distinct()
    out = ids.join(found, _same(ids["id"], found["conv_id"]), "left")
    zeros = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select(F.col("id").alias("conv_id"), *zeros, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("digest", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))
