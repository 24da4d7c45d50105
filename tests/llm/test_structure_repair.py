"""Structure repair against trying every sequence of edits, and against one pass over long conversations."""

import hashlib
import heapq
import random
import zlib

import pytest

from loamline.llm import structure_repair as sr

ROWS = "conv_id long, turn long, role string, text string, unit int, cost string"
AFTER = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("a", "u"): "u", ("u", "a"): "a"}


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        d = zlib.crc32(key.encode()) % 20
        role, text = role or " " if role is None else role, " " if text is None else text
        text = "" if d == 1 else "".join(c for c in text if c not in ".!?") if d == 2 else text
        if d:
            out += [(conv, turn, "user" if d == 4 else role, text)] * (2 if d == 3 else 1)
    return out


def in_order(rows):
    return sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))


def faults(rows):
    seen, out = set(), []
    for _, _, role, text in rows:
        bare = text.strip(" \t\n\x0b\x0c\r")
        out.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None)
        seen.add((role, text))
    return out


def cheapest(rows, found):
    """Least (cost, audit, lines) by uniform-cost search over single edits; every order of edits is tried."""
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, i, last, lines = heapq.heappop(heap)
        if (i, last) in done:
            continue
        done.add((i, last))
        if i == len(rows) and last in ("", "a"):
            return cost, audit, lines
        for role in ("user", "assistant"):
            if (last, role[0]) in AFTER:
                heapq.heappush(heap, (cost + 3, audit + "I", i, AFTER[last, role[0]], (*lines, f"{role}:")))
        if i < len(rows):
            _, _, role, text = rows[i]
            heapq.heappush(heap, (cost + 4, audit + "D", i + 1, last, lines))
            if found[i] in (None, "truncated"):
                more = 3 * (found[i] == "truncated")
                if (last, role[:1]) in AFTER:
                    heapq.heappush(heap, (cost + more, audit + "K", i + 1, AFTER[last, role[:1]], (*lines, f"{role}:{text}")))
                for new in ("user", "assistant"):
                    if (last, new[0]) in AFTER:
                        heapq.heappush(heap, (cost + 3 + more, audit + "R", i + 1, AFTER[last, new[0]], (*lines, f"{new}:{text}")))


def brute(conv, rows):
    rows = in_order(rows)
    found = faults(rows)
    turns = [t for _, t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    cost, audit, lines = cheapest(rows, found) if rows else (0, "", ())
    return (conv, gaps, found.count("blank"), found.count("duplicate"), found.count("truncated"), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


def corpus(seed, convs=120):
    rng, rows = random.Random(seed), []
    texts = ["Yes.", "No!", "And?", "cut of", "", None, "  \t", "é 😀 fin.", "a.b", "...", "Yes."]
    for c in [None, *range(convs)]:
        for t in range(rng.randrange(1, 9)):
            role = rng.choice(["user", "assistant"]) if rng.random() < 0.4 else ("user", "assistant")[t % 2]
            role = rng.choice(["system", None, "tool", "", "User"]) if rng.random() < 0.15 or t == 0 and rng.random() < 0.3 else role
            turn = None if rng.random() < 0.1 else t + 2 * (rng.random() < 0.1)
            rows.append((c, turn, role, rng.choice(texts) if rng.random() < 0.5 else f"text {rng.randrange(99)}."))
    return rows + rows[:7] + [(1000 + k, 0, "user", "x.") for k in range(40)]


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "x") for r in rows], ROWS).repartition(3)


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_search(spark, seed):
    rows = corpus(seed)
    conversations = frame(spark, rows)
    got = sorted((tuple(r) for r in sr.repair_report(conversations, sr.damaged(conversations)).collect()), key=str)
    left = damage(rows)
    want = sorted((brute(c, [r for r in left if r[0] == c]) for c in {r[0] for r in rows}), key=str)
    assert got == want


def test_segments_join(spark, monkeypatch):
    """With segments of four rows, joined two at a time, all is as before."""
    monkeypatch.setattr(sr, "SEGMENT", 2)
    monkeypatch.setattr(sr, "FAN", 2)
    monkeypatch.setattr(sr, "BATCH", 50)
    rng = random.Random(5)
    rows = corpus(3, convs=20) + [(7777, t, rng.choice(["user", "assistant", "assistant", "system"]), rng.choice(["Ja.", "cut", f"t{t}."])) for t in range(90)]
    conversations = frame(spark, rows)
    got = sorted((tuple(r) for r in sr.repair_report(conversations, conversations).collect()), key=str)
    plain = [(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows]
    assert got == sorted((brute(c, [r for r in plain if r[0] == c]) for c in {r[0] for r in rows}), key=str)


def test_repaired_turns(spark):
    rows = corpus(4, convs=30)
    turns = sr.ordered(frame(spark, rows))
    out = {}
    for r in sr.repaired_turns(turns, sr.repair_plans(turns)).collect():
        out.setdefault(r.conv_id, []).append((r.place, f"{r.role}:{r.text}"))
    plain = [(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows]
    for c in {r[0] for r in rows}:
        mine = in_order([r for r in plain if r[0] == c])
        assert [x for _, x in sorted(out.get(c, []))] == list(cheapest(mine, faults(mine))[2])


def test_nothing_and_all_dropped(spark):
    empty = frame(spark, [(1, 0, "user", "x.")]).limit(0)
    assert sr.repair_report(empty, sr.damaged(empty)).count() == 0
    one = frame(spark, [(1, 0, "user", "x."), (1, 1, "assistant", None)])
    assert tuple(sr.repair_report(one, one.limit(0)).first()) == (1, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
