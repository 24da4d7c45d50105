"""Spans and masks in time linear in text and matches, and equal to brute force."""

import random
import re
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from loamline.functions import text as tx
from loamline.operators import anonymise, chat, evaluate

W = r"\w"
PLAIN_EMAIL = re.compile(r"[\w.+-]+@[\w-]+\.[a-zA-Z]{2,}")
SPANS = "array<struct<kind:string,start:int,end:int,found:string>>"


def values(spark, rows, schema, expr):
    return [r.x for r in spark.createDataFrame(rows, schema).select(expr.alias("x")).collect()]


def test_running(spark):
    rng = random.Random(1)
    rows = [([rng.randrange(-9, 9) for _ in range(n)],) for n in (0, 1, 2, 3, 7, 8, 9, 100, 1023, 1024, 1025)]
    sums = values(spark, rows, "v array<int>", tx.running(F.col("v"), lambda a, b: a + b))
    most = values(spark, rows, "v array<int>", tx.running(F.col("v"), F.greatest))
    for (v,), s, m in zip(rows, sums, most):
        assert s == [sum(v[: i + 1]) for i in range(len(v))]
        assert m == [max(v[: i + 1]) for i in range(len(v))]


def test_emails_begin_where_they_did(spark):
    """The anchored pattern finds what the plain one does, in random texts of the characters that matter."""
    rng = random.Random(2)
    rows = [("".join(rng.choice("ab.é-+@@. _\n1") for _ in range(rng.randrange(60))),) for _ in range(1500)] + [("a@b.coz@d.fr",), ("a@b.co@d.fr",), ("x@y.frx-z@t.de",)]
    got = values(spark, rows, "t string", tx.spans(F.col("t"), "email", tx.PII["email"]))
    for (t,), found in zip(rows, got):
        assert [(s.start, s.end) for s in found] == [m.span() for m in PLAIN_EMAIL.finditer(t)]
    counts = values(spark, rows, "t string", tx.pii_numbers(F.col("t"), ("email",))[0])
    assert counts == [len(f) for f in got]


def brute_groups(spans):
    out = []
    for s, _, kind, e in sorted((s, -e, k, e) for k, s, e, _ in spans):
        if out and s < out[-1][2]:
            out[-1][2] = max(out[-1][2], e)
        else:
            out.append([kind, s, e])
    return [tuple(g) for g in out]


def test_groups_and_masks(spark):
    rng, rows = random.Random(3), []
    for _ in range(300):
        text = "".join(rng.choice("abé😀 \n") for _ in range(rng.choice([0, 5, 40, 1023, 1024, 1025, 3000])))
        spans = []
        for _ in range(rng.randrange(8)):
            s = rng.randrange(len(text) + 1)
            e = rng.randrange(s, min(len(text), s + rng.choice([3, 30, 2000])) + 1)
            spans.append((rng.choice(["a", "b"]), s, e, text[s:e]))
        rows.append((text, [x for x in spans if x[1] < x[2]]))
    groups = values(spark, rows, f"t string, s {SPANS}", tx.merged(F.col("s")))
    masked = values(spark, rows, f"t string, s {SPANS}", tx.with_spans_masked(F.col("t"), F.col("s")))
    around = values(spark, rows, f"t string, s {SPANS}", tx.with_contexts(F.col("t"), F.col("s")))
    for (t, spans), g, m, c in zip(rows, groups, masked, around):
        want = brute_groups(spans)
        assert [(x.kind, x.start, x.end) for x in g] == want
        out, at = [], 0
        for _, s, e in want:
            out += [t[at:s], tx.MASK]
            at = e
        assert m == "".join(out) + t[at:]
        assert [x.passage for x in c] == [t[max(0, s - 40) : e + 40] for _, s, e, _ in spans]


def test_nulls(spark):
    rows = [(None, None), ("x", []), ("", [])]
    assert values(spark, rows, f"t string, s {SPANS}", tx.with_spans_masked(F.col("t"), F.coalesce("s", F.array().cast(SPANS)))) == [None, "x", ""]
    assert values(spark, rows, f"t string, s {SPANS}", tx.spans(F.col("t"), "email", tx.PII["email"])) == [None, [], []]


def timed(spark, text, expr):
    df = spark.createDataFrame([(text,)], "t string").coalesce(1)
    df.select(expr).collect()
    began = time.time()
    df.select(expr).collect()
    return time.time() - began


@pytest.mark.parametrize("text", ["write a.b@c.de, " * 8000, "x" * 1_000_000, "x@" * 100_000, "a.b" * 100_000 + "@", "12/05/1980 a@b.fr " * 4000], ids=["matches", "letters", "ats", "dots", "two-kinds"])
def test_time_follows_the_text(spark, text):
    """Eight thousand matches, and a million letters without any, take about a second: quadratic code takes minutes."""
    t = F.col("t")
    assert timed(spark, text, F.size(tx.pii_spans(t, ("email", "date")))) < 3
    assert timed(spark, text, F.length(anonymise.masking(t, lambda x: tx.pii_spans(x, ("email", "date")))["masked"])) < 4


def test_bounds_of_long_chats(spark):
    turns = [("user", "é" * (i % 5)) for i in range(3000)]
    df = spark.createDataFrame([(turns,), ([],)], "m array<struct<role:string,contenu:string>>")
    long, none = (r.x for r in df.select(chat.bounds(F.col("m")).alias("x")).collect())
    at = 0
    for (role, text), b in zip(turns, long, strict=True):
        assert (b.debut, b.fin) == (at, at + len(f"<|im_start|>{role}\n{text}<|im_end|>\n"))
        at = b.fin
    assert none == []


LABELS = "array<struct<label:string,start:int,end:int>>"


def opinion(span, entities, lang):
    near = [x for x in entities if x[1] < span[1] and x[2] > span[0]]
    wanted = {"PER", "ORG", "LOC"} if lang == "fr" else {"PERSON", "ORG", "GPE", "LOC", "NORP"}
    return "aucune" if not near else "pertinente" if any(x[0] in wanted for x in near) else "autre"


def test_opinions(spark):
    rng, rows = random.Random(7), []
    for _ in range(400):
        some = lambda n: [(lambda a: (a, a + rng.randrange(1, 9)))(rng.randrange(40)) for _ in range(rng.randrange(n))]  # noqa: B023, E731
        rows.append((some(8), [(rng.choice(["PER", "PERSON", "MISC", "GPE", None]), a, b) for a, b in some(6)], rng.choice(["fr", "en", "de", None])))
    rows.append(([(1, 2)], None, "fr"))
    got = values(spark, rows, f"s array<struct<start:int,end:int>>, e {LABELS}, lang string", tx.opinions(F.col("s"), F.col("e"), F.col("lang")))
    assert got == [[opinion(x, e or [], lang) for x in s] for s, e, lang in rows]


def test_opinions_of_a_hundred_thousand_spans(spark):
    n = 100_000
    span = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.struct((i * 3).alias("start"), (i * 3 + 2).alias("end")))
    known = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.struct(F.lit("PER").alias("label"), (i * 6).alias("start"), (i * 6 + 1).alias("end")))
    df = spark.range(1).select(tx.opinions(span, known, F.lit("fr")).alias("o"))
    began = time.time()
    r = df.select(F.size(F.filter("o", lambda x: x == "pertinente")).alias("p"), F.size("o").alias("n")).first()
    assert (r.p, r.n) == (n // 2, n) and time.time() - began < 20


def test_common_tokens(spark):
    rng = random.Random(8)
    rows = [([rng.choice("aab c1") for _ in range(rng.randrange(12))], [rng.choice("abc 1") for _ in range(rng.randrange(12))]) for _ in range(300)] + [([], []), (["a"] * 3000, ["a"] * 2000 + ["b"] * 999)]
    got = values(spark, rows, "a array<string>, b array<string>", evaluate.common_tokens(F.col("a"), F.col("b")))
    assert got == [sum((Counter(a) & Counter(b)).values()) for a, b in rows]
