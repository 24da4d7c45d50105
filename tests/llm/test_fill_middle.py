"""Fill-in-middle against a brute-force version."""

import hashlib
import re

from loamline.llm import fill_middle
from loamline.llm.queries import fim_digests

DOCS = "doc_id long, text string, fim string, n int, marked string, form string"


def brute(doc_id, text):
    text = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    n = len(units)
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    lo, hi = sorted((h1 % (n + 1), h2 % (n + 1)))
    a, b, c = "".join(units[:lo]), "".join(units[lo:hi]), "".join(units[hi:])
    form = "plain" if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90 else "spm" if h4 % 100 < 20 else "psm"
    out = {"plain": text, "psm": f"<P>{a}<S>{c}<M>{b}", "spm": f"<S>{c}<P>{a}<M>{b}"}[form]
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (doc_id, n, form, *((None, None) if form == "plain" else (len(a), len(b))), sha(out), sha(text))


TEXTS = ["", None, "word", " ", "a b", "Two words, 3 marks!\n\n", "é😀ü ñandú 漢字 ́x", "a\x1fb\x1b0\x1b1\x1f\x1b", "\x1b", "\x1f\x1f", "x <P> y", "<S>", "a<M", "<", "S>P>M>", "\x00\x01 \\$0 $1 \\", "<<S <P M>", "long " * 40_000, "é" * 50_000]


def test_equals_brute_force(spark):
    rows = [(i, t) for k in range(12) for i, t in enumerate(TEXTS, start=100 * k)] + [(None, "null id text"), (5, "twice here"), (5, "twice here")]
    docs = spark.createDataFrame([(i, t, "x", 1, "m", "f") for i, t in rows], DOCS).repartition(3)
    got = [tuple(r) for r in fim_digests(docs).collect()]
    assert sorted(got, key=str) == sorted((brute(*r) for r in rows), key=str)
    assert {r[2] for r in got} == {"plain", "psm", "spm"}


def test_columns_and_nothing(spark):
    docs = spark.createDataFrame([(1, "a b c", "old", 7, "m", "f")], DOCS)
    out = fill_middle.fill_in_middle(docs)
    assert out.columns == ["doc_id", "text", "n", "marked", "form", "fim"]
    r = out.first()
    assert (r.text, r.n, r.form, r.fim.n) == ("a b c", 7, "f", 5)
    assert r.fim.form == "plain" or r.fim.prefix + r.fim.middle + r.fim.suffix == "a b c"
    assert fill_middle.fill_in_middle(docs.limit(0)).count() == 0
