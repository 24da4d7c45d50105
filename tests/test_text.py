import re

import pytest
from pyspark.sql import functions as F

from loamline.functions import json_values as js
from loamline.functions import text as tx


def one(spark, text, expr):
    return spark.createDataFrame([(text,)], "t string").select(expr(F.col("t")).alias("x")).first().x


@pytest.mark.parametrize(("nir", "ok"), [("185037511600127", True), ("1 85 03 75 116 001 27", True), ("278062B04500358", True), ("185037511600199", False), ("999999999999999", False), ("12", False), ("", False)])
def test_national_id(spark, nir, ok):
    assert one(spark, nir, tx.valid_nir) is ok


@pytest.mark.parametrize(("age", "token"), [(0, "PEDIATRIQUE"), (12, "PEDIATRIQUE"), (13, "ADOLESCENT"), (17, "ADOLESCENT"), (18, "ADULTE"), (64, "ADULTE"), (65, "PERSONNE_AGEE"), (90, "PERSONNE_AGEE"), (105, "PERSONNE_AGEE")])
def test_age_edges(spark, age, token):
    assert one(spark, f"Une femme de {age} ans", lambda t: tx.age_brackets(t, F.lit("fr"))) == f"Une <AGE_{token}>"


def test_ages_in_text(spark):
    fr = lambda t: tx.age_brackets(t, F.lit("fr"))
    assert one(spark, "Le garçon de 5 ans joue au ballon.", fr) == "Le <AGE_PEDIATRIQUE> joue au ballon."
    assert one(spark, "depuis 7 mois", fr) == "depuis 7 mois"
    assert one(spark, "Patient âgé de 70 ans.", fr) == "Patient <AGE_PERSONNE_AGEE>."
    assert one(spark, "A 7-year-old, 45 years old, aged 20.", lambda t: tx.age_brackets(t, F.lit("es"))) == "A <AGE_PEDIATRIC>, <AGE_ADULT>, <AGE_ADULT>."


@pytest.mark.parametrize("text", ["12/05/1980", "1980-05-12", "12 janvier 2020", "12 January 2020", "3 AOÛT 1999"])
def test_absolute_dates(spark, text):
    assert one(spark, text, tx.is_absolute_date)
    assert one(spark, text, lambda t: tx.masked(t, F.lit("date"))) == tx.MASK


@pytest.mark.parametrize("text", ["il y a 3 semaines", "depuis 2 mois", "pendant 10 jours", "dans 2 ans", "3 months ago", "for 3 years", "since 2 weeks"])
def test_durations(spark, text):
    assert one(spark, text, tx.is_relative_duration)
    assert not one(spark, text, tx.is_absolute_date)
    assert one(spark, text, lambda t: tx.masked(t, F.lit("date"))) == text

#: The patterns of personal data as Python has them, to compare with.
PY = {
    "email": re.compile(r"[\w.+-]+@[\w-]+\.[a-zA-Z]{2,}"),
    "url": re.compile(r"https?://\S+|www\.\S+"),
    "telephone": re.compile(r"(?:\+\d{1,3}[ .-]?)?(?:\(?\d{2,4}\)?[ .-]){2,5}\d{2,4}"),
    "bigramme_capitalise": re.compile(r"\b[A-ZÀ-Ý][a-zà-ÿ]+(?:\s+[A-ZÀ-Ý][a-zà-ÿ]+)+\b"),
}


@pytest.mark.parametrize("text", ["", "jean.é@ex-ample.fr et a@b.co", "😀 voir http://x.y/z?q=1 et www.site.org", "tel 01 02 03 04 05, +33 6.12.34.56.78 ou 192.168.001.022", "Jean\x1cDupont vit à Évry Ville", "½@a.fr", "Marie  Curie"])
def test_spans_agree_with_python(spark, text):
    got = one(spark, text, lambda t: tx.pii_spans(t, tuple(PY)))
    assert [(s.kind, s.start, s.end, s.found) for s in got] == [(k, m.start(), m.end(), m.group()) for k, p in PY.items() for m in p.finditer(text)]


def test_dates_and_context(spark):
    text = "x" * 50 + " le 12/05/1980 " + "y" * 50
    rows = one(spark, text, lambda t: tx.pii_spans(t, ("date",)))
    assert [(r.start, r.end) for r in rows] == [(54, 64)]
    assert one(spark, text, lambda t: tx.context(t, F.lit(54), F.lit(64))) == text[14:104]


def test_overlapping_spans_give_one_token(spark):
    text = "voir http://a.b/c@d.org fin"
    assert one(spark, text, lambda t: tx.with_spans_masked(t, tx.pii_spans(t))) == f"voir {tx.MASK} fin"
    assert one(spark, "a@b.fr", lambda t: tx.with_spans_masked(t, tx.pii_spans(t), "mask")) == "******"
    assert one(spark, "a@b.fr!", lambda t: tx.with_spans_masked(t, tx.pii_spans(t), "redact")) == "!"
    with pytest.raises(ValueError):
        tx.masked(F.lit("a"), F.lit("email"), "hide")


def test_normalise(spark):
    assert one(spark, "  Bonjour,   Docteur !!", tx.normalised) == "bonjour docteur"
    assert one(spark, " \x1ca b  ", lambda t: tx.tokens(t)) == ["a", "b"]
    assert one(spark, "  é  ", tx.strip) == "é"


def cut(text, n):
    """The rule in Python."""
    if len(text) <= n:
        return text
    head = text[:n]
    for sep in (". ", "! ", "? "):
        if (at := head.rfind(sep)) > 0:
            return head[: at + 1]
    at = head.rfind("\n")
    return head[:at].rstrip() if at > 0 else head.rstrip()


@pytest.mark.parametrize("text", ["court", "Un. Deux! Trois? " * 4, "Un! Deux! Trois", "Un? deux trois quatre", "ligne un\nligne deux trois", "mot " * 9, ". abc def ghi jkl mno"])
def test_sentence_cut(spark, text):
    assert one(spark, text, lambda t: tx.cut_at_sentence(t, 18)) == cut(text, 18)


@pytest.mark.parametrize(("text", "level"), [('{"niveau": 3}', "3"), ('x {"niveau": "3"} y', "3"), ('{"niveau": null}', "None"), ('{"niveau": true}', "True"), ("[1]", None), ("rien", None), ('{"a": 1}', None), ('{"niveau": " 2 "}', "2")])
def test_levels(spark, text, level):
    assert one(spark, text, js.level) == level


GOOD = '{"niveau": 3, "categorie": "a", "ressources_estimees": "b"}'


@pytest.mark.parametrize(("text", "ok"), [(f"<think>r</think>{GOOD}", True), (f"  <think>r</think>\n{GOOD} ", True), (f"<think> </think>{GOOD}", False), (GOOD, False), ("<think>r</think>" + GOOD.replace("3", "3.0"), False), ("<think>r</think>" + GOOD.replace("3", "true"), False), ("<think>r</think>" + GOOD.replace('"b"', '"b", "x": 1'), False), ("<think>r</think>" + GOOD.replace(', "ressources_estimees": "b"', ""), False), (f"<think>r</think>{GOOD} fin", False), ("", False)])
def test_strict_diagnosis(spark, text, ok):
    got = one(spark, text, js.diagnosis)
    assert (got is not None) is ok
    if ok:
        assert (got.raisonnement, got.niveau, got.categorie) == ("r", 3, "a")


def test_small_helpers(spark):
    assert one(spark, '{"a":1}{"a":2}', js.split_glued) == ['{"a":1}', '{"a":2}']
    assert one(spark, "{'loss': 1.5, 'epoch': 0.5}", js.python_dict) == {"loss": 1.5, "epoch": 0.5}
    assert one(spark, "{'other': 1}", js.python_dict) is None
    assert one(spark, "3", lambda t: js.capped(t.cast("int"))) == 2
    assert one(spark, "a", lambda t: js.first_turn_prefix(F.lit(0), F.lit(0), "p:", t)) == "p:a"


def test_capitals_of_one_code_point(spark):
    assert one(spark, "straße ŉ ﬁ ᾳ ᾲ ǆ ǅ é ÿ ς 𐐨 ı 2", tx.upper) == "STRAẞE ŉ ﬁ ᾼ ᾲ Ǆ Ǆ É Ÿ Σ 𐐀 I 2"
    assert one(spark, "", tx.upper) == "" and spark.sql("select cast(null as string) as t").select(tx.upper(F.col("t")).alias("x")).first().x is None
    duckdb = pytest.importorskip("duckdb")
    every = [chr(i) for i in range(1, 0x110000) if not 0xD800 <= i <= 0xDFFF]
    texts = ["".join(every[i : i + 4096]) for i in range(0, len(every), 4096)]
    got = [r.x for r in spark.createDataFrame(list(enumerate(texts)), "i int, t string").orderBy("i").select(tx.upper(F.col("t")).alias("x")).collect()]
    assert got == [duckdb.execute("select upper(?)", [t]).fetchone()[0] for t in texts]
