"""Tables that are written and read again, requests and their audit log, conversations."""

import math
import random
import statistics

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loamline.functions import clock
from loamline.functions import json_values as js
from loamline.operators import anonymise, chat, evaluate, inference
from loamline.plans import queries, tables
from loamline.sources import files

MESSAGES = "identifiant string, messages array<struct<role:string,contenu:string>>"


def test_answers_and_failures(spark, tmp_path):
    def engine(messages, parameters):
        if messages[-1]["content"] == "fail":
            raise TimeoutError("too slow")
        if messages[-1]["content"] == "malformed":
            return {"text": "?"}
        return {"texte": f"{messages[-1]['role']}:{parameters['t']}:{len(messages)}", "nombre_tokens_sortie": 3, "latence_ms": 1.5}

    rows = [("a", [("user", "x"), ("user", "y")]), ("b", [("user", "fail")]), ("c", [("user", "malformed")])]
    answers = inference.answered(spark.createDataFrame(rows, MESSAGES), engine, {"t": 1})
    got = {r.identifiant: r for r in answers.collect()}
    assert got["a"].texte == "user:1:2" and got["a"].erreur is None and got["a"].latence_ms == 1.5
    assert (got["b"].texte, got["b"].type_erreur, got["b"].erreur) == (None, "TimeoutError", "too slow") and got["c"].type_erreur == "KeyError"
    answers.write.parquet(f"{tmp_path}/answers")
    kept = spark.read.parquet(f"{tmp_path}/answers")
    with pytest.raises(inference.InferenceFailure, match="2 requests"):
        inference.settled(kept, f"{tmp_path}/log", "tour", "m1", clock.fixed("t0"))
    log = {r.conversation_id: r for r in inference.logged(spark, f"{tmp_path}/log").collect()}
    assert log["b"].type_evenement == "echec_inference" and log["b"].metadonnees == {"type_evenement_origine": "tour", "type_erreur": "TimeoutError", "erreur": "too slow"}
    assert (log["a"].type_evenement, log["a"].entree, log["a"].horodatage, log["a"].version_modele) == ("tour", "y", "t0", "m1") and log["a"].metadonnees["nombre_tokens_sortie"] == "3"
    assert inference.settled(kept.filter("identifiant = 'a'"), f"{tmp_path}/log", "tour", "m1").count() == 1
    table = spark.createDataFrame([("a", "yes")], "identifiant string, texte string")
    from_table = {r.identifiant: (r.texte, r.type_erreur) for r in inference.answered_from(spark.createDataFrame(rows, MESSAGES), table).collect()}
    assert from_table == {"a": ("yes", None), "b": (None, "KeyError"), "c": (None, "KeyError")}


def test_conversations(spark):
    heads = inference.created(spark.range(3))
    assert heads.select(F.count_distinct("conversation_id")).first()[0] == 3
    schema = "conversation_id string, ord int, role string, contenu string"
    turns = spark.createDataFrame([("a", 0, "user", "x"), ("a", 1, "assistant", "y")], schema)
    known = spark.createDataFrame([("a",), ("b",)], "conversation_id string")
    new = spark.createDataFrame([("a", 5, "user", "z"), ("a", 9, "assistant", "w"), ("b", 0, "user", "first"), ("none", 0, "user", "lost")], schema)
    fresh, unknown = inference.appended(known, turns, new)
    assert sorted(map(tuple, fresh.collect())) == [("a", 2, "user", "z"), ("a", 3, "assistant", "w"), ("b", 0, "user", "first")]
    assert [(r.conversation_id, r.erreur) for r in unknown.collect()] == [("none", "unknown conversation")]
    assert [r.contenu for r in inference.history(turns.union(fresh), "a").collect()] == ["x", "y", "z", "w"]
    assert inference.history(turns, "none").count() == 0


def test_clock(spark):
    old = spark.conf.get("spark.sql.session.timeZone")
    try:
        for zone in ("UTC", "Asia/Tokyo"):
            spark.conf.set("spark.sql.session.timeZone", zone)
            assert spark.range(1).select(clock.iso(F.timestamp_seconds(F.lit(86400)))).first()[0] == "1970-01-02T00:00:00+00:00"
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)
    assert spark.range(1).select(clock.now()).first()[0].endswith("+00:00")


def test_a_swap_cut_short_is_recovered(spark, tmp_path):
    schema = T.StructType([T.StructField("id", T.LongType())])
    path = f"{tmp_path}/t"
    files.overwrite(spark.range(3), path)
    (tmp_path / "t").rename(tmp_path / "t.old-1")  # the first of two renames
    assert files.read_table(spark, path, schema).count() == 3
    (tmp_path / "t").rename(tmp_path / "t.old-2")
    spark.range(5).write.json(f"{path}.new-3")
    assert files.read_table(spark, path, schema).count() == 5
    assert files.read_table(spark, f"{tmp_path}/none", schema, required=False).count() == 0


def test_report_is_made_from_json(spark, tmp_path):
    total = spark.createDataFrame([("b", 4, 1, {"email": 1}), ("a", 0, 0, {})], "source string, lignes long, avec_entite long, par_type map<string,long>")
    anonymise.write_report(total, str(tmp_path))
    text = "\n".join(r.value for r in spark.read.text(f"{tmp_path}/markdown").collect())
    assert text.startswith("| source |") and "| a | 0 | 0 | 0.0 |\n| b | 4 | 1 | 25.0 |" in text
    assert anonymise.markdown(total.limit(0)).count("\n") == 2


def test_templates(spark):
    plain = chat.Template(begin="[", after_role="] ", end="\n")
    m = spark.createDataFrame([([("user", "a"), ("assistant", "b")],)], "m array<struct<role:string,contenu:string>>")
    r = m.select(chat.render(F.col("m"), plain).alias("t"), chat.bounds(F.col("m"), plain).alias("b"), chat.invitation(F.col("m"), plain).alias("i")).first()
    assert r.t == "[user] a\n[assistant] b\n" and [r.t[x.debut : x.fin] for x in r.b] == ["[user] a\n", "[assistant] b\n"] and r.i == r.t + "[assistant] "


@pytest.mark.parametrize("n", [0, 1, 2, 7, 200, 201])
def test_exact_median(spark, n):
    rng = random.Random(n)
    values = [rng.choice([rng.random() * 1e6, 5.0, 5.0, -3.0]) for _ in range(n)]
    d = spark.createDataFrame([(v,) for v in values] + [(None,)], "x double")
    got = evaluate.exact_median(d, "x").first().median
    assert got is None if not n else math.isclose(got, statistics.median(values))


@pytest.mark.parametrize("value", [1.0, 0.1, -2.5, 1e16, 123456789.125, 1e-4, 1.5e-5, 1e100, 3e-10, 0.0, 12345678.0, float("nan"), float("inf")])
def test_floats_as_python_prints_them(spark, value):
    assert spark.createDataFrame([(value,)], "x double").select(js.python_float(F.col("x"))).first()[0] == repr(value)


def test_printed_values(spark):
    row = [1, None], {"a": "it's", "b": 'say "x"\n'}, [True, False], "plain", None
    d = spark.createDataFrame([row], "l array<int>, m map<string,string>, b array<boolean>, s string, n array<int>")
    got = d.select(*[js.printed(F.col(f.name), f.dataType).alias(f.name) for f in d.schema.fields]).first()
    assert tuple(got) == tuple(map(str, row))


def test_masks_take_time_by_the_text_alone(spark):
    """Every span is masked and the plan holds each pattern once, however many spans there are."""
    text = " ".join(f"u{i}@x.fr le 12/05/1980," for i in range(300))
    d = spark.createDataFrame([(text,)], "t string").select(anonymise.rules()(F.col("t"), F.lit("fr")).alias("x"))
    r = d.first().x
    assert r.masked.count("<INFO_MASQUEE>") == 600 and len(r.spans) == 600 and "@" not in r.masked


def test_preferences_with_sharp_s_and_repeated_rows_equal_sql(spark, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    turns = [(k, j, ("user", "assistant")[j], f"{'Wie' if j == 0 else 'So'} heißt {k}?") for k in range(8) for j in range(2)]
    turns += [turns[0], turns[1], turns[9], (8, 0, "user", "Maße"), (8, 1, "assistant", "ßﬁŉ"), (9, 0, "user", None), (9, 1, "assistant", "x")]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from read_parquet('{tmp_path}/conversations.parquet/*.parquet')")
    got = [tuple(r) for r in queries.pref_pairs_override(spark, str(tmp_path)).collect()]
    assert sorted(got) == sorted(con.execute(queries.ORACLES["pref_pairs_override"]).fetchall()) and len(got) == 13


def test_metrics_of_runs_are_summed_exactly(spark, tmp_path):
    rows = [(n, u, x) for n, (u, x) in enumerate([(1, 1e16), (1, 1.0), (1, 1.0), (1, -1e16), (2, 0.1), (2, 0.2), (2, None), (3, None)])]
    spark.createDataFrame(rows, "event_id long, user_id long, value double").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    got = {r.etape: (r.run, r.valeur, r.ms) for r in tables.run_files(spark, str(tmp_path)).collect()}
    assert got == {1: ("b", 2.0, 1500), 2: ("b", math.fsum([0.1, 0.2]), 1500), 3: ("b", None, 1500)}
