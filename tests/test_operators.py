import difflib
import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from loamline import schemas
from loamline.functions import text as tx
from loamline.operators import anonymise, audit, chat, curves, dedup, evaluate, log_replay, mapping, profile, sampling
from loamline.plans import queries as plans
from loamline.sources import files
from loamline.streaming import logs


def ids(df, c="identifiant"):
    return sorted(r[c] for r in df.select(c).collect())


# mapping


def test_open_questions(spark):
    raw = spark.createDataFrame([("1", "Q", "A", None), (None, "Q", "A", None), ("2", "", "A", None), ("3", None, None, "R")], "id string, question string, answer string, reponse string")
    rows = mapping.open_questions(raw).collect()
    assert len(rows) == 2 and {r.identifiant_source_brute for r in rows} == {"1", "None"}
    assert all(r.identifiant.startswith("corpus-mediqal_oeq-") and r.prompt[0].contenu == "Q" for r in rows)


def test_multiple_choice(spark):
    schema = "id string, clinical_case string, question string, answer_a string, answer_b string, answer_c string, correct_answers string, task string"
    raw = spark.createDataFrame([("1", "cas", "q", "x", "y", "z", " A, c", "QCM"), ("1", "", "q", "x", "", "z", "b", "QCU"), ("2", None, "q", "x", "y", "z", "C", "QCU")], schema)
    rows = {(r.identifiant_source_brute, r.completion[0].contenu): r for r in mapping.multiple_choice(raw).collect()}
    assert set(rows) == {("1", "x z"), ("2", "z")}
    assert rows["1", "x z"].prompt[0].contenu == "cas\n\nq" and "mcqm" in rows["1", "x z"].identifiant


def test_indexed_choice(spark):
    raw = spark.createDataFrame([("1", "q", "x", "y", "1"), ("2", "q", "x", "y", "2.7"), ("3", "q", "x", "y", "9"), ("4", "q", "x", "y", " 0 ")], "id string, question string, answer_a string, answer_b string, correct_answers string")
    assert sorted((r.identifiant_source_brute, r.completion[0].contenu) for r in mapping.indexed_choice(raw).collect()) == [("1", "y"), ("4", "x")]
    number = spark.createDataFrame([("1", "q", "x", "y", 1.7)], "id string, question string, answer_a string, answer_b string, correct_answers double")
    assert mapping.indexed_choice(number).first().completion[0].contenu == "y"


def test_preferences_keep_the_last_message(spark):
    raw = spark.createDataFrame([("p", "l", "q", [("user", "q"), ("assistant", "a")], [("assistant", "b")]), ("p", "l", "q", [], [("assistant", "b")])], "prompt_id string, label_type string, prompt string, chosen array<struct<role:string,content:string>>, rejected array<struct<role:string,content:string>>")
    (r,) = mapping.preferences(raw).collect()
    assert (r.chosen[0].contenu, r.rejected[0].contenu, r.type_exemple) == ("a", "b", "dpo")
    with pytest.raises(ValueError):
        mapping.mapped(raw, "other")


def test_namespaces_do_not_collide(spark):
    raw = spark.createDataFrame([("1", "q", "a")], "id string, question string, answer string")
    assert mapping.open_questions(raw).first().identifiant != mapping.open_questions(raw, namespace="other").first().identifiant


# dedup, sampling, splits


def test_first_wins(spark):
    d = spark.createDataFrame([("a", 2), ("a", 1), ("b", 3)], "k string, ord int")
    keep, drop = dedup.first_wins(d, "k", "ord")
    assert sorted(map(tuple, keep.collect())) == [("a", 1), ("b", 3)] and [tuple(r) for r in drop.collect()] == [("a", 2)]


def largest_remainder(sizes, n):
    total = sum(sizes.values())
    part = {k: n * (v / total) for k, v in sizes.items()}
    quota = {k: min(int(p), sizes[k]) for k, p in part.items()}
    short = n - sum(quota.values())
    for k in sorted(part, key=lambda k: -(part[k] - int(part[k]))):
        if short > 0 and quota[k] < sizes[k]:
            quota[k] += 1
            short -= 1
    return quota


@pytest.mark.parametrize(("sizes", "n"), [({"a": 80, "b": 15, "c": 5}, 20), ({"a": 5, "b": 500}, 50), ({"a": 3, "b": 3, "c": 3}, 4), ({"a": 1, "b": 1}, 1), ({"a": 10}, 100)])
def test_quotas(spark, sizes, n):
    rows = [(f"{s}{i}", s, 1000 * k + i) for k, (s, m) in enumerate(sizes.items()) for i in range(m)]
    d = spark.createDataFrame(rows, "id string, s string, ord int")
    got = sampling.stratified_sample(d, n, ["s"], "id", "ord").groupBy("s").count().collect()
    want = {k: v for k, v in largest_remainder(sizes, n).items() if v}
    assert {r.s: r["count"] for r in got} == want
    again = sampling.stratified_sample(d.repartition(7), n, ["s"], "id", "ord")
    assert ids(again, "id") == ids(sampling.stratified_sample(d, n, ["s"], "id", "ord"), "id")


def test_split_grows_only(spark):
    d = spark.createDataFrame([(f"d{i:03}", "s" if i % 3 else "t", True, None, i) for i in range(200)], "id string, source string, anonymise boolean, split string, ord int")
    first = sampling.assign_splits(d, ["source"], "id", n=100, order="ord")
    assert first.count() == 100
    merged = d.drop("split").join(first.select("id", "split"), "id", "left")
    out = spark.createDataFrame([("d199",)], "id string")
    more = sampling.assign_splits(merged, ["source"], "id", n=150, excluded=out, order="ord")
    assert more.count() == 50 and not set(ids(more, "id")) & set(ids(first, "id")) and "d199" not in ids(more, "id")
    assert sampling.assign_splits(merged, ["source"], "id", n=100, order="ord").count() == 0
    small = sampling.assign_splits(d.limit(9), ["anonymise"], "id")
    assert [r.split for r in small.collect()] == ["train"] * 9
    counts = sampling.split_counts(first).first()
    assert counts.n_test == sum(int(n * 0.1) for n in [r["count"] for r in first.groupBy("source").count().collect()])


def test_caps_and_quota(spark):
    d = spark.createDataFrame([(i, i % 2) for i in range(10)], "id int, g int")
    assert sampling.capped_per_group(d, "g", ["id"], 2).count() == 4
    assert sampling.capped_per_group(d, "g", ["id"], None).count() == 10
    assert ids(sampling.remaining(d, d.limit(3), "id", "id", 5), "id") == [3, 4]


# evaluation


@pytest.mark.parametrize(("a", "b", "f1"), [("a b", "a b", 1.0), ("a", "b", 0.0), ("   ", "!!!", 1.0), ("a", "", 0.0), ("a a b", "a c", 0.4)])
def test_f1(spark, a, b, f1):
    d = spark.createDataFrame([(1, a, b)], "id int, a string, b string")
    assert math.isclose(evaluate.token_f1(d, "id", "a", "b").first().f1, f1)


def test_rates(spark):
    d = spark.createDataFrame([("x", "X!"), ("y", "z"), ("é", "É")], "a string, b string")
    assert math.isclose(evaluate.exact_match_rate(d, "a", "b").first()[0], 2 / 3)
    assert evaluate.exact_match_rate(d.limit(0), "a", "b").first()[0] == 0.0
    lv = spark.createDataFrame([('{"niveau": 1}', '{"niveau": "1"}'), ('{"niveau": 2}', '{"niveau": 3}'), ("x", "y")], "a string, b string")
    r = evaluate.level_accuracy(lv, "a", "b").first()
    assert (r.paires, r.comparables, r.corrects, r.justesse) == (3, 2, 1, 0.5)
    assert evaluate.level_accuracy(lv.filter("a = 'x'"), "a", "b").first().justesse is None
    with pytest.raises(Exception, match="no example succeeded"):
        evaluate.latency(spark.createDataFrame([], "secondes double, echec boolean")).collect()


# curves


def curve(spark, train, valid=None, grad=None):
    rows = [("r", i, t, (valid or [None] * len(train))[i], (grad or [1.0] * len(train))[i]) for i, t in enumerate(train)]
    return spark.createDataFrame(rows, "run string, etape int, perte_train double, perte_validation double, norme_gradient double")


@pytest.mark.parametrize(("train", "valid", "grad", "verdict"), [([2.0, 0.9], [2.1, 0.95], None, "saine"), ([2.0, 1.5, 1.0, 0.5], [2.0, 1.4, 1.3, 1.8], None, "surapprentissage"), ([1.0, 2.0], None, [1.0, 15.0], "instable"), ([2.0, 1.0], None, None, "saine"), ([1.0, 0.99], None, None, "sous_apprentissage"), ([1.0, float("nan")], None, None, "instable"), ([0.0, 0.0], None, None, "sous_apprentissage"), ([2.0, 1.0], [1.0, float("inf")], None, "instable")])
def test_verdicts(spark, train, valid, grad, verdict):
    assert curves.verdicts(curve(spark, train, valid, grad)).first().verdict == verdict


def test_nearest_steps(spark):
    train = spark.createDataFrame([("r", s) for s in (10, 110, 120, 220, 230, 330)], "run string, etape int")
    evals = spark.createDataFrame([("r", s, s, float(s)) for s in (113, 226, 339, 115)], "run string, etape int, ord int, v double")
    got = {r.etape: r.etape_train for r in curves.nearest_steps(evals, train).collect()}
    assert got == {113: 110, 226: 230, 339: 330, 115: 110}
    assert curves.nearest_steps(evals, train.limit(0)).count() == 0


def test_wide_and_last(spark):
    p = spark.createDataFrame([("r", 2, "a", 1.0, 0), ("r", 1, "a", 2.0, 1), ("r", 1, "a", 3.0, 2)], "run string, etape int, nom string, valeur double, ord int")
    w = curves.wide(p, ["a", "b"])
    assert sorted(map(tuple, w.collect())) == [("r", 1, 3.0, None), ("r", 2, 1.0, None)]
    assert curves.present(w, ["b", "a", "c"]) == ["a"]
    assert curves.last_row(w, ["a", "b"]).first().asDict() == {"run": "r", "a": 1.0, "b": 0.0}


def test_log_replay(spark):
    text = ["run-20240101T100000Z", "2/20 [00:06<00:54, 3.0s/it]", "10/20 [00:32<00:30, 3.0s/it]", "{'loss': 1.0, 'grad_norm': 0.5, 'epoch': 1.0}", "0/8 [00:00<00:01, 3.0s/it]", "{'eval_loss': 0.9, 'epoch': 1.0}", "12/20 [00:39<00:20, 3.0s/it]", "20/20 [01:05<00:00, 3.0s/it]", "{'loss': 0.8, 'epoch': 2.0}"]
    lines = spark.createDataFrame([("r", i, t) for i, t in enumerate(text)], "run string, ord int, line string")
    assert {r.etape: r.ecoule for r in log_replay.elapsed(lines).collect()} == {2: 6, 10: 32, 12: 39, 20: 65}
    t0 = 1704103200.0
    got = sorted((r.etape, r.nom, r.valeur, r.horodatage) for r in log_replay.replayed(lines).collect())
    assert got == [(10, "norme_gradient", 0.5, t0 + 32), (10, "perte_train", 1.0, t0 + 32), (10, "perte_validation", 0.9, t0 + 32), (20, "perte_train", 0.8, t0 + 65)]


# anonymisation and audit


def pivot(spark, rows):
    base = {f.name: None for f in schemas.PIVOT.fields} | {"source": "s", "type_exemple": "sft", "langue": "fr", "symptomes": "", "prompt": [], "completion": [], "chosen": [], "rejected": [], "niveau_confiance": "moyenne", "anonymise": False}
    return spark.createDataFrame([base | r for r in rows], schemas.PIVOT)


def test_anonymise(spark):
    p = pivot(spark, [{"identifiant": "a", "symptomes": "Femme de 30 ans, a@b.fr", "prompt": [("user", "tel 01 02 03 04 05")]}, {"identifiant": "b", "symptomes": "rien", "antecedents": "NIR 185037511600127"}, {"identifiant": "c"}])
    out = anonymise.anonymised(p)
    rows = {r.identifiant: r for r in out.collect()}
    assert rows["a"].symptomes == f"<AGE_ADULTE>, {tx.MASK}" and rows["a"].prompt[0].contenu == f"tel {tx.MASK}" and rows["a"].anonymise
    assert rows["b"].antecedents == f"NIR {tx.MASK}" and rows["c"].kinds == []
    s = anonymise.stats(out)
    assert s.first().asDict() == {"source": "s", "lignes": 3, "avec_entite": 2, "par_type": {"email": 1, "nir": 1, "telephone": 1}}
    twice = anonymise.merged_stats(s.unionByName(s))
    assert anonymise.report(twice).first().asDict() == {"lignes": 6, "avec_entite": 4, "entites": 6, "pct_avec_entite": 100 * 4 / 6}
    assert "| s | 6 | 4 | 66.7 |" in anonymise.markdown(twice)
    assert anonymise.report(s.limit(0)).first().pct_avec_entite == 0.0


def test_audit(spark):
    o = pivot(spark, [{"identifiant": "a", "symptomes": "voir Jean Dupont, a@b.fr", "prompt": [("user", "x"), ("user", "y")]}, {"identifiant": "b", "symptomes": "rien"}])
    m = pivot(spark, [{"identifiant": "a", "symptomes": f"voir {tx.MASK}, a@b.fr", "prompt": [("user", "x")]}, {"identifiant": "b", "symptomes": "rien"}, {"identifiant": "z"}])
    pairs = mapping.text_pairs(o, m)
    assert sorted((r.identifiant, r.champ) for r in pairs.collect()) == [("a", "prompt[0]"), ("a", "symptomes"), ("b", "symptomes")]
    assert ids(audit.untouched(pairs)) == ["b"] and ids(audit.joined(o, m)[1]) == ["z"]
    c = audit.candidates(pairs)
    assert [(r.type_motif, r.verdict) for r in c.collect()] == [("email", audit.CONFIRMED)]
    (f,) = audit.masked_fragments(pairs).collect()
    a, b = "voir Jean Dupont, a@b.fr", f"voir {tx.MASK}, a@b.fr"
    want = [(a[i:j], i, j) for op, i, j, k, n in difflib.SequenceMatcher(None, a, b, autojunk=False).get_opcodes() if op == "replace" and b[k:n] == tx.MASK]
    assert [(f.fragment, f.debut, f.fin)] == want
    e = spark.createDataFrame([("a", "symptomes", [("MISC", 5, 16)])], "identifiant string, champ string, entities array<struct<label:string,start:int,end:int>>")
    assert [r.verdict for r in audit.false_masks(audit.masked_fragments(pairs), e).collect()] == [audit.HUMAN]


def test_fragments_are_what_was_masked(spark):
    rng = random.Random(3)
    rows, want = [], []
    for n in range(80):
        parts, masked, at = [], [], 0
        for k in range(rng.randrange(0, 6)):
            plain = "".join(rng.choice(["le ", "Être à ", "(x) ", ".*\\E ", "\n"]) for _ in range(rng.randrange(1, 4)))
            secret, token = rng.choice([(f"p{n}.{k}@é.fr", tx.MASK), ("de 30 ans", "<AGE_ADULTE>"), (f"01 02 {n:02}", tx.MASK)])
            parts += [plain, secret]
            masked += [plain, token]
            if token == tx.MASK:
                want.append((str(n), secret, at + len(plain), at + len(plain) + len(secret)))
            at += len(plain) + len(secret)
        rows.append((str(n), "s", "fr", 0, "symptomes", "".join(parts) + " fin", "".join(masked) + " fin"))
    rows += [("x", "s", "fr", 0, "c", "other text", f"a {tx.MASK} b"), ("y", "s", "fr", 0, "c", None, tx.MASK), ("z", "s", "fr", 0, "c", "all", tx.MASK), ("u", "s", "fr", 0, "c", "abcd", f"a{tx.MASK}{tx.MASK}d")]
    pairs = spark.createDataFrame(rows, "identifiant string, source string, langue string, champ_ord int, champ string, original string, masque string")
    got = [(r.identifiant, r.fragment, r.debut, r.fin) for r in audit.masked_fragments(pairs).collect()]
    assert sorted(got) == sorted([*want, ("z", "all", 0, 3)])


def test_exclusions_and_decisions(spark):
    d = spark.createDataFrame([("a", "confirme", "accepte"), ("a", "revision_humaine", "rejete"), ("b", "revision_humaine", "en attente"), ("c", "revision_humaine", "accepte"), ("d", "faux_positif_regex", "en attente")], "identifiant string, verdict string, decision string")
    assert {r.identifiant: r.motif for r in audit.exclusion_reasons(d).collect()} == {"a": "confirme", "b": "pendant_revision_humaine"}
    c = audit.verdict_counts(d).first()
    assert (c.confirme, c.revision_humaine, c.en_attente) == (1, 3, 2)


def test_incremental_samples(spark):
    pop = spark.createDataFrame([(f"d{i}",) for i in range(6)], "identifiant string")
    reg = spark.createDataFrame([], schemas.REGISTRY)
    for expected in (4, 2, 0):
        new = audit.new_samples(pop, reg, "x", 4)
        assert new.count() == expected
        reg = reg.union(spark.createDataFrame([(r.identifiant, "x", "t") for r in new.collect()], schemas.REGISTRY))


# chat, profile, files, streams


def test_chat(spark):
    p = pivot(spark, [{"identifiant": "a", "prompt": [("user", "é😀")], "completion": [("assistant", "ok")], "type_exemple": "sft"}])
    r = chat.formatted(p).first()
    assert r.texte == "<|im_start|>user\né😀<|im_end|>\n<|im_start|>assistant\nok<|im_end|>\n"
    assert [r.texte[t.debut : t.fin] for t in r.tours] == ["<|im_start|>user\né😀<|im_end|>\n", "<|im_start|>assistant\nok<|im_end|>\n"]
    lab = chat.formatted(p).select(chat.labels(F.col("texte"), F.col("tours"), chat.code_points).alias("x")).first().x
    assert lab[: r.tours[0].fin] == [-100] * r.tours[0].fin and lab[r.tours[1].debut :] == [ord(c) for c in r.texte[r.tours[1].debut :]]


def test_profile(spark):
    d = spark.createDataFrame([("ab", 1.0), (None, float("nan")), ("ab", 1.0)], "s string, x double")
    rows = {r.colonne: r for r in profile.columns(d).collect()}
    assert math.isclose(rows["s"].taux_manquant, 1 / 3) and math.isclose(rows["x"].taux_manquant, 1 / 3) and math.isclose(rows["s"].longueur_moyenne, 8 / 3)
    assert math.isclose(dedup.duplicate_rate(d).first()[0], 1 / 3)


def test_files(spark, tmp_path):
    path = f"{tmp_path}/t.jsonl"
    rows = pivot(spark, [{"identifiant": "a", "symptomes": "1"}, {"identifiant": "b"}])
    files.upsert(spark, path, schemas.PIVOT, rows)
    files.upsert(spark, path, schemas.PIVOT, pivot(spark, [{"identifiant": "a", "symptomes": "2"}, {"identifiant": "c"}]))
    got = schemas.decoded(files.read_table(spark, path, schemas.PIVOT))
    assert {r.identifiant: r.symptomes for r in got.collect()} == {"a": "2", "b": "", "c": ""}
    assert files.matching(got, {"split": None, "langue": "fr"}).count() == 3
    assert files.lookup(got, "a").first().symptomes == "2"
    with pytest.raises(FileNotFoundError):
        files.read_corpus(spark, f"{tmp_path}/none.csv")
    with pytest.raises(ValueError):
        files.read_corpus(spark, f"{tmp_path}/x.xml")
    (tmp_path / "c.csv").write_text('id,question\n1,"a\nb"\n')
    assert files.read_corpus(spark, f"{tmp_path}/c.csv").first().question == "a\nb"
    (tmp_path / "c.json").write_text('[{"id": 1}, {"id": 2}]')
    assert files.read_corpus(spark, f"{tmp_path}/c.json").count() == 2
    out = files.write_splits(spark.createDataFrame([("Train",), ("validation",), ("?",)], "split string").withColumn("x", F.lit(1)), f"{tmp_path}/splits")
    assert out == {"train": 1, "val": 1, "test": 0, "ignores": 1}


def test_unknown_enum_is_an_error(spark):
    bad = pivot(spark, [{"identifiant": "a", "langue": "xx"}])
    with pytest.raises(Exception, match="unknown langue"):
        schemas.decoded(bad).collect()


def test_streams(spark, tmp_path):
    log = tmp_path / "log"
    log.mkdir()
    points = [("r", s, n, v) for s, t in enumerate((2.0, 1.5, 1.0)) for n, v in (("perte_train", t), ("norme_gradient", 1.0))]
    (log / "a.json").write_text("".join(f'{{"run": "{r}", "etape": {s}, "nom": "{n}", "valeur": {v}, "horodatage": {s}}}\n' for r, s, n, v in points))
    logs.follow_metrics(spark, str(log), f"{tmp_path}/latest", f"{tmp_path}/cp").awaitTermination()
    (row,) = logs.live(spark, f"{tmp_path}/latest", [curves.TRAIN, curves.VALID, curves.GRAD]).collect()
    assert (row.verdict, row.message) == ("saine", "sans perte de validation")
    source = tmp_path / "in"
    source.mkdir()
    (source / "a.json").write_text('{"identifiant": "a"}\n{"identifiant": "b"}\n')
    for n in range(2):
        stream = spark.readStream.schema("identifiant string").json(str(source))
        logs.resume(stream, f"{tmp_path}/out", "identifiant string", lambda d: d, f"{tmp_path}/cp{n}").awaitTermination()
    assert ids(spark.read.json(f"{tmp_path}/out")) == ["a", "b"]


def test_log_details_and_text_tables(spark):
    lines = spark.createDataFrame([("r", 0, "pkg @ git+https://host.example/x/y@" + "a" * 40), ("r", 1, "rows: 12"), ("r", 2, "rows=15")], "run string, ord int, line string")
    assert log_replay.commits(lines).first().sha == "a" * 40
    assert log_replay.counters(lines, ["rows", "other"]).first().asDict() == {"run": "r", "nom": "rows", "valeur": 15}
    t = spark.createDataFrame([("s", "train"), ("s", "train"), ("s", "test")], "source string, split string")
    line = sampling.as_text(sampling.crosstab(t, ["source"]), ["source"], 6).first().ligne
    assert line == "s             2 ( 66.7 %)        0 (  0.0 %)        1 ( 33.3 %)        3"
    runs = spark.createDataFrame([("r",), ("q",)], "run string")
    assert {r.run: r.beta for r in files.run_parameters(runs, spark.createDataFrame([("r", 0.1)], "run string, beta double")).collect()} == {"r": 0.1, "q": None}


def test_registered_queries_run_over_all_documents(spark, tmp_path):
    texts = ["Jean Dupont a vu Émile Zola", "été à Paris Sud\nécrire à zoé@b.fr", "Anna Lee, a@b.fr", None, "Ève Ménard et Luc", "xAnna Lee ÉAnna Lee", "Marie Curie\nLe Havre 1.2"]
    spark.createDataFrame([(n, t, "s") for n, t in enumerate(texts)], "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1), (2, 1), (5, 0)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    by_id = {0: audit.CONFIRMED, 1: audit.HUMAN, 2: audit.REGEX_FALSE}
    want = Counter()
    for n, t in enumerate(texts):
        want[("bigramme_capitalise", by_id[n % 3])] += len(re.findall(r"\b[A-ZÀ-Ý][a-zà-ÿ]+(?:\s+[A-ZÀ-Ý][a-zà-ÿ]+)+\b", t or ""))
        want[("email", audit.CONFIRMED)] += len(re.findall(r"[\w.+-]+@[\w-]+\.[a-zA-Z]{2,}", t or ""))
    got = plans.candidate_verdicts_all(spark, str(tmp_path)).collect()
    assert {(r.type_motif, r.verdict): r.n for r in got} == dict(+want)
    assert sorted(r.doc_id for r in plans.publication_filter_all(spark, str(tmp_path)).collect()) == [-2, 0, 3, 4, 5, 6]
