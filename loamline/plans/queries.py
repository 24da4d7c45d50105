"""The registered queries over the supplied tables, each with its DuckDB oracle where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loamline.functions import json_values as js
from loamline.functions import text as tx
from loamline.operators import anonymise, audit, chat, curves, dedup, evaluate, log_replay, mapping, profile, sampling
from loamline.schemas import MESSAGES, PIVOT
from loamline.sources import files

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    def keep(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _stand_in(docs: DataFrame) -> DataFrame:
    """Documents as anonymised members to split: type by id, stratum source and language."""
    return docs.select("doc_id", "source", "lang", F.when(F.col("doc_id") % 3 == 0, "dpo").otherwise("sft").alias("type_exemple"), F.lit(True).alias("anonymise"), F.lit(None).cast("string").alias("split"))


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User turns with the assistant turn after them."""
    c = table(spark, sf_dir, "conversations")
    q = c.filter("role = 'user'").select("conv_id", "turn", F.col("text").alias("question"))
    a = c.filter("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer"))
    return q.join(a, ["conv_id", "turn"]).withColumn("id", F.concat_ws(":", "conv_id", "turn"))


_TURNS = """
t AS (SELECT q.conv_id, q.turn, q.text AS question, a.text AS answer, q.conv_id || ':' || q.turn AS id
  FROM conversations q JOIN conversations a ON a.conv_id = q.conv_id AND a.turn = q.turn + 1 WHERE q.role = 'user' AND a.role = 'assistant')"""


def _flat(p: DataFrame) -> DataFrame:
    text = lambda c: F.array_join(F.transform(c, lambda m: F.concat(m["role"], F.lit("="), m["contenu"])), "|")
    return p.select("identifiant", "identifiant_source_brute", "source", "type_exemple", "langue", "symptomes", "niveau_confiance", *[text(c).alias(c) for c in ("prompt", "completion", "chosen", "rejected")])


def _flat_sql(ns: str, key: str, raw: str, **c: str) -> str:
    """The columns of _flat: ns and key are SQL."""
    plain = {"source": "''", "type_exemple": "'sft'", "langue": "'fr'", "symptomes": "''", "niveau_confiance": "'moyenne'", "prompt": "''", "completion": "''", "chosen": "''", "rejected": "''"} | c
    return f"'corpus-' || lower({ns}) || '-' || substr(sha256({ns} || ':' || {key}), 1, 16) AS identifiant, {raw} AS identifiant_source_brute, " + ", ".join(f"{v} AS {k}" for k, v in plain.items())


@query(f"WITH {_TURNS} SELECT {_flat_sql(chr(39) + 'mediqal_oeq' + chr(39), 'id', 'id', source=chr(39) + 'MediQAl' + chr(39), symptomes='question', prompt=chr(39) + 'user=' + chr(39) + ' || question', completion=chr(39) + 'assistant=' + chr(39) + ' || answer')} FROM t WHERE question <> '' AND answer <> ''")
def pivot_from_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(mapping.open_questions(_turns(spark, sf_dir)))


def _choices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as multiple-choice rows: options are words of the text."""
    w = F.split("text", " ")
    d = table(spark, sf_dir, "documents")
    letters = F.when(F.col("doc_id") % 4 == 0, "C").when(F.col("doc_id") % 4 == 1, " a, D ").when(F.col("doc_id") % 4 == 2, "b,,z").otherwise("")
    return d.select(F.col("doc_id").alias("id"), F.when(F.col("doc_id") % 5 > 0, F.get(w, F.lit(0))).alias("question"), F.when(F.col("doc_id") % 2 == 0, F.col("lang")).otherwise("").alias("clinical_case"), F.when(F.col("doc_id") % 3 == 0, "QCU").otherwise("QCM").alias("task"), letters.alias("correct_answers"), *[F.coalesce(F.get(w, F.lit(i)), F.lit("")).alias(f"answer_{c}") for i, c in enumerate("abcde", 1)])


_CHOICES = """
c AS (SELECT doc_id, doc_id::VARCHAR AS id, CASE WHEN doc_id % 5 > 0 THEN w[1] END AS question, CASE WHEN doc_id % 2 = 0 THEN lang ELSE '' END AS kase, CASE WHEN doc_id % 3 = 0 THEN 'mediqal_mcqu' ELSE 'mediqal_mcqm' END AS ns,
  coalesce(w[2], '') AS a, coalesce(w[3], '') AS b, coalesce(w[4], '') AS c, coalesce(w[5], '') AS d, coalesce(w[6], '') AS e FROM (SELECT *, string_split(text, ' ') AS w FROM documents)),
o AS (SELECT *, CASE doc_id % 4 WHEN 0 THEN c WHEN 1 THEN array_to_string(list_filter([a, d], lambda x: x <> ''), ' ') WHEN 2 THEN b ELSE '' END AS answer FROM c)"""


@query(f"WITH {_CHOICES} SELECT {_flat_sql('ns', 'id', 'id', source=chr(39) + 'MediQAl' + chr(39), niveau_confiance=chr(39) + 'haute' + chr(39), symptomes='CASE WHEN kase <> ' + chr(39) * 2 + ' THEN kase ELSE question END', prompt=chr(39) + 'user=' + chr(39) + ' || CASE WHEN kase <> ' + chr(39) * 2 + ' THEN kase || chr(10) || chr(10) ELSE ' + chr(39) * 2 + ' END || question', completion=chr(39) + 'assistant=' + chr(39) + ' || answer')} FROM o WHERE question <> '' AND answer <> ''")
def pivot_multiple_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(mapping.multiple_choice(_choices(spark, sf_dir)))


@query(f"WITH {_CHOICES}, i AS (SELECT *, CASE doc_id % 7 WHEN 0 THEN a WHEN 1 THEN b WHEN 2 THEN c WHEN 3 THEN d WHEN 4 THEN e END AS pick FROM c) SELECT {_flat_sql(chr(39) + 'frenchmedmcqa' + chr(39), 'id', 'id', source=chr(39) + 'FrenchMedMCQA' + chr(39), niveau_confiance=chr(39) + 'haute' + chr(39), prompt=chr(39) + 'user=' + chr(39) + ' || question', completion=chr(39) + 'assistant=' + chr(39) + ' || pick')} FROM i WHERE question <> '' AND pick <> ''")
def pivot_indexed_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(mapping.indexed_choice(_choices(spark, sf_dir).withColumn("correct_answers", (F.col("id") % 7).cast("int"))))


@query(f"WITH {_TURNS} SELECT {_flat_sql(chr(39) + 'medquad' + chr(39), 'sha256(question || ' + chr(39) + '||' + chr(39) + ' || answer)', 'sha256(question || ' + chr(39) + '||' + chr(39) + ' || answer)', source=chr(39) + 'MedQuAD' + chr(39), langue=chr(39) + 'en' + chr(39), symptomes='question', prompt=chr(39) + 'user=' + chr(39) + ' || question', completion=chr(39) + 'assistant=' + chr(39) + ' || answer')} FROM t WHERE question <> '' AND answer <> ''")
def pivot_question_answer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(mapping.question_answer(_turns(spark, sf_dir).select("question", "answer")))


def _preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User turns with the answer as chosen and the question turned round as rejected, both as message lists."""
    t = _turns(spark, sf_dir)
    said = lambda c: F.array(F.struct(F.lit("user").alias("role"), F.lit("x").alias("content")), F.struct(F.lit("assistant").alias("role"), c.alias("content")))
    return t.select(F.col("id").alias("prompt_id"), F.lit("length").alias("label_type"), F.col("question").alias("prompt"), said(F.col("answer")).alias("chosen"), said(F.reverse("question")).alias("rejected"))


@query(f"WITH {_TURNS} SELECT {_flat_sql(chr(39) + 'ultramedical' + chr(39), 'id || ' + chr(39) + '|length|' + chr(39) + ' || answer || ' + chr(39) + '|' + chr(39) + ' || reverse(question)', 'id', source=chr(39) + 'UltraMedical-Preference' + chr(39), type_exemple=chr(39) + 'dpo' + chr(39), langue=chr(39) + 'en' + chr(39), prompt=chr(39) + 'user=' + chr(39) + ' || question', chosen=chr(39) + 'assistant=' + chr(39) + ' || answer', rejected=chr(39) + 'assistant=' + chr(39) + ' || reverse(question)')} FROM t WHERE question <> '' AND answer <> ''")
def pivot_preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(mapping.preferences(_preferences(spark, sf_dir)))


_RANKED_TEXT = "SELECT doc_id, lang, source, row_number() OVER (PARTITION BY md5(text) ORDER BY doc_id) AS rn FROM documents"


def _hashed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "lang", "source", F.md5("text").alias("h"))


@query(f"SELECT doc_id, lang, source FROM ({_RANKED_TEXT}) WHERE rn = 1")
def dedup_first_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.first_wins(_hashed(spark, sf_dir), "h", "doc_id")[0].drop("h")


@query(f"SELECT doc_id, lang, source FROM ({_RANKED_TEXT}) WHERE rn > 1")
def dedup_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.first_wins(_hashed(spark, sf_dir), "h", "doc_id")[1].drop("h")


_SPLIT = """
r AS (SELECT doc_id, source, lang, doc_id % 3 AS k, row_number() OVER (PARTITION BY source, lang ORDER BY md5('42:' || doc_id), doc_id) AS rn, count(*) OVER (PARTITION BY source, lang) AS n FROM documents),
s AS (SELECT doc_id, source, lang, CASE WHEN k = 0 THEN 'dpo' ELSE 'sft' END AS type_exemple, CASE WHEN rn <= floor(n * 0.1) THEN 'test' WHEN rn <= floor(n * 0.1) + floor(n * 0.1) THEN 'val' ELSE 'train' END AS split FROM r)"""


def _split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.assign_splits(_stand_in(table(spark, sf_dir, "documents")), ["source", "lang"], "doc_id")


@query(f"WITH {_SPLIT} SELECT doc_id, source, lang, split FROM s")
def split_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _split(spark, sf_dir)


@query(f"""WITH {_SPLIT}, c AS (SELECT source, lang, count(*) FILTER (split = 'train') AS train, count(*) FILTER (split = 'val') AS val, count(*) FILTER (split = 'test') AS test, count(*) AS total FROM s GROUP BY ALL)
SELECT *, train * 100.0::DOUBLE / total AS pct_train, val * 100.0::DOUBLE / total AS pct_val, test * 100.0::DOUBLE / total AS pct_test FROM c""")
def split_repartition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.crosstab(_split(spark, sf_dir), ["source", "lang"])


@query(f"WITH {_SPLIT} SELECT count(*) FILTER (split = 'train') AS n_train, count(*) FILTER (split = 'val') AS n_val, count(*) FILTER (split = 'test') AS n_test FROM s")
def split_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.split_counts(_split(spark, sf_dir))


_QUOTA = """
z AS (SELECT source, lang, count(*) AS size, min(doc_id) AS first FROM {src} GROUP BY ALL),
y AS (SELECT *, {n} * (size::DOUBLE / sum(size) OVER ()) AS part FROM z),
x AS (SELECT *, least(floor(part), size) AS base FROM y),
v AS (SELECT *, {n} - sum(base) OVER () AS short, base < size AS open FROM x),
u AS (SELECT *, row_number() OVER (PARTITION BY open ORDER BY part - floor(part) DESC, first) AS turn FROM v),
q AS (SELECT source, lang, base + CASE WHEN open AND turn <= short THEN 1 ELSE 0 END AS quota FROM u),
p AS (SELECT d.*, row_number() OVER (PARTITION BY source, lang ORDER BY md5('42:' || doc_id), doc_id) AS rn FROM {src} d)"""


@query(f"WITH {_QUOTA.format(src='documents', n=200)} SELECT p.doc_id, p.source, p.lang FROM p JOIN q USING (source, lang) WHERE rn <= quota")
def stratified_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "source", "lang")
    return sampling.stratified_sample(d, 200, ["source", "lang"], "doc_id", "doc_id")


@query(f"WITH {_SPLIT}, k AS (SELECT * FROM s WHERE type_exemple = 'sft' AND doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)), {_QUOTA.format(src='k', n=120)} SELECT p.doc_id, p.source, p.lang, p.split FROM p JOIN q USING (source, lang) WHERE rn <= quota")
def subset_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _stand_in(table(spark, sf_dir, "documents")).drop("split").join(_split(spark, sf_dir).select("doc_id", "split"), "doc_id")
    out = table(spark, sf_dir, "labels").filter("toxic = 1")
    return sampling.extract_subset(rows, "sft", ["source", "lang"], "doc_id", "doc_id", target=120, excluded=out).select("doc_id", "source", "lang", "split")


@query(f"WITH {_SPLIT}, k AS (SELECT count(*) AS avant, count(*) FILTER (doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)) AS exclus FROM s WHERE type_exemple = 'sft') SELECT avant, exclus, avant - exclus AS disponibles, greatest(1000 - (avant - exclus), 0) AS manque FROM k")
def subset_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _stand_in(table(spark, sf_dir, "documents")).drop("split").join(_split(spark, sf_dir).select("doc_id", "split"), "doc_id")
    return sampling.subset_report(rows, "sft", table(spark, sf_dir, "labels").filter("toxic = 1"), "doc_id", 1000)


def _judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels as candidates: toxic is confirmed, bad awaits a person, some are accepted."""
    lab = table(spark, sf_dir, "labels")
    verdict = F.when(F.col("toxic") == 1, audit.CONFIRMED).when(F.col("quality") == 0, audit.HUMAN).otherwise(audit.REGEX_FALSE)
    decision = F.when(F.col("doc_id") % 3 == 0, "accepte").when(F.col("doc_id") % 3 == 1, "rejete")
    return lab.select("doc_id", verdict.alias("verdict"), F.coalesce(decision, F.lit("en attente")).alias("decision"))


_JUDGED = """
j AS (SELECT doc_id, CASE WHEN toxic = 1 THEN 'confirme' WHEN quality = 0 THEN 'revision_humaine' ELSE 'faux_positif_regex' END AS verdict, CASE doc_id % 3 WHEN 0 THEN 'accepte' WHEN 1 THEN 'rejete' ELSE 'en attente' END AS decision FROM labels)"""


@query(f"WITH {_JUDGED}, m AS (SELECT doc_id, max(CASE WHEN verdict = 'confirme' THEN 2 WHEN verdict = 'revision_humaine' AND decision <> 'accepte' THEN 1 END) AS r FROM j GROUP BY 1) SELECT doc_id, CASE r WHEN 2 THEN 'confirme' ELSE 'pendant_revision_humaine' END AS motif FROM m WHERE r IS NOT NULL")
def exclusion_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.exclusion_reasons(_judged(spark, sf_dir), "doc_id")


@query(f"WITH {_JUDGED} SELECT " + ", ".join(f"count(*) FILTER ({c} = '{v}') AS {v.replace(' ', '_')}" for c, vs in (("verdict", ("confirme", "faux_positif_regex", "revision_humaine")), ("decision", ("accepte", "rejete", "en attente"))) for v in vs) + " FROM j")
def verdict_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.verdict_counts(_judged(spark, sf_dir))


@query("""SELECT 'corpus-ultramedical-' || substr(sha256('ultramedical:' || q.conv_id || ':' || q.turn || '|length|' || a.text || '|' || reverse(q.text)), 1, 16) AS identifiant,
  '<|im_start|>user' || chr(10) || q.text || '<|im_end|>' || chr(10) || '<|im_start|>assistant' || chr(10) AS prompt,
  '<|im_start|>assistant' || chr(10) || CASE WHEN q.conv_id % 4 = 0 THEN upper(a.text) ELSE a.text END || '<|im_end|>' || chr(10) AS chosen,
  '<|im_start|>assistant' || chr(10) || reverse(q.text) || '<|im_end|>' || chr(10) AS rejected
FROM conversations q JOIN conversations a ON a.conv_id = q.conv_id AND a.turn = q.turn + 1 WHERE q.role = 'user' AND a.role = 'assistant' AND q.text <> '' AND a.text <> ''""")
def pref_pairs_override(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = mapping.preferences(_preferences(spark, sf_dir))
    every_fourth = F.split_part("identifiant_source_brute", F.lit(":"), F.lit(1)).cast("long") % 4 == 0
    new = p.filter(every_fourth).select("identifiant", F.transform("chosen", lambda m: F.struct(m["role"].alias("role"), tx.upper(m["contenu"]).alias("contenu"))).alias("chosen"))
    # rows that repeat share an id, and so their text
    return chat.triplets(p, new.dropDuplicates(["identifiant"]))


_NORM = r"trim(regexp_replace(regexp_replace(lower({c}), '[^\p{{L}}\p{{N}}_\s]', ' ', 'g'), '\s+', ' ', 'g'))"


@query(f"WITH {_TURNS} SELECT avg(CASE WHEN {_NORM.format(c='question')} = {_NORM.format(c='answer')} THEN 1.0::DOUBLE ELSE 0 END) AS exact_match_rate FROM t")
def exact_match_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.exact_match_rate(_turns(spark, sf_dir), "answer", "question")


@query(f"""WITH {_TURNS}, n AS (SELECT id, list_filter(string_split({_NORM.format(c='answer')}, ' '), lambda x: x <> '') AS e, list_filter(string_split({_NORM.format(c='question')}, ' '), lambda x: x <> '') AS g FROM t),
a AS (SELECT id, w, count(*) AS c FROM (SELECT id, unnest(e) AS w FROM n) GROUP BY ALL), b AS (SELECT id, w, count(*) AS c FROM (SELECT id, unnest(g) AS w FROM n) GROUP BY ALL),
m AS (SELECT a.id, sum(least(a.c, b.c)) AS m FROM a JOIN b USING (id, w) GROUP BY 1)
SELECT n.id, CASE WHEN len(e) = 0 AND len(g) = 0 THEN 1.0::DOUBLE WHEN m IS NULL THEN 0 ELSE 2.0::DOUBLE * m / (len(e) + len(g)) END AS f1 FROM n LEFT JOIN m USING (id)""")
def token_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.token_f1(_turns(spark, sf_dir), "id", "answer", "question")


def _levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as expected and given answers, some with text around the object, some without a level."""
    e = table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))
    want = F.concat(F.lit('{"niveau": '), (F.col("k") % 5 + 1).cast("string"), F.lit("}"))
    got = F.concat(F.lit('réponse : {"niveau": "'), ((F.col("k") + F.col("event_id")) % 5 + 1).cast("string"), F.lit('"} fin'))
    return e.select(want.alias("want"), F.when(F.col("event_id") % 4 == 0, '{"autre": 1}').when(F.col("event_id") % 4 == 1, "rien").otherwise(got).alias("got"))


@query("""WITH l AS (SELECT event_id, (props->>'$.k')::BIGINT AS k FROM events), p AS (SELECT (k % 5 + 1) AS a, CASE WHEN event_id % 4 > 1 THEN (k + event_id) % 5 + 1 END AS b FROM l)
SELECT count(*) AS paires, count(b) AS comparables, count(*) FILTER (a = b) AS corrects, (count(*) FILTER (a = b))::DOUBLE / nullif(count(b), 0) AS justesse FROM p""")
def json_level_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.level_accuracy(_levels(spark, sf_dir), "want", "got")


@query("""WITH l AS (SELECT event_id, event_id % 6 AS r FROM events) SELECT event_id, CASE WHEN r IN (0, 5) THEN 3 END::BIGINT AS niveau, CASE WHEN r IN (0, 5) THEN 'a' END AS categorie, r IN (0, 3, 5) AS reformulable, r = 0 AS forme FROM l""")
def strict_diagnosis(spark: SparkSession, sf_dir: str) -> DataFrame:
    think = '<think>raisonnement assez long</think>'
    texts = [think + '{"niveau": 3, "categorie": "a", "ressources_estimees": "b"}', think + '{"niveau": 3, "categorie": "a"}', "<think>  </think>{}", think + '{"niveau": true, "categorie": "a", "ressources_estimees": "b"}', think + '{"niveau": 3, "categorie": "a", "ressources_estimees": "b"} suite', "  " + think + '\n{"niveau": 3, "categorie": "a", "ressources_estimees": "b"}\n']
    e = table(spark, sf_dir, "events").select("event_id", F.get(F.array(*map(F.lit, texts)), F.col("event_id") % 6).alias("t"))
    d = js.diagnosis(F.col("t"))
    return e.select("event_id", d["niveau"].alias("niveau"), d["categorie"].alias("categorie"), js.reformulation(F.col("t")).isNotNull().alias("reformulable"), js.has_diagnosis_form(F.col("t")).alias("forme"))


@query("SELECT count(*) AS nombre, avg(value) AS moyenne, median(value) AS mediane, min(value) AS minimum, max(value) AS maximum FROM events WHERE event_type LIKE '%c%' AND user_id % 10 <> 0")
def latency_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("ok", F.col("user_id") % 10 != 0)
    return evaluate.latency_summary(e, "event_type", "c", "value", "ok")


@query("SELECT count(*) AS exemples, count(*) FILTER (user_id % 10 = 0) AS echecs, avg(value) FILTER (user_id % 10 <> 0) AS latence_moyenne FROM events")
def latency_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("echec", F.col("user_id") % 10 == 0)
    return evaluate.latency(e, "value", "echec")


def _points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as long metric points: a user is a run, a step is a day of its own, the name goes by the kind."""
    e = table(spark, sf_dir, "events")
    names = F.create_map(*map(F.lit, (0, curves.TRAIN, 1, curves.GRAD, 2, curves.VALID)))
    nth = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    return e.select(F.col("user_id").alias("run"), F.col("event_id").alias("ord"), "value", nth.alias("nth")).select("run", "ord", F.floor(F.col("nth") / 4).cast("int").alias("etape"), F.try_element_at(names, F.greatest(F.col("nth") % 4 - 1, F.lit(0)).cast("int")).alias("nom"), F.col("value").alias("valeur"))


_POINTS = """
n AS (SELECT user_id AS run, event_id AS ord, value AS valeur, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS nth FROM events),
p AS (SELECT run, ord, (nth // 4)::INT AS etape, CASE greatest(nth % 4 - 1, 0) WHEN 0 THEN 'perte_train' WHEN 1 THEN 'norme_gradient' ELSE 'perte_validation' END AS nom, valeur FROM n),
w AS (SELECT run, etape, max_by(valeur, ord) FILTER (nom = 'perte_train') AS perte_train, max_by(valeur, ord) FILTER (nom = 'perte_validation') AS perte_validation, max_by(valeur, ord) FILTER (nom = 'norme_gradient') AS norme_gradient FROM p GROUP BY ALL),
c AS (SELECT * FROM w WHERE perte_train IS NOT NULL AND norme_gradient IS NOT NULL)"""
_NAMES = [curves.TRAIN, curves.VALID, curves.GRAD]


@query(f"WITH {_POINTS} SELECT * FROM w")
def metrics_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curves.wide(_points(spark, sf_dir), _NAMES)


_VERDICTS = f"""{_POINTS},
a AS (SELECT run, count(*) AS n, min_by(perte_train, etape) AS t0, max_by(perte_train, etape) AS t1, min_by(norme_gradient, etape) AS g0, max_by(norme_gradient, etape) AS g1 FROM c GROUP BY 1),
l AS (SELECT run, etape, perte_validation AS v, row_number() OVER (PARTITION BY run ORDER BY etape DESC) AS rn FROM c WHERE perte_validation IS NOT NULL),
h AS (SELECT run, CASE WHEN count(*) >= 2 THEN max_by(v, etape) - min_by(v, etape) END AS hausse FROM l WHERE rn <= 3 GROUP BY 1),
e AS (SELECT a.run, n, CASE WHEN g0 > 0 AND g1 / g0 >= 10 AND t1 > t0 THEN 'instable' WHEN CASE WHEN t0 = 0 THEN 0 ELSE (t0 - t1) / t0 END < 0.05 THEN 'sous_apprentissage' WHEN hausse > 0.05 THEN 'surapprentissage' ELSE 'saine' END AS verdict FROM a LEFT JOIN h USING (run))"""


@query(f"WITH {_VERDICTS} SELECT run, n, verdict FROM e")
def convergence_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curves.verdicts(curves.complete_steps(curves.wide(_points(spark, sf_dir), _NAMES)))


@query(f"WITH {_VERDICTS}, v AS (SELECT run, count(perte_validation) > 0 AS hv FROM c GROUP BY 1) SELECT r.run, CASE WHEN n >= 2 THEN verdict END AS verdict, CASE WHEN coalesce(n, 0) < 2 THEN 'pas assez de points complets' WHEN NOT hv THEN 'sans perte de validation' ELSE '' END AS message FROM (SELECT DISTINCT run FROM w) r LEFT JOIN e USING (run) LEFT JOIN v USING (run)")
def live_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curves.live_verdicts(curves.wide(_points(spark, sf_dir), _NAMES))


def _by_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(F.col("user_id").alias("run"), F.col("event_id").alias("ord"), "event_type", "value", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).alias("etape"))


_BY_RANK = "k AS (SELECT user_id AS run, event_id AS ord, event_type, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id)::INT AS etape FROM events)"


@query(f"""WITH {_BY_RANK}, m AS (SELECT e.run, e.etape, e.ord, e.value, t.etape AS etape_train, row_number() OVER (PARTITION BY e.run, e.etape ORDER BY abs(e.etape - t.etape), t.etape) AS rn
  FROM k e JOIN k t ON t.run = e.run AND t.event_type = 'click' WHERE e.event_type = 'purchase') SELECT run, etape, ord, value, etape_train FROM m WHERE rn = 1""")
def nearest_eval_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = _by_rank(spark, sf_dir)
    return curves.nearest_steps(k.filter("event_type = 'purchase'").select("run", "etape", "ord", "value"), k.filter("event_type = 'click'").select("run", "etape"))


@query(f"""WITH {_BY_RANK}, m AS (SELECT e.run, e.ord, e.value, t.etape AS ts, row_number() OVER (PARTITION BY e.run, e.etape ORDER BY abs(e.etape - t.etape), t.etape) AS rn
  FROM k e JOIN k t ON t.run = e.run AND t.event_type = 'click' WHERE e.event_type = 'purchase'), v AS (SELECT run, ts AS etape, max_by(value, ord) AS perte_validation FROM m WHERE rn = 1 GROUP BY ALL)
SELECT k.run, k.etape, k.value AS perte_train, v.perte_validation, 0.0::DOUBLE AS norme_gradient FROM k LEFT JOIN v USING (run, etape) WHERE k.event_type = 'click'""")
def curve_from_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = _by_rank(spark, sf_dir)
    log = k.select("run", "ord", F.col("etape").alias("step"), F.when(F.col("event_type") == "click", F.col("value")).alias("loss"), F.lit(None).cast("double").alias("grad_norm"), F.when(F.col("event_type") == "purchase", F.col("value")).alias("eval_loss"))
    return curves.curve_from_log(log)


@query(f"WITH {_BY_RANK} SELECT run, ord, coalesce(last_value(CASE WHEN event_type = 'click' THEN etape END IGNORE NULLS) OVER (PARTITION BY run ORDER BY etape ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS step FROM k")
def forward_fill_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _by_rank(spark, sf_dir).withColumn("click", F.when(F.col("event_type") == "click", F.col("etape")))
    return log_replay.filled_steps(rows, "run", "etape", "click", "step").select("run", "ord", "step")


@query(f"WITH {_VERDICTS}, f AS (SELECT run, max_by(perte_train, etape) AS perte_train, max_by(struct_pack(v := perte_validation), etape).v AS perte_validation FROM c GROUP BY 1) SELECT run, verdict, perte_train, perte_validation FROM f JOIN e USING (run) ORDER BY verdict <> 'saine', coalesce(perte_validation, perte_train), run LIMIT 1")
def best_trial(spark: SparkSession, sf_dir: str) -> DataFrame:
    curve = curves.complete_steps(curves.wide(_points(spark, sf_dir), _NAMES))
    end = curves.ends(curve).select("run", f"dernier.{curves.TRAIN}", f"dernier.{curves.VALID}")
    return curves.best_trial(end.join(curves.verdicts(curve), "run").withColumn("ord", F.col("run"))).select("run", "verdict", curves.TRAIN, curves.VALID)


@query(f"WITH {_POINTS}, u AS (UNPIVOT (SELECT run, etape, perte_train, perte_validation, norme_gradient FROM c) ON perte_train, perte_validation, norme_gradient INTO NAME nom VALUE valeur) SELECT run, etape, nom, valeur FROM u")
def metric_fan_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curves.long_points(curves.complete_steps(curves.wide(_points(spark, sf_dir), _NAMES)))


@query("SELECT user_id AS run, event_type AS nom, max_by(value, event_id) AS valeur FROM events GROUP BY ALL")
def final_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return curves.last_values(e.select(F.col("user_id").alias("run"), F.col("event_id").alias("ord"), F.col("event_type").alias("nom"), F.col("value").alias("valeur")))


@query("""SELECT user_id AS run, 10 * (user_id % 3 + 1) AS etape, 'perte_train' AS nom, 1.5::DOUBLE AS valeur, (1704103200 + 60 * (user_id % 3 + 1))::DOUBLE AS horodatage FROM (SELECT DISTINCT user_id FROM events)
UNION ALL SELECT user_id, 20 * (user_id % 3 + 1), 'perte_validation', 1.25, 1704103200 + 120 * (user_id % 3 + 1) FROM (SELECT DISTINCT user_id FROM events)""")
def log_replay_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A small training log for each user: a stamp, bars at a half and at the end, a train and an evaluation line."""
    k = F.col("user_id") % 3 + 1
    bar = lambda step: F.format_string("%d/%d [%02d:00<00:00, 6.0s/it]", step, 20 * k, (step / 10).cast("int"))
    lines = F.array(F.lit("out: run-20240101T100000Z"), bar(10 * k), F.lit("{'loss': 1.5, 'epoch': 0.5}"), bar(20 * k), F.lit("{'eval_loss': 1.25, 'epoch': 1.0}"), F.lit("{'loss': broken"))
    users = table(spark, sf_dir, "events").select("user_id").distinct()
    text = users.select(F.col("user_id").alias("run"), F.posexplode(lines).alias("ord", "line"))
    return log_replay.replayed(text).select("run", F.col("etape").cast("long").alias("etape"), "nom", "valeur", "horodatage")


_W = r"[\p{L}\p{N}_"
_RX = {"email": _W + r".+-]+@" + _W + r"-]+\.[a-zA-Z]{2,}", "url": r"https?://\S+|www\.\S+", "telephone": r"(?:\+\p{Nd}{1,3}[ .-]?)?(?:\(?\p{Nd}{2,4}\)?[ .-]){2,5}\p{Nd}{2,4}"}


@query("SELECT source, kind, count(*) AS n FROM (" + " UNION ALL ".join(f"SELECT source, '{k}' AS kind, unnest(regexp_extract_all(text, '{r}')) AS m FROM documents" for k, r in _RX.items()) + ") GROUP BY ALL")
def pii_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("source", *tx.pii_numbers(F.col("text"), tuple(_RX)))
    sums = d.groupBy("source").agg(*[F.sum(k).cast("long").alias(k) for k in _RX])
    return sums.unpivot("source", list(_RX), "kind", "n").filter("n > 0")


@query(f"SELECT doc_id, unnest(regexp_extract_all(text, '{_RX['email']}')) AS found FROM documents")
def pii_emails(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = tx.bound(F.col("text"), lambda t: F.struct(tx.pieces(t).alias("parts"), tx.spans(t, "email", tx.PII["email"]).alias("spans")))
    cut = tx.bound(found, lambda x: F.transform(x["spans"], lambda s: tx.cut(x["parts"], s["start"], s["end"])))
    return table(spark, sf_dir, "documents").select("doc_id", F.explode(cut).alias("found"))


@query(f"SELECT doc_id, regexp_replace(text, '{_RX['email']}', '<INFO_MASQUEE>', 'g') AS masque FROM documents")
def pii_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", tx.with_spans_masked(t, tx.spans(t, "email", tx.PII["email"])).alias("masque"))


_AGE = "CASE WHEN doc_id % 100 <= 12 THEN '{}' WHEN doc_id % 100 <= 17 THEN '{}' WHEN doc_id % 100 <= 64 THEN '{}' ELSE '{}' END"


@query(f"SELECT doc_id, 'Un ' || {_AGE.format(*tx.BRACKETS['fr'])} || ', 7 mois, suivi ' || lang AS fr, 'A ' || {_AGE.format(*tx.BRACKETS['en'])} || ' patient ' || {_AGE.format(*tx.BRACKETS['en'])} || '.' AS en FROM documents")
def age_brackets(spark: SparkSession, sf_dir: str) -> DataFrame:
    age = (F.col("doc_id") % 100).cast("string")
    d = table(spark, sf_dir, "documents")
    fr = F.concat(F.lit("Un homme de "), age, F.lit(" ans, 7 mois, suivi "), F.col("lang"))
    en = F.concat(F.lit("A "), age, F.lit("-year-old patient aged "), age, F.lit("."))
    return d.select("doc_id", tx.age_brackets(fr, F.lit("fr")).alias("fr"), tx.age_brackets(en, F.lit("en")).alias("en"))


@query("SELECT doc_id, doc_id % 2 = 0 AS nir, doc_id % 3 = 0 AS absolue, doc_id % 3 = 1 AS relative, CASE WHEN doc_id % 3 = 1 THEN 'il y a ' || (doc_id % 9 + 1) || ' semaines' ELSE '<INFO_MASQUEE>' END AS masque FROM documents")
def date_and_id_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    body = F.concat(F.lit("1850375116"), F.lpad((i % 1000).cast("string"), 3, "0"))
    key = F.lpad((97 - F.pmod(body.cast("bigint"), F.lit(97)) + F.when(i % 2 == 0, 0).otherwise(1)).cast("string"), 2, "0")
    date = F.when(i % 3 == 0, F.concat(F.lit("le 12/05/"), 1900 + i % 100)).when(i % 3 == 1, F.concat(F.lit("il y a "), i % 9 + 1, F.lit(" semaines"))).otherwise("lundi")
    rows = table(spark, sf_dir, "documents").select("doc_id", F.concat(body, key).alias("n"), date.alias("d"))
    return rows.select("doc_id", tx.valid_nir(F.col("n")).alias("nir"), tx.is_absolute_date(F.col("d")).alias("absolue"), tx.is_relative_duration(F.col("d")).alias("relative"), tx.masked(F.col("d"), F.lit("date")).alias("masque"))


@query(r"""WITH h AS (SELECT doc_id, text, substr(text, 1, 300) AS h FROM documents), c AS (SELECT *, CASE WHEN h LIKE '_%. %' THEN length(h) - instr(reverse(h), ' .') ELSE 0 END AS a, CASE WHEN h LIKE '_%! %' THEN length(h) - instr(reverse(h), ' !') ELSE 0 END AS b, CASE WHEN h LIKE '_%? %' THEN length(h) - instr(reverse(h), ' ?') ELSE 0 END AS q, CASE WHEN instr(reverse(h), chr(10)) > 0 THEN length(h) - instr(reverse(h), chr(10)) ELSE 0 END AS n FROM h)
SELECT doc_id, CASE WHEN length(text) <= 300 THEN text WHEN a > 0 THEN substr(h, 1, a) WHEN b > 0 THEN substr(h, 1, b) WHEN q > 0 THEN substr(h, 1, q) WHEN n > 0 THEN rtrim(substr(h, 1, n), ' ' || chr(10)) ELSE rtrim(h, ' ' || chr(10)) END AS coupe FROM c""")
def sentence_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", tx.cut_at_sentence(F.col("text"), 300).alias("coupe"))


def _pivot_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as pivot rows: a prompt of the text, a completion of its first line, a history for some."""
    d = table(spark, sf_dir, "documents")
    none = F.array().cast(MESSAGES)
    given = {"identifiant": F.col("doc_id").cast("string"), "source": F.col("source"), "type_exemple": F.lit("sft"), "langue": F.when(F.col("lang") == "fr", "fr").otherwise("en"), "symptomes": F.substring_index("text", "\n", 1), "antecedents": F.when(F.col("doc_id") % 3 == 0, "RAS").when(F.col("doc_id") % 3 == 1, ""), "prompt": mapping.message("user", F.col("text")), "completion": mapping.message("assistant", F.substring_index("text", "\n", -1)), "chosen": none, "rejected": none, "niveau_confiance": F.lit("moyenne"), "anonymise": F.lit(False)}
    return d.select(*[given.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in PIVOT.fields])


def _masked_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All e-mail addresses masked."""

    def only_emails(text, lang):
        return anonymise.masking(text, lambda t: tx.spans(t, "email", tx.PII["email"]))

    return anonymise.anonymised(_pivot_docs(spark, sf_dir), only_emails)


_LAST_LINE = "split_part(text, chr(10), -1)"
_FIELDS = f"""
f AS (SELECT doc_id, source, 0 AS o, 'symptomes' AS champ, split_part(text, chr(10), 1) AS t FROM documents UNION ALL SELECT doc_id, source, 1, 'antecedents', 'RAS' FROM documents WHERE doc_id % 3 = 0
 UNION ALL SELECT doc_id, source, 2, 'prompt[0]', text FROM documents UNION ALL SELECT doc_id, source, 3, 'completion[0]', {_LAST_LINE} FROM documents),
g AS (SELECT doc_id::VARCHAR AS identifiant, source, champ, t AS original, regexp_replace(t, '{_RX['email']}', '<INFO_MASQUEE>', 'g') AS masque FROM f)"""


@query(f"WITH {_FIELDS} SELECT identifiant, champ, original, masque FROM g")
def paired_unpivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mapping.text_pairs(_pivot_docs(spark, sf_dir), _masked_docs(spark, sf_dir)).select("identifiant", "champ", "original", "masque")


@query(f"WITH {_FIELDS} SELECT identifiant FROM g GROUP BY 1 HAVING bool_and(original = masque)")
def no_entity_stratum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.untouched(mapping.text_pairs(_pivot_docs(spark, sf_dir), _masked_docs(spark, sf_dir)))


@query(f"WITH {_FIELDS}, k AS (SELECT source, identifiant, sum(len(regexp_extract_all(original, '{_RX['email']}'))) AS n FROM g GROUP BY ALL) SELECT source, count(*) AS lignes, count(*) FILTER (n > 0) AS avec_entite, sum(n)::BIGINT AS emails FROM k GROUP BY 1")
def anonymise_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = anonymise.merged_stats(anonymise.stats(_masked_docs(spark, sf_dir)))
    return s.select("source", "lignes", "avec_entite", F.coalesce(F.try_element_at("par_type", F.lit("email")), F.lit(0)).alias("emails"))


@query(f"WITH {_FIELDS}, k AS (SELECT identifiant, sum(len(regexp_extract_all(original, '{_RX['email']}'))) AS n FROM g GROUP BY ALL) SELECT 2 * count(*) AS lignes, 2 * count(*) FILTER (n > 0) AS avec_entite, (2 * sum(n))::BIGINT AS entites, 100.0::DOUBLE * count(*) FILTER (n > 0) / count(*) AS pct_avec_entite FROM k")
def cumulative_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two equal runs in the ledger."""
    run = anonymise.stats(_masked_docs(spark, sf_dir))
    return anonymise.report(anonymise.merged_stats(run.unionByName(run)))


@query(f"""WITH d AS (SELECT *, CASE WHEN lang = 'fr' THEN 'fr' ELSE 'en' END AS langue, CASE WHEN doc_id % 3 = 0 THEN 1 ELSE 0 END AS more FROM documents),
f AS (SELECT doc_id, source, langue, 0 AS champ_ord, 'symptomes' AS champ, split_part(text, chr(10), 1) AS t FROM d UNION ALL SELECT doc_id, source, langue, 1 + more, 'prompt[0]', text FROM d UNION ALL SELECT doc_id, source, langue, 2 + more, 'completion[0]', {_LAST_LINE} FROM d),
g AS (SELECT *, regexp_extract_all(t, '{_RX['email']}') AS found, regexp_split_to_array(t, '{_RX['email']}') AS gaps FROM f),
h AS (SELECT *, unnest(range(1, len(found) + 1)) AS k FROM g),
p AS (SELECT *, (list_sum(list_transform(gaps[1:k], lambda x: length(x))) + coalesce(list_sum(list_transform(found[1:k - 1], lambda x: length(x))), 0))::INT AS debut FROM h)
SELECT doc_id::VARCHAR AS identifiant, source, langue, champ_ord, champ, found[k] AS fragment, debut, (debut + length(found[k]))::INT AS fin FROM p""")
def fragment_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What was masked in every field."""
    return audit.masked_fragments(mapping.text_pairs(_pivot_docs(spark, sf_dir), _masked_docs(spark, sf_dir)))


@query(f"WITH r AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rn FROM (SELECT doc_id, source, unnest(regexp_extract_all(text, '{_RX['telephone']}')) AS m FROM documents)) SELECT doc_id, source FROM r WHERE rn <= 3")
def capped_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "source", F.explode(tx.spans(F.col("text"), "telephone", tx.PII["telephone"])).alias("s")).withColumn("start", F.col("s.start"))
    return sampling.capped_per_group(d, "source", ["doc_id", "start"], 3).select("doc_id", "source")


@query("SELECT " + " UNION ALL SELECT ".join(f"'{c}' AS colonne, avg(CASE WHEN {c} IS NULL THEN 1.0::DOUBLE ELSE 0 END) AS taux_manquant, {'avg(length(coalesce(' + c + ', ' + chr(39) + 'None' + chr(39) + ')))' if s else 'NULL::DOUBLE'} AS longueur_moyenne FROM documents" for c, s in (("doc_id", 0), ("text", 1), ("lang", 1), ("source", 1), ("n_chars", 0))))
def profile_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.columns(table(spark, sf_dir, "documents"))


@query("WITH c AS (SELECT event_type, value, count(*) AS n FROM (SELECT event_type, floor(value) AS value FROM events) GROUP BY ALL) SELECT (sum(n) - count(*))::DOUBLE / sum(n) AS duplicate_rate FROM c")
def profile_missing_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.duplicate_rate(table(spark, sf_dir, "events").select("event_type", F.floor("value").alias("value")))


_CHAT = "'<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10)"


def _chats(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("contenu"))))
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.transform(turns, lambda t: F.struct(t["role"].alias("role"), t["contenu"].alias("contenu"))).alias("m"))


@query(f"SELECT conv_id, string_agg({_CHAT}, '' ORDER BY turn) AS texte FROM conversations GROUP BY 1")
def chatml_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chats(spark, sf_dir).select("conv_id", chat.render(F.col("m")).alias("texte"))


@query(f"WITH l AS (SELECT conv_id, turn, role, length({_CHAT}) AS n FROM conversations), b AS (SELECT conv_id, role, sum(n) OVER (PARTITION BY conv_id ORDER BY turn) AS fin, n FROM l) SELECT conv_id, role, (fin - n)::INT AS debut, fin::INT AS fin FROM b")
def turn_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chats(spark, sf_dir).select("conv_id", F.explode(chat.bounds(F.col("m"))).alias("b")).select("conv_id", "b.*")


@query(f"SELECT conv_id, {_CHAT} AS assistant FROM conversations WHERE role = 'assistant'")
def assistant_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _chats(spark, sf_dir).select("conv_id", chat.render(F.col("m")).alias("t"), chat.bounds(F.col("m")).alias("b"))
    return c.select("conv_id", F.explode(chat.assistant_text(F.col("t"), F.col("b"))).alias("assistant"))


@query(f"SELECT conv_id, sum(length({_CHAT}))::BIGINT AS n_ids, sum(CASE WHEN role <> 'assistant' THEN length({_CHAT}) ELSE 0 END)::BIGINT AS n_masked FROM conversations GROUP BY 1")
def label_masking(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _chats(spark, sf_dir).select("conv_id", chat.render(F.col("m")).alias("t"), chat.bounds(F.col("m")).alias("b"))
    ids = c.select("conv_id", chat.labels(F.col("t"), F.col("b"), chat.code_points).alias("ids"))
    return ids.select("conv_id", F.size("ids").cast("long").alias("n_ids"), F.size(F.filter("ids", lambda i: i == -100)).cast("long").alias("n_masked"))


@query("SELECT doc_id, source FROM documents WHERE lang = 'fr' AND source = 'src1'")
def filtered_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.matching(table(spark, sf_dir, "documents"), {"lang": "fr", "source": "src1", "absent": None}).select("doc_id", "source")


@query("SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) UNION ALL SELECT doc_id, 'q' || quality AS lang FROM labels")
def upsert_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    new = table(spark, sf_dir, "labels").select("doc_id", F.concat(F.lit("q"), "quality").alias("lang"))
    return files.upserted(table(spark, sf_dir, "documents").select("doc_id", "lang"), new, "doc_id", "lang")


@query("SELECT user_id, event_type, max_by(event_id, event_id) AS event_id, max_by(value, event_id) AS value FROM events GROUP BY ALL")
def latest_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.latest_per_key(table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "value"), ["user_id", "event_type"], "event_id")


@query("SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def resume_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("doc_id").alias("identifiant")
    rest = anonymise.to_do(table(spark, sf_dir, "documents").select(key, "lang"), table(spark, sf_dir, "labels").select(key))
    return rest.select(F.col("identifiant").alias("doc_id"), "lang")


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) ORDER BY doc_id LIMIT greatest(0, (SELECT count(DISTINCT doc_id) FROM labels) + 25 - (SELECT count(DISTINCT doc_id) FROM labels))")
def remaining_quota(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = table(spark, sf_dir, "labels")
    return sampling.remaining(table(spark, sf_dir, "documents").select("doc_id"), done, "doc_id", "doc_id", done.select("doc_id").distinct().count() + 25)


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) ORDER BY md5('43:' || doc_id), doc_id LIMIT 50")
def plain_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    fresh = table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_anti")
    return sampling.plain_sample(fresh, 50, "doc_id")


@query("SELECT CASE doc_id % 5 WHEN 0 THEN 'train' WHEN 1 THEN 'val' WHEN 2 THEN 'val' WHEN 3 THEN 'test' END AS split, count(*) AS n FROM documents GROUP BY 1")
def split_router(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.get(F.array(*map(F.lit, ("Train", "VALIDATION", " val", "test", "autre"))), F.col("doc_id") % 5)
    return files.routed(table(spark, sf_dir, "documents").select(raw.alias("split"))).groupBy("split").agg(F.count("*").alias("n"))


@query("SELECT event_id, (props->>'$.k')::BIGINT AS k FROM events UNION ALL SELECT event_id, 7 FROM events")
def glued_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", F.explode(js.split_glued(F.concat("props", F.lit('{"k": 7}')))).alias("j"))
    return e.select("event_id", F.from_json("j", "k bigint")["k"].alias("k"))


@query("SELECT conv_id, count(*) AS n, '[' || string_agg('{\"role\":\"' || role || '\"}', ',' ORDER BY turn) || ']' AS roles FROM conversations GROUP BY 1")
def history_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count("*").alias("n"), F.collect_list(F.struct("turn", "role", F.lit(None).cast("string").alias("contenu"))).alias("t"))
    return g.select("conv_id", "n", js.history(F.col("t")).alias("roles"))


def _opinions(d: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Documents as pairs, and entities: a person over all, a label of no interest, or none."""
    pairs = d.select(F.col("doc_id").cast("string").alias("identifiant"), "source", F.lit("en").alias("langue"), F.lit(0).alias("champ_ord"), F.lit("texte").alias("champ"), F.lit("").alias("original"), F.col("text").alias("masque"))
    label = F.when(F.col("doc_id") % 3 == 0, "PERSON").when(F.col("doc_id") % 3 == 1, "MISC")
    spans = F.array(F.struct(label.alias("label"), F.lit(0).alias("start"), F.length("text").alias("end")))
    e = d.filter(label.isNotNull()).select(F.col("doc_id").cast("string").alias("identifiant"), F.lit("texte").alias("champ"), spans.alias("entities"))
    return pairs, e


@query()
def candidate_verdicts_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates of every kind in all documents."""
    return audit.candidates(*_opinions(table(spark, sf_dir, "documents"))).groupBy("type_motif", "verdict").agg(F.count("*").alias("n"))


@query(f"WITH {_JUDGED} SELECT doc_id, verdict FROM j WHERE verdict IN ('confirme', 'revision_humaine') AND doc_id % 3 = 2")
def undecided_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    lab = _judged(spark, sf_dir)
    key = {"liste": F.lit("residuel"), "identifiant": F.col("doc_id").cast("string"), "champ": F.lit("texte"), "type_motif": F.lit("email"), "debut": F.lit(0), "fin": F.lit(1)}
    rows = lab.select(*[v.alias(k) for k, v in key.items()], "doc_id", "verdict")
    done = lab.filter("decision <> 'en attente'").select(*[v.alias(k) for k, v in key.items()], "decision")
    return audit.undecided(rows, done).filter(F.col("verdict").isin(audit.CONFIRMED, audit.HUMAN)).select("doc_id", "verdict")


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1) UNION ALL SELECT -count(*) AS doc_id FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def publication_filter_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids that may be published, and how many were left out as a negative number."""
    rows, left_out = audit.publishable(table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels").filter("toxic = 1"), "doc_id")
    return rows.union(left_out.select(-F.col("exclus")))


@query(" UNION ALL ".join(f"SELECT '{t}' AS \"table\", (SELECT count(*) FROM {t}) AS lignes, ((SELECT count(*) FROM {t}) - (SELECT count(*) FROM (SELECT DISTINCT * FROM {t})))::DOUBLE / (SELECT count(*) FROM {t}) AS duplicate_rate" for t in ("labels", "benchmark", "conversations", "nation")))
def profile_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.tables({t: table(spark, sf_dir, t) for t in ("labels", "benchmark", "conversations", "nation")})
