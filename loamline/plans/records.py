"""Registered queries of records, masks, decisions and metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamline.functions import clock, json_values as js
from loamline.functions import text as tx
from loamline.operators import anonymise, audit, curves, dedup, entities, evaluate, log_replay, mapping, profile, sampling
from loamline.plans.queries import _FIELDS, _JUDGED, _NAMES, _POINTS, _RX, _SPLIT, _TURNS, ORACLES, _flat, _judged, _masked_docs, _pivot_docs, _points, _split, _turns, query, table
from loamline.sources import files


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mapping.text_pairs(_pivot_docs(spark, sf_dir), _masked_docs(spark, sf_dir))


@query(f"WITH {_FIELDS} SELECT identifiant, min_by(champ, o) AS champ, min_by(masque, o) AS masque FROM (SELECT *, CASE champ WHEN 'symptomes' THEN 0 WHEN 'antecedents' THEN 1 WHEN 'prompt[0]' THEN 2 ELSE 3 END AS o FROM g) WHERE original <> '' GROUP BY 1")
def first_filled_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mapping.first_filled(_pairs(spark, sf_dir)).select("identifiant", "champ", "masque")


@query(f"WITH {_FIELDS} SELECT identifiant, original FROM g WHERE champ = 'completion[0]'")
def named_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mapping.field_pair(_pairs(spark, sf_dir), "completion[0]").select("identifiant", "original")


@query(f"WITH {_TURNS} SELECT id, answer || chr(10) || question AS texte FROM t")
def completion_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = lambda c: F.struct(F.lit("assistant").alias("role"), F.col(c).alias("contenu"))
    return _turns(spark, sf_dir).select("id", mapping.completion_text(F.array(said("answer"), said("question"))).alias("texte"))


@query("WITH d AS (SELECT doc_id, doc_id % 100 AS n, 'u' || doc_id || '@x.fr' AS m FROM documents) SELECT doc_id, 'Un ' || CASE WHEN n <= 12 THEN '<AGE_PEDIATRIQUE>' WHEN n <= 17 THEN '<AGE_ADOLESCENT>' WHEN n <= 64 THEN '<AGE_ADULTE>' ELSE '<AGE_PERSONNE_AGEE>' END || ' : <INFO_MASQUEE>, <INFO_MASQUEE> (le <INFO_MASQUEE>) au <INFO_MASQUEE>; NIR ' || CASE WHEN doc_id % 2 = 0 THEN '<INFO_MASQUEE>' ELSE '185037511600199' END || '. Depuis 3 semaines. Fin' AS masque, CASE WHEN doc_id % 2 = 0 THEN 'nir,' ELSE '' END || 'email,url,telephone,date' AS kinds FROM d")
def rule_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rules' masker over texts that hold every kind it knows: ages, mails, urls, dates, phone numbers, ids with right and wrong check digits."""
    i = F.col("doc_id")
    nir = F.when(i % 2 == 0, "185037511600127").otherwise("185037511600199")
    text = F.concat(F.lit("Un homme de "), i % 100, F.lit(" ans : u"), i, F.lit("@x.fr, http://s.fr/"), i, F.lit(" (le 12/05/19"), F.lpad((i % 90 + 10).cast("string"), 2, "0"), F.lit(") au 01 02 03 04 "), F.lpad((i % 90 + 10).cast("string"), 2, "0"), F.lit("; NIR "), nir, F.lit(". Depuis 3 semaines. Fin"))
    d = table(spark, sf_dir, "documents").select("doc_id", anonymise.rules()(text, F.lit("fr")).alias("x"))
    return d.select("doc_id", F.col("x.masked").alias("masque"), F.array_join(F.transform("x.spans", lambda s: s["kind"]), ",").alias("kinds"))


@query(f"WITH k AS (SELECT source, 'email' AS kind, len(regexp_extract_all(text, '{_RX['email']}')) AS n FROM documents UNION ALL SELECT source, 'email', len(regexp_extract_all(split_part(text, chr(10), 1), '{_RX['email']}')) FROM documents UNION ALL SELECT source, 'email', len(regexp_extract_all(split_part(text, chr(10), -1), '{_RX['email']}')) FROM documents) SELECT source, kind, sum(n)::BIGINT AS n FROM k GROUP BY ALL HAVING sum(n) > 0")
def kinds_by_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return anonymise.by_count(anonymise.stats(_masked_docs(spark, sf_dir)))


@query("WITH s AS (SELECT quality::VARCHAR AS source, count(*) AS n, sum(toxic) AS t FROM labels GROUP BY 1) SELECT '| source | lignes | avec entité | % |' || chr(10) || '|---|---:|---:|---:|' || chr(10) || string_agg('| ' || source || ' | ' || n || ' | ' || t || ' | ' || printf('%.1f', 100.0 * t / n) || ' |' || chr(10), '' ORDER BY source) AS markdown FROM s")
def report_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cumulative report as JSON, and Markdown made from it."""
    kinds = F.when(F.col("toxic") == 1, F.array(F.lit("email"))).otherwise(F.array().cast("array<string>"))
    stats = anonymise.stats(table(spark, sf_dir, "labels").select(F.col("quality").cast("string").alias("source"), kinds.alias("kinds")))
    return anonymise.markdown_of(anonymise.report_json(stats))


@query("SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def wave_of_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.waves(table(spark, sf_dir, "documents").select("doc_id", "lang", "source"), table(spark, sf_dir, "labels"), None, ["source", "lang"], "doc_id", "doc_id").select("doc_id", "lang")


@query("SELECT 100 AS n, 100 AS fresh, 0 AS repeated")
def wave_of_hundred(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two waves of 60 and 40 rows take a hundred, none of them twice or done before."""
    d, done = table(spark, sf_dir, "documents").select("doc_id", "lang", "source"), table(spark, sf_dir, "labels").select("doc_id")
    strata = ["source", "lang"]
    one = sampling.waves(d, done, 60, strata, "doc_id", "doc_id").select("doc_id")
    two = sampling.waves(d, done.union(one), 40, strata, "doc_id", "doc_id").select("doc_id")
    both = one.union(two).join(done.withColumn("was", F.lit(1)), "doc_id", "left")
    return both.agg(F.count("*").cast("int").alias("n"), F.count_if(F.col("was").isNull()).cast("int").alias("fresh"), (F.count("*") - F.count_distinct("doc_id")).cast("int").alias("repeated"))


@query("SELECT doc_id, quality::BIGINT AS o, toxic::BIGINT AS m FROM labels WHERE doc_id % 2 = 0 AND doc_id % 5 <> 0")
def replayed_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Original and masked rows of all ids ever sampled that are still there on both sides."""
    lab = table(spark, sf_dir, "labels").withColumn("identifiant", F.col("doc_id").cast("string"))
    registry = lab.filter("doc_id % 2 = 0").select("identifiant")
    pairs = audit.replayed(registry.union(registry), lab.select("identifiant", "doc_id", "quality"), lab.filter("doc_id % 5 <> 0").select("identifiant", "toxic"))
    return pairs.select("o.doc_id", F.col("o.quality").cast("long").alias("o"), F.col("m.toxic").cast("long").alias("m"))


def _candidate_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels as the three lists of candidates."""
    rows = _judged(spark, sf_dir).select(F.col("doc_id").cast("string").alias("identifiant"), F.lit("s").alias("source"), F.lit("texte").alias("champ"), F.lit("fr").alias("langue"), F.lit("email").alias("type_motif"), F.lit(0).alias("debut"), F.lit(3).alias("fin"), F.lit("x").alias("passage"), "verdict")
    fragments = rows.drop("langue", "type_motif").withColumnRenamed("passage", "fragment")
    return audit.all_candidates(rows, fragments, rows, [audit.CONFIRMED, audit.HUMAN])


@query(f"WITH {_JUDGED} SELECT liste, doc_id::VARCHAR AS identifiant, verdict, CASE WHEN liste = 'residuel' AND doc_id % 4 = 0 THEN 'accepte' ELSE 'en attente' END AS decision FROM j, (VALUES ('residuel'), ('fragment'), ('sans_entite')) v(liste) WHERE verdict <> 'faux_positif_regex'")
def annotated_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates of three lists with the decisions there are."""
    rows = _candidate_lists(spark, sf_dir)
    done = rows.filter((F.col("liste") == "residuel") & (F.col("identifiant").cast("long") % 4 == 0)).select("liste", "identifiant", "champ", "type_motif", "debut", "fin", F.lit("accepte").alias("decision"))
    return audit.annotated(rows, done).select("liste", "identifiant", "verdict", "decision")


@query(f"WITH {_JUDGED} SELECT count(DISTINCT doc_id) AS n FROM j WHERE verdict <> 'faux_positif_regex'")
def distinct_decision_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _candidate_lists(spark, sf_dir).filter("liste = 'residuel'")
    return rows.agg(F.count_distinct(audit.decision_key()).alias("n"))


@query("SELECT 'difference' AS kind, count(*) AS n FROM (SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels) UNION ALL SELECT 'intersection', count(*) FROM (SELECT doc_id FROM documents INTERSECT SELECT doc_id FROM labels) UNION ALL SELECT 'union', count(*) FROM (SELECT doc_id FROM documents UNION SELECT doc_id FROM labels)")
def id_set_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    sets = dedup.id_sets(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "doc_id")
    sizes = [d.agg(F.lit(k).alias("kind"), F.count("*").alias("n")) for k, d in sets.items()]
    return sizes[0].union(sizes[1]).union(sizes[2])


@query("WITH g AS (SELECT DISTINCT 16 AS rang, user_id % 7 AS k FROM events WHERE user_id % 7 > 3), p AS (SELECT unnest(range(0, 7)) AS pos) SELECT pos::BIGINT AS pos, (pos * 1e-4)::DOUBLE AS taux FROM p WHERE pos NOT IN (SELECT k FROM g) ORDER BY pos LIMIT 1")
def next_untried(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first of seven learning rates that no run of the events has."""
    tried = table(spark, sf_dir, "events").select((F.col("user_id") % 7).alias("k")).filter("k > 3").distinct()
    grid = dedup.expanded_grid(spark.range(1).select(F.lit(16).alias("rang")), "taux", [k * 1e-4 for k in range(7)])
    done = grid.join(tried, F.col("pos") == F.col("k"), "left_semi")
    return dedup.not_yet_tried(grid, done, ["taux", "rang"]).select(F.col("pos").cast("long").alias("pos"), "taux")


_F1_SQL = r"trim(regexp_replace(regexp_replace(lower({c}), '[^\p{{L}}\p{{N}}_\s]', ' ', 'g'), '\s+', ' ', 'g'))"


@query(f"WITH {_TURNS}, n AS (SELECT id, list_filter(string_split({_F1_SQL.format(c='answer')}, ' '), lambda x: x <> '') AS e, list_filter(string_split({_F1_SQL.format(c='question')}, ' '), lambda x: x <> '') AS g FROM t), a AS (SELECT id, w, count(*) AS c FROM (SELECT id, unnest(e) AS w FROM n) GROUP BY ALL), b AS (SELECT id, w, count(*) AS c FROM (SELECT id, unnest(g) AS w FROM n) GROUP BY ALL) SELECT n.id, coalesce(sum(least(a.c, coalesce(b.c, 0))), 0)::BIGINT AS common FROM n LEFT JOIN a ON a.id = n.id LEFT JOIN b ON b.id = n.id AND b.w = a.w GROUP BY n.id")
def common_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = lambda c: tx.tokens(tx.normalised(F.col(c)))
    return _turns(spark, sf_dir).select("id", evaluate.common_tokens(words("answer"), words("question")).cast("long").alias("common"))


@query(f"WITH {_TURNS}, n AS (SELECT id, list_filter(string_split({_F1_SQL.format(c='answer')}, ' '), lambda x: x <> '') AS e, list_filter(string_split({_F1_SQL.format(c='question')}, ' '), lambda x: x <> '') AS g FROM t), a AS (SELECT id, w, count(*) AS c FROM (SELECT id, unnest(e) AS w FROM n) GROUP BY ALL), b AS (SELECT id, w, count(*) AS c FROM (SELECT id, unnest(g) AS w FROM n) GROUP BY ALL), m AS (SELECT a.id, sum(least(a.c, b.c)) AS m FROM a JOIN b USING (id, w) GROUP BY 1) SELECT round(avg(CASE WHEN len(e) = 0 AND len(g) = 0 THEN 1.0::DOUBLE WHEN m IS NULL THEN 0 ELSE 2.0::DOUBLE * m / (len(e) + len(g)) END), 9) AS token_f1 FROM n LEFT JOIN m USING (id)")
def mean_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.mean_token_f1(_turns(spark, sf_dir), "id", "answer", "question").select(F.round("token_f1", 9).alias("token_f1"))


@query("SELECT event_id FROM events WHERE user_id % 10 = 0 ORDER BY event_id LIMIT 20")
def bounded_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.bounded_sample(table(spark, sf_dir, "events").filter("user_id % 10 = 0").select("event_id"), "event_id")


@query("SELECT (doc_id // 100)::BIGINT AS bloc, count(*) AS lignes, avg(CASE WHEN doc_id % 3 = 0 THEN 1.0::DOUBLE ELSE 0 END) AS manquant_x FROM documents GROUP BY 1")
def block_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.by_block(table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("doc_id") % 3 > 0, 1).alias("x")), "doc_id", 100)


@query("WITH s AS (SELECT conv_id, '[' || string_agg(CASE WHEN turn % 2 = 0 THEN turn::VARCHAR ELSE 'None' END, ', ' ORDER BY turn) || ']' AS l, max(turn) AS t FROM conversations GROUP BY 1) SELECT 'liste' AS colonne, avg(length(l)) AS longueur_moyenne FROM s UNION ALL SELECT 'paire', avg(length('{''t'': ' || t || ', ''r'': ''x''}')) FROM s")
def printed_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean lengths of list and struct columns, as they are printed."""
    c = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list("turn")).alias("turns"))
    rows = c.select(F.transform("turns", lambda t: F.when(t % 2 == 0, t)).alias("liste"), F.struct(F.array_max("turns").alias("t"), F.lit("x").alias("r")).alias("paire"))
    return profile.columns(rows).select("colonne", "longueur_moyenne")


@query("SELECT doc_id, CASE WHEN doc_id % 100 <= 12 THEN '<AGE_PEDIATRIC>' WHEN doc_id % 100 <= 17 THEN '<AGE_ADOLESCENT>' WHEN doc_id % 100 <= 64 THEN '<AGE_ADULT>' ELSE '<AGE_ELDERLY>' END AS tranche FROM documents")
def age_bracket_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", tx.age_bracket_of(F.col("doc_id") % 100, "en").alias("tranche"))


@query("SELECT event_id, CASE event_id % 8 WHEN 0 THEN '3.0' WHEN 1 THEN '[1, ''a'', None, 2.5]' WHEN 2 THEN 'None' WHEN 3 THEN 'True' WHEN 4 THEN (event_id % 97)::VARCHAR WHEN 5 THEN '1e+20' WHEN 6 THEN 'deux' END AS niveau FROM events")
def json_levels_spelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Levels of every kind of JSON value, some with text around the object."""
    values = ["3.0", '[1, "a", null, 2.50]', "null", "true", None, "1e20", '" deux "']
    value = F.coalesce(F.get(F.array(*map(F.lit, values)), F.col("event_id") % 8), (F.col("event_id") % 97).cast("string"))
    text = F.when(F.col("event_id") % 8 == 7, '{"autre": 1}').otherwise(F.concat(F.when(F.col("event_id") % 3 == 0, "dit : ").otherwise(""), F.lit('{"niveau": '), value, F.lit("}")))
    return table(spark, sf_dir, "events").select("event_id", js.level(text).alias("niveau"))


@query("SELECT conv_id, '[' || string_agg('{\"role\":' || to_json(role)::VARCHAR || ',\"contenu\":' || to_json(text)::VARCHAR || '}', ',' ORDER BY turn) || ']' AS historique FROM conversations GROUP BY 1")
def history_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole histories as JSON, texts included."""
    g = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.collect_list(F.struct("turn", "role", F.col("text").alias("contenu"))).alias("t"))
    return g.select("conv_id", js.history(F.col("t")).alias("historique"))


@query("SELECT conv_id, turn::BIGINT AS turn, CASE WHEN turn = 0 THEN 'Note : ' ELSE '' END || text AS demande FROM conversations")
def first_turn_prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").cast("long").alias("turn"), js.first_turn_prefix(F.col("turn"), F.lit(0), "Note : ", F.col("text")).alias("demande"))


@query("SELECT user_id AS run, 'x' AS nom, 3.0::DOUBLE AS valeur FROM (SELECT DISTINCT user_id FROM events) UNION ALL SELECT user_id, 'loss', 1.5 FROM (SELECT DISTINCT user_id FROM events)")
def printed_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers of printed dicts that hold None, truth values and text too."""
    users = table(spark, sf_dir, "events").select(F.col("user_id").alias("run")).distinct()
    m = users.select("run", F.explode(js.python_dict(F.lit("{'loss': 1.5, 'a': None, 'x': 3, 'b': True, 'c': 'text'}"))).alias("nom", "valeur"))
    return m.filter("valeur is not null")


@query("SELECT user_id AS run, repeat('a', 40) AS sha, (user_id % 5)::BIGINT AS valeur FROM (SELECT DISTINCT user_id FROM events)")
def log_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The commit and the last counter that a log names."""
    users = table(spark, sf_dir, "events").select("user_id").distinct()
    text = F.array(F.concat(F.lit("pkg @ git+https://host.example/x@"), F.repeat(F.lit("a"), F.lit(40))), F.lit("rows: 99"), F.concat(F.lit("rows="), F.col("user_id") % 5))
    lines = users.select(F.col("user_id").alias("run"), F.posexplode(text).alias("ord", "line"))
    return log_replay.commits(lines).join(log_replay.counters(lines, ["rows"]), "run").select("run", "sha", "valeur")


@query("SELECT doc_id, 'd' || doc_id AS texte, strftime(make_timestamp(doc_id * 1000000 * 3600), '%Y-%m-%dT%H:%M:%S') || '+00:00' AS horodatage FROM documents")
def iso_stamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stamps of a given clock; the session's time zone makes no difference."""
    at = lambda: clock.iso(F.timestamp_seconds(F.col("doc_id") * 3600))
    return table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("d"), "doc_id").alias("texte"), at().alias("horodatage"))


@query("WITH l AS (SELECT quality::VARCHAR AS source, doc_id, row_number() OVER (PARTITION BY quality ORDER BY doc_id::VARCHAR) AS rn FROM labels WHERE doc_id % 3 <> 0) SELECT source, doc_id::VARCHAR AS identifiant, CASE WHEN doc_id % 3 = 1 THEN 'revision_humaine' ELSE 'faux_positif_regex' END AS verdict FROM l WHERE rn <= 5")
def capped_false_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Masked fragments that name nobody, five a source: a third overlap a person, a third another label, the rest nothing."""
    lab = table(spark, sf_dir, "labels").withColumn("identifiant", F.col("doc_id").cast("string"))
    fragments = lab.select("identifiant", F.col("quality").cast("string").alias("source"), F.lit("fr").alias("langue"), F.lit(0).alias("champ_ord"), F.lit("texte").alias("champ"), F.lit("xyz").alias("fragment"), F.lit(2).alias("debut"), F.lit(5).alias("fin"))
    label = F.when(F.col("doc_id") % 3 == 0, "PER").when(F.col("doc_id") % 3 == 1, "MISC")
    entities = lab.filter(label.isNotNull()).select("identifiant", F.lit("texte").alias("champ"), F.array(F.struct(label.alias("label"), F.lit(4).alias("start"), F.lit(9).alias("end"))).alias("entities"))
    return audit.false_masks(fragments, entities, 5).select("source", "identifiant", "verdict")


@query(f"WITH {_SPLIT}, c AS (SELECT source, lang, count(*) FILTER (split = 'train') AS a, count(*) FILTER (split = 'val') AS b, count(*) FILTER (split = 'test') AS c, count(*) AS n FROM s GROUP BY ALL) SELECT source, lang, rpad(source || ' / ' || lang, 24, ' ') || ' ' || printf('%8d (%5.1f %%)', a, 100.0 * a / n) || ' ' || printf('%8d (%5.1f %%)', b, 100.0 * b / n) || ' ' || printf('%8d (%5.1f %%)', c, 100.0 * c / n) || ' ' || lpad(n::VARCHAR, 8, ' ') AS ligne FROM c")
def crosstab_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.as_text(sampling.crosstab(_split(spark, sf_dir), ["source", "lang"]), ["source", "lang"])


@query(f"WITH {_POINTS}, r AS (SELECT run, coalesce(max_by(struct_pack(v := perte_train), etape).v, 0) AS perte_train, coalesce(max_by(struct_pack(v := perte_validation), etape).v, 0) AS perte_validation FROM c GROUP BY run) SELECT run, perte_train, perte_validation FROM r")
def last_row_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each run's values at its last whole step, 0 where missing; columns that no row fills are left out."""
    w = curves.complete_steps(curves.wide(_points(spark, sf_dir), _NAMES))
    names = [n for n in curves.present(w, [curves.TRAIN, "absent", curves.VALID])]
    filled = w.select("run", "etape", *[F.struct(F.col(n)).alias(n) for n in names])
    last = filled.groupBy("run").agg(*[F.max_by(n, "etape").alias(n) for n in names])
    plain = last.select("run", F.lit(0).alias("etape"), *[F.col(f"{n}.{n}").alias(n) for n in names])
    return curves.last_row(plain, names)


@query(ORACLES["pivot_question_answer"])
def pivot_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A corpus mapped by its name."""
    return _flat(mapping.mapped(_turns(spark, sf_dir).select("question", "answer"), "medquad"))


@query("SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'OBJECT<a: BIGINT>' WHEN 1 THEN 'STRING' WHEN 2 THEN 'VOID' END AS kind, least(greatest(event_id % 5 - 1, 0), 2)::BIGINT AS capped FROM events")
def strict_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts as one JSON value each, or none; and a number held between 0 and 2."""
    texts = ['{"a": 1}', '"x"', "null", "1 2", "{'a': 1}"]
    e = table(spark, sf_dir, "events").select("event_id", F.get(F.array(*map(F.lit, texts)), F.col("event_id") % 5).alias("t"))
    return e.select("event_id", F.schema_of_variant(js.strict(F.col("t"))).alias("kind"), js.capped(F.col("event_id") % 5 - 1).cast("long").alias("capped"))


@query("SELECT user_id AS run, CASE WHEN user_id % 2 = 0 THEN 0.1 END::DOUBLE AS beta FROM (SELECT DISTINCT user_id FROM events)")
def runs_with_parameters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every other run wrote its parameters."""
    found = table(spark, sf_dir, "events").select(F.col("user_id").alias("run")).distinct()
    return files.run_parameters(found, found.filter("run % 2 = 0").withColumn("beta", F.lit(0.1)))


@query("SELECT doc_id, (40 + doc_id % 12)::BIGINT AS debut, (least(40 + doc_id % 12 + 6 + 40, 58 + doc_id % 30) - doc_id % 12)::BIGINT AS n FROM documents")
def span_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lengths of the context of one address in a text, forty characters on either side where there are as many."""
    i = F.col("doc_id")
    text = F.concat(F.repeat(F.lit("="), (40 + i % 12).cast("int")), F.lit("a@b.fr"), F.repeat(F.lit("="), (12 - i % 12 + i % 30).cast("int")))
    d = table(spark, sf_dir, "documents").select("doc_id", text.alias("t")).select("doc_id", "t", F.explode(tx.pii_spans(F.col("t"), ("email",))).alias("s"))
    return d.select("doc_id", F.col("s.start").cast("long").alias("debut"), F.length(tx.context(F.col("t"), F.col("s.start"), F.col("s.end"))).cast("long").alias("n"))


def _recogniser(spark: SparkSession, docs: DataFrame) -> entities.Recogniser:
    """The capitalised names that stand in several documents, as people or places by their length."""
    return entities.Recogniser.of(spark, entities.frequent_names(docs, F.when(F.length("name") % 2 == 0, "PER").otherwise("LOC")))


# words with their places; runs of capitalised ones with nothing but white space between; names of two or three words in several documents;
# and every place of each, joined by label
_TITLE = "[A-ZÀ-Ý][a-zà-ÿ]+"
_FOUND_NAMES = rf"""
ws AS (SELECT doc_id, unnest(regexp_extract_all(text, '[\p{{L}}\p{{N}}_]+')) AS w, generate_subscripts(regexp_extract_all(text, '[\p{{L}}\p{{N}}_]+'), 1) AS k FROM documents),
gs AS (SELECT doc_id, unnest(regexp_split_to_array(text, '[\p{{L}}\p{{N}}_]+')) AS g, generate_subscripts(regexp_split_to_array(text, '[\p{{L}}\p{{N}}_]+'), 1) AS k FROM documents),
tk AS (SELECT doc_id, k, w, g, sum(length(g) + length(w)) OVER (PARTITION BY doc_id ORDER BY k)::INT AS e FROM ws JOIN gs USING (doc_id, k)),
tt AS (SELECT *, e - length(w) AS s, regexp_full_match(w, '{_TITLE}') AS title, coalesce(regexp_full_match(g, '\s+'), false) AS near FROM tk),
rn AS (SELECT *, sum(CASE WHEN title AND near AND coalesce(was, false) THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY k) AS r FROM (SELECT *, lag(title) OVER (PARTITION BY doc_id ORDER BY k) AS was FROM tt)),
nm AS (SELECT name FROM (SELECT doc_id, string_agg(w, ' ' ORDER BY k) AS name, count(*) AS n FROM rn WHERE title GROUP BY doc_id, r) WHERE n BETWEEN 2 AND 3 GROUP BY name HAVING count(DISTINCT doc_id) >= 2),
pl AS (SELECT doc_id, a.s, b.e, a.w || ' ' || b.w AS name FROM tt a JOIN tt b USING (doc_id) WHERE b.k = a.k + 1 AND b.near
  UNION ALL SELECT doc_id, a.s, c.e, a.w || ' ' || b.w || ' ' || c.w FROM tt a JOIN tt b USING (doc_id) JOIN tt c USING (doc_id) WHERE b.k = a.k + 1 AND c.k = a.k + 2 AND b.near AND c.near),
hit AS (SELECT doc_id, s, e, CASE WHEN length(name) % 2 = 0 THEN 'PER' ELSE 'LOC' END AS label FROM pl JOIN nm USING (name)),
il AS (SELECT *, max(e) OVER (PARTITION BY doc_id, label ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM hit),
ig AS (SELECT il.*, sum(CASE WHEN m IS NULL OR (s > m AND NOT regexp_full_match(substr(text, m + 1, s - m), '\s*')) THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, label ORDER BY s, e) AS i FROM il JOIN documents USING (doc_id)),
ent AS (SELECT doc_id, label, min(s) AS debut, max(e) AS fin FROM ig GROUP BY doc_id, label, i)"""


@query(f"WITH {_FOUND_NAMES} SELECT doc_id, label, debut, fin FROM ent")
def listed_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every place of every listed name in all documents."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = entities.with_entities(docs, _recogniser(spark, docs)).select("doc_id", F.explode("entities").alias("e"))
    return found.select("doc_id", "e.label", F.col("e.start").alias("debut"), F.col("e.end").alias("fin"))


@query(f"""WITH {_FOUND_NAMES},
hm AS (SELECT *, max(fin) OVER (PARTITION BY doc_id ORDER BY debut, fin DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM ent),
hg AS (SELECT *, sum(CASE WHEN m IS NULL OR debut >= m THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY debut, fin DESC) AS i FROM hm),
isl AS (SELECT doc_id, i, min(debut) AS a, max(fin) AS b FROM hg GROUP BY doc_id, i),
pc AS (SELECT doc_id, i, b, substr(text, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY i), 0) + 1, a - coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY i), 0)) || '<INFO_MASQUEE>' AS piece FROM isl JOIN documents USING (doc_id)),
dn AS (SELECT doc_id, count(*) AS n, string_agg(piece, '' ORDER BY i) AS head, max(b) AS b FROM pc GROUP BY doc_id)
SELECT doc_id, coalesce(n, 0)::BIGINT AS masques, CASE WHEN text IS NOT NULL THEN coalesce(head, '') || substr(text, coalesce(b, 0) + 1) END AS masque FROM documents LEFT JOIN dn USING (doc_id)""")
def masked_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with their listed names masked."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = entities.with_entities(docs, _recogniser(spark, docs))
    groups = lambda s: F.size(tx.merged(s)).cast("long")
    return found.select("doc_id", tx.bound(entities.as_spans(F.col("entities")), groups).alias("masques"), tx.with_spans_masked(F.col("text"), entities.as_spans(F.col("entities"))).alias("masque"))


@query()
def tagged_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities of all documents by label, with names that a tagger finds beside the listed ones."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    listed = _recogniser(spark, docs)
    both = listed.with_tagger(spark, entities.fit_tagger(docs, listed, max_lines=1000))
    found = entities.with_entities(docs, both).select("doc_id", F.explode("entities").alias("e"))
    return found.groupBy("doc_id", F.col("e.label").alias("label")).agg(F.count("*").alias("n"))


_DATE_SQL = "(?i)(?:^|[^\\p{L}\\p{N}_])(?:\\p{Nd}{1,2}[/-]\\p{Nd}{1,2}[/-]\\p{Nd}{2,4}|\\p{Nd}{4}[/-]\\p{Nd}{1,2}[/-]\\p{Nd}{1,2}|\\p{Nd}{1,2}\\s+(?:" + tx.MONTHS + ")\\s+\\p{Nd}{4})(?:$|[^\\p{L}\\p{N}_])"
ORACLES["candidate_verdicts_all"] = f"""WITH {_FOUND_NAMES},
kn AS ({" UNION ALL ".join(f"SELECT doc_id, '{k}' AS type_motif, len(regexp_extract_all(text, '{r}')) AS n FROM documents" for k, r in (*_RX.items(), ("date", _DATE_SQL)))}
  UNION ALL SELECT doc_id, 'bigramme_capitalise', count(*) FILTER (n >= 2) FROM (SELECT doc_id, r, count(*) AS n FROM rn WHERE title GROUP BY doc_id, r) GROUP BY doc_id)
SELECT type_motif, CASE WHEN type_motif <> 'bigramme_capitalise' OR doc_id % 3 = 0 THEN 'confirme' WHEN doc_id % 3 = 1 THEN 'revision_humaine' ELSE 'faux_positif_regex' END AS verdict, sum(n)::BIGINT AS n
FROM kn GROUP BY ALL HAVING sum(n) > 0"""


@query(f"""WITH {_FOUND_NAMES},
cd AS (SELECT doc_id, min(s) AS s, max(e) AS e FROM rn WHERE title GROUP BY doc_id, r HAVING count(*) >= 2)
SELECT doc_id, s AS debut, CASE WHEN EXISTS (SELECT 1 FROM ent WHERE ent.doc_id = cd.doc_id AND ent.debut < cd.e AND ent.fin > cd.s) THEN 'confirme' ELSE 'faux_positif_regex' END AS verdict FROM cd""")
def recognised_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Capitalised words in all documents, judged by the recogniser's names."""
    docs = table(spark, sf_dir, "documents")
    pairs = docs.select(F.col("doc_id").cast("string").alias("identifiant"), "source", F.lit("en").alias("langue"), F.lit(0).alias("champ_ord"), F.lit("texte").alias("champ"), F.lit("").alias("original"), F.col("text").alias("masque"))
    known = entities.with_field_entities(pairs, _recogniser(spark, docs.select("doc_id", "text")))
    judged = audit.candidates(known).filter("type_motif = 'bigramme_capitalise'")
    return judged.select(F.col("identifiant").cast("long").alias("doc_id"), "debut", "verdict")


@query(f"""WITH g AS (SELECT doc_id, text, regexp_extract_all(text, '{_RX['email']}') AS f, regexp_split_to_array(text, '{_RX['email']}') AS p FROM documents)
SELECT doc_id, array_to_string(list_transform(range(1, len(p) + 1), lambda i: p[i] || coalesce(repeat('*', least(length(f[i]), 100)) || substr(f[i], 101), '')), '') AS etoiles, regexp_replace(text, '{_RX['email']}', '', 'g') AS sans FROM g""")
def mask_strategies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E-mail addresses in all documents as stars, and left out."""
    found = lambda t: tx.spans(t, "email", tx.PII["email"])
    t = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", tx.with_spans_masked(t, found(t), "mask").alias("etoiles"), tx.with_spans_masked(t, found(t), "redact").alias("sans"))


@query("""WITH f AS (SELECT doc_id, source, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)),
r AS (SELECT *, row_number() OVER (PARTITION BY source, lang ORDER BY md5('42:' || doc_id), doc_id) AS rn, count(*) OVER (PARTITION BY source, lang) AS n FROM f)
SELECT doc_id, source, lang, CASE WHEN rn <= floor(n * 0.1) THEN 'test' WHEN rn <= floor(n * 0.1) + floor(n * 0.1) THEN 'val' ELSE 'train' END AS split FROM r""")
def split_without_excluded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The grow-only split of all documents but the excluded ones."""
    rows = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", F.lit(True).alias("anonymise"), F.lit(None).cast("string").alias("split"))
    return sampling.assign_splits(rows, ["source", "lang"], "doc_id", excluded=table(spark, sf_dir, "labels").filter("toxic = 1"))


@query("""SELECT 'residuel' AS strate, doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1)
UNION ALL SELECT 'sans_entite', doc_id FROM (SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 0) ORDER BY md5('43:' || doc_id), doc_id LIMIT 40)""")
def new_samples_by_stratum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What two strata have not sampled yet, each by its own entries in the registry: all of one, 40 rows of the other."""
    ids = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("identifiant"))
    registry = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("identifiant"), F.when(F.col("quality") == 1, "residuel").otherwise("sans_entite").alias("strate"))
    drawn = [audit.new_samples(ids, registry, stratum, k).select(F.lit(stratum).alias("strate"), F.col("identifiant").alias("doc_id")) for stratum, k in (("residuel", None), ("sans_entite", 40))]
    return drawn[0].union(drawn[1])


@query("SELECT event_type, q, CASE q WHEN 0.01 THEN quantile_cont(value, 0.01) WHEN 0.5 THEN quantile_cont(value, 0.5) ELSE quantile_cont(value, 0.99) END AS value FROM events, (VALUES (0.01::DOUBLE), (0.5::DOUBLE), (0.99::DOUBLE)) v(q) GROUP BY event_type, q")
def latency_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact 1 %, 50 % and 99 % quantiles of each kind of event."""
    return evaluate.exact_quantiles(table(spark, sf_dir, "events"), "value", [0.01, 0.5, 0.99], ["event_type"])
