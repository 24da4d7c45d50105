"""Registered queries of sources and sinks: tables are written to the shared folder and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loamline import schemas
from loamline.functions import text as tx
from loamline.operators import chat, evaluate, inference, log_replay
from loamline.plans.queries import _TURNS, _VERDICTS, _pivot_docs, _points, _turns, query, table
from loamline.sources import files, versions
from loamline.streaming import logs, runs

_LABEL = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("kind", T.StringType())])


@query("SELECT conv_id::BIGINT AS conv_id, turn::BIGINT AS turn, role, text FROM conversations")
def csv_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = files.scratch(spark) + ".csv"
    table(spark, sf_dir, "conversations").write.options(header=True, escape='"', quoteAll=True).csv(path)
    rows = files.read_corpus(spark, path, chunk=1000)
    return rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")


@query("SELECT doc_id::BIGINT AS doc_id, text FROM documents")
def jsonl_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = files.scratch(spark) + ".jsonl"
    n = files.dump_corpus(table(spark, sf_dir, "documents").select("doc_id", "text"), path)
    return files.read_corpus(spark, path).select("doc_id", "text").filter(F.lit(n) > 0)


@query("SELECT n_nationkey::BIGINT AS n_nationkey, n_name FROM nation")
def json_array_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = files.scratch(spark) + ".json"
    table(spark, sf_dir, "nation").agg(F.to_json(F.collect_list(F.struct("*")))).write.text(path)
    return files.read_corpus(spark, path).select("n_nationkey", "n_name")


@query("SELECT 'train' AS split, count(*) AS n FROM documents")
def hub_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = files.scratch(spark)
    table(spark, sf_dir, "documents").write.parquet(f"{path}/train")
    return files.read_hub(spark, path).agg(F.lit("train").alias("split"), F.count("*").alias("n"))


@query("SELECT doc_id, 'q' || quality AS kind FROM labels WHERE doc_id % 3 <> 0 UNION ALL SELECT doc_id, 'new' FROM labels WHERE doc_id % 3 = 0 UNION ALL SELECT -doc_id - 1, 'new' FROM labels WHERE doc_id % 3 = 0")
def keyed_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two upserts into a table that is missing at first."""
    path, lab = files.scratch(spark), table(spark, sf_dir, "labels")
    files.upsert(spark, path, _LABEL, lab.select("doc_id", F.concat(F.lit("q"), "quality").alias("kind")), "doc_id")
    third = lab.filter("doc_id % 3 = 0")
    files.upsert(spark, path, _LABEL, third.select("doc_id", F.lit("new").alias("kind")).union(third.select(-F.col("doc_id") - 1, F.lit("new"))), "doc_id")
    return files.read_table(spark, path, _LABEL)


@query("SELECT doc_id, lang FROM documents WHERE doc_id = 7")
def point_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.lookup(table(spark, sf_dir, "documents").select("doc_id", "lang"), 7, "doc_id")


@query("SELECT count(*) AS n FROM documents WHERE lang = 'en'")
def filtered_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.matching(table(spark, sf_dir, "documents"), {"lang": "en"}).agg(F.count("*").alias("n"))


@query("SELECT DISTINCT conv_id FROM conversations")
def projected_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.identifiers(table(spark, sf_dir, "conversations"), "conv_id")


@query("SELECT doc_id::VARCHAR AS identifiant, CASE WHEN quality = 0 THEN 'rejete' ELSE 'accepte' END AS decision, '2024-01-0' || (2 - quality) AS horodatage FROM labels")
def decision_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decisions are appended twice; of a candidate's the last counts."""
    path, lab = files.scratch(spark), table(spark, sf_dir, "labels")
    key = {"liste": F.lit("residuel"), "identifiant": F.col("doc_id").cast("string"), "champ": F.lit("texte"), "type_motif": F.lit("email"), "debut": F.lit(0), "fin": F.lit(1)}
    rows = lambda d, said, day: d.select(*[v.alias(k) for k, v in key.items()], F.lit(said).alias("decision"), F.lit(day).alias("horodatage"))
    files.append(rows(lab, "accepte", "2024-01-01"), path)
    files.append(rows(lab.filter("quality = 0"), "rejete", "2024-01-02"), path)
    return files.decisions(spark, path).select("identifiant", "decision", "horodatage")


@query("SELECT doc_id::VARCHAR AS identifiant FROM labels WHERE toxic = 1")
def registry_by_stratum(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, lab = files.scratch(spark), table(spark, sf_dir, "labels")
    for part in (lab, lab.filter("doc_id % 2 = 0")):
        files.append(part.select(F.col("doc_id").cast("string").alias("identifiant"), F.when(F.col("toxic") == 1, "a").otherwise("b").alias("strate"), F.lit("t").alias("horodatage")), path)
    return files.sampled_ids(files.read_table(spark, path, schemas.REGISTRY), "a")


@query("SELECT doc_id::VARCHAR AS identifiant, 'confirme' AS motif FROM labels WHERE toxic = 1 UNION ALL SELECT 'n', (count(*))::VARCHAR FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def exclusion_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The excluded ids, and the size of the subset that is written without them."""
    path = files.scratch(spark)
    out = table(spark, sf_dir, "labels").filter("toxic = 1").select(F.col("doc_id").cast("string").alias("identifiant"), F.lit("confirme").alias("motif"))
    rest = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("identifiant")).join(out, "identifiant", "left_anti")
    n = files.write_subset(rest, f"{path}/subset", out, f"{path}/excluded")
    return files.read_table(spark, f"{path}/excluded", out.schema).union(spark.range(1).select(F.lit("n"), F.lit(str(n))))


@query("SELECT 'b' AS run, user_id AS etape, sum(value)::DOUBLE AS valeur, 1500::BIGINT AS ms FROM events GROUP BY user_id")
def run_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics of two runs in folders of their own; a is imported already, b began anew once."""
    root = files.scratch(spark)
    # summed exactly: a plain sum's last digits change with the order of the rows
    m = evaluate.exact_sums(table(spark, sf_dir, "events"), "value", ["user_id"], "valeur").select(F.col("user_id").cast("int").alias("etape"), F.lit("perte_train").alias("nom"), "valeur", F.lit(1.5).alias("horodatage"))
    parameters = spark.range(1).select(F.lit(0.1).alias("beta"))
    for run in ("a", "b", "b"):
        files.start_run(m.limit(0), parameters, root, run)
        files.log_metrics(m, root, run)
    fresh = files.not_imported(files.runs(spark, root), spark.range(1).select(F.lit("a").alias("run")))
    rows = files.metric_log(spark, f"{root}/b/metriques.jsonl").withColumn("run", F.lit("b")).join(fresh, "run")
    return rows.select("run", F.col("etape").cast("long").alias("etape"), "valeur", files.milliseconds(F.col("horodatage")).alias("ms"))


@query("SELECT CASE doc_id % 5 WHEN 0 THEN 'train' WHEN 1 THEN 'val' WHEN 2 THEN 'val' WHEN 3 THEN 'test' ELSE 'ignores' END AS split, count(*) AS n FROM documents GROUP BY 1")
def split_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.get(F.array(*map(F.lit, ("Train", "VALIDATION", " val", "test", "autre"))), F.col("doc_id") % 5)
    counts = files.write_splits(table(spark, sf_dir, "documents").select("doc_id", raw.alias("split")), files.scratch(spark))
    return spark.createDataFrame([(k, v) for k, v in counts.items() if v], "split string, n long")


@query("SELECT conv_id::VARCHAR AS identifiant, '<|im_start|>user' || chr(10) || text || '<|im_end|>' || chr(10) AS texte FROM conversations WHERE turn = 0 AND conv_id % 2 = 0")
def formatted_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Formatted rows in a table, and those of a split and type taken from it."""
    path = files.scratch(spark)
    first = table(spark, sf_dir, "conversations").filter("turn = 0").select(F.col("conv_id").cast("string").alias("identifiant"), F.array(F.struct(F.lit("user").alias("role"), F.col("text").alias("contenu"))).alias("m"))
    rows = first.select("identifiant", chat.render(F.col("m")).alias("texte"), chat.bounds(F.col("m")).alias("tours"))
    files.append(rows, path)
    pivot = first.select("identifiant", F.when(F.col("identifiant").cast("long") % 2 == 0, "train").otherwise("val").alias("split"), F.lit("sft").alias("type_exemple"))
    return chat.members(files.read_table(spark, path, schemas.FORMATTED), pivot, "train", "sft").select("identifiant", "texte")


@query("SELECT substr(sha256((CASE WHEN doc_id % 2 = 0 THEN 'dpo:' ELSE '' END) || 'm' || doc_id || ':t'), 1, 16) AS identifiant, CASE WHEN doc_id % 2 = 0 THEN 'dpo' ELSE 'sft' END AS kind, CASE WHEN doc_id % 2 = 0 THEN 0.1 END::DOUBLE AS beta FROM labels")
def checkpoint_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Checkpoints of both kinds, saved twice; ids tell them apart."""
    path, lab = files.scratch(spark), table(spark, sf_dir, "labels").withColumn("model", F.concat(F.lit("m"), "doc_id"))
    dpo = F.col("doc_id") % 2 == 0
    ids = F.when(dpo, tx.checkpoint_id(F.col("model"), F.lit("t"), True)).otherwise(tx.checkpoint_id(F.col("model"), F.lit("t")))
    h = F.struct(F.lit(2e-4).alias("taux_apprentissage"), F.lit(16).alias("rang_lora"), F.lit(3).alias("nombre_epoques"), F.when(dpo, 0.1).alias("beta"))
    rows = lab.select(ids.alias("identifiant"), F.col("model").alias("modele"), F.lit("t").alias("horodatage"), F.lit("saine").alias("verdict"), h.alias("hyperparametres"))
    files.save_checkpoints(spark, path, rows)
    files.save_checkpoints(spark, path, rows)
    return files.read_checkpoints(spark, path).select("identifiant", "kind", "hyperparametres.beta")


@query("SELECT doc_id::VARCHAR AS identifiant FROM documents WHERE split_part(text, chr(10), -1) IS NOT NULL AND doc_id % 2 = 0")
def complete_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the pivot table, written, decoded and complete; every other one has no completion."""
    path = files.scratch(spark)
    rows = _pivot_docs(spark, sf_dir).filter("symptomes is not null").withColumn("completion", F.when(F.col("identifiant").cast("long") % 2 == 0, F.col("completion")))
    files.append(rows, path)
    return schemas.decoded(files.read_table(spark, path, schemas.PIVOT)).filter(schemas.complete()).select("identifiant")


@query("SELECT 'run' AS run, 10 * (row_number() OVER (ORDER BY user_id)) - 10 AS ord, 'user ' || user_id AS line FROM (SELECT DISTINCT user_id FROM events)")
def text_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log file of ten lines a user, of which the first names the user."""
    path = files.scratch(spark)
    users = table(spark, sf_dir, "events").select("user_id").distinct().orderBy("user_id")
    text = users.agg(F.array_join(F.transform(F.array_sort(F.collect_list("user_id")), lambda u: F.concat(F.lit("user "), u, F.repeat(F.lit("\n-"), F.lit(9)))), "\n").alias("value"))
    text.coalesce(1).write.text(f"{path}/run.log")
    lines = log_replay.read_log(spark, f"{path}/run.log").withColumn("run", F.lit("run")).filter("line like 'user%'")
    return lines.select("run", F.col("ord").cast("long").alias("ord"), "line")


@query("SELECT doc_id::VARCHAR AS identifiant, 'vu' AS type_evenement FROM labels UNION ALL SELECT doc_id::VARCHAR, 'revu' FROM labels WHERE toxic = 1")
def audit_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events that come in two files, appended to a log by a stream that is started twice."""
    path, lab = files.scratch(spark), table(spark, sf_dir, "labels")
    event = lambda d, kind: d.select(F.lit("t").alias("horodatage"), F.lit(kind).alias("type_evenement"), F.col("doc_id").cast("string").alias("identifiant"))
    for rows in (event(lab, "vu"), event(lab.filter("toxic = 1"), "revu")):
        files.append(rows, f"{path}/in")
        stream = spark.readStream.schema(schemas.AUDIT).json(f"{path}/in")
        logs.append_audit(stream, f"{path}/log", f"{path}/checkpoint").awaitTermination()
    return spark.read.schema(schemas.AUDIT).json(f"{path}/log").select("identifiant", "type_evenement")


def _requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").filter("turn = 0")
    return c.select(F.col("conv_id").cast("string").alias("identifiant"), F.array(F.struct("role", F.col("text").alias("contenu"))).alias("messages"))


def _count_words(messages: list[dict], parameters: dict) -> dict:
    """An engine for tests: it counts words and fails on what it is told to."""
    n = len(messages[-1]["content"].split(" "))
    if n % parameters["fails_at"] == 0:
        raise ValueError(f"{n} words")
    return {"texte": f"{n} words", "nombre_tokens_sortie": 2}


_COUNTED = "w AS (SELECT conv_id::VARCHAR AS identifiant, text, len(string_split(text, ' ')) AS n FROM conversations WHERE turn = 0)"


@query(f"WITH {_COUNTED} SELECT identifiant, CASE WHEN n % 3 <> 0 THEN n || ' words' END AS texte, CASE WHEN n % 3 = 0 THEN 'ValueError' END AS type_erreur FROM w")
def model_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inference.answered(_requests(spark, sf_dir), _count_words, {"fails_at": 3}).select("identifiant", "texte", "type_erreur")


@query(f"WITH {_COUNTED} SELECT identifiant AS conversation_id, CASE WHEN n % 3 = 0 THEN 'echec_inference' ELSE 'tour_entretien' END AS type_evenement, text AS entree, CASE WHEN n % 3 <> 0 THEN n || ' words' ELSE '' END AS sortie, 't0' AS horodatage, CASE WHEN n % 3 = 0 THEN 'ValueError' END AS type_erreur FROM w")
def audit_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of all answers, failed ones too: they are in the log before the failure is raised."""
    path = files.scratch(spark)
    answers = inference.answered(_requests(spark, sf_dir), _count_words, {"fails_at": 3})
    answers.write.parquet(f"{path}/answers")
    try:
        inference.settled(spark.read.parquet(f"{path}/answers"), f"{path}/log", "tour_entretien", "m", clock=lambda: F.lit("t0"))
    except inference.InferenceFailure:
        pass  # what the log is read for
    return inference.logged(spark, f"{path}/log").select("conversation_id", "type_evenement", "entree", "sortie", "horodatage", F.try_element_at("metadonnees", F.lit("type_erreur")).alias("type_erreur"))


@query("SELECT conv_id::VARCHAR AS conversation_id, turn::BIGINT AS ord, text AS contenu, NULL::VARCHAR AS erreur FROM conversations WHERE conv_id % 3 <> 0 AND turn > 0 UNION ALL SELECT conv_id::VARCHAR, NULL, text, 'unknown conversation' FROM conversations WHERE conv_id % 3 = 0 AND turn > 0")
def conversation_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Later turns are appended to conversations that hold the first; every third conversation was never created."""
    c = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string").alias("conversation_id"), F.col("turn").cast("int").alias("ord"), "role", F.col("text").alias("contenu"), "conv_id")
    turns = c.filter("conv_id % 3 <> 0 and ord = 0").drop("conv_id")
    fresh, unknown = inference.appended(turns.select("conversation_id"), turns, c.filter("ord > 0").drop("conv_id"))
    rows = fresh.select("conversation_id", F.col("ord").cast("long").alias("ord"), "contenu", F.lit(None).cast("string").alias("erreur"))
    return rows.union(unknown.select("conversation_id", F.lit(None).cast("long"), "contenu", "erreur"))


@query("SELECT doc_id, 'new' AS kind FROM labels WHERE doc_id % 3 = 0 UNION ALL SELECT doc_id, 'q' || quality FROM labels WHERE doc_id % 3 <> 0 UNION ALL SELECT -doc_id - 1, 'new' FROM labels WHERE doc_id % 3 = 0")
def bucketed_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table in buckets that is merged twice, the second time by a batch that comes again."""
    path, lab = files.scratch(spark), table(spark, sf_dir, "labels")
    row = lambda d, key, kind, day: d.select(key.alias("doc_id"), kind.alias("kind"), F.lit(day).alias("jour"))
    versions.upsert(row(lab, F.col("doc_id"), F.concat(F.lit("q"), "quality"), 1), path, key="doc_id", order="jour", buckets=16)
    third = lab.filter("doc_id % 3 = 0")
    for _ in range(2):
        new = row(third, F.col("doc_id"), F.lit("old"), 2).union(row(third, F.col("doc_id"), F.lit("new"), 3)).union(row(third, -F.col("doc_id") - 1, F.lit("new"), 3))
        versions.upsert(new, path, key="doc_id", order="jour", writer="second", batch=0)
    return versions.read(spark, path, "doc_id long, kind string, jour int").select("doc_id", "kind")


@query("SELECT doc_id::VARCHAR AS identifiant, count(*) AS n FROM documents GROUP BY 1")
def resumed_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents worked off by a stream that is started three times, once anew, with ids that come again."""
    path, d = files.scratch(spark), table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("identifiant"))
    for k, rows in enumerate((d.filter("identifiant % 3 = 0"), d, d.filter("identifiant % 2 = 0"))):
        rows.write.mode("append").parquet(f"{path}/in")
        stream = spark.readStream.schema("identifiant string").parquet(f"{path}/in")
        logs.resume_once(stream, f"{path}/out", "identifiant string", lambda b: b, f"{path}/checkpoint-{k // 2}", buckets=8).awaitTermination()
    return versions.read(spark, f"{path}/out", "identifiant string").groupBy("identifiant").agg(F.count("*").alias("n"))


@query(f"WITH {_VERDICTS}, v AS (SELECT run, count(perte_validation) > 0 AS hv FROM c GROUP BY 1) SELECT r.run::VARCHAR AS run, CASE WHEN n >= 2 THEN verdict END AS verdict, CASE WHEN coalesce(n, 0) < 2 THEN 'pas assez de points complets' WHEN NOT hv THEN 'sans perte de validation' ELSE '' END AS message FROM (SELECT DISTINCT run FROM w) r LEFT JOIN e ON e.run = r.run LEFT JOIN v ON v.run = r.run")
def streamed_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts of all runs, kept by a stream with a small state a run over metric files that come in two parts."""
    path = files.scratch(spark)
    points = _points(spark, sf_dir).select(F.col("run").cast("string").alias("run"), F.col("etape").cast("int").alias("etape"), "nom", F.col("valeur").cast("double").alias("valeur"), F.col("ord").cast("double").alias("horodatage"))
    first = points.agg(F.percentile_approx("etape", 0.5)).scalar()
    for part in (points.filter(F.col("etape") <= first), points.filter(F.col("etape") > first)):
        files.append(part.repartition(1).sortWithinPartitions("run", "etape", "horodatage"), f"{path}/in")
        runs.watch_runs(spark, f"{path}/in", f"{path}/verdicts", f"{path}/checkpoint").awaitTermination()
    return versions.read(spark, f"{path}/verdicts", runs.VERDICTS).select("run", "verdict", "message")


_CHATML = "'<|im_start|>{r}' || chr(10) || {t} || '<|im_end|>' || chr(10)"


@query(f"""WITH {_TURNS} SELECT id AS identifiant, {_CHATML.format(r='user', t='question')} || '<|im_start|>assistant' || chr(10) AS prompt,
  {_CHATML.format(r='assistant', t="CASE WHEN conv_id % 3 = 0 THEN 'Mieux : ' || answer ELSE answer END")} AS chosen, {_CHATML.format(r='assistant', t='reverse(question)')} AS rejected FROM t""")
def preference_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Preference triplets written to their table and read again; of a third the chosen answer comes from the table of reformulated ones, whose last entry counts."""
    path, t = files.scratch(spark), _turns(spark, sf_dir)
    said = lambda role, text: F.array(F.struct(F.lit(role).alias("role"), text.alias("contenu")))
    given = {"identifiant": F.col("id"), "source": F.lit("s"), "type_exemple": F.lit("dpo"), "langue": F.lit("fr"), "prompt": said("user", F.col("question")), "chosen": said("assistant", F.col("answer")), "rejected": said("assistant", F.reverse("question"))}
    pivot = t.select(*[given.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in schemas.PIVOT.fields])
    new = t.filter("conv_id % 3 = 0")
    for day, text in (("2024-01-02", F.concat(F.lit("Mieux : "), "answer")), ("2024-01-01", F.lit("vieux"))):
        files.append(new.select(F.col("id").alias("identifiant"), said("assistant", text).alias("chosen"), F.lit(day).alias("horodatage")), f"{path}/reformulated")
    reformulated = files.reformulated(spark, f"{path}/reformulated")
    files.save_preferences(spark, f"{path}/preferences", chat.triplets(pivot, reformulated))
    return files.preferences(spark, f"{path}/preferences")


@query("SELECT doc_id // 500 AS run, (row_number() OVER (PARTITION BY doc_id // 500 ORDER BY doc_id) * 2 - 2)::BIGINT AS ord, 'doc ' || doc_id AS line FROM documents UNION ALL SELECT doc_id // 500, (row_number() OVER (PARTITION BY doc_id // 500 ORDER BY doc_id) * 2 - 1)::BIGINT, 'lang ' || doc_id || ' ' || lang FROM documents")
def numbered_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ordinals of the lines of logs, one for every 500 documents, each a file that is read in ranges of bytes."""
    path, d = files.scratch(spark), table(spark, sf_dir, "documents").withColumn("log", F.floor(F.col("doc_id") / 500))
    lines = d.repartition("log").sortWithinPartitions("log", "doc_id").select("log", F.concat(F.lit("doc "), "doc_id", F.lit("\r\nlang "), "doc_id", F.lit(" "), "lang").alias("value"))
    lines.write.partitionBy("log").text(path)
    rows = log_replay.read_log(spark, path)
    return rows.select(F.floor(F.regexp_extract("line", " ([0-9]+)", 1).cast("long") / 500).alias("run"), F.col("ord").cast("long").alias("ord"), "line")
