"""Requests to a model, their answers and audit events, and the conversations they belong to.

No model is at hand: an engine is any function of a list of messages and a dict of
parameters. Requests are dealt over tasks and answered in batches.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loamline.functions.clock import Clock, now
from loamline.schemas import AUDIT_EVENT, MESSAGES
from loamline.sources import versions
from loamline.sources.files import append

#: (messages, parameters) -> dict of texte and, if known, nombre_tokens_entree, nombre_tokens_sortie and latence_ms.
Engine = Callable[[list[dict], dict], dict]
RESPONSE = T.StructType([T.StructField("texte", T.StringType()), T.StructField("nombre_tokens_entree", T.IntegerType()), T.StructField("nombre_tokens_sortie", T.IntegerType()), T.StructField("latence_ms", T.DoubleType()), T.StructField("type_erreur", T.StringType()), T.StructField("erreur", T.StringType())])


class InferenceFailure(RuntimeError):
    """Some requests had no answer; their audit events are written."""


def _one(engine: Engine, messages, parameters: dict) -> tuple:
    try:
        r = engine([{"role": m["role"], "content": m["contenu"]} for m in messages], parameters)
        return r["texte"], int(r.get("nombre_tokens_entree", 0)), int(r.get("nombre_tokens_sortie", 0)), float(r.get("latence_ms", 0.0)), None, None
    except Exception as e:  # a malformed response is a failure as well
        return None, None, None, None, type(e).__name__, str(e)


def answered(requests: DataFrame, engine: Engine, parameters: dict | None = None, key: str = "identifiant") -> DataFrame:
    """key, messages and the engine's response (RESPONSE) to each row's messages; a failed request has its error and no text."""
    given = dict(parameters or {})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = pd.DataFrame([_one(engine, m, given) for m in batch["messages"]], columns=RESPONSE.names, index=batch.index)
            yield pd.concat([batch, out.astype({"nombre_tokens_entree": "Int32", "nombre_tokens_sortie": "Int32"})], axis=1)

    rows = requests.select(key, F.col("messages").cast(MESSAGES).alias("messages"))
    return rows.mapInPandas(run, T.StructType([*rows.schema.fields, *RESPONSE.fields]))


def answered_from(requests: DataFrame, table: DataFrame, key: str = "identifiant") -> DataFrame:
    """The same from a table of answers (key, texte): a request without one has failed."""
    rows = requests.select(key, "messages").join(table.select(key, "texte"), key, "left")
    missing = F.col("texte").isNull()
    return rows.select(key, "messages", "texte", F.lit(0).alias("nombre_tokens_entree"), F.lit(0).alias("nombre_tokens_sortie"), F.lit(0.0).alias("latence_ms"), F.when(missing, "KeyError").alias("type_erreur"), F.when(missing, "no answer").alias("erreur"))


def audit_events(answers: DataFrame, kind: str, model: str, clock: Clock = now, key: str = "identifiant") -> DataFrame:
    """An event for each answer: of the kind given, or echec_inference with the error and the kind it came from."""
    failed = F.col("type_erreur").isNotNull()
    pair = lambda k, v: F.struct(F.lit(k).alias("key"), v.cast("string").alias("value"))
    why = F.array(pair("type_evenement_origine", F.lit(kind)), pair("type_erreur", F.col("type_erreur")), pair("erreur", F.col("erreur")))
    how = F.array(pair("latence_ms", F.col("latence_ms")), pair("nombre_tokens_sortie", F.col("nombre_tokens_sortie")))
    asked = F.coalesce(F.get("messages", F.size("messages") - 1)["contenu"], F.lit(""))
    return answers.select(clock().alias("horodatage"), F.when(failed, "echec_inference").otherwise(kind).alias("type_evenement"), F.col(key).cast("string").alias("conversation_id"), asked.alias("entree"), F.coalesce("texte", F.lit("")).alias("sortie"), F.lit(model).alias("version_modele"), F.map_from_entries(F.when(failed, why).otherwise(how)).alias("metadonnees"))


def settled(answers: DataFrame, path: str, kind: str, model: str, clock: Clock = now, key: str = "identifiant", wave: str | None = None) -> DataFrame:
    """The answers, once their events are in the audit log at ``path``; an error after that if any failed.

    ``answers`` is read more than once: give a written table. With a name for the ``wave``, the log is a
    table of ``versions``, in which the events of a wave that is tried again are there once.
    """
    events = audit_events(answers, kind, model, clock, key)
    if wave is None:
        append(events, path)
    else:
        versions.append(events, path, writer=wave, batch=0)
    failures = answers.filter("type_erreur is not null").count()
    if failures:
        raise InferenceFailure(f"{failures} requests failed")
    return answers


def logged(spark, path: str) -> DataFrame:
    """The audit log."""
    version = versions.current(spark, path)
    return versions.read(spark, path, AUDIT_EVENT, version) if version.number >= 0 else spark.read.schema(AUDIT_EVENT).json(path)


# conversations


def created(new: DataFrame) -> DataFrame:
    """A conversation without turns for each row: conversation_id (a random name)."""
    return new.select(F.expr("uuid()").alias("conversation_id"))


def history(turns: DataFrame, conversation_id: str) -> DataFrame:
    """The turns (ord, role, contenu) of one conversation, in order."""
    return turns.filter(F.col("conversation_id") == conversation_id).select("ord", "role", "contenu").orderBy("ord")


def appended(heads: DataFrame, turns: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """New messages (conversation_id, ord, role, contenu) after the turns there are, and those of unknown conversations with an error.

    ``ord`` of new messages gives their order; it goes on from the last turn. Only the last
    place of each conversation is looked up.
    """
    known = heads.select("conversation_id").distinct()
    last = turns.groupBy("conversation_id").agg((F.max("ord") + 1).alias("next"))
    place = F.row_number().over(Window.partitionBy("conversation_id").orderBy("ord")) - 1
    fresh = new.join(known, "conversation_id", "left_semi").withColumn("ord", place).join(last, "conversation_id", "left")
    fresh = fresh.select("conversation_id", (F.col("ord") + F.coalesce("next", F.lit(0))).cast("int").alias("ord"), "role", "contenu")
    unknown = new.join(known, "conversation_id", "left_anti").select("conversation_id", "role", "contenu", F.lit("unknown conversation").alias("erreur"))
    return fresh, unknown
