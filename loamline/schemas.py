"""Schemas of the tables and their checks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MESSAGES = T.ArrayType(T.StructType([T.StructField("role", T.StringType()), T.StructField("contenu", T.StringType())]))

PIVOT = T.StructType([
    T.StructField("identifiant", T.StringType(), False),
    T.StructField("identifiant_source_brute", T.StringType()),
    T.StructField("source", T.StringType(), False),
    T.StructField("type_exemple", T.StringType(), False),
    T.StructField("langue", T.StringType(), False),
    T.StructField("symptomes", T.StringType()),
    T.StructField("antecedents", T.StringType()),
    T.StructField("constantes_vitales", T.StructType([
        T.StructField("pression_arterielle", T.StringType()),
        T.StructField("frequence_cardiaque", T.IntegerType()),
        T.StructField("saturation_o2", T.IntegerType()),
        T.StructField("frequence_respiratoire", T.IntegerType()),
    ])),
    T.StructField("prompt", MESSAGES),
    T.StructField("completion", MESSAGES),
    T.StructField("chosen", MESSAGES),
    T.StructField("rejected", MESSAGES),
    T.StructField("niveau_confiance", T.StringType()),
    T.StructField("anonymise", T.BooleanType()),
    T.StructField("split", T.StringType()),
])

TURNS = T.ArrayType(T.StructType([T.StructField("role", T.StringType()), T.StructField("debut", T.IntegerType()), T.StructField("fin", T.IntegerType())]))
FORMATTED = T.StructType([T.StructField("identifiant", T.StringType(), False), T.StructField("texte", T.StringType()), T.StructField("tours", TURNS)])
PREFERENCE = T.StructType([T.StructField(c, T.StringType()) for c in ("identifiant", "prompt", "chosen", "rejected")])
REFORMULATED = T.StructType([T.StructField("identifiant", T.StringType(), False), T.StructField("chosen", MESSAGES), T.StructField("horodatage", T.StringType())])
DECISION_KEY = ["liste", "identifiant", "champ", "type_motif", "debut", "fin"]
DECISION = T.StructType([*(T.StructField(c, T.StringType()) for c in DECISION_KEY[:4]), T.StructField("debut", T.IntegerType()), T.StructField("fin", T.IntegerType()), T.StructField("decision", T.StringType()), T.StructField("horodatage", T.StringType())])
REGISTRY = T.StructType([T.StructField(c, T.StringType()) for c in ("identifiant", "strate", "horodatage")])
METRIC = T.StructType([T.StructField("etape", T.IntegerType()), T.StructField("nom", T.StringType()), T.StructField("valeur", T.DoubleType()), T.StructField("horodatage", T.DoubleType())])
AUDIT = T.StructType([*(T.StructField(c, T.StringType()) for c in ("horodatage", "type_evenement", "identifiant")), T.StructField("metadonnees", T.MapType(T.StringType(), T.StringType()))])
AUDIT_EVENT = T.StructType([*(T.StructField(c, T.StringType()) for c in ("horodatage", "type_evenement", "conversation_id", "entree", "sortie", "version_modele")), T.StructField("metadonnees", T.MapType(T.StringType(), T.StringType()))])
CHECKPOINT = T.StructType([T.StructField(c, T.StringType()) for c in ("identifiant", "modele", "horodatage", "verdict")] + [T.StructField("hyperparametres", T.StructType([T.StructField("taux_apprentissage", T.DoubleType()), T.StructField("rang_lora", T.IntegerType()), T.StructField("nombre_epoques", T.IntegerType()), T.StructField("beta", T.DoubleType())]))])

#: The members of the enumerations.
ENUMS = {
    "langue": ("fr", "en"),
    "type_exemple": ("sft", "dpo"),
    "niveau_confiance": ("haute", "moyenne", "basse"),
    "split": ("train", "val", "test"),
    "verdict": ("saine", "surapprentissage", "sous_apprentissage", "instable"),
}


def decoded(df: DataFrame) -> DataFrame:
    """Rows read with PIVOT, with defaults for what may be missing; mandatory columns and enums are checked as rows are read."""
    empty = F.array().cast(MESSAGES)
    out = df.withColumns({
        "symptomes": F.coalesce("symptomes", F.lit("")),
        "niveau_confiance": F.coalesce("niveau_confiance", F.lit("moyenne")),
        "anonymise": F.coalesce("anonymise", F.lit(False)),
        **{c: F.coalesce(c, empty) for c in ("prompt", "completion", "chosen", "rejected")},
    })
    for c in ("identifiant", "source", "type_exemple", "langue"):
        out = out.withColumn(c, F.when(F.col(c).isNull(), F.raise_error(F.lit(f"{c} is missing"))).otherwise(F.col(c)))
    for c in ("type_exemple", "langue", "niveau_confiance", "split"):
        known = F.col(c).isNull() | F.col(c).isin(*ENUMS[c])
        out = out.withColumn(c, F.when(~known, F.raise_error(F.concat(F.lit(f"unknown {c}: "), F.col(c)))).otherwise(F.col(c)))
    return out


def complete() -> Column:
    """SFT rows have a prompt and a completion, DPO rows a prompt and both sides."""
    has = lambda *cols: reduce(lambda a, b: a & b, [F.size(c) > 0 for c in cols])
    return F.when(F.col("type_exemple") == "sft", has("prompt", "completion")).when(F.col("type_exemple") == "dpo", has("prompt", "chosen", "rejected")).otherwise(False)


def with_kind(checkpoints: DataFrame) -> DataFrame:
    """Checkpoints of the union: a beta makes it dpo, else sft."""
    return checkpoints.withColumn("kind", F.when(F.col("hyperparametres.beta").isNotNull(), "dpo").otherwise("sft"))
