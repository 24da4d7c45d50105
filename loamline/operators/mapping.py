"""Raw corpora of different schemas as rows of the pivot schema. Incomplete rows are dropped."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loamline.functions.text import ID_PREFIX, content_id, first_truthy, strip
from loamline.schemas import MESSAGES, PIVOT

LETTERS = "abcde"


def column(df: DataFrame, name: str, kind: str = "string") -> Column:
    """The column, or null where a corpus lacks it."""
    return F.col(f"`{name}`").cast(kind) if name in df.columns else F.lit(None).cast(kind)


def message(role: str, text: Column) -> Column:
    return F.array(F.struct(F.lit(role).alias("role"), text.alias("contenu"))).cast(MESSAGES)


def _pivot(df: DataFrame, **given: Column) -> DataFrame:
    empty = F.array().cast(MESSAGES)
    plain = {"symptomes": F.lit(""), "niveau_confiance": F.lit("moyenne"), "anonymise": F.lit(False), **dict.fromkeys(("prompt", "completion", "chosen", "rejected"), empty)}
    return df.select(*[F.coalesce(given[f.name], F.lit(None)).cast(f.dataType).alias(f.name) if f.name in given else plain.get(f.name, F.lit(None).cast(f.dataType)).alias(f.name) for f in PIVOT.fields], *[c for c in ("ord",) if c in df.columns])


def _id_text(df: DataFrame) -> Column:
    """The raw id as text; a missing one is spelled None."""
    return F.coalesce(column(df, "id"), F.lit("None"))


def open_questions(df: DataFrame, namespace: str = "mediqal_oeq", source: str = "MediQAl", lang: str = "fr", prefix: str = ID_PREFIX) -> DataFrame:
    question, answer = first_truthy(column(df, "question"), column(df, "query")), first_truthy(column(df, "answer"), column(df, "reponse"))
    key = _id_text(df)
    rows = df.filter(question.isNotNull() & answer.isNotNull())
    return _pivot(rows, identifiant=content_id(F.lit(namespace), key, prefix), identifiant_source_brute=key, source=F.lit(source), type_exemple=F.lit("sft"), langue=F.lit(lang), symptomes=question, prompt=message("user", question), completion=message("assistant", answer))


def multiple_choice(df: DataFrame, source: str = "MediQAl", lang: str = "fr", prefix: str = ID_PREFIX) -> DataFrame:
    """Answers named by letters, joined with a space; a case goes before the question."""
    question, case = first_truthy(column(df, "question")), first_truthy(column(df, "clinical_case"))
    asked = F.when(case.isNotNull(), F.concat(case, F.lit("\n\n"), question)).otherwise(question)
    letters = F.filter(F.transform(F.split(column(df, "correct_answers"), ","), lambda c: F.lower(strip(c))), lambda c: c != "")
    options = F.create_map(*[x for c in LETTERS for x in (F.lit(c), F.coalesce(column(df, f"answer_{c}"), F.lit("")))])
    chosen = F.filter(F.transform(letters, lambda c: F.try_element_at(options, c)), lambda a: a.isNotNull() & (a != ""))
    answer = F.array_join(chosen, " ")
    namespace = F.when(column(df, "task") == "QCU", "mediqal_mcqu").otherwise("mediqal_mcqm")
    key = _id_text(df)
    rows = df.filter(question.isNotNull() & (F.size(chosen) > 0))
    return _pivot(rows, identifiant=content_id(namespace, key, prefix), identifiant_source_brute=key, source=F.lit(source), type_exemple=F.lit("sft"), langue=F.lit(lang), symptomes=F.coalesce(case, question), prompt=message("user", asked), completion=message("assistant", answer), niveau_confiance=F.lit("haute"))


def indexed_choice(df: DataFrame, namespace: str = "frenchmedmcqa", source: str = "FrenchMedMCQA", lang: str = "fr", prefix: str = ID_PREFIX) -> DataFrame:
    """The answer is the option of a 0-based index; text counts only as a whole number, numbers are truncated."""
    question = first_truthy(column(df, "question"))
    raw = F.col("correct_answers") if "correct_answers" in df.columns else F.lit(None).cast("string")
    textual = "correct_answers" in df.columns and isinstance(df.schema["correct_answers"].dataType, T.StringType)
    index = F.when(strip(raw).rlike(r"^[+-]?[0-9]+$"), strip(raw).try_cast("int")) if textual else raw.cast("int")
    options = F.array(*[column(df, f"answer_{c}") for c in LETTERS])
    answer = F.nullif(F.when((index >= 0) & (index < len(LETTERS)), F.try_element_at(options, index + 1)), F.lit(""))
    key = _id_text(df)
    rows = df.filter(question.isNotNull() & answer.isNotNull())
    return _pivot(rows, identifiant=content_id(F.lit(namespace), key, prefix), identifiant_source_brute=key, source=F.lit(source), type_exemple=F.lit("sft"), langue=F.lit(lang), prompt=message("user", question), completion=message("assistant", answer), niveau_confiance=F.lit("haute"))


def question_answer(df: DataFrame, namespace: str = "medquad", source: str = "MedQuAD", lang: str = "en", prefix: str = ID_PREFIX) -> DataFrame:
    """Rows without an id: the hash of question||answer stands for it."""
    question, answer = first_truthy(column(df, "Question"), column(df, "question")), first_truthy(column(df, "Answer"), column(df, "answer"))
    key = F.sha2(F.concat(question, F.lit("||"), answer), 256)
    rows = df.filter(question.isNotNull() & answer.isNotNull())
    return _pivot(rows, identifiant=content_id(F.lit(namespace), key, prefix), identifiant_source_brute=key, source=F.lit(source), type_exemple=F.lit("sft"), langue=F.lit(lang), symptomes=question, prompt=message("user", question), completion=message("assistant", answer))


def last_message(df: DataFrame, name: str) -> Column:
    """The content of the last of a list of messages, or the text itself."""
    if name in df.columns and isinstance(df.schema[name].dataType, T.ArrayType):
        return F.get(F.col(name), F.size(F.col(name)) - 1)["content"]
    return column(df, name)


def preferences(df: DataFrame, namespace: str = "ultramedical", source: str = "UltraMedical-Preference", lang: str = "en", prefix: str = ID_PREFIX) -> DataFrame:
    prompt = first_truthy(column(df, "prompt"), column(df, "instruction"))
    chosen, rejected = first_truthy(last_message(df, "chosen")), first_truthy(last_message(df, "rejected"))
    key = F.concat_ws("|", *[F.coalesce(c, F.lit("")) for c in (column(df, "prompt_id"), column(df, "label_type"), chosen, rejected)])
    rows = df.filter(prompt.isNotNull() & chosen.isNotNull() & rejected.isNotNull())
    return _pivot(rows, identifiant=content_id(F.lit(namespace), key, prefix), identifiant_source_brute=column(df, "prompt_id"), source=F.lit(source), type_exemple=F.lit("dpo"), langue=F.lit(lang), prompt=message("user", prompt), chosen=message("assistant", chosen), rejected=message("assistant", rejected))


#: By corpus name; any function of a DataFrame can be added.
MAPPERS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "mediqal_oeq": open_questions,
    "mediqal_mcqu": multiple_choice,
    "mediqal_mcqm": multiple_choice,
    "frenchmedmcqa": indexed_choice,
    "medquad": question_answer,
    "ultramedical": preferences,
    "ultramedical_preference": preferences,
}


def mapped(df: DataFrame, corpus: str, **options: str) -> DataFrame:
    """Rows of a corpus by its name; options (source, lang, prefix of ids) go to its mapper."""
    if corpus not in MAPPERS:
        raise ValueError(f"unknown corpus: {corpus}")
    return MAPPERS[corpus](df, **options)


def text_pairs(original: DataFrame, masked: DataFrame) -> DataFrame:
    """Each free-text field of rows that both tables have: identifiant, source, langue, champ_ord, champ, original, masque.

    symptomes always, antecedents if the original has any, the messages of prompt,
    completion, chosen and rejected up to the shorter list.
    """
    o = original.select("identifiant", "source", "langue", F.struct("symptomes", "antecedents", "prompt", "completion", "chosen", "rejected").alias("o"))
    both = o.join(masked.select("identifiant", F.struct("symptomes", "antecedents", "prompt", "completion", "chosen", "rejected").alias("m")), "identifiant")
    pair = lambda name, a, b: F.struct(name.alias("champ"), a.alias("original"), b.alias("masque"))

    def messages(field: str) -> Column:
        n = F.least(F.size(F.coalesce(f"o.{field}", F.array().cast(MESSAGES))), F.size(F.coalesce(f"m.{field}", F.array().cast(MESSAGES))))
        places = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(places, lambda i: pair(F.concat(F.lit(field + "["), i.cast("string"), F.lit("]")), F.get(F.col(f"o.{field}"), i)["contenu"], F.get(F.col(f"m.{field}"), i)["contenu"]))

    history = F.when(F.coalesce("o.antecedents", F.lit("")) != "", F.array(pair(F.lit("antecedents"), F.col("o.antecedents"), F.col("m.antecedents"))))
    fields = F.concat(F.array(pair(F.lit("symptomes"), F.col("o.symptomes"), F.col("m.symptomes"))), F.coalesce(history, F.slice(F.array(pair(F.lit("antecedents"), F.col("o.antecedents"), F.col("m.antecedents"))), 1, 0)), *[messages(f) for f in ("prompt", "completion", "chosen", "rejected")])
    return both.select("identifiant", "source", "langue", F.posexplode(fields).alias("champ_ord", "p")).select("identifiant", "source", "langue", "champ_ord", "p.*")


def first_filled(pairs: DataFrame) -> DataFrame:
    """The first field of each row whose original is not empty."""
    return pairs.filter(F.coalesce("original", F.lit("")) != "").groupBy("identifiant").agg(F.min_by(F.struct("champ", "original", "masque"), "champ_ord").alias("p")).select("identifiant", "p.*")


def field_pair(pairs: DataFrame, name: str) -> DataFrame:
    return pairs.filter(F.col("champ") == name)


def completion_text(completion: Column) -> Column:
    return F.array_join(F.transform(completion, lambda m: m["contenu"]), "\n")
