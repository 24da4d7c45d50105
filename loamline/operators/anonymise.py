"""Masking of personal data by rules, its counts and the cumulative report."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loamline.functions import text as tx
from loamline.operators.entities import Recogniser, as_spans
from loamline.schemas import MESSAGES

#: A masker takes (text, language) and returns struct(masked, spans); any other one, say of a model, can be passed in.
Masker = Callable[[Column, Column], Column]


def masking(text: Column, found: Callable[[Column], Column], strategy: str = "replace", token: str = tx.MASK) -> Column:
    """struct(masked, spans) of a text by the spans that ``found`` sees in it; both are computed once. A null text stays null."""
    result = lambda t, spans: F.struct(F.when(text.isNotNull(), tx.with_spans_masked(t, spans, strategy, token)).alias("masked"), spans.alias("spans"))
    return tx.bound(text, lambda t: tx.bound(found(F.coalesce(t, F.lit(""))), lambda spans: result(t, spans)))


def rules(strategy: str = "replace", token: str = tx.MASK) -> Masker:
    """Ages become brackets first; then national ids with right check digits, e-mails, urls, phone numbers and dates are masked.

    With a third argument, spans of names, those are masked too; they are places in a
    text whose ages are brackets already.
    """

    def apply(text: Column, lang: Column, names: Column | None = None) -> Column:
        def found(plain: Column) -> Column:
            ids = F.when(lang == "fr", F.filter(tx.spans(plain, "nir", tx.NIR), lambda s: tx.valid_nir(s["found"]))).otherwise(F.array().cast(tx.SPAN))
            more = [] if names is None else [F.coalesce(names, F.array().cast(tx.SPAN))]
            return F.concat(ids, tx.pii_spans(plain, ("email", "url", "telephone", "date")), *more)

        return masking(tx.age_brackets(text, lang) if names is None else text, found, strategy, token)

    return apply


def _kinds(spans: Column) -> Column:
    return F.transform(spans, lambda s: s["kind"])


#: The free-text fields of pivot rows, and those that are lists of messages.
TEXTS, LISTS = ("symptomes", "antecedents"), ("prompt", "completion", "chosen", "rejected")


def field_texts() -> Column:
    """All free texts of a pivot row as one array: the fields, then the messages of each list in order."""
    none = F.array().cast(MESSAGES)
    return F.concat(F.array(*TEXTS), *[F.transform(F.coalesce(c, none), lambda m: m["contenu"]) for c in LISTS])


def with_field_texts(texts: Column) -> dict[str, Column]:
    """The fields of a pivot row with the texts of an array in the order of ``field_texts`` in place of theirs."""
    out = {c: F.get(texts, F.lit(i)) for i, c in enumerate(TEXTS)}
    at = F.lit(len(TEXTS))
    for c in LISTS:
        n = F.coalesce(F.size(c), F.lit(0))
        out[c] = F.zip_with(c, F.slice(texts, at + 1, n), lambda m, t: F.struct(m["role"].alias("role"), t.alias("contenu")))
        at = at + n
    return out


def anonymised(df: DataFrame, masker: Masker | None = None, recogniser: Recogniser | None = None) -> DataFrame:
    """Pivot rows with all free-text fields masked, anonymise = true, and kinds (array of the kinds of all spans).

    With a recogniser, names of people, places and organisations are masked too (kind nom); ``masker``
    then takes them as a third argument, as ``rules`` does.
    """
    mask, lang = masker or rules(), F.col("langue")
    # all texts of a row go through one expression; what follows only takes it apart
    if recogniser is None:
        done = df.withColumn("_done", F.transform(field_texts(), lambda t: mask(t, lang)))
    else:
        texts = df.withColumn("_texts", F.transform(field_texts(), lambda t: tx.age_brackets(t, lang)))
        texts = texts.withColumn("_names", F.transform(recogniser.entities(F.col("_texts")), as_spans))
        done = texts.withColumn("_done", F.zip_with("_texts", "_names", lambda t, n: mask(t, lang, n))).drop("_texts", "_names")
    fields = with_field_texts(F.transform("_done", lambda x: x["masked"]))
    return done.withColumns(fields | {"anonymise": F.lit(True), "kinds": F.flatten(F.transform("_done", lambda x: _kinds(x["spans"])))}).drop("_done")


def to_do(source: DataFrame, done: DataFrame) -> DataFrame:
    return source.join(done.select("identifiant").distinct(), "identifiant", "left_anti")


def _by_source(rows: DataFrame) -> DataFrame:
    """Sums of (source, kind, n, with_any), as one row a source; rows of a null kind stand for texts, the others for spans."""
    sums = rows.groupBy("source", "kind").agg(F.sum("n").alias("n"), F.sum("with_any").alias("with_any"))
    whole = lambda c: F.coalesce(F.sum(F.when(F.col("kind").isNull(), F.col(c))), F.lit(0))
    kinds = F.collect_list(F.when(F.col("kind").isNotNull(), F.struct("kind", "n")))
    return sums.groupBy("source").agg(whole("n").alias("lignes"), whole("with_any").alias("avec_entite"), F.map_from_entries(F.array_sort(kinds)).alias("par_type"))


def _row(kind: Column, n: Column, with_any: Column) -> Column:
    return F.struct(kind.cast("string").alias("kind"), n.cast("long").alias("n"), with_any.cast("long").alias("with_any"))


def stats(df: DataFrame, source: str = "source", kinds: str = "kinds") -> DataFrame:
    """By source: lignes, avec_entite (rows with any) and par_type (map of kind to count). The input is read once; a row counts itself and each of its spans."""
    itself = F.array(_row(F.lit(None), F.lit(1), F.coalesce(F.size(kinds) > 0, F.lit(False)).cast("int")))
    each = F.transform(kinds, lambda k: _row(k, F.lit(1), F.lit(0)))
    rows = df.select(F.col(source).alias("source"), F.explode(F.concat(itself, F.coalesce(each, F.array().cast("array<struct<kind:string,n:bigint,with_any:bigint>>")))).alias("x"))
    return _by_source(rows.select("source", "x.*")).withColumnRenamed("source", source)


def merged_stats(ledger: DataFrame) -> DataFrame:
    """The runs of a ledger (source, lignes, avec_entite, par_type) summed up, maps element by element."""
    itself = F.array(_row(F.lit(None), F.col("lignes"), F.col("avec_entite")))
    each = F.transform(F.map_entries("par_type"), lambda e: _row(e["key"], e["value"], F.lit(0)))
    return _by_source(ledger.select("source", F.explode(F.concat(itself, each)).alias("x")).select("source", "x.*"))


def report(total: DataFrame) -> DataFrame:
    """One row: rows, rows with entities, entities, and the share of rows with any in percent (0 without rows)."""
    entities = F.aggregate(F.map_values("par_type"), F.lit(0).cast("long"), lambda a, b: a + b)
    out = total.agg(F.coalesce(F.sum("lignes"), F.lit(0)).alias("lignes"), F.coalesce(F.sum("avec_entite"), F.lit(0)).alias("avec_entite"), F.coalesce(F.sum(entities), F.lit(0)).alias("entites"))
    return out.withColumn("pct_avec_entite", F.coalesce(F.try_divide(F.col("avec_entite") * 100.0, F.col("lignes")), F.lit(0.0)))


def by_count(total: DataFrame) -> DataFrame:
    """Kinds of a source by descending count, then name."""
    return total.select("source", F.explode("par_type").alias("kind", "n")).orderBy("source", F.desc("n"), "kind")


REPORT = "struct<sources:array<struct<source:string,lignes:bigint,avec_entite:bigint,par_type:map<string,bigint>>>>"


def report_json(total: DataFrame) -> DataFrame:
    """The report as one row of JSON: a list of sources, which are few, in order."""
    rows = F.array_sort(F.collect_list(F.struct("source", "lignes", "avec_entite", F.map_entries("par_type").alias("t"))))
    sources = F.transform(rows, lambda s: F.struct(s["source"].alias("source"), s["lignes"].alias("lignes"), s["avec_entite"].alias("avec_entite"), F.map_from_entries(s["t"]).alias("par_type")))
    return total.agg(F.to_json(F.struct(sources.alias("sources"))).alias("json"))


def markdown_of(report: DataFrame) -> DataFrame:
    """One row of text, made from the JSON report alone: markdown."""
    share = lambda s: F.format_number(F.coalesce(F.try_divide(s["avec_entite"] * 100.0, s["lignes"]), F.lit(0.0)), 1)
    line = lambda s: F.format_string("| %s | %d | %d | %s |", s["source"], s["lignes"], s["avec_entite"], share(s))
    head = F.array(F.lit("| source | lignes | avec entité | % |"), F.lit("|---|---:|---:|---:|"))
    sources = F.from_json("json", REPORT)["sources"]
    return report.select(F.concat(F.array_join(F.concat(head, F.transform(sources, line)), "\n"), F.lit("\n")).alias("markdown"))


def markdown(total: DataFrame) -> str:
    """The report as text; it has a row for each source, which is all that comes to the driver."""
    return markdown_of(report_json(total)).first()["markdown"]


def write_report(total: DataFrame, folder: str) -> None:
    """The cumulative report as JSON, and Markdown regenerated from the JSON that was written."""
    report_json(total).write.mode("overwrite").text(f"{folder}/json")
    report = total.sparkSession.read.text(f"{folder}/json").withColumnRenamed("value", "json")
    markdown_of(report).write.mode("overwrite").text(f"{folder}/markdown")
