"""Expressions over model output that should hold JSON."""

from __future__ import annotations

import ast
import re

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loamline.functions.text import bound, strip


#: Quoted texts (left as they are), and the names of numbers that no literal spells.
_NAMED = re.compile(r"'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\"|\b(nan|inf)\b")


def strict(text: Column) -> Column:
    """The text as one JSON value (variant), or null. Wrapped in an array, so trailing text is no value.

    Duplicate keys and NaN are no JSON here.
    """
    items = F.try_variant_get(F.try_parse_json(F.concat(F.lit("["), text, F.lit("]"))), "$", "array<variant>")
    return bound(items, lambda v: F.when(F.size(v) == 1, F.get(v, F.lit(0))))


def is_object(v: Column) -> Column:
    return F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False))


def lenient_object(text: Column) -> Column:
    """The text as a JSON object, or else the block from its first { to its last }; null if neither is one. Each is parsed once, the block only if it is needed."""
    block = strict(F.nullif(F.regexp_extract(text, r"(?s)\{.*\}", 0), F.lit("")))
    part = bound(block, lambda p: F.when(is_object(p), p))
    return bound(strict(text), lambda w: F.when(is_object(w), w).otherwise(part))


def python_float(c: Column) -> Column:
    """A double as Python prints it."""
    plain, exponent = c.cast("string"), F.regexp_extract(c.cast("string"), r"E(-?[0-9]+)$", 1).try_cast("int")
    whole = F.regexp_replace(c.cast("decimal(38,18)").cast("string"), r"(\.[0-9]+?)0+$", "$1")
    digits = F.regexp_replace(F.regexp_extract(plain, r"^(.*)E", 1), r"\.0$", "")
    power = F.concat(F.when(exponent < 0, "-").otherwise("+"), F.lpad(F.abs(exponent).cast("string"), F.greatest(F.length(F.abs(exponent).cast("string")), F.lit(2)), F.lit("0")))
    named = F.when(F.isnan(c), "nan").when(c == float("inf"), "inf").when(c == float("-inf"), "-inf")
    return F.coalesce(named, F.when(exponent.isNull(), plain).when(exponent.between(-4, 15), whole).otherwise(F.concat(digits, F.lit("e"), power)))


def printed(c: Column, kind: T.DataType, nested: bool = False) -> Column:
    """A value as Python prints it: lists and dicts of any depth, texts inside them in quotes, None for null."""
    if isinstance(kind, T.ArrayType):
        out = F.concat(F.lit("["), F.array_join(F.transform(c, lambda x: printed(x, kind.elementType, True)), ", "), F.lit("]"))
    elif isinstance(kind, T.StructType):
        fields = [F.concat(F.lit(f"'{f.name}': "), printed(c[f.name], f.dataType, True)) for f in kind.fields]
        out = F.concat(F.lit("{"), F.concat_ws(", ", *fields), F.lit("}"))
    elif isinstance(kind, T.MapType):
        pair = lambda e: F.concat(printed(e["key"], kind.keyType, True), F.lit(": "), printed(e["value"], kind.valueType, True))
        out = F.concat(F.lit("{"), F.array_join(F.transform(F.map_entries(c), pair), ", "), F.lit("}"))
    elif isinstance(kind, (T.DoubleType, T.FloatType)):
        out = python_float(c.cast("double"))
    elif isinstance(kind, T.BooleanType):
        out = F.initcap(c.cast("string"))
    elif isinstance(kind, T.StringType):
        out = _quoted(c) if nested else c
    else:
        out = c.cast("string")
    return F.coalesce(F.when(c.isNotNull(), out), F.lit("None"))


def _quoted(plain: Column) -> Column:
    """A text in quotes as Python chooses them; line ends and tabs are escaped."""
    safe = plain
    for a, b in (("\\", "\\\\"), ("\n", "\\n"), ("\t", "\\t"), ("\r", "\\r")):
        safe = F.replace(safe, F.lit(a), F.lit(b))
    double = plain.contains("'") & ~plain.contains('"')
    return F.when(double, F.concat(F.lit('"'), safe, F.lit('"'))).otherwise(F.concat(F.lit("'"), F.replace(safe, F.lit("'"), F.lit("\\'")), F.lit("'")))


def _spelled(v: Column, nested: bool = False) -> Column:
    """A JSON scalar as Python prints it; in a list, texts are quoted."""
    kind, plain = F.schema_of_variant(v), F.try_variant_get(v, "$", "string")
    text = _quoted(plain) if nested else plain
    # 3.0 is a decimal without places; so are whole numbers too long for 64 bits, which have 19 digits or more
    long = kind.rlike(r"^DECIMAL\((19|[23][0-9]),0\)$")
    number = (kind.startswith("DECIMAL") & ~long) | kind.isin("DOUBLE", "FLOAT")
    out = F.when(kind == "VOID", "None").when(kind == "BOOLEAN", F.initcap(plain)).when(number, python_float(F.try_variant_get(v, "$", "double")))
    return out.when(kind == "STRING", text).otherwise(plain)


def level(text: Column, field: str = "niveau") -> Column:
    """The field of the lenient object as Python prints it, trimmed; null if absent.

    Literals are spelled None, True and False, 3.0 keeps its point, lists of plain
    values have a space after each comma. Objects are given as JSON.
    """

    def spelled(v: Column) -> Column:
        items = F.transform(F.try_variant_get(v, "$", "array<variant>"), lambda x: bound(x, lambda y: F.coalesce(_spelled(y, True), F.lit("None"))))
        return strip(F.when(F.schema_of_variant(v).startswith("ARRAY"), F.concat(F.lit("["), F.array_join(items, ", "), F.lit("]"))).otherwise(_spelled(v)))

    return bound(F.try_variant_get(lenient_object(text), f"$.{field}", "variant"), lambda v: F.when(v.isNotNull(), spelled(v)))


def _thought(text: Column, i: int) -> Column:
    return F.nullif(F.regexp_extract(strip(text), r"(?s)^<think>(.*?)</think>(.*)$", i), F.lit(""))


def diagnosis(text: Column) -> Column:
    """struct(raisonnement, niveau, categorie, ressources_estimees) of a well-formed answer, or null.

    It starts with <think>; what follows the first </think> is one JSON object of
    exactly these three fields, a whole number and two strings; the thought is not blank.
    """
    thought = strip(_thought(text, 1))
    obj = strict(strip(_thought(text, 2)))
    keys = F.array_sort(F.json_object_keys(F.when(is_object(obj), obj.cast("string"))))
    kind = lambda f: F.schema_of_variant(F.try_variant_get(obj, f"$.{f}", "variant"))
    fields = (keys == F.array(F.lit("categorie"), F.lit("niveau"), F.lit("ressources_estimees"))) & (kind("niveau") == "BIGINT") & (kind("categorie") == "STRING") & (kind("ressources_estimees") == "STRING")
    value = F.struct(thought.alias("raisonnement"), F.try_variant_get(obj, "$.niveau", "bigint").alias("niveau"), F.try_variant_get(obj, "$.categorie", "string").alias("categorie"), F.try_variant_get(obj, "$.ressources_estimees", "string").alias("ressources_estimees"))
    return F.when((thought != "") & is_object(obj) & fields, value)


def reformulation(text: Column) -> Column:
    """The stripped answer as one assistant message if it has the form of a diagnosis, whatever the types of its fields; else null."""
    obj = strict(strip(_thought(text, 2)))
    keys = F.array_sort(F.json_object_keys(F.when(is_object(obj), obj.cast("string"))))
    well = (strip(_thought(text, 1)) != "") & (keys == F.array(F.lit("categorie"), F.lit("niveau"), F.lit("ressources_estimees")))
    return F.when(well, F.array(F.struct(F.lit("assistant").alias("role"), strip(text).alias("contenu"))))


#: Fixed value: the form that constrained generation allows.
DIAGNOSIS_FORM = r'^<think>[^<]{10,500}</think>\{"niveau": [1-5], "categorie": "[^"]{1,120}", "ressources_estimees": "[^"]{1,300}"\}$'


def has_diagnosis_form(text: Column) -> Column:
    return text.rlike(DIAGNOSIS_FORM)


def _literals(lines: pa.Array) -> pa.Array:
    """Printed dicts, whatever they hold, as pairs of names and numbers."""
    out = []
    for line in lines.to_pylist():
        try:
            found = ast.literal_eval(_NAMED.sub(lambda m: m[0] if m[1] is None else "1e999" if m[1] == "inf" else "'nan'", line)) if line else None
        except (ValueError, SyntaxError, MemoryError, RecursionError):
            found = None
        if not isinstance(found, dict):
            out.append(None)
            continue
        row = {}
        for name, value in found.items():
            try:
                row[str(name)] = None if isinstance(value, (bool, list, tuple, dict, set, bytes, complex)) or value is None else float(value)
            except (ValueError, OverflowError):
                row[str(name)] = None
        out.append(list(row.items()))
    return pa.array(out, pa.map_(pa.string(), pa.float64()))


def python_dict(text: Column) -> Column:
    """A printed dict as map<string,double>, or null; values that are no numbers (None, truth values, texts, tuples, lists, dicts) are null.

    Only lines of train and eval losses are read, so the others cost no Python. inf and nan are numbers.
    """
    line = strip(text)
    wanted = F.when(line.startswith("{'loss'") | line.startswith("{'eval_loss'"), line)
    return F.arrow_udf(_literals, "map<string,double>")(wanted)


def split_glued(text: Column) -> Column:
    """Objects written without a line end between them, one a row of an array."""
    return F.split(F.regexp_replace(text, r"\}\{", "}\n{"), "\n")


def history(turns: Column) -> Column:
    """A conversation's turns (turn, role, contenu), in order, as a JSON array of messages."""
    return F.to_json(F.transform(F.array_sort(turns), lambda t: F.struct(t["role"].alias("role"), t["contenu"].alias("contenu"))))


def first_turn_prefix(turn: Column, first: Column, prefix: str, text: Column) -> Column:
    """The prefix goes before the first turn of a conversation only."""
    return F.when(turn == first, F.concat(F.lit(prefix), text)).otherwise(text)


def capped(c: Column, low: int = 0, high: int = 2) -> Column:
    return F.greatest(F.lit(low), F.least(c, F.lit(high)))
