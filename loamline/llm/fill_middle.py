"""Fill-in-middle transformation by escaped marker injection.

A text is cut into units (letter runs, and every other code point by itself). A
delimiter is escaped wherever the text has it, ``regexp_replace`` appends the bare
delimiter after each unit, its count is the number of units, and ``substring_index``
takes the units before, between and behind two of its ranks. The parts lose the
delimiters, are unescaped and put together as prefix, suffix, middle or suffix, prefix,
middle. No array of units is built: a text is one string all along, and nothing is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UNIT = "[A-Za-z]+|[^A-Za-z]"
#: Prefix, suffix and middle marker of the output.
MARKERS = ("<P>", "<S>", "<M>")
#: The delimiter, and what escapes it and itself: E0 is E, E1 is D.
_D, _E = "\x1f", "\x1b"


def _escaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit(_E), F.lit(_E + "0")), F.lit(_D), F.lit(_E + "1"))


def _plain(marked: Column) -> Column:
    """Marked units as the text that they were."""
    bare = F.replace(marked, F.lit(_D), F.lit(""))
    return F.replace(F.replace(bare, F.lit(_E + "1"), F.lit(_D)), F.lit(_E + "0"), F.lit(_E))


def _index(text: Column, delimiter: str, rank: Column) -> Column:
    return F.call_function("substring_index", text, F.lit(delimiter), rank.cast("int"))


def _draw(key: Column, k: int) -> Column:
    """The k-th 8-digit group (from 1) of the hex digest, as a number."""
    return F.conv(F.substring(key, 8 * k - 7, 8), 16, 10).cast("long")


def restored(output: Column, form: Column, markers: tuple[str, str, str] = MARKERS) -> Column:
    """The text that an output of the given form was made of.

    The parts hold no marker, and none can begin in a part and end in the marker after
    it (each has its first character nowhere else), so the first of each kind is the one put there.
    """
    p, s, m = markers

    def parts(first: str, second: str) -> tuple[Column, Column, Column]:
        body = F.substring(output, len(first) + 1, 1 << 30)
        head = F.substring_index(body, m, 1)
        return F.substring_index(head, second, 1), F.substring_index(head, second, -1), F.substring_index(body, m, -1)

    a, b, mid = parts(p, s)
    psm = F.concat(a, mid, b)
    a, b, mid = parts(s, p)
    return F.when(form == "psm", psm).when(form == "spm", F.concat(b, mid, a)).otherwise(output)


def fill_in_middle(docs: DataFrame, *, seed: int = 1, plain_percent: int = 10, spm_percent: int = 20, unit: str = UNIT, markers: tuple[str, str, str] = MARKERS, report: str = "fim") -> DataFrame:
    """All columns of ``docs`` with a struct ``report``: n (units), form (plain, psm, spm), prefix, middle, suffix (null if plain), output.

    ``docs`` needs doc_id and text; ``report`` takes the place of a column of that name,
    other names may be any. The two cuts, and the form, are drawn from the sha256 of
    ``seed:doc_id``, so reruns agree and rows that share a doc_id share draws. Texts are
    read whole. A null text is an empty one; empty texts, texts with a marker and
    ``plain_percent`` of the others stay plain; of the rest ``spm_percent`` are spm. A
    null doc_id is drawn as an empty one. The delimiter's characters, if a text has them, are units by
    themselves. Repeated rows fare alike; an empty table gives an empty one.
    """
    p, s, m = markers
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.coalesce("text", F.lit("")).alias("whole"), F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("")), 256).alias("key"))
    rows = rows.withColumn("marked", F.regexp_replace(_escaped(F.col("whole")), f"{_E}[01]|{unit}", f"$0{_D}"))
    rows = rows.withColumn("n", F.regexp_count("marked", F.lit(_D)).cast("long"))
    cuts = [_draw(F.col("key"), k) % (F.col("n") + 1) for k in (1, 2)]
    held = (F.col("whole") == "") | F.col("whole").contains(p) | F.col("whole").contains(s) | F.col("whole").contains(m)
    form = F.when(held | (_draw(F.col("key"), 3) % 100 >= 100 - plain_percent), "plain").when(_draw(F.col("key"), 4) % 100 < spm_percent, "spm").otherwise("psm")
    rows = rows.select("row", "whole", "marked", "n", F.least(*cuts).alias("lo"), F.greatest(*cuts).alias("hi"), form.alias("form"))
    cut = lambda part: F.when(F.col("form") != "plain", _plain(part))
    upto = _index(F.col("marked"), _D, F.col("hi"))
    rows = rows.select(
        "row", "whole", "n", "form",
        cut(_index(F.col("marked"), _D, F.col("lo"))).alias("prefix"),
        cut(_index(upto, _D, F.col("lo") - F.col("hi"))).alias("middle"),
        cut(_index(F.col("marked"), _D, F.col("hi") - F.col("n") - 1)).alias("suffix"),
    )
    psm, spm = F.concat(F.lit(p), "prefix", F.lit(s), "suffix", F.lit(m), "middle"), F.concat(F.lit(s), "suffix", F.lit(p), "prefix", F.lit(m), "middle")
    output = F.when(F.col("form") == "psm", psm).when(F.col("form") == "spm", spm).otherwise(F.col("whole"))
    told = F.struct("n", "form", "prefix", "middle", "suffix", output.alias("output"))
    return rows.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns if c != report], told.alias(report))
