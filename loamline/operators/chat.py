"""ChatML rendering with character bounds, preference triplets and label masks."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loamline.functions.text import bound, running

BEGIN, END = "<|im_start|>", "<|im_end|>\n"


@dataclass(frozen=True)
class Template:
    """How a turn is written: begin, role, after_role, text, end."""

    begin: str = BEGIN
    after_role: str = "\n"
    end: str = END

    def turn(self, m: Column) -> Column:
        return F.concat(F.lit(self.begin), m["role"], F.lit(self.after_role), m["contenu"], F.lit(self.end))

    def invitation(self) -> Column:
        return F.lit(f"{self.begin}assistant{self.after_role}")


CHATML = Template()


def turn(m: Column, template: Template = CHATML) -> Column:
    return template.turn(m)


def render(messages: Column, template: Template = CHATML) -> Column:
    return F.array_join(F.transform(messages, template.turn), "")


def bounds(messages: Column, template: Template = CHATML) -> Column:
    """Half-open, contiguous character bounds (role, debut, fin) of the rendered turns."""
    sizes = F.transform(messages, lambda m: F.struct(m["role"].alias("role"), F.length(template.turn(m)).alias("n")))
    ends = lambda turns: running(F.transform(turns, lambda t: t["n"]), lambda a, b: a + b)
    bound_of = lambda t, end: F.struct(t["role"].alias("role"), (end - t["n"]).alias("debut"), end.alias("fin"))
    return bound(sizes, lambda turns: F.zip_with(turns, ends(turns), bound_of))


def formatted(pivot: DataFrame, template: Template = CHATML) -> DataFrame:
    """identifiant, texte and tours of rows with a prompt and a completion."""
    every = F.concat("prompt", "completion")
    return pivot.select("identifiant", render(every, template).alias("texte"), bounds(every, template).alias("tours"))


def invitation(prompt: Column, template: Template = CHATML) -> Column:
    """The prompt with an open assistant turn."""
    return F.concat(render(prompt, template), template.invitation())


def triplets(pivot: DataFrame, reformulated: DataFrame | None = None, template: Template = CHATML) -> DataFrame:
    """identifiant, prompt, chosen, rejected as text; a reformulated chosen replaces the original."""
    rows = pivot.filter(F.col("type_exemple") == "dpo")
    if reformulated is not None:
        rows = rows.join(reformulated.select("identifiant", F.col("chosen").alias("_new")), "identifiant", "left").withColumn("chosen", F.coalesce("_new", "chosen"))
    return rows.select("identifiant", invitation(F.col("prompt"), template).alias("prompt"), render(F.col("chosen"), template).alias("chosen"), render(F.col("rejected"), template).alias("rejected"))


def assistant_text(text: Column, turns: Column) -> Column:
    """The slices of assistant turns."""
    return F.transform(F.filter(turns, lambda t: t["role"] == "assistant"), lambda t: F.substring(text, t["debut"] + 1, t["fin"] - t["debut"]))


def labels(text: Column, turns: Column, tokenise: Callable[[Column], Column], assistant_only: bool = True) -> Column:
    """Token ids turn by turn, -100 outside assistant turns; without bounds, or for all turns, plain ids."""
    whole = tokenise(text)
    if not assistant_only:
        return whole

    def one(t: Column) -> Column:
        ids = tokenise(F.substring(text, t["debut"] + 1, t["fin"] - t["debut"]))
        return F.when(t["role"] == "assistant", ids).otherwise(F.array_repeat(F.lit(-100), F.size(ids)))

    return F.when(F.size(turns) > 0, F.flatten(F.transform(turns, one))).otherwise(whole)


def code_points(text: Column) -> Column:
    """A stand-in tokeniser: one id a character."""
    return F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.ascii(c))


def members(df: DataFrame, pivot: DataFrame, split: str, kind: str | None = None) -> DataFrame:
    """Formatted rows whose pivot row is in the split (and of the type)."""
    ids = pivot.filter(F.col("split") == split)
    ids = ids if kind is None else ids.filter(F.col("type_exemple") == kind)
    return df.join(ids.select("identifiant"), "identifiant", "left_semi")
