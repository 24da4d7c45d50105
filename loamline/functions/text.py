"""String, regex and hash expressions.

Patterns spell out their classes: Java's \\w and \\s are ASCII by default and differ from the
Unicode ones even with flags, so words are [\\p{L}\\p{N}_] and white space is listed.
Offsets count code points, from 0, half-open.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

W = r"\p{L}\p{N}_"
S = r"\t-\r\x1C-\x20\x85\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000"
EDGE_L, EDGE_R = rf"(?<![{W}])", rf"(?![{W}])"

#: Month names, and the patterns of personal data that may be left in a text. An address is tried at
#: the start of a run of its characters or after the match before, where it begins if anywhere: so a long run is read once.
MONTHS = r"janvier|f[ée]vrier|mars|avril|mai|juin|juillet|ao[uû]t|septembre|octobre|novembre|d[ée]cembre|January|February|March|April|May|June|July|August|September|October|November|December"
PII = {
    "email": rf"(?:\G|(?<![{W}.+-]))[{W}.+-]++@[{W}-]++\.[a-zA-Z]{{2,}}",
    "url": rf"https?://[^{S}]+|www\.[^{S}]+",
    "telephone": r"(?:\+\p{Nd}{1,3}[ .-]?)?(?:\(?\p{Nd}{2,4}\)?[ .-]){2,5}\p{Nd}{2,4}",
    "date": rf"(?iu){EDGE_L}\p{{Nd}}{{1,2}}[/-]\p{{Nd}}{{1,2}}[/-]\p{{Nd}}{{2,4}}{EDGE_R}|{EDGE_L}\p{{Nd}}{{4}}[/-]\p{{Nd}}{{1,2}}[/-]\p{{Nd}}{{1,2}}{EDGE_R}|{EDGE_L}\p{{Nd}}{{1,2}}[{S}]+(?:{MONTHS})[{S}]+\p{{Nd}}{{4}}{EDGE_R}",
    "bigramme_capitalise": rf"{EDGE_L}[A-ZÀ-Ý][a-zà-ÿ]+(?:[{S}]+[A-ZÀ-Ý][a-zà-ÿ]+)+{EDGE_R}",
}
CONTEXT = 40

#: How texts state an age, by language, and the tokens of its bracket (upper bounds 12, 17, 64, none).
AGE_FR = [rf"(?iu)âgée?[{S}]*\(?[{S}]*(?:de[{S}]+)?({{age}})[{S}]*ans\)?", rf"(?iu){EDGE_L}(?:enfant|nourrisson|adolescente?|nouveau-n[ée]|homme|femme|patiente?|garçon|fille)[{S}]+de[{S}]+({{age}})[{S}]*ans{EDGE_R}"]
AGE_EN = [rf"(?iu){EDGE_L}({{age}})[- ]?years?[- ]?old{EDGE_R}", rf"(?iu){EDGE_L}aged[{S}]+({{age}}){EDGE_R}"]
BRACKETS = {"fr": ["<AGE_PEDIATRIQUE>", "<AGE_ADOLESCENT>", "<AGE_ADULTE>", "<AGE_PERSONNE_AGEE>"], "en": ["<AGE_PEDIATRIC>", "<AGE_ADOLESCENT>", "<AGE_ADULT>", "<AGE_ELDERLY>"]}
#: The numbers of one to three digits in each bracket.
BRACKET_NUMBERS = [r"0{0,2}[0-9]|0?1[0-2]", r"0?1[3-7]", r"0?1[89]|0?[2-5][0-9]|0?6[0-4]", r"0?6[5-9]|0?[7-9][0-9]|[1-9][0-9]{2}"]

#: Calendar dates, and durations that are told from now.
ABSOLUTE_DATE = rf"(?iu)\p{{Nd}}{{1,2}}[/.-]\p{{Nd}}{{1,2}}[/.-]\p{{Nd}}{{2,4}}|\p{{Nd}}{{4}}[/.-]\p{{Nd}}{{1,2}}[/.-]\p{{Nd}}{{1,2}}|{EDGE_L}\p{{Nd}}{{1,2}}[{S}]+(?:{MONTHS})[{S}]+\p{{Nd}}{{4}}{EDGE_R}"
_UNIT = r"jours?|semaines?|mois|ans?|ann[ée]es?|days?|weeks?|months?|years?"
RELATIVE_DURATION = rf"(?iu){EDGE_L}(?:il y a|depuis|pendant|dans|since|for){EDGE_R}[^.;\n]{{0,20}}?\p{{Nd}}{{1,3}}[{S}]*(?:{_UNIT}){EDGE_R}|{EDGE_L}\p{{Nd}}{{1,3}}[{S}]*(?:{_UNIT})[{S}]+ago{EDGE_R}"
NIR = rf"{EDGE_L}[12][ .-]?\p{{Nd}}{{2}}[ .-]?(?:0[1-9]|1[0-2])[ .-]?(?:\p{{Nd}}{{2}}|2[ABab])[ .-]?\p{{Nd}}{{3}}[ .-]?\p{{Nd}}{{3}}[ .-]?\p{{Nd}}{{2}}{EDGE_R}"

MASK = "<INFO_MASQUEE>"
SPAN = "array<struct<kind:string,start:int,end:int,found:string>>"


#: Before every id; callers with ids of their own pass theirs.
ID_PREFIX = "corpus"


def content_id(namespace: Column, key: Column, prefix: str = ID_PREFIX) -> Column:
    """prefix-namespace-hash: the first 16 hex digits of sha256(namespace:key); the namespace is lower-cased outside the hash only."""
    return F.concat(F.lit(prefix + "-"), F.lower(namespace), F.lit("-"), F.substring(F.sha2(F.concat(namespace, F.lit(":"), key), 256), 1, 16))


def strip(c: Column) -> Column:
    """Without white space (of any script) at both ends."""
    return F.regexp_replace(c, rf"^[{S}]+|[{S}]+$", "")


def rstrip(c: Column) -> Column:
    return F.regexp_replace(c, rf"[{S}]+$", "")


def _capital(c: str) -> str:
    """The capital of a letter if that is one code point, else the letter; ß has ẞ."""
    return next((x for x in ("ẞ" if c == "ß" else c.upper(), c.title()) if len(x) == 1), c)


# letters with capitals are all below U+20000
_CAPITALS = {c: _capital(c) for c in map(chr, range(0x20000)) if _capital(c) != c}


def upper(c: Column) -> Column:
    """Capitals code point by code point, as in DuckDB, so that lengths stay: Spark's own ``upper`` makes SS of ß."""
    return F.translate(c, "".join(_CAPITALS), "".join(_CAPITALS.values()))


def first_truthy(*cols: Column) -> Column:
    """The first that is neither null nor empty."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in cols])


def normalised(c: Column) -> Column:
    """Lower case, marks as spaces, single spaces, none at the ends."""
    return strip(F.regexp_replace(F.regexp_replace(F.lower(c), rf"[^{W}{S}]", " "), rf"[{S}]+", " "))


def tokens(c: Column) -> Column:
    return F.filter(F.split(c, rf"[{S}]+"), lambda t: t != "")


def bound(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value) with the value computed once a row, however often ``then`` uses it."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


#: Distances of ``running``; the last is for arrays of up to 2 ** 27 values.
_BACK = [1 << k for k in range(27)]


def running(values: Column, combine: Callable[[Column, Column], Column]) -> Column:
    """For each value of an array, all values up to it combined (an associative function, such as a sum or the greater one).

    One step after the other combines what is 1, 2, 4 ... places back, as far as the array
    goes: n log n in all, where an accumulator that is copied for each value takes the square.
    """

    def steps(v: Column) -> Column:
        far = F.filter(F.array(*map(F.lit, _BACK)), lambda back: back < F.size(v))
        return F.aggregate(far, v, lambda a, back: F.transform(a, lambda x, i: F.when(i < back, x).otherwise(combine(F.get(a, i - back), x))))

    return bound(values, steps)


def spans(text: Column, kind: str, pattern: str) -> Column:
    """All matches, left to right, as (kind, start, end, found)."""
    # matches and what is between them, side by side: each is computed once
    pieces = F.zip_with(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1), lambda f, g: F.struct(f.alias("found"), (F.length(g) + F.coalesce(F.length(f), F.lit(0))).alias("n")))

    def placed(p: Column) -> Column:
        ends = running(F.transform(p, lambda x: x["n"]), lambda a, b: a + b)
        span = lambda x, e: F.struct(F.lit(kind).alias("kind"), (e - F.length(x["found"])).alias("start"), e.alias("end"), x["found"].alias("found"))
        return F.zip_with(p, ends, span)

    # the last piece is what follows the last match
    return F.when(text.rlike(pattern), F.filter(bound(pieces, placed), lambda x: x["found"].isNotNull())).when(text.isNotNull(), F.array().cast(SPAN))


def pii_spans(text: Column, kinds: tuple[str, ...] = tuple(PII)) -> Column:
    """Residual personal data in the order of the kinds; none in null or empty texts."""
    each = F.concat(*[spans(text, k, PII[k]) for k in kinds])
    return F.when(F.coalesce(text, F.lit("")) == "", F.array().cast(SPAN)).otherwise(each)


def pii_numbers(text: Column, kinds: tuple[str, ...] = tuple(PII)) -> list[Column]:
    """The number of matches of each kind, 0 in null texts; no spans are made."""
    return [F.coalesce(F.regexp_count(text, F.lit(PII[k])), F.lit(0)).alias(k) for k in kinds]


#: Code points of a piece of a text that is cut at many places.
PIECE = 1024


def pieces(text: Column) -> Column:
    """A text in pieces of ``PIECE`` code points, for ``cut``."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))


def cut(parts: Column, start: Column, end: Column) -> Column:
    """Code points ``start`` to ``end`` of a text in ``pieces``. A substring of the whole text would be counted from its start, for each cut anew."""
    first = F.floor(start / PIECE).cast("int")
    some = F.slice(parts, first + 1, F.greatest(F.ceil(end / PIECE).cast("int") - first, F.lit(0)))

    def inside(p: Column, i: Column) -> Column:
        before = (first + i) * PIECE
        low = F.greatest(start - before, F.lit(0))
        return F.substring(p, low + 1, F.least(end - before, F.lit(PIECE)) - low)

    return F.when(end > start, F.array_join(F.transform(some, inside), "")).otherwise("")


def context(text: Column, start: Column, end: Column, margin: int = CONTEXT) -> Column:
    """The span with up to ``margin`` code points on either side."""
    first = F.greatest(start - margin, F.lit(0))
    return F.substring(text, first + 1, F.least(end + margin, F.length(text)) - first)


def with_contexts(text: Column, found: Column, margin: int = CONTEXT) -> Column:
    """Spans with their context, as ``passage``."""
    passage = lambda x, s: cut(x["parts"], F.greatest(s["start"] - margin, F.lit(0)), F.least(s["end"] + margin, x["n"]))
    each = lambda x: F.transform(x["found"], lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), passage(x, s).alias("passage")))
    none = F.array().cast("array<struct<kind:string,start:int,end:int,passage:string>>")
    told = lambda f: F.when(F.size(f) == 0, none).otherwise(bound(F.struct(pieces(text).alias("parts"), F.length(text).alias("n"), f.alias("found")), each))
    return bound(found, told)


def age_brackets(text: Column, lang: Column) -> Column:
    """Stated ages as bracket tokens; French patterns for fr, English ones for all other languages.

    A pattern's four brackets have disjoint numbers, so replacing them one after
    the other equals one pass over the pattern.
    """

    def applied(patterns: list[str], names: list[str]) -> Column:
        out = text
        for pattern in patterns:
            for numbers, token in zip(BRACKET_NUMBERS, names, strict=True):
                out = F.regexp_replace(out, pattern.replace("{age}", numbers), token)
        return out

    return F.when(lang == "fr", applied(AGE_FR, BRACKETS["fr"])).otherwise(applied(AGE_EN, BRACKETS["en"]))


def age_bracket_of(age: Column, lang: str = "fr") -> Column:
    child, teen, adult, elder = BRACKETS.get(lang, BRACKETS["en"])
    return F.when(age <= 12, child).when(age <= 17, teen).when(age <= 64, adult).otherwise(elder)


def is_absolute_date(c: Column) -> Column:
    return c.rlike(ABSOLUTE_DATE)


def is_relative_duration(c: Column) -> Column:
    return c.rlike(RELATIVE_DURATION)


def valid_nir(c: Column) -> Column:
    """Whether the 13 digits agree with the two check digits; Corsican departments count as 0 less a million (A) or two (B)."""
    bare = F.upper(F.regexp_replace(c, "[ .-]", ""))
    body, key = F.substring(bare, 1, 13), F.substring(bare, 14, 2)
    less = F.when(body.contains("A"), 1_000_000).when(body.contains("B"), 2_000_000).otherwise(0)
    digits = F.when(body.contains("A"), F.replace(body, F.lit("A"), F.lit("0"))).otherwise(F.replace(body, F.lit("B"), F.lit("0")))
    number = digits.try_cast("bigint")
    well = (F.length(bare) == 15) & digits.rlike("^[0-9]{13}$") & key.rlike("^[0-9]{2}$")
    return F.coalesce(F.when(well, 97 - F.pmod(number - less, F.lit(97)) == key.try_cast("int")), F.lit(False))


def masked(found: Column, kind: Column, strategy: str = "replace", token: str = MASK) -> Column:
    """What stands for a span. A date stays if it is no calendar date but a duration told from now."""
    if strategy not in ("replace", "mask", "redact"):
        raise ValueError(f"unknown strategy: {strategy}")
    n = F.length(found)
    stars = F.concat(F.repeat(F.lit("*"), F.least(n, F.lit(100))), F.substring(found, 101, 1 << 30))
    plain = {"replace": F.lit(token), "mask": stars, "redact": F.lit("")}[strategy]
    date = F.repeat(F.lit("*"), n) if strategy == "mask" else plain
    keep = ~is_absolute_date(found) & is_relative_duration(found)
    return F.when(kind == "date", F.when(keep, found).otherwise(date)).otherwise(plain)


def merged(found: Column) -> Column:
    """Spans sorted, with overlapping ones as one (of the kind of the first).

    A span begins a group if it starts where all spans before it have ended: at the
    running maximum of the ends; a group's end is that maximum at its last span.
    """
    by_place = F.array_sort(F.transform(found, lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("less"), s["kind"].alias("kind"), s["end"].alias("end"))))

    def groups(x: Column) -> Column:
        each, upto = x["each"], x["upto"]
        first = F.filter(F.sequence(F.lit(0), F.size(each) - 1), lambda i: (i == 0) | (F.get(each, i)["start"] >= F.get(upto, i - 1)))
        group = lambda heads: F.transform(heads, lambda i, k: F.struct(F.get(each, i)["kind"].alias("kind"), F.get(each, i)["start"].alias("start"), F.get(upto, F.coalesce(F.get(heads, k + 1), F.size(each)) - 1).alias("end")))
        return bound(first, group)

    with_ends = lambda each: F.struct(each.alias("each"), running(F.transform(each, lambda s: s["end"]), F.greatest).alias("upto"))
    none = F.array().cast("array<struct<kind:string,start:int,end:int>>")
    return bound(by_place, lambda each: F.when(F.size(each) == 0, none).when(F.size(each) > 0, bound(with_ends(each), groups)))


def with_spans_masked(text: Column, found: Column, strategy: str = "replace", token: str = MASK) -> Column:
    """The text with each group of overlapping spans masked once."""

    def masked_text(x: Column) -> Column:
        parts, groups = x["parts"], x["groups"]
        ends = F.concat(F.array(F.lit(0)), F.transform(groups, lambda s: s["end"]))
        # what stands before each group, and its mask; the last end has no group
        piece = lambda s, at: F.when(s.isNull(), cut(parts, at, x["n"])).otherwise(F.concat(cut(parts, at, s["start"]), bound(cut(parts, s["start"], s["end"]), lambda found: masked(found, s["kind"], strategy, token))))
        return F.array_join(F.zip_with(groups, ends, piece), "")

    whole = lambda groups: bound(F.struct(pieces(text).alias("parts"), F.length(text).alias("n"), groups.alias("groups")), masked_text)
    return bound(found, lambda f: F.when(F.size(f) == 0, text).otherwise(whole(merged(f))))


def cut_at_sentence(text: Column, limit: int = 1500) -> Column:
    """Texts beyond the limit end at the last '. ' before it, else '! ', else '? ', else the last line end; else at the limit."""
    head = F.substring(text, 1, limit)

    def last(separator: str) -> Column:
        """0-based place of the last one, or -1."""
        back = F.locate(separator[::-1], F.reverse(head))
        return F.when(back > 0, F.length(head) - back - len(separator) + 1).otherwise(-1)

    out = F.when(last("\n") > 0, rstrip(F.substring(head, F.lit(1), last("\n")))).otherwise(rstrip(head))
    for separator in ("? ", "! ", ". "):
        out = F.when(last(separator) > 0, F.substring(head, F.lit(1), last(separator) + 1)).otherwise(out)
    return F.when(F.length(text) <= limit, text).otherwise(out)


def overlapping_labels(entities: Column, start: Column, end: Column) -> Column:
    """Labels of the entities (label, start, end) that share a code point with the span."""
    return F.transform(F.filter(entities, lambda e: (e["start"] < end) & (e["end"] > start)), lambda e: e["label"])


def entity_verdict(labels: Column, lang: Column) -> Column:
    """aucune without labels, pertinente if one names a person, place or organisation in the language's scheme, else autre."""
    french, english = F.array(*map(F.lit, ("PER", "ORG", "LOC"))), F.array(*map(F.lit, ("PERSON", "ORG", "GPE", "LOC", "NORP")))
    return F.when(F.size(labels) == 0, "aucune").when(F.arrays_overlap(labels, F.when(lang == "fr", french).otherwise(english)), "pertinente").otherwise("autre")


def opinions(found: Column, entities: Column, lang: Column) -> Column:
    """For each span (start, end), ``entity_verdict`` of the entities (label, start, end) that share a code point with it.

    Ends of spans and starts of entities are put in one order. Of the entities that start before a
    span ends, one overlaps it if the last end among them is beyond its start: a running maximum,
    so time grows with n log n, however many spans and entities a text has.
    """
    french, english = ("PER", "ORG", "LOC"), ("PERSON", "ORG", "GPE", "LOC", "NORP")
    # at an equal place the span comes first: an entity that starts at its end is outside
    event = lambda at, kind, end, named, i: F.struct(at.alias("at"), F.lit(kind).alias("kind"), end.cast("int").alias("end"), named.cast("int").alias("named"), i.cast("int").alias("i"))
    none = F.lit(-1)

    def named(e: Column) -> Column:
        return F.when(F.coalesce(F.when(lang == "fr", e["label"].isin(*french)).otherwise(e["label"].isin(*english)), F.lit(False)), e["end"]).otherwise(none)

    def judged(x: Column) -> Column:
        spans, events = x["spans"], x["events"]
        upto = lambda c: running(F.transform(events, lambda e: e[c]), F.greatest)
        both = F.zip_with(F.zip_with(events, upto("end"), lambda e, m: F.struct(e["i"].alias("i"), m.alias("any"))), upto("named"), lambda e, m: F.struct(e["i"].alias("i"), e["any"].alias("any"), m.alias("named")))
        own = F.array_sort(F.filter(both, lambda e: e["i"] >= 0))
        return F.zip_with(spans, own, lambda s, m: F.when(m["named"] > s["start"], "pertinente").when(m["any"] > s["start"], "autre").otherwise("aucune"))

    def ordered(x: Column) -> Column:
        spans, known = x["spans"], x["known"]
        events = F.concat(F.transform(spans, lambda s, i: event(s["end"], 0, none, none, i)), F.transform(known, lambda e: event(e["start"], 1, e["end"], named(e), none)))
        return bound(F.struct(spans.alias("spans"), F.array_sort(events).alias("events")), judged)

    known = F.coalesce(entities, F.array().cast("array<struct<label:string,start:int,end:int>>"))
    plain = F.transform(found, lambda s: F.struct(s["start"].cast("int").alias("start"), s["end"].cast("int").alias("end")))
    return bound(F.struct(plain.alias("spans"), known.alias("known")), ordered)


def checkpoint_id(model: Column, stamp: Column, preference: bool = False) -> Column:
    """16 hex digits of model:stamp, or dpo:model:stamp."""
    return F.substring(F.sha2(F.concat(F.lit("dpo:" if preference else ""), model, F.lit(":"), stamp), 256), 1, 16)
