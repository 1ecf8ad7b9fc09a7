"""Personal data: regular expressions propose spans, checksums confirm them, context words adjust the score.

DataFrame functions alone. Each match is wrapped in two private-use characters, the text is split at the first of
them and the lengths of the parts add up to code-point offsets, so a text is scanned once for each kind. The patterns take
what cannot be given back possessively and start at a run's first character, so that long runs take linear time; offsets and
context words come from one fold over the parts, so that many spans in one text take linear time too.

Defined results: a null text counts as empty and has no spans. A failing match is dropped and its characters are not tried again.
Repeated rows and null ids keep their rows. A table without rows gives none. Other columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The kinds in the order of their spans, with their patterns. iban is an addition to the base kinds.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}(?![A-Za-z0-9])"
KINDS = {"email": EMAIL, "ip": IP, "card": CARD, "phone": PHONE, "iban": IBAN}
BASE = ("email", "ip", "card", "phone")
#: Words that make personal data likelier when one stands in the code points before a span.
CONTEXT = "e-?mail|mail|contact|write|card|visa|mastercard|credit|phone|tel|call|mobile|fax|iban|account|bank|ip|server|host|address"
CONTEXT_CHARS = 40
#: A character without which a text has no match of the kind.
NEEDED = {"email": "@", "phone": "+"}
#: Matches that a fold gathers at once.
BLOCK = 256
OPEN, SHUT, OTHER = "", "", ""


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _chars(s: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.char_length(s)), lambda i: F.substring(s, i, F.lit(1)))


def luhn(digits: Column) -> Column:
    """Whether a string of one digit or more has a valid check digit."""
    def weigh(d, i):
        twice = d.cast("int") * (i % 2 + 1)
        return F.when(twice > 9, twice - 9).otherwise(twice)

    return F.aggregate(F.transform(_chars(F.reverse(digits)), weigh), F.lit(0), lambda a, x: a + x) % 10 == 0


def mod97(iban: Column) -> Column:
    """Whether an IBAN without spaces leaves 1 modulo 97, its first four characters moved to the end, A as 10 and so on."""
    turned = F.concat(F.substring(iban, F.lit(5), F.char_length(iban)), F.substring(iban, 1, 4))

    def step(a, c):
        code = F.ascii(c)
        return F.when(code < 65, (a * 10 + code - 48) % 97).otherwise((a * 100 + code - 55) % 97)

    return F.aggregate(_chars(turned), F.lit(0), step) == 1


def _valid(kind: str, m: Column) -> Column:
    if kind == "ip":
        def small(p):
            bare = F.regexp_replace(p, "^0+", "")
            return F.when(F.char_length(bare) > 3, False).otherwise(F.coalesce(F.nullif(bare, F.lit("")), F.lit("0")).cast("int") <= 255)

        return F.forall(F.split(m, r"\."), small)
    if kind == "card":
        return F.when(F.char_length(_digits(m)).between(13, 19), luhn(_digits(m))).otherwise(False)
    if kind == "phone":
        return F.char_length(_digits(m)).between(9, 15)
    if kind == "iban":
        return mod97(F.replace(m, F.lit(" "), F.lit("")))
    return F.lit(True)


def _parts(kind: str, text: Column) -> Column:
    """The text cut at the start of each match; a part but the first is a match, SHUT and what comes before the next."""
    marked = F.regexp_replace(text, KINDS[kind], f"{OPEN}$0{SHUT}")
    if kind in NEEDED:
        marked = F.when(F.contains(text, F.lit(NEEDED[kind])), marked).otherwise(text)
    return F.split(marked, OPEN)


def _located(parts: Column) -> Column:
    """array of struct(start, end, before, m) of the matches; ``before`` is what stands ahead of one, CONTEXT_CHARS at most.

    A fold over the parts carries the place and the last code points. It runs over blocks of BLOCK parts, as each
    step of a fold copies what it has gathered.
    """
    spans = "array<struct<start:int,end:int,before:string,m:string>>"

    def add(a, p):
        m = F.substring_index(p, SHUT, 1)
        span = F.struct(a["at"].alias("start"), (a["at"] + F.char_length(m)).alias("end"), a["tail"].alias("before"), m.alias("m"))
        tail = F.substring(F.concat(a["tail"], F.replace(p, F.lit(SHUT), F.lit(""))), F.lit(-CONTEXT_CHARS), F.lit(CONTEXT_CHARS))
        return F.struct((a["at"] + F.char_length(p) - 1).alias("at"), tail.alias("tail"), F.concat(a["spans"], F.array(span)).alias("spans"))

    def add_block(a, k):
        last, none = a["last"], F.array().cast(spans).alias("spans")
        block = F.aggregate(F.slice(parts, k * BLOCK + 2, F.lit(BLOCK)), F.struct(last["at"].alias("at"), last["tail"].alias("tail"), none), add)
        return F.struct(block.alias("last"), F.concat(a["out"], F.array(last["spans"])).alias("out"))

    first = F.struct(F.char_length(parts[0]).alias("at"), F.substring(parts[0], F.lit(-CONTEXT_CHARS), F.lit(CONTEXT_CHARS)).alias("tail"), F.array().cast(spans).alias("spans"))
    start = F.struct(first.alias("last"), F.array().cast(f"array<{spans}>").alias("out"))
    blocks = F.sequence(F.lit(0), F.floor((F.size(parts) - 2) / BLOCK).cast("int"))
    found = F.aggregate(blocks, start, add_block, lambda a: F.flatten(F.concat(a["out"], F.array(a["last"]["spans"]))))
    return F.when(F.size(parts) > 1, found).otherwise(F.array().cast(spans))


def _judged(kind: str, located: Column) -> Column:
    """array of struct(kind, start, end, score): the valid ones of ``located``, score in hundredths."""
    def score(s):
        near = F.lower(s["before"]).rlike(f"(^|[^a-z])({CONTEXT})([^a-z]|$)")
        return F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), (F.lit(80 if kind in ("card", "iban") else 50) + F.when(near, 20).otherwise(0)).alias("score"))

    return F.transform(F.filter(located, lambda s: _valid(kind, s["m"])), score)


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, spans: array of struct(kind, start, end, score)), a row for each row; spans by kind as in KINDS, then start."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    text = F.replace(F.replace(text, F.lit(OPEN), F.lit(OTHER)), F.lit(SHUT), F.lit(OTHER))
    plain = docs.select(F.col(id_col).alias("id"), text.alias("text"))
    # each step's columns are used more than once by the next, so that Spark keeps them instead of computing them anew
    parts = plain.select("id", *[_parts(k, F.col("text")).alias(k) for k in KINDS])
    return parts.select(F.col("id").alias(id_col), F.concat(*[_judged(k, _located(F.col(k))) for k in KINDS]).alias("spans"))


def listed(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
