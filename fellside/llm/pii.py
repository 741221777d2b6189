"""Operator 5, personal data: patterns propose, checksums confirm, context words adjust the score.

Base kinds are email, ip, card and phone. The method adds two: ``iban`` (confirmed by the remainder of 97) and
``ssn`` (three, two and four digits, which only words nearby can confirm). Base spans are always kept; an added
span is kept if its score reaches ``ACCEPT``. A score is the kind's prior, plus what its checksum and a context
word in the ``NEAR`` characters before or behind it (up to the next span of its kind) are worth.

A text's matches are the strings that the pattern extracts; their places follow from what lies between them,
which splitting by the same pattern gives. Patterns are written so that Java's engine neither recurses nor
goes back over a run of characters: repeated groups are possessive where nothing follows them that could
need what they took, and a match can only start at the first character of its run or where the last match
ended (``\\G``). So a text of one endless number or word takes linear time. A pattern runs only on texts that
hold what each of its matches must hold, and splitting only on texts that match.

DataFrame functions only; nothing is shuffled, and each row is worked on alone, whole.

Defined results: a null text is the empty text and has no spans; matches that fail their check are dropped and
not searched again; spans of different kinds may overlap; starts and ends count code points; repeated rows
and null identifiers are rows like any other; an empty table gives no rows; other columns aren't looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import computed, picked, table, text_or_empty

# Kinds in their order, patterns, context words and scores.
BASE_KINDS = ("email", "ip", "card", "phone")
ADDED_KINDS = ("iban", "ssn")
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}+|(?:\x20[A-Z0-9]{4}){2,7}+(?:\x20[A-Z0-9]{1,3}+)?)(?![A-Za-z0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
}
NEEDS = {"email": "@", "ip": ".", "card": r"[0-9][\x20-]?[0-9]", "phone": "+", "iban": "[0-9][0-9]", "ssn": "-"}
CONTEXT = {
    "email": r"\b(?:e-?mail|mail|contact|write)\b",
    "ip": r"\b(?:ip|host|server|address|client)\b",
    "card": r"\b(?:card|visa|credit|debit|amex|mastercard|payment)\b",
    "phone": r"\b(?:phone|tel|call|mobile|fax|whatsapp)\b",
    "iban": r"\b(?:iban|account|bank|konto|compte|cuenta)\b",
    "ssn": r"\b(?:ssn|social security|social insurance)\b",
}
PRIOR = {"email": 0.8, "ip": 0.6, "card": 0.4, "phone": 0.5, "iban": 0.3, "ssn": 0.3}
CHECKED = {"email": 0.0, "ip": 0.1, "card": 0.4, "phone": 0.1, "iban": 0.4, "ssn": 0.1}
CONTEXT_GAIN = 0.3
NEAR = 48
ACCEPT = 0.6

_BLOCK = 64


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes: every second from the right counts double, nines cast out."""
    doubled = lambda d: F.when(d > 4, d * 2 - 9).otherwise(d * 2)
    marks = F.split(F.reverse(digits), "")
    value = lambda d, i: F.when(i % 2 == 1, doubled(F.try_to_number(d, F.lit("9")).cast("int"))).otherwise(F.try_to_number(d, F.lit("9")).cast("int"))
    return F.aggregate(F.transform(marks, value), F.lit(0), lambda a, d: a + d) % 10 == 0


def mod97(iban: Column) -> Column:
    """Whether an IBAN, its first four characters moved to the end and letters read as 10 to 35, leaves 1."""
    text = F.replace(iban, F.lit(" "), F.lit(""))
    marks = F.split(F.concat(F.substr(text, F.lit(5)), F.substr(text, F.lit(1), F.lit(4))), "")
    step = lambda a, c: F.when(F.ascii(c) < 65, (a * 10 + F.ascii(c) - 48) % 97).otherwise((a * 100 + F.ascii(c) - 55) % 97)
    return F.aggregate(marks, F.lit(0), step) == 1


def _valid(kind: str, m: Column) -> Column:
    if kind == "ip":
        small = lambda p: F.length(F.regexp_replace(p, "^0+", "")) <= 3
        fits = lambda p: F.coalesce(F.try_to_number(F.right(p, F.lit(3)), F.lit("999")).cast("int"), F.lit(0)) <= 255
        return F.forall(F.split(m, r"\."), lambda p: small(p) & fits(p))
    if kind == "card":
        n = F.length(_digits(m))
        return F.when((n >= 12) & (n <= 19), luhn(_digits(m))).otherwise(F.lit(False))
    if kind == "phone":
        return F.length(_digits(m)).between(9, 15)
    if kind == "iban":
        return mod97(m)
    if kind == "ssn":
        return ~m.rlike("^(?:000|666|9)") & ~m.rlike("-00-") & ~m.rlike("-0000$")
    return F.lit(True)


def _hits(kind: str, text: Column) -> Column:
    needs = text.rlike(NEEDS[kind]) if kind in ("card", "iban") else F.contains(text, F.lit(NEEDS[kind]))
    return F.when(needs, F.regexp_extract_all(text, F.lit(PATTERNS[kind]), F.lit(0))).otherwise(F.array().cast("array<string>"))


def find_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, spans: array of kind, start, end (code points, end exclusive), score, base; by start, then kind."""
    kinds = (*BASE_KINDS, *ADDED_KINDS)
    empty = F.array().cast("array<string>")
    df = picked(docs, id_col, text_col).select(F.col(id_col), text_or_empty(text_col).alias("_t"))
    df = computed(df, *[_hits(k, F.col("_t")).alias(f"_h_{k}") for k in kinds])
    df = computed(df, *[F.when(F.size(f"_h_{k}") > 0, F.split("_t", PATTERNS[k], -1)).otherwise(empty).alias(f"_s_{k}") for k in kinds]).drop("_t")
    # what each match and the text before it take; sums over blocks of matches; sums of blocks
    df = computed(df, *[F.zip_with(F.slice(f"_s_{k}", 1, F.size(f"_h_{k}")), f"_h_{k}", lambda a, b: (F.length(a) + F.length(b)).cast("long")).alias(f"_l_{k}") for k in kinds])
    add = lambda a, b: a + b
    zero = F.lit(0).cast("long")

    def block_sums(k: str) -> Column:
        last = F.floor(F.greatest(F.size(f"_h_{k}") - 1, F.lit(0)) / _BLOCK).cast("int")
        return F.transform(F.sequence(F.lit(0), last), lambda c: F.aggregate(F.slice(f"_l_{k}", c * _BLOCK + 1, F.lit(_BLOCK)), zero, add))

    def block_starts(k: str) -> Column:
        return F.transform(f"_b_{k}", lambda _, c: F.aggregate(F.slice(f"_b_{k}", F.lit(1), c), zero, add))

    df = computed(df, *[block_sums(k).alias(f"_b_{k}") for k in kinds])
    df = computed(df, *[block_starts(k).alias(f"_o_{k}") for k in kinds])

    def spans(rank: int, k: str) -> Column:
        def one(m: Column, i: Column) -> Column:
            block = F.floor(i / _BLOCK).cast("int")
            gap = F.element_at(f"_s_{k}", i + 1)
            start = F.element_at(f"_o_{k}", block + 1) + F.aggregate(F.slice(f"_l_{k}", block * _BLOCK + 1, i % _BLOCK), zero, add) + F.length(gap)
            behind = F.element_at(f"_s_{k}", i + 2)
            near = F.lower(F.right(gap, F.lit(NEAR))).rlike(CONTEXT[k]) | F.lower(F.left(behind, F.lit(NEAR))).rlike(CONTEXT[k])
            score = F.lit(PRIOR[k] + CHECKED[k]) + F.when(near, F.lit(CONTEXT_GAIN)).otherwise(F.lit(0.0))
            return F.struct(start.alias("start"), F.lit(rank).alias("rank"), F.lit(k).alias("kind"), (start + F.length(m)).alias("end"), F.least(score, F.lit(1.0)).alias("score"), F.lit(k in BASE_KINDS).alias("base"), _valid(k, m).alias("valid"))

        return F.filter(F.transform(f"_h_{k}", one), lambda x: x["valid"] & (x["base"] | (x["score"] >= ACCEPT)))

    df = df.select(id_col, *[spans(r, k).alias(f"_x_{k}") for r, k in enumerate(kinds)])
    found = F.array_sort(F.concat(*[F.col(f"_x_{k}") for k in kinds]))
    return df.select(id_col, F.transform(found, lambda x: x.dropFields("rank", "valid")).alias("spans"))


def as_text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def op5_pii(spark, sf_dir: str) -> DataFrame:
    found = find_spans(table(spark, sf_dir, "documents"))
    count = lambda k: F.size(F.filter("spans", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    base = F.filter("spans", lambda x: x["base"])
    return found.select("doc_id", *[count(k) for k in BASE_KINDS], F.sha2(as_text(base).cast("binary"), 256).alias("base_sha256"), as_text(F.col("spans")).alias("spans"))
