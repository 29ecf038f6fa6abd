"""Personal data in texts: patterns propose spans, checksums confirm them, context words adjust the score.

Kinds: email; ip (each part at most 255); card (13 to 19 digits that pass Luhn); phone (9 to 15 digits); iban,
which mod 97 confirms; and number (a bare identity, account or passport number). A span's score is its kind's base
plus CONTEXT_GAIN if a word of its kind stands within the CONTEXT characters before it (and after the match before
it). Spans of the first four kinds stay whatever their score. The others need MIN_SCORE, and there context decides:
an iban in a length that no country uses or in small groups is one only after such a word, a bare number never is
one without.

All of it is DataFrame functions, so nothing leaves the JVM and nothing is shuffled. Groups that repeat
are possessive and starts are bounded by look-behind, which finds the same spans in one pass over runs of
any length. Defined results: null text counts as empty; empty text has no spans; repeated rows and null
ids are treated like any other; columns of any other names pass through ``annotate`` and ``redact``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import nullable_text
from .spans import apart, cut, listed, with_spans

KINDS = ("email", "ip", "card", "phone", "iban", "number")
BASE_KINDS = KINDS[:4]
CONTEXT, CONTEXT_GAIN, MIN_SCORE = 40, 0.3, 0.5
BASE_SCORE = {"email": 0.7, "ip": 0.5, "card": 0.6, "phone": 0.5, "iban": 0.4, "number": 0.3}
#: Score that a common form adds: an iban of a length in use, undivided or in fours.
FORM_GAIN, IBAN_LENGTHS = {"iban": 0.2}, (15, 16, 18, 19, 20, 21, 22, 23, 24, 25, 26, 27, 28, 29, 31)
CONTEXT_WORDS = {
    "email": "mail|contact|write|schreib|courriel|correo",
    "ip": "ip|addr|host|server|login",
    "card": "card|visa|master|credit|karte|carte|tarjeta",
    "phone": "phone|tel|call|mobile|fax|anruf|llam",
    "iban": "iban|bank|account|konto|compte|cuenta",
    "number": "ssn|social security|passport|account|identity|tax id|ausweis|steuernummer|konto|passeport|compte|pasaporte|cuenta|dni",
}
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9]){12,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"\b[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?:[\x20-][A-Z0-9]{2,5}){2,14}(?:[\x20-][A-Z0-9]{1,3})?)\b",
    "number": r"(?<![A-Za-z0-9+.@_-])(?:[0-9]{3}-[0-9]{2}-[0-9]{4}|[A-Z]{0,2}[0-9]{7,12})(?![A-Za-z0-9@_-]|\.[0-9])",
}


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _mod97(value: Column) -> Column:
    """Whether an account number passes mod 97: the first four characters moved behind, letters as 10 to 35."""
    plain = F.regexp_replace(value, "[ -]", "")
    chars = F.split(F.concat(F.substring(plain, 5, 40), F.substring(plain, 1, 4)), "")

    def step(acc: Column, c: Column) -> Column:
        code = F.ascii(c)
        return F.when(code < 48, acc).when(code < 58, (acc * 10 + code - 48) % 97).otherwise((acc * 100 + code - 55) % 97).cast("int")

    return F.length(plain).between(15, 34) & (F.aggregate(F.filter(chars, lambda c: c != ""), F.lit(0), step) == 1)


def _valid(kind: str, value: Column) -> Column | None:
    if kind == "ip":
        small = lambda p: (F.length(p) <= 3) & (F.coalesce(p.try_cast("int"), F.lit(0)) <= 255)
        return F.forall(F.split(value, r"\."), lambda p: small(F.regexp_replace(p, "^0+", "")))
    if kind == "card":
        return (F.length(_digits(value)) <= 19) & F.call_function("luhn_check", _digits(value))
    if kind == "phone":
        return F.length(_digits(value)).between(9, 15)
    if kind == "iban":
        return _mod97(value)
    return None


def _scored(kind: str):
    def of(s: Column) -> Column:
        near = F.lower(s["before"]).rlike(CONTEXT_WORDS[kind])
        score = F.lit(BASE_SCORE[kind]) + F.when(near, CONTEXT_GAIN).otherwise(0.0)
        if kind == "iban":
            usual = s["value"].rlike(r"^(?:[A-Z0-9]{4} )*[A-Z0-9]{1,4}$|^[A-Z0-9]+$") & F.length(F.regexp_replace(s["value"], "[ -]", "")).isin(*IBAN_LENGTHS)
            score += F.when(usual, FORM_GAIN[kind]).otherwise(0.0)
        return F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value"), score.alias("score"))

    return of


def annotate(docs: DataFrame, text: str = "text", out: str = "pii") -> DataFrame:
    """Add ``out``: array of (kind, start, end, value, score), by kind as listed and then by start."""
    kept = [c for c in docs.columns if c != out]
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in kept)).alias("row"), nullable_text(f"`{text}`").alias("text"))  # no name of theirs can clash
    needs = {"email": F.contains("text", F.lit("@")), "phone": F.contains("text", F.lit("+"))}
    rows = with_spans(rows, {k: (PATTERNS[k], needs.get(k)) for k in KINDS}, "text", CONTEXT)
    checked = {}
    for kind in KINDS:
        spans = F.col(kind)
        if _valid(kind, F.lit("")) is not None:
            spans = F.filter(spans, lambda s: _valid(kind, s["value"]))  # noqa: B023  built at once
        spans = F.transform(spans, _scored(kind))
        checked[kind] = spans if kind in BASE_KINDS else F.filter(spans, lambda s: s["score"] >= MIN_SCORE - 1e-9)
    rows = rows.withColumns(checked)
    # a bare number that is part of another span is no number of its own
    others = F.concat(*(F.col(k) for k in KINDS[:-1]))
    rows = rows.withColumn("number", F.filter("number", lambda s: ~F.exists(others, lambda o: (o["start"] < s["end"]) & (o["end"] > s["start"]))))
    return rows.select("row.*", F.concat(*(F.col(k) for k in KINDS)).alias(out))


def scan(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, the number of spans of each base kind, the digest of the base spans, all spans and their scores."""
    found = annotate(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    of = lambda *kinds: F.filter("pii", lambda s: s["kind"].isin(*kinds))
    return found.select(
        "doc_id", *(F.size(of(k)).cast("long").alias(f"n_{k}") for k in BASE_KINDS),
        F.sha2(listed(of(*BASE_KINDS)), 256).alias("base_sha256"), listed(F.col("pii")).alias("spans"), *(F.size(of(k)).cast("long").alias(f"n_{k}") for k in KINDS[4:]),
        F.array_join(F.transform("pii", lambda s: F.format_number(s["score"], 2)), ",").alias("scores"),
    )


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """The same rows with every span's text replaced by its kind in brackets; of overlapping spans the first counts."""
    found = annotate(docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("whole"), F.col(f"`{text}`").alias("text")))
    source = F.coalesce("text", F.lit(""))
    ordered = F.array_sort(F.transform("pii", lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("back"), s["end"].alias("end"), s["kind"].alias("kind"))))
    found = found.withColumn("taken", apart(ordered))
    taken = F.col("taken")
    gaps = F.zip_with(
        F.concat(F.array(F.lit(0)), F.transform(taken, lambda s: s["end"])), F.concat(F.transform(taken, lambda s: s["start"]), F.array(F.length(source))),
        lambda a, b: F.struct(a.alias("start"), b.alias("end")),
    )
    found = found.withColumn("gaps", F.when(F.size(taken) > 0, gaps))
    marks = F.concat(F.transform(taken, lambda s: F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]"))), F.array(F.lit("")))
    clean = F.when(F.size(taken) > 0, F.array_join(F.zip_with(cut(source, F.col("gaps")), marks, lambda t, m: F.concat(t, m)), "")).otherwise(F.col("text"))
    return found.select(*(clean.alias(c) if c == text else F.col("whole").getField(c).alias(c) for c in docs.columns))
