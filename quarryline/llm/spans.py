"""Positions of regular-expression matches with DataFrame functions alone.

Spark gives the matches of a pattern, and the text between them by ``split``; a running sum over the lengths
of both places every match. The sum runs over blocks of matches, so that a text with very many of them
costs little more than in proportion. Positions are in code points, ends exclusive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK = 256
SPAN = "struct<start:int,end:int,value:string,before:string>"


def _sql(pattern: str) -> str:
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _between(found: Column, pieces: Column, context: int) -> Column:
    """Spans of the matches ``found`` among ``pieces``, one more than matches."""
    none = F.array().cast(f"array<{SPAN}>")

    def one(acc: Column, i: Column) -> Column:
        piece, value = F.element_at(pieces, i), F.element_at(found, i)
        start = acc["at"] + F.length(piece)
        span = F.struct(start.alias("start"), (start + F.length(value)).alias("end"), value.alias("value"), F.expr("''").alias("before") if not context else F.right(piece, F.lit(context)).alias("before"))
        return F.struct((start + F.length(value)).alias("at"), F.concat(acc["got"], F.array(span).cast(f"array<{SPAN}>")).alias("got"))

    def block(acc: Column, first: Column) -> Column:
        inner = F.aggregate(
            F.sequence(first, F.least(first + BLOCK - 1, F.size(found))),
            F.struct(acc["at"].alias("at"), none.alias("got")), one,
        )
        # one-element concat keeps the blocks apart until the end
        return F.struct(inner["at"].alias("at"), F.concat(acc["all"], F.array(inner["got"])).alias("all"))

    start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<array<{SPAN}>>").alias("all"))
    blocks = F.aggregate(F.sequence(F.lit(1), F.size(found), F.lit(BLOCK)), start, block, lambda acc: F.flatten(acc["all"]))
    return F.when(F.size(found) > 0, blocks).otherwise(none)


def with_spans(df: DataFrame, patterns: dict[str, tuple[str, Column | None]], text: str, context: int = 0) -> DataFrame:
    """Add a column of spans per name of ``patterns``: (pattern, a cheap condition without which nothing matches)."""
    found = {}
    for name, (pattern, needs) in patterns.items():
        all_ = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
        found[f"_m_{name}"] = all_ if needs is None else F.when(needs, all_).otherwise(F.array().cast("array<string>"))
    df = df.withColumns(found)
    df = df.withColumns({f"_p_{n}": F.when(F.size(f"_m_{n}") > 0, F.split(text, pattern, -1)) for n, (pattern, _) in patterns.items()})
    df = df.withColumns({n: _between(F.col(f"_m_{n}"), F.col(f"_p_{n}"), context) for n in patterns})
    return df.drop(*(f"_{k}_{n}" for n in patterns for k in "mp"))


def listed(spans: Column) -> Column:
    """kind:start:end of spans (with a kind field), comma-joined in their order."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def cut(text: Column, spans: Column) -> Column:
    """Array of the parts of a text under spans (start, end), which ascend and don't overlap.

    Each cut walks the text from its start, so spans are cut from parts of about sqrt(n) spans that are cut before.
    """
    n = F.size(spans)
    step = F.greatest(F.ceil(F.sqrt(n)).cast("int"), F.lit(1))

    def part(first: Column) -> Column:
        own = F.slice(spans, first + 1, step)
        base, end = F.element_at(own, 1)["start"], F.element_at(own, -1)["end"]
        return F.struct(F.substr(text, base + 1, end - base).alias("text"), base.alias("base"), own.alias("spans"))

    one = lambda p: lambda s: F.substr(p["text"], s["start"] - p["base"] + 1, s["end"] - s["start"])
    parts = F.transform(F.sequence(F.lit(0), n - 1, step), part)
    return F.when(n > 0, F.flatten(F.transform(parts, lambda p: F.transform(p["spans"], one(p))))).otherwise(F.array().cast("array<string>"))


def apart(spans: Column) -> Column:
    """Of spans (start, end, kind) in order, those that don't overlap one that is taken before."""
    kinds = "struct<start:int,end:int,kind:string>"
    none = F.array().cast(f"array<{kinds}>")

    def one(acc: Column, s: Column) -> Column:
        free = s["start"] >= acc["at"]
        more = F.array(F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))).cast(f"array<{kinds}>")
        return F.struct(F.when(free, s["end"]).otherwise(acc["at"]).alias("at"), F.when(free, F.concat(acc["got"], more)).otherwise(acc["got"]).alias("got"))

    def block(acc: Column, first: Column) -> Column:
        inner = F.aggregate(F.slice(spans, first, F.lit(BLOCK)), F.struct(acc["at"].alias("at"), none.alias("got")), one)
        return F.struct(inner["at"].alias("at"), F.concat(acc["all"], F.array(inner["got"])).alias("all"))

    start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<array<{kinds}>>").alias("all"))
    return F.when(F.size(spans) > 0, F.aggregate(F.sequence(F.lit(1), F.size(spans), F.lit(BLOCK)), start, block, lambda acc: F.flatten(acc["all"]))).otherwise(none)
