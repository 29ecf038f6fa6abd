"""Functors: user functions over relations, chosen by which parameters are bound.

A functor has a name, named parameters, and an implementation per binding pattern: ``b`` for a parameter that is
given and ``f`` for one that the implementation gives. Implementations are Column functions where Spark has the
expression, else vectorised UDFs made by the caller. ``range`` says how many results a row may have:
"." one, "?" at most one (null: none), "*" any number (an array of values or structs), "+" one or more, which is checked.

Summaries are functors over groups: they take summarised variables and configuration variables, which are constant in a
group, and give one value per output.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RANGES = (".", "?", "*", "+")


class FunctorError(ValueError):
    """A functor was declared or used against its rules."""


@dataclass
class Functor:
    name: str
    params: tuple[str, ...]
    patterns: dict[str, tuple[Callable[..., Column], str]] = field(default_factory=dict)

    def add(self, pattern: str, fn: Callable[..., Column], range_: str = ".") -> Functor:
        if len(pattern) != len(self.params) or set(pattern) - {"b", "f"}:
            raise FunctorError(f"{self.name}: {pattern} doesn't fit {self.params}")
        if range_ not in RANGES:
            raise FunctorError(f"{self.name}: unknown range {range_}")
        if "b" not in pattern:
            raise FunctorError(f"{self.name}: free parameters alone are not allowed")
        if "f" not in pattern and range_ != "?":
            raise FunctorError(f"{self.name}: a filter has at most one result")
        self.patterns[pattern] = (fn, range_)
        return self


@dataclass(frozen=True)
class Summary:
    """An aggregate functor: ``fn`` gets a Column per summarised and then per configuration variable, and gives one per output."""

    name: str
    summarised: int
    config: int
    outputs: int
    fn: Callable[..., tuple[Column, ...]]


class Functors:
    """A registry of functors and summaries by name."""

    def __init__(self) -> None:
        self._by_name: dict[str, Functor] = {}
        self._summaries: dict[str, Summary] = {}

    def summary(self, name: str, fn: Callable[..., tuple[Column, ...]], summarised: int = 1, config: int = 0, outputs: int = 1) -> Functors:
        if name in self._summaries:
            raise FunctorError(f"{name} is declared twice")
        if outputs < 1:
            raise FunctorError(f"{name}: a summary has an output")
        self._summaries[name] = Summary(name, summarised, config, outputs, fn)
        return self

    def summarise(self, df: DataFrame, name: str, over: list[str], out: list[str], group: list[str] = (), config: list[str] = (), apart: list[str] = ()) -> DataFrame:
        """(group, config, out) of the set of (group, config, over, apart) rows.

        A group that meets several configurations is summarised under each of them. ``apart`` names variables that keep
        equal values of ``over`` apart. Spark aggregates map-side first.
        """
        s = self._summaries.get(name)
        if s is None:
            raise FunctorError(f"unknown summary {name}")
        if (len(over), len(config), len(out)) != (s.summarised, s.config, s.outputs):
            raise FunctorError(f"{name} takes {s.summarised} variables and {s.config} of configuration and gives {s.outputs}")
        keys = [*group, *config]
        rows = df.select(*keys, *over, *apart).distinct()
        got = s.fn(*(F.col(v) for v in over), *(F.col(c) for c in config))
        return rows.groupBy(*keys).agg(*(c.alias(o) for c, o in zip(got, out)))

    def declare(self, name: str, *params: str, impure: bool = False) -> Functor:
        if impure:
            raise FunctorError(f"{name}: impure functors are not supported")
        found = self._by_name.setdefault(name, Functor(name, params))
        if found.params != params:
            raise FunctorError(f"{name} is declared again with other parameters")
        return found

    def _choose(self, name: str, args: tuple[Any, ...], bound: set[str]) -> tuple[Callable, str, str]:
        functor = self._by_name.get(name)
        if functor is None:
            raise FunctorError(f"unknown functor {name}")
        for pattern, (fn, range_) in functor.patterns.items():
            if all(p == "f" or not isinstance(a, str) or a in bound for p, a in zip(pattern, args)):
                return fn, range_, pattern
        raise FunctorError(f"{name}: no declared pattern fits {args} with {sorted(bound)} bound")

    def apply(self, df: DataFrame, name: str, *args: Any, negated: bool = False) -> DataFrame:
        """Rows of df joined with the functor's results; args are variables (strings) or Const values.

        A free parameter that is bound already is compared with the result. Negated: rows that have no result.
        """
        fn, range_, pattern = self._choose(name, args, set(df.columns))
        given = [F.col(a) if isinstance(a, str) else F.lit(a.value) for a, p in zip(args, pattern) if p == "b"]
        result = fn(*given)
        free = [a for a, p in zip(args, pattern) if p == "f"]
        if negated and range_ in (".", "+"):
            raise FunctorError(f"{name}: a functor that always has a result can't be negated")
        if not free:
            keep = F.coalesce(result, F.lit(False))
            return df.where(~keep if negated else keep)
        if negated:
            return df.where(F.size(F.coalesce(result, F.array())) == 0 if range_ == "*" else result.isNull())
        if range_ == "+":
            result = F.when(F.size(result) > 0, result).otherwise(F.raise_error(F.lit(f"{name}: no result where one or more are promised")))
        df = df.withColumn("_r", F.explode(result) if range_ in ("*", "+") else result)
        if range_ == "?":
            df = df.where(F.col("_r").isNotNull())
        for i, a in enumerate(free):
            value = F.col("_r") if len(free) == 1 else F.col("_r").getField(df.schema["_r"].dataType.names[i])
            if not isinstance(a, str):
                df = df.where(value == F.lit(a.value))
            elif a in df.columns:
                df = df.where(value == F.col(a))
            else:
                df = df.withColumn(a, value)
        return df.drop("_r")


def builtin() -> Functors:
    """Functors that are Spark expressions: arithmetic, strings, paths, lists."""
    f = Functors()
    add = f.declare("add", "a", "b", "sum")
    add.add("bbf", lambda a, b: a + b).add("bfb", lambda a, s: s - a).add("fbb", lambda b, s: s - b)
    f.declare("sub", "a", "b", "difference").add("bbf", lambda a, b: a - b)
    f.declare("mul", "a", "b", "product").add("bbf", lambda a, b: a * b)
    f.declare("div", "a", "b", "quotient").add("bbf", lambda a, b: F.call_function("div", a, F.nullif(b, F.lit(0).cast("long"))), "?")
    f.declare("mod", "a", "b", "rest").add("bbf", lambda a, b: F.when(b != 0, F.pmod(a, F.when(b != 0, b))), "?")
    f.declare("to_bool", "n", "flag").add("bf", lambda n: n != 0)
    f.declare("concat", "a", "b", "joined").add("bbf", lambda a, b: F.concat(a, b))
    f.declare("join_path", "dir", "name", "path").add("bbf", lambda d, n: F.concat_ws("/", d, n))
    f.declare("parent_dir", "path", "dir").add("bf", lambda p: F.nullif(F.regexp_extract(p, r"^(.*)/[^/]+$", 1), F.lit("")), "?")
    f.declare("length", "text", "n").add("bf", lambda t: F.length(t).cast("long"))
    f.declare("lower", "text", "lowered").add("bf", F.lower)
    f.declare("starts_with", "text", "prefix").add("bb", lambda t, p: t.startswith(p), "?")
    f.declare("contains", "text", "part").add("bb", lambda t, p: F.contains(t, p), "?")
    f.declare("word", "text", "w").add("bf", lambda t: F.filter(F.split(t, r"\s+"), lambda w: w != ""), "*")
    f.declare("enumerate", "list", "position", "item").add("bff", lambda xs: F.transform(xs, lambda x, i: F.struct(i.cast("long").alias("position"), x.alias("item"))), "*")
    f.declare("list_of", "item", "list").add("bf", lambda x: F.array(x))
    f.declare("append", "list", "item", "longer").add("bbf", F.array_append)
    f.declare("prepend", "item", "list", "longer").add("bbf", lambda x, xs: F.array_prepend(xs, x))
    f.declare("concat_list", "a", "b", "joined").add("bbf", lambda a, b: F.concat(a, b))
    f.declare("min_max", "a", "b", "low", "high").add("bbff", lambda a, b: F.struct(F.least(a, b).alias("low"), F.greatest(a, b).alias("high")))
    f.declare("piece", "text", "separator", "part").add("bbf", lambda t, s: F.call_function("split", t, F.concat(F.lit("\\Q"), s, F.lit("\\E"))), "+")
    f.summary("count", lambda x: (F.count("*"),)).summary("sum", lambda x: (F.sum(x),)).summary("min_max", lambda x: (F.min(x), F.max(x)), outputs=2)
    f.summary("share_above", lambda x, limit: (F.count_if(x > limit), F.count("*")), config=1, outputs=2)
    f.declare("parse_long", "text", "n").add("bf", lambda t: t.try_cast("long"), "?")
    return f
