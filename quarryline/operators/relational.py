"""Set-semantics relational operators over DataFrames whose columns are named by logical variables.

A relation is a DataFrame without duplicate rows and without nulls. ``atom`` reads one under variable names;
operators combine what has variables in common; ``head`` projects and makes a set again. All of them only build
Spark plans, so Catalyst and AQE choose join strategies, push filters and prune columns.
"""

from __future__ import annotations

import operator
from collections.abc import Callable, Iterable
from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ANY = None  # a wildcard term


@dataclass(frozen=True)
class Const:
    """A constant term."""

    value: Any


class UnrelatedError(ValueError):
    """Operands share no variable and no product was asked for."""


def relation(df: DataFrame) -> DataFrame:
    """A set of rows without nulls: there is no null among facts, so anti-joins and equality agree with negation."""
    return df.dropna("any").distinct()


def facts(spark: SparkSession, schema: str, *rows: tuple) -> DataFrame:
    """A relation of constant rows."""
    return spark.createDataFrame(list(rows), schema).distinct()


def _value(term: Any) -> Column:
    return F.lit(term.value) if isinstance(term, Const) else F.col(term)


def atom(df: DataFrame, *terms: str | Const | None) -> DataFrame:
    """Rows of ``df`` under the variables ``terms``, one per column, in order.

    A Const keeps the rows with that value, a variable named twice those whose columns are equal, ANY drops a column.
    The result may hold a row more than once if columns were dropped; ``head`` and ``negate`` don't mind.
    """
    if len(terms) != len(df.columns):
        raise ValueError(f"{len(df.columns)} terms are needed for {df.columns}, not {len(terms)}")
    seen: dict[str, str] = {}
    for name, term in zip(df.columns, terms):
        c = F.col(f"`{name}`")
        if isinstance(term, Const):
            df = df.where(c == F.lit(term.value))
        elif term is not None and term in seen:
            df = df.where(c == F.col(f"`{seen[term]}`"))
        elif term is not None:
            seen[term] = name
    return df.select(*(F.col(f"`{name}`").alias(var) for var, name in seen.items())) if seen else df.select(F.lit(True).alias("_there"))


def where(df: DataFrame, left: str | Const, op: str, right: str | Const) -> DataFrame:
    """Rows that compare; op is one of = != < >. Strings compare by their UTF-8 bytes, unsigned."""
    a, b = _value(left), _value(right)
    tests = {"=": a == b, "!=": a != b, "<": a < b, ">": a > b}
    if op not in tests:
        raise ValueError(f"unknown comparison {op}")
    if left == right and op != "=":
        raise ValueError(f"{left} {op} {right} never holds")
    if isinstance(left, Const) and isinstance(right, Const):
        ordered = {"=": operator.eq, "!=": operator.ne, "<": operator.lt, ">": operator.gt}
        if not ordered[op](left.value, right.value):
            raise ValueError(f"{left.value!r} {op} {right.value!r} never holds")
        return df
    return df.where(tests[op])


def unify(df: DataFrame, keep: str, other: str) -> DataFrame:
    """Rows in which two variables are equal, with one column for both."""
    return df.where(F.col(keep) == F.col(other)).drop(other)


def assign(df: DataFrame, var: str, value: Any) -> DataFrame:
    """Bind a variable to a constant; if it is bound already, keep the rows that agree."""
    return df.where(F.col(var) == F.lit(value)) if var in df.columns else df.withColumn(var, F.lit(value))


def holds(df: DataFrame, var: str, positive: bool = True) -> DataFrame:
    """A boolean variable as a condition."""
    return df.where(F.col(var) if positive else ~F.col(var))


def join(*operands: DataFrame) -> DataFrame:
    """Equi-join on all variables that operands share, two at a time, each with one that it is related to."""
    rest = list(operands)
    out = rest.pop(0)
    while rest:
        found = next((d for d in rest if set(d.columns) & set(out.columns)), None)
        if found is None:
            raise UnrelatedError(f"{out.columns} and {[d.columns for d in rest]} share no variable; use product()")
        rest.remove(found)
        out = out.join(found, [c for c in out.columns if c in found.columns], "inner")
    return out


def product(*operands: DataFrame) -> DataFrame:
    """Cross product, for operands that are known to be small; variables must differ."""
    def cross(a: DataFrame, b: DataFrame) -> DataFrame:
        if shared := set(a.columns) & set(b.columns):
            raise ValueError(f"operands share {sorted(shared)}; use join()")
        return a.crossJoin(b)

    return reduce(cross, operands)


#: Rows of one key that a block of ``block_join`` has, about; pairs that a task makes, about; tasks at most.
BLOCK_ROWS, TASK_PAIRS, TASKS = 2_000, 4_000_000, 20_000


def block_join(left: DataFrame, right: DataFrame, on: str) -> DataFrame:
    """Equi-join on one variable whose keys have many rows on both sides, so that the result is far larger than both.

    A key's rows are cut into blocks on either side and each pair of blocks is joined apart: a task holds a few blocks
    and makes about TASK_PAIRS rows, however many a key has. Rows go once to each block of the other side, so what is shuffled is
    the result's number of rows over BLOCK_ROWS. Operands are read twice.
    """
    per_key = lambda d, n: d.where(F.col(on).isNotNull()).groupBy(on).agg(F.count("*").alias(n))
    blocks = per_key(left, "_l").join(per_key(right, "_r"), on)
    pairs = blocks.agg(F.coalesce(F.sum(F.col("_l").cast("double") * F.col("_r")), F.lit(0.0))).first()[0]
    blocks = blocks.select(on, *(F.ceil(F.col(c) / BLOCK_ROWS).cast("int").alias(c) for c in ("_l", "_r")))
    tasks = int(min(TASKS, max(1, pairs // TASK_PAIRS)))

    def dealt(d: DataFrame, own: str, others: str, i: str, j: str) -> DataFrame:
        mine = F.pmod(F.xxhash64(*(F.col(f"`{c}`") for c in d.columns)), F.col(own)).cast("int")
        out = d.join(blocks, on).select(*d.columns, mine.alias(i), F.explode(F.sequence(F.lit(0), F.col(others) - 1)).alias(j))
        return out.repartition(tasks, on, "_i", "_j")

    return dealt(left, "_l", "_r", "_i", "_j").join(dealt(right, "_r", "_l", "_j", "_i").hint("shuffle_hash"), [on, "_i", "_j"]).drop("_i", "_j")


def pairs_sharing(rows: DataFrame, item: str, key: str, first: str, second: str) -> DataFrame:
    """The set of pairs (first, second) of different items that have a key in common.

    Items that share several keys are paired at the least of them alone, so the pairs need not be made distinct: they are
    not shuffled. An item's keys are held as one array.
    """
    rows = relation(rows.select(item, key))
    rows = rows.join(rows.groupBy(item).agg(F.collect_set(key).alias("_keys")), item)
    side = lambda var, keys: rows.select(F.col(item).alias(var), key, F.col("_keys").alias(keys))
    once = (F.size("_a") == 1) | (F.size("_b") == 1) | (F.array_min(F.array_intersect("_a", "_b")) == F.col(key))
    return block_join(side(first, "_a"), side(second, "_b"), key).where(F.col(first) != F.col(second)).where(once).select(first, second)


def semi(df: DataFrame, other: DataFrame) -> DataFrame:
    """Rows with a match among ``other`` on the shared variables; what a join projected to one side gives."""
    return df.join(other, _shared(df, other), "left_semi")


def negate(df: DataFrame, other: DataFrame) -> DataFrame:
    """Rows without a match in ``other``. Its variables must be bound; wildcards and constants are the atom's own."""
    if unbound := set(other.columns) - set(df.columns) - {"_there"}:
        raise ValueError(f"negation needs {sorted(unbound)} bound")
    return gate(df, other, positive=False) if "_there" in other.columns else df.join(other, _shared(df, other), "left_anti")


def _shared(df: DataFrame, other: DataFrame) -> list[str]:
    shared = [c for c in df.columns if c in other.columns]
    if not shared:
        raise UnrelatedError(f"{df.columns} and {other.columns} share no variable")
    return shared


def gate(df: DataFrame, condition: DataFrame, positive: bool = True) -> DataFrame:
    """All rows if the condition has a row (or has none), otherwise no row. One row at most is sent around."""
    flag = F.broadcast(condition.select(F.lit(1).alias("_gate")).limit(1))
    return df.withColumn("_gate", F.lit(1)).join(flag, "_gate", "left_semi" if positive else "left_anti").drop("_gate")


def head(df: DataFrame, *terms: str | Const, names: Iterable[str] | None = None) -> DataFrame:
    """The rule's head: a set of the terms' values, under ``names`` or the variables' own."""
    names = list(names or [t if isinstance(t, str) else f"c{i}" for i, t in enumerate(terms)])
    return df.select(*(_value(t).alias(n) for t, n in zip(terms, names))).distinct()


def union(*bodies: DataFrame) -> DataFrame:
    """Set union by position of several bodies of one head."""
    return reduce(lambda a, b: a.union(b), bodies).distinct()


def intersect(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.intersect(b)


def minus(a: DataFrame, b: DataFrame) -> DataFrame:
    """The set of rows of a that are not in b, by position."""
    return a.subtract(b)


def literal(df: DataFrame, flag: bool) -> DataFrame:
    """A body of ``true`` or ``false`` beside others: all rows, or none."""
    return df if flag else df.where(F.lit(False))


def truth(spark: SparkSession, flag: bool = True) -> DataFrame:
    """A body of ``true`` or ``false`` alone: one row without variables, or none. ``head`` takes constants from it."""
    return literal(spark.range(1).select(F.lit(True).alias("_there")), flag)


def aggregate(df: DataFrame, group: Iterable[str], over: Iterable[str], **summaries: Column) -> DataFrame:
    """Summaries of the set of (group, over) rows: variables that are in neither are gone before counting.

    With ``over`` naming only the summed variable, equal values of a group count once; name a key to keep them apart.
    Spark sums map-side first, so a hot group costs no more than its distinct rows.
    """
    group, over = list(group), list(over)
    rows = df.select(*group, *over).distinct()
    return rows.groupBy(*group).agg(*(c.alias(n) for n, c in summaries.items()))


def keyed_merge(proposals: DataFrame, keys: Iterable[str], value: str, merge: str | Callable[[Any, Any], Any], order: str | None = None) -> DataFrame:
    """One value per key, merged from all proposed ones.

    merge names an associative function (min, max, sum, any, all, and first and last in the order of the column
    ``order``, ties by value), which is combined map-side, so a hot key costs no more than others. Or it is a Python
    function (old, proposed) of another kind, folded in the order of ``order``: one key's fold can't be split, so it is
    one task's work, but keeps one value and reads its proposals as Arrow batches of the shuffle's sorted order.
    """
    keys = list(keys)
    if merge in ("first", "last") or not isinstance(merge, str):
        if order is None:
            raise ValueError("a merge that isn't commutative needs an order")
    if isinstance(merge, str):
        named = {"min": F.min, "max": F.max, "sum": F.sum, "any": F.bool_or, "all": F.bool_and}
        ends = {"first": F.min_by, "last": F.max_by}
        summary = ends[merge](value, F.struct(order, value)) if merge in ends else named[merge](value)
        return proposals.groupBy(*keys).agg(summary.alias(value))
    schema = proposals.select(*keys, value).schema

    def fold(batches):
        import pyarrow as pa

        last, acc, kinds = None, None, None
        for batch in batches:
            kinds, out = batch.schema, []
            *key_columns, values = (batch.column(i).to_pylist() for i in range(len(keys) + 1))  # not pandas: nulls and long numbers stay what they are
            for *key, proposed in zip(*key_columns, values):
                if key == last:
                    acc = merge(acc, proposed)
                else:
                    if last is not None:
                        out.append((*last, acc))
                    last, acc = key, proposed
            yield pa.record_batch([pa.array([r[i] for r in out], kinds.field(i).type) for i in range(len(keys) + 1)], names=[*keys, value])
        if last is not None:
            row = (*last, acc)
            yield pa.record_batch([pa.array([row[i]], kinds.field(i).type) for i in range(len(keys) + 1)], names=[*keys, value])

    # sorted within partitions: a key's proposals arrive in order, in batches, never all at once in memory
    dealt = proposals.select(*keys, value, F.col(order).alias("_order")).repartition(*keys).sortWithinPartitions(*keys, "_order")
    return dealt.select(*keys, value).mapInArrow(fold, schema)


def lookup(df: DataFrame, **bound: Any) -> DataFrame:
    """A query with some parameters bound: equality filters, which reach the scan below."""
    return reduce(lambda d, kv: d.where(F.col(kv[0]) == F.lit(kv[1])), bound.items(), df)


def exists(df: DataFrame, **bound: Any) -> bool:
    """A query with its parameters bound: whether there is a match. Stops at the first."""
    return not lookup(df, **bound).isEmpty()


def first(df: DataFrame) -> DataFrame:
    """One match: the least in the order of all columns, so that it is the same in every run."""
    return df.orderBy(*df.columns).limit(1)
