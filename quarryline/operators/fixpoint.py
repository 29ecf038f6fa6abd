"""Recursion to a fixpoint by semi-naive rounds.

Rules are functions from a ``Reader`` of relations to a DataFrame. A rule that reads recursive relations k times runs k
times a round: the i-th time its i-th reading gives the last round's new rows and its other readings give all rows
(those before the i-th with the new rows, those after it without), so every derivation that uses a new row is made
and no other. New rows are checkpointed each round, which cuts the lineage and lets a lost executor's part be read
again; all rows are the union of those checkpoints, gathered anew now and then to keep plans short.

Few new rows (FEW at most, counted) are broadcast, so that a round costs a scan of what is there already and no shuffle
of it.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Reader:
    """How a rule reads relations: ``r(name)``, ``r.settled(name)`` for what must be complete before it is read, or
    ``r.never(name)`` for what is complete and, by promise, will never take a derived row away.

    Negation, aggregation and keyed merges need settled relations. A program finds such readings by itself (see
    ``safety``); everything else may see a relation grow.
    """

    def __init__(self, now: Callable[[str], DataFrame], settled: Callable[[str], DataFrame] | None = None, never: Callable[[str], DataFrame] | None = None):
        self._now, self._settled = now, settled or now
        self._never = never or self._settled

    def __call__(self, name: str) -> DataFrame:
        return self._now(name)

    def settled(self, name: str) -> DataFrame:
        return self._settled(name)

    def never(self, name: str) -> DataFrame:
        return self._never(name)


Rule = Callable[[Reader], DataFrame]

#: Rounds; parts that make a gathering; rows that may be broadcast; rows from which on scanning beats shuffling.
MAX_ROUNDS, GATHER, FEW, MANY = 1000, 8, 50_000, 200_000


class DivergenceError(RuntimeError):
    """A recursion didn't settle within the allowed number of rounds."""


def checkpoint_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``. Where that is unset, one of this machine, if all runs on this machine."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        where = spark.conf.get("spark.checkpoint.dir", None)
        if where is None:
            if not sc.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            where = tempfile.mkdtemp(prefix="quarryline-rounds-")
            atexit.register(shutil.rmtree, where, True)
        sc.setCheckpointDir(where)
    return sc.getCheckpointDir()


def durable(df: DataFrame) -> DataFrame:
    """Cut the lineage with a checkpoint in ``checkpoint_folder``."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


class Counted:
    """Checkpointed rows and their number."""

    def __init__(self, df: DataFrame, n: int | None = None):
        self.df = durable(df) if n is None else df
        self.n = self.df.count() if n is None else n

    @classmethod
    def none(cls, like: DataFrame) -> Counted:
        """No rows, without a job."""
        return cls(like.limit(0), 0)

    @property
    def hinted(self) -> DataFrame:
        """The rows, to be broadcast if they are few."""
        return F.broadcast(self.df) if self.n <= FEW else self.df


def present(batch: Counted, rows: DataFrame) -> Counted:
    """The rows that are in batch too."""
    return Counted(rows.join(batch.hinted, rows.columns, "left_semi"))


def absent(candidates: DataFrame, rows: DataFrame, n: int) -> Counted:
    """The set of candidates that are not among rows, n of them."""
    if n == 0:
        return Counted(candidates.distinct())
    if n > MANY:
        batch = Counted(candidates.distinct())
        if batch.n <= FEW:  # what is there is scanned, not shuffled
            there = present(batch, rows.toDF(*batch.df.columns)) if batch.n else batch
            return Counted(batch.df.join(there.hinted, batch.df.columns, "left_anti")) if there.n else batch
        candidates = batch.df
    return Counted(candidates.distinct().join(rows.toDF(*candidates.columns), candidates.columns, "left_anti"))


class _Rounds:
    """What a relation has: new rows of the last round, and rows before them."""

    def __init__(self, base: DataFrame | None, n_base: int, new: Counted):
        self.base, self.n_base, self.new, self.parts, self.n_parts = base, n_base, new, [], 0

    @property
    def old(self) -> DataFrame:
        found = ([self.base] if self.base is not None else []) + self.parts
        return _union(found) if found else self.new.df.limit(0)

    @property
    def all(self) -> DataFrame:
        return _union([self.old, self.new.df]) if self.parts or self.base is not None else self.new.df

    @property
    def gained(self) -> DataFrame:
        """All rows but the base."""
        return _union([*self.parts, self.new.df])

    @property
    def n(self) -> int:
        return self.n_base + self.n_parts + self.new.n

    def step(self, new: Counted) -> None:
        if self.new.n:
            self.parts.append(self.new.df)
            self.n_parts += self.new.n
        self.new = new
        if len(self.parts) >= GATHER:
            self.parts = [durable(_union(self.parts))]


def _union(parts: Sequence[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def readings(rule: Rule, read: Callable[[str], DataFrame], names: set[str], settled: Callable[[str], DataFrame]) -> list[str]:
    """The relations of ``names`` that a rule reads as they grow, in order."""
    seen: list[str] = []

    def note(name: str) -> DataFrame:
        if name in names:
            seen.append(name)
        return read(name)

    rule(Reader(note, settled))
    return seen


def deltas(rule: Rule, reads: Sequence[str], new: Mapping[str, DataFrame], whole: Callable[[str], DataFrame], before: Callable[[str], DataFrame], settled: Callable[[str], DataFrame]) -> list[DataFrame]:
    """What a rule derives with at least one new row: a run per reading of a relation in ``new``."""
    out = []
    for i, changed in enumerate(reads):
        if changed not in new:
            continue
        count = iter(range(len(reads)))

        def now(name: str, i: int = i, count=count) -> DataFrame:
            if name not in reads:
                return whole(name)
            k = next(count)
            return new[name] if k == i else whole(name) if k < i else before(name)

        out.append(rule(Reader(now, settled)))
    return out


def merged(parts: Sequence[DataFrame], columns: Sequence[str]) -> DataFrame:
    """The union of parts under one relation's columns; rows may repeat."""
    return _union(parts).toDF(*columns)


def rounds(start: Mapping[str, DataFrame], rules: Mapping[str, Sequence[Rule]], read: Callable[[str], DataFrame], max_rounds: int, seed: Mapping[str, DataFrame] | None = None, sizes: Mapping[str, int] | None = None) -> dict[str, _Rounds]:
    """Semi-naive rounds until no relation gains a row. With ``seed``, start is closed already and has ``sizes`` rows."""
    if seed is None:
        state = {n: _Rounds(None, 0, Counted(d.distinct())) for n, d in start.items()}
    else:
        state = {n: _Rounds(d, sizes[n], absent(seed[n].toDF(*d.columns) if n in seed else d.limit(0), d, sizes[n])) for n, d in start.items()}
    names = set(state)
    whole = lambda name: state[name].all if name in state else read(name)
    before = lambda name: state[name].old if name in state else read(name)
    plans = [(n, rule, readings(rule, whole, names, read)) for n, rs in rules.items() for rule in rs]
    for _ in range(max_rounds):
        live = {n: s.new.hinted for n, s in state.items() if s.new.n}
        if not live:
            return state
        new = {}
        for n, s in state.items():
            parts = [d for m, rule, reads in plans if m == n for d in deltas(rule, reads, live, whole, before, read)]
            new[n] = absent(merged(parts, s.new.df.columns), s.all, s.n) if parts else None
        for n, s in state.items():
            s.step(new[n] or Counted.none(s.new.df))
    raise DivergenceError(f"no fixpoint of {sorted(names)} after {max_rounds} rounds; does a rule make new values for ever?")


def fixpoint(start: Mapping[str, DataFrame], rules: Mapping[str, Sequence[Rule]], read: Callable[[str], DataFrame], max_rounds: int = MAX_ROUNDS) -> dict[str, DataFrame]:
    """Relations that ``rules`` derive from ``start``, all together.

    start: rows of each relation before any recursive rule. read: other relations. A rule that reads one of the
    relations under negation or an aggregate, which can't see it grow, is an error.
    """
    from .safety import check

    for name, own in rules.items():
        for rule in own:
            check(rule, lambda n: start[n] if n in start else read(n), set(start), f"a rule of {name}")
    return {n: s.all for n, s in rounds(start, rules, read, max_rounds).items()}


def closure(edges: DataFrame, max_rounds: int = MAX_ROUNDS) -> DataFrame:
    """Transitive closure of a relation of two columns, by doubling: a path of n edges takes about log2(n) rounds."""
    a, b = edges.columns

    def twice(r: Reader) -> DataFrame:
        return r("paths").toDF(a, "_via").join(r("paths").toDF("_via", b), "_via").select(a, b)

    return fixpoint({"paths": edges}, {"paths": [twice]}, lambda name: edges, max_rounds)["paths"]


def reachable(edges: DataFrame, start: DataFrame, max_rounds: int = MAX_ROUNDS) -> DataFrame:
    """Pairs of the closure of ``edges`` whose first node is in ``start`` (one column): only these are derived."""
    a, b = edges.columns
    first = edges.join(start.toDF(a).distinct(), a, "left_semi")
    step = lambda r: r("paths").toDF(a, "_via").join(r("edges").toDF("_via", b), "_via").select(a, b)
    return fixpoint({"paths": first}, {"paths": [step]}, lambda name: edges, max_rounds)["paths"]
