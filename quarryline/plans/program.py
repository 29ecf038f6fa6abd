"""Programs of typed relations and rules, kept up to date as facts come and go.

A ``Program`` declares messages (facts from outside), relations (with rules) and queries. A ``Database`` holds their
rows as checkpointed DataFrames. ``ingest`` adds and removes facts: relations that depend on a changed one are
brought up to date stratum by stratum, in the order of their dependencies:

* additions alone, read only where relations may grow: semi-naive rounds go on from the new rows;
* removals, read only where relations may grow: rows with a derivation from a removed row are taken out (over-deletion),
  those with another derivation come back, and their consequences with them;
* a change under negation, an aggregate or a merge: the stratum is derived anew and compared.

Either way the change of every relation is known, and subscribers of published relations get it. Which readings of a
rule are under negation, an aggregate or a merge is found from its plan (``operators.safety``), so a rule may read them
by ``r(name)`` or by ``r.settled(name)``.

A batch costs in proportion to itself, but for scans: what is there is read to find what the batch changes, and never
shuffled or written anew for a small one (see ``Stored``).
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import relational as R
from ..operators.fixpoint import FEW, GATHER, MAX_ROUNDS, Counted, Reader, Rule, absent, deltas, durable, merged, present, readings, rounds
from ..operators.safety import guarded, unsafe_readings


class ProgramError(ValueError):
    """A declaration or rule is wrong."""


class StratificationError(ProgramError):
    """A relation depends on its own negation, aggregate or merge."""


class PromiseError(ProgramError):
    """Facts under ``r.never`` took a derived row away."""


@dataclass
class Query:
    """Access to a relation with parameters bound: patterns like "bf" (bound, free) that are allowed."""

    relation: str
    patterns: tuple[str, ...]
    first: bool = False
    forces: str | None = None  # a message that the bound parameters are sent to before reading


@dataclass
class Program:
    messages: dict[str, str] = field(default_factory=dict)
    relations: dict[str, str] = field(default_factory=dict)
    rules: dict[str, list[Rule]] = field(default_factory=dict)
    queries: dict[str, Query] = field(default_factory=dict)
    published: dict[str, bool] = field(default_factory=dict)
    differential: set[str] = field(default_factory=set)

    def message(self, name: str, schema: str, differential: bool = False) -> Program:
        self._new(name)
        self.messages[name] = schema
        if differential:
            self.differential.add(name)
        return self

    def relation(self, name: str, schema: str, *rules: Rule) -> Program:
        if self.relations.get(name, schema) != schema:
            raise ProgramError(f"{name} is declared again with another schema")
        if name in self.messages:
            raise ProgramError(f"{name} is a message already")
        self.relations[name] = schema
        self.rules.setdefault(name, []).extend(rules)
        return self

    def rule(self, name: str) -> Callable[[Rule], Rule]:
        """Decorator: one more body of a relation."""
        if name in self.messages:
            raise ProgramError(f"{name} is received, so no rule can derive it")
        if name not in self.relations:
            raise ProgramError(f"{name} is not declared")
        return lambda fn: self.rules[name].append(fn) or fn

    def publish(self, name: str, differential: bool = False) -> Program:
        self.published[name] = differential
        return self

    def query(self, name: str, relation: str, *patterns: str, first: bool = False, forces: str | None = None) -> Program:
        if first and all("f" not in p for p in patterns):
            raise ProgramError(f"{name}: a first match needs a free parameter")
        if forces is not None and forces not in self.messages:
            raise ProgramError(f"{name}: {forces} is no message")
        self.queries[name] = Query(relation, patterns, first, forces)
        return self

    def _new(self, name: str) -> None:
        if name in self.messages or name in self.relations:
            raise ProgramError(f"{name} is declared twice")


@dataclass
class Stratum:
    """Relations that depend on each other, what they read, and what of it must be settled."""

    names: list[str]
    reads: set[str]
    settled: set[str]
    recursive: bool
    promised: set[str]  # of the settled ones, those that are only read by ``never``
    rules: dict[str, list[Rule]]


def strata(program: Program, spark: SparkSession) -> list[Stratum]:
    """Groups of mutually recursive relations, each behind all that it reads. Checks names, types and negation."""
    schemas = {**program.messages, **program.relations}
    empty = {n: spark.createDataFrame([], s) for n, s in schemas.items()}
    grows: dict[str, set[str]] = {}
    closed: dict[str, set[str]] = {}
    never: dict[str, set[str]] = {}
    safe: dict[str, list[Rule]] = {}
    for name, rules in program.rules.items():
        grows[name], closed[name], never[name], safe[name] = set(), set(), set(), []
        if not rules:
            raise ProgramError(f"{name} has no rule")
        for rule in rules:
            def read(other: str, into: set[str] | None = None) -> DataFrame:
                if other not in empty:
                    raise ProgramError(f"a rule of {name} reads {other}, which is not declared")
                if into is not None:
                    into.add(other)
                return empty[other]

            seen, unsafe, out = unsafe_readings(rule, read, lambda n: read(n, never[name]), lambda n: read(n, closed[name]))
            want, got = [f.dataType for f in empty[name].schema], [f.dataType for f in out.schema]
            if want != got:
                raise ProgramError(f"a rule of {name} gives {[t.simpleString() for t in got]}, declared are {[t.simpleString() for t in want]}")
            grows[name] |= {n for k, n in enumerate(seen) if k not in unsafe}
            closed[name] |= {seen[k] for k in unsafe}
            safe[name].append(guarded(rule, set(unsafe)))
        never[name] -= closed[name]
        closed[name] |= never[name]
    needs = {n: grows[n] | closed[n] for n in grows}

    def reach(start: str) -> set[str]:
        seen, todo = set(), list(needs[start])
        while todo:
            n = todo.pop()
            if n not in seen:
                seen.add(n)
                todo.extend(needs.get(n, ()))
        return seen

    below = {n: reach(n) for n in needs}
    out, done = [], set()
    for n in sorted(needs, key=lambda n: (len(below[n]), n)):  # whatever n reads and doesn't read n reaches less
        if n in done:
            continue
        group = sorted({n} | {m for m in below[n] if n in below.get(m, ())})
        done |= set(group)
        settled = set().union(*(closed[m] for m in group))
        if inside := settled & set(group):
            raise StratificationError(f"{sorted(inside)} would have to be complete before they are derived")
        promised = set().union(*(never[m] for m in group)) - set().union(*(closed[m] - never[m] for m in group))
        out.append(Stratum(group, set().union(*(needs[m] for m in group)) - set(group), settled, n in below[n], promised, {m: safe[m] for m in group}))
    return out


@dataclass
class Change:
    """What a batch did to a relation."""

    added: DataFrame
    removed: DataFrame
    n_added: int
    n_removed: int


class Stored:
    """The rows of a relation: a base, rows added since, and rows of the base that are gone.

    The base is written anew only when what came and went since is an eighth of it, so the cost of writing stays in
    proportion to the changes. Instances don't change, so the state before a batch can still be read.
    """

    def __init__(self, base: DataFrame, n: int, plus: tuple[DataFrame, ...] = (), minus: Counted | None = None, since: int = 0):
        self.base, self.n, self.plus, self.minus, self.since = base, n, plus, minus, since

    @property
    def rows(self) -> DataFrame:
        kept = self.base.join(self.minus.hinted, self.base.columns, "left_anti") if self.minus and self.minus.n else self.base
        return reduce(lambda a, b: a.union(b), self.plus, kept)

    def changed(self, change: Change) -> Stored:
        """change: rows that were absent, and rows that were present."""
        plus, minus, columns = self.plus, self.minus, self.base.columns
        fresh, gone = Counted(change.added, change.n_added), Counted(change.removed, change.n_removed)
        if gone.n and plus:
            added = reduce(lambda a, b: a.union(b), plus)
            of_base = Counted(gone.df.join(added, columns, "left_anti"))
            plus, gone = ((durable(added.join(gone.hinted, columns, "left_anti")),) if of_base.n < gone.n else plus), of_base
        if minus and minus.n and fresh.n:  # rows of the base that come back
            back = Counted(fresh.df.join(minus.df, columns, "left_semi"))
            if back.n:
                minus, fresh = Counted(minus.df.join(back.hinted, columns, "left_anti")), Counted(fresh.df.join(back.hinted, columns, "left_anti"))
        if gone.n:
            minus = Counted(minus.df.union(gone.df)) if minus and minus.n else gone
        plus = (*plus, fresh.df) if fresh.n else plus
        if len(plus) > GATHER:
            plus = (durable(reduce(lambda a, b: a.union(b), plus)),)
        n, since = self.n + change.n_added - change.n_removed, self.since + change.n_added + change.n_removed
        out = Stored(self.base, n, plus, minus, since)
        return Stored(durable(out.rows), n) if since > max(FEW, n) // 8 else out


class _Rows(Mapping):
    """The rows of every relation, by name."""

    def __init__(self, stored: dict[str, Stored]):
        self._stored = stored

    def __getitem__(self, name: str) -> DataFrame:
        return self._stored[name].rows

    def __iter__(self):
        return iter(self._stored)

    def __len__(self) -> int:
        return len(self._stored)


class Database:
    def __init__(self, spark: SparkSession, program: Program, max_rounds: int = MAX_ROUNDS):
        self.spark, self.program, self.max_rounds = spark, program, max_rounds
        self.strata = strata(program, spark)
        for name, schema in program.published.items():
            if not schema and self._can_shrink(name):
                raise ProgramError(f"{name} can lose rows, so it must be published as differential")
        self._stored = {n: Stored(spark.createDataFrame([], s), 0) for n, s in {**program.messages, **program.relations}.items()}
        self.rows = _Rows(self._stored)
        self._listeners: dict[str, list[Callable[[DataFrame], None]]] = {}
        self._update({}, derive=True)

    def _can_shrink(self, name: str) -> bool:
        """Whether rows can go: after a removal below, or an addition under negation, an aggregate or a merge."""
        todo, seen = [name], set()
        while todo:
            n = todo.pop()
            if n in seen:
                continue
            seen.add(n)
            if n in self.program.differential:
                return True
            for s in self.strata:
                if n in s.names:
                    if s.settled - s.promised:
                        return True
                    todo.extend(s.reads)
        return False

    def subscribe(self, name: str, listener: Callable[[DataFrame], None]) -> None:
        """Call listener with (columns..., added boolean) for every batch that changes a published relation."""
        if name not in self.program.published:
            raise ProgramError(f"{name} is not published")
        self._listeners.setdefault(name, []).append(listener)

    def ingest(self, added: Mapping[str, DataFrame] | None = None, removed: Mapping[str, DataFrame] | None = None) -> dict[str, Change]:
        """One batch of facts, additions before removals; the change of every relation."""
        names = [*dict.fromkeys([*(added or {}), *(removed or {})])]
        for name in names:
            if name not in self.program.messages:
                raise ProgramError(f"{name} is no message")
            if removed and name in removed and name not in self.program.differential:
                raise ProgramError(f"{name} is not differential, so facts can't be removed")
        was, changes = dict(self._stored), {}
        for name in names:
            old = self._stored[name]
            typed = lambda d: R.relation(d.select(*(F.col(f"`{c}`").cast(t).alias(f) for c, (f, t) in zip(d.columns, old.base.dtypes))))  # noqa: B023, E731
            fresh, drop = typed(added[name]) if added and name in added else None, Counted(typed(removed[name])) if removed and name in removed else None
            gone = present(drop, old.rows) if drop and drop.n and old.n else Counted.none(old.base)
            if fresh is not None and drop and drop.n:
                fresh = fresh.join(drop.hinted, fresh.columns, "left_anti")
            new = absent(fresh, old.rows, old.n) if fresh is not None else Counted.none(old.base)
            self._apply(name, new, gone, changes)
        self._update(changes, was)
        for name, listeners in self._listeners.items():
            if name in changes:
                c = changes[name]
                log = c.added.withColumn("added", F.lit(True))
                if self.program.published[name]:
                    log = log.union(c.removed.withColumn("added", F.lit(False)))
                for listener in listeners:
                    listener(log)
        return changes

    def _apply(self, name: str, added: Counted, removed: Counted, changes: dict[str, Change]) -> None:
        """Take a relation's exact change."""
        if added.n or removed.n:
            changes[name] = Change(added.df, removed.df, added.n, removed.n)
            self._stored[name] = self._stored[name].changed(changes[name])

    def _read(self, name: str) -> DataFrame:
        return self.rows[name]

    def _update(self, changes: dict[str, Change], was: Mapping[str, Stored] | None = None, derive: bool = False) -> None:
        before = _Rows(was or dict(self._stored))
        for s in self.strata:
            touched = s.reads & set(changes)
            if not (touched or derive):
                continue
            if derive or touched & s.settled:
                found = {n: self._compared(n, d) for n, d in self._derive(s).items()}
                broken = not derive and touched & s.settled <= s.promised and not any(changes[n].n_removed for n in touched)
                if broken and (lost := [n for n, (_, gone) in found.items() if gone.n]):
                    raise PromiseError(f"{sorted(touched & s.promised)} took rows of {lost} away")
            elif any(changes[n].n_removed for n in touched):
                found = self._delete(s, changes, touched, before)
            else:
                gained = self._grow(s, {n: self._hinted(changes[n].added, changes[n].n_added) for n in touched}, lambda n: before[n], {n: self.rows[n] for n in s.names}, {n: self._stored[n].n for n in s.names})
                found = {n: (g, Counted.none(g.df)) for n, g in gained.items()}
            for n, (added, removed) in found.items():
                self._apply(n, added, removed, changes)

    @staticmethod
    def _hinted(df: DataFrame, n: int) -> DataFrame:
        return Counted(df, n).hinted

    def _compared(self, name: str, new: Counted) -> tuple[Counted, Counted]:
        """What is new and what is gone, given all rows as they should be."""
        old = self._stored[name]
        if not old.n or not new.n:
            return (new, Counted.none(old.base)) if not old.n else (Counted.none(old.base), Counted(old.rows))
        columns = old.base.columns
        return Counted(new.df.join(old.rows, columns, "left_anti")), Counted(old.rows.join(new.df, columns, "left_anti"))

    def _derive(self, s: Stratum) -> dict[str, Counted]:
        """All rows of a stratum from what it reads."""
        start, loops = {}, {}
        for n in s.names:
            columns = self._stored[n].base.columns
            exits = [r for r in s.rules[n] if not readings(r, self._read, set(s.names), self._read)]
            start[n] = merged([r(Reader(self._read)) for r in exits], columns) if exits else self._stored[n].base.limit(0)
            loops[n] = [r for r in s.rules[n] if r not in exits]
        if not s.recursive:
            return {n: Counted(d.distinct()) for n, d in start.items()}
        return {n: Counted(d.all, d.n) for n, d in rounds(start, loops, self._read, self.max_rounds).items()}

    def _grow(self, s: Stratum, added: Mapping[str, DataFrame], before: Callable[[str], DataFrame], start: Mapping[str, DataFrame], sizes: Mapping[str, int], more: Mapping[str, DataFrame] | None = None) -> dict[str, Counted]:
        """What a stratum gains that is closed but for rows added below it (and rows ``more`` of its own)."""
        whole = lambda n: start[n] if n in start else self.rows[n]
        seed = {}
        for n in s.names:
            parts = [more[n]] if more else []
            for rule in s.rules[n]:
                parts += deltas(rule, readings(rule, whole, set(added), self._read), added, whole, before, self._read)
            if parts:
                seed[n] = merged(parts, start[n].columns)
        if not s.recursive:
            return {n: absent(d, start[n], sizes[n]) for n, d in seed.items()}
        loops = {n: [r for r in s.rules[n] if readings(r, whole, set(s.names), self._read)] for n in s.names}
        return {n: Counted(d.gained, d.n - d.n_base) for n, d in rounds(start, loops, self._read, self.max_rounds, seed, sizes).items()}

    def _delete(self, s: Stratum, changes: Mapping[str, Change], touched: set[str], was: Mapping[str, DataFrame]) -> dict[str, tuple[Counted, Counted]]:
        """Over-delete, derive again, then add: what a stratum gains and loses by removals (and additions) below it."""
        old = {n: self.rows[n] for n in s.names}
        before = lambda n: was[n]
        none = {n: Counted.none(self._stored[n].base) for n in s.names}
        gone = dict(none)
        fresh, count = {n: self._hinted(changes[n].removed, changes[n].n_removed) for n in touched if changes[n].n_removed}, 0
        while fresh:  # rows with a derivation from a removed row, in the state before
            count += 1
            if count > self.max_rounds:
                raise ProgramError("over-deletion doesn't settle")
            found = {}
            for n in s.names:
                parts = [d for rule in s.rules[n] for d in deltas(rule, readings(rule, before, set(fresh), before), fresh, before, before, before)]
                if parts:
                    new = merged(parts, old[n].columns).distinct()
                    new = new.join(gone[n].hinted, old[n].columns, "left_anti") if gone[n].n else new
                    new = Counted(old[n].join(new, old[n].columns, "left_semi"))
                    if new.n:
                        found[n] = new.hinted
                        gone[n] = Counted(gone[n].df.union(new.df)) if gone[n].n else new
            fresh = found
        left = {n: old[n].join(gone[n].hinted, old[n].columns, "left_anti") if gone[n].n else old[n] for n in s.names}
        sizes = {n: self._stored[n].n - gone[n].n for n in s.names}
        # what is gone may have a derivation from what is left
        now = Reader(lambda n: left[n] if n in left else self.rows[n])
        again = {n: merged([rule(now) for rule in s.rules[n]], old[n].columns).join(gone[n].hinted, old[n].columns, "left_semi") if gone[n].n else none[n].df for n in s.names}
        added = {n: self._hinted(changes[n].added, changes[n].n_added) for n in touched if changes[n].n_added}

        def between(n: str) -> DataFrame:  # without what is removed and without what is added
            return was[n].join(changes[n].removed, was[n].columns, "left_anti") if n in changes and changes[n].n_removed else was[n]

        gained = self._grow(s, added, between, left, sizes, again)
        out = {}
        for n in s.names:
            g = gained.get(n, none[n])
            both = gone[n].n and g.n
            out[n] = (Counted(g.df.join(gone[n].hinted, old[n].columns, "left_anti")), Counted(gone[n].df.join(g.hinted, old[n].columns, "left_anti"))) if both else (g, gone[n])
        return out

    def query(self, name: str, *args) -> DataFrame:
        """Rows of a query with all columns; args are values, or None for free parameters."""
        q = self.program.queries[name]
        pattern = "".join("f" if a is None else "b" for a in args)
        if pattern not in q.patterns:
            raise ProgramError(f"{name} has no pattern {pattern}")
        df = self.rows[q.relation]
        bound = {c: a for c, a in zip(df.columns, args) if a is not None}
        if q.forces is not None:
            self.ingest({q.forces: self.spark.createDataFrame([tuple(bound.values())], self.program.messages[q.forces])})
            df = self.rows[q.relation]
        out = R.lookup(df, **bound)
        return R.first(out) if q.first else out

    def each(self, name: str, *args, until: Callable[[tuple], bool]) -> int:
        """Give a query's rows to ``until`` one by one, partition by partition, until it says so; how many it got."""
        n = 0
        for row in self.query(name, *args).toLocalIterator():
            n += 1
            if until(tuple(row)):
                break
        return n

    def holds(self, name: str) -> bool:
        """Whether a relation has any row: the value of a condition."""
        return self._stored[name].n > 0

    def explain(self, name: str) -> str:
        """The physical plan of one relation's rules over the rows as they are."""
        bodies = [rule(Reader(self._read)) for rule in self.program.rules[name]]
        return reduce(lambda a, b: a.union(b), bodies)._jdf.queryExecution().toString()

    def dot(self) -> str:
        """The strata as a graph in DOT."""
        lines = [f'  "{r}" -> "{n}"{" [style=dashed]" if r in s.settled else ""};' for s in self.strata for n in s.names for r in sorted(s.reads)]
        return "digraph {\n" + "\n".join(lines) + "\n}"
