import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from quarryline.functions.functors import FunctorError, Functors, builtin
from quarryline.operators import relational as R
from quarryline.operators.fixpoint import DivergenceError, closure, fixpoint
from quarryline.operators.relational import ANY, Const, atom, head, join


def rows(df):
    return set(map(tuple, df.collect()))


def edges(spark, pairs):
    return spark.createDataFrame(sorted(pairs), "a long, b long")


def test_relation_is_a_set_without_nulls(spark):
    df = spark.createDataFrame([(1, 2), (1, 2), (None, 3), (4, None)], "a long, b long")
    assert rows(R.relation(df)) == {(1, 2)}


def test_atom_terms(spark):
    df = edges(spark, {(1, 1), (1, 2), (2, 2)})
    assert rows(atom(df, "x", "x")) == {(1,), (2,)}
    assert rows(head(atom(df, Const(1), "x"), "x")) == {(1,), (2,)}
    assert rows(head(atom(df, "x", ANY), "x")) == {(1,), (2,)}
    with pytest.raises(ValueError):
        atom(df, "x")


def test_joins_need_shared_variables(spark):
    a, b = atom(edges(spark, {(1, 2)}), "x", "y"), atom(edges(spark, {(3, 4)}), "u", "v")
    with pytest.raises(R.UnrelatedError):
        join(a, b)
    assert rows(R.product(a, b)) == {(1, 2, 3, 4)}
    with pytest.raises(ValueError):
        R.product(a, a)


def test_join_order_does_not_matter(spark):
    a = atom(edges(spark, {(1, 2), (2, 3)}), "x", "y")
    b = atom(edges(spark, {(2, 5), (3, 6)}), "y", "z")
    c = atom(edges(spark, {(5, 7), (6, 8)}), "z", "w")
    want = {(1, 7), (2, 8)}
    for order in ((a, b, c), (c, b, a), (a, c, b), (b, c, a)):
        assert rows(head(join(*order), "x", "w")) == want


def test_compare_and_unsatisfiable(spark):
    df = atom(edges(spark, {(1, 2), (3, 3), (5, 4)}), "x", "y")
    assert rows(R.where(df, "x", "<", "y")) == {(1, 2)}
    assert rows(R.where(df, "x", "=", "y")) == {(3, 3)}
    for op in ("!=", "<", ">"):
        with pytest.raises(ValueError):
            R.where(df, "x", op, "x")


def test_constants_and_literals(spark):
    df = atom(edges(spark, {(1, 2)}), "x", "y")
    assert rows(R.where(df, Const(1), "<", Const(2))) == {(1, 2)}
    with pytest.raises(ValueError):
        R.where(df, Const("a"), "=", Const("b"))
    assert rows(R.literal(df, True)) == {(1, 2)} and rows(R.literal(df, False)) == set()
    assert rows(head(R.truth(spark), Const(7))) == {(7,)} and rows(head(R.truth(spark, False), Const(7))) == set()


def test_existence(spark):
    df = edges(spark, {(1, 2), (3, 4)})
    assert R.exists(df, a=1, b=2) and not R.exists(df, a=1, b=4) and R.exists(df)


def test_difference_of_other_names(spark):
    a = spark.createDataFrame([(1,), (1,), (2,)], "x long")
    for b in ("x", "y"):
        assert [tuple(r) for r in R.minus(a, spark.createDataFrame([(1,)], f"{b} long")).collect()] == [(2,)]


def test_negation_needs_bound_variables(spark):
    df = atom(edges(spark, {(1, 2), (3, 4)}), "x", "y")
    assert rows(R.negate(df, atom(edges(spark, {(3, 9)}), "x", ANY))) == {(1, 2)}
    with pytest.raises(ValueError):
        R.negate(df, atom(edges(spark, {(3, 9)}), "x", "z"))


def test_gate(spark):
    df, none = atom(edges(spark, {(1, 2)}), "x", "y"), edges(spark, {(1, 1)}).where("a > 1")
    assert rows(R.gate(df, none)) == set() and rows(R.gate(df, none, positive=False)) == {(1, 2)}


def test_aggregate_is_over_a_set(spark):
    df = spark.createDataFrame([(1, 10, 5), (1, 11, 5), (2, 12, 7)], "g long, k long, w long")
    from pyspark.sql import functions as F

    assert rows(R.aggregate(atom(df, "g", ANY, "w"), ["g"], ["w"], s=F.sum("w"))) == {(1, 5), (2, 7)}
    assert rows(R.aggregate(atom(df, "g", "k", "w"), ["g"], ["k", "w"], s=F.sum("w"))) == {(1, 10), (2, 7)}


def test_ordered_merge_over_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        df = spark.createDataFrame([(i % 2, str(i), i) for i in range(20)], "k long, v string, t long")
        got = dict(map(tuple, R.keyed_merge(df, ["k"], "v", lambda old, new: old + new, order="t").collect()))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == {k: "".join(str(i) for i in range(20) if i % 2 == k) for k in (0, 1)}


def test_merges_of_odd_values(spark):
    """Null keys, numbers beyond 2 ** 53, and the ends of an order with ties."""
    big = (1 << 60) + 1
    df = spark.createDataFrame([(None, big, 1), (None, 3, 2), (5, big, 1), (5, big + 1, 1)], "k long, v long, t long")
    got = {tuple(r) for r in R.keyed_merge(df, ["k"], "v", lambda old, new: max(old, new), order="t").collect()}
    assert got == {(None, big), (5, big + 1)}
    for merge, want in (("last", {(None, 3), (5, big + 1)}), ("first", {(None, big), (5, big)})):
        assert rows(R.keyed_merge(df, ["k"], "v", merge, order="t")) == want
    with pytest.raises(ValueError):
        R.keyed_merge(df, ["k"], "v", "last")


def test_summaries(spark):
    f = builtin()
    df = spark.createDataFrame([("a", 1, 5, 4), ("a", 2, 5, 4), ("a", 3, 9, 4), ("b", 1, 1, 4), ("b", 1, 1, 0)], "g string, k long, x long, c long")
    assert rows(f.summarise(df, "min_max", ["x"], ["lo", "hi"], group=["g"])) == {("a", 5, 9), ("b", 1, 1)}
    assert rows(f.summarise(df, "sum", ["x"], ["s"], group=["g"])) == {("a", 14), ("b", 1)}
    assert rows(f.summarise(df, "sum", ["x"], ["s"], group=["g"], apart=["k"])) == {("a", 19), ("b", 1)}
    assert rows(f.summarise(df, "share_above", ["x"], ["n", "of"], group=["g"], config=["c"], apart=["k"])) == {("a", 4, 3, 3), ("b", 4, 0, 1), ("b", 0, 1, 1)}
    with pytest.raises(FunctorError):
        f.summarise(df, "sum", ["x", "k"], ["s"])
    with pytest.raises(FunctorError):
        f.summary("sum", lambda x: (x,))


def test_one_or_more_is_checked(spark):
    f, df = Functors(), spark.createDataFrame([([1, 2],), ([],)], "l array<long>")
    f.declare("items", "list", "item").add("bf", lambda x: x, "+")
    assert rows(f.apply(df.where("size(l) > 0"), "items", "l", "i").select("i")) == {(1,), (2,)}
    with pytest.raises(Exception, match="one or more"):
        f.apply(df, "items", "l", "i").collect()


def brute_closure(pairs):
    out = set(pairs)
    while more := {(a, d) for a, b in out for c, d in out if b == c} - out:
        out |= more
    return out


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.sets(st.tuples(st.integers(0, 6), st.integers(0, 6)), min_size=1, max_size=10))
def test_closures_agree(spark, pairs):
    e = edges(spark, pairs)
    linear = fixpoint({"t": e}, {"t": [lambda r: head(join(atom(r("e"), "a", "x"), atom(r("t"), "x", "b")), "a", "b")]}, lambda n: e)["t"]
    assert rows(linear) == rows(closure(e)) == brute_closure(pairs)


def test_divergence_is_reported(spark):
    start = spark.createDataFrame([(0,)], "n long")
    with pytest.raises(DivergenceError):
        fixpoint({"n": start}, {"n": [lambda r: builtin().apply(atom(r("n"), "n"), "add", "n", Const(1), "m").select("m")]}, lambda n: start, max_rounds=4)


def test_functor_rules():
    f = Functors()
    with pytest.raises(FunctorError):
        f.declare("g", "a").add("f", lambda: None)
    with pytest.raises(FunctorError):
        f.declare("h", "a").add("b", lambda a: a, ".")
    with pytest.raises(FunctorError):
        f.declare("g", "a", "b")
    with pytest.raises(FunctorError):
        f.declare("i", "a", impure=True)


def test_functor_patterns(spark):
    f, df = builtin(), atom(edges(spark, {(3, 5), (2, 4)}), "x", "y")
    assert rows(f.apply(df, "add", "x", "d", "y")) == {(3, 5, 2), (2, 4, 2)}
    assert rows(f.apply(df, "add", "x", Const(2), "y")) == {(3, 5), (2, 4)}
    assert rows(f.apply(df, "div", "y", Const(0), "q")) == set()
    assert rows(f.apply(df, "div", "y", Const(0), "q", negated=True)) == {(3, 5), (2, 4)}
    with pytest.raises(FunctorError):
        f.apply(df, "length", "z", "n")
    lists = f.apply(f.apply(df.select("x"), "list_of", "x", "l"), "append", "l", Const(9), "m")
    assert rows(f.apply(lists, "enumerate", "m", "i", "v").select("x", "i", "v")) == {(3, 0, 3), (3, 1, 9), (2, 0, 2), (2, 1, 9)}
