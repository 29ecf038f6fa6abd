"""Programs under updates: the final state and the published changes against brute force."""

import random

import pytest

from pyspark.sql import functions as F

from quarryline.operators import fixpoint
from quarryline.operators import relational as R
from quarryline.operators.relational import ANY, atom, gate, head, join, negate
from quarryline.plans.catalogue import brand_flow_program
from quarryline.plans.program import Database, Program, ProgramError, PromiseError, StratificationError


def rows(df):
    return set(map(tuple, df.collect()))


def pairs(spark, values):
    return spark.createDataFrame(sorted(values), "a long, b long")


def graph(non_linear=True):
    p = Program().message("edge", "a long, b long", differential=True)
    p.relation("tc", "a long, b long", lambda r: r("edge"), lambda r: head(join(atom(r("tc"), "x", "y"), atom(r("tc" if non_linear else "edge"), "y", "z")), "x", "z"))
    return p.publish("tc", differential=True).query("reaches", "tc", "bf", "fb", "bb")


def brute(edges):
    out = set(edges)
    while more := {(a, d) for a, b in out for c, d in out if b == c} - out:
        out |= more
    return out


def test_closure_and_its_log(spark):
    """Random edges come and go; the closure, the queries and the published log agree with brute force at each step."""
    rng, db, log, edges, closed = random.Random(21), Database(spark, graph()), [], set(), set()
    db.subscribe("tc", lambda d: log.append(rows(d)))
    for _ in range(4):
        add, drop = {(rng.randrange(6), rng.randrange(6)) for _ in range(3)}, set(rng.sample(sorted(edges), min(2, len(edges))))
        log.clear()
        db.ingest({"edge": pairs(spark, add)}, {"edge": pairs(spark, drop)} if drop else {})
        edges = (edges | add) - drop
        was, closed = closed, brute(edges)
        assert rows(db.query("reaches", 2, None)) == {p for p in closed if p[0] == 2}
        told = log[0] if log else set()
        assert told == {(*p, True) for p in closed - was} | {(*p, False) for p in was - closed}


def test_random_updates(spark):
    random.seed(3)
    db, edges = Database(spark, graph(non_linear=False)), set()
    for _ in range(3):
        add = {(random.randrange(5), random.randrange(5)) for _ in range(4)}
        drop = set(random.sample(sorted(edges), min(2, len(edges))))
        db.ingest({"edge": pairs(spark, add)}, {"edge": pairs(spark, drop)} if drop else {})
        edges = (edges | add) - drop
        assert rows(db.rows["tc"]) == brute(edges)


def hierarchy():
    """Members under negation below a recursion: teams without a parent are heads, and everyone is under a head."""
    p = Program().message("team", "t long").message("under", "t long, p long", differential=True)
    p.relation("top", "t long", lambda r: negate(atom(r("team"), "t"), atom(r("under"), "t", ANY)))
    p.relation("led", "h long, t long", lambda r: r("top").selectExpr("t AS h", "t"), lambda r: head(join(atom(r("led"), "h", "p"), atom(r("under"), "t", "p")), "h", "t"))
    p.relation("size", "h long, n long", lambda r: R.aggregate(atom(r("led"), "h", "t"), ["h"], ["t"], n=F.count("*")))
    return p


def test_negation_and_counts_under_updates(spark):
    """Nothing here is read by ``settled``: that results can shrink is found from the rules."""
    rng, db, teams, under = random.Random(4), Database(spark, hierarchy()), set(), set()
    for _ in range(4):
        new = {rng.randrange(12) for _ in range(4)}
        add = {(t, rng.randrange(12)) for t in rng.sample(range(12), 3)}
        drop = set(rng.sample(sorted(under), min(2, len(under)))) - add
        db.ingest({"team": spark.createDataFrame([(t,) for t in new], "t long"), "under": spark.createDataFrame(sorted(add), "t long, p long")}, {"under": spark.createDataFrame(sorted(drop), "t long, p long")} if drop else {})
        teams, under = teams | new, (under | add) - drop
        led = {(t, t) for t in teams - {t for t, _ in under}}
        while more := {(h, t) for h, p in led for t, q in under if p == q} - led:
            led |= more
        assert rows(db.rows["led"]) == led
        assert rows(db.rows["size"]) == {(h, sum(x == h for x, _ in led)) for h, _ in led}


def test_an_aggregate_is_kept_up_to_date(spark):
    p = Program().message("sale", "k long, x long", differential=True).relation("total", "k long, s long", lambda r: R.aggregate(atom(r("sale"), "k", "x"), ["k"], ["x"], s=F.sum("x")))
    p.relation("low", "k long, x long", lambda r: R.keyed_merge(r("sale"), ["k"], "x", "min"))
    db = Database(spark, p)
    for x in (2, 3):
        db.ingest({"sale": spark.createDataFrame([(1, x)], "k long, x long")})
    assert rows(db.rows["total"]) == {(1, 5)} and rows(db.rows["low"]) == {(1, 2)}
    db.ingest(removed={"sale": spark.createDataFrame([(1, 2)], "k long, x long")})
    assert rows(db.rows["total"]) == {(1, 3)} and rows(db.rows["low"]) == {(1, 3)}


def test_negation_sees_facts_come(spark):
    p = Program().message("a", "x long").message("b", "x long").relation("only", "x long", lambda r: negate(r("a"), r("b")))
    p.relation("less", "y long", lambda r: R.minus(r("a"), r("b").toDF("z")).toDF("y"))
    db, one = Database(spark, p), lambda *v: spark.createDataFrame([(x,) for x in v], "x long")
    db.ingest({"a": one(1, 2)})
    db.ingest({"b": one(2)})
    assert rows(db.rows["only"]) == {(1,)} == rows(db.rows["less"])
    with pytest.raises(ProgramError):
        Database(spark, p.publish("only"))


@pytest.mark.parametrize("body", [
    lambda r: negate(atom(r("m"), "a"), atom(r("p"), "a")), lambda r: R.minus(r("m"), r("p")), lambda r: R.aggregate(r("p"), ["a"], ["a"], n=F.count("*")).select("a"),
    lambda r: R.first(r("p")), lambda r: r("m").join(r("p").withColumn("b", F.lit(1)), "a", "left").where("b IS NULL").select("a"), lambda r: gate(r("m"), r("p"), positive=False),
])
def test_recursion_through_what_must_be_complete(spark, body):
    with pytest.raises(StratificationError):
        Database(spark, Program().message("m", "a long").relation("p", "a long", lambda r: r("m"), body))
    m = spark.createDataFrame([(1,)], "a long")
    with pytest.raises(ValueError):
        fixpoint.fixpoint({"p": m}, {"p": [body]}, lambda n: m)


def test_a_condition_may_grow(spark):
    """A positive condition is monotone: the stratum is recursive through it and allowed."""
    p = Program().message("m", "a long").relation("p", "a long", lambda r: r("m").where("a > 0"), lambda r: gate(r("m"), r("p")))
    db = Database(spark, p)
    db.ingest({"m": spark.createDataFrame([(0,), (-1,)], "a long")})
    assert rows(db.rows["p"]) == set()
    db.ingest({"m": spark.createDataFrame([(5,)], "a long")})
    assert rows(db.rows["p"]) == {(0,), (-1,), (5,)}


def test_a_promise_is_checked(spark):
    p = Program().message("a", "x long").message("b", "x long").publish("fine")
    p.relation("fine", "x long", lambda r: negate(r("a"), r.never("b")))
    db, one = Database(spark, p), lambda *v: spark.createDataFrame([(x,) for x in v], "x long")
    db.ingest({"b": one(1)})
    db.ingest({"a": one(1, 2)})
    db.ingest({"b": one(7)})
    assert rows(db.rows["fine"]) == {(2,)}
    with pytest.raises(PromiseError):
        db.ingest({"b": one(2)})


def test_a_product_loses_rows(spark):
    p = Program().message("a", "x long", differential=True).message("b", "y long").relation("ab", "x long, y long", lambda r: R.product(r("a"), r("b")))
    db = Database(spark, p)
    db.ingest({"a": spark.createDataFrame([(1,), (2,)], "x long"), "b": spark.createDataFrame([(8,), (9,)], "y long")})
    db.ingest(removed={"a": spark.createDataFrame([(1,)], "x long")})
    assert rows(db.rows["ab"]) == {(2, 8), (2, 9)}


def test_brands_flow(spark):
    rng, n = random.Random(9), range(7)
    facts = {
        "stocks": {(k, f"b{rng.randrange(4)}") for k in rng.sample(n, 4)}, "hands_on": {(rng.randrange(7), rng.randrange(7)) for _ in range(3)},
        "puts": {(rng.randrange(7), rng.randrange(7), m) for m in (1, 2, 3)}, "takes": {(rng.randrange(7), rng.randrange(7), m) for m in (1, 2, 3, 1)},
    }
    p = brand_flow_program()
    db = Database(spark, p)
    for name in facts:  # one message after another
        db.ingest({name: spark.createDataFrame(sorted(facts[name]), p.messages[name])})
    flows, carries = set(facts["hands_on"]), set(facts["stocks"])
    while True:
        size = (len(flows), len(carries))
        carries |= {(t, b) for g, t in flows for m, b in carries if m == g}
        shares = {(a, b) for a, x in carries for b, y in carries if x == y}
        flows |= {(g, t) for g, k, m in facts["puts"] for a, b in shares if a == k for c, t, w in facts["takes"] if c == b and w == m}
        if size == (len(flows), len(carries)):
            break
    assert rows(db.rows["flows"]) == flows and rows(db.rows["carries"]) == carries and rows(db.rows["shares"]) == shares


def test_small_batches_write_little(spark, monkeypatch):
    """Rows that come, go and come back, over a base that is neither shuffled nor written anew."""
    from quarryline.plans import program as module

    p = Program().message("m", "a long, b long", differential=True).relation("copy", "a long, b long", lambda r: r("m"))
    db, want = Database(spark, p), {(k, k % 7) for k in range(3000)}
    monkeypatch.setattr(fixpoint, "MANY", 100)
    monkeypatch.setattr(module, "FEW", 100)
    db.ingest({"m": pairs(spark, want)})
    base = db._stored["copy"].base
    for add, drop in [({(9000, 1)}, set()), (set(), {(5, 5), (9000, 1)}), ({(5, 5), (9001, 2)}, {(6, 6)}), ({(5, 5), (6, 6)}, {(9001, 2), (77777, 1)})]:
        db.ingest({"m": pairs(spark, add)} if add else {}, {"m": pairs(spark, drop)} if drop else {})
        want = (want | add) - drop
        assert rows(db.rows["copy"]) == want and db._stored["copy"].n == len(want) and db._stored["copy"].base is base
    db.ingest(removed={"m": pairs(spark, {(k, k % 7) for k in range(1000)})})
    assert rows(db.rows["copy"]) == want - {(k, k % 7) for k in range(1000)} and db._stored["copy"].base is not base


def test_reading_can_stop_early(spark):
    db, got = Database(spark, graph()), []
    db.ingest({"edge": pairs(spark, {(0, k) for k in range(1, 9)})})
    assert db.each("reaches", 0, None, until=lambda row: got.append(row) or len(got) == 3) == 3 and len(got) == 3


def test_conditions_come_and_go(spark):
    p = Program().message("login", "u long", differential=True).message("user", "u long")
    p.relation("known", "u long", lambda r: gate(r("user"), r.settled("login")))
    db, one = Database(spark, p), spark.createDataFrame([(1,)], "u long")
    db.ingest({"user": one})
    assert not db.holds("known")
    db.ingest({"login": one})
    assert db.holds("known")
    db.ingest(removed={"login": one})
    assert not db.holds("known")


def test_add_and_remove_in_one_batch_is_absent(spark):
    db = Database(spark, graph())
    e = pairs(spark, {(1, 2)})
    db.ingest({"edge": e}, {"edge": e})
    assert not db.holds("tc")
    db.ingest({"edge": e.union(e)})
    db.ingest(removed={"edge": e})
    assert not db.holds("tc")


def test_diagnostics(spark):
    p = Program().message("m", "a long")
    p.relation("p", "a long", lambda r: negate(atom(r("m"), "a"), atom(r.settled("q"), "a"))).relation("q", "a long", lambda r: r("p"))
    with pytest.raises(StratificationError):
        Database(spark, p)
    with pytest.raises(ProgramError):
        Database(spark, Program().relation("p", "a long", lambda r: r("nowhere")))
    with pytest.raises(ProgramError):
        Database(spark, Program().message("m", "a long").relation("p", "a string", lambda r: r("m")))
    with pytest.raises(ProgramError):
        Database(spark, Program().message("m", "a long", differential=True).relation("p", "a long", lambda r: r("m")).publish("p"))
    with pytest.raises(ProgramError):
        Program().message("m", "a long").message("m", "a long")
    with pytest.raises(ProgramError):
        Program().query("q", "p", "bb", first=True)
    db = Database(spark, graph())
    with pytest.raises(ProgramError):
        db.query("reaches", None, None)
    with pytest.raises(ProgramError):
        db.ingest({"tc": pairs(spark, {(1, 2)})})


def test_stream_feeds_a_database(spark, tmp_path):
    from quarryline.streaming.feed import drain, feed

    source = str(tmp_path / "in")
    spark.createDataFrame([(0, 1, True), (1, 2, True)], "a long, b long, added boolean").coalesce(1).write.parquet(source)
    db = Database(spark, graph())
    read = lambda: spark.readStream.schema("a long, b long, added boolean").parquet(source)
    drain(feed(db, "edge", read()), str(tmp_path / "cp"))
    assert rows(db.rows["tc"]) == {(0, 1), (1, 2), (0, 2)}
    spark.createDataFrame([(1, 2, False)], "a long, b long, added boolean").coalesce(1).write.mode("append").parquet(source)
    drain(feed(db, "edge", read()), str(tmp_path / "cp"))
    assert rows(db.rows["tc"]) == {(0, 1)}


def test_tab_separated_facts(spark, tmp_path):
    from quarryline.sources.facts import tab_separated, write_changes, write_relation

    (tmp_path / "f.tsv").write_text("1\t2\n1\t2\nx\ty\n3\t4\n")
    df = tab_separated(spark, str(tmp_path / "f.tsv"), "a long, b long")
    assert rows(df) == {(1, 2), (3, 4)}
    write_relation(df, str(tmp_path / "out"))
    assert rows(spark.read.parquet(str(tmp_path / "out"))) == {(1, 2), (3, 4)}
    for _ in range(2):
        write_changes(df.selectExpr("*", "true AS added"), str(tmp_path / "log"), 1)
    assert spark.read.parquet(str(tmp_path / "log")).count() == 2


def test_plans_can_be_looked_at(spark):
    db = Database(spark, graph())
    assert "Join" in db.explain("tc") and '"edge" -> "tc"' in db.dot()
