"""Near copies and the stage that drops them, against exact similarity and planted pairs."""

import random
import time

from pyspark.sql import functions as F

import corpus_pipeline
from quarryline.llm import common, near_copies, simhash

from .test_operators import least_reachable

KINDS = "doc_id long, text string, lang string, source string, n_chars long"


def shingles(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def similarity(a, b):
    return len(a & b) / len(a | b) if a or b else 1.0


def planted(pairs, seed=11):
    """Pairs of texts of 30 to 1,500 words with five-word similarity 0.8 to 0.95, spread over the range."""
    rng = random.Random(seed)
    out = []
    while len(out) < pairs:
        n = rng.choice([30, 60, 100, 200, 400, 1000, 1500])
        words = [f"w{rng.randrange(5000)}" for _ in range(n)]
        other = list(words)
        for _ in range(rng.randint(1, max(1, n // 40))):
            other[rng.randrange(n)] = f"x{rng.randrange(5000)}"
        a, b = " ".join(words), " ".join(other)
        if 0.8 <= similarity(shingles(a), shingles(b)) <= 0.95:
            out.append((a, b))
    return out


def kept_of(spark, rows, small):
    df = spark.createDataFrame([(i, t, None, None, 3) for i, t in rows], KINDS)
    return sorted(((r.doc_id, r.text) for r in corpus_pipeline.near_duplicates(spark, df, small).collect()), key=str)


def test_planted_pairs_are_found(spark, small):
    pairs = planted(300)
    rows = [(k, a) for k, (a, _) in enumerate(pairs)] + [(1000 + k, b) for k, (_, b) in enumerate(pairs)]
    assert [i for i, _ in sorted(kept_of(spark, rows, small))] == list(range(300))


def test_no_link_below_the_threshold(spark, small):
    """Chains, hubs and crowded buckets: the same components as all pairs give."""
    rng = random.Random(3)
    rows = []
    for _ in range(6):
        words = [f"w{rng.randrange(5000)}" for _ in range(120)]
        for _ in range(40):
            rows.append((len(rows), " ".join(words)))
            if rng.random() < 0.3:
                words = list(words)
                words[rng.randrange(120)] = f"x{rng.randrange(5000)}"
            other = list(words)
            for _ in range(rng.randint(0, 4)):
                other[rng.randrange(120)] = f"y{rng.randrange(5000)}"
            rows.append((len(rows), " ".join(other)))
    rng.shuffle(rows)
    rows = [(k, t) for k, (_, t) in enumerate(rows)]
    sets = [shingles(t) for _, t in rows]
    roots = least_reachable(rows, lambda i: [j for j in range(len(rows)) if similarity(sets[i], sets[j]) >= 0.8])
    assert 6 < len(set(roots)) < len(rows)
    assert sorted(kept_of(spark, rows, small)) == sorted(rows[k] for k in set(roots))


def test_signature_of_short_texts():
    assert len(near_copies.shingles_of(b"A b")) == 1 and (near_copies.shingles_of(b"A b") == near_copies.shingles_of(b"a  B\n")).all()
    assert len(near_copies.shingles_of(b" ")) == 0 and len(near_copies.shingles_of(b"a b c d e f")) == 2


def test_empty_table(spark, small):
    df = spark.createDataFrame([], KINDS)
    assert near_copies.near_copies(df.withColumn("x", F.lit(1))).count() == 0


def test_stage_over_the_small_table(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    rows = sorted((r.doc_id, r.text) for r in docs.collect())
    sets = [shingles(t) for _, t in rows]
    roots = least_reachable(rows, lambda i: [j for j in range(len(rows)) if similarity(sets[i], sets[j]) >= 0.8])
    single = corpus_pipeline.near_duplicates(spark, docs, small)
    assert single.columns == docs.columns and {r.doc_id for r in single.collect()} == {rows[k][0] for k in set(roots)}


A = " ".join(f"a{k}" for k in range(60))
NEAR_A = " ".join([*(f"a{k}" for k in range(59)), "z"])
B, C, D = (" ".join(f"{c}{k}" for k in range(40)) for c in "bcd")


def test_a_repeated_id_loses_only_the_copy(spark, small):
    assert kept_of(spark, [(3, A), (7, NEAR_A), (7, B)], small) == [(3, A), (7, B)]


def test_near_texts_under_one_id_are_one(spark, small):
    got = kept_of(spark, [(7, A), (7, NEAR_A), (8, C), (8, C)], small)
    assert len(got) == 2 and got[0][0] == 7 and got[0][1] in (A, NEAR_A) and got[1] == (8, C)


def test_a_null_id_never_removes_a_real_one(spark, small):
    rows = [(None, A), (5, NEAR_A), (6, A), (None, B), (9, B), (None, C), (None, C), (None, D), (2, D), (1, D)]
    assert kept_of(spark, rows, small) == sorted([(5, NEAR_A), (9, B), (None, C), (1, D)], key=str)


def test_fingerprints_give_candidates_of_their_own(spark):
    """Without the bands all pairs within four bits are still found, by op2's segments, and those below 0.8 stay apart."""
    pairs = planted(150, seed=4)
    texts = [t for p in pairs for t in p]
    fp = [int(simhash.majority(near_copies.shingles_of(t.encode()).astype(">u8").view("u1").reshape(-1, 8), [len(near_copies.shingles_of(t.encode()))])[0]) for t in texts]
    near = {k for k in range(150) if (fp[2 * k] ^ fp[2 * k + 1]).bit_count() <= simhash.RADIUS}
    rows = [(k + 1000 * i, p[i]) for k, p in enumerate(pairs) for i in (0, 1)]
    assert 10 < len(near) < 140
    df = spark.createDataFrame(rows, "doc_id long, text string")
    df = df.select("doc_id", "text", F.xxhash64("text").alias("hash"))
    nodes = near_copies.signed(df, near_copies.SHINGLE).withColumn("keys", F.array("node"))  # no band is shared
    found = near_copies.links(df, common.durable(nodes), near_copies.SHINGLE, near_copies.THRESHOLD)
    of = {r.node: r.doc_id for r in nodes.collect()}
    assert {frozenset((of[r.a], of[r.b])) for r in found.collect()} == {frozenset((k, k + 1000)) for k in near}


def test_pairs_of_one_fingerprint_and_of_linked_ones(spark):
    rows = [(1, 0, [1]), (2, 0, [2]), (3, 0b1111, [3]), (4, 0b11111 << 9, [4]), (5, -1, [5]), (6, -1 << 3, [6]), (7, 0, [])]
    found = near_copies.fingerprint_pairs(spark.createDataFrame(rows, "node long, fp long, keys array<long>")).collect()
    assert {frozenset(p) for p in found} == {frozenset(p) for p in ((1, 2), (1, 3), (5, 6))}


def test_fingerprints_of_sets_equal_those_of_texts():
    text = " ".join(f"w{k}" for k in range(700)).encode()  # no shingle twice
    h = near_copies.shingles_of(text)
    assert simhash.majority(h.astype(">u8").view("u1").reshape(-1, 8), [len(h)]) == simhash.fingerprints_of([text], near_copies.SHINGLE)


def test_few_links_leave_few_files(spark, monkeypatch):
    """The rounds of components don't leave files for every shuffle partition, and finished rounds leave none."""
    kept, files = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}, []

    def durable(df):
        out = common.checkpoint_folder(df.sparkSession) and df.checkpoint(eager=True)
        files.append(out.rdd.getNumPartitions())
        return out

    monkeypatch.setattr(common, "durable", durable)
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "61")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        got = {r.node: r.root for r in common.components(spark.createDataFrame([(k, k + 1) for k in range(200) if k % 20 != 7], "a long, b long"), "a", "b").collect()}
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
    assert got == {k: max(0, (k - 8) // 20 * 20 + 8) for k in range(201)}
    assert len(files) > 3 and max(files[1:]) <= common.FEW_PARTS


def test_released_shuffles_are_deleted(spark):
    disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    shuffles = lambda: {x.rsplit("/", 1)[-1] for x in disk.getAllFiles().mkString("\n").split("\n") if "shuffle_" in x}
    before = shuffles()
    common.durable(spark.range(1000).groupBy(F.col("id") % 7).count())
    made = shuffles() - before
    assert made
    for _ in range(30):  # Spark holds its last job till the next one, and its cleaner has a thread of its own
        spark.range(3).collect()
        common.release(spark)
        time.sleep(0.1)
        if not made & shuffles():
            break
    assert not made & shuffles()
