"""The methods themselves against plain versions: the mixing coder, ratios, context, additive tables, trees and segments."""

import math
import random
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarryline.llm import common, decontaminate, lm_mixing, pii, quality_gam, rp_forest, secret_scan, simhash

# 3


def toy_model(seed=0, words=40):
    rng = np.random.default_rng(seed)
    letters = rng.integers(0, 50, 257)
    vocabulary = [f"w{k}".encode() for k in range(words)] + [lm_mixing.END]
    coder = lm_mixing.Coder(vocabulary, [1000 // (k + 1) for k in range(words)] + [30], 200, letters)
    cells = rng.integers(-40, 40, lm_mixing.WORD_CELLS + (1 << 18)).astype(np.int8)
    weights = np.abs(rng.standard_normal((lm_mixing.INPUTS, lm_mixing.GATES))) * 0.3
    return lm_mixing.Model(coder, cells, 18, weights, rng.standard_normal(lm_mixing.GATES) * 0.1)


def plain_code(words, model):
    """Bit by bit, with one weight vector per gate, from the description alone."""
    m, c, words = lm_mixing, model.coder, [*words, lm_mixing.END]
    ids = [c.number.get(w, c.escape) for w in words]
    weights, shift = [list(map(float, w)) for w in model.weights.T], list(map(float, model.shift))
    classes = [m.class_of(w, i if i < c.escape else None) for w, i in zip(words, ids)]
    start, costs = m.class_of(m.END, c.number[m.END]), [0.0] * len(words)
    for low in range(0, len(words), m.WINDOW):
        units = []
        for k in range(low, min(low + m.WINDOW, len(words))):
            units.append((k, ids[k], m.CLASSES * m.STRIDE, (classes[k - 1] if k else start) * m.STRIDE))
            if ids[k] == c.escape:
                letters, *hashes = m.letter_contexts([words[k]])
                units += [(k, int(x) + c.escape + 1, *(int(model.keys(h)[i]) for h in hashes)) for i, x in enumerate(letters)]
        at = 0
        while at < len(units):
            size = m.STRETCH[0] if low == 0 and at < m.SOON else m.STRETCH[1]
            moves = []
            for k, symbol, *keys in units[at : at + size]:
                for step in range(c.offset[symbol], c.offset[symbol] + c.length[symbol]):
                    xs = [model.cells[key ^ int(c.place[step])] / m.SCALE for key in keys]
                    g = int(c.gate[step]) + (xs[1] != 0)
                    z = shift[g] + sum(w * x for w, x in zip(weights[g], xs))
                    p = 1 / (1 + math.exp(-max(-m.LIMIT, min(m.LIMIT, z))))
                    bit = int(c.bit[step])
                    costs[k] -= math.log(p if bit else 1 - p)
                    moves.append((g, bit - p, xs))
            for g, error, xs in moves:
                weights[g] = [w + m.RATE * error * x for w, x in zip(weights[g], xs)]
                shift[g] += m.REFINE * error
            at += size
    return costs


def stream(rng, n):
    return [rng.choice([f"w{k}".encode() for k in range(40)] + [b"unknown", b"zz", b"unknowing", bytes([200, 201])]) for _ in range(n)]


def test_the_coder_equals_a_plain_one_in_any_company():
    rng, model = random.Random(1), toy_model()
    documents = [stream(rng, n) for n in (0, 1, 5, 700, 90, 1300)]
    batch = lm_mixing.Batch(model.coder, documents)
    for words, got in zip(documents, lm_mixing.code(batch, list(range(len(documents))), model)):
        assert np.allclose(got, plain_code(words, model), rtol=2e-3, atol=1e-3)
        assert np.allclose(got, lm_mixing.code(lm_mixing.Batch(model.coder, [words]), [0], model)[0], rtol=1e-4, atol=1e-5)


def test_costs_are_a_distribution():
    """Of all that may stand next the probabilities sum to one: words and the escape, then letters and the stop."""
    model = toy_model(3)
    c = model.coder
    cost = lambda w: lm_mixing.code(lm_mixing.Batch(c, [[w]]), [0], model)[0][0]
    told = np.exp([-cost(w) for w in c.number if w != lm_mixing.END]).sum() + math.exp(-lm_mixing.code(lm_mixing.Batch(c, [[]]), [0], model)[0][0])
    escape = 1 - told
    one_letter = np.exp([-cost(bytes([b])) for b in range(256) if bytes([b]) not in c.number]).sum()
    assert 0 < escape < 1 and one_letter < escape
    paths = [int(c.length[k]) for k in range(c.escape + 1)]
    assert abs(sum(2.0**-n for n in paths) - 1) < 1e-9  # a complete tree
    paths = [int(c.length[k]) for k in range(c.escape + 1, c.escape + 258)]
    assert abs(sum(2.0**-n for n in paths) - 1) < 1e-9


def test_chunks_follow_the_text_alone():
    rng, model = random.Random(2), toy_model()
    passage = [rng.choice([f"w{k}", f"rare{rng.randrange(500)}"]).encode() for k in range(40) for _ in range(6)]
    found, documents = [], [[f"p{rng.randrange(999)}".encode() for _ in range(rng.randrange(50, 90))] + passage for _ in range(2)]
    batch = lm_mixing.Batch(model.coder, documents)
    first, context, chunk = lm_mixing.chunks(model.coder, batch)
    assert np.diff(np.append(first, len(batch.ids))).max() <= lm_mixing.CHUNK and set(batch.first) <= set(first)
    for d in range(2):
        own = (first >= batch.first[d]) & (first < batch.first[d] + batch.size[d])
        found.append(set(zip(context[own].tolist(), chunk[own].tolist())))
        alone = lm_mixing.chunks(model.coder, lm_mixing.Batch(model.coder, [documents[d]]))
        assert set(zip(alone[1].tolist(), alone[2].tolist())) == found[d]
    assert len(found[0] & found[1]) > 5


def plain_repeats(held, rows):
    change, past, tries, last = 0.0, [], {}, 2
    total = lambda key: sum(1 for r in rows if key(r))
    for context, chunk, n, of, nats in rows:
        own = 0 if held else 1
        n_other = n - own * total(lambda r: r[:2] == (context, chunk)) + sum(r[:2] == (context, chunk) for r in past)
        of_other = of - own * total(lambda r: r[0] == context) + sum(r[0] == context for r in past)
        past.append((context, chunk))
        if of_other == 0:
            continue
        hit, gate = n_other > 0, (last, of_other > 1)
        h, t = tries.get(gate, (0, 0))
        p = (h + lm_mixing.PRIOR * (0.15, 0.9, 0.4)[last]) / (t + lm_mixing.PRIOR)
        change += -math.log(p) + math.log(of_other / n_other) - nats if hit else -math.log(1 - p)
        tries[gate], last = (h + hit, t + 1), int(hit)
    return change


@pytest.mark.parametrize("held", [True, False])
def test_repeats_equal_a_plain_count(held):
    rng = random.Random(5)
    for _ in range(30):
        pairs = [(rng.randrange(4), rng.randrange(3)) for _ in range(rng.randrange(1, 25))]
        extra = {p: rng.randrange(3) for p in set(pairs)}
        own = lambda p: 0 if held else pairs.count(p)
        n = {p: own(p) + extra[p] for p in set(pairs)}
        of = {c: sum(n[p] for p in n if p[0] == c) + c for c, _ in pairs}
        rows = [(*p, n[p], of[p[0]], float(np.float32(rng.random() * 20))) for p in pairs]
        two = [(d, held, *r) for d in (3, 4) for r in rows]  # documents don't see each other
        got = lm_mixing.repeats(*(np.array([r[k] for r in two], float if k == 6 else bool if k == 1 else np.int64) for k in range(7)))
        assert np.allclose(got.reshape(2, -1).sum(1), plain_repeats(held, rows), atol=1e-6)


def test_held_out_documents_cost_less_than_by_single_words(spark):
    got = lm_mixing.score(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).where("held_out").agg(F.sum("base_score"), F.sum("score"), F.sum("n_bytes")).first()
    base, mixed = (-x / got[2] / math.log10(2) for x in got[:2])
    assert mixed < base - 0.08


def test_a_document_that_occurs_twice_stands_apart(spark):
    rng = random.Random(8)
    texts = [" ".join(f"{rng.choice('abcdefgh')}{rng.randrange(3000)}" for _ in range(120)) for _ in range(120)]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts + texts[:20])], "doc_id long, text string")
    got = {r.doc_id: r for r in lm_mixing.score(df).collect()}
    trained = [k for k in range(20) if not got[k].held_out and not got[120 + k].held_out]
    twice, once = [got[k].bits_per_byte for k in trained], [got[k].bits_per_byte for k in range(20, 120)]
    assert len(trained) > 10 and max(twice) < 0.5 * min(once)


def test_starting_weights_come_from_every_bit_of_every_training_document(spark, monkeypatch):
    rng = random.Random(3)
    texts = [" ".join(rng.choice([f"w{rng.randrange(30)}", f"rare{rng.randrange(4000)}"]) for _ in range(rng.randrange(60))) for _ in range(300)] + ["long " * 5000]
    given, plain = [], lm_mixing.fit
    monkeypatch.setattr(lm_mixing, "fit", lambda cases: given.append(cases) or plain(cases))
    docs = spark.createDataFrame([(k if k % 9 else None, t) for k, t in enumerate(texts)], "doc_id long, text string")
    model = lm_mixing.train(docs)[3]
    c, want = model.coder, np.zeros(2)  # bits of words, of letters
    for text in texts:
        for w in [*text.encode().split(), lm_mixing.END]:
            want[0] += c.length[c.number.get(w, c.escape)]
            want[1] += 0 if w in c.number else sum(c.length[c.escape + 1 + x] for x in [*w, lm_mixing.STOP])
    kind = np.arange(lm_mixing.CASES) >> 17 >= 2 * lm_mixing.DEPTHS
    assert [given[0][~kind].sum(), given[0][kind].sum()] == want.tolist() and want.min() > 1000


def test_the_fit_is_the_best():
    rng = np.random.default_rng(2)
    x0, x1, gate = rng.integers(-127, 128, 5000), rng.integers(-127, 128, 5000), rng.integers(0, lm_mixing.GATES // 2, 5000) * 2
    bit = (rng.random(5000) < 1 / (1 + np.exp(-(0.2 + 0.9 * x0 / lm_mixing.SCALE - 0.3 * x1 / lm_mixing.SCALE)))).astype(int)
    cases = np.zeros(lm_mixing.CASES)
    np.add.at(cases, lm_mixing.case(gate, x0, x1, bit), 100.0)
    weights, shift = lm_mixing.fit(cases)
    used = np.unique(gate) + 1
    assert np.abs(weights[:, used].mean(1) - [0.9, -0.3]).max() < 0.1 and abs(shift[used].mean() - 0.2) < 0.1

    def loss(w, s):
        g = gate + (x1 != 0)
        z = np.clip(s[g] + w[0][g] * x0 / lm_mixing.SCALE + w[1][g] * x1 / lm_mixing.SCALE, -lm_mixing.LIMIT, lm_mixing.LIMIT)
        return 100 * np.logaddexp(0, np.where(bit, -z, z)).sum() + lm_mixing.FIRM / 2 * (((w - 0.5) ** 2).sum() + (s**2).sum())

    for k in range(20):
        assert loss(weights, shift) <= loss(weights + rng.standard_normal(weights.shape) * 0.01, shift + rng.standard_normal(len(shift)) * 0.01)


def test_cells_without_one_of_their_bits():
    """As if counted anew, for small counts; the known one taken off an only one leaves nothing."""
    ones, zeros = (v.ravel() for v in np.meshgrid(np.arange(9.0), np.arange(9.0)))
    for bit in (0, 1):
        may = (ones if bit else zeros) > 0
        x, size = lm_mixing.logits_of(ones[may], zeros[may]), lm_mixing.sizes_of(ones[may], zeros[may])
        assert (lm_mixing.without(x, size, np.full(may.sum(), bit)) == lm_mixing.logits_of(ones[may] - bit, zeros[may] - (1 - bit))).all()


def test_no_python_step_feeds_another(spark, monkeypatch):
    """Each would take a worker of its own, and all idle workers keep what they loaded."""
    from pyspark.sql.classic.dataframe import DataFrame

    step, plans = DataFrame.mapInArrow, []

    def watched(df, *args, **kwargs):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return step(df, *args, **kwargs)

    monkeypatch.setattr(DataFrame, "mapInArrow", watched)
    lm_mixing.train(spark.createDataFrame([(k, f"a few words {k} {k % 7}") for k in range(30)], "doc_id long, text string"))
    assert len(plans) > 3 and not any("MapInArrow" in p for p in plans)


# 6


def plain_random(text, model):
    m = secret_scan
    base = [(r.start(), r.end()) for r in re.finditer(m.ASSIGN, text) if len(r[2]) >= m.MIN_VALUE]
    base += [(r.start(), r.end()) for p in (r"AKIA[A-Z0-9]{14,}", r"[0-9a-f]{16,}") for r in re.finditer(p, text)]
    out = []
    for r in re.finditer(r"[A-Za-z0-9+/_=-]{20,}", text):
        v = [m.ALPHABET.index(c) for c in r[0]]
        ratio = sum(round(model.ratios[a * len(m.ALPHABET) + b], 5) for a, b in zip(v, v[1:])) / (len(v) - 1)
        if ratio > model.margin and len(set(r[0])) >= m.MIN_DISTINCT and re.search("[A-Za-z]", r[0]) and not any(a < r.end() and b > r.start() for a, b in base):
            out.append((r.start(), r.end()))
    return out


LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"


def identifiers(rng, n):
    parts = "user account total balance history average position element transform callback iterator pointer segment channel buffer storage catalogue department wahrscheinlich geburtstag bonjour montagne ventana mariposa".split()
    forms = [lambda p: "_".join(p), lambda p: p[0] + "".join(x.title() for x in p[1:]), lambda p: "-".join(p), lambda p: "/".join(p), lambda p: "_".join(p).upper()]
    out = []
    while len(out) < n:
        s = rng.choice(forms)([rng.choice(parts) for _ in range(rng.randrange(2, 5))])
        out += [s] * (len(s) >= 20)
    return out


def test_ratios_equal_plain_ones_and_tell_classes_apart(spark):
    rng, model = random.Random(4), secret_scan.train(secret_scan.samples(spark))
    secrets = ["".join(rng.choice(a) for _ in range(rng.randrange(24, 48))) for a in (LETTERS, LETTERS[26:], LETTERS[:26] + LETTERS[52:], LETTERS + "+/") for _ in range(100)]
    plain = identifiers(rng, 400)
    odd = ["-" * 32, "A" * 24, "ab" * 15, "=" * 40, "0" * 30, "12345678901234567890123", "x" * 19, "/usr/share/doc/packages/readme/index", "https://example.org/some/long/path/of/words", "password=" + "Qx7" * 9]
    texts = [f"a {s} b" for s in secrets + plain + odd] + [" ".join(secrets[:3] + plain[:3])]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: [tuple(map(int, s.split(":")[1:])) for s in r.spans.split(",") if s.startswith("random:")] for r in secret_scan.scan(df, model).collect()}
    assert got == {k: plain_random(t, model) for k, t in enumerate(texts)}
    assert sum(map(bool, (got[k] for k in range(400)))) >= 392  # recall
    assert sum(map(bool, (got[k] for k in range(400, 800)))) <= 8  # false alarms
    assert not any(got[k] for k in range(800, 810))


def test_ratio_samples_may_lack_a_class(spark):
    for kind in ("true", "false"):
        model = secret_scan.train(secret_scan.samples(spark, 200).where(f"is_random = {kind}"))
        assert model.margin == math.inf
    assert secret_scan.train(secret_scan.samples(spark, 200).limit(0)).margin == math.inf


# 7


@pytest.mark.parametrize("text, spans", [
    ("ref DE89370400440532013000 x", "iban:4:26"), ("DE89 3704 0044 0532 0130 00", "iban:0:27"), ("DE88 3704 0044 0532 0130 00", ""),
    ("code GB82-WEST-12345-698765-432 x", ""), ("my bank: GB82-WEST-1234-5698-7654-32 x", "iban:9:36"), ("lot GB82-WEST-1234-5698-7654-32 x", ""),
    ("passport 123456789", "number:9:18"), ("parcel 123456789", ""), ("SSN 123-45-6789.", "number:4:15"), ("part 123-45-6789.", ""), ("account 123456789 and 987654321", "number:8:17"),
])
def test_context_decides(spark, text, spans):
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert pii.scan(df).first().spans == spans


def test_scores_are_told(spark):
    df = spark.createDataFrame([(1, "x a@b.cc"), (2, "mail a@b.cc"), (3, None)], "doc_id long, text string")
    assert {r.doc_id: r.scores for r in pii.scan(df).collect()} == {1: "0.70", 2: "1.00", 3: ""}


# 8


def test_the_bitmap_lets_every_sketch_pass(spark):
    hashes = np.random.default_rng(1).integers(0, 1 << 63, 500, np.uint64) * np.uint64(2)
    df = spark.createDataFrame([(int(h),) for h in hashes.view(np.int64)], "hash long")
    for bits in (11, 16):
        flags = decontaminate._bitmap(df, bits)
        bit = hashes >> np.uint64(64 - bits)
        assert np.unpackbits(flags).sum() == len(np.unique(bit)) and np.unpackbits(flags)[bit.astype(int)].all()


# 9


def plain_score(model, row):
    z = model["base"]
    for f, (cuts, table) in enumerate(zip(model["cuts"], model["tables"])):
        z += table[sum(row[f] >= c for c in cuts)]
    for i, j, table in model["pairs"]:
        z += table[sum(row[i] >= c for c in model["coarse"][i])][sum(row[j] >= c for c in model["coarse"][j])]
    return 1 / (1 + math.exp(-z))


def plain_features(text):
    words, lines = text.split(), [x for x in text.split(b"\n") if x]
    n, size = len(words), len(text)
    count = lambda chars: sum(chr(b) in chars for b in text) if isinstance(chars, str) else sum(map(chars, text))
    marks = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum())
    share = [text.count(bytes([b])) / size for b in set(text)]
    return [
        math.log1p(n), size / n, len(set(words)) / n, sum(a == b for a, b in zip(words, words[1:])) / n, len(set(lines)) / max(1, len(lines)), math.log1p(n / max(1, len(lines))),
        count(lambda b: 65 <= b <= 90) / size, count(lambda b: 48 <= b <= 57) / size, count(marks) / size, count("*&%$#@^~=<>{}[]|\\_") / size, count(".,;:?") / n, count("|") / n,
        sum(w[-1:] in b"*&%$#!@" for w in words) / n, sum(w[:1].isupper() and not w[1:].isupper() for w in words) / n, -sum(p * math.log2(p) for p in share), max(map(len, words)) / (8 + size / n),
    ]


def test_scores_equal_plain_sums_of_tables(spark, small):
    docs, labels = (spark.read.parquet(f"{small}/{t}.parquet") for t in ("documents", "labels"))
    model = quality_gam.fit(docs, labels)
    assert len(model["pairs"]) == quality_gam.PAIRS and any(np.abs(t).sum() for _, _, t in model["pairs"])
    texts = {r.doc_id: (r.text or "").encode() for r in docs.collect()}
    for r in quality_gam.with_scores(docs, model).collect():
        t = texts[r.doc_id]
        row = plain_features(t) if t.split() else [0.0] * len(quality_gam.FEATURES)
        assert np.allclose(row, quality_gam.text_features(t)) and abs(r.score - plain_score(model, quality_gam.text_features(t))) < 1e-9


def test_one_tree_by_hand():
    """Bins 0 to 3 with 10 rows each and gradients that part best at 2, then at 1: leaves of sum / (curvature + ridge)."""
    g, h, n = np.array([8.0, 0.0, -10.0, -10.0]), np.full(4, 2.0), np.full(4, 10)
    assert np.allclose(quality_gam._tree(g, h, n, 2), [1, 1, -2.5, -2.5])
    assert np.allclose(quality_gam._tree(g, h, n, 3), [8 / 6, 0, -2.5, -2.5])
    assert np.allclose(quality_gam._tree(g, h, np.full(4, 5), 3), [1, 1, -2.5, -2.5])  # leaves need MIN_LEAF rows


# 10 and shared


def test_forest_recall_at_full_depth():
    rng = np.random.default_rng(5)
    x = rng.standard_normal((30_000, 32))
    y = x[:1500] + rng.standard_normal((1500, 32)) * 0.36
    whole = np.concatenate([x, y])
    whole /= np.linalg.norm(whole, axis=1, keepdims=True)
    near = np.flatnonzero((whole[:1500] * whole[30_000:]).sum(1) >= 0.93)
    forest = rp_forest.Forest(whole[:30_000], rp_forest.MAX_DEPTH, rp_forest.TREES, rp_forest.SPILL)
    rows = np.concatenate([near, 30_000 + near])
    row, leaf = forest.leaves(whole[rows])
    lists = [set() for _ in rows]
    for r, c in zip(row.tolist(), leaf.tolist()):
        lists[r].add(c)
    assert len(near) > 300 and np.mean([bool(lists[k] & lists[k + len(near)]) for k in range(len(near))]) >= 0.95


def test_recall_of_near_copies_end_to_end(spark):
    """Pairs among many strangers at a depth above zero."""
    rng = np.random.default_rng(6)
    x = rng.standard_normal((3000, 32))
    x = np.concatenate([x, x[:300] + rng.standard_normal((300, 32)) * 0.3]).astype(np.float32)
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    want = (unit @ unit.T >= 0.93).sum(1) - 1
    df = spark.createDataFrame([(k, v.tolist(), 1) for k, v in enumerate(x)], "vec_id long, embedding array<float>, label int")
    got = {r.vec_id: r.n_links for r in rp_forest.near_duplicates(df, leaf_rows=64).collect()}
    counts = np.array([got[k] for k in range(len(x))])
    assert (counts <= want).all() and want.sum() > 300 and counts.sum() >= 0.95 * want.sum()


def test_long_segments_find_the_same(spark):
    assert simhash.balls_for(1 << 20) == simhash.BALLS and simhash.balls_for(1 << 40) == simhash.LONG_BALLS
    rng = random.Random(3)
    fps = [rng.getrandbits(64) for _ in range(30)]
    fps += [f ^ sum(1 << b for b in rng.sample(range(64), 4)) for f in fps]
    df = spark.createDataFrame([(int(np.uint64(f).view(np.int64)),) for f in fps], "fp long")
    for balls in (simhash.BALLS, simhash.LONG_BALLS):
        links = simhash.fingerprint_links(df, balls=balls).collect()
        assert len({frozenset(r) for r in links}) == 30


def test_hot_keys_are_joined_apart(spark):
    rows = common.durable(spark.createDataFrame([(1 if k < 300 else k, k) for k in range(400)], "k long, x long"))
    values = common.durable(rows.groupBy("k").agg(F.count("*").alias("n")))
    got = common.spread_join(rows, values, ["k"], "n", 400)
    assert sorted((r.k, r.x, r.n) for r in got.collect()) == sorted((1 if k < 300 else k, k, 300 if k < 300 else 1) for k in range(400))
    assert "BroadcastHashJoin" in got._jdf.queryExecution().toString()


def test_training_leaves_few_shuffles(spark, monkeypatch):
    """Shuffles of tables that are made are deleted while the training goes on."""
    disk, left, plain = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager(), [], lm_mixing.fit
    shuffles = lambda: {x.rsplit("/", 1)[-1].split("_")[1] for x in disk.getAllFiles().mkString("\n").split("\n") if "shuffle_" in x}
    before = shuffles()

    def fit(cases):
        for _ in range(30):  # Spark's cleaner has a thread of its own
            if len(shuffles() - before) > 3:
                time.sleep(0.1)
        left.extend(shuffles() - before)
        return plain(cases)

    monkeypatch.setattr(lm_mixing, "fit", fit)
    lm_mixing.train(spark.createDataFrame([(k, f"a few words {k} {k % 7}") for k in range(30)], "doc_id long, text string"))
    assert len(left) <= 3
