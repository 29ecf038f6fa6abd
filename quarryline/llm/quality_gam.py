"""Quality classifier: a generalised additive model with pairwise interactions.

``text_features`` gives 16 numbers of a text. Each feature has bins at quantiles of
the training rows. Training is cyclic boosting: feature after feature, round after round, a shallow tree (at
most LEAVES leaves over the bins) is fitted to the gradient of the log loss and its leaf values, shrunk, are
added to the feature's lookup table. Then the pairs of features whose joint coarse bins explain most of what
is left get tables of their own, boosted the same way. A score is a sum of table entries by bin, looked up
for whole batches at once.

Training uses at most TRAIN_ROWS labelled rows, those of the smallest hash of doc_id, of the labelled rows not
held out; the statistics of scoring cover every row. Labels, lang, source and doc_id are no features.

Defined results: null and empty texts have all features zero and a score like any other; labels other than 0
and 1, and labels without a document, are not used; without two classes to learn from, every score is the
share of label 1 (0.5 without labels). Repeated rows are scored alike.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import nullable_text, ship

TRAIN_ROWS, FOLDS, THRESHOLD = 20_000, 5, 0.3
BINS, PAIR_BINS, LEAVES, ROUNDS, PAIR_ROUNDS, RATE, PAIRS, MIN_LEAF, RIDGE = 32, 8, 3, 150, 60, 0.12, 6, 8, 4.0
FEATURES = (
    "log_words", "word_length", "distinct_words", "repeated_words", "distinct_lines", "line_words", "upper", "digits", "marks", "rare_marks",
    "stops", "bars", "joined_marks", "title_words", "entropy", "longest_word",
)

_CLASSES = np.zeros((256, 6))
_CLASSES[65:91, 0] = _CLASSES[48:58, 1] = 1
_CLASSES[[c for c in range(33, 127) if not chr(c).isalnum()], 2] = 1
_CLASSES[[ord(c) for c in "*&%$#@^~=<>{}[]|\\_"], 3] = 1
_CLASSES[[ord(c) for c in ".,;:?"], 4] = 1
_CLASSES[ord("|"), 5] = 1


def text_features(text: bytes) -> list[float]:
    words = text.split()
    n, size = len(words), len(text)
    if not n:
        return [0.0] * len(FEATURES)
    histogram = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    upper, digits, marks, rare, stops, bars = (histogram @ _CLASSES).tolist()
    share = histogram[histogram > 0] / size
    lines = [x for x in text.split(b"\n") if x]
    joined = sum(w[-1:] in b"*&%$#!@" for w in words)
    title = sum(w[:1].isupper() and not w[1:].isupper() for w in words)
    return [
        float(np.log1p(n)), size / n, len(set(words)) / n, sum(map(eq, words, words[1:])) / n, len(set(lines)) / max(1, len(lines)), float(np.log1p(n / max(1, len(lines)))),
        upper / size, digits / size, marks / size, rare / size, stops / n, bars / n, joined / n, title / n, float(-(share * np.log2(share)).sum()), max(map(len, words)) / (8 + size / n),
    ]


def feature_rows(texts: list[bytes]) -> np.ndarray:
    return np.array([text_features(t) for t in texts]).reshape(-1, len(FEATURES))


def _featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = feature_rows(batch.column("text").cast(pa.binary()).to_pylist())
        yield pa.record_batch([batch.column("y")] + [pa.array(rows[:, i]) for i in range(len(FEATURES))], names=["y", *FEATURES])


def _tree(g: np.ndarray, h: np.ndarray, n: np.ndarray, leaves: int = LEAVES) -> np.ndarray:
    """Leaf values over ordered bins of gradient, curvature and row sums: best splits first."""
    value, parts = np.zeros(len(g)), [(0, len(g))]
    score = lambda a, b: a * a / (b + RIDGE)
    while len(parts) < leaves:
        best = (1e-9, None, None)
        for p in parts:
            i, j = p
            cg, ch, cn = np.cumsum(g[i:j]), np.cumsum(h[i:j]), np.cumsum(n[i:j])
            gain = score(cg, ch) + score(cg[-1] - cg, ch[-1] - ch) - score(cg[-1], ch[-1])
            gain[(cn < MIN_LEAF) | (cn[-1] - cn < MIN_LEAF)] = 0
            if gain.max(initial=0) > best[0]:
                best = (gain.max(), p, i + int(gain.argmax()) + 1)
        if best[1] is None:
            break
        parts.remove(best[1])
        parts += [(best[1][0], best[2]), (best[2], best[1][1])]
    for i, j in parts:
        value[i:j] = g[i:j].sum() / (h[i:j].sum() + RIDGE)
    return value


def train(x: np.ndarray, y: np.ndarray) -> dict:
    """The model: base log-odds, cut points and a table per feature, and tables of pairs."""
    share = float(y.mean()) if len(y) else 0.5
    if share in (0.0, 1.0) or not len(y):
        return {"base": float(np.log((share + 1e-6) / (1 - share + 1e-6))), "cuts": [], "tables": [], "coarse": [], "pairs": []}
    base = float(np.log(share / (1 - share)))
    cuts = [np.unique(np.quantile(x[:, f], np.arange(1, BINS) / BINS)) for f in range(x.shape[1])]
    bins = [np.searchsorted(c, x[:, f], side="right") for f, c in enumerate(cuts)]
    tables, z = [np.zeros(len(c) + 1) for c in cuts], np.full(len(y), base)
    counts = [np.bincount(b, minlength=len(c) + 1) for b, c in zip(bins, cuts)]

    def residual():
        p = 1 / (1 + np.exp(-z))
        return y - p, p * (1 - p)

    for _ in range(ROUNDS):
        for f, b in enumerate(bins):
            g, h = residual()
            m = len(tables[f])
            step = RATE * _tree(np.bincount(b, g, m), np.bincount(b, h, m), counts[f])
            tables[f] += step
            z += step[b]
    coarse = [np.unique(np.quantile(x[:, f], np.arange(1, PAIR_BINS) / PAIR_BINS)) for f in range(x.shape[1])]
    cells = [np.searchsorted(c, x[:, f], side="right") for f, c in enumerate(coarse)]
    g, h = residual()

    def gain(i: int, j: int) -> float:
        cell, m = cells[i] * PAIR_BINS + cells[j], PAIR_BINS * PAIR_BINS
        a, b = np.bincount(cell, g, m), np.bincount(cell, h, m)
        return float((a * a / (b + RIDGE)).sum())

    chosen = sorted(combinations(range(x.shape[1]), 2), key=lambda p: -gain(*p))[:PAIRS]
    pairs = [(i, j, np.zeros((PAIR_BINS, PAIR_BINS))) for i, j in chosen]
    for _ in range(PAIR_ROUNDS):
        for i, j, t in pairs:
            g, h = residual()
            cell = cells[i] * PAIR_BINS + cells[j]
            a, b, n = (np.bincount(cell, w, PAIR_BINS**2).reshape(PAIR_BINS, PAIR_BINS) for w in (g, h, np.ones(len(y))))
            # a tree of depth two: one cut of the first feature, then one of the second on either side
            split = _tree(a.sum(1), b.sum(1), n.sum(1), 2)
            first = int(np.flatnonzero(np.diff(split))[0]) + 1 if np.diff(split).any() else PAIR_BINS
            step = np.zeros_like(t)
            for part in (slice(0, first), slice(first, PAIR_BINS)):
                step[part] = _tree(a[part].sum(0), b[part].sum(0), n[part].sum(0), 2)
            t += RATE * step
            z += RATE * step[cells[i], cells[j]]
    return {"base": base, "cuts": cuts, "tables": tables, "coarse": coarse, "pairs": pairs}


def score(model: dict, x: np.ndarray) -> np.ndarray:
    z = np.full(len(x), model["base"])
    for f, (cuts, table) in enumerate(zip(model["cuts"], model["tables"])):
        z += table[np.searchsorted(cuts, x[:, f], side="right")]
    for i, j, table in model["pairs"]:
        z += table[np.searchsorted(model["coarse"][i], x[:, i], side="right"), np.searchsorted(model["coarse"][j], x[:, j], side="right")]
    return 1 / (1 + np.exp(-z))


def held_out():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % FOLDS == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, limit: int = TRAIN_ROWS) -> dict:
    """Train on documents that have a label and aren't held out. Only the chosen ones' texts reach Python."""
    ship(docs.sparkSession)
    known = labels.where("quality in (0, 1)").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("quality").cast("int").alias("y"))
    ids = docs.where(~held_out()).select(F.col("doc_id").cast("long").alias("doc_id")).distinct().join(known, "doc_id")
    chosen = F.broadcast(ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit))  # ``limit`` rows of two numbers
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), nullable_text().alias("text")).join(chosen, "doc_id")
    rows = texts.mapInArrow(_featurise, "y int, " + ", ".join(f"{f} double" for f in FEATURES))
    # rows that share an id may be more than the ids; the order by hash keeps both classes among those chosen
    got = rows.orderBy(F.xxhash64(*FEATURES), "y", *FEATURES).limit(limit).toPandas()
    return train(got[list(FEATURES)].to_numpy(float), got["y"].to_numpy(float))


def with_scores(docs: DataFrame, model: dict, text: str = "text", out: tuple[str, str] = ("score", "predicted")) -> DataFrame:
    """All columns of docs, and score and predicted under the names ``out``: one pass, no shuffle."""
    ship(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)  # tables of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 2000):
                part = b.slice(at, 2000)
                s = score(sent.value, feature_rows(part.column("text").cast(pa.binary()).to_pylist()))
                yield pa.record_batch([part.column("row"), pa.array(s), pa.array((s >= THRESHOLD).astype(np.int32))], names=["row", "score", "predicted"])

    # all columns in one, so that no name of theirs can clash
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns if c not in out)).alias("row"), nullable_text(f"`{text}`").alias("text"))
    kinds = T.StructType([rows.schema["row"], T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    return rows.mapInArrow(run, kinds).select("row.*", F.col("score").alias(out[0]), F.col("predicted").alias(out[1]))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every row."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return with_scores(rows, fit(docs, labels)).select("doc_id", held_out().alias("held_out"), "score", "predicted")
