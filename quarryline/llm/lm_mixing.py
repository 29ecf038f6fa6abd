"""Language-model scores by online logistic context mixing, beside a unigram base score.

A text is its lower-cased words and one end. A word of the vocabulary is one symbol; any other is an escape, then its
letters and a stop. Symbols are leaves of two binary trees (Huffman codes of training counts), so every symbol is a
path of bits and likely ones are short. Every bit of a word is predicted by its node alone and with the class of the word
before, every bit of a letter with the last three and with the last five letters of the word. Their stretched probabilities (logits of training counts) are combined by weights that are gated by the kind of
symbol, the depth of the bit and whether the longest context is known, learn from the coding error as the document goes
on, and start from what fits all training documents best; the mixed
prediction is refined by an adaptive shift per gate. The fit takes every bit of every training document at the logits
that the tables have without that occurrence (deleted estimation): how often each pair of logits met each bit at each
gate is counted from the tables' own counts, so no document is coded twice and none is left out. Weights move after every STRETCH[0] symbols at first and after every
STRETCH[1] later on. A score depends on the counts
and the document alone, so whole groups of documents are coded at once.

Before a run of words (a chunk, which the text itself delimits) one more bit tells whether the chunk goes on as in
another training document after the same three words, or earlier in the same one. Its counts are Spark rows by context
hash and grow with the corpus; a training document's own counts are taken off. If it goes on, the chunk costs that bit
and its share among what followed, else that bit and its symbols.

Sizes: the table of word contexts has STRIDE nodes times CLASSES, the one of letters grows with the vocabulary to
2 ** MAX_BITS cells; counts of tokens and of chunks are rows without bound.

The base score adds one to each token's training count. Counts come from one aggregation over all training tokens.
Frequent tokens (FREQUENT at most, of up to TOKEN_BYTES) go to every task; the others are joined per document.

Defined results: null text counts as empty (one token, the end); rows with a null doc_id are training rows; repeated
rows count and are scored each; without training tokens the base score is 0 for every token. Only doc_id and text
are read.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, nullable_text, release, ship, spread_join

FOLDS, HELD_OUT = 7, 2
FREQUENT, TOKEN_BYTES, END = 200_000, 64, b"\n"
VOCABULARY, STRIDE, CLASSES, COMMON = (1 << 16) - 1, 1 << 16, 127, 64
#: Words that the tables saw fewer times are spelled, as new ones are.
LEAST = 4
#: Cells of words: a row of nodes by class, and one for nodes alone.
WORD_CELLS = (CLASSES + 1) * STRIDE
#: Bits of the letters' table and of a block of it, in which a context has its cells; keys that make a group of blocks.
BLOCK, MIN_BITS, MAX_BITS, GROUP_KEYS = 12, 18, 23, 1_000_000
SCALE, ADD, LIMIT = 14.0, 0.25, 12.0
#: Symbols of a stretch, words of a window, documents of a group; depths that have gates of their own.
STRETCH, SOON, WINDOW, DOCS, DEPTHS = (32, 128), 128, 256, 64, 8
GATES, INPUTS = 2 * DEPTHS * 2, 2
START, RATE, REFINE = (0.5, 0.5), 0.005, 0.003
#: How much START counts in the fit of starting weights, in bits.
FIRM = 20.0
#: Words of a chunk at most and one in how many words starts one; weight of the prior of the bit before it.
CHUNK, EVERY, PRIOR = 64, 16, 2.0
_ROWS, _FLUSH = 512, 3_000_000
_M1, _M2, _P = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)
_POWERS = np.array([pow(int(_P), k, 1 << 64) for k in range(1, CHUNK + 1)], np.uint64)
STOP, NONE = 256, 257


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ h >> np.uint64(29)) * _M1
    h = (h ^ h >> np.uint64(32)) * _M2
    return h ^ h >> np.uint64(31)


def huffman(counts: list[int]) -> tuple[list[list[tuple[int, int]]], np.ndarray]:
    """The path (node, bit) from the root of every symbol, and the logit of bit 1 of every node. Nodes: one less than symbols."""
    n = len(counts)
    heap = [(c, k) for k, c in enumerate(counts)]
    heapq.heapify(heap)
    parent, bit, logit = [0] * (2 * n - 1), [0] * (2 * n - 1), np.zeros(max(0, n - 1), np.float32)
    for made in range(n, 2 * n - 1):
        (a, i), (b, j) = heapq.heappop(heap), heapq.heappop(heap)
        parent[i] = parent[j] = made
        bit[j] = 1
        logit[2 * n - 2 - made] = math.log((b + ADD) / (a + ADD))  # the root is node 0
        heapq.heappush(heap, (a + b, made))
    paths = []
    for k in range(n):
        path = []
        while k != 2 * n - 2:
            path.append((2 * n - 2 - parent[k], bit[k]))
            k = parent[k]
        paths.append(path[::-1])
    return paths, logit


class Coder:
    """Symbols and their paths. words: the vocabulary with its counts, most frequent first; rest: tokens beyond it;
    letters: counts of the 256 bytes and the stop beyond it."""

    def __init__(self, words: list[bytes], counts: list[int], rest: int, letters: np.ndarray):
        if END not in words:
            words, counts = [*words, END], [*counts, 0]
        self.number = {w: k for k, w in enumerate(words)}
        self.words, self.escape = len(words), len(words)
        first, logits = huffman([c + 1 for c in counts] + [rest + 1])
        second, more = huffman([int(c) + 1 for c in letters])
        self.nodes = len(logits)
        paths = [*first, *([(n + self.nodes, b) for n, b in p] for p in second)]
        self.logits = logits
        self.length = np.array([len(p) for p in paths], np.int32)
        self.offset = (np.cumsum(self.length) - self.length).astype(np.int32)
        flat = np.array([x for p in paths for x in p], np.int32).reshape(-1, 2)
        node, self.bit = flat[:, 0], flat[:, 1].astype(np.uint8)
        letters = node >= self.nodes
        depth = np.concatenate([np.arange(len(p)) for p in paths])
        # of every step of a path: gate, place in the cells of a context (words by node, letters mixed), and all in one number
        self.gate = (letters * (DEPTHS * 2) + np.minimum(depth, DEPTHS - 1) * 2).astype(np.int64)
        mixed = (mix(np.arange(1, len(more) + 1, dtype=np.uint64)) >> np.uint64(64 - BLOCK)).astype(np.int64)
        self.place = np.where(letters, mixed[np.maximum(node - self.nodes, 0)], node).astype(np.int64)
        self.packed = (self.place | self.gate << 16 | flat[:, 1].astype(np.int64) << 24).astype(np.int32)
        # of every node of words: how many zeros and ones it met, and its gate
        of, step = self.steps(np.arange(self.words + 1))
        n = (np.array([*counts, rest], np.float64) + 1)[of]
        self.met = np.array([np.bincount(self.place[step], n * (self.bit[step] == b), self.nodes) for b in (0, 1)])
        self.node_gate = np.zeros(self.nodes, np.int64)
        self.node_gate[self.place[step]] = self.gate[step]
        self.classes = np.array([*(class_of(w, k) for k, w in enumerate(words))], np.int64)
        self.hashes = np.array([xxhash.xxh64_intdigest(w, 1) for w in words], np.uint64)

    def steps(self, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number of the symbol, step of its path) of every bit, in order."""
        n = self.length[symbols]
        of = np.repeat(np.arange(len(symbols)), n)
        return of, np.arange(len(of)) + np.repeat(self.offset[symbols] - (np.cumsum(n) - n), n)


def class_of(word: bytes, rank: int | None = None) -> int:
    """A frequent word is a class of its own, others go by their last two bytes."""
    if rank is not None and rank < COMMON:
        return rank
    return COMMON + (word[-1] * 31 + (word[-2] * 17 if len(word) > 1 else 0)) % (CLASSES - COMMON)


def letter_contexts(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the letters and stops of words: the letter, and the hashes of its two contexts."""
    size = np.array([len(w) + 1 for w in words], np.int64)
    end = np.cumsum(size)
    n = int(end[-1]) if len(words) else 0
    letters = np.full(n, STOP, np.uint64)
    inside = np.ones(n, bool)
    inside[end - 1] = False
    letters[inside] = np.frombuffer(b"".join(words), np.uint8)
    begin = np.repeat(end - size, size)
    at = np.arange(n)
    last, contexts = np.zeros(n, np.uint64), []
    for k in range(1, 6):
        before = np.where(at - k >= begin, letters[np.maximum(at - k, 0)], np.uint64(NONE))
        last = last * np.uint64(300) + before
        if k in (3, 5):
            contexts.append(mix(last + np.uint64(k << 60)))
    return letters.astype(np.int64), *contexts


@dataclass
class Model:
    coder: Coder
    cells: np.ndarray  # int8: a row of words by class, one for nodes alone, then the letters' table
    bits: int  # of the letters' table
    weights: np.ndarray  # INPUTS by GATES
    shift: np.ndarray  # GATES

    def keys(self, hashes: np.ndarray) -> np.ndarray:
        """What a letter context's cells have in common: the block, and what places in it are mixed with."""
        block = (hashes >> np.uint64(64 - (self.bits - BLOCK))).astype(np.int64) << BLOCK
        return WORD_CELLS + block | ((hashes >> np.uint64(9)) & np.uint64((1 << BLOCK) - 1)).astype(np.int64)

    def symbols(self, words: list[bytes], ids: np.ndarray, before: np.ndarray):
        """Symbols of words, word of each, and keys of both contexts. before: class of the word before. A cell is a key xor a place."""
        c = self.coder
        known = ids < c.escape
        spelled = [words[k] for k in np.flatnonzero(~known)]
        n = np.ones(len(words), np.int64)
        n[~known] += np.array([len(w) + 1 for w in spelled], np.int64)
        of = np.repeat(np.arange(len(words)), n)
        head = np.zeros(len(of), bool)
        head[np.cumsum(n) - n] = True
        symbol, keys = np.empty(len(of), np.int64), np.empty((2, len(of)), np.int64)
        symbol[head], keys[0, head], keys[1, head] = ids, CLASSES * STRIDE, before * STRIDE
        if spelled:
            letters, *hashes = letter_contexts(spelled)
            symbol[~head] = letters + c.escape + 1
            keys[:, ~head] = [self.keys(h) for h in hashes]
        return symbol, of, keys


class Batch:
    """Documents: all words, each document's end behind it, with numbers, and with the class of the word before."""

    def __init__(self, c: Coder, documents: list[list[bytes]]):
        self.words = []
        for words in documents:
            self.words += words
            self.words.append(END)
        self.size = np.array([len(words) + 1 for words in documents], np.int64)
        self.first = np.cumsum(self.size) - self.size
        self.ids = np.fromiter(map(c.number.get, self.words, repeat(c.escape)), np.int64, len(self.words))
        known = self.ids < c.escape
        self.unknown = np.flatnonzero(~known)
        classes = np.zeros(len(self.ids), np.int64)
        classes[known] = c.classes[self.ids[known]]
        classes[~known] = np.array([class_of(self.words[k]) for k in self.unknown], np.int64)
        self.before = np.concatenate([[0], classes[:-1]])[: len(classes)]
        self.before[self.first] = c.classes[c.number[END]]  # a text begins as behind an end


def code(batch: Batch, chosen: list[int], model: Model) -> list[np.ndarray]:
    """Cost in nats of each word of the chosen documents."""
    c, k = model.coder, len(chosen)
    order = sorted(range(k), key=lambda d: -batch.size[chosen[d]])
    first, length = batch.first[[chosen[d] for d in order]], batch.size[[chosen[d] for d in order]]
    costs = [np.zeros(n) for n in length]
    weights = [np.tile(w / SCALE, k).astype(np.float32) for w in model.weights]  # by document and gate, for cells as they are
    rate = RATE / SCALE**2
    shift = np.tile(model.shift, k).astype(np.float32)
    for low in range(0, int(length[0]) if k else 0, WINDOW):
        live = int((length > low).sum())
        size = np.minimum(length[:live] - low, WINDOW)
        at = np.repeat(first[:live] + low - (np.cumsum(size) - size), size) + np.arange(size.sum())
        symbol, of, keys = model.symbols([batch.words[i] for i in at.tolist()], batch.ids[at], batch.before[at])
        doc = np.repeat(np.arange(live), size)[of]
        # stretches of all documents side by side
        within = np.arange(len(doc)) - np.searchsorted(doc, np.arange(live))[doc]
        stretch = within // STRETCH[1]
        if low == 0:
            stretch = np.where(within < SOON, within // STRETCH[0], stretch + (SOON // STRETCH[0] - SOON // STRETCH[1]))
        turn = np.argsort(stretch.astype(np.int16) if len(doc) < 1 << 15 else stretch, kind="stable")
        # a stretch at a time from here on, so that what each bit needs stays in a cache
        cuts = np.searchsorted(stretch[turn], np.arange(int(stretch.max()) + 2))
        symbol, gates, keys, price = symbol[turn], doc[turn] * GATES, keys[:, turn], np.empty(len(turn))
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            n = c.length[symbol[a:b]]
            begin = np.cumsum(n) - n
            step = np.repeat(c.offset[symbol[a:b]] - begin, n)
            step += np.arange(len(step))
            packed = c.packed[step]
            place, s = packed & 0xFFFF, (packed >> 23).astype(np.float32) - 1
            xs = [model.cells[np.repeat(k[a:b], n) ^ place].astype(np.float32) for k in keys]
            g = np.repeat(gates[a:b], n)
            g += packed >> 16 & 0x7F
            g += xs[1] != 0
            z = shift[g]
            for w, x in zip(weights, xs):
                z += w[g] * x
            np.clip(z, -LIMIT, LIMIT, out=z)
            z *= s
            e = np.exp(-z)
            more = 1 + e
            price[a:b] = np.add.reduceat(np.log(more), begin, dtype=np.float64)
            e /= more
            e *= s  # the bit less its probability
            last = int(gates[b - 1]) + GATES  # documents that have this stretch come first
            for w, x in zip(weights, xs):
                w[:last] += rate * np.bincount(g, e * x, last)
            shift[:last] += REFINE * np.bincount(g, e, last)
        per_word = np.bincount(of[turn], price, len(at))
        for d, (x, y) in enumerate(zip(np.cumsum(size) - size, np.cumsum(size))):
            costs[d][low : low + WINDOW] = per_word[x:y]
    out = [np.zeros(0)] * k
    for d, at in enumerate(order):
        out[at] = costs[d]
    return out


def chunks(c: Coder, batch: Batch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word, hash of the three words before, and hash of every chunk of the documents of a batch."""
    n = len(batch.ids)
    h = c.hashes[np.minimum(batch.ids, c.escape - 1)]
    h[batch.unknown] = np.array([xxhash.xxh64_intdigest(batch.words[k], 1) for k in batch.unknown.tolist()], np.uint64)
    at = np.arange(n)
    begin = np.repeat(batch.first, batch.size)
    before = lambda k: np.where(at - k >= begin, h[np.maximum(at - k, 0)], np.uint64(k))
    one, two = before(1), before(2)
    start = (mix(one * _M1 + two) & np.uint64(EVERY - 1)) == 0
    start[batch.first] = True
    start |= (at - np.maximum.accumulate(np.where(start, at, 0))) % CHUNK == 0
    first = np.flatnonzero(start)
    inside = at - np.repeat(first, np.diff(np.append(first, n)))
    found = mix(np.add.reduceat(h * _POWERS[inside], first)) if n else h
    context = mix((one * _M1 + two) * _M2 + before(3))
    return first, context[first].view(np.int64), found.view(np.int64)


def logits_of(ones: np.ndarray, zeros: np.ndarray) -> np.ndarray:
    return np.clip(np.rint(np.log((ones + ADD) / (zeros + ADD)) * SCALE), -127, 127).astype(np.int8)


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Parts of batches that are small once their words are Python objects."""
    for batch in batches:
        for at in range(0, batch.num_rows, _ROWS):
            yield batch.slice(at, _ROWS)


def _words(batch: pa.RecordBatch) -> list[list[bytes]]:
    return [t.lower().split() for t in batch.column("text").cast(pa.binary()).to_pylist()]


def _gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of tokens in a task's documents, told whenever they are many."""
    tokens: Counter = Counter()

    def told() -> pa.RecordBatch:
        out = pa.record_batch([pa.array([t.decode() for t in tokens], pa.string()), pa.array(tokens.values(), pa.int64())], names=["token", "n"])
        tokens.clear()
        return out

    for batch in _slices(batches):
        for words in _words(batch):
            tokens.update(words)
            tokens[END] += 1
        if len(tokens) > 300_000:
            yield told()
    if tokens:
        yield told()


def _combined(keys: list[np.ndarray], counts: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    if keys:
        k, n = np.concatenate(keys), np.concatenate(counts)
        keys.clear()
        counts.clear()
        order = np.argsort(k)
        k, n = k[order], n[order]
        first = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
        k, n = k[first], np.add.reduceat(n, first)
        for i in range(0, len(k), 100_000):
            yield pa.record_batch([pa.array(k[i : i + 100_000], pa.int64()), pa.array(n[i : i + 100_000], pa.int64())], names=["key", "n"])


def word_counts(c: Coder):
    """Counts of (class before, symbol) of documents, as one number."""

    def told(keys: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        if keys:
            k = np.sort(np.concatenate(keys))
            keys.clear()
            first = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
            n = np.diff(np.append(first, len(k)))
            for i in range(0, len(first), 100_000):
                yield pa.record_batch([pa.array(k[first[i : i + 100_000]], pa.int32()), pa.array(n[i : i + 100_000], pa.int64())], names=["key", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys: list[np.ndarray] = []
        for part in _slices(batches):
            batch = Batch(c, _words(part))
            keys.append((batch.before * (c.escape + 1) + batch.ids).astype(np.int32))
            if sum(map(len, keys)) > 2 * _FLUSH:
                yield from told(keys)
        yield from told(keys)

    return run


def letter_shares(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of the letters and the stop of tokens."""
    total = np.zeros(257, np.int64)
    for batch in batches:
        words, n = batch["token"].cast(pa.binary()).to_pylist(), batch["n"].to_numpy()
        total[:256] += np.bincount(np.frombuffer(b"".join(words), np.uint8), np.repeat(n, [len(w) for w in words]), 256).astype(np.int64)
        total[STOP] += n.sum()
    at = np.flatnonzero(total)
    yield pa.record_batch([pa.array(at), pa.array(total[at])], names=["key", "n"])


def letter_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of (context hash but for its last nine bits, letter) of tokens, as one number."""
    keys, counts = [], []
    for batch in batches:
        for at in range(0, batch.num_rows, 20_000):
            part = batch.slice(at, 20_000)
            words = part["token"].cast(pa.binary()).to_pylist()
            letters, *hashes = letter_contexts(words)
            n = np.repeat(part["n"].to_numpy(), [len(w) + 1 for w in words])
            for h in hashes:
                keys.append((h >> np.uint64(9) << np.uint64(9)).view(np.int64) | letters)
                counts.append(n)
            if sum(map(len, keys)) > _FLUSH:
                yield from _combined(keys, counts)
    yield from _combined(keys, counts)


def _tally(c: Coder, symbols: np.ndarray, n: np.ndarray, cell, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Of cells: how many ones and zeros they met, from counts of symbols; ``cell`` gives a symbol's cell of a place."""
    of, step = c.steps(symbols)
    at, n, bit = cell(of, c.place[step]), n[of].astype(float), c.bit[step]
    return np.bincount(at, n * bit, size), np.bincount(at, n * (1 - bit.astype(float)), size)


def case(gate, x0, x1, bit):
    """A gate, what both tables say and the bit that came, as one number below CASES."""
    return ((gate + (x1 != 0)).astype(np.int64) << 8 | x0.astype(np.int64) + 128) << 9 | (x1.astype(np.int64) + 128) << 1 | bit


CASES = GATES << 17


def word_cases(c: Coder, ones: np.ndarray, zeros: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cases of the bits that nodes met behind one class, each without itself in either table, and how often they came."""
    keys, counts = [], []
    for bit, met in ((1, ones), (0, zeros)):
        at = np.flatnonzero(met[: c.nodes])
        x0, x1 = (logits_of(a[at] - bit, b[at] - (1 - bit)) for a, b in (c.met[::-1], (ones, zeros)))
        keys.append(case(c.node_gate[at], x0, x1, bit))
        counts.append(met[at])
    return _added(np.concatenate(keys), np.concatenate(counts))


def _added(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    keys, of = np.unique(keys, return_inverse=True)
    return keys, np.bincount(of, counts, len(keys))


def sizes_of(ones: np.ndarray, zeros: np.ndarray) -> np.ndarray:
    """How much cells met, as a byte: itself below 128, a logarithm above."""
    n = ones + zeros
    return np.where(n < 128, n, np.minimum(128 + np.rint(np.log2(np.maximum(n, 128) / 128) * 6), 255)).astype(np.uint8)


def without(x: np.ndarray, size: np.ndarray, bit: np.ndarray) -> np.ndarray:
    """Logits of cells had they not met one of such bits, from their logits and sizes (exact but for the rounding of both)."""
    total = np.where(size < 128, size, np.rint(128 * np.exp2((size.astype(np.float32) - 128) / 6)))
    ones = np.rint(np.clip((total + 2 * ADD) / (1 + np.exp(x.astype(np.float32) / -SCALE)) - ADD, 0, total))
    return logits_of(np.maximum(ones - bit, 0), np.maximum(total - ones - (1 - bit.astype(np.float32)), 0))


def letter_cases(model: Model, sizes: np.ndarray):
    """Cases of the letters' bits of tokens, each without itself in either table, and how often they came."""
    base = DEPTHS * 2 << 17  # gates of letters are behind those of words

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, found = model.coder, np.zeros(CASES - base)
        for batch in batches:
            for at in range(0, batch.num_rows, 5000):
                part = batch.slice(at, 5000)
                words = part["token"].cast(pa.binary()).to_pylist()
                letters, *hashes = letter_contexts(words)
                of, step = c.steps(letters + c.escape + 1)
                bit, cells = c.bit[step], [model.keys(h)[of] ^ c.place[step] for h in hashes]
                x0, x1 = (without(model.cells[at], sizes[at - WORD_CELLS], bit) for at in cells)
                n = np.repeat(part["n"].to_numpy(), [len(w) + 1 for w in words])
                found += np.bincount(case(c.gate[step], x0, x1, bit) - base, n[of], len(found))
        at = np.flatnonzero(found)
        for i in range(0, len(at), 100_000):
            yield pa.record_batch([pa.array(at[i : i + 100_000] + base, pa.int64()), pa.array(found[at[i : i + 100_000]])], names=["key", "n"])

    return run


def fit(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weights and shift of each gate that make cases, so often as they came, likeliest (Newton's method, drawn to START)."""
    at = np.flatnonzero(counts)
    n, gate, sign = counts[at], at >> 17, (at & 1) * 2.0 - 1
    x = np.array([np.ones(len(at)), ((at >> 9 & 255) - 128) / SCALE, ((at >> 1 & 255) - 128) / SCALE])
    start = np.array([0.0, *START])
    w = np.tile(start, (GATES, 1))

    def loss(w: np.ndarray) -> np.ndarray:
        z = np.clip((w[gate].T * x).sum(0), -LIMIT, LIMIT) * sign
        return np.bincount(gate, n * np.logaddexp(0, -z), GATES) + FIRM / 2 * ((w - start) ** 2).sum(1)

    now = loss(w)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip((w[gate].T * x).sum(0), -LIMIT, LIMIT)))
        slope = np.array([np.bincount(gate, n * ((sign > 0) - p) * a, GATES) for a in x]).T - FIRM * (w - start)
        bend = np.array([[np.bincount(gate, n * p * (1 - p) * a * b, GATES) for b in x] for a in x]).transpose(2, 0, 1) + FIRM * np.eye(3)
        step, part = np.linalg.solve(bend, slope[:, :, None])[:, :, 0], np.ones((GATES, 1))
        for _ in range(20):  # halved where it would make things worse
            then = loss(w + part * step)
            worse = then > now
            if not worse.any():
                break
            part[worse] /= 2
        w += np.where(worse[:, None], 0, part * step)
        gain, now = (now - np.where(worse, now, then)).sum(), np.where(worse, now, then)
        if gain < 1e-6 * max(1.0, now.sum()):
            break
    return w[:, 1:].T, w[:, 0]


def train(docs: DataFrame, frequent: int = FREQUENT) -> tuple[DataFrame, pa.Table, int, Model]:
    """(token, n) of all training tokens, the frequent ones, the least count among them (as in ``_least``), and the model."""
    spark = docs.sparkSession
    ship(spark)
    docs = docs.select("text")
    vocabulary = durable(docs.mapInArrow(_gather, "token string, n long").groupBy("token").agg(F.sum("n").alias("n")))
    bucket, short = F.floor(F.log2("n") * 8), F.octet_length("token") <= TOKEN_BYTES
    least = _least(vocabulary.where(short), frequent)
    # ``frequent`` rows of at most TOKEN_BYTES
    common = vocabulary.where(short & (bucket >= least)).select(F.col("token").cast("binary").alias("token"), "n").orderBy(F.desc("n"), "token").toArrow().combine_chunks()
    often = common.filter(pc.greater_equal(common["n"], LEAST)).slice(0, VOCABULARY)
    words, counts = often["token"].to_pylist(), often["n"].to_pylist()
    # all others come behind the last of these: told by columns, as a second Python step would double a task's workers
    rare = vocabulary.where(F.col("token") != END.decode())
    if words:
        rare = rare.where(~short | (F.col("n") < counts[-1]) | ((F.col("n") == counts[-1]) & (F.col("token").cast("binary") > F.lit(words[-1]))))
    shares, total, different = np.zeros(257), *vocabulary.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    for k, n in rare.mapInArrow(letter_shares, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).collect():  # 257 rows at most
        shares[k] = n
    coder = Coder(words, counts, int(total) - sum(counts), shares)
    bits = min(MAX_BITS, max(MIN_BITS, (16 * different).bit_length()))
    sent = spark.sparkContext.broadcast(coder)
    cells = np.zeros(WORD_CELLS + (1 << bits), np.int8)
    cells[CLASSES * STRIDE :][: len(coder.logits)] = np.clip(np.rint(coder.logits * SCALE), -127, 127)
    # so many groups of blocks that each has about GROUP_KEYS keys, one per block at most
    parts = min(bits - BLOCK, max(4, (different // (GROUP_KEYS // 8)).bit_length()))
    width, region = coder.escape + 1, 1 << (bits - parts)

    def word_table(t: pa.Table) -> pa.Table:
        c, of, key = sent.value, t["c"][0].as_py(), t["key"].to_numpy()
        ones, zeros = _tally(c, key % width, t["n"].to_numpy(), lambda _, place: place, STRIDE)
        keys, n = word_cases(c, ones, zeros)
        columns = {"cells": logits_of(ones, zeros), "keys": keys.astype(np.int32), "n": n}
        return pa.table({"at": pa.array([of], pa.int64())} | {k: pa.array([v.tobytes()], pa.binary()) for k, v in columns.items()})

    def letter_table(t: pa.Table) -> pa.Table:
        c, of, key = sent.value, t["c"][0].as_py(), t["key"].to_numpy().view(np.uint64)
        own = Model(c, cells=None, bits=bits, weights=None, shift=None).keys(key) - WORD_CELLS - of * region
        ones, zeros = _tally(c, (key & np.uint64(511)).astype(np.int64) + c.escape + 1, t["n"].to_numpy(), lambda e, place: own[e] ^ place, region)
        return pa.table({"at": pa.array([of], pa.int64()), "cells": pa.array([logits_of(ones, zeros).tobytes()], pa.binary()), "sizes": pa.array([sizes_of(ones, zeros).tobytes()], pa.binary())})

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from word_counts(sent.value)(batches)

    release(spark)
    cases = np.zeros(CASES)
    pairs = docs.mapInArrow(count, "key int, n long").groupBy("key").agg(F.sum("n").alias("n"))
    tables = pairs.withColumn("c", F.floor(F.col("key") / width)).groupBy("c").applyInArrow(word_table, "at long, cells binary, keys binary, n binary")
    for at, got, keys, n in tables.toLocalIterator():  # CLASSES rows of a byte a node, and of at most two cases a node
        cells[at * STRIDE : (at + 1) * STRIDE] = np.frombuffer(got, np.int8)
        cases[np.frombuffer(keys, np.int32)] += np.frombuffer(n)
    del pairs, tables  # their shuffles are as large as the corpus's own
    release(spark)
    letters = rare.mapInArrow(letter_counts, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    tables, sizes = letters.withColumn("c", F.shiftrightunsigned("key", 64 - parts)).groupBy("c").applyInArrow(letter_table, "at long, cells binary, sizes binary"), np.zeros(1 << bits, np.uint8)
    for at, got, size in tables.toLocalIterator():  # 2 * 2 ** MAX_BITS bytes in all
        low = WORD_CELLS + at * region
        cells[low : low + region] = np.frombuffer(got, np.int8)
        sizes[low - WORD_CELLS :][:region] = np.frombuffer(size, np.uint8)
    del letters, tables
    release(spark)
    model = Model(coder, cells, bits, np.repeat(np.array(START)[:, None], GATES, 1), np.zeros(GATES))
    tried = spark.sparkContext.broadcast((model, sizes))

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from letter_cases(*tried.value)(batches)

    found = rare.mapInArrow(spell, "key long, n double").groupBy("key").agg(F.sum("n").alias("n")).toArrow()  # CASES / 2 rows at most
    cases[found["key"].to_numpy()] += found["n"].to_numpy()
    model.weights, model.shift = fit(cases)
    for used in (sent, tried):  # their files would stay on every executor
        used.destroy()
    return vocabulary, common, least, model


def _least(vocabulary: DataFrame, limit: int) -> int:
    """The least count that at most ``limit`` tokens have, as a power of 2 ** (1 / 8)."""
    bucket = F.floor(F.log2("n") * 8)
    found = {int(r.b): r.k for r in vocabulary.groupBy(bucket.alias("b")).agg(F.count("*").alias("k")).collect()}  # 8 * 63 rows at most
    total, least = 0, max(found, default=0) + 1
    for b in sorted(found, reverse=True):
        total += found[b]
        if total > limit:
            break
        least = b
    return least


def repeats(rid: np.ndarray, held: np.ndarray, context: np.ndarray, chunk: np.ndarray, n: np.ndarray, of: np.ndarray, nats: np.ndarray) -> np.ndarray:
    """What each chunk changes its document's cost by, as it goes on as others do or not. Rows are in order, document by
    document. n, of: training counts of (context, chunk) and of context."""
    def earlier(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How often each value was there before, and is there at all."""
        order = np.argsort(values, kind="stable")
        first = np.r_[True, values[order][1:] != values[order][:-1]]
        begin = np.flatnonzero(first)
        size = np.diff(np.append(begin, len(values)))
        rank, whole = np.empty(len(values), np.int64), np.empty(len(values), np.int64)
        rank[order], whole[order] = np.arange(len(values)) - np.repeat(begin, size), np.repeat(size, size)
        return rank, whole

    if not len(rid):
        return np.zeros(0)
    document = mix(rid.view(np.uint64) + _P)
    own_of, all_of = earlier(mix(document ^ context.view(np.uint64)))
    own_n, all_n = earlier(mix(mix(document ^ context.view(np.uint64)) * _M1 + chunk.view(np.uint64)))
    n, of = n + own_n - np.where(held, 0, all_n), of + own_of - np.where(held, 0, all_of)
    out, told = np.zeros(len(rid)), np.flatnonzero(of > 0)
    if not len(told):
        return out
    n, of, rid = n[told], of[told], rid[told]
    hit = n > 0
    last = np.r_[2, hit[:-1].astype(int)]  # whether the chunk before went on; 2: none before
    last[np.r_[True, rid[1:] != rid[:-1]]] = 2
    # what was told before in the same document at the same gate
    gate = last * 2 + (of > 1)
    order = np.lexsort((np.arange(len(rid)), gate, rid))
    begin = np.flatnonzero(np.r_[True, (rid[order][1:] != rid[order][:-1]) | (gate[order][1:] != gate[order][:-1])])
    start = np.repeat(begin, np.diff(np.append(begin, len(rid))))
    hits = np.cumsum(hit[order]) - hit[order]
    p = np.empty(len(rid))
    p[order] = (hits - hits[start] + PRIOR * np.array([0.15, 0.9, 0.4])[last[order]]) / (np.arange(len(rid)) - start + PRIOR)
    out[told] = np.where(hit, -np.log(p) + np.log(of / np.maximum(n, 1)) - nats[told], -np.log1p(-p))
    return out


def _apply_repeats(t: pa.Table) -> pa.Table:
    t = t.sort_by([("rid", "ascending"), ("at", "ascending")])
    rid, *columns = (t[c].to_numpy() for c in ("rid", "held_out", "context", "chunk", "n", "of", "nats"))
    first = np.flatnonzero(np.r_[True, rid[1:] != rid[:-1]]) if len(rid) else np.zeros(0, np.int64)
    change = repeats(rid, *columns)
    return pa.table({"rid": pa.array(rid[first]), "change": pa.array(np.add.reduceat(change, first) if len(rid) else change)})


def score(docs: DataFrame, frequent: int = FREQUENT) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_bytes and bits_per_byte of every row."""
    spark = docs.sparkSession
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % FOLDS == HELD_OUT, F.lit(False))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held.alias("held_out"), nullable_text().alias("text"))
    vocabulary, common, least, model = train(rows.where(~held), frequent)
    n, v = vocabulary.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    # plain columns and arrays: the driver makes no object of each token
    sent, whole = spark.sparkContext.broadcast((common, model)), float(n + v + 1)
    del common, model

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent, model = sent.value
        logs = dict(zip(frequent["token"].to_pylist(), np.log10(frequent["n"].to_numpy() + 1.0).tolist()))
        known_logs = np.array([logs.get(w, -1.0) for w in model.coder.number])
        rare_type = pa.list_(pa.struct([("token", pa.string()), ("k", pa.int64())]))
        for part in _slices(batches):
            documents = _words(part)
            batch = Batch(model.coder, documents)
            log = np.full(len(batch.words), -1.0)
            at = np.flatnonzero(batch.ids < model.coder.escape)
            log[at] = known_logs[batch.ids[at]]
            log[batch.unknown] = [logs.get(batch.words[k], -1.0) for k in batch.unknown.tolist()]
            seen, first = log >= 0, batch.first
            sums, known = (np.add.reduceat(v, first) if len(first) else v for v in (np.where(seen, log, 0.0), seen.astype(np.int64)))
            rare = [Counter() for _ in documents]
            for k, d in zip(np.flatnonzero(~seen).tolist(), np.repeat(np.arange(len(documents)), batch.size)[~seen].tolist()):
                rare[d][batch.words[k]] += 1
            cost = np.zeros(len(batch.words))
            order = np.argsort(batch.size, kind="stable").tolist()  # groups of like lengths
            for at in range(0, len(order), DOCS):
                group = order[at : at + DOCS]
                for d, own in zip(group, code(batch, group, model)):
                    cost[batch.first[d] : batch.first[d] + batch.size[d]] = own
            first, context, chunk = chunks(model.coder, batch)
            cuts = np.append(np.searchsorted(first, batch.first), len(first)).astype(np.int32)
            lists = [pa.ListArray.from_arrays(cuts, pa.array(v)) for v in (context, chunk, np.add.reduceat(cost, first).astype(np.float32) if len(first) else np.zeros(0, np.float32))]
            yield pa.record_batch([
                part["rid"], part["doc_id"], part["held_out"], pa.array(batch.size), pa.array(known), pa.array(sums), pa.array(np.add.reduceat(cost, batch.first) if len(cost) else cost),
                pa.array([sum(map(len, w)) + max(1, len(w)) for w in documents], pa.int64()), pa.array([[{"token": t.decode(), "k": k} for t, k in c.items()] for c in rare], rare_type), *lists,
            ], names=["rid", "doc_id", "held_out", "n_tokens", "known", "logs", "nats", "n_bytes", "rare", "contexts", "chunks", "costs"])

    schema = "rid long, doc_id long, held_out boolean, n_tokens long, known long, logs double, nats double, n_bytes long, rare array<struct<token:string,k:long>>, contexts array<long>, chunks array<long>, costs array<float>"
    scored = durable(rows.withColumn("rid", F.monotonically_increasing_id()).mapInArrow(run, schema))
    few = vocabulary.where((F.floor(F.log2("n") * 8) < least) | (F.octet_length("token") > TOKEN_BYTES))
    rare = scored.select("rid", F.explode("rare").alias("r")).select("rid", "r.token", "r.k")
    more = rare.join(few, "token").groupBy("rid").agg(F.sum(F.col("k") * F.log10(F.col("n") + 1)).alias("more"), F.sum("k").alias("seen"))
    changes = _changes(scored)
    base = F.col("logs") + F.coalesce("more", F.lit(0.0)) - F.col("n_tokens") * F.lit(math.log10(whole))
    done = scored.drop("rare", "contexts", "chunks", "costs").join(more, "rid", "left").join(changes, "rid", "left").withColumn("nats", F.col("nats") + F.coalesce("change", F.lit(0.0)))
    return done.select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("seen", F.lit(0))).alias("n_known"), F.lit(int(n)).cast("long").alias("train_tokens"),
        base.alias("base_score"), (F.col("nats") * (-1 / math.log(10))).alias("score"), "n_bytes", (F.col("nats") / math.log(2) / F.col("n_bytes")).alias("bits_per_byte"),
    )


def _changes(scored: DataFrame) -> DataFrame:
    """(rid, change): what the bits before chunks change in documents' costs. Contexts that occur once are left out."""
    pieces = scored.select("rid", "held_out", F.posexplode(F.arrays_zip("contexts", "chunks", "costs")).alias("at", "p"))
    pieces = pieces.select("rid", "held_out", "at", F.col("p.contexts").alias("context"), F.col("p.chunks").alias("chunk"), F.col("p.costs").alias("nats"))
    contexts = durable(pieces.groupBy("context").agg(F.count("*").alias("all"), F.count_if(~F.col("held_out")).alias("of")).where("all > 1"))
    total = contexts.agg(F.coalesce(F.sum("all"), F.lit(0))).first()[0]
    release(scored.sparkSession)
    met = durable(spread_join(pieces, contexts, ["context"], "all", total).drop("all"))
    release(scored.sparkSession)
    counts = met.groupBy("context", "chunk").agg(F.count("*").alias("k"), F.count_if(~F.col("held_out")).alias("n"))
    met = spread_join(met, counts, ["context", "chunk"], "k", total).select("rid", "held_out", "at", "context", "chunk", "n", "of", "nats")
    groups = max(1, total // 100_000)
    return met.groupBy(F.pmod(F.xxhash64("rid"), F.lit(groups)).alias("g")).applyInArrow(_apply_repeats, "rid long, change double")
