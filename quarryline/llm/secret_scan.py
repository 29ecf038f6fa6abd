"""Secrets in texts: patterns of known forms, and character Markov models for the rest.

Base kinds: assign (a value of 12 or more characters given to a name like password), access (AKIA and 14 or
more capitals or digits) and hex (16 or more hex digits). The method adds kind random: any other run of
MIN_RUN or more characters of ALPHABET whose log-likelihood ratio between two first-order Markov models,
one of random strings and one of ordinary identifiers, is over the model's margin a pair of characters. Runs
without a letter or of fewer than MIN_DISTINCT different characters are none, whatever their ratio. Both
models are counted by Spark from labelled samples (``samples``, or a table of the caller's own) before the scan;
a fifth of the samples is kept out of the counts, and the margin is the ratio that one in 1 / FALSE_ALARMS of the
ordinary ones of that fifth exceeds. The ratios are one table of 67 * 67 numbers, whatever the input, and
scoring adds table entries. Every span, base or not, is told with its ratio.

All of it is DataFrame functions: nothing is shuffled but the samples' counts. Defined results: null text
counts as empty; empty text has no spans; repeated rows and null ids are treated like any other; columns of
any other names pass through ``annotate``; without samples of a class nothing is random.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import nullable_text
from .spans import listed, with_spans

KINDS = ("assign", "access", "hex", "random")
BASE_KINDS = KINDS[:3]
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-="
MIN_RUN, MIN_VALUE, MIN_DISTINCT, SAMPLES, FALSE_ALARMS = 20, 12, 8, 6000, 0.001
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
PATTERNS = {
    "assign": ASSIGN,
    "access": r"AKIA[A-Z0-9]{14,}+",
    "hex": r"[0-9a-f]{16,}+",
    "random": rf"[A-Za-z0-9+/_=-]{{{MIN_RUN},}}+",
}
#: Parts of ordinary identifiers and words, the labelled samples of that class.
WORDS = (
    "get set add remove update create delete find list read write open close start stop init load save send receive parse format print "
    "user name value index count total size length width height color style class object string number array table column row field key "
    "file path folder image document page header footer button menu window dialog message error warning request response session cookie "
    "server client network address service manager factory builder handler listener controller model view template config option setting "
    "average maximum minimum temperature international information understanding government development organization environment different "
    "nachricht verzeichnis einstellung geschwindigkeit zeichenkette verarbeitung benutzer ereignis freundschaft bedeutung schreiben lichkeit "
    "développement utilisateur connaissance gouvernement important bibliotheque lentement maintenant question mouvement appartement nation "
    "usuario contraseña desarrollo conocimiento gobierno informacion internacional rapidamente corazon ciudad nacion trabajadores comunicacion"
).split()


ONSETS, VOWELS, CODAS = "b br c ch d dr f g gr h j k l m n p pr qu r s sch sh st t th tr v w z".split(), "a e i o u ai ea ei ou y".split(), "n r s t l nd st ng m ' '".replace("' '", "-").split()


def samples(spark: SparkSession, n: int = SAMPLES) -> DataFrame:
    """(is_random, text): n strings of either class, the same in every run.

    Random: digests in base 64, cut to letters and digits, or those in one case. Ordinary: two to four words, of WORDS
    or of made-up syllables, in one of the usual forms (a_b, aB, a-b, ab, A_B, a/b, and with a number behind).
    """
    ids = spark.range(n, numPartitions=1)
    digest = F.base64(F.unhex(F.sha2(F.col("id").cast("string"), 256)))
    plain = F.regexp_replace(digest, "[^A-Za-z0-9]", "")
    kind = F.col("id") % 4
    random = F.when(kind == 0, F.substring(digest, 1, 43)).when(kind == 1, plain).when(kind == 2, F.lower(plain)).otherwise(F.upper(plain))
    pick = lambda xs, salt: F.element_at(F.lit(xs), (F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(len(xs))) + 1).cast("int"))

    def word(k: int) -> Column:
        made = F.concat(*(pick(xs, f"{k} {j} {i}") for j in range(3) for i, xs in enumerate((ONSETS, VOWELS))), F.replace(pick(CODAS, f"{k} coda"), F.lit("-"), F.lit("")))
        return F.when(F.pmod(F.xxhash64("id", F.lit(f"made {k}")), F.lit(2)) == 0, made).otherwise(pick(WORDS, f"word {k}"))

    parts = [word(0), word(1), F.when(F.col("id") % 3 > 0, word(2)), F.when(F.col("id") % 3 > 1, word(3))]
    form = F.pmod(F.xxhash64("id", F.lit("form")), F.lit(7))
    joined = lambda sep, p=parts: F.concat_ws(sep, *p)
    ordinary = (
        F.when(form == 0, joined("_")).when(form == 1, joined("", [parts[0], *(F.initcap(p) for p in parts[1:])])).when(form == 2, joined("-")).when(form == 3, F.upper(joined("_")))
        .when(form == 4, joined("/")).when(form == 5, F.concat(joined("_"), F.lit("_"), F.col("id").cast("string"))).otherwise(joined(""))
    )
    return ids.select(F.lit(True).alias("is_random"), random.alias("text")).union(ids.select(F.lit(False).alias("is_random"), ordinary.alias("text")))


def _class(c: Column) -> Column:
    """Number of a character's class; -1 outside the alphabet."""
    return F.instr(F.lit(ALPHABET), c) - 1


@dataclass(frozen=True)
class Model:
    """Log-likelihood ratios, random against ordinary, of each pair (first * 67 + second), and the margin."""

    ratios: tuple[float, ...]
    margin: float


def train(labelled: DataFrame) -> Model:
    """The model of samples (is_random, text), with one added to each count. Null labels and texts are left out."""
    rows = labelled.where("is_random IS NOT NULL AND text IS NOT NULL").select("is_random", "text", (F.pmod(F.xxhash64("text"), F.lit(5)) == 0).alias("held"))
    chars = rows.where(~F.col("held")).select("is_random", F.filter(F.split("text", ""), lambda c: (c != "") & (_class(c) >= 0)).alias("cs")).where(F.size("cs") > 1)
    pairs = chars.select("is_random", F.explode(F.transform(F.sequence(F.lit(1), F.size("cs") - 1), lambda i: F.struct(_class(F.element_at("cs", i)).alias("a"), _class(F.element_at("cs", i + 1)).alias("b")))).alias("p"))
    counts = {(r.is_random, r.a, r.b): r.n for r in pairs.groupBy("is_random", "p.a", "p.b").agg(F.count("*").alias("n")).collect()}  # 2 * 67 * 67 rows at most
    k = len(ALPHABET)
    out = []
    for a in range(k):
        total = {c: sum(counts.get((c, a, b), 0) for b in range(k)) + k for c in (True, False)}
        out += [math.log((counts.get((True, a, b), 0) + 1) / total[True]) - math.log((counts.get((False, a, b), 0) + 1) / total[False]) for b in range(k)]
    ratio = ratio_of(F.col("text"), _table(out))
    seen = {r.is_random: r.q for r in rows.where("held").groupBy("is_random").agg(F.percentile(ratio, 1 - FALSE_ALARMS).alias("q")).collect()}  # two rows at most
    margin = max(0.0, seen[False]) if {True, False} <= {c for c, _, _ in counts} and False in seen and seen[False] is not None else math.inf
    return Model(tuple(out), margin)


def _table(ratios) -> Column:
    return F.split(F.lit(",".join(f"{r:.5f}" for r in ratios)), ",").cast("array<double>")  # folded into one constant


def ratio_of(value: Column, table: Column) -> Column:
    """Mean log-likelihood ratio of the pairs of a string; a character outside the alphabet parts it. 0 without a pair."""
    codes = F.transform(F.filter(F.split(value, ""), lambda c: c != ""), _class)

    def step(acc: Column, c: Column) -> Column:
        pair = (acc["last"] >= 0) & (c >= 0)
        more = F.when(pair, F.element_at(table, F.when(pair, acc["last"] * len(ALPHABET) + c + 1).otherwise(1))).otherwise(0.0)
        return F.struct(c.alias("last"), (acc["sum"] + more).alias("sum"), (acc["n"] + pair.cast("int")).alias("n"))

    return F.aggregate(codes, F.struct(F.lit(-1).alias("last"), F.lit(0.0).alias("sum"), F.lit(0).alias("n")), step, lambda acc: acc["sum"] / F.greatest(acc["n"], F.lit(1)))


def annotate(docs: DataFrame, text: str = "text", out: str = "secrets", model: Model | None = None) -> DataFrame:
    """Add ``out``: array of (start, kind number, end, kind, ratio), by start and then by kind. model: one trained before."""
    model = model or train(samples(docs.sparkSession))
    table = _table(model.ratios)
    kept = [c for c in docs.columns if c != out]
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in kept)).alias("row"), nullable_text(f"`{text}`").alias("text"))  # no name of theirs can clash
    needs = {"assign": F.contains("text", F.lit("=")) | F.contains("text", F.lit(":")), "access": F.contains("text", F.lit("AKIA"))}
    rows = with_spans(rows, {k: (PATTERNS[k], needs.get(k)) for k in KINDS}, "text")
    value = lambda k, s: F.regexp_extract(s["value"], ASSIGN, 2) if k == "assign" else s["value"]
    put = lambda k: lambda s: F.struct(s["start"].alias("start"), F.lit(KINDS.index(k)).alias("order"), s["end"].alias("end"), F.lit(k).alias("kind"), ratio_of(value(k, s), table).alias("ratio"))
    rows = rows.withColumn("assign", F.filter("assign", lambda s: F.length(value("assign", s)) >= MIN_VALUE))
    rows = rows.withColumn("base", F.concat(*(F.transform(k, put(k)) for k in BASE_KINDS)))
    varied = lambda s: s["value"].rlike("[A-Za-z]") & (F.size(F.array_distinct(F.split(s["value"], ""))) >= MIN_DISTINCT)
    free = lambda s: ~F.exists("base", lambda b: (b["start"] < s["end"]) & (b["end"] > s["start"]))
    more = F.filter(F.transform(F.filter(F.filter("random", varied), free), put("random")), lambda s: s["ratio"] > model.margin)
    return rows.withColumn("found", F.array_sort(F.concat("base", more))).select("row.*", F.col("found").alias(out))


def scan(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """Per row: doc_id, the number of spans of each base kind, the digest of the base spans, all spans and their ratios."""
    found = annotate(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), model=model)
    of = lambda *kinds: F.filter("secrets", lambda s: s["kind"].isin(*kinds))
    return found.select(
        "doc_id", *(F.size(of(k)).cast("long").alias(f"n_{k}") for k in BASE_KINDS),
        F.sha2(listed(of(*BASE_KINDS)), 256).alias("base_sha256"), listed(F.col("secrets")).alias("spans"), F.size(of("random")).cast("long").alias("n_random"),
        F.array_join(F.transform("secrets", lambda s: F.format_number(s["ratio"], 3)), ",").alias("ratios"),
    )
