"""The pipeline's stages against brute force over the small tables."""

import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quarryline.llm import packing, pii, quality_gam, secret_scan

from .test_near_copies import shingles, similarity
from .test_operators import brute_containment, least_reachable


def test_stages(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    columns, rows = docs.columns, {r.doc_id: r for r in docs.collect()}
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality", "near_duplicates", "benchmark_passages", "personal_data", "packing"]
    run = lambda name, d: stages[name](spark, d, small).cache()

    good = run("quality", docs)
    scores = {r.doc_id: r.predicted for r in quality_gam.classify(docs, spark.read.parquet(f"{small}/labels.parquet")).collect()}
    assert good.columns == columns and {r.doc_id for r in good.collect()} == {i for i, p in scores.items() if p == 1}

    single = run("near_duplicates", good)
    ids = sorted(r.doc_id for r in good.collect())
    sets = [shingles(rows[i].text) for i in ids]  # a stage takes five words and 0.8, not op2's contract
    roots = least_reachable(ids, lambda k: [j for j in range(len(ids)) if similarity(sets[j], sets[k]) >= 0.8])
    assert single.columns == columns and {r.doc_id for r in single.collect()} == {ids[k] for k in set(roots)}

    clean = run("benchmark_passages", single)
    items = [tuple(r) for r in spark.read.parquet(f"{small}/benchmark.parquet").select("item_id", "text").collect()]
    leaked = {d for d, *_ in brute_containment([(r.doc_id, r.text) for r in single.collect()], items)}
    assert leaked and {r.doc_id for r in clean.collect()} == {r.doc_id for r in single.collect()} - leaked

    private = run("personal_data", clean)
    assert private.columns == columns and private.count() == clean.count()
    for r in private.collect():
        assert r.n_chars == len(r.text) and not re.search(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r.text)
    assert pii.scan(private).agg(F.sum(F.expr("n_email + n_card + n_ip + n_phone"))).first()[0] == 0

    key = lambda d: sorted((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in d.collect())
    packed = run("packing", private)
    assert key(packed) == key(packing.pack(private)) == key(corpus_pipeline.run(spark, small))


def test_odd_rows(spark, small):
    rows = [(None, "the quick brown fox jumps over a dog"), (None, "the quick brown fox jumps over a dog"), (None, "another text without any id at all"), (7, "x y z"), (7, "x y z"), (7, "q w e r t y"), (8, None), (9, "")]
    df = spark.createDataFrame([(i, t, None, None, 3) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").withColumn("score", F.lit(1)).withColumn("predicted", F.lit("x"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, df, small).columns == df.columns and stage(spark, df.limit(0), small).count() == 0
    kept = sorted(((r.doc_id or 0, r.text or "") for r in corpus_pipeline.near_duplicates(spark, df, small).collect()))
    assert kept == sorted([(0, "another text without any id at all"), (0, rows[0][1]), (7, "q w e r t y"), (7, "x y z"), (8, "")])


CLASHING = "_text _own _hash _quality _pii _drop_doc_id _id score predicted fp rid row key keys hash node item pii secrets number random n text_id".split()


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES[:-1]])
def test_columns_of_any_name_pass_through(spark, small, name):
    docs = spark.read.parquet(f"{small}/documents.parquet").where("doc_id < 60")
    odd = docs.select("*", *(F.concat(F.lit(c), F.col("doc_id").cast("string")).alias(c) for c in CLASHING))
    stage = dict(corpus_pipeline.STAGES)[name]
    got, want = stage(spark, odd, small), stage(spark, docs, small)
    assert got.columns == odd.columns
    assert sorted(got.select(docs.columns).collect()) == sorted(want.collect())
    assert all(r[c] == f"{c}{r.doc_id}" for r in got.collect() for c in CLASHING)


def test_annotators_keep_columns(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").where("doc_id < 20")
    odd = docs.select("*", *(F.lit(c).alias(c) for c in CLASHING))
    for run, out in ((pii.annotate, "pii"), (secret_scan.annotate, "secrets"), (lambda d: pii.redact(d), None)):
        got = run(odd)
        assert [c for c in odd.columns if c != out] == [c for c in got.columns if c != out]
        assert all(r[c] == c for r in got.collect() for c in CLASHING if c != out)
