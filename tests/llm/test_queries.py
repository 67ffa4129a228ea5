"""Registered queries of the subpackage against their SQL; the pipeline against its stages' brute force."""

import hashlib
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest

import corpus_pipeline
from lexmill.llm import bpe, mixing, pii, queries
from lexmill.llm.common import written
from lexmill.llm.toxicity import Scorer

from .conftest import ROWS
from .test_ops import plain_classes

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_matches_sql(spark, name):
    c = duckdb.connect()
    for t in ("documents", "pages", "labels"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    got, want = queries.queries()[name](spark, DATA), c.sql(queries.oracle_sql()[name])
    assert sorted(got.columns) == sorted(want.columns)
    places = [want.columns.index(x) for x in got.columns]
    assert Counter(map(tuple, got.collect())) == Counter(tuple(r[i] for i in places) for r in want.fetchall())


def test_held_out_rows(spark):
    rows = queries.op3_toxicity(spark, DATA).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows) and len(rows) == 200


def test_pipeline_by_stages(spark):
    """Every stage on what the one before kept, against plain Python."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    names, stages = docs.columns, dict(corpus_pipeline.STAGES)
    score = Scorer(queries.toxicity_model(spark, DATA))
    clean = stages["toxicity"](spark, docs, DATA).cache()
    assert {r.doc_id for r in clean.collect()} == {r.doc_id for r in docs.collect() if score(r.text) < 0}
    single = stages["ngram_jaccard_join"](spark, clean, DATA).cache()
    classes = plain_classes([(r.doc_id, r.text) for r in clean.collect()])
    assert sorted(r.doc_id for r in single.collect()) == sorted({c for _, c, _ in classes})
    private = stages["pii"](spark, single, DATA).cache()
    assert Counter(r.doc_id for r in private.collect()) == Counter(r.doc_id for r in single.collect())
    assert all(r.n_chars == len(r.text) for r in private.collect())
    before, after = {r.doc_id: r.text for r in single.collect()}, {r.doc_id: r.text for r in private.collect()}
    assert any(before[i] != after[i] for i in before) and all(before[i] == after[i] for i in before if not any(c in before[i] for c in "0123456789@=:"))
    mixture = stages["mixing"](spark, private, DATA).cache()
    copies = Counter(r.doc_id for r in mixture.collect())
    assert set(copies) == set(after) and max(copies.values()) <= 2
    tokens, taken = defaultdict(int), defaultdict(int)
    for r in private.collect():
        tokens[r.source] += len(r.text.split())
        taken[r.source] += len(r.text.split()) * copies[r.doc_id]
    longest = max(len(t.split()) for t in after.values())
    a = 1 - np.log(2.0) / np.log(max(tokens.values()) / min(tokens.values()))
    for s in tokens:
        due = tokens[s] * (max(tokens.values()) / tokens[s]) ** (1 - a)
        assert due - 1 <= taken[s] <= due + longest
    assert mixing.Settings().repeats == 2.0
    for stage in (clean, single, private, mixture):
        assert stage.columns == names
    enc = bpe.encoding(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    want = Counter()
    for r in mixture.collect():
        ids = enc.encode_ordinary(r.text)
        want[(r.doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(r.text.encode()).hexdigest())] += 1
    assert Counter(map(tuple, stages["bpe"](spark, mixture, DATA).collect())) == want
    assert Counter(map(tuple, corpus_pipeline.run(spark, DATA).collect())) == want


def test_pipeline_stages_on_odd_rows(spark, odd):
    """All stages but the last keep every column as it is, and drop or repeat rows only as their operators say."""
    docs = odd
    for name, stage in corpus_pipeline.STAGES[:-1]:
        made = written(stage(spark, docs, DATA), f"odd-{name}")
        assert made.columns == odd.columns and made.where("found <> 'clash' or __id <> 'clash' or `odd name``s` <> 'clash'").count() == 0, name
        docs = made
    kept = {(r.doc_id, r.text) for r in docs.collect()}
    assert kept == {(i, t) for i, t, *_ in ROWS if i not in (4, 5)} - {(3, None)}
    last = corpus_pipeline.STAGES[-1][1](spark, docs, DATA)
    assert last.count() == docs.count() and {r.doc_id for r in last.collect()} == {i for i, _ in kept}


def test_key_of_pseudonyms_comes_from_the_session(spark):
    docs = spark.createDataFrame([(1, "on 2021-02-28")], "doc_id long, text string")
    with pytest.warns(UserWarning, match="not set"):
        plain = pii.pseudonymised(docs, queries.pii_key(spark)).first().text
    spark.conf.set(queries.PII_KEY, "secret key")
    try:
        made = pii.pseudonymised(docs, queries.pii_key(spark))
        assert made.first().text != plain and "secret key" not in made._jdf.queryExecution().toString()
    finally:
        spark.conf.unset(queries.PII_KEY)


def test_pipeline_on_no_rows(spark, empty):
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, DATA).count() == 0, name
