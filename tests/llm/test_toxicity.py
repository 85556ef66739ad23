"""Toxicity: FTRL against a plain one, held-out accuracy, and odd rows."""

from __future__ import annotations

import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from roost.llm import queries, toxicity

DOCS = "doc_id long, text string, score string, label string, features string"


def plain_ftrl(rows, labels, n, turns, alpha, beta, l1, l2):
    z, square = [0.0] * (n + 1), [0.0] * (n + 1)

    def weight(i):
        bar = 0.0 if i == n else l1
        if abs(z[i]) <= bar:
            return 0.0
        return -(z[i] - math.copysign(bar, z[i])) / ((beta + math.sqrt(square[i])) / alpha + l2)

    for _ in range(turns):
        for row, label in zip(rows, labels, strict=True):
            at = [*row, n]
            w = [weight(i) for i in at]
            g = 1 / (1 + math.exp(-sum(w))) - label
            for i, x in zip(at, w, strict=True):
                z[i] += g - (math.sqrt(square[i] + g * g) - math.sqrt(square[i])) / alpha * x
                square[i] += g * g
    return [weight(i) for i in range(n)], weight(n)


def test_ftrl_against_a_plain_one():
    draw = random.Random(2)
    rows = [sorted(draw.sample(range(12), draw.randint(0, 6))) for _ in range(200)]
    labels = [float(3 in row or draw.random() < 0.1) for row in rows]
    settings = dict(turns=3, alpha=0.7, beta=1.0, l1=0.8, l2=0.1)
    got, bias = toxicity.ftrl([np.array(r, np.int64) for r in rows], np.array(labels), 12, **settings)
    want, plain_bias = plain_ftrl(rows, labels, 12, **settings)
    assert np.allclose(got, want) and math.isclose(bias, plain_bias)
    assert 0 < np.count_nonzero(got) < 12 and got[3] == max(got)


def test_features_of_pieces_are_those_of_the_whole(monkeypatch):
    text = "Ab cd_1 éf, gh ij  kl — mn " * 30
    whole = toxicity.features(text, toxicity._Hashes())
    monkeypatch.setattr(toxicity, "PIECE", 7)
    assert np.array_equal(whole, toxicity.features(text, toxicity._Hashes()))
    assert len(toxicity.features("one", toxicity._Hashes())) == 1 and len(toxicity.features("a b", toxicity._Hashes())) == 3
    assert len(toxicity.features(None, toxicity._Hashes())) == 0


def rows(n, seed):
    """Prose in which a pair of harmless words, only in order, marks label 1."""
    draw = random.Random(seed)
    out = []
    for i in range(n):
        words = [draw.choice("abcdefghijklmnopqrstuvwxyz") * draw.randint(1, 3) for _ in range(draw.randint(20, 60))]
        toxic = draw.random() < 0.3
        words[4:6] = ["you", "fool"] if toxic else ["fool", "you"]
        out.append((i, " ".join(words), toxic))
    return out


def test_learns_word_pairs_and_keeps_odd_rows(spark):
    data = rows(600, 1)
    docs = spark.createDataFrame([(i, t, "x", "y", "z") for i, t, _ in data], DOCS)
    labels = spark.createDataFrame([(i, int(toxic)) for i, _, toxic in data] + [(5, None), (None, 1)], "doc_id long, toxic int")
    model = toxicity.fit(toxicity.labelled_documents(docs, labels))
    again = toxicity.fit(toxicity.labelled_documents(docs.repartition(5), labels.repartition(3)))
    assert np.array_equal(model.keys, again.keys) and np.array_equal(model.weights, again.weights)
    fresh = rows(300, 9)
    odd = [(-1, None), (-2, ""), (-3, "you fool " + "a b " * 60_000), (None, "you fool"), (None, "you fool")]
    table = spark.createDataFrame([(i, t, "x", "y", "z") for i, t, _ in fresh] + [(i, t, "", "", "") for i, t in odd], DOCS)
    got = toxicity.score_documents(table, model).collect()
    score = {r.doc_id: r.score for r in got if r.doc_id is not None}
    assert len(got) == 305 and sum((score[i] >= 0.5) == toxic for i, _, toxic in fresh) >= 297
    assert score[-1] == score[-2] == pytest.approx(1 / (1 + math.exp(-model.bias)))
    assert all(0 <= r.score <= 1 for r in got)


def test_empty_tables_and_one_label(spark):
    none = spark.createDataFrame([], DOCS)
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    model = toxicity.fit(toxicity.labelled_documents(none, labels))
    assert toxicity.score_documents(none, model).collect() == []
    one = spark.createDataFrame([(1, "some words", "", "", "")], DOCS)
    assert [r.score for r in toxicity.score_documents(one, model).collect()] == [0.5]
    only = toxicity.fit(one.select("text", F.lit(0).alias("toxic")))
    assert toxicity.score_documents(one, only).first().score < 0.5


def test_query_holds_out_a_fifth_and_finds_the_toxic(spark):
    got = queries.op13_toxicity(spark, "/root/testdata/sf0.1").collect()
    marks = {r.doc_id: r.toxic for r in spark.read.parquet("/root/testdata/sf0.1/labels.parquet").collect()}
    assert len(got) == spark.read.parquet("/root/testdata/sf0.1/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == (r.score >= 0.5) for r in got)
    held = [r for r in got if r.held_out and r.doc_id in marks]
    toxic = [r for r in held if marks[r.doc_id] == 1]
    assert sum(r.predicted for r in toxic) >= 0.8 * len(toxic)
    assert sum(r.predicted for r in held if marks[r.doc_id] == 0) <= 0.01 * len(held)
