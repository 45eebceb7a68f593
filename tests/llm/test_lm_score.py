import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from widestat.llm import lm_score as L

from .conftest import by_id


def tokens(text):
    return [L.BEGIN] * (L.ORDER - 1) + [ord(c) for c in text or ""] + [L.END]


class Model:
    """Plain n-gram counts and the smoothing formula."""

    def __init__(self, texts, scale=1.0):
        self.n = {k: Counter() for k in range(1, L.ORDER + 1)}
        self.c = {k: Counter() for k in range(1, L.ORDER + 1)}
        for t in texts:
            x = tokens(t)
            for i in range(L.ORDER - 1, len(x)):
                for k in self.n:
                    self.n[k][tuple(x[i - k + 1:i + 1])] += scale
                    self.c[k][tuple(x[i - k + 1:i])] += scale

    def p(self, gram, vocabulary, size):
        p = (self.n[1][gram[-1:]] + 1) / size
        for k in range(2, L.ORDER + 1):
            g = gram[-k:]
            p = (self.n[k][g] + L.MU * p) / (self.c[k][g[:-1]] + L.MU)
        return p


def brute(rows, good):
    target_texts = [t for d, t in rows if d in good]
    everything = Model([t for _, t in rows])
    vocabulary = len(everything.n[1])
    total, own = sum(everything.n[1].values()), sum(len(t or "") + 1 for t in target_texts)
    target, background = Model(target_texts), Model([t for _, t in rows], own / total)
    out = []
    for d, t in rows:
        x, losses = tokens(t), [0.0, 0.0]
        for i in range(L.ORDER - 1, len(x)):
            for k, m in enumerate((target, background)):
                losses[k] -= math.log(m.p(tuple(x[i - L.ORDER + 1:i + 1]), vocabulary, own + vocabulary))
        n = len(t or "") + 1
        out.append((d, n, losses[0] / n, losses[1] / n, (losses[1] - losses[0]) / n))
    return out


ROWS = [(1, "the cat sat on the mat"), (2, "the dog sat"), (3, "###$$$ ###"), (4, None), (5, ""), (6, "Ünï 世界 \U0001F600 text"),
        (7, "the cat sat on the mat"), (7, "the cat sat on the mat"), (None, "the cat")]
LABELS = [(1, 1, 0), (2, 1, 0), (2, 1, 0), (3, 0, 0), (6, 1, 1), (None, 1, 0), (7, None, 0), (99, 1, 0)]


def same(got, want):
    got = sorted(map(tuple, got), key=repr)
    want = sorted(want, key=repr)
    assert [g[:2] for g in got] == [w[:2] for w in want]
    for g, w in zip(got, want):
        assert g[2:] == pytest.approx(w[2:], abs=1e-9)


@pytest.mark.parametrize("block_grams", [L.BLOCK_GRAMS, 20])
def test_equals_brute_force(spark, docs, block_grams):
    labels = spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")
    out = L.score(docs(ROWS).withColumn("low", F.lit("clash")).withColumn("score", F.lit(1)), labels, block_grams=block_grams)
    assert out.columns == ["doc_id", "n_tokens", "target_loss", "background_loss", "score"]
    same(out.collect(), brute(ROWS, {1, 2}))


def test_no_good_documents_and_empty_tables(spark, docs):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert all(math.isfinite(r.score) for r in L.score(docs(ROWS), labels).collect())
    assert L.score(docs([]), labels).count() == 0


def test_long_text_is_whole(spark, docs, monkeypatch):
    monkeypatch.setattr(L, "SLICE", 1000)
    rows = [(1, "abc " * 50_000), (2, "xyz"), (3, "abc")]
    labels = spark.createDataFrame([(3, 1, 0)], "doc_id long, quality int, toxic int")
    same(L.score(docs(rows), labels).collect(), brute(rows, {3}))


def test_target_sample_is_bounded(spark):
    labels = spark.range(500).selectExpr("id doc_id", "1 quality", "0 toxic")
    ids = L.target_ids(labels, 100)
    assert len(ids) == 100 and (np.diff(ids) > 0).all() and (ids == L.target_ids(labels.repartition(7), 100)).all()


def test_target_is_every_good_document(spark):
    """More good documents than the driver once took: the target counts them all."""
    n = 200_050
    docs = spark.range(n, numPartitions=8).selectExpr("id doc_id", "'ab' text")
    labels = spark.range(n).selectExpr("id doc_id", "1 quality", "0 toxic")
    counts = L.count_grams(docs, L.good_documents(labels), "doc_id", "text")
    assert [(r.target, r.background) for r in counts.collect()] == [(n, n)] * 3
    r = L.score(docs, labels).agg(F.max("score").alias("most"), F.min("score").alias("least"), F.count("*").alias("n")).first()
    assert (r.most, r.least, r.n) == (pytest.approx(0, abs=1e-12), pytest.approx(0, abs=1e-12), n)


def test_held_out_ranking(spark):
    """Fitted on half of the labels, the score ranks the other half's good
    documents above its bad ones."""
    sf = "/root/testdata/sf0.01"
    documents, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    half = F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0
    score = by_id(L.score(documents, labels.where(half)))
    held = labels.where(~half & F.col("quality").isNotNull()).collect()
    good = [score[r.doc_id].score for r in held if r.quality == 1 and r.toxic == 0]
    bad = [score[r.doc_id].score for r in held if r.quality == 0]
    auc = np.mean([g > b for g in good for b in bad])
    assert auc > 0.85, auc
