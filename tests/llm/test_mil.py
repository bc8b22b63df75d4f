import math
import random
import tracemalloc
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestrata.llm import mil


def corpus(n=600):
    rng = random.Random(1)
    docs, labels = [], []
    for i in range(n):
        words = ["".join(rng.choices("abcdeéü", k=rng.randint(1, 9))) for _ in range(rng.choice([3, 70, 200]))]
        good = i % 3 > 0
        docs.append((i, " ".join(words) if good else " ".join(w.upper() + "!!" for w in words)))
        if i % 2:
            labels.append((i, int(good)))
    return docs, labels


def test_held_out_accuracy(spark):
    docs, labels = corpus()
    d = spark.createDataFrame([(i, t, 7, "q") for i, t in docs], "doc_id long, text string, score int, quality string")
    lab = spark.createDataFrame([(i, q, "t") for i, q in labels] + [(None, 1, "t"), (3, None, "t"), (5, 9, "t")], "doc_id long, quality int, text string")
    model = mil.train(d, lab)
    rows = mil.score(d, model).collect()
    assert len(rows) == len(docs) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    out = [r for r in rows if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert np.mean([r.predicted == (r.doc_id % 3 > 0) for r in out]) > 0.97
    assert {r.doc_id: r.score for r in mil.score(d, mil.train(d, lab)).collect()} == {r.doc_id: r.score for r in rows}
    kept = mil.keep_good(d, lab)
    assert kept.columns == d.columns and 380 < kept.count() < 420


def test_held_out_labels_teach_nothing(spark):
    docs, labels = corpus(200)
    d = spark.createDataFrame(docs, "doc_id long, text string")
    a = mil.train(d, spark.createDataFrame(labels, "doc_id long, quality int"))
    b = mil.train(d, spark.createDataFrame([(i, 1 - q if zlib.crc32(str(i).encode()) % 5 == 0 else q) for i, q in labels], "doc_id long, quality int"))
    assert all((a.weights[k] == b.weights[k]).all() for k in a.weights)


def test_odd_texts_and_empty_tables(spark):
    docs, labels = corpus(200)
    d = spark.createDataFrame(docs + [(None, "x"), (1, None), (1, ""), (2, "long " * 100000), (2, "x" * 500000)], "doc_id long, text string")
    lab = spark.createDataFrame(labels, "doc_id long, quality int")
    model = mil.train(d, lab)
    assert mil.score(d, model).count() == 205
    assert mil.score(d.limit(0), model).count() == 0
    assert [r.predicted for r in mil.score(d.limit(3), mil.train(d, lab.limit(0))).collect()] == [1, 1, 1]
    assert [r.predicted for r in mil.score(d.limit(3), mil.train(d, lab.where("quality = 0"))).collect()] == [0, 0, 0]


def test_gradient():
    """One step of plain descent lowers the loss as the gradient says it should."""
    rng = np.random.default_rng(0)
    sizes = np.array([1, 3, 2, 5, 1, 4])
    x, y = rng.normal(size=(sizes.sum(), mil.FEATURES)).astype(np.float32), np.array([0, 1, 1, 0, 1, 0], np.float32)
    starts = np.r_[0, np.cumsum(sizes)[:-1]]

    def loss(m):
        p = m.forward(np.clip((x - m.mean) / m.scale, -8, 8), starts, sizes)["p"]
        return -np.mean(y * np.log(p) + (1 - y) * np.log(1 - p))

    assert loss(mil.fit(x, sizes, y, epochs=40, decay=0)) < 0.2 < loss(mil.fit(x, sizes, y, epochs=0))


def test_score_equals_plain_loops(monkeypatch):
    """Attention and score of whole texts recomputed number by number, however passages are dealt to steps."""
    rng = np.random.default_rng(3)
    model = mil.fit(rng.normal(size=(8, mil.FEATURES)).astype(np.float32), np.array([3, 5]), np.array([0, 1], np.float32), epochs=2)
    w = {k: v.astype(float) for k, v in model.weights.items()}
    sig = lambda v: 1 / (1 + math.exp(-v))
    word = random.Random(2)
    texts = ["", None, "one short text", " ".join("".join(word.choices("abcde,.!", k=word.randint(1, 9))) for _ in range(700))]
    want = []
    for text in texts:
        z, e = [], []
        for p in mil.passages(text):
            x = np.clip((mil.encode([p])[0] - model.mean) / model.scale, -8, 8).astype(float).tolist()
            own = [math.tanh(w["b"][h] + sum(x[f] * w["W"][f][h] for f in range(mil.FEATURES))) for h in range(len(w["b"]))]
            dot = lambda m, k: sum(own[h] * m[h][k] for h in range(len(own)))
            e.append(sum(math.tanh(dot(w["V"], k)) * sig(dot(w["U"], k)) * w["a"][k] for k in range(len(w["a"]))))
            z.append(own)
        share = [math.exp(v) / sum(map(math.exp, e)) for v in e]
        want.append(sig(w["d"][0] + sum(w["c"][h] * sum(s * own[h] for s, own in zip(share, z)) for h in range(len(w["c"])))))
    assert len(mil.passages(texts[3])) == 11
    for step in (2048, 3):
        monkeypatch.setattr(mil, "STEP", step)
        assert model.score(texts) == pytest.approx(want, abs=1e-5)


def test_features_equal_plain_counts():
    text = "Some Words, some words!! 12 |x| caf\u00e9"
    p = text.encode()
    x, kinds = mil.encode([p])[0], [int(mil.CLASSES[c]) for c in p]
    single = [kinds.count(k) / (len(p) + 20) for k in range(mil.KINDS)]
    pair = [math.sqrt(sum(a == i and b == j for a, b in zip(kinds, kinds[1:])) / (len(p) + 20)) for i in range(mil.KINDS) for j in range(mil.KINDS)]
    assert x[mil.WORD_FEATURES :].tolist() == pytest.approx(single + pair, abs=1e-6)


def test_bounds_of_the_sample(spark):
    """A huge text teaches by a bounded number of passages; ids with both labels, and repeats, teach once or not at all."""
    docs, labels = corpus(200)
    d = spark.createDataFrame(docs, "doc_id long, text string")
    lab = spark.createDataFrame(labels, "doc_id long, quality int")
    own = next(i for i, _ in labels if zlib.crc32(str(i).encode()) % 5)
    a = mil.train(d, lab.where(F.col("doc_id") != own))
    b = mil.train(d.unionByName(d), lab.unionByName(spark.createDataFrame([(own, 0), (own, 1)], "doc_id long, quality int")))
    assert all((a.weights[k] == b.weights[k]).all() for k in a.weights)
    long = spark.createDataFrame([(own, "word " * 2_000_000)], "doc_id long, text string")
    assert mil.train(d.where(F.col("doc_id") != own).unionByName(long), lab, max_passages=2000).weights["d"].shape == (1,)


def test_fit_copies_no_passages():
    """The passages fill a good part of the driver's memory once; fitting takes little beside them and leaves them as they are."""
    rng = np.random.default_rng(4)
    sizes = rng.integers(1, 20, 1500)
    x = rng.random((sizes.sum(), mil.FEATURES)).astype(np.float32)
    x.flags.writeable = False
    tracemalloc.start()
    try:
        model = mil.fit(x, sizes, rng.integers(0, 2, len(sizes)).astype(np.float32), epochs=1)
        assert tracemalloc.get_traced_memory()[1] < x.nbytes / 2
    finally:
        tracemalloc.stop()
    assert (model.mean == x.mean(0)).all() and (model.scale == x.std(0) + 1e-2).all()
