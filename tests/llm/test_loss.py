import collections
import math
import random

import numpy as np
import pytest

from lodestrata.llm import loss
from lodestrata.llm.packing import vocabulary, word_ids

SCHEMA = "doc_id long, text string, target string, score int"


def docs(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)


def corpus(n=120):
    rng = random.Random(8)
    good, bad = "the cat sat on a mat and saw dogs run".split(), "buy cheap now click here win prize money fast deal".split()
    return [(i, " ".join(rng.choices(good if i % 2 else bad, k=rng.choice([1, 30, 90])))) for i in range(n)] + [(None, "the cat"), (500, None), (501, ""), (1, "the mat"), (1, "the mat")]


def brute(rows, target, words, size, leave_out=True):
    toks = lambda t: np.frombuffer(words.ids(t or ""), "<u4").tolist()
    c = [collections.Counter() for _ in range(2)]
    for i, t in rows:
        own = c[0 if i in target else 1]
        ids = toks(t)
        for v, w in zip([size - 1, *ids], ids):
            own.update([("t", w), ("c", v), (v, w)])
    out = []
    for i, t in rows:
        ids = toks(t)
        ls = []
        for k, all_counts in enumerate(c):
            own = collections.Counter(all_counts)
            if leave_out and k == (0 if i in target else 1):
                for v, w in zip([size - 1, *ids], ids):
                    own.subtract([("t", w), ("c", v), (v, w)])
            n = sum(x for k, x in own.items() if k[0] == "t")
            bits = 0
            for v, w in zip([size - 1, *ids], ids):
                one = (own["t", w] + 0.5) / (n + 0.5 * size)
                bits -= math.log2((own[v, w] + loss.PULL * one) / (own["c", v] + loss.PULL))
            ls.append(bits / max(1, len(ids)))
        out.append((i, len(ids), *ls, ls[0] - ls[1]))
    return out


@pytest.mark.parametrize("max_pairs", [1 << 20, 20, 0])
def test_scores_equal_brute_force(spark, max_pairs):
    """The same figures whether all pairs, a few or none go to every task."""
    rows = corpus()
    target = {i for i, _ in rows if i and i % 2 and i % 3}
    ids = spark.createDataFrame([(i,) for i in target] + [(None,), (1,), (9999,)], "doc_id long")
    tokens = loss.tokenize(docs(spark, rows).repartition(3), ids, vocabulary())
    models = loss.learn(tokens, vocabulary(), max_pairs)
    assert len(models.pairs) <= max_pairs and (models.rare is None) == (max_pairs > 20)
    for leave_out in (True, False):
        got = [tuple(r) for r in loss.score(tokens, models, leave_out).collect()]
        want = brute(rows, target, word_ids(vocabulary()), models.size, leave_out)
        key = lambda r: (str(r[0]), r[1], round(r[4], 6))
        for a, b in zip(sorted(got, key=key), sorted(want, key=key), strict=True):
            assert a[:2] == b[:2] and a[2:] == pytest.approx(b[2:], abs=1e-9)
        by = {r[0]: r[4] for r in got if r[1] > 5}
        assert max(s for i, s in by.items() if i and i % 2) < min(s for i, s in by.items() if i is not None and not i % 2)


def test_repeated_documents_are_known_to_the_model(spark):
    """Left out itself, a document that occurs once is new to its model; one that occurs twice is not."""
    rng = random.Random(2)
    text = lambda: " ".join("".join(rng.choices("abcdefgh", k=5)) for _ in range(60))
    twice = [text() for _ in range(10)]
    rows = [(i, t) for i, t in enumerate([*twice, *twice, *(text() for _ in range(40))])]
    tokens = loss.tokenize(docs(spark, rows), spark.createDataFrame([], "doc_id long"), vocabulary())
    got = {r.doc_id: r.background_loss for r in loss.score(tokens, loss.learn(tokens, vocabulary())).collect()}
    assert max(got[i] for i in range(20)) < min(got[i] for i in range(20, 60))


def test_empty_tables_and_long_texts(spark):
    none = spark.createDataFrame([], "doc_id long")
    tokens = loss.tokenize(docs(spark, []), none, vocabulary())
    models = loss.learn(tokens, vocabulary())
    assert loss.score(tokens, models).count() == 0
    assert [tuple(r)[1:] for r in loss.score(loss.tokenize(docs(spark, [(1, None)]), none, vocabulary()), models).collect()] == [(0, 0.0, 0.0, 0.0)]
    long = loss.tokenize(docs(spark, [(1, "one word after the other " * 200_000), (2, "one word")]), none, vocabulary())
    got = {r.doc_id: r for r in loss.score(long, loss.learn(long, vocabulary())).collect()}
    assert got[1].n_tokens == 1_000_000 and got[2].n_tokens == 2
