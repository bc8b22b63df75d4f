import collections
import math
import random
import zlib

import numpy as np
import pytest

from lodestrata.llm import ppm


def brute_bits(train: list[bytes], text: bytes) -> float:
    """Code length by the definition, one byte at a time."""
    trees = collections.defaultdict(collections.Counter)
    for t in train:
        t = ppm.PAD + t
        for i in range(3, len(t)):
            for k in range(4):
                trees[t[i - k : i]][t[i]] += 1
    bits, t = 0.0, ppm.PAD + text
    for i in range(3, len(t)):
        for k in (3, 2, 1, 0):
            if c := trees.get(t[i - k : i]):
                n, d = sum(c.values()), len(c)
                if t[i] in c:
                    bits += math.log2((n + d) / c[t[i]])
                    break
                bits += math.log2((n + d) / d)
        else:
            bits += 8
    return bits


WORDS = {"aa": "kan tro sil vop ñam", "bb": "the and tion ing éta", "cc": "ßor ung lich ein der"}


def corpus(n=300):
    rng = random.Random(3)
    langs = sorted(WORDS)
    return [(i, " ".join(rng.choices(WORDS[langs[i % 3]].split(), k=rng.choice([2, 20, 200]))), langs[i % 3], 5) for i in range(n)]


SCHEMA = "doc_id long, text string, lang string, score int"


def test_code_lengths_equal_brute_force(spark):
    rows = corpus(60)
    model = ppm.learn(spark.createDataFrame(rows, SCHEMA))
    texts = [rows[0][1].encode(), b"", "unseen Ω bytes and the kan".encode(), b"x"]
    was, ppm.BLOCK_BYTES = ppm.BLOCK_BYTES, 16  # texts go over blocks
    try:
        got = model.code_lengths(texts)
    finally:
        ppm.BLOCK_BYTES = was
    want = [[brute_bits([t.encode() for _, t, x, _ in rows if x == lang], s) for lang in model.langs] for s in texts]
    assert model.langs == ["aa", "bb", "cc"] and np.allclose(got, want, rtol=1e-5, atol=1e-4)


def test_held_out_accuracy_and_odd_texts(spark):
    rows = corpus() + [(1000, None, "aa", 1), (1001, "12 !! 3", "bb", 1), (1002, "", None, 1), (None, "the and tion", "bb", 1), (4, "the and tion ing", "bb", 1)]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = ppm.identify(docs, ppm.learn(docs.where(ppm.held_out()))).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    pred = {r.doc_id: r.lang_pred for r in got}
    assert [pred[i] for i in (1000, 1001, 1002)] == ["und"] * 3 and pred[None] == "bb"
    known = [(i, lang) for i, _, lang, _ in rows[:300] if i != 4 and zlib.crc32(str(i).encode()) % 5]
    assert np.mean([pred[i] == lang for i, lang in known]) > 0.99


@pytest.mark.parametrize("rows", [[], [(1, "text", None, 1)]])
def test_nothing_to_learn(spark, rows):
    docs = spark.createDataFrame(rows, SCHEMA)
    assert [(r.lang_pred, r.score) for r in ppm.identify(docs, ppm.learn(docs)).collect()] == [("und", 0.0)] * len(rows)


def test_very_long_text(spark):
    docs = spark.createDataFrame(corpus() + [(5000, "the and tion ing " * 150_000, "bb", 1)], SCHEMA)
    got = {r.doc_id: r.lang_pred for r in ppm.identify(docs, ppm.learn(docs.where("doc_id < 5000"))).collect()}
    assert got[5000] == "bb"
