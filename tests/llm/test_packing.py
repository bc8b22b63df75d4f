import random
import zlib

import numpy as np
import pytest

from lodestrata.llm import packing


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(packing.vocabulary())


def test_word_ids_equal_whole_texts(tokenizer):
    rng = random.Random(4)
    bits = ["a", "B", "'s", "don't", " ", "\t", "\n", "\x0b", "\x1c", "\x85", "\xa0", "é", "É", "é", "Σ", "ΑΣ", "İ", "ß", "<|endoftext|>", "<|", "12", "٣", "日本", "👍🏽", "​", "﻿", "ﬁ", "_", "$$$", "ÿ", "µ"]
    w = packing.WordIds(packing.vocabulary(), most=50)
    for _ in range(5000):
        s = "".join(rng.choices(bits, k=rng.randint(0, 9)))
        assert w.ids(s) == w.whole(s) == np.array(tokenizer.encode(s, add_special_tokens=False).ids, "<u4").tobytes()


def check(rows, docs, tokenizer, size):
    """Every piece in place, no gap, no overlap; returns the number of sequences."""
    want = []
    for i, t in docs:
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        want += [(i, k, s, len(ids[s : s + size]), zlib.crc32(ids[s : s + size].tobytes())) for k, s in enumerate(range(0, len(ids), size))]
    key = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows), key=key) == sorted(want, key=key)
    bins = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= size
    return len(bins)


@pytest.mark.parametrize("parts,fan_in,carry", [(1, 16, 64), (7, 2, 2), (40, 3, 64), (40, 16, 64)])
def test_pack(spark, tokenizer, parts, fan_in, carry):
    rng = random.Random(parts)
    docs = [(i, " ".join(rng.choices(["alpha", "of", "Zq9", "the", "été"], k=rng.choice([0, 3, 20, 60, 300])))) for i in range(200)]
    docs += [(500, None), (501, ""), (502, "x" * 5000), (None, "no id"), (7, "again"), (7, "again")]
    df = spark.createDataFrame([(i, t, 1, "y") for i, t in docs], "doc_id long, text string, bin int, open string").repartition(parts)
    rows = packing.pack(df, packing.vocabulary(), size=64, fan_in=fan_in, carry=carry).collect()
    n = check(rows, docs, tokenizer, 64)
    assert n <= 1.02 * sum(r.length for r in rows) / 64 + (1 if parts == 1 else 8)


def test_empty(spark):
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string"), packing.vocabulary()).count() == 0


def test_best_fit_holds_and_fills():
    rng = random.Random(1)
    lengths = [rng.randint(1, 100) for _ in range(3000)]
    where, base, fill = packing.best_fit(lengths, 100)
    assert max(fill) <= 100 and sum(fill) == sum(lengths) and len(fill) <= 1.02 * sum(lengths) / 100
