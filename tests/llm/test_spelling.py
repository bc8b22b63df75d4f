import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from lodestrata.llm import spelling

DOCS = "doc_id long, text string, word string, n int"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "clash", 3) for i, t in rows], DOCS)


def lower(w):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w)


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(rows, every=97):
    count = Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = lower(run)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if h % every == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            if len(w) >= 5:
                count[w] += 1
    n = {w: c for w, c in count.items() if c >= 3}
    out, form = {}, {}
    for w in n:
        others = [v for v in n if near(w, v)]
        best = min(others, key=lambda v: (-n[v], v)) if others else None
        form[w] = best if best and n[best] >= 2 * n[w] else None
        out[w] = [n[w], len(others)]
    root = lambda w: w if form[w] is None else root(form[w])
    return {w: (form[w], root(w), n[w], k, n.get(form[w])) for w, (_, k) in out.items()}


def got(df):
    rows = df.collect()
    out = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in rows}
    assert len(out) == len(rows)
    return out


@pytest.mark.parametrize("every", [97, 2])
def test_equals_brute_force(spark, every):
    rng = random.Random(every)
    words = ["".join(rng.choices("abAéÉ×", k=rng.randint(4, 8))) for _ in range(300)]
    rows = [(rng.choice([None, *range(50)]), " ".join(rng.choices(words, weights=range(1, 301), k=rng.randint(0, 60))) + rng.choice(["", "\n12", "日本"])) for _ in range(300)] + [(1, None), (2, ""), (3, "aaaaaaa " * 40 + "aaabaaa " * 9 + "aaaaaa " * 4)]
    want = brute(rows, every)
    assert len(want) > 100 and any(f and want[f][0] for f, *_ in want.values()) and want == got(spelling.group_variants(docs(spark, rows), every=every))


def test_chains_ties_and_long_words(spark):
    long = "abcdefghij" * 5000
    text = "house " * 40 + "housea " * 20 + "houseab " * 10 + "houseabc " * 5 + "tests " * 4 + "testa " * 8 + "testb " * 8 + f"{long} " * 8 + f"{long[:-1]} " * 3 + "x" * 20_000 + " " + ("x" * 20_000 + " ") * 3
    rows = [(1, text), (7, "straße " * 5 + "strasse"), (9, " ".join(["zzzzz"] * 3))]
    want = brute(rows, 10**9)
    assert want["houseabc"][:2] == ("houseab", "house") and want["tests"][0] == "testa" and want[long[:-1]][0] == long
    assert want == got(spelling.group_variants(docs(spark, rows), every=10**9))


def test_empty(spark):
    assert spelling.group_variants(docs(spark, [])).count() == 0
    assert spelling.group_variants(docs(spark, [(1, None), (2, "one two")])).count() == 0


def test_keys_are_those_of_the_deleted_strings():
    rng = random.Random(3)
    some = ["".join(rng.choices("abcé", k=rng.randint(1, 9))) for _ in range(500)] + ["", "😀é"]
    key, word, lo, hi = spelling.deletion_keys(some)
    by = {}
    for k, w, a, b in zip(key.tolist(), word.tolist(), lo.tolist(), hi.tolist()):
        s = some[w] if a < 0 else some[w][:a] + some[w][a + 1 :]
        assert all(some[w][:i] + some[w][i + 1 :] == s for i in range(a, b + 1) if a >= 0)
        assert by.setdefault(s, k) == k
    assert len(set(by.values())) == len(by)
    places = Counter((w, i) for w, a, b in zip(word.tolist(), lo.tolist(), hi.tolist()) if a >= 0 for i in range(a, b + 1))
    assert set(places.values()) == {1} and len(places) == sum(map(len, some))


def test_strings_decide_where_keys_collide():
    members = [(1, -1, -1, "apple", 9), (2, 5, 5, "applex", 3), (3, 0, 0, "zother", 5), (4, 2, 3, "appple", 4), (5, -1, -1, "other", 7)]
    out = sorted(spelling.near_in(members))
    assert out == [(1, 2, "appple", 4), (2, 1, "apple", 9), (3, 1, "other", 7), (4, 1, "apple", 9), (5, 1, "zother", 5)]


def test_deletion_keys_of_one_letter_runs():
    key, word, lo, hi = spelling.deletion_keys(["aaaa"])
    assert lo.tolist() == [-1, 0] and hi.tolist() == [-1, 3] and len(np.unique(key)) == 2
