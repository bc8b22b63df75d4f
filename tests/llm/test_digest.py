import hashlib
import random

import pytest

from lodestrata.llm import digest


def brute_counts(data):
    data = data + bytes(max(0, 5 - len(data))) if data else data
    out = [0] * digest.BUCKETS
    for i in range(len(data) - 4):
        for t, places in zip(digest.TABLES, digest.TRIPLETS):
            out[int(t[0][data[i + places[0]]] ^ t[1][data[i + places[1]]] ^ t[2][data[i + places[2]]])] += 1
    return out


def test_counts_equal_brute_force():
    data = random.Random(1).randbytes(3000)
    assert digest.bucket_counts(data).tolist() == brute_counts(data)
    was, digest.BLOCK = digest.BLOCK, 100
    try:
        assert digest.bucket_counts(data).tolist() == brute_counts(data)
    finally:
        digest.BLOCK = was


def test_likeness_falls_with_edits():
    rng = random.Random(2)
    words = ["".join(rng.choices("abcdefgh", k=6)) for _ in range(2000)]
    a = " ".join(words)
    some = " ".join(w if rng.random() > 0.1 else w[::-1] for w in words)
    most = " ".join("".join(rng.choices("abcdefgh", k=6)) for _ in words)
    f = [digest.digest(x.encode()) for x in (a, some, most)]
    assert digest.likeness(f[0], f[0]) == 1 > digest.likeness(f[0], f[1]) > digest.likeness(f[0], f[2]) >= 0


@pytest.mark.parametrize("n", [0, 1, 2, 37])
def test_every_row_meets_its_successor(spark, n):
    rng = random.Random(n)
    text = lambda: rng.choice([None, "", "é日😀", "".join(rng.choices("abc é", k=rng.randint(1, 400)))])
    rows = [(i * 7 - 20, text(), "x") for i in range(n)]
    got = {r.doc_id: r for r in digest.compare_with_next(spark.createDataFrame(rows, "doc_id long, text string, part string")).collect()}
    assert len(got) == n
    for k, (i, t, _) in enumerate(rows):
        t, following = t or "", rows[(k + 1) % n][1] or ""
        edited = t[: len(t) - len(t) // 4] + following[: len(t) // 4]
        own, other, mark = (digest.digest(x.encode()) for x in (t, following, edited))
        r = got[i]
        assert (r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint) == (len(t), hashlib.sha256(edited.encode()).hexdigest(), own, mark)
        assert r.near_edited == digest.likeness(own, mark) and r.near_next == digest.likeness(own, other)


def test_repeated_and_null_ids(spark):
    rows = [(None, "a" * 50), (3, "b" * 80), (3, "b" * 80), (3, "c" * 9), (None, None)]
    got = digest.compare_with_next(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or -1, r.n_chars) for r in got) == [(-1, 0), (-1, 50), (3, 9), (3, 80), (3, 80)]
    assert digest.fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).count() == 5


def test_short_texts_differ():
    texts = [b"", b"a", b"b", b"ab", b"abc", b"abd", b"xyz", b"abcd", b"wxyz", b"abcde"]
    marks = [digest.digest(t) for t in texts]
    assert len(set(marks)) == len(texts)
    for t in texts:
        assert digest.bucket_counts(t).tolist() == brute_counts(t)
    of = dict(zip(texts, marks))
    assert digest.likeness(of[b"abc"], of[b"xyz"]) == 0 < digest.likeness(of[b"abc"], of[b"abd"]) < 1 == digest.likeness(of[b"a"], of[b"a"])
    assert all(0 <= digest.likeness(x, y) <= 1 for x in marks for y in marks)


def test_very_long_texts(spark):
    rng = random.Random(3)
    base = "".join(rng.choices("abcdefgh ij", k=3_000_000))
    rows = [(1, base), (2, base[:-9] + "something"), (3, base[::-1]), (4, "x" * 2_000_000)]
    got = {r.doc_id: r for r in digest.compare_with_next(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[i].n_chars for i, _ in rows] == [len(t) for _, t in rows]
    assert got[1].near_next > 0.95 > got[3].near_next and got[1].fingerprint == digest.digest(base.encode())
