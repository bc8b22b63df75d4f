import random
import time

import numpy as np

from lodestrata.llm import qgram

ALPHABET = "abcdefghijklmnopqrstuvwxyz éß"


def brute_best(item: str, doc: str) -> int:
    """Fewest edits that turn the item into any stretch of the document."""
    d = [0] * (len(doc) + 1)
    for i, c in enumerate(item, 1):
        e = [i]
        for j, x in enumerate(doc, 1):
            e.append(min(d[j - 1] + (c != x), d[j] + 1, e[j - 1] + 1))
        d = e
    return min(d)


def edited(rng, text, n):
    t = list(text)
    for _ in range(n):
        at = rng.randrange(len(t))
        kind = rng.random()
        if kind < 0.34:
            t[at] = rng.choice("xyz ")
        elif kind < 0.67:
            t.insert(at, rng.choice("xyz"))
        else:
            del t[at]
    return "".join(t)


def make(seed=3):
    rng = random.Random(seed)
    items = [(i, "".join(rng.choices(ALPHABET, k=rng.choice([40, 90, 150, 260])))) for i in range(12)] + [(50, "abc"), (51, ""), (52, None), (53, "--"), (3, "repeated item id, of some length here"), (None, "an item that has no id at all, yet it has text")]
    docs = []
    for i in range(50):
        text = "".join(rng.choices(ALPHABET, k=rng.choice([0, 30, 300, 1500])))
        for _ in range(rng.randint(0, 2)):
            item = rng.choice(items[:12])[1]
            at = rng.randint(0, len(text))
            text = text[:at] + " " + edited(rng, item, rng.choice([0, 1, len(item) // 12, len(item) // 9])) + " " + text[at:]
        docs.append((i, text.upper() if i % 3 == 0 else text))
    docs += [(100, None), (101, ""), (102, items[3][1]), (102, items[3][1]), (None, items[4][1]), (104, "Say ABC now"), (105, "xabc abcx")]
    return docs, items


def frames(spark, docs, items):
    return (
        spark.createDataFrame([(i, t, 1, "u") for i, t in docs], "doc_id long, text string, item_id int, start string").repartition(3),
        spark.createDataFrame([(i, t, 9) for i, t in items], "item_id long, text string, doc_id int"),
    )


def budget(m, rate=0.1):
    """The largest number of edits, at most ``rate`` a character, under which a q-gram must be shared."""
    return max([k for k in range(int(rate * m) + 1) if m + 1 - (k + 1) * qgram.Q >= 1], default=0)


def want(docs, items, rate=0.1):
    out = []
    for i, t in docs:
        for j, x in items:
            x, d = qgram.normal(x), qgram.normal(t)
            if not x:
                continue
            if (f" {x} " in f" {d} ") if len(x) < qgram.Q else brute_best(x, d) <= budget(len(x), rate):
                out.append((i, j))
    return out


def test_finds_what_full_alignment_finds(spark):
    docs, items = make()
    d, b = frames(spark, docs, items)
    expected = want(docs, items)
    for options in ({}, {"max_index": 500}, {"block_chars": 400}):
        rows = qgram.contaminated(d, b, **options).collect()
        pairs = {(r.doc_id, r.item_id) for r in rows}
        assert pairs == set(expected), options
        assert sum(r.doc_id == 102 and r.item_id == 3 for r in rows) == 2
        for r in rows:
            text = next(qgram.normal(t) for i, t in docs if i == r.doc_id and t)
            item = next(x for x in (qgram.normal(t) for j, t in items if j == r.item_id) if len(x) == r.item_chars)
            assert 0 <= r.start <= r.end <= len(text)
            if r.edits == 0:
                assert text[r.start : r.end] == item
            else:
                assert whole(item, text[r.start : r.end]) == r.edits


def whole(a, b):
    """Edit distance of two whole strings."""
    d = list(range(len(b) + 1))
    for i, c in enumerate(a, 1):
        e = [i]
        for j, x in enumerate(b, 1):
            e.append(min(d[j - 1] + (c != x), d[j] + 1, e[j - 1] + 1))
        d = e
    return d[-1]


def test_budget_counts_characters(spark):
    """10 changes in 54 accented characters are more than a tenth, though less than a tenth of their bytes would be 10."""
    rng = random.Random(1)
    item = "".join(rng.choices("éèàùçôîûëï", k=54))
    changed = lambda n: "".join("ö" if k % 5 == 0 and k // 5 < n else c for k, c in enumerate(item))
    docs = [(n, f"vor {changed(n)} nach") for n in (0, 3, 4, 5, 6, 10)]
    d, b = frames(spark, docs, [(1, item)])
    assert [(r.doc_id, r.edits) for r in qgram.contaminated(d, b).orderBy("doc_id").collect()] == [(n, n) for n, _ in docs if n <= budget(54)]


def test_alignment_equals_full_table():
    rng = random.Random(4)
    for n in (8, 30, 63, 64, 65, 130, 400):
        item = "".join(rng.choices("abé ", k=n))
        text = "".join(rng.choices("abé ", k=50)) + edited(rng, item, n // 12) + "".join(rng.choices("abé ", k=50))
        best = brute_best(item, text)
        edits, a, b = qgram.align(item, text, n)
        assert edits == best == whole(item, text[a:b])
        assert not best or qgram.align(item, text, best - 1) is None


def test_long_item_and_dense_hits():
    """An item of 60,000 characters is aligned in seconds; hundreds of neighbouring copies are each found once."""
    rng = random.Random(6)
    item = "".join(rng.choices(ALPHABET, k=60_000)).strip()
    index = qgram.Index([(0, qgram.normal(item))], 0.1)
    began = time.time()
    got = qgram.regions(["x " + edited(rng, item, 300) + " y"], index, 1 << 21)
    assert len(got) == 1 and got[0][4] <= 300 and time.time() - began < 20
    short = "one passage of fifty characters that comes again ok"
    text = " ".join(short if k % 3 else short.replace("fifty", "fifti") for k in range(400))
    index = qgram.Index([(0, short)], 0.1)
    got = qgram.regions([text], index, 1 << 21)
    assert [(x[2], x[4]) for x in got] == [(k * (len(short) + 1), int(k % 3 == 0)) for k in range(400)]


def test_grams():
    rng = np.random.default_rng(0)
    for n in (0, 3, 7, 8, 9, 15, 16, 17, 100, 1003):
        x = rng.integers(0, 255, n).astype(np.uint8)
        assert qgram.grams(x).tolist() == [int.from_bytes(x[i : i + 8].tobytes(), "little") for i in range(max(0, n - 7))]


def test_empty_tables_and_dropping(spark):
    docs, items = make()
    d, b = frames(spark, docs, items)
    none_d, none_b = d.limit(0), b.limit(0)
    assert qgram.contaminated(none_d, b).count() == 0 and qgram.contaminated(d, none_b).count() == 0
    hit = {i for i, _ in want(docs, items)}
    left = qgram.drop_contaminated(d, b)
    assert left.columns == d.columns
    assert sorted(str(r.doc_id) for r in left.collect()) == sorted(str(i) for i, _ in docs if i not in hit)


def test_bands_at_the_edges_equal_brute_force():
    """A band narrows what may match, never what it finds; bands ahead of, behind and across a text's ends."""
    rng = random.Random(8)

    def brute(item, text, lo, hi):
        """Fewest edits over paths within the band, by the whole table."""
        big, m = 10**9, len(item)
        d = [[big] * (len(text) + 1) for _ in range(m + 1)]
        for i in range(m + 1):
            for j in range(len(text) + 1):
                if lo <= j - i <= hi:
                    if i == 0:
                        d[i][j] = 0
                        continue
                    d[i][j] = min(d[i - 1][j] + 1, *([d[i][j - 1] + 1, d[i - 1][j - 1] + (item[i - 1] != text[j - 1])] if j else []), big)
                elif i == 0:
                    d[i][j] = 0
        return d[m]

    for _ in range(1500):
        item, text = ("".join(rng.choices("ab", k=rng.randint(1, 9))) for _ in range(2))
        k = rng.randint(0, 4)
        lo = rng.randint(-12, 10)
        hi = lo + rng.randint(0, 8)
        got = qgram.align(item, text, k, lo, hi)
        if item in text:
            assert got[0] == 0
            continue
        full = min(brute(item, text, -99, 99))
        inside = min(brute(item, text, max(lo, -k), hi)[1:] or [10**9]) if hi >= max(lo, -k) else 10**9
        assert got is None or full <= got[0] <= k
        if inside <= k and inside < len(item):
            assert got is not None and got[0] <= inside
