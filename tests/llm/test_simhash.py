import itertools
import random

import pytest
import xxhash
from pyspark.sql import functions as F

from lodestrata.llm import common, simhash


def brute_fp(text, words=4):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    hs = [xxhash.xxh64_intdigest(b" ".join(w[i : i + words]), 42) for i in range(max(1, len(w) - words + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(rows, d=4):
    fps = {i: brute_fp(t) for i, t in rows}
    parent = {i: i for i in fps}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(sorted(fps), 2):
        if bin(fps[a] ^ fps[b]).count("1") <= d:
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    return {i: (format(fps[i], "016x"), find(i)) for i in fps}


def corpus():
    rng = random.Random(5)
    vocab = [f"w{i}" for i in range(300)] + ["É", "ß"]
    rows = []
    for i in range(60):
        base = rng.choices(vocab, k=rng.choice([2, 5, 60, 400]))
        for _ in range(rng.randint(1, 4)):
            edit = list(base)
            for _ in range(rng.randint(0, 2)):
                edit[rng.randrange(len(edit))] = rng.choice(vocab)
            rows.append((rng.choice([" ", "\n", "\t \x0b"]).join(edit)))
    rows += [None, "", "  \n", "A b C d", "a B c D", "x" * 30000, " ".join(rng.choices(vocab, k=70000))]
    return [(7 * i + 3, t) for i, t in enumerate(rows)]


@pytest.mark.parametrize("options", [{}, {"n_blocks": 5}, {"n_blocks": 7}, {"n_blocks": 5, "max_group": 2}])
def test_matches_brute_force(spark, options):
    rows = corpus()
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, fp string, rep long").repartition(5)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(df, **options).collect()}
    assert got == brute_components(rows)


def test_dense_group_goes_by_flips(spark):
    """Fingerprints a few bits around one centre: one hot key, and still the exact components."""
    rng = random.Random(2)
    fps = {0}
    for centre in (0, 0xFFFF00000000FFFF):
        for _ in range(150):
            fps.add(centre ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 3))))
    fps = sorted(fps)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    nodes = spark.createDataFrame([(f, i) for i, f in enumerate(signed)], "fp long, rep long")
    parent = list(range(len(fps)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(range(len(fps)), 2):
        if bin(fps[a] ^ fps[b]).count("1") <= 4:
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    want = {i: find(i) for i in range(len(fps)) if find(i) != i}
    for group in (20, 1000):
        got = {r.node: r.root for r in simhash.components(simhash.links(nodes, max_group=group, n_blocks=6)).collect()}
        assert got == want


def test_long_chain_and_empty(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(5, 5), (1000, 999)], "a long, b long")
    got = {r.node: r.root for r in simhash.components(chain).collect()}
    assert got == {i: 0 for i in range(1, 201)} | {1000: 999}
    assert simhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_repeated_rows_and_null_ids(spark):
    df = spark.createDataFrame([(3, "a b c d e"), (3, "a b c d e"), (None, "a b c d e"), (None, "lonely text of its own here"), (9, "A b c d e")], "doc_id long, text string")
    got = sorted(((r.doc_id, r.component_id) for r in simhash.near_duplicates(df).collect()), key=str)
    assert got == [(3, 3), (3, 3), (9, 3), (None, 3), (None, None)]
    assert sorted((str(r.doc_id), r.text) for r in simhash.keep_one(df).collect()) == [("3", "a b c d e"), ("None", "lonely text of its own here")]


def near_corpus(n, copies, seed=9):
    """Base texts, each with copies of which about one word in 60 differs."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        base = [f"w{rng.randrange(5000)}" for _ in range(300)]
        for k in range(copies[i % len(copies)]):
            rows.append((len(rows), " ".join(w if k == 0 or rng.random() > 0.01 else f"x{rng.randrange(9999)}" for w in base), i))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("max_group", [1024, 20])
def test_similar_texts_meet(spark, max_group):
    rows = near_corpus(40, [1, 1, 2, 5] if max_group == 1024 else [1, 120])
    got = {r.doc_id: r.component_id for r in simhash.similar(spark.createDataFrame(rows, "doc_id long, text string, component_id long"), max_group=max_group).collect()}
    of = {i: b for i, _, b in rows}
    first = {b: min(i for i in of if of[i] == b) for b in of.values()}
    assert all(of[got[i]] == of[i] for i in of)  # no two base texts meet
    assert sum(got[i] == first[of[i]] for i in of) >= 0.97 * len(of)


def test_keep_one_of_similar(spark):
    rows = [(3, "a b c d e f g", 0), (5, "a b c d e f g", 0), (6, "something else in five words", 0), (7, None, 0), (8, " ", 0), (None, "a b c d e f g", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n int")
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns and sorted(str(r.doc_id) for r in kept.collect()) == ["3", "6", "7"]
    assert simhash.keep_one(df.limit(0)).count() == 0


def graded(seed=31):
    """Pairs of texts of graded similarity, each pair on words of its own, with exact Jaccard."""
    rng = random.Random(seed)
    rows, want = [], {}
    for i in range(240):
        base = [f"p{i}w{k}" for k in range(300)]
        other = list(base)
        for at in rng.sample(range(2, 298), rng.randint(2, 12)):
            other[at] = f"p{i}x{at}"
        sets = [{tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in (base, other)]
        rows += [(2 * i, " ".join(base)), (2 * i + 1, " ".join(other))]
        want[i] = len(sets[0] & sets[1]) / len(sets[0] | sets[1])
    return rows, want


def test_similar_is_decided_by_exact_jaccard(spark):
    rows, want = graded()
    got = {r.doc_id: r.component_id for r in simhash.similar(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    met = {i: got[2 * i] == got[2 * i + 1] for i in want}
    near = [i for i, s in want.items() if 0.8 <= s < 0.85]
    assert len(near) > 20 and sum(met[i] for i in near) >= 0.95 * len(near)
    assert not any(met[i] for i, s in want.items() if s < 0.8) and any(0.75 < s < 0.8 for s in want.values())


def test_hot_blocks_lose_no_pair(spark):
    """Texts that share most of their words crowd each block; the same pairs link as without a limit."""
    rng = random.Random(77)
    shared = [f"b{k}" for k in range(500)]
    rows, want = [], []
    for i in range(150):
        base = shared[:400] + [f"o{i}w{k}" for k in range(200)]
        other = base[:]
        other[500] = "changed"
        rows += [(2 * i, " ".join(base)), (2 * i + 1, " ".join(other))]
    rng.shuffle(rows)
    sets = {i: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} for i, w in ((i, t.split()) for i, t in rows)}
    for a, b in itertools.combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if both >= 0.8 * (len(sets[a]) + len(sets[b]) - both):
            want.append((a, b))
    assert want == [(2 * i, 2 * i + 1) for i in range(150)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in simhash.similar(df, max_group=4).collect()}
    assert got == {i: i - i % 2 for i in sets}


def test_keep_one_decides_by_row(spark):
    """An id that repeats with other texts loses only the rows that are copies."""
    rows = [(1, "a b c d e f g"), (2, "a b c d e f g"), (2, "some quite different text of its own"), (3, "one more text that nobody has"), (3, "and yet another one for this id"), (3, "one more text that nobody has")]
    kept = sorted(map(tuple, simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()))
    assert kept == sorted({rows[0], rows[2], rows[3], rows[4]})


def test_star_of_many_links(spark):
    """A node with 100,000 links: the same roots whether minima are broadcast or its links are dealt over tasks."""
    star = spark.range(1, 100_001).select(F.when(F.col("id") % 2 == 0, 0).otherwise(-5).alias("a"), F.col("id").alias("b")).unionByName(spark.createDataFrame([(0, 7)], "a long, b long"))
    for options in ({}, {"broadcast_bytes": 0, "part": 1000}):
        got = simhash.components(star, **options)
        assert got.count() == 100_001 and [r.root for r in got.select("root").distinct().collect()] == [-5]


def test_null_id_bridges(spark):
    """Two texts that are linked only through one without an id share a component."""
    texts = bridge()
    df = spark.createDataFrame([(1, texts[0]), (None, texts[1]), (2, texts[2])], "doc_id long, text string")
    assert sorted(((r.doc_id, r.component_id) for r in simhash.near_duplicates(df).collect()), key=str) == [(1, 1), (2, 1), (None, 1)]


def bridge():
    """Three texts whose fingerprints are within 4 bits from one to the next but not from first to last."""
    rng = random.Random(3)
    base = [f"w{rng.randrange(900)}" for _ in range(400)]
    near = {}
    for at in range(0, 400, 3):
        text = " ".join(base[:at] + ["changed"] + base[at + 1 :])
        near[brute_fp(text)] = text
    fp, far = brute_fp(" ".join(base)), lambda x, y: bin(x ^ y).count("1")
    for a, b in itertools.combinations(near, 2):
        if far(a, fp) <= 4 and far(b, fp) <= 4 < far(a, b):
            return near[a], " ".join(base), near[b]
    raise AssertionError("no bridge among these texts")


def test_keep_one_decides_rows_without_id(spark):
    rows = [(None, "a b c d e f g"), (None, "a b c d e f g"), (4, "x y z with words enough"), (None, "x y z with words enough"), (None, "alone with its own words here"), (None, None), (None, "")]
    kept = sorted(((r.doc_id, r.text or "") for r in simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    assert kept == sorted([(None, "a b c d e f g"), (4, "x y z with words enough"), (None, "alone with its own words here"), (None, "")], key=str)


def test_keep_one_hands_on_columns_of_any_name(spark):
    words = " ".join(f"w{i}" for i in range(60))
    rows = [(1, words, "a", 1, b"x", "p", 7), (2, words + " more", "b", 2, b"y", "q", 8), (3, "something else entirely", "c", 3, b"z", "r", 9)]
    d = spark.createDataFrame(rows, "doc_id long, text string, _key string, _id int, _text binary, lead string, `_row` int")
    got = simhash.keep_one(d)
    assert got.columns == d.columns
    assert sorted((r.doc_id, r._key, r._id, bytes(r._text), r.lead, r._row) for r in got.collect()) == [(1, "a", 1, b"x", "p", 7), (3, "c", 3, b"z", "r", 9)]


def test_components_of_few_links_run_in_few_tasks(spark):
    """The driver keeps a record of each task, so rounds over few links don't follow the number of shuffle partitions."""
    conf = {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    was = {k: spark.conf.get(k) for k in conf}
    chain = spark.createDataFrame([(i, i + 1) for i in range(40)], "a long, b long")
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        got = simhash.components(chain)
        assert got.rdd.getNumPartitions() <= spark.sparkContext.defaultParallelism
        assert {tuple(r) for r in got.collect()} == {(i, 0) for i in range(1, 41)}
        small = spark.createDataFrame([(i % 9,) for i in range(99)], "k long").distinct()
        assert common.checked(small).rdd.getNumPartitions() <= spark.sparkContext.defaultParallelism
    finally:
        for k, v in was.items():
            spark.conf.set(k, v)
