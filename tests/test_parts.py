import hashlib
import random

import pytest
from pyspark.sql import functions as F

from lodestrata.operators import parts, records, transfer
from lodestrata.plans import queries
from lodestrata.sources import files as source


def cut_up(text, rng, inside=False):
    """Rows ``(part, content, continues)`` of a text, cut behind LF or anywhere."""
    at = sorted(rng.sample(range(1, len(text)), min(len(text) - 1, 6))) if len(text) > 1 else []
    if not inside:
        at = [i for i in at if text[i - 1] == "\n"]
    at = [i for i in at if text[i - 1] != "\r"]
    edges = [0, *at, len(text)]
    return [(k, text[a:b], a > 0 and text[a - 1] != "\n") for k, (a, b) in enumerate(zip(edges, edges[1:]))]


@pytest.mark.parametrize("inside", [False, True])
def test_chunks_of_parts_are_those_of_the_whole(spark, inside):
    rng = random.Random(inside)
    texts = {f"f{i}": "".join(rng.choice(["", "a", "bcd efg", "é" * 12, "x" * 70]) + rng.choice(["\n", "\n", "\r\n", "\r", " ", " "]) for _ in range(rng.choice([1, 5, 60, 300]))) for i in range(30)}
    rows = [(name, *r) for name, t in texts.items() for r in cut_up(t, rng, inside)] + [("none", 0, "", False), ("null", 0, None, None)]
    d = spark.createDataFrame(rows, "rel_path string, part int, content string, continues boolean").repartition(3)
    hashes = transfer.ordered_hash(d, "rel_path", "part", "content")
    got = parts.split_parts(d, hashes, 7, 60)
    want = transfer.split_chunks(spark.createDataFrame(list(texts.items()), "rel_path string, content string"), 7, 60)
    assert sorted(map(tuple, got.select(want.columns).collect())) == sorted(map(tuple, want.collect()))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" not in plan


def test_parts_are_folded_once(spark):
    """Chunks are kept before they are numbered: no later step splits and folds the texts again."""
    d = spark.createDataFrame([("f", 0, "a\nb\n"), ("f", 1, "c\n"), ("g", 0, "d")], "rel_path string, part int, content string")
    got = parts.split_parts(d, spark.createDataFrame([("f", "1"), ("g", "2")], "rel_path string, hash string"), 2, 2)
    assert sorted((r.rel_path, r.chunk_index, r.total_chunks, r.body, r.report_hash) for r in got.collect()) == [("f", 1, 3, "a\n", "sha256:1"), ("f", 2, 3, "b\n", "sha256:1"), ("f", 3, 3, "c\n", "sha256:1"), ("g", 1, 1, "d", "sha256:2")]
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" not in plan and "split(" not in plan
    bare = parts.split_parts(d, spark.createDataFrame([("f", "1"), ("g", "2")], "rel_path string, hash string"), 2, 2, bodies=False)
    assert "body" not in bare.columns and "body" not in bare._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(map(tuple, bare.collect())) == sorted(map(tuple, got.drop("body").collect()))


def test_documents_are_cut_where_they_are_read(spark, tmp_path):
    rng = random.Random(11)
    texts = {k: "".join(rng.choice(["", "ab", "\u00e9" * 9, "\U0001f600x"]) + rng.choice(["\n", "\r\n", "\r", "\x0b", "\x1c", "\x85", "\u2028"]) for _ in range(rng.choice([0, 1, 40]))) + rng.choice(["", "end"]) for k in range(30)}
    spark.createDataFrame([*((k, t, "en", "s") for k, t in texts.items()), (30, None, "en", "s")], "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    cut = queries._in_parts(spark, str(tmp_path), 25)
    want = set()
    for k, t in texts.items():
        ahead, own = 0, {}
        for line in t.splitlines(keepends=True):
            own[ahead // 25] = own.get(ahead // 25, "") + line
            ahead += len(line)
        want |= {(f"s/{k}.en", part, content) for part, content in own.items()}
    rows = [tuple(r) for r in cut.collect()]
    assert set(rows) == want and len(rows) == len(want)
    assert "Exchange" not in cut._jdf.queryExecution().executedPlan().toString()
    chunks = queries.part_chunks(spark, str(tmp_path))
    assert sorted(map(tuple, chunks.drop("report_hash").collect())) == sorted(map(tuple, queries.chunk_plan(spark, str(tmp_path)).collect()))


def test_sums_ahead_in_short_stretches(spark):
    rng = random.Random(4)
    rows = [(g, i, rng.randint(0, 9)) for g in "ab" for i in rng.sample(range(200), 90)]
    got = parts.sums_ahead(spark.createDataFrame(rows, "g string, at long, n long"), ["g"], "at", "n", "s", width=7).collect()
    assert len(got) == len(rows) and all(r.s == sum(n for g, i, n in rows if g == r.g and i < r["at"]) for r in got)


def test_verdicts_equal_those_of_gathered_transfers(spark):
    rng = random.Random(9)
    sent = transfer.envelopes(transfer.split_chunks(spark.createDataFrame([(f"t{i}", "line of text\n" * rng.randint(1, 40)) for i in range(40)], "rel_path string, content string"), 5, 30), F.col("rel_path"), F.lit("now"))
    rows = [(r.rel_path, r.message) for r in sent.collect()]
    bad = []
    for name, m in rows:
        kind = int(name[1:]) % 8
        if kind == 1 and rng.random() < 0.2:
            continue
        if kind == 2 and rng.random() < 0.3:
            bad.append((name, m))
        if kind == 3:
            m = m.replace("line of", "lime of", 1)
        if kind == 4 and rng.random() < 0.5:
            m = m.replace("session_id=t", "session_id=u")
        if kind == 5:
            m = m[:-3]
        bad.append((name, m))
    rng.shuffle(bad)
    parsed = transfer.parse_chunks(spark.createDataFrame(bad, "t string, message string"))
    want = {r.t: (r.status, r.reason, r.chunks, r.content and hashlib.sha256(r.content.encode()).hexdigest()) for r in transfer.verify(parsed, "t").collect()}
    verdicts = parts.verify(parsed, "t")
    assert {r.t: tuple(r)[1:] for r in verdicts.collect()} == want and len({w[1] for w in want.values()}) > 4
    bodies = {}
    for r in parts.rebuild(parsed, verdicts, "t").orderBy("t", "chunk_index").collect():
        bodies[r.t] = bodies.get(r.t, "") + r.body
    assert {t: hashlib.sha256(b.encode()).hexdigest() for t, b in bodies.items()} == {t: w[3] for t, w in want.items() if w[3]}


def test_large_files_in_parts(spark, tmp_path):
    """The same chunks, hash and counts whatever a row may hold; one line longer than a row; a binary file."""
    rng = random.Random(3)
    text = "".join("# word é\r\n" if rng.random() < 0.2 else "x" * rng.randint(0, 80) + "\n" for _ in range(2000)) + "é" * 9000 + "\n  \nlast"
    (tmp_path / "a.txt").write_bytes(text.encode())
    (tmp_path / "wide.txt").write_bytes(("# " + "wö" * 40_000).encode())
    (tmp_path / "bin.dat").write_bytes(b"\0" + b"x" * 50_000)
    seen = []
    for most in (1 << 20, 3000):
        tree = source.read_tree(spark, tmp_path, maxContentBytes=most)
        made = sorted(map(tuple, records.records(tree).collect()))
        texts = tree.where("rel_path like '%.txt'")
        hashes = records.records(tree).select("rel_path", F.col("content_hash").alias("hash"))
        chunks = parts.split_parts(texts, hashes, 1000, 4000).select("rel_path", "chunk_index", "total_chunks", "start_line", "end_line", "chunk_hash", "report_hash")
        seen.append((made, sorted(map(tuple, chunks.collect()))))
        assert most > 3000 or texts.count() > 50 and max(len(r.content) for r in texts.collect()) <= 6000
    assert seen[0] == seen[1]
    assert {r[0]: r[-1] for r in seen[0][0]} == {"a.txt": hashlib.sha256(text.encode()).hexdigest(), "wide.txt": hashlib.sha256((tmp_path / "wide.txt").read_bytes()).hexdigest(), "bin.dat": None}
