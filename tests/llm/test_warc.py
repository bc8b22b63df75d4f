import hashlib
import random

import pytest

from lodestrata.llm import warc

SCHEMA = "page_id long, url string, html string, archive string, length int"


def pages(spark, rows):
    return spark.createDataFrame([(*r, "clash", 1) for r in rows], SCHEMA)


def corpus(n=300):
    rng = random.Random(6)
    return [(i * 3, f"http://h/{i}", rng.choice([None, "", "é<p>" * rng.randint(1, 90)])) for i in range(n)] + [(None, "u", "x"), (None, None, None), (9, "again", "y"), (9, "again", "y")]


LEAF = "archive long, slot long, record_id long, start long, length long, hash string"


def leaf_rows(records, archive=0):
    """Leaves of ``(record_id, bytes)`` in the order given."""
    at, out = 0, []
    for slot, (i, data) in enumerate(records):
        out.append((archive, slot, i, at, len(data), hashlib.sha256(data).hexdigest()))
        at += len(data)
    return out


def brute(ours, theirs):
    """Every leaf of both sides compared by plain loops."""
    here, there = ({(r[0], r[1]): r for r in x} for x in (ours, theirs))
    own = [r for k, r in here.items() if k not in there or there[k][3:] != r[3:]]
    other = [r for k, r in there.items() if k not in here or here[k][3:] != r[3:]]
    out = [(*r, "intact") for r in ours if r not in own]
    for key, status in ((lambda r: (r[0], r[2], r[5]), "moved"), (lambda r: (r[0], r[2]), "changed")):
        for r in sorted(own, key=lambda r: r[:2]):
            if hit := next((x for x in sorted(other, key=lambda r: r[:2]) if key(x) == key(r)), None):
                out.append((*r, status))
                own.remove(r)
                other.remove(hit)
    return sorted([*out, *((*r, "missing") for r in own), *((*r, "extra") for r in other)], key=str)


def audited(spark, ours, theirs, fan_out=3):
    got = warc.check_replica(spark.createDataFrame(ours, LEAF), spark.createDataFrame(theirs, LEAF), fan_out=fan_out)
    return sorted(map(tuple, got.collect()), key=str)


def test_every_kind_of_damage_is_found(spark):
    rows = corpus()
    other = list(rows)
    other[5] = (*rows[5][:2], "overwritten")
    other[200] = (rows[200][0], "elsewhere", rows[200][2])
    other = [r for i, r in enumerate(other) if i not in (0, 77, 299)] + [(-4, "new", "page"), (10**6, "new", "page")]
    a, b = warc.leaves(pages(spark, rows), span=100), warc.leaves(pages(spark, other), span=100)
    got = sorted(map(tuple, warc.check_replica(a, b, fan_out=3).collect()), key=str)
    assert got == brute([tuple(r) for r in a.collect()], [tuple(r) for r in b.collect()])
    kind = {(r[2], r[6]) for r in got if r[6] not in ("intact", "moved")}
    assert kind == {(rows[5][0], "changed"), (rows[200][0], "changed"), (0, "missing"), (231, "missing"), (897, "missing"), (-4, "extra"), (10**6, "extra")}
    assert len(got) == len(rows) + 2


def test_order_and_offsets_are_audited(spark):
    """A replica in another order, padded, shifted, or without a record isn't intact."""
    rng = random.Random(8)
    records = [(i // 2, rng.randbytes(rng.randint(1, 60))) for i in range(40)] + [(None, b"same")] * 5
    ours = leaf_rows(records)
    lost, padded = records[:20] + records[21:], records[:20] + [(99, b"pad")] + records[20:]
    shifted = [(a, s, i, at + 7, n, h) for a, s, i, at, n, h in ours]
    swapped = records[:3] + [records[4], records[3]] + records[5:]
    cases = [leaf_rows(records[::-1]), leaf_rows(lost), leaf_rows(padded), shifted, leaf_rows(swapped), leaf_rows(records + records[:2]), []]
    own = [(k, *r[1:]) for k in range(len(cases)) for r in ours]
    other = [(k, *r[1:]) for k, case in enumerate(cases) for r in case]
    got = audited(spark, own, other)
    assert got == brute(own, other)
    kinds = [[r[6] for r in got if r[0] == k] for k in range(len(cases))]
    assert kinds[0].count("intact") <= 1 and kinds[1].count("intact") == 20 and set(kinds[3]) == {"moved"} and set(kinds[6]) == {"missing"}


def test_only_differing_branches_are_descended(spark):
    records = [(i, bytes([i])) for i in range(81)]
    ours = leaf_rows(records)
    theirs = leaf_rows([*records[:50], (50, b"!"), *records[51:]])
    a, b = (warc.tree(spark.createDataFrame(x, LEAF), 4, 3) for x in (ours, theirs))
    got = warc.differing(a, b, 3).collect()
    assert [(r.archive, r.node) for r in got] == [(0, 50)]
    assert warc.differing(a, a, 3).count() == 0


def test_large_archive_is_numbered_over_tasks(spark):
    """One archive with ids that all repeat, and null ids: places and offsets equal a plain count."""
    rows = [(7, "u", "x")] * 300 + [(None, "u", "y")] * 200 + [(8, None, "z" * (i % 5)) for i in range(300)]
    got = [tuple(r) for r in warc.leaves(pages(spark, rows).repartition(7)).collect()]
    for archive in (-1, 0):
        own = sorted((r for r in got if r[0] == archive), key=lambda r: r[1])
        assert [r[1] for r in own] == list(range(len(own)))
        assert [r[3] for r in own] == [sum(x[4] for x in own[:i]) for i in range(len(own))]
        assert [(r[2] or 0, r[5]) for r in own] == sorted((r[2] or 0, r[5]) for r in own)


def test_equal_replicas_and_empty_tables(spark):
    rows = corpus(40)
    a = warc.leaves(pages(spark, rows))
    assert {r.status for r in warc.check_replica(a, warc.leaves(pages(spark, rows[::-1]))).collect()} == {"intact"}
    none = warc.leaves(pages(spark, []))
    assert warc.check_replica(none, none).count() == 0
    assert {r.status for r in warc.check_replica(a, none).collect()} == {"missing"}
    assert {r.status for r in warc.check_replica(none, a).collect()} == {"extra"}


def test_root_equals_brute_force(spark):
    leaf = [tuple(r) for r in warc.leaves(pages(spark, corpus(50)[:50]), span=1000).orderBy("archive", "slot").collect()]
    level = [(start, length, h) for _, _, _, start, length, h in leaf]
    assert [x[0] for x in level] == [sum(y[1] for y in level[:i]) for i in range(len(level))]
    levels = 0
    while len(level) > 1 or not levels:
        groups = [level[i : i + 4] for i in range(0, len(level), 4)]
        level = [(g[0][0], sum(x[1] for x in g), hashlib.sha256(",".join(":".join(map(str, x)) for x in g).encode()).hexdigest()) for g in groups]
        levels += 1
    made = warc.leaves(pages(spark, corpus(50)[:50]), span=1000)
    assert warc.depth(made, fan_out=4) == levels
    root = warc.tree(made, levels, 4)[-1].collect()
    assert [(r.start, r.length, r.hash) for r in root] == level


@pytest.fixture
def folder(tmp_path, spark):
    data = b"".join(r[0].encode() for r in pages(spark, corpus(30)).select(warc.record(warc.F.col("url"), warc.F.col("html"))).collect())
    for name in ("a", "b"):
        (tmp_path / name).mkdir()
    (tmp_path / "a/x.warc").write_bytes(data)
    return tmp_path, data


def test_files(spark, folder):
    path, data = folder
    a = warc.scan_archives(spark, str(path / "a"))
    rows = a.orderBy("slot").collect()
    assert len(rows) == 34 and sum(r.length for r in rows) == len(data)
    assert all(hashlib.sha256(data[r.start : r.start + r.length]).hexdigest() == r.hash for r in rows)
    at = rows[7].start + 3
    (path / "b/x.warc").write_bytes(data[:at] + b"#" + data[at + 1 :])
    name = warc.F.regexp_extract("archive", "[^/]*$", 0)
    got = warc.check_replica(a.withColumn("archive", name), warc.scan_archives(spark, str(path / "b")).withColumn("archive", name)).where("status != 'intact'").collect()
    assert [(r.record_id, r.status) for r in got] == [(7, "changed")]


def test_compressed_files(spark, tmp_path):
    import gzip

    records = [f"WARC/1.1\r\nContent-Length: {i}\r\n\r\n{'x' * i}\r\n\r\n".encode() for i in range(12)]
    parts = [gzip.compress(r) for r in records]
    (tmp_path / "x.warc.gz").write_bytes(b"".join(parts))
    rows = warc.scan_archives(spark, str(tmp_path)).orderBy("slot").collect()
    assert [(r.length, r.hash) for r in rows] == [(len(p), hashlib.sha256(p).hexdigest()) for p in parts]
    bad = bytearray(b"".join(parts))
    bad[sum(map(len, parts[:4])) + 12] ^= 255
    view = memoryview(bytes(bad))
    assert [e - s for s, e in warc.members_in(view)][:4] == [len(p) for p in parts[:4]] and sum(e - s for s, e in warc.members_in(view)) == len(bad)
