import os

import pytest

from lodestrata import rules
from lodestrata.operators import findings, incremental, records, snapshots
from lodestrata.streaming import feed


def wanted(root):
    """Entries that a scan of the whole tree gives: path to hash and numbers of findings."""
    import hashlib

    out = {}
    for folder, _, names in os.walk(root):
        for name in names:
            path = os.path.join(folder, name)
            with open(path, "rb") as f:
                data = f.read()
            if data and b"\0" not in data:
                out[os.path.relpath(path, root)] = (hashlib.sha256(data).hexdigest(), data.count(b"TODO"))
    return out


def cached(spark, path):
    return {r.rel_path: (r.hash, len(r.todos)) for r in snapshots.load(spark, path).collect()}


def test_a_cache_follows_a_tree(spark, tmp_path):
    root, cache = tmp_path / "tree", f"{tmp_path}/cache"
    (root / "sub").mkdir(parents=True)
    for i in range(12):
        (root / "sub" / f"f{i}.py").write_text(f"x = {i}\n# TODO {i}\n")
    run = lambda: feed.follow(spark, str(root), cache, f"{tmp_path}/check", buckets=8, userIgnores="", shards=3).awaitTermination()
    run()
    assert cached(spark, cache) == wanted(root) and len(wanted(root)) == 12
    first = snapshots.manifest(snapshots.Store(spark, cache))
    run()  # nothing has changed
    assert snapshots.manifest(snapshots.Store(spark, cache)) == first
    (root / "sub" / "f1.py").write_text("# TODO a\n# TODO b\n")
    (root / "sub" / "f2.py").unlink()
    (root / "new.py").write_text("no marker\n")
    (root / "sub" / "f3.py").write_bytes(b"\0binary now")
    run()
    assert cached(spark, cache) == wanted(root) and len(wanted(root)) == 11
    second = snapshots.manifest(snapshots.Store(spark, cache))
    paths = spark.createDataFrame([(p,) for p in ("sub/f1.py", "sub/f2.py", "sub/f3.py", "new.py")], "rel_path string")
    moved = set(snapshots.touched(snapshots.Store(spark, cache), paths, 8))
    assert {b for b in second["buckets"] if second["buckets"][b] != first["buckets"].get(b)} <= moved and second["version"] == first["version"] + 1


def test_a_failed_batch_is_run_again(spark, tmp_path, monkeypatch):
    root, cache = tmp_path / "tree", f"{tmp_path}/cache"
    root.mkdir()
    (root / "a.py").write_text("# TODO 1\n")
    run = lambda: feed.follow(spark, str(root), cache, f"{tmp_path}/check", buckets=4, userIgnores="", shards=2)
    run().awaitTermination()
    (root / "b.py").write_text("# TODO 2\n")
    (root / "a.py").unlink()
    with monkeypatch.context() as m:
        m.setattr(snapshots.Store, "publish", lambda *a: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(Exception, match="lost"):
            run().awaitTermination()
    assert set(cached(spark, cache)) == {"a.py"}
    run().awaitTermination()  # from the checkpoint: the batch that failed
    assert cached(spark, cache) == wanted(root)
    (root / "c.py").write_text("late\n")
    run().awaitTermination()
    assert cached(spark, cache) == wanted(root)


def entries(spark, rows):
    files = spark.createDataFrame(rows, "rel_path string, content string")
    return incremental.build_cache(records.records(files), findings.scan_todos(files), findings.scan_secrets(files), unhashed=True)


@pytest.mark.parametrize("step", ["before data", "after data", "manifest", "tidy"])
def test_a_version_is_there_wholly_or_not(spark, tmp_path, monkeypatch, step):
    path = f"{tmp_path}/c"
    assert snapshots.load(spark, path).count() == 0
    snapshots.merge(entries(spark, [(f"f{i}", f"# TODO {i}") for i in range(20)]), path, batch=0, buckets=4)
    before = cached(spark, path)
    more = entries(spark, [("f1", "# TODO x\n# TODO y"), ("f2", ""), ("g", "new")])

    def lost(*a, **k):
        raise OSError("lost")

    with monkeypatch.context() as m:
        if step == "before data":
            m.setattr(snapshots, "touched", lost)
        elif step == "after data":
            names = snapshots.Store.names
            m.setattr(snapshots.Store, "names", lambda self, rel: lost() if rel.startswith("data/") else names(self, rel))
        elif step == "manifest":
            m.setattr(snapshots.Store, "publish", lost)
        else:
            m.setattr(snapshots, "tidy", lost)
        with pytest.raises(OSError):
            snapshots.merge(more, path, batch=1, buckets=4)
    after = {k: v for k, v in before.items() if k != "f2"} | {"f1": (cached(spark, path) if step == "tidy" else {"f1": None})["f1"]}
    assert cached(spark, path) == before or step == "tidy"
    assert snapshots.merge(more, path, batch=1, buckets=4) == 2 and snapshots.merge(more, path, batch=1, buckets=4) == 2
    got = cached(spark, path)
    assert got["f1"][1] == 2 and "f2" not in got and "g" in got and set(got) == set(after) | {"g"}
    assert {r.rel_path for r in snapshots.load(spark, path, version=1).collect()} == set(before)
    store = snapshots.Store(spark, path)
    for k in range(3):
        snapshots.merge(entries(spark, [(f"h{k}", "x")]), path, buckets=4)
    used = {f for v in snapshots.manifests(store) for f in snapshots.manifest(store, v)["buckets"].values()}
    assert len(snapshots.manifests(store)) == 2 and set(store.names("data")) == used


def test_other_rules_make_a_cache_void(spark, tmp_path, monkeypatch):
    path = f"{tmp_path}/c"
    snapshots.merge(entries(spark, [("a", "x")]), path)
    monkeypatch.setattr(rules, "fingerprint", lambda: "other")
    assert snapshots.load(spark, path).count() == 0
