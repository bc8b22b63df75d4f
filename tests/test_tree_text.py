"""The drawn tree of folders and of paths, and orders of paths."""

import os

from pyspark.sql import functions as F

from lodestrata.functions import text as T
from lodestrata.operators import ordering, tree
from lodestrata.sources import directories


def walk(folder, depth, most, ignore, indent="", inside=()):
    """A plain walk; a link into a directory it is in isn't entered."""
    if depth == 0:
        return []
    found = sorted((e for e in os.listdir(folder) if e not in ignore), key=lambda n: (os.path.isfile(f"{folder}/{n}"), n.lower(), n))
    out, inside = [], (*inside, os.path.realpath(folder))
    for k, name in enumerate(found[:most]):
        at, last = f"{folder}/{name}", k == len(found) - 1
        out.append(f"{indent}{'└── ' if last else '├── '}{name}{'/' if os.path.isdir(at) else ''}")
        if os.path.isdir(at) and os.path.realpath(at) not in inside:
            out += walk(at, depth - 1, most, ignore, indent + ("    " if last else "│   "), inside)
    if len(found) > most:
        out.append(f"{indent}└── ... ({len(found) - most} more entries hidden)")
    return out


def drawn(rows):
    return [r.line for r in rows.orderBy("key").collect()]


def test_a_folder_as_it_is_on_disk(spark, tmp_path):
    for d in ("src/deep/er/still", "empty", "node_modules/x", "B", "a", "many"):
        os.makedirs(tmp_path / d)
    for f in ("src/main.py", "src/deep/x.log", "README", ".gitignore", "a/z", "node_modules/x/y", "src/Ünïcode | `x`"):
        (tmp_path / f).write_text("*.log\n")
    for k in range(12):
        (tmp_path / "many" / f"f{k}").write_text("")
    os.symlink("nowhere", tmp_path / "broken")
    os.symlink("../src", tmp_path / "a" / "to_src")
    os.symlink("..", tmp_path / "a" / "up")
    os.symlink(".", tmp_path / "self")
    for depth, most in ((8, 100), (2, 100), (8, 3), (1, 1), (8, 12)):
        got = directories.folder_tree(spark, tmp_path, ("node_modules",), depth, most)
        assert drawn(got) == walk(str(tmp_path), depth, most, ("node_modules",)), (depth, most)
    paths = {r.path for r in got.collect()}
    assert {"empty", "src/deep/x.log", "a/to_src/main.py"} <= paths and "a/up/a" not in paths


def test_folders_without_anything(spark, tmp_path):
    assert directories.folder_tree(spark, tmp_path).count() == 0
    assert directories.folder_tree(spark, tmp_path / "missing").count() == 0
    assert directories.folder_tree(spark, tmp_path, max_depth=0).count() == 0


def test_a_name_that_is_not_utf8(spark, tmp_path):
    os.makedirs(os.fsencode(tmp_path) + b"/d\xff")
    open(os.fsencode(tmp_path) + b"/d\xff/inside", "w").close()
    assert drawn(directories.folder_tree(spark, tmp_path)) == ["└── d�/"]


def test_lines_of_paths(spark, tmp_path):
    paths = ["z_file", "a_file", "z_dir/x", "a_dir/y", "a_dir/sub/deep/er", *(f"many/f{k:02}" for k in range(9)), "Many2/only"]
    for p in paths:
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text("")
    rows = spark.createDataFrame([(p,) for p in paths], "rel_path string")
    for depth, most in ((8, 100), (2, 100), (8, 3), (1, 1), (8, 9)):
        got = tree.lines(tree.entries(rows, depth, most), most)
        assert drawn(got) == walk(str(tmp_path), depth, most, ()), (depth, most)
    assert tree.lines(tree.entries(rows.where("false"))).count() == 0


def test_paths_are_ordered_by_their_parts(spark):
    paths = ["a-b/x", "a/x", "a", "a.c/x", "a b/x", "a/x/y", "a/-", "ä/x", "", None, "a/x"]
    rows = spark.createDataFrame([(k, p, k) for k, p in enumerate(paths)], "id int, rel_path string, row int").repartition(5)
    got = ordering.numbered(rows, T.path_key("rel_path"), "id")
    want = sorted(range(len(paths)), key=lambda k: (paths[k] is not None, (paths[k] or "").split("/"), k))
    assert [r.id for r in got.orderBy("position").collect()] == want
    assert sorted(r.position for r in got.collect()) == list(range(len(paths)))
    assert ordering.numbered(rows.where("false"), "id").count() == 0
    assert rows.select(F.min(T.path_key(F.col("rel_path")))).first()[0] == ""
