import random

from pyspark.sql import functions as F

from lodestrata.functions import text as T


def values(spark, rows, *exprs):
    return [tuple(r) for r in spark.createDataFrame([(r,) for r in rows], "x string").select(*exprs).collect()]


def test_lines(spark):
    samples = ["", "a", "a\n", "a\n\n", "\n", "a\r\nb\rc\nd", "x\x0by\x0cz\x1c\x1d\x1e\x85\u2028\u2029e", "é\u00a0\n"]
    got = values(spark, samples, T.lines_keep_ends("x"), T.lines_lf("x"), T.lines_universal("x"))
    for s, (kept, lf, universal) in zip(samples, got):
        assert kept == s.splitlines(keepends=True)
        assert lf == (s[:-1] if s.endswith("\n") else s).split("\n") if s else lf == []
        assert universal == [x.rstrip("\n") for x in s.replace("\r\n", "\n").replace("\r", "\n").splitlines(keepends=True)] or "\x0b" in s


def test_lines_with_ends_are_those_of_python(spark):
    rng = random.Random(7)
    samples = ["".join(rng.choice("ab \u00e9\U0001f600\n\r\r\n\x0b\x0c\x1c\x1d\x1e\x1f\x85\u2028\u2029") for _ in range(rng.randint(0, 12))) for _ in range(2000)] + ["\r", "\r\n", "\n\r", "a\r", "a\r\n", "\r\r\n\n"]
    got = values(spark, [*samples, None], T.lines_keep_ends("x"))
    assert [g[0] for g in got] == [*(s.splitlines(keepends=True) for s in samples), None]


def test_line_kinds(spark):
    text = "fn main() {\n\n// comment\n# comment\nlet value = 42;\n  \n}\n"
    got = values(spark, [text], F.transform(T.lines_lf("x"), T.line_kind))[0][0]
    assert (len(got), got.count("code"), got.count("comment"), got.count("blank")) == (7, 3, 2, 2)


def test_paths(spark):
    rows = ["main.py", "src/.hidden", "a/B.TAR.GZ", "a/b/.env.local", "x.", "noext"]
    got = values(spark, rows, T.extension("x"), T.parent("x"), T.is_hidden("x"), T.secret_name("x"))
    assert [g[0] for g in got] == [".py", "", ".gz", ".local", ".", ""]
    assert [g[1] for g in got] == [".", "src", "a", "a/b", ".", "."]
    assert [g[2] for g in got] == [False, True, False, True, False, False]
    assert [g[3] for g in got] == [False, False, False, True, False, False]


def test_sizes_and_slugs(spark):
    sizes = {0: "0.0 B", 1023: "1023.0 B", 1536: "1.5 KiB", 1280: "1.2 KiB", 1024**2: "1.0 MiB", 1024**4: "1.0 TiB"}
    assert [r[0] for r in spark.createDataFrame([(k,) for k in sizes], "x long").select(T.human_size("x")).collect()] == list(sizes.values())
    slugs = {"My Project": "my-project", "  My   Project---Name  ": "my-project-name", "...": "project"}
    assert [r[0] for r in values(spark, list(slugs), T.slug("x"))] == list(slugs.values())


def test_tail_truncation_and_ids(spark):
    long = "\n".join(map(str, range(100)))
    got = values(spark, [long, "a" * 200, " " + "b" * 201], T.tail("x"), T.truncated("x"), T.rule_id("todo", "x"))
    assert got[0][0] == "\n".join(map(str, range(20, 100))) and got[1][1] == "a" * 200 and got[2][1] == "b" * 197 + "..."
    assert values(spark, ["AWS Access Key"], T.rule_id("secret", "x"))[0][0] == "secret/aws-access-key"
