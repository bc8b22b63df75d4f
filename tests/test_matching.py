import random
import re

from lodestrata.operators import matching

RULES = "rule string, literal string, pattern string"


def by_hand(files, rules):
    out = set()
    for path, text in files:
        lines = re.split(r"\r\n|\r|\n", text or "")
        out |= {(path, n, rule) for n, line in enumerate(lines, 1) if line or n < len(lines) for rule, _, p in rules if p is not None and re.search(p, line)}
    return out


def found(spark, files, rules, **options):
    rows = matching.match_rules(spark.createDataFrame(files, "rel_path string, content string"), spark.createDataFrame(rules, RULES), **options).collect()
    assert len(set(rows)) == len(rows)
    return {tuple(r) for r in rows}


def test_rules_equal_one_by_one(spark):
    rnd = random.Random(5)
    word = lambda: "".join(rnd.choices("abé", k=rnd.randint(1, 3)))
    files = [(f"f{i}", "".join(rnd.choice(("a", "b", "é", " ", "\n", "\r", "\r\n", "A")) for _ in range(rnd.randint(0, 300)))) for i in range(30)]
    rules = []
    for i in range(120):
        w = word()
        rules.append((f"r{i}", w, rf"\b{w}\b" if i % 3 else f"{w}$"))
    assert found(spark, files, rules) == by_hand(files, rules)
    assert found(spark, files, rules, slice_bytes=50) == by_hand(files, rules)


def test_rules_of_any_kind(spark):
    files = [("a", "Key=1\r\nkey=2\rnothing\nKEY=3 key=4"), ("b", ""), ("c", None), ("d", "x" * 2_000_000 + "key=9"), ("a", "key=2")]
    rules = [
        ("any case", "key", "(?i)key=[0-9]"), ("one case", "KEY=", "KEY=[0-9]"), ("no literal", None, "^nothing$"), ("empty literal", "", "=4$"),
        ("two ways", "key=2", "key=2"), ("two ways", "nothing", "nothing"), ("none", "key", None), ("across", "1\r\nk", "1\r\nk"), ("absent", "zzz", "zzz"), (None, "key=9", "key=9"),
    ]
    rows = matching.match_rules(spark.createDataFrame(files, "rel_path string, content string"), spark.createDataFrame(rules, RULES)).collect()
    assert {tuple(r) for r in rows} == {
        ("a", 1, "any case"), ("a", 2, "any case"), ("a", 4, "any case"), ("d", 1, "any case"), ("a", 4, "one case"), ("a", 3, "no literal"), ("a", 4, "empty literal"),
        ("a", 2, "two ways"), ("a", 3, "two ways"), ("a", 1, "two ways"), ("d", 1, None),
    }
    assert found(spark, [], rules) == set() and found(spark, files, []) == set()


def test_parts_of_a_file_go_on_counting(spark):
    parts = spark.createDataFrame([("a", b"x\nkey\n", 0), ("a", b"key\xff\n", 2)], "rel_path string, content binary, first_line long")
    rows = matching.match_rules(parts, spark.createDataFrame([("k", "key", "^key"), ("every", None, "y")], RULES)).collect()
    assert {tuple(r) for r in rows} == {("a", 2, "k"), ("a", 3, "k"), ("a", 2, "every"), ("a", 3, "every")}
