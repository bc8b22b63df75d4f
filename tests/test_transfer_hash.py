import hashlib

from lodestrata.operators import transfer


def test_ordered_hash_gathers_no_transfer(spark):
    rows = [(i % 3, 500 - i, f"é{i} ") for i in range(500)] + [(0, 7, None), (9, 0, None), (None, 2, "b"), (None, 1, "a"), (8, 1, "y"), (8, 1, "x")]
    made = transfer.ordered_hash(spark.createDataFrame(rows, "k long, n int, t string"), "k", "n", "t")
    want = {k: "".join(t for _, t in sorted((n, t) for i, n, t in rows if i == k and t is not None)) for k, *_ in rows}
    assert {r.k: r.hash for r in made.collect()} == {k: hashlib.sha256(t.encode()).hexdigest() for k, t in want.items()}
    assert made.count() == len(want)
    assert "collect_list" not in made._jdf.queryExecution().toString()
