import hashlib
import random
import re

import pytest

from lodestrata.llm import pii

DOCS = "doc_id long, text string, spans string, row int"
IBAN = "DE89370400440532013000"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "clash", 3) for i, t in rows], DOCS)


def luhn(d):
    return sum(int(c) if k % 2 == 0 else sum(divmod(2 * int(c), 10)) for k, c in enumerate(reversed(d))) % 10 == 0


def brute(text):
    """The contract's base kinds, as it states them."""
    text = text or ""
    out = []
    for o, (kind, pattern) in enumerate({
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    }.items()):
        for m in re.finditer(pattern, text):
            d = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else 0, "card": 12 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15}[kind]
            if ok:
                out.append((m.start(), o, kind, m.end()))
    return [(kind, s, e) for s, _, kind, e in sorted(out)]


def found(spark, rows, **options):
    return [(r.doc_id, [(s.kind, s.start, s.end) for s in r.spans], r.spans) for r in pii.annotate(docs(spark, rows), **options).select("doc_id", "spans").collect()]


def test_base_spans_equal_brute_force(spark):
    rng = random.Random(12)
    bits = [
        "a.b@c.de", "@", "x@y", ".", "-", "_", "+", "%", "1.2.3.4", "256.1.1.1", "0001.02.3.4.5.6.7.8", "4111 1111-1111 1111", "4111111111111112", "378282246310005", "0" * 12, "+1 (743) 555-3824", "+49", "(", ")",
        " ", " ", "\n", "é", "😀", "12", "7", "a", "Z9", "-555-", "1111 1111 1111 1117", "co.uk@d-e.f-g", IBAN,
    ]
    rows = [(i, "".join(rng.choices(bits, k=rng.choice([1, 3, 8, 30, 400])))) for i in range(400)]
    for i, spans, _ in found(spark, rows):
        assert [s for s in spans if s[0] in pii.BASE] == brute(rows[i][1]), rows[i]


@pytest.mark.parametrize("unit", ["a", "1", "1-", "+1", "1.", "a@b.", "a@", "+1 (", "AB12"])
def test_long_runs_take_time_by_length(spark, unit):
    [(_, short, _), (_, long, _)] = sorted(found(spark, [(1, unit * 500), (2, unit * 100_000)]))
    assert [s for s in short if s[0] in pii.BASE] == brute(unit * 500)
    assert len(long) == (200 * len(short) if unit in ("1.", "a@b.") else len(short))


def test_checksums_and_words(spark):
    rows = [
        (1, f"pay to {IBAN} today"), (2, "pay to DE89 3704 0044 0532 0130 00 today"), (3, f"pay to {IBAN[:-1]}1 today"), (4, f"sample {IBAN} here"), (5, f"x{IBAN}"),
        (6, "my SSN: 078-05-1120"), (7, "part 078-05-1120"), (8, "ssn 000-05-1120"), (9, "please call (212) 555-0188 now"), (10, "code 212-555-0188 now"), (11, "tel +1 212-555-0188"),
        (12, "sample build 10.0.0.1"),
    ]
    got = {i: spans for i, spans, _ in found(spark, rows)}
    at = lambda i, v, kind: [(kind, rows[i - 1][1].index(v), rows[i - 1][1].index(v) + len(v))]
    assert got[1] == at(1, IBAN, "iban") and got[2] == at(2, "DE89 3704 0044 0532 0130 00", "iban") and got[4] == at(4, IBAN, "iban")
    assert got[6] == at(6, "078-05-1120", "ssn") and got[9] == at(9, "(212) 555-0188", "local_phone") and got[11] == at(11, "+1 212-555-0188", "phone")
    assert got[12] == at(12, "10.0.0.1", "ip") and not any(got[i] for i in (3, 5, 7, 8, 10))
    scores = {i: s[0].score for i, _, s in found(spark, rows) if s}
    assert scores[1] == 0.9 and scores[4] == 0.6 and scores[12] == 0.3 and scores[9] == 0.65


def test_odd_rows(spark):
    text = "a@b.cd and 4111111111111111"
    rows = [(1, None), (2, ""), (None, text), (3, text), (3, text), (4, "word " * 100_000 + text)]
    got = sorted((i or 0, spans) for i, spans, _ in found(spark, rows))
    want = [("email", 0, 6), ("card", 11, 27)]
    assert got == [(0, want), (1, []), (2, []), (3, want), (3, want), (4, [(k, s + 500_000, e + 500_000) for k, s, e in want])]
    assert pii.annotate(docs(spark, [])).count() == 0


def test_redact(spark):
    rows = [(1, "x a@b.cd y 1.2.3.4"), (2, None), (3, "plain"), (4, "1.2.3.4@x.yz")]
    d = docs(spark, rows)
    got = pii.redact(d)
    assert got.columns == d.columns and got.select("spans", "row").distinct().collect() == [("clash", 3)]
    assert {r.doc_id: r.text for r in got.collect()} == {1: "x [EMAIL] y [IP]", 2: None, 3: "plain", 4: "[EMAIL]"}


def test_query_equals_sql(spark, tmp_path):
    import duckdb

    from lodestrata.llm.common import table

    rng = random.Random(2)
    bits = ["a.b@c.de", "+1 (743) 555-3824", "1.2.3.4", "4111 1111 1111 1111", IBAN, "GB82 WEST 1234 5698 7654 32", "call", "212-555-0188", "ssn 078-05-1120", "example", " ", " ", ", ", "é", "x"]
    rows = [(i, "".join(rng.choices(bits, k=rng.choice([1, 5, 30])))) for i in range(300)] + [(900, None), (901, ""), (1, "a@b.c"), (None, "1.2.3.4")]
    docs(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = pii.op12_pii(spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    want = con.execute(pii.ORACLE_SQL["op12_pii"])
    assert got.columns == [c[0] for c in want.description]
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want.fetchall()))
    texts = {r.doc_id: r.text for r in table(spark, str(tmp_path), "documents").where("doc_id > 1").collect()}
    for r in got.where("doc_id > 1").collect():
        spans = brute(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in spans).encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s[0] == k for s in spans) for k in pii.BASE]
