import hashlib
import random

from lodestrata.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string, part string"


def corpus():
    rng = random.Random(2)
    bits = ["\\", "<turn:", "</turn>", "<turn:user>\n", "\n</turn>\n", "é", "日", " word ", "\n", "😀", "<", ">", "%3E"]
    rows = []
    for c in [*range(40), None]:
        for t in range(rng.randint(1, 6)):
            text = rng.choice([None, "", "".join(rng.choices(bits, k=rng.randint(1, 9)))])
            rows.append((c, t, rng.choice(["user", "assistant", "a>b\n%", None, ""]), text, "x"))
    rows += [(1, 0, "user", "again", "x")] * 2 + [(99, None, "assistant", "long " * 50_000, "x")]
    rng.shuffle(rows)
    return rows


def want(rows):
    out = {}
    key = lambda r: tuple((x is not None, x if x is not None else "") for x in r[1:4])
    for c in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == c), key=key)
        turns = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in own)
        loss = "".join(r[3] or "" for r in own if r[2] == "assistant")
        out[c] = (len(own), hashlib.sha256(turns.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


def test_round_trip_with_escapes_nulls_and_repeats(spark):
    rows = corpus()
    turns = spark.createDataFrame(rows, SCHEMA)
    for part_bytes in (chat.PART_BYTES, 60):  # the second cuts conversations into parts
        made = chat.format_chats(turns, part_bytes=part_bytes)
        got = chat.digests(made).collect()
        assert {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in got} == want(rows)
        assert len(got) == len(want(rows)) and (made.where("part > 0").count() > 0) == (part_bytes == 60)


def test_small_batches_carry_conversations_over(spark):
    rows = corpus()
    was = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        got = chat.digests(chat.format_chats(spark.createDataFrame(rows, SCHEMA))).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", was)
    assert {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in got} == want(rows)


def test_empty_table(spark):
    assert chat.digests(chat.format_chats(spark.createDataFrame([], SCHEMA))).count() == 0
