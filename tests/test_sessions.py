import hashlib
import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from lodestrata.operators import parts, transfer
from lodestrata.streaming import sessions

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def test_missing_stretches():
    rng = random.Random(1)
    for _ in range(200):
        gaps, highest, seen = [], 0, set()
        for i in rng.choices(range(1, 15), k=rng.randint(1, 14)):
            gaps, highest = sessions.closed(gaps, highest, i)
            seen.add(i)
            assert highest == max(seen) and [x for a, b in gaps for x in range(a, b + 1)] == [x for x in range(1, highest) if x not in seen]


def test_verdicts_of_sessions_as_chunks_arrive(spark, tmp_path):
    rng = random.Random(6)
    texts = [(f"s{i}", f"text {i}\n" * rng.randint(1, 25)) for i in range(24)]
    sent = transfer.envelopes(transfer.split_chunks(spark.createDataFrame(texts, "rel_path string, content string"), 5, 30), F.col("rel_path"), F.lit("now"))
    begin = datetime(2026, 1, 1)
    rows, ends = [], {}
    for r in sorted(sent.collect(), key=lambda r: (r.rel_path, r.chunk_index)):
        kind, m = int(r.rel_path[1:]) % 6, r.message
        if kind == 1 and r.chunk_index == 1:
            continue  # never whole
        if kind == 2:
            m = m.replace("text", "tent", 1)
        rows.append((r.rel_path, m, rng.randint(0, 299)))
        if kind in (3, 4):
            rows.append((r.rel_path, m, rng.randint(0, 299)))  # again
        if kind == 4 and r.chunk_index == r.total_chunks:
            other = r.body.replace("text", "tex!")
            fake = m.replace(r.body, other).replace(r.chunk_hash, "sha256:" + hashlib.sha256(other.encode()).hexdigest())
            rows.append((r.rel_path, fake, 0))  # sound, but another body at this place
    late = [(n, m) for n, m, _ in rows if int(n[1:]) % 6 == 0][:5]
    batches = [[r for r in rows if r[2] // 50 == b] for b in range(6)]
    for own in batches:
        rng.shuffle(own)
    # Time goes on: repeats of judged sessions, then one short session at a time, until all other state has expired.
    alive = transfer.envelopes(transfer.split_chunks(spark.createDataFrame([(f"alive{k}", "x") for k in range(4)], "rel_path string, content string")), F.col("rel_path"), F.lit("now")).collect()
    batches += [[(n, m, 320) for n, m in late], *[[(r.rel_path, r.message, 60 * minutes)] for r, minutes in zip(alive, (30, 60, 300, 600))], [("", "no chunk", 0)]]
    rows += [(r.rel_path, r.message, 0) for r in alive]
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    try:
        # A run that ends after some files, and another that goes on from its checkpoint.
        for some in (range(4), range(4, len(batches))):
            for k in some:
                spark.createDataFrame([(m, begin + timedelta(seconds=s)) for _, m, s in batches[k]], "message string, at timestamp").coalesce(1).write.parquet(f"{tmp_path}/in/{k:02}")
            stream = spark.readStream.schema("message string, at timestamp").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
            q = sessions.judge(stream).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).start()
            q.awaitTermination()
        state = [p for p in q.recentProgress if p["stateOperators"]][-1]["stateOperators"][0]["numRowsTotal"]
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    got = {}
    for r in spark.read.parquet(f"{tmp_path}/out").collect():
        assert r.session_id not in got
        got[r.session_id] = r
    distinct = spark.createDataFrame(list({(n, m) for n, m, _ in rows}), "t string, message string")
    want = {r.t: r for r in parts.verify(transfer.parse_chunks(distinct), "t").collect()}
    assert set(got) == set(want)
    for name, w in want.items():
        g, kind = got[name], int(name[1:]) % 6 if name[1:].isdigit() else 0
        assert (g.status, g.hash) == (w.status, w.hash) and g.expired == (g.reason == "missing chunks" or kind in (1, 2)), (name, g, w)
        assert kind in (1, 2, 4) or g.status == "VERIFIED"
        assert g.reason == w.reason or kind in (1, 4), (g, w)
    assert state <= 4  # the last session's mark and timer
