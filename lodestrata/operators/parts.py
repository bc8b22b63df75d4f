"""Transfers of texts larger than a row: numbered, folded and verified from parts.

A text comes as rows ``(rel_path, part, content)``, cut anywhere behind a line's end, or
inside a line where ``continues`` says that a row goes on with the last one's.  Line and
chunk numbers are sums over what lies ahead, taken in two levels so that no window
holds a whole text; each block of lines is folded by itself; bodies are never gathered,
but sorted within tasks and taken one by one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import rules
from ..functions import text as T
from ..sources.corpus import checkpointed

FOLDED = "rel_path string, block long, k int, body string, lines int"


def sums_ahead(rows: DataFrame, group: list[str], at: str, n: str, out: str, width: int = 10_000) -> DataFrame:
    """``rows`` with ``out``: the sum of ``n`` over rows of the same ``group`` with a smaller ``at``.

    ``at`` is a whole number from 0, different for each row of a group.  Windows run over
    stretches of ``width`` places, and over the stretches' totals.
    """
    before = lambda w: F.coalesce(F.sum(n).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cut = rows.withColumn("_stretch", F.expr(f"`{at}` div {width}"))
    totals = cut.groupBy(*group, "_stretch").agg(F.sum(n).alias(n))
    totals = totals.select(*group, "_stretch", before(Window.partitionBy(*group).orderBy("_stretch")).alias("_base"))
    within = cut.withColumn(out, before(Window.partitionBy(*group, "_stretch").orderBy(at)))
    return within.join(totals, [*group, "_stretch"]).withColumn(out, (F.col(out) + F.col("_base")).cast("long")).drop("_stretch", "_base")


def lines(parts: DataFrame) -> DataFrame:
    """``(rel_path, line, part, text)``: every line, or piece of one, with its number from 0 in the whole text."""
    goes_on = F.col("continues") if "continues" in parts.columns else F.lit(False)
    content = F.make_valid_utf8(F.col("content").cast("string"))
    own = parts.where(F.octet_length("content") > 0).select("rel_path", F.col("part").cast("long").alias("part"), F.coalesce(goes_on, F.lit(False)).cast("int").alias("_on"), content.alias("_text"))
    counted = sums_ahead(own.select("rel_path", "part", (F.size(T.lines_keep_ends("_text")) - F.col("_on")).alias("_n")), ["rel_path"], "part", "_n", "_ahead").select("rel_path", "part", "_ahead")
    each = own.join(counted, ["rel_path", "part"]).select("rel_path", "part", "_ahead", "_on", F.posexplode_outer(T.lines_keep_ends("_text")).alias("_pos", "text"))
    return each.select("rel_path", (F.col("_ahead") + F.col("_pos") - F.col("_on")).alias("line"), "part", "text")


def _fold(batches: Iterator[pa.RecordBatch], chunk_bytes: int) -> Iterator[pa.RecordBatch]:
    """Chunks of sorted ``(rel_path, block, line, text)``: greedy up to ``chunk_bytes``; a longer line is alone."""
    made: list[tuple] = []
    key, number, line, body, size, n, k = None, None, [], [], 0, 0, 0

    def close():
        nonlocal body, size, n, k
        if n:
            made.append((*key, k, "".join(body), n))
            body, size, n, k = [], 0, 0, k + 1

    def whole_line():
        nonlocal line, body, size, n
        if not line:
            return
        text = "".join(line)
        m = len(text.encode())
        if m > chunk_bytes or size + m > chunk_bytes:
            close()
        body.append(text)
        size, n, line = size + m, n + 1, []
        if m > chunk_bytes:
            close()

    def batch():
        columns = [pa.array(c, t) for c, t in zip(zip(*made), (pa.string(), pa.int64(), pa.int32(), pa.string(), pa.int32()))]
        made.clear()
        return pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in FOLDED.split(", ")])

    for b in batches:
        for path, block, at, text in zip(*[c.to_pylist() for c in b.columns]):
            if (path, block) != key or at != number:
                whole_line()
            if (path, block) != key:
                if key is not None:
                    close()
                key, k = (path, block), 0
            number = at
            line.append(text)
        if made:
            yield batch()
    whole_line()
    if key is not None:
        close()
    if made:
        yield batch()


def split_parts(parts: DataFrame, hashes: DataFrame, block_lines: int = rules.BLOCK_LINES, chunk_bytes: int = rules.CHUNK_BYTES, bodies: bool = True) -> DataFrame:
    """The rows of ``transfer.split_chunks``, of texts in parts; ``hashes(rel_path, hash)`` are those of whole texts.

    A text of no bytes has no chunk.  A chunk is a row, so a line is one too.  Folded chunks
    are read four times, for numbers, totals and rows, so they are checkpointed: the shared
    folder holds the texts once, or, without ``bodies``, their chunks' sizes and hashes alone.
    """
    dealt = lines(parts).select("rel_path", F.expr(f"line div {block_lines}").alias("block"), "line", "part", "text")
    dealt = dealt.repartition("rel_path", "block").sortWithinPartitions("rel_path", "block", "line", "part").drop("part")
    chunks = dealt.mapInArrow(lambda b: _fold(b, chunk_bytes), FOLDED).withColumns({"chunk_bytes": F.octet_length("body"), "_digest": F.unhex(F.sha2("body", 256))})
    chunks = checkpointed(chunks if bodies else chunks.drop("body"))
    blocks = chunks.groupBy("rel_path", "block").agg(F.count("*").alias("_n"), F.sum("lines").alias("_lines"))
    numbered = sums_ahead(blocks, ["rel_path"], "block", "_n", "_ahead")
    totals = blocks.groupBy("rel_path").agg(F.sum("_n").alias("_chunks"), F.sum("_lines").alias("_all"))
    known = numbered.select("rel_path", "block", "_ahead").join(totals, "rel_path").join(hashes.select("rel_path", F.col("hash").alias("_hash")), "rel_path")
    named = chunks.join(known, ["rel_path", "block"])
    i = lambda c: c.cast("int")
    return named.select(
        "rel_path", i(F.col("block")).alias("block"), i(F.ceil(F.col("_all") / block_lines)).alias("total_blocks"), i(F.col("_ahead") + F.col("k") + 1).alias("chunk_index"), i(F.col("_chunks")).alias("total_chunks"),
        i(F.col("block") * block_lines + 1).alias("start_line"), i(F.least((F.col("block") + 1) * block_lines, F.col("_all"))).alias("end_line"), *["body"] * bodies, F.concat(F.lit("sha256:"), "_hash").alias("report_hash"),
        "chunk_bytes", F.concat(F.lit("sha256:"), F.lower(F.hex("_digest"))).alias("chunk_hash"),
    )


FACTS = "chunks long, error string, session_id string, report_id string, total int, sessions boolean, reports boolean, totals boolean, repeated boolean, lowest int, highest int, starts long, ends long, start_hash string, end_hash string, hash string"


def _facts(batches: Iterator[pa.RecordBatch], by: str, kind: pa.DataType) -> Iterator[pa.RecordBatch]:
    """One row for each transfer of sorted chunks, with a running digest of their bodies."""
    names = [by, *[x.split()[0] for x in FACTS.split(", ")]]
    types = [kind, pa.int64(), *[pa.string()] * 3, pa.int32(), *[pa.bool_()] * 4, pa.int32(), pa.int32(), pa.int64(), pa.int64(), *[pa.string()] * 3]
    state, running, last, made = None, None, None, []

    def close():
        if state is not None:
            made.append((*state.values(), running.hexdigest()))

    def batch():
        out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*made), types)], names)
        made.clear()
        return out

    least = lambda a, b: b if a is None else a if b is None else min(a, b)
    most = lambda a, b: b if a is None else a if b is None else max(a, b)
    for b in batches:
        for name, index, body, error, session, report, total, start, end, start_hash, end_hash in zip(*[c.to_pylist() for c in b.columns]):
            if state is None or name != state["by"]:
                close()
                running, last = hashlib.sha256(), None
                state = dict(by=name, chunks=0, error=None, session=session, report=report, total=total, sessions=True, reports=True, totals=True, repeated=False, lowest=None, highest=None, starts=0, ends=0, start_hash=None, end_hash=None)
            s = state
            s["chunks"] += 1
            s["error"] = least(s["error"], error)
            s["sessions"] &= session == s["session"] and session is not None
            s["reports"] &= report == s["report"] and report is not None
            s["totals"] &= total == s["total"] and total is not None
            s["total"] = most(s["total"], total)
            s["repeated"] |= index is None or (s["chunks"] > 1 and index == last)
            s["lowest"], s["highest"] = least(s["lowest"], index), most(s["highest"], index)
            s["starts"] += bool(start)
            s["ends"] += bool(end)
            s["start_hash"], s["end_hash"] = most(s["start_hash"], start_hash), most(s["end_hash"], end_hash)
            last = index
            running.update((body or "").encode())
        if made:
            yield batch()
    close()
    if made:
        yield batch()


def reason_of(expected=None):
    """The first failing check of a transfer's facts, null if there is none, in the order of ``transfer.verify``."""
    c = F.col
    checks = [
        (c("error").isNotNull(), c("error")), (~c("sessions"), F.lit("different sessions")), (~c("reports"), F.lit("different reports")), (~c("totals"), F.lit("different total_chunks")),
        (c("repeated"), F.lit("duplicate chunk index")), (c("starts") != 1, F.lit("not exactly one START")), (c("ends") != 1, F.lit("not exactly one END")), (c("start_hash") != c("end_hash"), F.lit("START and END hashes differ")),
    ]
    if expected is not None:
        checks += [(~expected.rlike("^sha256:[0-9a-f]{64}$"), F.lit("invalid expected hash")), (expected != c("start_hash"), F.lit("not the expected report"))]
    checks += [
        ((c("chunks") < c("total")) | (c("lowest") > 1), F.lit("missing chunks")), (c("highest") > c("total"), F.lit("unexpected chunks")),
        (F.concat(F.lit("sha256:"), c("hash")) != c("start_hash"), F.lit("content doesn't match report_hash")),
    ]
    return F.coalesce(*[F.when(F.coalesce(test, F.lit(False)), what) for test, what in checks])


def verify(parsed: DataFrame, by: str, expected=None) -> DataFrame:
    """``(by, status, reason, chunks, hash)``: the verdict of ``transfer.verify`` on transfers of any size.

    Chunks are dealt by transfer and sorted by index; one pass keeps a digest and a few
    facts of each, so bodies never meet.  ``hash`` is that of a verified text.
    """
    kind = parsed.schema[by].dataType
    fields = ["chunk_index", "body", "error", "session_id", "report_id", "total_chunks", "has_start", "has_end", "start_hash", "end_hash"]
    rows = parsed.select(F.col(by).alias("_by"), *fields).repartition("_by").sortWithinPartitions("_by", "chunk_index", "body")
    arrow = rows.limit(0).toArrow().schema.field("_by").type
    facts = rows.mapInArrow(lambda b: _facts(b, by, arrow), f"`{by}` {kind.simpleString()}, {FACTS}").withColumn("reason", reason_of(expected))
    good = F.col("reason").isNull()
    return facts.select(by, F.when(good, "VERIFIED").otherwise("INVALID").alias("status"), "reason", "chunks", F.when(good, F.col("hash")).alias("hash"))


def rebuild(parsed: DataFrame, verdicts: DataFrame, by: str) -> DataFrame:
    """``(by, chunk_index, body)`` of verified transfers: in order of index the bodies are the text."""
    return parsed.select(by, "chunk_index", "body").join(verdicts.where("status = 'VERIFIED'").select(by), by, "left_semi")
