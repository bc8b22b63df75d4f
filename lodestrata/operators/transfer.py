"""Transfers: a text split into blocks and chunks with checksums, verified and rebuilt.

Splitting is a projection: the fold that packs lines into chunks runs inside a row, so
all chunks of all texts are made where the text is read, without a shuffle.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from .. import rules
from ..functions import text as T

VERSION = 1
NAME = "CORPUS RC"


def _folded(lines: Column, block: Column, n: Column, chunk_bytes: int) -> Column:
    """Chunks ``(block, n, body)`` of one block's lines: greedy up to ``chunk_bytes``; a longer line is alone."""
    span = lambda a, b: F.array(F.struct(a.alias("a"), b.alias("b")))
    none = F.array().cast("array<struct<a:int,b:int>>")
    start = F.struct(F.lit(0).alias("i"), F.lit(0).alias("a"), F.lit(0).alias("size"), none.alias("done"))

    def step(s, line):
        n, i, is_open = F.octet_length(line), s["i"], s["i"] > s["a"]
        flushed = F.when(is_open, F.concat(s["done"], span(s["a"], i))).otherwise(s["done"])
        alone = F.struct((i + 1).alias("i"), (i + 1).alias("a"), F.lit(0).alias("size"), F.concat(flushed, span(i, i + 1)).alias("done"))
        fresh = F.struct((i + 1).alias("i"), i.alias("a"), n.alias("size"), flushed.alias("done"))
        more = F.struct((i + 1).alias("i"), s["a"].alias("a"), (s["size"] + n).alias("size"), s["done"].alias("done"))
        return F.when(n > chunk_bytes, alone).when(s["size"] + n > chunk_bytes, fresh).otherwise(more)

    done = F.aggregate(lines, start, step, lambda s: F.when(s["i"] > s["a"], F.concat(s["done"], span(s["a"], s["i"]))).otherwise(s["done"]))
    return F.transform(done, lambda x: F.struct(block.alias("block"), n.alias("n"), F.array_join(F.slice(lines, x["a"] + 1, x["b"] - x["a"]), "").alias("body")))


def split_chunks(texts: DataFrame, block_lines: int = rules.BLOCK_LINES, chunk_bytes: int = rules.CHUNK_BYTES) -> DataFrame:
    """Chunks of ``texts(rel_path, content)``.

    ``(rel_path, block, total_blocks, chunk_index, total_chunks, start_line, end_line,
    body, chunk_bytes, chunk_hash, report_hash)``; ``start_line`` and ``end_line`` are
    those of the block.  An empty text has no chunk.
    """
    def blocks(lines):
        n = F.size(lines)
        one = lambda b: T.let(F.slice(lines, b * block_lines + 1, F.lit(block_lines)), lambda own: _folded(own, b, n, chunk_bytes))
        return F.flatten(F.transform(F.sequence(F.lit(0), F.ceil(n / block_lines).cast("int") - 1), one))

    rows = texts.where(F.octet_length("content") > 0).select("rel_path", T.sha256_mark("content").alias("report_hash"), T.let(T.lines_keep_ends("content"), blocks).alias("chunks"))
    # Every text here has a chunk; of the plain posexplode Spark would infer a filter that folds each text once more.
    rows = rows.select("rel_path", "report_hash", F.size("chunks").alias("total_chunks"), F.posexplode_outer("chunks").alias("pos", "c"))
    return rows.select(
        "rel_path", F.col("c.block").alias("block"), F.ceil(F.col("c.n") / block_lines).cast("int").alias("total_blocks"), (F.col("pos") + 1).alias("chunk_index"), "total_chunks",
        (F.col("c.block") * block_lines + 1).alias("start_line"), F.least((F.col("c.block") + 1) * block_lines, F.col("c.n")).alias("end_line"), F.col("c.body").alias("body"), "report_hash",
    ).withColumns({"chunk_bytes": F.octet_length("body"), "chunk_hash": T.sha256_mark("body")})


def remaining_lines(n: Column, block: Column, block_lines: int = rules.BLOCK_LINES) -> Column:
    """Lines behind a block."""
    return F.greatest(F.lit(0), n - F.least((block + 1) * block_lines, n))


def _line(key: str, value) -> Column:
    return F.concat(F.lit(f"{key}="), value.cast("string"), F.lit("\n"))


def envelopes(chunks: DataFrame, session_id: Column, generated_at: Column, name: str = NAME, kind: str = "md") -> DataFrame:
    """``chunks`` with ``message``: header, body and footer, START on the first and END on the last."""
    c = F.col
    report = F.substring(F.regexp_replace("report_hash", "^sha256:", ""), 1, 16)
    edge = "=" * 20
    lines = lambda *kv: F.concat(*[_line(k, v) for k, v in kv])
    start = F.concat(
        F.lit(f"{edge} {name} START {edge}\n"),
        lines(("protocol_version", F.lit(VERSION)), ("session_id", session_id), ("report_id", report), ("source", c("rel_path")), ("source_fingerprint", c("report_hash")), ("generated_at", generated_at), ("format", F.lit(kind)), ("total_chunks", c("total_chunks")), ("report_hash", c("report_hash"))),
        F.lit("\nA chunk is not the report: wait for END and verify every hash before use.\n"), F.lit(f"{edge} {name} START-END {edge}\n\n"),
    )
    head = F.concat(
        F.lit(f"----- {name} CHUNK "), c("chunk_index").cast("string"), F.lit("/"), c("total_chunks").cast("string"), F.lit(" -----\n"),
        lines(("session_id", session_id), ("report_id", report), ("block", c("block")), ("total_blocks", c("total_blocks")), ("start_line", c("start_line")), ("end_line", c("end_line")), ("chunk_bytes", c("chunk_bytes")), ("chunk_hash", c("chunk_hash"))),
        F.lit(f"----- {name} CHUNK-BODY -----\n"),
    )
    end = F.concat(F.lit(f"\n{edge} {name} END {edge}\n"), lines(("session_id", session_id), ("report_id", report), ("total_chunks_sent", c("total_chunks")), ("report_hash", c("report_hash"))), F.lit(f"{edge} {name} END-END {edge}\n"))
    none = F.lit("")
    message = F.concat(
        F.when(c("chunk_index") == 1, start).otherwise(none), head, c("body"), F.lit(f"\n----- {name} CHUNK-END -----\n"), F.when(c("chunk_index") == c("total_chunks"), end).otherwise(none)
    )
    return chunks.select("*", head.alias("header"), message.alias("message"))


def parse_chunks(messages: DataFrame, name: str = NAME) -> DataFrame:
    """``messages`` with the fields of each ``message`` and the first ``error``, null if there is none.

    The body is cut by its declared bytes, so markers inside it are content.
    """
    h = r"sha256:[0-9a-f]{64}"
    edge = "=" * 20
    head = (
        rf"----- {name} CHUNK (\d+)/(\d+) -----\nsession_id=([^\n]+)\nreport_id=([^\n]+)\nblock=(\d+)\ntotal_blocks=(\d+)\nstart_line=(\d+)\nend_line=(\d+)\n"
        rf"chunk_bytes=(\d+)\nchunk_hash=({h})\n----- {name} CHUNK-BODY -----\n"
    )
    first = (
        rf"(?s)^{edge} {name} START {edge}\nprotocol_version=[^\n]+\nsession_id=([^\n]+)\nreport_id=([^\n]+)\nsource=[^\n]*\nsource_fingerprint=[^\n]+\ngenerated_at=[^\n]+\nformat=[^\n]+\n"
        rf"total_chunks=(\d+)\nreport_hash=({h})\n.*?{edge} {name} START-END {edge}\n+$"
    )
    last = rf"^\n*{edge} {name} END {edge}\nsession_id=([^\n]+)\nreport_id=([^\n]+)\ntotal_chunks_sent=(\d+)\nreport_hash=({h})\n{edge} {name} END-END {edge}\n$"
    footer = f"\n----- {name} CHUNK-END -----\n"
    c = F.col
    m = messages.withColumn("_at", F.instr("message", F.lit(f"----- {name} CHUNK ")))
    m = m.withColumn("_prefix", F.when(c("_at") > 0, F.substring(c("message"), F.lit(1), c("_at") - 1)).otherwise(""))
    m = m.withColumn("_rest", F.when(c("_at") > 0, F.substring(c("message"), c("_at"), F.length("message"))).otherwise(""))
    m = m.withColumn("_head", F.regexp_extract("_rest", "^" + head, 0))
    # A header has one field a line; its values are cut out of the lines, not matched once a field.
    m = m.withColumn("_lines", F.split("_head", "\n"))
    value = lambda k: F.coalesce(F.substring_index(F.get("_lines", F.lit(k)), "=", -1), F.lit(""))
    session = F.coalesce(F.regexp_replace(F.get("_lines", F.lit(1)), "^session_id=", ""), F.lit(""))
    report = F.coalesce(F.regexp_replace(F.get("_lines", F.lit(2)), "^report_id=", ""), F.lit(""))
    count = F.split(F.regexp_replace(F.get("_lines", F.lit(0)), "[^0-9/]", ""), "/")
    m = m.withColumns({"session_id": session, "report_id": report, "chunk_index": F.get(count, F.lit(0)).try_cast("int"), "total_chunks": F.get(count, F.lit(1)).try_cast("int"), "declared_bytes": value(7).try_cast("long"), "declared_hash": value(8)})
    m = m.withColumn("_bytes", F.substring(F.encode("_rest", "UTF-8"), F.octet_length("_head") + 1, F.octet_length("_rest")))
    m = m.withColumn("_raw", F.substring(c("_bytes"), F.lit(1), c("declared_bytes").cast("int")))
    behind = F.substring(c("_bytes"), c("declared_bytes").cast("int") + 1, F.octet_length("_bytes"))
    m = m.withColumn("_tail", F.make_valid_utf8(behind.cast("string")))
    m = m.withColumns({"body": c("_raw").cast("string"), "_suffix": F.substring(c("_tail"), F.lit(len(footer) + 1), F.length("_tail"))})
    m = m.withColumns({"has_start": F.length("_prefix") > 0, "has_end": F.length("_suffix") > 0})
    s, e = (lambda k: F.regexp_extract("_prefix", first, k)), (lambda k: F.regexp_extract("_suffix", last, k))
    m = m.withColumns({"start_hash": F.nullif(s(4), F.lit("")), "end_hash": F.nullif(e(4), F.lit(""))})
    checks = [
        (F.length("message") == 0, "empty chunk"),
        (c("_head") == "", "no valid chunk header"),
        (F.octet_length("_raw") != c("declared_bytes"), "chunk_bytes exceeds the data"),
        (~F.is_valid_utf8("body"), "chunk_bytes ends inside a character"),
        (~c("_tail").startswith(footer), "no footer behind the declared body"),
        (c("has_start") & c("start_hash").isNull(), "invalid START"),
        (c("has_end") & c("end_hash").isNull(), "invalid END"),
        (c("chunk_index") < 1, "chunk index below 1"),
        (c("total_chunks") < 1, "total_chunks below 1"),
        (c("chunk_index") > c("total_chunks"), "chunk index out of range"),
        (c("declared_hash") != T.sha256_mark("_raw"), "chunk_hash mismatch"),
        (c("has_start") & (c("chunk_index") != 1), "START not on chunk 1"),
        (c("has_start") & ((s(1) != c("session_id")) | (s(2) != c("report_id")) | (s(3).try_cast("int") != c("total_chunks"))), "START doesn't match its chunk"),
        (c("has_end") & (c("chunk_index") != c("total_chunks")), "END not on the last chunk"),
        (c("has_end") & ((e(1) != c("session_id")) | (e(2) != c("report_id")) | (e(3).try_cast("int") != c("total_chunks"))), "END doesn't match its chunk"),
        (c("has_end") & (c("total_chunks") == 1) & (c("end_hash") != T.sha256_mark("_raw")), "END hash doesn't match the only chunk"),
    ]
    error = F.coalesce(*[F.when(F.coalesce(test, F.lit(False)), F.lit(what)) for test, what in checks])
    fields = ["session_id", "report_id", "chunk_index", "total_chunks", "declared_bytes", "declared_hash", "body", "has_start", "has_end", "start_hash", "end_hash"]
    return m.select(*[x for x in messages.columns if x not in fields], *fields, error.alias("error"))


def verify(parsed: DataFrame, by: str, expected: Column | None = None) -> DataFrame:
    """One row a transfer ``by``: ``(status, reason, chunks, content)``, the first failing check named.

    A transfer's bodies meet in one row: together they are the one text that was sent.
    """
    c = F.col
    parts = F.array_sort(F.collect_list(F.struct("chunk_index", "body")))
    one = lambda k: F.min(k) == F.max(k)  # noqa: E731  distinct counts would expand every row, body included
    t = parsed.groupBy(by).agg(
        F.min("error").alias("error"), F.count("*").alias("chunks"), one("session_id").alias("sessions"), one("report_id").alias("reports"), one("total_chunks").alias("totals"),
        F.max("total_chunks").alias("total"), F.size(F.collect_set("chunk_index")).alias("different"), F.min("chunk_index").alias("lowest"), F.max("chunk_index").alias("highest"),
        F.count_if("has_start").alias("starts"), F.count_if("has_end").alias("ends"), F.max("start_hash").alias("start_hash"), F.max("end_hash").alias("end_hash"), parts.alias("parts"),
    )
    t = t.withColumn("content", F.array_join(F.transform("parts", lambda x: x["body"]), ""))
    checks = [
        (c("error").isNotNull(), c("error")),
        (~F.coalesce("sessions", F.lit(False)), F.lit("different sessions")),
        (~F.coalesce("reports", F.lit(False)), F.lit("different reports")),
        (~F.coalesce("totals", F.lit(False)), F.lit("different total_chunks")),
        (c("different") != c("chunks"), F.lit("duplicate chunk index")),
        (c("starts") != 1, F.lit("not exactly one START")),
        (c("ends") != 1, F.lit("not exactly one END")),
        (c("start_hash") != c("end_hash"), F.lit("START and END hashes differ")),
    ]
    if expected is not None:
        checks += [(~expected.rlike("^sha256:[0-9a-f]{64}$"), F.lit("invalid expected hash")), (expected != c("start_hash"), F.lit("not the expected report"))]
    checks += [
        ((c("chunks") < c("total")) | (c("lowest") > 1), F.lit("missing chunks")),
        (c("highest") > c("total"), F.lit("unexpected chunks")),
        (T.sha256_mark("content") != c("start_hash"), F.lit("content doesn't match report_hash")),
    ]
    reason = F.coalesce(*[F.when(F.coalesce(test, F.lit(False)), what) for test, what in checks])
    good = reason.isNull()
    return t.select(by, F.when(good, "VERIFIED").otherwise("INVALID").alias("status"), reason.alias("reason"), "chunks", F.when(good, c("content")).alias("content"))


def completeness(parts: DataFrame, by: str, index: str) -> DataFrame:
    """``(by, received, highest, missing)`` of parts numbered from 0, from aggregates alone."""
    return parts.groupBy(by).agg(F.count("*").alias("received"), F.max(index).alias("highest"), F.count_distinct(index).alias("different")).select(by, "received", "highest", (F.col("highest") + 1 - F.col("different")).alias("missing"))


def ordered_hash(parts: DataFrame, by: str, index: str, body: str) -> DataFrame:
    """SHA-256 of each transfer's bodies joined in order; null bodies add nothing.

    Bodies are sorted, not gathered: a running hash takes them one by one, so a transfer
    may be larger than memory.
    """
    rows = parts.select(F.col(by).alias("_by"), F.col(index).alias("_index"), F.col(body).alias("_body"))
    rows = rows.repartition("_by").sortWithinPartitions("_by", "_index", "_body").select(F.col("_by").alias(by), F.col("_body").cast("binary").alias("_body"))

    def run(batches):
        name, running = None, None
        for b in batches:
            names, hashes = [], []
            for i in range(b.num_rows):
                now, part = b.column(0)[i].as_py(), b.column(1)[i].as_py()
                if running is None or not (now == name or now != now and name != name):
                    if running is not None:
                        names.append(name)
                        hashes.append(running.hexdigest())
                    name, running = now, hashlib.sha256()
                running.update(part or b"")
            yield pa.RecordBatch.from_arrays([pa.array(names, b.column(0).type), pa.array(hashes, pa.string())], [by, "hash"])
            kind = b.column(0).type
        if running is not None:
            yield pa.RecordBatch.from_arrays([pa.array([name], kind), pa.array([running.hexdigest()])], [by, "hash"])

    return rows.mapInArrow(run, StructType([StructField(by, rows.schema[by].dataType), StructField("hash", StringType())]))


def missing_parts(parts: DataFrame, expected: DataFrame, keys: list[str]) -> DataFrame:
    """The expected keys that no part has."""
    return expected.join(parts.select(*keys).distinct(), keys, "left_anti")
