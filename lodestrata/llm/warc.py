"""WARC fixity audits with Merkle trees.

Every record of an archive is hashed; leaves are the records in the order in which they
stand, each with the byte range it takes, and a node hashes the ranges and hashes of up
to ``FAN_OUT`` nodes below it.  Each replica has a tree of its own order and offsets.
Two replicas are compared by root; only below roots that differ are children compared,
level by level, until the places that differ are found.  Only the records at those
places are then matched between the replicas, to tell what was changed, lost or moved.

Hashes are made where a record is read, so what is shuffled is a few numbers and 64 hex
digits a record.  Places are numbered by ranges and nodes grouped by their number, so an
archive of any size is worked on by many tasks.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, cut, numbered, table

FAN_OUT = 16
SPAN = 100  # ids of an archive
CRLF = "\r\n"


def record(url: Column, body: Column) -> Column:
    """A WARC response record; null bodies are empty, null urls have an empty target."""
    body = F.coalesce(body, F.lit(""))
    head = F.concat(
        F.lit(f"WARC/1.1{CRLF}WARC-Type: resource{CRLF}WARC-Target-URI: "), F.coalesce(url, F.lit("")),
        F.lit(f"{CRLF}Content-Type: text/html{CRLF}Content-Length: "), F.octet_length(body).cast("string"), F.lit(CRLF * 2),
    )
    return F.concat(head, body, F.lit(CRLF * 2))


def leaves(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", body_col: str = "html", span: int = SPAN, order: tuple[str, ...] = ("record_id", "hash")) -> DataFrame:
    """``(archive, slot, record_id, start, length, hash)`` of the archives that hold ``pages``.

    Ids of ``span`` neighbouring numbers share an archive; null ids share archive -1.
    Records stand in ``order`` (columns of ``pages`` may be named too), one after the
    other without a gap.  Repeated rows are records each; very long bodies only give
    their hash and length; other columns are ignored; an empty table gives no leaves.
    """
    made = record(F.col(url_col), F.col(body_col))
    more = [c for c in order if c not in ("record_id", "hash")]
    rows = pages.select(F.col(id_col).cast("long").alias("record_id"), made.alias("record"), *more).select(
        F.coalesce(F.floor(F.col("record_id") / span).cast("long"), F.lit(-1).cast("long")).alias("archive"), "record_id", F.octet_length("record").cast("long").alias("length"), F.sha2("record", 256).alias("hash"), *more,
    )
    placed = numbered(cut(rows), ["archive"], list(order), "length")
    return cut(placed.select("archive", F.col("nth").alias("slot"), "record_id", F.col("before").alias("start"), "length", "hash"))


HEADER = re.compile(rb"WARC/1\.[01]\r\n(?:[^\r\n]+\r\n)*?(?i:Content-Length): *(\d+)\r\n(?:[^\r\n]+\r\n)*\r\n")
MEMBER = b"\x1f\x8b\x08"


def records_in(view: memoryview):
    """``(start, end)`` of the records of an uncompressed archive, damaged stretches included."""
    at = 0
    while at < len(view):
        m = HEADER.match(view, at)
        if m and m.end() + int(m[1]) + 4 <= len(view):
            end = m.end() + int(m[1]) + 4
        else:
            after = HEADER.search(view, at + 1)
            end = after.start() if after else len(view)
        yield at, end
        at = end


def members_in(view: memoryview, step: int = 1 << 20):
    """``(start, end)`` of the members of a compressed archive, one a record by convention."""
    import zlib

    data, at = view.obj if isinstance(view.obj, bytes) else bytes(view), 0
    while at < len(data):
        unpack, read, end = zlib.decompressobj(31), at, None
        try:
            while read < len(data) and not unpack.eof:
                unpack.decompress(view[read : read + step])  # what is unpacked isn't kept
                read = min(read + step, len(data))
            end = read - len(unpack.unused_data) if unpack.eof else len(data)
        except zlib.error:
            after = data.find(MEMBER, at + 1)
            end = after if after > 0 else len(data)
        yield at, end
        at = end


def scan_archives(spark: SparkSession, path: str) -> DataFrame:
    """Leaves of WARC files, plain or compressed record by record, one archive a file: ``archive`` is its path.

    Bytes that are no record, at a file's damaged place, become one leaf up to the next
    record, so that every byte is under some leaf.  A file is read by one task and must
    be below 2 GB, as Spark's reader of binary files has it.
    """
    import hashlib

    import pyarrow as pa

    kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
    names = ["archive", "slot", "record_id", "start", "length", "hash"]

    def run(batches):
        for b in batches:
            for name, data in zip(b.column(0).to_pylist(), b.column(1)):
                view = memoryview(data.as_buffer())
                parts = members_in(view) if bytes(view[:3]) == MEMBER else records_in(view)
                rows = [(name, k, k, at, end - at, hashlib.sha256(view[at:end]).hexdigest()) for k, (at, end) in enumerate(parts)]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "archive string, slot long, record_id long, start long, length long, hash string")


def tree(leaf: DataFrame, levels: int, fan_out: int = FAN_OUT) -> list[DataFrame]:
    """``(archive, node, start, length, hash)`` of each level: the leaves first, one root an archive last."""
    own = ["archive", "node", "start", "length", "hash"]
    out = [leaf.withColumnRenamed("slot", "node").select(*own)]
    for _ in range(levels):
        child = F.concat_ws(":", "start", "length", "hash")
        level = out[-1].groupBy("archive", F.floor(F.col("node") / fan_out).cast("long").alias("node")).agg(
            F.min("start").alias("start"), F.sum("length").alias("length"),
            F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("node", child.alias("c")))), lambda x: x["c"]), ","), 256).alias("hash"),
        ).select(*own)
        out.append(cut(level))
    return out


def depth(*leaf: DataFrame, fan_out: int = FAN_OUT) -> int:
    """Levels above the leaves until the largest archive has one node."""
    most = max(x.agg(F.max("slot")).first()[0] or 0 for x in leaf)
    k = 1
    while most >= fan_out**k:
        k += 1
    return k


def _below(level: DataFrame, branch: DataFrame, fan_out: int, is_small: bool) -> DataFrame:
    """The nodes of ``level`` that are children of ``branch``; few branches go to all tasks and nothing else is shuffled."""
    parent = branch.select("archive", F.col("node").alias("parent"))
    return level.withColumn("parent", F.floor(F.col("node") / fan_out).cast("long")).join(F.broadcast(parent) if is_small else parent, ["archive", "parent"], "left_semi").drop("parent")


def differing(ours: list[DataFrame], theirs: list[DataFrame], fan_out: int = FAN_OUT) -> DataFrame:
    """``(archive, node, own, other)``: the leaf places at which two trees of equal height differ.

    Roots are compared first, and a level is compared only below nodes that differed one
    level up; where no root differs, no leaf is looked at.
    """
    mark = F.struct("start", "length", "hash")
    branch, n = None, 0
    for a, b in zip(reversed(ours), reversed(theirs)):
        if branch is not None:
            a, b = (_below(x, branch, fan_out, n * 32 < BROADCAST_BYTES) for x in (a, b))
        both = a.select("archive", "node", mark.alias("own")).join(b.select("archive", "node", mark.alias("other")), ["archive", "node"], "full")
        branch = cut(both.where(~F.col("own").eqNullSafe(F.col("other"))))
        n = branch.count()
        if not n:
            break
    return branch if n else branch.limit(0)


def matched(own: DataFrame, other: DataFrame) -> DataFrame:
    """``own`` and what only ``other`` has, with ``status``, for leaves at places that differ.

    First records of the same archive, id and hash meet (``moved``), in order of place;
    then those of the same id that are left (``changed``); the rest is ``missing`` or
    ``extra``.
    """
    columns = ["archive", "slot", "record_id", "start", "length", "hash"]

    def meet(a, b, keys):
        a, b = (numbered(x, keys, ["slot"], "length").withColumnRenamed("nth", "_nth").drop("before") for x in (a, b))
        b = b.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("_nth").alias("_m"), F.struct(*columns).alias("_other"))
        on = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys] + [F.col("_nth") == F.col("_m")]
        both = cut(a.join(b, on, "full").select(F.when(F.col("_nth").isNotNull(), F.struct(*columns)).alias("own"), "_other"))
        return both.where("own is not null and _other is not null").select("own.*"), both.where("_other is null").select("own.*"), both.where("own is null").select("_other.*")

    moved, own, other = meet(own, other, ["archive", "record_id", "hash"])
    changed, own, other = meet(own, other, ["archive", "record_id"])
    out = moved.withColumn("status", F.lit("moved"))
    for rows, status in ((changed, "changed"), (own, "missing"), (other, "extra")):
        out = out.unionByName(rows.withColumn("status", F.lit(status)))
    return out


def check_replica(ours: DataFrame, theirs: DataFrame, fan_out: int = FAN_OUT) -> DataFrame:
    """``ours``, and leaves only ``theirs`` has, with ``status``.

    ``intact``: the same bytes at the same place and offset; ``moved``: the same record
    at another place or offset; ``changed``: a record of that id with other bytes;
    ``missing``: no record of that id is left for it; ``extra``: only ``theirs`` has it.
    Null ids and repeated rows are records like any other; empty tables make empty trees.
    """
    ours, theirs = cut(ours), cut(theirs)
    levels = depth(ours, theirs, fan_out=fan_out)
    places = differing(tree(ours, levels, fan_out), tree(theirs, levels, fan_out), fan_out)
    n = places.count()
    if not n:
        return ours.withColumn("status", F.lit("intact"))
    keys = places.select("archive", F.col("node").alias("slot"))
    keys = F.broadcast(keys) if n * 32 < BROADCAST_BYTES else keys
    own, other = (cut(x.join(keys, ["archive", "slot"], "left_semi")) for x in (ours, theirs))
    intact = ours.join(keys, ["archive", "slot"], "left_anti").withColumn("status", F.lit("intact"))
    return intact.unionByName(matched(own, other).select(intact.columns))


def damaged(pages: DataFrame) -> DataFrame:
    """A replica with planted damage: a record lost, cut short or overwritten, by a hash of its id."""
    lot = F.left(F.sha2(F.col("page_id").cast("string"), 256), F.lit(2))
    html = F.when(lot == "1b", F.expr("left(html, length(html) div 2)")).when(lot == "2c", F.translate("html", "e", "3")).otherwise(F.col("html"))
    return pages.where(~F.coalesce(lot == "0a", F.lit(False))).withColumn("html", html)


def op9_warc_fixity(spark, sf_dir):
    """All pages as WARC archives against a replica with planted damage."""
    pages = table(spark, sf_dir, "pages")
    return check_replica(leaves(pages), leaves(damaged(pages)))


_RECORD = """'WARC/1.1' || nl || 'WARC-Type: resource' || nl || 'WARC-Target-URI: ' || coalesce(url, '') || nl || 'Content-Type: text/html' || nl
    || 'Content-Length: ' || octet_length(encode(coalesce({0}, ''))) || nl || nl || coalesce({0}, '') || nl || nl"""
_PLACED = """select page_id as record_id, page_id // {0} as archive, cast(octet_length(encode(rec)) as bigint) as length, sha256(rec) as hash,
    row_number() over w - 1 as slot, cast(sum(octet_length(encode(rec))) over w - octet_length(encode(rec)) as bigint) as start
    from {1} window w as (partition by page_id // {0} order by page_id rows between unbounded preceding and current row)"""

QUERIES = {"op9_warc_fixity": op9_warc_fixity}
ORACLE_SQL = {
    "op9_warc_fixity": f"""
with p as (select *, chr(13) || chr(10) as nl, left(sha256(cast(page_id as varchar)), 2) as lot from pages),
q as (select *, case lot when '1b' then left(html, length(html) // 2) when '2c' then replace(html, 'e', '3') else html end as copy from p),
r1 as (select page_id, {_RECORD.format("html")} as rec from q), r2 as (select page_id, {_RECORD.format("copy")} as rec from q where lot != '0a'),
a as ({_PLACED.format(SPAN, "r1")}), b as ({_PLACED.format(SPAN, "r2")})
select a.archive, a.slot, a.record_id, a.start, a.length, a.hash,
    case when b.record_id is null then 'missing' when a.hash != b.hash then 'changed' when a.slot != b.slot or a.start != b.start then 'moved' else 'intact' end as status
from a left join b on a.record_id = b.record_id""",
}
