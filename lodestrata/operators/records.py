"""File records: one typed row a file, from its path and content."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import rules
from ..functions import text as T

SCHEMA = (
    "rel_path string, size long, is_symlink boolean, is_broken_symlink boolean, is_hidden boolean, is_binary boolean, is_executable boolean, extension string, "
    "total_lines long, code_lines long, comment_lines long, blank_lines long, content_hash string"
)
FIELDS = [x.split()[0] for x in SCHEMA.split(", ")]


def records(files: DataFrame, hash_max_bytes: int = rules.HASH_MAX_BYTES, keep: tuple[str, ...] = ()) -> DataFrame:
    """Records of ``files(rel_path, content)``, a projection without a shuffle.

    ``content`` is text or bytes; flags of links and modes are taken from the listing
    where it has them.  A null content is an unreadable file: binary, no lines.  Rows of
    a file that the listing has split are added up; only those are shuffled, and their
    hash is the digest that the listing has made.  Columns named in ``keep`` go along.
    """
    if "is_split" in files.columns:
        whole = _records(files.where("not is_split"), hash_max_bytes, keep)
        parts = _records(files.where("is_split"), -1, (*keep, "part", "digest", "continues"))
        sums = {"total_lines", "code_lines", "comment_lines", "blank_lines"}
        front = F.min_by(F.struct(*[c for c in (*keep, *FIELDS) if c not in sums and c not in ("rel_path", "content_hash")]), "part").alias("_front")
        added = parts.groupBy("rel_path").agg(front, F.max("digest").alias("digest"), *[F.sum(c).alias(c) for c in sorted(sums)])
        hashed = F.when(~F.col("_front.is_binary") & F.col("_front.size").between(1, hash_max_bytes), F.col("digest")).alias("content_hash")
        return whole.unionByName(added.select("rel_path", "_front.*", hashed, *sorted(sums)))
    return _records(files, hash_max_bytes, keep)


def _records(files: DataFrame, hash_max_bytes: int, keep: tuple[str, ...]) -> DataFrame:
    """One record a row.  A part that isn't a file's first is text: the first tells whether a file is binary."""
    flag = lambda c: F.col(c) if c in files.columns else F.lit(False)
    raw = F.col("content").cast("binary")
    sniffed = F.contains(F.substring(raw, 1, rules.SNIFF_BYTES), F.lit(b"\x00"))
    binary = F.col("content").isNull() | ((F.col("part") == 0) & sniffed if "part" in keep else sniffed)
    link = flag("is_symlink")
    counted = ~link & ~F.col("is_binary")
    content = F.make_valid_utf8(F.col("content").cast("string")) if dict(files.dtypes)["content"] == "binary" else F.col("content")
    lines = F.when(counted & (F.octet_length("content") > 0), T.lines_lf(content)).otherwise(F.array().cast("array<string>"))
    if "part" in keep:  # the rest of a line that an earlier part has counted
        lines = F.when(flag("continues"), F.slice(lines, F.lit(2), F.greatest(F.lit(0), F.size(lines) - 1))).otherwise(lines)
    of = lambda test: F.size(F.filter("_lines", test)).cast("long")
    made = files.select(
        *keep, "rel_path", "content", F.when(link, F.lit(0)).otherwise(F.col("size") if "size" in files.columns else F.coalesce(F.octet_length("content"), F.lit(0))).cast("long").alias("size"),
        link.alias("is_symlink"), flag("is_broken_symlink").alias("is_broken_symlink"), T.is_hidden("rel_path").alias("is_hidden"),
        (~link & binary).alias("is_binary"), flag("is_executable").alias("is_executable"), F.when(link, F.lit("")).otherwise(T.extension("rel_path")).alias("extension"),
    ).withColumn("_lines", lines)
    made = made.withColumns({"total_lines": F.size("_lines").cast("long"), "comment_lines": of(T.is_comment), "blank_lines": of(T.is_blank)})
    hashed = ~F.col("is_symlink") & ~F.col("is_binary") & F.col("size").between(1, hash_max_bytes)
    return made.withColumns({"code_lines": F.col("total_lines") - F.col("comment_lines") - F.col("blank_lines"), "content_hash": F.when(hashed, F.sha2(raw, 256))}).select(*keep, *FIELDS)


def cap_hashes(found: DataFrame, most: int = rules.MAX_HASH_FILES) -> DataFrame:
    """Only the first ``most`` hashable files in order of path keep their hash.

    The bound makes the kept paths small enough for a broadcast.
    """
    first = found.where("content_hash is not null").select("rel_path").orderBy("rel_path").limit(most).withColumn("_first", F.lit(True))
    return found.join(F.broadcast(first), "rel_path", "left").withColumn("content_hash", F.when(F.col("_first"), F.col("content_hash"))).select(found.columns)
