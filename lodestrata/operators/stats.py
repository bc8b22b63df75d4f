"""Corpus statistics over file records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import rules
from ..functions import text as T


def project_stats(records: DataFrame) -> DataFrame:
    """Counters in one row; links count among files and hidden files only."""
    real = ~F.col("is_symlink")
    lines = lambda c: F.coalesce(F.sum(F.when(real & ~F.col("is_binary"), F.col(c))), F.lit(0)).alias(c)
    return records.agg(
        F.count("*").alias("total_files"), F.count_if("is_hidden").alias("hidden_files"), F.count_if(real & F.col("is_binary")).alias("binary_files"),
        F.count_if("is_broken_symlink").alias("broken_symlinks"), F.count_if(real & (F.col("size") == 0)).alias("empty_files"),
        F.count_if(real & F.col("is_executable")).alias("executable_files"), F.count_if(real & T.is_temporary("rel_path")).alias("temporary_files"),
        F.count_if(real & T.in_directory("rel_path", rules.CACHE_DIRS)).alias("cache_files"),
        *map(lines, ("total_lines", "code_lines", "comment_lines", "blank_lines")),
    )


def by_extension(records: DataFrame) -> DataFrame:
    return records.where("not is_symlink and extension != ''").groupBy("extension").agg(F.count("*").alias("files")).orderBy(F.desc("files"), "extension")


def directory_sizes(records: DataFrame, most: int = 15) -> DataFrame:
    """Bytes of the files right inside a directory, the largest directories."""
    sizes = records.where("not is_symlink").groupBy(T.parent("rel_path").alias("directory")).agg(F.sum("size").alias("size"))
    return sizes.orderBy(F.desc("size"), "directory").limit(most)


def largest_files(records: DataFrame, most: int = 20) -> DataFrame:
    return records.where("not is_symlink").select("rel_path", "size").orderBy(F.desc("size"), "rel_path").limit(most)


def duplicate_groups(records: DataFrame) -> DataFrame:
    """``(digest, files, first_path, wasted)`` of contents that several files have."""
    groups = records.where("not is_symlink and content_hash is not null").groupBy("content_hash").agg(F.count("*").alias("files"), F.min("rel_path").alias("first_path"), F.min("size").alias("one"))
    return groups.where("files > 1").select(F.substring("content_hash", 1, 12).alias("digest"), "files", "first_path", ((F.col("files") - 1) * F.col("one")).alias("wasted"))


def duplicate_files(records: DataFrame) -> DataFrame:
    """``(digest, rel_path)`` of every file in such a group, never gathered into one row."""
    own = records.where("not is_symlink and content_hash is not null").select("content_hash", "rel_path")
    many = own.groupBy("content_hash").count().where("count > 1").select("content_hash")
    return own.join(many, "content_hash", "left_semi").select(F.substring("content_hash", 1, 12).alias("digest"), "rel_path")


def _path_tests() -> dict[str, Column]:
    real = ~F.col("is_symlink")
    return {
        "temporary": real & T.is_temporary("rel_path"), "cache": real & T.in_directory("rel_path", rules.CACHE_DIRS), "empty": real & (F.col("size") == 0),
        "executable": real & F.col("is_executable"), "hidden": F.col("is_hidden"), "broken": F.col("is_broken_symlink"),
    }


def files_that(records: DataFrame, kind: str) -> DataFrame:
    """Paths of ``temporary``, ``cache``, ``empty``, ``executable``, ``hidden`` or ``broken`` files."""
    return records.where(_path_tests()[kind]).select("rel_path")


def path_lists(records: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    """``(kind, rel_path)`` for each of ``kinds`` that a file is of, from one scan."""
    tests = _path_tests()
    held = F.array_compact(F.array(*[F.when(tests[k], F.lit(k)) for k in kinds]))
    return records.select(F.explode(held).alias("kind"), "rel_path")
