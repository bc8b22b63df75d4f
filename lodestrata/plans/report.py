"""All analyses of one corpus together, each a lazy table."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import rules
from ..operators import findings, incremental, records, score, stats
from ..operators import tree as drawn


@dataclass
class Report:
    """Tables of a report; only bounded ones are collected when it is rendered."""

    name: str
    records: DataFrame
    stats: DataFrame
    extensions: DataFrame
    directories: DataFrame
    largest: DataFrame
    duplicates: DataFrame
    essential: DataFrame
    excluded: DataFrame
    todos: DataFrame
    secrets: DataFrame
    issues: DataFrame
    detection: DataFrame
    reading: DataFrame
    health: DataFrame
    results: DataFrame
    known: DataFrame
    skipped: DataFrame
    cache: DataFrame
    tree: DataFrame
    sources: DataFrame | None = None
    git: dict = field(default_factory=dict)
    environment: dict = field(default_factory=dict)

    def release(self) -> None:
        """Give back what the tables share in memory."""
        self.records.unpersist()


RESULTS = "kind string, source string, returncode int, skipped boolean, skip_reason string, raw_output string, duration_seconds double"


def build(files: DataFrame, name: str = "project", results: DataFrame | None = None, git: dict | None = None, tools: int = 0, max_file_size: int = rules.MAX_FILE_SIZE, cache: DataFrame | None = None, environment: dict | None = None, tree: DataFrame | None = None, sources: bool = True) -> Report:
    """A report on ``files(rel_path, content, ...)``.

    ``results`` holds runs of external tools, if any.  ``cache`` is that of an earlier
    report: of files it has with the same hash, line findings are taken from it, and only
    the others are scanned; ``Report.cache`` is the cache for the next one.  Line scans
    leave out files whose name or content is flagged from what may be shown.  ``tree`` has
    the ``key`` and ``line`` of the drawn tree's lines (``sources.directories.folder_tree``);
    without it the tree is that of the files' paths.  With ``sources`` a page embeds files.
    """
    spark = files.sparkSession
    results = results if results is not None else spark.createDataFrame([], RESULTS)
    own = records.records(files).persist()
    split = findings.essential_split(own, max_file_size)
    text = files.join(own.where("not is_binary and not is_symlink").select("rel_path"), "rel_path", "left_semi").withColumn("content", F.make_valid_utf8(F.col("content").cast("string")))
    known = cache if cache is not None else spark.createDataFrame([], incremental.CACHE)
    hit = incremental.hits(own, known).select("rel_path")
    fresh = text.join(hit, "rel_path", "left_anti") if cache is not None else text
    all_todos, all_secrets = findings.scan_todos(fresh), findings.scan_secrets(fresh)
    if cache is not None:
        all_todos = incremental.combined(all_todos, incremental.cached_findings(hit, known, "todos"))
        all_secrets = incremental.combined(all_secrets, incremental.cached_findings(hit, known, "secrets"))
    secrets = all_secrets.join(split.where("bucket = 'included'").select("rel_path"), "rel_path", "left_semi")
    named = split.where("bucket = 'excluded'").select("rel_path")
    todos = findings.exclude_flagged(all_todos.join(named, "rel_path", "left_anti"), secrets)
    safe = findings.exclude_flagged(split.where("bucket = 'included'"), secrets)
    excluded = findings.exclusion_reasons(named.union(secrets.select("rel_path")).distinct(), secrets)
    summary = stats.project_stats(own)
    return Report(
        name, own, summary, stats.by_extension(own), stats.directory_sizes(own), stats.largest_files(own), stats.duplicate_groups(own), safe, excluded, todos, secrets,
        findings.scan_issues(results), score.detect_project(files.withColumn("content", F.make_valid_utf8(F.col("content").cast("string")))), score.reading_order(safe),
        score.health(results, git or {}, todos, secrets, summary, tools), results, findings.known_issues(results), split.where("bucket = 'skipped'").select("rel_path", "size"),
        incremental.build_cache(own, all_todos, all_secrets), tree if tree is not None else drawn.lines(drawn.entries(own)), files if sources else None, git or {}, environment or {},
    )
