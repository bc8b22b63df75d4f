"""A whole report in one call: tree, tools, cache, analyses and the written file."""

from __future__ import annotations

import os
import re

from pyspark.sql import SparkSession

from ..operators import incremental, score, tools
from ..sinks import render
from ..sources.directories import folder_tree
from ..sources.files import read_tree
from . import report
from .settings import Settings


def report_path(root: str, settings: Settings) -> str:
    """Where a report goes: under its own name, or one made from the project's."""
    name = re.sub("-+", "-", re.sub("[^A-Za-z0-9._-]+", "-", os.path.basename(os.path.abspath(root)))).strip("-.").lower() or "project"
    return os.path.join(settings.output_dir, settings.output_name or f"{name}-report.{settings.kind}")


def make(spark: SparkSession, root: str, settings: Settings) -> str:
    """Analyse the files below ``root`` and write the report; returns its path.

    Findings of unchanged files come from the cache beside the report if the settings say so.
    """
    files = read_tree(spark, root)
    languages = score.detect_project(files.select("rel_path")).first()
    languages = list(languages.languages or [languages.primary_language])
    kinds = [k for k, on in (("test", settings.tests), ("quality", settings.quality), ("security", settings.security)) if on]
    results = tools.run_checks(spark, root, languages, kinds=kinds)
    missing = tools.doctor(spark, root, languages)
    found = missing.where("not is_missing").select("tool").distinct().count()
    kept = incremental.cache_path(settings.output_dir, root)
    cache = incremental.load_cache(spark, kept) if settings.use_cache else None
    made = report.build(files, os.path.basename(os.path.abspath(root)), results, tools.git_snapshot(root), found, settings.max_file_size, cache, tools.environment(spark, root).first().asDict(), folder_tree(spark, root, max_depth=settings.tree_depth, max_entries=settings.tree_entries), settings.sources)
    os.makedirs(settings.output_dir, exist_ok=True)
    path = report_path(root, settings)
    render.write(made, path, settings.kind)
    if settings.use_cache:
        incremental.save_cache(made.cache, kept)
    made.release()
    return path
