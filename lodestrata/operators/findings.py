"""Line findings: work markers, credential-shaped content, tool issues, and what they exclude."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import rules
from ..functions import text as T

TODO = rf"(?iU)\b({'|'.join(rules.TODO_WORDS)})\b"


def numbered_lines(files: DataFrame, pattern: str, may: Callable[[Column], Column]) -> DataFrame:
    """``(rel_path, line_number, line)`` of the lines that match.

    ``may`` is a cheap test that every match passes; only files and lines that pass it
    are split and matched, so most text is looked at once.  A row may hold a part of a
    file: ``first_line`` then says how many lines are ahead of it.
    """
    ahead = F.col("first_line") if "first_line" in files.columns else F.lit(0)
    lines = files.where(may(F.col("content"))).select("rel_path", ahead.alias("ahead"), F.posexplode(T.lines_universal("content")).alias("pos", "line"))
    return lines.where(may(F.col("line"))).where(F.col("line").rlike(pattern)).select("rel_path", (F.col("ahead") + F.col("pos") + 1).cast("long").alias("line_number"), "line")


def _may_be_todo(c: Column) -> Column:
    return T.contains_any(F.lower(c), [w.lower() for w in rules.TODO_WORDS])


def _may_be_secret(c: Column) -> Column:
    return T.contains_any(c, rules.SECRET_PARTS) | c.rlike(rules.ASSIGNMENT)


def scan_todos(files: DataFrame, most: int | None = None) -> DataFrame:
    """``(rel_path, line_number, kind, content)``: the first marker of each line.

    ``most`` keeps the first by path and line, as a report does; a cache keeps all.
    """
    found = numbered_lines(files, TODO, _may_be_todo).select("rel_path", "line_number", F.upper(F.regexp_extract("line", TODO, 1)).alias("kind"), T.truncated("line").alias("content"))
    return found if most is None else found.orderBy("rel_path", "line_number").limit(most)


def scan_secrets(files: DataFrame) -> DataFrame:
    """``(rel_path, line_number, pattern_name, is_test_fixture)``, one row a rule and line, never the value."""
    every = "|".join(f"(?:{p})" for _, p in rules.SECRET_RULES)
    lines = numbered_lines(files, every, _may_be_secret)
    named = F.filter(F.array(*[F.when(F.col("line").rlike(p), F.lit(n)) for n, p in rules.SECRET_RULES]), lambda x: x.isNotNull())
    return lines.select("rel_path", "line_number", F.explode(named).alias("pattern_name"), F.col("rel_path").rlike(rules.FIXTURE).alias("is_test_fixture"))


def scan_issues(outputs: DataFrame) -> DataFrame:
    """``(source, severity, message)`` from ``outputs(source, raw_output)``; a line may be both."""
    lines = outputs.select("source", F.explode(F.split("raw_output", "\n", -1)).alias("line"))
    low = F.lower("line")
    kinds = F.filter(F.array(*[F.when(T.contains_any(low, words), F.lit(k)) for k, words in (("warning", rules.WARNINGS), ("error", rules.ERRORS))]), lambda x: x.isNotNull())
    return lines.select("source", F.explode(kinds).alias("severity"), F.regexp_replace("line", r"(?U)^\s+|\s+$", "").alias("message"))


def known_issues(outputs: DataFrame) -> DataFrame:
    """``(pattern, explanation, found)``: one row a rule, from one pass over all outputs."""
    low = F.lower("raw_output")
    hit = [F.coalesce(F.bool_or(low.rlike(rf"(?U)\b{_literal(p.lower())}")), F.lit(False)) for p, _ in rules.KNOWN_ISSUES]
    row = outputs.agg(F.array(*[F.struct(F.lit(p).alias("pattern"), F.lit(e).alias("explanation"), h.alias("found")) for (p, e), h in zip(rules.KNOWN_ISSUES, hit)]).alias("all"))
    return row.select(F.inline("all"))


def _literal(text: str) -> str:
    return "".join(c if c.isalnum() or c == " " else f"\\{c}" for c in text)


def essential_split(records: DataFrame, max_file_size: int = rules.MAX_FILE_SIZE) -> DataFrame:
    """Essential files with ``bucket``: ``excluded`` by name, ``skipped`` for size, or ``included``."""
    bucket = F.when(T.secret_name("rel_path"), "excluded").when(F.col("size") > max_file_size, "skipped").otherwise("included")
    return records.where(~F.col("is_symlink") & F.col("extension").isin(*rules.ESSENTIAL_EXTENSIONS)).select("rel_path", "size", bucket.alias("bucket"))


def exclude_flagged(included: DataFrame, secrets: DataFrame) -> DataFrame:
    """Files to embed: those without a finding."""
    return included.join(secrets.select("rel_path").distinct(), "rel_path", "left_anti")


def flagged(included: DataFrame, secrets: DataFrame) -> DataFrame:
    """Files that a finding keeps from being embedded."""
    return included.join(secrets.select("rel_path").distinct(), "rel_path", "left_semi")


def exclusion_reasons(excluded: DataFrame, secrets: DataFrame) -> DataFrame:
    """``(rel_path, reason)``: ``content`` where a finding names the file, else ``name``."""
    found = secrets.select("rel_path").distinct().withColumn("_hit", F.lit(True))
    return excluded.join(found, "rel_path", "left").select("rel_path", F.when(F.col("_hit"), "content").otherwise("name").alias("reason"))


def sarif_results(todos: DataFrame, secrets: DataFrame, issues: DataFrame) -> DataFrame:
    """``(rule_id, level, message, path, line)`` of all findings in one table."""
    none = F.lit(None)
    parts = [
        secrets.select(T.rule_id("secret", "pattern_name").alias("rule_id"), F.lit("error").alias("level"), F.concat(F.lit("Possible "), "pattern_name").alias("message"), F.col("rel_path").alias("path"), F.col("line_number").alias("line")),
        todos.select(T.rule_id("todo", "kind").alias("rule_id"), F.lit("note").alias("level"), F.col("content").alias("message"), F.col("rel_path").alias("path"), F.col("line_number").alias("line")),
        issues.select(T.rule_id("tool", "source").alias("rule_id"), F.col("severity").alias("level"), "message", none.cast("string").alias("path"), none.cast("long").alias("line")),
    ]
    return reduce(DataFrame.unionByName, parts)


def sarif_order() -> list[Column]:
    """Sort keys of a log: findings of content, markers, then tool issues, each by place and text."""
    kind = F.when(F.col("rule_id").startswith("secret/"), 0).when(F.col("rule_id").startswith("todo/"), 1).otherwise(2)
    return [kind, F.col("path"), F.col("line"), F.col("rule_id"), F.col("message"), F.col("level")]


def sarif_rules(results: DataFrame) -> DataFrame:
    """``(rule_id, level)`` of the rules that have a result, in order of first use."""
    first = results.groupBy("rule_id").agg(F.min(F.struct(*[c.alias(f"k{i}") for i, c in enumerate(sarif_order())])).alias("first"))
    return first.orderBy("first").select("rule_id", F.col("first.k5").alias("level"))
