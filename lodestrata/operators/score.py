"""Project detection, reading order and the health score."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import rules
from ..functions import text as T


def detect_project(files: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """``primary_language, project_type, build_system, languages, markers, entry_points, is_recognized``, one row.

    Markers are files at the root, in order of priority; without one the commonest
    extension's language is named, ties by name.  ``files`` has ``rel_path`` and may have
    ``content``.  With ``by`` there is one row for each project that those columns name.

    One aggregate over one scan: what is kept of a project are the marker and entry-point
    names it has, and a count a language, all from fixed lists.
    """
    c = F.col
    android = c("rel_path").rlike(r"^(([^/]+/){1,2}src/main/)?AndroidManifest\.xml$")
    if "content" in files.columns:
        build = c("rel_path").rlike(r"^(app/)?build\.gradle(\.kts)?$")
        android = android | (build & T.contains_any(c("content").cast("string"), ("com.android.application", "com.android.library")))
    names = {m[0] for m in rules.PROJECT_MARKERS} | {p for ps in rules.ENTRY_POINTS.values() for p in ps}
    known = F.create_map(*[F.lit(x) for kv in rules.EXTENSION_LANGUAGE.items() for x in kv])
    spoken = sorted(set(rules.EXTENSION_LANGUAGE.values()))
    rows = files.select(*by, "rel_path", android.alias("_android"), known[T.extension("rel_path")].alias("_language"))
    kept = rows.groupBy(*by).agg(
        F.coalesce(F.bool_or("_android"), F.lit(False)).alias("_is_android"),
        F.collect_set(F.when(c("rel_path").isin(*sorted(names)), c("rel_path"))).alias("_names"),
        *[F.count_if(c("_language") == lang).alias(f"_n{i}") for i, lang in enumerate(spoken)],
    )
    markers = F.array(*[F.struct(*[F.lit(x).alias(k) for k, x in zip(("name", "language", "kind", "build"), m)]) for m in rules.PROJECT_MARKERS])
    points = F.array(*[F.struct(F.lit(lang).alias("language"), F.lit(p).alias("name")) for lang, ps in rules.ENTRY_POINTS.items() for p in ps])
    counts = F.array(*[F.struct((-c(f"_n{i}")).alias("n"), F.lit(lang).alias("language")) for i, lang in enumerate(spoken)])
    kept = kept.withColumns({"_found": F.filter(markers, lambda m: F.array_contains("_names", m["name"])), "_guess": F.array_min(F.filter(counts, lambda x: x["n"] < 0))["language"]})
    kept = kept.withColumns({"_languages": F.array_distinct(F.transform("_found", lambda m: m["language"])), "_first": F.get("_found", F.lit(0))})
    entries = F.filter(points, lambda p: F.array_contains("_languages", p["language"]) & F.array_contains("_names", p["name"]))
    relabel = lambda lang: F.when(c("_is_android") & (lang == "Java/Kotlin"), "Android/Kotlin").otherwise(lang)
    return kept.select(
        *by, relabel(F.coalesce("_first.language", "_guess", F.lit("Unknown"))).alias("primary_language"), F.coalesce("_first.kind", F.lit("unknown (no build-system marker found)")).alias("project_type"),
        F.coalesce("_first.build", F.lit("none detected")).alias("build_system"), F.transform("_languages", relabel).alias("languages"), F.array_sort(F.transform("_found", lambda m: m["name"])).alias("markers"),
        F.array_sort(F.array_distinct(F.transform(entries, lambda p: p["name"]))).alias("entry_points"), c("_first").isNotNull().alias("is_recognized"),
    )


def majority_language(files: DataFrame, languages: dict[str, str] = rules.EXTENSION_LANGUAGE) -> DataFrame:
    """``(language, files)`` of the language that most files have; ties go by name."""
    known = F.create_map(*[F.lit(x) for kv in languages.items() for x in kv])
    named = files.select(known[T.extension("rel_path")].alias("language")).where("language is not null")
    return named.groupBy("language").agg(F.count("*").alias("files")).orderBy(F.desc("files"), "language").limit(1)


def reading_bucket(path: str = "rel_path") -> Column:
    """0: read first, 1: next, 2: the rest."""
    low, name = F.lower(F.col(path)), F.lower(T.file_name(path))
    return F.when(name.isin(*rules.READ_FIRST) | low.startswith("docs/"), 0).when(name.isin(*rules.READ_NEXT) | T.contains_any(low, rules.READ_NEXT_PARTS), 1).otherwise(2)


def reading_order(files: DataFrame) -> DataFrame:
    return files.select("rel_path", reading_bucket().alias("bucket")).orderBy("bucket", T.path_key("rel_path"))


def health(results: DataFrame, git: dict, todos: DataFrame, secrets: DataFrame, stats: DataFrame, tools: int) -> DataFrame:
    """One row of six components, their sum, grade and the critical points.

    ``results(kind, returncode, skipped)`` holds runs of kind test, quality and security.
    """
    is_run, ok = ~F.col("skipped"), T.passed()
    per = lambda kind, test: F.count_if((F.col("kind") == kind) & test).alias(f"{kind}_{'all' if test is yes else 'run' if test is is_run else 'ok'}")
    yes = F.lit(True)
    counts = results.agg(*[per(k, t) for k in ("test", "quality", "security") for t in (yes, is_run, ok)])
    row = counts.crossJoin(todos.agg(F.count("*").alias("n_todos"))).crossJoin(secrets.agg(F.count_if(~F.col("is_test_fixture")).alias("n_secrets"))).crossJoin(stats.select("broken_symlinks", "empty_files"))  # one row each
    c = F.col
    less = lambda test, points: F.when(test, points).otherwise(0)
    made = {
        "tests": F.when(c("test_all") == 0, 5.0).when(c("test_run") == 0, 10.0).otherwise(F.bround(25.0 * c("test_ok") / c("test_run"), 1)),
        "quality": F.when(c("quality_all") == 0, 5.0).when(c("quality_run") == 0, 8.0).otherwise(F.bround(20.0 * c("quality_ok") / c("quality_run"), 1)),
        "security": F.when(c("security_all") == 0, 8.0).when(c("security_ok") < c("security_run"), 5.0).otherwise(15.0),
        "git": F.lit(float(max(0, 10 - 4 * bool(git.get("dirty")) - 3 * (git.get("behind", 0) > 10) - 2 * (git.get("untracked", 0) > 20)))),
        "code": F.greatest(F.lit(0), 15 - less(c("n_todos") > 50, 5) - less(c("broken_symlinks") > 0, 3) - less(c("empty_files") > 10, 2) - less(c("n_secrets") > 0, 10)).cast("double"),
        "tooling": F.lit(float(min(10, 2 * tools))),
    }
    critical = F.filter(
        F.array(
            F.when(c("test_ok") < c("test_run"), "failing tests"), F.when(c("security_ok") < c("security_run"), "failing security checks"), F.when(c("broken_symlinks") > 0, "broken links"), F.when(c("n_secrets") > 0, "possible secrets"),
        ), lambda x: x.isNotNull(),
    )
    total = F.bround(F.greatest(F.lit(0.0), F.least(F.lit(100.0), reduce(lambda a, b: a + b, map(F.col, made)))), 1)
    out = row.select(*[x.alias(k) for k, x in made.items()], critical.alias("critical")).withColumn("score", total)
    grade = F.when(c("score") >= 90, "A").when(c("score") >= 80, "B").when(c("score") >= 70, "C").when(c("score") >= 60, "D").otherwise("F")
    return out.withColumn("grade", grade)
