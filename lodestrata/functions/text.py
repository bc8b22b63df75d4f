"""Scalar expressions over names and texts; all run inside code generation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import rules

# Line ends, and the places behind them inside a text.  Looking back at each place is far
# cheaper than running over all other characters, [^...]*+, with ends beyond Latin-1.
ENDS = "\\n\\r\\x0B\\x0C\\x1C-\\x1E\\u0085\\u2028\\u2029"
BEHIND_END = rf"(?<=[{ENDS}])(?!\z|(?<=\r)\n)"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _without_last_empty(parts: Column) -> Column:
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)


def let(value: Column, f) -> Column:
    """``f(value)`` with ``value`` evaluated once; inside a lambda an expression would be again for each element."""
    return F.element_at(F.transform(F.array(value), f), 1)


def lines_lf(text) -> Column:
    """Lines ended by LF, without their ends; no phantom line after the last end."""
    return _without_last_empty(F.split(col(text), "\n", -1))


def lines_universal(text) -> Column:
    """Lines ended by LF, CR or CRLF, without their ends."""
    return _without_last_empty(F.split(col(text), r"\r\n|\r|\n", -1))


def lines_keep_ends(text) -> Column:
    """Lines with their ends, at every Unicode line boundary; concatenated they are the text."""
    return F.array_remove(F.split(col(text), BEHIND_END, -1), "")


def is_blank(line) -> Column:
    return col(line).rlike(r"(?U)^\s*$")


def is_comment(line) -> Column:
    return col(line).rlike(r"(?U)^\s*(#|//)")


def line_kind(line) -> Column:
    """``blank``, ``comment`` or ``code``."""
    return F.when(is_blank(line), "blank").when(is_comment(line), "comment").otherwise("code")


def file_name(path) -> Column:
    return F.regexp_extract(col(path), "([^/]*)$", 1)


def extension(path) -> Column:
    """The last suffix, lower-cased with its dot; a dotfile without another dot has none."""
    return F.lower(F.regexp_extract(file_name(path), r"^.+?(\.[^.]*)$", 1))


def parent(path) -> Column:
    return F.coalesce(F.nullif(F.regexp_extract(col(path), "^(.*)/[^/]*$", 1), F.lit("")), F.lit("."))


def path_key(path) -> Column:
    """What orders paths part by part: ``a/x`` is ahead of ``a-b/x``, as no name has the sign below all others."""
    return F.replace(col(path), F.lit("/"), F.lit("\0"))


def is_hidden(path) -> Column:
    return file_name(path).startswith(".")


def in_directory(path, names) -> Column:
    """One of the path's parts is among ``names``."""
    return F.arrays_overlap(F.split(col(path), "/"), F.array(*map(F.lit, names)))


def is_temporary(path) -> Column:
    return F.lower(col(path)).rlike(r"(\.tmp|\.temp|\.swp|~)$")


def secret_name(path) -> Column:
    return F.lower(file_name(path)).rlike("|".join(rules.SECRET_NAMES))


def human_size(size) -> Column:
    """Bytes in steps of 1024, one decimal, ties to even."""
    n, out = col(size).cast("double"), None
    for k, unit in enumerate(("B", "KiB", "MiB", "GiB")):
        text = F.format_string(f"%.1f {unit}", F.bround(n / 1024.0**k, 1))
        out = F.when(n < 1024.0 ** (k + 1), text) if out is None else out.when(n < 1024.0 ** (k + 1), text)
    return out.otherwise(F.format_string("%.1f TiB", F.bround(n / 1024.0**4, 1)))


def slug(name) -> Column:
    dashed = F.regexp_replace(F.regexp_replace(col(name), "[^A-Za-z0-9._-]+", "-"), "-+", "-")
    return F.coalesce(F.nullif(F.lower(F.regexp_replace(dashed, "^[-.]+|[-.]+$", "")), F.lit("")), F.lit("project"))


def report_name(name, extension: str = "md") -> Column:
    return F.concat(slug(name), F.lit(f"-report.{extension}"))


def tail(text, n: int = 80) -> Column:
    """The last ``n`` lines of the stripped text."""
    lines = F.split(F.regexp_replace(col(text), r"(?U)^\s+|\s+$", ""), "\n", -1)
    return F.array_join(F.when(F.size(lines) > n, F.slice(lines, -n, n)).otherwise(lines), "\n")


def truncated(text, most: int = rules.TODO_CHARS) -> Column:
    """The stripped text; beyond ``most`` characters three fewer and an ellipsis."""
    clean = F.regexp_replace(col(text), r"(?U)^\s+|\s+$", "")
    return F.when(F.length(clean) > most, F.concat(F.substring(clean, 1, most - 3), F.lit("..."))).otherwise(clean)


def rule_id(prefix: str, name) -> Column:
    return F.concat(F.lit(f"{prefix}/"), F.replace(F.lower(F.trim(col(name))), F.lit(" "), F.lit("-")))


def fence_language(ext) -> Column:
    pairs = [F.lit(x) for pair in rules.FENCE_LANGUAGE.items() for x in pair]
    return F.coalesce(F.create_map(*pairs)[col(ext)], F.lit(""))


def table_cell(text) -> Column:
    """Text for a cell of a Markdown table."""
    return F.replace(col(text), F.lit("|"), F.lit("\\|"))


def sha256_mark(text) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(col(text), 256))


def contains_any(text, words) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(col(text), F.lit(w)) for w in words])


def passed(returncode="returncode", skipped="skipped") -> Column:
    return (col(returncode) == 0) & ~col(skipped)


def badge(returncode="returncode", skipped="skipped") -> Column:
    return F.when(col(skipped), "SKIP").when(passed(returncode, skipped), "PASS").otherwise("FAIL")
