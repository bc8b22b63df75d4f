"""Reports as Markdown, JSON, text, HTML and SARIF.

Pages to read show each table up to a stated limit, then the directory tree and, if asked
for, the sources.  JSON and SARIF hold every row.  What grows with the input is sorted and
written by tasks as pieces of text (``sinks.pieces``); the driver writes the short texts
between them and joins the pieces by bytes.  A report's folder must be one that all
executors mount at the same path.
"""

from __future__ import annotations

import hashlib
import html
import json
import os
import shutil
import uuid
from collections.abc import Iterator
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import findings
from ..operators.tools import environment_text
from ..plans.report import Report
from . import pieces

# Fixed limits of what a report shows.
LIMITS = {"extensions": 10, "directories": 15, "largest": 15, "duplicates": 20, "todos": 100, "issues": 500, "reading": 40, "excluded": 50, "secrets": 100}
LIMIT_RESULTS = 100
#: Sort keys, descending behind a minus sign.
ORDER = {
    "extensions": ("-files", "extension"), "directories": ("-size", "directory"), "largest": ("-size", "rel_path"), "duplicates": ("-wasted", "digest"),
    "todos": ("rel_path", "line_number"), "issues": ("severity", "source", "message"), "reading": ("bucket", "rel_path"), "excluded": ("rel_path",), "secrets": ("rel_path", "line_number", "pattern_name"),
}


class Rows(NamedTuple):
    """A part of a report that tasks write: the one column of sorted rows, with a text between two."""

    rows: DataFrame
    between: str = "\n"


def _keys(names: tuple[str, ...]) -> list:
    """Sort keys by name; paths go by their parts."""
    return [F.desc(c[1:]) if c[0] == "-" else T.path_key(c) if c == "rel_path" else F.col(c) for c in names]


def summary(report: Report) -> dict:
    """All that a rendered report says, as plain values."""
    out = {"name": report.name, **_single(report)}
    shown = ["kind", "source", T.badge().alias("outcome"), F.round("duration_seconds", 1).alias("seconds"), T.tail("raw_output", 20).alias("output")]
    out["results"] = [r.asDict() for r in report.results.select(*shown).orderBy("kind", "source").limit(LIMIT_RESULTS).collect()]
    for name, most in LIMITS.items():
        rows = getattr(report, name).orderBy(*_keys(ORDER[name])).limit(most + 1).collect()
        out[name] = [r.asDict() for r in rows[:most]]
        out[f"more_{name}"] = len(rows) > most
        if name in ("todos", "secrets"):
            out[f"all_{name}"] = getattr(report, name).count() if len(rows) > most else len(rows)
    return out


def _single(report: Report) -> dict:
    """The parts of a report that are one row, and the summary made of them."""
    out = {k: t.first().asDict(recursive=True) for k, t in (("detection", report.detection), ("stats", report.stats), ("health", report.health))}
    known = [r.explanation for r in report.known.where("found").collect()]  # a row a rule
    extensions = report.extensions.orderBy(F.desc("files"), "extension").limit(8).collect()
    d, h, git = out["detection"], out["health"], report.git
    lines = [f"Project: {report.name}", f"Languages: {', '.join(d['languages'] or [d['primary_language']])}", f"Kind: {d['project_type']}, built with {d['build_system']}"]
    lines += [f"Starts at: {', '.join(d['entry_points'])}"] * bool(d["entry_points"])
    lines += [f"Extensions: {', '.join(f'{r.extension} {r.files}' for r in extensions) or 'none'}", f"Files: {out['stats']['total_files']}, lines of code: {out['stats']['code_lines']}"]
    lines += [f"Git: {git['branch']} at {git['commit']}, dirty {git['dirty']}, ahead {git['ahead']}, behind {git['behind']}"] if git else []
    lines += [f"Health: {h['score']} of 100, grade {h['grade']}", *(f"Known issue: {x}" for x in known)]
    return out | {"git": git, "environment": report.environment, "known_issues": known, "summary": "\n".join(lines)}


def to_json(data: dict) -> str:
    return json.dumps(data, indent=2, ensure_ascii=False, default=str)


#: Tables of a JSON report by name, with their order; none has a limit.
FULL = {
    "todos": ("rel_path", "line_number"), "secrets": ("rel_path", "line_number", "pattern_name"), "issues": ("source", "severity", "message"), "results": ("kind", "source"),
    "extensions": ORDER["extensions"], "directories": ORDER["directories"], "largest": ORDER["largest"], "duplicates": ORDER["duplicates"],
    "reading": ORDER["reading"], "essential": ("rel_path",), "skipped": ("rel_path",), "excluded": ("rel_path",),
}


def json_sections(report: Report) -> Iterator[str | Rows]:
    """The whole report as JSON."""
    yield "{"
    for key, value in {"name": report.name, **_single(report)}.items():
        yield f"{json.dumps(key)}: {json.dumps(value, ensure_ascii=False, default=str)},"
    for k, (name, keys) in enumerate(FULL.items()):
        yield f"{json.dumps(name)}: ["
        yield Rows(getattr(report, name).orderBy(*_keys(keys)).select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value")), ",\n")
        yield "]" + "," * (k + 1 < len(FULL))
    yield "}"


def _tables(data: dict):
    for name in LIMITS:
        if rows := data[name]:
            yield name, list(rows[0]), [[str(v) for v in r.values()] for r in rows], data[f"more_{name}"]


def to_markdown(data: dict) -> str:
    cell = lambda x: x.replace("|", "\\|").replace("\n", " ")
    d, h = data["detection"], data["health"]
    out = [f"# {data['name']}", "", f"{d['primary_language']}, {d['project_type']}, built with {d['build_system']}.", "", f"Health: {h['score']} ({h['grade']})", ""]
    out += ["```", data["summary"], "```", ""]
    if data["environment"]:
        out += ["| machine | |", "|-|-|", *[f"| {k} | {cell(v)} |" for k, v in environment_text(data["environment"]).items()], ""]
    for r in data["results"]:
        out += [f"### {r['kind']}: `{r['source']}` {r['outcome']}", "", *(["````", r["output"], "````", ""] if r["output"] else [])]
    out += ["| counter | value |", "|-|-|", *[f"| {k} | {v} |" for k, v in data["stats"].items()], ""]
    for name, head, rows, more in _tables(data):
        out += [f"## {name.capitalize()}", "", f"| {' | '.join(head)} |", f"|{'-|' * len(head)}", *[f"| {' | '.join(map(cell, r))} |" for r in rows], *(["", "More are not shown."] if more else []), ""]
    return "\n".join(out)


def markdown_sections(report: Report) -> Iterator[str | Rows]:
    """A page, the directory tree, and each embeddable file with its text where the report has sources."""
    yield to_markdown(summary(report))
    yield f"## Tree\n\n````\n{report.name}/"
    yield Rows(report.tree.orderBy("key").select("line"))
    yield "````\n"
    if report.sources is not None:
        yield "## Sources\n"
        yield Rows(embedded_sources(report, report.sources).orderBy(T.path_key("rel_path"), "part").select("section"), "")


def to_text(data: dict) -> str:
    s, h, d = data["stats"], data["health"], data["detection"]
    return "\n".join([
        data["name"], f"language: {d['primary_language']}", f"files: {s['total_files']}", f"lines: {s['total_lines']} ({s['code_lines']} code, {s['comment_lines']} comment, {s['blank_lines']} blank)",
        f"todos: {data['all_todos']}", f"possible secrets: {data['all_secrets']}", f"health: {h['score']} ({h['grade']})",
    ])


def to_html(data: dict) -> str:
    e = html.escape
    row = lambda cells, tag="td": "<tr>" + "".join(f"<{tag}>{e(c)}</{tag}>" for c in cells) + "</tr>"
    parts = [f"<h1>{e(data['name'])}</h1><p>{e(data['detection']['primary_language'])}, health {data['health']['score']} ({data['health']['grade']})</p>"]
    parts.append(f"<pre>{e(data['summary'])}</pre>")
    parts.append("<table>" + "".join(row([k, str(v)]) for k, v in data["stats"].items()) + "</table>")
    for r in data["results"]:
        parts.append(f"<h3>{e(r['kind'])}: {e(r['source'])} {e(r['outcome'])}</h3>" + (f"<pre>{e(r['output'])}</pre>" if r["output"] else ""))
    for name, head, rows, more in _tables(data):
        parts.append(f"<h2>{e(name.capitalize())}</h2><table>{row(head, 'th')}{''.join(map(row, rows))}</table>{'<p>More are not shown.</p>' if more else ''}")
    return f'<!DOCTYPE html><html><head><meta charset="utf-8"><title>{e(data["name"])}</title></head><body>{"".join(parts)}'


def html_sections(report: Report) -> Iterator[str | Rows]:
    """A page with the directory tree and, where the report has them, sources."""
    safe = lambda c: F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    yield to_html(summary(report))
    yield f"<h2>Tree</h2><pre>{html.escape(report.name)}/"
    yield Rows(report.tree.orderBy("key").select(safe("line")))
    yield "</pre>"
    if report.sources is not None:
        yield "<h2>Sources</h2><pre>"
        yield Rows(embedded_sources(report, report.sources).orderBy(T.path_key("rel_path"), "part").select(safe("section")), "")
        yield "</pre>"
    yield "</body></html>"


def sarif(report: Report) -> DataFrame:
    """Every finding as one SARIF result in JSON, a row each, in order: content findings, markers, tool issues, by place."""
    found = findings.sarif_results(report.todos, report.secrets, report.issues).orderBy(*findings.sarif_order())
    place = F.struct(F.struct(F.struct(F.col("path").alias("uri")).alias("artifactLocation"), F.struct(F.col("line").alias("startLine")).alias("region")).alias("physicalLocation"))
    return found.select(F.to_json(F.struct(F.col("rule_id").alias("ruleId"), "level", F.struct(F.col("message").alias("text")).alias("message"), F.when(F.col("path").isNotNull(), F.array(place)).alias("locations"))).alias("value"))


def sarif_sections(report: Report) -> Iterator[str | Rows]:
    """A SARIF 2.1.0 log with all results; rules in order of first use."""
    every = findings.sarif_results(report.todos, report.secrets, report.issues)
    rules = [{"id": r.rule_id} for r in findings.sarif_rules(every).collect()]  # as many as rules
    yield '{"version": "2.1.0", "$schema": "https://json.schemastore.org/sarif-2.1.0.json", "runs": [{'
    yield f'"tool": {{"driver": {json.dumps({"name": "corpus-report", "rules": rules})}}}, "results": ['
    yield Rows(sarif(report), ",\n")
    yield "]}]}"


def text_sections(report: Report) -> Iterator[str | Rows]:
    yield to_text(summary(report))


RENDERERS = {"md": markdown_sections, "txt": text_sections, "html": html_sections}
SECTIONS = {**RENDERERS, "json": json_sections, "sarif": sarif_sections}


def embedded_sources(report: Report, files: DataFrame) -> DataFrame:
    """``(rel_path, part, section)``: each embeddable file as a fenced Markdown section, a large file's in as many rows as it has parts.

    A fence is longer than any run of its sign in the file.
    """
    if "part" not in files.columns:
        files = files.withColumn("part", F.lit(0))
    text = F.coalesce(F.make_valid_utf8(F.col("content").cast("string")), F.lit(""))
    own = files.join(report.essential.select("rel_path"), "rel_path", "left_semi").select("rel_path", "part", text.alias("text"))
    run = F.coalesce(F.array_max(F.transform(F.regexp_extract_all("text", F.lit("`+"), 0), F.length)), F.lit(0))
    # A run may go on in the next part.
    whole = own.groupBy("rel_path").agg(F.max("part").alias("last"), F.max(run).alias("run")).withColumn("fence", F.repeat(F.lit("`"), F.greatest(F.lit(4), F.col("run") * (1 + F.sign("last")).cast("int") + 1)))
    head = F.when(F.col("part") == 0, F.concat(F.lit("### "), "rel_path", F.lit("\n\n"), "fence", T.fence_language(T.extension("rel_path")), F.lit("\n"))).otherwise("")
    tail = F.when(F.col("part") == F.col("last"), F.concat(F.lit("\n"), "fence", F.lit("\n\n"))).otherwise("")
    return own.join(whole, "rel_path").select("rel_path", "part", F.concat(head, "text", tail).alias("section"))


def lines(report: Report, kind: str) -> Iterator[str]:
    """A report of some kind as texts to print, in order; its rows come one partition at a time."""
    for s in SECTIONS[kind](report):
        if isinstance(s, str):
            yield s
            continue
        held = None
        for (value,) in s.rows.toLocalIterator():
            if held is not None:
                yield held + s.between.removesuffix("\n")
            held = value
        if held is not None:
            yield held


def write(report: Report, path: str, kind: str = "md") -> str:
    """Render to a file beside its checksum, replacing earlier ones; returns the digest.

    The new report is complete before the old one goes, and the old checksum goes first.
    Where a job fails, the old report and its checksum stay as they are.
    """
    digest, new, held = hashlib.sha256(), f"{path}.new", f"{os.path.abspath(path)}.{uuid.uuid4().hex}"
    try:
        with open(new, "wb") as f:

            def put(data: bytes) -> None:
                digest.update(data)
                f.write(data)

            for k, s in enumerate(SECTIONS[kind](report)):
                if isinstance(s, str):
                    put(f"{s}\n".encode("utf-8", "replace"))
                    continue
                pieces.write(s.rows, f"{held}/{k}", s.between)
                n = f.tell()
                for block in pieces.joined(f"{held}/{k}", s.between):
                    put(block)
                put(b"\n" * (f.tell() > n))
                shutil.rmtree(f"{held}/{k}")
    finally:
        shutil.rmtree(held, ignore_errors=True)
    if os.path.exists(f"{path}.sha256"):
        os.remove(f"{path}.sha256")
    os.replace(new, path)
    with open(f"{path}.sha256.new", "w", encoding="utf-8") as f:
        f.write(f"{digest.hexdigest()}  {path.rsplit('/', 1)[-1]}\n")
    os.replace(f"{path}.sha256.new", f"{path}.sha256")
    return digest.hexdigest()
