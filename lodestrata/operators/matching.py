"""Thousands of line rules in one pass over the texts.

A rule is a pattern and a literal that every match of it contains.  One automaton over
all literals walks each text once, whatever the number of rules; a line that holds a
rule's literal is then matched with that rule's pattern only, by Spark's own matcher.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

#: Bytes of literals in one automaton; more rules are more automata, each one more pass.
SLICE_BYTES = 4 << 20
#: Rows of one batch that a task gives back.
BATCH = 8192


def _key(text: str) -> str:
    """Bytes of a text as characters, A-Z as a-z: places in it are places in the bytes."""
    return text.encode(errors="surrogatepass").lower().decode("latin-1")


def _automaton(literals: list[tuple[int, str]]):
    import ahocorasick

    by = defaultdict(list)
    for i, literal in literals:
        by[_key(literal)].append(i)
    made = ahocorasick.Automaton()
    for key, ids in by.items():
        made.add_word(key, ids)
    made.make_automaton()
    return made


def _hits(automaton, text: str) -> Iterator[tuple[int, int, bytes]]:
    """``(rule, line number, line)`` once for each line that holds a rule's literal."""
    key, raw = _key(text), text.encode(errors="surrogatepass")
    number, start, end, seen = 0, 0, -1, set()
    for at, ids in automaton.iter(key):
        while at >= end:  # lines end at LF, CR or CRLF
            start = 0 if end < 0 else after
            lf, cr = key.find("\n", start), key.find("\r", start)
            end = min((x for x in (lf, cr) if x >= 0), default=len(key))
            after = end + (2 if key.startswith("\r\n", end) else 1)
            number, seen = number + 1, set()
        for i in ids:
            if i not in seen:
                seen.add(i)
                yield i, number, raw[start:end]


def _search(literals: list[tuple[int, str]]):
    made = []

    def run(batches):
        if not made:
            made.append(_automaton(literals))
        rows = [], [], [], []

        def batch():
            kinds = pa.string(), pa.int32(), pa.int64(), pa.string()
            out = pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(rows, kinds)], ["rel_path", "_rule", "line_number", "line"])
            for x in rows:
                x.clear()
            return out

        size = 0
        for b in batches:
            for path, text, ahead in zip(*(b.column(k).to_pylist() for k in range(3))):
                for i, number, line in _hits(made[0], text):
                    for x, value in zip(rows, (path, i, ahead + number, line.decode(errors="replace"))):
                        x.append(value)
                    size += len(line)
                    if len(rows[0]) == BATCH or size > 16 << 20:
                        size = 0
                        yield batch()
        if rows[0]:
            yield batch()

    return run


def match_rules(files: DataFrame, rules: DataFrame, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """``(rel_path, line_number, rule)`` of every line of ``files`` and rule that match.

    ``rules`` has ``rule``, ``pattern`` and ``literal``: a text that each match contains,
    with A-Z and a-z taken as the same.  A rule without a literal, null or empty, is
    matched with every line, at its full price.  Rows of one ``rule`` are alternatives
    and give a line once; a null pattern matches nothing, and neither does a literal that
    holds a line end.  Rules are read to the driver and sent to tasks: a table of
    configuration, of which an automaton holds ``slice_bytes`` of literals.  Lines end at
    LF, CR or CRLF; files without text have none.
    """
    spark = files.sparkSession
    numbered = [(i, *r) for i, r in enumerate(sorted({(r.rule, r.pattern, r.literal or "") for r in rules.where("pattern is not null").select("rule", "pattern", "literal").collect()}, key=lambda r: (r[0] or "", r[1], r[2])))]
    ahead = F.col("first_line") if "first_line" in files.columns else F.lit(0)
    texts = files.select("rel_path", F.make_valid_utf8(F.col("content").cast("string")).alias("content"), ahead.cast("long").alias("ahead")).where("octet_length(content) > 0")
    slices, size = [[]], 0
    for i, _, _, literal in numbered:
        if literal:
            size += len(literal.encode())
            if size > slice_bytes and slices[-1]:
                slices.append([])
                size = len(literal.encode())
            slices[-1].append((i, literal))
    patterns = spark.createDataFrame([r[:3] for r in numbered], "_rule int, rule string, pattern string")
    out = spark.createDataFrame([], "rel_path string, line_number long, rule string")
    for own in filter(None, slices):
        near = texts.mapInArrow(_search(own), "rel_path string, _rule int, line_number long, line string")
        # Bounded by what the driver has just sent to tasks anyway.
        out = out.unionByName(near.join(F.broadcast(patterns), "_rule").where(F.expr("regexp_like(line, pattern)")).select("rel_path", "line_number", "rule"))
    if every := [r for r in numbered if not r[3]]:
        lines = texts.select("rel_path", "ahead", F.posexplode(T.lines_universal("content")).alias("pos", "line"))
        named = F.filter(F.array(*[F.when(F.col("line").rlike(p), F.struct(F.lit(n).cast("string").alias("rule"))) for _, n, p, _ in every]), lambda x: x.isNotNull())
        out = out.unionByName(lines.select("rel_path", (F.col("ahead") + F.col("pos") + 1).alias("line_number"), F.explode(named).alias("r")).select("rel_path", "line_number", "r.rule"))
    names = [r[1] for r in numbered]
    return out if len(set(names)) == len(names) else out.distinct()
