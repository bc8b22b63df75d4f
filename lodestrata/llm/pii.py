"""Personal data: patterns propose spans, checksums confirm them, words nearby adjust the score.

Every kind has a pattern, tests that a match has to pass (Luhn for cards, mod 97 for
account numbers, ranges for parts of addresses), a score to begin with, and words that
raise it when they stand near.  ``BASE`` kinds are reported whenever their tests pass,
whatever their score; all others only from a score of ``least`` on, and not where a base
span lies.  An account number's checksum lifts it over that line by itself; a local
telephone or social security number needs a word that says what it is.

Patterns, tests, checksums and contexts are built-in expressions: a text is split at a
kind's matches once, offsets are sums of the parts' lengths, and contexts are the ends
of the parts beside a match.  Nothing is shuffled or collected.  Patterns never try a
run of characters again from within it, so that a text takes time by its length.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, small_batches, sums_ahead, table

NEAR = 40  # characters of context on either side
SPAN = "struct<kind:string,start:long,end:long,score:double,base:boolean>"

# Fixed values of the contract: patterns of the base kinds, written so that Java's engine
# finds the same matches without trying a run again.  A leftmost match starts at a run's
# first character, or where the match before it ended.
EMAIL_CHARS = "A-Za-z0-9._%+-"
EMAIL = rf"(?:\G|(?<![{EMAIL_CHARS}]))[{EMAIL_CHARS}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"
#: Only whole chains of 12 to 19 digits; the base pattern takes shorter and longer ones too and its test drops them.
CARD = r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){11,18}+(?![ -]?[0-9])"
PHONE = r"\+[0-9][ ().0-9-]+[0-9]"

IBAN = r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?"
SSN = r"[0-9]{3}-[0-9]{2}-[0-9]{4}"
LOCAL_PHONE = r"\(?[0-9]{3}\)?[ .-][0-9]{3}[.-][0-9]{4}"

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def digits(v: Column) -> Column:
    return F.regexp_replace(v, "[^0-9]", "")


def luhn(v: Column) -> Column:
    """The Luhn sum of a match's digits is a multiple of ten."""

    def total(back):
        digit = lambda i: F.substr(back, i, F.lit(1)).cast("int")
        twice = lambda d: F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return F.aggregate(F.sequence(F.lit(1), F.length(back)), F.lit(0), lambda a, i: a + F.when(i % 2 == 0, twice(digit(i))).otherwise(digit(i)))

    return let(F.reverse(digits(v)), total) % 10 == 0


def mod97(v: Column) -> Column:
    """The first four characters put last, letters as 10 to 35, the number leaves remainder 1 by 97."""

    def remainder(x):
        value = lambda i: F.instr(F.lit("0123456789" + UPPER), F.substr(x, i, F.lit(1))) - 1
        step = lambda a, i: let(value(i), lambda d: (a * F.when(d > 9, 100).otherwise(10) + d) % 97)
        return F.aggregate(F.sequence(F.lit(1), F.length(x)), F.lit(0), step)

    bare = F.replace(v, F.lit(" "), F.lit(""))
    return let(F.concat(F.substr(bare, F.lit(5)), F.left(bare, F.lit(4))), remainder) == 1


def n_digits(v: Column, least: int, most: int) -> Column:
    return F.length(digits(v)).between(least, most)


@dataclass(frozen=True)
class Kind:
    """One kind of personal data; ``edge`` are characters that mustn't stand beside a match."""

    name: str
    pattern: str
    score: float
    test: object = None
    words: tuple[str, ...] = ()
    edge: str = ""
    base: bool = False
    unless: tuple[str, ...] = field(default=("version", "build", "isbn", "serial", "example", "sample"))

    def kept(self, match: Column) -> Column:
        ok = F.lit(True) if self.test is None else self.test(match["value"])
        if self.edge:
            ok = ok & ~F.right(match["before"], F.lit(1)).rlike(f"[{self.edge}]") & ~F.left(match["after"], F.lit(1)).rlike(f"[{self.edge}]")
        return ok

    def scored(self, match: Column) -> Column:
        """The score to begin with, more where a word of this kind is near, less where one speaks against it."""
        around = F.translate(F.concat_ws(" ", match["before"], match["after"]), UPPER, LOWER)
        said = lambda words: around.rlike(word_pattern(words)) if words else F.lit(False)
        full = F.lit(self.score) + F.when(said(self.words), 0.35).otherwise(0.0) - F.when(said(self.unless), 0.3).otherwise(0.0)
        return F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), full)), 2)


def word_pattern(words: tuple[str, ...]) -> str:
    return f"(^|[^a-z])({'|'.join(words)})([^a-z]|$)"


PART = "(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
#: Kinds as listed: those of the base, in the contract's order, then those the method adds.
KINDS = (
    Kind("email", EMAIL, 0.8, words=("e-?mail", "mail", "contact", "write", "correo", "courriel"), base=True),
    Kind("ip", IP, 0.6, lambda v: v.rlike(rf"^0*{PART}(?:\.0*{PART}){{3}}$"), ("ip", "address", "host", "server", "client"), base=True),
    Kind("card", CARD, 0.9, luhn, ("card", "visa", "mastercard", "credit", "debit", "karte", "tarjeta", "carte"), base=True),
    Kind("phone", PHONE, 0.6, lambda v: n_digits(v, 9, 15), ("phone", "tel", "telephone", "call", "mobile", "cell", "fax"), base=True),
    Kind("iban", IBAN, 0.9, mod97, ("iban", "account", "bank", "konto", "cuenta", "compte"), edge="A-Za-z0-9"),
    Kind("ssn", SSN, 0.3, lambda v: ~v.rlike("^(000|666|9..)|-00-|0000$"), ("ssn", "social security"), edge="0-9A-Za-z-"),
    Kind("local_phone", LOCAL_PHONE, 0.3, None, ("phone", "tel", "telephone", "call", "mobile", "cell", "fax"), edge="0-9A-Za-z+.-"),
)
BASE = tuple(k.name for k in KINDS if k.base)


def matches(text: Column, pattern: str, near: int = NEAR) -> Column:
    """``array<struct<value, start, before, after>>``: a pattern's matches with 0-based places and the text beside them."""
    length = lambda x: F.length(x).cast("long")

    def of(x):
        m, g = x["m"], x["g"]
        sizes = F.zip_with(F.slice(g, F.lit(1), F.size(m)), m, lambda a, b: length(a) + length(b))
        one = lambda ahead: lambda v, k: F.struct(
            v.alias("value"), (F.get(ahead, k) + length(F.get(g, k))).alias("start"), F.right(F.get(g, k), F.lit(near)).alias("before"), F.left(F.get(g, k + 1), F.lit(near)).alias("after"),
        )
        return let(sums_ahead(sizes), lambda ahead: F.transform(m, one(ahead)))

    found = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"), F.split(text, pattern, -1).alias("g"))
    none = F.array().cast("array<struct<value:string,start:long,before:string,after:string>>")
    return F.when(text.rlike(pattern), let(found, of)).otherwise(none)


def _spans(text: Column, kind: Kind) -> Column:
    kept = F.filter(matches(text, kind.pattern), kind.kept)
    return F.transform(kept, lambda m: F.struct(F.lit(kind.name).alias("kind"), m["start"].alias("start"), (m["start"] + F.length(m["value"])).alias("end"), kind.scored(m).alias("score"), F.lit(kind.base).alias("base"))).cast(f"array<{SPAN}>")


def annotate(docs: DataFrame, kinds: tuple[Kind, ...] = KINDS, least: float = 0.5, text_col: str = "text", out: str = "spans") -> DataFrame:
    """``docs`` with ``out``: an array of ``(kind, start, end, score, base)`` by start, then kind as listed.

    Places are 0-based code points, ends exclusive.  All rows and other columns stay, repeated rows
    each with their own spans; null and empty texts have an empty array; texts of any
    length are searched whole; an empty table gives an empty result.  A column named like
    ``out`` is replaced.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    order = F.create_map(*[F.lit(x) for i, k in enumerate(kinds) for x in (k.name, i)])
    base = F.concat(*[_spans(text, k) for k in kinds if k.base], F.array().cast(f"array<{SPAN}>"))
    more = F.concat(*[_spans(text, k) for k in kinds if not k.base], F.array().cast(f"array<{SPAN}>"))

    def together(x):
        apart = lambda s: ~F.exists(x["base"], lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))
        every = F.concat(x["base"], F.filter(x["more"], lambda s: (s["score"] >= least) & apart(s)))
        keyed = F.transform(every, lambda s: F.struct(s["start"].alias("start"), order[s["kind"]].alias("order"), s.alias("span")))
        return F.transform(F.array_sort(keyed), lambda s: s["span"])

    return docs.withColumn(out, let(F.struct(base.alias("base"), more.alias("more")), together))


def digest(spans: Column) -> Column:
    """``kind:start:end`` of all, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def mask(text: Column, spans: Column) -> Column:
    """``text`` with each span replaced by its kind in brackets; where spans overlap, those that start inside one before go with it."""
    state = lambda done, at: F.struct(done.alias("done"), at.alias("at"))
    part = lambda a, b: F.substr(text, (a + 1).cast("int"), (b - a).cast("int"))

    def step(s, x):
        fresh = state(F.concat(s["done"], F.array(part(s["at"], x["start"]), F.concat(F.lit("["), F.upper(x["kind"]), F.lit("]")))), x["end"])
        return F.when(x["start"] >= s["at"], fresh).otherwise(state(s["done"], F.greatest(s["at"], x["end"])))

    start = state(F.array().cast("array<string>"), F.lit(0).cast("long"))
    whole = F.aggregate(spans, start, step, lambda s: F.concat(F.array_join(s["done"], ""), F.substr(text, (s["at"] + 1).cast("int"))))
    return F.when(F.size(spans) > 0, whole).otherwise(text)


def redact(docs: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """``docs`` with all personal data in their texts replaced by marks; null texts stay null."""
    kept = docs.columns
    found = annotate(docs.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"), F.col(text_col).alias("text")), **options)
    return found.select(*[mask(F.col("text"), F.col("spans")).alias(c) if c == text_col else F.col("row").getField(c).alias(c) for c in kept])


def op12_pii(spark, sf_dir):
    """Contract: all documents; counts and the digest are those of the base kinds."""
    small_batches(spark)
    found = annotate(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("spans", lambda s: s["base"])
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *[count(k) for k in BASE], F.sha2(digest(base), 256).alias("base_sha256"), digest(F.col("spans")).alias("spans"))


def _sql() -> str:
    """DuckDB SQL for ``op12_pii``: the contract's own patterns, tests by list functions, places by window sums."""
    patterns = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
        "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+",
        "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
        "iban": IBAN, "ssn": SSN, "local_phone": LOCAL_PHONE,
    }
    tests = {
        "ip": "list_bool_and(list_transform(string_split(v, '.'), lambda x: length(ltrim(x, '0')) <= 3 AND coalesce(try_cast(right(x, 3) AS int), 0) <= 255))",
        "card": "nd BETWEEN 12 AND 19 AND list_sum(list_transform(range(1, nd + 1), lambda i: (CASE WHEN i % 2 = 0 THEN (2 * CAST(substr(reverse(dg), i, 1) AS int)) // 10 + (2 * CAST(substr(reverse(dg), i, 1) AS int)) % 10 ELSE CAST(substr(reverse(dg), i, 1) AS int) END))) % 10 = 0",
        "phone": "nd BETWEEN 9 AND 15",
        "iban": f"list_reduce(list_prepend(0, list_transform(string_split(substr(replace(v, ' ', ''), 5) || left(replace(v, ' ', ''), 4), ''), lambda c: strpos('0123456789{UPPER}', c) - 1)), lambda a, d: (a * (CASE WHEN d > 9 THEN 100 ELSE 10 END) + d) % 97) = 1",
        "ssn": "NOT regexp_matches(v, '^(000|666|9..)|-00-|0000$')",
    }
    of = lambda f: "CASE kind " + " ".join(f"WHEN '{k.name}' THEN {f(k)}" for k in KINDS) + " END"
    edge = lambda k: f" AND NOT regexp_matches(right(g, 1), '[{k.edge}]') AND NOT regexp_matches(left(coalesce(nxt, ''), 1), '[{k.edge}]')" if k.edge else ""
    near = lambda words: f"regexp_matches(around, '{word_pattern(words)}')"
    value = lambda k: f"{k.score} + (CASE WHEN {near(k.words)} THEN 0.35 ELSE 0 END) - (CASE WHEN {near(k.unless)} THEN 0.3 ELSE 0 END)"
    parts = " UNION ALL ".join(
        f"SELECT r, {i} AS o, '{k.name}' AS kind, t, regexp_extract_all(t, '{patterns[k.name]}') AS m, string_split_regex(t, '{patterns[k.name]}') AS gs FROM d WHERE regexp_matches(t, '{patterns[k.name]}')" for i, k in enumerate(KINDS)
    )
    base = ", ".join(f"'{k}'" for k in BASE)
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
found AS ({parts}),
listed AS (SELECT r, o, kind, m, gs, unnest(range(1, len(m) + 1)) AS k FROM found),
placed AS (SELECT r, o, kind, k, m[k] AS v, gs[k] AS g, gs[k + 1] AS nxt, CAST(sum(length(m[k]) + length(gs[k])) OVER (PARTITION BY r, o ORDER BY k) AS bigint) AS e FROM listed),
tested AS (SELECT *, e - length(v) AS s, regexp_replace(v, '[^0-9]', '', 'g') AS dg, length(regexp_replace(v, '[^0-9]', '', 'g')) AS nd,
  translate(right(g, {NEAR}) || ' ' || left(coalesce(nxt, ''), {NEAR}), '{UPPER}', '{LOWER}') AS around FROM placed),
good AS (SELECT r, o, kind, s, e, {of(value)} AS score FROM tested WHERE {of(lambda k: "(" + tests.get(k.name, "true") + edge(k) + ")")}),
kept AS (SELECT * FROM good g WHERE kind IN ({base}) OR (round(score, 2) >= 0.5 AND NOT EXISTS (SELECT 1 FROM good b WHERE b.r = g.r AND b.kind IN ({base}) AND b.s < g.e AND g.s < b.e))),
each AS (SELECT r, {", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in BASE)},
  string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, o) FILTER (kind IN ({base})) AS base, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, o) AS spans FROM kept GROUP BY r)
SELECT doc_id, {", ".join(f"coalesce(n_{k}, 0) AS n_{k}" for k in BASE)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN each USING (r)
"""


QUERIES = {"op12_pii": op12_pii}
ORACLE_SQL = {"op12_pii": _sql()}
