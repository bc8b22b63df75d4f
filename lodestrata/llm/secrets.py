"""Secret scans: candidates from a pattern, false positives removed by a random forest.

Candidates are unbroken strings of at least sixteen key-like characters, quoted values
and unquoted values of a secret's name of at least six, passwords within addresses,
signed tokens of three parts and the bodies of private keys, each as one candidate; a
name that something is set to isn't one.  A forest tells keys and passwords from
identifiers, words, checksums and placeholders by a candidate's length, the transitions
between its characters, how much of it dictionary words cover, its path, the words next
to it and the name it is set to.  It is trained from labelled findings; ``default_findings`` makes
some from public formats of keys and of what is mistaken for them.  The dictionary, and
which transitions are common in words, come from an installed public vocabulary file.

Every place of a candidate is judged by what stands around that place, and redacted there.

Everything on the main path is built-in expressions and Spark's own forest, in the JVM.
A scan neither shuffles nor collects: texts are split at their candidates once, and
offsets and contexts come from the pieces, not from the whole text again.  Redaction
joins each text's judgements back to it.  Results name places, never secrets.
"""

from __future__ import annotations

import base64
import json
import random
import uuid
from collections import Counter
from functools import cache, reduce

from pyspark.ml import Pipeline
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, let, sums_ahead, table
from .packing import vocabulary

LEAST, LEAST_VALUE = 16, 6
BEFORE, AFTER = 72, 36  # characters of context
NEAR = 8  # so many candidates with what is between them are longer than the context
CHARS = r"A-Za-z0-9+/_\-"
VALUE_OF = r"(?i:token|secret|passwd|password|passphrase|pwd|apikey|api_key|api-key|access_key|auth|credentials?)"
CANDIDATE = "|".join([
    r"(?<=PRIVATE KEY-----)[A-Za-z0-9+/= \t\r\n]{16,}+(?=-----END)",
    rf"(?<![{CHARS}.])eyJ[A-Za-z0-9_\-]{{6,}}+\.[A-Za-z0-9_\-]{{6,}}+\.[A-Za-z0-9_\-]{{6,}}+",
    rf"""(?<=:)(?<=://[^ \t-\r:/@"']{{0,64}}:)[^ \t-\r:/@"']{{{LEAST_VALUE},}}+(?=@)""",
    # A run that isn't itself a name set to something; = behind it only as padding.
    rf"""(?<![{CHARS}])[{CHARS}]{{{LEAST},}}+(?:={{1,2}}(?![A-Za-z0-9+/_$"'{{<]))?+(?!["']?[ \t]{{0,2}}[=:])""",
    rf"""(?<=[=:]["']|[=:] ["'])[^ \t-\r"']{{{LEAST_VALUE},}}+(?=["'])""",
    rf"""(?<=[=: ])(?<={VALUE_OF}["']?[ ]?[=:][ ]?)[^ \t-\r"'`<>,;(){{}}\[\]=:]{{{LEAST_VALUE},}}+(?![^ \t-\r"'`<>,;)}}\]])""",
])


@cache
def dictionary(path: str | None = None, most: int = 6000) -> tuple[str, ...]:
    """The first ``most`` words of four to twelve small letters in a vocabulary whose tokens mark a word's front."""
    with open(path or vocabulary("byte_bpe_50k.json"), encoding="utf-8") as f:
        ids = json.load(f)["model"]["vocab"]
    words = [t[1:] for t in sorted(ids, key=ids.get) if t[0] == "\u0120"]
    return tuple([w for w in words if 4 <= len(w) <= 12 and w.isascii() and w.isalpha() and w.islower()][:most])


def word_pattern(words) -> str:
    """A pattern that matches the longest of ``words`` at a place, letter by letter."""
    root: dict = {}
    for w in words:
        node = root
        for c in w:
            node = node.setdefault(c, {})
        node[""] = {}

    def of(node: dict) -> str:
        parts = [c + of(below) for c, below in sorted(node.items()) if c]
        if not parts:
            return ""
        inner = parts[0] if len(parts) == 1 and "" not in node else f"(?:{'|'.join(parts)})"
        return f"{inner}?" if "" in node else inner

    return of(root)


@cache
def transitions(words: tuple[str, ...]) -> tuple[str, str]:
    """Patterns of the pairs of letters that make up half of all in ``words``, and the next four tenths."""
    count = Counter(w[i : i + 2] for w in words for i in range(len(w) - 1))
    total, seen, levels = count.total(), 0, ({}, {}, {})
    for pair, n in sorted(count.items(), key=lambda x: (-x[1], x[0])):
        levels[0 if seen < 0.5 * total else 1 if seen < 0.9 * total else 2].setdefault(pair[0], []).append(pair[1])
        seen += n
    return tuple("(?=" + "|".join(f"{c}[{''.join(sorted(x))}]" for c, x in sorted(level.items())) + ")" for level in levels[:2])


NAMES = r"(?i)(token|secret|passw(or)?d|pwd|apikey|key|auth|bearer|credentials?|access|api)s?([_-]?(key|token|id))?[\s\"'=:]{0,8}$"
HASHES = r"(?i)(sha|sha-?1|sha-?256|sha-?512|md5|commit|checksum|digest|integrity|etag|rev|revision|hash|uuid|guid|blob|version)[\s\"'=:]{0,8}$"
EXAMPLES = r"(?i)(example|sample|dummy|fake|placeholder|redacted|changeme|your)"
#: The name that a candidate is set to says that it is none.
EXAMPLE_NAME = r"(?i)(example|sample|dummy|fake|placeholder|redacted)[A-Za-z0-9_-]{0,24}[\s\"'=:]{1,8}$"
ADDRESS = r"://[^\s:/@\"']{0,64}:$"
TESTS = r"(?i)(^|[/_.-])(tests?|fixtures?|examples?|samples?|mocks?)([/_.-]|$)"


def features(found: DataFrame) -> dict[str, Column]:
    """What the forest sees of ``found(candidate, before, after, path)``."""
    c, low = F.col("candidate"), F.lower("candidate")
    n = F.length(c).cast("double")
    share = lambda x, pattern: F.regexp_count(x, F.lit(pattern)) / n
    words = dictionary()
    common, usual = transitions(words)
    made = {
        "length": n,
        "digits": share(c, "[0-9]"),
        "upper": share(c, "[A-Z]"),
        "kinds": reduce(lambda a, b: a + b, [c.rlike(p).cast("double") for p in ("[0-9]", "[a-z]", "[A-Z]", r"[+/_\-]")]),
        "changes": share(c, "[0-9](?=[A-Za-z])|[A-Za-z](?=[0-9])|[a-z](?=[A-Z])|[A-Z](?=[a-z])"),
        "common": share(low, common),
        "usual": share(low, usual),
        "words": (n - F.length(F.regexp_replace(low, word_pattern(words), ""))) / n,
        "marks": share(c, r"[^A-Za-z0-9+/_\-=]"),
        "repeats": share(c, r"(.)\1"),
        "steps": share(low, "01|12|23|34|45|56|67|78|89|ab|bc|cd|de|ef|fg|gh|hi"),
        "hex": c.rlike("^([0-9a-f]+|[0-9A-F]+)$"),
        "padded": c.endswith("="),
        "uuid": low.rlike("^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"),
        "near_key": F.col("before").rlike(NAMES),
        "near_hash": F.col("before").rlike(HASHES),
        "example": c.rlike(EXAMPLES) | F.col("before").rlike(EXAMPLE_NAME),
        "private_key": F.col("before").endswith("PRIVATE KEY-----"),
        "signed": c.rlike(r"^eyJ[^.]*\.[^.]*\."),
        "address": F.col("before").rlike(ADDRESS),
        "name": c.rlike("^[A-Z]+(_[A-Z]+)+=?$|^[a-z]+(_[a-z]+)+=?$"),
        "assigned": F.col("before").rlike(r"[=:]\s*[\"']?$"),
        "path_test": F.coalesce("path", F.lit("")).rlike(TESTS),
    }
    return {k: x.cast("double") for k, x in made.items()}


def _split(text: Column) -> tuple[Column, Column]:
    """The candidates of a text in order, and what is before, between and behind them."""
    return F.regexp_extract_all(text, F.lit(CANDIDATE), F.lit(0)), F.split(text, CANDIDATE, -1)


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_col: str = "source") -> DataFrame:
    """``(doc_id, text_key, path, k, candidate, before, after, start)``: one row for each place of a candidate.

    ``k`` numbers the candidates of a text from 0, ``start`` is a place's 0-based
    character, and ``before`` and ``after`` are what stands around it there.  ``text_key``
    is a hash of the text.  Null texts have none; null ids stay.
    """
    text = F.col(text_col)
    found, gaps = _split(text)
    cut_up = docs.where(text.rlike(CANDIDATE)).select(
        F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("text_key"), F.col(path_col).cast("string").alias("path"), found.alias("_m"), gaps.alias("_g"),
    )
    m, g = F.col("_m"), F.col("_g")
    n = F.size(m)
    length = lambda x: F.length(x).cast("long")

    def place(k, ahead):
        first = F.greatest(F.lit(0), k - NEAR)
        back = F.transform(F.sequence(first, k), lambda i: F.concat(F.when(i > first, F.get(m, i - 1)).otherwise(""), F.right(F.get(g, i), F.lit(BEFORE))))
        ahead_of = F.transform(F.sequence(k + 1, F.least(n, k + NEAR)), lambda i: F.concat(F.left(F.get(g, i), F.lit(AFTER)), F.when(i < F.least(n, k + NEAR), F.get(m, i)).otherwise("")))
        return F.struct(
            k.alias("k"), F.get(m, k).alias("candidate"), F.right(F.array_join(back, ""), F.lit(BEFORE)).alias("before"), F.left(F.array_join(ahead_of, ""), F.lit(AFTER)).alias("after"),
            (F.get(ahead, k) + length(F.get(g, k))).alias("start"),
        )

    lengths = F.zip_with(F.slice(g, F.lit(1), n), m, lambda x, y: length(x) + length(y))
    places = let(sums_ahead(lengths), lambda ahead: F.transform(F.sequence(F.lit(0), n - 1), lambda k: place(k, ahead)))
    return cut_up.select("doc_id", "text_key", "path", F.inline(places))


KEYBOARD = ("qwertyuiop", "asdfghjkl", "zxcvbnm", "1234567890")


def default_findings(spark: SparkSession, n: int = 6000, seed: int = 7) -> DataFrame:
    """``(text, path, label)``: keys and passwords in public formats, and what is mistaken for them."""
    rng, words = random.Random(seed), dictionary()
    take = lambda chars, k: "".join(rng.choices(chars, k=k))
    hexes, alnum = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    b64 = lambda k: base64.b64encode(rng.randbytes(k)).decode()
    hexa = lambda: take(hexes, rng.choice([32, 40, 40, 64]))
    keys = [
        hexa, hexa, lambda: b64(rng.randint(15, 60)), lambda: take(alnum, rng.randint(20, 64)), lambda: "AKIA" + take(alnum[:26] + alnum[52:], 16),
        lambda: "ghp_" + take(alnum, 36), lambda: "sk_live_" + take(alnum, 24), lambda: f"xoxb-{take(hexes[:10], 12)}-{take(alnum, 24)}", lambda: take(alnum, 43) + "=",
    ]
    passwords = [
        lambda: take(alnum[26:52], rng.randint(12, 24)), lambda: take(alnum + "!@#$%&*?", rng.randint(10, 20)),
        lambda: "".join(row[: rng.randint(5, 10)] for row in rng.sample(KEYBOARD, 3)), lambda: rng.choice(words) + take("!@#$%&*?0123456789", rng.randint(4, 8)),
    ]
    follow: dict[str, list[str]] = {}
    for w in words:
        for x, y in zip(w, w[1:]):
            follow.setdefault(x, []).append(y)

    def invented(k: int) -> str:
        """A string of ``k`` letters that follow each other as in words."""
        out = rng.choice(words)[0]
        while len(out) < k:
            out += rng.choice(follow[out[-1]])
        return out

    names = ["token", "secret", "api_key", "apikey", "password", "auth_token", "access_token", "client_secret", "AWS_SECRET_ACCESS_KEY", "aws_access_key_id", "credentials", "key"]
    plain = ["name", "title", "lang", "format", "theme", "label", "column", "kind", "encoding", "path", "topic"]
    signs = [' = "{}"', '="{}"', ": {}", "={}", ' : "{}",', " {}", "='{}';"]
    quoted = [' = "{}"', '="{}"', ': "{}"', "='{}';", " = '{}'"]
    word, title = lambda: rng.choice(words), lambda: rng.choice(words).title()
    prose = lambda: " ".join(rng.choice([word, lambda: invented(rng.randint(2, 9))])() for _ in range(rng.randint(0, 8)))
    named = lambda value: rng.choice(names) + rng.choice(signs).format(value)
    others = [
        lambda: rng.choice(["commit", "sha256", "sha1", "checksum", "md5", "integrity", "etag", "digest", "revision", "blob"]) + rng.choice(signs).format(rng.choice([hexa, hexa, lambda: "sha512-" + b64(64)])()),
        lambda: rng.choice([prose, lambda: "uuid =", lambda: "id:"])() + " " + str(uuid.UUID(bytes=rng.randbytes(16))),
        lambda: named(rng.choice(["your_{}_goes_here_1", "YOUR-{}-HERE-12345", "example_{}_0123456789", "xxxxxxxxxxxxxxxx{}1", "0123456789abcdef{}", "changeme_{}_changeme1", "dummy-{}-1234567890"]).format(word())),
        lambda: named(rng.choice(["a1", "0", "x1", "abc1", "1234"]) * rng.randint(8, 16)),
        lambda: prose() + " " + word() + "".join(title() for _ in range(rng.randint(2, 4))) + rng.choice(["", "2"]),
        lambda: prose() + " " + rng.choice("_-/").join(word() for _ in range(rng.randint(3, 5))) + rng.choice(["", "_1", "_v2"]),
        lambda: prose() + " /" + "/".join(word() for _ in range(rng.randint(3, 6))) + rng.choice(["", "/2", "/v1"]),
        lambda: named("".join(title() for _ in range(rng.randint(3, 5))) + rng.choice(["", "1"])),
        lambda: prose() + " " + take("0123456789", rng.randint(16, 24)),
        lambda: prose() + " " + f"20{take(hexes[:10], 2)}-0{rng.randint(1, 9)}-1{rng.randint(0, 9)}T{take(hexes[:10], 2)}-{take(hexes[:10], 2)}",
        lambda: prose() + " " + rng.choice([str, str.title, str.upper])(invented(rng.randint(16, 28))) + rng.choice(["", "1", "42", "Th"]),
        lambda: prose() + " " + "-".join(invented(rng.randint(4, 9)) for _ in range(rng.randint(3, 5))),
        lambda: prose() + " " + rng.choice("-_=+/") * rng.randint(16, 60),
        lambda: rng.choice(plain) + rng.choice(quoted).format(rng.choice([word, lambda: f"{word()}-{word()}", lambda: invented(rng.randint(8, 20)), lambda: f"{word()}.{word()}/{word()}"])()),
        lambda: rng.choice(names) + rng.choice(quoted).format(rng.choice([f"{word()}_{word()}_{word()}", f"${{{word()}}}", f"<your-{word()}>", "changeme123", "xxxxxxxxxx", "**********"])),
        lambda: rng.choice(["example_", "sample_", "dummy-", "fake_"]) + named(rng.choice(keys)()),
        lambda: prose() + " " + rng.choice(["_".join(word().upper() for _ in range(rng.randint(3, 5))), "AWS_SECRET_ACCESS_KEY", "GITHUB_ACCESS_TOKEN_NAME"]) + rng.choice(["=", "= ", "", " is", "\n"]),
        lambda: rng.choice(names[:6]) + rng.choice([": ", "=", " = "]) + rng.choice([word, lambda: f"{word()}_{word()}", lambda: f"{word()}.{word()}", lambda: "required", lambda: "undefined"])(),
        lambda: f"{rng.choice(['http', 'https', 'redis'])}://{word()}:{rng.choice(['password', 'your-password', 'example1', 'changeme', 'xxxxxxxx'])}@{word()}.example.com",
    ]
    paths = ["src/app/config.py", "deploy/values.yaml", "README.md", "lib/client.js", "src3", "docs/setup.md", "tests/fixtures/data.json", None]
    part = lambda k: base64.urlsafe_b64encode(rng.randbytes(k)).decode().rstrip("=")
    signed = lambda: f"eyJ{part(rng.randint(12, 30))}.eyJ{part(rng.randint(20, 90))}.{part(rng.choice([32, 48, 64]))}"

    def pem() -> str:
        body = b64(rng.choice([96, 192, 384, 600]))
        return f"-----BEGIN {rng.choice(['RSA ', 'EC ', 'OPENSSH ', ''])}PRIVATE KEY-----\n" + "\n".join(body[k : k + 64] for k in range(0, len(body), 64)) + "\n-----END"

    whole = [
        pem, lambda: rng.choice(["Bearer ", "token: ", "jwt = ", "Authorization: Bearer ", ""]) + signed(),
        lambda: f"{rng.choice(['postgres', 'mysql', 'amqp', 'https', 'mongodb'])}://{word()}:{rng.choice(passwords)()}@{rng.choice(['db', word()])}".replace("&", "").replace("?", ""),
        lambda: rng.choice(names[:6]) + rng.choice([": ", "=", " = "]) + rng.choice([lambda: take(alnum, rng.randint(8, 15)), lambda: f"{word()}{take(hexes[:10], 2)}{word()}{take(hexes[:10], rng.randint(1, 3))}", lambda: word() + take(hexes[:10], rng.randint(2, 5))])(),
    ]
    rows = []
    for i in range(n):
        if i % 8 == 3:
            rows.append((f"{prose()} {rng.choice(whole)()} {prose()}", rng.choice(paths[:6]), 1))
        elif i % 4 == 1:
            rows.append((f"{prose()} {rng.choice(names[:6])}{rng.choice(quoted).format(rng.choice(passwords)())} {prose()}", rng.choice(paths[:6]), 1))
        elif i % 2:
            rows.append((f"{prose()} {named(rng.choice(keys)())} {prose()}", rng.choice(paths[:6]), 1))
        else:
            rows.append((f"{rng.choice(others)()} {prose()}", rng.choice(paths), 0))
    return spark.createDataFrame(rows, "text string, path string, label int")


def train(findings: DataFrame, trees: int = 30, depth: int = 9, seed: int = 3):
    """A forest from ``findings(text, path, label)``; every candidate of a text has its label.

    Rows whose label is neither 0 nor 1, and texts without a candidate, teach nothing.
    """
    found = candidates(findings.where("label in (0, 1)").withColumn("doc_id", F.col("label")), path_col="path")
    table = found.select(F.col("doc_id").cast("double").alias("label"), *[x.alias(k) for k, x in features(found).items()])
    names = [c for c in table.columns if c != "label"]
    forest = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, featuresCol="_features", probabilityCol="_probability", rawPredictionCol="_raw", predictionCol="_prediction")
    return Pipeline(stages=[VectorAssembler(inputCols=names, outputCol="_features"), forest]).fit(table)


def _scored(docs: DataFrame, model, **columns) -> DataFrame:
    found = candidates(docs, **columns)
    made = features(found)
    return model.transform(found.withColumns(made)).withColumn("score", vector_to_array("_probability")[1]).drop(*made, "_features", "_raw", "_probability", "_prediction")


def scan(docs: DataFrame, model, threshold: float = 0.5, **columns) -> DataFrame:
    """``(doc_id, path, start, length, score, is_secret)``: one row for each place of a candidate.

    The value itself isn't shown.  Null and empty texts have no rows; repeated rows repeat
    theirs; texts of any length are split once; other columns are ignored; an empty table
    gives an empty result.
    """
    return _scored(docs, model, **columns).select("doc_id", "path", "start", F.length("candidate").alias("length"), F.round("score", 6).alias("score"), (F.col("score") >= threshold).alias("is_secret"))


def redact(docs: DataFrame, model, threshold: float = 0.5, mark: str = "[SECRET]", broadcast_bytes: int = 8 << 20, path_col: str = "source") -> DataFrame:
    """``docs`` with ``mark`` at every place in ``text`` judged to be a secret; all rows and columns stay.

    A text's judgements, one for each of its candidates in order, go to all tasks only if
    together they have fewer than ``broadcast_bytes``; otherwise the two sides are joined
    by a shuffle.  Rows are told apart by id, text and path.  Columns of any name go
    through unchanged.
    """
    key = ["doc_id", "text_key", "path"]
    secret = (F.col("score") >= threshold).alias("secret")
    found = cut(
        _scored(docs, model, path_col=path_col).select(*key, F.struct("k", secret).alias("at"))
        .groupBy(*key).agg(F.array_sort(F.collect_set("at")).alias("at"), F.bool_or("at.secret").alias("any")).where("any")
        .select(*[F.col(k).alias(f"_{k}") for k in key], F.transform("at", lambda x: x["secret"]).alias("_flags"))
    )
    size = found.agg(F.sum(F.size("_flags") + 64)).first()[0] or 0
    # The whole row travels in one column, so its names can't meet those used here.
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    row = lambda c: F.col("row").getField(c)
    marked = rows.join(
        F.broadcast(found) if size < broadcast_bytes else found,
        row("doc_id").cast("long").eqNullSafe(F.col("_doc_id")) & (F.xxhash64(row("text")) == F.col("_text_key")) & row(path_col).cast("string").eqNullSafe(F.col("_path")), "left",
    )
    m, g = _split(row("text"))
    rebuilt = let(F.struct(m.alias("m"), g.alias("g")), lambda x: F.concat(
        F.array_join(F.transform("_flags", lambda secret, k: F.concat(F.get(x["g"], k), F.when(secret, F.lit(mark)).otherwise(F.get(x["m"], k)))), ""), F.element_at(x["g"], -1),
    ))
    clean = F.when(F.col("_flags").isNull(), row("text")).otherwise(rebuilt)
    return marked.select(*[(clean if c == "text" else row(c)).alias(c) for c in docs.columns])


def op5_secrets(spark, sf_dir):
    """Every candidate of every document, scored."""
    return scan(table(spark, sf_dir, "documents"), train(default_findings(spark)))


QUERIES = {"op5_secrets": op5_secrets}
ORACLE_SQL = {}
