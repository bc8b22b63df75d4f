"""Language identification by prediction by partial matching.

Each language has a tree of byte contexts up to three bytes long.  A byte costs
-log2 of its share in the longest context seen; where it wasn't seen there, the
context's escape probability is paid and the next shorter context decides, down to a
uniform choice of 256.  With ``n`` symbols of ``d`` kinds counted in a context, a symbol
counted ``c`` times has probability ``c / (n + d)`` and the escape ``d / (n + d)``.  The
statistics stay as they were learned, so a text's code length is the exact sum of its
bytes' costs, and the language with the shortest code is predicted.

Learning counts byte 4-grams in Spark over a bounded sample of each language; the
trees follow from those.  Scoring is one scan: numpy walks all bytes of a block of texts
one context length at a time, for all languages at once.

The tables are dense and go to every task: about 1 KB for each context of three bytes and
8 bytes for each 4-gram and language, 22 MB for four languages of prose.  That suits some
tens of languages; hundreds with their own scripts would need tables of their own each.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, held_out, small_batches, table, utf8

ORDER = 3
PAD = b"\n" * ORDER  # what stands before a text
BLOCK_BYTES = 1 << 19


def gram_keys(data: np.ndarray) -> np.ndarray:
    """The four bytes that end at each place from the fourth on, first byte highest."""
    d = data.astype(np.uint32)
    return d[:-3] << 24 | d[1:-2] << 16 | d[2:-1] << 8 | d[3:]


def joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All texts with their padding, the places where a text's bytes stand, and its text."""
    data = np.frombuffer(b"".join(PAD + t for t in texts), np.uint8)
    size = np.array([len(t) for t in texts], np.int64)
    owner = np.repeat(np.arange(len(texts)), size)
    place = np.arange(size.sum()) + (owner + 1) * ORDER
    return data, place, owner


def count_grams(docs: DataFrame) -> DataFrame:
    """``(lang, gram, n)`` of ``docs(lang, text)``, counted in each batch before the shuffle."""

    def run(batches):
        for b in batches:
            langs = b.column(0).to_pylist()
            for lang in dict.fromkeys(langs):
                own = [utf8(t.as_py()) for k, t in zip(langs, b.column(1)) if k == lang]
                for _, texts in blocks(own, 200):
                    data, place, _ = joined(texts)
                    if len(place):
                        gram, n = np.unique(gram_keys(data)[place - ORDER], return_counts=True)
                        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(gram), pa.string()), pa.array(gram.astype(np.int64)), pa.array(n.astype(np.int64))], ["lang", "gram", "n"])

    return docs.mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


@dataclass
class Level:
    """Contexts of one length: each symbol's row of costs, or 0, and what an escape costs."""

    context: np.ndarray  # sorted keys of all contexts that some language has
    row: np.ndarray  # by context and byte
    cost: np.ndarray  # by row and language; nan: this language escapes
    escape: np.ndarray  # by context and language; 0 where the language lacks the context


class Model:
    """Trees of all languages over one numbering of contexts."""

    def __init__(self, counts: list[tuple[str, np.ndarray, np.ndarray]]):
        counts = sorted((lang, g, n) for lang, g, n in counts if len(g))
        self.langs = [lang for lang, _, _ in counts]
        self.levels = [self._level(counts, k) for k in range(ORDER + 1)]
        # Which context of three bytes ends at a place, by two steps through dense tables.
        pair = np.unique(self.levels[3].context >> 8) if self.langs else np.zeros(0, np.int64)
        self.pair = np.zeros(1 << 16, np.int32)
        self.pair[pair] = np.arange(1, len(pair) + 1)
        self.triple = np.zeros((len(pair) + 1, 256), np.int32)
        if self.langs:
            c = self.levels[3].context
            self.triple[self.pair[c >> 8], c & 255] = np.arange(1, len(c) + 1)
            # Any 4-gram that one language has is known in all of them, escapes included.
            node, symbol = np.nonzero(self.levels[ORDER].row)
            full = self._escaping(node, c[node - 1], symbol)
            self.known = np.zeros((len(full) + 1, len(self.langs)), np.float32)
            self.known[self.levels[ORDER].row[node, symbol]] = full

    def _level(self, counts, k: int) -> Level:
        keys, numbers = [], []
        for _, gram, n in counts:
            key, back = np.unique(gram & ((1 << 8 * (k + 1)) - 1), return_inverse=True)
            keys.append(key)
            numbers.append(np.bincount(back, n))
        every = np.unique(np.concatenate(keys or [np.zeros(0, np.int64)]))
        context, at = np.unique(every >> 8, return_inverse=True)
        row = np.zeros((len(context) + 1, 256), np.int32)
        row[at + 1, every & 255] = np.arange(1, len(every) + 1)
        cost = np.full((len(every) + 1, len(counts)), np.nan, np.float32)
        escape = np.zeros((len(context) + 1, len(counts)), np.float32)
        for j, (key, n) in enumerate(zip(keys, numbers)):
            where = np.searchsorted(every, key)
            total, kinds = np.bincount(at[where], n, len(context)), np.bincount(at[where], minlength=len(context))
            cost[where + 1, j] = np.log2((total + kinds)[at[where]] / n)
            has = kinds > 0
            escape[1:, j][has] = np.log2((total + kinds)[has] / kinds[has])
        return Level(context, row, cost, escape)

    def _escaping(self, node: np.ndarray, context: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """Bits of each symbol in each language, from the longest context down."""
        top = self.levels[ORDER]
        bits = top.cost[top.row[node, symbol]]
        left = np.isnan(bits)
        bits = np.where(left, top.escape[node], bits)
        for k in range(ORDER - 1, -1, -1):
            level = self.levels[k]
            key = context & ((1 << 8 * k) - 1)
            at = np.searchsorted(level.context, key)
            at[at == len(level.context)] = 0
            node = np.where(level.context[at] == key, at + 1, 0)
            more = level.cost[level.row[node, symbol]]
            ends = left & ~np.isnan(more)
            bits += np.where(ends, more, np.where(left, level.escape[node], 0))
            left &= ~ends
        return bits + np.where(left, 8.0, 0)

    def costs(self, data: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Bits of each byte at ``place`` in each language."""
        symbol = data[place]
        a, b, c = data[place - 3], data[place - 2], data[place - 1]
        node = self.triple[self.pair[a.astype(np.int32) << 8 | b], c]
        row = self.levels[ORDER].row[node, symbol]
        bits = self.known[row]
        open_ = np.flatnonzero(row == 0)  # new to all languages
        if len(open_):
            context = a[open_].astype(np.int64) << 16 | b[open_].astype(np.int64) << 8 | c[open_]
            bits[open_] = self._escaping(node[open_], context, symbol[open_])
        return bits

    def code_lengths(self, texts: list[bytes]) -> np.ndarray:
        """Bits of each whole text in each language."""
        total = np.zeros((len(texts), len(self.langs)))
        if not self.langs:
            return total
        data, place, owner = joined(texts)
        for at in range(0, len(place), BLOCK_BYTES):
            bits, own = self.costs(data, place[at : at + BLOCK_BYTES]), owner[at : at + BLOCK_BYTES]
            first = np.r_[0, np.flatnonzero(own[1:] != own[:-1]) + 1]
            total[own[first]] += np.add.reduceat(bits, first, axis=0, dtype=np.float64)
        return total


def learn(docs: DataFrame, max_train: int = 2000) -> Model:
    """Trees from ``docs(doc_id, text, lang)``.

    Each language learns from about ``max_train`` of its documents, chosen by a hash of
    the id, and from all of them where it has fewer.  Rows without text, language or id
    teach nothing.  The counts of that bounded sample are what comes to the driver.
    """
    usable = docs.where("text is not null and lang is not null and doc_id is not null")
    share = usable.groupBy("lang").count().select("lang", F.least(F.lit(1.0), F.lit(float(max_train)) / F.col("count")).alias("share")).collect()  # one row a language
    chance = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) / float(1 << 20)
    if not share:
        return Model([])
    limit = F.create_map(*[F.lit(x) for r in share for x in (r.lang, r.share)])[F.col("lang")]
    sample = usable.where(chance < limit).select("lang", "text")
    got = count_grams(sample).toArrow().sort_by([("lang", "ascending"), ("gram", "ascending")])
    lang, gram, n = got["lang"].to_numpy(), got["gram"].to_numpy(), got["n"].to_numpy()
    first = np.flatnonzero(np.r_[True, lang[1:] != lang[:-1]]) if len(lang) else np.zeros(0, int)
    return Model([(str(lang[a]), gram[a:b], n[a:b]) for a, b in zip(first, np.r_[first[1:], len(lang)])])


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, lang_pred, score)`` for every row of ``docs``.

    ``score`` is the share of the predicted language in the likelihoods of all, equal
    priors.  Equal code lengths go to the language first by name.  A text that is null
    or has no letter is ``und`` with score 0, as is every text under a model that learned
    nothing.  Texts of any length are scored whole, a block of bytes at a time.  Null ids
    stay, repeated rows repeat, other columns are ignored, an empty table gives no rows.
    """

    def run(batches):
        for b in batches:
            pred, score = [], []
            raw = b.column(1).to_pylist()
            size, group = 0, []

            def flush():
                bits = model.code_lengths([utf8(t) for t in group])
                for t, x in zip(group, bits):
                    if t and len(x) and any(map(str.isalpha, t)):
                        best = int(x.argmin())
                        pred.append(model.langs[best])
                        score.append(float(1 / np.exp2(np.maximum(x[best] - x, -60)).sum()))
                    else:
                        pred.append("und")
                        score.append(0.0)

            for t in raw:
                group.append(t)
                size += len(t or "")
                if size > BLOCK_BYTES:
                    flush()
                    size, group = 0, []
            flush()
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(pred, pa.string()), pa.array(score, pa.float64())], ["doc_id", "lang_pred", "score"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, lang_pred string, score double")


def op1_language(spark, sf_dir):
    """Contract: learn from rows that aren't held out, predict every whole text."""
    small_batches(spark)
    docs = table(spark, sf_dir, "documents")
    model = learn(docs.where(~held_out()))
    return identify(docs, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


QUERIES = {"op1_language": op1_language}
ORACLE_SQL = {}
