"""Language-model scoring by cross-entropy difference.

Two bigram models, of a target and of the background, have the same vocabulary (a
public tokenizer's), order and smoothing.  A document's score is the mean over its
tokens of the loss under the target less the loss under the background: the lower, the
more the document is like the target.  A document is left out of the model that counted
it: its own counts are taken off before it is scored.

All documents are tokenized once and counted.  Counts of token pairs are exact and stay
a Spark table that grows with the corpus.  The commonest pairs, at most ``max_pairs``,
and the counts of single tokens, as many as the vocabulary has, go to every task; losses
of all other pairs are found by a join of each document's rare pairs with that table.
Both ways give the same figures, so where the line between them lies changes no result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_bytes, checked, cut, small_batches, table
from .packing import vocabulary, word_ids

MAX_PAIRS = 1 << 20
PULL = 8.0  # how many tokens' weight the shorter context has
CHUNK = 1 << 21  # tokens counted together before a task hands them on
TARGET, BACKGROUND = 0, 1


def vocabulary_size(tokenizer: str) -> int:
    """Tokens, and one more that stands before a text."""
    return word_ids(tokenizer).tokenizer.get_vocab_size() + 1


def tokenize(docs: DataFrame, target_ids: DataFrame, tokenizer: str) -> DataFrame:
    """``(row, doc_id, side, ids)`` of every row of ``docs(doc_id, text)``, materialised.

    ``side`` is 0 for documents whose id is in ``target_ids(doc_id)`` and 1 for all
    others, null ids too.  ``row`` numbers rows, repeated ones apart; ``ids`` are the
    token ids as 16- or 32-bit words, none for a null or empty text.
    """
    ids = target_ids.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id")).distinct().withColumn("target", F.lit(TARGET))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(checked(ids), "doc_id", "left").select("doc_id", F.coalesce("target", F.lit(BACKGROUND)).alias("side"), "text")
    kind = _kind(vocabulary_size(tokenizer))

    def run(batches):
        words, row = word_ids(tokenizer), TaskContext.get().partitionId() << 40
        for b in batches:
            for at, texts in by_bytes(b.column(2).to_pylist()):
                made = [np.frombuffer(words.ids(t or ""), "<u4").astype(kind).tobytes() for t in texts]
                yield pa.RecordBatch.from_arrays([pa.array(range(row, row + len(texts)), pa.int64()), b.column(0).slice(at, len(texts)), b.column(1).slice(at, len(texts)), pa.array(made, pa.binary())], ["row", "doc_id", "side", "ids"])
                row += len(texts)

    return cut(rows.mapInArrow(run, "row long, doc_id long, side int, ids binary"))


def _kind(size: int) -> str:
    return "<u2" if size <= 1 << 16 else "<u4"


def _flat(ids: list[bytes], size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tokens of all texts, the token before each and the number of tokens of each text."""
    n = np.array([len(x) for x in ids], np.int64) // np.dtype(_kind(size)).itemsize
    token = np.frombuffer(b"".join(ids), _kind(size)).astype(np.int64)
    before = np.r_[size - 1, token[:-1]] if len(token) else token
    before[(np.cumsum(n) - n)[n > 0]] = size - 1
    return token, before, n


def _groups(ids: list[bytes], most: int):
    """Slices of ``ids`` of about ``most`` bytes, one text at least."""
    first, held = 0, 0
    for i, x in enumerate(ids):
        if i > first and held + len(x) > most:
            yield first, i
            first, held = i, 0
        held += len(x)
    if first < len(ids):
        yield first, len(ids)


@dataclass
class Models:
    """Exact counts: of tokens and contexts by side, of the commonest pairs, and the table of the others."""

    size: int
    token: np.ndarray  # by side and token
    context: np.ndarray
    pairs: np.ndarray  # sorted keys
    counts: np.ndarray  # by side and pair
    rare: DataFrame | None  # (pair, target, background)

    def parts(self, ids: list[bytes], side: np.ndarray, leave_out: bool):
        """For each text and each of its different pairs, what its loss follows from."""
        token, before, n = _flat(ids, self.size)
        owner = np.repeat(np.arange(len(ids)), n)
        key, back = np.unique(before << 32 | token, return_inverse=True)
        own, times = np.unique(owner * max(1, len(key)) + back, return_counts=True)
        text, pair = own // max(1, len(key)), key[own % max(1, len(key))]
        made = []
        for part, total in ((pair & 0xFFFFFFFF, self.token), (pair >> 32, self.context)):
            every = token if total is self.token else before
            some, count = np.unique(owner * self.size + every, return_counts=True)
            made.append((part, total, count[np.searchsorted(some, text * self.size + part)]))
        out = []
        for k in (TARGET, BACKGROUND):
            mine = ((side[text] == k) & leave_out).astype(np.float64)
            (tok, tokens, own_t), (ctx, contexts, own_c) = made
            one = (tokens[k][tok] - mine * own_t + 0.5) / (tokens[k].sum() - mine * n[text] + 0.5 * self.size)
            out.append((PULL * one, contexts[k][ctx] - mine * own_c + PULL, mine * times))
        return n, text, pair, times, out


def learn(tokens: DataFrame, tokenizer: str, max_pairs: int = MAX_PAIRS) -> Models:
    """Models from what ``tokenize`` made; every row counts, repeated ones each time."""
    size = vocabulary_size(tokenizer)

    def run(batches):
        held, some = 0, []

        def counted():
            key, n = np.unique(np.concatenate(some), return_counts=True)
            some.clear()
            side = (key & 1) == TARGET
            return pa.RecordBatch.from_arrays([pa.array(key >> 1), pa.array(np.where(side, n, 0)), pa.array(np.where(side, 0, n))], ["pair", "target", "background"])

        for b in batches:
            ids, side = b.column(1).to_pylist(), b.column(0).to_numpy().astype(np.int64)
            for i, j in _groups(ids, CHUNK):
                token, before, n = _flat(ids[i:j], size)
                some.append((before << 32 | token) << 1 | np.repeat(side[i:j], n))
                held += len(token)
                if held > CHUNK:
                    yield counted()
                    held = 0
        if held:
            yield counted()

    total = (F.col("target") + F.col("background")).alias("total")
    sums = [F.sum("target").alias("target"), F.sum("background").alias("background")]
    counts = cut(tokens.select("side", "ids").mapInArrow(run, "pair long, target long, background long").groupBy("pair").agg(*sums))

    def single(name):
        got = counts.groupBy(name.alias("id")).agg(*sums).toArrow()  # at most one row a token
        out = np.zeros((2, size))
        for k, side in enumerate(("target", "background")):
            out[k][got["id"].to_numpy()] = got[side].to_numpy()
        return out

    # The smallest power of two that no more than max_pairs pairs reach.
    levels = counts.select(F.floor(F.log2(total)).alias("level")).groupBy("level").count().orderBy(F.desc("level")).collect()  # a row a power of two
    least, seen = (levels[0].level + 1 if levels else 0), 0
    for r in levels:
        if seen + r["count"] > max_pairs:
            break
        least, seen = r.level, seen + r["count"]
    top = counts.where(total >= 2**least).toArrow().sort_by("pair")
    rare = counts.where(total < 2**least) if seen < sum(r["count"] for r in levels) else None
    return Models(
        size, single(F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF))), single(F.shiftright("pair", 32)), top["pair"].to_numpy(),
        np.stack([top[c].to_numpy() for c in ("target", "background")]).astype(np.float64), rare,
    )


def score(tokens: DataFrame, models: Models, leave_out: bool = True) -> DataFrame:
    """``(doc_id, n_tokens, target_loss, background_loss, score)`` for every row of what ``tokenize`` made.

    Losses are bits a token; a null or empty text has no tokens, losses 0 and score 0.
    ``leave_out`` takes a row's own counts off the model of its side, as is right for rows
    that the models learned from.  Null ids stay, repeated rows repeat and leave only
    themselves out; very long texts are scored whole; an empty table gives no rows.
    """
    rare, models.rare = models.rare, None
    light = models
    names = ["row", "doc_id", "n_tokens", "pair", "side", "a", "b", "c", "d"]

    def run(batches):
        for b in batches:
            ids, sides = b.column(3).to_pylist(), b.column(2).to_numpy().astype(np.int64)
            for i, j in _groups(ids, 1 << 20):
                n, text, pair, times, parts = light.parts(ids[i:j], sides[i:j], leave_out)
                at = np.minimum(np.searchsorted(light.pairs, pair), max(0, len(light.pairs) - 1))
                known = light.pairs[at] == pair if len(light.pairs) else np.zeros(len(pair), bool)
                loss = []
                for k, (pull, below, mine) in enumerate(parts):
                    own = (light.counts[k][at[known]] - mine[known] + pull[known]) / below[known]
                    loss.append(np.bincount(text[known], -times[known] * np.log2(own), j - i).astype(np.float64))
                rows = b.slice(i, j - i)
                none = pa.nulls(j - i, pa.int64())
                yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array(n), none, rows.column(2), *map(pa.array, loss), *[pa.nulls(j - i, pa.float64())] * 2], names)
                if (rest := np.flatnonzero(~known)).size:
                    (p0, b0, _), (p1, b1, _) = parts
                    more = [pa.array(x[rest]) for x in (times, pair)]
                    yield pa.RecordBatch.from_arrays(
                        [rows.column(0).take(pa.array(text[rest])), pa.nulls(len(rest), pa.int64()), *more, pa.array(sides[i:j][text[rest]].astype(np.int32)), *[pa.array(x[rest]) for x in (p0, b0, p1, b1)]], names,
                    )

    made = cut(tokens.select("row", "doc_id", "side", "ids").mapInArrow(run, "row long, doc_id long, n_tokens long, pair long, side int, a double, b double, c double, d double"))
    models.rare = rare
    own = made.where("pair is null").select("row", "doc_id", "n_tokens", "a", "b")
    if rare is not None:
        n = F.col("n_tokens")
        mine = lambda side: F.when((F.col("side") == side) & F.lit(leave_out), n).otherwise(0)
        bits = lambda count, side, pull, below: F.sum(-n * F.log2((F.coalesce(count, F.lit(0)) - mine(side) + pull) / below))
        more = (
            made.where("pair is not null").join(rare, "pair", "left").groupBy("row")
            .agg(bits(F.col("target"), TARGET, F.col("a"), F.col("b")).alias("more_a"), bits(F.col("background"), BACKGROUND, F.col("c"), F.col("d")).alias("more_b"))
        )
        own = own.join(more, "row", "left").withColumns({"a": F.col("a") + F.coalesce("more_a", F.lit(0.0)), "b": F.col("b") + F.coalesce("more_b", F.lit(0.0))})
    size = F.greatest(F.col("n_tokens"), F.lit(1))
    losses = own.select("doc_id", "n_tokens", (F.col("a") / size).alias("target_loss"), (F.col("b") / size).alias("background_loss"))
    return losses.withColumn("score", F.col("target_loss") - F.col("background_loss"))


def op2_loss(spark, sf_dir):
    """All documents, with those labelled good as the target."""
    small_batches(spark)
    good = table(spark, sf_dir, "labels").where("quality = 1")
    tokens = tokenize(table(spark, sf_dir, "documents"), good, vocabulary())
    return score(tokens, learn(tokens, vocabulary()))


QUERIES = {"op2_loss": op2_loss}
ORACLE_SQL = {}
