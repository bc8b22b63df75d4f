"""Spelling variants: words one inserted, deleted or replaced code point apart, by rolling-hash deletions.

Two words are one edit apart exactly if one is the other without a code point, or both
without the code point at one place are the same string.  So every word gets a key for
itself and one for each of its deletions.  Keys are polynomial hashes: a prefix's and a
suffix's hash give that of the string without what lies between, for all places of all
words of a batch at once, as running sums in numpy.  Deleting any letter of a run of
equal ones gives the same string, so a run has one key and the range of its places.

Integer keys are dealt to tasks by their upper bits and sorted there; only keys that
several words share are kept.  Those meet their strings, and the strings decide.

No pairs of words are emitted: under a deleted string, the string itself, if it is a
word, is near all words that give it, and words that lose the code point at the same
place are near each other, so each of them gets how many there are and the best one.
A place has at most as many such words as the alphabet has letters.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_bytes, cut, small_batches, table

#: Fixed values of the contract: which runs of letters are words.
RUN = r"[A-Za-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
KEYS = "key long, wid long, lo int, hi int"


def low(c):
    """A-Z as small letters, all else as it is."""
    return F.when(F.octet_length(c) == F.length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def words(docs: DataFrame, least_letters: int = 5, least: int = 3, every: int = 97, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(word, n)``: how often each run of letters occurs in all texts.

    Of a run whose crc32, with its document's id ahead, ``every`` divides, one code point
    is deleted, as misspellings are made to be found again.  Only results of at least
    ``least_letters`` code points and ``least`` occurrences stay.  Null texts have no
    runs; a null id counts as an empty one.
    """
    runs = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all(F.col(text_col), F.lit(RUN), F.lit(0))).alias("run")).withColumn("run", low(F.col("run")))
    run, h = F.col("run"), F.col("h")
    hashed = runs.withColumn("h", F.crc32(F.concat("id", F.lit(":"), run).cast("binary")))
    place = (h % F.length(run)).cast("int")
    word = F.when(h % every == 0, F.concat(F.substr(run, F.lit(1), place), F.substr(run, place + 2))).otherwise(run)
    return hashed.select(word.alias("word")).where(F.length("word") >= least_letters).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def deletion_keys(some: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``(key, word, lo, hi)``: each word's own key (``lo`` = ``hi`` = -1), and one for each run of equal code points.

    ``word`` is a place in ``some``; ``lo`` to ``hi`` are the places whose deletion gives the string.
    """
    n = np.array([len(w) for w in some], np.int64)
    code = np.frombuffer("".join(some).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64) + np.uint64(1)
    end = np.cumsum(n)
    start = end - n
    with np.errstate(over="ignore"):
        power = np.cumprod(np.r_[np.uint64(1), np.full(len(code), BASE)], dtype=np.uint64)
        back = np.cumprod(np.r_[np.uint64(1), np.full(len(code), INVERSE)], dtype=np.uint64)
        upto = np.r_[np.uint64(0), np.cumsum(code * power[:-1], dtype=np.uint64)]
        own = (upto[end] - upto[start]) * back[start]
        word = np.repeat(np.arange(len(some)), n)
        at = np.arange(len(code))
        first = np.r_[True, code[1:] != code[:-1]] if len(code) else np.zeros(0, bool)
        first[start[n > 0]] = True
        lo = np.flatnonzero(first)
        hi = np.r_[lo[1:], len(code)] - 1 if len(lo) else lo
        word, at = word[lo], at[lo]
        s, e = start[word], end[word]
        prefix = (upto[at] - upto[s]) * back[s]
        suffix = (upto[e] - upto[at + 1]) * back[s + 1]
        key = np.r_[own, prefix + suffix] + np.r_[n, n[word] - 1].astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
        # Upper bits deal keys to tasks, so they have to depend on all.
        key ^= key >> np.uint64(32)
        key *= np.uint64(0xD6E8FEB86659FD93)
        key ^= key >> np.uint64(32)
        key *= np.uint64(0xD6E8FEB86659FD93)
    none = np.full(len(some), -1)
    return key.view(np.int64), np.r_[np.arange(len(some)), word], np.r_[none, lo - s], np.r_[none, hi - s]


def keyed(vocabulary: DataFrame) -> DataFrame:
    """``(key, wid, lo, hi)`` of all ``vocabulary(wid, word)``."""

    def run(batches):
        for b in batches:
            for at, some in by_bytes(b.column(1).to_pylist(), rows=1 << 14):
                key, word, lo, hi = deletion_keys(some)
                ids = b.column(0).to_numpy()[at : at + len(some)]
                for i in range(0, len(key), 1 << 16):
                    j = slice(i, i + (1 << 16))
                    yield pa.RecordBatch.from_arrays([pa.array(key[j]), pa.array(ids[word[j]]), pa.array(lo[j].astype(np.int32)), pa.array(hi[j].astype(np.int32))], ["key", "wid", "lo", "hi"])

    return vocabulary.select("wid", "word").mapInArrow(run, KEYS)


def _dealt(rows: DataFrame, *order: str) -> DataFrame:
    """``rows`` dealt by their keys' upper bits and sorted by key in each task."""
    return rows.repartition(F.expr("shiftrightunsigned(key, 40)")).sortWithinPartitions("key", *order)


def shared(keys: DataFrame) -> DataFrame:
    """The rows whose key another word has too."""

    def run(batches):
        held = None

        def kept(b, last):
            """Whole runs of ``b`` that have two rows or more, and the rows of its last run unless it is the ``last`` batch."""
            key, wid = b.column(0).to_numpy(), b.column(1).to_numpy()
            first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            stop = len(key) if last else first[-1]
            # A key's rows come by word, so a run of one word has the same word at both ends.
            ends = np.r_[first[1:], len(key)]
            many = np.repeat(wid[first] != wid[ends - 1], ends - first)[:stop]
            return b.take(pa.array(np.flatnonzero(many))), None if last else b.slice(stop)

        for b in batches:
            if not b.num_rows:
                continue
            if held is not None:
                b = pa.Table.from_batches([held, b]).combine_chunks().to_batches()[0]
            out, held = kept(b, False)
            if out.num_rows:
                yield out
        if held is not None:
            out, _ = kept(held, True)
            if out.num_rows:
                yield out

    return _dealt(keys, "wid").mapInArrow(run, KEYS)


def near_in(rows: list[tuple[int, int, int, str, int]]):
    """``(wid, near, best word, its n)`` from all ``(wid, lo, hi, word, n)`` under one key.

    Strings are compared, so words that share only the key aren't near.
    """
    under = defaultdict(list)
    for wid, lo, hi, word, n in rows:
        under[word if lo < 0 else word[:lo] + word[lo + 1 :]].append((wid, lo, hi, word, n))
    for members in under.values():
        if len(members) < 2:
            continue
        whole = [m for m in members if m[1] < 0]
        others = sorted([m for m in members if m[1] >= 0], key=lambda m: (-m[4], m[3]))
        if whole and others:
            (wid, _, _, word, n), top = whole[0], others[0]
            yield wid, len(others), top[3], top[4]
            for m in others:
                yield m[0], 1, word, n
        places = defaultdict(list)
        for m in others:
            for at in range(m[1], m[2] + 1):
                places[at].append(m)
        for same in places.values():
            if len(same) > 1:
                for k, m in enumerate(same):
                    top = same[0] if k else same[1]
                    yield m[0], len(same) - 1, top[3], top[4]


def near(vocabulary: DataFrame) -> DataFrame:
    """``(wid, n_near, form, form_n)`` for the words of ``vocabulary(wid, word, n)`` that have near ones.

    ``form`` is the near word with the largest n, of those the smallest in code-point order.
    """
    strung = shared(keyed(vocabulary)).join(vocabulary, "wid").select("key", "wid", "lo", "hi", "word", "n")

    def run(batches):
        last, held = None, []
        made: list[tuple] = []

        def batch():
            columns = [pa.array(c, k) for c, k in zip(zip(*made), (pa.int64(), pa.int64(), pa.string(), pa.int64()))]
            made.clear()
            return pa.RecordBatch.from_arrays(columns, ["wid", "near", "best", "best_n"])

        for b in batches:
            for key, *row in zip(*[c.to_pylist() for c in b.columns]):
                if key != last:
                    made.extend(near_in(held))
                    last, held = key, []
                    if len(made) > 1 << 14:
                        yield batch()
                held.append(row)
        made.extend(near_in(held))
        if made:
            yield batch()

    found = _dealt(strung).mapInArrow(run, "wid long, near long, best string, best_n long")
    best = F.min(F.struct((-F.col("best_n")).alias("less"), "best"))
    return found.groupBy("wid").agg(F.sum("near").alias("n_near"), best.alias("top")).select("wid", "n_near", F.col("top.best").alias("form"), (-F.col("top.less")).alias("form_n"))


def roots(forms: DataFrame) -> DataFrame:
    """``(word, root)`` for all ``forms(word, form)``: the end of each chain, whose length is halved in every round."""
    state = cut(forms.select("word", F.col("form").alias("root")))
    while True:
        ahead = state.select(F.col("word").alias("root"), F.col("root").alias("next"))
        # A form has twice the occurrences of its word, so chains end.
        moved = cut(state.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("went")))
        state = moved.select("word", "root")
        if moved.where("went").isEmpty():
            return state


def group_variants(docs: DataFrame, ratio: int = 2, **options) -> DataFrame:
    """``(word, form, root, n, n_near, form_n)`` for every word of ``docs``.

    ``form`` is the commonest near word if it occurs at least ``ratio`` (2 or more) times
    as often, ``root`` where following forms ends.  Null and empty texts have no words;
    repeated rows count each time; a tie goes to the smallest word in code-point order;
    texts and words of any length are taken whole; other columns are ignored; an empty
    table gives no rows.  ``options`` are those of ``words``.
    """
    vocabulary = cut(words(docs, **options).withColumn("wid", F.monotonically_increasing_id()))
    has = F.col("form_n") >= ratio * F.col("n")
    joined = cut(
        vocabulary.join(near(vocabulary), "wid", "left")
        .select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(has, F.col("form")).alias("form"), F.when(has, F.col("form_n")).alias("form_n"))
    )
    return joined.join(roots(joined.where("form is not null")), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op13_spelling(spark, sf_dir):
    """Contract: all documents."""
    small_batches(spark)
    return group_variants(table(spark, sf_dir, "documents"))


QUERIES = {"op13_spelling": op13_spelling}
ORACLE_SQL = {}
