"""Cross-tokenizer alignment: which tokens of one vocabulary cover which of another.

Both tokenizers write the same bytes.  Where a token of each ends at the same byte, the
text is cut; tokens between two cuts are a group, and every token of A in a group is
linked to every token of B in it.  Over a batch of texts laid end to end, the ends are
one cumulative sum a side, the cuts their intersection, the groups a binary search, and
the links a repeat of each token of A by its group's tokens of B.

How many documents hold a pair of ids linked is counted by a salted shuffle in two
stages.  A document's different pairs are kept packed beside its row, so texts are
tokenized once.  The counts of the commonest pairs, at most ``max_pairs``, go to every
task; all others meet their counts in a join that deals frequent pairs over tasks.  Both
ways give the same figures.
"""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_bytes, cut, join_one, small_batches, table
from .packing import vocabulary

MAX_PAIRS = 1 << 20
LINKS = 1 << 22  # links spread out at a time
CHUNK = 1 << 21  # pairs counted together before a task hands them on
SALTS = 16
ROW = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, groups string, n_pairs long, pairs binary"


class Side:
    """One tokenizer: ``encode(texts)`` gives an array of ids each, ``tokens`` each id's bytes."""

    def __init__(self, tokens: list[bytes], encode):
        self.tokens, self.encode, self.size = tokens, encode, len(tokens)
        self.lengths = np.array([len(t) for t in tokens], np.int64)
        # An id written out with what follows it: a comma, or the mark at a group's end.
        self.written = {end: np.array([[f"{i}{mark}".encode() for i in range(self.size)] for mark in ("," + end)], object) for end in "|;"}

    def bytes(self, ids) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids.tolist()))


def byte_level(path: str) -> Side:
    """A byte-level vocabulary file; special tokens' strings are plain text.

    The file's entries are ranked by their ids, as its merges are, so the faster of the
    two libraries that read such vocabularies gives the same ids.
    """
    import public_tokenizers
    import tiktoken

    with open(path, encoding="utf-8") as f:
        made = json.load(f)
    special = {x["content"]: x["id"] for x in made["added_tokens"]}
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    moved = iter(range(256, 512))
    back = {chr(b if b in plain else next(moved)): b for b in range(256)}
    ranks = {bytes(back[c] for c in t): i for t, i in made["model"]["vocab"].items() if t not in special}
    tokens = [b""] * (1 + max([*ranks.values(), *special.values()]))
    for t, i in [*ranks.items(), *[(t.encode(), i) for t, i in special.items()]]:
        tokens[i] = t
    coder = tiktoken.Encoding("a", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return Side(tokens, lambda texts: [np.array(coder.encode_ordinary(" " + t), np.int64) for t in texts])


def pieces(path: str) -> Side:
    """A piece vocabulary: U+2581 stands for a space, ``<0xHH>`` for a byte."""
    import sentencepiece

    coder = sentencepiece.SentencePieceProcessor(model_file=path)
    names = [coder.id_to_piece(i) for i in range(coder.get_piece_size())]
    tokens = [bytes([int(p[3:5], 16)]) if coder.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(names)]
    return Side(tokens, lambda texts: [np.array(x, np.int64) for x in coder.encode(texts, num_threads=1)])


@cache
def sides(a: str, b: str) -> tuple[Side, Side]:
    """Both tokenizers, read once in a Python worker."""
    return byte_level(a), pieces(b)


def summed(key: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each different key in order, and the sum of its ``times``."""
    order = np.argsort(key, kind="stable")
    key, times = key[order], times[order]
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
    return key[first], np.add.reduceat(times, first) if len(first) else times


def crossed(group_a, a, group_b, b, times_a, times_b, key_of, most: int = LINKS) -> tuple[np.ndarray, np.ndarray]:
    """``summed`` keys of all links; both sides are ordered by group.

    ``key_of(i, j)`` makes a link's key of a place on each side.  At most ``most`` links,
    or those of one token of A, are spread out at once.
    """
    in_b = np.bincount(group_b, minlength=(group_a[-1] + 1) if len(group_a) else 0)
    start_b = np.cumsum(in_b) - in_b
    times = in_b[group_a]
    ends = np.cumsum(times)
    kept: list[tuple] = []
    held = first = 0
    while first < len(a):
        done = ends[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(ends, done + most, "right")))
        n = times[first:last]
        i = np.repeat(np.arange(first, last), n)
        j = np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(start_b[group_a[first:last]], n)
        kept.append(summed(key_of(i, j), times_a[i] * times_b[j]))
        held += len(kept[-1][0])
        if held > most and len(kept) > 1:
            kept = [summed(*map(np.concatenate, zip(*kept)))]
            held = len(kept[0][0])
        first = last
    return summed(*map(np.concatenate, zip(*kept))) if len(kept) > 1 else kept[0] if kept else (np.zeros(0, np.int64),) * 2


@dataclass
class Aligned:
    """Texts of a batch that have tokens: figures by text, and the pairs of all, text by text."""

    n_groups: np.ndarray
    n_links: np.ndarray
    groups: list[bytes]
    owner: np.ndarray
    pair: np.ndarray
    times: np.ndarray


def aligned(a_ids: list[np.ndarray], b_ids: list[np.ndarray], one: Side, two: Side, most: int = LINKS) -> Aligned:
    """Groups and links of texts whose tokens on both sides make the same bytes, at least one."""
    n_a, n_b = (np.array([len(x) for x in ids], np.int64) for ids in (a_ids, b_ids))
    a, b = np.concatenate(a_ids), np.concatenate(b_ids)
    ends_a, ends_b = np.cumsum(one.lengths[a]), np.cumsum(two.lengths[b])
    # Every token has a byte at least, so a side's ends are all different.
    cuts = np.intersect1d(ends_a, ends_b, assume_unique=True)
    group_a, group_b = np.searchsorted(cuts, ends_a), np.searchsorted(cuts, ends_b)
    in_a, in_b = (np.bincount(g, minlength=len(cuts)) for g in (group_a, group_b))
    upto_a, upto_b = np.cumsum(in_a), np.cumsum(in_b)
    owner = np.repeat(np.arange(len(n_a)), n_a)
    owner_of = owner[upto_a - 1]
    texts = len(n_a)
    links = np.r_[0, np.cumsum(in_a * in_b)]
    at = np.searchsorted(owner_of, np.arange(texts + 1))

    written = np.empty(len(a) + len(b), object)
    at_a, at_b = np.arange(len(a)), np.arange(len(b))
    written[at_a + (upto_b - in_b)[group_a]] = one.written["|"][(at_a == upto_a[group_a] - 1).astype(int), a]
    written[at_b + upto_a[group_b]] = two.written[";"][(at_b == upto_b[group_b] - 1).astype(int), b]
    stop = np.cumsum(n_a + n_b)
    groups = [b"".join(written[s:e].tolist())[:-1] for s, e in zip(stop - n_a - n_b, stop)]

    every = one.size * two.size
    times_a, times_b = np.ones(len(a), np.int64), np.ones(len(b), np.int64)
    if links[-1] > 4 * (len(a) + len(b)):
        # Wide groups: a group's equal tokens of a side are linked as one.
        (key_a, times_a), (key_b, times_b) = summed(group_a * one.size + a, times_a), summed(group_b * two.size + b, times_b)
        group_a, a, group_b, b = key_a // one.size, key_a % one.size, key_b // two.size, key_b % two.size
    key, times = crossed(group_a, a, group_b, b, times_a, times_b, lambda i, j: owner_of[group_a[i]] * every + a[i] * two.size + b[j], most)
    return Aligned(np.bincount(owner_of, minlength=texts), links[at[1:]] - links[at[:-1]], groups, key // every, key % every, times)


def packed(pair: np.ndarray, times: np.ndarray) -> bytes:
    """Ordered pairs as differences, and their times, byte planes compressed."""
    both = np.stack([np.diff(pair, prepend=0), times]).astype("<u4")
    return pa.compress(np.ascontiguousarray(both.view(np.uint8).reshape(2, -1, 4).transpose(0, 2, 1)).tobytes(), codec="zstd", asbytes=True)


def unpacked(blob: bytes, n: int) -> tuple[np.ndarray, np.ndarray]:
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    planes = np.frombuffer(pa.decompress(blob, decompressed_size=8 * n, codec="zstd", asbytes=True), np.uint8).reshape(2, 4, n)
    both = np.ascontiguousarray(planes.transpose(0, 2, 1)).view("<u4").reshape(2, n).astype(np.int64)
    return np.cumsum(both[0]), both[1]


def encode(docs: DataFrame, a: str, b: str, keep_groups: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each of ``docs``, materialised: figures, the groups' digest, and packed pairs.

    ``row`` numbers rows, repeated ones apart.  With ``keep_groups`` the groups are
    written out as ``a1,a2|b1;a3|b2,b3``.  A null or empty text, and one whose tokens on
    either side don't make its bytes again, has no tokens: zeros, and empty strings.
    """

    def run(batches):
        one, two = sides(a, b)
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            for at, texts in by_bytes(batch.column(1).to_pylist()):
                n = len(texts)
                numbers = np.zeros((5, n), np.int64)
                digest, groups, blobs = [""] * n, [""] * n, [b""] * n
                some = [i for i, t in enumerate(texts) if t]
                a_ids, b_ids = one.encode([texts[i] for i in some]), two.encode([texts[i] for i in some])
                same = [k for k, i in enumerate(some) if one.bytes(a_ids[k]) == two.bytes(b_ids[k]) == (" " + texts[i]).encode()]
                if same:
                    a_ids, b_ids, some = [a_ids[k] for k in same], [b_ids[k] for k in same], [some[k] for k in same]
                    made = aligned(a_ids, b_ids, one, two)
                    starts = np.searchsorted(made.owner, np.arange(len(some) + 1))
                    numbers[:, some] = [[len(x) for x in a_ids], [len(x) for x in b_ids], made.n_groups, made.n_links, np.diff(starts)]
                    for k, i in enumerate(some):
                        digest[i] = hashlib.sha256(made.groups[k]).hexdigest()
                        if keep_groups:
                            groups[i] = made.groups[k].decode()
                        blobs[i] = packed(made.pair[starts[k] : starts[k + 1]], made.times[starts[k] : starts[k + 1]])
                columns = [pa.array(range(row, row + n), pa.int64()), batch.column(0).slice(at, n), *map(pa.array, numbers[:4]), pa.array(digest), pa.array(groups), pa.array(numbers[4]), pa.array(blobs, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in ROW.split(", ")])
                row += n

    return cut(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, ROW))


def pair_counts(encoded: DataFrame) -> DataFrame:
    """``(pair, n)``: how many rows of what ``encode`` made hold a pair; a task counts its own first."""

    def run(batches):
        some, held, salt = [], 0, TaskContext.get().partitionId() % SALTS

        def counted():
            key, n = np.unique(np.concatenate(some), return_counts=True)
            some.clear()
            return pa.RecordBatch.from_arrays([pa.array(key), pa.array(np.full(len(key), salt, np.int32)), pa.array(n)], ["pair", "salt", "n"])

        for batch in batches:
            for n, blob in zip(batch.column(0).to_pylist(), batch.column(1)):
                some.append(unpacked(blob.as_py(), n)[0])
                held += n
                if held > CHUNK:
                    yield counted()
                    held = 0
        if held:
            yield counted()

    counted = encoded.where("n_pairs > 0").select("n_pairs", "pairs").mapInArrow(run, "pair long, salt int, n long")
    return counted.groupBy("pair", "salt").agg(F.sum("n").alias("n")).groupBy("pair").agg(F.sum("n").alias("n"))


@dataclass
class Counts:
    """The commonest pairs with their counts, the highest count by id of A, and the table of all other pairs."""

    pairs: np.ndarray
    counts: np.ndarray
    best: np.ndarray
    rare: DataFrame | None  # (pair, n, best)


def learn(encoded: DataFrame, a: str, b: str, max_pairs: int = MAX_PAIRS) -> Counts:
    """Counts of all pairs, split where no more than ``max_pairs`` stay on the common side."""
    one, two = sides(a, b)
    counts = cut(pair_counts(encoded))
    best = counts.groupBy(F.expr(f"pair div {two.size}").alias("a")).agg(F.max("n").alias("top"))
    highest = np.zeros(one.size, np.int64)
    got = best.toArrow()  # at most one row an id of A
    highest[got["a"].to_numpy()] = got["top"].to_numpy()
    level = F.floor(F.log2("n"))
    levels = counts.groupBy(level.alias("level")).count().orderBy(F.desc("level")).collect()  # a row a power of two
    least, seen = (levels[0].level + 1 if levels else 0), 0
    for r in levels:
        if seen + r["count"] > max_pairs:
            break
        least, seen = r.level, seen + r["count"]
    top = counts.where(level >= least).toArrow().sort_by("pair")
    rare = None
    if seen < sum(r["count"] for r in levels):
        rare = counts.where(level < least).withColumn("a", F.expr(f"pair div {two.size}")).join(F.broadcast(best), "a").select("pair", "n", (F.col("n") == F.col("top")).alias("best"))
    return Counts(top["pair"].to_numpy(), top["n"].to_numpy(), highest, rare)


def score(encoded: DataFrame, counts: Counts, b_size: int, row_bytes: int = 48, part: int = 50_000) -> DataFrame:
    """``encoded`` rows with ``n_best`` and ``count_sum``, without the packed pairs.

    ``n_best`` is how many links of a row have a pair whose count is the highest of its id
    of A; ``count_sum`` is the sum of counts over all links.
    """
    pairs, number, best = counts.pairs, counts.counts, counts.best
    names = ["row", "pair", "times", "n_best", "count_sum"]

    def run(batches):
        own, rest, held = [], [], 0

        def flush():
            columns = [[x[0] for x in own], None, None, [x[1] for x in own], [x[2] for x in own]]
            yield pa.RecordBatch.from_arrays([pa.nulls(len(own), pa.int64()) if c is None else pa.array(c, pa.int64()) for c in columns], names)
            if rest:
                row, pair, times = map(np.concatenate, zip(*rest))
                yield pa.RecordBatch.from_arrays([*map(pa.array, (row, pair, times)), *[pa.nulls(len(row), pa.int64())] * 2], names)
            own.clear(), rest.clear()

        for batch in batches:
            for row, size, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                pair, times = unpacked(blob.as_py(), size)
                at = np.minimum(np.searchsorted(pairs, pair), max(0, len(pairs) - 1))
                known = pairs[at] == pair if len(pairs) else np.zeros(len(pair), bool)
                n, t = number[at[known]], times[known]
                own.append((row, int(t[n == best[pair[known] // b_size]].sum()), int((n * t).sum())))
                if not known.all():
                    rest.append((np.full(size - len(n), row), pair[~known], times[~known]))
                held += 1 + size - len(n)
                if held > 1 << 16:
                    yield from flush()
                    held = 0
        if own:
            yield from flush()

    made = encoded.select("row", "n_pairs", "pairs").mapInArrow(run, "row long, pair long, times long, n_best long, count_sum long")
    if counts.rare is not None:
        made = cut(made)
    sums = made.where("pair is null").select("row", "n_best", "count_sum")
    if counts.rare is not None:
        sizes = counts.rare.select("pair", F.col("n").alias("_n"))
        met = join_one(made.where("pair is not null").select("row", "pair", "times"), counts.rare, ["pair"], row_bytes=row_bytes, part=part, counted=sizes)
        more = met.groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("_best"), F.sum(F.col("n") * F.col("times")).alias("_sum"))
        add = lambda c, x: F.col(c) + F.coalesce(x, F.lit(0))
        sums = sums.join(more, "row", "left").select("row", add("n_best", F.col("_best")).alias("n_best"), add("count_sum", F.col("_sum")).alias("count_sum"))
    return encoded.drop("pairs", "n_pairs").join(sums, "row")


def align(docs: DataFrame, a: str, b: str, keep_groups: bool = False, max_pairs: int = MAX_PAIRS, part: int = 50_000) -> DataFrame:
    """``(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256)`` for every row of ``docs``.

    Null and empty texts, and those that a tokenizer doesn't give back byte by byte, have
    zeros and ``''``.  Null ids stay; each repeated row counts as a document and repeats;
    ties for the highest count are all best; texts of any length are aligned whole;
    other columns are ignored; an empty table gives no rows.  With ``keep_groups`` a
    column ``groups`` holds the groups themselves.
    """
    encoded = encode(docs, a, b, keep_groups)
    out = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    return score(encoded, learn(encoded, a, b, max_pairs), sides(a, b)[1].size, part=part).select(*out, *(["groups"] if keep_groups else []))


def op11_alignment(spark, sf_dir):
    """Contract: all documents, byte-level BPE against pieces."""
    small_batches(spark)
    return align(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model"))


QUERIES = {"op11_alignment": op11_alignment}
ORACLE_SQL = {}
