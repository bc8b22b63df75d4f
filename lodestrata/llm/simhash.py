"""SimHash near-duplicates by pigeonhole blocks.

A fingerprint has 64 bits.  If two differ in at most ``d`` bits and the bits are cut
into ``m`` blocks, then at least ``m - d`` blocks agree; every choice of ``m - d``
blocks is therefore a join key, and close pairs meet under at least one of them.

How the work stays linear in the number of documents:

* Documents collapse to distinct fingerprints before anything is compared, so exact
  copies, however many, cost one row.
* ``m`` follows the number of distinct fingerprints so that a key is expected to hold
  a few dozen of them.  Results do not depend on ``m``.
* Within a key, close pairs are found in numpy and only a spanning forest of them
  leaves the task, never all pairs.
* A key that holds more than ``max_group`` fingerprints is not gathered at all.  Two
  words differ in at most four bits just if some word is within two bits of both, so
  there every fingerprint is dealt to all words within two flips of it and joined to
  the smallest one it meets.  That is linear in the group and dealt over the cluster.
* Components come from alternating large-star and small-star steps over those links;
  a node with very many links is dealt over tasks (``common.join_one``).
"""

from __future__ import annotations

from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, blocks, checked, cut, few, join_one, small_batches, table, utf8

BITS = 64
CHECK = 4  # words of a wide fingerprint by which candidates are compared


def fingerprint_many(texts: list[str | None], words: int = 4) -> np.ndarray:
    """SimHash of each text: A-Z lower-cased, words split at ASCII white space,
    XXH64 (seed 42) of space-joined shingles, repeats counted, strict majority."""
    import xxhash

    h = xxhash.xxh64_intdigest
    out = np.zeros(len(texts), np.uint64)
    for k, text in enumerate(texts):
        w = utf8(text).lower().split()
        if not w:
            continue
        n = max(1, len(w) - words + 1)
        ones = np.zeros(BITS, np.int64)
        for at in range(0, n, 65536):
            part = w[at : min(at + 65536, n) + words - 1]
            shingles = map(b" ".join, zip(*(part[i:] for i in range(words)))) if len(part) >= words else [b" ".join(part)]
            hashes = np.array([h(s, 42) for s in shingles], "<u8")
            ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        out[k] = np.packbits(2 * ones > n, bitorder="little").view("<u8")[0]
    return out


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4) -> DataFrame:
    """``(doc_id, fp)``: the fingerprint of every whole text as a signed long.

    A null or blank text has fingerprint 0.
    """

    def run(batches):
        for b in batches:
            texts = b.column(1).to_pylist()
            fps = np.concatenate([fingerprint_many(t, words) for _, t in blocks(texts, 256)] or [np.zeros(0, np.uint64)])
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, fp long")


def _masks(m: int, d: int) -> list[int]:
    edges = [round(i * BITS / m) for i in range(m + 1)]
    parts = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:])]
    return [sum(c) for c in combinations(parts, m - d)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def choose_blocks(n: int, d: int, most: int = 32) -> int:
    """The fewest blocks with which a key is expected to hold at most ``most`` of ``n`` fingerprints."""
    return next((m for m in range(d + 1, d + 5) if n / 2 ** (BITS * (m - d) / m) <= most), d + 4)


def _forest(key: np.ndarray, fp: np.ndarray, rep: np.ndarray, d: int):
    """Spanning links between close fingerprints under equal keys; rows sorted by key.

    ``fp`` has one word a row, or a row of words where fingerprints are wider.
    """
    n = len(key)
    at, found = np.arange(n), []
    step = 0
    while len(at):
        step += 1
        at = at[at + step < n]
        at = at[key[at] == key[at + step]]
        apart = np.bitwise_count((fp[at] ^ fp[at + step]).view(np.uint64))
        close = at[(apart if fp.ndim == 1 else apart.sum(1, dtype=np.int32)) <= d]
        if len(close):
            found.append((close, close + step))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    a, b = (np.concatenate(x) for x in zip(*found))
    order = np.argsort(rep, kind="stable")  # labels in order of rep, so that a root is its tree's smallest
    rank = np.empty(n, np.int64)
    rank[order] = np.arange(n)
    a, b, label = rank[a], rank[b], np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    child = np.flatnonzero(label != np.arange(n))
    return rep[order[label[child]]], rep[order[child]]


def _close(keyed: DataFrame, d: int) -> DataFrame:
    """``(a, b)``: spanning links of the close ones under each key of ``keyed(key, fp, rep)``."""

    def words(fp: pa.Array) -> np.ndarray:
        if pa.types.is_integer(fp.type):
            return fp.to_numpy(zero_copy_only=False)
        return np.frombuffer(b"".join(fp.to_pylist()), "<u8").reshape(len(fp), -1)

    def run(batches):
        held = None
        for b in batches:
            if not b.num_rows:
                continue
            key, rep = (b.column(i).to_numpy(zero_copy_only=False) for i in (0, 2))
            fp = words(b.column(1))
            if held is not None:
                key, fp, rep = (np.concatenate(x) for x in zip(held, (key, fp, rep)))
            end = int(np.searchsorted(key, key[-1]))  # the last key may go on in the next batch
            held = key[end:], fp[end:], rep[end:]
            if end:
                lo, hi = _forest(key[:end], fp[:end], rep[:end], d)
                yield pa.RecordBatch.from_arrays([pa.array(lo), pa.array(hi)], ["a", "b"])
        if held is not None:
            lo, hi = _forest(*held, d)
            yield pa.RecordBatch.from_arrays([pa.array(lo), pa.array(hi)], ["a", "b"])

    return keyed.repartition("key").sortWithinPartitions("key").mapInArrow(run, "a long, b long")


def links(nodes: DataFrame, max_distance: int = 4, max_group: int = 1024, n_blocks: int | None = None) -> DataFrame:
    """``(a, b)`` with a < b: links that join ``rep`` values of close fingerprints.

    ``nodes`` has ``(fp, rep)``, one row for each fingerprint.  The links have the same
    connected components as the graph of all pairs within ``max_distance`` bits.
    """
    d = max_distance
    masks = _masks(n_blocks or choose_blocks(nodes.count(), d), d)
    keyed = nodes.select(
        "fp", "rep", F.posexplode(F.array(*[F.xxhash64(F.lit(i), F.col("fp").bitwiseAND(F.lit(_signed(m)))) for i, m in enumerate(masks)])).alias("c", "key")
    )
    hot = cut(keyed.groupBy("key").count().where(F.col("count") > max_group).select("key"))
    any_hot = not hot.isEmpty()
    cold = keyed.join(hot, "key", "left_anti") if any_hot else keyed

    out = _close(cold.select("key", "fp", "rep"), d)
    if any_hot:
        spark = nodes.sparkSession
        near, far = d // 2, d - d // 2  # a word within near bits of one and far bits of the other lies between them
        flips = spark.createDataFrame(
            [(c, _signed(sum(1 << i for i in bits)), k) for c, m in enumerate(masks) for k in range(far + 1) for bits in combinations([i for i in range(BITS) if not m >> i & 1], k)],
            "c int, flip long, k int",
        )  # at most C(m, d) times a few thousand rows, whatever the input
        dealt = keyed.join(hot, "key", "left_semi").join(F.broadcast(flips), "c").select("key", "rep", "k", F.col("fp").bitwiseXOR(F.col("flip")).alias("w"))
        # The smallest one within `near` bits of w meets every one within `far` bits of w.
        first = dealt.where(F.col("k") <= near).groupBy("key", "w").agg(F.min("rep").alias("first"))
        out = out.union(dealt.join(first, ["key", "w"]).where("rep != first").select(F.least("rep", "first").alias("a"), F.greatest("rep", "first").alias("b")))
    return out.distinct()


def components(edges: DataFrame, max_rounds: int = 64, broadcast_bytes: int = BROADCAST_BYTES, part: int = 50_000) -> DataFrame:
    """``(node, root)`` for each node of ``edges(a, b)``: the smallest node it can reach.

    Alternates large-star and small-star steps until the links no longer change, each
    round cut off in the shared checkpoint folder.  Minima are pre-aggregated before they
    are shuffled.  They go to all tasks while there are few links; beyond that the links
    of a node that has more than ``part`` are dealt over several tasks.  A round runs in as
    many tasks as its links fill, whatever the number of shuffle partitions.
    """

    def state(e):
        return e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()

    def lowest(rows, low, key):
        return rows.join(F.broadcast(few(low, 2 * was[0])), key) if 32 * was[0] < broadcast_bytes else join_one(rows, low, [key], row_bytes=16, most=broadcast_bytes, part=part)

    edges = cut(edges.where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    was = state(edges)
    if not was[0]:
        return edges.select(F.col("b").alias("node"), F.col("a").alias("root"))
    edges = few(edges, was[0])
    for _ in range(max_rounds):
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = few(lowest(both, low, "u").where("v > u").select(F.col("m").alias("a"), F.col("v").alias("b")).where("a != b").distinct(), was[0])
        low = large.groupBy("b").agg(F.min("a").alias("m"))
        joined = lowest(large, low, "b")
        edges = cut(few(joined.select(F.col("m").alias("a"), "b").union(joined.select(F.col("m").alias("a"), F.col("a").alias("b"))).where("a != b").distinct(), 2 * was[0]))
        now = state(edges)
        if now == was:
            break
        was = now
    else:
        raise RuntimeError(f"components did not settle within {max_rounds} rounds")
    return edges.select(F.col("b").alias("node"), F.col("a").alias("root"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, max_distance: int = 4, max_group: int = 1024, n_blocks: int | None = None) -> DataFrame:
    """``(doc_id, fingerprint, component_id)``, one row for each row of ``docs``.

    ``component_id`` is the smallest id that can be reached over links between
    fingerprints that differ in at most ``max_distance`` bits.  Null and blank texts
    have fingerprint zero and link like any other; rows without an id link like any
    other too and are only left out of the minimum, which is null where a whole component
    has no id; repeated rows return repeated rows; other columns are ignored; an empty
    table gives an empty result.
    """
    own = cut(fingerprints(docs, id_col, text_col, words))
    nodes = cut(own.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = components(links(nodes.select("fp", F.col("fp").alias("rep")), max_distance, max_group, n_blocks))
    placed = cut(nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), "least"))
    named = join_one(placed.select("fp", "root"), placed.groupBy("root").agg(F.min("least").alias("component_id")), ["root"])
    return join_one(own, named.select("fp", "component_id"), ["fp"]).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def shingle_hashes(text: str | None, words: int) -> np.ndarray:
    """Sorted XXH64 of the different shingles of a text; none of a null or blank one."""
    import xxhash

    h = xxhash.xxh64_intdigest
    w = utf8(text).lower().split()
    if not w:
        return np.zeros(0, np.uint64)
    shingles = set(map(b" ".join, zip(*(w[i:] for i in range(words))))) if len(w) >= words else {b" ".join(w)}
    return np.unique(np.fromiter((h(s, 42) for s in shingles), np.uint64, len(shingles)))


def wide_fingerprint_many(texts: list[str | None], words: int, n_words: int) -> np.ndarray:
    """SimHash of ``64 * n_words`` bits over the different shingles of each text, one row a text.

    Word j's bits are those of the shingle's XXH64 mixed with j.
    """
    out = np.zeros((len(texts), n_words), np.uint64)
    salt = np.arange(1, n_words + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for k, text in enumerate(texts):
        hashes = shingle_hashes(text, words)
        if not len(hashes):
            continue
        ones = np.zeros(BITS * n_words, np.int64)
        for at in range(0, len(hashes), 1 << 14):
            x = hashes[at : at + (1 << 14), None] + salt
            for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
                x = (x ^ (x >> np.uint64(shift))) * np.uint64(by)
            x = np.ascontiguousarray(x ^ (x >> np.uint64(31)))
            ones += np.unpackbits(x.view(np.uint8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        out[k] = np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")
    return out


def _whole_keys(batches, rows: int = 2048):
    """Tables of whole keys, about ``rows`` rows or one key each, from batches sorted by their first column."""
    held = None
    for b in batches:
        if not b.num_rows:
            continue
        t = pa.Table.from_batches([b])
        held = t if held is None else pa.concat_tables([held, t])
        key = held.column(0).to_numpy()
        end = int(np.searchsorted(key, key[-1]))  # the last key may go on in the next batch
        at = 0
        while at < end:
            to = end if end - at <= rows else max(int(np.searchsorted(key, key[at + rows])), int(np.searchsorted(key, key[at], "right")))
            yield held.slice(at, to - at)
            at = to
        held = held.slice(end)
    if held is not None and held.num_rows:
        yield held


def _close_rows(t: pa.Table, d: int, n_blocks: int, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of rows of ``t(key, block, rep, root, fp)`` under a key, and their distance.

    Those within ``d`` of the bits kept for comparing, of different roots, and only under
    the first block that they share, so that a pair is met once.
    """
    key, block, root = (t.column(c).to_numpy() for c in ("key", "block", "root"))
    fp = np.frombuffer(b"".join(t.column("fp").to_pylist()), "<u8").reshape(len(key), -1)
    check = np.ascontiguousarray(fp[:, -CHECK:])
    at, step, found = np.arange(len(key)), 0, []
    while len(at):
        step += 1
        at = at[at + step < len(key)]
        at = at[key[at] == key[at + step]]
        other = at[root[at] != root[at + step]]
        bits = np.bitwise_count(check[other] ^ check[other + step]).sum(1, dtype=np.int32)
        close = bits <= d
        if close.any():
            found.append((other[close], other[close] + step, bits[close]))
    if not found:
        return (np.zeros(0, np.int64),) * 3
    a, b, bits = (np.concatenate(x) for x in zip(*found))
    value = np.unpackbits(fp.view(np.uint8), axis=1, bitorder="little")[:, : n_blocks * width].reshape(len(key), n_blocks, width) @ (1 << np.arange(width, dtype=np.int32))
    first = np.concatenate([(value[a[i : i + 65536]] == value[b[i : i + 65536]]).argmax(1) for i in range(0, len(a), 65536)])
    own = first == block[a]
    return a[own], b[own], bits[own]


def _candidates(keyed: DataFrame, d: int, n_blocks: int, width: int) -> DataFrame:
    """The rows of ``keyed(key, block, rep, root, fp)`` that have a close one under their key."""

    def run(batches):
        for t in _whole_keys(batches):
            a, b, _ = _close_rows(t, d, n_blocks, width)
            if len(a):
                yield from t.take(pa.array(np.unique(np.r_[a, b]))).to_batches()

    return keyed.repartition("key").sortWithinPartitions("key").mapInArrow(run, keyed.schema)


def _links(cells: DataFrame, d: int, n_blocks: int, width: int, similarity: float) -> DataFrame:
    """``(a, b)``: links of the rows of ``cells(key, block, rep, root, fp, own)`` whose sets ``own`` are alike.

    Under each key, close pairs are decided by the exact Jaccard similarity of their sets,
    the nearest first; a pair that earlier links of its key join is passed over.
    """

    def run(batches):
        for t in _whole_keys(batches):
            a, b, bits = _close_rows(t, d, n_blocks, width)
            if not len(a):
                continue
            order = np.argsort(bits, kind="stable")
            rep, sets = t.column("rep").to_pylist(), t.column("own").combine_chunks()
            run_of = np.cumsum(np.r_[0, np.diff(t.column("key").to_numpy()) != 0])
            label = np.unique(np.stack([run_of, t.column("root").to_numpy()]), axis=1, return_inverse=True)[1].ravel().tolist()
            parent = list(range(len(label)))

            def find(x, parent=parent):
                while parent[x] != x:
                    parent[x] = x = parent[parent[x]]
                return x

            own, found = {}, []
            for i, j in zip(a[order].tolist(), b[order].tolist()):
                u, v = find(label[i]), find(label[j])
                if u == v:
                    continue
                for k in (i, j):
                    if k not in own:
                        own[k] = np.frombuffer(sets[k].as_buffer(), np.uint64)
                x, y = own[i], own[j]
                if min(len(x), len(y)) < similarity * max(len(x), len(y)) - 1e-9:
                    continue
                both = len(np.intersect1d(x, y, assume_unique=True))
                if both >= similarity * (len(x) + len(y) - both) - 1e-9:
                    parent[max(u, v)] = min(u, v)
                    found.append((rep[i], rep[j]))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found)], ["a", "b"])

    return cells.repartition("key").sortWithinPartitions("key").mapInArrow(run, "a long, b long")


def similar(docs: DataFrame, similarity: float = 0.8, words: int = 5, recall: float = 0.99, max_group: int = 1024) -> DataFrame:
    """``(doc_id, component_id)``: components of documents whose shingle sets are alike.

    Jaccard similarity s of two sets is cosine 2s / (1 + s), which SimHash turns into a
    share arccos(cosine) / pi of differing bits.  That is 15 % at 0.8, too many for
    every choice of blocks that must agree, so fingerprints are wider: as many blocks as
    make ``recall`` of the pairs right at ``similarity`` share one, whatever the blocks'
    width; that follows the number of rows, so that a block is expected to be shared by
    about a hundred unrelated ones.  Pairs that share a block and differ in no more of 256
    other bits than three standard deviations above the mean at ``similarity`` are
    candidates; the exact Jaccard similarity of their shingle sets decides each.

    A pair is met under the first block that it shares.  Rows that have a candidate there
    are sent there with their sets, and what leaves that task are links: those of a forest
    at most, so that a large group of copies gives a link a member, never all its pairs.

    Equal fingerprints collapse first.  A block value with more than ``max_group``
    fingerprints is dealt to parts, one each; afterwards its rows are met once more, those of its
    largest component, which need no comparison with each other, against the parts of the
    rest, and any two of those parts: every pair that may still matter is compared.

    Null and blank texts are equal to each other; a component's id is null where none of
    its rows has one; repeated rows repeat.
    """
    own, placed = _similar(docs, similarity, words, recall, max_group)
    ids = placed.groupBy("root").agg(F.min("least.doc_id").alias("component_id"))
    named = join_one(placed.select("fp", "root"), ids, ["root"]).select("fp", "component_id")
    return join_one(own.select("doc_id", "fp"), named, ["fp"], row_bytes=96).select("doc_id", "component_id")


def _key(c: str = "text"):
    """128 bits that stand for a text; null counts as empty."""
    return F.unhex(F.md5(F.coalesce(F.col(c), F.lit(""))))


def _similar(docs: DataFrame, similarity: float = 0.8, words: int = 5, recall: float = 0.99, max_group: int = 1024, cell_bytes: int = 256 << 20) -> tuple[DataFrame, DataFrame]:
    """``own(doc_id, text_key, fp)`` of each row, and ``placed(fp, least, root)`` of each fingerprint.

    ``least`` is a fingerprint's first row, by id and then text, ``root`` its component's name.
    """
    n = docs.count()
    apart = float(np.arccos(2 * similarity / (1 + similarity)) / np.pi)
    width = int(np.clip(np.ceil(np.log2(max(n, 2) / 128)), 8, 24))
    n_blocks = int(np.ceil(np.log(1 - recall) / np.log(1 - (1 - apart) ** width)))
    n_words = max(8, -(-n_blocks * width // BITS) + CHECK)  # the last ones are for comparing
    d = int(np.ceil(apart * BITS * CHECK + 3 * np.sqrt(apart * (1 - apart) * BITS * CHECK)))

    def prints(batches):
        for b in batches:
            rows = [x.tobytes() for _, t in blocks(b.column(2).to_pylist(), 256) for x in wide_fingerprint_many(t, words, n_words)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(rows, pa.binary())], ["doc_id", "text_key", "fp"])

    def keyed(nodes):
        def keys(batches):
            weight = 1 << np.arange(width, dtype=np.int64)
            for b in batches:
                for at in range(0, b.num_rows, 4096):
                    part = b.slice(at, 4096)
                    raw = np.frombuffer(b"".join(part.column(2).to_pylist()), np.uint8).reshape(len(part), -1)
                    bits = np.unpackbits(raw, axis=1, bitorder="little")[:, : n_blocks * width]
                    block = np.tile(np.arange(n_blocks, dtype=np.int64), len(part))
                    key = (bits.reshape(len(part), n_blocks, width) @ weight).ravel() + (block << 32)
                    again = pa.array(np.repeat(np.arange(len(part)), n_blocks))
                    yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(block.astype(np.int32)), *(x.take(again) for x in part.columns)], ["key", "block", "rep", "root", "fp"])

        return nodes.select("rep", "root", "fp").mapInArrow(keys, "key long, block int, rep long, root long, fp binary")

    columns = ["block", "rep", "root", "fp"]
    part_of = lambda parts: F.pmod(F.xxhash64("rep", "key"), parts)

    def dealt(made, hot):
        """Rows of hot keys against the parts of all but their largest component."""
        half = max(1, max_group // 2)
        made = made.join(checked(hot), "key")
        plan = cut(
            made.groupBy("key", "root").agg(F.count("*").alias("k")).groupBy("key").agg(F.max_by("root", "k").alias("_main"), F.max("k").alias("m"), F.sum("k").alias("n"))
            .select("key", "_main", F.ceil(F.col("m") / half).alias("_major"), F.ceil((F.col("n") - F.col("m")) / half).alias("_minor"))
        )
        major, minor = F.col("_major"), F.col("_minor")
        upto = lambda k: F.when(k > 0, F.sequence(F.lit(0).cast("long"), k - 1)).otherwise(F.array().cast("array<long>"))
        against = lambda i, j: F.xxhash64("key", F.lit(0), i, j)
        here = part_of(minor)
        of_rest = F.concat(
            F.transform(upto(major), lambda j: against(here, j)),
            F.transform(F.filter(upto(minor), lambda i: i != here), lambda i: F.xxhash64("key", F.lit(1), F.least(i, here), F.greatest(i, here))),
        )
        deal = F.when(F.col("root") == F.col("_main"), F.transform(upto(minor), lambda i: against(i, part_of(major)))).otherwise(of_rest)
        return made.join(checked(plan, 32), "key").select(F.explode(deal).alias("key"), *columns)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _key().alias("text_key"), "text")
    own = cut(rows.mapInArrow(prints, "doc_id long, text_key binary, fp binary"))
    # Of each fingerprint its first row, and so one text that has it.
    nodes = cut(own.groupBy("fp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_key")).alias("least")).withColumn("rep", F.xxhash64("fp")))
    name = nodes.select(F.col("least.doc_id").alias("_id"), F.col("least.text_key").alias("text_key"), "rep")

    def sets(batches):
        done = set()
        for b in batches:
            new = [i for i, rep in enumerate(b.column(0).to_pylist()) if not (rep in done or done.add(rep))]
            made = [shingle_hashes(b.column(1)[i].as_py(), words).tobytes() for i in new]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(new, pa.int64())), pa.array(made, pa.binary())], ["rep", "own"])

    def decided(made):
        """Links among the rows of ``made(key, block, rep, root, fp)``."""
        met = cut(_candidates(made, d, n_blocks, width))
        ends = cut(met.select("rep").distinct())
        if ends.isEmpty():
            return None
        wanted = cut(name.join(checked(ends), "rep", "left_semi"))
        texts = rows.join(checked(wanted, 40), (rows["text_key"] == wanted["text_key"]) & rows["doc_id"].eqNullSafe(F.col("_id"))).select("rep", "text")
        own = cut(texts.mapInArrow(sets, "rep long, own binary").dropDuplicates(["rep"]))
        # A key with more bytes of sets than a task may hold is dealt again, any two parts in a cell.
        size = met.select("key", "rep").join(own.select("rep", F.octet_length("own").alias("n")), "rep").groupBy("key").agg(F.sum("n").alias("n"))
        heavy = cut(size.where(F.col("n") > cell_bytes).select("key", F.ceil(2 * F.col("n") / cell_bytes).alias("_parts")))
        if not heavy.isEmpty():
            here = part_of(F.col("_parts"))
            others = F.transform(F.filter(F.sequence(F.lit(0).cast("long"), F.col("_parts") - 1), lambda x: x != here), lambda x: F.xxhash64("key", F.least(here, x), F.greatest(here, x)))
            met = met.join(checked(heavy), "key", "left").select(F.explode(F.when(F.col("_parts").isNull(), F.array("key")).otherwise(others)).alias("key"), *columns)
        return cut(_links(met.join(own, "rep").select("key", *columns, "own"), d, n_blocks, width, similarity))

    def rooted(sure):
        if sure is None or sure.isEmpty():
            return nodes.withColumn("root", F.col("rep"))
        return nodes.join(components(sure).withColumnRenamed("node", "rep"), "rep", "left").withColumn("root", F.coalesce("root", "rep"))

    made = keyed(nodes.withColumn("root", F.col("rep")))
    hot = cut(made.groupBy("key").agg(F.count("*").alias("_n")).where(F.col("_n") > max_group))
    if hot.isEmpty():
        sure = decided(made)
    else:
        one = F.when(F.col("_n").isNull(), F.col("key")).otherwise(F.xxhash64("key", part_of(F.ceil(F.col("_n") / max_group))))
        sure = decided(made.join(checked(hot), "key", "left").select(one.alias("key"), *columns))
        more = decided(dealt(keyed(rooted(sure)), hot.select("key")))
        sure = sure if more is None else more if sure is None else sure.union(more)
    return own, cut(rooted(sure).select("fp", "least", "root"))


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """One row of each component of ``similar``: the one of the smallest id, without an id last.

    Rows are told apart by id and text, so rows of one id with other texts, and rows
    without an id, are kept or dropped each for its own text; of rows equal in both, one stays.
    Columns of any name go through unchanged; an empty table gives an empty result.
    """
    # The whole row travels in one column, so its names can't meet those used here.
    docs = docs.select("doc_id", "text", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))
    own, placed = _similar(docs, **options)
    lead = placed.groupBy("root").agg(F.min("least").alias("lead"))
    named = join_one(placed.select("fp", "root"), lead, ["root"], row_bytes=64).select("fp", "lead")
    counted = own.groupBy("doc_id", "text_key", "fp").count()
    found = cut(join_one(counted, named, ["fp"], row_bytes=128).select("doc_id", "text_key", (F.col("lead.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("lead.text_key") == F.col("text_key"))).alias("leads"), "count"))
    left = docs.withColumn("_text", _key())

    def listed(rows):
        """These rows' names, and the condition under which a document is one of them."""
        rows = checked(cut(rows.select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"))), 48)
        return rows, F.col("doc_id").cast("long").eqNullSafe(F.col("_id")) & (F.col("_text") == F.col("_key"))

    left = left.join(*listed(found.where("not leads")), "left_anti")
    again = found.where("leads and count > 1")
    if not again.isEmpty():  # only these rows' texts are dealt by their key
        same = listed(again)
        left = left.join(*same, "left_anti").unionByName(left.join(*same, "left_semi").dropDuplicates(["doc_id", "_text"]))
    return left.select("_row.*")


def op6_simhash(spark, sf_dir):
    """Contract: 4-word shingles, 4 bits, components over all documents."""
    small_batches(spark)
    return near_duplicates(table(spark, sf_dir, "documents"))


QUERIES = {"op6_simhash": op6_simhash}
ORACLE_SQL = {}
