"""Benchmark decontamination by q-gram lemma filtering.

A passage of ``m`` characters that occurs in a document with at most ``k`` edits shares
at least ``m + 1 - (k + 1) * q`` of its q-grams with it, and all of them lie within a
band of ``k + 1`` neighbouring diagonals (position in the document minus position in the
passage).  So each batch of documents looks its q-grams up among those of the passages,
counts hits by passage and band, keeps bands that reach the bound, and proves what is
left by an alignment of the stretch under the band.

Bands are ``2 (k + 1)`` diagonals wide and overlap by half, so that any ``k + 1``
neighbouring diagonals lie inside one of them.  Texts are compared lower-cased, with
runs of anything but letters and digits as one space.  Everything counts characters.

For the q-gram filter a character is folded to one byte, so a q-gram is one 64-bit word;
characters that share a byte can only add hits, which the alignment of the characters
themselves then rejects.  The alignment is bit-parallel: one column of the band's
stretch costs ``m / 64`` words, less than the ``k`` cells of a banded table as long as
``rate`` is above 1/64.

The passages' q-grams go to every task, so their total size is checked against
``max_index`` characters; a larger benchmark is worked through in slices of that size,
each slice one scan of the documents.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, table

Q = 8  # a q-gram is one 64-bit word
RUN = re.compile(r"[\W_]+")
PLAIN = bytes(c if chr(c).isalnum() and c < 128 else 32 for c in range(128)) + bytes(range(128, 256))
MATCH = "doc_id long, item_id long, start long, end long, edits long, item_chars long"
MIX = np.uint64(0x9E3779B97F4A7C15)


def normal(text: str | None) -> str:
    """Lower case; anything but letters and digits becomes one space."""
    if not text:
        return ""
    low = text.lower()
    if low.isascii():
        return b" ".join(low.encode().translate(PLAIN).split()).decode()
    return RUN.sub(" ", low).strip()


def fold(text: str) -> np.ndarray:
    """One byte a character: itself if ASCII, else one of 127 others."""
    if text.isascii():
        return np.frombuffer(text.encode(), np.uint8)
    code = np.frombuffer(text.encode("utf-32-le", "replace"), "<u4")
    return np.where(code < 128, code, 128 + (code * np.uint32(2654435761) >> np.uint32(16)) % np.uint32(127)).astype(np.uint8)


def grams(data: np.ndarray) -> np.ndarray:
    """The q-gram at each position as a 64-bit word."""
    n = len(data) - Q + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.empty(n, np.uint64)
    for i in range(Q):  # eight aligned views instead of eight shifts of everything
        part = data[i : i + (n - i + Q - 1) // Q * Q]
        part = part[: len(part) // Q * Q].view("<u8")
        out[i::Q] = part[: len(out[i::Q])]
    return out


@dataclass
class Index:
    """Passages, their edit budgets and bounds, and their q-grams sorted."""

    items: list[tuple[int, str]]
    rate: float

    def __post_init__(self):
        size = np.array([len(t) for _, t in self.items])
        # The largest budget up to rate * m under which the lemma still asks for a shared q-gram.
        self.k = np.clip(np.minimum((self.rate * size).astype(int), (size + 1) // Q - 1), 0, None)
        while len(size) and (bad := (size + 1 - (self.k + 1) * Q < 1) & (self.k > 0)).any():
            self.k -= bad
        self.need = np.maximum(size + 1 - (self.k + 1) * Q, 1)
        self.size = size
        g = [grams(fold(t)) for _, t in self.items]
        key = np.concatenate(g or [np.zeros(0, np.uint64)])
        item = np.repeat(np.arange(len(g)), [len(x) for x in g])
        pos = np.concatenate([np.arange(len(x)) for x in g] or [np.zeros(0, int)])
        order = np.argsort(key, kind="stable")
        self.item, self.pos = item[order].astype(np.int32), pos[order].astype(np.int32)
        self.key, self.first, self.count = np.unique(key[order], return_index=True, return_counts=True)
        self.seen = np.zeros(1 << 21, bool)
        self.seen[self.slot(self.key)] = True
        self.short = [(j, t) for j, (_, t) in enumerate(self.items) if 0 < len(t) < Q]

    @staticmethod
    def slot(key: np.ndarray) -> np.ndarray:
        return (key * MIX) >> np.uint64(43)


def banded(item: str, text: str, lo: int, hi: int, anchored: bool):
    """``(end, edits)``: the fewest edits from the whole item to a stretch of ``text`` that ends at ``end``.

    Only alignments count that stay in a band: behind ``i`` characters of the item and
    ``j`` of the text, ``lo <= j - i <= hi``.  The stretch starts anywhere, or at the
    text's front if ``anchored``.  A column of the band is ``hi - lo + 1`` bits that move
    down a row with each character, so a step is an addition and some logic on the band
    alone.  Rows above the item's first cost nothing, or what lies ahead in the text if
    ``anchored``.
    """
    m = len(item)
    lo = max(lo, -m)  # nothing lies further left
    top = hi - lo
    if top < 0:
        return
    mask = (2 << top) - 1
    at: dict[str, int] = {}
    for i, c in enumerate(item):
        at[c] = at.get(c, 0) | 1 << i
    begin = max(lo, 0)
    above = (1 << max(0, hi - begin)) - 1 & mask
    up, down = mask & ~above, above if anchored else 0
    score = begin - lo  # of the band's lowest row
    for j in range(begin + 1, len(text) + 1):
        first = j - hi  # the row of bit 0
        own = at.get(text[j - 1], 0)
        eq = (own >> first - 1 if first >= 1 else own << 1 - first | (1 << 1 - first) - 1) & mask
        zero = ((eq & up) + up ^ up | eq | down) & mask
        more, less = down | ~(zero | up) & mask, zero & up
        if j - lo <= m:
            score += 1 - (zero >> top & 1)
        elif m < first:
            return
        else:
            score += (more >> m - first & 1) - (less >> m - first & 1)
        if j - lo >= m:
            yield j, score
        up, down = (less | ~(zero >> 1 | more)) & mask, more & zero >> 1


def align(item: str, text: str, k: int, lo: int | None = None, hi: int | None = None) -> tuple[int, int, int] | None:
    """``(edits, start, end)`` of the stretch of ``text`` nearest to the item; none within ``k`` edits.

    Only diagonals from ``lo`` to ``hi`` are tried, all that ``text`` has unless given.
    """
    exact = text.find(item)
    if exact >= 0:
        return 0, exact, exact + len(item)
    lo, hi = -k if lo is None else max(lo, -k), max(0, len(text) - len(item)) + k if hi is None else hi
    best, end = k + 1, 0
    for j, edits in banded(item, text, lo, hi, False):
        if edits < best:
            best, end = edits, j
    if best > k:
        return None
    back = text[max(0, end - len(item) - best) : end][::-1]
    # Back from its end the path is found again, perhaps with fewer edits than the first band allowed.
    size, edits = next((j, e) for j, e in banded(item[::-1], back, -best, best, True) if e <= best)
    return edits, end - size, end


def search(texts: list[str], index: Index) -> list[tuple[int, int, int, int, int]]:
    """``(text number, item number, start, end, edits)`` of every region found in ``texts``."""
    gap = np.full(Q, 32, np.uint8)
    data = np.concatenate([x for t in texts for x in (fold(t), gap)])
    start = np.r_[0, np.cumsum([len(t) + Q for t in texts])]
    found = []
    for j, t in index.short:  # shorter than a q-gram: exact words
        for i, x in enumerate(texts):
            for f in re.finditer(r"(?:^|(?<= ))" + re.escape(t) + r"(?= |$)", x):
                found.append((i, j, f.start(), f.end(), 0))
    key = grams(data)
    at = np.flatnonzero(index.seen[index.slot(key)])
    k = np.searchsorted(index.key, key[at])
    k[k == len(index.key)] = 0
    hit = index.key[k] == key[at] if len(index.key) else np.zeros(len(at), bool)
    at, k = at[hit], k[hit]
    if not len(at):
        return found
    owner = np.searchsorted(start, at, "right") - 1
    # Every occurrence of each q-gram among the passages, a bounded number of hits at once.
    n_items, spots = len(index.items), []
    times = index.count[k]
    cuts = np.r_[0, np.searchsorted(np.cumsum(times), np.arange(1 << 22, times.sum(), 1 << 22)), len(at)]
    cuts = cuts[np.r_[True, (owner[np.minimum(cuts[1:], len(at) - 1)] != owner[cuts[1:] - 1]) | (cuts[1:] == len(at))]]  # between texts only
    for a, b in zip(cuts, cuts[1:]):
        n = times[a:b]
        occ = np.repeat(index.first[k[a:b]] - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
        item = index.item[occ]
        pair = np.repeat(owner[a:b], n) * n_items + item
        # A region needs so many hits of its item in its text at all; few pairs have them.
        many = np.bincount(pair, minlength=0) if pair.max() < 1 << 24 else None
        if many is not None:
            rest = np.flatnonzero(many[pair] >= index.need[item])
        else:
            _, back, each = np.unique(pair, return_inverse=True, return_counts=True)
            rest = np.flatnonzero(each[back] >= index.need[item])
        if not len(rest):
            continue
        pair, item, occ = pair[rest], item[rest], occ[rest]
        where = np.repeat(at[a:b], n)[rest]
        text = pair // n_items
        band = (where - start[text] - index.pos[occ]) // (index.k[item] + 1)
        # Bands [w b, w (b + 2)): each diagonal lies in two.  A position counts once, so
        # repeats inside a passage don't add up.
        code = (np.r_[pair, pair].astype(np.int64) << 32) | (np.r_[band, band - 1] + (1 << 31))
        some, total = np.unique(code, return_counts=True)
        some = some[total >= index.need[(some >> 32) % n_items]]
        if len(some):
            slot = np.minimum(np.searchsorted(some, code), len(some) - 1)
            own = np.flatnonzero(some[slot] == code)
            once = np.unique(slot[own] << 32 | np.r_[where, where][own]) >> 32
            spots.append(some[np.bincount(once, minlength=len(some)) >= index.need[(some >> 32) % n_items]])
    last = None
    for code in np.concatenate(spots or [np.zeros(0, np.int64)]).tolist():
        text, item = divmod(code >> 32, n_items)
        m, k = int(index.size[item]), int(index.k[item])
        low = ((code & 0xFFFFFFFF) - (1 << 31)) * (k + 1)
        if last and last[:2] == (text, item) and last[4] == 0 and low - k <= last[3] - m <= low + 3 * k + 1:
            continue  # the same stretch again, which can't be nearer
        a, b = max(0, low - k), max(0, low + 2 * k + 1 + m + k)
        # A path of k edits that meets the band [low, low + 2 (k + 1)) leaves it by no more than k.
        if hit := align(index.items[item][1], texts[text][a:b], k, low - k - a, low + 3 * k + 1 - a):
            last = text, item, a + hit[1], a + hit[2], hit[0]
            found.append(last)
    return found


def best_of_each(found, index):
    """Of regions of one item that overlap by half or more, the one with fewest edits.

    The ends of those kept lie half an item apart, so a region can only overlap its two neighbours.
    """
    out, ends, now = [], [], None
    for f in sorted(found, key=lambda f: (f[0], f[1], f[4], f[3])):
        if f[:2] != now:
            now, ends = f[:2], []
        at = bisect_left(ends, f[3])
        if not any(abs(e - f[3]) * 2 < index.size[f[1]] for e in ends[max(0, at - 1) : at + 1]):
            ends.insert(at, f[3])
            out.append(f)
    return sorted(out)


def regions(texts: list[str | None], index: Index, block_chars: int) -> list[tuple[int, int, int, int, int]]:
    """The best regions in whole texts; long ones are searched in overlapping windows."""
    reach = int((index.size + 2 * index.k).max(initial=0)) + 2 * Q  # no region is longer
    found, group, size = [], [], 0

    def flush():
        for t, item, a, b, edits in search([t for _, _, t in group], index):
            doc, shift, _ = group[t]
            found.append((doc, item, a + shift, b + shift, edits))

    for n, text in enumerate(texts):
        whole = normal(text)
        for at in range(0, max(1, len(whole) - reach), block_chars):
            part = whole[at : at + block_chars + reach]
            if size + len(part) > block_chars and group:
                flush()
                group, size = [], 0
            group.append((n, at, part))
            size += len(part) + Q
    if group:
        flush()
    return best_of_each(found, index)


def contaminated(docs: DataFrame, benchmark: DataFrame, rate: float = 0.1, max_index: int = 4_000_000, block_chars: int = 1 << 21) -> DataFrame:
    """``(doc_id, item_id, start, end, edits, item_chars)``: one row per region of a document
    that a benchmark item turns into with at most ``rate`` edits a character.

    Offsets count characters of the normalised text.  Items whose normal form is empty,
    and null texts, match nothing; an item shorter than a q-gram matches as whole words.
    Items short enough for the lemma to be void get the largest budget for which it isn't.
    Texts of any length are searched whole, in overlapping windows; an alignment
    costs an item's length times the width of its band.  Repeated documents or items give repeated
    rows, null ids stay, other columns are ignored, and an empty table on either side gives
    no rows.
    """
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return reduce(DataFrame.unionByName, [_scan(read, rows, rate, block_chars) for rows in _slices(benchmark, max_index)])


def _slices(benchmark: DataFrame, max_index: int) -> list[list[tuple[int, str]]]:
    """The items in normal form, in lists of about ``max_index`` characters."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("text is not null")
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    slices = -(-total // max_index) or 1
    parts = [items if slices == 1 else items.where(F.pmod(F.xxhash64("text", "item_id"), F.lit(slices)) == k) for k in range(slices)]
    return [[(r.item_id, t) for r in part.collect() if (t := normal(r.text))] for part in parts]  # the benchmark, not the documents


def _scan(docs: DataFrame, rows: list[tuple[int, str]], rate: float, block_chars: int) -> DataFrame:
    def run(batches):
        index = Index(rows, rate)
        for b in batches:
            names, f = b.column(0).to_pylist(), regions(b.column(1).to_pylist(), index, block_chars)
            columns = [[names[x[0]] for x in f], [rows[x[1]][0] for x in f], *[[x[c] for x in f] for c in (2, 3, 4)], [int(index.size[x[1]]) for x in f]]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["doc_id", "item_id", "start", "end", "edits", "item_chars"])

    return docs.mapInArrow(run, MATCH)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, rate: float = 0.1, max_index: int = 4_000_000, block_chars: int = 1 << 21) -> DataFrame:
    """The rows in whose text no benchmark item is found, by the same search; ids play no part."""
    at = docs.columns.index("text")

    def keep(rows):
        def run(batches):
            index = Index(rows, rate)
            for b in batches:
                clean = np.ones(b.num_rows, bool)
                clean[[x[0] for x in regions(b.column(at).to_pylist(), index, block_chars)]] = False
                yield b.filter(pa.array(clean))

        return run

    for rows in _slices(benchmark, max_index):
        docs = docs.mapInArrow(keep(rows), docs.schema)
    return docs


def op3_qgram(spark, sf_dir):
    """All documents against all benchmark items."""
    small_batches(spark)
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {"op3_qgram": op3_qgram}
ORACLE_SQL = {}
