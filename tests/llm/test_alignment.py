import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from lodestrata.llm import alignment
from lodestrata.llm.packing import vocabulary

A, B = vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model")
DOCS = "doc_id long, text string, row long, pair long, best boolean"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, 1, 2, True) for i, t in rows], DOCS)


@pytest.fixture(scope="module")
def coders():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=B)


def tokens(coders, text):
    """Ids and bytes on both sides, by the libraries that the contract names."""
    a, b = coders
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    back = {chr(x): x for x in plain} | {chr(256 + k): x for k, x in enumerate([x for x in range(256) if x not in plain])}
    ids_a = a.encode(" " + text, add_special_tokens=False).ids
    ids_b = b.encode(text)
    bytes_a = [bytes(back[c] for c in a.id_to_token(i)) for i in ids_a]
    bytes_b = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]
    return (ids_a, bytes_a), (ids_b, bytes_b)


def brute(coders, rows):
    made, count = [], Counter()
    for i, text in rows:
        groups = []
        if text:
            (ids_a, bytes_a), (ids_b, bytes_b) = tokens(coders, text)
            if b"".join(bytes_a) == b"".join(bytes_b) == (" " + text).encode():
                ends = []
                for ids, parts in ((ids_a, bytes_a), (ids_b, bytes_b)):
                    at, out = 0, []
                    for t, p in zip(ids, parts):
                        at += len(p)
                        out.append((at, t))
                    ends.append(out)
                cuts = sorted({e for e, _ in ends[0]} & {e for e, _ in ends[1]})
                low = 0
                for c in cuts:
                    groups.append([[t for e, t in side if low < e <= c] for side in ends])
                    low = c
        links = [(x, y) for a, b in groups for x in a for y in b]
        count.update(set(links))
        made.append((i, groups, links))
    best = defaultdict(int)
    for (x, _), n in count.items():
        best[x] = max(best[x], n)
    out = []
    for i, groups, links in made:
        text = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)
        out.append((
            i, sum(len(a) for a, _ in groups), sum(len(b) for _, b in groups), len(groups), len(links), sum(count[x] == best[x[0]] for x in links), sum(count[x] for x in links),
            hashlib.sha256(text.encode()).hexdigest() if groups else "", text,
        ))
    return out


def texts(n, seed=11):
    rng = random.Random(seed)
    bits = ["the", "The", "nation", "naïve", "straße", " ", " ", "  ", "\n", "\t", ".", "'s", "12", "2024", "日本語", "👍🏽", "é", "▁", " ", "<|endoftext|>", "</s>", "<0x41>", "ing", "qzx", "\x00", "é"]
    return [(i, "".join(rng.choices(bits, k=rng.choice([1, 2, 6, 25])))) for i in range(n)]


@pytest.mark.parametrize("max_pairs,part,row_bytes", [(1 << 20, 50_000, 48), (20, 50_000, 48), (0, 3, 1 << 30)])
def test_equals_brute_force(spark, coders, max_pairs, part, row_bytes):
    rows = [*texts(150), (1, "again the"), (1, "again the"), (None, "no id"), (900, None), (901, ""), (902, "   "), (903, "the nation " * 3000)]
    d = docs(spark, rows).repartition(5)
    encoded = alignment.encode(d, A, B, keep_groups=True)
    got = alignment.score(encoded, alignment.learn(encoded, A, B, max_pairs), alignment.sides(A, B)[1].size, row_bytes=row_bytes, part=part)
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "groups"]
    key = lambda r: tuple((x is None, x) for x in r)
    want = brute(coders, rows)
    assert sum(r[1] > 0 for r in want) > 100 and sum(r[1] == 0 for r in want) > 5
    assert sorted(map(tuple, got.select(*names).collect()), key=key) == sorted(want, key=key)


def test_query_columns_and_empty_table(spark, tmp_path):
    docs(spark, texts(20)).write.parquet(f"{tmp_path}/documents.parquet")
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    got = alignment.op11_alignment(spark, str(tmp_path))
    assert got.columns == names and got.count() == 20
    assert alignment.align(docs(spark, []), A, B).collect() == []


def test_wide_groups_in_small_steps():
    """Sides that never end together within a text, spread out a few links at a time."""
    one = alignment.Side([b"", b"ab", b"a", b"b"], None)
    two = alignment.Side([b"", b"ba", b"b", b"a"], None)
    a_ids = [np.array([1] * 40), np.array([2, 3]), np.array([1] * 30)]
    b_ids = [np.array([3] + [1] * 39 + [2]), np.array([3, 2]), np.array([3, 2] * 30)]
    want = None
    for most in (1, 7, 1 << 20):
        made = alignment.aligned(a_ids, b_ids, one, two, most)
        assert made.n_groups.tolist() == [1, 2, 30] and made.n_links.tolist() == [40 * 41, 2, 60]
        pairs = Counter(dict(zip(zip(made.owner.tolist(), made.pair.tolist()), made.times.tolist())))
        assert pairs == Counter({(0, 1 * 4 + 3): 40, (0, 1 * 4 + 1): 40 * 39, (0, 1 * 4 + 2): 40, (1, 2 * 4 + 3): 1, (1, 3 * 4 + 2): 1, (2, 7): 30, (2, 6): 30})
        want = want or made.groups
        assert made.groups == want
    assert want[1] == b"2|3;3|2"


def test_packed_pairs_come_back():
    rng = np.random.default_rng(1)
    for n in (0, 1, 1000):
        pair = np.unique(rng.integers(0, 50257 * 32000, n))
        times = rng.integers(1, 1 << 20, len(pair))
        got = alignment.unpacked(alignment.packed(pair, times), len(pair))
        assert all(np.array_equal(x, y) for x, y in zip(got, (pair, times)))
