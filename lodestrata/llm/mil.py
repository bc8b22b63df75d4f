"""Document quality by attention-based multiple-instance learning.

A document is a bag of passages.  Each passage is encoded from counts over its bytes
and words; gated attention (tanh times sigmoid) weighs the encodings, and a logistic
unit scores their weighted sum.  All weights are learned together from document labels.

Fitting uses a bounded sample of labelled rows: at most ``max_train`` documents, chosen by
a hash of the id, that together have at most ``max_passages`` passages; all passages of
these are encoded.  Spark tasks make their features, and the driver gets at most
``max_passages`` times ``FEATURES`` floats.
Scoring is one scan of whole texts without a shuffle: all passages of a text are encoded,
``STEP`` of them at a time, and what is kept of each until its text is pooled is one
encoding of a few numbers.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import by_bytes, cut, held_out, small_batches, table, utf8

WORDS = 64  # words in a passage
KINDS = 16  # byte classes, below
STEP = 2048  # passages encoded at once


def _byte_classes() -> np.ndarray:
    """Letters, digits, space and the marks that tell prose from junk, lists and shouting."""
    c = np.full(256, 13, np.uint8)  # other ASCII
    c[ord("a") : ord("z") + 1] = 0
    c[ord("A") : ord("Z") + 1] = 1
    c[ord("0") : ord("9") + 1] = 2
    c[ord(" ")] = 3
    for k, marks in enumerate((".", ",", "!", "?", "|", "*&%$#@^~", "\"'()[]{}<>", "-_/\\", ":;="), 4):
        for m in marks:
            c[ord(m)] = k
    c[0x80:0xA0], c[0xA0:0xC0], c[0xC0:] = 14, 15, 13  # continuation bytes of capitals, of small letters, lead bytes
    return c


CLASSES = _byte_classes()
WORD_FEATURES = 6
FEATURES = WORD_FEATURES + KINDS + KINDS * KINDS


def passages(text: str | None) -> list[bytes]:
    """The whole text, ``WORDS`` words at a time; an empty text is one empty passage."""
    words = utf8(text).split()
    return [b" ".join(words[i : i + WORDS]) for i in range(0, len(words), WORDS)] or [b""]


def encode(flat: list[bytes]) -> np.ndarray:
    """Features of passages, a row each."""
    n = len(flat)
    sizes = np.array([len(p) for p in flat])
    kinds = CLASSES[np.frombuffer(b"".join(flat), np.uint8)].astype(np.int64)
    owner = np.repeat(np.arange(n), sizes)
    single = np.bincount(owner * KINDS + kinds, minlength=n * KINDS).reshape(n, KINDS)
    same = owner[1:] == owner[:-1]
    pair = np.bincount((owner[1:] * KINDS * KINDS + kinds[:-1] * KINDS + kinds[1:])[same], minlength=n * KINDS * KINDS).reshape(n, KINDS * KINDS)
    words = np.zeros((n, WORD_FEATURES), np.float32)
    for i, p in enumerate(flat):
        w = p.split()
        if w:
            words[i] = len(w) / WORDS, len(p) / len(w) / 8, len(set(w)) / len(w), sum(map(bytes.__eq__, w, w[1:])) / len(w), max(map(len, w)) / 32, 1
    length = (sizes + 20)[:, None]  # few bytes are weak evidence
    return np.hstack([words, single / length, np.sqrt(pair / length)]).astype(np.float32)


@dataclass
class Model:
    """Weights of the encoder, of the two attention branches and of the scorer."""

    mean: np.ndarray
    scale: np.ndarray
    weights: dict[str, np.ndarray]

    def attend(self, x: np.ndarray) -> tuple[np.ndarray, ...]:
        """Encoding of each passage, its two attention branches and the logit of its weight."""
        w = self.weights
        z = np.tanh(x @ w["W"] + w["b"])
        t, g = np.tanh(z @ w["V"]), 1 / (1 + np.exp(-(z @ w["U"])))
        return z, t, g, (t * g) @ w["a"]

    def pool(self, z: np.ndarray, e: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, ...]:
        """Each passage's share of its bag's attention, the weighted encodings and the bags' scores."""
        w = self.weights
        e = np.exp(e - np.repeat(np.maximum.reduceat(e, starts), sizes))
        att = e / np.repeat(np.add.reduceat(e, starts), sizes)
        bag = np.add.reduceat(att[:, None] * z, starts)
        return att, bag, 1 / (1 + np.exp(-np.clip(bag @ w["c"] + w["d"], -30, 30)))

    def forward(self, x: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> dict[str, np.ndarray]:
        z, t, g, e = self.attend(x)
        att, bag, p = self.pool(z, e, starts, sizes)
        return {"z": z, "t": t, "g": g, "att": att, "bag": bag, "p": p}

    def scaled(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -8, 8)

    def score(self, texts: list[str | None]) -> np.ndarray:
        each = [passages(t) for t in texts]
        flat = [p for ps in each for p in ps]
        z, e = [], []
        for i in range(0, len(flat), STEP):
            own = self.attend(self.scaled(encode(flat[i : i + STEP])))
            z.append(own[0])
            e.append(own[3])
        sizes = np.array([len(ps) for ps in each])
        return self.pool(np.concatenate(z), np.concatenate(e), np.r_[0, np.cumsum(sizes)[:-1]], sizes)[2].astype(float)


def fit(x: np.ndarray, sizes: np.ndarray, y: np.ndarray, hidden: int = 24, gate: int = 12, epochs: int = 25, batch: int = 64, rate: float = 3e-3, decay: float = 1e-4, seed: int = 1) -> Model:
    """Adam on the log loss of bags; ``x`` has the passages of all bags in order.

    ``x`` may fill a good part of the driver, so it is never copied: a batch is scaled when it is used.
    """
    rng = np.random.default_rng(seed)
    mean, scale = x.mean(0), np.concatenate([x[:, i : i + KINDS].std(0) for i in range(0, x.shape[1], KINDS)]) + 1e-2
    f = x.shape[1]
    normal = lambda *s: rng.normal(0, 1 / np.sqrt(s[0]), s).astype(np.float32)
    w = {"W": normal(f, hidden), "b": np.zeros(hidden, np.float32), "V": normal(hidden, gate), "U": normal(hidden, gate), "a": normal(gate), "c": normal(hidden), "d": np.zeros(1, np.float32)}
    model = Model(mean, scale, w)
    m, v, step = {k: np.zeros_like(a) for k, a in w.items()}, {k: np.zeros_like(a) for k, a in w.items()}, 0
    first = np.r_[0, np.cumsum(sizes)[:-1]]
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for at in range(0, len(y), batch):
            own = order[at : at + batch]
            n = sizes[own]
            starts = np.r_[0, np.cumsum(n)[:-1]]
            rows = np.repeat(first[own] - starts, n) + np.arange(n.sum())
            xb = model.scaled(x[rows]).astype(np.float32)
            o = model.forward(xb, starts, n)
            dlogit = ((o["p"] - y[own]) / len(own)).astype(np.float32)
            dbag = np.repeat(dlogit[:, None] * w["c"], n, axis=0)
            datt = (dbag * o["z"]).sum(1)
            de = o["att"] * (datt - np.repeat(np.add.reduceat(o["att"] * datt, starts), n))
            dtg = de[:, None] * w["a"]
            dt, dg = dtg * o["g"] * (1 - o["t"] ** 2), dtg * o["t"] * o["g"] * (1 - o["g"])
            dz = (dbag * o["att"][:, None] + dt @ w["V"].T + dg @ w["U"].T) * (1 - o["z"] ** 2)
            grad = {"W": xb.T @ dz, "b": dz.sum(0), "V": o["z"].T @ dt, "U": o["z"].T @ dg, "a": (o["t"] * o["g"]).T @ de, "c": o["bag"].T @ dlogit, "d": dlogit.sum(keepdims=True)}
            step += 1
            for k in w:
                g = grad[k] + decay * w[k]
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                w[k] -= (rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return model


def train(docs: DataFrame, labels: DataFrame, max_train: int = 4000, max_passages: int = 128_000, **options) -> Model:
    """Fit on all passages of at most ``max_train`` labelled ids that aren't held out.

    Ids are taken in the order of a hash; one whose text has more passages than
    ``max_passages`` leaves after those before it teaches nothing, so fewer rows teach
    where texts are long, and each of these is read whole.
    ``docs(doc_id, text)``, ``labels(doc_id, quality)``; rows without an id or a label,
    and ids whose labels contradict each other, teach nothing; of rows that repeat an id
    the least text teaches.  With fewer than two labels to learn from, the model scores
    the one label's value, or 1 without any: nothing is known against a document.
    """
    known = (
        labels.where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & ~held_out())
        .groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("quality").cast("int").alias("quality"), F.min("quality").alias("least")).where("quality = least").drop("least")
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train)
    )

    def counts(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(passages(t)) for t in b.column(1).to_pylist()], pa.int64())], ["doc_id", "n"])

    def run(batches):
        for b in batches:
            for at, texts in by_bytes(b.column(2).to_pylist()):
                each = [passages(t) for t in texts]
                flat = [p for ps in each for p in ps]
                x = np.concatenate([encode(flat[i : i + STEP]) for i in range(0, len(flat), STEP)])
                rows = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum([len(ps) for ps in each]) * FEATURES].astype(np.int32)), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, len(texts)), b.column(1).slice(at, len(texts)), rows], ["doc_id", "quality", "x"])

    # At most max_train ids: a proven bound for the broadcast.
    sample = cut(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(known), "doc_id").groupBy("doc_id", "quality").agg(F.min(F.coalesce("text", F.lit(""))).alias("text")))
    left, taken = max_passages, []
    for r in sample.select("doc_id", "text").mapInArrow(counts, "doc_id long, n long").orderBy(F.xxhash64("doc_id"), "doc_id").collect():  # at most max_train rows
        if r.n <= left:
            left -= r.n
            taken.append((r.doc_id,))
    chosen = F.broadcast(docs.sparkSession.createDataFrame(taken, "doc_id long"))
    got = sample.join(chosen, "doc_id", "left_semi").select("doc_id", "quality", "text").mapInArrow(run, "doc_id long, quality int, x array<float>").toArrow().sort_by("doc_id")
    y = got["quality"].to_numpy().astype(np.float32)
    if len(set(y.tolist())) < 2:
        sure = np.array([-30.0 if len(y) and y[0] == 0 else 30.0], np.float32)
        zero = fit(np.zeros((2, FEATURES), np.float32), np.array([1, 1]), np.array([0.0, 1.0], np.float32), epochs=0)
        zero.weights |= {"c": np.zeros_like(zero.weights["c"]), "d": sure}
        return zero
    lists = got["x"].combine_chunks()
    del got
    pa.default_memory_pool().release_unused()  # what came unsorted
    model = fit(lists.flatten().to_numpy().reshape(-1, FEATURES), np.diff(lists.offsets.to_numpy()) // FEATURES, y, **options)
    del lists
    pa.default_memory_pool().release_unused()  # the driver has other work after this
    return model


def score(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """``docs`` with ``score`` and ``predicted`` beside its columns.

    ``score`` is the chance of label 1, for null and empty texts too (they are one empty
    passage).  Columns of these two names are replaced; every row stays, repeats included.
    """
    rest = docs.drop("score", "predicted")
    at = rest.columns.index("text")
    schema = T.StructType([*rest.schema, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])

    def run(batches):
        for b in batches:
            s = np.concatenate([model.score(t) for _, t in by_bytes(b.column(at).to_pylist(), rows=128)] or [np.zeros(0)])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(s), pa.array((s >= threshold).astype(np.int32))], [*b.schema.names, "score", "predicted"])

    return rest.mapInArrow(run, schema)


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs``, whatever its columns, that aren't predicted to be of low quality."""
    model, at = train(docs, labels), docs.columns.index("text")

    def run(batches):
        for b in batches:
            s = np.concatenate([model.score(t) for _, t in by_bytes(b.column(at).to_pylist(), rows=128)] or [np.zeros(0)])
            yield b.filter(pa.array(s >= threshold))

    return docs.mapInArrow(run, docs.schema)


def op4_quality(spark, sf_dir):
    """Contract: every document, held out or not, scored from its text alone."""
    small_batches(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, table(spark, sf_dir, "labels"))
    return score(docs, model).select("doc_id", held_out().alias("held_out"), "score", "predicted")


QUERIES = {"op4_quality": op4_quality}
ORACLE_SQL = {}
