"""Quality classifier: random-indexing word vectors, pooled for each document, and a two-layer network.

Every term has a sparse ternary index vector, made from its hash. The vector of a term is its index vector for each
time that it occurs and the sum of those of the terms beside it (WINDOW words to either side), over all documents. A
word gives two terms, its lower-case form and its shape. Terms share WORDS and SHAPES rows by their hash, so the table
has one size whatever the corpus holds (under 9 MB, which is what is sent to executors), every word has a vector, and
none is left out for being rare or late. A document is the mean of its words' and of its shapes' vectors, with its
length and its share of distinct words. The network's logits are divided by a temperature that is fitted on labelled
rows held back from training.

The network alone is fitted on a sample: at most ``SAMPLE`` labelled ids, taken by hash of the id, whose documents are
pooled where they lie. Vectors are counted over all documents, and scoring reads every document whole.

Defined results. A null or blank text has zero vectors and gets the network's answer to them. Several labels of one
id count as their mean, and so do several documents of one id; null labels don't count. With no label, or labels of
one kind, all scores are the smoothed share of good labels. Repeated rows get equal scores. An empty table gives an
empty table. A column of the score's name is replaced.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterable
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import texts, tree_sums

SAMPLE = 6000
DIM, NONZERO, WINDOW = 64, 8, 2
WORDS, SHAPES = 1 << 15, 1 << 11
#: Rows of a table that travel together when tables of partitions are summed.
ROWS = 512
#: Tokens whose vectors are held at a time.
PART = 1 << 16
HIDDEN, EPOCHS, BATCH, RATE, DECAY = 32, 60, 128, 3e-3, 1e-4
CALIBRATE = 5  # every fifth row of the sample sets the temperature
KNOWN = 400_000
RUN = re.compile(r"(.)\1+", re.S)


class Like(dict):
    """Of each character what stands for it in a shape."""

    def __missing__(self, code: int) -> str:
        c = chr(code)
        self[code] = like = "9" if c.isdecimal() else ("X" if c.isupper() else "x") if c.isalnum() else c
        return like


LIKE = Like()


def shape(word: bytes) -> str:
    """Letters are x or X, digits 9; runs of letters count as one, of other characters as two."""
    if word.isalpha():  # ASCII letters only
        if word.islower():
            return "x"
        if word.isupper():
            return "X"
        if word.istitle():
            return "Xx"
    return RUN.sub(r"\1\1", word.decode("utf-8", "replace").translate(LIKE)).replace("xx", "x").replace("XX", "X")


def index_vectors(kind: int, rows: int) -> np.ndarray:
    """For each row NONZERO places of +1 or -1, drawn from the row's number."""
    out = np.zeros((rows, DIM), np.float32)
    rng = np.random.Generator(np.random.PCG64([kind, rows]))
    at = rng.random((rows, DIM)).argsort(axis=1)[:, :NONZERO]
    np.put_along_axis(out, at, rng.choice(np.array([-1, 1], np.float32), (rows, NONZERO)), axis=1)
    return out


class Vectors(NamedTuple):
    words: np.ndarray  # (WORDS, DIM)
    shapes: np.ndarray  # (SHAPES, DIM)


class Rows(dict):
    """Word to its number, with the rows of its terms; starts anew when it holds KNOWN words."""

    def __init__(self):
        super().__init__()
        self.word, self.shape, self.shapes = array("i", [0]), array("i", [0]), {}

    def __missing__(self, word: bytes) -> int:
        n, like = len(self.word), shape(word)  # 0 is no word
        row = self.shapes.get(like)
        if row is None:
            row = self.shapes[like] = xxhash.xxh64_intdigest(like.encode("utf-8", "surrogatepass")) % SHAPES
        self.shape.append(row)
        self.word.append(xxhash.xxh64_intdigest(word.lower()) % WORDS)
        self[word] = n
        return n

    def clear(self) -> None:
        super().clear()
        self.word, self.shape, self.shapes = array("i", [0]), array("i", [0]), {}

    def tables(self) -> tuple[np.ndarray, np.ndarray]:
        """The rows by number; no word may be added while these views are held."""
        return np.frombuffer(self.word, np.int32), np.frombuffer(self.shape, np.int32)

    def numbers(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words))

    def of(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        if len(self) > KNOWN:
            self.clear()
        n = self.numbers(words)
        word, like = self.tables()
        return word[n], like[n]


def summed(rows: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows with the sums of their values."""
    order = np.argsort(rows, kind="stable")
    rows = rows[order]
    first = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]]))
    return rows[first], np.add.reduceat(np.ascontiguousarray(values[order].T).astype(np.int32), first, axis=1).T


def counted(docs: Iterable[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """What these documents add to the tables of words and of shapes; whole numbers, so their order is all one."""
    none = np.zeros((1, DIM), np.int8)  # the row of the gaps between documents
    index_w, index_s = (np.concatenate([index_vectors(k, n).astype(np.int8), none]) for k, n in ((0, WORDS), (1, SHAPES)))
    total_w, total_s = np.zeros(index_w.shape, np.int64), np.zeros(index_s.shape, np.int64)
    gap = np.full(WINDOW, -1)
    rows, held, size = Rows(), [], 0

    def flush() -> None:
        word = np.concatenate([gap, *held])
        word_rows, shape_rows = rows.tables()
        at_w, at_s = word_rows[word], shape_rows[word]
        at_w[word < 0], at_s[word < 0] = WORDS, SHAPES
        for i in range(WINDOW, len(word) - WINDOW, PART):
            part = slice(i - WINDOW, i + PART + WINDOW)
            index = index_w[at_w[part]] + index_s[at_s[part]]
            near = index[: len(index) - 2 * WINDOW].copy()  # at most 2 * (2 * WINDOW + 1)
            for k in range(1, 2 * WINDOW + 1):  # each token's own index vector among them
                near += index[k : k + len(near)]
            own, sums = summed(word[i : i + len(near)], near)
            own, sums = own[own >= 0], sums[own >= 0]
            if len(own):
                for total, of in ((total_w, word_rows), (total_s, shape_rows)):
                    at, more = summed(of[own], sums)
                    total[at] += more

    for d in docs:
        if len(rows) > KNOWN:  # numbers of words are given anew
            if held:
                flush()
            held, size = [], 0
            rows.clear()
        held += [rows.numbers(d), gap]
        size += len(d)
        if size >= PART:
            flush()
            held, size = [], 0
    if held:
        flush()
    return total_w[:-1], total_s[:-1]


def fit_vectors(docs: DataFrame, text: str) -> Vectors:
    """Tables of partitions are cut into blocks of rows and summed by block: no task or driver holds more than one
    table of sums."""

    def run(batches):
        tables = counted(t.split() for b in batches for t in texts(b.column(0)))
        parts = [(k, i, zlib.compress(t[i : i + ROWS].astype("<i8").T.tobytes(), 1)) for k, t in enumerate(tables) for i in range(0, len(t), ROWS) if t[i : i + ROWS].any()]
        cols = list(zip(*parts, strict=True)) if parts else [[]] * 3
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int32(), pa.binary()), strict=True)], names=["kind", "at", "sums"])

    def add(blobs: list[bytes]) -> bytes:
        total = sum(np.frombuffer(zlib.decompress(x), "<i8") for x in blobs)
        return zlib.compress(total.tobytes(), 1)

    parts = docs.select(F.col(text).cast("string")).mapInArrow(run, "kind int, at int, sums binary")
    tables = np.zeros((WORDS, DIM)), np.zeros((SHAPES, DIM))
    for r in tree_sums(parts, ["kind", "at"], "sums", add).collect():  # 18 MB at most
        block = np.frombuffer(zlib.decompress(bytes(r["sums"])), "<i8").reshape(DIM, -1).T
        tables[r["kind"]][r["at"] : r["at"] + len(block)] = block
    return Vectors(*((t / np.maximum(np.linalg.norm(t, axis=1, keepdims=True), 1e-9)).astype(np.float32) for t in tables))


def pooled(words: list[bytes], vectors: Vectors, rows: Rows) -> np.ndarray:
    out = np.zeros(2 * DIM + 2, np.float32)
    if words:
        for i in range(0, len(words), PART):
            word, shapes = rows.of(words[i : i + PART])
            out[:DIM] += vectors.words[word].sum(0)
            out[DIM : 2 * DIM] += vectors.shapes[shapes].sum(0)
        out /= len(words)
        out[-2:] = np.log1p(len(words)), len(set(words)) / len(words)
    return out


class Network(NamedTuple):
    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.mean) / self.scale @ self.w1 + self.b1) @ self.w2 + self.b2

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -500, 500)))


def loss(logits: np.ndarray, y: np.ndarray) -> float:
    return float(np.mean(np.logaddexp(0, logits) - y * logits))


def constant(y: np.ndarray) -> Network:
    share = (y.sum() + 1) / (len(y) + 2)
    n = 2 * DIM + 2
    return Network(np.zeros(n), np.ones(n), np.zeros((n, HIDDEN)), np.zeros(HIDDEN), np.zeros(HIDDEN), float(np.log(share / (1 - share))), 1.0)


def fit_network(x: np.ndarray, y: np.ndarray, seed: int = 3) -> Network:
    """Adam on the cross-entropy, then the temperature that suits the rows held back best."""
    back = np.arange(len(y)) % CALIBRATE == 0
    if len(np.unique(y[~back])) < 2:
        return constant(y)
    rng = np.random.Generator(np.random.PCG64(seed))
    x = x.astype(np.float64)
    mean, scale = x[~back].mean(0), x[~back].std(0) + 1e-3
    z, t = (x[~back] - mean) / scale, y[~back].astype(np.float64)
    p = [rng.normal(0, 1 / np.sqrt(z.shape[1]), (z.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), np.zeros(1)]
    m, v = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p]
    step = 0
    for _ in range(EPOCHS):
        for rows in np.array_split(rng.permutation(len(t)), max(1, len(t) // BATCH)):
            h = np.tanh(z[rows] @ p[0] + p[1])
            err = (1 / (1 + np.exp(-(h @ p[2] + p[3][0]))) - t[rows]) / len(rows)
            back_h = err[:, None] * p[2] * (1 - h * h)
            grads = [z[rows].T @ back_h + DECAY * p[0], back_h.sum(0), h.T @ err + DECAY * p[2], np.array([err.sum()])]
            step += 1
            for i, g in enumerate(grads):
                m[i] = 0.9 * m[i] + 0.1 * g
                v[i] = 0.999 * v[i] + 0.001 * g * g
                p[i] = p[i] - RATE * m[i] / (1 - 0.9**step) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
    net = Network(mean, scale, p[0], p[1], p[2], float(p[3][0]), 1.0)
    logits = net.logits(x[back])
    temperatures = np.exp(np.linspace(np.log(0.25), np.log(20), 120))
    return net._replace(temperature=float(min(temperatures, key=lambda k: loss(logits / k, y[back]))))


def fit(docs: DataFrame, labels: DataFrame, id: str, text: str, label: str, sample: int = SAMPLE) -> tuple[Vectors, Network]:
    """``labels`` are those that may be learnt from."""
    vectors = fit_vectors(docs, text)
    sent = docs.sparkSession.sparkContext.broadcast(vectors)
    known = labels.where(F.col(id).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(id).alias("id")).agg(F.avg(label).alias("y"))
    known = known.orderBy(F.xxhash64("id"), "id").limit(sample)  # sample rows of 16 bytes: small enough to broadcast
    rows = docs.select(F.col(id).alias("id"), F.col(text).cast("string").alias("t")).join(F.broadcast(known), "id").select("id", "y", "t")

    def pool(batches):
        own = Rows()
        for b in batches:
            x = [pooled(t.split(), sent.value, own).astype(np.float64) for t in texts(b.column(2))]
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), b.column(1), pa.array(x, pa.list_(pa.float64()))], names=["id", "y", "x"])

    pooled_rows = rows.mapInArrow(pool, "id long, y double, x array<double>")
    # One row of 2 * DIM + 2 numbers for each id of the sample comes to the driver.
    means = F.array(*(F.avg(F.get("x", F.lit(i))) for i in range(2 * DIM + 2)))
    found = sorted(pooled_rows.groupBy("id").agg(F.first("y").alias("y"), means.alias("x")).collect(), key=lambda r: xxhash.xxh64_intdigest(str(r["id"])))
    x = np.array([r["x"] for r in found], np.float64).reshape(len(found), 2 * DIM + 2)
    return vectors, fit_network(x, np.array([r["y"] >= 0.5 for r in found], np.float64))


def with_quality(docs: DataFrame, vectors: Vectors, network: Network, text: str = "text") -> DataFrame:
    """The other columns of ``docs`` and ``score``."""
    keep = [c for c in docs.columns if c not in (text, "score")]
    sent = docs.sparkSession.sparkContext.broadcast((vectors, network))

    def run(batches):
        vectors, network = sent.value
        rows = Rows()
        for b in batches:
            x = np.array([pooled(t.split(), vectors, rows) for t in texts(b.column(b.num_columns - 1))]).reshape(b.num_rows, 2 * DIM + 2)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(network.score(x.astype(np.float64)))], names=[*keep, "score"])

    return docs.select(*keep, F.col(text).cast("string").alias("_text")).mapInArrow(run, docs.select(*keep, F.lit(0.0).alias("score")).schema)
