"""A hidden Markov language model over word classes.

Counts of all training tokens are summed by word over the cluster; each chunk of documents asks for the counts of its
own distinct words. A word that makes up at least one in ``alphabet(N)`` of the N training tokens is a class of its
own, so classes grow with the corpus; all other words share classes by their ending, the text's end is a class. So a
word's probability is that of its class, from the hidden Markov model, times that of the word in its class, from the
counts. Latent states start from an expectation-maximisation fit to the corpus' counts of neighbouring classes
(COARSE of them, a table of fixed size); Baum-Welch rounds then run the forward and backward recursions over every
whole training text, their expected counts summed across partitions, until a round improves the training tokens'
mean log-likelihood by less than ``TOLERANCE``. Scores come from the scaled forward recursion over each whole text.

The driver holds class tables, never a vocabulary: at most MOST words can make up one in MOST tokens each, so what is
sent to executors is bounded by 2 * MOST classes of STATES numbers. Chunks grow with the corpus (common.chunk_bytes), so
that the entries for a word that every chunk has stay few.

Defined results. A null text is empty and scores as its end alone. A null id trains. Words that training never saw
share half a count, in their class and in the unigram base alike. Without training documents every score is finite.
Repeated rows train and score as often as they come. An empty table gives an empty table.
"""

from __future__ import annotations

import math
import struct
import zlib
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import chunk_bytes, cut, longs, shuffle_partitions, texts, tree_sums

CHUNK_BYTES, MOST_CHUNK_BYTES = 4 << 20, 32 << 20
LEAST, MOST = 1 << 10, 1 << 15
COARSE_TOP, COARSE_REST = 511, 256
COARSE = COARSE_TOP + COARSE_REST + 1
STATES = 12
BIGRAM_ROUNDS = 120
#: Nats a token.
TOLERANCE = 4e-3
SMOOTH = 0.1
SUMS = 16
NONE = 0xFFFF


def alphabet(tokens: int) -> int:
    return min(MOST, max(LEAST, 4 * math.isqrt(tokens)))


def ending(word: bytes) -> int:
    return zlib.crc32(word[-3:])


class Model(NamedTuple):
    start: np.ndarray  # (STATES,)
    move: np.ndarray  # (STATES, STATES)
    emit: np.ndarray  # (STATES, classes)


def packed(*arrays: np.ndarray) -> bytes:
    """Arrays, compressed one by one."""
    parts = [np.ascontiguousarray(a) for a in arrays]
    out = [struct.pack("<I", len(parts))]
    for a in parts:
        body = pa.compress(a.tobytes(), "zstd", asbytes=True) if a.nbytes else b""
        out += [struct.pack("<4sQQ", a.dtype.str.encode().ljust(4), a.nbytes, len(body)), body]
    return b"".join(out)


def unpacked(blob: bytes) -> list[np.ndarray]:
    at, out = 4, []
    for _ in range(struct.unpack_from("<I", blob)[0]):
        kind, size, stored = struct.unpack_from("<4sQQ", blob, at)
        at += 20
        raw = pa.decompress(blob[at : at + stored], size, "zstd", asbytes=True) if size else b""
        out.append(np.frombuffer(raw, kind.decode().strip()))
        at += stored
    return out


def joined(words: list[bytes]) -> bytes:
    return packed(np.frombuffer(b" ".join(words), np.uint8))


def unjoined(blob: bytes) -> list[bytes]:
    text = unpacked(blob)[0].tobytes()
    return text.split(b" ") if text else []


ASKED = "kind int, bucket int, chunk int, words binary, state binary, tokens long"
"""kind 0: distinct words of a chunk, in order, with their counts in its training texts; 1: the chunk's texts as
numbers of those words, and how many of its tokens train."""


def asked(parts: DataFrame, buckets: int) -> DataFrame:
    def run(group: pa.Table) -> pa.Table:
        chunk = group.column("chunk")[0].as_py()
        ids, train = longs(group.column("id")), group.column("train").to_numpy(zero_copy_only=False).astype(bool)
        number: dict[bytes, int] = {}
        found, sizes = [], np.zeros(group.num_rows, np.int64)
        for i, text in enumerate(texts(group.column("text"))):
            words = text.lower().split()
            sizes[i] = len(words)
            for w in words:
                if w not in number:
                    number[w] = len(number)
            found.append(np.fromiter(map(number.__getitem__, words), np.int64, len(words)))
        flat = np.concatenate(found) if found else np.zeros(0, np.int64)
        counts = np.bincount(flat[np.repeat(train, sizes)], minlength=len(number))
        placed = sorted((zlib.crc32(w) % buckets, w, n) for w, n in number.items())
        new = np.empty(len(placed), np.int64)
        new[[n for _, _, n in placed]] = np.arange(len(placed))
        counts = counts[[n for _, _, n in placed]] if placed else counts
        where = np.array([b for b, _, _ in placed], np.int64)
        cuts = [0, *(np.flatnonzero(np.diff(where)) + 1).tolist(), len(placed)] if placed else [0]
        rows = [(0, int(where[a]), chunk, joined([w for _, w, _ in placed[a:b]]), packed(counts[a:b].astype(np.int64)), None) for a, b in zip(cuts, cuts[1:])]
        rows.append((1, None, chunk, joined([w for _, w, _ in placed]), packed(ids, group.column("none").to_numpy(zero_copy_only=False).astype(np.uint8), train.astype(np.uint8), sizes, new[flat].astype(np.uint16 if len(placed) < NONE else np.uint32)), int(sizes[train].sum())))
        cols = list(zip(*rows, strict=True))
        return pa.table([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.int64()), strict=True)], names=["kind", "bucket", "chunk", "words", "state", "tokens"])

    return parts.groupBy("chunk").applyInArrow(run, ASKED)


TOLD = "chunk int, bucket int, counts binary, top array<struct<c:long,w:binary>>, rest array<struct<n:long,v:long>>"
"""A chunk's counts in the order in which it asked; or, without a chunk, a bucket's words that are classes of their own
and the counts and numbers of words of its other classes."""


def told(requests: DataFrame, tokens: int, rest: int) -> DataFrame:
    least = max(1, -(-tokens // alphabet(tokens)))

    def run(group: pa.Table) -> pa.Table:
        bucket = group.column("bucket")[0].as_py()
        total: dict[bytes, int] = {}
        asked_for = []
        for chunk, words, state in zip(*(group.column(c).to_pylist() for c in ("chunk", "words", "state")), strict=True):
            w = unjoined(words)
            asked_for.append((chunk, w))
            for word, c in zip(w, unpacked(state)[0].tolist(), strict=True):
                total[word] = total.get(word, 0) + c
        n, v = [0] * rest, [0] * rest
        top = []
        for word, c in total.items():
            if c >= least:
                top.append({"c": c, "w": word})
            elif c:
                n[ending(word) % rest] += c
                v[ending(word) % rest] += 1
        rows = [(chunk, bucket, packed(np.fromiter(map(total.__getitem__, w), np.int64, len(w))), None, None) for chunk, w in asked_for]
        rows.append((None, bucket, None, top, [{"n": a, "v": b} for a, b in zip(n, v, strict=True)]))
        types = (pa.int32(), pa.int32(), pa.binary(), pa.list_(pa.struct([("c", pa.int64()), ("w", pa.binary())])), pa.list_(pa.struct([("n", pa.int64()), ("v", pa.int64())])))
        return pa.table([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=["chunk", "bucket", "counts", "top", "rest"])

    return requests.groupBy("bucket").applyInArrow(run, TOLD)


class Counts(NamedTuple):
    top: dict[bytes, int]  # word to class, most frequent first
    rest: int  # classes of words by their ending
    n: np.ndarray  # tokens of each class; the last is the text's end
    v: np.ndarray  # distinct words of each class
    coarse: np.ndarray  # of each class the class that the start of the states is fitted with
    tokens: int
    words: int

    def kind(self, word: bytes) -> int:
        found = self.top.get(word)
        return len(self.top) + ending(word) % self.rest if found is None else found


def gathered(answers: DataFrame, ends: int, rest: int) -> Counts:
    own = answers.where("chunk IS NULL")
    best = own.select(F.explode("top").alias("t")).orderBy(F.desc("t.c"), "t.w").collect()  # MOST at most
    others = own.select(F.posexplode("rest").alias("g", "x")).groupBy("g").agg(F.sum("x.n").alias("n"), F.sum("x.v").alias("v")).collect()
    top = {bytes(r["t"]["w"]): k for k, r in enumerate(best)}
    n, v = np.zeros(len(top) + rest + 1, np.int64), np.zeros(len(top) + rest + 1, np.int64)
    n[: len(top)], v[: len(top)] = [r["t"]["c"] for r in best], 1
    for r in others:
        n[len(top) + r["g"]], v[len(top) + r["g"]] = r["n"], r["v"]
    n[-1], v[-1] = ends, int(ends > 0)
    coarse = [k if k < COARSE_TOP else COARSE_TOP + ending(w) % COARSE_REST for w, k in top.items()]
    coarse += [COARSE_TOP + g % COARSE_REST for g in range(rest)] + [COARSE - 1]
    return Counts(top, rest, n, v, np.array(coarse), int(n.sum()), int(v.sum()))


CODED = "chunk int, state binary"


def coded(states: DataFrame, answers: DataFrame, counts: Counts) -> DataFrame:
    """Each chunk's texts as classes, with what does not depend on the model: ids, sizes, known words, base scores,
    and the words' scores inside their classes."""

    def run(group: pa.Table, said: pa.Table) -> pa.Table:
        if not group.num_rows:
            return pa.table({"chunk": pa.array([], pa.int32()), "state": pa.array([], pa.binary())})
        ids, none, train, sizes, flat = unpacked(group.column("state")[0].as_py())
        words = unjoined(group.column("words")[0].as_py())
        replies = sorted(zip(said.column("bucket").to_pylist(), said.column("counts").to_pylist(), strict=True))
        c = np.concatenate([unpacked(b)[0] for _, b in replies]) if replies else np.zeros(0, np.int64)
        c = np.append(c, counts.n[-1])  # the end is the word after all others
        end = len(counts.n) - 1
        kind = np.array([*map(counts.kind, words), end], np.int64)
        base = np.log10((c + 0.5) / (counts.tokens + 0.5 * (counts.words + 1)))
        # Classes of one word can't hold an unseen one.
        own = np.log10((c + 0.5) / (counts.n[kind] + 0.5 * (counts.v[kind] + 1)))
        own[(kind < len(counts.top)) | (kind == end)] = 0.0
        first = np.cumsum(np.append(0, sizes))
        with_end = np.insert(flat.astype(np.int64), first[1:], len(words))
        start = first[:-1] + np.arange(len(sizes))
        sums = [np.add.reduceat(x[with_end], start) if len(sizes) else np.zeros(0) for x in (base, own, (c > 0).astype(np.int64))]
        return pa.table({"chunk": pa.array([group.column("chunk")[0].as_py()], pa.int32()), "state": pa.array([packed(ids, none, train, sizes + 1, *sums, kind[with_end].astype(np.uint16))], pa.binary())})

    return states.groupBy("chunk").cogroup(answers.where("chunk IS NOT NULL").groupBy("chunk")).applyInArrow(run, CODED)


def summed(rows: DataFrame, f, spark) -> list[np.ndarray]:
    """f(iterator of blobs) gives arrays for each partition; their sums. SUMS blobs come to the driver."""

    def each(batches):
        total = f(x for b in batches for x in b.column(0).to_pylist())
        yield pa.RecordBatch.from_arrays([pa.array([packed(*total)], pa.binary())], names=["x"])

    def add(blobs: list[bytes]) -> bytes:
        total = unpacked(blobs[0])
        for x in blobs[1:]:
            total = [a + b for a, b in zip(total, unpacked(x), strict=True)]
        return packed(*total)

    partial = rows.select("state").mapInArrow(each, "x binary")
    blobs = [unpacked(bytes(r["x"])) for r in tree_sums(partial, [], "x", add, SUMS, 16).collect()]
    return [sum(x) for x in zip(*blobs, strict=True)]


def bigrams(coarse: np.ndarray):
    def run(blobs):
        total = np.zeros(COARSE * COARSE, np.int64)
        for blob in blobs:
            _, _, train, sizes, *_, kind = unpacked(blob)
            learnt = np.repeat(train.astype(bool), sizes)
            k = coarse[kind[learnt]]
            own = np.repeat(np.arange(len(sizes)), sizes)[learnt]
            pair = own[1:] == own[:-1]
            total += np.bincount(k[:-1][pair] * COARSE + k[1:][pair], minlength=COARSE * COARSE)
        return [total]

    return run


def start_model(pairs: np.ndarray, counts: Counts, seed: int = 5) -> Model:
    """States fitted to the counts of neighbouring coarse classes alone; a class has its share of its coarse one."""
    x = pairs.reshape(COARSE, COARSE) + 1e-4
    x /= x.sum()
    rng = np.random.Generator(np.random.PCG64(seed))
    unigram = (x.sum(0) + x.sum(1)) / 2
    emit = unigram * rng.gamma(1.0, 1.0, (STATES, COARSE)) + 1e-9
    emit /= emit.sum(1, keepdims=True)
    joint = rng.gamma(2.0, 1.0, (STATES, STATES)) + 4 * np.eye(STATES)
    joint /= joint.sum()
    for _ in range(BIGRAM_ROUNDS):
        ratio = x / (emit.T @ joint @ emit)
        left, right = emit @ ratio, ratio @ emit.T
        more = emit * (joint @ right.T) + emit * (joint.T @ left)
        joint = joint * (emit @ ratio @ emit.T)
        joint /= joint.sum()
        emit = more + 1e-9 * unigram
        emit /= emit.sum(1, keepdims=True)
    state = joint.sum(1) + 1e-9
    share = (counts.n + SMOOTH) / np.bincount(counts.coarse, counts.n + SMOOTH, minlength=COARSE)[counts.coarse]
    emit = emit[:, counts.coarse] * share
    return Model(state / state.sum(), (joint + 1e-9) / (joint + 1e-9).sum(1, keepdims=True), emit / emit.sum(1, keepdims=True))


def expected(model: Model, at_once: int = 3):
    """Expected counts of starts, moves and emissions over whole training texts, their log-likelihood and tokens."""
    move, emit, start = model.move.astype(np.float32), np.ascontiguousarray(model.emit.T.astype(np.float32)), model.start.astype(np.float32)
    states, classes = model.emit.shape

    def add(total: list[np.ndarray], held: list[tuple[np.ndarray, np.ndarray]]) -> None:
        sizes, kind = (np.concatenate(x) for x in zip(*held, strict=True))
        if not len(sizes):
            return
        order = np.argsort(-sizes, kind="stable")
        at, size = (np.cumsum(sizes) - sizes)[order], sizes[order]
        live = np.searchsorted(-size, -np.arange(1, int(size[0]) + 1), side="right").tolist()
        seen = [kind[at[:m] + t] for t, m in enumerate(live)]
        alphas, scales = [], []
        a = np.broadcast_to(start, (len(size), states))
        for o in seen:
            a = a[: len(o)] * emit[o]
            s = a.sum(1, keepdims=True)
            a /= s
            alphas.append(a)
            scales.append(s)
            a = a @ move
        moves = np.zeros((states, states))
        beta = np.ones((live[-1], states), np.float32)
        for t in range(len(live) - 1, -1, -1):
            if len(beta) < live[t]:
                beta = np.concatenate([beta, np.ones((live[t] - len(beta), states), np.float32)])
            if t:
                ahead = emit[seen[t]] * beta / scales[t]
                moves += alphas[t - 1][: live[t]].T @ ahead
                alphas[t] *= beta
                beta = ahead @ move.T
        alphas[0] *= beta
        gamma, o = np.concatenate(alphas), np.concatenate(seen).astype(np.int64)
        total[0] += alphas[0].sum(0)
        total[1] += (moves * move).ravel()
        total[2] += np.concatenate([np.bincount(o, gamma[:, k], minlength=classes) for k in range(states)]).astype(np.float32)
        total[3] += [float(np.log(np.concatenate(scales).astype(np.float64)).sum()), len(o)]

    def run(blobs):
        total = [np.zeros(states), np.zeros(states * states), np.zeros(states * classes, np.float32), np.zeros(2)]
        held: list = []
        for blob in blobs:
            _, _, train, sizes, *_, kind = unpacked(blob)
            train = train.astype(bool)
            held.append((sizes[train], kind[np.repeat(train, sizes)]))
            if len(held) == at_once:
                add(total, held)
                held = []
        if held:
            add(total, held)
        return total

    return run


def improved(parts: list[np.ndarray], counts: Counts) -> Model:
    starts, moves, emits = parts[0] + SMOOTH, parts[1].reshape(STATES, STATES) + SMOOTH, parts[2].reshape(STATES, -1).astype(np.float64)
    emits = emits + SMOOTH * (counts.n + 1) / (counts.n + 1).sum() * STATES
    return Model(starts / starts.sum(), moves / moves.sum(1, keepdims=True), emits / emits.sum(1, keepdims=True))


def trained(rows: DataFrame, counts: Counts) -> Model:
    spark = rows.sparkSession
    found = summed(rows, bigrams(counts.coarse), spark)
    model = start_model(found[0] if found else np.zeros(COARSE * COARSE, np.int64), counts)
    before = -math.inf
    while (found := summed(rows, expected(model), spark)) and found[3][1]:
        model = improved(found, counts)
        now = found[3][0] / found[3][1]
        if now - before < TOLERANCE:
            break
        before = now
    return model


def forward(model: Model, kind: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """log10 likelihood of each sequence, whole: one step of all that are still running at a time."""
    order = np.argsort(-sizes, kind="stable")
    at, size = (np.cumsum(sizes) - sizes)[order], sizes[order]
    emit = np.ascontiguousarray(model.emit.T)
    total = np.zeros(len(sizes))
    if not len(sizes):
        return total
    live = np.searchsorted(-size, -np.arange(1, int(size[0]) + 1), side="right")
    a = np.broadcast_to(model.start, (len(size), len(model.start)))
    for t, m in enumerate(live.tolist()):
        a = (a if t == 0 else a[:m] @ model.move) * emit[kind[at[:m] + t]]
        s = a.sum(1)
        a = a / s[:, None]
        total[:m] += np.log10(s)
    out = np.empty(len(sizes))
    out[order] = total
    return out


SCORED = "id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"


def scored(rows: DataFrame, model: Model, at_once: int = 8) -> DataFrame:
    def run(batches):
        held: list = []

        def flush():
            cols = [np.concatenate(x) for x in zip(*held, strict=True)]
            held.clear()
            ids, none, train, sizes, base, own, known, kind = cols
            score = forward(model, kind, sizes) + own
            return pa.RecordBatch.from_arrays([pa.array(ids, mask=none.astype(bool)), pa.array(train == 0), pa.array(sizes), pa.array(known.astype(np.int64)), pa.array(base), pa.array(score)], names=["id", "held_out", "n_tokens", "n_known", "base_score", "score"])

        for b in batches:
            for blob in b.column(0):
                held.append(unpacked(blob.as_py()))
                if len(held) == at_once:
                    yield flush()
        if held:
            yield flush()

    return rows.select("state").mapInArrow(run, SCORED)


def language_model(docs: DataFrame, train: Column, id: str = "doc_id", text: str = "text") -> tuple[DataFrame, Counts, Model]:
    """SCORED rows of all of ``docs``, learnt from the rows where ``train`` is not false; the counts; the model."""
    spark = docs.sparkSession
    total = docs.agg(F.sum(F.octet_length(text)).alias("b"), F.count("*").alias("n"), F.sum(F.coalesce(train, F.lit(True)).cast("long")).alias("t")).first()
    size = (total["b"] or 0) + 64 * total["n"]
    chunks = max(1, -(-size // chunk_bytes(size, CHUNK_BYTES, MOST_CHUNK_BYTES)))
    parts = docs.select(F.pmod(F.xxhash64(F.col(id).cast("long")), F.lit(chunks)).cast("int").alias("chunk"), F.col(id).cast("long").alias("id"), F.col(id).isNull().alias("none"), F.coalesce(train, F.lit(True)).alias("train"), F.col(text).cast("string").alias("text"))
    first = cut(asked(parts, max(shuffle_partitions(spark), chunks // 4, 1)))
    ends = int(total["t"] or 0)
    tokens = int(first.where("kind = 1").agg(F.sum("tokens")).first()[0] or 0) + ends
    rest = max(COARSE_REST, alphabet(tokens) // 32)
    answers = cut(told(first.where("kind = 0").select("bucket", "chunk", "words", "state"), tokens, rest))
    counts = gathered(answers, ends, rest)
    rows = cut(coded(first.where("kind = 1").select("chunk", "words", "state"), answers.select("chunk", "bucket", "counts"), counts))
    model = trained(rows, counts)
    return scored(rows, model), counts, model
