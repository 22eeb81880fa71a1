"""Removal of byte strings that already occur in an earlier document, by a depth-limited radix order of suffixes.

A suffix is told apart from others only through ``length`` bytes. Suffixes are ordered by most-significant-digit
passes over partitions, and after each pass only groups with more than one member go on:

1. First digit: the rarest-hash 16-gram (minimiser) of a window of ``length`` bytes. Windows that start at
   neighbouring places share it, so about one place in eighteen is dealt out, and equal windows share the digit.
2. Second digit: all the bytes around that 16-gram that any window over it can touch. Equal groups there are
   repeated windows at once.
3. Third digit, only for 16-grams seen in different surroundings: the half of the surroundings before the 16-gram
   and the half after it. A window over the 16-gram has one of the two whole.
4. Last digit, only for windows over a half that is seen again: the window itself.

The groups that are left equal are exactly the repeated windows (digits are compared by at least 96 bits of hash
of the whole content they stand for). Documents are dealt to some thousand chunks once, of ``CHUNK_BYTES`` to
``MOST_CHUNK_BYTES``; every later step reads that exchange again. A chunk is worked on in pieces of ``PIECE_BYTES`` (of
up to ``MOST_CHUNK_BYTES`` in a corpus of over a TiB), which bound memory, and sends a row to each bucket for all its
pieces, so rows do not grow with the square of the corpus as chunks times buckets do. A piece sends each distinct digit
once with the least document that has it, so a passage in a third of all documents costs each bucket one entry a piece,
which is 14 bytes. A bucket's work grows with its entries, however many chunks they are from.

Defined results. A null text is empty. A null id orders after every id. Rows with the same id count as one
document among themselves. Texts under ``length`` bytes stay as they are. An empty table gives an empty table.
Other columns pass through, whatever they are called.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import buffers, chunk_bytes, longs, pack, tidy, unpack

PIECE_BYTES, CHUNK_BYTES, MOST_CHUNK_BYTES = 1 << 20, 1 << 20, 16 << 20
BUCKET_BYTES = 4 << 20
GRAM = 16
TILE = 1 << 17
_RNG = np.random.Generator(np.random.PCG64(7))
BYTE_CODE = _RNG.integers(1 << 62, (1 << 64) - 1, 256, np.uint64) | np.uint64(1)
BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
M1, M2, M3 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53), np.uint64(0xD6E8FEB86659FD93)
LOW32 = np.uint64((1 << 32) - 1)
_powers: dict[np.uint64, np.ndarray] = {}


def powers(base: np.uint64, n: int) -> np.ndarray:
    if len(_powers.get(base, ())) < n:
        _powers[base] = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n - 1, base)]), dtype=np.uint64)
    return _powers[base]


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * M3
    return x ^ (x >> np.uint64(29))


def slide(x: np.ndarray, width: int, f) -> np.ndarray:
    """f over x[i : i + width], for every i that has so many."""
    have = 1
    while have < width:
        step = min(have, width - have)
        x = f(x[:-step], x[step:]) if step < len(x) else x[:0]
        have += step
    return x


class Chunk:
    """The documents of a piece of a chunk, end to end in the order of their ids, and their anchors."""

    def __init__(self, ids: np.ndarray, column, length: int):
        data, at = buffers(column)
        self.order = np.argsort(ids, kind="stable")
        sizes = np.diff(at)[self.order]
        self.bounds = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        self.data = np.concatenate([data[at[i] : at[i + 1]] for i in self.order]) if len(ids) else data
        self.ids, self.rank = np.unique(ids[self.order], return_inverse=True)
        self.length, self.width = length, length - GRAM + 1
        self.n = len(self.data)
        self._anchors()

    def _anchors(self) -> None:
        """Places of the 16-grams that are least in some window, their hashes, and the least hash of each window."""
        n, length, width = self.n, self.length, self.width
        self.least = np.zeros(max(0, n - length + 1), np.uint64)
        found, hashes = [], []
        padded = np.concatenate([self.data, np.zeros(GRAM, np.uint8)])
        for lo in range(0, n - length + 1, TILE):
            hi = min(lo + TILE, n - length + 1)  # windows that start in [lo, hi)
            first, last = max(0, lo - width + 1), hi + width - 1  # 16-grams at stake
            part = padded[first : last + GRAM]
            m = last - first
            view = np.ndarray((len(part) - 7,), "<u8", part.tobytes(), strides=(1,))
            h = view[:m] * M1
            h ^= (view[8 : 8 + m] ^ (h >> np.uint64(31))) * M2
            h = mixed(h) | np.uint64(1)
            least = slide(h, width, np.minimum)  # of windows that start from first on
            # Of those that run over the end of a document nothing is asked.
            ends = self.bounds[slice(*np.searchsorted(self.bounds, (first + 1, first + len(least) + length - 1)))]
            over = (ends[:, None] - first - np.arange(1, length)).ravel()
            least[over[(over >= 0) & (over < len(least))]] = 0
            self.least[lo:hi] = least[lo - first : hi - first]
            edge = np.zeros(width - 1, np.uint64)
            most = slide(np.concatenate([edge, least, edge]), width, np.maximum)
            # A 16-gram under the next tile's windows too is looked at there again, with all its windows.
            at = np.flatnonzero(h == most)
            found.append(at + first)
            hashes.append(h[at])
        at = np.concatenate(found) if found else np.zeros(0, np.int64)
        h = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        self.at, once = np.unique(at, return_index=True)
        h = h[once]
        doc = np.searchsorted(self.bounds, self.at, side="right") - 1
        self.start = np.maximum(self.at - width + 1, self.bounds[doc])
        self.end = np.minimum(self.at + length, self.bounds[doc + 1])
        self.doc = self.rank[doc]
        self.gram = h >> np.uint64(16)  # 48 bits
        self.sums = np.zeros(self.n + 1, np.uint64)
        np.take(BYTE_CODE, self.data, out=self.sums[1:])
        self.sums[1:] *= powers(BASE, self.n + 1)[: self.n]
        np.cumsum(self.sums, out=self.sums)
        around = self._hash(self.start, self.end) + (self.at - self.start).astype(np.uint64) * M1 + (self.end - self.at).astype(np.uint64) * M2
        self.around = mixed(around) >> np.uint64(16)

    def _hash(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return (self.sums[b] - self.sums[a]) * powers(INVERSE, self.n + 1)[a]

    def entries(self) -> Chunk:
        """Distinct (gram, around) in order, each with its least document; of: the entry of each anchor."""
        order = np.lexsort((self.doc, self.around, self.gram))
        g, c = self.gram[order], self.around[order]
        new = np.ones(len(order), bool)
        new[1:] = (g[1:] != g[:-1]) | (c[1:] != c[:-1])
        self.of = np.empty(len(order), np.int64)
        self.of[order] = np.cumsum(new) - 1
        first = order[new]
        self.e_at, self.e_gram, self.e_around, self.e_doc = first, self.gram[first], self.around[first], self.doc[first]
        return self

    def sides(self, anchors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sorted keys of the halves of these anchors' surroundings, whose anchor each is, whether it is the later."""
        half = (self.width - 1) // 2
        i = np.flatnonzero(self.at[anchors] - self.start[anchors] >= half)
        j = np.flatnonzero(self.end[anchors] - self.at[anchors] >= GRAM + half)
        a, b = self.at[anchors[i]], self.at[anchors[j]]
        key = mixed(np.concatenate([self._hash(a - half, a + GRAM), self._hash(b, b + GRAM + half) * M2]))
        order = np.argsort(key, kind="stable")
        return key[order], np.concatenate([i, j])[order], np.repeat([False, True], [len(i), len(j)])[order]

    def windows(self, anchors: np.ndarray, before: np.ndarray, after: np.ndarray) -> tuple[np.ndarray, ...]:
        """Distinct windows over these anchors that have the half before, or after, where told: key, second key,
        least document; and anchor, place and number among the distinct ones of each window."""
        half = (self.width - 1) // 2
        p = self.start[anchors, None] + np.arange(self.width)[None, :]
        lead = self.at[anchors, None] - p
        ok = (lead >= 0) & (p + self.length <= self.end[anchors, None])
        ok &= before[:, None] & (lead >= half) | after[:, None] & (self.width - 1 - lead >= half)
        a, p = np.broadcast_to(anchors[:, None], p.shape)[ok], p[ok]
        if len(p):
            right = self.least[p] >> np.uint64(16) == self.gram[a]
            a, p = a[right], p[right]
        key = mixed(self._hash(p, p + self.length))
        other = (self.gram[a] ^ ((self.at[a] - p).astype(np.uint64) << np.uint64(24))) & LOW32
        order = np.lexsort((self.doc[a], other, key))
        k, o = key[order], other[order]
        new = np.ones(len(order), bool)
        new[1:] = (k[1:] != k[:-1]) | (o[1:] != o[:-1])
        of = np.empty(len(order), np.int64)
        of[order] = np.cumsum(new) - 1
        first = order[new]
        return key[first], other[first], self.doc[a][first], a, p, of

    def copied(self, a: np.ndarray, p: np.ndarray, anchors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bounds of the runs of windows, at p over the anchors a, at each of ``anchors`` with the same surroundings."""
        new = np.ones(len(p), bool)
        new[1:] = (a[1:] != a[:-1]) | (p[1:] != p[:-1] + 1)
        lo = np.flatnonzero(new)
        hi = np.append(lo[1:], len(p))[: len(lo)] - 1
        anchors = anchors[np.argsort(self.of[anchors], kind="stable")]
        first, last = (np.searchsorted(self.of[anchors], self.of[a[lo]], side=s) for s in ("left", "right"))
        n = last - first
        run = np.repeat(np.arange(len(lo)), n)
        to = anchors[np.arange(len(run)) + np.repeat(first - np.cumsum(n) + n, n)]
        by = self.start[to] - self.start[a[lo]][run]
        return p[lo][run] + by, p[hi][run] + self.length + by


def in_order(group: pa.Table) -> pa.Table:
    """The rows of a chunk by id and text. A shuffle hands them over in another order each time that it is read, and
    answers count on pieces of the same rows."""
    rows = pa.table([pa.array(longs(group.column("id"))), group.column("body").combine_chunks()], names=["id", "body"])
    return group.take(pc.sort_indices(rows, sort_keys=[("id", "ascending"), ("body", "ascending")]))


def bucket_of(key: np.ndarray, bits: int, buckets: int) -> np.ndarray:
    """Even ranges of the values of keys of so many bits."""
    return ((key >> np.uint64(bits - 32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def pieces(sizes: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Bounds of runs of rows, which end with the row that brings them to ``most`` bytes."""
    out, at, held = [], 0, 0
    for i, n in enumerate(sizes.tolist(), 1):
        held += n
        if held >= most or i == len(sizes):
            out.append((at, i))
            at, held = i, 0
    return out


ENTRY = "bucket int, chunk int, x binary, y binary, d binary, ids binary"
REPLY = "chunk int, kind int, bucket int, lower binary, mixed binary"


def packed_ids(ids: np.ndarray) -> bytes:
    """Ascending ids as the first and the steps, in as many bytes as the largest step takes."""
    if not len(ids):
        return b""
    steps = (ids[1:].astype(np.uint64) - ids[:-1].astype(np.uint64)) if len(ids) > 1 else np.zeros(0, np.uint64)
    width = max(1, -(-int(steps.max()).bit_length() // 8)) if len(steps) else 1
    return ids[:1].tobytes() + bytes([width]) + pack(steps, width)


def unpacked_ids(blob: bytes) -> np.ndarray:
    if not blob:
        return np.zeros(0, np.int64)
    steps = unpack(blob[9:], blob[8])
    return np.concatenate([np.frombuffer(blob, np.uint64, 1), np.frombuffer(blob, np.uint64, 1) + np.cumsum(steps)]).astype(np.int64)


def sent(chunk: int, parts: list[tuple[np.ndarray, ...]], bits: int, buckets: int, wide: int) -> pa.Table:
    """What a chunk's pieces send, each first keys in order, second keys and documents' ids, or first keys alone: a row
    for each bucket, in which one piece's entries follow another's."""
    rows: list = []
    x, *more = (np.concatenate(column) for column in zip(*parts, strict=True)) if parts else [np.zeros(0, np.uint64)]
    bucket = bucket_of(x, bits, buckets)
    order = np.argsort(bucket, kind="stable")
    bucket, first = bucket[order], pack(x[order], wide)
    second, ids = (pack(more[0][order], 12 - wide), more[1][order]) if more else (b"", None)
    cuts = np.flatnonzero(np.diff(bucket)) + 1
    for i, j in zip([0, *cuts.tolist()], [*cuts.tolist(), len(x)], strict=True) if len(x) else []:
        own = int(bucket[i]), chunk, first[i * wide : j * wide]
        if ids is None:
            rows.append((*own, b"", b"", b""))
            continue
        used, d = np.unique(ids[i:j], return_inverse=True)
        rows.append((*own, second[i * (12 - wide) : j * (12 - wide)], pack(d.astype(np.uint64), next(n for n in (1, 2, 4) if len(used) <= 1 << 8 * n)), packed_ids(used)))
    cols = list(zip(*rows, strict=True)) if rows else [[]] * 6
    return pa.table([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int32(), *[pa.binary()] * 4), strict=True)], names=["bucket", "chunk", "x", "y", "d", "ids"])


SURROUNDINGS, SIDES, WINDOWS = range(3)


def reply(out: list[tuple]) -> pa.Table:
    cols = list(zip(*out, strict=True)) if out else [[]] * 5
    return pa.table([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary()), strict=True)], names=["chunk", "kind", "bucket", "lower", "mixed"])


def judge(kind: int, wide: int):
    """The bucket's side: for each sender, which entries an earlier document has too, and which of the rest stand
    beside others under their first digit. Of SIDES only the latter is asked."""

    def run(group: pa.Table) -> pa.Table:
        tidy()
        bucket = group.column("bucket")[0].as_py()
        rows = sorted(zip(group.column("chunk").to_pylist(), *(group.column(c).to_pylist() for c in ("x", "y", "d", "ids")), strict=True), key=lambda r: r[0])
        x = unpack(b"".join(r[1] for r in rows), wide)
        sizes = [len(r[1]) // wide for r in rows]
        bounds = np.cumsum([0, *sizes])

        def told(low: np.ndarray, mix: np.ndarray) -> pa.Table:
            """Places among all entries as places in the rows of their senders."""
            out, ends = [], []
            for at in (low, mix):
                at.sort()
                ends.append(np.searchsorted(at, bounds).tolist())
            own = [(at - np.repeat(bounds[:-1], np.diff(e))).astype(np.uint32) for at, e in zip((low, mix), ends, strict=True)]
            for i, r in enumerate(rows):
                (a, b), (c, d) = ((e[i], e[i + 1]) for e in ends)
                if b > a or d > c:
                    out.append((r[0], kind, bucket, own[0][a:b].tobytes(), own[1][c:d].tobytes()))
            return reply(out)

        order = np.argsort(x, kind="stable")
        k = x[order]
        same = np.zeros(len(k), bool)
        same[1:] = k[1:] == k[:-1]
        same[:-1] |= same[1:]
        order = order[same]  # what stands alone under the first digit is done
        del k, same
        if kind == SIDES:
            return told(order[:0], order)
        y = unpack(b"".join(r[2] for r in rows), 12 - wide)[order]
        ids = np.concatenate([unpacked_ids(r[4])[unpack(r[3], len(r[3]) // max(1, n)).astype(np.int64)] for r, n in zip(rows, sizes, strict=True)])[order]
        x = x[order]
        rows = [(r[0], None) for r in rows]
        again = np.lexsort((ids, y, x))
        x, y, ids, at = x[again], y[again], ids[again], order[again]
        new_x, new = np.ones(len(x), bool), np.ones(len(x), bool)
        new_x[1:] = x[1:] != x[:-1]
        new[1:] = new_x[1:] | (y[1:] != y[:-1])
        group_of = np.cumsum(new) - 1
        lower = ids > ids[new][group_of] if len(ids) else new
        x_of = np.cumsum(new_x) - 1
        beside = np.bincount(x_of[new])[x_of] > 1 if len(x) else new
        return told(at[lower], at[~lower & beside] if kind == SURROUNDINGS else at[:0])

    return run


class Replies:
    """What a chunk was told of the entries of one kind, looked up piece by piece as they were sent."""

    def __init__(self, table: pa.Table, kind: int, bits: int, buckets: int):
        self.bits, self.buckets = bits, buckets
        self.before = np.zeros(buckets, np.int64)  # entries of earlier pieces
        rows = [r for r in zip(*(table.column(c).to_pylist() for c in ("kind", "bucket", "lower", "mixed")), strict=True) if r[0] == kind]
        self.told = [self._places([r[1] for r in rows], [r[i] for r in rows]) for i in (2, 3)]

    @staticmethod
    def _places(buckets: list[int], blobs: list[bytes]) -> np.ndarray:
        """Bucket and place there as one number, in order."""
        at = np.frombuffer(b"".join(blobs), np.uint32).astype(np.int64)
        return np.sort(at + (np.repeat(np.array(buckets, np.int64), [len(x) // 4 for x in blobs]) << 32))

    def of(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For the next piece's keys, in order: which have an earlier document, and which stand beside others."""
        bucket = bucket_of(key, self.bits, self.buckets)
        n = np.bincount(bucket, minlength=self.buckets)
        at = (bucket << 32) + np.arange(len(key)) + (self.before - np.cumsum(n) + n)[bucket]
        self.before += n
        low, mix = np.zeros(len(key), bool), np.zeros(len(key), bool)
        for found, told in ((low, self.told[0]), (mix, self.told[1])):
            if len(told):
                found[:] = told[np.minimum(np.searchsorted(told, at), len(told) - 1)] == at
        return low, mix


def mark_repeats(docs: DataFrame, id: str = "doc_id", text: str = "text", length: int = 50) -> DataFrame:
    """The columns of ``docs`` as struct ``row``, and ``n_bytes``, ``n_removed``, ``spans`` (array of byte bounds
    of the maximal removed runs) and ``kept`` (binary). If there is but an id and a text, ``row`` has the id alone."""
    return marked(docs, id, text, F.struct(id) if docs.columns == [id, text] else F.struct("*"), length)


def marked(docs: DataFrame, id: str, text: str, row: Column, length: int) -> DataFrame:
    if length < 2 * GRAM:
        raise ValueError(f"length is {length}; at least {2 * GRAM} is needed")
    total = docs.agg(F.sum(F.octet_length(text)), F.count("*")).first()
    size = (total[0] or 0) + 64 * total[1]
    piece = chunk_bytes(size, PIECE_BYTES, MOST_CHUNK_BYTES)
    chunks = max(1, -(-size // min(MOST_CHUNK_BYTES, max(CHUNK_BYTES, size >> 10))))
    # A bucket takes about 14 bytes for each anchor, one in (width + 1) / 2 bytes of text.
    buckets = max(1, -(-28 * (total[0] or 0) // (length - GRAM + 2) // BUCKET_BYTES))
    parts = docs.select(F.pmod(F.xxhash64(F.col(id).cast("long")), F.lit(chunks)).cast("int").alias("chunk"), F.col(id).cast("long").alias("id"), F.col(text).cast("binary").alias("body"), row.alias("row"))
    schema = parts.select("row").schema
    own = parts.groupBy("chunk")

    def opened(group: pa.Table) -> Iterator[Chunk]:
        """The pieces of a chunk, whose rows are in_order()."""
        tidy()
        ids, body = longs(group.column("id")), group.column("body").combine_chunks()
        for i, j in pieces(pc.binary_length(body).fill_null(0).to_numpy(zero_copy_only=False) + 64, piece):
            yield Chunk(ids[i:j], body.slice(i, j - i), length).entries()

    def number(group: pa.Table) -> int:
        return group.column("chunk")[0].as_py()

    def first_digits(group: pa.Table) -> pa.Table:
        return sent(number(group), [(c.e_gram, c.e_around, c.ids[c.e_doc]) for c in opened(in_order(group))], 48, buckets, 6)

    def nothing() -> pa.Table:
        return sent(0, [], 64, buckets, 8)

    def third_digits(group: pa.Table, told: pa.Table) -> pa.Table:
        """Of anchors that stand for distinct surroundings beside others, the halves' keys."""
        if not told.num_rows:
            return nothing()
        around = Replies(told, SURROUNDINGS, 48, buckets)
        return sent(number(group), [c.sides(c.e_at[around.of(c.e_gram)[1]])[:1] for c in opened(in_order(group))], 64, buckets, 8)

    def windows(c: Chunk, anchors: np.ndarray, halves: Replies) -> tuple[np.ndarray, ...]:
        key, owner, later = c.sides(anchors)
        _, again = halves.of(key)
        sides = np.zeros((2, len(anchors)), bool)
        sides[0, owner[again & ~later]] = True
        sides[1, owner[again & later]] = True
        any_ = sides.any(axis=0)
        return c.windows(anchors[any_], sides[0, any_], sides[1, any_])

    def last_digits(group: pa.Table, told: pa.Table) -> pa.Table:
        if not told.num_rows:
            return nothing()
        around, halves, parts = Replies(told, SURROUNDINGS, 48, buckets), Replies(told, SIDES, 64, buckets), []
        for c in opened(in_order(group)):
            key, other, doc, *_ = windows(c, c.e_at[around.of(c.e_gram)[1]], halves)
            parts.append((key, other, c.ids[doc]))
        return sent(number(group), parts, 64, buckets, 8)

    def removed(group: pa.Table, told: pa.Table) -> pa.Table:
        group = in_order(group)
        around, halves, last = Replies(told, SURROUNDINGS, 48, buckets), Replies(told, SIDES, 64, buckets), Replies(told, WINDOWS, 64, buckets)
        parts = [cut_out(c, around, halves, last) for c in opened(group)]
        sizes, counts, spans, kept = ([x for p in parts for x in p[i]] for i in range(4))
        span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        return pa.table([group.column("row").combine_chunks() if group.num_rows else group.column("row"), pa.array(sizes, pa.int64()), pa.array(counts, pa.int64()), pa.array(spans, span), pa.array(kept, pa.binary())], names=["row", "n_bytes", "n_removed", "spans", "kept"])

    def cut_out(c: Chunk, around: Replies, halves: Replies, last: Replies) -> tuple[list, ...]:
        """The results of a piece's documents: bytes, bytes removed, their bounds, what is kept."""
        low, mix = around.of(c.e_gram)
        edge = np.zeros(c.n + 1, np.int32)
        hit = low[c.of] | (c.doc > c.e_doc[c.of])
        np.add.at(edge, c.start[hit], 1)
        np.add.at(edge, c.end[hit], -1)
        if mix.any():
            key, _, first, a, p, of = windows(c, c.e_at[mix], halves)
            below, _ = last.of(key)
            on = below[of] | (c.doc[a] > first[of])
            # The document of an entry's first anchor may have the same surroundings again.
            begin, end = c.copied(a[on], p[on], np.flatnonzero(mix[c.of] & ~hit))
            np.add.at(edge, begin, 1)
            np.add.at(edge, end, -1)
        gone = np.cumsum(edge[:-1]) > 0
        sizes, counts, spans, kept = [0] * len(c.order), [0] * len(c.order), [[]] * len(c.order), [b""] * len(c.order)
        for i, row in enumerate(c.order.tolist()):
            a, b = int(c.bounds[i]), int(c.bounds[i + 1])
            cover = gone[a:b]
            sizes[row], counts[row] = b - a, int(cover.sum())
            if counts[row]:
                turns = np.flatnonzero(np.diff(np.concatenate([[0], cover.view(np.int8), [0]])))
                spans[row] = [{"start": x, "end": y} for x, y in turns.reshape(-1, 2).tolist()]
                kept[row] = c.data[a:b][~cover].tobytes()
            else:
                kept[row] = c.data[a:b].tobytes()
        return sizes, counts, spans, kept

    def asked(step, told: DataFrame, kind: int) -> DataFrame:
        return own.cogroup(told.groupBy("chunk")).applyInArrow(step, ENTRY).groupBy("bucket").applyInArrow(judge(kind, 8), REPLY)

    told = own.applyInArrow(first_digits, ENTRY).groupBy("bucket").applyInArrow(judge(SURROUNDINGS, 6), REPLY)
    told = told.unionByName(asked(third_digits, told, SIDES))
    told = told.unionByName(asked(last_digits, told, WINDOWS))
    out = StructType([*schema, *StructType.fromDDL("n_bytes long, n_removed long, spans array<struct<start:long,end:long>>, kept binary")])
    return own.cogroup(told.groupBy("chunk")).applyInArrow(removed, out)


def drop_repeats(docs: DataFrame, id: str = "doc_id", text: str = "text", length: int = 50, drop_emptied: bool = False) -> DataFrame:
    """``docs`` with repeated strings cut out of ``text``. A character of which only a part was cut goes too. With
    ``drop_emptied``, rows that lost bytes and have no word left go."""
    rest = [c for c in docs.columns if c != text]

    def run(batches):
        for b in batches:
            done, stay = [], []
            for none, n, k in zip(b.column("none").to_pylist(), b.column("n_removed").to_pylist(), b.column("kept"), strict=True):
                raw = k.as_py()
                done.append(None if none else raw.decode("utf-8", "ignore" if n else "replace"))
                stay.append(not (drop_emptied and n and not raw.split()))
            yield pa.RecordBatch.from_arrays([b.column("rest"), pa.array(done, pa.string())], names=["rest", "body"]).filter(pa.array(stay, pa.bool_()))

    row = F.struct(F.struct(*rest).alias("rest"), F.col(text).isNull().alias("none"))  # the text is not sent twice
    found = marked(docs, id, text, row, length).select("row.rest", "row.none", "n_removed", "kept")
    done = found.mapInArrow(run, found.select("rest", F.lit(None).cast("string").alias("body")).schema)
    return done.select(*(F.col("body").alias(c) if c == text else F.col(f"rest.`{c}`").alias(c) for c in docs.columns))
