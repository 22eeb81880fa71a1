"""Packing of tokenized documents into sequences of at most ``CAPACITY`` tokens by bin completion.

Which documents share a sequence depends on lengths alone, of which there are CAPACITY at most. So tasks count pieces by
length, and the counts, one number for each length whatever the corpus, are packed by branch and bound: around the
largest length left, the fillings that no other filling dominates are tried, those of least waste first, each as many
times as the counts allow and then fewer; what would waste more than a better solution may is cut off. Best fit
decreasing gives the first incumbent, and a solution that meets the lower bound ends the search. The result is a list
of patterns with how often each is used, a few for each length. Tasks then number the pieces of each length over all
partitions and look up sequence and offset, so no piece passes the driver and no group of pieces is gathered.

The search is exact if it ends within ``NODES`` nodes and no node has more fillings than ``WIDTH``, as in small inputs;
else its best solution stands, which is never worse than best fit decreasing. Nothing is left out in either case.

Defined results. A null text is empty and is the end token alone. A document over CAPACITY tokens is cut from its end
into pieces of CAPACITY, so its first piece may be shorter. Repeated rows and ids are packed each for itself; which of
pieces of equal length comes first is up to the partitions. The string of a special token in a text is read as that
token, as the tokenizer does by default. A very long text costs memory in proportion in its task. An empty table gives
an empty table. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, tidy

CAPACITY = 1024
END = 2
#: Fillings that are gone through for one node, those kept, and nodes of a search.
STEPS, WIDTH, NODES = 1500, 12, 1500
#: Strings whose ids a worker remembers, some 200 bytes each.
REMEMBERED = 1_000_000
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"

Pattern = tuple[tuple[int, int], ...]


# Lengths to patterns


def lower_bound(counts: np.ndarray, capacity: int = CAPACITY) -> int:
    """Sequences that any packing needs: above some length none shares with one of the least length k or more, and what
    the rest of those of k or more exceeds the room that longer ones leave needs sequences of its own."""
    sizes = np.arange(capacity + 1)
    n, total = np.r_[0, np.cumsum(counts)], np.r_[0, np.cumsum(counts * sizes)]
    k = np.arange(capacity // 2 + 1)
    half = capacity // 2 + 1
    alone, large = n[-1] - n[capacity - k + 1], n[capacity - k + 1] - n[half]
    room = large * capacity - (total[capacity - k + 1] - total[half])
    rest = np.maximum(0, total[half] - total[k] - room)
    return int((alone + large + -(-rest // capacity)).max())


def best_fit(counts: np.ndarray, capacity: int = CAPACITY) -> list[tuple[Pattern, int]]:
    """Best fit decreasing: each piece, largest first, goes where it leaves least room; sequences that look alike are
    handled together."""
    done: dict[int, list[tuple[Pattern, int]]] = {}
    for size in range(capacity, 0, -1):
        n = int(counts[size])
        while n:
            room = min((r for r in done if r >= size), default=None)
            pattern, k = done[room].pop() if room is not None else ((), -(-n // (capacity // size)))
            if room is not None and not done[room]:
                del done[room]
            left = capacity if room is None else room
            each = left // size
            use, own = (min(k, n // each), each) if n >= each else (1, n)
            done.setdefault(left - own * size, []).append(((*pattern, (size, own)), use))
            n -= use * own
            if k > use and room is not None:
                done.setdefault(room, []).append((pattern, k - use))
    return [x for entries in done.values() for x in entries]


def dominates(strong: tuple[int, ...], weak: tuple[int, ...]) -> bool:
    """Whether the sizes of ``weak`` fit into those of ``strong``, several into one if need be."""
    if sum(weak) > sum(strong):
        return False
    left = list(strong)

    def put(i: int) -> bool:
        if i == len(weak):
            return True
        seen = set()
        for j, room in enumerate(left):
            if room >= weak[i] and room not in seen:
                seen.add(room)
                left[j] -= weak[i]
                if put(i + 1):
                    return True
                left[j] += weak[i]
        return False

    return put(0)


def flat(pattern: Pattern) -> tuple[int, ...]:
    return tuple(s for s, m in pattern for _ in range(m))


def fillings(counts: np.ndarray, room: int, slack: int, banned: frozenset = frozenset()) -> list[tuple[int, Pattern]]:
    """Waste and sizes of the undominated fillings of ``room`` that waste ``slack`` at most, the least first."""
    sizes = [int(s) for s in np.flatnonzero(counts[: room + 1])[::-1]]
    have = [int(counts[s]) for s in sizes]
    rest = np.cumsum([s * n for s, n in zip(sizes[::-1], have[::-1], strict=True)])[::-1].tolist() + [0]
    found: list[tuple[int, Pattern]] = []
    steps = 0

    def go(i: int, room: int, taken: Pattern) -> bool:
        """False once the steps are used up, or nothing can be better."""
        nonlocal steps
        used = dict(taken)
        for j in range(i, len(sizes)):
            if room - rest[j] > slack:
                break
            if sizes[j] > room:
                continue
            for m in range(min(have[j], room // sizes[j]), 0, -1):
                if not go(j + 1, room - m * sizes[j], (*taken, (sizes[j], m))):
                    return False
        steps += 1
        if room <= slack and taken not in banned and not any(s <= room and n > used.get(s, 0) for s, n in zip(sizes, have, strict=True)):
            found.append((room, taken))
            if room == 0 and len(taken) == 1 and taken[0][1] == 1:
                return False  # one piece that fills the room dominates all else
        return steps < STEPS

    go(0, room, ())
    kept: list[tuple[int, Pattern]] = []
    for waste, p in sorted(found, key=lambda x: (x[0], sum(m for _, m in x[1]), [-s for s, _ in x[1]])):
        own = flat(p)
        if len(own) > 8 or not any(len(flat(q)) <= 8 and dominates(flat(q), own) for _, q in kept):
            kept.append((waste, p))
            if len(kept) == WIDTH:
                break
    return kept


def bin_completion(counts: np.ndarray, capacity: int = CAPACITY, nodes: int = NODES) -> list[tuple[Pattern, int]]:
    """Patterns, each with how many sequences are filled so, that use up ``counts[length]``."""
    counts = np.asarray(counts, np.int64)
    best = best_fit(counts, capacity)
    fewest, least = sum(n for _, n in best), lower_bound(counts, capacity)
    total = int((counts * np.arange(capacity + 1)).sum())

    def branches(left: np.ndarray, used: int, wasted: int, banned: frozenset) -> Iterator[tuple[Pattern, int, int, frozenset]]:
        """What to try at a node: a pattern, how often, its waste, and patterns not to be used around this length again."""
        size = int(np.flatnonzero(left)[-1])
        others = left.copy()
        others[size] -= 1
        slack = (fewest - 1) * capacity - total - wasted
        for waste, filling in fillings(others, capacity - size, min(slack, capacity), banned):
            parts = dict(filling)
            parts[size] = parts.get(size, 0) + 1
            pattern = tuple(sorted(parts.items(), reverse=True))
            banned |= {filling}
            most = min(int(left[s]) // m for s, m in pattern)
            for times in range(most, 0, -1):
                if waste * times <= (fewest - 1) * capacity - total - wasted:
                    yield pattern, times, waste, banned if left[size] > times * parts[size] else frozenset()

    if fewest <= least:
        return best
    path: list[tuple[Pattern, int]] = []
    stack = [(counts, 0, 0, branches(counts, 0, 0, frozenset()))]
    while stack and nodes and fewest > least:
        left, used, wasted, more = stack[-1]
        found = next(more, None)
        if found is None:
            stack.pop()
            if path:
                path.pop()
            continue
        nodes -= 1
        pattern, times, waste, banned = found
        below = left.copy()
        for s, m in pattern:
            below[s] -= m * times
        now = used + times
        if not below.any():
            if now < fewest:
                fewest, best = now, [*path, (pattern, times)]
        elif now + lower_bound(below, capacity) < fewest:
            path.append((pattern, times))
            stack.append((below, now, wasted + waste * times, branches(below, now, wasted + waste * times, banned)))
    return best


class Plan:
    """Sequence and offset of the piece of a length that has a given number among those of this length."""

    def __init__(self, patterns: list[tuple[Pattern, int]]):
        rows, used, base = [], {}, 0
        for pattern, times in patterns:
            offset = 0
            for size, m in pattern:
                rows.append((size, used.get(size, 0), base, m, offset))
                used[size] = used.get(size, 0) + times * m
                offset += size * m
            base += times
        table = np.array(sorted(rows), np.int64).reshape(-1, 5)
        self.keys = table[:, 0] << 50 | table[:, 1]
        _, self.start, self.base, self.each, self.offset = table.T

    def places(self, lengths: np.ndarray, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(self.keys, lengths << 50 | numbers, "right") - 1
        inside = numbers - self.start[at]
        return self.base[at] + inside // self.each[at], self.offset[at] + inside % self.each[at] * lengths


# Texts to ids

#: White space around a blank: only there does what a tokenizer's word is depend on more than the words at a blank.
RUN = re.compile(r"\s \s")
LETTERS, DIGITS, MARKS = "[A-Za-zÀ-ÖØ-öø-ÿ]", "[0-9]", r"[!-&(-/:;=-@[-`{-~]"
#: Runs of letters, digits and marks, and single line ends between them: the words that they are to the tokenizer. An
#: apostrophe may begin a word of its own kind, and ``<`` a special token, so these are not plain.
PLAIN = re.compile(rf"(?:{LETTERS}++|{DIGITS}++|{MARKS}++)(?:{LETTERS}++|{DIGITS}++|{MARKS}++|\n(?=\S))*+")
WORDS = re.compile(rf"{LETTERS}+|{DIGITS}+|{MARKS}+|\n")


def byte_letters() -> dict[int, int]:
    """Which letter stands for each byte in byte-level BPE: itself if it can be seen, else the next above 255."""
    seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {b: b for b in seen} | {b: 256 + k for k, b in enumerate(x for x in range(256) if x not in seen)}


def raw(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


class Encoder:
    """A tokenizer's file, and the ids of words that were met, four bytes each; kept by the worker.

    Byte-level BPE cuts a text into words before it merges. A blank with no white space on one side or the other always
    begins a word, so a text's ids are those of what stands between blanks, each with its blank. Plain ones of these are
    runs of letters, digits and marks, which are words apart. The tokenizer's model merges each word once and then it is looked
    up; whatever is not plain, and every text with longer runs of white space, goes through the whole tokenizer."""

    held: dict[str, Encoder] = {}

    @classmethod
    def of(cls, path: str) -> Encoder:
        if path not in cls.held:
            cls.held[path] = cls(path)
        return cls.held[path]

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.merge = self.tokenizer.model.tokenize
        self.letters = byte_letters()
        self.behind_blank: dict[str, bytes] = {}
        self.bare: dict[str, bytes] = {}

    def whole(self, text: str) -> bytes:
        return raw(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def word(self, word: str) -> bytes:
        """One word to the tokenizer."""
        seen = word.encode().decode("latin-1").translate(self.letters)
        return raw([t.id for t in self.merge(seen)])

    def learn(self, parts: set[str]) -> None:
        """What stands behind a blank, and is not known yet."""
        known, bare = self.behind_blank, self.bare
        odd = []
        for part in parts:
            if not PLAIN.fullmatch(part):
                odd.append(part)
                continue
            first, *rest = WORDS.findall(part)
            ids = known.get(first)
            if ids is None:
                ids = known[first] = self.word(f" {first}")
            if rest:
                for w in rest:
                    if w not in bare:
                        bare[w] = self.word(w)
                known[part] = ids + b"".join(map(bare.__getitem__, rest))
        known.update((p, raw(e.ids)) for p, e in zip(odd, self.tokenizer.encode_batch_fast([f" {p}" for p in odd], add_special_tokens=False), strict=True))

    def encoded(self, texts: list[str]) -> list[bytes]:
        if len(self.behind_blank) + len(self.bare) > REMEMBERED:
            self.behind_blank.clear()
            self.bare.clear()
        parts = [None if RUN.search(t) else t.split(" ") for t in texts]
        self.learn(set().union(*(p[1:] for p in parts if p)).difference(self.behind_blank))
        known = self.behind_blank
        return [self.whole(t) if p is None else self.whole(p[0]) + b"".join([known[w] for w in p[1:]]) for t, p in zip(texts, parts, strict=True)]


def tokenized(docs: DataFrame, path: str, keep_ids: bool = False) -> DataFrame:
    """PIECES and, where asked for, their ``ids`` (four bytes each); ``part`` and ``place`` number the pieces of each
    length inside their partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(CAPACITY + 1, np.int64)
        encoder = Encoder.of(path)
        part, end = TaskContext.get().partitionId(), raw([END])
        for batch in batches:
            blobs = encoder.encoded(["" if t is None else t for t in batch.column(1).to_pylist()])
            n = np.array([len(b) // 4 + 1 for b in blobs], np.int64)
            pieces = -(-n // CAPACITY)
            doc = np.repeat(np.arange(len(n)), pieces)
            piece = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            first = n - (pieces - 1) * CAPACITY
            start = np.where(piece > 0, first[doc] + (piece - 1) * CAPACITY, 0)
            length = np.where(piece > 0, CAPACITY, first[doc])
            views = [memoryview(b + end) for b in blobs]
            ids = [views[d][4 * s : 4 * (s + k)] for d, s, k in zip(doc.tolist(), start.tolist(), length.tolist(), strict=True)]
            order = np.argsort(length, kind="stable")
            sorted_ = length[order]
            place = np.empty(len(order), np.int64)
            place[order] = np.arange(len(order)) - np.searchsorted(sorted_, sorted_) + seen[sorted_]
            seen += np.bincount(length, minlength=CAPACITY + 1)
            columns = [batch.column(0).cast(pa.int64()).take(pa.array(doc)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array([zlib.crc32(x) for x in ids], pa.int64()), pa.array(np.full(len(doc), part, np.int32)), pa.array(place)]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "part", "place"]
            if keep_ids:
                columns.append(pa.array([bytes(x) for x in ids], pa.binary()))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names=names)
        tidy()

    return docs.select("doc_id", "text").mapInArrow(run, f"{PIECES}, part int, place long" + ", ids binary" * keep_ids)


def pack(docs: DataFrame, path: str, keep_ids: bool = False) -> DataFrame:
    """PIECES with ``sequence_id`` and ``offset``, and ``ids`` where asked for. ``path`` is the tokenizer's file."""
    pieces = cut(tokenized(docs, path, keep_ids))
    counts = np.zeros(CAPACITY + 1, np.int64)
    for length, n in pieces.groupBy("length").count().collect():  # CAPACITY rows at most
        counts[length] = n
    plan = Plan(bin_completion(counts))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    first = pieces.groupBy("length", "part").agg(F.count("*").alias("n")).select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    rows = pieces.join(first, ["length", "part"]).withColumn("number", F.col("first") + F.col("place"))
    names = ["doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if keep_ids else [])]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = lambda n: batch.column(batch.schema.get_field_index(n))  # noqa: B023, E731
            sequence, offset = plan.places(*(column(n).to_numpy(zero_copy_only=False) for n in ("length", "number")))
            yield pa.RecordBatch.from_arrays([*map(column, names), pa.array(sequence), pa.array(offset)], names=[*names, "sequence_id", "offset"])

    return rows.select(*names, "number").mapInArrow(place, f"{PIECES}{', ids binary' * keep_ids}, sequence_id long, offset long")


def sequences(packed: DataFrame) -> DataFrame:
    """``sequence_id, doc_ids, lengths, ids`` from ``pack(..., keep_ids=True)``: whole sequences, CAPACITY tokens each at
    most, with the documents and lengths of their pieces in order."""
    order = F.sort_array(F.collect_list(F.struct("offset", "doc_id", "length", "ids")))
    held = packed.groupBy("sequence_id").agg(order.alias("p"))
    return held.select("sequence_id", F.col("p.doc_id").alias("doc_ids"), F.col("p.length").alias("lengths"), F.aggregate("p", F.lit(b""), lambda a, x: F.concat(a, x["ids"])).alias("ids"))
