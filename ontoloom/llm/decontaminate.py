"""Benchmark decontamination by template windows, which also finds re-parameterised questions.

Words lose case and outer punctuation; numbers, names and units become typed placeholders. An item's windows of
``WINDOW`` canonical words are joined by hash with those of the documents. A document leaks an item if it has at
least ``share`` of the item's windows in one passage (words may be missing or put in between, no more than the item
has) and all their placeholders are filled consistently: what stood for one value in the item stands for one value in
the passage. Leaks are ``exact`` (all values
equal) or ``reparameterised``.

Whether a word is a name depends on its capital and on what precedes it, and so may differ between an item and its
verbatim copy. Therefore all words, without case and outer punctuation but with no placeholder and no minimum of
literal words, are joined by windows too: a document that has ``share`` of these leaks the item, ``exact``. And a
window of a document that begins with a name counts also with that word as it stands, as at the start of a sentence.

A document that has ``share`` of n windows has one of any n - share * n + 1 of them. So documents meet items only by
so many of an item's windows, those that fewest other items have: a phrase that many items share brings no document
together with all of them. Documents that meet no bit of a fixed-size bitmap (2 ** BITS bits, whatever the benchmark's
size) by such a window never leave their task; the bitmap can only let too much through, the join decides.

Defined results. A null or blank text has no windows; an item without words leaks nowhere. Items under WINDOW words
are one window. Template windows with fewer than two literal words (one, in a window of one or two) count nowhere. A
word of nothing but punctuation is one of its own. If both kinds of windows show a leak, the figures are those of the
template windows if these say ``exact``, else those of the plain ones. Rows that share id and text are one document.
A null id is an id of its own. Empty tables give an empty result. Texts count whole.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, texts

WINDOW = 5
SHARE = 0.8
BITS = 24
MERGES = 16
VOCABULARY = 400_000
NUMBER = re.compile(r"[+-]?[$€£]?\d[\d.,:/]*(?:st|nd|rd|th|%|[a-zµ°]{1,3}(?:/[a-z])?)?$", re.I)
OUTER = re.compile(r"^[^\w$€£+-]+|[^\w%]+$")
UNITS = frozenset("% percent mm cm m km in ft yd mi inch inches foot feet yard yards mile miles meter meters metre metres kilometer kilometers g kg mg lb lbs oz gram grams kilogram kilograms pound pounds ounce ounces l ml liter liters litre litres gallon gallons s sec ms min h hr second seconds minute minutes hour hours day days week weeks month months year years c f degrees dollar dollars euro euros cent cents mph kmh w kw kwh v".split())
UNIT_BYTES = frozenset(u.encode() for u in UNITS)
LITERAL, NUM, NAME, UNIT = range(4)
NUMBER_SIGN, CAPITAL_SIGN, END_SIGN, UNIT_SIGN = 1, 2, 4, 8
#: Added to the length that starts the hash of a window of plain words.
PLAIN = 64
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
MIX = np.uint64(0xD6E8FEB86659FD93)


class Words(dict):
    """Word to its number; the hash and the signs of each word are in arrays by that number. It starts anew when it
    holds VOCABULARY words, so its size has a bound whatever the texts are."""

    def __init__(self):
        super().__init__()
        self.code, self.signs = np.zeros(1 << 12, np.uint64), np.zeros(1 << 12, np.uint8)
        self.filled = 0
        self.new: list[tuple[int, int]] = []  # of words that are not in the arrays yet

    def __missing__(self, word: bytes) -> int:
        if word.isalpha() and word.islower():  # ASCII letters only
            self.new.append((xxhash.xxh64_intdigest(word), UNIT_SIGN if word in UNIT_BYTES else 0))
        else:
            text = word.decode("utf-8", "replace")
            bare = OUTER.sub("", text) or text
            low = bare.lower()
            signs = NUMBER_SIGN if NUMBER.match(bare) else 0
            if bare[:1].isupper() and bare[1:] != bare[1:].upper():
                signs |= CAPITAL_SIGN
            if text[-1] in ".!?:;" or text[-2:-1] in (".", "!", "?"):
                signs |= END_SIGN
            if low in UNITS:
                signs |= UNIT_SIGN
            self.new.append((xxhash.xxh64_intdigest(low.encode()), signs))
        self[word] = n = len(self)
        return n

    def of(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The hash and the signs of each."""
        if len(self) > VOCABULARY:
            self.clear()
            self.filled = 0
        n = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        if self.new:
            last = self.filled + len(self.new)
            while len(self.code) < last:
                self.code, self.signs = (np.concatenate([x, np.zeros_like(x)]) for x in (self.code, self.signs))
            self.code[self.filled : last], self.signs[self.filled : last] = zip(*self.new, strict=True)
            self.filled = last
            self.new.clear()
        return self.code[n], self.signs[n]


def scanned(text: bytes, known: Words) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray]:
    """The words, the hash of each plain word and of each canonical word, and its kind."""
    words = text.split()
    plain, signs = known.of(words)
    start = np.ones(len(words), bool)
    start[1:] = signs[:-1] & END_SIGN != 0
    number = signs & NUMBER_SIGN != 0
    kind = np.where(number, NUM, LITERAL).astype(np.int8)
    kind[~number & (signs & CAPITAL_SIGN != 0) & ~start] = NAME
    after = np.zeros(len(words), bool)
    after[1:] = kind[:-1] == NUM
    kind[after & (signs & UNIT_SIGN != 0)] = UNIT
    return words, plain, np.where(kind == LITERAL, plain, kind.astype(np.uint64)), kind


def step(h: np.ndarray, code: np.ndarray) -> np.ndarray:
    return (h * MULTIPLIER + code) ^ (h >> np.uint64(29))


def last(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * MIX
    return h ^ (h >> np.uint64(29))


def windows(code: np.ndarray, kind: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the template windows that count, and their hashes."""
    m = len(code) - length + 1
    if m <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    h, literal = np.full(m, np.uint64(length)), np.zeros(m, np.int8)
    for k in range(length):
        h = step(h, code[k : k + m])
        literal += kind[k : k + m] == LITERAL
    at = np.flatnonzero(literal >= (2 if length > 2 else 1))
    return at, last(h[at])


def plain_windows(plain: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of all windows, and the hashes of their plain words."""
    m = len(plain) - length + 1
    if m <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    h = np.full(m, np.uint64(PLAIN + length))
    for k in range(length):
        h = step(h, plain[k : k + m])
    return np.arange(m), last(h)


def opened_windows(plain: np.ndarray, code: np.ndarray, kind: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Template windows that begin with a name, with that word as it stands."""
    m = len(code) - length + 1
    at = np.flatnonzero(kind[: max(0, m)] == NAME)
    h, literal = step(np.full(len(at), np.uint64(length)), plain[at]), np.ones(len(at), np.int8)
    for k in range(1, length):
        h = step(h, code[at + k])
        literal += kind[at + k] == LITERAL
    keep = literal >= (2 if length > 2 else 1)
    return at[keep], last(h[keep])


def slots(words: list[bytes], kind: np.ndarray, at: int, length: int) -> list[str]:
    """The values of a window's placeholders, in order."""
    return [OUTER.sub("", words[i].decode("utf-8", "replace")).lower() for i in range(at, at + length) if kind[i] != LITERAL]


def bits_of(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    bit = h >> np.uint64(64 - BITS)
    return (bit >> np.uint64(3)).astype(np.int64), np.uint8(1) << (bit & np.uint64(7)).astype(np.uint8)


def meets(h: np.ndarray, bitmap: np.ndarray) -> np.ndarray:
    byte, bit = bits_of(h)
    return bitmap[byte] & bit != 0


def bitmap(hashes: DataFrame) -> np.ndarray:
    """The bits of ``hashes(h)``, or-ed by partition and then in MERGES groups; so many bitmaps come to the driver."""

    def whole(blobs) -> bytes:
        bits = np.zeros(1 << (BITS - 3), np.uint8)
        for blob in blobs:
            bits |= np.frombuffer(zlib.decompress(blob), np.uint8)
        return zlib.compress(bits.tobytes(), 1)

    def each(batches):
        bits = np.zeros(1 << (BITS - 3), np.uint8)
        for b in batches:
            np.bitwise_or.at(bits, *bits_of(b.column(0).to_numpy().view(np.uint64)))
        yield pa.RecordBatch.from_arrays([pa.array([zlib.compress(bits.tobytes(), 1)], pa.binary())], names=["bits"])

    def merged(group: pa.Table) -> pa.Table:
        return pa.table({"bits": pa.array([whole(x.as_py() for x in group.column("bits"))], pa.binary())})

    parts = hashes.select("h").mapInArrow(each, "bits binary").withColumn("k", F.pmod(F.spark_partition_id(), F.lit(MERGES)))
    found = [bytes(r["bits"]) for r in parts.groupBy("k").applyInArrow(merged, "bits binary").collect()]
    return np.frombuffer(zlib.decompress(whole(found)), np.uint8)


def item_windows(benchmark: DataFrame, id: str, text: str) -> DataFrame:
    def run(batches):
        known = Words()
        for b in batches:
            rows = []
            for item, t in zip(b.column(0).to_pylist(), texts(b.column(1)), strict=True):
                words, plain, code, kind = scanned(t, known)
                length = min(WINDOW, len(words))
                if length:
                    at, h = windows(code, kind, length)
                    rows += [(item, False, len(at), length, int(x), int(i), slots(words, kind, int(i), length)) for i, x in zip(at, h.view(np.int64), strict=True)]
                    at, h = plain_windows(plain, length)
                    rows += [(item, True, len(at), length, int(x), int(i), []) for i, x in zip(at, h.view(np.int64), strict=True)]
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 7
            types = (pa.int64(), pa.bool_(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["item_id", "plain", "n_windows", "length", "h", "item_pos", "item_slots"])

    named = benchmark.select(F.col(id).cast("long").alias("item_id"), F.col(text).cast("string").alias("text"))
    return named.mapInArrow(run, "item_id long, plain boolean, n_windows int, length int, h long, item_pos int, item_slots array<string>")


def least_shared(items: DataFrame, share: float) -> DataFrame:
    """``h, item_id`` of as many windows of each item, of either kind, as none that leaks can do without."""
    often = items.groupBy("h").agg(F.count_distinct("item_id").alias("often"))
    rank = F.row_number().over(Window.partitionBy("item_id", "plain").orderBy("often", "h", "item_pos"))
    needed = F.col("n_windows") - F.ceil(F.col("n_windows") * share - 1e-9) + 1
    return items.join(often, "h").withColumn("rank", rank).where(F.col("rank") <= needed).select("h", "item_id").distinct()


def document_windows(docs: DataFrame, every: np.ndarray, needed: np.ndarray, lengths: list[int]) -> DataFrame:
    """Of those of ``docs(id, th, text)`` that meet ``needed``, the windows that meet ``every``."""

    def run(batches):
        known = Words()
        for b in batches:
            ids, ths = b.column(0), b.column(1)
            row, hs, pos, found = [], [], [], []
            for i, t in enumerate(texts(b.column(2))):
                words, plain, code, kind = scanned(t, known)
                own = [(n, length, *f) for length in lengths for n, f in enumerate((windows(code, kind, length), plain_windows(plain, length), opened_windows(plain, code, kind, length)))]
                if not any(meets(h, needed).any() for _, _, _, h in own):
                    continue
                for n, length, at, h in own:
                    keep = meets(h, every)
                    at, h = at[keep], h[keep]
                    row.append(np.full(len(at), i))
                    hs.append(h)
                    pos.append(at)
                    found += [[] if n == 1 else slots(words, kind, int(p) + (n == 2), length - (n == 2)) for p in at]
            take = pa.array(np.concatenate(row) if row else np.zeros(0, np.int64))
            h = np.concatenate(hs) if hs else np.zeros(0, np.uint64)
            p = np.concatenate(pos) if pos else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([ids.take(take), ths.take(take), pa.array(h.view(np.int64)), pa.array(p.astype(np.int32)), pa.array(found, pa.list_(pa.string()))], names=["id", "th", "h", "pos", "slots"])

    return docs.mapInArrow(run, "id long, th long, h long, pos int, slots array<string>")


class Alignment:
    """Windows of a document that lie as far behind those of the item, with what fills their placeholders. If one value
    of the item is filled in several ways, the one found most often counts, and only windows that agree with it."""

    def __init__(self, shift: int, windows: list[tuple[int, tuple[tuple[str, str], ...]]]):
        ways: dict[str, Counter[str]] = {}
        for _, filled in windows:
            for i, d in filled:
                ways.setdefault(i, Counter())[d] += 1
        self.shift, self.filled = shift, {i: min(c, key=lambda d: (-c[d], d)) for i, c in ways.items()}
        self.windows = [(at, filled) for at, filled in windows if all(self.filled[i] == d for i, d in filled)]
        self.places, self.every = {at for at, _ in self.windows}, {at for at, _ in windows}


def best_passage(hits: list[tuple[int, int, tuple[tuple[str, str], ...]]], needed: float, span: int) -> tuple[int, bool]:
    """``hits`` are (place in the item, place in the document, filled placeholders). How many places of the item one
    passage has with one filling, and whether that is the item's own. Starting from each alignment in turn, others of
    the passage are taken in, the largest first, as far as they agree with what is filled so far. A place that the
    passage has with another filling alone contradicts."""
    by: dict[int, list] = {}
    for at, pos, filled in hits:
        by.setdefault(pos - at, []).append((at, filled))
    found = sorted((Alignment(k, w) for k, w in by.items()), key=lambda a: (-len(a.places), a.shift))
    near: dict[int, list[Alignment]] = {}
    for a in found:
        near.setdefault(a.shift // (span + 1), []).append(a)
    best = 0, False
    for first in found:
        k = first.shift // (span + 1)
        around = [a for j in (k - 1, k, k + 1) for a in near.get(j, ()) if abs(a.shift - first.shift) <= span]
        every = set().union(*(a.every for a in around))
        if len(every) < max(needed, best[0]):
            continue
        value, places = dict(first.filled), set(first.places)
        for a in sorted(around, key=lambda a: (-len(a.places), a.shift)):
            for at, filled in a.windows:
                if at not in places and all(value.get(i, d) == d for i, d in filled):
                    places.add(at)
                    value.update(filled)
        if places == every:
            best = max(best, (len(places), all(i == d for i, d in value.items())))
    return best


def decided(pairs: DataFrame, share: float) -> DataFrame:
    """``pairs(id, th, item_id, plain, n_windows, found)`` that are leaks, as ``id, th, item_id, row, rank``."""
    out = "id long, th long, item_id long, n_windows int, hits int, containment double, kind string, rank int"

    def run(batches):
        for b in batches:
            rows = []
            for r in b.to_pylist():
                n = r["n_windows"]
                if r["plain"]:
                    hits, same = len({x["item_pos"] for x in r["found"]}), True
                else:
                    windows_ = [(x["item_pos"], x["pos"], tuple(zip(x["item_slots"], x["slots"], strict=True))) for x in r["found"]]
                    hits, same = best_passage(windows_, share * n - 1e-9, n + WINDOW)
                if hits >= share * n - 1e-9:
                    rows.append((r["id"], r["th"], r["item_id"], n, hits, hits / n, "exact" if same else "reparameterised", 1 if r["plain"] else 2 if same else 0))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 8
            types = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.float64(), pa.string(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=[x.split()[0] for x in out.split(", ")])

    return pairs.select("id", "th", "item_id", "plain", "n_windows", "found").mapInArrow(run, out)


def leaks(docs: DataFrame, benchmark: DataFrame, id: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", share: float = SHARE) -> DataFrame:
    """``(id, th, item_id, n_windows, hits, containment, kind)`` of each document (th: hash of its text) and item
    that it leaks."""
    items = cut(item_windows(benchmark, item, item_text))
    needed = cut(least_shared(items, share))
    lengths = sorted(r[0] for r in items.select("length").distinct().collect())
    named = docs.select(F.col(id).cast("long").alias("id"), F.xxhash64(text).alias("th"), F.col(text).cast("string").alias("text"))
    found = cut(document_windows(named, bitmap(items), bitmap(needed), lengths)).distinct()
    candidates = found.select("id", "th", "h").join(needed, "h").select(F.col("id").alias("c_id"), F.col("th").alias("c_th"), "item_id").distinct()
    met = found.join(candidates, (F.col("th") == F.col("c_th")) & F.col("id").eqNullSafe(F.col("c_id"))).join(items, ["item_id", "h"])
    key = ["id", "th", "item_id", "plain", "n_windows"]
    pairs = met.groupBy(*key).agg(F.collect_list(F.struct("item_pos", "pos", "item_slots", "slots")).alias("found"))
    row = F.struct("n_windows", "hits", "containment", "kind")
    return decided(pairs, share).groupBy("id", "th", "item_id").agg(F.max_by(row, "rank").alias("row")).select("id", "th", "item_id", "row.*")


def drop_leaks(docs: DataFrame, benchmark: DataFrame, id: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """The rows of ``docs`` that leak no item."""
    found = cut(leaks(docs, benchmark, id, text, **how).select("id", "th").distinct())
    marked = docs.select(F.struct("*").alias("row"), F.col(id).cast("long").alias("own_id"), F.xxhash64(text).alias("own_th"))
    on = F.col("own_id").eqNullSafe(F.col("id")) & (F.col("own_th") == F.col("th"))
    return marked.join(found, on, "left_anti").select(*(F.col(f"row.`{c}`").alias(c) for c in docs.columns))
