"""Audit of how filters interact: what each removes at each place of every order, by a packed bitmap index.

Each partition packs its documents' failures, labels and parts into bit sets of 64-bit words. For each subset of the
filters, AND-NOT and popcount give the documents that pass all of it, and the good and the toxic ones among them. These
counts, 32 for each part and partition, are all that leaves a task; their sums answer every order. Rows are put in the
order of their parts before they are packed, so the words that a part's bits reach are few, however many parts there are.

Duplicates are looked for over the whole table, by one aggregation of SHA-256 digests with map-side minima and a join
back by (digest, id), a key that no group of copies makes hot.

Defined results. A null text is empty; an empty text fails A (no words) and no other of A to D. A null lang and an empty
one are the part ''. A null id comes after all others, so of equal texts it fails E if any has an id; rows that repeat
the least id all pass E. Labels that repeat an id count as one that has every mark of theirs. Documents without a label
are neither good nor toxic. Words are held for one text at a time, so a very long one costs memory in proportion. An
empty table gives an empty table. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import NO_ID, cut

FILTERS = "ABCDE"
SUBSETS = 1 << len(FILTERS)
#: Rows that are packed at a time: seven bit sets of 128 KiB.
BLOCK = 1 << 20
COUNTS = "part string, subset int, n long, good long, toxic long"


def failures(text: Column) -> Column:
    """Bits 0 to 3: whether a text fails A to D."""
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    n, distinct = F.size(words), F.size(F.array_distinct(words))
    capitals = F.length(text) - F.length(F.regexp_replace(text, "[A-Z]", ""))
    found = (n < 100, 100 * distinct < 80 * n, 100 * capitals > 10 * F.length(text), text.rlike(r"[#$%&*|]"))
    return sum((F.when(f, 1 << i).otherwise(0) for i, f in enumerate(found)), F.lit(0))


def flagged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``part, marks``: a row for each document; bits 0 to 4 for the filters that it fails, 5 good, 6 toxic."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("part"), text.alias("text"))
    rows = cut(rows.select("doc_id", F.coalesce("doc_id", F.lit(NO_ID)).alias("id"), "part", failures(F.col("text")).alias("fails"), F.unhex(F.sha2(F.col("text"), 256)).alias("digest")))
    first = rows.groupBy("digest").agg(F.min("id").alias("id")).withColumn("first", F.lit(True))
    mark = lambda name: F.max(F.coalesce(F.col(name) == 1, F.lit(False))).alias(name)
    marks = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("label")).agg(mark("quality"), mark("toxic"))
    rows = rows.join(first, ["digest", "id"], "left")
    # Rows without an id have no label: their keys are spread, and the second condition keeps them apart.
    rows = rows.withColumn("key", F.coalesce("doc_id", F.xxhash64("digest", "part")))
    rows = rows.join(marks, (F.col("key") == F.col("label")) & F.col("doc_id").isNotNull(), "left")
    bits = F.col("fails") + F.when(F.col("first").isNull(), 16).otherwise(0) + F.when(F.col("quality"), 32).otherwise(0) + F.when(F.col("toxic"), 64).otherwise(0)
    return rows.select("part", bits.cast("short").alias("marks"))


def packed(bits: np.ndarray) -> np.ndarray:
    """Booleans as bits of 64-bit words, zeros behind the last."""
    raw = np.packbits(bits, bitorder="little")
    return np.concatenate([raw, np.zeros(-len(raw) % 8, np.uint8)]).view(np.uint64)


def block_counts(codes: np.ndarray, marks: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each part's code and its (SUBSETS, 3) counts: documents that pass all filters of a subset, good and toxic ones."""
    order = np.argsort(codes, kind="stable")
    codes, marks = codes[order], marks[order]
    fails = [packed(marks >> i & 1 == 1) for i in range(len(FILTERS))]
    labels = [packed(marks >> i & 1 == 1) for i in (5, 6)]
    starts = np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]])
    for a, b in zip(starts, np.r_[starts[1:], len(codes)], strict=True):
        words = slice(a // 64, (b + 63) // 64)
        part = np.zeros((words.stop - words.start) * 64, bool)
        part[a - words.start * 64 : b - words.start * 64] = True
        left = [packed(part)]
        for s in range(1, SUBSETS):  # a subset without its highest filter, AND NOT that filter
            high = s.bit_length() - 1
            left.append(left[s ^ 1 << high] & ~fails[high][words])
        ones = lambda x: int(np.bitwise_count(x).sum())
        yield int(codes[a]), np.array([[ones(x), *(ones(x & own[words]) for own in labels)] for x in left], np.int64)


def partition_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """COUNTS of one partition. Counts of a block are sent on when the next one has other parts, so memory is bounded."""
    parts: dict[str, int] = {}
    held: dict[int, np.ndarray] = {}
    codes, marks, n = [], [], 0

    def count() -> None:
        for code, found in block_counts(np.concatenate(codes), np.concatenate(marks)):
            held[code] = held[code] + found if code in held else found

    def sent() -> pa.RecordBatch:
        names = list(parts)
        table = np.concatenate(list(held.values()))
        each = np.repeat(np.fromiter(held, np.int64), SUBSETS)
        subset = np.tile(np.arange(SUBSETS, dtype=np.int32), len(held))
        return pa.RecordBatch.from_arrays([pa.array(names, pa.string()).take(pa.array(each)), pa.array(subset), *(pa.array(table[:, i]) for i in range(3))], names=["part", "subset", "n", "good", "toxic"])

    for batch in batches:
        coded = batch.column(0).dictionary_encode()
        own = np.array([parts.setdefault(p, len(parts)) for p in coded.dictionary.to_pylist()], np.int64)
        if not len(batch):
            continue
        codes.append(own[coded.indices.to_numpy(zero_copy_only=False)])
        marks.append(batch.column(1).to_numpy(zero_copy_only=False))
        n += len(batch)
        if n >= BLOCK:
            count()
            codes, marks, n = [], [], 0
            if len(parts) > 4096:
                yield sent()
                parts.clear()
                held.clear()
    if n:
        count()
    if held:
        yield sent()


def subset_counts(marked: DataFrame) -> DataFrame:
    """COUNTS over all partitions."""
    found = marked.mapInArrow(partition_counts, COUNTS)
    return found.groupBy("part", "subset").agg(*(F.sum(c).alias(c) for c in ("n", "good", "toxic")))


def steps() -> list[tuple[str, int, int, int, int]]:
    """Order, step, its filter's number, the subset before it and after it."""
    out = []
    for order in map("".join, permutations(FILTERS)):
        before = 0
        for k, letter in enumerate(order, 1):
            own = FILTERS.index(letter)
            out.append((order, k, own, before, before | 1 << own))
            before |= 1 << own
    return out


def interactions(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``part, filter_order, step`` with ``kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley``."""
    counts = subset_counts(flagged(docs, labels)).groupBy("part").agg(F.sort_array(F.collect_list(F.struct("subset", "n", "good", "toxic"))).alias("c"))  # SUBSETS entries
    at = lambda i, name="n": F.get("c", F.lit(i) if isinstance(i, int) else i)[name]
    least = len(FILTERS) - 1

    def share(f: int) -> Column:
        """What filter f removes over all orders: each subset comes before it in so many."""
        orders = lambda s: math.factorial(s.bit_count()) * math.factorial(least - s.bit_count())
        return sum((orders(s) * (at(s) - at(s | 1 << f)) for s in range(SUBSETS) if not s >> f & 1), F.lit(0))

    shares = F.array(*(share(f) for f in range(len(FILTERS))))
    fails = F.array(*(at(0) - at(1 << f) for f in range(len(FILTERS))))
    alone = F.array(*(at(SUBSETS - 1 ^ 1 << f) - at(SUBSETS - 1) for f in range(len(FILTERS))))
    placed = counts.withColumns({"shares": shares, "fails": fails, "alone": alone}).select("*", F.explode("c.subset").alias("before"))
    places = docs.sparkSession.createDataFrame(steps(), "filter_order string, step int, f int, before int, after int")  # 600 rows
    gone = lambda name: at(F.col("before"), name) - at(F.col("after"), name)
    return placed.join(F.broadcast(places), "before").select(
        "part", "filter_order", "step", at(F.col("after")).alias("kept"), gone("n").alias("removed"), (F.get("fails", F.col("f")) - gone("n")).alias("redundant"),
        F.get("alone", F.col("f")).alias("unique_fails"), gone("good").alias("good_lost"), gone("toxic").alias("toxic_lost"), F.get("shares", F.col("f")).alias("shapley"),
    )
