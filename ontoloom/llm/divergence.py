"""Audit of how sources of a language differ in their words, by two passes of a vocabulary automaton.

Texts are first written as blocks: those of one language in one task, about ``BLOCK_BYTES``, with letters A to Z lower-
cased and all that is no part of a term turned into blanks. The first pass counts in how many documents of a block each
term occurs; the sums over blocks are exact document frequencies, and terms in ``MIN_DOCS`` documents or more are kept.
The second pass tells each block which of its terms are kept; an Aho-Corasick automaton of these, each between blanks,
recounts the occurrences of every source. So an automaton holds what one block has, however large the vocabulary grows;
no vocabulary is collected or sent to all tasks, and a term has one row a block at most.

What comes out are sparse postings: for each term the sources that have it, and how often. A term that neither of two
sources has adds the same to their divergence, whatever the term, so a pair needs: that amount for all terms; for each
source, the difference that its own terms make, of which only how many have each count matters; and a correction for
terms that both have, which tasks find from the postings of a term. Everything is whole numbers of 64 bits, decimals
where a product needs more.

Defined results. Null texts, languages and sources are ''. A document without a term counts for its source, which then
gives every term its least probability; a language without kept terms has pairs of value 0. Repeated rows and ids count
as documents of their own. A language with one source has no pair. A very long text is one block of its own, so memory
grows with it; postings of a term are one row, as long as its language has sources. An empty table gives an empty table.
Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from operator import itemgetter

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import numbered
from .common import cut, shared_path, small_batches, texts, tidy

MIN_DOCS = 3
TOP_TERMS = 200
BLOCK_BYTES = 8 << 20
SCALE = 1_000_000_000
#: A group's terms are ranked in so many parts, by the task that finds them, before its best are.
PARTS = 16
#: Pairs of postings that a task makes at a time, and sums that it holds.
PAIRS_AT_ONCE = 1 << 19
BLANK = b" "
#: Bytes to what stands for them in a block.
LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if b > 127 or 97 <= b <= 122 else 32 for b in range(256))
BLOCKS = "block long, lang string, sources array<string>, blobs array<binary>, terms array<binary>, docs array<int>, names binary"
#: Bytes of all groups up to which they are sent to all tasks; beyond, they are joined by shuffle.
BROADCAST_BYTES = 16 << 20


class Block:
    """Texts of one language: for each source its bytes, and for each term in how many documents it is."""

    def __init__(self):
        self.sources: dict[str, list[bytes]] = {}
        self.docs: Counter = Counter()
        self.size = 0

    def add(self, source: str, text: bytes) -> None:
        own = text.translate(LETTERS)
        self.docs.update(set(own.split()))
        self.sources.setdefault(source, []).append(own)
        self.size += len(own) + 1


def blocks(docs: DataFrame) -> DataFrame:
    """BLOCKS, written to the shared folder: what later passes read stays as it is when tasks are run again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_: dict[str, Block] = {}
        number, held = TaskContext.get().partitionId() << 32, 0

        def row(lang: str, b: Block) -> pa.RecordBatch:
            nonlocal number
            number += 1
            pack = zstandard.ZstdCompressor(level=3).compress
            terms = sorted(b.docs)
            blobs = [pack(BLANK.join([b"", *x, b""])) for x in b.sources.values()]
            values = ([number], [lang], [list(b.sources)], [blobs], [terms], [[b.docs[t] for t in terms]], [pack(BLANK.join(terms))])
            kinds = (pa.int64(), pa.string(), pa.list_(pa.string()), pa.list_(pa.binary()), pa.list_(pa.binary()), pa.list_(pa.int32()), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds, strict=True)], names=["block", "lang", "sources", "blobs", "terms", "docs", "names"])

        for batch in batches:
            for lang, source, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), texts(batch.column(2)), strict=True):
                own = open_.setdefault(lang, Block())
                before = own.size
                own.add(source, text)
                held += own.size - before
                if own.size >= BLOCK_BYTES:
                    held -= own.size
                    yield row(lang, open_.pop(lang))
                elif held >= 4 * BLOCK_BYTES:  # many languages at once: the largest goes
                    most = max(open_, key=lambda x: open_[x].size)
                    held -= open_[most].size
                    yield row(most, open_.pop(most))
        for lang, own in open_.items():
            yield row(lang, own)
        tidy()

    spark = docs.sparkSession
    small_batches(spark)
    empty = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    where = shared_path(spark, "blocks")
    found = docs.select(empty("lang"), empty("source"), empty("text")).mapInArrow(run, BLOCKS)
    # Rows are large, so the writer looks at its memory after each.
    small = {"parquet.block.size": 16 << 20, "parquet.block.size.row.check.min": 1, "parquet.block.size.row.check.max": 1, "parquet.page.size.row.check.min": 1, "parquet.page.size.row.check.max": 1, "parquet.enable.dictionary": "false"}
    found.write.options(**{k: str(v) for k, v in small.items()}).parquet(where)
    return spark.read.parquet(where)


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a compressed table in the shared folder."""
    where = shared_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(where)
    return df.sparkSession.read.parquet(where)


def kept_terms(made: DataFrame) -> DataFrame:
    """``block, place`` of the terms in MIN_DOCS documents or more, by their place in the block's list of terms."""
    each = made.select("block", "lang", F.posexplode(F.arrays_zip("terms", "docs")).alias("place", "t")).select("block", "lang", "place", F.col("t.terms").alias("term"), F.col("t.docs").alias("docs"))
    whole = F.sum("docs").over(Window.partitionBy("lang", "term"))
    return each.withColumn("whole", whole).where(F.col("whole") >= MIN_DOCS).select("block", "place")


def source_groups(made: DataFrame) -> DataFrame:
    """``lang, source, gid``: all groups that occur, also without a term."""
    each = made.select("lang", F.explode("sources").alias("source")).distinct()
    return cut(numbered(each, ("lang", "source"), "gid").withColumn("gid", F.col("gid").cast("int")))


def recounted(made: DataFrame, groups: DataFrame) -> DataFrame:
    """Sparse postings ``lang, term, found array<struct<gid, count>>`` of the kept terms; each block's automaton counts."""
    terms = kept_terms(made).select(F.col("block").alias("owner"), "place", F.lit(None).cast("int").alias("gid"))
    sources = made.select(F.col("block").alias("owner"), "lang", F.posexplode("sources").alias("place", "source")).join(groups, ["lang", "source"]).select("owner", "place", "gid")

    def run(key: tuple, block: pa.Table, known: pa.Table) -> pa.Table:
        import ahocorasick

        gid = known.column("gid").to_numpy(zero_copy_only=False)
        place = known.column("place").to_numpy()
        is_term = known.column("gid").is_null().to_numpy()
        kept = place[is_term]
        gids = dict(zip(place[~is_term].tolist(), gid[~is_term].astype(np.int64).tolist(), strict=True))
        unpack = zstandard.ZstdDecompressor().decompress
        every = unpack(block.column("names")[0].as_py()).split()
        names = [every[k] for k in kept.tolist()]
        automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for i, term in enumerate(names):
            automaton.add_word(f" {term.decode('latin-1')} ", i)  # a character for each byte
        at, who, n = [np.zeros(0, np.int64)], [np.zeros(0, np.int32)], [np.zeros(0, np.int32)]
        if names:
            automaton.make_automaton()
            for k, blob in enumerate(block.column("blobs").combine_chunks().flatten()):
                found = Counter(map(itemgetter(1), automaton.iter(unpack(blob.as_buffer()).decode("latin-1"))))
                at.append(np.fromiter(found, np.int64, len(found)))
                n.append(np.fromiter(found.values(), np.int32, len(found)))
                who.append(np.full(len(found), gids[k], np.int32))
        at, who, n = map(np.concatenate, (at, who, n))
        order = np.argsort(at, kind="stable")
        ends = pa.array(np.searchsorted(at[order], np.arange(len(names) + 1)), pa.int32())  # every term of a block is found in it
        lists = [pa.ListArray.from_arrays(ends, pa.array(x[order])) for x in (who, n)]
        lang = pa.array([block.column("lang")[0].as_py()] * len(names), pa.string())
        return pa.table({"lang": lang, "term": pa.array(names, pa.binary()), "gids": lists[0], "counts": lists[1]})

    whole = made.select("block", "lang", "blobs", "names").groupBy("block")
    found = whole.cogroup(terms.unionByName(sources).groupBy("owner")).applyInArrow(run, "lang string, term binary, gids array<int>, counts array<int>")
    # One exchange by term serves the sums and the lists.
    each = found.repartition("lang", "term").select("lang", "term", F.explode(F.arrays_zip("gids", "counts")).alias("f")).select("lang", "term", F.col("f.gids").alias("gid"), F.col("f.counts").alias("count"))
    sums = each.groupBy("lang", "term", "gid").agg(F.sum("count").alias("count"))
    return sums.groupBy("lang", "term").agg(F.collect_list(F.struct("gid", "count")).alias("found"))


def probability(count: Column | int, total: Column, terms: Column) -> Column:
    """1 + floor(SCALE * (count + 1) / (total + terms)), in whole numbers."""
    wide = lambda x: (x if isinstance(x, Column) else F.lit(x)).cast("decimal(20,0)")
    return (F.call_function("div", wide(SCALE) * (wide(count) + 1), wide(total) + wide(terms)) + 1).cast("long")


def divergence(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def shared_corrections(rows: DataFrame) -> DataFrame:
    """From ``tid, gid, p, p0``, what terms that both have change, as ``a, b, value``. Rows of a term come one after the
    other in one partition; a task makes pairs of these postings in blocks and holds sums alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], int] = {}
        carry: pa.Table | None = None

        def f(p: np.ndarray, q: np.ndarray) -> np.ndarray:
            return (p - q) * (p - q) // q

        def add(a: np.ndarray, b: np.ndarray, value: np.ndarray) -> None:
            order = np.lexsort((b, a))
            a, b, value = a[order], b[order], value[order]
            starts = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
            for x, y, v in zip(a[starts].tolist(), b[starts].tolist(), np.add.reduceat(value, starts).tolist(), strict=True):
                held[x, y] = held.get((x, y), 0) + v

        def sent() -> pa.RecordBatch:
            keys = np.array(list(held), np.int64).reshape(-1, 2)
            out = pa.RecordBatch.from_arrays([pa.array(keys[:, 0], pa.int32()), pa.array(keys[:, 1], pa.int32()), pa.array(list(held.values()), pa.int64())], names=["a", "b", "value"])
            held.clear()
            return out

        def pairs(gid: np.ndarray, p: np.ndarray, p0: np.ndarray, sizes: np.ndarray) -> Iterator[None]:
            """Of runs of rows, ``sizes`` each: a row with each other row of its run, PAIRS_AT_ONCE at a time."""
            first = np.repeat(np.cumsum(sizes) - sizes, sizes)
            partners = np.repeat(sizes, sizes)
            ends = np.cumsum(partners)
            at = 0
            while at < len(gid):
                base = ends[at - 1] if at else 0
                to = max(at + 1, int(np.searchsorted(ends, base + PAIRS_AT_ONCE, "right")))
                n = partners[at:to]
                i = np.repeat(np.arange(at, to), n)
                j = np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first[at:to], n)
                i, j = i[i != j], j[i != j]
                if len(i):
                    add(gid[i], gid[j], f(p[i], p[j]) - f(p[i], p0[j]) - f(p0[i], p[j]) + f(p0[i], p0[j]))
                at = to
                yield

        def whole(t: pa.Table, last: bool) -> Iterator[pa.RecordBatch]:
            """All terms of ``t`` but the last, which may go on, unless nothing follows."""
            nonlocal carry
            tid = t.column("tid").to_numpy()
            starts = np.flatnonzero(np.r_[True, tid[1:] != tid[:-1]])
            end = len(t) if last else int(starts[-1])
            carry = t.slice(end)
            starts = starts[starts < end]
            for _ in pairs(*(t.column(c).to_numpy()[:end] for c in ("gid", "p", "p0")), np.diff(np.r_[starts, end])):
                if len(held) > PAIRS_AT_ONCE:
                    yield sent()

        for batch in batches:
            if len(batch):
                yield from whole(pa.concat_tables([*([carry] if carry is not None else []), pa.Table.from_batches([batch])]).combine_chunks(), False)
        if carry is not None and len(carry):
            yield from whole(carry, True)
        if held:
            yield sent()

    return rows.select("tid", F.col("gid").cast("long").alias("gid"), "p", "p0").mapInArrow(run, "a int, b int, value long")


def audit(docs: DataFrame) -> DataFrame:
    """``lang, source, part, item, value, rank``: for each source the other sources of its language by how far it is
    from them (``pair``), and the terms that it has more of than its language (``term``, TOP_TERMS at most)."""
    made = blocks(docs)
    groups = source_groups(made)
    postings = stored(recounted(made, groups), "postings")
    terms = postings.groupBy("lang").agg(F.count("*").alias("v"))
    totals = postings.select(F.explode("found").alias("f")).groupBy("f.gid").agg(F.sum("f.count").alias("n"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    groups = groups.join(totals, "gid", "left").join(terms, "lang", "left").select("lang", "source", "gid", zero("n"), zero("v"))
    least = F.when(F.col("v") > 0, probability(0, F.col("n"), F.col("v"))).otherwise(1)
    groups = cut(groups.withColumns({"p0": least, "lang_n": F.sum("n").over(Window.partitionBy("lang"))}))
    size = groups.agg(F.sum(F.octet_length("lang") + F.octet_length("source") + 64)).first()[0] or 0

    each = postings.withColumn("tid", F.monotonically_increasing_id()).select("term", "tid", F.aggregate("found", F.lit(0).cast("long"), lambda a, x: a + x["count"]).alias("all"), (F.size("found") > 1).alias("many"), F.explode("found").alias("f"))
    rows = each.select("term", "tid", "all", "many", "f.gid", "f.count").join(F.broadcast(groups) if size <= BROADCAST_BYTES else groups, "gid").withColumn("p", probability(F.col("count"), F.col("n"), F.col("v")))

    other = groups.select("lang", F.col("gid").alias("other"), F.col("p0").alias("q0"))
    own = groups.select("lang", "gid", "p0", "v").join(other, "lang").where("gid <> other")
    base = own.select(F.col("gid").alias("a"), F.col("other").alias("b"), (F.col("v") * divergence(F.col("p0"), F.col("q0"))).alias("value"))
    histogram = rows.groupBy("lang", "gid", "p0", "p").agg(F.count("*").alias("m"))
    p, p0, q0 = F.col("p"), F.col("p0"), F.col("q0")
    change = histogram.join(other, "lang").where("gid <> other").groupBy("gid", "other").agg(
        F.sum(F.col("m") * (divergence(p, q0) - divergence(p0, q0))).alias("to"), F.sum(F.col("m") * (divergence(q0, p) - divergence(q0, p0))).alias("back"))
    both = F.explode(F.array(F.struct(F.col("gid").alias("a"), F.col("other").alias("b"), F.col("to").alias("value")), F.struct(F.col("other").alias("a"), F.col("gid").alias("b"), F.col("back").alias("value"))))
    shared = rows.where("many")
    if size > BROADCAST_BYTES:  # else postings of a term are still together
        shared = shared.select("tid", "gid", "p", "p0").repartition("tid").sortWithinPartitions("tid")
    sums = base.unionByName(change.select(both.alias("e")).select("e.*")).unionByName(shared_corrections(shared)).groupBy("a", "b").agg(F.sum("value").alias("value"))
    named = groups.select(F.col("gid").alias("a"), "lang", "source")
    pairs = sums.join(named, "a").join(groups.select(F.col("gid").alias("b"), F.col("source").alias("item")), "b")
    best = lambda *by: Window.partitionBy(*by).orderBy(F.desc("value"), "item")
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(best("lang", "source")).alias("rank"))

    q = probability(F.col("all"), F.col("lang_n"), F.col("v"))
    more = rows.withColumn("q", q).where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").cast("string").alias("item"), divergence(F.col("p"), F.col("q")).alias("value"))
    salted = more.withColumn("salt", F.spark_partition_id() % PARTS)
    first = salted.withColumn("rank", F.row_number().over(best("lang", "source", "salt"))).where(F.col("rank") <= TOP_TERMS).drop("rank", "salt")
    ranked = first.withColumn("rank", F.row_number().over(best("lang", "source"))).where(F.col("rank") <= TOP_TERMS)
    return pairs.unionByName(ranked)
