"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Documents are hashed to blocks of their source, about ``BLOCK_WORDS`` words each. A source is drawn in whole
passes over a keyed permutation of its blocks and then in part: further blocks in order, and of the block at the
border those documents that fill the rest best. That makes exact quotas of block draws. A binary tree over the
output shards splits the quotas: the left half of a node gets a multivariate-hypergeometric share of what the
node has of each source, seeded by the node, so any task finds the shard of a draw by walking down from the root
and nothing but the quotas is shipped. Each source's draws go to shards as disjoint ranges of its permuted
blocks; rows are shuffled inside their shard by a hash.

What the driver sees are the sources (MAX_SOURCES at most, else an error), never documents or blocks.

Defined results. A null text has size 0 and is taken as nothing; a null source is a source of its own, last in
order. Rows with the same id and text share a block and are drawn together in whole passes; at the border each
distinct (id, text) is one unit. An empty table gives an empty table. Other columns pass through; columns of the
names of mix()'s own two are replaced.
"""

from __future__ import annotations

import functools
import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, cut

WEIGHTS = (5, 2, 1)
MOST_REPEATS = 3
BLOCK_WORDS = 1 << 18
SHARD_WORDS = 1 << 21
SPAN = 4096
MAX_SOURCES = 100_000
SEED = 20


def targets(sizes: list[int], weights: list[float], share: float = 1.0, most: int = MOST_REPEATS) -> list[float]:
    """Shares of share * sum(sizes) by weight; none is above most times its size, the excess is shared again."""
    out, left, open_ = [0.0] * len(sizes), share * sum(sizes), list(range(len(sizes)))
    while open_ and left > 0:
        weight = sum(weights[i] for i in open_)
        over = [i for i in open_ if left * weights[i] / weight > most * sizes[i]]
        if not over:
            for i in open_:
                out[i] = left * weights[i] / weight
            break
        for i in over:
            out[i] = float(most * sizes[i])
        left -= sum(most * sizes[i] for i in over)
        open_ = [i for i in open_ if i not in set(over)]
    return out


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit(WORD)), F.lit(0)).cast("long")


def narrow(docs: DataFrame, id: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """What the plan needs of each document."""
    return docs.select(F.col(id).alias("id"), F.col(source).alias("source"), size_of(F.col(text)).alias("size"), F.xxhash64(text).alias("th"))


class Plan:
    """The quotas of each source. ``sizes`` is narrow(), cut from its lineage."""

    def __init__(self, sizes: DataFrame, weights=WEIGHTS, share: float = 1.0, most: int = MOST_REPEATS):
        self.spark = sizes.sparkSession
        found = sizes.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("n")).limit(MAX_SOURCES + 1).collect()
        if len(found) > MAX_SOURCES:
            raise ValueError(f"more than {MAX_SOURCES} sources")
        found.sort(key=lambda r: (r["source"] is None, r["source"] or ""))
        size = [int(r["size"]) for r in found]
        goal = targets(size, [weights[i % len(weights)] for i in range(len(size))], share, most)
        self.sources = []
        for i, r in enumerate(found):
            passes = min(most, int(goal[i] // size[i])) if size[i] else 0
            blocks = max(1, -(-(size[i] + r["n"]) // BLOCK_WORDS))
            step = next(k for k in range(max(1, int(blocks * 0.618)), 2 * blocks + 2) if math.gcd(k, blocks) == 1)
            self.sources.append({"s": i, "source": r["source"], "source_size": size[i], "target": goal[i], "passes": passes, "blocks": blocks, "step": step, "rest": goal[i] - passes * size[i], "border": -1, "left": 0.0})
        self.shards = max(1, -(-int(sum(goal)) // SHARD_WORDS))
        self._border(sizes)
        self.quotas = [x["passes"] * x["blocks"] + x["border"] + 1 for x in self.sources]

    def table(self) -> DataFrame:
        return self.spark.createDataFrame(
            [tuple(x.values()) for x in self.sources],
            "s int, source string, source_size long, target double, passes int, blocks long, step long, rest double, border long, left double",
        )

    def place(self, df: DataFrame) -> DataFrame:
        """Adds the source's plan and the block. The side that is broadcast has MAX_SOURCES rows at most."""
        t = F.broadcast(self.table().withColumnRenamed("source", "_source"))
        return df.join(t, df["source"].eqNullSafe(F.col("_source"))).drop("_source").withColumn("block", F.pmod(F.xxhash64("id", "th", F.lit(SEED)), F.col("blocks")))

    def _border(self, sizes: DataFrame) -> None:
        """Of each source the block at which what is left over after whole passes ends, found over spans of blocks
        first and then inside one span, so that no task gets all blocks of a source."""
        blocks = cut(self.place(sizes).where("rest > 0").groupBy("s", "rest", "block").agg(F.sum("size").alias("words")).withColumn("span", F.floor(F.col("block") / SPAN)))

        def ends(df: DataFrame, by: str) -> DataFrame:
            w = Window.partitionBy("s").orderBy(by)
            df = df.withColumn("after", F.sum("words").over(w)).withColumn("before", F.col("after") - F.col("words"))
            return df.where("after > rest AND before <= rest").groupBy("s").agg(F.min(F.struct(by, "before")).alias("m")).select("s", F.col(f"m.{by}").alias(by), F.col("m.before").alias("before"))

        span = ends(blocks.groupBy("s", "rest", "span").agg(F.sum("words").alias("words")), "span")
        inside = blocks.join(span, ["s", "span"]).select("s", "block", "words", "before", (F.col("rest") - F.col("before")).alias("rest"))
        for r in ends(inside.select("s", "block", "words", "rest"), "block").join(span.withColumnRenamed("before", "base").drop("span"), "s").collect():
            x = self.sources[r["s"]]
            x["border"], x["left"] = r["block"], x["rest"] - r["base"] - r["before"]

        def fill(group: pa.Table) -> pa.Table:
            g = group.sort_by([("words", "descending"), ("key", "ascending")])
            left, words = group.column("left")[0].as_py(), g.column("words").to_numpy()
            took = np.zeros(len(words), bool)
            for i, n in enumerate(words.tolist()):
                if 0 < n <= left:
                    took[i], left = True, left - n
            rest = np.flatnonzero(~took & (words > 0))
            if len(rest) and abs(words[rest].min() - left) < left:  # one more comes nearer
                took[rest[np.argmin(words[rest])]] = True
            return g.select(["s", "key"]).filter(pa.array(took))

        at = self.place(sizes).where("block = border").groupBy("s", "left", F.xxhash64("id", "th", F.lit(SEED + 1)).alias("key")).agg(F.sum("size").alias("words"))
        self.chosen = cut(at.groupBy("s").applyInArrow(fill, "s int, key long"))

    def draws(self, df: DataFrame) -> DataFrame:
        """Adds ``draws``: the numbers, in the source's order of draws, under which the mix takes the document."""
        placed = self.place(df).withColumn("key", F.xxhash64("id", "th", F.lit(SEED + 1)))
        took = placed.join(self.chosen.withColumn("chosen", F.lit(True)), ["s", "key"], "left").drop("key")
        whole = F.expr("IF(passes = 0, array(), transform(sequence(0L, passes - 1L), p -> p * blocks + pmod(block * step + p, blocks)))")
        more = F.expr("IF(border >= 0 AND (block < border OR chosen), array(passes * blocks + block), array())")
        return took.withColumn("draws", F.when(F.col("size") > 0, F.concat(whole, more)).otherwise(F.expr("array()").cast("array<bigint>")))

    def deal(self, drawn: DataFrame) -> DataFrame:
        """``drawn``, which has ``s`` and ``draws``, with ``shards``: for each draw the output shard that has it in its
        range, by the splitting tree. A draw that no shard has is not taken; it has no place in ``shards``."""
        quotas, shards = tuple(self.quotas), self.shards

        @F.pandas_udf("array<int>")
        def dealt(s: pd.Series, draws: pd.Series) -> pd.Series:
            n = draws.map(len).to_numpy()
            flat = np.concatenate([*draws, np.zeros(0, np.int64)]).astype(np.int64)
            found = descend(quotas, shards, np.repeat(s.to_numpy(), n), flat)
            return pd.Series([x[x >= 0] for x in np.split(found, np.cumsum(n)[:-1])] if len(n) else [], dtype=object)

        return drawn.withColumn("shards", dealt("s", "draws"))


#: Numbers that the splits which a task remembers may hold.
REMEMBERED = 1 << 20


@functools.cache
def splitter(sources: int):
    return functools.lru_cache(maxsize=max(1, REMEMBERED // max(1, sources)))(split)


def split(counts: tuple[int, ...], lo: int, hi: int) -> tuple[int, ...]:
    """Of a node's quotas those of its left half."""
    total = sum(counts)
    take = total * ((hi - lo) // 2) // (hi - lo)
    rng = np.random.Generator(np.random.PCG64([SEED, lo, hi]))
    return tuple(int(x) for x in rng.multivariate_hypergeometric(counts, take, method="marginals")) if total else counts


def descend(quotas: tuple[int, ...], shards: int, s: np.ndarray, draw: np.ndarray) -> np.ndarray:
    """The shard of each draw: in every node a source's first draws go left, as many as the split gives it. A draw
    beyond what the last node has is in no shard: -1."""
    out = np.full(len(s), -1, np.int32)
    halves = splitter(len(quotas))
    todo = [(0, shards, quotas, np.arange(len(s)), draw)]
    while todo:
        lo, hi, counts, rows, at = todo.pop()
        if not len(rows):
            continue
        if hi - lo == 1:
            out[rows[at < np.array(counts)[s[rows]]]] = lo
            continue
        left = halves(counts, lo, hi)
        first = np.array(left)[s[rows]]
        goes = at < first
        mid = lo + (hi - lo) // 2
        todo.append((lo, mid, left, rows[goes], at[goes]))
        todo.append((mid, hi, tuple(c - x for c, x in zip(counts, left, strict=True)), rows[~goes], (at - first)[~goes]))
    return out


def taken(docs: DataFrame, id: str = "doc_id", source: str = "source", text: str = "text", **how) -> DataFrame:
    """For every document ``id``, ``size``, ``source_size``, ``target``, ``shards`` (the output shard of each time that
    it is drawn), ``copies`` and ``taken`` words. What counts are the draws that the tree deals to shards."""
    sizes = cut(narrow(docs, id, source, text))
    plan = Plan(sizes, **how)
    copies = F.size("shards").cast("long")
    return plan.deal(plan.draws(sizes)).select(F.col("id").alias(id), "size", "source_size", "target", "shards", copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def mix(docs: DataFrame, id: str = "doc_id", source: str = "source", text: str = "text", **how) -> DataFrame:
    """The mixture: the columns of ``docs`` and ``mix_shard``, ``mix_order``; a document comes once for each draw.
    Rows of a shard are together and in their shuffled order."""
    plan = Plan(cut(narrow(docs, id, source, text)), **how)
    rows = docs.select(F.struct("*").alias("row"), F.col(id).alias("id"), F.col(source).alias("source"), size_of(F.col(text)).alias("size"), F.xxhash64(text).alias("th"))
    rows = plan.deal(plan.draws(rows)).select("row", "id", "th", F.posexplode("shards").alias("n", "mix_shard"))
    rows = rows.withColumn("mix_order", F.xxhash64("id", "th", "n", "mix_shard", F.lit(SEED)))
    keep = [c for c in docs.columns if c not in ("mix_shard", "mix_order")]
    return rows.repartition("mix_shard").sortWithinPartitions("mix_shard", "mix_order").select(*(F.col(f"row.`{c}`").alias(c) for c in keep), "mix_shard", "mix_order")
