"""Near copies: texts whose sets of five-word shingles have a Jaccard similarity of ``SIMILARITY`` or more.

SimHash differs in some ten of 64 bits at that similarity, in nineteen now and then; within such a radius no tree of
vantage points can leave out anything (distances of unrelated fingerprints are 32 +- 4), so its work would be that of
all pairs. Candidates are therefore the links of the vantage-point trees within ``RADIUS`` and, beyond them, texts
that share one of ``BANDS`` bands of ``ROWS`` minima of permuted shingle hashes: a pair at 0.8 shares none with
probability (1 - 0.8 ** ROWS) ** BANDS, 2.2e-5, a closer pair with less. Components of candidates are then compared by their
whole shingle sets; only similarity joins two texts.

Defined results. Texts with equal sets are one point. A text of fewer than five words is one shingle; blank and null
texts are equal. Shingles are compared by 64 bits of hash. A component of candidates is compared in one task, or, if
it has more text than GROUP_BYTES, in one task for each two of its blocks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, texts
from .components import connected_components
from .simhash import SEED, keep_one, link, majority

SHINGLE = 5
SIMILARITY = 0.8
RADIUS = 2
ROWS, BANDS = 5, 27
VOCABULARY = 400_000
GROUP_BYTES = 16 << 20
#: Shingles that are permuted at once.
BLOCK = 4096
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
MIX = np.uint64(0xD6E8FEB86659FD93)
ODD = np.random.default_rng(SEED).integers(0, 1 << 63, ROWS * BANDS, np.uint64) * np.uint64(2) + np.uint64(1)


class Words(dict):
    """Word to its hash; it starts anew at VOCABULARY words."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= VOCABULARY:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word, SEED)
        return h


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * MIX
    h = (h ^ (h >> np.uint64(29))) * MULTIPLIER
    return h ^ (h >> np.uint64(32))


def shingles(text: bytes, known: Words) -> np.ndarray:
    """A hash for each place of a shingle, repeats included."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    code = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    length = min(SHINGLE, len(code))
    m = len(code) - length + 1
    h = np.full(m, np.uint64(length))
    for k in range(length):
        h = (h * MULTIPLIER + code[k : k + m]) ^ (h >> np.uint64(29))
    return mixed(h)


def bands(points: np.ndarray) -> np.ndarray:
    """The band keys of a set; none for the empty set, which equals only itself."""
    if not len(points):
        return np.zeros(0, np.uint64)
    least = np.full(ROWS * BANDS, np.iinfo(np.uint64).max)
    for i in range(0, len(points), BLOCK):
        np.minimum(least, (ODD[:, None] * points[None, i : i + BLOCK]).min(axis=1), out=least)
    key = np.arange(BANDS, dtype=np.uint64)
    for row in least.reshape(BANDS, ROWS).T:
        key = mixed(key * MULTIPLIER + row)
    return key


def sketches(docs: DataFrame) -> DataFrame:
    """``docs(id, none, th, text)`` to ``(id, none, th, node, bytes, fp, keys)``; equal sets have equal nodes."""
    names = ["id", "none", "th", "node", "bytes", "fp", "keys"]

    def run(batches):
        known = Words()
        for b in batches:
            node, size, fp, keys = [], [], [], []
            for t in texts(b.column(3)):
                h = shingles(t, known)
                own = np.unique(h)
                size.append(len(t))
                node.append(xxhash.xxh64_intdigest(own.tobytes(), SEED) if len(own) else 0)
                fp.append(majority(h))
                keys.append(bands(own).view(np.int64))
            node, fp = (pa.array(np.array(x, np.uint64).view(np.int64)) for x in (node, fp))
            yield pa.RecordBatch.from_arrays([*b.columns[:3], node, pa.array(size, pa.int64()), fp, pa.array(keys, pa.list_(pa.int64()))], names=names)

    return docs.mapInArrow(run, "id long, none boolean, th long, node long, bytes long, fp long, keys array<long>")


def similar(sets: list[np.ndarray]) -> np.ndarray:
    """For each set the least index of its component under similarity. A set is compared with those not reached yet,
    so a large group of copies costs no pairs."""
    n = np.array([len(s) for s in sets])
    label = np.arange(len(sets))
    code = np.unique(np.concatenate(sets), return_inverse=True)[1] if n.sum() else np.zeros(0, np.int64)
    at = np.concatenate([[0], np.cumsum(n)])
    owner = np.repeat(label, n)
    order = np.argsort(code, kind="stable")
    held = owner[order]
    first = np.searchsorted(code[order], np.arange(code.max() + 2 if len(code) else 1))
    todo = np.ones(len(sets), bool)
    left, left_owner = code, owner
    seen = np.zeros(len(first), bool)
    for seed in range(len(sets)):
        if not todo[seed]:
            continue
        todo[seed] = False
        reach = [seed]
        while reach:
            i = reach.pop()
            own = code[at[i] : at[i + 1]]
            a, many = first[own], first[own + 1] - first[own]
            if many.sum() < len(left):
                step = np.repeat(a - np.cumsum(many) + many, many) + np.arange(many.sum())
                both = np.bincount(held[step], minlength=len(sets))
            else:
                seen[own] = True
                both = np.bincount(left_owner[seen[left]], minlength=len(sets))
                seen[own] = False
            joined = np.flatnonzero(todo & (both * (1 + SIMILARITY) >= SIMILARITY * (n[i] + n) - 1e-9))
            todo[joined] = False
            label[joined] = seed
            reach += joined.tolist()
            if len(joined):
                stay = todo[left_owner]
                left, left_owner = left[stay], left_owner[stay]
    return label


def compared(candidates: DataFrame) -> DataFrame:
    """``candidates(root, node, first, second, text)`` to pairs ``(node, kind)`` of nodes that are near copies, by a
    chain of them inside one group."""

    def tie(group: pa.Table) -> pa.Table:
        node = group.column("node").to_numpy()
        node, pick = np.unique(node, return_index=True)
        known, text = Words(), group.column("text")
        label = similar([np.unique(shingles((text[int(i)].as_py() or "").encode(), known)) for i in pick])
        return pa.table({"node": node, "kind": node[label]})

    return candidates.groupBy("root", "first", "second").applyInArrow(tie, "node long, kind long")


def dealt(wanted: DataFrame) -> DataFrame:
    """``wanted(root, node, bytes, ...)`` with the groups ``(root, first, second)`` in which nodes are compared. A
    component of more than GROUP_BYTES of text is cut into blocks, and each two of its blocks are a group, so that no
    task gets a whole one; a block of one text may be larger."""
    sizes = wanted.groupBy("root").agg(F.ceil(F.sum("bytes") / GROUP_BYTES).cast("int").alias("blocks"))
    rows = wanted.join(sizes, "root").withColumn("block", F.pmod(F.xxhash64("node"), F.greatest("blocks", F.lit(1))).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.greatest(F.col("blocks") - 1, F.lit(0)))))
    return rows.select(*wanted.columns, F.least("block", "other").alias("first"), F.greatest("block", "other").alias("second"), (F.col("blocks") > 1).alias("cut"))


def near_copies(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, th, root)`` for every row: rows that a chain of near copies joins share a root."""
    none = F.col(id).isNull()
    key = ["id", "none", "th"]
    named = docs.select(F.coalesce(F.col(id).cast("long"), F.lit(0)).alias("id"), none.alias("none"), F.xxhash64(F.col(text)).alias("th"), F.col(text).cast("string").alias("text"))
    rows = cut(sketches(named))
    nodes = cut(rows.groupBy("node").agg(F.min(F.struct("none", "id", "th")).alias("best"), F.max("bytes").alias("bytes"), F.min("fp").alias("fp"), F.min("keys").alias("keys")))
    keys = nodes.select(F.explode("keys").alias("k"), "node")
    least = keys.groupBy("k").agg(F.min("node").alias("b"), F.count("*").alias("n")).where("n > 1").drop("n")
    banded = keys.join(least, "k").where("node <> b").select(F.col("node").alias("a"), "b").distinct()
    points = cut(nodes.groupBy("fp").agg(F.min("node").alias("b")))
    same = nodes.join(points, "fp").where("node <> b").select(F.col("node").alias("a"), "b")
    ties = link(points.select("fp"), RADIUS)
    ties = ties.join(points.select(F.col("fp").alias("a"), F.col("b").alias("x")), "a").join(points.select(F.col("fp").alias("b"), F.col("b").alias("y")), "b")
    edges = banded.unionByName(same).unionByName(ties.select(F.col("x").alias("a"), F.col("y").alias("b")))
    roots = connected_components(edges)
    wanted = cut(dealt(nodes.join(roots, "node").select("node", "root", "bytes", *(F.col(f"best.{c}").alias(c) for c in key))))
    kinds = cut(compared(named.join(wanted, key).select("root", "node", "first", "second", "text")))
    many = wanted.where("cut").select("node").distinct()
    if not many.isEmpty():  # a node of a component that was cut has an answer from each of its groups
        whole = connected_components(kinds.join(many, "node", "left_semi").select(F.col("node").alias("a"), F.col("kind").alias("b")))
        kinds = kinds.join(many, "node", "left_anti").unionByName(whole.withColumnRenamed("root", "kind"))
    found = rows.select(*key, "node").join(kinds, "node", "left")
    return found.select(F.when(~F.col("none"), F.col("id")).alias("doc_id"), "th", F.coalesce("kind", "node").alias("root"))


def drop_near_copies(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` less all but one of each group of near copies."""
    return keep_one(docs, near_copies(docs, id, text), id, text)
