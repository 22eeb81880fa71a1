"""SimHash near-duplicates, joined exactly by vantage-point trees over the fingerprints.

A tree built from a bounded sample (``SAMPLE_PER_LEAF`` fingerprints a leaf, ``LEAVES`` leaves at most) deals every
distinct fingerprint to its home leaf and, by the triangle bound, to the leaves that a partner of it may have as
home. Distances of unrelated fingerprints are nearly all 32 +- 4, so each further level of such a tree sends a third of
the guests both ways; the copies of a point would grow with the tree (2.3 at 16 leaves, 24 at 4096). Therefore larger
inputs cut leaves into cells of another kind: of ``radius`` + 1 blocks of bits two partners share one, so a leaf's
points are dealt by leading bits of each block, as many as keep cells at LEAF_POINTS. Copies then stay at
2.3 * (radius + 1), whatever the input. A cell that is still larger than MOST_POINTS (fingerprints of texts much alike)
is cut into parts, each two of which are compared in a task of their own. In each cell further vantage points split
the points, and what is linked comes out as a spanning forest, never as all pairs; components are joined across cells
afterwards.

Defined results. A null or blank text has fingerprint zero and links like any other. A null id orders last: it
names a component only if all its members have none. Repeated rows come out as often as they went in. An empty
table gives an empty table. Texts count whole, however long.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, texts
from .components import connected_components

LEAVES = 16
SAMPLE_PER_LEAF = 32
#: Distinct fingerprints whose home is one cell, on average, and copies that one task gets at most.
LEAF_POINTS, MOST_POINTS = 1 << 14, 1 << 18
BRUTE = 1 << 21
SEED = 42


def fingerprint(text: bytes, shingle: int = 3) -> int:
    """64 bits; a bit is 1 if it is set in over half of the XXH64 values of the word shingles, repeats counted."""
    words = text.lower().split()
    if not words:
        return 0
    if len(words) < shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    hashed = xxhash.xxh64_intdigest
    rows = zip(*(words[i:] for i in range(shingle)))
    return majority(np.fromiter((hashed(x, SEED) for x in map(b" ".join, rows)), np.uint64, len(words) - shingle + 1))


def majority(h: np.ndarray) -> int:
    """64 bits, each 1 if it is set in over half of the hashes."""
    ones = np.zeros(64, np.int64)
    for i in range(0, len(h), 1 << 16):
        bits = np.unpackbits(h[i : i + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(h), bitorder="little").tobytes(), "little")


def with_fingerprint(docs: DataFrame, text: str = "text", shingle: int = 3) -> DataFrame:
    """The other columns of ``docs`` and ``fp``, the fingerprint as a signed long; it replaces a column of that name."""
    keep = [c for c in docs.columns if c not in (text, "fp")]
    schema = docs.select(*keep).withColumn("fp", F.lit(0).cast("long")).schema

    def run(batches):
        for b in batches:
            fps = np.array([fingerprint(x, shingle) for x in texts(b.column(b.num_columns - 1))], np.uint64)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(fps.view(np.int64))], names=[*keep, "fp"])

    return docs.select(*keep, text).mapInArrow(run, schema)


def distances(points: np.ndarray, to: np.uint64) -> np.ndarray:
    return np.bitwise_count(points ^ to)


def vantage(points: np.ndarray, tries: int = 6) -> tuple[np.uint64, int]:
    """Of a few points the one whose distances spread most, with their median."""
    best = None
    look = points[:: max(1, len(points) // 512)]
    for v in points[:: max(1, len(points) // tries)][:tries]:
        spread = float(distances(look, v).std())
        if best is None or spread > best[0]:
            best = spread, v
    return best[1], int(np.median(distances(points, best[1])))


def build_tree(sample: np.ndarray, leaves: int) -> list[tuple[int, int, int, int]]:
    """Nodes (vantage point, radius, left, right); a negative child -1 - k is leaf k. Empty for one leaf."""
    nodes: list = []
    n_leaves = 0

    def grow(points: np.ndarray, want: int) -> int:
        nonlocal n_leaves
        if want > 1 and len(points) > 1:
            v, mu = vantage(points)
            near = distances(points, v) <= mu
            if near.any() and not near.all():
                nodes.append(None)
                at = len(nodes) - 1
                left = grow(points[near], want // 2)
                nodes[at] = (int(v), mu, left, grow(points[~near], want - want // 2))
                return at
        n_leaves += 1
        return -n_leaves

    grow(sample, leaves)
    return nodes


def route(points: np.ndarray, nodes: list, radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(index of the point, leaf, whether it is its home): every pair within ``radius`` meets in the home leaf
    of at least one of the two."""
    out = []
    todo = [(0 if nodes else -1, np.arange(len(points)), np.zeros(0, np.int64))]
    while todo:
        at, home, guest = todo.pop()
        if at < 0:
            out += [(home, -1 - at, True), (guest, -1 - at, False)]
            continue
        v, mu, left, right = nodes[at]
        d, e = distances(points[home], np.uint64(v)), distances(points[guest], np.uint64(v)).astype(np.int64)
        todo.append((left, home[d <= mu], np.concatenate([guest[e <= mu + radius], home[(d > mu) & (d <= mu + radius)]])))
        todo.append((right, home[d > mu], guest[e > mu - radius]))
    out = [x for x in out if len(x[0])]
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, bool)
    return tuple(np.concatenate(x) for x in ([x[0] for x in out], [np.full(len(x[0]), x[1], np.int32) for x in out], [np.full(len(x[0]), x[2]) for x in out]))


def merge(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Joins the classes of a[i] and b[i]; label[x] <= x always leads to the least member."""
    while True:
        while not np.array_equal(up := label[label], label):
            label = up
        ra, rb = label[a], label[b]
        if not (apart := ra != rb).any():
            return label
        np.minimum.at(label, np.maximum(ra, rb)[apart], np.minimum(ra, rb)[apart])


def link_leaf(points: np.ndarray, home: np.ndarray, radius: int) -> np.ndarray:
    """For each point of a leaf the index of its class among them."""
    label = np.arange(len(points))
    held: list = []
    todo = [(np.flatnonzero(home), np.flatnonzero(~home))]
    while todo:
        own, guest = todo.pop()
        if len(own) * (len(own) + len(guest)) > BRUTE and len(own) > 64:
            v, mu = vantage(points[own])
            d, e = distances(points[own], v), distances(points[guest], v).astype(np.int64)
            if (d > mu).any():
                todo.append((own[d <= mu], np.concatenate([guest[e <= mu + radius], own[(d > mu) & (d <= mu + radius)]])))
                todo.append((own[d > mu], guest[e > mu - radius]))
                continue
        every = np.concatenate([own, guest])
        step = max(1, BRUTE // max(1, len(every)))
        for i in range(0, len(own), step):
            x, y = np.nonzero(np.bitwise_count(points[own[i : i + step], None] ^ points[every][None, :]) <= radius)
            a, b = own[i + x], every[y]
            held.append((a[a != b], b[a != b]))
            if sum(len(h[0]) for h in held) > BRUTE:
                label, held = merge(label, *map(np.concatenate, zip(*held, strict=True))), []
    if held:
        label = merge(label, *map(np.concatenate, zip(*held, strict=True)))
    return label


def cells(points: np.ndarray, leaf: np.ndarray, radius: int, bits: int) -> np.ndarray:
    """(radius + 1, points): for each block of bits the number of the cell, from the leaf and the block's leading bits."""
    blocks = radius + 1
    width = 64 // blocks
    value = [(points >> np.uint64(64 - (j + 1) * width) & np.uint64((1 << width) - 1)) >> np.uint64(width - bits) for j in range(blocks)]
    return np.stack([((leaf.astype(np.int64) * blocks + j) << width) + v.astype(np.int64) for j, v in enumerate(value)])


def link(points: DataFrame, radius: int = 2) -> DataFrame:
    """``points(fp)``, each once, to edges ``(a, b)`` whose components are those of all pairs within ``radius``."""
    want = max(1, -(-points.count() // LEAF_POINTS))
    leaves = min(LEAVES, want)
    bits = min(64 // (radius + 1), (-(-want // leaves) - 1).bit_length())
    sample = [r[0] for r in points.orderBy(F.xxhash64("fp"), "fp").limit(leaves * SAMPLE_PER_LEAF).collect()] if leaves > 1 else []
    nodes = build_tree(np.array(sample, np.int64).view(np.uint64), leaves)

    def deal(batches):
        for b in batches:
            p = b.column(0).to_numpy()
            i, leaf, home = route(p.view(np.uint64), nodes, radius)
            cell = cells(p.view(np.uint64)[i], leaf, radius, bits) if bits else leaf[None].astype(np.int64)
            n = len(cell)
            yield pa.RecordBatch.from_arrays([pa.array(cell.ravel()), pa.array(np.tile(p[i], n)), pa.array(np.tile(home, n))], names=["cell", "fp", "home"])

    def tie(group: pa.Table) -> pa.Table:
        p = group.column("fp").to_numpy()
        order = np.argsort(p)
        p, home = p[order], group.column("home").to_numpy()[order]
        label = link_leaf(p.view(np.uint64), home, radius)
        own = np.flatnonzero(label != np.arange(len(p)))
        return pa.table({"a": p[own], "b": p[label[own]]})

    rows = points.mapInArrow(deal, "cell long, fp long, home boolean")
    large = cut(rows.groupBy("cell").agg(F.count("*").alias("n")).where(F.col("n") > MOST_POINTS))
    if large.isEmpty():
        return rows.groupBy("cell").applyInArrow(tie, "a long, b long")
    rows = rows.join(large, "cell", "left")
    parts = F.ceil(2 * F.coalesce("n", F.lit(0)) / MOST_POINTS).cast("int")  # two of them are a task
    rows = rows.withColumn("parts", F.greatest(parts, F.lit(1))).withColumn("part", F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    return rows.groupBy("cell", F.least("part", "other"), F.greatest("part", "other")).applyInArrow(tie, "a long, b long")


def near_duplicates(docs: DataFrame, id: str = "doc_id", text: str = "text", shingle: int = 3, radius: int = 2, keep: tuple = ()) -> DataFrame:
    """``(doc_id, *keep, fp, root, component_id)`` for every row: fingerprints that a chain of links joins share a component."""
    named = docs.select(F.col(id).cast("long").alias("doc_id"), *keep, F.col(text).alias("text"))
    rows = cut(with_fingerprint(named, "text", shingle))
    points = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = connected_components(link(points.select("fp"), radius))
    placed = points.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    return rows.join(placed.join(named, "root").select("fp", "root", "component_id"), "fp")


def drop_near_duplicates(docs: DataFrame, id: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """The rows of ``docs`` less all but one of each component: the one of least id, then of least text hash."""
    marked = docs.select(F.col(id).alias("id"), F.col(text).alias("text"), F.xxhash64(F.col(text)).alias("th"))
    return keep_one(docs, near_duplicates(marked, "id", "text", keep=("th",), **how), id, text)


def keep_one(docs: DataFrame, rows: DataFrame, id: str, text: str) -> DataFrame:
    """One row of ``docs`` for each root of ``rows(doc_id, th, root)``, which has every row of ``docs``."""
    on = ["id", "none", "th"]
    best = rows.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.coalesce("doc_id", F.lit(0)).alias("id"), "th")).alias("best"))
    same = rows.groupBy(F.coalesce("doc_id", F.lit(0)).alias("id"), F.col("doc_id").isNull().alias("none"), "th").count()
    best = cut(best.select(*(F.col(f"best.{c}").alias(c) for c in on)).join(same, on))
    marked = docs.select(F.struct("*").alias("row"), F.coalesce(F.col(id).cast("long"), F.lit(0)).alias("id"), F.col(id).isNull().alias("none"), F.xxhash64(F.col(text)).alias("th"))
    once = marked.join(best.where("count = 1"), on, "left_semi")
    if not best.where("count > 1").isEmpty():
        once = once.unionByName(marked.join(best.where("count > 1"), on, "left_semi").dropDuplicates(on))
    return once.select(*(F.col(f"row.`{c}`").alias(c) for c in docs.columns))
