"""Packing, source divergence and filter interaction against brute force, with odd rows."""

import collections
import itertools
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ontoloom.llm import common, divergence, interactions, packing

DOCS = "doc_id long, text string, lang string, source string, part string, marks int, gid long, length int"
BPE = str(public_tokenizers.path("byte_bpe_50k.json"))
MORE = ("x", 1, 1, 1)  # columns whose names operators use


def rows(n=90, seed=3):
    """Gibberish in three languages; rows that are null, blank, repeated, very long or share an id."""
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcEFé") for _ in range(rng.randint(1, 5))) for _ in range(60)] + ["a#b", "x1y", "ÄÖ", "don't", "$", "(ab)"]
    say = lambda k: "".join(rng.choice(words) + rng.choice((" ", " ", " ", "\n", ", ", "  ")) for _ in range(k))
    out = []
    for i in range(n):
        text = out[-3][1] if i % 9 == 8 else say(rng.choice((3, 40, 150))).upper() if i % 11 == 5 else say(rng.choice((1, 20, 120, 260)))
        out.append((i, text, ("en", "de", "fr")[i % 3], f"s{i * i % 7}", *MORE))
    out += [(n, None, None, None, *MORE), (n + 1, "", "", "s0", *MORE), (n + 2, " \n\t", "en", None, *MORE), (None, out[4][1], "en", "s1", *MORE), (None, None, "xx", "s1", *MORE)]
    out += [out[7], (3, say(40), "de", "s2", *MORE), (n + 3, "ab cd " * 40_000, "en", "s1", *MORE), (n + 4, "x" * 300_000, "fr", "only", *MORE)]
    return out


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), DOCS).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def fewest(items, capacity):
    items, best = sorted(items, reverse=True), len(items)

    def go(i, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if i == len(items):
            best = len(bins)
            return
        for room in sorted({b for b in bins if b >= items[i]}):
            left = list(bins)
            left[left.index(room)] -= items[i]
            go(i + 1, left)
        go(i + 1, [*bins, capacity - items[i]])

    go(0, [])
    return best


def used(patterns, capacity):
    counts = np.zeros(capacity + 1, int)
    for pattern, times in patterns:
        assert sum(s * m for s, m in pattern) <= capacity and times > 0
        for s, m in pattern:
            counts[s] += m * times
    return counts.tolist()


def test_bin_completion_finds_the_fewest():
    rng = random.Random(5)
    better = 0
    for k in range(150):
        capacity = rng.choice((20, 50, 100))
        items = [rng.randint(1, capacity) if k % 2 else rng.randint(capacity // 6, capacity // 2) for _ in range(rng.randint(0, 12))]
        counts = np.bincount(items, minlength=capacity + 1) if items else np.zeros(capacity + 1, int)
        first, best = packing.best_fit(counts, capacity), packing.bin_completion(counts, capacity)
        assert used(first, capacity) == used(best, capacity) == counts.tolist()
        n = sum(t for _, t in best)
        assert packing.lower_bound(counts, capacity) <= n == fewest(items, capacity) <= sum(t for _, t in first)
        better += n < sum(t for _, t in first)
    assert better
    many = np.bincount(np.random.default_rng(1).integers(256, 400, 30_000), minlength=1025)
    assert sum(t for _, t in packing.bin_completion(many)) < sum(t for _, t in packing.best_fit(many))
    assert packing.dominates((7, 3), (4, 3, 2)) and not packing.dominates((5, 5), (7,))


def test_words_have_the_tokenizers_ids():
    rng = random.Random(3)
    model, encoder = Tokenizer.from_file(BPE), packing.Encoder.of(BPE)
    pieces = [" ", "\n", "\t", "  ", "a", "b1", "é", "!", ".", ",", "Word", "ünd", "×", "\xa0", "　", "'s", "<|endoftext|>", "12", "\x1c", "​", "的", "\r", "\x85", "ª", "###", "-", "😀", "é"]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randint(0, 9))) for _ in range(20_000)]
    whole = model.encode_batch(texts, add_special_tokens=False)
    assert encoder.encoded(texts) == [packing.raw(e.ids) for e in whole]


def test_packing(docs, empty):
    model = Tokenizer.from_file(BPE)
    packed = packing.pack(docs, BPE, keep_ids=True)
    found = packed.collect()
    want, got = collections.Counter(), collections.Counter()
    for i, text, *_ in rows():
        ids = np.array([*model.encode(text or "", add_special_tokens=False).ids, packing.END], "<u4")
        first = (len(ids) - 1) % 1024 + 1
        cuts = [0, *range(first, len(ids) + 1, 1024)]
        want.update((i, k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(itertools.pairwise(cuts)))
    got.update((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in found)
    assert got == want and all(zlib.crc32(r["ids"]) == r["ids_crc32"] for r in found)
    held = collections.defaultdict(list)
    for r in found:
        held[r["sequence_id"]].append((r["offset"], r["length"], bytes(r["ids"])))
    for own in held.values():
        own.sort()
        assert [o for o, _, _ in own] == [0, *itertools.accumulate(n for _, n, _ in own)][:-1] and sum(n for _, n, _ in own) <= 1024
    made = {r["sequence_id"]: bytes(r["ids"]) for r in packing.sequences(packed).collect()}
    assert made == {k: b"".join(x for _, _, x in own) for k, own in held.items()}
    counts = np.bincount([r["length"] for r in found], minlength=1025)
    assert len(held) == sum(t for _, t in packing.bin_completion(counts))
    assert packing.pack(empty, BPE).count() == 0


def terms_of(text):
    return re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def audited(table):
    seen, counts = collections.Counter(), collections.defaultdict(collections.Counter)
    for _, text, lang, source, *_ in table:
        seen.update({(lang or "", t) for t in terms_of(text)})
        counts[lang or "", source or ""].update(terms_of(text))
    out = []
    for lang in {g[0] for g in counts}:
        kept = [t for (own, t), n in seen.items() if own == lang and n >= 3]
        of = {s: c for (own, s), c in counts.items() if own == lang}
        whole = sum(of.values(), collections.Counter())

        def share(c):
            n = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 1) // (n + len(kept)) for t in kept}

        f = lambda p, q: (p - q) ** 2 // q
        p, q = {s: share(c) for s, c in of.items()}, share(whole)
        for s in of:
            pairs = [(sum(f(p[s][t], p[o][t]) for t in kept), o) for o in of if o != s]
            best = [(f(p[s][t], q[t]), t) for t in kept if of[s][t] and p[s][t] > q[t]]
            for part, found, most in (("pair", pairs, len(pairs)), ("term", best, divergence.TOP_TERMS)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, value, k) for k, (value, item) in enumerate(found[:most], 1)]
    return sorted(out)


def test_divergence(spark, docs, empty, monkeypatch):
    want = audited(rows())
    assert {x[2] for x in want} == {"pair", "term"}
    for block, pairs, top, sent in ((8 << 20, 1 << 19, 200, 1 << 24), (3000, 7, 5, 0)):  # few and many blocks, sums that are sent on, short lists, a join by shuffle
        monkeypatch.setattr(divergence, "BROADCAST_BYTES", sent)
        monkeypatch.setattr(divergence, "BLOCK_BYTES", block)
        monkeypatch.setattr(divergence, "PAIRS_AT_ONCE", pairs)
        monkeypatch.setattr(divergence, "TOP_TERMS", top)
        got = divergence.audit(docs).select("lang", "source", "part", "item", "value", "rank").collect()
        assert sorted(map(tuple, got)) == audited(rows())
    assert divergence.audit(empty).count() == 0


def failing(table):
    first = {}
    for i, text, *_ in table:
        i = 1 << 63 if i is None else i
        first[text or ""] = min(i, first.get(text or "", i))
    out = []
    for i, text, lang, *_ in table:
        t = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = (len(words) < 100, 100 * len(set(words)) < 80 * len(words), 100 * sum("A" <= c <= "Z" for c in t) > 10 * len(t), bool(re.search(r"[#$%&*|]", t)), (1 << 63 if i is None else i) > first[t])
        out.append((i, lang or "", dict(zip("ABCDE", fails))))
    return out


def test_interactions(spark, docs, empty, monkeypatch):
    labels = [(i, i % 2, int(i % 5 == 0)) for i in range(0, 80, 2)] + [(7, 0, 0), (7, 1, 1), (9, None, None), (None, 1, 1), (10_000, 1, 1)]
    good, toxic = ({r[0] for r in labels if r[0] is not None and r[k] == 1} for k in (1, 2))
    table = failing(rows())
    want, whole = {}, collections.Counter()
    for part in {p for _, p, _ in table}:
        for order in map("".join, itertools.permutations("ABCDE")):
            left = [(i, f) for i, p, f in table if p == part]
            for step, x in enumerate(order, 1):
                gone = [i for i, f in left if f[x]]
                failed = sum(f[x] for _, p, f in table if p == part)
                alone = sum(f[x] and sum(f.values()) == 1 for _, p, f in table if p == part)
                left = [(i, f) for i, f in left if not f[x]]
                whole[part, x] += len(gone)
                want[part, order, step] = (len(left), len(gone), failed - len(gone), alone, sum(i in good for i in gone), sum(i in toxic for i in gone))
    frame = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    for block in (1 << 20, 7):
        monkeypatch.setattr(interactions, "BLOCK", block)
        got = interactions.interactions(docs, frame).collect()
        names = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")
        assert {(r["part"], r["filter_order"], r["step"]): tuple(r[n] for n in names) for r in got} == want and len(got) == len(want)
        assert all(r["shapley"] == whole[r["part"], r["filter_order"][r["step"] - 1]] for r in got)
    assert interactions.interactions(empty, frame).count() == 0
    assert interactions.interactions(docs, frame.where(F.lit(False))).agg(F.sum("good_lost")).first()[0] == 0


def test_sums_of_many_partitions_meet_in_small_groups(spark):
    """A blob says how many it is the sum of, and the largest group that it went through."""
    parts = spark.range(0, 100, numPartitions=100).selectExpr("id % 2 AS k", "encode('1 1', 'UTF-8') AS x")

    def add(blobs):
        each = [tuple(map(int, b.split())) for b in blobs]
        return f"{sum(n for n, _ in each)} {max(len(blobs), *(m for _, m in each))}".encode()

    got = {r["k"]: bytes(r["x"]) for r in common.tree_sums(parts, ["k"], "x", add, fan_in=4).collect()}
    assert {k: int(x.split()[0]) for k, x in got.items()} == {0: 50, 1: 50} and all(int(x.split()[1]) <= 4 for x in got.values())
    ends = common.tree_sums(parts.drop("k"), [], "x", add, ends=8, fan_in=4).collect()
    assert 1 < len(ends) <= 8 and sum(int(bytes(r["x"]).split()[0]) for r in ends) == 100
    assert common.tree_sums(parts.limit(0), ["k"], "x", add).count() == 0
