"""Each operator against a brute-force version, an exact round trip or held-out accuracy, with odd rows."""

import collections
import hashlib
import math
import os
import random
import re
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ontoloom.llm import chat, classifier, decontaminate, html, lm, mixing, near, repeats, rules, simhash, warc
from ontoloom.llm.queries import queries

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, chunk int, row string"


def corpus(n=60, seed=1):
    """Gibberish with copies, shared passages, and rows that are null, blank, repeated or share an id; the columns
    ``chunk`` and ``row`` clash with names that operators use."""
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdeéß") for _ in range(rng.randint(1, 7))) for _ in range(80)]
    say = lambda k: " ".join(rng.choice(words) for _ in range(k))
    shared = [say(30) for _ in range(3)]
    rows = []
    for i in range(n):
        text = say(rng.randint(1, 120))
        if i % 3 == 0:
            text += " " + shared[i % 9 // 3] + "\n" + say(9)
        if i % 7 == 0 and i:
            text = rows[-1][1]
        rows.append((i, text, "en", f"s{i % 3}", 7, "r"))
    rows += [(n, None, None, None, 7, "r"), (n + 1, "", "en", "s0", 7, "r"), (n + 2, " \n\t", "en", "s1", None, None), rows[5], (None, rows[3][1], "en", None, 7, "r"), (2, say(40), "en", "s2", 7, "r"), (n + 3, "aa " * 400, "en", "s2", 7, "r")]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), DOCS).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def test_repeats_of_a_passage_that_a_document_has_twice(spark):
    """An earlier document has but the middle of it: the middle of every copy goes."""
    rng = random.Random(5)
    say = lambda n: "".join(rng.choice("abcdefghij") for _ in range(n))
    middle = say(60)
    passage = say(40) + middle + say(40)
    rows = [(1, say(90) + middle + say(90)), (2, say(10) + passage + say(30) + passage + say(20) + passage)]
    got = {r["doc_id"]: (r["n_removed"], [tuple(s) for s in r["spans"]]) for r in repeats.mark_repeats(spark.createDataFrame(rows, "doc_id long, text string")).select("row.doc_id", "n_removed", "spans").collect()}
    assert got[1] == (0, [])
    assert got[2] == (180, [(50, 110), (220, 280), (380, 440)])


def test_repeats(spark, docs, empty, monkeypatch):
    monkeypatch.setattr(repeats, "CHUNK_BYTES", 6000)
    monkeypatch.setattr(repeats, "BUCKET_BYTES", 3000)
    rows = corpus()
    last = 1 << 62
    seen = {}
    for i, t, *_ in rows:
        b, i = (t or "").encode(), last if i is None else i
        for p in range(len(b) - 49):
            seen[b[p : p + 50]] = min(i, seen.get(b[p : p + 50], last))
    want = collections.Counter()
    for i, t, *_ in rows:
        b, j = (t or "").encode(), last if i is None else i
        gone = bytearray(len(b))
        for p in range(len(b) - 49):
            if seen[b[p : p + 50]] < j:
                gone[p : p + 50] = b"\1" * 50
        want[(i, len(b), sum(gone), bytes(x for x, g in zip(b, gone) if not g))] += 1
    got = repeats.mark_repeats(docs)
    assert collections.Counter((r["row"]["doc_id"], r["n_bytes"], r["n_removed"], bytes(r["kept"])) for r in got.collect()) == want
    assert any(n for _, _, n, _ in want)
    kept = repeats.drop_repeats(docs)
    assert kept.columns == docs.columns and kept.count() == len(rows)
    assert repeats.mark_repeats(empty).count() == 0


def test_repeats_in_chunks_of_many_pieces(spark, docs, empty, monkeypatch):
    monkeypatch.setattr(repeats, "PIECE_BYTES", 700)
    test_repeats(spark, docs, empty, monkeypatch)


def test_pieces_have_the_same_rows_whatever_order_a_shuffle_gives(spark):
    rows = [(i % 9 or None, None if i == 4 else b"%d" % (i * 7 % 5), i) for i in range(40)]
    rng, found = random.Random(2), set()
    for _ in range(20):
        rng.shuffle(rows)
        cuts = [0, 13, 13, 40]
        parts = [pa.table([pa.array(c, t) for c, t in zip(zip(*rows[a:b], strict=True), kinds, strict=True)], names=["id", "body", "row"]) for a, b in zip(cuts, cuts[1:], strict=False) if b > a for kinds in [(pa.int64(), pa.binary(), pa.int64())]]
        got = repeats.in_order(pa.concat_tables(parts))
        assert sorted(zip(*(got.column(c).to_pylist() for c in ("id", "body", "row")), strict=True), key=repr) == sorted(rows, key=repr)
        found.add(repr([got.column(c).to_pylist() for c in ("id", "body")]))
    assert len(found) == 1


@pytest.mark.parametrize("kind", [repeats.SURROUNDINGS, repeats.SIDES, repeats.WINDOWS])
def test_judging_a_bucket_takes_no_longer_for_many_senders(kind):
    """Each sender's answers were looked for among all entries, so work grew with the square of the input."""

    def seconds(senders, n=200_000):
        rng, rows = np.random.default_rng(1), []
        for k in range(senders):
            x = np.sort(rng.integers(0, 1 << 16, n // senders)).astype(np.uint64)
            y, d = (rng.integers(0, 3, n // senders).astype(np.uint64) for _ in range(2))
            rows.append((0, k, repeats.pack(x, 6), repeats.pack(y, 6), repeats.pack(d, 2), repeats.packed_ids(np.arange(3) + 3 * k)))
        columns = zip(zip(*rows, strict=True), (pa.int32(), pa.int32(), *[pa.binary()] * 4), strict=True)
        table = pa.table([pa.array(c, t) for c, t in columns], names=["bucket", "chunk", "x", "y", "d", "ids"])
        took = []
        for _ in range(3):
            start = time.thread_time()
            got = repeats.judge(kind, 6)(table)
            took.append(time.thread_time() - start)
        assert got.num_rows > senders * 0.9
        return min(took)

    assert seconds(8000) < 12 * seconds(40)


def test_simhash(spark, docs, empty):
    rows = corpus()
    fps = [simhash.fingerprint((t or "").encode()) for _, t, *_ in rows]
    group = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if (fps[a] ^ fps[b]).bit_count() <= 2 and group[a] != group[b]:
                old, new = group[a], group[b]
                group = [new if g == old else g for g in group]
    least = {g: min((r[0] for r, h in zip(rows, group) if h == g and r[0] is not None), default=None) for g in group}
    want = collections.Counter((r[0], f, least[g]) for r, f, g in zip(rows, fps, group))
    found = simhash.near_duplicates(docs)
    assert collections.Counter((r["doc_id"], r["fp"] & (1 << 64) - 1, r["component_id"]) for r in found.collect()) == want
    assert simhash.drop_near_duplicates(docs).count() == len(set(group))
    assert simhash.near_duplicates(empty).count() == simhash.drop_near_duplicates(empty).count() == 0


@pytest.mark.parametrize(("leaves", "most"), [(16, 1 << 18), (4, 1 << 18), (4, 30), (1, 60)])
def test_vantage_point_tree_finds_every_pair(spark, monkeypatch, leaves, most):
    rng = random.Random(4)
    base = [rng.getrandbits(64) for _ in range(150)]
    base += [base[0] ^ rng.getrandbits(8) for _ in range(40)]  # much alike
    monkeypatch.setattr(simhash, "LEAVES", leaves)
    monkeypatch.setattr(simhash, "MOST_POINTS", most)
    points = {b ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for b in base for _ in range(4)} | set(base)
    signed = [p - (1 << 64) if p >> 63 else p for p in points]
    monkeypatch.setattr(simhash, "LEAF_POINTS", 40)
    monkeypatch.setattr(simhash, "BRUTE", 1 << 9)
    edges = simhash.link(spark.createDataFrame([(p,) for p in signed], "fp long")).collect()
    up = {p: p for p in signed}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        assert ((a ^ b) & (1 << 64) - 1).bit_count() <= 64
        up[max(root(a), root(b))] = min(root(a), root(b))
    for i, a in enumerate(signed):
        for b in signed[:i]:
            if ((a ^ b) & (1 << 64) - 1).bit_count() <= 2:
                assert root(a) == root(b)
    classes = list(range(len(signed)))
    for i, a in enumerate(signed):
        for j, b in enumerate(signed[:i]):
            if ((a ^ b) & (1 << 64) - 1).bit_count() <= 2 and classes[i] != classes[j]:
                old, new = classes[i], classes[j]
                classes = [new if c == old else c for c in classes]
    assert len({root(p) for p in signed}) == len(set(classes)) >= 100


@pytest.mark.parametrize("cut_up", [False, True])
def test_near_copies_of_the_pipeline(spark, docs, empty, monkeypatch, cut_up):
    import corpus_pipeline

    rng = random.Random(6)
    rows = [(i, t, "en", "s", 7, "r") for i, t, *_ in corpus()]
    for i in range(1000, 1040):
        words = ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(300)]
        rows.append((i, " ".join(words), "en", "s", 7, "r"))
        for j in range(1, 3):
            changed = list(words)
            for k in range(rng.choice((2, 4, 6))):
                changed[40 * k + 20] = "new" + str(i)
            rows.append((i + 1000 * j, " ".join(changed), "en", "s", 7, "r"))
    sets = []
    for _, t, *_ in rows:
        w = (t or "").lower().split()
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))})
    group = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if group[a] != group[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                old, new = group[a], group[b]
                group = [new if g == old else g for g in group]
    df = spark.createDataFrame(rows, DOCS).repartition(3)
    if cut_up:
        monkeypatch.setattr(near, "GROUP_BYTES", 3000)
    kept = corpus_pipeline.near_dedup(spark, df, SF)
    want = [min((r[0] is None, r[0]) for r, h in zip(rows, group) if h == g) for g in set(group)]
    got = [(r["doc_id"] is None, r["doc_id"]) for r in kept.collect()]
    assert sorted(map(str, got)) == sorted(map(str, want)) and kept.columns == df.columns
    assert not {i for i in range(2000, 4000)} & {i for _, i in got}
    assert near.drop_near_copies(empty).count() == 0


def test_rules(spark, docs, empty):
    for r in rules.quality(docs.withColumn("doc_id", F.monotonically_increasing_id())).collect():
        assert (r["n_words"] < 50 or 2 * r["n_repeat_words"] > r["n_words"]) == r["base_failed"]
    ids = docs.withColumn("doc_id", F.monotonically_increasing_id()).cache()
    text = {r["doc_id"]: r["text"] or "" for r in ids.collect()}
    for r in rules.quality(ids).collect():
        t = text[r["doc_id"]]
        w, at = WORD.findall(t), collections.defaultdict(list)
        for i in range(len(w) - 2):
            at[tuple(w[i : i + 3])].append(i)
        covered = {i + k for places in at.values() if len(places) > 1 for i in places for k in range(3)}
        lines = [x for x in t.split("\n") if WORD.search(x)]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered))
    assert rules.quality(empty).count() == 0 and rules.keep_quality(docs).columns == docs.columns
    patterns, _, share = rules.fit({0b111000000: 900, 0b100000001: 60, 0b100000100: 40})
    assert patterns[0b111000000] > 0.9 > 0.1 > patterns[0b100000001] and patterns[0b100000100] < 0.1 and share > 0.8


def test_mixing(spark, docs, empty):
    assert mixing.targets([100, 100, 100], [5, 2, 1]) == [187.5, 75.0, 37.5]
    assert mixing.targets([10, 1000, 0], [5, 2, 1]) == [30.0, 980.0, 0.0]
    found = mixing.taken(docs).collect()
    again = mixing.taken(docs.repartition(5)).collect()
    key = lambda r: (str(r["doc_id"]), r["size"], r["taken"])
    assert sorted(map(key, found)) == sorted(map(key, again)) and len(found) == docs.count()
    by = collections.defaultdict(lambda: [0, 0.0, 0])
    for r in found:
        assert r["taken"] <= 3 * r["size"]
    source = collections.defaultdict(set)
    for r in found:
        by[r["target"]][0] += r["taken"]
        source[r["target"]].add(r["source_size"])
    for target, (taken, *_) in by.items():
        assert abs(taken - target) <= 0.05 * target + 5
    mixed = mixing.mix(docs)
    assert mixed.columns[: len(docs.columns)] == docs.columns and mixed.count() == sum(r["copies"] for r in found)
    assert mixing.taken(empty).count() == mixing.mix(empty).count() == 0
    import numpy as np

    shards = mixing.descend((40, 25, 7), 8, np.repeat([0, 1, 2], [40, 25, 7]), np.concatenate([np.arange(n) for n in (40, 25, 7)]))
    assert sorted(collections.Counter(shards.tolist()).values()) == [9] * 8


def test_chat(spark):
    control = "</s>[INST] ok [/INST]"
    rows = [(-1, 0, "user", control), (-1, 1, "assistant", control), (1, 0, "assistant", "<\\s> <\\\\/s>[\\INST] <<s>>"), (1, 1, "user", "[[INST]]"), (2, 0, "we</s>ird", None), (3, 0, "assistant", "$1\\"), (3, 0, "assistant", "$1\\"), (None, None, None, "x😀"), (4, 2, "assistant", "\n"), (4, 1, "assistant", "a" * 50_000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    by = collections.defaultdict(list)
    for c, n, role, text in rows:
        by[c].append((-1 if n is None else n, role or "", text or ""))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for r in chat.read_back(chat.examples(df)).collect():
        turns = sorted(by[r["conv_id"]])
        loss = "".join(t for _, role, t in turns if role == "assistant")
        assert (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) == (len(turns), sha("".join(f"{x}\n{t}\n" for _, x, t in turns)), len(loss), sha(loss))
    for r in chat.examples(df).where("conv_id = -1").collect():
        assert r["formatted"].count("[INST]") == 2 and r["loss_chars"] > 0
    assert chat.examples(df.limit(0)).count() == 0


def test_warc(spark, tmp_path):
    big, rng = "x" * 1500, random.Random(2)
    huge = "".join(rng.choice("abc<é\r\n") for _ in range(90_000))
    rows = [(1, "http://a", big), (5, "http://b\r\nX: y", big), (5, "http://b\r\nX: y", big), (2, None, None), (3, "u", ""), (4, "u", "short"), (9, "u", "short"), (7, "h", huge), (7, "h", huge), (None, "n", big), (8, "end", "WARC/1.1\r\n\r\n0\r\n\r\n")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = collections.Counter(tuple(r) for r in warc.archived(pages).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect())
    want = collections.Counter()
    for i, _, h in rows:
        b = (h or "").encode()
        again = len(b) >= 1000 and h == big and i not in (5,)
        if i is None:
            again = False
        want[(i, len(b), hashlib.sha1(b).hexdigest(), "revisit" if again else "response", 5 if again else None)] += 1
    assert got == want
    assert warc.archived(pages.limit(0)).count() == 0
    parts = warc.records(1, "u", 0, hashlib.sha1(huge.encode()).digest(), huge.encode(), None)
    assert len(parts) > 2
    with pytest.raises(warc.WarcError):
        list(warc.parsed(parts[0][:-5] + warc.END))
    with pytest.raises(warc.WarcError):
        warc.unframed(b"5\r\nabc")


def test_html():
    page = """<html><head><title>t</title></head><body><header><a href=/>Home</a></header><nav><a href=a>A</a></nav><div class="cookie-notice"><p>We use cookies to make it all much better for you and us here.</p></div>
    <article><h1>A &amp; B</h1><p>First   paragraph<br>goes on &lt;here&gt;.<p>Short.</p><aside>Side</aside><div class="share">Share</div><script>x("</p>")</script></article>
    <section id="comments"><article class="comment"><p>Great text, I read all of it with joy and will come back for more of it.</p></article></section><form>Mail <input></form><footer>&copy; x</footer></body>"""
    assert html.main_text(page) == "A & B\nFirst paragraph goes on <here>.\nShort."
    assert html.main_text(None) == html.main_text("") == html.main_text("<p") == ""
    assert html.main_text("<article><p>cut o") == "cut o"
    long = "word " * 200_000
    assert len(html.main_text(f"<article><p>{long}</p></article>")) == len(long) - 1


def test_html_decides_by_words_and_links():
    para = lambda w: " ".join([w] * 70)
    text = "".join(f"<p>{para(w)}</p>" for w in "abc")
    want = "\n".join(para(w) for w in "abc")
    comments = "".join(f"<article class=comment><p>Comment {i}, I read it all.</p></article>" for i in range(3))
    assert html.main_text(f"<div>{text}</div><section id=comments>{comments}</section>") == want
    teaser = "<aside><article class=teaser><h3><a href=x>More of it</a></h3></article></aside>"
    assert html.main_text(f"<ul><li><a href=/>Home</a><li><a href=/b>News</a></ul><div>{text}</div>{teaser}") == want
    card = "<article><a href=x>One more</a></article><article><a href=y>And more</a></article>"
    assert html.main_text(f"<div>{text}</div><div>{card}</div>") == want
    tags = "<ul><li><a href=1>Tag one</a><li><a href=2>Tag two</a><li><a href=3>Tag three</a></ul>"
    assert html.main_text(f"<article>{text}{tags}</article>") == want
    assert html.main_text(f"<article>{text}<p>See <a href=1>this</a> too.</article>") == want + "\nSee this too."
    assert html.main_text(f"<article>{text}</article><footer><p>{para('d')}</p></footer>") == want
    assert html.main_text(f"<div>By Ann</div><article>{text}</article>") == want
    assert html.main_text(f"<form><div>{text}</div><p>Send</p></form>") == want


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_classifier_on_held_out_rows(spark):
    got = {r["doc_id"]: r for r in queries()["op2_quality_classifier"](spark, SF).collect()}
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    held = [(got[i]["predicted"], y) for i, y in labels.items() if zlib.crc32(str(i).encode()) % 3 == 1]
    assert all(0 <= r["score"] <= 1 and r["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) for i, r in got.items())
    assert sum(p == y for p, y in held) >= 0.9 * len(held)


def test_classifier_without_labels(spark, docs, empty):
    none = spark.createDataFrame([], "doc_id long, quality int")
    vectors, network = classifier.fit(docs, none, "doc_id", "text", "quality")
    scores = classifier.with_quality(docs, vectors, network).collect()
    assert len(scores) == docs.count() and {round(r["score"], 6) for r in scores} == {0.5}
    assert classifier.with_quality(empty, vectors, network).count() == 0


def test_language_model(spark, docs, empty):
    found, counts, _ = lm.language_model(docs.select("doc_id", "text"), F.col("doc_id") % 4 != 1)
    tokens = {}
    for i, t, *_ in corpus():
        tokens.setdefault(i, []).append(t.encode().lower().decode().split() + [None] if t is not None else [None])
    c = collections.Counter(w for i, texts in tokens.items() if i is None or i % 4 != 1 for t in texts for w in t)
    n, v = sum(c.values()), len(c)
    assert counts.tokens == n and counts.words == v
    base = collections.Counter((i, len(t), round(sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in t), 6)) for i, texts in tokens.items() for t in texts)
    rows = found.collect()
    assert collections.Counter((r["id"], r["n_tokens"], round(r["base_score"], 6)) for r in rows) == base
    assert all(math.isfinite(r["score"]) and r["score"] <= 0 for r in rows)
    assert lm.language_model(empty.select("doc_id", "text"), F.lit(True))[0].count() == 0


def test_forward_is_exact():
    import numpy as np

    rng = np.random.default_rng(0)
    k = 3
    model = lm.Model(*(x / x.sum(-1, keepdims=True) for x in (rng.random(k), rng.random((k, k)), rng.random((k, 5)))))
    seqs = [[0, 1, 4], [2], [3, 3, 1, 0]]
    want = []
    for s in seqs:
        a = model.start * model.emit[:, s[0]]
        for o in s[1:]:
            a = (a @ model.move) * model.emit[:, o]
        want.append(math.log10(a.sum()))
    old, lm.STATES = lm.STATES, k
    got = lm.forward(model, np.concatenate(seqs), np.array([len(s) for s in seqs]))
    lm.STATES = old
    assert np.allclose(got, want)


def test_decontamination(spark, docs, empty):
    items = spark.createDataFrame([(1, "Tom has 5 apples and buys 12 more apples for 30 cents each. How many apples does Tom have now?"), (2, "short one"), (3, None), (4, "")], "item_id long, text string")
    texts = {
        1: "x y z. Ann has 7 apples and buys 9 more apples for 45 cents each. How many apples does Ann have now? the end",
        2: "so Tom has 5 apples and buys 12 more apples for 30 cents each. How many apples does Tom have now?",
        3: "Ann has 7 apples and she eats them all, then she goes home to sleep for many hours",
        4: None, 5: "", 6: "well a Short one here", 7: "tom HAS 5 apples and buys 12 more apples for 30 cents each. how many apples does tom have now?",
    }
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {(r["id"], r["item_id"]): r["kind"] for r in decontaminate.leaks(df, items).collect()}
    assert got[(1, 1)] == "reparameterised" and got[(2, 1)] == "exact"
    assert (3, 1) not in got and not {4, 5} & {i for i, _ in got}
    assert {r["doc_id"] for r in decontaminate.drop_leaks(df, items).collect()} >= {3, 4, 5}
    assert decontaminate.leaks(empty, items).count() == decontaminate.leaks(docs, items.limit(0)).count() == 0


def test_decontamination_finds_every_verbatim_copy(spark):
    items = {1: "What is the capital of France?", 2: "short one", 3: "Paris 1900 London 1908 Stockholm 1912 Berlin 1916", 4: "Tom has 5 apples and buys 12 more apples for 30 cents each. How many apples does Tom have now?", 5: "Which river flows through the city of Rome?"}
    texts = {
        1: "Question 12\nWhat is the capital of France?", 2: "he asked What is the capital of France and left", 3: "what is the capital of france", 4: "WHAT IS THE CAPITAL OF FRANCE?",
        5: "Host cities: paris 1900 london 1908 stockholm 1912 berlin 1916.", 6: "well a Short one here", 7: "tom HAS 5 apples and buys 12 more apples for 30 cents each. how many apples does tom have now?",
        8: "Question 13\nWhich river flows through the city of Paris?", 9: "What is the size of France?", 10: "Paris 1904 London 1912 Stockholm 1916 Berlin 1920",
    }
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    benchmark = spark.createDataFrame(list(items.items()), "item_id long, text string")
    found = decontaminate.leaks(df, benchmark).collect()
    got = {(r["id"], r["item_id"]): r["kind"] for r in found}
    assert got == {**{(i, 1): "exact" for i in (1, 2, 3, 4)}, (5, 3): "exact", (6, 2): "exact", (7, 4): "exact", (8, 5): "reparameterised"} and len(found) == len(got)
    assert {r["doc_id"] for r in decontaminate.drop_leaks(df, benchmark).collect()} == {9, 10}


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_pipeline(spark):
    import corpus_pipeline

    out = corpus_pipeline.run(spark, SF)
    before = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = out.collect()
    assert {"doc_id", "text", "lang", "source", "n_chars"} <= set(out.columns) and 50 < len(rows) < 3 * len(before)
    assert all(r["doc_id"] in before and r["n_chars"] == len(r["text"]) for r in rows)


def test_decontamination_fills_slots_once_over_a_passage(spark):
    item = "Tom has 5 apples in a box and later on he gives 5 of the apples to a friend who lives next door to the old mill"
    items = spark.createDataFrame([(1, item)], "item_id long, text string")
    same, other = item.replace("5", "7"), item.replace("5", "7", 1).replace("gives 5", "gives 99")
    gap = lambda t: t.replace("later on", "later on and after a rest")
    noise = "Tom has 3 apples in a box and later on he sleeps"
    texts = {1: same, 2: other, 3: gap(same), 4: gap(other), 5: f"{noise}. {same}", 6: f"{same}. {noise}. {noise}", 7: item, 8: gap(item)}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").withColumn("own_id", F.lit(11)).withColumn("_leak_id", F.lit(12))
    got = {r["id"]: r["kind"] for r in decontaminate.leaks(df, items).collect()}
    assert got == {1: "reparameterised", 3: "reparameterised", 5: "reparameterised", 6: "reparameterised", 7: "exact", 8: "exact"}
    kept = decontaminate.drop_leaks(df, items).collect()
    assert {(r["doc_id"], r["own_id"], r["_leak_id"]) for r in kept} == {(2, 11, 12), (4, 11, 12)}


def test_decontamination_by_plain_windows_against_brute_force(spark):
    rng = random.Random(8)
    words = ["".join(rng.choice("abcdefg") for _ in range(rng.randint(2, 6))) for _ in range(60)]
    head = "choose the right answer to this question and explain why".split()
    items = {k: (head if k % 2 else []) + [rng.choice(words) for _ in range(rng.randint(3, 25))] for k in range(25)}
    texts = {}
    for i in range(150):
        text = [rng.choice(words) for _ in range(rng.randint(0, 60))]
        own = list(items[rng.randrange(25)])
        if i % 2:
            for _ in range(rng.randint(0, 3)):
                own[rng.randrange(len(own))] = rng.choice(words)
            text[3:3] = own
        texts[i] = text
    w = decontaminate.WINDOW
    want = set()
    for i, text in texts.items():
        for k, item in items.items():
            n = min(w, len(item))
            have = {tuple(text[p : p + n]) for p in range(len(text) - n + 1)}
            parts = [tuple(item[p : p + n]) for p in range(len(item) - n + 1)]
            if sum(p in have for p in parts) >= 0.8 * len(parts):
                want.add((i, k))
    as_text = lambda x: [(k, " ".join(v)) for k, v in x.items()]
    got = decontaminate.leaks(spark.createDataFrame(as_text(texts), "doc_id long, text string"), spark.createDataFrame(as_text(items), "item_id long, text string")).collect()
    assert {(r["id"], r["item_id"]) for r in got} == want and len(want) > 15 and len(got) == len(want)


def test_mixing_takes_what_the_tree_deals(spark, docs):
    """The draws of every source, walked down the tree one by one."""
    import numpy as np

    def shard_of(quotas, shards, s, draw):
        lo, hi, counts = 0, shards, list(quotas)
        while hi - lo > 1:
            total = sum(counts)
            rng = np.random.Generator(np.random.PCG64([mixing.SEED, lo, hi]))
            left = rng.multivariate_hypergeometric(counts, total * ((hi - lo) // 2) // (hi - lo), method="marginals").tolist() if total else counts
            mid = lo + (hi - lo) // 2
            if draw < left[s]:
                hi, counts = mid, left
            else:
                lo, draw, counts = mid, draw - left[s], [c - x for c, x in zip(counts, left)]
        return lo if draw < counts[s] else None

    old = mixing.BLOCK_WORDS, mixing.SHARD_WORDS
    mixing.BLOCK_WORDS, mixing.SHARD_WORDS = 60, 500
    try:
        plan = mixing.Plan(mixing.cut(mixing.narrow(docs)))
        drawn = plan.draws(mixing.narrow(docs)).collect()
        want = collections.Counter((r["id"], r["size"], tuple(shard_of(plan.quotas, plan.shards, r["s"], d) for d in r["draws"])) for r in drawn)
        got = collections.Counter((r["doc_id"], r["size"], tuple(r["shards"])) for r in mixing.taken(docs).collect())
        mixed = collections.Counter(r["mix_shard"] for r in mixing.mix(docs.withColumn("mix_order", F.lit("x"))).collect())
    finally:
        mixing.BLOCK_WORDS, mixing.SHARD_WORDS = old
    assert got == want and plan.shards > 4
    assert mixed == collections.Counter(x for _, _, shards in want.elements() for x in shards)
    assert (mixing.descend((3, 2), 4, np.array([0, 0, 1]), np.array([2, 3, 2])) >= 0).tolist() == [True, False, False]


def test_expected_counts_of_the_language_model():
    import itertools

    import numpy as np

    rng = np.random.default_rng(3)
    k, v = 3, 5
    model = lm.Model(*(x / x.sum(-1, keepdims=True) for x in (rng.random(k), rng.random((k, k)), rng.random((k, v)))))
    seqs = [[0, 1, 4, 2], [2], [3, 3, 1], [4, 0]]
    starts, moves, emits, likelihood = np.zeros(k), np.zeros((k, k)), np.zeros((k, v)), 0.0
    for s in (x for i, x in enumerate(seqs) if i != 1):
        paths = {}
        for path in itertools.product(range(k), repeat=len(s)):
            p = model.start[path[0]] * model.emit[path[0], s[0]]
            for a, b, o in zip(path, path[1:], s[1:]):
                p *= model.move[a, b] * model.emit[b, o]
            paths[path] = p
        total = sum(paths.values())
        likelihood += math.log(total)
        for path, p in paths.items():
            starts[path[0]] += p / total
            for a, b in zip(path, path[1:]):
                moves[a, b] += p / total
            for a, o in zip(path, s):
                emits[a, o] += p / total
    none = np.zeros(0)
    blobs = [lm.packed(none, none, np.array(t, np.uint8), np.array([len(s) for s in part]), none, none, none, np.concatenate(part).astype(np.uint16)) for part, t in ((seqs[:2], [1, 0]), (seqs[2:], [1, 1]))]
    got = lm.expected(model)(iter(blobs))
    assert np.allclose(got[0], starts, atol=1e-5) and np.allclose(got[1].reshape(k, k), moves, atol=1e-5) and np.allclose(got[2].reshape(k, v), emits, atol=1e-5)
    assert np.allclose(got[3], [likelihood, 9], atol=1e-4)


def test_html_is_linear_in_broken_markup():
    import time

    n = 100_000
    pages = ["<a " + '"' * n, "<a " + "\"'" * n + ">", "<a " * n, '<a "' * n + '>"', "<a b=\"'> " * n, "<script " * n, "<script>" * n, "<div>" * n + "</section>" * n, "<!-- " * n, "<" * n, "&#" + "1" * n + ";", "<title>" + "</title" * n]
    for page in pages:
        start = time.perf_counter()
        html.main_text(f"<article><p>text</p></article>{page}")
        assert time.perf_counter() - start < 20
    assert html.main_text("<article><p>a &#0000065; &#x41; &#99999999999999; b</p></article>") == "a A A � b"
    assert html.main_text('<article><p class="x>y">in</p><p title="open>out</p></article>') == "in\nout"


def test_html_keeps_links_of_the_article():
    a = "<p>The first paragraph says this.</p>"
    b = "<p>The second one says that.</p>"
    want = "The first paragraph says this.\n{}The second one says that."
    page = lambda inner, head="": html.main_text(f"<nav><a href=/>Home</a></nav><article>{head}{a}{inner}{b}</article><footer>c</footer>")
    assert page("") == want.format("")
    assert page("", '<h1><a href="/post">My Great Post Title</a></h1>') == "My Great Post Title\n" + want.format("")
    items = "".join(f"<li><a href={i}>Item {i}</a>" for i in range(4))
    assert page(f"<ul>{items}</ul>") == want.format("Item 0\nItem 1\nItem 2\nItem 3\n")
    assert page(f"<div class=ad>Buy</div><ul>{items}</ul>") == want.format("Item 0\nItem 1\nItem 2\nItem 3\n")
    assert page("<p><a href=x>A paragraph that is one link.</a></p>") == want.format("A paragraph that is one link.\n")
    assert page("<div class='social-history'><p>Of the town.</p></div>") == want.format("Of the town.\n")
    prose = " ".join(["word"] * 40)
    assert page(f"<section class=search><h2>The search</h2><p>{prose}</p></section>") == want.format(f"The search\n{prose}\n")
    # What is no part of it goes, by words and links or by its name.
    assert page("<div class=share-buttons><a href=1>One</a> <a href=2>Two</a><span>Share this</span></div>") == want.format("")
    assert page("<div class=search><label>Search</label></div>") == want.format("")
    assert page(f"<div class=toc><h2>Contents</h2><ul>{items}</ul></div>") == want.format("")
    for name in ("user-comments", "comment-body", "cookieBanner", "ad_slot_3", "site-footer x"):
        assert page(f"<div class='{name}'><p>{prose}</p></div>") == want.format(""), name
    assert html.main_text(f"<article>{a}{b}</article><nav><p>{prose}</p></nav>") == want.format("")


def plain_walk(found):
    """FIELDS of blocks on a page with an article, from their definition."""
    density = lambda b: b.linked / b.words
    out = []
    for i, b in enumerate(found):
        mine = [j for j, x in enumerate(found) if not x.boiler and x.control == b.control and (x.region or x.control)]
        if b.boiler or i not in mine:
            mine, row = list(range(len(found))), []
        else:
            row = [i] if density(b) > html.OF_LINKS else []
            for step in (-1, 1):
                at = mine.index(i) + step
                while row and 0 <= at < len(mine) and density(found[mine[at]]) > html.OF_LINKS:
                    row.append(mine[at])
                    at += step
        low, high = mine.index(min(row or [i])) - 1, mine.index(max(row or [i])) + 1
        figures = [(found[j].words, density(found[j])) if j is not None else (0, 0) for j in (i, mine[low] if low >= 0 else None, mine[high] if high < len(mine) else None)]
        scope = html.FLAT if b.boiler or not (b.region or b.control) else html.IN_CONTROLS if b.control else html.ARTICLE
        place = html.NAMED if b.boiler else html.INSIDE if b.region else html.OUTSIDE
        out.append((*figures[0], *figures[1], *figures[2], place, b.heading, scope, len(row)))
    return out


def test_html_fields_follow_their_definition():
    import random

    r = random.Random(5)
    for _ in range(200):
        n = r.randint(1, 14)
        found = []
        for _ in range(n):
            words = r.randint(1, 60)
            found.append(html.Block("x", words, r.choice([0, 0, words, words, words // 2]), r.random() < 0.7, r.random() < 0.2, r.random() < 0.2, r.choice([0, 0, 0, 1, 2])))
        found.append(html.Block("x", 30, 0, True, False, False, 0))
        assert html.fields(found) == plain_walk(found)


def test_html_tree_decides_on_pages_with_articles():
    page = "<nav><ul><li><a href=1>One</a><li><a href=2>Two</a></ul></nav><article><p>Text of it.</p></article>"
    found = html.blocks(page)
    rows = html.fields(found)
    assert [html.is_article(f) for f in rows] == [False, False, True]
    assert all(f[html.FIELDS.index("place")] != html.NAMED for f in rows)


def test_html_tree_separates_its_table():
    for row in html.TABLE:
        assert html.is_article(tuple(row[:-1])) == bool(row[-1])
    fields = set()

    def walk(t):
        if isinstance(t, tuple):
            fields.add(html.FIELDS[t[0]])
            walk(t[2])
            walk(t[3])

    walk(html.tree())
    assert {"words", "links"} <= fields and len(fields & {"words_before", "links_before", "words_after", "links_after"}) >= 2


def test_columns_of_users_stay_theirs(spark, docs):
    names = ["id", "none", "th", "fp", "root", "node", "kind", "item_id", "pos", "h", "count", "s", "draws", "shards", "block", "key", "size", "votes", "quality", "body", "rest", "n_removed", "kept", "row", "_th", "_id", "_leak_id", "_leak_th"]
    own = docs.select("doc_id", "text", "lang", "source", *(F.lit(k).alias(n) for k, n in enumerate(names)))
    benchmark = spark.createDataFrame([(1, "no such words in here at all")], "item_id long, text string")
    for found in (simhash.drop_near_duplicates(own), near.drop_near_copies(own), decontaminate.drop_leaks(own, benchmark), repeats.drop_repeats(own), rules.keep_quality(own), mixing.mix(own)):
        assert found.columns[: len(own.columns)] == own.columns
        assert all(tuple(r[n] for n in names) == tuple(range(len(names))) for r in found.collect())


def test_classifier_counts_against_brute_force(monkeypatch):
    import numpy as np

    rng = random.Random(1)
    texts = [[rng.choice([b"a", b"bb", b"C1", b"dd!", b"eee"]) for _ in range(rng.randint(0, 30))] for _ in range(50)]
    monkeypatch.setattr(classifier, "PART", 64)
    got = classifier.counted(texts)
    index = classifier.index_vectors(0, classifier.WORDS), classifier.index_vectors(1, classifier.SHAPES)
    want, rows = [np.zeros(x.shape) for x in index], classifier.Rows()
    for t in texts:
        at = rows.of(t)
        for i in range(len(t)):
            for j in range(max(0, i - classifier.WINDOW), min(len(t), i + classifier.WINDOW + 1)):
                for k in (0, 1):
                    want[k][at[k][i]] += index[0][at[0][j]] + index[1][at[1][j]]
    assert all(np.array_equal(a, b) for a, b in zip(got, want))
    assert [classifier.shape(w.encode()) for w in ("abc", "Abc", "ABC", "a1__--BBcé", "--__99", "x")] == ["x", "Xx", "X", "x9__--Xx", "--__99", "x"]


def test_rules_verdicts_against_a_fit_by_document(spark, docs):
    """Expectation-maximisation over documents, one by one, with conditions that another engine evaluates."""
    import duckdb

    rows = rules.quality(docs.withColumn("doc_id", F.monotonically_increasing_id())).collect()
    con = duckdb.connect()
    con.execute(f"CREATE TABLE f (i BIGINT, {', '.join(f'{c} BIGINT' for c in rules.FEATURES)})")
    con.executemany(f"INSERT INTO f VALUES ({', '.join('?' * (len(rules.FEATURES) + 1))})", [(i, *(r[c] for c in rules.FEATURES)) for i, r in enumerate(rows)])
    votes = con.execute(f"SELECT {', '.join(f'({c})' for _, _, c in rules.RULES)} FROM f ORDER BY i").fetchall()
    learnt = [v for v, r in zip(votes, rows) if not r["base_failed"]]
    start = [(0.9, 0.3) if good else (0.05, 0.3) for _, good, _ in rules.RULES]
    rate, share, k = list(start), 0.8, rules.PRIOR_DOCS

    def posterior(v):
        good = math.prod(t if x else 1 - t for x, (t, _) in zip(v, rate)) * share
        bad = math.prod(f if x else 1 - f for x, (_, f) in zip(v, rate)) * (1 - share)
        return good / (good + bad)

    for _ in range(200):
        q = [posterior(v) for v in learnt]
        for i, (_, good, _) in enumerate(rules.RULES):
            t = (sum(x for x, v in zip(q, learnt) if v[i]) + k * start[i][0]) / (sum(q) + k)
            f = (sum(1 - x for x, v in zip(q, learnt) if v[i]) + k * start[i][1]) / (len(q) - sum(q) + k)
            if (t < f) == good:
                t = f = (t + f) / 2
            rate[i] = tuple(min(max(x, 1e-6), 1 - 1e-6) for x in (t, f))
        share = (sum(q) + 0.8 * k) / (len(q) + k)
    assert len(learnt) > 10
    for v, r in zip(votes, rows):
        if not r["base_failed"]:
            assert abs(posterior(v) - r["quality"]) < 1e-6 and r["kept"] == (r["quality"] >= 0.5)
        else:
            assert not r["kept"]
