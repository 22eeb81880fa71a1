"""Edge rules, role state, order and sinks on small hand-made ontologies."""

import hashlib
import json
import random
import time
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from ontoloom import schema as S
from ontoloom import storage
from ontoloom.api import BackendStatus, CancellationToken, Limits, Projector, iter_taxonomy_edges, project_taxonomy, select_backend
from ontoloom.errors import BackendUnavailable, Cancelled, IncompatibleSource, InvalidOptions, ResourceLimit, UnsupportedAxiomShape, UnsupportedProfile
from ontoloom.functions import canon as C
from ontoloom.functions import canon_columns as K
from ontoloom.functions import text as T
from ontoloom.operators import roles as R
from ontoloom.operators import rules as P
from ontoloom.options import Options
from ontoloom.plans import projection as plan
from ontoloom.sources import generators
from ontoloom.sources.bridge import star_view
from ontoloom.sources.views import Ontology
from ontoloom.streaming import distributed, role_stream, sinks
from ontoloom.streaming.lifecycle import replay, stream_edges


def prop(iri, inverse=False):
    return {"iri": iri, "inverse": inverse, "chain": False, "canon": C.prop(iri, inverse)}


def cls(iri):
    return {"tag": S.ENTITY, "iri": iri, "prop": None, "card": None, "filler_tag": None, "filler_iri": None, "canon": C.named_class(iri), "operands": None}


def some(p, filler, tag=S.SOME, card=None, inverse=False):
    return {"tag": tag, "iri": None, "prop": prop(p, inverse), "card": card, "filler_tag": S.ENTITY, "filler_iri": filler, "canon": C.restriction(tag, C.prop(p, inverse), filler, card), "operands": None}


def row(kind, **fields):
    values = {f.name: None for f in S.schema_of(kind)} | {"doc_id": "root", "anons": []} | fields
    return tuple(values[f.name] for f in S.schema_of(kind))


def view(spark, docs=(("root", [], True),), classes=(), **kinds):
    frames = {k: spark.createDataFrame(v, S.schema_of(k)) for k, v in kinds.items()}
    entities = spark.createDataFrame([("root", "class", c) for c in classes], S.ENTITIES)
    return Ontology(spark, frames, spark.createDataFrame(list(docs), S.DOCUMENTS), entities)


def subclass(a, b, **more):
    return row("SubClassOf", canon=C.axiom("SubClassOf", a["canon"], b["canon"]), sub=a, sup=b, **more)


def sub_role(a, b):
    return row("SubObjectPropertyOf", canon=C.axiom("SubObjectPropertyOf", C.prop(a), C.prop(b)), p1=prop(a), p2=prop(b), ann=[])


def inverse_roles(a, b):
    return row("InverseObjectProperties", canon=C.axiom("InverseObjectProperties", C.prop(a), C.prop(b)), p1=prop(a), p2=prop(b), ann=[])


def edges(df):
    return [tuple(r) for r in df.collect()]


def test_subclass_rules(spark):
    v = view(spark, SubClassOf=[subclass(cls("A"), cls("B")), subclass(cls("A"), some("p", "C")), subclass(some("q", "C"), cls("D")), subclass(cls("A"), some("p", "C", S.EXACT, 1)), subclass(cls("A"), some("r", "C", inverse=True))])
    found = edges(plan.projected(v, Options(bidirectional_taxonomy=True)))
    assert found == sorted([("A", S.SUBCLASS_OF, "B"), ("B", S.SUPERCLASS_OF, "A"), ("A", "p", "C"), ("D", "q", "C"), ("A", "r", "C")])
    assert edges(plan.projected(v, Options(only_taxonomy=True))) == [("A", S.SUBCLASS_OF, "B")]
    assert [tuple(r)[0:1] + tuple(r)[-1:] for r in plan.diagnostics(v).collect()] == [("MOWL_IGNORED_SHAPE", 1)]
    assert [tuple(e) for e in project_taxonomy(v)] == [("A", S.SUBCLASS_OF, "B")]


def role_rows(spark, axioms, first=0):
    """(is_inverse, first, second) as numbered rows, shuffled over partitions."""
    rows = [(first + i, *a) for i, a in enumerate(axioms)]
    return spark.createDataFrame(rows[::-1], "visit long, is_inverse boolean, first string, second string").repartition(3), len(rows)


def folded(axioms):
    """The fold as it is defined, one axiom after the other."""
    lists, inverses = {}, {}
    for is_inverse, a, b in axioms:
        if None in (a, b):
            continue
        if is_inverse:
            inverses |= {a: b, b: a}
        else:
            lists[b] = [a, *lists.get(a, [])]
    return lists, inverses


def held(spark, state):
    lists = {}
    for r in state.lists(spark).orderBy("relation", "pos").collect():
        own = lists.setdefault(r["relation"], [])
        assert r["pos"] == len(own)
        own.append(r["subrole"])
    return lists, {r["relation"]: r["inverse"] for r in state.inverses(spark).collect()}


def test_roles_fold_reads_children_of_the_sub_role(spark, tmp_path):
    axioms = [(False, "q", "r"), (False, "p", "q"), (True, "r", "s"), (True, "r", "t"), (False, "p", "r"), (False, None, "r"), (False, "r", "r")]
    s = R.RoleState()
    assert s.add(*role_rows(spark, axioms)) == 1
    assert held(spark, s) == folded(axioms) == ({"q": ["p"], "r": ["r", "p"]}, {"r": "t", "s": "r", "t": "r"})
    s.save(spark, str(tmp_path / "state"))
    again = R.RoleState.load(spark, str(tmp_path / "state"))
    more = [(False, "r", "u"), (True, "s", "v")]
    for state in (s, again):
        state.add(*role_rows(spark, more, len(axioms)))
        assert held(spark, state) == folded(axioms + more) and state.visited == 9


def test_role_fold_over_random_and_long_boxes(spark):
    rng = random.Random(4)
    boxes = [[(rng.random() < 0.2, f"r{rng.randrange(12)}", f"r{rng.randrange(12)}") for _ in range(n)] for n in (1, 60)]
    boxes.append([(False, f"r{i}", f"r{i + 1}") for i in range(300)])  # lists of up to 300 entries
    boxes.append([(False, "hub", "hub")] * 40)  # one role has every axiom
    for axioms in boxes:
        s = R.RoleState()
        s.add(*role_rows(spark, axioms))
        assert held(spark, s) == folded(axioms)
    assert R.RoleState().table(spark).count() == 0


def test_visits_follow_the_hash_table(spark):
    names = [f"urn:n#{i}" for i in range(60)]
    v = view(spark, SubObjectPropertyOf=[sub_role(a, b) for a, b in zip(names, names[1:])], InverseObjectProperties=[inverse_roles(names[3], names[5])])
    rows, n = R.visits(v, 7)
    hashed = R.role_axioms(v).select("first", "second", T.spread(F.col("hash")).alias("s"), "canon").collect()
    want = [(r["first"], r["second"]) for r in sorted(hashed, key=lambda r: (r["s"] & R.capacity(n) - 1, r["s"], bytes(r["canon"])))]
    got = sorted(rows.collect())
    assert n == 60 and [r["visit"] for r in got] == list(range(7, 67)) and [(r["first"], r["second"]) for r in got] == want


def test_role_expansion(spark):
    v = view(spark, SubClassOf=[subclass(cls("A"), some("p", "C"))], SubObjectPropertyOf=[sub_role("q", "p")], InverseObjectProperties=[inverse_roles("p", "i")])
    assert edges(plan.projected(v, Options(order="encounter"))) == [("A", "p", "C"), ("A", "q", "C"), ("C", "i", "A")]


def test_state_persists_over_calls(spark):
    a = view(spark, SubClassOf=[subclass(cls("A"), some("p", "C"))], SubObjectPropertyOf=[sub_role("q", "p")])
    b = view(spark, SubClassOf=[subclass(cls("A"), some("p", "C"))])
    assert [len(edges(x)) for x in replay([a, b])] == [2, 2]
    stateful, isolated = Projector(Options(compatibility_state="scala-instance")), Projector()
    assert [len(stateful.project(x)) for x in (a, b)] == [2, 2]
    assert [len(isolated.project(x)) for x in (a, b)] == [2, 1]


def test_equivalence_sorts_members_and_ignores_each_bad_operand(spark):
    def eq(a, b):
        return row("EquivalentClasses", canon=C.node(62, C.members((a["canon"], b["canon"])), C.members(())), exprs=[b, a])

    operands = [some("p", "E"), some("p", "E", S.EXACT, 2), cls("Z"), cls("Y")]
    both = {**cls("x"), "tag": S.AND, "iri": None, "canon": C.node(S.AND, C.members(o["canon"] for o in operands)), "operands": [{k: v for k, v in o.items() if k != "operands"} for o in operands]}
    v = view(spark, EquivalentClasses=[eq(cls("B"), cls("A")), eq(cls("K"), both), eq(cls("K"), some("p", "E"))])
    found = edges(plan.projected(v, Options(order="encounter")))
    assert sorted(found) == sorted([("A", S.SUBCLASS_OF, "B"), ("K", S.SUBCLASS_OF, "Y"), ("K", S.SUBCLASS_OF, "Z"), ("K", "p", "E")])
    assert [e for e in found if e[0] == "K"] == [("K", S.SUBCLASS_OF, "Y"), ("K", S.SUBCLASS_OF, "Z"), ("K", "p", "E")]
    assert plan.diagnostics(v).first()["count"] == 2


def annotation(subject, prop_, value, doc="root"):
    kind, raw = ("iri", C.iri(value)) if isinstance(value, str) else ("literal", C.literal(*value))
    v = {"kind": kind, "iri": value if kind == "iri" else None, "anon": None, "label": None, "lexical": None if kind == "iri" else value[0], "datatype": None if kind == "iri" else value[1], "lang": None}
    return row("AnnotationAssertion", doc_id=doc, canon=C.axiom("AnnotationAssertion", C.entity("annotation_property", prop_), C.iri(subject), raw), prop=prop_, subject=subject, value=v)


def test_annotations(spark):
    label, comment = S.RDFS + "label", S.RDFS + "comment"
    rows = [
        annotation("A", label, ("x\\y\n", S.XSD_STRING)), annotation("A", comment, ("42", S.XSD + "integer")), annotation("A", label, ("", S.PLAIN_LITERAL)),
        annotation("A", "http://purl.org/dc/terms/title", "urn:v"), annotation("A", "urn:other", ("n", S.XSD_STRING)), annotation("no-class", label, ("n", S.XSD_STRING)), annotation("A", label, ("imported", S.XSD_STRING), "leaf"),
    ]
    v = view(spark, docs=[("root", ["leaf"], True), ("leaf", [], False)], classes=["A"], AnnotationAssertion=rows)
    found = edges(plan.projected(v, Options(include_literals=True)))
    assert set(found) == {("A", "rdfs:label", "x\\y\n"), ("A", "rdfs:comment", '42"^^xsd:intege'), ("A", "rdfs:label", ""), ("A", "http://purl.org/dc/terms/title", "urn:v")}
    assert edges(plan.projected(v)) == []
    assert plan.warning_count(plan.diagnostics(v, Options(include_literals=True))).first()[0] == 1


def sized(df):
    """Rows and bytes of each partition that has any."""
    size = F.octet_length(F.concat_ws("", *plan.EDGE))
    return [tuple(r) for r in df.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*"), F.sum(size)).orderBy("p").drop("p").collect()]


def long_texts(spark):
    """Few long comments, most of them alike for their first thousand characters, beside many short edges."""
    rng = random.Random(3)
    texts = ["same start " * 100 + f"{i} " + rng.randbytes(500).hex() for i in range(150)] + [f"{i} " + rng.randbytes(900).hex() for i in range(50)]
    notes = [annotation(s, S.RDFS + "comment", (t, S.XSD_STRING)) for t in texts for s in ("A", "no-class")]
    notes += [annotation("B", S.RDFS + "label", ("b", S.XSD_STRING)), annotation("A", "urn:other", (texts[0], S.XSD_STRING)), annotation("A", S.RDFS + "label", ("", S.XSD_STRING))]
    names = [f"{'0' if i % 2 else 'C'}{i}" for i in range(2000)]
    named = [subclass(cls(n), cls("A")) for n in names]
    want = [("A", "rdfs:comment", t) for t in texts] + [("B", "rdfs:label", "b"), ("A", "rdfs:label", "")] + [(n, S.SUBCLASS_OF, "A") for n in names]
    return view(spark, classes=["A", "B"], AnnotationAssertion=notes, SubClassOf=named), want


@pytest.mark.parametrize("order", ["canonical", "encounter"])
def test_long_texts_share_no_range(spark, monkeypatch, order):
    v, want = long_texts(spark)
    roles = spark.createDataFrame([], R.EXPANSIONS)
    plain = edges(plan.projected(v, Options(include_literals=True, order=order), roles))  # too little for an order by bytes
    monkeypatch.setattr(storage, "DRAW_BYTES", 1 << 10, raising=False)
    monkeypatch.setattr(storage, "RANGE_BYTES", 1 << 14, raising=False)
    for duplicates in ("preserve", "unique"):
        found = plan.projected(v, Options(include_literals=True, order=order, duplicates=duplicates), roles)
        assert edges(found) == plain
        assert max(n for _, n in sized(found)) < 5 << 14  # of 400 KB, which one range had
    assert sorted(plain) == sorted(want)
    if order == "canonical":
        assert plain == sorted(want)


def test_order_by_bytes_of_ties_nulls_and_rows_longer_than_a_range(spark, monkeypatch):
    monkeypatch.setattr(storage, "DRAW_BYTES", 1 << 8)
    monkeypatch.setattr(storage, "RANGE_BYTES", 1 << 12)
    rows = [(None, None), (None, 1), ("", 2), ("a", None)] * 50 + [("b" * 30000, 1), ("b" * 30000 + "c", 0)] * 3 + [(f"c{i}", i % 3) for i in range(500)]
    df = spark.createDataFrame(rows, "text string, n int").repartition(3)
    found = storage.in_order(df, ("text", "n"))
    assert edges(found) == edges(df.orderBy("text", "n"))
    assert found.rdd.getNumPartitions() > 5
    assert edges(storage.in_order(df.limit(0), ("text", "n"))) == []


def test_texts_of_one_subject_are_joined_apart(spark, monkeypatch):
    monkeypatch.setattr(P, "SUBJECT_BYTES", 1 << 14, raising=False)
    v, want = long_texts(spark)
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, x in settings.items():
            spark.conf.set(k, x)
        found = P.annotation_edges(v, None)
        assert sorted(edges(found.select(*plan.EDGE))) == sorted(e for e in want if e[1] != S.SUBCLASS_OF)
        rows = [n for n, _ in sized(found.where("source = 'A'"))]
        assert sum(rows) == 201 and max(rows) < 120
    finally:
        for k, x in before.items():
            spark.conf.set(k, x)


def test_assertions_and_blank_ids(spark):
    def ind(x):
        if x.startswith("_:"):
            return {"iri": None, "anon": C.anonymous(bytes(32), x[2:]), "label": x}
        return {"iri": x, "anon": None, "label": None}

    def related(p, a, b):
        ends = [ind(a), ind(b)]
        raw = [e["anon"] or C.individual(e["iri"]) for e in ends]
        return row("ObjectPropertyAssertion", canon=C.axiom("ObjectPropertyAssertion", p["canon"], *raw), p1=p, i1=ends[0], i2=ends[1], anons=[e["anon"] for e in ends if e["anon"]])

    v = view(spark, ObjectPropertyAssertion=[related(prop("p"), "a", "_:zz"), related(prop("p"), "_:b", "c")])
    assert edges(plan.projected(v)) == sorted([("a", "p", "_:genid2147483649"), ("_:genid2147483648", "p", "c")])
    with pytest.raises(UnsupportedAxiomShape) as e:
        plan.projected(view(spark, ObjectPropertyAssertion=[related(prop("p", True), "a", "b")]))
    assert e.value.code == "UNSUPPORTED_AXIOM_SHAPE"


def test_domain_range_bag(spark):
    def sided(kind, c, note):
        return row(kind, canon=C.axiom(kind, C.prop("p"), C.named_class(c), annotations=[C.annotation("n", C.literal(note, S.XSD_STRING))] if note else ()), p1=prop("p"), sub=cls(c))

    kinds = {k: [sided(k, c, n) for c, n in ((x + "1", ""), (x + "1", "a"), (x + "2", ""))] for k, x in (("ObjectPropertyDomain", "D"), ("ObjectPropertyRange", "R"))}
    v = view(spark, SubObjectPropertyOf=[sub_role("child", "p")], InverseObjectProperties=[inverse_roles("p", "back")], **kinds)
    raw = plan.raw_edges(v)
    assert tuple(plan.edge_counts(raw).first()) == (27, 12, 15)
    assert len(edges(plan.projected(v, Options(duplicates="unique", order="encounter")))) == 12
    with pytest.raises(ResourceLimit):
        plan.projected(v, max_edges=26)


def test_options():
    with pytest.raises(InvalidOptions):
        Options(only_taxonomy=1)
    with pytest.raises(InvalidOptions):
        Options(order="random")
    with pytest.raises(UnsupportedProfile):
        Options(profile="x")


def java(s):
    h = 0
    raw = s.encode("utf-16-be", "surrogatepass")
    for i in range(0, len(raw), 2):
        h = (31 * h + raw[i] * 256 + raw[i + 1]) & 0xFFFFFFFF
    return h - (1 << 32) if h >> 31 else h


def test_hash_render_and_json(spark):
    words = ["", "a", "hello world", "日本語", "x😀y", "e" * 300, 'q"\\\n\t\r\b\f\x01\x1f\x7f é😀']
    df = spark.createDataFrame([(w,) for w in words], "w string")
    got = df.select("w", T.java_hash(F.col("w")).alias("h"), T.json_string(F.col("w")).alias("j"), T.literal_text(F.col("w"), F.lit("urn:t")).alias("r")).collect()
    for r in got:
        assert r["h"] == java(r["w"])
        assert r["j"] == json.dumps(r["w"], ensure_ascii=False)
        escaped = r["w"].replace("\\", "\\\\").replace('"', '\\"').replace("\n", "\\n").replace("\r", "\\r").replace("\t", "\\t")
        assert r["r"] == f'"{escaped}"^^<urn:t>'.replace("\\", "")[1:-1]


def test_edges_of_large_tables_need_less_python(spark):
    """Edges of assertions need no canonical bytes made in Python, those of restrictions none to be picked out."""
    v = star_view(spark, "/root/testdata/sf0.001")
    evaluated = lambda df: df._jdf.queryExecution().executedPlan().toString().count("EvalPython [")
    assert evaluated(P.object_assertion_edges(v, spark.createDataFrame([], "anon binary, blank string")).select(*plan.EDGE)) == 0
    assert evaluated(P.subclass_ignored(v, Options())) == 0
    assert evaluated(P.unexpanded_restrictions(v).select(*plan.EDGE)) <= 1


def test_hash_of_a_long_text_is_linear(spark):
    """A step that went through all before it took minutes here."""
    words = ["aé日😀" * 60000, None, "", "b" * 65537, "\0\0a"]
    df = spark.createDataFrame([(i, w) for i, w in enumerate(words)], "i int, w string")
    start = time.monotonic()
    for r in df.select("i", T.java_hash(F.col("w")).alias("h"), T.int32(T.string_hash(F.col("w"))).alias("s")).collect():
        assert r["h"] == r["s"] == (None if words[r["i"]] is None else java(words[r["i"]]))
    assert time.monotonic() - start < 60


def test_sinks(spark, tmp_path):
    v = view(spark, SubClassOf=[subclass(cls(a), cls("T")) for a in ("é", "a", "b")])
    p, out = Projector(), []
    assert p.project_to_sink(v, out.append, batch_edges=2) == 3 and [len(b) for b in out] == [2, 1]
    lines = [json.dumps({"source": s, "relation": r, "destination": d}, ensure_ascii=False, separators=(",", ":")) + "\n" for s, r, d in map(tuple, p.project(v))]
    assert p.canonical_digest(v) == hashlib.sha256("".join(lines).encode()).hexdigest()
    a = p.write_artifact(v, tmp_path / "x.jsonl")
    head, *rest = (tmp_path / "x.jsonl").read_bytes().splitlines(keepends=True)
    assert b"".join(rest).decode() == "".join(lines) and json.loads(head)["artifact_sha256"] == a.artifact_sha256
    bare = {k: x for k, x in json.loads(head).items() if k != "artifact_sha256"}
    assert hashlib.sha256(sinks.record(bare) + b"".join(rest)).hexdigest() == a.artifact_sha256
    assert [x.name for x in tmp_path.iterdir()] == ["x.jsonl"]
    _, report = p.project_with_report(v)
    assert (report.edges, report.duplicates, report.ignored_shapes) == (3, 0, 0)


def test_closure_counts_equal_axioms_once(spark):
    rows = [subclass(cls("A"), cls("B"), doc_id=d) for d in ("root", "leaf", "far")]
    v = view(spark, docs=[("root", ["leaf"], True), ("leaf", ["root"], False), ("far", [], False)], SubClassOf=rows)
    assert len(edges(plan.projected(v.closure("root")))) == 1


def test_flags_of_a_role_box_with_collisions(spark):
    ns = "urn:oracle:rbox#"
    p, q, r, s, t, a, b = (ns + x for x in "pqrstAB")
    v = view(
        spark, SubObjectPropertyOf=[sub_role(p, r), sub_role(q, r), sub_role(p, q)], InverseObjectProperties=[inverse_roles(r, s), inverse_roles(r, t)],
        SubClassOf=[subclass(cls(a), some(r, b)), subclass(cls(a), some(q, b))],
    )
    want = sorted([(a, p, b), (a, p, b), (a, q, b), (a, r, b), (b, t, a)])
    for both, literals in ((False, True), (True, False)):
        assert edges(plan.projected(v, Options(bidirectional_taxonomy=both, include_literals=literals))) == want
        assert edges(plan.projected(v, Options(bidirectional_taxonomy=both, include_literals=literals, only_taxonomy=True))) == []
    assert tuple(plan.edge_counts(plan.raw_edges(v)).first()) == (5, 4, 1)


def lifecycle(spark):
    ns = "urn:oracle:lifecycle#"
    a = view(spark, SubClassOf=[subclass(cls(ns + "A"), some(ns + "shared", ns + "B"))], SubObjectPropertyOf=[sub_role(ns + "child", ns + "shared")], InverseObjectProperties=[inverse_roles(ns + "shared", ns + "inverse")])
    b = view(spark, SubClassOf=[subclass(cls(ns + "X"), some(ns + "shared", ns + "Y"))])
    return a, b, [(ns + x, ns + y, ns + z) for x, y, z in (("X", "child", "Y"), ("X", "shared", "Y"), ("Y", "inverse", "X"))]


def test_stateful_calls_do_not_overlap(spark):
    a, b, after = lifecycle(spark)
    p = Projector(Options(compatibility_state="scala-instance"))
    first = p.iter_edges(a)
    assert next(first)
    with pytest.raises(InvalidOptions, match="non-concurrent"):
        p.project(b)
    first.close()
    assert [tuple(e) for e in p.project(b)] == after
    token = CancellationToken()
    found = Projector().iter_edges(a, token=token)
    assert next(found)
    token.cancel()
    with pytest.raises(Cancelled):
        list(found)
    assert len(list(iter_taxonomy_edges(view(spark, SubClassOf=[subclass(cls("A"), cls("B"))]), True))) == 2


def test_stream_goes_on_where_it_was(spark, tmp_path):
    a, b, after = lifecycle(spark)
    views = {"a": a, "b": b}

    def run():
        rows = spark.readStream.schema("doc string").option("maxFilesPerTrigger", 1).text(str(tmp_path / "in"))
        stream_edges(rows, str(tmp_path / "out"), str(tmp_path / "checkpoint"), lambda df: views[df.first()[0]]).trigger(availableNow=True).start().awaitTermination()

    def found(number):
        return edges(spark.read.parquet(str(tmp_path / "out" / f"batch={number}")).orderBy("source", "relation", "destination"))

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "0.txt").write_text("a\n")
    run()
    (tmp_path / "in" / "1.txt").write_text("b\n")
    run()  # another query, with the state of the first
    assert len(found(0)) == 3 and found(1) == after
    for name in ("1", ".1.crc"):  # the second batch is run again
        (tmp_path / "checkpoint" / "commits" / name).unlink(missing_ok=True)
    run()
    assert len(found(0)) == 3 and found(1) == after


def test_large_role_tables_are_joined_by_shuffle(spark, monkeypatch):
    s = R.RoleState()
    s.add(*role_rows(spark, [(False, f"r{i}", f"r{i + 1}") for i in range(40)] + [(True, "r3", "back")]))
    small = sorted(map(tuple, s.table(spark).collect()))
    monkeypatch.setattr(R, "BROADCAST_BYTES", 10)
    s._expansions = None
    assert sorted(map(tuple, s.table(spark).collect())) == small
    assert [x[1:] for x in small if x[0] == "r3"] == [(0, "r3", False), (1, "r2", False), (2, "r1", False), (3, "r0", False), (R.LAST_EMIT, "back", True)]
    base = spark.createDataFrame([(1, "x", "r3", "y"), (2, "x", "none", "y")], "k int, source string, relation string, destination string")
    assert sorted(edges(R.expand(base, s.table(spark)).select("k", "source", "relation", "destination"))) == [(1, "x", r, "y") for r in ("r0", "r1", "r2", "r3")] + [(1, "y", "back", "x"), (2, "x", "none", "y")]


def test_a_stream_without_its_state_fails(spark, tmp_path):
    a, b, _ = lifecycle(spark)
    (tmp_path / "in").mkdir()
    rows = spark.readStream.schema("doc string").option("maxFilesPerTrigger", 1).text(str(tmp_path / "in"))

    def run(name):
        (tmp_path / "in" / name).write_text(f"{name}\n")
        stream_edges(rows, str(tmp_path / "out"), str(tmp_path / "checkpoint"), lambda df: {"a": a, "b": b}[df.first()[0]]).trigger(availableNow=True).start().awaitTermination()

    run("a")
    (tmp_path / "out" / "_role_state").rename(tmp_path / "elsewhere")
    with pytest.raises(Exception, match="role state of batch 0 is gone"):
        run("b")


def test_capacity_is_that_of_a_table_that_doubles():
    for n in [*range(400), 767, 768, 769, 100_000]:
        slots = R.capacity(n)
        assert slots >= 16 and slots & slots - 1 == 0 and 4 * n <= 3 * slots and (slots == 16 or 4 * n > 3 * slots // 2)


def test_canonical_bytes_as_columns(spark):
    values = ["", "a", "é" * 70, "x" * 127, "x" * 128, "y" * 17_000, "z" * 3_000_000]
    df = spark.createDataFrame(list(enumerate(values)), "i int, v string")
    v, i = F.col("v"), F.col("i")
    notes = F.array(K.annotation("p", K.literal(v, F.lit("d"), F.lit("en"))), *[K.annotation("p", K.literal(F.lit("q"), F.lit("d")))] * 2)
    whole = K.axiom("ClassAssertion", K.named_class(v), K.anonymous(b"s", v), annotations=notes)
    part = K.restriction(F.lit(38), K.prop(v), F.when(i % 2 == 0, v), F.when(i % 3 == 0, i * 1000))
    for r in df.select("i", "v", whole.alias("whole"), part.alias("part")).collect():
        n, t = r["i"], r["v"]
        assert bytes(r["whole"]) == C.axiom("ClassAssertion", C.named_class(t), C.anonymous(b"s", t), annotations=[C.annotation("p", C.literal(t, "d", "en")), C.annotation("p", C.literal("q", "d"))])
        assert bytes(r["part"]) == C.restriction(38, C.prop(t), t if n % 2 == 0 else None, n * 1000 if n % 3 == 0 else None)


def test_blank_numbers_over_partitions(spark):
    raw = [C.anonymous(bytes(32), f"genid{k}") for k in range(3000)]
    found = spark.createDataFrame([(x,) for x in raw[::-1]], "anon binary").repartition(7)
    got = {bytes(r["anon"]): r["blank"] for r in P.blank_ids(found).collect()}
    assert got == {x: f"_:genid{(1 << 31) + k}" for k, x in enumerate(sorted(raw))}


def test_artifact_says_nothing_of_the_backend(spark, tmp_path):
    v = view(spark, SubClassOf=[subclass(cls("A"), cls("B")), subclass(cls("A"), some("p", "C", S.EXACT, 1))])
    found = [Projector(Options(backend=b)).write_artifact(v, tmp_path / b) for b in ("python", "auto")]
    assert found[0] == found[1] and (tmp_path / "python").read_bytes() == (tmp_path / "auto").read_bytes()
    head = found[0].metadata
    assert "backend" not in head["options"] and head["counts"] == {"edges": 1, "duplicates": 0, "skipped_axioms": 0, "ignored_shapes": 1, "warnings": 0}
    with pytest.raises(BackendUnavailable):
        select_backend("native", lambda: BackendStatus(False, "none"))
    assert select_backend("auto") == "spark"


class Flaky(distributed.FolderSink):
    """The first attempt of a part fails after it has written."""

    def open(self, part, name):
        own = super().open(part, name)
        flag = Path(self.path, f"failed-{part}")
        if not flag.exists():
            write = own.write_batch

            def fail(batch):
                write(batch)
                own.end()
                flag.touch()
                raise OSError("lost")

            own.write_batch = fail
        return own


def test_tasks_write_parts_that_count_once(spark, tmp_path, monkeypatch):
    made = spark.range(50_000).select(F.concat(F.lit('urn:"é'), "id").alias("source"), F.lit("r").alias("relation"), (F.col("id") % 7).cast("string").alias("destination")).repartition(3)
    kept = distributed.write_parts(made, str(tmp_path / "out"), {"profile": "p"})
    assert kept["edge_count"] == 50_000 and kept["profile"] == "p" and len(kept["parts"]) == 3
    back = distributed.read_parts(spark, str(tmp_path / "out"))
    assert plan.bag_diff(back, made).isEmpty()
    part = tmp_path / "out" / kept["parts"][0]["name"]
    raw = part.read_bytes()
    part.write_bytes(raw.replace(b"1", b"2", 1))
    with pytest.raises(Exception, match="are not those that were written"):
        back.count()
    (tmp_path / "out" / distributed.MANIFEST).write_text("{}")
    with pytest.raises(IncompatibleSource):
        distributed.manifest(str(tmp_path / "out"))
    nothing = distributed.write_parts(made.limit(0), str(tmp_path / "none"))
    assert nothing["edge_count"] == 0 and distributed.read_parts(spark, str(tmp_path / "none")).count() == 0
    with pytest.raises(Exception, match="lost"):  # no retries in a local session: the job fails and nothing is committed
        distributed.to_tasks(made, Flaky(str(tmp_path / "again")), 100)
    assert not (tmp_path / "again" / distributed.MANIFEST).exists()
    while len(list((tmp_path / "again").glob("failed-*"))) < 3:
        with pytest.raises(Exception, match="lost"):
            distributed.to_tasks(made, Flaky(str(tmp_path / "again")), 100)
    assert distributed.to_tasks(made, Flaky(str(tmp_path / "again")), 100) == 50_000  # beside what failed attempts left
    assert plan.bag_diff(distributed.read_parts(spark, str(tmp_path / "again")), made).isEmpty()


def test_projector_writes_parts(spark, tmp_path):
    v = view(spark, SubClassOf=[subclass(cls("A"), cls("B")), subclass(cls("C"), cls("B"))])
    head = Projector().write_parts(v, str(tmp_path / "x"))
    assert head["counts"]["edges"] == head["edge_count"] == 2 and head["options"]["order"] == "canonical"
    assert edges(distributed.read_parts(spark, str(tmp_path / "x")).orderBy("source")) == [("A", S.SUBCLASS_OF, "B"), ("C", S.SUBCLASS_OF, "B")]


def counting(spark, v, asked):
    """The same view, whose kinds say when they are asked for."""
    def ask(kind):
        def give():
            asked.append(kind)
            return v.axioms(kind)

        return give

    return Ontology(spark, {k: ask(k) for k in v.kinds()}, v.documents, v.entities, anonymous=("ObjectPropertyAssertion",))


def test_first_edge_comes_before_later_kinds_are_read(spark):
    ind = lambda x: {"iri": x, "anon": None, "label": None}
    related = lambda p: row("ObjectPropertyAssertion", canon=C.axiom("ObjectPropertyAssertion", p["canon"], C.individual("a"), C.individual("b")), p1=p, i1=ind("a"), i2=ind("b"))
    typed = row("ClassAssertion", canon=C.axiom("ClassAssertion", C.named_class("A"), C.individual("a")), sub=cls("A"), i1=ind("a"))
    v = view(spark, SubClassOf=[subclass(cls("A"), cls("B"))], ClassAssertion=[typed], ObjectPropertyAssertion=[related(prop("p"))])
    asked = []
    found = Projector(Options(order="encounter")).iter_edges(counting(spark, v, asked))
    assert tuple(next(found)) == ("A", S.SUBCLASS_OF, "B") and asked == ["SubClassOf"]
    assert [tuple(e) for e in found] == [("a", S.RDF_TYPE, "A"), ("a", "p", "b")] and set(asked) == {"SubClassOf", "ClassAssertion", "ObjectPropertyAssertion"}
    assert [tuple(e) for e in Projector(Options(order="encounter")).iter_edges(v)] == edges(plan.projected(v, Options(order="encounter")))
    refused = view(spark, SubClassOf=[subclass(cls("A"), cls("B"))], ObjectPropertyAssertion=[related(prop("p", True))])
    found = Projector(Options(order="encounter")).iter_edges(refused)
    assert next(found)
    with pytest.raises(UnsupportedAxiomShape):
        list(found)


def test_limits_hold_in_one_pass(spark):
    v = view(spark, SubClassOf=[subclass(cls(f"A{i}"), cls("T")) for i in range(40)])
    for options in (Options(), Options(order="encounter")):
        assert len(Projector(options).project(v, limits=Limits(max_edges=40))) == 40
        for most in (39, 3):
            with pytest.raises(ResourceLimit) as e:
                Projector(options).project(v, limits=Limits(max_edges=most))
            assert e.value.details["max_total_edges"] == most and e.value.details["seen"] > most
    runs = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def slow(x):
        import time

        runs.add(1)
        time.sleep(0.5)
        return x

    late = Ontology(spark, {"SubClassOf": v.axioms("SubClassOf").withColumn("sub", F.col("sub").withField("iri", slow("sub.iri")))}, v.documents, v.entities)
    with pytest.raises(ResourceLimit, match="over 1 seconds"):  # before the first edge is there
        next(Projector().iter_edges(late, limits=Limits(max_seconds=1)))
    fast = Ontology(spark, {"SubClassOf": v.axioms("SubClassOf").withColumn("doc_id", F.lit("root"))}, v.documents, v.entities)
    assert len(Projector().project(fast, limits=Limits(max_seconds=600))) == 40


def split_mix(seed):
    mask, state = (1 << 64) - 1, seed
    while True:
        state = (state + 0x9E3779B97F4A7C15) & mask
        z = state
        z = (z ^ z >> 30) * 0xBF58476D1CE4E5B9 & mask
        z = (z ^ z >> 27) * 0x94D049BB133111EB & mask
        yield z ^ z >> 31


def test_counter_based_numbers_are_those_of_the_sequence(spark):
    seeds = [0, 1, 17, (1 << 63) - 1, -1, -(1 << 63)]
    df = spark.createDataFrame([(s,) for s in seeds], "seed long").crossJoin(spark.range(1, 30).withColumnRenamed("id", "n"))
    z = generators.split_mix(F.col("seed"), F.col("n"))
    got = {(r[0], r[1]): (int(r[2], 16), r[3]) for r in df.select("seed", "n", generators.hex64(z), generators.index(z, 1000)).collect()}
    for s in seeds:
        for n, x in zip(range(1, 30), split_mix(s & (1 << 64) - 1)):
            assert got[s, n] == (x, x % 1000)


def plainly(rows, options):
    """The edges of a random case, by rules written down once more in plain Python; the role box in the order of visits."""
    boxed, out = [], []
    for kind, a, b, r in rows:
        if kind in ("role", "inverse"):
            boxed.append((kind == "inverse", f"p{r}", f"p{a % 4}"))
    lists, inverses = folded(boxed)
    up = lambda x, y: [(x, S.SUBCLASS_OF, y)] + [(y, S.SUPERCLASS_OF, x)] * options.bidirectional_taxonomy
    for kind, a, b, r in rows:
        if kind == "named":
            out += up(f"C{a}", f"C{b}")
        elif kind in ("some", "all") and not options.only_taxonomy:
            s, d, p = f"C{a}", f"C{b}", f"p{r}"
            out += [(s, p, d), *((s, x, d) for x in lists.get(p, [])), *([(d, inverses[p], s)] if p in inverses else [])]
        elif kind == "typed":
            out.append((f"i{r}", S.RDF_TYPE, f"C{a}"))
        elif kind == "related":
            out.append((f"i{a % 4}", f"p{r}", f"i{b % 4}"))
    return sorted(set(out) if options.duplicates == "unique" else out)


def test_random_cases_under_random_flags(spark):
    """Cases as the generator makes them, under flags from the bits of their number."""
    ind = lambda x: {"iri": x, "anon": None, "label": None}
    found = {}
    for r in generators.random_cases(spark, 3, 50, seed=40).collect():
        found.setdefault(r["case"], []).append((r["kind"], r["a"], r["b"], r["r"]))
    assert len(found) == 3 and len({k for rows in found.values() for k, *_ in rows}) == len(generators.KINDS)
    for case, rows in found.items():
        kinds = {}
        for kind, a, b, r in dict.fromkeys(rows):
            A, B, p = cls(f"C{a}"), cls(f"C{b}"), prop(f"p{r}")
            i, j = ind(f"i{a % 4}"), ind(f"i{b % 4}")
            name, made = {
                "named": ("SubClassOf", lambda: subclass(A, B)), "some": ("SubClassOf", lambda: subclass(A, some(f"p{r}", f"C{b}"))), "all": ("SubClassOf", lambda: subclass(some(f"p{r}", f"C{b}", S.ALL), A)),
                "role": ("SubObjectPropertyOf", lambda: sub_role(f"p{r}", f"p{a % 4}")), "inverse": ("InverseObjectProperties", lambda: inverse_roles(f"p{r}", f"p{a % 4}")),
                "typed": ("ClassAssertion", lambda: row("ClassAssertion", canon=C.axiom("ClassAssertion", A["canon"], C.individual(f"i{r}")), sub=A, i1=ind(f"i{r}"))),
                "related": ("ObjectPropertyAssertion", lambda: row("ObjectPropertyAssertion", canon=C.axiom("ObjectPropertyAssertion", p["canon"], C.individual(i["iri"]), C.individual(j["iri"])), p1=p, i1=i, i2=j)),
            }[kind]
            kinds.setdefault(name, {})[made()[1]] = made()  # equal axioms count once
        v = view(spark, **{k: list(x.values()) for k, x in kinds.items()})
        options = Options(bidirectional_taxonomy=bool(case & 1), only_taxonomy=bool(case & 2), duplicates="unique" if case & 1 else "preserve")
        order = R.visits(v)[0].orderBy("visit").collect() if {"SubObjectPropertyOf", "InverseObjectProperties"} & set(kinds) else []
        boxed = [("inverse" if x["is_inverse"] else "role", int(x["second"][1:]), 0, int(x["first"][1:])) for x in order]
        rest = list({(k, a, b, 0) if k == "named" else (k, a, b, r) if k in ("some", "all") else (k, a, 0, r) if k == "typed" else (k, a % 4, b % 4, r): None for k, a, b, r in rows if k not in ("role", "inverse")})
        assert edges(plan.projected(v, options)) == plainly(boxed + rest, options), case


def test_role_stream_keeps_its_state_in_the_store(spark, tmp_path):
    rng = random.Random(9)
    axioms = [(rng.random() < 0.2, f"r{rng.randrange(8)}", f"r{rng.randrange(8)}") for _ in range(45)] + [(False, None, "r1")]
    where = {k: str(tmp_path / k) for k in ("in", "out", "checkpoint")}
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", role_stream.PROVIDER)

    def run(first, last, at=None):
        rows = [(i, *axioms[i]) for i in range(first, last)] if at is None else at
        spark.createDataFrame(rows[::-1], "visit long, is_inverse boolean, first string, second string").coalesce(1).write.mode("append").parquet(where["in"])
        again()

    def again():
        stream = spark.readStream.schema("visit long, is_inverse boolean, first string, second string").parquet(where["in"])
        changes = role_stream.role_changes(stream)
        changes.writeStream.format("parquet").option("path", where["out"]).option("checkpointLocation", where["checkpoint"]).trigger(availableNow=True).start().awaitTermination()

    def found():
        return held(spark, role_stream.state_of(spark.read.parquet(where["out"])))

    try:
        run(0, 20)
        assert found() == folded(axioms[:20])
        run(20, 46)  # a restarted query
        assert found() == folded(axioms)
        last = max(int(p.name) for p in (tmp_path / "checkpoint" / "commits").glob("[0-9]*"))
        for name in (str(last), f".{last}.crc"):  # its last batch is run again
            (tmp_path / "checkpoint" / "commits" / name).unlink(missing_ok=True)
        again()
        assert found() == folded(axioms)
        with pytest.raises(Exception, match="comes after visit"):
            run(0, 0, [(3, False, axioms[44][1], axioms[44][2])])
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
