"""Whole documents and the edges that they must give, under all eight settings of the flags."""

import itertools
from functools import reduce

import pytest
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ontoloom import schema as S
from ontoloom.api import Projector, verify
from ontoloom.errors import IncompatibleSource, Nonconformance, UnsupportedAxiomShape
from ontoloom.functions import text as T
from ontoloom.operators.roles import fold
from ontoloom.options import Options
from ontoloom.plans import projection as plan

from .functional_syntax import read

FLAGS = list(itertools.product((False, True), repeat=3))
ONE, OTHER = "Caf\u00e9", "Cafe\u0301"
SHARED = "Declaration(ObjectProperty(:shared)) SubClassOf(:{a} ObjectSomeValuesFrom(:shared :{b}))"

# What each document gives; "t" edges of the taxonomy, "s" their reverse (bidirectional
# only), "r" others, which a taxonomy alone leaves out, "l" annotations (literals only).
CASES = {
    "roles that collide": (
        """Declaration(Class(:A)) Declaration(Class(:B)) SubObjectPropertyOf(:p :r) SubObjectPropertyOf(:q :r) SubObjectPropertyOf(:p :q)
        InverseObjectProperties(:r :s) InverseObjectProperties(:r :t) SubClassOf(:A ObjectSomeValuesFrom(:r :B)) SubClassOf(:A ObjectSomeValuesFrom(:q :B))""",
        [("r", "A", "q", "B"), ("r", "A", "p", "B"), ("r", "A", "r", "B"), ("r", "A", "p", "B"), ("r", "B", "t", "A")],
    ),
    "a sub-role and an inverse": (
        "SubObjectPropertyOf(:child :shared) InverseObjectProperties(:shared :inverse) " + SHARED.format(a="A", b="B"),
        [("r", "A", "shared", "B"), ("r", "A", "child", "B"), ("r", "B", "inverse", "A")],
    ),
    "another sub-role": (
        "SubObjectPropertyOf(:other :shared) InverseObjectProperties(:shared :otherInverse) " + SHARED.format(a="X", b="Y"),
        [("r", "X", "shared", "Y"), ("r", "X", "other", "Y"), ("r", "Y", "otherInverse", "X")],
    ),
    "what gives no edge": (
        """SubClassOf(:A ObjectExactCardinality(1 :p :B)) SubClassOf(:A ObjectHasValue(:p :i)) SubClassOf(:A ObjectHasSelf(:p)) SubClassOf(:A DataSomeValuesFrom(:score xsd:integer))
        SubClassOf(:A ObjectSomeValuesFrom(:p ObjectUnionOf(:B :C))) SubObjectPropertyOf(ObjectPropertyChain(:p :q) :p) SymmetricObjectProperty(:p)
        DataPropertyAssertion(:score :i "2"^^xsd:integer) Declaration(Class(:A))""",
        [],
    ),
    "two spellings of a name": (
        f"""Declaration(Class(:{ONE})) Declaration(Class(:{OTHER})) SubClassOf(:{ONE} :{OTHER})
        AnnotationAssertion(rdfs:label :{ONE} "\u96ea\nline\tend") AnnotationAssertion(rdfs:comment :{OTHER} "cafe\u0301")""",
        [("t", ONE, S.SUBCLASS_OF, OTHER), ("s", OTHER, S.SUPERCLASS_OF, ONE), ("l", ONE, "rdfs:label", "\u96ea\nline\tend"), ("l", OTHER, "rdfs:comment", "cafe\u0301")],
    ),
}


def short(e):
    return tuple(x.removeprefix("urn:t#") for x in e)


@pytest.mark.parametrize("name", CASES)
def test_edges_under_all_flags(spark, name):
    text, marked = CASES[name]
    view = read(spark, {"root": text})
    roles = fold(view)[0].table(spark)  # once for all settings
    settings = [Options(bidirectional_taxonomy=both, only_taxonomy=only, include_literals=literals) for both, only, literals in FLAGS]
    rows = reduce(DataFrame.unionAll, [plan.raw_edges(view, o, roles).select(F.lit(i).alias("i"), *plan.EDGE) for i, o in enumerate(settings)]).collect()
    for i, (both, only, literals) in enumerate(FLAGS):
        want = [e for m, *e in marked if m == "t" or m == "s" and both or m == "r" and not only or m == "l" and literals]
        assert sorted(short(r[1:]) for r in rows if r["i"] == i) == sorted(tuple(e) for e in want), (both, only, literals)


def test_canonical_and_encounter_order_of_a_document(spark):
    text, marked = CASES["roles that collide"]
    view = read(spark, {"root": text})
    want = [tuple(e) for _, *e in marked]
    assert [short(e) for e in Projector(Options(order="encounter")).project(view)] == want
    assert [short(e) for e in Projector().project(view)] == sorted(want)


def test_an_inverse_property_in_an_assertion_is_refused_under_all_flags(spark):
    view = read(spark, {"root": "Declaration(ObjectProperty(:p)) ObjectPropertyAssertion(ObjectInverseOf(:p) :i :j)"})
    for both, only, literals in FLAGS:
        with pytest.raises(UnsupportedAxiomShape) as e:
            Projector(Options(bidirectional_taxonomy=both, only_taxonomy=only, include_literals=literals)).project(view)
        assert "java.lang.ClassCastException" in str(vars(e.value))


def test_domains_and_ranges(spark):
    text = """SubObjectPropertyOf(:child :p) InverseObjectProperties(:p :inverse)
    ObjectPropertyDomain(:p :D1) ObjectPropertyDomain(Annotation(rdfs:comment "again") :p :D1) ObjectPropertyDomain(:p :D2)
    ObjectPropertyRange(:p :R1) ObjectPropertyRange(Annotation(rdfs:comment "again") :p :R1) ObjectPropertyRange(:p :R2)
    ObjectPropertyDomain(:child ObjectIntersectionOf(:D1 :D2)) ObjectPropertyRange(:child ObjectUnionOf(:R1 :R2)) Declaration(Class(:D1))"""
    view = read(spark, {"root": text})
    assert tuple(plan.edge_counts(plan.raw_edges(view)).first()) == (27, 12, 15)


RESTRICTIONS = """SubClassOf(:A :B) SubClassOf(:A ObjectSomeValuesFrom(:p :C)) SubClassOf(ObjectSomeValuesFrom(:q :D) :B) SubClassOf(:A ObjectAllValuesFrom(:p :D))
    SubClassOf(ObjectAllValuesFrom(:q :C) :B) SubClassOf(:A ObjectMinCardinality(2 :p :C)) SubClassOf(ObjectMinCardinality(1 :q :D) :B) SubClassOf(:A ObjectMaxCardinality(3 :p :D))
    SubClassOf(ObjectMaxCardinality(4 :q :C) :B) SubClassOf(:A ObjectMinCardinality(1 :q)) SubClassOf(:A ObjectMaxCardinality(2 :q)) SubClassOf(:A ObjectExactCardinality(1 :p :C))
    SubClassOf(:A ObjectSomeValuesFrom(:p ObjectIntersectionOf(:C :D))) SubClassOf(ObjectUnionOf(:A :B) :C) Declaration(Class(:A))"""


def test_taxonomy_and_restrictions(spark):
    view = read(spark, {"root": RESTRICTIONS})
    both_ways = [("A", "p", "C"), ("A", "p", "C"), ("A", "p", "D"), ("A", "p", "D"), ("A", "q", S.OWL_THING), ("A", "q", S.OWL_THING), ("B", "q", "C"), ("B", "q", "C"), ("B", "q", "D"), ("B", "q", "D")]
    assert sorted(short(e) for e in Projector().project(view)) == sorted([("A", S.SUBCLASS_OF, "B"), *both_ways])
    assert [short(e) for e in Projector(Options(only_taxonomy=True)).project(view)] == [("A", S.SUBCLASS_OF, "B")]
    name = lambda x: "urn:t#" + x
    verify(view, {"taxonomy": (Options(only_taxonomy=True), [(name("A"), S.SUBCLASS_OF, name("B"))])})
    with pytest.raises(Nonconformance, match="taxonomy"):
        verify(view, {"taxonomy": (Options(only_taxonomy=True), [])})


def test_imports(spark):
    leaf = 'Declaration(Class(:L)) SubClassOf(:L :M) AnnotationAssertion(rdfs:label :L "of the leaf")'
    one = read(spark, {"root": 'Import(<leaf>) Declaration(Class(:A)) SubClassOf(:A :L) AnnotationAssertion(rdfs:label :A "of the root")', "leaf": leaf})
    found = [short(e) for e in Projector(Options(include_literals=True)).project(one.closure("root"))]
    assert sorted(found) == [("A", S.SUBCLASS_OF, "L"), ("A", "rdfs:label", "of the root"), ("L", S.SUBCLASS_OF, "M")]
    diamond = read(spark, {"root": "Import(<l>) Import(<r>) Declaration(Class(:A)) SubClassOf(:A :B)", "l": "Import(<c>) SubClassOf(:B :D)", "r": "Import(<c>) SubClassOf(:C :D)", "c": "SubClassOf(:D :E)"})
    assert len(Projector().project(diamond.closure("root"))) == 4
    cycle = read(spark, {"root": "Import(<b>) Declaration(Class(:A)) SubClassOf(:A :B)", "b": "Import(<root>) SubClassOf(:B :A)"})
    assert len(Projector().project(cycle.closure("root"))) == 2
    with pytest.raises(IncompatibleSource):
        read(spark, {"root": "Import(<nowhere>) Declaration(Class(:A)) SubClassOf(:A :B)"}).closure("root")


def java(text):
    h = 0
    for i in range(0, len(b := text.encode("utf-16-be")), 2):
        h = 31 * h + (b[i] << 8 | b[i + 1])
    return h


def plain_hash(e):
    """From the definition, in unbounded numbers."""
    iri = lambda x: java(x[: 1 + max(x.rfind(c) for c in "#/:")]) + java(x[1 + max(x.rfind(c) for c in "#/:") :])
    fold = lambda seed, *xs: seed if not xs else fold(31 * seed + xs[0], *xs[1:])
    if e["tag"] == S.ENTITY:
        return fold(2293, iri(e["iri"]))
    if e["tag"] in (S.AND, S.OR):
        return fold({S.AND: 3083, S.OR: 3581}[e["tag"]], sum(plain_hash(x) for x in {x["canon"]: x for x in e["operands"]}.values()))
    if e["tag"] == S.EXACT:
        return java("ObjectExactCardinality")
    prop = fold(4153, iri(e["prop"]["iri"]))
    card = [e["card"]] if e["card"] is not None else []
    return fold({S.SOME: 3517, S.ALL: 2833, S.MIN: 3259, S.MAX: 3187}[e["tag"]], fold(4241, prop) if e["prop"]["inverse"] else prop, *card, fold(2293, iri(e["filler_iri"])))


def test_hashes_of_class_expressions(spark):
    more = """SubClassOf(:A ObjectUnionOf(:B ObjectSomeValuesFrom(ObjectInverseOf(:p) :C) ObjectMaxCardinality(7 :q :D)))
    SubClassOf(<http://x/\U0001f600y> ObjectIntersectionOf(:B <urn> :B ObjectExactCardinality(1 :p :C)))"""
    df = read(spark, {"root": RESTRICTIONS + more}).axioms("SubClassOf").select(F.explode(F.array("sub", "sup")).alias("e"))
    n = 0
    for e, h in df.select("e", T.int32(T.expression_hash(F.col("e")))).collect():
        if e["filler_tag"] in (None, S.ENTITY) and (e["operands"] or [e]):
            assert h == (plain_hash(e) + 2**31) % 2**32 - 2**31, e
            n += 1
        else:
            assert h is None
    assert n == 31
