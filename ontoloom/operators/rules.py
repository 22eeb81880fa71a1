"""Edge rules. Each takes a view to edges with their encounter key, and to the axioms that it ignores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schema as S
from ..errors import IncompatibleSource, UnsupportedAxiomShape
from ..functions.text import blank_label, literal_text
from ..options import Options
from ..sources.generators import FIELDS, chosen
from ..sources.views import Ontology, class_signature
from ..storage import durable, numbered
from .roles import expand

KEY = ("cat", "k0", "k1", "k2", "op", "emit")
COLUMNS = (*KEY, "source", "relation", "destination")
SUBCLASS, EQUIVALENT, ANNOTATION, CLASS_ASSERTION, OBJECT_ASSERTION, DOMAIN_RANGE = range(1, 7)


def edges(df: DataFrame, cat: int) -> DataFrame:
    """Fills in what of KEY the rule does not set."""
    blank = {"k0": F.lit(None).cast("string"), "k1": F.lit(None).cast("binary"), "k2": F.lit(None).cast("binary"), "op": F.lit(0), "emit": F.lit(0)}
    return df.withColumns({"cat": F.lit(cat), **{k: v for k, v in blank.items() if k not in df.columns}}).select(*COLUMNS)


def is_class(e: Column) -> Column:
    return e["tag"] == S.ENTITY


def is_restriction(e: Column) -> Column:
    return e["tag"].isin(S.SOME, S.ALL, S.MIN, S.MAX) & (e["filler_tag"] == S.ENTITY) & e["filler_iri"].isNotNull() & ~F.coalesce(e["prop"]["chain"], F.lit(False)) & e["prop"]["iri"].isNotNull()


def taxonomy_pair(sub: Column, sup: Column, both: bool) -> Column:
    """An array of edges: up and, if asked for, down again."""
    edge = lambda i, s, r, d: F.struct(F.lit(i).alias("emit"), s.alias("source"), F.lit(r).alias("relation"), d.alias("destination"))
    up = edge(0, sub, S.SUBCLASS_OF, sup)
    return F.array(up, edge(1, sup, S.SUPERCLASS_OF, sub)) if both else F.array(up)


def named_subclasses(view: Ontology, both: bool = False) -> DataFrame:
    df = view.axioms("SubClassOf").where(is_class(F.col("sub")) & is_class(F.col("sup")))
    return edges(df.select(F.col("canon").alias("k1"), F.explode(taxonomy_pair(F.col("sub.iri"), F.col("sup.iri"), both)).alias("e")).select("k1", "e.*"), SUBCLASS)


def other_side(named: Column) -> Column:
    """Of a subclass axiom, the side that is not the named one; a condition on it makes no canonical bytes."""
    return chosen(named, F.col("sup"), F.col("sub"), (*FIELDS, "operands"))


def restriction_sides(view: Ontology) -> DataFrame:
    """Subclass axioms with exactly one named side: ``k1, side, source, expr``."""
    df = view.axioms("SubClassOf")
    sub, sup = is_class(F.col("sub")), is_class(F.col("sup"))
    one = df.where(sub != sup)
    return one.select(F.col("canon").alias("k1"), F.when(sub, "super").otherwise("sub").alias("side"), F.when(sub, F.col("sub.iri")).otherwise(F.col("sup.iri")).alias("source"), other_side(sub).alias("expr"))


def unexpanded_restrictions(view: Ontology, side: str | None = None) -> DataFrame:
    df = restriction_sides(view)
    if side:
        df = df.where(F.col("side") == side)
    # An array of one edge: for a join, Spark may repeat a plan in a subquery, as a Bloom filter of its keys, and there it
    # leaves Python functions, as canonical bytes are, where they cannot run. It does not do so above an explode.
    edge = F.struct(F.col("expr.prop.iri").alias("relation"), F.col("expr.filler_iri").alias("destination"))
    return df.where(is_restriction(F.col("expr"))).select("k1", "source", F.explode(F.array(edge)).alias("e")).select("k1", "source", "e.*")


def subclass_edges(view: Ontology, options: Options, roles: DataFrame) -> DataFrame:
    named = named_subclasses(view, options.bidirectional_taxonomy)
    if options.only_taxonomy:
        return named
    return named.unionByName(edges(expand(unexpanded_restrictions(view), roles), SUBCLASS))


def subclass_ignored(view: Ontology, options: Options) -> DataFrame:
    df = view.axioms("SubClassOf")
    sub, sup = is_class(F.col("sub")), is_class(F.col("sup"))
    other = other_side(sub)
    bad = ~(sub & sup)
    if not options.only_taxonomy:
        bad = bad & ~((sub | sup) & F.coalesce(is_restriction(other), F.lit(False)))
    return df.where(bad).select(F.lit("SubClassOf").alias("constructor"))


def ordered(exprs: Column) -> Column:
    """Class expressions in the order of their kinds, named ones by IRI, others by canonical bytes."""
    index = lambda e: F.coalesce(F.create_map(*(F.lit(x) for kv in S.EXPRESSION_ORDER.items() for x in kv))[e["tag"]], F.lit(S.OTHER_EXPRESSION))
    key = lambda e: F.when(is_class(e), F.encode(e["iri"], "UTF-8")).otherwise(e["canon"])
    keyed = F.transform(exprs, lambda e: F.struct(index(e).alias("index"), key(e).alias("key"), e.alias("e")))
    return F.transform(F.array_sort(keyed), lambda x: x["e"])


def equivalences(view: Ontology) -> DataFrame:
    df = view.axioms("EquivalentClasses").select("canon", ordered(F.col("exprs")).alias("x"))
    return df.select("canon", F.get("x", 0).alias("first"), F.get("x", 1).alias("second"))


def equivalence_operands(view: Ontology) -> DataFrame:
    """``k1, first, op, operand`` of axioms of a named class and an intersection or union."""
    df = equivalences(view).where(is_class(F.col("first")) & F.col("second.tag").isin(S.AND, S.OR))
    return df.select(F.col("canon").alias("k1"), F.col("first.iri").alias("source"), F.col("second.tag").alias("join"), F.posexplode(ordered(F.col("second.operands"))).alias("op", "operand"))


def equivalent_edges(view: Ontology, options: Options, roles: DataFrame) -> DataFrame:
    both = options.bidirectional_taxonomy
    pairs = equivalences(view).where(is_class(F.col("first")) & is_class(F.col("second")))
    named = edges(pairs.select(F.col("canon").alias("k1"), F.explode(taxonomy_pair(F.col("first.iri"), F.col("second.iri"), both)).alias("e")).select("k1", "e.*"), EQUIVALENT)
    operands = equivalence_operands(view)
    inner = operands.where(is_class(F.col("operand"))).select("k1", "op", F.explode(taxonomy_pair(F.col("source"), F.col("operand.iri"), both)).alias("e")).select("k1", "op", "e.*")
    named = named.unionByName(edges(inner, EQUIVALENT))
    if options.only_taxonomy:
        return named
    found = operands.where(is_restriction(F.col("operand"))).select("k1", "op", "source", F.col("operand.prop.iri").alias("relation"), F.col("operand.filler_iri").alias("destination"))
    return named.unionByName(edges(expand(found, roles), EQUIVALENT))


def equivalent_ignored(view: Ontology, options: Options) -> DataFrame:
    """One row for each axiom without effect, and for each operand of an aggregate that is neither."""
    df = equivalences(view)
    fine = F.coalesce(is_class(F.col("first")) & (is_class(F.col("second")) | F.col("second.tag").isin(S.AND, S.OR)), F.lit(False))
    whole = df.where(~fine).select(F.lit("EquivalentClasses").alias("constructor"))
    if options.only_taxonomy:
        return whole
    operand = F.col("operand")
    return whole.unionByName(equivalence_operands(view).where(~is_class(operand) & ~F.coalesce(is_restriction(operand), F.lit(False))).select(F.lit("EquivalentClasses").alias("constructor")))


#: Bytes of annotations of one subject from which they are spread over tasks and not gathered to look for its class.
SUBJECT_BYTES = 16 << 20


def root_annotations(view: Ontology, texts: bool = False) -> DataFrame:
    """The root document's annotations, and whether each is of a known class by a known property: ``allowed``. Classes
    are joined once, from the outside: such a join stays above the union of what annotations come from. If their
    ``texts`` are read, those of long_subjects are joined under keys that nothing has, and not under one."""
    df = view.axioms("AnnotationAssertion", root=True).withColumn("_key", F.col("subject"))
    known = class_signature(view).select(F.col("iri").alias("_class"))
    found = F.col("_class").isNotNull()
    if texts and not (long := long_subjects(view)).isEmpty():
        df = df.join(F.broadcast(long), F.col("subject") == F.col("_long"), "left")
        spread_out = F.concat(F.lit("\0"), F.hex(F.xxhash64("value")))
        df = df.withColumn("_key", F.when(F.col("_long").isNull(), F.col("subject")).otherwise(spread_out))
        found = F.coalesce("_known", found)
    fits = found & F.coalesce(F.col("prop").isin(*S.ANNOTATION_PROPERTIES), F.lit(False))
    return df.join(known, F.col("_key") == F.col("_class"), "left").withColumn("allowed", fits).drop("_class", "_key", "_long", "_known")


def long_subjects(view: Ontology) -> DataFrame:
    """``_long``, subjects of the root's annotations that have SUBJECT_BYTES of them, and ``_known``, whether each is a
    class: one for each SUBJECT_BYTES there are at most. Found once for a view and kept durably."""
    if "long" not in view.memo:
        v, known = F.col("value"), class_signature(view).select(F.col("iri").alias("_class"))
        size = sum(F.coalesce(F.octet_length(v[c]), F.lit(0)) for c in ("lexical", "iri"))
        sums = view.axioms("AnnotationAssertion", root=True).groupBy(F.col("subject").alias("_long")).agg(F.sum(size).alias("n"))
        joined = sums.where(F.col("n") >= SUBJECT_BYTES).join(known, F.col("_long") == F.col("_class"), "left")
        view.memo["long"] = durable(joined.select("_long", F.col("_class").isNotNull().alias("_known")))
    return view.memo["long"]


def allowed_annotations(view: Ontology) -> DataFrame:
    return root_annotations(view, texts=True).where("allowed").drop("allowed")


def annotation_relation(prop: Column) -> Column:
    return F.when(F.startswith(prop, F.lit(S.RDFS)), F.concat(F.lit("rdfs:"), F.substr(prop, F.lit(len(S.RDFS) + 1)))).otherwise(prop)


def annotation_edges(view: Ontology, blanks: DataFrame | None) -> DataFrame:
    df = allowed_annotations(view)
    v = F.col("value")
    text = F.when(v["kind"] == "iri", v["iri"]).when(v["kind"] == "literal", literal_text(v["lexical"], v["datatype"]))
    df = df.select(F.col("canon").alias("k1"), F.col("subject").alias("source"), annotation_relation(F.col("prop")).alias("relation"), text.alias("destination"), v["anon"].alias("anon"), v["label"].alias("label"))
    if blanks is None:
        return edges(df.select("k1", "source", "relation", F.coalesce("destination", "label").alias("destination")), ANNOTATION)
    known = with_blank(df.where("destination IS NULL"), "anon", "label", "blank", blanks).select("k1", "source", "relation", F.col("blank").alias("destination"))
    return edges(df.where("destination IS NOT NULL").select(*known.columns).unionByName(known), ANNOTATION)


def annotation_faults(view: Ontology) -> DataFrame:
    """``ignored`` or a ``literal`` that is no string: what is to be said of each annotation, by one pass."""
    v = F.col("value")
    odd = (v["kind"] == "literal") & ~v["datatype"].isin(S.XSD_STRING, S.PLAIN_LITERAL)
    fault = F.when(~F.col("allowed"), "ignored").when(odd, "literal")
    return root_annotations(view).select(fault.alias("fault")).where("fault IS NOT NULL")


def class_assertion_edges(view: Ontology) -> DataFrame:
    df = view.axioms("ClassAssertion").where(is_class(F.col("sub")) & F.col("i1.iri").isNotNull())
    return edges(df.select(F.col("canon").alias("k1"), F.col("i1.iri").alias("source"), F.lit(S.RDF_TYPE).alias("relation"), F.col("sub.iri").alias("destination")), CLASS_ASSERTION)


def class_assertion_ignored(view: Ontology) -> DataFrame:
    return view.axioms("ClassAssertion").where(~(is_class(F.col("sub")) & F.col("i1.iri").isNotNull())).select(F.lit("ClassAssertion").alias("constructor"))


FIRST_BLANK = 1 << 31


def anonymous(view: Ontology) -> DataFrame | None:
    """Each anonymous individual once; None if the view has no kind of axiom that names any."""
    parts = [view.axioms(k).select(F.explode("anons").alias("anon")) for k in view.anonymous_kinds()]
    if not parts:
        return None
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.distinct()


def blank_ids(found: DataFrame) -> DataFrame:
    """``anon, blank``: distinct individuals numbered in the order of their canonical bytes."""
    return numbered(found, ("anon",), "n", FIRST_BLANK).select("anon", F.concat(F.lit("_:genid"), F.col("n").cast("string")).alias("blank"))


def with_blank(df: DataFrame, anon: str, label: str, to: str, blanks: DataFrame | None) -> DataFrame:
    """The number of an anonymous individual, or the label that it has of its own where none is known. Rows without an
    anonymous individual are joined under keys that nothing has, and not under one."""
    if blanks is None:
        return df.withColumn(to, F.col(label))
    spread_out = F.unhex(F.hex(F.xxhash64("k1")))
    keyed = df.withColumn("_key", F.coalesce(F.col(anon), spread_out))
    return keyed.join(blanks.select(F.col("anon").alias("_key"), F.col("blank").alias("_blank")), "_key", "left").withColumn(to, F.coalesce("_blank", F.col(label))).drop("_key", "_blank")


def object_assertion_edges(view: Ontology, blanks: DataFrame | None) -> DataFrame:
    df = view.axioms("ObjectPropertyAssertion").where(F.col("p1.iri").isNotNull() & ~F.coalesce(F.col("p1.chain"), F.lit(False)))
    df = df.select(F.col("canon").alias("k1"), F.col("i1.iri").alias("source"), F.col("p1.iri").alias("relation"), F.col("i2.iri").alias("destination"), F.col("i1.anon").alias("a_anon"), F.col("i1.label").alias("a_label"), F.col("i2.anon").alias("b_anon"), F.col("i2.label").alias("b_label"))
    # Named ends need no lookup and stay out of the joins.
    both = F.col("source").isNotNull() & F.col("destination").isNotNull()
    named = df.where(both).select("k1", "source", "relation", "destination")
    other = with_blank(with_blank(df.where(~both), "a_anon", "a_label", "a_blank", blanks), "b_anon", "b_label", "b_blank", blanks)
    other = other.select("k1", F.coalesce("source", "a_blank").alias("source"), "relation", F.coalesce("destination", "b_blank").alias("destination"))
    return edges(named.unionByName(other), OBJECT_ASSERTION)


def own_property(view: Ontology, kind: str) -> DataFrame:
    p = F.col("p1")
    return view.axioms(kind).withColumn("fine", ~p["inverse"] & ~F.coalesce(p["chain"], F.lit(False)) & is_class(F.col("sub")))


def domain_range_pairs(view: Ontology) -> DataFrame:
    side = lambda kind, key, name: own_property(view, kind).where("fine").select(F.col("p1.iri").alias("relation"), F.col("canon").alias(key), F.col("sub.iri").alias(name))
    return side("ObjectPropertyDomain", "k1", "source").join(side("ObjectPropertyRange", "k2", "destination"), "relation").withColumn("k0", F.col("relation"))


def domain_range_edges(view: Ontology, roles: DataFrame) -> DataFrame:
    return edges(expand(domain_range_pairs(view), roles), DOMAIN_RANGE)


def domain_range_ignored(view: Ontology) -> DataFrame:
    parts = [own_property(view, k).where("NOT fine").select(F.lit(k).alias("constructor")) for k in ("ObjectPropertyDomain", "ObjectPropertyRange")]
    return parts[0].unionByName(parts[1])


def skipped(view: Ontology) -> DataFrame:
    """Axioms of the kinds that are not visited; ontology annotations and rules (other root kinds) are silent."""
    return view.axioms("Other").where("root_kind = 2").select(F.col("kind").alias("constructor"))


def refuse_assertions(view: Ontology) -> None:
    """Raises for an object-property assertion with an inverse property."""
    for row in view.axioms("ObjectPropertyAssertion").where("p1.inverse").select("p1.iri").limit(1).collect():
        raise UnsupportedAxiomShape("an object-property assertion with an inverse property", constructor="ObjectInverseOf", reference_error="java.lang.ClassCastException", property=row[0])


def refuse_kinds(view: Ontology) -> None:
    """Raises for a kind of axiom that is not known."""
    for row in view.axioms("Other").where((F.col("root_kind") == 2) & ~F.col("kind").isin(*S.SKIPPED)).select("kind").limit(1).collect():
        raise IncompatibleSource(f"no such kind of axiom: {row[0]}", constructor=row[0])


def core_blank(key: Column) -> Column:
    return blank_label(key)
