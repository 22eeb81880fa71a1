"""One query for each operator over the star-schema ontology, with SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema as S
from ..functions import canon_columns as C
from ..functions import text as T
from ..operators import roles as R
from ..operators import rules as P
from ..options import Options
from ..sources import generators, views
from ..sources.bridge import IMPORTS, Bridge, star_view, urn
from ..storage import numbered
from ..streaming.lifecycle import replay_states
from . import projection as plan
from . import sql as Q

EDGE = plan.EDGE
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
EVERY = Options(bidirectional_taxonomy=True, include_literals=True)


def query(oracle: str | None = None, name: str | None = None):
    def add(f):
        QUERIES[name or f.__name__] = f
        if oracle is not None:
            SQL[name or f.__name__] = Q.sql(oracle)
        return f

    return add


def triples(df: DataFrame) -> DataFrame:
    return df.select(*EDGE)


def roles_of(view) -> DataFrame:
    return R.fold(view)[0].table(view.spark)


# Scans and the algebra of views


@query("SELECT CASE WHEN inv THEN 'InverseObjectProperties' ELSE 'SubObjectPropertyOf' END AS kind, a AS first, b AS second FROM rbox")
def scan_axioms_by_kind(spark, d):
    v = star_view(spark, d)
    parts = [v.axioms(k).select(F.lit(k).alias("kind"), F.col("p1.iri").alias("first"), F.col("p2.iri").alias("second")) for k in ("SubObjectPropertyOf", "InverseObjectProperties")]
    return parts[0].unionByName(parts[1])


@query("SELECT prop, subject, coalesce(lexical, iri) AS value FROM ann WHERE doc = 'root'")
def scan_root_annotations(spark, d):
    return star_view(spark, d).axioms("AnnotationAssertion", root=True).select("prop", "subject", F.coalesce("value.lexical", "value.iri").alias("value"))


@query("SELECT sub, sup FROM named")
def closure_dedup(spark, d):
    b = Bridge(spark, d)
    twice = b.named_subclasses().unionByName(b.named_subclasses().withColumn("doc_id", F.lit("core")))
    v = views.Ontology(spark, {"SubClassOf": twice}, b.documents(), b.entities()).closure("root")
    return v.axioms("SubClassOf").select(F.col("sub.iri").alias("sub"), F.col("sup.iri").alias("sup"))


@query("SELECT DISTINCT iri FROM classes")
def class_signature(spark, d):
    return views.class_signature(star_view(spark, d))


@query("SELECT sub, sup FROM named")
def segment_direct(spark, d):
    return ends(views.direct(Bridge(spark, d).named_subclasses()))


def ends(df: DataFrame) -> DataFrame:
    return df.select(F.col("sub.iri").alias("sub"), F.col("sup.iri").alias("sup"))


def in_regions(spark, d, condition: str) -> DataFrame:
    return Bridge(spark, d).named_subclasses().where(F.expr(f"cast(substring_index(sup.iri, '#', -1) as int) {condition}"))


@query("SELECT sub, sup FROM named WHERE CAST(split_part(sup, '#', 2) AS INT) <> 1")
def segment_overlay_exclude(spark, d):
    base = Bridge(spark, d).named_subclasses()
    return ends(views.overlay(base, base.limit(0), in_regions(spark, d, "= 1")))


@query("SELECT sub, sup FROM named UNION ALL SELECT 'urn:tpch:country#' || n_name, 'urn:tpch:region#' || n_regionkey FROM nation")
def segment_overlay_delta(spark, d):
    b = Bridge(spark, d)
    n = b.read("nation").select(generators.named_class(urn("country", "n_name")).alias("a"), generators.named_class(urn("region", "n_regionkey")).alias("b"))
    return ends(views.overlay(b.named_subclasses(), generators.subclass(n, "delta", F.col("a"), F.col("b"))))


@query("SELECT sub, sup FROM named WHERE CAST(split_part(sup, '#', 2) AS INT) IN (0, 2, 3, 4)")
def segment_composite_include(spark, d):
    base = Bridge(spark, d).named_subclasses()
    return ends(views.composite([(base, "INCLUDE", in_regions(spark, d, "= 0")), (base, "EXCLUDE", in_regions(spark, d, "<= 1"))]))


@query("SELECT sub, sup FROM named UNION ALL SELECT 'urn:tpch:country#' || n_name, 'urn:tpch:region#' || n_regionkey FROM nation")
def segment_composite_bridge(spark, d):
    b = Bridge(spark, d)
    n = b.read("nation").select(generators.named_class(urn("country", "n_name")).alias("a"), generators.named_class(urn("region", "n_regionkey")).alias("b"))
    base = b.named_subclasses()
    return ends(views.composite([(base, "ALL", None), (base, "INCLUDE", in_regions(spark, d, "= 3"))], generators.subclass(n, "bridge", F.col("a"), F.col("b"))))


@query("SELECT s_suppkey AS key, CASE WHEN s_nationkey % 2 = 0 THEN 100 + s_nationkey ELSE s_nationkey END AS scope FROM supplier")
def anon_scope_remap(spark, d):
    b = Bridge(spark, d)
    scope = lambda n: F.unhex(F.lpad(F.hex(n.cast("long")), 64, "0"))
    people = b.read("supplier").select(F.col("s_suppkey").alias("key"), scope(F.col("s_nationkey")).alias("scope"))
    remap = b.read("nation").where("n_nationkey % 2 = 0").select(scope(F.col("n_nationkey")).alias("scope"), scope(F.col("n_nationkey") + 100).alias("new_scope"))
    return views.remap_scopes(people, remap).select("key", F.conv(F.hex("scope"), 16, 10).cast("int").alias("scope"))


@query(", links AS (SELECT c_custkey AS a, unnest([2 * c_custkey, 2 * c_custkey + 1, c_custkey // 3, c_custkey]) AS b FROM customer WHERE c_nationkey <> 7), reached AS (SELECT 1::BIGINT AS k UNION SELECT b FROM links JOIN reached ON a = k WHERE b IN (SELECT c_custkey FROM customer)) SELECT 'urn:doc#' || k AS doc_id FROM reached")
def imports_closure(spark, d):
    """Each customer is a document that imports others: some twice as far on, one back (cycles), itself; those of one
    nation import nothing."""
    key = F.col("c_custkey")
    far = F.when(F.col("c_nationkey") != 7, F.array(2 * key, 2 * key + 1, F.floor(key / 3), key)).otherwise(F.array().cast("array<bigint>"))
    name = lambda x: F.concat(F.lit("urn:doc#"), x.cast("string"))
    customers = Bridge(spark, d).read("customer")
    links = customers.select(key, F.explode_outer(far).alias("to")).join(customers.select(key.alias("to"), F.lit(True).alias("there")), "to", "left")
    documents = links.groupBy(name(key).alias("doc_id")).agg(F.collect_list(F.when(F.col("there"), name(F.col("to")))).alias("imports"))
    return views.imports_closure(documents, "urn:doc#1")


@query("SELECT 'geo' AS doc_id, 'lost' || r_regionkey AS import_id FROM region")
def missing_imports(spark, d):
    b = Bridge(spark, d)
    lost = b.read("region").agg(F.collect_list(F.concat(F.lit("lost"), F.col("r_regionkey"))).alias("imports")).select(F.lit("geo").alias("doc_id"), "imports", F.lit(False).alias("is_root"))
    return views.missing_imports(b.documents().unionByName(lost))


NUMBERED = "(SELECT row_number() OVER () - 1 AS i, count(*) OVER () AS n FROM lineitem)"


@query(f"SELECT 'urn:p4:class:' || lpad(CAST(i AS VARCHAR), 9, '0') AS source, '{S.SUBCLASS_OF}' AS relation, 'urn:p4:class:' || lpad(CAST(i + 1 AS VARCHAR), 9, '0') AS destination FROM {NUMBERED}")
def synthetic_chain(spark, d):
    """As many axioms as there are order lines."""
    return plan.projected(generators.chain(spark, Bridge(spark, d).read("lineitem").count()))


@query(f"SELECT 'urn:synthetic:class:' || lpad(CAST(i % greatest(1, n * 4 // 5) AS VARCHAR), 9, '0') AS source, 'urn:synthetic:relation:' || lpad(CAST(i % 17 AS VARCHAR), 2, '0') AS relation, 'urn:synthetic:class:' || lpad(CAST((i * 37) % greatest(1, n * 4 // 5) AS VARCHAR), 9, '0') AS destination FROM {NUMBERED}")
def synthetic_edges(spark, d):
    return generators.synthetic_edges(spark, Bridge(spark, d).read("lineitem").count())


SPLIT_MIX = """SELECT l_orderkey, l_linenumber, printf('%016x', xor(z, z >> 31)) AS number FROM (
    SELECT * REPLACE ((xor(z, z >> 27)::UHUGEINT * 10723151780598845931::UHUGEINT % 18446744073709551616::UHUGEINT)::UBIGINT AS z) FROM (
    SELECT * REPLACE ((xor(z, z >> 30)::UHUGEINT * 13787848793156543929::UHUGEINT % 18446744073709551616::UHUGEINT)::UBIGINT AS z) FROM (
    SELECT l_orderkey, l_linenumber, ((l_orderkey::HUGEINT + 11400714819323198485::HUGEINT * l_linenumber::HUGEINT) % 18446744073709551616)::UBIGINT AS z FROM lineitem)))"""


@query(f" SELECT * FROM ({SPLIT_MIX})")
def split_mix(spark, d):
    """The number that a generator seeded by an order's key gives at each line of it, by the line's number alone."""
    lines = Bridge(spark, d).read("lineitem").select("l_orderkey", "l_linenumber")
    number = generators.split_mix(F.col("l_orderkey").cast("long"), F.col("l_linenumber").cast("long"))
    return lines.select("l_orderkey", "l_linenumber", generators.hex64(number).alias("number"))


# Edge rules


@query("SELECT * FROM subclass_up")
def subclass_named(spark, d):
    return triples(P.named_subclasses(star_view(spark, d)))


@query("SELECT * FROM subclass_both")
def subclass_bidirectional(spark, d):
    return triples(P.named_subclasses(star_view(spark, d), True))


@query(Q.expanded("SELECT * FROM restr_fine WHERE side = 'super'"))
def restriction_super(spark, d):
    v = star_view(spark, d)
    return triples(R.expand(P.unexpanded_restrictions(v, "super"), roles_of(v)))


@query(Q.expanded("SELECT * FROM restr_fine WHERE side = 'sub'"))
def restriction_sub(spark, d):
    v = star_view(spark, d)
    return triples(R.expand(P.unexpanded_restrictions(v, "sub"), roles_of(v)))


@query("SELECT CASE kind WHEN 0 THEN 34 WHEN 1 THEN 35 WHEN 2 THEN 38 ELSE 39 END AS tag, count(*) AS n FROM restr WHERE kind < 4 GROUP BY ALL")
def restriction_kinds(spark, d):
    return P.restriction_sides(star_view(spark, d)).where(P.is_restriction(F.col("expr"))).groupBy(F.col("expr.tag").alias("tag")).agg(F.count("*").alias("n"))


@query("SELECT b.source, b.relation AS base, e.relation, e.destination FROM (SELECT DISTINCT source, relation, destination FROM restr_fine WHERE side = 'super') b, LATERAL (SELECT b.relation AS relation, b.destination AS destination UNION ALL SELECT c.subrole, b.destination FROM chain c WHERE c.relation = b.relation) e")
def role_expansion(spark, d):
    v = star_view(spark, d)
    base = P.unexpanded_restrictions(v, "super").select("source", "relation", "destination", F.col("relation").alias("base"), F.col("source").alias("from"))
    return R.expand(base, roles_of(v)).where("source = from").select("source", "base", "relation", "destination")


@query(f"SELECT sub AS source, '{S.SUBCLASS_OF}' AS relation, sup AS destination FROM eq_pairs")
def equivalent_named(spark, d):
    v = star_view(spark, d)
    pairs = P.equivalences(v).where(P.is_class(F.col("first")) & P.is_class(F.col("second")))
    return triples(pairs.select(F.explode(P.taxonomy_pair(F.col("first.iri"), F.col("second.iri"), False)).alias("e")).select("e.*"))


def aggregate_query(tag: int):
    def run(spark, d):
        v = star_view(spark, d)
        own = P.equivalence_operands(v).where(F.col("join") == tag)
        named = own.where(P.is_class(F.col("operand"))).select("source", F.lit(S.SUBCLASS_OF).alias("relation"), F.col("operand.iri").alias("destination"))
        some = own.where(P.is_restriction(F.col("operand"))).select("source", F.col("operand.prop.iri").alias("relation"), F.col("operand.filler_iri").alias("destination"))
        return named.unionByName(triples(R.expand(some, roles_of(v))))

    return run


for _name, _tag, _odd in (("equivalent_intersection", S.AND, 0), ("equivalent_union", S.OR, 1)):
    query(f"SELECT 'urn:tpch:brand#' || p_brand AS source, '{S.SUBCLASS_OF}' AS relation, destination FROM operands WHERE kind = 'class' AND n % 2 = {_odd} UNION ALL ({Q.expanded(f'SELECT source, relation, destination FROM eq_restr WHERE n % 2 = {_odd}')})", _name)(aggregate_query(_tag))


@query("SELECT constructor, count(*) AS n FROM diag WHERE code = 'MOWL_IGNORED_SHAPE' AND constructor = 'EquivalentClasses' GROUP BY ALL")
def equivalent_ignored(spark, d):
    return P.equivalent_ignored(star_view(spark, d), Options()).groupBy("constructor").agg(F.count("*").alias("n"))


@query("SELECT * FROM ann_edges")
def annotation_edges(spark, d):
    return triples(P.annotation_edges(star_view(spark, d), None))


@query("SELECT prop, count(*) AS n FROM ann WHERE doc = 'root' AND prop IN (" + Q.ALLOWED + ") GROUP BY ALL")
def annotation_allowlist(spark, d):
    return star_view(spark, d).axioms("AnnotationAssertion", root=True).where(F.col("prop").isin(*S.ANNOTATION_PROPERTIES)).groupBy("prop").agg(F.count("*").alias("n"))


@query("SELECT * FROM ca")
def class_assertion(spark, d):
    return triples(P.class_assertion_edges(star_view(spark, d)))


@query("SELECT * FROM oa")
def object_assertion(spark, d):
    v = star_view(spark, d)
    return triples(P.object_assertion_edges(v, P.blank_ids(P.anonymous(v))))


@query(Q.expanded("SELECT * FROM dr"))
def domain_range(spark, d):
    v = star_view(spark, d)
    return triples(P.domain_range_edges(v, roles_of(v)))


@query("SELECT * FROM subclass_up")
def asserted_taxonomy(spark, d):
    return plan.taxonomy(star_view(spark, d))


@query("SELECT * FROM subclass_both")
def asserted_taxonomy_bidirectional(spark, d):
    return plan.taxonomy(star_view(spark, d), True)


@query(Q.FULL)
def full_projection(spark, d):
    return plan.projected(star_view(spark, d))


@query(Q.ALL_FLAGS)
def full_projection_all_flags(spark, d):
    return plan.projected(star_view(spark, d), EVERY)


@query(f"SELECT * FROM plain UNION ALL ({Q.expanded('SELECT * FROM dr')})")
def only_taxonomy(spark, d):
    return plan.projected(star_view(spark, d), Options(only_taxonomy=True))


# Diagnostics and counts


@query("SELECT constructor, count(*) AS n FROM diag WHERE code = 'MOWL_SKIPPED_AXIOM' GROUP BY ALL")
def skipped_axioms(spark, d):
    return P.skipped(star_view(spark, d)).groupBy("constructor").agg(F.count("*").alias("n"))


@query("SELECT 'Rule' AS kind, count(*) AS n FROM region")
def silent_roots(spark, d):
    return star_view(spark, d).axioms("Other").where("root_kind <> 2").groupBy("kind").agg(F.count("*").alias("n"))


@query("SELECT constructor, count(*) AS n FROM diag WHERE code = 'MOWL_IGNORED_SHAPE' GROUP BY ALL")
def ignored_shapes(spark, d):
    return plan.ignored(star_view(spark, d), EVERY).groupBy("constructor").agg(F.count("*").alias("n"))


@query("SELECT code, severity, constructor, count(*) AS count FROM diag GROUP BY ALL")
def diagnostics(spark, d):
    return plan.diagnostics(star_view(spark, d), EVERY).drop("message")


@query("SELECT count(*) AS warnings FROM diag WHERE severity = 'warning'")
def warning_summary(spark, d):
    return plan.warning_count(plan.diagnostics(star_view(spark, d), EVERY))


@query(f"SELECT count(*) AS raw_edges, count(DISTINCT (source, relation, destination)) AS distinct_edges, count(*) - count(DISTINCT (source, relation, destination)) AS duplicate_edges FROM ({Q.FULL})")
def edge_statistics(spark, d):
    return plan.edge_counts(plan.raw_edges(star_view(spark, d)))


@query(f"SELECT source, relation, destination, count(*) AS count FROM ({Q.FULL}) GROUP BY ALL")
def edge_counter(spark, d):
    return plan.edge_counter(plan.raw_edges(star_view(spark, d)))


@query("SELECT relation, string_agg(DISTINCT source, ' ' ORDER BY source) AS domains, string_agg(DISTINCT destination, ' ' ORDER BY destination) AS ranges FROM dr GROUP BY relation")
def domain_range_lists(spark, d):
    v = star_view(spark, d)
    side = lambda k, n: P.own_property(v, k).where("fine").groupBy(F.col("p1.iri").alias("relation")).agg(F.concat_ws(" ", F.sort_array(F.collect_set("sub.iri"))).alias(n))
    return side("ObjectPropertyDomain", "domains").join(side("ObjectPropertyRange", "ranges"), "relation")


@query(f"SELECT CAST(sum(CAST('0x' || substr(md5(source || '|' || relation || '|' || destination), 1, 8) AS BIGINT)) AS BIGINT) AS digest, count(*) AS n FROM ({Q.FULL})")
def bag_checksum(spark, d):
    """The sum of 32 bits of a digest of each edge: it depends on every edge and its multiplicity, not on order."""
    edge = F.md5(F.encode(F.concat_ws("|", *EDGE), "UTF-8"))
    return plan.raw_edges(star_view(spark, d)).agg(F.sum(F.conv(F.substring(edge, 1, 8), 16, 10).cast("long")).alias("digest"), F.count("*").alias("n"))


@query("SELECT sha256(string_agg('{\"source\":\"' || source || '\",\"relation\":\"' || relation || '\",\"destination\":\"' || destination || '\"}' || chr(10), '' ORDER BY encode(source), encode(relation), encode(destination))) AS digest FROM subclass_both")
def canonical_digest(spark, d):
    from ..streaming.sinks import digest

    return spark.createDataFrame([(digest(plan.taxonomy(star_view(spark, d), True)),)], "digest string")


# Roles


@query("SELECT relation, pos, subrole FROM chain")
def role_state_subroles(spark, d):
    return R.fold(star_view(spark, d))[0].lists(spark)


@query("SELECT relation, inverse FROM inverses")
def role_state_inverse(spark, d):
    return R.fold(star_view(spark, d))[0].inverses(spark)


@query("SELECT b.source, c.subrole AS relation, b.destination FROM restr_fine b JOIN chain c ON c.relation = b.relation")
def role_subroles_join(spark, d):
    v = star_view(spark, d)
    return P.unexpanded_restrictions(v).join(R.fold(v)[0].lists(spark), "relation").select("source", F.col("subrole").alias("relation"), "destination")


@query("SELECT b.destination AS source, i.inverse AS relation, b.source AS destination FROM restr_fine b JOIN inverses i ON i.relation = b.relation")
def role_inverse_join(spark, d):
    v = star_view(spark, d)
    return P.unexpanded_restrictions(v).join(R.fold(v)[0].inverses(spark), "relation").select(F.col("destination").alias("source"), F.col("inverse").alias("relation"), F.col("source").alias("destination"))


@query(f"SELECT inv AS is_inverse, a AS first, b AS second, {Q.int32('hash')} AS hash FROM hashed")
def role_axiom_hash(spark, d):
    return R.role_axioms(star_view(spark, d)).select("is_inverse", "first", "second", T.int32(F.col("hash")).alias("hash"))


@query(f"SELECT source, {Q.int32('hash')} AS hash FROM ({Q.EXPRESSION_HASHES})")
def class_expression_hash(spark, d):
    v = star_view(spark, d)
    found = P.restriction_sides(v).select("source", "expr").unionByName(P.equivalences(v).select(F.col("first.iri").alias("source"), F.col("second").alias("expr")))
    return found.select("source", T.int32(T.expression_hash(F.col("expr"))).alias("hash"))


@query("SELECT ord AS visit, inv AS is_inverse, a AS first, b AS second FROM visits")
def hashset_order(spark, d):
    return R.visits(star_view(spark, d), 1)[0]


def by_region(spark, d):
    """The role axioms of each region's nations, as calls one after the other."""
    b = Bridge(spark, d)
    out = []
    for k in range(5):
        keys = F.concat(F.lit("urn:tpch:prop#"), F.col("n_nationkey"))
        own = b.read("nation").where(F.col("n_regionkey") == k).select(keys.alias("iri"))
        kinds = {n: b.roles(n).join(own, F.col("p1.iri") == F.col("iri"), "left_semi") for n in ("SubObjectPropertyOf", "InverseObjectProperties")}
        out.append((k, views.Ontology(spark, kinds, b.documents(), b.entities())))
    return out


@query(Q.LIFECYCLE)
def role_lifecycle(spark, d):
    return replay_states(by_region(spark, d))


# Order and duplicates


def ranked(edges: DataFrame, *keys: str) -> DataFrame:
    return numbered(edges, keys, "rank", 1).select("rank", *EDGE)


@query(f"SELECT row_number() OVER (ORDER BY encode(source), encode(relation), encode(destination)) AS rank, * FROM ({Q.FULL})")
def canonical_order(spark, d):
    return ranked(plan.raw_edges(star_view(spark, d)).select(*EDGE), *EDGE)


ENCOUNTER = f"""SELECT 1 AS cat, sub AS source, '{S.SUBCLASS_OF}' AS relation, sup AS destination, length(sub) AS l0, encode(sub) AS k0, length(sup) AS l1, encode(sup) AS k1, 0 AS emit FROM named
    UNION ALL SELECT 1, sup, '{S.SUPERCLASS_OF}', sub, length(sub), encode(sub), length(sup), encode(sup), 1 FROM named
    UNION ALL SELECT 4, source, relation, destination, length(destination), encode(destination), length(source), encode(source), 0 FROM ca"""


def encountered(spark, d) -> DataFrame:
    """Edges of two categories."""
    v = star_view(spark, d)
    return P.named_subclasses(v, True).unionByName(P.class_assertion_edges(v))


@query(f"SELECT row_number() OVER (ORDER BY cat, l0, k0, l1, k1, emit) AS rank, source, relation, destination FROM ({ENCOUNTER})")
def encounter_order(spark, d):
    return ranked(encountered(spark, d), *P.KEY)


@query(f"SELECT row_number() OVER (ORDER BY first) AS rank, source, relation, destination FROM (SELECT source, relation, destination, min(r) AS first FROM (SELECT *, row_number() OVER (ORDER BY cat, l0, k0, l1, k1, emit) AS r FROM ({ENCOUNTER})) GROUP BY ALL)")
def encounter_unique(spark, d):
    df = encountered(spark, d)
    return ranked(plan.firsts(df.unionByName(df.withColumn("cat", F.lit(9)))), *P.KEY)


@query(f"SELECT DISTINCT source, relation, destination FROM ({Q.FULL})")
def canonical_unique(spark, d):
    return plan.projected(star_view(spark, d), Options(duplicates="unique"))


@query("SELECT 'urn:tpch:brand#' || p_brand AS source, op, kind, destination AS operand FROM operands")
def expression_order(spark, d):
    kind = F.when(P.is_class(F.col("operand")), "class").when(F.col("operand.tag") == S.SOME, "some").otherwise("exact")
    name = F.coalesce("operand.iri", "operand.filler_iri")
    return P.equivalence_operands(star_view(spark, d)).select("source", "op", kind.alias("kind"), name.alias("operand"))


@query("SELECT key, blank FROM anons")
def blank_ids(spark, d):
    found = P.blank_ids(P.anonymous(star_view(spark, d)))
    return found.select(F.expr("decode(substring(anon, 38), 'UTF-8')").alias("key"), "blank")


@query("SELECT CAST(floor((n - 1) / 1000) AS BIGINT) AS batch, count(*) AS size FROM (SELECT row_number() OVER () AS n FROM ca) GROUP BY ALL")
def batch_sizes(spark, d):
    from ..streaming.sinks import numbered_batches

    return numbered_batches(P.class_assertion_edges(star_view(spark, d)), 1000).groupBy("batch").agg(F.count("*").alias("size"))


@query("SELECT a.source, a.relation, a.destination, 2 AS left_count, 1 AS right_count FROM subclass_up a WHERE destination = 'urn:tpch:region#1'")
def bag_diff(spark, d):
    up = P.named_subclasses(star_view(spark, d))
    return plan.bag_diff(up.unionByName(up.where("destination = 'urn:tpch:region#1'")), up)


# Functions


@query(f"SELECT doc_id, {Q.int32(Q.string_hash('text'))} AS hash FROM documents")
def java_hash(spark, d):
    return Bridge(spark, d).read("documents").select("doc_id", T.java_hash(F.col("text")).alias("hash"))


@query(f"SELECT iri, {Q.int32(Q.iri_hash('iri'))} AS hash FROM classes")
def iri_hash(spark, d):
    return views.class_signature(star_view(spark, d)).select("iri", T.int32(T.iri_hash(F.col("iri"))).alias("hash"))


@query(f"SELECT c_nationkey AS n, CAST(sum({Q.string_hash('c_name')}) AS BIGINT) & 4294967295 AS hash FROM customer GROUP BY c_nationkey")
def set_hash(spark, d):
    df = Bridge(spark, d).read("customer").select("c_nationkey", T.string_hash(F.col("c_name")).alias("h"))
    return df.groupBy(F.col("c_nationkey").alias("n")).agg(T.set_hash(F.collect_list("h")).alias("hash"))


@query(r"""SELECT doc_id, replace(replace(replace(replace(text, '\', ''), chr(10), 'n'), chr(13), 'r'), chr(9), 't') || '"^^xsd:toke' AS text FROM documents""")
def literal_render(spark, d):
    return Bridge(spark, d).read("documents").select("doc_id", T.literal_text(F.col("text"), F.lit(S.XSD + "token")).alias("text"))


@query("SELECT s_suppkey AS key, CASE WHEN s_suppkey % 2 = 0 THEN '_:' || s_name ELSE '_:' || s_suppkey END AS label FROM supplier")
def core_blank_id(spark, d):
    s = Bridge(spark, d).read("supplier")
    key = F.when(F.col("s_suppkey") % 2 == 0, F.col("s_name")).otherwise(F.concat(F.lit("_:"), F.col("s_suppkey")))
    return s.select(F.col("s_suppkey").alias("key"), T.blank_label(F.encode(key, "UTF-8")).alias("label"))


@query("SELECT iri, lower(hex('\\x01\\x02'::BLOB || from_hex(printf('%02x', strlen(iri))) || encode(iri))) AS canon FROM (SELECT DISTINCT iri FROM classes)".replace("from_hex(", "unhex("))
def canonical_bytes(spark, d):
    return views.class_signature(star_view(spark, d)).select("iri", F.lower(F.hex(C.iri(F.col("iri")))).alias("canon"))


@query("SELECT '{\"source\":' || to_json(source)::VARCHAR || ',\"relation\":' || to_json(relation)::VARCHAR || ',\"destination\":' || to_json(destination)::VARCHAR || '}' AS value FROM ann_edges")
def edge_json(spark, d):
    from ..streaming.sinks import json_lines

    return json_lines(P.annotation_edges(star_view(spark, d), None))


@query("SELECT subject, prop FROM ann WHERE doc = 'root' AND prop = '" + Q.UNSUPPORTED + "'")
def root_annotation_intersect(spark, d):
    v = star_view(spark, d)
    every, root = v.axioms("AnnotationAssertion"), v.axioms("AnnotationAssertion", root=True)
    return every.join(root.select("canon").distinct(), "canon", "left_semi").where(F.col("prop") == Q.UNSUPPORTED).select("subject", "prop")


IMPORTS_ORDER = tuple(IMPORTS)
