"""The same ontology and its edges in SQL, for comparison. Common table expressions that a query doesn't use cost
nothing."""

from __future__ import annotations

from .. import schema as S
from ..functions.text import EXPRESSION_SEEDS as EXPRESSIONS
from ..functions.text import HASH_SEEDS as SEEDS
from ..functions.text import UNSEEDED
from ..sources.bridge import ALT_LABEL, COMMENT, LABEL, PREF_LABEL, TITLE, UNSUPPORTED

MASK = 4294967295


def string_hash(e: str) -> str:
    return f"(CASE WHEN {e} = '' THEN 0 ELSE list_reduce(list_prepend(0::BIGINT, list_transform(string_split({e}, ''), lambda x: unicode(x)::BIGINT)), lambda h, x: (31 * h + x) & {MASK}) END)"


def iri_hash(e: str) -> str:
    part = [f"regexp_extract({e}, '^(.*[#/:])?(.*)$', {i})" for i in (1, 2)]
    return f"(({string_hash(part[0])} + {string_hash(part[1])}) & {MASK})"


def combined(seed: int, *parts: str) -> str:
    out = f"{seed}::BIGINT"
    for p in parts:
        out = f"((31 * {out} + {p}) & {MASK})"
    return out


def int32(e: str) -> str:
    return f"((({e}) + 2147483648) & {MASK}) - 2147483648"


ALLOWED = ", ".join(f"'{p}'" for p in S.ANNOTATION_PROPERTIES)

CTES = {
    "named": """SELECT 'urn:tpch:nation#' || n_nationkey AS sub, 'urn:tpch:region#' || n_regionkey AS sup FROM nation""",
    "subclass_up": f"SELECT sub AS source, '{S.SUBCLASS_OF}' AS relation, sup AS destination FROM named",
    "subclass_both": f"SELECT * FROM subclass_up UNION ALL SELECT sup, '{S.SUPERCLASS_OF}', sub FROM named",
    "restr": """SELECT p_partkey % 6 AS kind, CASE WHEN (p_partkey // 6) % 2 = 0 THEN 'super' ELSE 'sub' END AS side,
        'urn:tpch:part#' || p_partkey AS source, 'urn:tpch:prop#' || (p_partkey % 25) AS relation, 'urn:tpch:type#' || p_type AS destination FROM part""",
    "restr_fine": "SELECT source, relation, destination, side FROM restr WHERE kind < 4",
    # the role box, in the order of the hash table: 55 axioms in 128 slots
    "rbox": f"""SELECT false AS inv, 'urn:tpch:prop#' || n_nationkey AS a, 'urn:tpch:prop#' || ((n_nationkey * 7 + 3) % 25) AS b, NULL AS note FROM nation
        UNION ALL SELECT false, 'urn:tpch:prop#' || n_nationkey, 'urn:tpch:prop#' || ((n_nationkey * 7 + 3) % 25), n_name FROM nation WHERE n_nationkey % 5 = 0
        UNION ALL SELECT true, 'urn:tpch:prop#' || n_nationkey, 'urn:tpch:prop#' || ((n_nationkey * 11 + 5) % 25), NULL FROM nation""",
    "hashed": f"""SELECT *, CASE WHEN inv THEN {combined(SEEDS['inverse_properties'], f'(ha + hb) & {MASK}', 'hn')} ELSE {combined(SEEDS['sub_property'], 'ha', 'hb', 'hn')} END AS hash
        FROM (SELECT *, {combined(SEEDS['object_property'], iri_hash('a'))} AS ha, {combined(SEEDS['object_property'], iri_hash('b'))} AS hb,
            CASE WHEN note IS NULL THEN 0 ELSE {combined(SEEDS['annotation'], iri_hash(f"'{COMMENT}'"), string_hash('note'))} END AS hn FROM rbox)""",
    "visits": "SELECT *, row_number() OVER (ORDER BY spread & 127, spread) AS ord FROM (SELECT *, xor(hash, hash >> 16) AS spread FROM hashed)",
    "sp": "SELECT ord, a AS sub, b AS sup FROM visits WHERE NOT inv",
    "prev": "SELECT x.ord AS t, max(y.ord) AS ord FROM sp x JOIN sp y ON y.sup = x.sub AND y.ord < x.ord GROUP BY x.ord",
    "chain": """SELECT sup AS relation, 0 AS pos, arg_max(sub, ord) AS subrole, max(ord) AS t FROM sp GROUP BY sup
        UNION ALL SELECT c.relation, c.pos + 1, n.sub, n.ord FROM chain c JOIN prev p ON p.t = c.t JOIN sp n ON n.ord = p.ord""",
    "inverses": "SELECT a AS relation, arg_max(b, ord) AS inverse FROM (SELECT a, b, ord * 2 AS ord FROM visits WHERE inv UNION ALL SELECT b, a, ord * 2 + 1 FROM visits WHERE inv) GROUP BY a",
    "types": "SELECT DISTINCT p_brand, p_type FROM part",
    "brands": "SELECT DISTINCT p_brand, CAST(substr(p_brand, 7) AS INT) AS n FROM part",
    "operands": """SELECT p_brand, CAST(substr(p_brand, 7) AS INT) AS n, row_number() OVER (PARTITION BY p_brand ORDER BY encode(p_type)) - 1 AS op, 'class' AS kind, 'urn:tpch:type#' || p_type AS destination FROM types
        UNION ALL SELECT p_brand, any_value(CAST(substr(p_brand, 7) AS INT)), count(*), 'some', 'urn:tpch:type#ALL' FROM types GROUP BY p_brand
        UNION ALL SELECT p_brand, any_value(CAST(substr(p_brand, 7) AS INT)), count(*) + 1, 'exact', 'urn:tpch:type#ALL' FROM types GROUP BY p_brand""",
    "eq_pairs": "SELECT 'urn:tpch:country#' || n_name AS sub, 'urn:tpch:nation#' || n_nationkey AS sup FROM nation",
    "eq_named": """SELECT sub, sup FROM eq_pairs UNION ALL SELECT 'urn:tpch:brand#' || p_brand, destination FROM operands WHERE kind = 'class'""",
    "eq_restr": "SELECT 'urn:tpch:brand#' || p_brand AS source, 'urn:tpch:prop#' || (n % 25) AS relation, destination, n FROM operands WHERE kind = 'some'",
    "eq_up": f"SELECT sub AS source, '{S.SUBCLASS_OF}' AS relation, sup AS destination FROM eq_named",
    "eq_both": f"SELECT * FROM eq_up UNION ALL SELECT sup, '{S.SUPERCLASS_OF}', sub FROM eq_named",
    "dr": """SELECT DISTINCT 'urn:tpch:nation#' || d.c_nationkey AS source, 'urn:tpch:segment#' || d.c_mktsegment AS relation, 'urn:tpch:priority#' || r.o_orderpriority AS destination
        FROM customer d JOIN (SELECT DISTINCT c_mktsegment, o_orderpriority FROM orders JOIN customer ON c_custkey = o_custkey) r ON r.c_mktsegment = d.c_mktsegment""",
    "ca": f"""SELECT 'urn:tpch:customer#' || c_custkey AS source, '{S.RDF_TYPE}' AS relation, 'urn:tpch:nation#' || c_nationkey AS destination FROM customer WHERE c_custkey % 50 <> 0
        UNION ALL SELECT 'urn:tpch:supplier#' || s_suppkey, '{S.RDF_TYPE}', 'urn:tpch:nation#' || s_nationkey FROM supplier""",
    # anonymous individuals by canonical bytes: the scope is one, keys are ordered by length and then by bytes
    "anons": """SELECT key, '_:genid' || (2147483647 + row_number() OVER (ORDER BY length(key), encode(key))) AS blank
        FROM (SELECT DISTINCT 'o' || l_orderkey AS key FROM lineitem WHERE l_orderkey % 97 = 0 UNION SELECT DISTINCT 'c' || c_custkey FROM customer WHERE c_custkey % 50 = 0)""",
    "oa": """SELECT CASE WHEN l_orderkey % 97 = 0 THEN blank ELSE 'urn:tpch:order#' || l_orderkey END AS source, 'urn:tpch:prop#hasPart' AS relation, 'urn:tpch:part#' || l_partkey AS destination
        FROM lineitem LEFT JOIN anons ON l_orderkey % 97 = 0 AND key = 'o' || l_orderkey""",
    "classes": """SELECT 'urn:tpch:nation#' || n_nationkey AS iri FROM nation UNION SELECT 'urn:tpch:region#' || r_regionkey FROM region UNION SELECT 'urn:tpch:country#' || n_name FROM nation
        UNION SELECT 'urn:tpch:part#' || p_partkey FROM part UNION SELECT 'urn:tpch:type#' || p_type FROM part UNION SELECT 'urn:tpch:brand#' || p_brand FROM part""",
    "ann": f"""SELECT 'root' AS doc, '{LABEL}' AS prop, 'urn:tpch:nation#' || n_nationkey AS subject, n_name AS lexical, '{S.XSD_STRING}' AS datatype, NULL AS iri FROM nation
        UNION ALL SELECT 'root', '{UNSUPPORTED}', 'urn:tpch:nation#' || n_nationkey, n_name, '{S.XSD_STRING}', NULL FROM nation
        UNION ALL SELECT 'root', '{PREF_LABEL}', 'urn:tpch:part#' || p_partkey, p_name, '{S.XSD_STRING}', NULL FROM part
        UNION ALL SELECT 'root', '{ALT_LABEL}', 'urn:tpch:part#' || p_partkey, CAST(p_size AS VARCHAR), '{S.XSD}integer', NULL FROM part
        UNION ALL SELECT 'root', '{TITLE}', 'urn:tpch:part#' || p_partkey, NULL, NULL, 'urn:tpch:brand#' || p_brand FROM part
        UNION ALL SELECT 'root', '{COMMENT}', 'urn:tpch:nation#' || n, text, '{S.PLAIN_LITERAL}', NULL FROM (SELECT DISTINCT doc_id % 25 AS n, text, lang FROM documents)
        UNION ALL SELECT 'root', '{LABEL}', 'urn:tpch:supplier#' || s_suppkey, s_name, '{S.XSD_STRING}', NULL FROM supplier
        UNION ALL SELECT 'geo', '{LABEL}', 'urn:tpch:region#' || r_regionkey, r_name, '{S.XSD_STRING}', NULL FROM region""",
    "ann_fine": f"SELECT * FROM ann WHERE doc = 'root' AND prop IN ({ALLOWED}) AND subject IN (SELECT iri FROM classes)",
    "ann_edges": f"""SELECT subject AS source, CASE WHEN starts_with(prop, '{S.RDFS}') THEN 'rdfs:' || substr(prop, {len(S.RDFS) + 1}) ELSE prop END AS relation,
        CASE WHEN iri IS NOT NULL THEN iri WHEN datatype IN ('{S.XSD_STRING}', '{S.PLAIN_LITERAL}') THEN lexical
             ELSE lexical || '"^^' || left('xsd:' || substr(datatype, {len(S.XSD) + 1}), -1) END AS destination FROM ann_fine""",
    "expandable": "SELECT source, relation, destination FROM restr_fine UNION ALL SELECT source, relation, destination FROM eq_restr UNION ALL SELECT * FROM dr",
    "plain": """SELECT * FROM subclass_up UNION ALL SELECT * FROM eq_up UNION ALL SELECT * FROM ca UNION ALL SELECT * FROM oa""",
    "diag": f"""SELECT 'MOWL_IGNORED_SHAPE' AS code, 'info' AS severity, 'SubClassOf' AS constructor FROM restr WHERE kind >= 4
        UNION ALL SELECT 'MOWL_IGNORED_SHAPE', 'info', 'EquivalentClasses' FROM operands WHERE kind = 'exact'
        UNION ALL SELECT 'MOWL_IGNORED_SHAPE', 'info', 'EquivalentClasses' FROM nation WHERE n_nationkey % 2 = 0
        UNION ALL SELECT 'MOWL_IGNORED_SHAPE', 'info', 'ClassAssertion' FROM customer WHERE c_custkey % 50 = 0
        UNION ALL SELECT 'MOWL_IGNORED_SHAPE', 'info', 'AnnotationAssertion' FROM ann WHERE doc = 'root' AND NOT (prop IN ({ALLOWED}) AND subject IN (SELECT iri FROM classes))
        UNION ALL SELECT 'MOWL_SKIPPED_AXIOM', 'info', k FROM nation, (SELECT unnest([{', '.join(f"'{k}'" for k in S.SKIPPED)}]) AS k)
        UNION ALL SELECT 'MOWL_NON_STRING_LITERAL_RENDERING', 'warning', 'Literal' FROM ann_fine WHERE datatype NOT IN ('{S.XSD_STRING}', '{S.PLAIN_LITERAL}')""",
}
PRELUDE = "WITH RECURSIVE " + ",\n".join(f"{k} AS ({v})" for k, v in CTES.items())


def expanded(base: str) -> str:
    """A role's edge, its sub-roles' and its inverse's."""
    return f"""SELECT source, relation, destination FROM ({base})
        UNION ALL SELECT b.source, c.subrole, b.destination FROM ({base}) b JOIN chain c ON c.relation = b.relation
        UNION ALL SELECT b.destination, i.inverse, b.source FROM ({base}) b JOIN inverses i ON i.relation = b.relation"""


def sql(select: str) -> str:
    return f"{PRELUDE}\n{select}"


def restriction_hash(kind: str, relation: str, destination: str) -> str:
    """Of a restriction by a named class; ``kind``: 0 some, 1 all, 2 at least one, 3 at most one, 4 exactly one."""
    p = combined(SEEDS["object_property"], iri_hash(relation))
    c = combined(SEEDS["class"], iri_hash(destination))
    seeds = [EXPRESSIONS[t] for t in (S.SOME, S.ALL, S.MIN, S.MAX)]
    of = [combined(s, p, *(["1"] if i > 1 else []), c) for i, s in enumerate(seeds)]
    named = string_hash(f"'{UNSEEDED[S.EXACT]}'")
    return f"CASE {kind} WHEN 0 THEN {of[0]} WHEN 1 THEN {of[1]} WHEN 2 THEN {of[2]} WHEN 3 THEN {of[3]} WHEN 4 THEN {named} END"


PROP_OF_BRAND, CLASS_SEED = "'urn:tpch:prop#' || (n % 25)", SEEDS["class"]
OPERAND_HASH = f"CASE kind WHEN 'class' THEN {combined(CLASS_SEED, iri_hash('destination'))} WHEN 'some' THEN {restriction_hash('0', f'({PROP_OF_BRAND})', 'destination')} ELSE {restriction_hash('4', f'({PROP_OF_BRAND})', 'destination')} END"
EXPRESSION_HASHES = f"""SELECT source, {restriction_hash('kind', 'relation', 'destination')} AS hash FROM restr
    UNION ALL SELECT 'urn:tpch:brand#' || p_brand, CASE WHEN n % 2 = 0 THEN {combined(EXPRESSIONS[S.AND], 'members')} ELSE {combined(EXPRESSIONS[S.OR], 'members')} END
        FROM (SELECT p_brand, any_value(n) AS n, CAST(sum({OPERAND_HASH}) % 4294967296 AS BIGINT) AS members FROM operands GROUP BY p_brand)
    UNION ALL SELECT sub, {combined(CLASS_SEED, iri_hash('sup'))} FROM eq_pairs
    UNION ALL SELECT 'urn:tpch:nation#' || n_nationkey, {restriction_hash('0', "('urn:tpch:prop#' || n_nationkey)", "('urn:tpch:region#' || n_regionkey)")} FROM nation WHERE n_nationkey % 2 = 0"""
EXPANDED = expanded("SELECT * FROM expandable")
FULL = f"SELECT * FROM plain UNION ALL ({EXPANDED})"
ALL_FLAGS = f"SELECT * FROM subclass_both UNION ALL SELECT * FROM eq_both UNION ALL SELECT * FROM ca UNION ALL SELECT * FROM oa UNION ALL ({EXPANDED}) UNION ALL SELECT * FROM ann_edges"

#: Calls over the role axioms of one region's nations after another; each call has a table of its own, of 16 slots up
#: to 12 axioms.
LIFECYCLE_CTES = {
    "owned": "SELECT h.*, n.n_regionkey AS call, count(*) OVER (PARTITION BY n.n_regionkey) AS size FROM hashed h JOIN nation n ON h.a = 'urn:tpch:prop#' || n.n_nationkey",
    "turns": "SELECT *, row_number() OVER (ORDER BY call, spread & (CASE WHEN size <= 12 THEN 15 ELSE 31 END), spread) AS ord FROM (SELECT *, xor(hash, hash >> 16) AS spread FROM owned)",
    "steps": "SELECT call, ord, a AS sub, b AS sup FROM turns WHERE NOT inv",
    "pointers": "SELECT x.ord AS t, max(y.ord) AS ord FROM steps x JOIN steps y ON y.sup = x.sub AND y.ord < x.ord GROUP BY x.ord",
    "calls": "SELECT DISTINCT call FROM turns",
    "ways": """SELECT c.call AS invocation, s.sup AS relation, 0 AS pos, arg_max(s.sub, s.ord) AS subrole, max(s.ord) AS t FROM calls c JOIN steps s ON s.call <= c.call GROUP BY c.call, s.sup
        UNION ALL SELECT w.invocation, w.relation, w.pos + 1, n.sub, n.ord FROM ways w JOIN pointers p ON p.t = w.t JOIN steps n ON n.ord = p.ord""",
    "backs": """SELECT c.call AS invocation, i.a AS relation, arg_max(i.b, i.ord) AS inverse
        FROM calls c JOIN (SELECT call, a, b, ord * 2 AS ord FROM turns WHERE inv UNION ALL SELECT call, b, a, ord * 2 + 1 FROM turns WHERE inv) i ON i.call <= c.call GROUP BY c.call, i.a""",
}
LIFECYCLE = ", " + ", ".join(f"{k} AS ({v})" for k, v in LIFECYCLE_CTES.items()) + " SELECT coalesce(w.invocation, b.invocation) AS invocation, coalesce(w.relation, b.relation) AS relation, b.inverse, w.pos, w.subrole FROM ways w FULL JOIN backs b ON w.invocation = b.invocation AND w.relation = b.relation"
