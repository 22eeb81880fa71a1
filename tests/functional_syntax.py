"""Reads small documents in OWL functional syntax into views: the part of it that tests use."""

import re

from ontoloom import schema as S
from ontoloom.functions import canon as C
from ontoloom.sources.views import Ontology

TOKEN = re.compile(r'"(?:[^"\\]|\\.)*"(?:\^\^\S+?(?=[\s)])|@[\w-]+)?|<[^>]*>|[()=]|[^\s()=<>"]+')
PREFIXES = {"xsd": S.XSD, "rdfs": S.RDFS, "owl": "http://www.w3.org/2002/07/owl#", "skos": "http://www.w3.org/2004/02/skos/core#"}
RESTRICTIONS = {
    "ObjectSomeValuesFrom": S.SOME, "ObjectAllValuesFrom": S.ALL, "ObjectMinCardinality": S.MIN, "ObjectMaxCardinality": S.MAX,
    "ObjectExactCardinality": S.EXACT, "ObjectHasValue": S.HAS_VALUE, "ObjectHasSelf": S.HAS_SELF, "DataSomeValuesFrom": 43,
}
JOINS = {"ObjectIntersectionOf": S.AND, "ObjectUnionOf": S.OR}
ENTITY_KINDS = {"Class": "class", "ObjectProperty": "object_property", "NamedIndividual": "named_individual", "DataProperty": "data_property"}


class Reader:
    """One document: ``axioms`` by kind as rows of the schema, ``entities``, and what it imports."""

    def __init__(self, doc_id, text, namespace="urn:t#"):
        self.doc_id, self.namespace, self.axioms, self.entities, self.imports = doc_id, namespace, {}, [], []
        self.tokens = TOKEN.findall(text)
        self.at = 0
        while self.at < len(self.tokens):
            self.add(self.term())

    def term(self):
        """A name or literal, or a list: a name and its arguments."""
        head = self.tokens[self.at]
        self.at += 1
        if self.at == len(self.tokens) or self.tokens[self.at] != "(":
            return head
        self.at += 1
        out = [head]
        while self.tokens[self.at] != ")":
            out.append(self.term())
        self.at += 1
        return out

    def iri(self, name):
        if name.startswith("<"):
            return name[1:-1]
        prefix, _, rest = name.partition(":")
        return (PREFIXES[prefix] if prefix else self.namespace) + rest

    def prop(self, term):
        if isinstance(term, str):
            return {"iri": self.iri(term), "inverse": False, "chain": False, "canon": C.prop(self.iri(term))}
        if term[0] == "ObjectInverseOf":
            return {"iri": self.iri(term[1]), "inverse": True, "chain": False, "canon": C.prop(self.iri(term[1]), True)}
        return {"iri": None, "inverse": False, "chain": True, "canon": C.node(S.CHAIN, *(C.sub(self.prop(p)["canon"]) for p in term[1:]))}

    def expr(self, term):
        blank = {"tag": None, "iri": None, "prop": None, "card": None, "filler_tag": None, "filler_iri": None, "operands": None}
        if isinstance(term, str):
            return blank | {"tag": S.ENTITY, "iri": self.iri(term), "canon": C.named_class(self.iri(term))}
        if term[0] in JOINS:
            inner = [self.expr(t) for t in term[1:]]
            return blank | {"tag": JOINS[term[0]], "operands": inner, "canon": C.node(JOINS[term[0]], C.members(x["canon"] for x in inner))}
        tag, rest = RESTRICTIONS[term[0]], term[1:]
        card = int(rest.pop(0)) if "Cardinality" in term[0] else None
        prop = self.prop(rest[0])
        if term[0] in ("ObjectHasValue", "ObjectHasSelf", "DataSomeValuesFrom"):
            return blank | {"tag": tag, "prop": prop, "canon": C.node(tag, C.sub(prop["canon"]), C.text(" ".join(rest[1:])))}
        filler = self.expr(rest[1]) if len(rest) > 1 else self.expr(f"<{S.OWL_THING}>")
        raw = C.node(tag, *([] if card is None else [C.integer(card)]), C.sub(prop["canon"]), C.sub(filler["canon"]))
        return blank | {"tag": tag, "prop": prop, "card": card, "filler_tag": filler["tag"], "filler_iri": filler["iri"], "canon": raw}

    def individual(self, name):
        if name.startswith("_:"):
            raw = C.anonymous(b"scope", name[2:])
            return {"iri": None, "anon": raw, "label": name}, raw, [raw]
        return {"iri": self.iri(name), "anon": None, "label": None}, C.individual(self.iri(name)), []

    def value(self, token):
        blank = {"kind": "literal", "iri": None, "anon": None, "label": None, "lexical": None, "datatype": None, "lang": None}
        if not token.startswith('"'):
            return blank | {"kind": "iri", "iri": self.iri(token)}, C.iri(self.iri(token))
        end = token.rindex('"')
        text, tail = re.sub(r"\\(.)", r"\1", token[1:end]), token[end + 1 :]
        datatype = self.iri(tail[2:]) if tail.startswith("^^") else S.PLAIN_LITERAL if tail else S.XSD_STRING
        lang = tail[1:] if tail.startswith("@") else None
        return blank | {"lexical": text, "datatype": datatype, "lang": lang}, C.literal(text, datatype, lang)

    def add(self, term):
        kind, rest = term[0], [t for t in term[1:] if t[0] != "Annotation"]
        notes = [self.note(t) for t in term[1:] if t[0] == "Annotation"]
        marks = [C.annotation(n["prop"], C.literal(n["lexical"], S.XSD_STRING)) for n in notes]
        anons = []
        if kind == "Import":
            self.imports.append(rest[0][1:-1])
            return
        if kind == "Declaration":
            self.entities.append((self.doc_id, ENTITY_KINDS[rest[0][0]], self.iri(rest[0][1])))
            return
        if kind == "SubClassOf":
            a, b = map(self.expr, rest)
            fields, parts = {"sub": a, "sup": b}, [a["canon"], b["canon"]]
        elif kind == "EquivalentClasses":
            inner = [self.expr(t) for t in rest]
            fields, parts = {"exprs": inner}, sorted(x["canon"] for x in inner)
        elif kind in ("SubObjectPropertyOf", "InverseObjectProperties"):
            a, b = map(self.prop, rest)
            fields, parts = {"p1": a, "p2": b, "ann": notes}, [a["canon"], b["canon"]]
        elif kind in ("ObjectPropertyDomain", "ObjectPropertyRange"):
            p, e = self.prop(rest[0]), self.expr(rest[1])
            fields, parts = {"p1": p, "sub": e}, [p["canon"], e["canon"]]
        elif kind == "ClassAssertion":
            e = self.expr(rest[0])
            i, raw, anons = self.individual(rest[1])
            fields, parts = {"sub": e, "i1": i}, [e["canon"], raw]
        elif kind == "ObjectPropertyAssertion":
            p = self.prop(rest[0])
            (a, x, u), (b, y, v) = map(self.individual, rest[1:])
            fields, parts, anons = {"p1": p, "i1": a, "i2": b}, [p["canon"], x, y], u + v
        elif kind == "AnnotationAssertion":
            value, raw = self.value(rest[2])
            fields = {"prop": self.iri(rest[0]), "subject": self.iri(rest[1]), "value": value}
            parts = [C.entity("annotation_property", fields["prop"]), C.iri(fields["subject"]), raw]
        else:
            self.row("Other", [], canon=C.node(110, C.text(repr(term))), kind=kind, root_kind=2)
            return
        self.row(kind, anons, canon=C.axiom(kind, *parts, annotations=marks), **fields)

    def note(self, term):
        return {"prop": self.iri(term[1]), "iri": None, "key": None, "lexical": self.value(term[2])[0]["lexical"]}

    def row(self, axiom, anons, **fields):
        values = {"doc_id": self.doc_id, "anons": anons} | fields
        self.axioms.setdefault(axiom, []).append(tuple(values.get(f.name) for f in S.schema_of(axiom)))


def read(spark, texts, root="root"):
    """A view of documents by name."""
    docs = [Reader(name, text) for name, text in texts.items()]
    kinds = sorted({k for d in docs for k in d.axioms})
    frames = {k: spark.createDataFrame([r for d in docs for r in d.axioms.get(k, [])], S.schema_of(k)) for k in kinds}
    documents = spark.createDataFrame([(d.doc_id, d.imports, d.doc_id == root) for d in docs], S.DOCUMENTS)
    return Ontology(spark, frames, documents, spark.createDataFrame([e for d in docs for e in d.entities], S.ENTITIES))
