"""Row types, constructor numbers and fixed names."""

from __future__ import annotations

from pyspark.sql.types import StructType

PROP = "struct<iri:string,inverse:boolean,chain:boolean,canon:binary>"
OPERAND = f"struct<tag:int,iri:string,prop:{PROP},card:bigint,filler_tag:int,filler_iri:string,canon:binary>"
EXPR = f"struct<tag:int,iri:string,prop:{PROP},card:bigint,filler_tag:int,filler_iri:string,canon:binary,operands:array<{OPERAND}>>"
IND = "struct<iri:string,anon:binary,label:string>"
VALUE = "struct<kind:string,iri:string,anon:binary,label:string,lexical:string,datatype:string,lang:string>"
#: A value is an IRI, the local key of an anonymous individual, or a literal.
ANNOTATIONS = "array<struct<prop:string,iri:string,key:string,lexical:string>>"

#: Columns that each kind of axiom has besides HEAD.
HEAD = "doc_id string, canon binary, anons array<binary>"
KINDS = {
    "SubClassOf": f"sub {EXPR}, sup {EXPR}",
    "EquivalentClasses": f"exprs array<{EXPR}>",
    "SubObjectPropertyOf": f"p1 {PROP}, p2 {PROP}, ann {ANNOTATIONS}",
    "InverseObjectProperties": f"p1 {PROP}, p2 {PROP}, ann {ANNOTATIONS}",
    "ObjectPropertyDomain": f"p1 {PROP}, sub {EXPR}",
    "ObjectPropertyRange": f"p1 {PROP}, sub {EXPR}",
    "ClassAssertion": f"sub {EXPR}, i1 {IND}",
    "ObjectPropertyAssertion": f"p1 {PROP}, i1 {IND}, i2 {IND}",
    "AnnotationAssertion": f"prop string, subject string, value {VALUE}",
    "Other": "kind string, root_kind int",
}
DOCUMENTS = "doc_id string, imports array<string>, is_root boolean"
ENTITIES = "doc_id string, kind string, iri string"
EDGE = "source string, relation string, destination string"


def schema_of(kind: str) -> StructType:
    return StructType.fromDDL(f"{HEAD}, {KINDS[kind]}")


# Constructor numbers of expressions and axioms.
IRI, ENTITY, ANON, LITERAL, ANNOTATION, INVERSE_OF, CHAIN = 1, 2, 3, 4, 5, 10, 11
AND, OR, SOME, ALL, MIN, MAX = 30, 31, 34, 35, 38, 39
EXACT, HAS_VALUE, HAS_SELF = 40, 36, 37
AXIOM_TAGS = {
    "Declaration": 60, "SubClassOf": 61, "EquivalentClasses": 62, "SubObjectPropertyOf": 70, "InverseObjectProperties": 73,
    "ObjectPropertyDomain": 74, "ObjectPropertyRange": 75, "ClassAssertion": 112, "ObjectPropertyAssertion": 113, "AnnotationAssertion": 120,
}
#: Order of class expressions inside n-ary axioms, by constructor.
EXPRESSION_ORDER = {ENTITY: 1001, AND: 3001, OR: 3002, SOME: 3005, ALL: 3006, MIN: 3008, MAX: 3010}
OTHER_EXPRESSION = 3999

# Relations and namespaces.
SUBCLASS_OF = "http://subclassof"
SUPERCLASS_OF = "http://superclassof"
RDF_TYPE = "http://type"
OWL_THING = "http://www.w3.org/2002/07/owl#Thing"
RDFS = "http://www.w3.org/2000/01/rdf-schema#"
XSD = "http://www.w3.org/2001/XMLSchema#"
XSD_STRING = XSD + "string"
PLAIN_LITERAL = "http://www.w3.org/1999/02/22-rdf-syntax-ns#PlainLiteral"

# Kinds of axiom that emit nothing and are counted as skipped.
SKIPPED = (
    "EquivalentObjectProperties", "DisjointObjectProperties", "FunctionalObjectProperty", "InverseFunctionalObjectProperty",
    "ReflexiveObjectProperty", "IrreflexiveObjectProperty", "SymmetricObjectProperty", "AsymmetricObjectProperty",
    "TransitiveObjectProperty", "SubDataPropertyOf", "EquivalentDataProperties", "DisjointDataProperties", "DataPropertyDomain",
    "DataPropertyRange", "FunctionalDataProperty", "DatatypeDefinition", "HasKey", "DisjointClasses", "DisjointUnion",
    "SameIndividual", "DifferentIndividuals", "NegativeObjectPropertyAssertion", "DataPropertyAssertion",
    "NegativeDataPropertyAssertion", "SubAnnotationPropertyOf", "AnnotationPropertyDomain", "AnnotationPropertyRange",
)

# Annotation properties that become edges.
ANNOTATION_PROPERTIES = (
    "http://www.w3.org/2000/01/rdf-schema#label",
    "http://www.w3.org/2004/02/skos/core#prefLabel",
    "rdfs:label",
    "rdfs:comment",
    "http://purl.obolibrary.org/obo/IAO_0000111",
    "http://purl.obolibrary.org/obo/IAO_0000589",
    "http://www.geneontology.org/formats/oboInOwl#hasRelatedSynonym",
    "http://www.geneontology.org/formats/oboInOwl#hasExactSynonym",
    "http://www.geneontology.org/formats/oboInOWL#hasExactSynonym",
    "http://purl.bioontology.org/ontology/SYN#synonym",
    "http://scai.fraunhofer.de/CSEO#Synonym",
    "http://purl.obolibrary.org/obo/synonym",
    "http://ncicb.nci.nih.gov/xml/owl/EVS/Thesaurus.owl#FULL_SYN",
    "http://www.ebi.ac.uk/efo/alternative_term",
    "http://ncicb.nci.nih.gov/xml/owl/EVS/Thesaurus.owl#Synonym",
    "http://bioontology.org/projects/ontologies/fma/fmaOwlDlComponent_2_0#Synonym",
    "http://www.geneontology.org/formats/oboInOwl#hasDefinition",
    "http://bioontology.org/projects/ontologies/birnlex#preferred_label",
    "http://bioontology.org/projects/ontologies/birnlex#synonyms",
    "http://www.w3.org/2004/02/skos/core#altLabel",
    "https://cfpub.epa.gov/ecotox#latinName",
    "https://cfpub.epa.gov/ecotox#commonName",
    "https://www.ncbi.nlm.nih.gov/taxonomy#scientific_name",
    "https://www.ncbi.nlm.nih.gov/taxonomy#synonym",
    "https://www.ncbi.nlm.nih.gov/taxonomy#equivalent_name",
    "https://www.ncbi.nlm.nih.gov/taxonomy#genbank_synonym",
    "https://www.ncbi.nlm.nih.gov/taxonomy#common_name",
    "http://purl.obolibrary.org/obo/IAO_0000118",
    "http://www.w3.org/2000/01/rdf-schema#comment",
    "http://www.geneontology.org/formats/oboInOwl#hasDbXref",
    "http://purl.org/dc/elements/1.1/description",
    "http://purl.org/dc/terms/description",
    "http://purl.org/dc/elements/1.1/title",
    "http://purl.org/dc/terms/title",
    "http://purl.obolibrary.org/obo/IAO_0000115",
    "http://purl.obolibrary.org/obo/IAO_0000600",
    "http://purl.obolibrary.org/obo/IAO_0000602",
    "http://purl.obolibrary.org/obo/IAO_0000601",
    "http://www.geneontology.org/formats/oboInOwl#hasOBONamespace",
)
