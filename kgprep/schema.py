"""Fixed schemas (positional, headerless inputs are never inferred)."""

from pyspark.sql import types as T

S = T.StringType()
L = T.LongType()

# Parsed graph: one row per triple, bag semantics.
TRIPLE = T.StructType([
    T.StructField("s", S), T.StructField("s_kind", S),
    T.StructField("p", S),
    T.StructField("o", S), T.StructField("o_kind", S),
    T.StructField("o_lang", S), T.StructField("o_datatype", S),
])

QUAD = T.StructType([T.StructField(c, S) for c in ("s", "p", "o", "language")])
LINK = T.StructType([T.StructField(c, S) for c in ("s", "p", "o")])
ENTITY_DICT = T.StructType([T.StructField("entity", S), T.StructField("id", L)])
RELATION_DICT = T.StructType([T.StructField("relation", S), T.StructField("id", L)])
ENCODED = T.StructType([T.StructField(c, L) for c in ("s", "p", "o")])

URI, BLANK, LITERAL = "uri", "blank", "literal"

# Fixed vocabulary values.
OWL_SAME_AS = "http://www.w3.org/2002/07/owl#sameAs"
RDF_NS = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
DC_NS = "http://purl.org/dc/elements/1.1/"
XSD_DATE = "http://www.w3.org/2001/XMLSchema#date"
