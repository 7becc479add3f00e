"""Column expressions on RDF nodes (N1, N2) and their text forms.

All functions return ``pyspark.sql.Column`` built from JVM-side functions,
so they fuse into whole-stage codegen with the scan that feeds them.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from kgprep.schema import BLANK, DC_NS, LITERAL, RDF_NS, URI

# One N-Triples statement: subject, predicate, object, the final dot and an
# optional trailing comment.  Groups: 1 subject, 2 predicate, 3 object, each
# in its raw text form (``<iri>``, ``_:label`` or ``"lex"@lang`` /
# ``"lex"^^<iri>``).  A literal may hold escaped quotes, ``<``, ``.`` and ``#``.
# Quantifiers inside a literal are possessive: they never give back what they
# matched, so the regex engine needs no stack however long the literal is.
_QUOTED = r'[^"\\]*+(?:\\.[^"\\]*+)*+'
NT_STATEMENT = (
    r'(?s)^\s*+(<[^>]*+>|_:\S+)\s++(<[^>]*+>)\s++'
    r'(<[^>]*+>|_:\S+|"' + _QUOTED + r'"(?:@[A-Za-z0-9-]++|\^\^<[^>]*+>)?)'
    r'\s*\.\s*+(?:#.*+)?$'
)
# The same statement with a literal's parts as groups of their own: 1 subject, 2 predicate,
# 3 object unless it is a literal, 4 lexical form, 5 language tag, 6 datatype IRI.
NT_PARTS = (
    r'(?s)^\s*+(<[^>]*+>|_:\S+)\s++(<[^>]*+>)\s++'
    r'(?:(<[^>]*+>|_:\S+)|"(' + _QUOTED + r')"(?:@([A-Za-z0-9-]++)|\^\^<([^>]*+)>)?)'
    r'\s*\.\s*+(?:#.*+)?$'
)
STATEMENT_PARTS = 6
# How far a malformed line is well-formed.
SUBJECT_START = r'(?s)^\s*+(?:<[^>]*+>|_:\S+)\s++'
PREDICATE_START = SUBJECT_START + r'<[^>]*+>\s++'
OBJECT_START = PREDICATE_START + r'(?:<[^>]*+>|_:\S|"' + _QUOTED + r'")'

# A literal's raw form: group 1 lexical form (escapes included), group 2
# language tag, group 3 datatype IRI.
NT_LITERAL = r'(?s)^"(' + _QUOTED + r')"(?:@([A-Za-z0-9-]++)|\^\^<([^>]*+)>)?$'

# A text with escapes is cut into these pieces: one escape (a surrogate pair
# counts as one), or the text between two escapes.
_PIECE = (r'(?s)\\u[dD][89abAB][0-9A-Fa-f]{2}\\u[dD][c-fC-F][0-9A-Fa-f]{2}|\\u[0-9A-Fa-f]{4}|\\U[0-9A-Fa-f]{8}'
          r'|\\.|\\$|[^\\]++')
# The one-letter escapes of N-Triples.
ESCAPES = (("t", "\t"), ("b", "\b"), ("n", "\n"), ("r", "\r"), ("f", "\f"), ('"', '"'), ("'", "'"), ("\\", "\\"))
# A numbered escape that names no character: half a surrogate pair, or beyond U+10FFFF.
_NO_CHARACTER = r'^\\u[dD][89a-fA-F]..$|^\\U(?!000[0-9A-Fa-f]|0010)|^\\U0000[dD][89a-fA-F]'

# A text whose escapes are all of N-Triples: exactly those that ``unescape`` decodes.
WELL_ESCAPED = (
    r'(?s)^(?:[^\\]++|\\[tbnrf"\'\\]|\\u[dD][89abAB][0-9A-Fa-f]{2}\\u[dD][c-fC-F][0-9A-Fa-f]{2}'
    r'|\\u(?![dD][89a-fA-F])[0-9A-Fa-f]{4}|\\U(?!0000[dD][89a-fA-F])(?:000[0-9A-Fa-f]|0010)[0-9A-Fa-f]{4})*+\z'
)

# Newline cannot occur inside a line read by the text source, so it is a
# safe separator for "replace with groups, then split": one regex pass.
_SEP = "\n"

# Prefixes compacted in readable output (fixed values).
READABLE_PREFIXES = (("rdf:", RDF_NS), ("dc:", DC_NS))


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def _pieces(raw: Column) -> Column:
    return F.regexp_extract_all(raw, F.lit(_PIECE), F.lit(0))


def _decode_piece(p: Column) -> Column:
    """The text of one piece; null for an escape that N-Triples does not have."""
    out = F.when(p.rlike(_NO_CHARACTER), F.lit(None))
    numbered = F.regexp_replace(p, r"\\[uU]", "")
    out = out.when(p.rlike(r"^\\u.{4}"), F.decode(F.unhex(numbered), "UTF-16BE"))
    out = out.when(p.rlike(r"^\\U.{8}"), F.decode(F.unhex(numbered), "UTF-32"))
    for letter, char in ESCAPES:
        out = out.when(p == "\\" + letter, F.lit(char))
    return out.when(~p.startswith("\\"), p)


def unescape(raw: Column | str) -> Column:
    """A node's text with its escapes decoded (``\\u00e9``, ``\\U0001F600``, ``\\"``, ``\\n``, ...);
    null if an escape is not one of N-Triples.  Text without a backslash is returned as it is."""
    r = _c(raw)
    decoded = F.transform(_pieces(r), _decode_piece)
    whole = F.when(F.exists(decoded, lambda p: p.isNull()), F.lit(None)).otherwise(F.array_join(decoded, ""))
    return F.when(F.instr(r, "\\") == 0, r).otherwise(whole)


def escape_literal(text: Column | str) -> Column:
    """The quoted form's inside: backslash, quote and line ends escaped."""
    t = _c(text)
    out = t
    for letter, char in (("\\", "\\"), ('"', '"'), ("n", "\n"), ("r", "\r")):
        out = F.replace(out, F.lit(char), F.lit("\\" + letter))
    return F.when(t.rlike(r'[\\\\"\n\r]'), out).otherwise(t)


def escape_iri(iri: Column | str) -> Column:
    """Characters that an IRI may not hold in N-Triples as numbered escapes."""
    t = _c(iri)
    out = t
    for code in (0x5C, *range(0x21), *map(ord, '<>"{}|^`')):
        out = F.replace(out, F.lit(chr(code)), F.lit(f"\\u{code:04X}"))
    return F.when(t.rlike(r'[\x00-\x20<>"{}|^`\\\\]'), out).otherwise(t)


def split_statement(line: Column | str) -> Column:
    """Array ``[s_raw, p_raw, o_raw]`` for a well-formed line, else a 1-element array."""
    return F.split(F.regexp_replace(_c(line), NT_STATEMENT, f"$1{_SEP}$2{_SEP}$3"), _SEP)


def statement_parts(line: Column | str) -> Column:
    """Array ``[s, p, o, lexical, language, datatype]`` for a well-formed line, else a 1-element array.

    ``s``, ``p`` and ``o`` are in raw form; ``o`` is empty for a literal, the last three for any
    other object.  One regex pass, where ``split_statement`` needs a second for the literal.
    """
    return F.split(F.regexp_replace(_c(line), NT_PARTS, _SEP.join(f"${i + 1}" for i in range(STATEMENT_PARTS))), _SEP)


def is_skippable(line: Column | str) -> Column:
    """Empty lines and comment lines carry no triple."""
    t = F.trim(_c(line))
    return (t == "") | t.startswith("#")


def node_kind(raw: Column | str) -> Column:
    """``uri`` / ``blank`` / ``literal`` from a node's raw N-Triples text."""
    r = _c(raw)
    return (F.when(r.startswith("<"), F.lit(URI))
            .when(r.startswith("_:"), F.lit(BLANK))
            .otherwise(F.lit(LITERAL)))


def node_value(raw: Column | str) -> Column:
    """IRIs lose their angle brackets; blank labels stay ``_:label``;
    literals become their lexical form.  Escapes are decoded."""
    r = _c(raw)
    return (F.when(r.startswith("<"), unescape(r.substr(F.lit(2), F.length(r) - 2)))
            .when(r.startswith("_:"), r)
            .otherwise(unescape(F.get(literal_parts(r), 0))))


def literal_parts(raw: Column | str) -> Column:
    """Array ``[lexical, language, datatype]`` of a raw literal ('' when absent);
    the lexical form still has its escapes."""
    return F.split(F.regexp_replace(_c(raw), NT_LITERAL, f"$1{_SEP}$2{_SEP}$3"), _SEP)


def compact(uri: Column | str) -> Column:
    """Replace the rdf: and dc: namespaces by their prefixes."""
    out = _c(uri)
    for prefix, ns in READABLE_PREFIXES:
        out = F.when(out.startswith(ns),
                     F.concat(F.lit(prefix), out.substr(F.lit(len(ns) + 1), F.length(out)))).otherwise(out)
    return out


def literal_text(lex: Column | str, lang: Column | str, datatype: Column | str) -> Column:
    """``"lex"@lang``, ``"lex"^^datatype`` or ``"lex"`` (readable form, one line)."""
    quoted = F.concat(F.lit('"'), escape_literal(lex), F.lit('"'))
    return (F.when(_c(lang).isNotNull(), F.concat(quoted, F.lit("@"), _c(lang)))
            .when(_c(datatype).isNotNull(), F.concat(quoted, F.lit("^^"), _c(datatype)))
            .otherwise(quoted))


def readable_node(value: Column | str, kind: Column | str, lang: Column | str | None = None,
                  datatype: Column | str | None = None) -> Column:
    """A node in the readable triple layout: compacted IRI, blank label or literal."""
    v, k = _c(value), _c(kind)
    lit = literal_text(v, lang if lang is not None else F.lit(None).cast("string"),
                       datatype if datatype is not None else F.lit(None).cast("string"))
    return F.when(k == URI, compact(v)).when(k == BLANK, v).otherwise(lit)


def nt_node(value: Column | str, kind: Column | str, lang: Column | str | None = None,
            datatype: Column | str | None = None) -> Column:
    """A node rendered back as N-Triples text."""
    v, k = _c(value), _c(kind)
    quoted = F.concat(F.lit('"'), escape_literal(v), F.lit('"'))
    lit = quoted
    if lang is not None and datatype is not None:
        lit = (F.when(_c(lang).isNotNull(), F.concat(quoted, F.lit("@"), _c(lang)))
               .when(_c(datatype).isNotNull(), F.concat(quoted, F.lit("^^<"), escape_iri(datatype), F.lit(">")))
               .otherwise(quoted))
    return (F.when(k == URI, F.concat(F.lit("<"), escape_iri(v), F.lit(">")))
            .when(k == BLANK, v).otherwise(lit))


def nt_line(df_cols: dict[str, Column | str] | None = None) -> Column:
    """``<s> <p> o .`` for a TRIPLE-shaped row."""
    c = df_cols or {}
    g = lambda n: _c(c.get(n, n))
    return F.concat_ws(" ", nt_node(g("s"), g("s_kind")), F.concat(F.lit("<"), escape_iri(g("p")), F.lit(">")),
                       nt_node(g("o"), g("o_kind"), g("o_lang"), g("o_datatype")), F.lit("."))
