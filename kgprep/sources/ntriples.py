"""N-Triples scans.

Lines are read by Spark's text source, which splits plain files by byte
range and bz2 files by block (Hadoop's bzip2 codec is splittable), so a big
compressed dump is read by many tasks and never passes through the driver.
Parsing is one regex per line, fused into the scan's codegen stage.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kgprep.functions.nodes import STATEMENT_PARTS, WELL_ESCAPED, is_skippable, node_kind, statement_parts, unescape

FAILFAST, DROPMALFORMED, PERMISSIVE = "FAILFAST", "DROPMALFORMED", "PERMISSIVE"
CORRUPT = "_corrupt_record"
TRIPLE_COLUMNS = ["s", "s_kind", "p", "o", "o_kind", "o_lang", "o_datatype"]


def parse_ntriples(lines: DataFrame, mode: str = FAILFAST, uri_subjects_only: bool = False,
                   value_col: str = "value", keep: Sequence[str] = (),
                   blank_scope: Column | None = None, keep_skipped: bool = False) -> DataFrame:
    """Parse a DataFrame of N-Triples lines into the TRIPLE layout.

    ``mode``: FAILFAST raises on the first malformed line, DROPMALFORMED drops
    it, PERMISSIVE keeps it with null fields and the line in ``_corrupt_record``.
    Escapes are decoded, so ``<http://x/\\u00e9>`` and ``<http://x/é>`` are one
    node; an escape that N-Triples does not have makes a line malformed.
    ``uri_subjects_only`` keeps only lines starting with ``<`` before parsing
    (drops comments and blank-node subjects).  ``blank_scope`` (a string
    column, e.g. the file path) is folded into blank labels, as a hash, so
    equal labels from different files stay different nodes.  ``keep`` columns
    are carried through unchanged.  ``keep_skipped`` (PERMISSIVE only) keeps empty and
    comment lines too, as rows of nulls.
    """
    mode = mode.upper()
    if mode not in (FAILFAST, DROPMALFORMED, PERMISSIVE):
        raise ValueError(f"unknown mode {mode!r}")
    line = F.col(value_col)
    extra = [blank_scope.alias("_bscope")] if blank_scope is not None else []
    scope = ["_bscope"] if extra else []
    # The statement regex must run once per line, and the line expression
    # itself once.  A filter on either would be pushed below the projection
    # (and into every branch of a union feeding it) with the expression
    # inlined.  So the regex runs in one projection, and skipping, dropping
    # and failing are decided by a generator on top of it: each line
    # explodes into a 0- or 1-element array.  It is a CASE of expressions that
    # all have codegen, escapes included (a regex; ``transform`` has none), and
    # each of them stands in it once.
    if uri_subjects_only:
        # a prefix test on the raw line, before any regex (filter before parse)
        lines = lines.where(line.startswith("<"))
    df = lines.select(*keep, *extra, line.alias("_line"), statement_parts(line).alias("_split"))
    parts, text = F.col("_split"), F.col("_line")
    drop = is_skippable(text)
    ok = (F.size(parts) == STATEMENT_PARTS) & (
        (F.instr(text, "\\") == 0) | F.array_join(parts, " ").rlike(WELL_ESCAPED))
    none = F.array().cast("array<array<string>>")
    if mode == FAILFAST:
        one = F.when(drop, none).when(ok, F.array(parts)).otherwise(F.raise_error(
            F.concat(F.lit("malformed N-Triples line: "), text)).cast("array<array<string>>"))
    elif mode == DROPMALFORMED:
        one = F.when(drop, none).when(ok, F.array(parts)).otherwise(none)
    else:
        skipped = F.array(F.array().cast("array<string>")) if keep_skipped else none
        one = F.when(drop, skipped).when(ok, F.array(parts)).otherwise(F.array(F.array(text)))
    df = df.select(*keep, *scope, "_line", F.explode(one).alias("_parts"))
    part = [F.get(F.col("_parts"), i) for i in range(STATEMENT_PARTS)]
    if mode == PERMISSIVE:
        # only here are there rows without a statement
        whole = F.size("_parts") == STATEMENT_PARTS
        bad = (F.size("_parts") == 1) & part[0].isNotNull()
        corrupt = [F.when(bad, F.col("_line")).alias(CORRUPT)]
        part = [F.when(whole, x) for x in part]
    else:
        corrupt = []
    df = df.select(*keep, *scope, (F.instr("_line", "\\") > 0).alias("_escaped"),
                   *[x.alias(f"_{name}") for name, x in zip(("s", "p", "o", "lex", "lang", "type"), part)], *corrupt)

    def decoded(x: Column) -> Column:
        return F.when(F.col("_escaped"), unescape(x)).otherwise(x)

    def iri(raw: str) -> Column:
        return decoded(F.substring(F.substring_index(raw, ">", 1), 2, 1 << 30))  # no ``>`` is inside

    def node(raw: str) -> Column:
        r = F.col(raw)
        label = F.concat(F.lit("_:"), _scope_tag(F.col("_bscope")), F.lit("_"), F.substring(r, 3, 1 << 30)) if extra else r
        return F.when(r.startswith("<"), iri(raw)).when(r.startswith("_:"), label)

    return df.select(
        *keep,
        node("_s").alias("s"),
        F.when(F.col("_s").isNotNull(), node_kind("_s")).alias("s_kind"),
        iri("_p").alias("p"),
        F.when(F.col("_o") == "", decoded(F.col("_lex"))).otherwise(node("_o")).alias("o"),
        F.when(F.col("_o").isNotNull(), node_kind("_o")).alias("o_kind"),
        F.nullif(F.col("_lang"), F.lit("")).alias("o_lang"),
        F.nullif(F.col("_type"), F.lit("")).alias("o_datatype"),
        *([CORRUPT] if corrupt else []))


def _scope_tag(scope: Column) -> Column:
    # Short stable tag of the source file; hashed only where a blank node is.
    return F.substring(F.sha2(scope, 256), 1, 16)


def read_ntriples(spark: SparkSession, paths: str | Iterable[str], mode: str = FAILFAST,
                  uri_subjects_only: bool = False, scope_blank_nodes: bool = True) -> DataFrame:
    """Scan N-Triples files (plain or ``.bz2``; globs allowed) into one graph."""
    paths = [paths] if isinstance(paths, str) else list(paths)
    lines = spark.read.text(paths)
    if not scope_blank_nodes:
        return parse_ntriples(lines, mode=mode, uri_subjects_only=uri_subjects_only)
    lines = lines.select("value", F.col("_metadata.file_path").alias("_path"))
    return parse_ntriples(lines, mode=mode, uri_subjects_only=uri_subjects_only, blank_scope=F.col("_path"))


def _path_parts(path: Column, suffix: str) -> Column:
    """Array ``[language, dataset]`` of ``<language>/<dataset>_<language><suffix>``, a
    file or a Hadoop output directory of that name; a path that does not fit raises."""
    quoted = re.sub(r"([^A-Za-z0-9_])", r"\\\1", suffix)
    parts = F.split(F.regexp_replace(path, rf"^.*/([^/]+)/([^/]+)_\1{quoted}(?:/[^/]+)?$", "$1\n$2"), "\n")
    return F.when(F.size(parts) == 2, parts).otherwise(F.raise_error(F.concat(
        F.lit("not a <language>/<dataset>_<language> path: "), path)).cast("array<string>"))


def read_language_datasets(spark: SparkSession, root: str, languages: Sequence[str] | None = None,
                           datasets: Sequence[str] | None = None, suffix: str = ".ttl.bz2",
                           mode: str = FAILFAST, uri_subjects_only: bool = True,
                           scope_blank_nodes: bool = True) -> DataFrame:
    """One scan over a ``<lang>/<dataset>_<lang>`` tree, whitelisted.

    Files that do not exist are simply not matched by the glob; the
    whitelist is applied on the path-derived ``language``/``dataset`` columns
    (and narrows the glob), so all languages and datasets are one union-all
    scan carrying those two columns.  As in the language jobs, only lines
    starting with ``<`` are parsed by default.
    """
    def alt(values: Sequence[str] | None) -> str:
        if not values:
            return "*"
        vals = sorted(set(values))
        return vals[0] if len(vals) == 1 else "{" + ",".join(vals) + "}"

    glob = f"{root.rstrip('/')}/{alt(languages)}/{alt(datasets)}_*{suffix}"
    # what the path says is worked out once per line, from the path alone
    raw = spark.read.text(glob).select(
        "value", F.col("_metadata.file_path").alias("_path"),
        _path_parts(F.col("_metadata.file_path"), suffix).alias("_of"))
    raw = raw.select("value", "_path", F.get("_of", 0).alias("language"), F.get("_of", 1).alias("dataset"))
    if languages:
        raw = raw.where(F.col("language").isin(list(languages)))
    if datasets:
        raw = raw.where(F.col("dataset").isin(list(datasets)))
    return parse_ntriples(raw, mode=mode, uri_subjects_only=uri_subjects_only, keep=("language", "dataset"),
                          blank_scope=F.col("_path") if scope_blank_nodes else None)
