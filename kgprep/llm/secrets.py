"""Secret scans: three fixed patterns, and a randomness test battery over long tokens.

The patterns give the base spans.  The battery looks at every run of
``[A-Za-z0-9+/_-]`` of ``MIN_TOKEN`` characters or more.  The token's
encoding is inferred from its characters, and three tests ask whether it
could be a uniform draw from that encoding's alphabet: chi-squared
uniformity of the symbol counts, the number of runs above and below the
middle of the alphabet, and the lag-1 serial correlation.  Their squared z
scores are added and compared with the chi-squared quantile of three
degrees of freedom.

Being consistent with randomness is not enough for a span (short tokens are
consistent with anything), so each token also gets a p-value for being
ordinary text: symbols drawn with the frequencies that all tokens of the
corpus show.  By Markov's inequality the likelihood ratio of the uniform
draw bounds it: p <= exp(-ratio), smaller the longer the token.  The
Benjamini-Hochberg rule then runs in each length class over all tokens of
the corpus, on counts per binned p-value.

All of it is DataFrame functions.  Texts are scanned where they are; only
texts with a match are worked on further, once per distinct text.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kgprep.llm.common import broadcast_if_small, text_key, written

# Fixed patterns of the base kinds, in the order in which kinds are listed.
ASSIGN = (r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = r"AKIA[A-Z0-9]+"
HEX_RUN = r"[0-9a-f]{24,}"  # a maximal run of [0-9a-f] with 24 characters or more
KINDS = ("assign", "access", "hex", "random")
MIN_ASSIGN_VALUE, MIN_ACCESS = 6, 20

MIN_TOKEN = 16
TOKEN = rf"[A-Za-z0-9+/_-]{{{MIN_TOKEN},}}"
# Fixed alphabets, smallest first: (name, pattern that a token must match, symbols in order).
DIGITS, LOWER, UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ENCODINGS = (
    ("hex", "^[0-9a-f]+$", DIGITS + "abcdef"),
    ("hex_upper", "^[0-9A-F]+$", DIGITS + "ABCDEF"),
    ("base32", "^[A-Z2-7]+$", UPPER + "234567"),
    ("base36", "^[0-9a-z]+$", DIGITS + LOWER),
    ("base36_upper", "^[0-9A-Z]+$", DIGITS + UPPER),
    ("base62", "^[0-9A-Za-z]+$", DIGITS + UPPER + LOWER),
    ("base64_url", "^[0-9A-Za-z_-]+$", UPPER + LOWER + DIGITS + "-_"),
    ("base64", "", UPPER + LOWER + DIGITS + "+/_-"),
)
SYMBOLS = UPPER + LOWER + DIGITS + "+/_-"

CHI2_3_999 = 16.266  # 99.9 % quantile, three degrees of freedom
FALSE_DISCOVERY_RATE = 1e-3
BINS_PER_DECADE, MAX_DECADES = 4, 60
BROADCAST_BYTES = 16 << 20


def _pieces(kind: str, text: Column, pattern: str, value_group: int = 0) -> Column:
    """Pieces between matches, the matches, and the group whose length counts; empty without a match."""
    none = F.array().cast("array<string>")
    has = text.rlike(pattern)
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(value_group)) if value_group else whole
    return F.struct(F.lit(kind).alias("kind"), F.when(has, F.split(text, pattern)).otherwise(none).alias("between"),
                    F.when(has, whole).otherwise(none).alias("match"), F.when(has, value).otherwise(none).alias("value"))


def pattern_matches(docs: DataFrame) -> DataFrame:
    """Every match in every distinct text: t1, t2, kind, start, stop (code points), match, value.

    ``split`` gives what lies between the matches that ``regexp_extract_all``
    gives, so a match starts behind the summed lengths of all before it.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    any_kind = text.rlike("|".join((ASSIGN, ACCESS, HEX_RUN, TOKEN)))
    t1, t2 = text_key(text)
    found = docs.where(any_kind).select(text.alias("text"), t1.alias("t1"), t2.alias("t2"))
    # copies of a text are scanned once; their rows combine before the shuffle
    found = found.groupBy("t1", "t2").agg(F.first("text").alias("text"))
    kinds = F.array(_pieces("assign", F.col("text"), ASSIGN, 1), _pieces("access", F.col("text"), ACCESS),
                    _pieces("hex", F.col("text"), HEX_RUN), _pieces("random", F.col("text"), TOKEN))
    found = found.select("t1", "t2", F.explode(kinds).alias("k"))
    found = found.select("t1", "t2", "k.kind", F.posexplode(F.arrays_zip("k.between", "k.match", "k.value"))
                         .alias("nth", "m"))
    ahead = Window.partitionBy("t1", "t2", "kind").orderBy("nth").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    size = F.char_length("m.match")
    stop = F.sum(F.char_length("m.between") + F.coalesce(size, F.lit(0))).over(ahead)
    return (found.select("t1", "t2", "kind", "m", stop.cast("bigint").alias("stop"))
            .where(F.col("m.match").isNotNull())
            .select("t1", "t2", "kind", (F.col("stop") - size).alias("start"), "stop",
                    F.col("m.match").alias("match"), F.col("m.value").alias("value")))


def encoding_of(token: Column) -> Column:
    """Index in ENCODINGS of the smallest alphabet that holds the token."""
    out = F.lit(len(ENCODINGS) - 1)
    for i in range(len(ENCODINGS) - 2, -1, -1):
        out = F.when(token.rlike(ENCODINGS[i][1]), F.lit(i)).otherwise(out)
    return out


def battery(tokens: DataFrame) -> DataFrame:
    """Adds encoding, z_chi2, z_runs, z_serial and ``looks_random`` to rows with ``match``."""
    symbols = F.get(F.array(*[F.lit(s) for _, _, s in ENCODINGS]), F.col("encoding"))
    rows = tokens.withColumn("encoding", encoding_of(F.col("match")))
    rows = rows.withColumn("_alphabet", symbols)
    rows = rows.withColumn("_x", F.transform(F.split("match", ""), lambda c: F.instr(F.col("_alphabet"), c) - 1))
    rows = rows.withColumn("_k", F.char_length("_alphabet").cast("double")).withColumn(
        "_n", F.size("_x").cast("double"))
    zero = F.lit(0.0)

    def total(values: Column) -> Column:
        return F.aggregate(values, zero, lambda a, v: a + v)

    squares = total(F.transform(F.array_distinct("_x"),
                                lambda s: F.pow(F.size(F.filter("_x", lambda v: v == s)).cast("double"), F.lit(2.0))))
    upper = F.transform("_x", lambda v: F.when(2 * v >= F.col("_k"), 1).otherwise(0))
    middle, variance = (F.col("_k") - 1) / 2, (F.col("_k") * F.col("_k") - 1) / 12
    centred = F.transform("_x", lambda v: v - middle)

    def pairs(values: Column, combine) -> Column:
        ahead = F.slice(values, F.lit(2), F.size(values))
        return total(F.zip_with(F.slice(values, F.lit(1), F.size(values) - 1), ahead, combine))

    chi2 = F.col("_k") / F.col("_n") * squares - F.col("_n")
    spread = F.sqrt(2 * (F.col("_k") - 1) * (1 - 1 / F.col("_n")))
    changes = pairs(upper, lambda a, b: F.when(a != b, F.lit(1.0)).otherwise(F.lit(0.0)))
    products = pairs(centred, lambda a, b: a * b)
    steps = F.col("_n") - 1
    rows = rows.withColumns({
        "z_chi2": (chi2 - (F.col("_k") - 1)) / spread,
        "z_runs": (changes - steps / 2) / F.sqrt(steps / 4),
        "z_serial": products / variance / F.sqrt(steps),
    })
    z2 = sum((F.pow(F.col(z), F.lit(2.0)) for z in ("z_runs", "z_serial")), F.pow(F.greatest(zero, "z_chi2"), F.lit(2.0)))
    return rows.withColumn("looks_random", z2 <= CHI2_3_999).drop("_alphabet", "_x", "_k")


def symbol_counts(tokens: DataFrame) -> DataFrame:
    """Occurrences of each symbol in all tokens (at most len(SYMBOLS) rows)."""
    return tokens.select(F.explode(F.split("match", "")).alias("symbol")).groupBy("symbol").count()


def text_evidence(tested: DataFrame, counts: dict[str, int]) -> DataFrame:
    """Adds ``decades``: -log10 of the bound on the p-value for being ordinary text."""
    total = sum(counts.values()) + len(SYMBOLS)
    log_text = [math.log10((counts.get(s, 0) + 1) / total) for s in SYMBOLS]
    weights = F.array(*[F.lit(w) for w in log_text])
    log_uniform = F.get(F.array(*[F.lit(-math.log10(len(s))) for _, _, s in ENCODINGS]), F.col("encoding"))
    text = F.aggregate(F.split("match", ""), F.lit(0.0),
                       lambda a, c: a + F.get(weights, F.instr(F.lit(SYMBOLS), c) - 1))
    ratio = F.col("_n") * log_uniform - text
    # encodings tried count as that many tests of the token
    return tested.withColumn("decades", F.greatest(F.lit(0.0), ratio - math.log10(len(ENCODINGS))))


def discovery_thresholds(tested: DataFrame, rate: float = FALSE_DISCOVERY_RATE) -> DataFrame:
    """Benjamini-Hochberg per length class: length_class, least (decades a token must reach).

    P-values are binned downwards, so the rule is never looser than exact BH.
    There are at most 64 x ``BINS_PER_DECADE`` x ``MAX_DECADES`` bins.
    """
    binned = tested.groupBy("length_class", F.least(
        F.floor(F.col("decades") * BINS_PER_DECADE), F.lit(BINS_PER_DECADE * MAX_DECADES)).alias("bin")).count()
    every = Window.partitionBy("length_class")
    above = every.orderBy(F.col("bin").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = binned.select("length_class", "bin", F.sum("count").over(above).alias("_k"),
                           F.sum("count").over(every).alias("_m"))
    passed = F.col("bin") / BINS_PER_DECADE >= F.log10(F.col("_m") / (F.lit(rate) * F.col("_k")))
    return ranked.where(passed).groupBy("length_class").agg((F.min("bin") / BINS_PER_DECADE).alias("least"))


def random_spans(tokens: DataFrame) -> DataFrame:
    """Tokens that the battery finds random and that are not ordinary text (t1, t2, kind, start, stop).

    Tokens of digits alone are numbers, and tokens without a digit are words
    or names: they count in the corpus statistics but are no candidates.
    """
    rows = battery(tokens).withColumn("length_class", F.floor(F.log2("_n")))
    counts = {r["symbol"]: r["count"] for r in symbol_counts(tokens).collect()}
    rows = written(text_evidence(rows, counts), "tokens")
    mixed = F.col("match").rlike("[0-9]") & F.col("match").rlike("[A-Za-z]")
    thresholds = discovery_thresholds(rows)
    return (rows.where(mixed & F.col("looks_random")).join(F.broadcast(thresholds), "length_class")
            .where(F.col("decades") >= F.col("least")).select("t1", "t2", "kind", "start", "stop"))


def find_secrets(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``text``'s spans: array of (start, kind index, stop), sorted, per document row.

    A null text is empty.  Rows repeated exactly get the same spans; null
    ids stay null.  Other columns are not read.
    """
    matches = written(pattern_matches(docs), "matches")
    base = matches.where(
        ((F.col("kind") == "assign") & (F.char_length("value") >= MIN_ASSIGN_VALUE))
        | ((F.col("kind") == "access") & (F.char_length("match") >= MIN_ACCESS)) | (F.col("kind") == "hex"))
    spans = base.select("t1", "t2", "kind", "start", "stop").unionByName(
        random_spans(matches.where("kind = 'random'")))
    order = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind"))
    per_text = spans.groupBy("t1", "t2").agg(F.sort_array(F.collect_list(
        F.struct("start", order.alias("nth"), "stop", "kind"))).alias("_spans"))
    per_text = broadcast_or_written(per_text)
    text = F.coalesce(F.col("text"), F.lit(""))
    t1, t2 = text_key(text)
    rows = docs.select("doc_id", t1.alias("t1"), t2.alias("t2")).join(per_text, ["t1", "t2"], "left")
    empty = F.array().cast(rows.schema["_spans"].dataType)
    return rows.select("doc_id", F.coalesce("_spans", empty).alias("spans"))


def broadcast_or_written(per_text: DataFrame) -> DataFrame:
    """A written table, so that a text that a third of the rows share is
    split by the skew join when the table is too large to broadcast."""
    stored = written(per_text, "spans")
    sized = stored.select(F.size("_spans").alias("n")).agg(F.sum("n"), F.count("n")).first()
    return F.broadcast(stored) if (sized[0] or 0) * 64 + sized[1] * 64 <= BROADCAST_BYTES else stored


def secrets_digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans of every document row."""
    rows = find_secrets(docs.select("doc_id", "text"))

    def joined(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])), ",")

    def number(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    base = F.filter("spans", lambda s: s["kind"] != "random")
    return rows.select("doc_id", *[number(k) for k in KINDS[:3]], F.sha2(joined(base), 256).alias("base_sha256"),
                       joined(F.col("spans")).alias("spans"), number("random"))
