"""Benchmark decontamination with a distributed positional inverted index.

1. The items become windows of ``n`` consecutive words (a shorter item is one
   window); equal windows are one phrase.
2. The phrases' terms are counted over all documents, and each phrase is
   probed by its ``probes`` rarest terms.  A phrase with a term that no
   document holds is out at once.
3. The documents' postings ``(term, doc_id, position)`` of the probe terms
   are stored as a table.
4. Each probe's posting list is shifted by the term's offset in the phrase;
   starts that all probes share (exact), or that lie within ``slack`` of one
   another (proximity), are candidates.
5. Candidates go back to their document, where the remaining words are
   compared.  The distinct sets of items of a document's phrases are then
   looked up, and each item is listed once.

Postings are stored by the task that reads the document: nothing is shuffled
by term, so a term that a third of the documents hold is no hot partition.
The intersection groups by document, phrase and start.  The phrase side
is broadcast only if its measured bytes are below ``BROADCAST_BYTES``;
otherwise the same joins are shuffle joins on the term.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kgprep.llm.common import ascii_lower, broadcast_if_small, written

# everything in ASCII but letters and digits separates words
SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
BROADCAST_BYTES = 64 << 20


def raw_words(text: Column) -> Column:
    """Words in their own case; a null text has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SEPARATORS), "")


def benchmark_windows(items: DataFrame, n: int = 13) -> DataFrame:
    """Distinct (item_id, phrase) of all windows; a phrase is its words joined by a space.

    An item without words has no window.  A null item_id counts as an item
    whose id is the empty string.
    """
    words = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"),
                         F.transform(raw_words(F.col("text")), ascii_lower).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("w") - (n - 1)))
    grams = words.select("item_id", "w", F.explode(starts).alias("_s"))
    grams = grams.select("item_id", F.slice("w", F.col("_s"), F.lit(n)).alias("terms"))
    return grams.select("item_id", F.array_join("terms", " ").alias("phrase")).distinct()


def item_sets(windows: DataFrame) -> DataFrame:
    """(phrase, n_ids, x1, x2): a key of the phrase's set of items, from sums that combine before the shuffle."""
    return windows.groupBy("phrase").agg(F.count(F.lit(1)).alias("n_ids"), F.bit_xor(F.xxhash64("item_id")).alias("x1"),
                                         F.bit_xor(F.xxhash64(F.lit("second"), "item_id")).alias("x2"))


def benchmark_phrases(windows: DataFrame) -> DataFrame:
    """Distinct windows: phrase, terms, n."""
    return windows.select("phrase").distinct().select("phrase", F.split("phrase", " ").alias("terms")).withColumn(
        "n", F.size("terms"))


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.xxhash64("text").alias("t1"), raw_words(F.col("text")).alias("w"))


def term_counts(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """Occurrences over all documents of the given distinct terms."""
    words = docs.select(F.explode(raw_words(F.col("text"))).alias("w")).select(ascii_lower(F.col("w")).alias("term"))
    return words.join(broadcast_if_small(terms, BROADCAST_BYTES), "term", "left_semi").groupBy("term").count()


def rarest_terms(phrases: DataFrame, counts: DataFrame, probes: int = 2) -> DataFrame:
    """Probes of the phrases that can occur: phrase, n, term, offset, probe (0 is the rarest)."""
    terms = phrases.select("phrase", "n", F.posexplode("terms").alias("offset", "term"))
    ranked = terms.join(counts, "term", "left").withColumn("count", F.coalesce("count", F.lit(0)))
    by_phrase = Window.partitionBy("phrase")
    order = by_phrase.orderBy("count", "term", "offset")
    ranked = ranked.select("*", F.min("count").over(by_phrase).alias("_least"), F.row_number().over(order).alias("_r"))
    return ranked.where((F.col("_least") > 0) & (F.col("_r") <= probes)).select(
        "phrase", "n", "term", "offset", (F.col("_r") - 1).alias("probe"))


def positional_index(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """Stored postings (doc_id, t1, term, pos) of the given terms; t1 tells
    apart rows that share a doc_id."""
    words = _keyed(docs).select("doc_id", "t1", F.posexplode("w").alias("pos", "w"))
    words = words.select("doc_id", "t1", "pos", ascii_lower(F.col("w")).alias("term"))
    return written(words.join(broadcast_if_small(terms, BROADCAST_BYTES), "term", "left_semi")
                   .select("doc_id", "t1", "term", "pos"), "postings")


def intersect(index: DataFrame, probes: DataFrame, slack: int = 0) -> DataFrame:
    """Candidate matches (doc_id, t1, phrase, n, start) that all probes of a phrase agree on.

    ``slack`` 0 asks for one common start; otherwise the probes' shifted
    positions lie within ``slack`` words of the rarest term's.
    """
    shifted = (index.join(broadcast_if_small(probes, BROADCAST_BYTES), "term")
               .select("doc_id", "t1", "phrase", "n", "probe", (F.col("pos") - F.col("offset")).alias("start")))
    wanted = F.call_function("shiftleft", F.lit(1), F.least(F.col("n"), F.lit(_probe_count(probes)))) - 1
    seen = F.bit_or(F.expr("shiftleft(1, probe)"))
    if slack == 0:
        found = shifted.where("start >= 0").groupBy("doc_id", "t1", "phrase", "n", "start").agg(seen.alias("_seen"))
        return found.where(F.col("_seen") == wanted).drop("_seen")
    near = Window.partitionBy("doc_id", "t1", "phrase").orderBy("start").rangeBetween(-slack, slack)
    found = shifted.withColumn("_seen", seen.over(near)).where((F.col("probe") == 0) & (F.col("_seen") == wanted))
    return found.select("doc_id", "t1", "phrase", "n", "start").distinct()


def _probe_count(probes: DataFrame) -> int:
    return (probes.agg(F.max("probe")).first()[0] or 0) + 1


def proximity_matches(docs: DataFrame, items: DataFrame, n: int = 13, probes: int = 3, slack: int = 5) -> DataFrame:
    """Places where a phrase's rarest terms occur in its order up to ``slack``
    inserted or missing words: doc_id, phrase, start."""
    chosen = _probes(docs, benchmark_windows(items, n), probes)
    terms = chosen.select("term").distinct()
    return intersect(positional_index(docs, terms), chosen, slack).select("doc_id", "phrase", "start")


def _probes(docs: DataFrame, windows: DataFrame, probes: int) -> DataFrame:
    phrases = written(benchmark_phrases(windows), "phrases")
    vocabulary = written(phrases.select(F.explode("terms").alias("term")).distinct(), "vocabulary")
    counts = term_counts(docs, vocabulary)
    return written(rarest_terms(phrases, counts, probes), "probes")


def items_of(matches: DataFrame, windows: DataFrame) -> DataFrame:
    """(_d, _t, item_ids) of the documents in distinct (_d, _t, phrase) rows, ids sorted.

    The windows of a template that many items share have one set of items,
    so a document asks once for the set.  Ids become an array only after
    they are distinct per document.
    """
    key = ["n_ids", "x1", "x2"]
    sets = written(item_sets(windows), "item-sets")
    least = written(sets.groupBy(*key).agg(F.min("phrase").alias("phrase")), "set-phrases")
    members = written(windows.join(broadcast_if_small(least, BROADCAST_BYTES), "phrase").select(*key, "item_id"), "set-members")
    asked = matches.join(broadcast_if_small(sets, BROADCAST_BYTES), "phrase").select("_d", "_t", *key).distinct()
    pairs = asked.join(broadcast_if_small(members, BROADCAST_BYTES), key).select("_d", "_t", "item_id").distinct()
    return pairs.groupBy("_d", "_t").agg(F.array_sort(F.collect_list("item_id")).alias("item_ids"))


def decontaminate(docs: DataFrame, items: DataFrame, n: int = 13, probes: int = 2, hit_share: float = 0.05) -> DataFrame:
    """``docs`` with n_words, n_hit, n_items, item_ids and contaminated added.

    A word is hit if it lies inside any occurrence of a window.  A document
    is contaminated if it has hits and they make up at least ``hit_share``
    of its words.  Null and empty texts have no words.  Rows repeated exactly get the same
    result; names that clash with the added columns are replaced.
    """
    added = ("n_words", "n_hit", "n_items", "item_ids", "contaminated")
    windows = written(benchmark_windows(items, n), "windows")
    chosen = _probes(docs, windows, probes)
    index = positional_index(docs, chosen.select("term").distinct())
    found = intersect(index, chosen).groupBy(F.col("doc_id").alias("_d"), F.col("t1").alias("_t")).agg(
        F.collect_list(F.struct("start", "n", "phrase")).alias("_c"))
    texts = docs.select("text", F.col("doc_id").alias("_id"), F.xxhash64("text").alias("_key"))
    texts = texts.join(found, F.col("_id").eqNullSafe(F.col("_d")) & (F.col("_key") == F.col("_t")))
    texts = texts.select("_d", "_t", "_c", raw_words(F.col("text")).alias("_w"))

    def occurs(c: Column) -> Column:
        here = F.transform(F.slice("_w", c["start"] + 1, c["n"]), ascii_lower)
        return F.array_join(here, " ") == c["phrase"]

    texts = texts.select("_d", "_t", F.array_sort(F.filter("_c", occurs)).alias("_m"))
    begin = F.struct(F.lit(0).cast("bigint").alias("hit"), F.lit(0).cast("bigint").alias("end"))

    def cover(acc: Column, m: Column) -> Column:
        """Matches come by start: each adds the words behind what is covered."""
        end = (m["start"] + m["n"]).cast("bigint")
        fresh = F.greatest(F.lit(0).cast("bigint"), end - F.greatest(acc["end"], m["start"].cast("bigint")))
        return F.struct((acc["hit"] + fresh).alias("hit"), F.greatest(acc["end"], end).alias("end"))

    texts = texts.select("_d", "_t", F.aggregate("_m", begin, cover)["hit"].alias("n_hit"),
                         F.array_distinct(F.col("_m.phrase")).alias("_p"))
    # rows repeated exactly have the same matches
    matched = written(texts.where("n_hit > 0").dropDuplicates(["_d", "_t"]), "matched")
    ids = items_of(matched.select("_d", "_t", F.explode("_p").alias("phrase")), windows)
    ids = ids.select(F.col("_d").alias("_d2"), F.col("_t").alias("_t2"), "item_ids")
    hits = matched.select("_d", "_t", "n_hit").join(
        ids, F.col("_d").eqNullSafe(F.col("_d2")) & (F.col("_t") == F.col("_t2"))).select("_d", "_t", "n_hit", "item_ids")
    carried = [c for c in docs.columns if c not in added]
    rows = docs.select(F.struct(*carried).alias("_row"), F.col("doc_id").alias("_id"), F.xxhash64("text").alias("_key"),
                       F.size(raw_words(F.col("text"))).cast("bigint").alias("n_words"))
    rows = rows.join(hits, F.col("_id").eqNullSafe(F.col("_d")) & (F.col("_key") == F.col("_t")), "left")
    rows = rows.select("_row", "n_words", F.coalesce("n_hit", F.lit(0).cast("bigint")).alias("n_hit"),
                       F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids"))
    hit = (F.col("n_hit") > 0) & (F.col("n_hit") >= F.col("n_words") * F.lit(hit_share))
    return rows.select(*[F.col("_row")[c].alias(c) for c in carried], "n_words", "n_hit",
                       F.size("item_ids").cast("bigint").alias("n_items"), "item_ids", hit.alias("contaminated"))


def contamination_digest(docs: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of every document row."""
    out = decontaminate(docs.select("doc_id", "text"), items)
    return out.select("doc_id", "n_words", "n_hit", "n_items",
                      F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"),
                      ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"))
