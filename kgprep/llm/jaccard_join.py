"""N-gram Jaccard join by grouped prefixes.

A document's set holds the hashes of its distinct word n-grams.  Two sets
with Jaccard similarity t or more share k of the first
n - ceil(t n) + k members (the prefix) of either in any one order of all members.

1. Members held by few documents come first in the order, by hash; the others follow by
   frequency, so prefixes hold rare members.  They are counted over all documents.
2. Documents with equal sets are a class.  Classes with identical prefixes and size are
   collapsed into one group, and only groups are listed under the members of their prefix.
3. Classes that agree in the smallest members of a seeded order, a star, are first compared
   with one of them; the links found give components.  Near copies of a text need not be similar to any one of them,
   so in a large star each is then compared with some of other components, the leads, in turns.  Only links
   between different components can change the result from here on, so a group whose classes are
   all in one component is skipped beside groups of the same.
4. Listed groups meet by prefix member.  A pair is kept if sizes and places
   in the prefixes allow it, and if the groups share as many members as k asks for; k grows with the size, so that
   long documents are not compared for one passage.  Under a member, the groups of the component that
   most groups have meet only the others; pairs of groups are then
   expanded to pairs of classes, whose sets are compared. Before, the parities of members in ``BITS`` bins, which differ
   in no more bins than the sets do in members, drop pairs that are too far apart.
5. Components of all links are found by randomised contraction.

No step holds more than one pair of sets at a time, whatever the size of a
group; equal texts are never expanded into pairs.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from kgprep.llm.common import broadcast_if_small, text_key, written
from kgprep.llm.components import component_minimum

NGRAM = 3
PERCENT = 90
MORE_EVERY = 50  # k is 1 and one more for so many members
COMMON = 8  # documents that hold a member which does not come first in the order, at least
COMMON_ROWS = 1 << 20  # such members, at most
BITS = 256  # bins of the members' parities
STARS = 4  # seeded orders
STAR_MEMBERS = 4  # smallest members that must agree
LARGE_STAR = 64  # classes; a star of more has leads
LEADS = (8, 64)  # of a large star in each turn, at most; after the first turn most classes are of the leads' component
BROADCAST_BYTES = 32 << 20
TEXTS = 1024  # texts that leave Arrow at a time


def shingle_set(ngram: int):
    """``members(text)`` -> sorted distinct uint64 hashes of the text's word n-grams."""
    import xxhash

    digest = xxhash.xxh64_intdigest

    def members(text):
        words = (text or "").encode("utf-8", "surrogatepass").lower().split()
        if not words:
            return np.zeros(0, np.uint64)
        joined = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        k = min(ngram, len(words))
        first = np.append(0, ends[:-1] + 1)[:len(words) - k + 1].tolist()
        return np.unique(np.fromiter([digest(joined[a:b]) for a, b in zip(first, ends[k - 1:].tolist())], np.uint64))

    return members


def _arrow_rows(frame: DataFrame, make, added: str) -> DataFrame:
    """``make()(text)`` -> a tuple of the ``added`` columns, or a list of tuples; the last column of ``frame`` is the text.

    Other columns stay Arrow arrays and are repeated for each tuple.
    """
    carried = frame.columns[:-1]
    schema = StructType([frame.schema[c] for c in carried] + StructType.fromDDL(added).fields)

    def run(batches):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_type

        row_of = make()
        types = [to_arrow_type(f.dataType) for f in schema.fields[len(carried):]]
        for batch in batches:
            for at in range(0, batch.num_rows, TEXTS):
                part = batch.slice(at, TEXTS)
                made = [pa.array(c, t) for c, t in zip(zip(*map(row_of, part.column(len(carried)).to_pylist())), types)]
                yield pa.RecordBatch.from_arrays([*part.columns[:len(carried)], *made], names=schema.names)

    return frame.mapInArrow(run, schema)


def common_members(docs: DataFrame, ngram: int, common: int, common_rows: int):
    """(hashes, ranks): sorted hashes that at least ``common`` documents hold; a rank is the logarithm of their number.

    There are at most ``common_rows``; beyond it, ``common`` rises.  A batch of documents passes on
    the hashes that two or more of its documents hold.  So a number is a lower bound, short by at most one for each
    batch, and a hash that more documents hold than there are batches is never missed.  The
    numbers make the order, which spares work and never changes the result.
    """
    def count(batches):
        import pyarrow as pa

        members = shingle_set(ngram)
        for batch in batches:
            # texts leave Arrow a few at a time; a batch's members are sorted in place, and only those met again are copied
            found = [members(t) for at in range(0, batch.num_rows, TEXTS) for t in batch.column(0).slice(at, TEXTS).to_pylist()]
            found = np.concatenate([np.zeros(0, np.uint64), *found])
            found.sort()
            again = found[1:] == found[:-1]
            hashes, n = np.unique(found[1:][again], return_counts=True)
            del found, again
            n += 1
            yield pa.RecordBatch.from_arrays([pa.array(hashes.astype(np.int64)), pa.array(n.astype(np.int64))], names=["m", "n"])

    counts = docs.select("text").mapInArrow(count, "m long, n long").groupBy("m").agg(F.sum("n").alias("n"))
    counts = written(counts.where(F.col("n") >= common), "common")
    if counts.count() > common_rows:
        total = counts.agg(F.sum("n")).first()[0]
        counts = counts.where(F.col("n") >= -(-total // common_rows))
    top = counts.toPandas().sort_values("m")
    return top["m"].to_numpy(np.int64).astype(np.uint64), np.log2(top["n"].to_numpy(np.float64) + 0.5).astype(np.uint8)


def _text_key():
    t1, t2 = text_key(F.col("text"))
    return F.struct(F.col("doc_id"), t1.alias("t1"), t2.alias("t2"))


def signatures(docs: DataFrame, ngram: int, percent: int, common) -> DataFrame:
    """Stored (doc_id, t, cls, n, grp, prefix, stars, bits) of every row; cls is null for an empty set.

    ``cls`` and ``grp`` are 128-bit hashes of the set, and of the prefix and the size; ``t`` is the id
    and a 128-bit hash of the text; ``bits`` are the parities of the set's members in ``BITS`` bins.
    """
    shared = docs.sparkSession.sparkContext.broadcast(common)

    def make():
        import xxhash

        members, (common, ranks) = shingle_set(ngram), shared.value
        seeds = np.random.default_rng(11).integers(1, 1 << 62, 2 * STARS).astype(np.uint64) * np.uint64(2) + np.uint64(1)

        def row(text):
            m = members(text)
            n = len(m)
            if not n:
                return None, 0, None, None, None, None
            order = m
            if len(common):
                at = np.minimum(np.searchsorted(common, m), len(common) - 1)
                order = m[np.argsort(np.where(common[at] == m, ranks[at] + 1, 0), kind="stable")]
            prefix = order[:n - (-(-percent * n // 100)) + 1 + n // MORE_EVERY]
            stars = []
            with np.errstate(over="ignore"):
                for r in range(STARS):
                    mixed = m * seeds[2 * r]
                    mixed = (mixed ^ (mixed >> np.uint64(31))) * seeds[2 * r + 1]
                    least = np.sort(np.partition(mixed, STAR_MEMBERS - 1)[:STAR_MEMBERS]) if n > STAR_MEMBERS else np.sort(mixed)
                    stars.append(xxhash.xxh64_intdigest(least.tobytes(), r) - (1 << 63))
            name = xxhash.xxh128_digest(prefix.tobytes(), n & 0xFFFFFFFF)
            odd = np.packbits(np.bincount((m % np.uint64(BITS)).astype(np.int64), minlength=BITS) & 1).view(np.int64)
            return xxhash.xxh128_digest(m.tobytes()), n, name, prefix.view(np.int64), stars, odd

        return row

    rows = _arrow_rows(docs.select("doc_id", _text_key().alias("t"), "text"), make,
                       "cls binary, n int, grp binary, prefix array<long>, stars array<long>, bits array<long>")
    return written(rows, "signatures")


def member_sets(docs: DataFrame, wanted: DataFrame, classes: DataFrame, ngram: int) -> DataFrame:
    """Stored (cls, members) of the ``wanted`` classes (column cls), read from one row of each."""
    texts = written(classes.join(wanted.distinct(), "cls", "left_semi").select(F.xxhash64("t").alias("h"), "t.*"), "wanted")
    texts = broadcast_if_small(texts.withColumnRenamed("doc_id", "_id"), BROADCAST_BYTES)
    rows = docs.select(_text_key().alias("t"), "text").select(F.xxhash64("t").alias("h"), "t.*", "text")
    # ids can be null, so the hash of the whole key is what the rows are dealt by
    rows = rows.join(texts.withColumnsRenamed({"t1": "_1", "t2": "_2", "h": "_h"}), (F.col("h") == F.col("_h")) & (
        F.col("t1") == F.col("_1")) & (F.col("t2") == F.col("_2")) & F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi")

    def read(batches):
        import pyarrow as pa
        import xxhash

        members, seen = shingle_set(ngram), set()
        for batch in batches:
            for at in range(0, batch.num_rows, TEXTS):
                found = {}
                for text in batch.column(0).slice(at, TEXTS).to_pylist():
                    m = members(text)
                    found[xxhash.xxh128_digest(m.tobytes())] = m.view(np.int64)
                new = [c for c in found if c not in seen]
                seen.update(new)
                yield pa.RecordBatch.from_arrays([pa.array(new, pa.binary()), pa.array([found[c] for c in new], pa.list_(pa.int64()))],
                                                 names=["cls", "members"])

    sets = written(rows.select("text").mapInArrow(read, "cls binary, members array<long>"), "sets")
    # rows with the same id and text that different tasks read
    again = sets.groupBy("cls").count().where("count > 1")
    return sets if again.isEmpty() else written(sets.dropDuplicates(["cls"]), "sets")


def linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The stored pairs (a, b) of classes whose sets are similar."""
    left = sets.withColumnsRenamed({"cls": "a", "members": "ma"})
    right = sets.withColumnsRenamed({"cls": "b", "members": "mb"})
    both = pairs.join(left, "a").join(right, "b")
    # 100 * shared >= percent * (x + y - shared), with the intersection written once: a condition evaluates it as often as it is there
    shared = F.size(F.array_intersect("ma", "mb")).cast("long")
    return written(both.where((100 + percent) * shared >= percent * (F.size("ma") + F.size("mb"))).select("a", "b"), "links")


def _with_component(classes: DataFrame, links: DataFrame) -> DataFrame:
    """``classes`` with comp: the label of the class's component, or the class itself."""
    labels = component_minimum(links).withColumnsRenamed({"node": "cls", "label": "_l"})
    return written(classes.join(labels, "cls", "left").withColumn("comp", F.coalesce("_l", "cls")).drop("_l"), "components")


def star_pairs(classes: DataFrame) -> DataFrame:
    """Stored distinct (a, b): each class beside the one of its star that most documents have."""
    each = classes.select("cls", "n", "copies", F.posexplode("stars").alias("r", "star"))
    lead = each.groupBy("r", "star").agg(F.max(F.struct("copies", "cls")).alias("lead"), F.count(F.lit(1)).alias("k"))
    lead = written(lead.where("k > 1").select("r", "star", F.col("lead.cls").alias("b")), "stars")
    pairs = each.join(lead, ["r", "star"]).where(F.col("cls") != F.col("b"))
    return written(pairs.select(F.col("cls").alias("a"), "b").distinct(), "star-pairs")


def large_stars(classes: DataFrame) -> DataFrame:
    """Stored (r, star, cls, n, bits): the classes of stars that hold more than ``LARGE_STAR``."""
    each = classes.select("cls", "n", "bits", F.posexplode("stars").alias("r", "star"))
    large = each.groupBy("r", "star").agg(F.count(F.lit(1)).alias("k")).where(F.col("k") > LARGE_STAR).select("r", "star")
    return written(each.join(broadcast_if_small(written(large, "large"), BROADCAST_BYTES), ["r", "star"]), "large-stars")


def lead_pairs(large: DataFrame, known: DataFrame, percent: int, leads: int) -> DataFrame:
    """Stored distinct (a, b): classes of ``large`` beside up to ``leads`` of their star, drawn by hash, that may be similar
    and are of another component (``known``: cls, comp)."""
    each = large.join(known.select("cls", "comp"), "cls")
    drawn = F.xxhash64(F.lit(leads), "r", "cls")
    lead = each.groupBy("r", "star", F.pmod(drawn, F.lit(leads)).alias("slot")).agg(
        F.min_by(F.struct(F.col("cls").alias("b"), F.col("n").alias("nb"), F.col("bits").alias("bb"), F.col("comp").alias("cb")), drawn).alias("lead"))
    lead = written(lead.select("r", "star", "lead.*"), "leads").withColumnsRenamed({"r": "_r", "star": "_star"})
    pairs = each.join(lead, (each["r"] == lead["_r"]) & (each["star"] == lead["_star"]) & (F.col("comp") != F.col("cb"))
                      & _may_share(percent, F.col("n"), F.col("nb"), F.col("bits"), F.col("bb")))
    return written(pairs.select(F.col("cls").alias("a"), "b").distinct(), "lead-pairs")


def _least_shared(percent, x, y):
    """The members that sets of x and y members must share."""
    return F.floor((percent * (x + y) + 99 + percent) / (100 + percent))


def _may_share(percent, x, y, a, b):
    """Whether sets of x and y members with the parities a and b can share as many as they must; true if a or b is null."""
    apart = reduce(Column.__add__, (F.bit_count(F.get(a, i).bitwiseXOR(F.get(b, i))) for i in range(BITS // 64)))
    return F.coalesce(apart, F.lit(0)) <= x + y - 2 * _least_shared(percent, x, y)


def group_pairs(groups: DataFrame, percent: int) -> DataFrame:
    """(x, y): groups that share enough prefix members at places that allow a link, unless both are of one component.

    ``groups`` has g, n, prefix, comp, which is null if its classes are of several, and bits, null if it has several classes.
    """
    listed = groups.select("g", "n", "comp", "bits", F.posexplode("prefix").alias("place", "member"))
    # most members are listed once: their rows go no further
    shared = written(listed.groupBy("member").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("member"), "shared")
    listed = written(listed.join(broadcast_if_small(shared, BROADCAST_BYTES), "member", "left_semi"), "postings")
    many = listed.groupBy("member").agg(F.count(F.lit(1)).alias("k"), F.min("comp").alias("lo"), F.max("comp").alias("hi"),
                                        F.count("comp").alias("whole"))
    # a member whose groups are all of one component gives nothing
    many = written(many.where((F.col("whole") < F.col("k")) | (F.col("lo") != F.col("hi"))).select("member"), "listed")
    listed = written(listed.join(many, "member", "left_semi"), "postings")
    main = listed.where("comp IS NOT NULL").groupBy("member", "comp").agg(F.count(F.lit(1)).alias("k"))
    main = written(main.groupBy("member").agg(F.max(F.struct("k", "comp")).alias("m")).select("member", F.col("m.comp").alias("main")), "main")
    other = F.col("main").isNull() | F.col("comp").isNull() | (F.col("comp") != F.col("main"))
    listed = written(listed.join(main, "member", "left").select("member", "g", "n", "comp", "bits", "place", other.alias("other")), "postings")
    x = listed.where("other").drop("other").withColumnsRenamed({"g": "x", "n": "nx", "comp": "cx", "place": "px", "bits": "bx"})
    y = listed.withColumnsRenamed({"g": "y", "n": "ny", "comp": "cy", "place": "py", "bits": "by"})
    more = F.floor(F.least("nx", "ny") / MORE_EVERY)
    need = _least_shared(percent, F.col("nx"), F.col("ny"))
    fits = ((100 * F.least("nx", "ny") >= percent * F.greatest("nx", "ny"))
            & F.when(F.col("other"), F.col("x") < F.col("y")).otherwise(F.col("x") != F.col("y"))
            & (F.col("px") <= F.col("nx") - need + more) & (F.col("py") <= F.col("ny") - need + more)
            & (F.col("cx").isNull() | F.col("cy").isNull() | (F.col("cx") != F.col("cy")))
            & _may_share(percent, F.col("nx"), F.col("ny"), F.col("bx"), F.col("by")))
    met = x.join(y, (x["member"] == y["member"]) & fits).select(
        F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"), more.alias("more"))
    return met.groupBy("x", "y").agg(F.count(F.lit(1)).alias("k"), F.max("more").alias("more")).where("k > more").select("x", "y")


def jaccard_components(docs: DataFrame, ngram: int = NGRAM, percent: int = PERCENT, common: int = COMMON,
                       common_rows: int = COMMON_ROWS) -> DataFrame:
    """doc_id, n_shingles, component_id of every document row.

    Words are split at ASCII white space after lower-casing A-Z.  Fewer than ``ngram`` words are
    one member; a text without words, or null, has an empty set, is linked with nothing and is its own
    component.  Rows with equal sets are linked.  component_id is the smallest doc_id of the
    component; ids that are null count for nothing, and a component without any other has a null one.
    Other columns of ``docs`` are ignored.
    """
    docs = docs.select("doc_id", "text")
    rows = signatures(docs, ngram, percent, common_members(docs, ngram, common, common_rows))
    classes = rows.where("cls IS NOT NULL").groupBy("cls").agg(
        F.first("n").alias("n"), F.first("grp").alias("grp"), F.first("stars").alias("stars"), F.first("bits").alias("bits"),
        F.min("t").alias("t"),
        F.count(F.lit(1)).alias("copies"))
    classes = written(classes, "classes")

    pairs = star_pairs(classes)
    nodes = pairs.select(F.col("a").alias("cls")).unionByName(pairs.select(F.col("b").alias("cls")))
    sets = member_sets(docs, nodes, classes, ngram)
    found = linked(pairs, sets, percent)
    named = classes.select("cls", "n", "grp", "bits")
    known = _with_component(named, found)
    large = large_stars(classes)
    for leads in () if large.isEmpty() else LEADS:
        pairs = lead_pairs(large, known, percent, leads)
        if pairs.isEmpty():
            continue
        found = found.unionByName(linked(pairs, sets, percent))
        known = _with_component(named, found)

    # groups go by 64 bits of their name: two that agree in them would only bring more pairs to compare
    short = F.xxhash64("grp")
    comps = known.groupBy("grp").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count(F.lit(1)).alias("k"),
                                      F.first("bits").alias("bits"))
    comps = comps.select("grp", F.when(F.col("lo") == F.col("hi"), F.xxhash64("lo")).alias("comp"),
                         F.when(F.col("k") == 1, F.col("bits")).alias("bits"))
    prefixes = rows.where("grp IS NOT NULL").groupBy("grp").agg(F.first("n").alias("n"), F.first("prefix").alias("prefix"))
    groups = written(prefixes.join(comps, "grp").select(short.alias("g"), "n", "prefix", "comp", "bits"), "groups")
    # classes of one group have one size n, so at least one member of each is not in the other
    inside = groups.where(F.col("comp").isNull() & (100 * (F.col("n") - 1) >= percent * (F.col("n") + 1)))
    met = written(group_pairs(groups, percent).unionByName(inside.select(F.col("g").alias("x"), F.col("g").alias("y"))), "group-pairs")

    # expand: classes of two groups, or of one, that are not yet of one component
    members = known.select(short.alias("g"), "cls", "comp", "n", "bits")
    first = members.withColumnsRenamed({"g": "x", "cls": "a", "comp": "ca", "n": "na", "bits": "ba"})
    second = members.withColumnsRenamed({"g": "y", "cls": "b", "comp": "cb", "n": "nb", "bits": "bb"})
    # a group of several components is opened only for its classes that can link with the other group
    ends = groups.select(F.col("g").alias("y"), F.col("n").alias("ny"), F.col("comp").alias("cy"), F.col("bits").alias("by"))
    met = met.join(ends, "y").withColumnRenamed("x", "_x")
    opened = written(met.join(first, (met["_x"] == first["x"]) & (F.col("cy").isNull() | (F.xxhash64("ca") != F.col("cy"))) & _may_share(
        percent, F.col("na"), F.col("ny"), F.col("ba"), F.col("by"))).drop("_x", "ny", "cy", "by"), "opened")
    pairs = written(opened.join(second, (opened["y"] == second["y"]) & (F.col("ca") != F.col("cb")) & (
        (opened["x"] != opened["y"]) | (F.col("a") < F.col("b"))) & _may_share(
            percent, F.col("na"), F.col("nb"), F.col("ba"), F.col("bb"))).select("a", "b"), "class-pairs")
    nodes = pairs.select(F.col("a").alias("cls")).unionByName(pairs.select(F.col("b").alias("cls")))
    more = linked(pairs, member_sets(docs, nodes, classes, ngram), percent)

    labels = component_minimum(reduce(DataFrame.unionByName, [found, more])).withColumnsRenamed({"node": "cls"})
    out = written(rows.select("doc_id", "n", "cls").join(labels, "cls", "left").withColumn("label", F.coalesce("label", "cls")), "labelled")
    least = written(out.where("label IS NOT NULL").groupBy("label").agg(F.min("doc_id").alias("least")), "least")
    return out.join(least, "label", "left").select(
        "doc_id", F.col("n").alias("n_shingles"),
        F.when(F.col("cls").isNull(), F.col("doc_id")).otherwise(F.col("least")).alias("component_id"))
