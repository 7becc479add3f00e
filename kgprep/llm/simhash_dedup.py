"""SimHash near-dedup by the generalised pigeonhole principle.

Documents whose fingerprints differ in at most ``radius`` bits are linked.
The 64 bits are cut into partitions of correlated bits, and partition i gets
a threshold t_i with sum(t_i) = radius - m + 1 (-1 skips it): two
fingerprints within the radius then differ in at most t_i bits of some
partition.  Thresholds come from dynamic programming on candidate counts
that are estimated from statistics of all fingerprints (Qin et al., GPH,
ICDE 2018).

Work is done on distinct fingerprints.  A fingerprint puts one row into the
bucket of each signature of each partition: the partition's value, and for
t_i >= 1 also the values one bit away, so two values that differ in at most
2 bits share a bucket.  In a bucket of up to ``PAIR_LIMIT`` members the pairs are
probed and verified.  Larger buckets never form pairs: their members are
grouped again by all fingerprints at most one bit away.  Two fingerprints
differ in at most two bits exactly if they have such a neighbour in
common, so a star per neighbour has the same components as the pairs, with
65 rows a member.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kgprep.llm.common import map_texts, written
from kgprep.llm.components import component_minimum
from kgprep.llm.simhash import shingle_fingerprints

BITS = 64
RADIUS = 2
PAIR_LIMIT = 64
SIGNATURE_COST = 4.0  # a signature row costs about as much as this many candidate pairs


def with_fingerprint(docs: DataFrame, n: int = 3, seed: int = 42) -> DataFrame:
    """(doc_id, t1, fp): a hash of the text, and the fingerprint as a signed 64-bit integer."""
    def make():
        fingerprint = shingle_fingerprints(n, seed)

        def values(texts):
            return [[v - (1 << 64) if v >> 63 else v for v in map(fingerprint, texts)]]

        return values

    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("t1"))
    return map_texts(rows, ["doc_id", "t1"], make, "fp long")


def bit_statistics(fps: DataFrame):
    """Over all distinct fingerprints: their number, set bits (64) and joint set bits (64 x 64).

    Each task adds up one matrix; at most 64 x 64 sums reach the driver.
    """
    import numpy as np
    import pandas as pd

    def run(batches):
        total, joint = 0, np.zeros((64, 64))
        for pdf in batches:
            raw = np.ascontiguousarray(pdf["fp"].to_numpy("int64")).view(np.uint8).reshape(-1, 8)
            bits = np.unpackbits(raw, axis=1, bitorder="little").astype(np.float32)
            total += len(bits)
            joint += bits.T @ bits
        flat = joint.ravel()
        yield pd.DataFrame({"i": np.arange(4097), "v": np.append(flat, float(total))})

    rows = fps.select("fp").mapInPandas(run, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect()
    values = np.zeros(4097)
    for r in rows:
        values[r["i"]] = r["v"]
    joint = values[:4096].reshape(64, 64)
    return values[4096], np.diag(joint).copy(), joint


def correlated_partitions(total: float, ones, joint, m: int) -> list[list[int]]:
    """``m`` partitions of nearly equal width; each grows from a seed bit by the
    unused bit most correlated with it, so that what is skewed is skewed together."""
    import numpy as np

    p = ones / max(total, 1)
    cov = joint / max(total, 1) - np.outer(p, p)
    sd = np.sqrt(np.clip(np.diag(cov), 1e-12, None))
    corr = np.abs(cov / np.outer(sd, sd))
    free, parts = set(range(BITS)), []
    for i in range(m):
        width = (BITS - sum(map(len, parts))) // (m - i)
        part = [max(sorted(free), key=lambda b: corr[b, sorted(free)].sum())]
        free.discard(part[0])
        while len(part) < width:
            best = max(sorted(free), key=lambda b: corr[b, part].sum())
            part.append(best)
            free.discard(best)
        parts.append(sorted(part))
    return parts


def part_value(fp: Column, part: list[int]) -> Column:
    """The bits of ``part``, others zero."""
    mask = sum(1 << b for b in part)
    return fp.bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask))


def _one_bit(b: int) -> Column:
    return F.lit(-(1 << 63) if b == 63 else 1 << b)


def estimated_pairs(fps: DataFrame, parts: list[list[int]], total: float, ones) -> list[dict[int, float]]:
    """Per partition and threshold, the pairs that would share a bucket.

    Pairs equal in a partition are counted exactly (sum of squared group
    sizes); each further bit multiplies them by the odds that random fingerprints
    differ in it.
    """
    keyed = fps.select(F.explode(F.array(*[F.struct(F.lit(i).alias("part"), part_value(F.col("fp"), p).alias("v"))
                                           for i, p in enumerate(parts)])).alias("k")).select("k.*")
    equal = {r["part"]: r["s"] for r in keyed.groupBy("part", "v").count()
             .groupBy("part").agg(F.sum(F.col("count").cast("double") * F.col("count")).alias("s")).collect()}
    out = []
    for i, part in enumerate(parts):
        differ = [2 * (ones[b] / max(total, 1)) * (1 - ones[b] / max(total, 1)) for b in part]
        odds = sum(d / (1 - d) for d in differ)
        same = float(equal.get(i) or 0.0)
        # buckets of values up to one bit away hold pairs up to two bits apart
        out.append({-1: 0.0, 0: same, 1: same * (1 + odds + odds * odds / 2)})
    return out


def allocate(costs: list[dict[int, float]], budget: int) -> tuple[float, list[int]]:
    """Thresholds per partition with the given sum and the least total cost, by dynamic programming."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for options in costs:
        nxt: dict[int, tuple[float, list[int]]] = {}
        for used, (cost, chosen) in best.items():
            for t, c in options.items():
                if used + t not in nxt or cost + c < nxt[used + t][0]:
                    nxt[used + t] = (cost + c, [*chosen, t])
        best = nxt
    return best.get(budget, (float("inf"), []))


def plan_partitions(fps: DataFrame, radius: int = RADIUS) -> list[tuple[list[int], int]]:
    """The (bits, threshold) partitions with the least estimated work, over 1 to radius + 1 partitions."""
    total, ones, joint = bit_statistics(fps)
    best = (float("inf"), [])
    for m in range(1, radius + 2):
        parts = correlated_partitions(total, ones, joint, m)
        pairs = estimated_pairs(fps, parts, total, ones)
        rows = [{t: c + SIGNATURE_COST * total * (0 if t < 0 else 1 if t == 0 else 1 + len(parts[i]))
                 for t, c in options.items()} for i, options in enumerate(pairs)]
        if m == 1:  # all bits: the one-bit neighbourhood reaches pairs two bits apart
            rows = [{radius: rows[0][1]}]
        cost, chosen = allocate(rows, radius - m + 1)
        if chosen and cost < best[0]:
            best = (cost, list(zip(parts, chosen)))
    return best[1]


def signatures(fps: DataFrame, plan: list[tuple[list[int], int]]) -> DataFrame:
    """Rows (part, key, fp): the buckets of each fingerprint."""
    keys = []
    for i, (part, threshold) in enumerate(plan):
        value = part_value(F.col("fp"), part)
        flips = [value.bitwiseXOR(_one_bit(b)) for b in part] if threshold >= 1 else []
        if threshold >= 0:
            keys += [F.struct(F.lit(i).alias("part"), v.alias("key")) for v in (value, *flips)]
    return fps.select("fp", F.explode(F.array(*keys)).alias("s")).select("s.part", "s.key", "fp")


def links(fps: DataFrame, radius: int = RADIUS, pair_limit: int = PAIR_LIMIT) -> DataFrame:
    """Edges (a, b) between distinct fingerprints, each within ``radius`` bits,
    with the same components as all such pairs."""
    if radius != 2:
        raise ValueError("buckets of values one bit away cover a radius of 2")
    rows = written(signatures(fps, plan_partitions(fps, radius)), "signatures")
    sizes = rows.groupBy("part", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    large = written(sizes.where(F.col("n") > pair_limit), "large")
    small = rows.join(sizes.where(F.col("n") <= pair_limit), ["part", "key"], "left_semi")
    members = small.groupBy("part", "key").agg(F.array_sort(F.collect_list("fp")).alias("m"))
    # of each pair the smaller member comes first; only close pairs leave the expression
    pairs = members.select(F.explode(F.flatten(F.transform("m", lambda a: F.transform(
        F.filter("m", lambda b: (b > a) & (F.bit_count(a.bitwiseXOR(b)) <= radius)),
        lambda b: F.struct(a.alias("a"), b.alias("b")))))).alias("e")).select("e.a", "e.b")
    crowded = rows.join(large, ["part", "key"], "left_semi").select("fp").distinct()
    around = crowded.select("fp", F.explode(F.array(F.col("fp"), *[
        F.col("fp").bitwiseXOR(_one_bit(b)) for b in range(BITS)])).alias("v"))
    centre = around.groupBy("v").agg(F.min("fp").alias("b"))
    stars = around.join(written(centre, "stars"), "v").where("fp <> b").select(F.col("fp").alias("a"), "b")
    return pairs.unionByName(stars).distinct()


def near_duplicates(docs: DataFrame, n: int = 3, radius: int = RADIUS) -> DataFrame:
    """One row per document row: doc_id, t1, fp, label (a fingerprint that stands
    for the component), component_id (the smallest doc_id reachable).

    Null and empty texts have fingerprint 0 and are linked like any other.
    Null ids are passed over by the minimum; a component of null ids only
    has a null component_id.  Extra columns are not read.
    """
    rows = written(with_fingerprint(docs, n), "fingerprints")
    classes = written(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "classes")
    edges = written(links(classes.select("fp"), radius), "links")
    labels = component_minimum(edges)
    tagged = classes.join(labels, classes["fp"] == labels["node"], "left").select(
        "fp", F.coalesce("label", "fp").alias("label"), "least")
    # a label is shared by few fingerprints or many; the minimum combines before the shuffle
    least = tagged.groupBy("label").agg(F.min("least").alias("component_id"))
    of_fp = written(tagged.select("fp", "label").join(least, "label").select("fp", "label", "component_id"), "components")
    return rows.join(of_fp, "fp").select("doc_id", "t1", "fp", "label", "component_id")


def first_of_each_group(docs: DataFrame, n: int = 3, radius: int = RADIUS) -> DataFrame:
    """One row of ``docs`` for each group: a row with the smallest id.

    Of several rows with that id the one whose text has the smallest hash
    stays, and of exact repeats one.  A group without ids is treated alike.
    """
    keyed = near_duplicates(docs, n, radius)
    keep = keyed.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy("label").agg(
        F.min("doc_id").alias("_k"), F.min("t1").alias("_kt"))
    rows = docs.select("*", F.xxhash64("text").alias("_t"))
    rows = rows.join(keep, F.col("doc_id").eqNullSafe(F.col("_k")) & (F.col("_t") == F.col("_kt")), "left_semi")
    repeat = Window.partitionBy("doc_id", "_t").orderBy(F.xxhash64(*docs.columns))
    return rows.withColumn("_r", F.row_number().over(repeat)).where("_r = 1").select(docs.columns)


def near_duplicate_digest(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id of every document row."""
    return near_duplicates(docs).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
                                        "component_id")
