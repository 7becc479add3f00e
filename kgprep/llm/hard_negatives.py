"""Hard negatives by anchor spanning-tree bounds.

Anchors are a stated share of the rows and meet all rows, in blocks.  The
inner product of a row c with an anchor a differs from that with another
anchor p by <a - p, c>, which is at most |a - p| |c| in size.  So anchors are
joined to trees by short edges, and an interval for a's score follows from
p's: only rows whose interval reaches into a's window are scored anew.

1. Anchors are sorted by the signs of their products with fixed random
   directions, which puts near ones beside each other, and cut into groups
   of ``group_anchors``.  Each group gets its minimum spanning tree.  Tiles
   of ``tile_groups`` groups meet blocks of about ``block_rows`` rows.
2. Each cell (block, tile) gives the best ``n_positives`` rows of each
   anchor's own label.  A row is scored if its interval reaches the score
   that as many lower ends reach.  The best of all blocks are the positives.
3. The positives fix each anchor's windows.  Each cell gives the first
   ``n_negatives`` rows of other labels in each window, and the first of all
   blocks are the result.

A root is scored with all rows.  Intervals of rows that are not scored
grow by the next edge.  A cell holds one block and one tile, whatever the
size of a label, and returns a fixed number of rows for an anchor and a positive.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kgprep.llm.common import written

BLOCK_ROWS = 2048
GROUP_ANCHORS = 128
TILE_GROUPS = 16
DIRECTIONS = 32


def integer_rows(vectors: DataFrame) -> DataFrame:
    """Stored (key, vec_id, label, v): rows that take part, components as floor(256 x), key a number of the row.

    Rows without an id, a label or a vector, or with a null or non-finite
    component, take no part.  Shorter vectors end in zeros.  A component whose
    square times the number of components would exceed 63 bits counts as the largest
    one that does not.
    """
    v = F.col("embedding")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = vectors.where("vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL").where(finite)
    label = F.col("label").cast("long")
    label = F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label)
    rows = written(rows.select(F.monotonically_increasing_id().alias("key"), F.col("vec_id").cast("long").alias("vec_id"),
                               label.alias("label"), F.transform(v, lambda x: x.cast("double")).alias("v")), "vectors")
    size = rows.agg(F.max(F.size("v"))).first()[0] or 0
    most = float(int((2.0 ** 62 / max(1, size)) ** 0.5))
    whole = F.transform("v", lambda x: F.floor(F.greatest(F.lit(-most), F.least(F.lit(most), 256 * x))).cast("long"))
    padded = F.concat(whole, F.array_repeat(F.lit(0).cast("long"), F.lit(size) - F.size("v")))
    return rows.select("key", "vec_id", "label", padded.alias("v"))


def spanning_tree(points):
    """Prim's tree over the rows of ``points``: (order, parent, length), parents before children.

    ``length`` bounds the Euclidean distance to the parent from above; the root's is 0.
    """
    n = len(points)
    points = np.asarray(points, np.float64)
    order, parent, length = np.zeros(n, np.int64), np.full(n, -1), np.zeros(n)
    best, nearest, todo = np.full(n, np.inf), np.full(n, -1), np.ones(n, bool)
    at = 0
    for i in range(n):
        order[i], todo[at] = at, False
        if i:
            parent[at], length[at] = nearest[at], best[at]
        distance = np.sqrt(((points - points[at]) ** 2).sum(1)) * (1 + 1e-9)
        closer = todo & (distance < best)
        best[closer], nearest[closer] = distance[closer], at
        at = int(np.where(todo, best, np.inf).argmin())
    return order, parent, length


def _matrix(column):
    return np.stack(column.to_numpy()) if len(column) else np.zeros((0, 0), np.int64)


def _ends(scores, small):
    """Doubles around the scores: equal to them where all are small, else the next ones on either side."""
    x = scores.astype(np.float64)
    return (x, x.copy()) if small else (np.nextafter(x, -np.inf), np.nextafter(x, np.inf))


def _tree_scores(rows, norms, anchors, order, parent, length, wanted):
    """``wanted(i, low, high, score)`` for every anchor, parents first.

    It gets an interval for each row's score and a function that scores rows, and returns
    the rows it scored with their scores, which become both ends of their intervals.
    """
    kept = {}
    uses = np.bincount(parent[parent >= 0], minlength=len(order))
    small = float(np.abs(rows).max(initial=0)) * float(np.abs(anchors).max(initial=0)) * max(1, rows.shape[1]) < 2 ** 52
    matrix = rows.astype(np.float64) if small else rows  # doubles are exact there and faster
    for i in order:
        def score(at, i=i):
            return (matrix[at] @ anchors[i]).astype(np.int64)

        p = parent[i]
        if p < 0:
            low, high = _ends(matrix @ anchors[i], small)
        else:
            # what rounding can take from the ends is far below the last term
            reach = length[i] * norms + 1e-15 * (np.abs(kept[p][0]) + np.abs(kept[p][1]))
            low, high = kept[p][0] - reach, kept[p][1] + reach
        scored, values = wanted(i, low, high, score)
        low[scored], high[scored] = _ends(values, small)
        if p >= 0:
            uses[p] -= 1
            if not uses[p]:
                del kept[p]
        if uses[i]:
            kept[i] = (low, high)


def anchor_trees(anchors: DataFrame, group_anchors: int, tile_groups: int, directions: int = DIRECTIONS) -> DataFrame:
    """Stored (grp, tile, place, parent, length) beside the anchors' columns; parents have smaller places."""
    def code(batches):
        for pdf in batches:
            if len(pdf):
                points = _matrix(pdf["v"]).astype(np.float64)
                plane = np.random.default_rng(7).standard_normal((points.shape[1], directions))
                bits = (points @ plane > 0).astype(np.int64)
                pdf["code"] = bits @ (np.int64(1) << np.arange(directions)[::-1])
                yield pdf

    def cut(batches):
        at = 0
        for pdf in batches:
            number = np.arange(at, at + len(pdf))
            at += len(pdf)
            pdf["chunk"] = number // group_anchors
            yield pdf

    parts = max(1, anchors.sparkSession.sparkContext.defaultParallelism)
    coded = anchors.mapInPandas(code, "key long, vec_id long, label long, v array<long>, code long")
    coded = coded.repartitionByRange(parts, "code", "key").sortWithinPartitions("code", "key")
    cuts = coded.mapInPandas(cut, "key long, vec_id long, label long, v array<long>, code long, chunk long")
    cuts = written(cuts.drop("code").withColumn("grp", F.struct(F.spark_partition_id().alias("p"), "chunk")), "anchors")

    def tree(pdf):
        pdf = pdf.sort_values("key", ignore_index=True)
        order, parent, length = spanning_tree(_matrix(pdf["v"]))
        place = np.empty(len(pdf), np.int64)
        place[order] = np.arange(len(pdf))
        pdf["place"], pdf["length"] = place, length
        pdf["parent"] = np.where(parent < 0, -1, place[parent])
        return pdf[["p", "chunk", "key", "vec_id", "label", "v", "place", "parent", "length"]]

    trees = cuts.select("grp.p", "grp.chunk", "key", "vec_id", "label", "v").groupBy("p", "chunk").applyInPandas(
        tree, "p int, chunk long, key long, vec_id long, label long, v array<long>, place long, parent long, length double")
    grp = F.xxhash64("p", "chunk")
    tiles = max(1, -(-cuts.count() // (group_anchors * tile_groups)))
    return written(trees.select(grp.alias("grp"), F.pmod(grp, F.lit(tiles)).alias("tile"),
                                "key", "vec_id", "label", "v", "place", "parent", "length"), "trees")


def _by_cells(rows: DataFrame, trees: DataFrame, per_cell, schema: str, block_rows: int) -> DataFrame:
    """``per_cell(block, tile)`` of every block of rows and tile of anchors."""
    blocks = max(1, -(-rows.count() // block_rows))
    tiles = (trees.agg(F.max("tile")).first()[0] or 0) + 1
    block = F.pmod(F.xxhash64("key"), F.lit(blocks))

    def numbers(n):
        return F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))

    left = rows.select(block.alias("block"), numbers(tiles).alias("tile"), "*")
    right = trees.select(numbers(blocks).alias("block"), "*")
    return left.groupBy("block", "tile").cogroup(right.groupBy("block", "tile")).applyInPandas(per_cell, schema)


def _first(scores, ids, n):
    """Positions of the ``n`` highest scores, ties by smaller id."""
    if len(scores) > 4 * n:
        least = np.partition(scores, len(scores) - n)[len(scores) - n]
        keep = np.nonzero(scores >= least)[0]
        return keep[np.lexsort((ids[keep], -scores[keep]))[:n]]
    return np.lexsort((ids, -scores))[:n]


def positives(rows: DataFrame, trees: DataFrame, n: int, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(anchor, anchor_id, positive_id, positive_score): each anchor's first ``n`` other rows of its label."""
    def cell(block, tile):
        out = []
        if len(block) and len(tile):
            x, ids, keys, labels = _matrix(block["v"]), *(block[c].to_numpy() for c in ("vec_id", "key", "label"))
            norms = np.sqrt((x.astype(np.float64) ** 2).sum(1)) * (1 + 1e-9)
            for _, group in tile.groupby("grp"):
                group = group.sort_values("place")
                a, own, mine = _matrix(group["v"]), group["key"].to_numpy(), group["label"].to_numpy()
                names = group["vec_id"].to_numpy()

                def wanted(i, low, high, score, a=a, own=own, mine=mine, names=names):
                    same = (labels == mine[i]) & (keys != own[i])
                    at = np.nonzero(same)[0]
                    if len(at) > n:
                        reach = np.partition(low[at], len(at) - n)[len(at) - n]
                        at = at[high[at] >= reach]
                    values = score(at)
                    best = _first(values, ids[at], n)
                    out.append((np.full(len(best), own[i]), np.full(len(best), names[i]), ids[at][best], values[best]))
                    return at, values

                _tree_scores(x, norms, a, np.arange(len(a)), group["parent"].to_numpy(), group["length"].to_numpy(), wanted)
        columns = [np.concatenate(c) for c in zip(*out)] if out else [np.zeros(0, np.int64)] * 4
        return pd.DataFrame(dict(zip(("anchor", "anchor_id", "positive_id", "positive_score"), columns)))

    found = _by_cells(rows, trees, cell, "anchor long, anchor_id long, positive_id long, positive_score long", block_rows)
    place = F.row_number().over(Window.partitionBy("anchor").orderBy(F.desc("positive_score"), "positive_id"))
    return written(found.withColumn("place", place).where(F.col("place") <= n), "positives")


def mine_hard_negatives(vectors: DataFrame, share: int = 100, n_positives: int = 5, n_negatives: int = 5,
                        block_rows: int = BLOCK_ROWS, group_anchors: int = GROUP_ANCHORS,
                        tile_groups: int = TILE_GROUPS) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Anchors are the rows whose vec_id is divisible by ``share``; every row is
    compared with them.  ``integer_rows`` says which rows take part.  Every row is
    a row of its own: one that repeats an anchor is another anchor, and another row for it.
    Other columns of the input are ignored; an empty table gives no rows.
    """
    rows = integer_rows(vectors)
    trees = anchor_trees(rows.where(F.col("vec_id") % share == 0), group_anchors, tile_groups)
    best = positives(rows, trees, n_positives, block_rows)
    windows = best.groupBy("anchor").agg(
        F.sort_array(F.collect_list(F.struct("place", "positive_id", "positive_score"))).alias("w"))
    windows = windows.select(F.col("anchor").alias("key"), F.col("w.place").alias("places"),
                             F.col("w.positive_id").alias("p_ids"), F.col("w.positive_score").alias("p_scores"))
    targets = written(trees.join(windows, "key", "left"), "windows")

    def cell(block, tile):
        out = []
        if len(block) and len(tile):
            x, ids, labels = _matrix(block["v"]), block["vec_id"].to_numpy(), block["label"].to_numpy()
            norms = np.sqrt((x.astype(np.float64) ** 2).sum(1)) * (1 + 1e-9)
            for _, group in tile.groupby("grp"):
                group = group.sort_values("place")
                a, own, mine = _matrix(group["v"]), group["key"].to_numpy(), group["label"].to_numpy()
                names, places, p_ids, p_scores = (group[c].to_numpy() for c in ("vec_id", "places", "p_ids", "p_scores"))

                def wanted(i, low, high, score, own=own, mine=mine, names=names, places=places, p_ids=p_ids,
                           p_scores=p_scores):
                    none = np.zeros(0, np.int64)
                    if p_scores[i] is None:
                        return none, none
                    tops = np.asarray(p_scores[i], np.int64)
                    other = labels != mine[i]
                    reach = np.zeros(len(low), bool)
                    for top in tops[tops >= 0].tolist():  # the window of a negative score is empty
                        reach |= (high >= 0.8 * top - 1) & (low <= top)
                    at = np.nonzero(reach & other)[0]
                    values = score(at)
                    for place, pid, top in zip(places[i], p_ids[i], tops.tolist()):
                        # 80 top <= 100 value <= 100 top, without products that could exceed 64 bits
                        inside = np.nonzero((values >= -(-4 * top // 5)) & (values <= top))[0]
                        if len(inside):
                            best = inside[_first(values[inside], ids[at][inside], n_negatives)]
                            k = len(best)
                            out.append((np.full(k, own[i]), np.full(k, names[i]), np.full(k, place), np.full(k, pid),
                                        np.full(k, top), ids[at][best], values[best]))
                    return at, values

                _tree_scores(x, norms, a, np.arange(len(a)), group["parent"].to_numpy(), group["length"].to_numpy(), wanted)
        columns = [np.concatenate(c) for c in zip(*out)] if out else [np.zeros(0, np.int64)] * 7
        return pd.DataFrame(dict(zip(names_of, columns)))

    names_of = ("anchor", "anchor_id", "place", "positive_id", "positive_score", "negative_id", "negative_score")
    found = _by_cells(rows, targets, cell, ", ".join(f"{c} long" for c in names_of), block_rows)
    rank = F.row_number().over(Window.partitionBy("anchor", "place").orderBy(F.desc("negative_score"), "negative_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= n_negatives).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
