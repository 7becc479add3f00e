"""Cross-language sameAs links.

``merge_ids`` folds linked entities onto shared ids in two modes:

* ``component`` (default): every entity takes the smallest id of its
  connected component.  Rounds of contraction on id pairs (Boegeholz et al., "In-database connected
  component analysis", ICDE 2020): every node points at the first of itself and its neighbours, and
  the edges move to those pointers, so a round works on the edges between what is left.  Grouped minima
  are partial aggregates, and they are stored before
  the joins that use them, so AQE can split the rows of a hub.  O(log n)
  rounds are expected.
* ``ordered``: the reference's sequential pass, where each link in turn
  gives both ends the smaller of their current ids.  Links only interact
  inside a connected component, so components are found first, the links of
  each are numbered in order and cut into blocks of ``block`` links.  All blocks fold at the
  same time, each from the best ids known for its nodes; an entity's id never rises,
  so what any earlier block gave a node is passed to all its later ones, and only blocks
  that this lowers fold again.  Nothing changes once every block has started
  from the ids that the serial pass would give it.  The rounds are the blocks that an id
  passes one after the other, at most the blocks of the largest component and three for links around a hub.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kgprep.operators.encode import bounded_broadcast, encode_uri
from kgprep.schema import OWL_SAME_AS
from kgprep.session import checkpoint_dir, scratch_path

FOLD_BLOCK = 1 << 16  # links of one component that a task folds in a round


def _checkpoint(df: DataFrame) -> DataFrame:
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def _table(df: DataFrame, name: str) -> DataFrame:
    """``df`` as files of the shared folder.  A checkpoint keeps the partitioning of its plan, and a join
    for which one side needs no shuffle is not split by AQE."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def known_links(links: DataFrame, ent: DataFrame) -> DataFrame:
    """A1: links whose two ends are both in the dictionary (semi-joins)."""
    keys = ent.select("entity")  # a semi-join needs no distinct keys
    return (links.join(keys.withColumnRenamed("entity", "s"), "s", "left_semi")
            .join(keys.withColumnRenamed("entity", "o"), "o", "left_semi"))


def links_as_triples(links: DataFrame, ent: DataFrame, rel: DataFrame | int, predicate: str = OWL_SAME_AS,
                     broadcast_relations: bool | str = "auto") -> DataFrame:
    """A2: links encoded as (id, sameAs relation id, id); unknown ends drop out.

    Every link gets one relation id, whatever its own predicate text: ``rel``
    is either that id or a relation dictionary holding ``predicate`` (the
    relation appended for the links, D9).
    """
    if isinstance(rel, int):
        e = ent.select("entity", "id")
        return (links.select("s", "o")
                .join(e.withColumnRenamed("entity", "s").withColumnRenamed("id", "_s_id"), "s")
                .join(e.withColumnRenamed("entity", "o").withColumnRenamed("id", "_o_id"), "o")
                .select(F.col("_s_id").alias("s"), F.lit(rel).cast("long").alias("p"), F.col("_o_id").alias("o")))
    return encode_uri(links.withColumn("p", F.lit(predicate)), ent, rel, broadcast_relations=broadcast_relations)


def with_links(train: DataFrame, link_triples: DataFrame) -> DataFrame:
    """A3: append encoded links to an encoded training set (bag union)."""
    return train.select("s", "p", "o").unionByName(link_triples.select("s", "p", "o"))


def link_id_pairs(links: DataFrame, ent: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Links as ``(a, b)`` id pairs; links with an unknown end are ignored.

    The links are stored first.  An end that is one literal for all of them would else be moved from the join into a
    filter on the dictionary, and what is left of the join is a product of all partitions of both sides.
    """
    e = ent.select("entity", "id")
    return (_checkpoint(links.select(*keep, "s", "o"))
            .join(e.withColumnRenamed("entity", "s").withColumnRenamed("id", "a"), "s")
            .join(e.withColumnRenamed("entity", "o").withColumnRenamed("id", "b"), "o")
            .select(*keep, "s", "o", "a", "b"))


def component_labels(pairs: DataFrame, max_rounds: int | None = None) -> DataFrame:
    """``(node, label)``: smallest node of each connected component of the
    undirected graph given by ``(a, b)`` pairs (self pairs allowed)."""
    edges = _checkpoint(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
                        .where("a <> b").distinct())
    pointers = []
    while not edges.isEmpty():
        turn = len(pointers)
        if max_rounds is not None and turn >= max_rounds:
            raise RuntimeError(f"components did not converge in {max_rounds} rounds")
        # two rounds in the order of the nodes make a star of a hub; random orders shorten chains
        def place(node):
            return F.col(node) if turn < 2 or turn % 2 else F.xxhash64(F.lit(turn), node)

        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        near = both.groupBy("a").agg(F.min_by("b", place("b")).alias("m"))
        ahead = place("m") < place("a")
        to = near.select(F.col("a").alias("node"), F.when(ahead, F.col("m")).otherwise(F.col("a")).alias("p"))
        to = _table(to, "pointers")
        pointers.append(to)
        # the pointers are stored, so AQE can split the rows of a hub
        moved = (edges.join(to.select(F.col("node").alias("a"), F.col("p").alias("_a")), "a")
                 .join(to.select(F.col("node").alias("b"), F.col("p").alias("_b")), "b"))
        moved = _checkpoint(moved.select(F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b")))
        edges = _checkpoint(moved.where("a <> b").distinct())
    if not pointers:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("label"))
    labels = pointers[-1].withColumnRenamed("p", "label")
    for to in reversed(pointers[:-1]):
        # a node that is its own pointer may have no edge left, and so no row in the next round
        up = _checkpoint(labels).select(F.col("node").alias("p"), "label")
        labels = to.join(up, "p", "left").select("node", F.coalesce("label", "p").alias("label"))
    labels = _checkpoint(labels)
    least = bounded_broadcast(labels.groupBy("label").agg(F.min("node").alias("_least")))
    return labels.join(least, "label").select("node", F.col("_least").alias("label"))


def grow_components(labels: DataFrame, links: DataFrame, max_rounds: int | None = None) -> DataFrame:
    """A5 for links that arrive in batches: ``(node, label)`` after ``links``, ``(a, b)`` pairs, are added to ``labels``.

    The new links are contracted onto the stored labels, so the rounds work on
    at most as many edges as there are new links between different components, whatever the size of
    the old graph.  One lookup join finds the ends' labels and one relabels the nodes.  Labels stay the smallest
    node of their component; ``labels`` holds each node once (``component_labels``).
    """
    stored = _checkpoint(labels.select("node", "label"))
    pairs = _checkpoint(links.select("a", "b").distinct())
    ends = pairs
    for end in ("a", "b"):
        now = stored.select(F.col("node").alias(end), F.col("label").alias(f"_{end}"))
        ends = ends.join(now, end, "left")
    ends = ends.select(F.coalesce("_a", "a").alias("a"), F.coalesce("_b", "b").alias("b")).where("a <> b").distinct()
    moved = _checkpoint(component_labels(_checkpoint(ends), max_rounds))
    # labels that moved are few beside the nodes: broadcast if measured small
    moved_to = bounded_broadcast(moved.where("node <> label").select(F.col("node").alias("label"), F.col("label").alias("_to")))
    old = stored.join(moved_to, "label", "left").select("node", F.coalesce("_to", "label").alias("label"))
    # nodes that only the new links have, loops included
    nodes = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(stored, "node", "left_anti")
    new = nodes.join(moved, "node", "left").select("node", F.coalesce("label", "node").alias("label"))
    return _checkpoint(old.unionByName(new))


def _numbered(tagged: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Adds ``rank``: 0, 1, 2, ... within ``comp`` in the order of ``keys``.

    Range partitioning on the component and the order splits a large
    component among tasks.  After a checkpoint the partitions are fixed and a
    component is contiguous in each, so a position minus the component's first position in its
    partition, plus its rows in earlier partitions, is the rank.
    """
    order = ["comp", *keys]
    placed = _checkpoint(tagged.repartitionByRange(*order).sortWithinPartitions(*order))
    placed = placed.withColumn("t", F.monotonically_increasing_id()).withColumn("pid", F.shiftright("t", 33))
    parts = placed.groupBy("comp", "pid").agg(F.min("t").alias("first"), F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("comp").orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = _checkpoint(parts.withColumn("off", F.coalesce(F.sum("n").over(before), F.lit(0))))
    return (placed.join(offsets, ["comp", "pid"])
            .withColumn("rank", F.col("off") + F.col("t") - F.col("first")).drop("t", "pid", "first", "n", "off"))


def _fold_sorted_partitions():
    """mapInPandas body: rows arrive sorted by (comp, blk, rank), so a block
    is a contiguous run: first the ids that its nodes start from (rank -1, ``a`` the
    node, ``b`` its id; a node without such a row starts from itself), then its links,
    folded one by one.  Emits each node's id at the start and the end of the block.
    State is the nodes of one block."""

    def run(batches):
        import pandas as pd

        def rows(block, start, val):
            return [(*block, n, start[n], v) for n, v in val.items()]

        cur, start, val = None, {}, {}
        for pdf in batches:
            done = []
            for comp, blk, rank, a, b in zip(*[pdf[k].tolist() for k in ("comp", "blk", "rank", "a", "b")]):
                if (comp, blk) != cur:
                    done += rows(cur, start, val)
                    cur, start, val = (comp, blk), {}, {}
                if rank < 0:
                    start[a] = val[a] = b
                else:
                    for n in (a, b):
                        if n not in val:
                            start[n] = val[n] = n
                    val[a] = val[b] = min(val[a], val[b])
            if done:
                yield pd.DataFrame(done, columns=["comp", "blk", "node", "start", "end"], dtype="int64")
        if val:
            yield pd.DataFrame(rows(cur, start, val), columns=["comp", "blk", "node", "start", "end"], dtype="int64")

    return run


def _fold_blocks(rows: DataFrame) -> DataFrame:
    """``(comp, blk, node, start, end)`` of the blocks in ``rows`` (see ``_fold_sorted_partitions``)."""
    return (rows.repartition("comp", "blk").sortWithinPartitions("comp", "blk", "rank")
            .mapInPandas(_fold_sorted_partitions(), "comp long, blk long, node long, start long, end long"))


def ordered_labels(pairs: DataFrame, order_cols: Sequence[str], block: int = FOLD_BLOCK,
                   max_rounds: int | None = None) -> DataFrame:
    """``(node, label)`` after processing links one by one in ``order_cols``
    order (then by ends), each link giving both ends the minimum of their current ids."""
    keys = [*order_cols, "a", "b"]
    links = pairs.where(F.col("a") != F.col("b")).select(*keys).dropDuplicates(keys)
    comp = component_labels(links, max_rounds)
    tagged = links.join(comp.select(F.col("node").alias("a"), F.col("label").alias("comp")), "a")
    ranked = _checkpoint(_numbered(tagged, keys)
                         .select("comp", F.floor(F.col("rank") / block).alias("blk"), "rank", "a", "b"))
    if ranked.isEmpty():
        return comp.select("node", "label").limit(0)
    # one row a block beyond the first, so at most links / block of them
    open_ = bounded_broadcast(ranked.where("blk > 0").select("comp").distinct())
    state = _checkpoint(_fold_blocks(ranked))
    # finished components are appended to one table, so the plan does not grow with the rounds
    path = scratch_path(pairs.sparkSession, "folded")
    state.join(open_, "comp", "left_anti").select("node", F.col("end").alias("label")).write.parquet(path)
    state = state.join(open_, "comp", "left_semi")
    earlier = Window.partitionBy("node").orderBy("blk").rowsBetween(Window.unboundedPreceding, -1)
    while not state.isEmpty():
        state = _checkpoint(state.withColumn("best", F.least("node", F.min("end").over(earlier))))
        stale = bounded_broadcast(state.where("best < start").select("comp", "blk").distinct())
        open_ = stale.select("comp")
        (state.join(open_, "comp", "left_anti").groupBy("node").agg(F.min("end").alias("label"))
         .write.mode("append").parquet(path))
        state = state.join(open_, "comp", "left_semi")
        again = (state.join(stale, ["comp", "blk"], "left_semi")
                 .select("comp", "blk", F.lit(-1).cast("long").alias("rank"), F.col("node").alias("a"), F.col("best").alias("b"))
                 .unionByName(ranked.join(stale, ["comp", "blk"], "left_semi")))
        state = _checkpoint(state.join(stale, ["comp", "blk"], "left_anti").drop("best").unionByName(_fold_blocks(again)))
    return pairs.sparkSession.read.schema("node long, label long").parquet(path)


def merge_ids(ent: DataFrame, links: DataFrame, mode: str = "component",
              order_by: Sequence[str] = ("s", "o"), max_rounds: int | None = None,
              block: int = FOLD_BLOCK) -> DataFrame:
    """The merged dictionary ``(entity, id)`` over all entities.

    ``ent`` needs one id per entity (``as_lookup``).  Links with an unknown
    end are ignored (A1).  ``order_by`` (ordered mode) names link columns
    giving the processing order, subject then object by default.
    """
    keep = [c for c in order_by if c not in ("s", "o")]
    # the dictionary feeds both the link ids and the final relabelling:
    # materialise it once in the shared checkpoint folder
    ent = _checkpoint(ent.select("entity", "id"))
    pairs = link_id_pairs(links, ent, keep)
    if mode == "component":
        labels = component_labels(pairs, max_rounds)
    elif mode == "ordered":
        labels = ordered_labels(pairs, list(order_by), block=block, max_rounds=max_rounds)
    else:
        raise ValueError(f"mode must be component or ordered, not {mode!r}")
    return (ent.join(labels, ent["id"] == labels["node"], "left")
            .select("entity", F.coalesce("label", "id").alias("id")))
