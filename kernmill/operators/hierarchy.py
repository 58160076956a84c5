"""Full hierarchies from parent-child rows (problem 5).

Pointer doubling separates trees from loops and yields subtree sizes in a number
of rounds logarithmic in the depth.  Heavy-path decomposition then labels chains:
every node continues the chain of its parent if it is the child with the largest
subtree, else it starts one.  A root path crosses at most log2(n) chains, so
paths come from joining chain segments, and descendants from chain intervals.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kernmill.operators.skew import hot_keys, salted_lookup
from kernmill.session import stage, unstage


@dataclass
class Forest:
    """``nodes``: prop, parent, n_parents, on_tree, chain (its top node), pos (place in it), subtree_size.
    ``chains``: chain, root, depth (of its top), above (the node it hangs below), chain_up, pos_up.
    Both hold numbers only; paths and members are made where they are asked for."""

    nodes: DataFrame
    chains: DataFrame


def property_edges(subprops: DataFrame, child: str = "s", parent: str = "o") -> DataFrame:
    """Edges ``child, parent`` whose two ends both start with P; other rows are ignored."""
    c, p = F.col(child), F.col(parent)
    return subprops.where(c.startswith("P") & p.startswith("P")).select(c.alias("child"), p.alias("parent"))


def _doubling(edges: DataFrame) -> tuple[DataFrame, int]:
    """State table id, up, n_parents, ptr, size after the last round, and the round.

    ``ptr`` is the ancestor 2**round steps up and null where there is none; what
    still has one when no more nodes resolve lies on a loop or below one.
    """
    up = edges.where(F.col("child").isNotNull() & F.col("parent").isNotNull()).groupBy("child").agg(
        F.min("parent").alias("up"), F.count_distinct("parent").alias("n_parents")
    )
    ids = edges.select(F.explode(F.array("child", "parent")).alias("id")).where("id is not null").distinct()
    state = stage(
        ids.join(up.withColumnRenamed("child", "id"), "id", "left").select(
            "id", "up", F.coalesce("n_parents", F.lit(0)).alias("n_parents"), F.col("up").alias("ptr"),
            F.lit(1).cast("long").alias("size"),
        ), "forest",
    )
    open_before, k = None, 0
    while True:
        n_open = state.where("ptr is not null").count()
        if n_open == 0 or n_open == open_before:
            return state, k
        open_before = n_open
        gained = state.where("ptr is not null").groupBy("ptr").agg(F.sum("size").alias("gain"))
        hot = hot_keys(state, "ptr", rows=n_open)
        jumped = salted_lookup(
            state.where("ptr is not null").select("id", "ptr"),
            state.select(F.col("id").alias("ptr"), F.col("ptr").alias("next")), "ptr", F.col("id"), hot,
        ).select("id", "next")
        new = (
            state.join(gained.withColumnRenamed("ptr", "id"), "id", "left")
            .join(jumped, "id", "left")
            .select("id", "up", "n_parents", F.col("next").alias("ptr"),
                    (F.col("size") + F.coalesce("gain", F.lit(0))).alias("size"))
        )
        new = stage(new, "forest")
        unstage(state)
        state, k = new, k + 1


def _loop_members(open_nodes: DataFrame) -> DataFrame:
    """Nodes on loops: the stable image of iterating the parent pointer."""
    ptrs = stage(open_nodes.select("id", F.col("ptr").alias("to")), "loops")
    size, total = -1, ptrs.count()
    while True:
        image = ptrs.select("to").distinct()
        n = image.count()
        if n == size:
            return image.select(F.col("to").alias("id"))
        size = n
        new = stage(
            salted_lookup(ptrs, ptrs.select(F.col("id").alias("to"), F.col("to").alias("next")), "to", F.col("id"),
                          hot_keys(ptrs, "to", rows=total)).select("id", F.col("next").alias("to")), "loops",
        )
        unstage(ptrs)
        ptrs = new


def _chain_places(tree: DataFrame) -> DataFrame:
    """Tree nodes with ``chain``, the top node of the heavy chain each lies on, and ``pos``, the steps from it.

    Doubling along the heavy hops; no chain is ever gathered in one row.
    """
    heavy = tree.where("up is not null").groupBy("up").agg(
        F.min_by("id", F.struct(-F.col("size"), F.col("id"))).alias("id")
    )
    state = stage(
        tree.join(heavy.select("id", F.col("up").alias("hop")), "id", "left").select(
            "id", "hop", F.when(F.col("hop").isNull(), F.col("id")).alias("chain"), F.col("hop").isNotNull().cast("long").alias("pos")
        ), "chains",
    )
    # a heavy hop leads to one child only, so both sides of the join are unique
    while state.where("chain is null").limit(1).count():
        target = state.select(
            F.col("id").alias("hop"), F.col("hop").alias("hop2"), F.col("chain").alias("chain2"), F.col("pos").alias("pos2")
        )
        done = state.where("chain is not null")
        going = state.where("chain is null").drop("chain").join(target, "hop").select(
            "id", F.when(F.col("chain2").isNull(), F.col("hop2")).alias("hop"), F.col("chain2").alias("chain"),
            (F.col("pos") + F.col("pos2")).alias("pos"),
        )
        new = stage(done.select("id", "hop", "chain", "pos").unionByName(going), "chains")
        unstage(state)
        state = new
    return state.select("id", "chain", "pos")


def _levels(roots: DataFrame, below: DataFrame, join) -> DataFrame:
    """Union of ``roots`` and what ``join(below, level)`` makes of each level until nothing hangs below it.

    A root path crosses at most log2(n) chains, so there are that many levels.
    """
    level = stage(roots, "level")
    out = level
    while True:
        level = stage(join(below, level), "level")
        if level.limit(1).count() == 0:
            unstage(level)
            return out
        out = out.unionByName(level)


def build_forest(edges: DataFrame) -> Forest:
    """Decompose ``edges`` (``child, parent``; repeats and nulls allowed).

    A child with several distinct parents hangs below the smallest of them;
    ``n_parents`` tells and ``other_parents`` names the rest.  A loop of any length,
    also of one, and everything below it is no tree and has no chain.  No edges give
    no nodes.
    """
    state, _ = _doubling(edges)
    tree = state.where("ptr is null")
    placed = stage(tree.join(_chain_places(tree), "id").select("id", "up", "n_parents", "size", "chain", "pos"), "placed")
    heads = placed.where("pos = 0").select("chain", F.col("up").alias("above"))
    at = placed.select(F.col("id").alias("above"), F.col("chain").alias("chain_up"), F.col("pos").alias("pos_up"))
    n = placed.count()
    hung = stage(
        salted_lookup(heads, at, "above", F.col("chain"), hot_keys(heads, "above", rows=n)).select("chain", "above", "chain_up", "pos_up"),
        "hung",
    )
    hot = hot_keys(hung, "chain_up", rows=n)

    def down(below: DataFrame, level: DataFrame) -> DataFrame:
        up = level.select(F.col("chain").alias("chain_up"), "root", F.col("depth").alias("_d"))
        return salted_lookup(below, up, "chain_up", F.col("chain"), hot).select(
            "chain", "root", (F.col("_d") + F.col("pos_up") + 1).alias("depth"), "above", "chain_up", "pos_up"
        )

    roots = heads.where("above is null").select(
        "chain", F.col("chain").alias("root"), F.lit(0).cast("long").alias("depth"), "above",
        F.lit(None).cast("string").alias("chain_up"), F.lit(None).cast("long").alias("pos_up"),
    )
    chains = _levels(roots, hung, down)
    on_tree = placed.select(
        F.col("id").alias("prop"), F.col("up").alias("parent"), "n_parents", F.lit(True).alias("on_tree"), "chain", "pos",
        F.col("size").alias("subtree_size"),
    )
    off = state.where("ptr is not null").select(
        F.col("id").alias("prop"), F.col("up").alias("parent"), "n_parents", F.lit(False).alias("on_tree"),
        F.lit(None).cast("string").alias("chain"), F.lit(None).cast("long").alias("pos"), F.lit(None).cast("long").alias("subtree_size"),
    )
    return Forest(on_tree.unionByName(off), chains)


def roots_and_depths(forest: Forest) -> DataFrame:
    """``prop, root, depth``; 'cycle' and -1 on or below a loop.  Chain numbers alone; no path is built."""
    tree = forest.nodes.where("on_tree")
    hot = hot_keys(tree, "chain")
    found = salted_lookup(tree.select("prop", "chain", "pos"), forest.chains.select("chain", "root", "depth"), "chain", F.col("prop"), hot)
    off = forest.nodes.where("not on_tree").select("prop", F.lit("cycle").alias("root"), F.lit(-1).cast("long").alias("depth"))
    return found.select("prop", "root", (F.col("depth") + F.col("pos")).alias("depth")).unionByName(off)


def other_parents(edges: DataFrame) -> DataFrame:
    """``child, parent``: the distinct edges of children with several parents that the forest does not follow."""
    e = edges.where("child is not null and parent is not null").distinct()
    kept = e.groupBy("child").agg(F.min("parent").alias("_kept"), F.count(F.lit(1)).alias("_c")).where("_c > 1")
    return e.join(kept, "child").where("parent <> _kept").select("child", "parent")


def labelled_chains(forest: Forest) -> DataFrame:
    """``chain, members, prefix``: the chain's nodes from the top, and the path above it from the root.

    Both are as long as the longest path through the chain, which the result holds anyway.
    """
    members = forest.nodes.where("on_tree").groupBy("chain").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("pos", "prop"))), lambda m: m["prop"]).alias("members")
    )
    info = stage(forest.chains.join(members, "chain"), "labels")
    hot = hot_keys(info, "chain_up")

    def down(below: DataFrame, level: DataFrame) -> DataFrame:
        up = level.select(F.col("chain").alias("chain_up"), F.col("members").alias("_m"), F.col("prefix").alias("_p"))
        return salted_lookup(below, up, "chain_up", F.col("chain"), hot).select(
            "chain", "members", F.concat("_p", F.slice("_m", F.lit(1), F.col("pos_up").cast("int") + 1)).alias("prefix")
        )

    roots = info.where("above is null").select("chain", "members", F.array().cast("array<string>").alias("prefix"))
    return _levels(roots, info.where("above is not null"), down)


def node_paths(forest: Forest, chains: DataFrame) -> DataFrame:
    """All nodes: ``prop, parent, n_parents, status, chain, pos, subtree_size, path``.

    Status is 'tree', 'loop' or 'below_loop'; the path begins at the root and is null
    off trees.
    """
    paths = chains.select("prefix", "members", F.posexplode("members").alias("_i", "prop")).select(
        "prop", F.concat("prefix", F.slice("members", F.lit(1), F.col("_i") + 1)).alias("path")
    )
    off = forest.nodes.where("not on_tree")
    loop = _loop_members(off.select(F.col("prop").alias("id"), F.col("parent").alias("ptr")))
    marked = forest.nodes.join(loop.select(F.col("id").alias("prop"), F.lit(True).alias("_on")), "prop", "left").join(paths, "prop", "left")
    return marked.select(
        "prop", "parent", "n_parents",
        F.when(F.col("on_tree"), "tree").when(F.col("_on"), "loop").otherwise("below_loop").alias("status"),
        "chain", "pos", "subtree_size", "path",
    )


def chain_intervals(chains: DataFrame) -> DataFrame:
    """All descendants of each tree node as chain intervals.

    Rows ``prop, chain, from_pos, to_pos`` (inclusive): the rest of the node's own
    chain, and every chain hanging below it whole.  A leaf has no row.
    """
    last = F.size("members") - 1
    own = chains.select("chain", last.cast("int").alias("to_pos"), F.posexplode("members").alias("pos", "prop")).where(
        "pos < to_pos"
    ).select("prop", "chain", (F.col("pos") + 1).alias("from_pos"), "to_pos")
    hanging = chains.select(
        F.explode("prefix").alias("prop"), "chain", F.lit(0).alias("from_pos"), last.cast("int").alias("to_pos"),
    )
    return own.unionByName(hanging)


def descendants(chains: DataFrame) -> DataFrame:
    """Pairs ``prop, descendant``, expanded from the chain intervals of ``labelled_chains``."""
    return chain_intervals(chains).join(chains.select("chain", "members"), "chain").select(
        "prop", F.explode(F.slice("members", F.col("from_pos") + 1, F.col("to_pos") - F.col("from_pos") + 1)).alias("descendant")
    )
