"""Communities of a weighted graph by modularity: rounds of local moves, refinement and contraction over edge tables.

All state is tables: nodes (node, k, loop, community), where k is the summed weight at a node and loop what is within it,
and edges (src, dst, w) in both directions. In a round each node's gain at each neighbouring community comes from one
aggregation over its edges; nodes of a hashed half move to their best community. As the others stay, a round can't swap
two neighbours back and forth for ever, and the best partition seen is kept. Then each community is split anew: nodes
that are still alone join a part of their own community that they gain by and that stays in this round, so parts are
connected. Parts become the nodes of the next level, which begins with the communities found so far. The driver reads one
number a round. Equal seeds give equal partitions on any partitioning, as draws are hashes of node numbers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.sources.shared import stored

#: A gain below this is rounding.
LEAST = 1e-9


def coin(seed: int, turn: int, column: str) -> Column:
    return F.pmod(F.xxhash64(F.lit(seed), F.lit(turn), F.col(column)), F.lit(2)) == 1


def both_ways(edges: DataFrame) -> DataFrame:
    """(src, dst, w) in both directions, summed, of edges (src, dst, weight) in one direction or in both; loops left out."""
    one = edges.where("src <> dst").groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(F.sum(F.col("weight").cast("double")).alias("w"))
    return one.select(F.explode(F.expr("array(struct(a as src, b as dst, w), struct(b as src, a as dst, w))")).alias("e")).select("e.*")


def modularity(edges: DataFrame, clusters: DataFrame, resolution: float = 1.0) -> DataFrame:
    """(communities, modularity), one row, of edges (src, dst, weight) and clusters (sample, cluster): the share of weight
    within communities less the resolution times what their weights would give by chance. No edges: null."""
    sides = both_ways(edges)
    at = lambda c, n: clusters.select(F.col("sample").alias(c), F.col("cluster").alias(n))
    placed = sides.join(at("src", "x"), "src").join(at("dst", "y"), "dst")
    by = placed.groupBy("x").agg(F.sum("w").alias("total"), F.sum(F.when(F.col("x") == F.col("y"), F.col("w")).otherwise(0.0)).alias("within"))
    whole = by.agg(F.sum("total").alias("all"), F.sum("within").alias("within"), F.sum(F.col("total") * F.col("total")).alias("squares"), F.count("*").alias("communities"))
    return whole.select("communities", (F.col("within") / F.col("all") - F.lit(resolution) * F.col("squares") / (F.col("all") * F.col("all"))).alias("modularity"))


def scores(nodes: DataFrame, edges: DataFrame, part: str, total: float, resolution: float, within: str | None = None) -> DataFrame:
    """(node, part, score, stay, inner): what each node of nodes (node, k, `part`) gains at the parts next to it and its own; stay:
    the gain at its own, inner: its weight to the rest of it. within: only along edges whose ends agree in that column."""
    columns = ["node", F.col(part).alias("own"), "k", *([F.col(within).alias("frame")] if within else [])]
    one = nodes.select(*columns)
    far = one.select(F.col("node").alias("dst"), F.col("own").alias("part"), *([F.col("frame").alias("far_frame")] if within else []))
    near = edges.join(far, "dst")
    if within:
        near = near.join(one.select(F.col("node").alias("src"), "frame"), "src").where("frame = far_frame")
    near = near.select(F.col("src").alias("node"), "part", "w")
    reach = near.union(one.select("node", F.col("own").alias("part"), F.lit(0.0))).groupBy("node", "part").agg(F.sum("w").alias("inner"))
    sums = one.groupBy(F.col("own").alias("part")).agg(F.sum("k").alias("sum"))
    rows = reach.join(sums, "part").join(one, "node")
    others = F.col("sum") - F.when(F.col("part") == F.col("own"), F.col("k")).otherwise(0.0)
    return rows.select("node", "own", "part", "k", "inner", (F.col("inner") - F.lit(resolution / total) * F.col("k") * others).alias("score"))


def quality(nodes: DataFrame, edges: DataFrame, total: float, resolution: float) -> float:
    """Modularity of nodes (node, k, loop, community)."""
    at = lambda c, n: nodes.select(F.col("node").alias(c), F.col("community").alias(n))
    same = edges.join(at("src", "x"), "src").join(at("dst", "y"), "dst").where("x = y").agg(F.sum("w").alias("w"))
    sums = nodes.groupBy("community").agg(F.sum("k").alias("k"), F.sum("loop").alias("loop")).agg(F.sum("loop").alias("loop"), F.sum(F.col("k") * F.col("k")).alias("squares"))
    r = sums.crossJoin(same).first()  # two rows of one each
    return ((r["w"] or 0.0) + (r["loop"] or 0.0)) / total - resolution * (r["squares"] or 0.0) / total**2


def moved(nodes: DataFrame, edges: DataFrame, total: float, resolution: float, seed: int, rounds: int, patience: int) -> tuple[DataFrame, float]:
    """nodes in the best partition that rounds of local moves come by, and its modularity; the rounds end when `patience` of
    them in a row have not bettered it."""
    best, top, idle, now = nodes, quality(nodes, edges, total, resolution), 0, nodes
    for turn in range(rounds):
        found = scores(now, edges, "community", total, resolution)
        choice = found.groupBy("node").agg(F.max(F.struct("score", (-F.col("part")).alias("less"))).alias("best"), F.max(F.when(F.col("part") == F.col("own"), F.col("score"))).alias("stay"))
        goes = (F.col("best.score") > F.col("stay") + LEAST) & coin(seed, turn, "node")
        to = choice.where(goes).select("node", (-F.col("best.less")).alias("to"))
        now = stored(now.join(to, "node", "left").select("node", "k", "loop", F.coalesce("to", "community").alias("community")), "moved")
        reached = quality(now, edges, total, resolution)
        if reached > top + LEAST:
            best, top, idle = now, reached, 0
        elif (idle := idle + 1) >= patience:
            break
    return best, top


def refined(nodes: DataFrame, edges: DataFrame, total: float, resolution: float, seed: int, rounds: int) -> DataFrame:
    """nodes with part: a connected piece of the community each is in. A node that is alone joins, where it gains most, a
    part that stays in this round; what stays is drawn by the parts' numbers."""
    now = stored(nodes.withColumn("part", F.col("node")), "parts")
    for turn in range(rounds):
        alone = now.groupBy("part").agg(F.count("*").alias("n"))
        found = scores(now, edges, "part", total, resolution, "community").join(alone.select(F.col("part").alias("own"), "n"), "own")
        free = found.where((F.col("n") == 1) & coin(seed, turn, "own") & ~coin(seed, turn, "part") & (F.col("part") != F.col("own")) & (F.col("score") > LEAST))
        to = stored(free.groupBy("node").agg(F.max(F.struct("score", (-F.col("part")).alias("less"))).alias("best")).select("node", (-F.col("best.less")).alias("to")), "joins")
        if to.isEmpty() and turn > 1:
            break
        now = stored(now.join(to, "node", "left").select("node", "k", "loop", "community", F.coalesce("to", "part").alias("part")), "parts")
    return now


def communities(edges: DataFrame, resolution: float = 1.0, seed: int = 7, levels: int = 10, rounds: int = 20, patience: int = 2) -> DataFrame:
    """(sample, cluster): communities of edges (src, dst, weight) with positive weights, numbered from 1 by their smallest
    sample. Nodes are the ends of edges; no edges give no rows."""
    sides = stored(both_ways(edges), "edges")
    nodes = sides.groupBy(F.col("src").alias("node")).agg(F.sum("w").alias("k"))
    nodes = stored(nodes.select("node", "k", F.lit(0.0).alias("loop"), F.col("node").alias("community")), "nodes")
    total = nodes.agg(F.sum("k")).first()[0]
    placed, top = nodes.select(F.col("node").alias("sample"), "node"), None
    for level in range(levels if total else 0):
        nodes, reached = moved(nodes, sides, total, resolution, seed + 1000 * level, rounds, patience)
        parts = refined(nodes, sides, total, resolution, seed + 1000 * level + 500, rounds)
        placed = stored(placed.join(parts.select("node", "part"), "node").select("sample", F.col("part").alias("node")), "placed")
        before = nodes
        at = lambda c, n: parts.select(F.col("node").alias(c), F.col("part").alias(n))  # noqa: B023, E731
        joined = stored(sides.join(at("src", "x"), "src").join(at("dst", "y"), "dst").groupBy("x", "y").agg(F.sum("w").alias("w")), "edges")
        inner = joined.where("x = y").select(F.col("x").alias("node"), F.col("w").alias("inner"))
        nodes = parts.groupBy(F.col("part").alias("node")).agg(F.sum("k").alias("k"), F.sum("loop").alias("loop"), F.min("community").alias("community")).join(inner, "node", "left")
        nodes = stored(nodes.select("node", "k", (F.col("loop") + F.coalesce("inner", F.lit(0.0))).alias("loop"), "community"), "nodes")
        sides = joined.where("x <> y").select(F.col("x").alias("src"), F.col("y").alias("dst"), "w")
        if top is not None and reached <= top + LEAST and nodes.count() == before.count():
            break
        top = reached
    found = placed.join(nodes.select("node", "community"), "node")
    first = found.groupBy("community").agg(F.min("sample").alias("first"))
    # One row a community is numbered, not the samples.
    order = first.select("community", F.expr("cast(row_number() over (order by first) as int)").alias("cluster"))
    return found.join(order, "community").select("sample", "cluster")
