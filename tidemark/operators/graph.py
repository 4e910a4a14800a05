"""Graph queries by repeated joins whose state is written between rounds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.sources.tables import scratch


def stored(rows: DataFrame) -> DataFrame:
    """rows in the shared checkpoint folder, without their lineage."""
    spark = rows.sparkSession
    path = f"{scratch(spark)}/rows"
    rows.write.parquet(path)
    return spark.read.schema(rows.schema).parquet(path)


def reachable(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """(node): all that the roots reach over edges (a, b), the roots included.  A round joins the last frontier alone."""
    edges = stored(edges)
    seen = frontier = stored(roots.select("node").distinct())
    while True:
        step = edges.join(frontier, edges["a"] == frontier["node"], "left_semi").select(edges["b"].alias("node")).distinct()
        frontier = stored(step.join(seen, "node", "left_anti"))
        if frontier.isEmpty():
            return seen
        seen = seen.union(frontier)


def _hung(edges: DataFrame, below: bool) -> DataFrame:
    """Edges (a, b), b < a, after each node's neighbours were hung on the least of them and itself: those above it, or those below and itself."""
    both = edges if below else edges.union(edges.select("b", "a"))
    least = both.groupBy("a").agg(F.min("b").alias("least")).withColumn("least", F.least("a", "least"))
    met = both.join(least, "a")
    if below:
        moved = met.select("a", "b", "least").select(F.explode(F.array(F.struct("a", F.col("least").alias("b")), F.struct(F.col("b").alias("a"), F.col("least").alias("b")))).alias("e"))
        return moved.select("e.*").where("a <> b").distinct()
    return met.where("b > a").select(F.col("b").alias("a"), F.col("least").alias("b")).where("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the least node that each node of the edges (a, b) is connected with; nodes without an edge to another have no row.

    Stars alternate: each node hangs its larger neighbours, then its smaller ones, on the least it knows.  Rounds grow as the logarithm of a
    component's size; a node with many edges only meets one row a node in a join, which skew handling splits.  What ends them is counted by
    node: no sum over all edges, which overflows.
    """
    now = stored(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    while not _are_stars(now):
        now = stored(_hung(stored(_hung(now, False)), True))
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select("b", "b").distinct())


def _are_stars(edges: DataFrame) -> bool:
    """Whether each a of the distinct edges (a, b) has one b, which is no edge's a."""
    ends = F.explode(F.array(F.struct(F.col("a").alias("node"), F.lit(1).alias("up")), F.struct(F.col("b").alias("node"), F.lit(0).alias("up"))))
    nodes = edges.select(ends.alias("end")).groupBy("end.node").agg(F.sum("end.up").alias("ups"), F.min("end.up").alias("least"))
    return nodes.where("ups > 1 OR ups > 0 AND least = 0").isEmpty()


def _trimmed(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, trimmed): nodes that no edge leaves, or none enters, are components of their own."""
    inner = edges.select(F.col("a").alias("node")).distinct().join(edges.select(F.col("b").alias("node")).distinct(), "node")
    rest = stored(nodes.join(inner, "node", "left_semi"))
    gone = nodes.join(rest, "node", "left_anti")
    ends = [rest.select(F.col("node").alias(c)) for c in ("a", "b")]
    return rest, stored(edges.join(ends[0], "a", "left_semi").join(ends[1], "b", "left_semi").select("a", "b")), stored(gone)


def strong_components(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, int]:
    """((node, component), rounds): the strongly connected components of edges (a, b), each named by its greatest node.

    A pass trims the ends, lets the greatest name spread forward until nothing changes, and takes what reaches that name's node backward
    inside its colour.  Every pass closes at least one component a colour; rounds are passes' steps, each of which joins only what changed.
    """
    todo = stored(nodes.select("node").distinct())
    edges = stored(edges.where("a <> b").select("a", "b").distinct())
    done: list[DataFrame] = []
    rounds = 0
    while not todo.isEmpty():
        rounds += 1
        todo, edges, gone = _trimmed(todo, edges)
        done.append(gone.select("node", F.col("node").alias("component")))
        if not gone.isEmpty():
            continue
        colours = changed = stored(todo.select("node", F.col("node").alias("colour")))
        while True:
            rounds += 1
            offered = edges.join(changed, edges["a"] == changed["node"]).groupBy(F.col("b").alias("node")).agg(F.max("colour").alias("offer"))
            colours = stored(colours.join(offered, "node", "left").select("node", F.greatest("colour", "offer").alias("colour"), (F.col("offer") > F.col("colour")).alias("new")))
            changed = colours.where("new").select("node", "colour")
            if changed.isEmpty():
                break
        colours = colours.select("node", "colour")
        # Edges inside a colour, walked back from the node that names it.
        ends = [colours.select(F.col("node").alias(n), F.col("colour").alias(c)) for n, c in (("a", "ca"), ("b", "cb"))]
        inside = stored(edges.join(ends[0], "a").join(ends[1], "b").where("ca = cb").select(F.col("b").alias("a"), F.col("a").alias("b")))
        back = reachable(inside, colours.where("node = colour"))
        closed = stored(colours.join(back, "node", "left_semi"))
        done.append(closed.select("node", F.col("colour").alias("component")))
        todo = stored(todo.join(closed, "node", "left_anti"))
        ends = [closed.select(F.col("node").alias(c)) for c in ("a", "b")]
        edges = stored(edges.join(ends[0], "a", "left_anti").join(ends[1], "b", "left_anti").select("a", "b"))
    out = nodes.limit(0).select("node", F.col("node").alias("component"))
    for part in done:
        out = out.union(part)
    return out, rounds


def summaries(nodes: DataFrame, edges: DataFrame, groups: DataFrame, top: int, most_rounds: int = 64) -> DataFrame:
    """(node, bits, settled): the facts of each node (node, bits) joined with those of all that it calls, over edges (a, b).

    Nodes of one component (node, component) have one summary.  Facts rise from callees to callers, a level a round; only components whose callees changed are
    joined again.  What hasn't settled after ``most_rounds`` rounds is widened to ``top``.
    """
    own = stored(nodes.join(groups, "node").groupBy("component").agg(F.bit_or("bits").alias("bits")))
    names = [groups.select(F.col("node").alias(n), F.col("component").alias(c)) for n, c in (("a", "caller"), ("b", "callee"))]
    calls = stored(edges.join(names[0], "a").join(names[1], "b").where("caller <> callee").select("caller", "callee").distinct())
    held = changed = own
    for _ in range(most_rounds):
        offered = calls.join(changed, calls["callee"] == changed["component"]).groupBy("caller").agg(F.bit_or("bits").alias("more"))
        bits = F.col("bits").bitwiseOR(F.coalesce("more", F.lit(0)))
        held = stored(held.join(offered, held["component"] == offered["caller"], "left").select("component", bits.alias("bits"), (bits != F.col("bits")).alias("new")))
        changed = held.where("new").select("component", "bits")
        if changed.isEmpty():
            break
    # Unsettled is whatever calls, at any depth, a component that still changed.
    open_ones = reachable(calls.select(F.col("callee").alias("a"), F.col("caller").alias("b")), changed.select(F.col("component").alias("node"))).withColumn("open", F.lit(True))
    state = held.join(open_ones, held["component"] == open_ones["node"], "left").select("component", "bits", F.col("open").isNull().alias("settled"))
    bits: Column = F.when(F.col("settled"), F.col("bits")).otherwise(F.lit(top))
    return groups.join(state, "component").select("node", bits.cast("long").alias("bits"), "settled")


def depths(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """(node, depth): the fewest edges (a, b) from a root, 0 for roots, of all that they reach.  A round joins the last frontier alone."""
    edges = stored(edges)
    seen = frontier = stored(roots.select("node").distinct().withColumn("depth", F.lit(0)))
    depth = 0
    while True:
        depth += 1
        step = edges.join(frontier, edges["a"] == frontier["node"], "left_semi").select(edges["b"].alias("node")).distinct()
        frontier = stored(step.join(seen, "node", "left_anti").withColumn("depth", F.lit(depth)))
        if frontier.isEmpty():
            return seen
        seen = seen.union(frontier)
