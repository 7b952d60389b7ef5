"""Property graphs as node and edge tables.

nodes has `id`, `label` and any properties; edges has `src`, `dst` and `type`.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.scratch import cut


@dataclass(frozen=True)
class Graph:
    nodes: DataFrame
    edges: DataFrame


def neighbors(edges: DataFrame, node) -> DataFrame:
    """(dst) of every edge from node, repeated as edges are."""
    return edges.filter(F.col("src") == node).select("dst")


def degrees(edges: DataFrame) -> DataFrame:
    """(id, out_degree, in_degree) of every end of an edge."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("src").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("dst").alias("id"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("e"))
    return ends.groupBy(F.col("e.id").alias("id")).agg(F.sum("e.o").cast("bigint").alias("out_degree"), F.sum("e.i").cast("bigint").alias("in_degree"))


def adjacency(edges: DataFrame) -> DataFrame:
    """(src, dsts): each node's out-neighbours in order."""
    return edges.groupBy("src").agg(F.sort_array(F.collect_list("dst")).alias("dsts"))


def two_hop(edges: DataFrame, start) -> DataFrame:
    """(id) of distinct nodes at the end of a walk of two edges from start, but start."""
    first = edges.filter(F.col("src") == start).select(F.col("dst").alias("mid")).distinct()
    return first.join(edges, F.col("mid") == F.col("src")).filter(F.col("dst") != start).select(F.col("dst").alias("id")).distinct()


def bfs(edges: DataFrame, start, max_depth: int) -> DataFrame:
    """(depth, id) of nodes within max_depth edges of start, each at its least depth; start is at 0.

    Each round joins the frontier with the edges and drops what was seen. What a
    round finds is written to the shared folder, so no plan grows with the depth
    and a lost executor costs no earlier round.
    """
    spark = edges.sparkSession
    hops = edges.select(F.col("src").alias("__src"), F.col("dst").alias("id"))
    seen = spark.range(1).select(F.lit(0).alias("depth"), F.lit(start).cast(edges.schema["src"].dataType).alias("id"))
    frontier, found = seen, [seen]
    for depth in range(1, max_depth + 1):
        reached = frontier.select(F.col("id").alias("__at")).join(hops, F.col("__at") == F.col("__src")).select("id").distinct()
        known = found[0]
        for f in found[1:]:
            known = known.unionByName(f)
        frontier = cut(reached.join(known.select("id"), "id", "left_anti").select(F.lit(depth).alias("depth"), "id"), f"bfs{depth}")
        if frontier.isEmpty():
            break
        found.append(frontier)
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


def bfs_ids(edges: DataFrame, start, max_depth: int) -> DataFrame:
    """(id) of bfs in its order: by depth, then by id."""
    return bfs(edges, start, max_depth).orderBy("depth", "id").select("id")


def add_nodes(g: Graph, nodes: DataFrame) -> Graph:
    """The graph with more nodes; one whose id is there already takes the old one's place."""
    return Graph(g.nodes.join(nodes, "id", "left_anti").unionByName(nodes, allowMissingColumns=True), g.edges)


def add_edges(g: Graph, edges: DataFrame) -> Graph:
    return Graph(g.nodes, g.edges.unionByName(edges, allowMissingColumns=True))


def counts(g: Graph) -> DataFrame:
    """One row: nodes, edges."""
    return g.nodes.agg(F.count("*").alias("nodes")).crossJoin(F.broadcast(g.edges.agg(F.count("*").alias("edges"))))  # one row each


def _steps(edges: DataFrame, direction: str, kind: str | None) -> DataFrame:
    if kind is not None:
        edges = edges.filter(F.col("type") == kind)
    out = edges.select(F.col("src").alias("__from"), F.col("dst").alias("__to"))
    back = edges.select(F.col("dst").alias("__from"), F.col("src").alias("__to"))
    return {"out": out, "in": back}[direction] if direction != "both" else out.unionByName(back)


def match(g: Graph, nodes: list[tuple[str, DataFrame, bool]], edges: list[tuple[str, str | None, int, int | None]], max_hops: int) -> DataFrame:
    """Distinct walks by their named nodes and length.

    nodes are (variable, its nodes, whether they are fewer than all); edges are
    (direction, type, least, most hops). Columns are variable__property for each
    node, and hops. Walks may pass a node again; equal ends and length count once.
    """
    def ids(i: int) -> DataFrame:
        return nodes[i][1].select(F.col("id").alias(f"__n{i}"))

    walk = ids(0).withColumn("hops", F.lit(0))
    names = ["__n0"]
    for i, (direction, kind, least, most) in enumerate(edges):
        most = max_hops if most is None else most
        if least > most:
            raise ValueError(f"{least} to {most} hops are none")
        steps = _steps(g.edges, direction, kind).distinct()
        here = walk.withColumn("__at", F.col(names[-1]))
        parts = [here] if least == 0 else []
        for hop in range(1, most + 1):
            here = here.join(steps, F.col("__at") == F.col("__from")).select(*names, (F.col("hops") + 1).alias("hops"), F.col("__to").alias("__at")).distinct()
            if hop >= least:
                parts.append(here)
        walk = parts[0]
        for p in parts[1:]:
            walk = walk.unionByName(p)
        name = f"__n{i + 1}"
        walk = walk.withColumnRenamed("__at", name)
        if nodes[i + 1][2]:
            walk = walk.join(ids(i + 1), name, "left_semi")
        names.append(name)
        walk = walk.select(*names, "hops")
        if len(parts) > 1:
            walk = walk.distinct()
    for i, (variable, df, _) in enumerate(nodes):
        walk = walk.join(df.select(*[F.col(c).alias(f"{variable}__{c}") for c in df.columns]), F.col(f"__n{i}") == F.col(f"{variable}__id"))
    return walk.select(*[f"{v}__{c}" for v, df, _ in nodes for c in df.columns], "hops")
