"""The weighted graph of scopes, and personalised PageRank over it."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from tarnwork.sources.readers import written

# Weights of the edge kinds, and the kinds of scopes that edges end at or start from.
WEIGHTS = {"CALLS_FUNCTION": 3.0, "IMPORTS_MODULE": 2.0, "HAS_PROPERTY": 1.0}
CALLEES = ("function", "method", "struct", "class", "enum", "impl")
OWNERS = ("struct", "enum", "class", "impl", "trait")

#: Up to so many edges PageRank is iterated in the driver's memory (24 bytes an edge); beyond, as joins.
SMALL_GRAPH = 200_000


def edge_weight(kind: Column) -> Column:
    out = F.when(F.lit(False), 0.0)
    for name, weight in WEIGHTS.items():
        out = out.when(kind == name, F.lit(weight))
    return out


def scope_nodes(chunks: DataFrame) -> DataFrame:
    """key, name, kind, file_path, line_start, line_end: a node per distinct chunk and one per file."""
    own = chunks.select(F.col("chunk_id").alias("key"), "name", "kind", "file_path", "line_start", "line_end").dropDuplicates(["key"])
    base = F.element_at(F.split("file_path", r"[/\\]"), -1)
    files = chunks.select("file_path").distinct()
    files = files.select(F.concat(F.lit("module::"), "file_path").alias("key"), base.alias("name"), F.lit("module").alias("kind"), "file_path", F.lit(1).alias("line_start"), F.lit(1).alias("line_end"))
    return own.unionByName(files)


def call_edges(chunks: DataFrame) -> DataFrame:
    """Caller to callee by an equi-join of call sites with names, instead of a scan for every pair."""
    sites = chunks.select(F.col("chunk_id").alias("src_key"), F.explode("calls").alias("name")).distinct()
    callees = chunks.where(F.col("kind").isin(*CALLEES)).select(F.col("chunk_id").alias("dst_key"), "name").distinct()
    return sites.join(callees, "name").where("src_key <> dst_key").select("src_key", "dst_key", F.lit("CALLS_FUNCTION").alias("kind"))


def import_edges(nodes: DataFrame, imports: DataFrame) -> DataFrame:
    """File to every node that has an imported name."""
    sources = imports.select(F.concat(F.lit("module::"), "file_path").alias("src_key"), "name").distinct()
    known = nodes.where("key LIKE 'module::%'").select(F.col("key").alias("src_key"))
    named = nodes.select(F.col("key").alias("dst_key"), "name")
    return sources.join(known, "src_key", "left_semi").join(named, "name").where("src_key <> dst_key").select("src_key", "dst_key", F.lit("IMPORTS_MODULE").alias("kind"))


def containment(owners: DataFrame, children: DataFrame, key: str) -> DataFrame:
    """owner_id and child_id of intervals (id, line_start, line_end) inside others of the same ``key``, smaller at one end at least.

    The equality keeps the join partitioned by ``key``; the range is checked in the join.
    """
    o, c = owners.alias("o"), children.alias("c")
    inside = (F.col("c.line_start") >= F.col("o.line_start")) & (F.col("c.line_end") <= F.col("o.line_end"))
    smaller = (F.col("c.line_start") > F.col("o.line_start")) | (F.col("c.line_end") < F.col("o.line_end"))
    joined = o.join(c, (F.col(f"o.{key}") == F.col(f"c.{key}")) & inside & smaller & (F.col("o.id") != F.col("c.id")))
    return joined.select(F.col(f"o.{key}").alias(key), F.col("o.id").alias("owner_id"), F.col("c.id").alias("child_id"))


def property_edges(chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges from types to the scopes inside them and to their fields; and the nodes of those fields."""
    rows = chunks.select(F.col("chunk_id").alias("id"), "file_path", "line_start", "line_end", "kind").distinct()
    inside = containment(rows.where(F.col("kind").isin(*OWNERS)), rows, "file_path").select(F.col("owner_id").alias("src_key"), F.col("child_id").alias("dst_key"))
    fields = chunks.where("kind = 'struct'").select("chunk_id", "file_path", "line_start", "line_end", F.explode("fields").alias("name")).distinct()
    key = F.concat("chunk_id", F.lit("#field#"), "name")
    nodes = fields.select(key.alias("key"), "name", F.lit("struct").alias("kind"), "file_path", "line_start", "line_end")
    edges = inside.unionByName(fields.select(F.col("chunk_id").alias("src_key"), key.alias("dst_key")))
    return edges.withColumn("kind", F.lit("HAS_PROPERTY")), nodes


def scope_graph(chunks: DataFrame, imports: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes, and distinct edges (src_key, dst_key, kind, weight)."""
    nodes = scope_nodes(chunks)
    owned, fields = property_edges(chunks)
    edges = call_edges(chunks).unionByName(import_edges(nodes, imports)).unionByName(owned).distinct()
    return nodes.unionByName(fields), edges.withColumn("weight", edge_weight(F.col("kind")))


def adjacency(edges: DataFrame) -> DataFrame:
    """src_key, dst_key and the share of the source's weight, parallel edges summed."""
    sums = edges.groupBy("src_key", "dst_key").agg(F.sum("weight").alias("weight"))
    out = sums.groupBy("src_key").agg(F.sum("weight").alias("out_sum"))
    return sums.join(out, "src_key").where("out_sum > 0").select("src_key", "dst_key", (F.col("weight") / F.col("out_sum")).alias("share"))


def focus_from_hits(hits: DataFrame, floor: float) -> DataFrame:
    """key and mass: hits (key, similarity) at or above ``floor``, summed per node."""
    return hits.where(F.col("similarity") >= floor).groupBy("key").agg(F.sum("similarity").alias("mass"))


def _start(nodes: DataFrame, focus: DataFrame | None) -> DataFrame:
    """key and p: the focus scaled to sum 1, or all nodes alike if it has no positive mass."""
    keys = nodes.select("key").distinct()
    if focus is not None:
        own = focus.where("mass > 0").join(keys, "key", "left_semi").groupBy("key").agg(F.sum("mass").alias("mass"))
        total = own.agg(F.sum("mass")).first()[0]
        if total:
            return keys.join(own, "key", "left").select("key", (F.coalesce("mass", F.lit(0.0)) / total).alias("p"))
    n = keys.count()
    return keys.select("key", F.lit(1.0 / max(n, 1)).alias("p"))


def personalized_pagerank(nodes: DataFrame, edges: DataFrame, focus: DataFrame | None = None, damping: float = 0.85, iterations: int = 50, tolerance: float = 1e-12, small_graph: int = SMALL_GRAPH) -> DataFrame:
    """key and rank. Mass of nodes without edges goes back to the focus; stops after the step that moves less than ``tolerance``."""
    damping = min(max(damping, 0.0), 1.0)
    start, adj = written(_start(nodes, focus), "pagerank-start"), written(adjacency(edges), "pagerank-edges")
    if adj.count() + start.count() <= small_graph:
        return _in_memory(start, adj, damping, iterations, tolerance)
    rank = start.select("key", "p", F.col("p").alias("rank"))
    for _ in range(iterations):
        flow = rank.join(adj, rank["key"] == adj["src_key"]).groupBy("dst_key").agg(F.sum(F.col("rank") * F.col("share")).alias("flow"))
        moved = written(rank.join(flow, rank["key"] == flow["dst_key"], "left").select("key", "p", "rank", F.coalesce("flow", F.lit(0.0)).alias("flow")), "pagerank-flow")
        dangling = 1 - (moved.agg(F.sum("flow")).first()[0] or 0.0)
        after = (1 - damping) * F.col("p") + damping * (F.col("flow") + dangling * F.col("p"))
        step = moved.select("key", "p", after.alias("rank"), F.abs(after - F.col("rank")).alias("change"))
        if (step.agg(F.sum("change")).first()[0] or 0.0) < tolerance:
            return step.select("key", "rank")
        rank = step.select("key", "p", "rank")
    return rank.select("key", "rank")


def _in_memory(start: DataFrame, adj: DataFrame, damping: float, iterations: int, tolerance: float) -> DataFrame:
    own = sorted(start.collect())
    number = {r.key: i for i, r in enumerate(own)}
    links = [(number[r.src_key], number[r.dst_key], r.share) for r in adj.collect() if r.src_key in number and r.dst_key in number]
    p = np.array([r.p for r in own])
    src, dst, share = (np.array(x) for x in zip(*links)) if links else (np.zeros(0, int), np.zeros(0, int), np.zeros(0))
    rank = p.copy()
    for _ in range(iterations):
        flow = np.bincount(dst, rank[src] * share, len(p))
        after = (1 - damping) * p + damping * (flow + (rank.sum() - rank[src] @ share) * p)
        change, rank = np.abs(after - rank).sum(), after
        if change < tolerance:
            break
    return start.sparkSession.createDataFrame([(r.key, float(x)) for r, x in zip(own, rank)], start.select("key", F.col("p").alias("rank")).schema)
