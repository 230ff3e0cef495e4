"""Directed graphs as edge tables (a, b)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from derlem.session import cut


def degrees(edges: DataFrame) -> DataFrame:
    """(node, n_out, n_in): one shuffle over both directions at once."""
    both = edges.select(F.col("a").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionByName(edges.select(F.col("b").alias("node"), F.lit(0).alias("o"), F.lit(1).alias("i")))
    return both.groupBy("node").agg(F.sum("o").alias("n_out"), F.sum("i").alias("n_in"))


def endpoints(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct()


def bfs(edges: DataFrame, start: DataFrame, depth: int) -> DataFrame:
    """(node, depth) within ``depth`` undirected steps of ``start`` (node); each node once, at its least depth."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    seen = start.select("node", F.lit(0).alias("depth"))
    front = seen
    for k in range(1, depth + 1):
        step = both.join(front.select(F.col("node").alias("a")), "a").select(F.col("b").alias("node")).distinct()
        front = step.join(seen, "node", "left_anti").select("node", F.lit(k).alias("depth"))
        if depth > 2:
            front = cut(front)
            if front.isEmpty():
                break
        seen = seen.unionByName(front)
    return seen


def neighbourhood(edges: DataFrame, centre: DataFrame) -> DataFrame:
    """(direction, node): what ``centre`` (node) cites and what cites it."""
    c = F.broadcast(centre)
    out = edges.join(c, F.col("a") == F.col("node")).select(F.lit("cites").alias("direction"), F.col("b").alias("node"))
    return out.unionByName(edges.join(c, F.col("b") == F.col("node")).select(F.lit("cited_by").alias("direction"), F.col("a").alias("node")))


def cross_references(edges: DataFrame, centre: DataFrame) -> DataFrame:
    """(id): the neighbours of ``centre`` and what those that cite it cite beside it, each once."""
    n = neighbourhood(edges, centre)
    citing = n.filter("direction = 'cited_by'").select(F.col("node").alias("a"))
    beside = edges.join(citing, "a", "left_semi").join(F.broadcast(centre), F.col("b") == F.col("node"), "left_anti").select(F.col("b").alias("id"))
    return n.select(F.col("node").alias("id")).union(beside).distinct()


def guard(edges: DataFrame, docs: DataFrame, least: float = 0.01) -> DataFrame:
    """(n_edges, n_citing, per_citing, coverage, state): ``docs`` (a) are the records; below ``least`` of them with a citation the graph is sparse."""
    own = docs.join(edges.select("a").distinct(), "a", "left_semi").agg(F.count("*").alias("k"))
    n = docs.agg(F.count("*").alias("n"))
    g = edges.agg(F.count("*").alias("n_edges"), F.count_distinct("a").alias("n_citing")).join(F.broadcast(own)).join(F.broadcast(n))
    share = F.try_divide(F.col("k"), F.col("n"))
    state = F.when(F.col("n_edges") == 0, "never_built").when(share < least, "sparse").otherwise("ok")
    return g.select("n_edges", "n_citing", F.round(F.try_divide("n_edges", "n_citing"), 6).alias("per_citing"), F.round(share, 6).alias("coverage"), state.alias("state"))


def first_per(rows: DataFrame, group: str, order: list[str], k: int) -> DataFrame:
    """The first ``k`` rows of each group with their ``place``."""
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(group).orderBy(*order))).filter(F.col("place") <= k)


def certainty(c: str) -> Column:
    """1 for the surest confidence, 4 for an unknown one."""
    return F.when(F.col(c) == "high", 1).when(F.col(c) == "medium", 2).when(F.col(c) == "low", 3).otherwise(4)


def certainty_name(c: str) -> Column:
    return F.when(F.col(c) == 1, "high").when(F.col(c) == 2, "medium").when(F.col(c) == 3, "low")


def dot_lines(edges: DataFrame) -> DataFrame:
    """(line) per edge for a ``digraph``; quotation marks inside names are escaped."""
    q = lambda c: F.regexp_replace(c, '"', '\\\\"')
    return edges.select(F.concat(F.lit('  "'), q("a"), F.lit('" -> "'), q("b"), F.lit('";')).alias("line"))


def mermaid_lines(edges: DataFrame) -> DataFrame:
    """(line) per edge for a ``graph``; nodes are numbered in the order of their names, without one task that sees all of them."""
    nodes = numbered(endpoints(edges), "node")
    j = edges.join(nodes.select(F.col("node").alias("a"), F.col("number").alias("x")), "a").join(nodes.select(F.col("node").alias("b"), F.col("number").alias("y")), "b")
    return j.select(F.concat(F.lit("    N"), F.col("x").cast("string"), F.lit(" --> N"), F.col("y").cast("string")).alias("line"))


def numbered(rows: DataFrame, by: str) -> DataFrame:
    """``rows`` with ``number``, their place in the order of ``by`` from 0: counted within ranges first, then shifted by what the ranges before hold."""
    parts = cut(rows.repartitionByRange(by).withColumn("_p", F.spark_partition_id()))
    sizes = parts.groupBy("_p").agg(F.count("*").alias("_n"))
    # one row per range
    before = sizes.withColumn("_before", F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)))
    place = F.row_number().over(Window.partitionBy("_p").orderBy(by)) - 1
    return parts.withColumn("_i", place).join(F.broadcast(before), "_p").withColumn("number", F.col("_i") + F.coalesce("_before", F.lit(0))).drop("_p", "_i", "_n", "_before")


def export(edges: DataFrame, folder: str, form: str = "json") -> None:
    """Write the graph: json is an object per edge, dot and mermaid are lines that a head and, for dot, a closing brace complete."""
    if form == "json":
        edges.select(F.col("a").alias("source"), F.col("b").alias("target")).write.mode("overwrite").json(folder)
    elif form in ("dot", "mermaid"):
        (dot_lines(edges) if form == "dot" else mermaid_lines(edges)).write.mode("overwrite").text(folder)
    else:
        raise ValueError(f"no such form: {form}")
