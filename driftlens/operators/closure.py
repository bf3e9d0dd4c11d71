"""Reachability over dependency edges by frontier loops; cycles end, since a pair is followed once."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftlens.functions.scratch import cut

#: Up to so many edges every worker gets them all and walks its own roots; beyond, frontiers are joined.
SENT_EDGES = 200_000


def closure(edges: DataFrame, roots: DataFrame, sent_edges: int = SENT_EDGES) -> DataFrame:
    """(root, node, depth) for every node that a root reaches, the root itself left out.

    edges(parent, child), roots(root); depth is the shortest. Nulls reach nothing.
    """
    edges = cut(edges.select("parent", "child").where("parent IS NOT NULL AND child IS NOT NULL").distinct())
    roots = roots.select("root").where("root IS NOT NULL").distinct()
    if edges.count() <= sent_edges:
        return _walks(edges, roots)
    frontier = cut(
        roots.join(edges, roots["root"] == edges["parent"]).select("root", F.col("child").alias("node")).where("root <> node").withColumn("depth", F.lit(1))
    )
    seen, depth = frontier, 1
    while not frontier.isEmpty():
        depth += 1
        step = frontier.select("root", "node").join(edges, F.col("node") == F.col("parent")).select("root", F.col("child").alias("node")).distinct()
        frontier = cut(step.where("root <> node").join(seen.select("root", "node"), ["root", "node"], "left_anti").withColumn("depth", F.lit(depth)))
        seen = cut(seen.unionByName(frontier))
    return seen


def _walks(edges: DataFrame, roots: DataFrame) -> DataFrame:
    children: dict[str, list[str]] = {}
    for parent, child in edges.collect():
        children.setdefault(parent, []).append(child)
    sent = edges.sparkSession.sparkContext.broadcast(children)

    def walk(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for root in frame.root:
                seen, front, rows, depth = {root}, [root], [], 0
                while front:
                    depth += 1
                    front = list(dict.fromkeys(c for p in front for c in sent.value.get(p, ()) if c not in seen))
                    seen.update(front)
                    rows += [(root, n, depth) for n in front]
                yield pd.DataFrame(rows, columns=["root", "node", "depth"])

    return roots.mapInPandas(walk, "root string, node string, depth int")


def reverse(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("child").alias("parent"), F.col("parent").alias("child"))


def merge_revisions(current: DataFrame, base: DataFrame) -> DataFrame:
    """The current edges, and the base edges of parents that the current revision lacks."""
    return current.unionByName(base.join(current.select("parent").distinct(), "parent", "left_anti"))


def without_inactive(edges: DataFrame, inactive: DataFrame) -> DataFrame:
    """edges less those that are proven to carry nothing."""
    return edges.join(inactive.select("parent", "child"), ["parent", "child"], "left_anti")


def parse_selection(selection: str) -> list[tuple[str, bool, bool]] | None:
    """(model, with ancestors, with descendants) for m, +m, m+ and +m+, joined by commas; None for anything else."""
    out = []
    for part in selection.split(","):
        found = re.fullmatch(r"\s*(\+?)([A-Za-z_][\w.]*)(\+?)\s*", part)
        if not found:
            return None
        out.append((found[2], bool(found[1]), bool(found[3])))
    return out


def select_nodes(edges: DataFrame, names: DataFrame, selection: str) -> DataFrame | None:
    """The nodes that a selection names; names(name, node). None where its syntax is unknown: then nothing is selected."""
    parts = parse_selection(selection)
    if parts is None:
        return None
    spark = edges.sparkSession
    wanted = spark.createDataFrame(parts, "name string, up boolean, down boolean").join(names, "name")
    out = wanted.select("node")
    for flag, along in (("down", edges), ("up", reverse(edges))):
        out = out.unionByName(closure(along, wanted.where(flag).select(F.col("node").alias("root"))).select("node"))
    return out.distinct()


def relevant_subgraph(edges: DataFrame, seeds: DataFrame, targets: DataFrame) -> DataFrame:
    """The edges on paths from a seed to a target: reached from the one and reaching the other; seeds(node), targets(node)."""
    ahead = closure(edges, seeds.select(F.col("node").alias("root"))).select("node").unionByName(seeds.select("node")).distinct()
    back = closure(reverse(edges), targets.select(F.col("node").alias("root"))).select("node").unionByName(targets.select("node")).distinct()
    nodes = cut(ahead.join(back, "node", "left_semi"))
    return edges.join(nodes.select(F.col("node").alias("parent")), "parent", "left_semi").join(
        nodes.select(F.col("node").alias("child")), "child", "left_semi"
    ).select("parent", "child")


def dependency_edges(base: DataFrame, current: DataFrame) -> DataFrame:
    """(parent, child, revisions) over both revisions."""
    both = base.withColumn("rev", F.lit("base")).unionByName(current.withColumn("rev", F.lit("current")))
    return both.groupBy("parent", "child").agg(F.array_sort(F.collect_set("rev")).alias("revisions"))


def cyclic_nodes(edges: DataFrame) -> DataFrame:
    """(node) of what is left when nodes without incoming edges are peeled off, again and again."""
    edges = cut(edges.select("parent", "child").distinct())
    while True:
        free = edges.select("parent").distinct().join(edges.select(F.col("child").alias("parent")).distinct(), "parent", "left_anti")
        if free.isEmpty():
            return edges.select(F.col("parent").alias("node")).unionByName(edges.select(F.col("child").alias("node"))).distinct()
        edges = cut(edges.join(free, "parent", "left_anti"))


def shortest_path(edges: DataFrame, source: str, target: str) -> list[str] | None:
    """One shortest path; among equals each node's smallest parent. The walk back reads one row a step."""
    roots = edges.sparkSession.createDataFrame([(source,)], "root string")
    reached = closure(edges, roots).select("node", "depth").unionByName(edges.sparkSession.createDataFrame([(source, 0)], "node string, depth int"))
    end = reached.where(F.col("node") == target).first()
    if end is None:
        return None
    parents = cut(
        edges.join(reached.toDF("child", "dc"), "child").join(reached.toDF("parent", "dp"), "parent").where("dp = dc - 1").groupBy("child").agg(F.min("parent").alias("parent"))
    )
    path = [target]
    while path[-1] != source:
        path.append(parents.where(F.col("child") == path[-1]).first()["parent"])
    return path[::-1]
