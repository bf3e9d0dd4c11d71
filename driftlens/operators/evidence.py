"""The evidence graph: which resource causes which finding, by what kind of edge, how certain."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftlens.operators import closure

#: No graph knows consumers outside of the project.
EXTERNAL_COVERAGE = "unknown"


def read_edges(pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges, summaries) of pairs(source, reader, removed, reads, text_matches, dependency).

    reads is null where it is unresolved. read: a removed column is read, exact
    where resolved, conservative by text; read_check: none is. An exact, empty
    check of a pair that is no dependency is only counted for its source.
    """
    resolved = F.col("reads").isNotNull()
    hit = F.when(resolved, F.array_intersect("removed", F.transform("reads", lambda c: F.lower(c)))).otherwise(F.col("text_matches"))
    rows = pairs.withColumns({"columns": F.array_sort(F.coalesce(hit, F.array().cast("array<string>"))), "state": F.when(resolved, "exact").otherwise("conservative")})
    rows = rows.withColumn("kind", F.when(F.size("columns") > 0, "read").otherwise("read_check"))
    idle = (F.col("kind") == "read_check") & (F.col("state") == "exact") & ~F.coalesce("dependency", F.lit(False))
    edges = rows.where(~idle).select(F.col("source").alias("a"), F.col("reader").alias("b"), "kind", "state", "columns")
    return edges, rows.where(idle).groupBy("source").agg(F.count("*").alias("n"))


def graph(reads: DataFrame, base: DataFrame, current: DataFrame, findings: DataFrame, exposures: DataFrame) -> DataFrame:
    """(a, b, kind, state, columns, revisions): read edges, and the dependencies on paths from a cause to what it affects.

    base and current are (parent, child), findings(source, affected), exposures(node).
    """
    links = closure.dependency_edges(base, current)
    apart = findings.where("affected <> source")
    kept = closure.relevant_subgraph(
        links.select("parent", "child"), findings.select(F.col("source").alias("node")).distinct(), apart.select(F.col("affected").alias("node")).distinct()
    )
    rows = links.join(kept, ["parent", "child"], "left_semi").join(exposures.select(F.col("node").alias("child"), F.lit(True).alias("outside")).distinct(), "child", "left")
    depends = rows.select(
        F.col("parent").alias("a"),
        F.col("child").alias("b"),
        F.when(F.col("outside"), "declared_consumer").otherwise("dependency").alias("kind"),
        F.lit("unknown").alias("state"),
        F.array().cast("array<string>").alias("columns"),
        "revisions",
    )
    return reads.withColumn("revisions", F.array().cast("array<string>")).unionByName(depends)


def dangling(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges of which an end is no node of the graph; a sound one has none."""
    ids = nodes.select("node").distinct()
    return edges.join(ids.toDF("a"), "a", "left_anti").unionByName(edges.join(ids.toDF("b"), "b", "left_anti")).distinct()


def unresolved_reads(pairs: DataFrame, findings: DataFrame) -> DataFrame:
    """(resource, reason_code, message) for pairs(source, reader, removed, reads, unresolved) whose reads are unresolved.

    A reader that another finding names already is left out: a refusal of it, a
    finding of its own that is not safe, or one of the same source's cascade.
    """
    own = F.col("affected").alias("reader")
    cascades = F.startswith(F.col("rule_code"), F.lit("cascade."))
    said = findings.where((F.col("rule_code") == "input.refusal") | ((F.col("severity") != "safe") & ~cascades)).select(own)
    below = findings.where((F.col("severity") != "safe") & cascades).select("source", own)
    blind = pairs.where("reads IS NULL").join(said.distinct(), "reader", "left_anti").join(below.distinct(), ["source", "reader"], "left_anti")
    told = F.concat(
        F.lit("Unresolved compiled SQL read from "), F.array_join("unresolved", ", "), F.lit(" while checking "), F.col("source"), F.lit("; affected columns: "), F.array_join("removed", ", ")
    )
    return blind.select(F.col("reader").alias("resource"), F.lit("read_unresolved").alias("reason_code"), told.alias("message"))
