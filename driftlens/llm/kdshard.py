"""K-d tree sharding: splits at distributed weighted medians along the widest metadata dimension.

Every row is a point: each dimension is a whole number of 31 bits, spread over
the dimension's own range. A node is split along the dimension in which its
rows spread widest, at the value that divides its bytes in the ratio of the
shards on either side. The value is found digit by digit from counts by node
and digit. Nodes, cuts and counts are tables, never lists of the driver, and a
level is one join of the rows with the cuts of its nodes. A row's order in a
dimension is its value and then a hash of its own, hence ties never keep a
split from being even: a source or a text that a third of the rows have is
spread over shards like any other rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftlens.llm.common import materialize

SIDE = 31
#: Bits of a digit: a round counts at most 2**DIGIT rows for each node.
DIGIT = 11
#: Shards at most: the table of a level's cuts has a row of some 40 bytes for each node and goes to every worker.
MOST_SHARDS = 1_000_000
#: Bits of the tie that tell equal rows apart; the others follow from the row alone.
TWINS = 8


def _coordinate(df: DataFrame, column: str) -> tuple[Column, bool]:
    """A dimension's value as a number, and whether numbers keep their distances; nulls are lowest."""
    kind = df.schema[column].dataType.typeName()
    if kind in ("byte", "short", "integer", "long", "float", "double", "decimal"):
        return F.col(column).cast("double"), True
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit(""))).cast("double"), False


def _points(docs: DataFrame, doc_id: str, text: str, dimensions: list[str]) -> DataFrame:
    """doc_id, size, text_crc32, tie and the raw coordinates x0, x1, ..."""
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    of_row = F.shiftrightunsigned(F.xxhash64(F.col(doc_id), F.col(text)), 64 - SIDE + TWINS)
    among_twins = F.shiftrightunsigned(F.xxhash64(F.monotonically_increasing_id()), 64 - TWINS)
    return docs.select(
        F.col(doc_id).alias("doc_id"),
        (F.octet_length(body) + 1).cast("long").alias("size"),
        F.crc32(F.encode(body, "UTF-8")).alias("text_crc32"),
        F.shiftleft(of_row, TWINS).bitwiseOR(among_twins).alias("tie"),
        *(_coordinate(docs, c)[0].alias(f"x{i}") for i, c in enumerate(dimensions)),
    )


def _scaled(rows: DataFrame, n: int) -> DataFrame:
    """rows with k0, k1, ...: 31 bits of value, then 31 bits of tie, as one number that sorts like them."""
    bounds = rows.agg(*(f(f"x{i}").alias(f"{s}{i}") for i in range(n) for s, f in (("lo", F.min), ("hi", F.max)))).first()
    top = 2**SIDE - 1
    keys = {}
    for i in range(n):
        lo, hi = bounds[f"lo{i}"], bounds[f"hi{i}"]
        part = F.lit(0.0) if lo is None or hi <= lo else F.coalesce((F.col(f"x{i}") - F.lit(lo)) / F.lit(hi - lo), F.lit(0.0))
        value = F.least(F.lit(top), F.greatest(F.lit(0), F.floor(part * top))).cast("long")
        keys[f"k{i}"] = F.shiftleft(value, SIDE).bitwiseOR(F.col("tie"))
    return rows.withColumns(keys).drop(*(f"x{i}" for i in range(n)), "tie")


def _widest(rows: DataFrame, n_dimensions: int) -> DataFrame:
    """(node, dim): the dimension in which the rows of each node spread widest, the first of equals."""
    spread = rows.groupBy("node").agg(*(f(F.shiftright(f"k{d}", SIDE)).alias(f"{s}{d}") for d in range(n_dimensions) for s, f in (("lo", F.min), ("hi", F.max))))
    return spread.select("node", F.greatest(*(F.struct((F.col(f"hi{d}") - F.col(f"lo{d}")).alias("width"), F.lit(-d).alias("d")) for d in range(n_dimensions)), F.lit(None).cast("struct<width:bigint,d:int>")).alias("w")).select(
        "node", (-F.col("w.d")).alias("dim")
    )


def _cuts(rows: DataFrame, nodes: DataFrame, n_dimensions: int, level: int) -> DataFrame:
    """(node, dim, cut): the largest key of each node's left part, whose bytes are nearest to the left shards' share.

    nodes(node, dim, goal): the bytes that the left part should have.
    """
    key = F.get(F.array(*(F.col(f"k{d}") for d in range(n_dimensions))), F.col("dim"))
    found = nodes.select("node", "dim", "goal", F.lit(0).cast("long").alias("prefix"), F.lit(0).cast("long").alias("below"), F.lit(0).cast("long").alias("weight"))
    left = 2 * SIDE
    while left:
        bits = min(DIGIT, left)
        here = rows.join(F.broadcast(found.select("node", "dim", "prefix")), "node").withColumn("key", key).filter(F.shiftright("key", left) == F.col("prefix"))
        digit = F.shiftright("key", left - bits).bitwiseAND(F.lit(2**bits - 1).cast("long"))
        counts = here.groupBy("node", digit.alias("digit")).agg(F.sum("size").alias("bytes"))
        upto = F.sum("bytes").over(Window.partitionBy("node").orderBy("digit"))
        counts = counts.withColumn("upto", upto).join(F.broadcast(found), "node")
        # The first digit that reaches the goal, or else the last one.
        reached = F.min(F.when(F.col("below") + F.col("upto") >= F.col("goal"), F.struct("digit", "upto", "bytes")))
        step = counts.groupBy("node", "dim", "goal", "prefix", "below").agg(F.coalesce(reached, F.max(F.struct("digit", "upto", "bytes"))).alias("x"))
        found = materialize(
            step.select(
                "node", "dim", "goal", F.shiftleft("prefix", bits).bitwiseOR(F.col("x.digit")).alias("prefix"), (F.col("below") + F.col("x.upto") - F.col("x.bytes")).alias("below"), F.col("x.bytes").alias("weight")
            ),
            f"digits{level}_{left}",
        )
        left -= bits
    # The row at the median goes to the side that it leaves nearer to its share.
    short = F.col("goal") - F.col("below") < F.col("below") + F.col("weight") - F.col("goal")
    return found.select("node", "dim", (F.col("prefix") - short.cast("long")).alias("cut"))


def kd_tree(rows: DataFrame, n_dimensions: int, shards: int) -> DataFrame:
    """rows(size, k0, k1, ...) with `shard`, from 0 to shards - 1.

    A node is named by its first shard and how many it has, (first, n), which
    follows from its place in the tree alone.
    """
    rows = rows.withColumns({"node": F.lit(0), "n": F.lit(shards)})
    level = 0
    while shards > 1:
        open_ = rows.filter("n > 1")
        bytes_ = open_.groupBy("node", "n").agg(F.sum("size").alias("bytes"))
        goal = F.floor(F.col("bytes") * F.floor(F.col("n") / 2) / F.col("n")).cast("long")
        nodes = materialize(_widest(open_, n_dimensions).join(bytes_, "node").select("node", "dim", goal.alias("goal")), f"nodes{level}")
        cuts = _cuts(open_, nodes, n_dimensions, level)
        key = F.get(F.array(*(F.col(f"k{d}") for d in range(n_dimensions))), F.col("dim"))
        half = F.floor(F.col("n") / 2).cast("int")
        right = F.col("cut").isNotNull() & (key > F.col("cut"))
        moved = rows.join(F.broadcast(cuts), "node", "left").withColumn("right", right)
        split = {"node": F.when(F.col("right"), F.col("node") + half).otherwise(F.col("node")), "n": F.when(F.col("n") == 1, 1).when(F.col("right"), F.col("n") - half).otherwise(half)}
        rows = materialize(moved.withColumns(split).drop("dim", "cut", "right"), f"level{level}")
        shards, level = shards - shards // 2, level + 1
    return rows.withColumnRenamed("node", "shard").drop("n")


def shard(
    docs: DataFrame,
    shards: int | None = 8,
    target_bytes: int | None = None,
    doc_id: str = "doc_id",
    text: str = "text",
    dimensions: tuple[str, ...] = ("n_chars", "source", "lang", "doc_id"),
) -> DataFrame:
    """One row for each row of docs: doc_id, size, text_crc32, shard and slot.

    size is the text's UTF-8 bytes (null: none) plus 1. The tree has `shards`
    leaves, or as many as keep a leaf at target_bytes. Leaves hold near equal
    bytes, whatever values repeat, for ties are split by a hash of the row;
    rows larger than that stay whole. Equal texts may lie in different shards.
    Where a row goes follows from the rows, not from how files are split, but
    for rows that are equal in id and text, and the few that share 23 bits of
    hash with the row at a cut. doc_id keeps its type. slot counts a shard's rows from 0 without
    a gap. Nulls of a dimension count as its least value, text dimensions by
    their CRC-32, dimensions that docs lacks are left out; an empty table gives
    no rows.
    """
    dims = [c for c in dimensions if c in docs.columns] or [doc_id]
    points = materialize(_points(docs, doc_id, text, dims), "points")
    rows = materialize(_scaled(points, len(dims)), "scaled")
    if shards is None:
        total = rows.agg(F.sum("size")).first()[0] or 0
        shards = max(1, -(-total // max(1, target_bytes or total)))
    if shards > MOST_SHARDS:
        raise ValueError(f"{shards} shards: at most {MOST_SHARDS}")
    placed = kd_tree(rows, len(dims), shards).select("doc_id", "size", "text_crc32", "shard")
    # Numbers within sorted ranges, and for each range and shard where its numbers begin.
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = placed.repartitionByRange(parts, "shard", "doc_id", "text_crc32").sortWithinPartitions("shard", "doc_id", "text_crc32")
    numbered = materialize(order.withColumn("number", F.monotonically_increasing_id()), "numbered")
    part = F.shiftright("number", 33)
    runs = numbered.groupBy("shard", part.alias("part")).agg(F.min("number").alias("least"), F.count("*").alias("n")).collect()
    starts, at = [], {}
    for r in sorted(runs, key=lambda r: (r["shard"], r["part"])):
        starts.append((r["shard"], r["part"], r["least"] - at.get(r["shard"], 0)))
        at[r["shard"]] = at.get(r["shard"], 0) + r["n"]
    spark = docs.sparkSession
    offsets = spark.createDataFrame(starts, "o_shard int, o_part long, shift long")  # a row for each shard and range
    joined = numbered.withColumn("part", part).join(F.broadcast(offsets), (F.col("shard") == F.col("o_shard")) & (F.col("part") == F.col("o_part")))
    return joined.select("doc_id", "size", "text_crc32", "shard", (F.col("number") - F.col("shift")).alias("slot"))
