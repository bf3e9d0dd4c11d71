"""Differences between two revisions: files, columns, casts, contracts, settings, existence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftlens.functions.types import family


def duplicate_keys(files: DataFrame, key: str = "stem") -> DataFrame:
    """Keys that more than one file has; a tree with any cannot be compared."""
    return files.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")


def tree_diff(base: DataFrame, current: DataFrame, key: str = "stem", text: str = "sql") -> DataFrame:
    """(key, status, base_text, current_text) of what was added, removed or modified; equal texts are left out.

    A text that cannot be decoded is null, and a pair with one is modified.
    """
    b, c = base.select(key, F.col(text).alias("base_text"), F.lit(True).alias("in_base")), current.select(key, F.col(text).alias("current_text"), F.lit(True).alias("in_current"))
    status = F.when(F.col("in_base").isNull(), "added").when(F.col("in_current").isNull(), "removed").otherwise("modified")
    same = F.col("in_base") & F.col("in_current") & (F.col("base_text") == F.col("current_text"))
    return b.join(c, key, "full_outer").where(~F.coalesce(same, F.lit(False))).select(key, status.alias("status"), "base_text", "current_text")


def column_changes(base: DataFrame, current: DataFrame) -> DataFrame:
    """(model, column, change) between rows (model, name); models of one side only are not compared."""
    both = base.select("model").distinct().join(current.select("model").distinct(), "model")
    b, c = (x.select("model", F.col("name").alias("column")).distinct().join(both, "model", "left_semi") for x in (base, current))
    gone = b.join(c, ["model", "column"], "left_anti").withColumn("change", F.lit("removed"))
    return gone.unionByName(c.join(b, ["model", "column"], "left_anti").withColumn("change", F.lit("added")))


def cast_changes(base: DataFrame, current: DataFrame) -> DataFrame:
    """(model, column, before, after) for columns of both sides (model, name, cast_type) whose explicit cast differs; none differs from one."""
    b = base.select("model", F.col("name").alias("column"), F.col("cast_type").alias("before"))
    c = current.select("model", F.col("name").alias("column"), F.col("cast_type").alias("after"))
    return b.join(c, ["model", "column"]).where(~F.col("before").eqNullSafe(F.col("after")))


def contract_violations(declared: DataFrame, produced: DataFrame) -> DataFrame:
    """(model, column, violation) of declared(model, column, data_type) against produced(model, column, cast_type)."""
    d = declared.select("model", F.lower("column").alias("column"), "data_type", F.lit(True).alias("d"))
    p = produced.select("model", F.lower("column").alias("column"), "cast_type", F.lit(True).alias("p"))
    p = p.join(d.select("model").distinct(), "model", "left_semi")
    what = (
        F.when(F.col("p").isNull(), "missing in definition")
        .when(F.col("d").isNull(), "missing in contract")
        .when(family(F.col("data_type")) != family(F.col("cast_type")), "data type mismatch")
    )
    return d.join(p, ["model", "column"], "full_outer").select("model", "column", what.alias("violation")).where("violation IS NOT NULL")


def only_in(left: DataFrame, *others: DataFrame, key: str = "name") -> DataFrame:
    """Rows of left whose key none of the others has: deleted, uncompiled or missing models."""
    for other in others:
        left = left.join(other.select(key).distinct(), key, "left_anti")
    return left


def setting_changes(base: DataFrame, current: DataFrame, fields: list[str], key: str = "name") -> DataFrame:
    """(key, field, before, after) of every field that differs, nulls and nested values included."""

    def stacked(df: DataFrame, name: str) -> DataFrame:
        def text(f: str) -> Column:
            kind = df.schema[f].dataType.typeName()
            return F.to_json(F.col(f)) if kind in ("struct", "map", "array") else F.col(f).cast("string")

        return df.select(key, F.explode(F.array(*(F.struct(F.lit(f).alias("field"), text(f).alias(name)) for f in fields))).alias("x")).select(key, "x.*")

    return stacked(base, "before").join(stacked(current, "after"), [key, "field"]).where("NOT before <=> after")


def inventory_problems(recorded: DataFrame, found: DataFrame) -> DataFrame:
    """(path, problem) of recorded(path, sha256) against found(path, sha256); no row means verified."""
    r, f = recorded.select("path", F.col("sha256").alias("was")), found.select("path", F.col("sha256").alias("now"))
    twice = recorded.groupBy("path").agg(F.count("*").alias("n")).where("n > 1").select("path", F.lit("recorded twice").alias("problem"))
    what = F.when(F.col("now").isNull(), "missing").when(F.col("was").isNull(), "unrecorded").when(F.col("was") != F.col("now"), "changed")
    return r.join(f, "path", "full_outer").select("path", what.alias("problem")).where("problem IS NOT NULL").unionByName(twice)
