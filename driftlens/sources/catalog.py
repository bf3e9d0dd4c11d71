"""A project revision as DataFrames: statements, models, edges, tests, fixtures, consumers, file digests."""

from __future__ import annotations

import csv
import io
import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

_TEXT = T.StringType()
_MAP = T.MapType(_TEXT, _TEXT)
_TEXTS = T.ArrayType(_TEXT)


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


NODE = _struct(
    name=_TEXT, unique_id=_TEXT, resource_type=_TEXT, package_name=_TEXT, language=_TEXT, path=_TEXT, original_file_path=_TEXT, relation_name=_TEXT,
    database=_TEXT, schema=_TEXT, alias=_TEXT, version=_TEXT, latest_version=_TEXT, raw_code=_TEXT,
    config=_struct(materialized=_TEXT, on_schema_change=_TEXT, enabled=T.BooleanType(), contract=_struct(enforced=T.BooleanType()), alias=_TEXT, where=_TEXT),
    unrendered_config=_MAP,
    columns=T.MapType(_TEXT, _struct(name=_TEXT, data_type=_TEXT)),
    depends_on=_struct(nodes=_TEXTS),
    column_name=_TEXT, attached_node=_TEXT,
    test_metadata=_struct(name=_TEXT, kwargs=_MAP),
    compiled=T.BooleanType(), compiled_code=_TEXT, checksum=_struct(name=_TEXT, checksum=_TEXT),
    config_text=_TEXT,
)
_BLOCK = _struct(format=_TEXT, rows=_TEXT, fixture=_TEXT, input=_TEXT)
UNIT_TEST = _struct(name=_TEXT, model=_TEXT, config=_struct(enabled=T.BooleanType()), depends_on=_struct(nodes=_TEXTS), expect=_BLOCK, given=T.ArrayType(_BLOCK))
EXPOSURE = _struct(name=_TEXT, type=_TEXT, url=_TEXT, owner=_struct(name=_TEXT, email=_TEXT), config=_struct(enabled=T.BooleanType()))
MACRO = _struct(name=_TEXT, original_file_path=_TEXT, macro_sql=_TEXT)
MANIFEST = _struct(
    metadata=_struct(project_name=_TEXT, adapter_type=_TEXT, invocation_id=_TEXT),
    nodes=T.MapType(_TEXT, NODE),
    child_map=T.MapType(_TEXT, _TEXTS),
    unit_tests=T.MapType(_TEXT, UNIT_TEST),
    exposures=T.MapType(_TEXT, EXPOSURE),
    macros=T.MapType(_TEXT, MACRO),
)
#: As it is read: a node's config is text first, so that all of its settings can be compared.
_WRITTEN = T.StructType(
    [
        T.StructField("nodes", T.MapType(_TEXT, T.StructType([T.StructField(f.name, _TEXT if f.name == "config" else f.dataType) for f in NODE if f.name != "config_text"])))
        if f.name == "nodes"
        else f
        for f in MANIFEST
    ]
)
#: Adapters whose SQL another dialect reads (fixed values).
ADAPTER_DIALECTS = {"sqlserver": "tsql", "synapse": "tsql", "glue": "spark", "spark_session": "spark"}


def resolve_dialect(explicit: str | None, adapter: str | None) -> str:
    """What is asked for, else what the adapter speaks, else snowflake."""
    return explicit or (ADAPTER_DIALECTS.get(adapter, adapter) if adapter else None) or "snowflake"


def scan_files(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """(path, content) below a folder, path relative to it; read in parallel by Spark's binary source."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root)
    plain = root.split("://", 1)[-1].split(":", 1)[-1].rstrip("/")
    return files.select(F.element_at(F.split("path", re.escape(plain) + "/", 2), -1).alias("path"), "content")


def statements(files: DataFrame, model_dirs: Sequence[str] | None = None) -> DataFrame:
    """(path, stem, sql, is_model) of the .sql files; sql is null where it is not UTF-8.

    A model lies below one of model_dirs, where they are given, and in no folder
    that is called like a YAML file, which holds tests. Marks of byte order go
    and line ends are \\n.
    """
    parts = F.split("path", "/")
    raw = F.col("content").cast("string")
    text = F.when(F.is_valid_utf8(raw), F.regexp_replace(F.regexp_replace(raw, "^﻿", ""), "\r\n", "\n"))
    inside = F.get(parts, 0).isin(*model_dirs) if model_dirs else F.lit(True)
    tests = F.exists(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), lambda p: p.rlike(r"\.ya?ml$"))
    stem = F.regexp_replace(F.element_at(parts, -1), r"\.sql$", "")
    return files.where(F.col("path").endswith(".sql")).select("path", stem.alias("stem"), text.alias("sql"), (inside & ~tests).alias("is_model"))


def digests(files: DataFrame) -> DataFrame:
    """(path, sha256) of every file."""
    return files.select("path", F.sha2("content", 256).alias("sha256"))


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """The manifest's kept sections in one row, empty where they are null; the scan reads no others."""
    return _sections(spark.read.schema(_WRITTEN).option("multiLine", True).json(path))


def manifest_of(spark: SparkSession, text: str) -> DataFrame:
    """The same of a manifest that is at hand as text."""
    return _sections(spark.createDataFrame([(text,)], "text string").select(F.from_json("text", _WRITTEN).alias("m")).select("m.*"))


def _sections(df: DataFrame) -> DataFrame:
    def with_config(_: Column, n: Column) -> Column:
        return n.withField("config_text", n["config"]).withField("config", F.from_json(n["config"], NODE["config"].dataType))

    df = df.withColumn("nodes", F.transform_values("nodes", with_config))
    empty = {c: F.coalesce(c, F.create_map().cast(MANIFEST[c].dataType)) for c in ("nodes", "child_map", "unit_tests", "exposures", "macros")}
    return df.withColumns(empty)


def nodes(m: DataFrame) -> DataFrame:
    """(node_id, n): one row for each node."""
    return m.select(F.explode("nodes").alias("node_id", "n"))


def edges(m: DataFrame) -> DataFrame:
    """(parent, child)."""
    return m.select(F.explode("child_map").alias("parent", "children")).select("parent", F.explode("children").alias("child"))


def model_key(node_id: Column) -> Column:
    """The stem of a node's compiled file: its name, and _vN for version N."""
    versioned = F.regexp_extract(node_id, r"([^.]+)\.v([^.]+)$", 1)
    number = F.regexp_extract(node_id, r"([^.]+)\.v([^.]+)$", 2)
    return F.when(versioned != "", F.concat_ws("_v", versioned, number)).otherwise(F.element_at(F.split(node_id, r"\."), -1))


def root_package(m: DataFrame) -> DataFrame:
    """(package) of the project: what the manifest says, else the one with most models, ties by name."""
    counted = nodes(m).where("n.resource_type = 'model'").groupBy(F.col("n.package_name").alias("package")).agg(F.count("*").alias("c"))
    most = counted.orderBy(F.desc("c"), "package").limit(1).select("package")
    said = m.select(F.col("metadata.project_name").alias("said"))
    return said.join(most, F.lit(True), "left").select(F.coalesce("said", "package").alias("package"))


def authored_policy(n: Column) -> Column:
    """on_schema_change as the author wrote it; without that record, the resolved one of incremental models only."""
    written, resolved = n["unrendered_config"], n["config"]["on_schema_change"]
    kept = F.when(F.coalesce(n["config"]["materialized"], F.lit("table")) == "incremental", resolved)
    # A key that the author did write may be a template, so the resolved value is what counts.
    return F.when(written.isNotNull(), F.when(F.map_contains_key(written, F.lit("on_schema_change")), F.coalesce(resolved, written["on_schema_change"]))).otherwise(kept)


def models(m: DataFrame, packages: bool = False) -> DataFrame:
    """Enabled models and snapshots of the root package (or of all): node_id, name, materialization, on_schema_change, version, declared, contract_enforced."""
    n = F.col("n")
    rows = nodes(m).where(n["resource_type"].isin("model", "snapshot") & F.coalesce(n["config"]["enabled"], F.lit(True)) & n["name"].isNotNull())
    if not packages:
        rows = rows.join(F.broadcast(root_package(m)), n["package_name"].eqNullSafe(F.col("package")) | F.col("package").isNull(), "left_semi")
    declared = F.map_from_entries(F.transform(F.map_entries(F.coalesce(n["columns"], F.create_map().cast(NODE["columns"].dataType))), lambda e: F.struct(F.lower(F.coalesce(e["value"]["name"], e["key"])).alias("key"), e["value"]["data_type"].alias("value"))))
    return rows.select(
        "node_id",
        model_key(F.col("node_id")).alias("name"),
        F.when(n["resource_type"] == "snapshot", "snapshot").otherwise(F.coalesce(n["config"]["materialized"], F.lit("table"))).alias("materialization"),
        authored_policy(n).alias("on_schema_change"),
        n["version"].alias("version"),
        n["latest_version"].alias("latest_version"),
        n["name"].alias("short_name"),
        declared.alias("declared"),
        F.coalesce(n["config"]["contract"]["enforced"], F.lit(False)).alias("contract_enforced"),
        n["relation_name"].alias("relation_name"),
        n["alias"].alias("alias"),
        n["language"].alias("language"),
        n["database"].alias("database"),
        n["schema"].alias("schema"),
        n["raw_code"].alias("raw_code"),
        _settings_in_order(F.from_json(n["config_text"], _MAP)).alias("settings"),
        _settings_in_order(n["unrendered_config"]).alias("written_settings"),
    )


def _settings_in_order(settings: Column) -> Column:
    """Settings as entries in the order of their names, so that two records of the same are equal."""
    return F.sort_array(F.map_entries(settings))


def name_index(rows: DataFrame) -> DataFrame:
    """models by every name: a file's own name first, then the short name of the latest version; none is overwritten."""
    own = rows.withColumn("rank", F.lit(0))
    short = rows.where("short_name <> name").withColumns({"name": F.col("short_name"), "rank": F.when(F.col("version") == F.col("latest_version"), 1).otherwise(2)})
    w = Window.partitionBy("name").orderBy("rank", "node_id")
    return own.unionByName(short).withColumn("place", F.row_number().over(w)).where("place = 1").drop("place", "rank")


def relation_index(rows: DataFrame) -> DataFrame:
    """(relation, name): physical names of models, full and bare; a name of two models is nobody's."""
    bare = F.lower(F.coalesce("alias", "short_name"))
    full = F.lower(F.regexp_replace(F.coalesce("relation_name", F.lit("")), r'["`\[\]]', ""))
    both = rows.select("node_id", "name", F.explode(F.array_distinct(F.array(bare, full, F.lower("name")))).alias("relation")).where("relation <> ''")
    return both.groupBy("relation").agg(F.count_distinct("node_id").alias("n"), F.first("name").alias("name")).where("n = 1").select("relation", "name")


def data_tests(m: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(tests, columns, depends): test_id, test_name, requires_sql; test_id, model, column; test_id, model."""
    n = F.col("n")
    rows = nodes(m).where((n["resource_type"] == "test") & F.coalesce(n["config"]["enabled"], F.lit(True)))
    kwargs = n["test_metadata"]["kwargs"]
    custom = F.size(F.filter(F.map_keys(kwargs), lambda k: ~k.isin("model", "column_name", "to", "field", "values", "quote_values"))) > 0
    needs = n["column_name"].isNull() | n["config"]["where"].isNotNull() | F.coalesce(custom, F.lit(False))
    tests = rows.select(F.col("node_id").alias("test_id"), n["name"].alias("test_name"), needs.alias("requires_sql"))
    own = rows.where(n["column_name"].isNotNull()).select(
        F.col("node_id").alias("test_id"), model_key(F.coalesce(n["attached_node"], F.get(n["depends_on"]["nodes"], -1))).alias("model"), F.lower(n["column_name"]).alias("column")
    )
    # The far side of a relationship: the node it depends on besides the one it is attached to.
    far = rows.where((n["test_metadata"]["name"] == "relationships") & kwargs["field"].isNotNull())
    far = far.select(F.col("node_id").alias("test_id"), n["attached_node"].alias("own"), F.explode(n["depends_on"]["nodes"]).alias("other"), F.lower(kwargs["field"]).alias("column"))
    far = far.where("other <> own").select("test_id", model_key(F.col("other")).alias("model"), "column")
    depends = rows.select(F.col("node_id").alias("test_id"), F.explode(n["depends_on"]["nodes"]).alias("d")).select("test_id", model_key(F.col("d")).alias("model"))
    return tests, own.unionByName(far).where("model IS NOT NULL"), depends


def _csv_columns(text: str | None) -> list[str] | None:
    """Header names of an inline table, lower-case; None where the header is empty, blank or says a name twice."""
    try:
        rows = list(csv.reader(io.StringIO((text or "").strip()), strict=True))
    except csv.Error:
        return None
    names = [c.strip().lower() for c in rows[0]] if rows else []
    return names if names and all(names) and len(set(names)) == len(names) else None


_csv_udf = F.udf(_csv_columns, _TEXTS)


def fixtures(m: DataFrame) -> DataFrame:
    """(test_id, test_name, label, model, columns, unreadable_reason) of every block of a unit test."""
    rows = m.select(F.explode("unit_tests").alias("test_id", "u")).where(F.coalesce(F.col("u.config.enabled"), F.lit(True)))
    expect = rows.select("test_id", F.col("u.name").alias("test_name"), F.lit("expect").alias("label"), F.col("u.model").alias("model"), F.col("u.expect").alias("b"), F.col("u.depends_on.nodes").alias("deps"))
    given = rows.select("test_id", F.col("u.name").alias("test_name"), F.explode("u.given").alias("b"), F.col("u.depends_on.nodes").alias("deps"))
    ref = F.regexp_extract(F.col("b.input"), r"""ref\(\s*(?:['"][^'"]*['"]\s*,\s*)?['"]([^'"]+)['"]\s*(?:,\s*(?:v|version)\s*=\s*['"]?(\w+)['"]?\s*)?\)""", 1)
    version = F.regexp_extract(F.col("b.input"), r"""(?:v|version)\s*=\s*['"]?(\w+)""", 1)
    target = F.when(version != "", F.concat_ws("_v", ref, version)).otherwise(ref)
    given = given.select("test_id", "test_name", F.concat(F.lit("given "), F.coalesce("b.input", F.lit(""))).alias("label"), target.alias("model"), "b", "deps")
    blocks = expect.unionByName(given)
    kind = F.lower(F.coalesce("b.format", F.lit("dict")))
    objects = F.from_json("b.rows", "array<map<string,string>>")
    dict_columns = F.when(objects.isNotNull() & (F.size(objects) > 0), F.array_distinct(F.flatten(F.transform(objects, lambda r: F.transform(F.map_keys(r), lambda k: F.lower(k))))))
    columns = F.when(F.col("b.fixture").isNotNull() | (kind == "sql"), F.lit(None)).when(kind == "csv", _csv_udf("b.rows")).otherwise(dict_columns)
    reason = F.when(F.col("b.fixture").isNotNull(), "reads its rows from a fixture file").when(kind == "sql", "is written in SQL").otherwise("has no readable columns")
    out = blocks.select("test_id", "test_name", "label", "model", columns.alias("columns"), reason.alias("why"))
    return out.withColumn("unreadable_reason", F.when(F.col("columns").isNull(), F.col("why"))).drop("why")


def exposures(m: DataFrame) -> DataFrame:
    """(exposure_id, exposure_name, type, owner, url)."""
    rows = m.select(F.explode("exposures").alias("exposure_id", "e")).where(F.coalesce(F.col("e.config.enabled"), F.lit(True)))
    return rows.select("exposure_id", F.col("e.name").alias("exposure_name"), "e.type", F.coalesce("e.owner.name", "e.owner.email").alias("owner"), "e.url")


def source_path(path: Column) -> Column:
    """A path as it may be shown: absolute ones, drives, steps upwards and build folders are withheld."""
    clean = F.regexp_replace(path, r"\\", "/")
    bad = clean.rlike(r"^(/|[A-Za-z]:)|(^|/)\.\.(/|$)|^(target|\w+_packages|\w+_modules)(/|$)") | (clean == "")
    return F.when(~bad, clean)
