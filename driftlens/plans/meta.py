"""Metadata operators as queries: over the tables' own schemas, slices of tables, and literal catalogs."""

from __future__ import annotations

import json
from collections.abc import Callable
from itertools import product

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftlens.operators import cascade, closure, diff, report, rules
from driftlens.plans import provenance
from driftlens.plans.check import Revision, check
from driftlens.plans.surface import TABLES
from driftlens.sources import catalog

Query = Callable[[SparkSession, str], DataFrame]


def _sql(value: object) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return str(value).upper()
    if isinstance(value, (list, tuple)):
        return "[" + ", ".join(map(_sql, value)) + "]"
    return str(value) if isinstance(value, int) else "'" + str(value).replace("'", "''") + "'"


def values(name: str, columns: str, rows: list[tuple]) -> str:
    """A common table expression for DuckDB with the rows of a literal catalog."""
    return f"{name}({columns}) AS (VALUES " + ", ".join("(" + ", ".join(map(_sql, r)) + ")" for r in rows) + ")"


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Models of which the current revision drops a column or adds one.
DROPPED = {"orders": "o_orderpriority", "customer": "c_acctbal", "part": "p_brand", "events": "props"}


def column_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Output columns of `SELECT *` against `SELECT * EXCEPT (...)` and an added one, over each table's schema."""
    base, current = [], []
    for t in TABLES:
        names = _read(spark, sf_dir, t).columns
        base += [(t, n) for n in names]
        current += [(t, n) for n in names if n != DROPPED.get(t)] + ([(t, "loaded_at")] if t in DROPPED else [])
    b, c = (spark.createDataFrame(x, "model string, name string") for x in (base, current))
    return diff.column_changes(b, c)


def _describe(t: str) -> str:
    return f"SELECT '{t}' AS model, column_name AS name FROM (DESCRIBE SELECT * FROM {t})"


COLUMN_DIFF_SQL = (
    "WITH base AS (" + " UNION ALL ".join(map(_describe, TABLES)) + "), gone(model, name) AS (VALUES "
    + ", ".join(f"('{t}', '{c}')" for t, c in DROPPED.items())
    + "), current AS (SELECT * FROM base ANTI JOIN gone USING (model, name) UNION ALL SELECT model, 'loaded_at' FROM gone)"
    " SELECT model, name AS column, 'removed' AS change FROM (SELECT * FROM base EXCEPT SELECT * FROM current)"
    " UNION ALL SELECT model, name, 'added' FROM (SELECT * FROM current EXCEPT SELECT * FROM base)"
)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole way from two statements to a verdict: an incremental model over orders that loses a column."""
    from driftlens.functions.sqlshape import extract

    orders = _read(spark, sf_dir, "orders").columns
    base = extract("WITH src AS (SELECT * FROM orders) SELECT * FROM src", "spark", {"orders": orders}.get)
    current = extract("WITH src AS (SELECT * EXCEPT (o_orderpriority) FROM orders) SELECT * FROM src", "spark", {"orders": orders}.get)
    rows = spark.createDataFrame(
        [("orders_model", "incremental", "sync_all_columns", base.names, current.names, "modified")],
        "name string, materialization string, on_schema_change string, base_columns array<string>, current_columns array<string>, status string",
    )
    out = rules.predict(rows).select("name", F.explode("operations").alias("o"), report.label(F.col("safety")).alias("safety"))
    return out.select("name", F.col("o.op").alias("op"), F.col("o.column").alias("column_name"), "safety")


FLAGSHIP_SQL = (
    "SELECT 'orders_model' AS name, 'DROP COLUMN' AS op, column_name, 'destructive' AS safety FROM"
    " (SELECT column_name FROM (DESCRIBE SELECT * FROM orders) EXCEPT SELECT column_name FROM (DESCRIBE SELECT * EXCLUDE (o_orderpriority) FROM orders))"
)

# ---- the rule table over its whole cross product
MATERIALIZATIONS = ["table", "view", "incremental", "ephemeral", "snapshot", "materialized_view", "custom", None]
POLICIES = [None, "ignore", "fail", "append_new_columns", "sync_all_columns", "other"]
STATUSES = ["modified", "added", "removed"]
CASES = [
    (["a", "b"], ["a"]),
    (["a"], ["a", "b"]),
    (["a", "b"], ["b", "a"]),
    (["a", "c"], ["a", "b"]),
    (None, ["a"]),
    (["a"], None),
    (["*"], ["a"]),
    (["a"], ["*"]),
    (["* except(x)"], ["* except(x)"]),
    (["* except(x)"], ["* except(y)"]),
    (["a"], ["* except(y)"]),
    (["a", "a"], ["a"]),
]
RULE_ROWS = [
    (i, m, p, list(b) if b else b, list(c) if c else c, s)
    for i, (m, p, s, (b, c)) in enumerate(product(MATERIALIZATIONS, POLICIES, STATUSES, CASES))
]
_RULE_SCHEMA = "id int, materialization string, on_schema_change string, base_columns array<string>, current_columns array<string>, status string"


def ddl_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = rules.predict(spark.createDataFrame(RULE_ROWS, _RULE_SCHEMA))
    text = F.array_join(F.transform("operations", lambda o: F.concat_ws(":", o["op"], o["column"])), ";")
    return out.select("id", report.label(F.col("safety")).alias("safety"), text.alias("operations"), F.array_join("added", ",").alias("added"), F.array_join("removed", ",").alias("removed"))


DDL_RULES_SQL = (
    "WITH " + values("raw", "id, m, p, b, c, s", RULE_ROWS) + ","
    " r AS (SELECT id, coalesce(m, 'table') AS m, p, coalesce(p, 'ignore') AS osc, CAST(b AS VARCHAR[]) AS b, CAST(c AS VARCHAR[]) AS c, s,"
    " list_sort(list_distinct([x FOR x IN CAST(c AS VARCHAR[]) IF NOT list_contains(CAST(b AS VARCHAR[]), x)])) AS ad,"
    " list_sort(list_distinct([x FOR x IN CAST(b AS VARCHAR[]) IF NOT list_contains(CAST(c AS VARCHAR[]), x)])) AS rm,"
    " coalesce(b[1] LIKE '*%', FALSE) OR coalesce(c[1] LIKE '*%', FALSE) OR b IS NULL OR c IS NULL AS vague FROM raw),"
    " t AS (SELECT *, b[1] LIKE '* except(%' AS be, c[1] LIKE '* except(%' AS ce, len(b) <> len(list_distinct(b)) OR len(c) <> len(list_distinct(c)) AS dup,"
    " array_to_string(list_concat([concat('ADD COLUMN:', x) FOR x IN ad], [concat('DROP COLUMN:', x) FOR x IN rm]), ';') AS sync,"
    " array_to_string([concat('ADD COLUMN:', x) FOR x IN ad], ';') AS adds FROM r),"
    " k AS (SELECT *, CASE WHEN s = 'removed' AND m = 'ephemeral' THEN 1 WHEN s = 'removed' THEN 2 WHEN m = 'table' THEN 3 WHEN m = 'view' THEN 4 WHEN m = 'ephemeral' THEN 5"
    " WHEN m = 'snapshot' THEN 6 WHEN m <> 'incremental' AND p IS NULL THEN 7 WHEN osc = 'ignore' AND s <> 'added' THEN 8 WHEN osc = 'ignore' THEN 9 WHEN s = 'added' THEN 10"
    " WHEN b IS NULL OR c IS NULL THEN 11 WHEN b = ['*'] OR c = ['*'] THEN 12 WHEN be OR ce THEN 13 WHEN dup THEN 14 WHEN osc = 'fail' THEN 15"
    " WHEN osc = 'append_new_columns' THEN 16 WHEN osc = 'sync_all_columns' THEN 17 ELSE 18 END AS rule FROM t),"
    " o AS (SELECT *, CASE rule WHEN 2 THEN 'MODEL REMOVED' WHEN 3 THEN 'CREATE OR REPLACE TABLE' WHEN 4 THEN 'CREATE OR REPLACE VIEW'"
    " WHEN 6 THEN concat('REVIEW REQUIRED (snapshot)', CASE WHEN NOT vague AND sync <> '' THEN concat(';', sync) ELSE '' END)"
    " WHEN 7 THEN concat(CASE WHEN m = 'materialized_view' THEN 'REVIEW REQUIRED (materialized_view is driven by on_configuration_change, which is not modelled)'"
    " ELSE concat('UNKNOWN materialization: ', m) END, CASE WHEN NOT vague AND sync <> '' THEN concat(';', sync) ELSE '' END)"
    " WHEN 8 THEN CASE WHEN vague THEN 'REVIEW REQUIRED: cannot determine incremental schema changes' WHEN len(rm) > 0 THEN "
    + _sql(rules.IGNORED_REMOVAL)
    + " WHEN len(ad) > 0 THEN "
    + _sql(rules.IGNORED_ADDITION)
    + " ELSE 'NO DDL' END WHEN 9 THEN 'NO DDL' WHEN 11 THEN 'REVIEW REQUIRED' WHEN 12 THEN 'REVIEW REQUIRED (SELECT *)'"
    " WHEN 13 THEN CASE WHEN be AND ce AND b[1] = c[1] THEN 'REVIEW REQUIRED (SELECT * EXCEPT — same exclusions)'"
    " WHEN be AND ce THEN 'REVIEW REQUIRED (SELECT * EXCEPT — exclusions changed)' ELSE 'REVIEW REQUIRED (SELECT * EXCEPT — column removal likely)' END"
    " WHEN 14 THEN 'REVIEW REQUIRED (duplicate column names)' WHEN 15 THEN CASE WHEN sync <> '' THEN 'BUILD FAILURE' ELSE '' END"
    " WHEN 16 THEN concat(adds, CASE WHEN len(rm) > 0 THEN concat(CASE WHEN adds <> '' THEN ';' ELSE '' END, 'STALE COLUMNS (not populated)') ELSE '' END)"
    " WHEN 17 THEN sync WHEN 18 THEN concat('UNKNOWN on_schema_change: ', osc) ELSE '' END AS operations FROM k)"
    " SELECT id, CASE WHEN rule IN (1, 3, 4, 5, 9, 10) THEN 'safe' WHEN rule = 2 THEN 'destructive' WHEN rule = 8 AND operations = 'NO DDL' THEN 'safe'"
    " WHEN rule = 15 AND operations = '' THEN 'safe' WHEN rule = 16 AND len(rm) = 0 THEN 'safe' WHEN rule = 17 AND len(rm) = 0 THEN 'safe' WHEN rule = 17 THEN 'destructive' ELSE 'warning' END AS safety,"
    " operations, CASE WHEN rule IN (15, 16, 17) OR (rule IN (6, 7) AND NOT vague) THEN array_to_string(ad, ',') ELSE '' END AS added,"
    " CASE WHEN rule IN (15, 16, 17) OR (rule IN (6, 7) AND NOT vague) THEN array_to_string(rm, ',') ELSE '' END AS removed FROM o"
)

RULE_PAIRS = [(m, p) for m in MATERIALIZATIONS if m for p in POLICIES]


def rule_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.has_rule(spark.createDataFrame(RULE_PAIRS, "materialization string, on_schema_change string"))


RULE_COVERAGE_SQL = (
    "WITH " + values("t", "materialization, on_schema_change", RULE_PAIRS)
    + " SELECT materialization, on_schema_change, CASE WHEN materialization IN ('table', 'view', 'ephemeral') THEN TRUE WHEN materialization = 'snapshot' THEN FALSE"
    " WHEN materialization <> 'incremental' AND on_schema_change IS NULL THEN FALSE ELSE coalesce(on_schema_change, 'ignore') <> 'other' END AS has_rule FROM t"
)

# ---- casts and contracts
BASE_CASTS = [("m1", "a", "VARCHAR"), ("m1", "b", "INT"), ("m1", "c", None), ("m2", "a", "DATE"), ("m2", "z", "INT"), ("m3", "a", None)]
CURRENT_CASTS = [("m1", "a", "VARCHAR"), ("m1", "b", "BIGINT"), ("m1", "c", "TEXT"), ("m2", "a", None), ("m2", "y", "INT"), ("m3", "a", None)]


def cast_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    b, c = (spark.createDataFrame(x, "model string, name string, cast_type string") for x in (BASE_CASTS, CURRENT_CASTS))
    return diff.cast_changes(b, c)


CAST_DIFF_SQL = (
    "WITH " + values("b", "model, name, t", BASE_CASTS) + ", " + values("c", "model, name, t", CURRENT_CASTS)
    + " SELECT b.model, b.name AS column, b.t AS before, c.t AS after FROM b JOIN c USING (model, name) WHERE b.t IS DISTINCT FROM c.t"
)
DECLARED = [("m1", "Id", "varchar"), ("m1", "n", "numeric(18,2)"), ("m1", "gone", "int"), ("m1", "at", "timestamp_ntz"), ("m1", "v", "variant"), ("m2", "id", "bigint")]
PRODUCED = [("m1", "id", "INTEGER"), ("m1", "n", "BIGINT"), ("m1", "extra", None), ("m1", "at", "TEXT"), ("m1", "v", "INT"), ("m2", "id", None), ("m9", "q", None)]


def contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spark.createDataFrame(DECLARED, "model string, column string, data_type string")
    p = spark.createDataFrame(PRODUCED, "model string, column string, cast_type string")
    return diff.contract_violations(d, p)


_FAMILY = (
    "CASE WHEN {0} ILIKE 'varchar%' OR {0} ILIKE 'text' THEN 'text' WHEN {0} ILIKE '%int%' OR {0} ILIKE 'numeric%' THEN 'number'"
    " WHEN {0} ILIKE 'date%' OR {0} ILIKE 'timestamp%' THEN 'date/time' END"
)
CONTRACT_SQL = (
    "WITH " + values("d0", "model, col, t", DECLARED) + ", " + values("p0", "model, col, t", PRODUCED)
    + ", d AS (SELECT model, lower(col) AS col, t FROM d0), p AS (SELECT model, lower(col) AS col, t FROM p0 WHERE model IN (SELECT model FROM d0)),"
    " j AS (SELECT coalesce(d.model, p.model) AS model, coalesce(d.col, p.col) AS col, CASE WHEN p.col IS NULL THEN 'missing in definition' WHEN d.col IS NULL THEN 'missing in contract'"
    f" WHEN ({_FAMILY.format('d.t')}) <> ({_FAMILY.format('p.t')}) THEN 'data type mismatch' END AS violation FROM d FULL OUTER JOIN p ON d.model = p.model AND d.col = p.col)"
    " SELECT model, col AS column, violation FROM j WHERE violation IS NOT NULL"
)


# ---- two revisions of files
def _slices(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    docs = _read(spark, sf_dir, "documents").select(F.concat(F.lit("model_"), F.col("doc_id").cast("string")).alias("stem"), F.col("text").alias("sql"), "doc_id", "lang")
    current = docs.where("lang <> 'de'").withColumn("sql", F.when(F.col("lang") == "fr", F.concat("sql", F.lit("\nLIMIT 1"))).otherwise(F.col("sql")))
    return docs.where("lang <> 'es'"), current


_BASE_SLICE = "SELECT concat('model_', doc_id) AS stem, text AS sql FROM documents WHERE lang <> 'es'"
_CURRENT_SLICE = "SELECT concat('model_', doc_id) AS stem, CASE WHEN lang = 'fr' THEN concat(text, chr(10), 'LIMIT 1') ELSE text END AS sql FROM documents WHERE lang <> 'de'"


def tree_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    base, current = _slices(spark, sf_dir)
    return diff.tree_diff(base, current).select("stem", "status", F.length("base_text").cast("long").alias("base_chars"), F.length("current_text").cast("long").alias("current_chars"))


TREE_DIFF_SQL = (
    f"WITH b AS ({_BASE_SLICE}), c AS ({_CURRENT_SLICE}) SELECT coalesce(b.stem, c.stem) AS stem,"
    " CASE WHEN b.stem IS NULL THEN 'added' WHEN c.stem IS NULL THEN 'removed' ELSE 'modified' END AS status,"
    " CAST(length(b.sql) AS BIGINT) AS base_chars, CAST(length(c.sql) AS BIGINT) AS current_chars"
    " FROM b FULL OUTER JOIN c ON b.stem = c.stem WHERE b.sql IS DISTINCT FROM c.sql"
)


def inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    base, current = _slices(spark, sf_dir)
    was, now = (x.select(F.col("stem").alias("path"), F.sha2("sql", 256).alias("sha256")) for x in (base, current))
    return diff.inventory_problems(was, now)


INVENTORY_SQL = (
    f"WITH b AS (SELECT stem, sha256(sql) AS h FROM ({_BASE_SLICE})), c AS (SELECT stem, sha256(sql) AS h FROM ({_CURRENT_SLICE}))"
    " SELECT coalesce(b.stem, c.stem) AS path, CASE WHEN c.h IS NULL THEN 'missing' WHEN b.h IS NULL THEN 'unrecorded' ELSE 'changed' END AS problem"
    " FROM b FULL OUTER JOIN c ON b.stem = c.stem WHERE b.h IS DISTINCT FROM c.h"
)


def deleted_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers stand for base models, those with a dear order for current ones, those of one nation for models in the diff."""
    base = _read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("name"), "c_nationkey")
    current = _read(spark, sf_dir, "orders").where("o_totalprice > 300000").select(F.col("o_custkey").alias("name"))
    return diff.only_in(base, current, base.where("c_nationkey = 3")).select("name")


DELETED_SQL = "SELECT c_custkey AS name FROM customer ANTI JOIN orders ON c_custkey = o_custkey AND o_totalprice > 300000 WHERE c_nationkey <> 3"


def setting_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Settings of suppliers in two revisions, of which one moves every supplier of nation 4 to 5."""
    base = _read(spark, sf_dir, "supplier").select(F.col("s_name").alias("name"), "s_nationkey", "s_suppkey")
    current = base.withColumn("s_nationkey", F.when(F.col("s_nationkey") == 4, 5).otherwise(F.col("s_nationkey")))
    return diff.setting_changes(base, current, ["s_nationkey", "s_suppkey"])


SETTING_SQL = "SELECT s_name AS name, 's_nationkey' AS field, '4' AS before, '5' AS after FROM supplier WHERE s_nationkey = 4"

# ---- graphs
EDGES = [
    ("src", "stg_a"), ("src", "stg_b"), ("stg_a", "mid"), ("stg_b", "mid"), ("mid", "mart1"), ("mid", "mart2"), ("mart1", "report"),
    ("c1", "c2"), ("c2", "c3"), ("c3", "c1"), ("c3", "out"), ("mart2", "expo"),
]
_EDGE_SQL = values("e", "parent, child", EDGES)
_REACH = (
    "WITH RECURSIVE " + _EDGE_SQL + ", t(root, node) AS (SELECT parent, child FROM e UNION SELECT t.root, e.child FROM t JOIN e ON t.node = e.parent)"
)


def _edges(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(EDGES, "parent string, child string")


def reach(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _edges(spark)
    return closure.closure(e, e.select(F.col("parent").alias("root"))).select("root", "node")


def selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _edges(spark)
    nodes = e.select(F.col("parent").alias("node")).unionByName(e.select(F.col("child").alias("node"))).distinct()
    return closure.select_nodes(e, nodes.select(F.col("node").alias("name"), "node"), "mid+, +stg_a, c2")


SELECTION_SQL = (
    _REACH + " SELECT DISTINCT node FROM (SELECT node FROM t WHERE root = 'mid' AND node <> root UNION ALL SELECT root FROM t WHERE node = 'stg_a' AND node <> root"
    " UNION ALL SELECT unnest(['mid', 'stg_a', 'c2']))"
)


def cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return closure.cyclic_nodes(_edges(spark))


#: What is left after peeling: nodes of a cycle and those that one reaches.
CYCLES_SQL = _REACH + " SELECT DISTINCT node FROM (SELECT root AS node FROM t WHERE root = node UNION ALL SELECT b.node FROM t a JOIN t b ON a.root = a.node AND b.root = a.root)"


def subgraph(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _edges(spark)
    seeds, targets = spark.createDataFrame([("stg_a",)], "node string"), spark.createDataFrame([("report",), ("expo",)], "node string")
    return closure.relevant_subgraph(e, seeds, targets)


SUBGRAPH_SQL = (
    _REACH + ", f AS (SELECT node FROM t WHERE root = 'stg_a' UNION SELECT 'stg_a'), b AS (SELECT root AS node FROM t WHERE node IN ('report', 'expo') UNION SELECT unnest(['report', 'expo'])),"
    " n AS (SELECT node FROM f INTERSECT SELECT node FROM b) SELECT parent, child FROM e WHERE parent IN (SELECT node FROM n) AND child IN (SELECT node FROM n)"
)
OLD_EDGES = [("src", "stg_a"), ("old", "mid"), ("mid", "mart0")]


def revision_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = closure.dependency_edges(spark.createDataFrame(OLD_EDGES, "parent string, child string"), _edges(spark))
    return both.select("parent", "child", F.array_join("revisions", "+").alias("revisions"))


REVISION_SQL = (
    "WITH " + _EDGE_SQL + ", " + values("b", "parent, child", OLD_EDGES)
    + " SELECT parent, child, string_agg(rev, '+' ORDER BY rev) AS revisions FROM (SELECT *, 'current' AS rev FROM e UNION ALL SELECT *, 'base' FROM b) GROUP BY 1, 2"
)


def merged_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return closure.merge_revisions(_edges(spark), spark.createDataFrame(OLD_EDGES, "parent string, child string"))


MERGED_SQL = "WITH " + _EDGE_SQL + ", " + values("b", "parent, child", OLD_EDGES) + " SELECT * FROM e UNION ALL SELECT * FROM b WHERE parent NOT IN (SELECT parent FROM e)"

# ---- the cascade over a literal project
NODES = [
    ("stg", "incremental", "sync_all_columns", ["id", "amount", "note"], ["id", "amount"], "select id, amount from raw"),
    ("mid", "view", None, ["id", "amount", "note"], ["id", "amount"], "select * from stg"),
    ("fct", "incremental", "sync_all_columns", ["id", "note"], ["id", "note"], "select id, note from mid"),
    ("agg", "table", None, ["n"], ["n"], "select count(*) as n from mid"),
    ("inc", "incremental", "fail", ["id"], ["id"], "select id from stg"),
    ("hist", "incremental", "sync_all_columns", ["id", "note"], ["id"], "select * from mid"),
    ("blind", "incremental", "append_new_columns", None, None, "select something(note) from mid"),
    ("eph", "ephemeral", None, ["note"], ["note"], "select note from stg"),
]
LINKS = [("stg", "mid"), ("mid", "fct"), ("mid", "agg"), ("stg", "inc"), ("mid", "hist"), ("mid", "blind"), ("stg", "eph")]
LINKS += [("stg", "ut1"), ("mid", "ut2"), ("fct", "ut3"), ("stg", "dt1"), ("mid", "dt2"), ("hist", "dt3"), ("fct", "dt4"), ("fct", "expo1"), ("agg", "expo2")]
READS = [("mid", "stg", None), ("fct", "mid", "id"), ("fct", "mid", "note"), ("agg", "mid", None), ("inc", "stg", "id"), ("hist", "mid", None), ("eph", "stg", "note")]
FIXTURES = [
    ("ut1", "unit_1", "expect", "stg", ["id", "note"], None),
    ("ut2", "unit_2", "given stg", "stg", ["id"], None),
    ("ut3", "unit_3", "given mid", "mid", None, "has no readable columns"),
]
TESTS = [("dt1", "not_null_stg_note", False, None), ("dt2", "singular", True, "select Note from mid"), ("dt3", "blind_test", True, None), ("dt4", "plain", True, "select 1 from mid")]
TEST_COLUMNS = [("dt1", "stg", "note")]
TEST_DEPENDS = [("dt1", "stg"), ("dt2", "mid"), ("dt3", "hist"), ("dt4", "mid")]
_NODE_SCHEMA = "name string, materialization string, on_schema_change string, base_columns array<string>, current_columns array<string>, sql string"


def _cascade(spark: SparkSession) -> dict[str, DataFrame]:
    nodes = spark.createDataFrame(NODES, _NODE_SCHEMA)
    links = spark.createDataFrame(LINKS, "parent string, child string")
    predictions = rules.predict(nodes.where("name = 'stg'").withColumn("status", F.lit("modified")))
    changes = cascade.changed_columns(predictions)
    models = nodes.select(F.col("name").alias("affected"))
    down = closure.closure(links, changes.select(F.col("source").alias("root"))).select(F.col("root").alias("source"), F.col("node").alias("affected"))
    down = down.join(models, "affected", "left_semi").select("source", "affected")
    impacts, lost_on = cascade.inherited(changes, down, nodes, predictions.select("name"))
    lost = cascade.lost_columns(changes, lost_on)
    reads = spark.createDataFrame(READS, "reader string, model string, column string")
    none = spark.createDataFrame([], "name string")
    owners = changes.select("source", F.col("source").alias("owner")).unionByName(down.select("source", F.col("affected").alias("owner")))
    fixtures = spark.createDataFrame(FIXTURES, "test_id string, test_name string, label string, model string, columns array<string>, unreadable_reason string")
    tests = spark.createDataFrame(TESTS, "test_id string, test_name string, requires_sql boolean, sql string")
    columns = spark.createDataFrame(TEST_COLUMNS, "test_id string, model string, column string")
    depends = spark.createDataFrame(TEST_DEPENDS, "test_id string, model string")
    return {
        "predictions": predictions,
        "inherited": impacts,
        "lost": lost,
        "build": cascade.build_failures(changes, down, nodes),
        "broken": cascade.broken_references(cascade.reading_pairs(lost, down, nodes, reads.where("column IS NOT NULL"), reads.select("reader", "model"), none)),
        "unit": cascade.unit_test_impacts(lost, owners, links, fixtures),
        "data": cascade.data_test_impacts(lost, owners, links, tests, columns, depends),
        "exposures": cascade.exposures(predictions, down, links, spark.createDataFrame([("expo1", "dashboard"), ("expo2", "sync")], "exposure_id string, exposure_name string")),
    }


def _impacts(parts: dict[str, DataFrame]) -> DataFrame:
    out = parts["build"]
    for name in ("inherited", "broken", "unit", "data"):
        out = out.unionByName(parts[name])
    return out


_PROJECT = (
    "WITH RECURSIVE " + values("nodes", "name, mat, osc, b, c, sql", NODES) + ", " + values("links", "parent, child", LINKS) + ", " + values("reads", "reader, model, col", READS)
    + ", d(node) AS (SELECT child FROM links WHERE parent = 'stg' UNION SELECT child FROM d JOIN links ON node = parent),"
    " down AS (SELECT nodes.* FROM d JOIN nodes ON node = name),"
    " lost AS (SELECT 'stg' AS model, unnest([x FOR x IN b IF NOT list_contains(c, x)]) AS col FROM nodes WHERE name = 'stg'"
    " UNION ALL SELECT name, unnest([x FOR x IN b IF NOT list_contains(c, x)]) FROM down WHERE b IS NOT NULL AND c IS NOT NULL)"
)


def broken_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cascade(spark)["broken"].select("source", "affected", "reason")


BROKEN_SQL = (
    _PROJECT + ", pairs AS (SELECT down.name, down.sql, lost.model, lost.col, EXISTS (SELECT 1 FROM reads r WHERE r.reader = down.name AND r.model = lost.model) AS known,"
    " EXISTS (SELECT 1 FROM reads r WHERE r.reader = down.name AND r.model = lost.model AND r.col = lost.col) AS hit FROM down JOIN lost ON down.name <> lost.model WHERE mat <> 'ephemeral'),"
    " v AS (SELECT name, bool_or(NOT known) AS loose FROM pairs GROUP BY name)"
    " SELECT 'stg' AS source, name AS affected, concat(CASE WHEN loose THEN 'references' ELSE 'reads' END, ' dropped column(s): ', string_agg(DISTINCT col, ', ' ORDER BY col)) AS reason"
    " FROM pairs JOIN v USING (name) WHERE (known AND hit) OR (NOT known AND regexp_matches(sql, concat('(?i)\\b', col, '\\b'))) GROUP BY name, loose"
)


def inherited_losses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cascade(spark)["inherited"].select("source", "affected", "risk", "reason")


INHERITED_SQL = (
    _PROJECT + " SELECT 'stg' AS source, name AS affected, CASE WHEN b IS NULL THEN 'inherited_change' ELSE 'inherited_drop' END AS risk,"
    " CASE WHEN b IS NULL THEN 'file unchanged, its columns cannot be resolved on both sides -- REVIEW REQUIRED' ELSE 'file unchanged, loses note from upstream -- DROP COLUMN note' END AS reason"
    " FROM down WHERE mat = 'incremental' AND osc <> 'ignore' AND (b IS NULL OR len([x FOR x IN b IF NOT list_contains(c, x)]) > 0)"
)


def test_impacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = _cascade(spark)
    return parts["unit"].unionByName(parts["data"]).select("source", "affected", "risk")


TESTS_SQL = (
    _PROJECT + ", " + values("fx", "id, name, label, model, cols, why", FIXTURES) + ", " + values("dt", "id, name, needs, sql", TESTS) + ", " + values("dc", "id, model, col", TEST_COLUMNS)
    + ", " + values("dd", "id, model", TEST_DEPENDS)
    + ", near AS (SELECT DISTINCT child AS id FROM links WHERE parent = 'stg' OR parent IN (SELECT name FROM down)),"
    " u AS (SELECT DISTINCT fx.name, CASE WHEN cols IS NULL THEN 'unit_test_unreadable' ELSE 'unit_test_failure' END AS risk FROM fx JOIN near USING (id) JOIN lost USING (model)"
    " WHERE cols IS NULL OR list_contains(cols, lost.col)),"
    " d1 AS (SELECT DISTINCT dt.id, dt.name, 'data_test_failure' AS risk FROM dt JOIN near USING (id) JOIN dc USING (id) JOIN lost ON lost.model = dc.model AND lost.col = dc.col),"
    " d2 AS (SELECT DISTINCT dt.id, dt.name, CASE WHEN dt.sql IS NULL THEN 'data_test_unreadable' ELSE 'data_test_failure' END AS risk FROM dt JOIN near USING (id) JOIN dd USING (id) JOIN lost USING (model)"
    " WHERE dt.id NOT IN (SELECT id FROM d1) AND (dt.sql IS NULL OR regexp_matches(dt.sql, concat('(?i)\\b', lost.col, '\\b'))))"
    " SELECT 'stg' AS source, name AS affected, risk FROM (SELECT * FROM u UNION ALL SELECT name, risk FROM d1 UNION ALL SELECT name, risk FROM d2)"
)


def cascade_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = _cascade(spark)
    impacts = _impacts(parts)
    out = cascade.escalate(parts["predictions"], impacts)
    counts = impacts.groupBy(F.col("source").alias("name")).agg(F.count("*").alias("n_impacts"))
    expo = parts["exposures"].select(F.col("source").alias("name"), F.array_join("exposures", ",").alias("exposures"))
    out = out.join(counts, "name", "left").join(expo, "name", "left")
    return out.select("name", report.label(F.col("own_safety")).alias("own_safety"), report.label(F.col("safety")).alias("safety"), "n_impacts", "exposures")


VERDICT_SQL = "SELECT 'stg' AS name, 'destructive' AS own_safety, 'destructive' AS safety, CAST(10 AS BIGINT) AS n_impacts, 'dashboard,sync' AS exposures"

ALIASES = [("stg", "model.p.stg"), ("mid", "model.p.mid"), ("fct", "model.p.fct"), ("fct", "model.q.fct"), ("unit_1", "unit_test.p.unit_1")]


def ambiguity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customer names by nation: a short name that several keys share never resolves."""
    aliases = _read(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("name"), F.concat(F.lit("k"), "c_nationkey").alias("unique_id"))
    return report.resolve(aliases.select("name").distinct(), aliases).select("name", F.col("candidates").cast("long").alias("candidates"), "unique_id")


AMBIGUITY_SQL = (
    "SELECT c_mktsegment AS name, CAST(count(DISTINCT c_nationkey) AS BIGINT) AS candidates,"
    " CASE WHEN count(DISTINCT c_nationkey) = 1 THEN concat('k', min(c_nationkey)) END AS unique_id FROM customer GROUP BY 1"
)


def finding_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical facts of the literal project by rule, severity and uncertainty."""
    parts = _cascade(spark)
    refusals = spark.createDataFrame([("gone", "missing_compiled_sql", "no SQL")], "resource string, reason_code string, message string")
    aliases = spark.createDataFrame(ALIASES, "name string, unique_id string")
    own = parts["predictions"].withColumn("own_safety", F.col("safety"))
    rows = report.facts(own, _impacts(parts), refusals, aliases)
    return rows.select("rule_code", "source", "affected", "severity", F.array_join("uncertainty", ",").alias("uncertainty"), "waiver_allowed")


#: The rules over what the other oracles find: which code, how certain, which identity.
FINDINGS_SQL = (
    "WITH " + values("a", "name, unique_id", ALIASES) + ","
    " ids AS (SELECT name, count(DISTINCT unique_id) AS n FROM a GROUP BY name),"
    f" i AS (SELECT source, affected, 'broken_ref' AS risk FROM ({BROKEN_SQL}) UNION ALL SELECT source, affected, risk FROM ({INHERITED_SQL}) UNION ALL SELECT source, affected, risk FROM ({TESTS_SQL})"
    f" UNION ALL SELECT 'stg', name, 'build_failure' FROM ({_PROJECT} SELECT name FROM down WHERE mat = 'incremental' AND osc = 'fail')),"
    f" f AS (SELECT 'ddl.drop_column' AS rule_code, 'stg' AS source, 'stg' AS affected, 'destructive' AS severity, 'provenance_unavailable' AS why, FALSE AS blind FROM ({_PROJECT} SELECT col FROM lost WHERE model = 'stg')"
    " UNION ALL SELECT concat('cascade.', risk), source, affected, CASE WHEN risk IN ('broken_ref', 'inherited_drop') THEN 'destructive' ELSE 'warning' END, 'provenance_unavailable', risk LIKE '%unreadable' FROM i"
    " UNION ALL SELECT 'input.refusal', 'gone', 'gone', 'warning', 'missing_compiled_sql', FALSE),"
    " d AS (SELECT f.*, list_sort(list_distinct(list_filter([why, CASE WHEN blind THEN 'unresolved_input' END,"
    " CASE WHEN s.n IS NULL THEN 'unresolved_resource' WHEN s.n > 1 THEN 'ambiguous_resource' END,"
    " CASE WHEN t.n IS NULL THEN 'unresolved_resource' WHEN t.n > 1 THEN 'ambiguous_resource' END], lambda x: x IS NOT NULL))) AS doubt"
    " FROM f LEFT JOIN ids s ON f.source = s.name LEFT JOIN ids t ON f.affected = t.name)"
    " SELECT rule_code, source, affected, severity, array_to_string(doubt, ',') AS uncertainty, len(doubt) = 0 AS waiver_allowed FROM d"
)

POLICY_ROWS = [(i, w, r, f, c) for i, (w, r, f, c) in enumerate(product([0, 1, 2], [True, False], [None, "warning", "destructive", "never"], [0, 2, 5]))]


def exit_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame(POLICY_ROWS, "id int, worst int, refused boolean, fail_on string, code int")
    fail = F.coalesce("fail_on", F.lit(""))
    return rows.select("id", report.exit_code(F.col("worst"), F.col("refused"), fail, F.col("code")).alias("exit_code"))


EXIT_SQL = (
    "WITH " + values("t", "id, worst, refused, fail_on, code", POLICY_ROWS)
    + ", k AS (SELECT *, CASE WHEN fail_on = 'destructive' THEN 0 WHEN fail_on = 'warning' AND code = 0 THEN 2 ELSE code END AS w FROM t)"
    " SELECT id, CASE WHEN fail_on = 'never' THEN 0 WHEN worst = 2 THEN 1 WHEN worst = 1 OR refused THEN w ELSE 0 END AS exit_code FROM k"
)


def topk_impacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items stand for impacts of their order, their return flags for risks."""
    risk = F.when(F.col("l_returnflag") == "R", "broken_ref").when(F.col("l_returnflag") == "A", "inherited_change").otherwise("no_such_risk")
    seq = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    rows = _read(spark, sf_dir, "lineitem").select((F.col("l_orderkey") % 500).alias("source"), risk.alias("risk"), seq.alias("seq"), "l_partkey")
    return report.top_impacts(rows).groupBy("source").agg(F.sum("l_partkey").alias("keys"), F.max("hidden").cast("long").alias("hidden"), F.count_if(F.col("risk") == "broken_ref").alias("n_broken"))


TOPK_SQL = (
    "SELECT source, CAST(sum(l_partkey) AS BIGINT) AS keys, max(greatest(n - 10, 0)) AS hidden, CAST(count_if(l_returnflag = 'R') AS BIGINT) AS n_broken FROM"
    " (SELECT l_orderkey % 500 AS source, *, count(*) OVER (PARTITION BY l_orderkey % 500) AS n, row_number() OVER (PARTITION BY l_orderkey % 500"
    " ORDER BY CASE WHEN l_returnflag = 'R' THEN 2 ELSE 1 END DESC, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS place FROM lineitem) WHERE place <= 10 GROUP BY source"
)


def project_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders stand for models: their priority for the materialization, their status for the policy."""
    rows = _read(spark, sf_dir, "orders").select(
        F.when(F.col("o_orderpriority") == "1-URGENT", "incremental").otherwise(F.col("o_orderpriority")).alias("materialization"),
        F.nullif(F.col("o_orderstatus"), F.lit("P")).alias("on_schema_change"),
        (F.col("o_totalprice") > 100000).alias("star"),
    )
    return report.stats(rows)


STATS_SQL = (
    "WITH m AS (SELECT CASE WHEN o_orderpriority = '1-URGENT' THEN 'incremental' ELSE o_orderpriority END AS mat, coalesce(nullif(o_orderstatus, 'P'), 'ignore') AS osc, o_totalprice > 100000 AS star FROM orders)"
    " SELECT 'materialization' AS what, mat AS value, count(*) AS n FROM m GROUP BY mat UNION ALL SELECT 'on_schema_change', osc, count(*) FROM m WHERE mat = 'incremental' GROUP BY osc"
    " UNION ALL SELECT 'star', 'percent', CAST(count_if(star) * 100 // count(*) AS BIGINT) FROM m"
)

# ---- the whole check over two literal revisions
CAST_MODELS = [
    ("typed", "incremental", [("a", "INT"), ("b", "TEXT"), ("c", None)], [("a", "BIGINT"), ("b", None), ("c", "DATE")]),
    ("same", "incremental", [("a", "INT"), ("b", None)], [("a", "INT"), ("b", None)]),
    ("moved", "incremental", [("a", "INT")], [("z", "DATE"), ("a", "INT")]),
    ("built", "table", [("a", "INT")], [("a", "DATE")]),
    ("seen", "view", [("a", None)], [("a", "DATE")]),
]
_CASTS = [(m, mat, rev, c, t) for m, mat, *both in CAST_MODELS for rev, side in zip(("base", "current"), both, strict=True) for c, t in side]


def _revision(spark: SparkSession, models: dict[str, tuple[str, str, list[str]]], settings: dict[str, dict] | None = None) -> Revision:
    """A revision of name -> (materialization, statement, parents), with more of a model's manifest entry."""
    nodes, children = {}, {}
    for name, (mat, _, parents) in models.items():
        config = {"materialized": mat, "on_schema_change": "sync_all_columns" if mat == "incremental" else None}
        nodes[f"model.p.{name}"] = {"name": name, "alias": name, "resource_type": "model", "package_name": "p", "config": config} | (settings or {}).get(name, {})
        for p in parents:
            children.setdefault(f"model.p.{p}", []).append(f"model.p.{name}")
    manifest = {"metadata": {"project_name": "p", "adapter_type": "duckdb"}, "nodes": nodes, "child_map": children}
    files = spark.createDataFrame([(n, sql) for n, (_, sql, _) in models.items()], "stem string, sql string")
    return Revision(files, catalog.manifest_of(spark, json.dumps(manifest)))


def checked_casts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changed casts of incremental models by the whole check; what is built anew has none."""

    def side(rev: str) -> Revision:
        text = lambda m: ", ".join(f"cast({c} as {t}) as {c}" if t else c for n, _, r, c, t in _CASTS if (n, r) == (m, rev))
        return _revision(spark, {m: (mat, f"select {text(m)} from raw", []) for m, mat, *_ in CAST_MODELS})

    found = check(side("base"), side("current")).predictions.select("name", "own_safety", F.explode("operations").alias("o"))
    return found.where(F.col("o.op").startswith("TYPE CHANGED")).select("name", F.col("o.op").alias("op"), F.col("o.column").alias("column_name"), report.label(F.col("own_safety")).alias("safety"))


CHECKED_CASTS_SQL = (
    "WITH " + values("t", "name, mat, rev, c, kind", _CASTS)
    + " SELECT b.name, concat('TYPE CHANGED: ', coalesce(b.kind, 'unknown'), ' -> ', coalesce(n.kind, 'unknown')) AS op, b.c AS column_name, 'warning' AS safety"
    " FROM t b JOIN t n ON b.name = n.name AND b.c = n.c AND b.rev = 'base' AND n.rev = 'current' WHERE b.mat NOT IN ('table', 'view', 'ephemeral') AND b.kind IS DISTINCT FROM n.kind"
)
BOUND = [("root", "bound1", "id"), ("root", "bound1", "amount"), ("root", "bound1", "note"), ("root", "bound2", "id"), ("root", "bound2", "amount"), ("root", "bound3", "id"), ("root", "bound3", "extra")]


def checked_contracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Enforced contracts of unchanged models below one that loses a column."""
    names = sorted({m for _, m, _ in BOUND})
    below = {m: ("table", "select * from root", ["root"]) for m in names}
    settings = {m: {"config": {"materialized": "table", "contract": {"enforced": True}}, "columns": {c: {"name": c} for _, n, c in BOUND if n == m}} for m in names}
    base = _revision(spark, below | {"root": ("incremental", "select id, amount, note from raw", [])}, settings)
    current = _revision(spark, below | {"root": ("incremental", "select id, amount from raw", [])}, settings)
    return check(base, current).impacts.where("risk = 'contract_violation'").select("source", "affected", "reason", "waiver_allowed")


CHECKED_CONTRACTS_SQL = (
    "WITH " + values("d", "source, model, c", BOUND) + ", p(c) AS (VALUES ('id'), ('amount')), m AS (SELECT DISTINCT source, model FROM d),"
    " x AS (SELECT source, model, 1 AS k, c, concat('CONTRACT VIOLATION: ', c, ' missing in definition') AS t FROM d WHERE c NOT IN (SELECT c FROM p)"
    " UNION ALL SELECT source, model, 2, p.c, concat('CONTRACT VIOLATION: ', p.c, ' missing in contract') FROM m, p WHERE NOT EXISTS (SELECT 1 FROM d WHERE d.model = m.model AND d.c = p.c))"
    " SELECT source, model AS affected, string_agg(t, '; ' ORDER BY k, c) AS reason, TRUE AS waiver_allowed FROM x GROUP BY source, model"
)
#: (model, what the manifest says in each revision as JSON); compiled statements are equal.
MANIFESTS = [("db", '{"database": "a"}', '{"database": "b"}'), ("plain", '{"schema": "s"}', '{"schema": "s"}'), ("alias", '{"schema": "s"}', '{"schema": "s", "alias": "other"}')]


def checked_manifests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Models that only their manifest entries change."""
    models = {m: ("table", "select 1 as id", []) for m, _, _ in MANIFESTS}
    base, current = (_revision(spark, models, {r[0]: json.loads(r[i]) for r in MANIFESTS}) for i in (1, 2))
    return check(base, current).predictions.select("name", "status")


CHECKED_MANIFESTS_SQL = "WITH " + values("t", "name, b, c", MANIFESTS) + " SELECT name, 'modified' AS status FROM t WHERE CAST(b AS JSON) <> CAST(c AS JSON)"


def table_reach(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many nodes each region reaches over nations, customers and orders, frontier by frontier."""
    key = lambda kind, c: F.concat(F.lit(kind), F.col(c).cast("string"))
    links = [("nation", "r", "n_regionkey", "n", "n_nationkey"), ("customer", "n", "c_nationkey", "c", "c_custkey"), ("orders", "c", "o_custkey", "o", "o_orderkey")]
    edges = [_read(spark, sf_dir, t).select(key(a, x).alias("parent"), key(b, y).alias("child")) for t, a, x, b, y in links]
    roots = _read(spark, sf_dir, "region").select(key("r", "r_regionkey").alias("root"))
    found = closure.closure(edges[0].unionByName(edges[1]).unionByName(edges[2]), roots, sent_edges=0)
    return found.groupBy("root", "depth").agg(F.count("*").alias("n")).withColumn("depth", F.col("depth").cast("long"))


TABLE_REACH_SQL = (
    "WITH n AS (SELECT concat('r', n_regionkey) AS root, n_nationkey FROM nation), c AS (SELECT root, c_custkey FROM n JOIN customer ON n_nationkey = c_nationkey),"
    " o AS (SELECT root, o_orderkey FROM c JOIN orders ON c_custkey = o_custkey)"
    " SELECT root, CAST(depth AS BIGINT) AS depth, count(*) AS n FROM (SELECT root, 1 AS depth FROM n UNION ALL SELECT root, 2 FROM c UNION ALL SELECT root, 3 FROM o) GROUP BY 1, 2"
)

_PAIRS: dict[str, tuple[Query, str]] = {
    "meta_column_diff": (column_diff, COLUMN_DIFF_SQL),
    "meta_flagship": (flagship, FLAGSHIP_SQL),
    "meta_ddl_rules": (ddl_rules, DDL_RULES_SQL),
    "meta_rule_coverage": (rule_coverage, RULE_COVERAGE_SQL),
    "meta_cast_diff": (cast_diff, CAST_DIFF_SQL),
    "meta_contract": (contract, CONTRACT_SQL),
    "meta_tree_diff": (tree_diff, TREE_DIFF_SQL),
    "meta_inventory": (inventory, INVENTORY_SQL),
    "meta_deleted": (deleted_models, DELETED_SQL),
    "meta_setting_diff": (setting_diff, SETTING_SQL),
    "meta_closure": (reach, _REACH + " SELECT root, node FROM t WHERE root <> node"),
    "meta_select": (selection, SELECTION_SQL),
    "meta_cycles": (cycles, CYCLES_SQL),
    "meta_subgraph": (subgraph, SUBGRAPH_SQL),
    "meta_revision_edges": (revision_edges, REVISION_SQL),
    "meta_merged_edges": (merged_edges, MERGED_SQL),
    "meta_broken_ref": (broken_refs, BROKEN_SQL),
    "meta_inherited": (inherited_losses, INHERITED_SQL),
    "meta_tests": (test_impacts, TESTS_SQL),
    "meta_cascade": (cascade_verdict, VERDICT_SQL),
    "meta_ambiguity": (ambiguity, AMBIGUITY_SQL),
    "meta_findings": (finding_codes, FINDINGS_SQL),
    "meta_exit_policy": (exit_policy, EXIT_SQL),
    "meta_topk_impacts": (topk_impacts, TOPK_SQL),
    "meta_stats": (project_stats, STATS_SQL),
    "meta_check_casts": (checked_casts, CHECKED_CASTS_SQL),
    "meta_check_contracts": (checked_contracts, CHECKED_CONTRACTS_SQL),
    "meta_check_manifests": (checked_manifests, CHECKED_MANIFESTS_SQL),
    "meta_closure_tables": (table_reach, TABLE_REACH_SQL),
    **provenance.PAIRS,
}
QUERIES: dict[str, Query] = {k: q for k, (q, _) in _PAIRS.items()}
ORACLE_SQL: dict[str, str] = {k: s for k, (_, s) in _PAIRS.items()}
