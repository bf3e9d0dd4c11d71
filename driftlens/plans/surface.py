"""Executable forms of the SQL constructs that the analysis understands.

Each construct is one statement for Spark and, where another spelling is
needed, one for DuckDB. Where a dialect's construct has no Spark spelling, the
statement goes through functions/dialect.py, which rewrites it.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftlens.functions.dialect import Versioned, to_spark

TABLES = "region nation customer supplier part orders lineitem events documents embeddings".split()


@dataclass(frozen=True)
class Construct:
    spark: str
    duckdb: str | None = None  # None: the same text; "": no deterministic answer

    @property
    def oracle(self) -> str | None:
        return self.spark if self.duckdb is None else self.duckdb or None


def tables(spark: SparkSession, sf_dir: str, text: str) -> None:
    """Registers the tables that a statement names; columns and filters still reach their scans."""
    for name in TABLES:
        if re.search(rf"\b{name}\b", text):
            spark.read.parquet(f"{sf_dir}/{name}.parquet").createOrReplaceTempView(name)


def run(text: str) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        tables(spark, sf_dir, text)
        return spark.sql(text.replace("{sf_dir}", sf_dir))

    return query


def _money(column: str, function: str = "SUM") -> str:
    """An exact aggregate of a two-digit amount, as a double."""
    return f"CAST({function}(CAST({column} AS DECIMAL(18, 2))) AS DOUBLE)"


CONSTRUCTS: dict[str, Construct] = {
    # scans, projections, predicates
    "surf_projection": Construct("SELECT o_orderkey, o_custkey, o_totalprice * 2 AS doubled FROM orders"),
    "surf_star_plus": Construct("SELECT *, n_nationkey + 1 AS next_key FROM nation"),
    "surf_qualified_star": Construct("SELECT n.*, r.r_name FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey"),
    "surf_star_except": Construct("SELECT * EXCEPT (n_name) FROM nation", "SELECT * EXCLUDE (n_name) FROM nation"),
    "surf_cte_chain": Construct(
        "WITH a AS (SELECT o_orderkey AS k, o_custkey AS c FROM orders), b AS (SELECT k, c, k % 7 AS d FROM a WHERE c > 10) SELECT * FROM b"
    ),
    "surf_derived_table": Construct("SELECT * FROM (SELECT c_custkey, c_mktsegment AS segment FROM customer) AS t"),
    "surf_scalar_subquery": Construct(
        "SELECT n_nationkey, (SELECT MAX((SELECT COUNT(*) FROM region)) FROM nation) AS n_regions FROM nation",
    ),
    "surf_exists": Construct(
        "SELECT c_custkey, c_name FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 200000)"
    ),
    "surf_where_having_limit": Construct(
        "SELECT o_custkey, CAST(COUNT(*) AS BIGINT) AS n FROM orders WHERE o_orderstatus <> 'P' GROUP BY o_custkey HAVING COUNT(*) > 5 ORDER BY n DESC, o_custkey LIMIT 20"
    ),
    "surf_from_file": Construct("SELECT r_regionkey, r_name FROM parquet.`{sf_dir}/region.parquet`", "SELECT r_regionkey, r_name FROM region"),
    "surf_values": Construct("SELECT * FROM (VALUES (1, 'a'), (2, 'b'), (2, 'b')) AS t(id, label)"),
    # joins
    "surf_join_inner": Construct(
        "SELECT o.o_orderkey, c.c_name, n.n_name FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey"
    ),
    "surf_join_left": Construct(
        "SELECT c.c_custkey, o.o_orderkey FROM customer c LEFT JOIN orders o ON o.o_custkey = c.c_custkey AND o.o_totalprice > 250000"
    ),
    "surf_join_right": Construct("SELECT s.s_suppkey, n.n_nationkey FROM supplier s RIGHT JOIN nation n ON s.s_nationkey = n.n_nationkey"),
    "surf_join_full": Construct(
        "SELECT a.n_nationkey AS left_key, b.n_nationkey AS right_key FROM (SELECT * FROM nation WHERE n_nationkey < 15) a"
        " FULL OUTER JOIN (SELECT * FROM nation WHERE n_nationkey > 10) b ON a.n_nationkey = b.n_nationkey"
    ),
    "surf_join_using": Construct(
        "SELECT k, a_name, b_price FROM (SELECT o_orderkey AS k, o_orderpriority AS a_name FROM orders)"
        " JOIN (SELECT l_orderkey AS k, MAX(l_extendedprice) AS b_price FROM lineitem GROUP BY l_orderkey) USING (k)"
    ),
    "surf_join_cross": Construct("SELECT n.n_nationkey, r.r_regionkey FROM nation n, region r"),
    "surf_join_theta": Construct(
        "SELECT a.n_nationkey AS low, b.n_nationkey AS high FROM nation a JOIN nation b ON a.n_nationkey < b.n_nationkey AND a.n_regionkey = b.n_regionkey"
    ),
    "surf_join_semi": Construct("SELECT c.c_custkey, c.c_name FROM customer c SEMI JOIN orders o ON c.c_custkey = o.o_custkey"),
    "surf_join_anti": Construct("SELECT c.c_custkey, c.c_name FROM customer c ANTI JOIN orders o ON c.c_custkey = o.o_custkey AND o.o_totalprice > 300000"),
    "surf_join_lateral": Construct(
        "SELECT c.c_custkey, CAST(CAST(r.last_order AS DATE) AS STRING) AS last_order FROM customer c"
        " LEFT JOIN LATERAL (SELECT MAX(o.o_orderdate) AS last_order FROM orders o WHERE o.o_custkey = c.c_custkey) r ON TRUE",
        "SELECT c.c_custkey, CAST(CAST(r.last_order AS DATE) AS VARCHAR) AS last_order FROM customer c"
        " LEFT JOIN LATERAL (SELECT MAX(o.o_orderdate) AS last_order FROM orders o WHERE o.o_custkey = c.c_custkey) r ON TRUE",
    ),
    "surf_unnest": Construct(
        "SELECT vec_id, CAST(x AS DOUBLE) AS x FROM embeddings LATERAL VIEW explode(embedding) t AS x",
        "SELECT vec_id, CAST(x AS DOUBLE) AS x FROM embeddings, UNNEST(embedding) AS t(x)",
    ),
    "surf_unnest_offset": Construct(
        "SELECT vec_id, CAST(p AS BIGINT) AS item_offset, CAST(x AS DOUBLE) AS x FROM embeddings LATERAL VIEW posexplode(embedding) t AS p, x",
        "SELECT vec_id, CAST(UNNEST(range(len(embedding))) AS BIGINT) AS item_offset, CAST(UNNEST(embedding) AS DOUBLE) AS x FROM embeddings",
    ),
    "surf_recursive": Construct(
        "WITH RECURSIVE t(n, total) AS (SELECT 1, CAST(1 AS BIGINT) UNION ALL SELECT n + 1, total + n + 1 FROM t WHERE n < 20) SELECT n, total FROM t",
        "WITH RECURSIVE t(n, total) AS (SELECT 1, CAST(1 AS BIGINT) UNION ALL SELECT n + 1, CAST(total + n + 1 AS BIGINT) FROM t WHERE n < 20) SELECT n, total FROM t",
    ),
    # aggregation
    "surf_agg_basic": Construct(
        f"SELECT l_returnflag, l_linestatus, CAST(COUNT(*) AS BIGINT) AS n, {_money('l_extendedprice')} AS revenue, MIN(l_quantity) AS lo, MAX(l_quantity) AS hi"
        " FROM lineitem GROUP BY 1, 2"
    ),
    "surf_agg_distinct": Construct("SELECT c_mktsegment, CAST(COUNT(DISTINCT c_nationkey) AS BIGINT) AS n FROM customer GROUP BY c_mktsegment"),
    "surf_agg_all": Construct(f"SELECT o_orderstatus, o_orderpriority, {_money('o_totalprice')} AS total FROM orders GROUP BY ALL"),
    "surf_agg_grouping_sets": Construct(
        "SELECT o_orderstatus, o_orderpriority, CAST(COUNT(*) AS BIGINT) AS n, CAST(grouping_id(o_orderstatus, o_orderpriority) AS BIGINT) AS mask"
        " FROM orders GROUP BY GROUPING SETS ((o_orderstatus, o_orderpriority), (o_orderstatus), ())",
        "SELECT o_orderstatus, o_orderpriority, CAST(COUNT(*) AS BIGINT) AS n, CAST(GROUPING(o_orderstatus, o_orderpriority) AS BIGINT) AS mask"
        " FROM orders GROUP BY GROUPING SETS ((o_orderstatus, o_orderpriority), (o_orderstatus), ())",
    ),
    "surf_agg_rollup": Construct(
        f"SELECT l_returnflag, l_linestatus, {_money('l_extendedprice')} AS total FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)"
    ),
    "surf_agg_cube": Construct("SELECT l_returnflag, l_linestatus, CAST(COUNT(*) AS BIGINT) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)"),
    "surf_agg_filter": Construct(
        f"SELECT o_custkey, CAST(COUNT(*) FILTER (WHERE o_orderstatus = 'F') AS BIGINT) AS finished,"
        f" CAST(SUM(CAST(o_totalprice AS DECIMAL(18, 2))) FILTER (WHERE o_orderpriority = '1-URGENT') AS DOUBLE) AS urgent FROM orders GROUP BY o_custkey"
    ),
    "surf_agg_count_if": Construct(
        "SELECT o_custkey, CAST(COUNT_IF(o_orderstatus = 'F') AS BIGINT) AS finished, CAST(SUM(IF(o_totalprice > 100000, 1, 0)) AS BIGINT) AS large FROM orders GROUP BY o_custkey"
    ),
    "surf_agg_percentile": Construct(
        "SELECT l_returnflag, CAST(2 * PERCENTILE_CONT(0.5) WITHIN GROUP (ORDER BY CAST(ROUND(100 * l_extendedprice) AS BIGINT)) AS BIGINT) AS median_half_cents FROM lineitem GROUP BY l_returnflag"
    ),
    "surf_array_agg_ordered": Construct(
        "SELECT o_custkey, array_join(transform(array_sort(collect_list(struct(o_orderkey))), x -> CAST(x.o_orderkey AS STRING)), ',') AS keys FROM orders GROUP BY o_custkey",
        "SELECT o_custkey, string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY o_orderkey) AS keys FROM orders GROUP BY o_custkey",
    ),
    "surf_list_agg": Construct(
        "SELECT n_regionkey, listagg(n_name, '|') WITHIN GROUP (ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey",
        "SELECT n_regionkey, string_agg(n_name, '|' ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey",
    ),
    "surf_list_size": Construct(
        "SELECT c_mktsegment, CAST(size(collect_list(c_custkey)) AS BIGINT) AS n FROM customer GROUP BY c_mktsegment",
        "SELECT c_mktsegment, CAST(len(list(c_custkey)) AS BIGINT) AS n FROM customer GROUP BY c_mktsegment",
    ),
    "surf_approx_distinct": Construct("SELECT l_returnflag, approx_count_distinct(l_partkey) AS parts FROM lineitem GROUP BY l_returnflag", ""),
    "surf_distinct_on": Construct(
        "SELECT o_custkey, o_orderkey AS latest FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS rn FROM orders) WHERE rn = 1",
        "SELECT DISTINCT ON (o_custkey) o_custkey, o_orderkey AS latest FROM orders ORDER BY o_custkey, o_orderdate DESC, o_orderkey",
    ),
    "surf_tablesample": Construct("SELECT l_orderkey, l_partkey FROM lineitem TABLESAMPLE (10 PERCENT) REPEATABLE (7)", ""),
    # windows
    "surf_window_functions": Construct(
        "SELECT event_id, CAST(row_number() OVER w AS BIGINT) AS row_num, lag(event_id) OVER w AS previous, ROUND(SUM(value) OVER (PARTITION BY user_id), 2) AS spend"
        " FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)"
    ),
    "surf_qualify": Construct(
        "SELECT event_id, user_id FROM (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) AS rn FROM events) WHERE rn = 1",
        "SELECT event_id, user_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) = 1",
    ),
    "surf_named_window": Construct(
        "SELECT o_custkey, o_orderkey, CAST(row_number() OVER w AS BIGINT) AS order_rank, CAST(SUM(CAST(o_totalprice AS DECIMAL(18, 2))) OVER w AS DOUBLE) AS running"
        " FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)"
    ),
    "surf_window_range": Construct(
        "SELECT o_custkey, o_orderkey, CAST(SUM(CAST(o_totalprice AS DECIMAL(18, 2))) OVER (PARTITION BY o_custkey ORDER BY o_orderdate) AS DOUBLE) AS running FROM orders"
    ),
    # set operations, pivot
    "surf_set_union_all": Construct("SELECT 'customer' AS kind, c_nationkey AS k FROM customer UNION ALL SELECT 'supplier' AS kind, s_nationkey FROM supplier"),
    "surf_set_union": Construct("SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier"),
    "surf_set_intersect": Construct("SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier"),
    "surf_set_except": Construct("SELECT 100 * c_nationkey + c_custkey % 100 AS k FROM customer EXCEPT SELECT 100 * s_nationkey + s_suppkey % 100 FROM supplier"),
    "surf_pivot": Construct(
        "SELECT * FROM (SELECT o_orderpriority, o_orderstatus, o_orderkey FROM orders) PIVOT (COUNT(o_orderkey) FOR o_orderstatus IN ('F' AS f, 'O' AS o, 'P' AS p))",
        "SELECT o_orderpriority, CASE WHEN COUNT_IF(o_orderstatus = 'F') > 0 THEN CAST(COUNT_IF(o_orderstatus = 'F') AS BIGINT) END AS f,"
        " CASE WHEN COUNT_IF(o_orderstatus = 'O') > 0 THEN CAST(COUNT_IF(o_orderstatus = 'O') AS BIGINT) END AS o,"
        " CASE WHEN COUNT_IF(o_orderstatus = 'P') > 0 THEN CAST(COUNT_IF(o_orderstatus = 'P') AS BIGINT) END AS p FROM orders GROUP BY o_orderpriority",
    ),
    "surf_unpivot": Construct(
        "SELECT * FROM (SELECT s_suppkey, CAST(s_nationkey AS DOUBLE) AS nation, s_acctbal AS balance FROM supplier) UNPIVOT (amount FOR what IN (nation, balance))",
        "SELECT s_suppkey, what, amount FROM (SELECT s_suppkey, CAST(s_nationkey AS DOUBLE) AS nation, s_acctbal AS balance FROM supplier) UNPIVOT (amount FOR what IN (nation, balance))",
    ),
    # scalars
    "surf_scalar_case": Construct("SELECT p_partkey, CASE WHEN p_size > 30 THEN 'large' WHEN p_size > 10 THEN 'medium' ELSE 'small' END AS size_class FROM part"),
    "surf_scalar_coalesce": Construct(
        "SELECT o_orderkey, COALESCE(NULLIF(o_orderstatus, 'F'), 'none') AS status, IFNULL(NULLIF(o_orderpriority, '5-LOW'), 'low') AS priority FROM orders"
    ),
    "surf_scalar_cast": Construct("SELECT o_orderkey, CAST(o_totalprice AS DECIMAL(18, 1)) > 1000 AS over_1000, CAST(o_orderkey AS STRING) AS k FROM orders"),
    "surf_scalar_try_cast": Construct("SELECT p_partkey, TRY_CAST(substr(p_type, 1, 3) AS INT) AS n, TRY_CAST(CAST(p_size AS STRING) AS BIGINT) AS p_size FROM part"),
    "surf_scalar_variant": Construct(
        "SELECT event_id, CAST(parse_json(props):k::string AS BIGINT) AS k FROM events",
        "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events",
    ),
    "surf_scalar_json": Construct("SELECT event_id, get_json_object(props, '$.k') AS k FROM events", "SELECT event_id, props ->> '$.k' AS k FROM events"),
    "surf_scalar_date": Construct(
        "SELECT o_orderkey, CAST(CAST(date_trunc('MONTH', o_orderdate) AS DATE) AS STRING) AS month, CAST(datediff(DAY, TIMESTAMP_NTZ'1995-01-01', o_orderdate) AS BIGINT) AS days,"
        " CAST(CAST(dateadd(DAY, 3, o_orderdate) AS DATE) AS STRING) AS later FROM orders",
        "SELECT o_orderkey, CAST(CAST(date_trunc('month', o_orderdate) AS DATE) AS VARCHAR) AS month, date_diff('day', TIMESTAMP '1995-01-01', o_orderdate) AS days,"
        " CAST(CAST(o_orderdate + INTERVAL 3 DAY AS DATE) AS VARCHAR) AS later FROM orders",
    ),
    "surf_scalar_current_date": Construct("SELECT r_regionkey, current_date() >= DATE'2024-01-01' AS recent FROM region", "SELECT r_regionkey, current_date >= DATE '2024-01-01' AS recent FROM region"),
    "surf_scalar_tz": Construct(
        "SELECT event_id, date_format(convert_timezone('UTC', 'Asia/Tokyo', ts), 'yyyy-MM-dd HH:mm') AS local FROM events",
        "SELECT event_id, strftime(timezone('Asia/Tokyo', timezone('UTC', ts)), '%Y-%m-%d %H:%M') AS local FROM events",
    ),
    "surf_scalar_array": Construct(
        "SELECT vec_id, CAST(get(embedding, 0) AS DOUBLE) AS first, CAST(get(embedding, 100000) AS DOUBLE) AS none FROM embeddings",
        "SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS first, CAST(embedding[100001] AS DOUBLE) AS none FROM embeddings",
    ),
    "surf_scalar_comprehension": Construct(
        "SELECT vec_id, CAST(size(transform(filter(embedding, x -> x > 0), x -> x * 2)) AS BIGINT) AS positive FROM embeddings",
        "SELECT vec_id, CAST(len([x * 2 FOR x IN embedding IF x > 0]) AS BIGINT) AS positive FROM embeddings",
    ),
    "surf_scalar_map": Construct(
        "SELECT o_orderkey, map('status', o_orderstatus, 'priority', o_orderpriority)['status'] AS status,"
        " try_element_at(map('status', o_orderstatus), 'none') AS missing FROM orders",
        "SELECT o_orderkey, MAP {'status': o_orderstatus, 'priority': o_orderpriority}['status'] AS status, CAST(NULL AS VARCHAR) AS missing FROM orders",
    ),
    "surf_scalar_struct": Construct(
        "SELECT o_orderkey, named_struct('a', o_orderstatus, 'b', o_custkey).b AS custkey FROM orders",
        "SELECT o_orderkey, struct_pack(a := o_orderstatus, b := o_custkey).b AS custkey FROM orders",
    ),
    "surf_scalar_explode": Construct(
        "SELECT n_nationkey, explode(split(n_name, 'A')) AS part FROM nation", "SELECT n_nationkey, unnest(string_split(n_name, 'A')) AS part FROM nation"
    ),
    "surf_scalar_literals": Construct("SELECT r_regionkey, 'SELECT * FROM t; -- no' AS a, 'it''s' AS b FROM region", None),
}


def star_replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """* REPLACE (lower(r_name) AS r_name): the column keeps its place."""
    return spark.read.parquet(f"{sf_dir}/region.parquet").withColumn("r_name", F.lower("r_name"))


def star_rename(spark: SparkSession, sf_dir: str) -> DataFrame:
    """* RENAME (r_name AS label)."""
    return spark.read.parquet(f"{sf_dir}/region.parquet").withColumnRenamed("r_name", "label")


def columns_regex(spark: SparkSession, sf_dir: str) -> DataFrame:
    """COLUMNS('s_.*key')."""
    df = spark.read.parquet(f"{sf_dir}/supplier.parquet")
    return df.select(df.colRegex("`s_.*key`"))


def as_of_join(left: DataFrame, right: DataFrame, by: str, at: str, value: str, strict: bool = False) -> DataFrame:
    """left with the `value` of the latest row of right that is not later (strict: earlier), for the same `by`.

    One shuffle and one sort: both sides are merged by (by, at) and the last
    value of the right side is carried along. At equal times right rows come
    first, or last where strict. Left rows without a match have null; rows with a
    null key or time match nothing; of right rows at one time the largest value
    counts.
    """
    from pyspark.sql import Window

    cols = left.columns
    one = left.select(*cols, F.lit(None).cast(right.schema[value].dataType).alias("__v"), F.lit(0 if strict else 1).alias("__side"), F.lit(False).alias("__right"))
    two = right.select(
        *(F.col(c) if c in (by, at) else F.lit(None).cast(left.schema[c].dataType).alias(c) for c in cols),
        F.col(value).alias("__v"),
        F.lit(1 if strict else 0).alias("__side"),
        F.lit(True).alias("__right"),
    ).filter(F.col(by).isNotNull() & F.col(at).isNotNull())
    w = Window.partitionBy(by).orderBy(F.col(at).asc_nulls_first(), "__side", F.col("__v").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    merged = one.unionByName(two).withColumn("__seen", F.last("__v", ignorenulls=True).over(w))
    return merged.filter(~F.col("__right")).select(*cols, F.when(F.col(by).isNotNull(), F.col("__seen")).alias(f"asof_{value}"))


def asof_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each purchase with the latest signup of its user that is not later."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    left = events.filter("event_type = 'purchase'").select("event_id", "user_id", "ts")
    right = events.filter("event_type = 'signup'").select("user_id", "ts", F.col("event_id").alias("signup_id"))
    return as_of_join(left, right, "user_id", "ts", "signup_id").select("event_id", "user_id", "asof_signup_id")


#: Statements of other dialects: (dialect, text, the same in DuckDB).
FOREIGN: dict[str, tuple[str, str, str]] = {
    "surf_star_exclude": ("snowflake", "SELECT * EXCLUDE (n_name, n_regionkey), '* EXCLUDE x' AS note FROM nation", "SELECT * EXCLUDE (n_name, n_regionkey), '* EXCLUDE x' AS note FROM nation"),
    "surf_flatten": (
        "snowflake",
        "SELECT vec_id, CAST(f.index AS BIGINT) AS item, CAST(f.value AS DOUBLE) AS x FROM embeddings, LATERAL FLATTEN(INPUT => embedding) f",
        "SELECT vec_id, CAST(UNNEST(range(len(embedding))) AS BIGINT) AS item, CAST(UNNEST(embedding) AS DOUBLE) AS x FROM embeddings",
    ),
    "surf_lateral_view": (
        "hive",
        "SELECT n_nationkey, part FROM nation LATERAL VIEW EXPLODE(split(n_name, 'A')) t AS part",
        "SELECT n_nationkey, unnest(string_split(n_name, 'A')) AS part FROM nation",
    ),
    "surf_array_join": (
        "clickhouse",
        "SELECT vec_id, CAST(x AS DOUBLE) AS x FROM embeddings ARRAY JOIN embedding AS x WHERE x > 0",
        "SELECT vec_id, CAST(x AS DOUBLE) AS x FROM embeddings, UNNEST(embedding) AS t(x) WHERE x > 0",
    ),
    "surf_final": (
        "clickhouse",
        "SELECT user_id, event_id FROM events FINAL",
        "SELECT user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1",
    ),
    "surf_hints": (
        "mysql",
        "SELECT STRAIGHT_JOIN c.c_custkey, o.o_orderkey, 'USE INDEX (a)' AS note FROM customer c FORCE INDEX (by_key) STRAIGHT_JOIN orders o USE INDEX FOR JOIN (by_customer) ON c.c_custkey = o.o_custkey",
        "SELECT c.c_custkey, o.o_orderkey, 'USE INDEX (a)' AS note FROM customer c JOIN orders o ON c.c_custkey = o.o_custkey",
    ),
}
VERSIONED = {"events": Versioned(("user_id",), "event_id")}

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    **{name: run(to_spark(text, dialect, VERSIONED)) for name, (dialect, text, _) in FOREIGN.items()},
    **{name: run(c.spark) for name, c in CONSTRUCTS.items()},
    "surf_star_replace": star_replace,
    "surf_star_rename": star_rename,
    "surf_columns_regex": columns_regex,
    "surf_asof": asof_query,
}
ORACLE_SQL: dict[str, str] = {
    **{name: c.oracle for name, c in CONSTRUCTS.items() if c.oracle},
    **{name: duckdb for name, (_, _, duckdb) in FOREIGN.items()},
    "surf_star_replace": "SELECT * REPLACE (lower(r_name) AS r_name) FROM region",
    "surf_star_rename": "SELECT r_regionkey, r_name AS label FROM region",
    "surf_columns_regex": "SELECT COLUMNS('s_.*key') FROM supplier",
    "surf_asof": (
        "SELECT p.event_id, p.user_id, s.event_id AS asof_signup_id FROM (SELECT * FROM events WHERE event_type = 'purchase') p"
        " ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'signup') s ON p.user_id = s.user_id AND p.ts >= s.ts"
    ),
}
