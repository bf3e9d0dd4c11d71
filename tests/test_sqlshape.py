import pytest

from driftlens.functions.sqlshape import extract, extract_casts, extract_columns, only_in_comments, reads_by_relation
from driftlens.functions.types import type_family

#: dialect, statement, output names (None: refused). Each kind has its positive, a control without a projection, an invariance control.
SHAPES = [
    ("bigquery", "SELECT order_id, book_ids[SAFE_OFFSET(0)] AS first_book FROM orders", ["order_id", "first_book"]),
    ("bigquery", "SELECT order_id FROM orders", ["order_id"]),
    ("bigquery", "SELECT o.id, i.sku AS sku, pos FROM orders AS o CROSS JOIN UNNEST(o.items) AS i WITH OFFSET AS pos", ["id", "sku", "pos"]),
    ("snowflake", "WITH a AS (SELECT id, raw:u::STRING AS u FROM r), b AS (SELECT id AS k, u FROM a) SELECT * FROM b WHERE k > 1", ["k", "u"]),
    ("duckdb", "SELECT o.id, p.price AS unit FROM orders o ASOF LEFT JOIN prices p ON o.b = p.b AND o.at >= p.at", ["id", "unit"]),
    ("duckdb", "SELECT c, SUM(x) AS total FROM orders GROUP BY ALL", ["c", "total"]),
    ("duckdb", "SELECT id, [x * 2 FOR x IN q IF x > 0] AS doubled FROM orders", ["id", "doubled"]),
    ("duckdb", "SELECT c.id FROM customers c SEMI JOIN orders o ON c.id = o.id", ["id"]),
    ("postgres", "SELECT c, COUNT(*) FILTER (WHERE s = 'paid') AS paid FROM orders GROUP BY c", ["c", "paid"]),
    ("postgres", "SELECT DISTINCT ON (c) c, o AS latest FROM orders ORDER BY c, at DESC", ["c", "latest"]),
    ("postgres", "SELECT c, GROUPING(c, s) AS mask FROM orders GROUP BY GROUPING SETS ((c, s), (c), ())", ["c", "mask"]),
    ("postgres", "SELECT c.id, r.at FROM customers c LEFT JOIN LATERAL (SELECT MAX(o.at) AS at FROM orders o WHERE o.c = c.id) r ON TRUE", ["id", "at"]),
    ("postgres", "SELECT c, ROW_NUMBER() OVER w AS n FROM orders WINDOW w AS (PARTITION BY c ORDER BY at)", ["c", "n"]),
    ("postgres", "SELECT c, PERCENTILE_CONT(0.5) WITHIN GROUP (ORDER BY amount) AS median FROM orders GROUP BY c", ["c", "median"]),
    ("postgres", "SELECT id FROM orders TABLESAMPLE SYSTEM (10) REPEATABLE (7)", ["id"]),
    ("postgres", "SELECT id, at AT TIME ZONE 'UTC' AS utc FROM orders", ["id", "utc"]),
    ("trino", "SELECT id, attributes['channel'] AS channel FROM orders", ["id", "channel"]),
    ("snowflake", "SELECT u, ROW_NUMBER() OVER (PARTITION BY u ORDER BY d) AS n FROM e QUALIFY n = 1", ["u", "n"]),
    ("clickhouse", "SELECT id FROM t FINAL", ["id"]),
    ("snowflake", "SELECT a FROM t UNION ALL SELECT b FROM u", ["a"]),
    ("snowflake", "SELECT * FROM t", ["*"]),
    ("snowflake", "SELECT t.* FROM t", ["*"]),
    ("snowflake", "SELECT * FROM a, b", ["*"]),
    ("snowflake", "SELECT a, b + 1 FROM t", None),
    ("bigquery", "SELECT * EXCEPT (a) FROM t", None),
    ("snowflake", "SELECT * RENAME (a AS b) FROM t", None),
    ("duckdb", "WITH c AS (SELECT a, b FROM t) SELECT * EXCLUDE (a) FROM c", ["b"]),
    ("duckdb", "WITH c AS (SELECT a, b FROM t) SELECT * EXCLUDE (z) FROM c", None),
    ("duckdb", "SELECT * FROM (SELECT a, b AS c FROM t) x WHERE a > 1", ["a", "c"]),
    ("snowflake", 'SELECT "A" FROM t', None),
    ("duckdb", 'SELECT "A" FROM t', ["a"]),
    ("snowflake", "VALUES (1, 2)", None),
    ("snowflake", "CREATE TABLE x AS SELECT 1 AS a", None),
    ("snowflake", "SELECT a FROM t; SELECT b FROM u", None),
    ("snowflake", "", None),
    ("snowflake", "no statement at all", None),
    ("snowflake", "SELECT 'x", None),
]


@pytest.mark.parametrize(("dialect", "sql", "names"), SHAPES)
def test_output_names(dialect, sql, names):
    assert extract_columns(sql, dialect) == names
    assert extract_columns("﻿" + sql.replace(" FROM ", "\r\nFROM ") + " -- end", dialect) == names


def test_partial_names_are_kept_apart():
    found = extract("SELECT a, b + 1, c FROM t", "snowflake")
    assert (found.names, found.state) == (["a", "c"], "partial")


def test_star_of_models():
    known = {"stg": ["ID", "Amount"], "s.other": ["x"]}
    assert extract_columns("SELECT * FROM stg", "duckdb", known.get) == ["id", "amount"]
    assert extract_columns("SELECT o.*, stg.id AS k FROM stg JOIN s.other o ON TRUE", "duckdb", known.get) == ["x", "k"]
    assert extract_columns("WITH stg AS (SELECT * FROM stg) SELECT * FROM stg", "duckdb", known.get) == ["*"]
    assert extract_columns("SELECT * FROM stg AS t(a, b)", "duckdb", known.get) == ["*"]


#: Each reason not to know what a star stands for, with the nearest statement that is known.
KNOWN = {"t": ["a", "b"], "u": ["c"], "s.t": ["d"], "starred": ["*"]}
REFUSALS = [
    ("SELECT * FROM t, u", "SELECT t.*, c FROM t, u", ["a", "b", "c"]),
    ("SELECT * FROM t JOIN u ON TRUE", "SELECT u.*, t.* FROM t JOIN u ON TRUE", ["c", "a", "b"]),
    ("SELECT z.* FROM t", "SELECT z.* FROM t AS z", ["a", "b"]),
    ("SELECT t.* FROM t AS z", "SELECT t.* FROM t", ["a", "b"]),
    ("SELECT s.t.* FROM s.t AS z", "SELECT s.t.* FROM s.t", ["d"]),
    ("SELECT t.* FROM t JOIN s.t ON TRUE", "SELECT s.t.* FROM s.t JOIN u ON TRUE", ["d"]),
    ("SELECT * FROM t AS z(q, w)", "SELECT * FROM t AS z", ["a", "b"]),
    ("SELECT * FROM generate_series(1, 3) AS g", "SELECT g FROM generate_series(1, 3) AS g", ["g"]),
    ("SELECT * FROM (SELECT * FROM t) x", "SELECT * FROM (SELECT a FROM t) x", ["a"]),
    ("SELECT * FROM (SELECT a, b + 1 FROM t) x", "SELECT * FROM (SELECT a, b + 1 AS n FROM t) x", ["a", "n"]),
    ("SELECT * FROM (SELECT UNNEST(a) AS e FROM t) x", "SELECT * FROM (SELECT ABS(a) AS e FROM t) x", ["e"]),
    ("SELECT * FROM (WITH c AS (SELECT 1 AS a) SELECT a FROM c) x", "WITH c AS (SELECT 1 AS a) SELECT * FROM c", ["a"]),
    ("SELECT * FROM (SELECT a FROM t UNION ALL SELECT c FROM u) x", "SELECT * FROM t UNION ALL SELECT c, c FROM u", ["a", "b"]),
    ("WITH c(z) AS (SELECT a FROM t) SELECT * FROM c", "WITH c AS (SELECT a AS z FROM t) SELECT * FROM c", ["z"]),
    ("WITH c AS (SELECT a FROM t UNION SELECT c FROM u) SELECT * FROM c", "WITH c AS (SELECT a FROM t) SELECT * FROM c", ["a"]),
    ("WITH c AS (SELECT * FROM c) SELECT * FROM c", "WITH c AS (SELECT * FROM t) SELECT * FROM c", ["a", "b"]),
    ("WITH c AS (SELECT * FROM d), d AS (SELECT a FROM t) SELECT * FROM c", "WITH d AS (SELECT a FROM t), c AS (SELECT * FROM d) SELECT * FROM c", ["a"]),
    ("WITH RECURSIVE c AS (SELECT 1 AS n UNION ALL SELECT n + 1 FROM c) SELECT * FROM c", "WITH RECURSIVE c AS (SELECT 1 AS n UNION ALL SELECT n + 1 FROM c) SELECT n FROM c", ["n"]),
    ("SELECT * REPLACE (a + 1 AS a) FROM t", "SELECT * EXCLUDE (a) FROM t", ["b"]),
    ("SELECT * EXCLUDE (z) FROM t", "SELECT * EXCLUDE (b) FROM t", ["a"]),
    ("SELECT * FROM v", "SELECT * FROM u", ["c"]),
    ("SELECT * FROM starred", "SELECT x.* FROM u AS x", ["c"]),
]


@pytest.mark.parametrize(("refused", "nearest", "names"), REFUSALS)
def test_stars_that_are_not_proved(refused, nearest, names):
    assert extract_columns(refused, "duckdb", KNOWN.get) in (None, ["*"])
    assert extract_columns(nearest, "duckdb", KNOWN.get) == names


@pytest.mark.parametrize(("ctes", "names"), [(32, ["a", "b"]), (33, ["*"]), (2_000, ["*"])])
def test_chains_of_stars(ctes, names):
    chain = ", ".join(f"c{i} AS (SELECT * FROM {f'c{i - 1}' if i else 't'})" for i in range(ctes))
    assert extract_columns(f"WITH {chain} SELECT * FROM c{ctes - 1}", "duckdb", KNOWN.get) == names


def test_only_needed_relations_are_asked():
    asked = []
    sql = "WITH idle AS (SELECT * FROM far), bad AS (SELECT a + 1 FROM t), c AS (SELECT * FROM t) SELECT * FROM c"
    assert extract_columns(sql, "duckdb", lambda k: asked.append(k) or KNOWN.get(k)) == ["a", "b"]
    assert asked == ["t"]


def test_deep_nesting_never_raises():
    deep = "SELECT " + "(SELECT " * 150 + "1" + ")" * 150 + " AS x FROM t"
    assert extract_columns(deep, "snowflake") in (["x"], None)
    assert extract_columns("SELECT " + ", ".join(f"c{i}" for i in range(12_000)) + " FROM t") is not None


def test_casts():
    assert extract_casts("SELECT CAST(a AS int) AS b, c::varchar(10) AS d, e FROM t", "postgres") == {"b": "INT", "d": "VARCHAR(10)"}
    assert extract_casts("WITH x AS (SELECT a::date AS a FROM t) SELECT * FROM x", "postgres") == {"a": "DATE"}
    assert extract_casts("SELECT a + b::int AS c FROM t", "postgres") == {}


SCHEMA = {"stg_orders": ["order_id", "customer_id", "status"], "dim_customers": ["customer_id", "tier"]}
READS = [
    ("SELECT order_id, c.tier FROM stg_orders o JOIN dim_customers c ON o.customer_id = c.customer_id", {"stg_orders": ["customer_id", "order_id"], "dim_customers": ["customer_id", "tier"]}),
    ("SELECT * FROM stg_orders", {"stg_orders": []}),
    ("WITH x AS (SELECT order_id FROM stg_orders) SELECT * FROM x", {"stg_orders": ["order_id"]}),
    ("WITH x AS (SELECT order_id FROM stg_orders) SELECT order_id FROM x", None),
    # the inner column, not the outer one of the same name
    ("SELECT tier FROM dim_customers c WHERE EXISTS (SELECT 1 FROM stg_orders WHERE customer_id = c.tier)", {"dim_customers": ["tier"], "stg_orders": ["customer_id"]}),
    ("SELECT customer_id FROM stg_orders, dim_customers", None),
    ("SELECT 'customer_id' AS x FROM stg_orders -- customer_id", {"stg_orders": []}),
    ("SELECT nothing FROM stg_orders", None),
]


@pytest.mark.parametrize(("sql", "expected"), READS)
def test_reads(sql, expected):
    assert reads_by_relation(sql, SCHEMA, "snowflake") == expected


def test_comment_only_dependency():
    known = {"stg_orders", "dim_customers"}
    assert only_in_comments("-- reads dim_customers\nSELECT order_id FROM stg_orders", "dim_customers", known)
    assert not only_in_comments("SELECT order_id FROM stg_orders JOIN dim_customers USING (k) -- dim_customers", "dim_customers", known)
    assert not only_in_comments("-- depends_on: dim_customers\nSELECT order_id FROM stg_orders", "dim_customers", known)


FAMILIES = [("varchar", "text"), ("TEXT", "text"), ("string", "text"), ("integer", "number"), ("numeric(18,2)", "number"), ("int64", "number"), ("date", "date/time"),
            ("timestamp_ntz", "date/time"), ("boolean", "boolean"), ("variant", None), ("array<int>", None), ("garbage", None), ("", None), (None, None), ("double precision", "number")]


@pytest.mark.parametrize(("declared", "family"), FAMILIES)
def test_families(declared, family):
    assert type_family(declared) == family


def test_family_column_agrees(spark):
    from pyspark.sql import functions as F

    from driftlens.functions.types import family

    rows = spark.createDataFrame([(d,) for d, _ in FAMILIES], "d string").select("d", family(F.col("d")).alias("f")).collect()
    assert [(r.d, r.f) for r in rows] == FAMILIES
