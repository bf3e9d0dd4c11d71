import pytest

from driftlens.functions.dialect import Versioned, to_spark

CASES = [
    ("snowflake", "SELECT * EXCLUDE a FROM t", "SELECT * EXCEPT (a) FROM t"),
    ("duckdb", 'SELECT t.* EXCLUDE ("a b", c) FROM t', 'SELECT t.* EXCEPT ("a b", c) FROM t'),
    ("duckdb", "SELECT '* EXCLUDE a' -- * EXCLUDE b\nFROM t", "SELECT '* EXCLUDE a' -- * EXCLUDE b\nFROM t"),
    ("snowflake", "SELECT f.value FROM t, LATERAL FLATTEN(input => split(x, ',)')) AS f", "SELECT f.value FROM t LATERAL VIEW posexplode(split(x, ',)')) f AS index, value"),
    ("snowflake", "SELECT 1 FROM t, LATERAL FLATTEN(x, OUTER => true) f", "SELECT 1 FROM t LATERAL VIEW OUTER posexplode(x) f AS index, value"),
    ("clickhouse", "SELECT x FROM t LEFT ARRAY JOIN xs AS x", "SELECT x FROM t LATERAL VIEW OUTER explode(xs) x_rows AS x"),
    ("mysql", "SELECT SQL_NO_CACHE a FROM t IGNORE KEY (k) WHERE b = 'STRAIGHT_JOIN'", "SELECT a FROM t  WHERE b = 'STRAIGHT_JOIN'"),
]


@pytest.mark.parametrize("dialect, sql, want", CASES)
def test_rewrites(dialect, sql, want):
    assert to_spark(sql, dialect) == want


def test_final_needs_the_keys():
    with pytest.raises(ValueError, match="keys of t"):
        to_spark("SELECT * FROM t FINAL", "clickhouse")
    out = to_spark("SELECT * FROM a.t FINAL WHERE x", "clickhouse", {"a.t": Versioned(("k", "l"), "v")})
    assert "PARTITION BY k, l ORDER BY v DESC" in out and out.endswith("AS t WHERE x")


def test_flatten_needs_an_alias():
    with pytest.raises(ValueError, match="alias"):
        to_spark("SELECT 1 FROM t, LATERAL FLATTEN(x)", "snowflake")
