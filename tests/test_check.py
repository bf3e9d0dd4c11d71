import json

import pytest
from pyspark.sql import functions as F

from driftlens.functions.sqlshape import STAR_MARKS
from driftlens.operators import closure, rules
from driftlens.plans.check import STAR_FOUND_NOTHING, causal_graph, check, exit_code, load
from driftlens.plans.surface import as_of_join

BASE = {
    "stg": ("incremental", "sync_all_columns", "select id, amount, note from raw", []),
    "mid": ("view", None, "select * from s.stg", ["stg"]),
    "fct": ("incremental", "sync_all_columns", "select id, note from s.mid", ["mid"]),
    "hist": ("incremental", "sync_all_columns", "select * from s.mid", ["mid"]),
    "safe": ("table", None, "select id from s.mid -- note", ["mid"]),
}


def write(root, models, settings=None, **more):
    (root / "compiled/models").mkdir(parents=True)
    nodes, children = {}, {}
    for n, (mat, osc, sql, parents) in models.items():
        (root / f"compiled/models/{n}.sql").write_text(sql)
        config = {"materialized": mat, "on_schema_change": osc}
        nodes[f"model.p.{n}"] = {"name": n, "resource_type": "model", "package_name": "p", "alias": n, "config": config, "unrendered_config": {"on_schema_change": osc} if osc else {}, "columns": None} | (settings or {}).get(n, {})
        for p in parents:
            children.setdefault(f"model.p.{p}", []).append(f"model.p.{n}")
    manifest = {"metadata": {"project_name": "p", "adapter_type": "duckdb"}, "nodes": nodes, "child_map": children, "exposures": None}
    (root / "manifest.json").write_text(json.dumps(manifest | more))
    return str(root)


def test_dropped_column_reaches_readers(spark, tmp_path):
    now = BASE | {"stg": ("incremental", "sync_all_columns", "select id, amount from raw", [])}
    result = check(load(spark, write(tmp_path / "a", BASE)), load(spark, write(tmp_path / "b", now)))
    row = result.predictions.first()
    assert [(o.op, o.column) for o in row.operations] == [("DROP COLUMN", "note")]
    assert (row.name, row.own_safety, row.safety) == ("stg", 2, 2)
    found = {(r.affected, r.risk) for r in result.impacts.collect()}
    assert found == {("fct", "broken_ref"), ("hist", "inherited_drop")}  # a comment is no read
    assert {r.rule_code for r in result.findings.collect()} == {"ddl.drop_column", "cascade.broken_ref", "cascade.inherited_drop"}
    graph = causal_graph(load(spark, str(tmp_path / "a")), load(spark, str(tmp_path / "b")), result).collect()
    assert {(r.a, r.b) for r in graph if r.kind == "dependency"} == {("stg", "mid"), ("mid", "fct"), ("mid", "hist")}
    assert ("fct", "read", ["note"]) in [(r.b, r.kind, r.columns) for r in graph]
    codes = [exit_code(result, named).first().exit_code for named in ((), ("stg",), ("stg", "fct", "hist"))]
    assert codes == [1, 1, 0] and exit_code(result, fail_on="never").first().exit_code == 0


def test_unresolved_read_is_refused(spark, tmp_path):
    odd = {"odd": ("table", None, "select id from s.stg, lateral f(x) where (", ["stg"])}
    now = BASE | {"stg": ("incremental", "sync_all_columns", "select id, amount from raw", [])} | odd
    result = check(load(spark, write(tmp_path / "a", BASE | odd)), load(spark, write(tmp_path / "b", now)))
    told = [(r.resource, r.message) for r in result.refused.where("reason_code = 'read_unresolved'").collect()]
    assert [r for r, _ in told] == ["odd"] and told[0][1].endswith(" while checking stg; affected columns: note")
    codes = [exit_code(result, ("stg", "fct", "hist"), rule).first().exit_code for rule in (None, "warning", "destructive")]
    assert codes == [2, 2, 0]


def test_unchanged_project_is_quiet(spark, tmp_path):
    result = check(load(spark, write(tmp_path / "a", BASE)), load(spark, write(tmp_path / "b", BASE)))
    assert result.predictions.count() == result.impacts.count() == result.findings.count() == 0


def test_unreadable_statement_is_never_safe(spark, tmp_path):
    now = BASE | {"stg": ("incremental", "sync_all_columns", "select id, amount + 1 from raw", [])}
    result = check(load(spark, write(tmp_path / "a", BASE)), load(spark, write(tmp_path / "b", now)))
    assert result.predictions.first().safety >= rules.WARNING
    assert {r.reason_code for r in result.refused.collect()} == {"parse_failed"}


def test_removed_model_takes_all_its_columns(spark, tmp_path):
    now = {k: v for k, v in BASE.items() if k != "stg"}
    result = check(load(spark, write(tmp_path / "a", BASE)), load(spark, write(tmp_path / "b", now)))
    row = result.predictions.where("name = 'stg'").first()
    assert (row.status, row.safety) == ("removed", rules.DESTRUCTIVE)


def test_changed_settings(spark, tmp_path):
    now = BASE | {"mid": ("table", None, "select * from s.stg", ["stg"])}
    result = check(load(spark, write(tmp_path / "a", BASE)), load(spark, write(tmp_path / "b", now)))
    row = result.predictions.where("name = 'mid'").first()
    assert row.operations[0].op == "MATERIALIZATION CHANGED: view -> table" and row.safety == rules.WARNING


def ops(result, name):
    return [(o.op, o.column) for o in result.predictions.where(F.col("name") == name).first().operations]


def test_changed_casts_contracts_and_stars(spark, tmp_path):
    mark = "/* " + " ".join(STAR_MARKS) + " */"
    was = BASE | {
        "cast": ("incremental", "sync_all_columns", "select cast(a as int) as a, b::text as b, c from raw", []),
        "wide": ("view", None, "select cast(a as int) as a from raw", []),
        "star": ("incremental", "sync_all_columns", "select id from raw", []),
        "bound": ("table", None, "select * from s.stg", ["stg"]),
    }
    now = was | {
        "cast": ("incremental", "sync_all_columns", "select cast(a as bigint) as a, b, c::date as c from raw", []),
        "wide": ("view", None, "select cast(a as bigint) as a from raw", []),
        "star": ("incremental", "sync_all_columns", f"select * from raw {mark}", []),
        "stg": ("incremental", "sync_all_columns", "select id, amount from raw", []),
    }
    contract = {"bound": {"config": {"materialized": "table", "contract": {"enforced": True}}, "columns": {c: {"name": c, "data_type": None} for c in ("id", "amount", "note")}}}
    result = check(load(spark, write(tmp_path / "a", was, contract)), load(spark, write(tmp_path / "b", now, contract)))
    assert [(o, c) for o, c in ops(result, "cast")] == [("TYPE CHANGED: INT -> BIGINT", "a"), ("TYPE CHANGED: TEXT -> unknown", "b"), ("TYPE CHANGED: unknown -> DATE", "c")]
    assert result.predictions.where("name = 'cast'").first().own_safety == rules.WARNING
    assert ops(result, "wide") == [("CREATE OR REPLACE VIEW", None)]
    assert ops(result, "star")[0] == (STAR_FOUND_NOTHING, None)
    below = {(r.source, r.affected, r.reason, r.waiver_allowed) for r in result.impacts.where("risk = 'contract_violation'").collect()}
    assert below == {("stg", "bound", "CONTRACT VIOLATION: note missing in definition", True)}
    codes = {(r.rule_code, r.column) for r in result.findings.where("source = 'cast'").collect()}
    assert codes == {("ddl.unknown_operation", c) for c in "abc"}  # cannot be waived


def test_what_the_manifest_alone_changes(spark, tmp_path):
    settings = {
        "mid": {"database": "other"},
        "safe": {"config": {"materialized": "table", "tags": ["x"]}},
        "hist": {"columns": {"id": {"name": "id", "data_type": "int"}}},
        "fct": {"unrendered_config": {"on_schema_change": "sync_all_columns", "note": "1"}},
    }
    a, b = load(spark, write(tmp_path / "a", BASE)), load(spark, write(tmp_path / "b", BASE, settings))
    assert {r.name for r in check(a, b).predictions.collect()} == set(settings)
    chosen = check(a, b, select="mid+", ignore=["hist", "nobody"])
    assert {r.name for r in chosen.predictions.collect()} == {"mid", "safe", "fct"}
    assert [r.name for r in chosen.ignored.collect()] == ["hist"] and [r.name for r in chosen.unmatched.collect()] == ["nobody"]
    with pytest.raises(ValueError, match="no selection"):
        check(a, b, select="tag:x")


def test_links_that_only_comments_have(spark, tmp_path):
    rel = lambda n: f'"d"."s"."{n}"'
    body = f"select id from {rel('other')}"
    children = {
        "off": f"{body} -- join {rel('stg')}",
        "hidden": f"{body} -- depends_on: {rel('stg')}",
        "own": f"select lookup(id) as id from {rel('other')} -- join {rel('stg')}",
        "outside": f'select id from "d"."ext"."other" -- join {rel("stg")}',
        "hooked": f"{body} -- join {rel('stg')} (hook)",
        "stale": f"{body} -- join {rel('stg')} (stale)",
        "on": f"{body} join {rel('stg')} on true -- join {rel('stg')}",
    }
    was = {"stg": BASE["stg"], "other": ("table", None, "select 1 as id", [])} | {n: ("incremental", "fail", sql, ["stg", "other"]) for n, sql in children.items()}

    def settings(models):
        out = {}
        for n, (mat, osc, sql, parents) in models.items():
            config = {"materialized": mat, "on_schema_change": osc, "pre-hook": [{"sql": "x"}] if n == "hooked" else []}
            out[n] = {"config": config, "relation_name": rel(n), "compiled": True, "compiled_code": sql + (" " if n == "stale" else ""), "depends_on": {"nodes": [f"model.p.{p}" for p in parents]}}
        return out

    now = was | {"stg": ("incremental", "sync_all_columns", "select id, amount from raw", [])}
    a, b = (load(spark, write(tmp_path / k, m, settings(m))) for k, m in (("a", was), ("b", now)))
    failing = {r.affected for r in check(a, b).impacts.where("risk = 'build_failure'").collect()}
    assert failing == set(children) - {"off"}


def test_incomplete_and_doubled_files(spark, tmp_path):
    a, b = write(tmp_path / "a", BASE), write(tmp_path / "b", BASE)
    (tmp_path / "a/compiled/models/safe.sql").unlink()
    result = check(load(spark, a), load(spark, b))
    assert {(r.resource, r.reason_code) for r in result.refused.collect()} == {("safe", "baseline_missing")}
    (tmp_path / "b/compiled/models/more").mkdir()
    (tmp_path / "b/compiled/models/more/mid.sql").write_text("select 1 as id")
    with pytest.raises(ValueError, match="more than one file for mid"):
        check(load(spark, a), load(spark, b))


@pytest.mark.parametrize("sent", [0, 1000])
def test_closure_of_a_wide_graph(spark, sent):
    rows = [(f"l{i}_{a}", f"l{i + 1}_{b}") for i in range(12) for a in "xy" for b in "xy"]  # 2 ** 12 paths
    edges = spark.createDataFrame([*rows, ("l12_x", "l0_x")], "parent string, child string")
    out = closure.closure(edges, spark.createDataFrame([("l0_x",)], "root string"), sent)
    assert out.count() == len({n for r in rows for n in r}) - 2  # neither the root nor its twin, which nothing reaches
    assert closure.select_nodes(edges, edges.select(F.col("parent").alias("name"), F.col("parent").alias("node")), "l0_x, @bad") is None
    assert closure.shortest_path(edges, "l10_y", "l12_y") == ["l10_y", "l11_x", "l12_y"]


@pytest.mark.parametrize("strict", [False, True])
def test_as_of_join_ties(spark, strict):
    left = spark.createDataFrame([(1, "a", 5), (2, "a", 3), (3, None, 5), (4, "b", 9)], "id int, k string, t int")
    right = spark.createDataFrame([("a", 5, 50), ("a", 2, 20), ("a", None, 1), (None, 5, 7)], "k string, t int, v int")
    out = {r.id: r.asof_v for r in as_of_join(left, right, "k", "t", "v", strict).collect()}
    assert out == {1: 20 if strict else 50, 2: 20, 3: None, 4: None}
