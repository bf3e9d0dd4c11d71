import json

import pytest

from driftlens.operators import evidence
from driftlens.plans import render
from driftlens.sources import config, snapshot


def test_config_file_environment_and_caller(tmp_path):
    (tmp_path / config.FILE).write_text(
        "﻿# settings\nignore_models:\n  - a  # one\n  - 'b # two'\nacknowledge_models: [x, \"y\"]\nwarning_exit_code: 5\nformat: yaml\nno_color: yes\nwhat: 1\nnonsense\ndialect: duckdb\n"
    )
    found = config.load(tmp_path, {"DRIFTLENS_FORMAT": "json", "DRIFTLENS_VERBOSE": "maybe"}, fail_on="never")
    assert (found.ignore_models, found.acknowledge_models) == (("a", "b # two"), ("x", "y"))
    assert (found.warning_exit_code, found.format, found.no_color, found.dialect, found.fail_on) == (5, "json", True, "duckdb", "never")
    assert [w.rsplit(" ", 1)[-1] for w in found.warnings] == ["format", "what", "setting", "verbose"]
    assert config.load(tmp_path / "none", {}) == config.Config()


@pytest.mark.parametrize("text", ["fail_on: sometimes", "warning_exit_code: 3"])
def test_config_errors(tmp_path, text):
    (tmp_path / config.FILE).write_text(text)
    with pytest.raises(config.ConfigError):
        config.load(tmp_path, {})


def project(root, name="p"):
    (root / f"target/compiled/{name}/models").mkdir(parents=True)
    (root / f"target/compiled/{name}/models/a.sql").write_text("select 1 as a")
    (root / "target/manifest.json").write_text(json.dumps({"metadata": {"project_name": "p"}}))


def test_snapshot_is_published_and_verified(tmp_path):
    project(tmp_path)
    target = tmp_path / "base"
    snapshot.take(tmp_path, target)
    assert snapshot.verify(target) == "verified"
    (target / "compiled/models/a.sql").write_text("select 2 as a")
    with pytest.raises(snapshot.SnapshotError, match="changed"):
        snapshot.verify(target)
    snapshot.take(tmp_path, target)
    (target / "more.sql").write_text("")
    with pytest.raises(snapshot.SnapshotError, match="added or removed"):
        snapshot.verify(target)
    (target / snapshot.INVENTORY).unlink()
    assert snapshot.verify(target) == "unrecorded"


def test_failed_snapshot_leaves_the_old_one(tmp_path):
    project(tmp_path)
    target = tmp_path / "base"
    snapshot.take(tmp_path, target)
    with pytest.raises(RuntimeError), snapshot.staged(target) as stage:
        (stage / "half").write_text("")
        raise RuntimeError
    assert snapshot.verify(target) == "verified" and [p.name for p in tmp_path.iterdir() if p.name.startswith(".")] == []
    (tmp_path / "target/compiled/q").mkdir()
    assert snapshot.compiled_folder(tmp_path / "target/compiled", tmp_path / "target/manifest.json").name == "p"
    (tmp_path / "target/manifest.json").write_text("{")
    with pytest.raises(snapshot.SnapshotError, match="several"):
        snapshot.compiled_folder(tmp_path / "target/compiled", tmp_path / "target/manifest.json")


@pytest.mark.parametrize("path", ["../a", "/a", "a\\b", "a/../b", "", None, "c:/x", "a//b"])
def test_paths_that_are_refused(path):
    with pytest.raises(snapshot.SnapshotError):
        snapshot.canonical(path)


def report():
    impacts = [{"model_name": f"m{i}", "risk": "broken_ref" if i == 11 else "build_failure", "reason": "r"} for i in range(12)]
    model = {"model_name": "a", "materialization": "incremental", "on_schema_change": "fail", "safety": "destructive", "own_safety": "warning", "acknowledged": False,
             "operations": [{"operation": "BUILD FAILURE", "column": None}], "downstream_impacts": impacts, "downstream_exposures": list("abcdefg")}
    return {"summary": {"total": 1, "safe": 0, "warning": 0, "destructive": 1, "cascade_risks": 12}, "models": [model], "parse_failures": ["b"], "uncompiled_models": [], "findings": []}


def test_reports():
    r = report()
    text = render.as_text(r)
    assert text.index("BROKEN_REF") < text.index("BUILD_FAILURE  m0") and "... and 2 more" in text and "a, b, c, d, e (+2 more)" in text
    assert text.splitlines()[-1] == "driftlens: 1 checked, 0 safe, 0 warning, 1 destructive, 12 cascade risk(s); overall review: DESTRUCTIVE (before policy)"
    assert "### DESTRUCTIVE `a` (incremental, fail)" in render.as_markdown(r) and json.loads(render.as_json(r)) == r
    assert render.problems(r) == [] and render.verdict(r)["refusals"] == [{"kind": "parse_failures", "resource": "b"}]


def test_malformed_reports_are_errors():
    assert "error" in render.verdict(None) and "error" in render.verdict({"summary": {}, "models": [1]})
    r = report()
    r["summary"]["safe"] = 1
    assert render.problems(r) == ["summary.safe"]
    r = report()
    r["findings"] = [{"severity": "safe", "rule_code": "ddl.verdict", "uncertainty": ["x"], "state": "exact"}]
    assert render.problems(r) == ["a safe finding that is uncertain"]


def test_evidence(spark):
    pairs = spark.createDataFrame(
        [("s", "r1", ["a"], ["a", "B"], None, True, []), ("s", "r2", ["a"], ["c"], None, False, []), ("s", "r3", ["a"], None, ["a"], True, ["s"]), ("s", "r4", ["a"], None, [], True, ["m", "s"])],
        "source string, reader string, removed array<string>, reads array<string>, text_matches array<string>, dependency boolean, unresolved array<string>",
    )
    edges, counted = evidence.read_edges(pairs)
    assert {(r.b, r.kind, r.state) for r in edges.collect()} == {("r1", "read", "exact"), ("r3", "read", "conservative"), ("r4", "read_check", "conservative")}
    assert [(r.source, r.n) for r in counted.collect()] == [("s", 1)]
    links = spark.createDataFrame([("s", "r1"), ("r1", "e"), ("x", "y")], "parent string, child string")
    found = spark.createDataFrame([("s", "s"), ("s", "e")], "source string, affected string")
    out = evidence.graph(edges, links.where("child <> 'e'"), links, found, spark.createDataFrame([("e",)], "node string")).where("kind IN ('dependency', 'declared_consumer')")
    assert {(r.a, r.b, r.kind, tuple(r.revisions)) for r in out.collect()} == {("s", "r1", "dependency", ("base", "current")), ("r1", "e", "declared_consumer", ("current",))}
    assert evidence.dangling(edges, spark.createDataFrame([("s",), ("r1",), ("r3",)], "node string")).count() == 1
    told = lambda *f: [r.resource for r in evidence.unresolved_reads(pairs, spark.createDataFrame([*f], "source string, affected string, rule_code string, severity string")).orderBy("resource").collect()]
    assert told(("s", "r1", "cascade.broken_ref", "destructive"), ("other", "r3", "cascade.broken_ref", "destructive"), ("r4", "r4", "ddl.x", "safe")) == ["r3", "r4"]
    assert told(("s", "r3", "cascade.broken_ref", "destructive"), ("r4", "r4", "input.refusal", "warning")) == []
