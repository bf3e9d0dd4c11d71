"""Reports of a finished check: the full JSON, and text and markdown in order of severity."""

from __future__ import annotations

import json
from typing import Any

from driftlens.operators.report import LABELS, UNREADABLE
from driftlens.operators.rules import RISKS
from driftlens.plans.check import Result

MOST_IMPACTS, MOST_NAMES = 10, 5


def collect(result: Result, acknowledged: tuple[str, ...] = (), analysis: dict[str, Any] | None = None) -> dict[str, Any]:
    """The report as plain data. It is as large as the project's own metadata, which the driver holds."""
    impacts: dict[str, list[dict[str, Any]]] = {}
    for r in result.impacts.orderBy("source", "affected", "risk", "reason").collect():
        impacts.setdefault(r.source, []).append({"model_name": r.affected, "risk": r.risk, "reason": r.reason})
    outside = {r.source: list(r.exposures) for r in result.exposures.collect()}
    models = []
    for p in result.predictions.orderBy("name").collect():
        model = {
            "model_name": p.name,
            "materialization": p.materialization,
            "on_schema_change": p.on_schema_change,
            "safety": LABELS[p.safety],
            "own_safety": LABELS[p.own_safety],
            "operations": [{"operation": o.op, "column": o.column} for o in p.operations],
            "columns_added": list(p.added),
            "columns_removed": list(p.removed),
            "acknowledged": p.name in acknowledged,
        }
        models.append(model | ({"downstream_impacts": impacts[p.name]} if p.name in impacts else {}) | ({"downstream_exposures": outside[p.name]} if p.name in outside else {}))
    summary = {"total": len(models)} | {n: sum(m["safety"] == n for m in models) for n in LABELS}
    if n := sum(m["acknowledged"] for m in models):
        summary["acknowledged"] = n
    if n := sum(map(len, impacts.values())):
        summary["cascade_risks"] = n
    refused = sorted((r.reason_code, r.resource) for r in result.refused.collect())
    out = {
        "summary": summary,
        "models": models,
        "parse_failures": [x for code, x in refused if code == "parse_failed"],
        "uncompiled_models": [x for code, x in refused if code == "missing_compiled_sql"],
        "findings": [r.asDict(recursive=True) for r in result.findings.collect()],
    }
    return out | ({"analysis": analysis} if analysis else {})


def review(report: dict[str, Any]) -> str:
    """The worst of everything reported, before any waiver; what was not examined is at least a warning."""
    ranks = [LABELS.index(m["safety"]) for m in report["models"]] + [LABELS.index(f["severity"]) for f in report["findings"]]
    if report["parse_failures"] or report["uncompiled_models"]:
        ranks.append(1)
    return LABELS[max(ranks, default=0)]


def summary_line(report: dict[str, Any], name: str = "driftlens") -> str:
    s = report["summary"]
    line = f"{name}: {s['total']} checked, " + ", ".join(f"{s[n]} {n}" for n in LABELS)
    line += f" ({s['acknowledged']} acknowledged)" if "acknowledged" in s else ""
    line += f", {s['cascade_risks']} cascade risk(s)" if "cascade_risks" in s else ""
    label = review(report)
    return f"{line}; overall review: {'NO REPORTED RISKS' if label == 'safe' else label.upper()} (before policy)"


def _shown(model: dict[str, Any]) -> tuple[list[dict[str, Any]], int]:
    found = sorted(model.get("downstream_impacts", []), key=lambda i: -RISKS.get(i["risk"], 1))
    return found[:MOST_IMPACTS], max(0, len(found) - MOST_IMPACTS)


def _names(names: list[str]) -> str:
    more = len(names) - MOST_NAMES
    return ", ".join(names[:MOST_NAMES]) + (f" (+{more} more)" if more > 0 else "")


def _lines(report: dict[str, Any], mark: dict[str, str]) -> list[str]:
    out = []
    for m in sorted(report["models"], key=lambda m: -LABELS.index(m["safety"])):
        about = m["materialization"] + (f", {m['on_schema_change']}" if m["on_schema_change"] else "")
        out.append(mark["model"].format(m["safety"].upper(), m["model_name"], about))
        out += [mark["item"].format(" ".join(x for x in (o["operation"], o["column"]) if x)) for o in m["operations"]]
        shown, more = _shown(m)
        out += [mark["impact"].format(i["risk"].upper(), i["model_name"], i["reason"]) for i in shown]
        out += [mark["item"].format(f"... and {more} more in the JSON report")] if more else []
        out += [mark["item"].format(f"consumers: {_names(m['downstream_exposures'])}")] if "downstream_exposures" in m else []
        out.append("")
    for key, text in (("parse_failures", "columns cannot be read, review by hand"), ("uncompiled_models", "the compile is incomplete, no SQL for")):
        if report[key]:
            out.append(mark["warning"].format(f"{text}: {', '.join(report[key])}"))
    return out


def as_text(report: dict[str, Any]) -> str:
    if not report["models"]:
        return "no model changes detected\n\n" + summary_line(report)
    mark = {"model": "{}  {} ({})", "item": "  {}", "impact": "  >> {}  {}: {}", "warning": "WARNING: {}"}
    return "\n".join([f"{len(report['models'])} model(s) changed", "", *_lines(report, mark), summary_line(report)])


def as_markdown(report: dict[str, Any]) -> str:
    mark = {"model": "### {} `{}` ({})", "item": "- {}", "impact": "- **{}** `{}`: {}", "warning": "> {}"}
    return "\n".join([f"## {len(report['models'])} model(s) changed", "", *_lines(report, mark), f"`{summary_line(report)}`"])


def as_json(report: dict[str, Any]) -> str:
    return json.dumps(report, indent=2, default=str)


def problems(report: Any) -> list[str]:
    """What is wrong with a report that was read back: types, counts, references. An empty list is a valid one."""
    if not isinstance(report, dict) or not isinstance(report.get("summary"), dict) or not isinstance(report.get("models"), list):
        return ["no report"]
    out = []
    s, models = report["summary"], report["models"]
    for m in models:
        if not isinstance(m, dict) or not isinstance(m.get("model_name"), str) or m.get("safety") not in LABELS or not isinstance(m.get("operations"), list):
            return [*out, "a model without name, safety or operations"]
    if s.get("total") != len(models):
        out.append("summary.total")
    out += [f"summary.{n}" for n in LABELS if s.get(n) != sum(m["safety"] == n for m in models)]
    if s.get("cascade_risks", 0) != sum(len(m.get("downstream_impacts", [])) for m in models):
        out.append("summary.cascade_risks")
    for f in report.get("findings", []):
        if not isinstance(f, dict) or f.get("severity") not in LABELS or not isinstance(f.get("rule_code"), str):
            out.append("a finding without severity or rule")
        elif f["severity"] == "safe" and (f.get("uncertainty") or f.get("state") != "exact"):
            out.append("a safe finding that is uncertain")
        elif f.get("waiver_allowed") and f["rule_code"].removeprefix("cascade.") in UNREADABLE:
            out.append("a waiver of what could not be read")
    out += [f"{k} is no list of names" for k in ("parse_failures", "uncompiled_models") if not (isinstance(report.get(k), list) and all(isinstance(x, str) for x in report[k]))]
    return out


def verdict(report: Any) -> dict[str, Any]:
    """What a service may answer: a verdict raised by raw severity, what was refused, or an error; never safe for a malformed report."""
    found = problems(report)
    if found:
        return {"error": "; ".join(found)}
    refused = [{"kind": k, "resource": x} for k in ("parse_failures", "uncompiled_models") for x in report[k]]
    return {"verdict": review(report), "refusals": refused, "summary": report["summary"]}
