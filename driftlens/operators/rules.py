"""The DDL rule table as one ordered chain of conditions, and its dimensions.

Safety is a rank: 0 safe, 1 warning, 2 destructive. An unresolved column list
is null, an unresolved star is the list ['*']; neither is ever taken for an
empty list.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SAFE, WARNING, DESTRUCTIVE = 0, 1, 2

#: Severity of a downstream risk; an unknown risk is a warning (fixed values).
RISKS = {
    "broken_ref": DESTRUCTIVE,
    "build_failure": WARNING,
    "unit_test_failure": WARNING,
    "unit_test_unreadable": WARNING,
    "inherited_drop": DESTRUCTIVE,
    "inherited_change": WARNING,
    "data_test_failure": WARNING,
    "data_test_unreadable": WARNING,
    "contract_violation": WARNING,
}

#: Operation texts that consumers match exactly, with their codes (fixed values).
IGNORED_REMOVAL = "BUILD FAILURE RISK: removed columns remain in the target under on_schema_change=ignore"
IGNORED_ADDITION = (
    "REVIEW REQUIRED: added columns are not written to the target under on_schema_change=ignore; downstream readers may fail"
)
OPERATION_CODES = {
    "MODEL REMOVED": "ddl.model_removed",
    "CREATE OR REPLACE TABLE": "ddl.replace_table",
    "CREATE OR REPLACE VIEW": "ddl.replace_view",
    "NO DDL": "ddl.no_ddl",
    "ADD COLUMN": "ddl.add_column",
    "DROP COLUMN": "ddl.drop_column",
    "BUILD FAILURE": "ddl.build_failure",
    "STALE COLUMNS (not populated)": "ddl.stale_columns",
    IGNORED_REMOVAL: "ddl.ignored_removal",
    IGNORED_ADDITION: "ddl.ignored_addition",
}
PREFIX_CODES = {
    "CONTRACT VIOLATION:": "ddl.contract_violation",
    "MATERIALIZATION CHANGED:": "ddl.materialization_changed",
    "on_schema_change CHANGED:": "ddl.schema_policy_changed",
    "RELATION CHANGED (": "ddl.relation_changed",
}
_OPS = "array<struct<op:string,column:string>>"


def operation_code(op: Column) -> Column:
    """The rule code of an operation text; null or empty text is the bare verdict."""
    out = F.lit("ddl.unknown_operation")
    out = F.when(op.startswith("UNKNOWN"), "ddl.unknown_configuration").otherwise(out)
    out = F.when(op.startswith("REVIEW REQUIRED"), "ddl.review_required").otherwise(out)
    for prefix, code in PREFIX_CODES.items():
        out = F.when(op.startswith(prefix), code).otherwise(out)
    for text, code in OPERATION_CODES.items():
        out = F.when(op == text, code).otherwise(out)
    return F.when(F.coalesce(op, F.lit("")) == "", "ddl.verdict").otherwise(out)


def known_operation(op: Column) -> Column:
    """Whether an operation is understood and so may be waived."""
    known = op.isin(*OPERATION_CODES)
    for prefix in PREFIX_CODES:
        known = known | op.startswith(prefix)
    return known


def risk_severity(risk: Column) -> Column:
    out = F.lit(WARNING)
    for name, rank in RISKS.items():
        out = F.when(risk == name, rank).otherwise(out)
    return out


def _ops(*texts: Column | str) -> Column:
    rows = [F.struct((F.lit(t) if isinstance(t, str) else t).alias("op"), F.lit(None).cast("string").alias("column")) for t in texts]
    return F.array(*rows).cast(_OPS) if rows else F.array().cast(_OPS)


def _each(text: str, columns: Column) -> Column:
    return F.transform(columns, lambda c: F.struct(F.lit(text).alias("op"), c.alias("column")))


def _unreadable(columns: Column) -> Column:
    return columns.isNull() | (F.size(columns) == 0) | F.get(columns, 0).startswith("*")


def column_diff(base: Column, current: Column) -> tuple[Column, Column]:
    """(added, removed), sorted; two empty lists where either side is not a list of names."""
    none = F.array().cast("array<string>")
    both = ~(_unreadable(base) | _unreadable(current))
    added = F.array_sort(F.array_except(current, base))
    removed = F.array_sort(F.array_except(base, current))
    return F.when(both, added).otherwise(none), F.when(both, removed).otherwise(none)


def predict(
    models: DataFrame,
    materialization: str = "materialization",
    on_schema_change: str = "on_schema_change",
    base: str = "base_columns",
    current: str = "current_columns",
    status: str = "status",
) -> DataFrame:
    """models plus operations (array of op, column), safety, added and removed; the first rule that matches decides.

    A null materialization counts as a table; a null status as modified.
    """
    mat = F.coalesce(F.col(materialization), F.lit("table"))
    raw, b, c = F.col(on_schema_change), F.col(base), F.col(current)
    state = F.coalesce(F.col(status), F.lit("modified"))
    osc = F.when(raw.isNull() | (raw == ""), "ignore").otherwise(raw)
    none, no_ops = F.array().cast("array<string>"), _ops()
    # A list that is known but empty takes part in the last rules only.
    plain_added, plain_removed = F.array_sort(F.array_except(c, b)), F.array_sort(F.array_except(b, c))
    loose_added, loose_removed = column_diff(b, c)
    starred = F.exists(F.concat(b, c), lambda x: x.startswith("*"))
    is_except = [(F.size(x) == 1) & F.get(x, 0).startswith("* except(") for x in (b, c)]
    star = [(F.size(x) == 1) & (F.get(x, 0) == "*") for x in (b, c)]
    repeated = (F.size(b) != F.size(F.array_distinct(b))) | (F.size(c) != F.size(F.array_distinct(c)))
    changed = (F.size(plain_added) > 0) | (F.size(plain_removed) > 0)
    lost = F.size(plain_removed) > 0
    add, drop = _each("ADD COLUMN", plain_added), _each("DROP COLUMN", plain_removed)
    loose = F.concat(_each("ADD COLUMN", loose_added), _each("DROP COLUMN", loose_removed))
    unmodelled = F.when(
        mat == "materialized_view",
        "REVIEW REQUIRED (materialized_view is driven by on_configuration_change, which is not modelled)",
    ).otherwise(F.concat(F.lit("UNKNOWN materialization: "), mat))
    ignored = (
        F.when(b.isNull() | c.isNull() | starred, "REVIEW REQUIRED: cannot determine incremental schema changes")
        .when(F.size(F.array_except(b, c)) > 0, IGNORED_REMOVAL)
        .when(F.size(F.array_except(c, b)) > 0, IGNORED_ADDITION)
        .otherwise("NO DDL")
    )
    except_text = (
        F.when(is_except[0] & is_except[1] & (F.get(b, 0) == F.get(c, 0)), "REVIEW REQUIRED (SELECT * EXCEPT — same exclusions)")
        .when(is_except[0] & is_except[1], "REVIEW REQUIRED (SELECT * EXCEPT — exclusions changed)")
        .otherwise("REVIEW REQUIRED (SELECT * EXCEPT — column removal likely)")
    )
    #: (condition, operations, safety, added, removed)
    rules: list[tuple[Column, Column, Column | int, Column, Column]] = [
        ((state == "removed") & (mat == "ephemeral"), no_ops, SAFE, none, none),
        (state == "removed", _ops("MODEL REMOVED"), DESTRUCTIVE, none, none),
        (mat == "table", _ops("CREATE OR REPLACE TABLE"), SAFE, none, none),
        (mat == "view", _ops("CREATE OR REPLACE VIEW"), SAFE, none, none),
        (mat == "ephemeral", no_ops, SAFE, none, none),
        (mat == "snapshot", F.concat(_ops("REVIEW REQUIRED (snapshot)"), loose), WARNING, loose_added, loose_removed),
        ((mat != "incremental") & raw.isNull(), F.concat(_ops(unmodelled), loose), WARNING, loose_added, loose_removed),
        ((osc == "ignore") & (state != "added"), _ops(ignored), F.when(ignored == "NO DDL", SAFE).otherwise(WARNING), none, none),
        (osc == "ignore", _ops("NO DDL"), SAFE, none, none),
        (state == "added", no_ops, SAFE, none, none),
        (b.isNull() | c.isNull(), _ops("REVIEW REQUIRED"), WARNING, none, none),
        (star[0] | star[1], _ops("REVIEW REQUIRED (SELECT *)"), WARNING, none, none),
        (is_except[0] | is_except[1], _ops(except_text), WARNING, none, none),
        (repeated, _ops("REVIEW REQUIRED (duplicate column names)"), WARNING, none, none),
        ((osc == "fail") & changed, _ops("BUILD FAILURE"), WARNING, plain_added, plain_removed),
        (osc == "fail", no_ops, SAFE, none, none),
        (
            osc == "append_new_columns",
            F.concat(add, F.when(lost, _ops("STALE COLUMNS (not populated)")).otherwise(no_ops)),
            F.when(lost, WARNING).otherwise(SAFE),
            plain_added,
            plain_removed,
        ),
        (osc == "sync_all_columns", F.concat(add, drop), F.when(lost, DESTRUCTIVE).otherwise(SAFE), plain_added, plain_removed),
    ]
    out = F.struct(
        _ops(F.concat(F.lit("UNKNOWN on_schema_change: "), osc)).alias("operations"), F.lit(WARNING).alias("safety"), none.alias("added"), none.alias("removed")
    )
    for condition, operations, safety, added, removed in reversed(rules):
        rank = F.lit(safety) if isinstance(safety, int) else safety
        row = F.struct(operations.cast(_OPS).alias("operations"), rank.alias("safety"), added.alias("added"), removed.alias("removed"))
        out = F.when(condition, row).otherwise(out)
    return models.select("*", out.alias("__p")).select(*models.columns, "__p.operations", "__p.safety", "__p.added", "__p.removed")


def has_rule(pairs: DataFrame) -> DataFrame:
    """pairs(materialization, on_schema_change) plus has_rule: whether a lost column gets more than a review."""
    probe = pairs.withColumns(
        {"base_columns": F.array(F.lit("a"), F.lit("b")), "current_columns": F.array(F.lit("a")), "status": F.lit("modified")}
    )
    vague = F.exists("operations", lambda o: o["op"].startswith("REVIEW REQUIRED") | o["op"].startswith("UNKNOWN"))
    return predict(probe).select(*pairs.columns, (~vague).alias("has_rule"))


def apply_contract(predictions: DataFrame, spark: SparkSession | None = None) -> DataFrame:
    """Puts contract violations before the operations and raises safe to warning.

    Needs contract_enforced, declared (map of lower-case column to declared type),
    current_columns and casts (map of column to explicit cast type).
    """
    from driftlens.functions.types import family

    declared, produced = F.map_keys("declared"), F.transform("current_columns", lambda c: F.lower(c))
    wanted = F.col("contract_enforced") & (F.coalesce(F.col("materialization"), F.lit("")) != "ephemeral") & (F.size(declared) > 0)
    unreadable = F.col("current_columns").isNull() | ((F.size("current_columns") == 1) & F.get("current_columns", 0).rlike(r"^\*$|^\* except\("))
    text = F.lit("CONTRACT VIOLATION: ")
    one = F.transform(F.array_sort(F.array_except(declared, produced)), lambda c: F.concat(text, c, F.lit(" missing in definition")))
    two = F.transform(F.array_sort(F.array_except(F.array_distinct(produced), declared)), lambda c: F.concat(text, c, F.lit(" missing in contract")))
    typed = F.filter(F.array_sort(declared), lambda c: family(F.col("declared")[c]) != family(F.col("casts")[c]))
    three = F.transform(
        typed, lambda c: F.concat(text, c, F.lit(" declared "), F.col("declared")[c], F.lit(", cast as "), F.col("casts")[c], F.lit(" -- data type mismatch"))
    )
    review = F.array(F.lit("REVIEW REQUIRED (contract enforced, but the columns this SQL produces could not be read)"))
    found = F.when(~F.coalesce(wanted, F.lit(False)), F.array().cast("array<string>")).when(unreadable, review).otherwise(F.concat(one, two, three))
    rows = predictions.withColumn("__v", found)
    ops = F.concat(F.transform("__v", lambda v: F.struct(v.alias("op"), F.lit(None).cast("string").alias("column"))), F.col("operations"))
    return rows.withColumns({"operations": ops, "safety": F.when(F.size("__v") > 0, F.greatest("safety", F.lit(WARNING))).otherwise(F.col("safety"))}).drop("__v")
