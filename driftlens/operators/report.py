"""Facts, policy, counts and truncation over predictions and impacts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftlens.operators.rules import DESTRUCTIVE, RISKS, SAFE, WARNING, known_operation, operation_code, risk_severity

LABELS = ("safe", "warning", "destructive")
UNREADABLE = ("data_test_unreadable", "unit_test_unreadable")
#: Rules that follow from the resource or its settings alone.
EXACT_CODES = (
    "ddl.replace_table",
    "ddl.replace_view",
    "ddl.model_removed",
    "ddl.materialization_changed",
    "ddl.schema_policy_changed",
    "ddl.relation_changed",
)
UNCERTAIN_CODES = ("ddl.review_required", "ddl.unknown_configuration", "ddl.unknown_operation")


def label(rank: Column) -> Column:
    return F.get(F.array(*map(F.lit, LABELS)), rank)


def resolve(names: DataFrame, aliases: DataFrame) -> DataFrame:
    """names(name) with unique_id, null unless aliases(name, unique_id) has exactly one, and how many there are."""
    ids = aliases.groupBy("name").agg(F.collect_set("unique_id").alias("ids"))
    out = names.join(ids, "name", "left").withColumn("candidates", F.coalesce(F.size("ids"), F.lit(0)))
    return out.withColumn("unique_id", F.when(F.col("candidates") == 1, F.get("ids", 0))).drop("ids")


def ambiguous(aliases: DataFrame) -> DataFrame:
    """Names that stand for more than one resource."""
    return aliases.groupBy("name").agg(F.count_distinct("unique_id").alias("n")).where("n > 1").select("name")


def facts(predictions: DataFrame, impacts: DataFrame, refusals: DataFrame, aliases: DataFrame) -> DataFrame:
    """One row for each operation, impact and refusal, in their canonical order; equal rows stay apart.

    predictions(name, materialization, own_safety, operations), impacts(source,
    affected, risk, reason, waiver_allowed), refusals(resource, reason_code,
    message). Uncertainty lifts safe to warning and forbids waivers.
    """
    bare = F.array(F.struct(F.lit("").alias("op"), F.lit(None).cast("string").alias("column")))
    ops = predictions.withColumn("allowed", F.forall("operations", lambda o: known_operation(o["op"])) & ((F.size("operations") > 0) | (F.col("own_safety") == SAFE)))
    ops = ops.select("name", "materialization", "own_safety", "allowed", F.explode(F.when(F.size("operations") > 0, F.col("operations")).otherwise(bare)).alias("o"))
    code = operation_code(F.col("o.op"))
    exact = code.isin(*EXACT_CODES) | ((code == "ddl.verdict") & (F.col("materialization") == "ephemeral"))
    unsure = code.isin(*UNCERTAIN_CODES)
    one = ops.select(
        code.alias("rule_code"),
        F.col("name").alias("source"),
        F.col("name").alias("affected"),
        F.col("o.column").alias("column"),
        F.col("own_safety").alias("rank"),
        F.when(F.col("o.op") == "", label(F.col("own_safety"))).otherwise(F.col("o.op")).alias("message"),
        F.lit("prediction").alias("origin"),
        F.when(unsure, "unknown").when(exact, "exact").otherwise("conservative").alias("state"),
        F.when(unsure, "unresolved_prediction").when(exact, "ddl_rule").otherwise("provenance_unavailable").alias("reason_code"),
        F.col("allowed"),
    )
    known_risk = F.col("risk").isin(*RISKS)
    two = impacts.select(
        F.when(known_risk, F.concat(F.lit("cascade."), "risk")).otherwise("cascade.unknown_risk").alias("rule_code"),
        "source",
        "affected",
        F.lit(None).cast("string").alias("column"),
        risk_severity(F.col("risk")).alias("rank"),
        F.col("reason").alias("message"),
        F.lit("legacy_cascade").alias("origin"),
        F.lit("unknown").alias("state"),
        F.lit("provenance_unavailable").alias("reason_code"),
        (F.col("waiver_allowed") & ~F.col("risk").isin(*UNREADABLE)).alias("allowed"),
    )
    three = refusals.select(
        F.lit("input.refusal").alias("rule_code"),
        F.col("resource").alias("source"),
        F.col("resource").alias("affected"),
        F.lit(None).cast("string").alias("column"),
        F.lit(WARNING).alias("rank"),
        "message",
        F.lit("input").alias("origin"),
        F.lit("unknown").alias("state"),
        "reason_code",
        F.lit(False).alias("allowed"),
    )
    rows = one.unionByName(two).unionByName(three)
    ids = resolve(aliases.select("name").distinct(), aliases)
    for side in ("source", "affected"):
        own = ids.select(F.col("name").alias(side), F.col("unique_id").alias(f"{side}_id"), F.col("candidates").alias(f"{side}_n"))
        rows = rows.join(own, side, "left")
    reasons = [
        *(
            F.when(F.col(s).isNotNull() & F.col(f"{s}_id").isNull(), F.when(F.col(f"{s}_n") > 1, "ambiguous_resource").otherwise("unresolved_resource"))
            for s in ("source", "affected")
        ),
        F.when(F.col("state") != "exact", F.col("reason_code")),
        F.when(F.col("rule_code").isin("ddl.unknown_operation", "cascade.unknown_risk"), "unknown_rule"),
        F.when(F.col("rule_code").isin("ddl.review_required", "ddl.unknown_configuration"), "unresolved_prediction"),
        F.when(F.col("rule_code").isin(*(f"cascade.{r}" for r in UNREADABLE)), "unresolved_input"),
    ]
    doubt = F.array_sort(F.array_distinct(F.array_compact(F.array(*reasons))))
    rows = rows.withColumn("uncertainty", doubt).withColumns(
        {
            "severity": label(F.when((F.size("uncertainty") > 0) & (F.col("rank") == SAFE), WARNING).otherwise(F.col("rank"))),
            "waiver_allowed": F.col("allowed") & (F.size("uncertainty") == 0),
        }
    )
    rows = rows.drop("rank", "allowed", "source_n", "affected_n")
    return rows.orderBy(F.to_json(F.struct(*sorted(rows.columns))))


def unwaived(predictions: DataFrame, impacts: DataFrame, acknowledged: DataFrame, unclear: DataFrame) -> DataFrame:
    """(rank) of every own verdict and impact that no acknowledgement waives; acknowledged(name), unclear(name)."""
    may = acknowledged.select("name").distinct().join(unclear.select("name"), "name", "left_anti").withColumn("ok", F.lit(True))
    own = predictions.join(may, "name", "left")
    understood = F.forall("operations", lambda o: known_operation(o["op"])) & ((F.size("operations") > 0) | (F.col("own_safety") == SAFE))
    one = own.where(~(F.coalesce("ok", F.lit(False)) & understood)).select(F.col("own_safety").alias("rank"))
    two = impacts.join(may.withColumnRenamed("name", "affected"), "affected", "left")
    plain = F.col("risk").isin(*RISKS) & ~F.col("risk").isin(*UNREADABLE) & F.col("waiver_allowed")
    return one.unionByName(two.where(~(F.coalesce("ok", F.lit(False)) & plain)).select(risk_severity(F.col("risk")).alias("rank")))


def exit_code(worst: Column, refused: Column, fail_on: Column, warning_code: Column) -> Column:
    """1 for an unwaived destructive finding, the warning code for a warning or anything not examined, else 0."""
    code = F.when(fail_on == "destructive", 0).when((fail_on == "warning") & (warning_code == 0), 2).otherwise(warning_code)
    return F.when(fail_on == "never", 0).when(worst >= DESTRUCTIVE, 1).when((worst >= WARNING) | refused, code).otherwise(0)


def top_impacts(impacts: DataFrame, seq: str = "seq", k: int = 10) -> DataFrame:
    """The k worst impacts of each source, ties in their order, and how many more there are."""
    w = Window.partitionBy("source")
    rank = F.row_number().over(w.orderBy(F.desc(risk_severity(F.col("risk"))), seq))
    rows = impacts.withColumns({"place": rank, "hidden": F.greatest(F.count("*").over(w) - k, F.lit(0))})
    return rows.where(F.col("place") <= k)


def short_list(names: Column, k: int = 5) -> Column:
    """The first k names and how many more there are, as text."""
    more = F.size(names) - k
    return F.concat(F.array_join(F.slice(names, 1, k), ", "), F.when(more > 0, F.concat(F.lit(" (+"), more.cast("string"), F.lit(" more)"))).otherwise(""))


def short_labels(rows: DataFrame, name: str = "name") -> DataFrame:
    """rows with label: the last part of a dotted name, or all of it where two names share that part."""
    last = F.element_at(F.split(F.col(name), r"\."), -1)
    clash = rows.groupBy(last.alias("__last")).agg(F.count_distinct(name).alias("__n"))
    return rows.withColumn("__last", last).join(clash, "__last").withColumn("label", F.when(F.col("__n") > 1, F.col(name)).otherwise(F.col("__last"))).drop("__last", "__n")


def summary(predictions: DataFrame) -> DataFrame:
    """One row of counts by verdict."""
    return predictions.agg(
        F.count("*").alias("total"), *(F.count_if(F.col("safety") == i).alias(n) for i, n in enumerate(LABELS))
    )


def stats(models: DataFrame) -> DataFrame:
    """(what, value, n) counts of models(materialization, on_schema_change, star) and the whole-number share of stars."""
    by_mat = models.groupBy(F.coalesce("materialization", F.lit("table")).alias("value")).agg(F.count("*").alias("n")).withColumn("what", F.lit("materialization"))
    by_osc = (
        models.where("materialization = 'incremental'")
        .groupBy(F.coalesce("on_schema_change", F.lit("ignore")).alias("value"))
        .agg(F.count("*").alias("n"))
        .withColumn("what", F.lit("on_schema_change"))
    )
    stars = models.agg((F.expr("count_if(star) * 100 div greatest(count(*), 1)")).alias("n")).select(F.lit("percent").alias("value"), "n", F.lit("star").alias("what"))
    return by_mat.unionByName(by_osc).unionByName(stars).select("what", "value", "n")
