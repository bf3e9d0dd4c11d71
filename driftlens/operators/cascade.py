"""What a change breaks downstream, as joins keyed by the changed model.

Unresolved facts stay rows: a reader whose columns are unknown is searched by
text, a test that cannot be read is reported as unreadable.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftlens.operators.rules import DESTRUCTIVE, SAFE, column_diff, known_operation, predict, risk_severity

#: (source, affected, risk, reason, waiver_allowed)
IMPACT = ["source", "affected", "risk", "reason", "waiver_allowed"]


def _names_it(sql: Column, column: Column) -> Column:
    return F.rlike(sql, F.concat(F.lit(r"(?i)\b\Q"), column, F.lit(r"\E\b")))


def changed_columns(models: DataFrame) -> DataFrame:
    """(source, removed, added) of models(name, base_columns, current_columns, status, added, removed) that change any.

    A removed model loses all its base columns; else the rule's own lists count,
    and where they are empty the difference of two known lists.
    """
    added, removed = column_diff(F.col("base_columns"), F.col("current_columns"))
    gone = F.col("current_columns").isNull() & F.col("base_columns").isNotNull() & (F.col("base_columns") != F.array(F.lit("*")))
    own = (F.size("removed") > 0) | (F.size("added") > 0)
    rows = models.select(
        F.col("name").alias("source"),
        F.when(gone, F.col("base_columns")).when(own, F.col("removed")).otherwise(removed).alias("removed"),
        F.when(own, F.col("added")).otherwise(added).alias("added"),
    )
    return rows.where("size(removed) > 0 OR size(added) > 0")


def quiet(models: DataFrame) -> Column:
    """Incremental models that ignore schema changes alter nothing physical, so only their own tests count."""
    return (F.col("materialization") == "incremental") & (F.coalesce("on_schema_change", F.lit("ignore")) == "ignore")


def build_failures(changes: DataFrame, reach: DataFrame, nodes: DataFrame) -> DataFrame:
    """Downstream incremental models that fail on any schema change; reach(source, affected), nodes(name, materialization, on_schema_change)."""
    rows = reach.join(changes.select("source"), "source", "left_semi").join(nodes.withColumnRenamed("name", "affected"), "affected")
    rows = rows.where("materialization = 'incremental' AND on_schema_change = 'fail'")
    reason = F.lit("upstream schema changed, on_schema_change=fail")
    return rows.select("source", "affected", F.lit("build_failure").alias("risk"), reason.alias("reason"), F.lit(True).alias("waiver_allowed"))


def inherited(changes: DataFrame, reach: DataFrame, nodes: DataFrame, changed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(impacts, lost) of unchanged downstream models; nodes also has base_columns and current_columns.

    lost(source, model, column) is what they inherit, harmless or not. A model
    whose columns are unknown on a side goes through the rules as well.
    """
    losing = changes.where("size(removed) > 0").select("source")
    rows = reach.join(losing, "source", "left_semi").join(nodes.withColumnRenamed("name", "affected"), "affected")
    rows = rows.join(changed.select(F.col("name").alias("affected")), "affected", "left_anti")
    known = (F.size("base_columns") > 0) & (F.size("current_columns") > 0)
    rows = rows.withColumn("lost", F.when(known, F.array_sort(F.array_except("base_columns", "current_columns"))).otherwise(F.array().cast("array<string>")))
    rows = rows.where("base_columns IS NULL OR current_columns IS NULL OR size(lost) > 0")
    lost = rows.select("source", F.col("affected").alias("model"), F.explode("lost").alias("column"))
    judged = predict(rows.drop("status").withColumn("status", F.lit("modified"))).where(F.col("safety") != SAFE)
    detail = F.when(F.size("lost") > 0, F.concat(F.lit("loses "), F.array_join("lost", ", "), F.lit(" from upstream"))).otherwise(
        "its columns cannot be resolved on both sides"
    )
    ops = F.array_join(F.transform("operations", lambda o: F.concat_ws(" ", o["op"], o["column"])), ", ")
    impacts = judged.select(
        "source",
        "affected",
        F.when(F.col("safety") == DESTRUCTIVE, "inherited_drop").otherwise("inherited_change").alias("risk"),
        F.concat(F.lit("file unchanged, "), detail, F.lit(" -- "), ops).alias("reason"),
        F.forall("operations", lambda o: known_operation(o["op"])).alias("waiver_allowed"),
    )
    return impacts, lost


def lost_columns(changes: DataFrame, inherited_lost: DataFrame) -> DataFrame:
    """(source, model, column): what each change takes away, from itself and from models that pass it on."""
    own = changes.select("source", F.col("source").alias("model"), F.explode("removed").alias("column"))
    return own.unionByName(inherited_lost).distinct()


def reading_pairs(lost: DataFrame, reach: DataFrame, nodes: DataFrame, reads: DataFrame, read_state: DataFrame, removed: DataFrame) -> DataFrame:
    """(source, affected, model, column, sql, resolved, hit, by_text): each reader below a source with each column lost there.

    nodes(name, materialization, sql); reads(reader, model, column) names what
    readers read; read_state(reader, model) lists the pairs that are resolved.
    A pair that is not is searched by text. Ephemeral and removed readers
    cannot break, nor does a model read itself.
    """
    readers = reach.join(nodes.withColumnRenamed("name", "affected"), "affected").where("materialization <> 'ephemeral'")
    readers = readers.join(removed.select(F.col("name").alias("affected")), "affected", "left_anti")
    pairs = readers.join(lost, "source").where("affected <> model")
    state = read_state.select(F.col("reader").alias("affected"), "model", F.lit(True).alias("resolved")).distinct()
    pairs = pairs.join(state, ["affected", "model"], "left")
    hits = reads.select(F.col("reader").alias("affected"), "model", F.lower("column").alias("low"), F.lit(True).alias("hit")).distinct()
    pairs = pairs.withColumn("low", F.lower("column")).join(hits, ["affected", "model", "low"], "left")
    by_text = F.col("resolved").isNull() & F.coalesce(_names_it(F.col("sql"), F.col("column")), F.lit(False))
    return pairs.select("source", "affected", "model", "column", "sql", "resolved", "hit", by_text.alias("by_text"))


def broken_references(pairs: DataFrame) -> DataFrame:
    """Readers of a lost column, of reading_pairs."""
    found = pairs.where((F.col("resolved") & F.col("hit")) | F.col("by_text"))
    # The verb follows the reader's pairs, whether or not the unresolved ones matched.
    loose = pairs.where("resolved IS NULL AND sql IS NOT NULL").select("source", "affected", F.lit(True).alias("loose")).distinct()
    rows = found.groupBy("source", "affected").agg(F.array_sort(F.collect_set("column")).alias("columns")).join(loose, ["source", "affected"], "left")
    verb = F.when(F.col("loose"), "references").otherwise("reads")
    return rows.select(
        "source",
        "affected",
        F.lit("broken_ref").alias("risk"),
        F.concat(verb, F.lit(" dropped column(s): "), F.array_join("columns", ", ")).alias("reason"),
        F.lit(True).alias("waiver_allowed"),
    )


def observed_reads(pairs: DataFrame, edges: DataFrame) -> DataFrame:
    """reading_pairs by source and reader, as the evidence graph takes them, with the models whose columns were lost.

    reads is null where the reader's statement cannot be resolved against one
    of those models; readers without a statement are left out.
    """
    direct = edges.select(F.col("parent").alias("source"), F.col("child").alias("reader"), F.lit(True).alias("dependency")).distinct()
    rows = pairs.where("sql IS NOT NULL").groupBy("source", F.col("affected").alias("reader")).agg(
        F.array_sort(F.collect_set(F.lower("column"))).alias("removed"),
        F.when(F.bool_and(F.col("resolved").isNotNull()), F.collect_set(F.when(F.col("hit"), F.lower("column")))).alias("reads"),
        F.array_sort(F.collect_set(F.when(F.col("by_text") | F.col("hit"), F.lower("column")))).alias("text_matches"),
        F.array_sort(F.collect_set(F.when(F.col("resolved").isNull(), F.col("model")))).alias("unresolved"),
    )
    return rows.join(direct, ["source", "reader"], "left")


def _tests_of(tests: DataFrame, owners: DataFrame, edges: DataFrame) -> DataFrame:
    """Tests that hang off an owner, once for each source; owners(source, owner)."""
    children = owners.join(edges.select(F.col("parent").alias("owner"), F.col("child").alias("test_id")), "owner").select("source", "test_id").distinct()
    return children.join(tests, "test_id")


def unit_test_impacts(lost: DataFrame, owners: DataFrame, edges: DataFrame, fixtures: DataFrame) -> DataFrame:
    """Fixtures that name a lost column, or cannot be read; fixtures(test_id, test_name, label, model, columns nullable, unreadable_reason)."""
    gone = lost.groupBy("source", "model").agg(F.array_sort(F.collect_set("column")).alias("removed"))
    rows = _tests_of(fixtures, owners, edges).join(gone, ["source", "model"])
    named = F.filter("removed", lambda c: F.array_contains(F.col("columns"), F.lower(c)))
    rows = rows.withColumn("named", named).where("columns IS NULL OR size(named) > 0")
    unreadable = F.col("columns").isNull()
    reason = F.when(
        unreadable, F.concat("label", F.lit(" "), "unreadable_reason", F.lit(", so it is unknown whether it names the dropped column(s)"))
    ).otherwise(F.concat("label", F.lit(" names dropped column(s): "), F.array_join("named", ", ")))
    risk = F.when(unreadable, "unit_test_unreadable").otherwise("unit_test_failure")
    return rows.select("source", F.col("test_name").alias("affected"), risk.alias("risk"), reason.alias("reason"), (~unreadable).alias("waiver_allowed"))


def data_test_impacts(lost: DataFrame, owners: DataFrame, edges: DataFrame, tests: DataFrame, columns: DataFrame, depends: DataFrame) -> DataFrame:
    """Data tests on a lost column: declared columns first, else the compiled text, else unreadable.

    tests(test_id, test_name, requires_sql, sql nullable), columns(test_id,
    model, column), depends(test_id, model).
    """
    rows = _tests_of(tests, owners, edges)
    declared = columns.select("test_id", "model", F.lower("column").alias("low"))
    hit = rows.join(declared, "test_id").join(lost.withColumn("low", F.lower("column")), ["source", "model", "low"])
    first = hit.groupBy("source", "test_id", "test_name").agg(F.array_sort(F.collect_set("column")).alias("named")).withColumn(
        "reason", F.concat(F.lit("tests dropped column(s): "), F.array_join("named", ", "))
    ).withColumn("risk", F.lit("data_test_failure"))
    rest = rows.join(first.select("source", "test_id"), ["source", "test_id"], "left_anti")
    described = columns.select("test_id", "model", F.lit(True).alias("described")).distinct()
    vague = rest.join(depends, "test_id").join(described, ["test_id", "model"], "left").where("described IS NULL OR requires_sql").join(lost, ["source", "model"])
    unread = vague.where("sql IS NULL").select("source", "test_id", "test_name").distinct().withColumns(
        {
            "risk": F.lit("data_test_unreadable"),
            "reason": F.lit("not every column read is described and no compiled SQL was found, so it is unknown whether it reads the dropped column(s)"),
        }
    )
    second = (
        vague.where(_names_it(F.col("sql"), F.col("column")))
        .groupBy("source", "test_id", "test_name")
        .agg(F.array_sort(F.collect_set("column")).alias("named"))
        .withColumns({"risk": F.lit("data_test_failure"), "reason": F.concat(F.lit("its SQL names dropped column(s): "), F.array_join("named", ", "))})
    )
    cols = ["source", F.col("test_name").alias("affected"), "risk", "reason", (F.col("risk") == "data_test_failure").alias("waiver_allowed")]
    return first.select(*cols).unionByName(second.select(*cols)).unionByName(unread.select(*cols))


def exposures(predictions: DataFrame, reach: DataFrame, edges: DataFrame, declared: DataFrame) -> DataFrame:
    """(source, exposures) for changes that are not safe or lose a column for certain; they never raise a verdict.

    predictions(name, safety, base_columns, current_columns), edges by name,
    declared(exposure_id, exposure_name).
    """
    _, removed = column_diff(F.col("base_columns"), F.col("current_columns"))
    loud = predictions.where((F.col("safety") != SAFE) | (F.size(removed) > 0)).select(F.col("name").alias("source"))
    owners = loud.select("source", F.col("source").alias("owner")).unionByName(
        reach.join(loud, "source", "left_semi").select("source", F.col("affected").alias("owner"))
    )
    found = owners.join(edges, F.col("owner") == F.col("parent")).join(declared, F.col("child") == F.col("exposure_id"))
    return found.groupBy("source").agg(F.array_sort(F.collect_set("exposure_name")).alias("exposures"))


def escalate(predictions: DataFrame, impacts: DataFrame) -> DataFrame:
    """predictions(name, safety, ...) with own_safety and the worst of it and its impacts; a cascade never lowers a verdict."""
    worst = impacts.groupBy(F.col("source").alias("name")).agg(F.max(risk_severity(F.col("risk"))).alias("__w"))
    rows = predictions.withColumn("own_safety", F.col("safety")).join(worst, "name", "left")
    return rows.withColumn("safety", F.greatest("own_safety", F.coalesce("__w", F.lit(SAFE)))).drop("__w")
