"""The whole check of two revisions: what changes, which DDL follows, what breaks, how certain it is."""

from __future__ import annotations

import posixpath
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftlens.functions.scratch import cut
from driftlens.functions.sqlshape import STAR_MARKS, Extraction, extract, only_in_comments, reads_by_relation
from driftlens.operators import cascade, closure, diff, evidence, report, rules
from driftlens.sources import catalog

#: Models that are built anew whatever their columns are.
REPLACED = ("table", "view", "ephemeral")
#: What the manifest alone may change in a model; raw_code counts for what has no compiled SQL.
MANIFEST_FIELDS = ["settings", "written_settings", "database", "schema", "alias", "declared", "language"]
STAR_FOUND_NOTHING = "SELECT * came from a star macro that found no relation when this was compiled. Compile where it exists, or list the columns."
#: What predictions and impacts have at least.
_PREDICTIONS = (
    "name string, status string, materialization string, on_schema_change string, base_columns array<string>, current_columns array<string>,"
    " operations array<struct<op:string,column:string>>, safety int, own_safety int, added array<string>, removed array<string>"
)
_IMPACTS = "source string, affected string, risk string, reason string, waiver_allowed boolean"
_READS = "source string, reader string, removed array<string>, reads array<string>, text_matches array<string>, unresolved array<string>, dependency boolean"
_SHAPE = "rev string, name string, columns array<string>, state string, casts map<string,string>"


@dataclass
class Revision:
    """One side: its statements (stem, sql) and its manifest."""

    files: DataFrame
    manifest: DataFrame


@dataclass
class Result:
    predictions: DataFrame
    impacts: DataFrame
    findings: DataFrame
    refused: DataFrame
    exposures: DataFrame
    #: Names that the ignore list took out, and those of it that nothing has.
    ignored: DataFrame
    unmatched: DataFrame
    #: What readers below a source read of the columns lost there, and what every name stands for.
    reads: DataFrame
    aliases: DataFrame


def load(spark: SparkSession, root: str, model_dirs: list[str] | None = None, compiled: str = "compiled", manifest: str = "manifest.json") -> Revision:
    """A revision from a folder with a tree of statements and a manifest."""
    files = catalog.statements(catalog.scan_files(spark, posixpath.join(root, compiled), "*.sql"), model_dirs)
    return Revision(files.where("is_model").select("stem", "sql"), catalog.manifest(spark, posixpath.join(root, manifest)))


def shapes(base: DataFrame, current: DataFrame, relations: DataFrame, dialect: str) -> DataFrame:
    """(rev, name, columns, state, casts) of both sides' statements.

    Stars of other models need those models' columns, so models are analysed in
    waves: first all whose answer needs no other, then those whose star they
    settle, until a wave settles none. Each wave is one pass over the
    statements that are open; what is left then stays as it is.
    """
    both = base.select(F.lit("base").alias("rev"), F.col("stem").alias("name"), "sql").unionByName(current.select(F.lit("current").alias("rev"), F.col("stem").alias("name"), "sql"))
    open_ = cut(both.withColumn("known", F.create_map().cast("map<string,array<string>>")))
    done = None

    def analysed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for rev, name, sql, known in zip(frame.rev, frame.name, frame.sql, frame.known, strict=True):
                have = dict(known or {})
                asked: list[str] = []

                def resolve(key: str, have=have, asked=asked) -> list[str] | None:
                    asked.append(key)
                    found = have.get(key) if have.get(key) is not None else have.get(key.rsplit(".", 1)[-1])
                    return None if found is None else list(found)

                found = extract(sql, dialect, resolve) if sql is not None else Extraction(None, "refused")
                waits = [k for k in asked if k not in have and k.rsplit(".", 1)[-1] not in have]
                names = None if found.names is None else list(found.names)
                out.append((rev, name, names, found.state, dict(found.casts), waits))
            yield pd.DataFrame(out, columns=["rev", "name", "columns", "state", "casts", "waits"])

    while True:
        wave = cut(open_.select("rev", "name", "sql", "known").mapInPandas(analysed, _SHAPE + ", waits array<string>"))
        settled = wave.where("size(waits) = 0").drop("waits")
        done = settled if done is None else done.unionByName(settled)
        waiting = wave.where("size(waits) > 0")
        wanted = waiting.select("rev", "name", F.explode("waits").alias("key"))
        owner = wanted.join(relations.withColumnRenamed("name", "owner"), F.lower(F.col("key")) == F.col("relation"), "left")
        bare = F.element_at(F.split("key", r"\."), -1)
        owner = owner.withColumn("owner", F.coalesce("owner", bare))
        answers = done.where("state IN ('known', 'partial', 'star', 'refused')").select("rev", F.col("name").alias("owner"), "columns", "state")
        # Only a complete list settles a star; any other answer settles that it cannot be expanded.
        got = owner.join(answers, ["rev", "owner"]).select("rev", "name", "key", F.when(F.col("state") == "known", F.col("columns")).otherwise(F.array().cast("array<string>")).alias("columns"))
        if got.isEmpty():
            return cut(done.unionByName(waiting.drop("waits")))
        news = got.groupBy("rev", "name").agg(F.map_from_entries(F.collect_list(F.struct("key", "columns"))).alias("news"))
        open_ = cut(
            waiting.select("rev", "name").join(open_, ["rev", "name"]).join(news, ["rev", "name"], "left").select(
                "rev", "name", "sql", F.when(F.col("news").isNotNull(), F.map_concat("known", "news")).otherwise(F.col("known")).alias("known")
            )
        )


def reads(current: DataFrame, schema: dict[str, list[str]], dialect: str) -> tuple[DataFrame, DataFrame]:
    """(reads, state): reader, relation and column; and the readers whose reads are resolved.

    schema has the base columns of the models; it goes to every worker, as the
    project's own metadata is small.
    """

    def analysed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for name, sql in zip(frame.stem, frame.sql, strict=True):
                found = reads_by_relation(sql, schema, dialect) if sql is not None else None
                out += [(name, k, list(v)) for k, v in (found or {}).items()]
                if found is not None:
                    out.append((name, None, []))
            yield pd.DataFrame(out, columns=["reader", "relation", "columns"])

    rows = cut(current.select("stem", "sql").mapInPandas(analysed, "reader string, relation string, columns array<string>"))
    return rows.where("relation IS NOT NULL").select("reader", "relation", F.explode("columns").alias("column")), rows.where("relation IS NULL").select("reader")


def check(
    base: Revision, current: Revision, dialect: str | None = None, test_sql: DataFrame | None = None, select: str | None = None, ignore: Sequence[str] = ()
) -> Result:
    """All stages over two revisions; test_sql(test_name, sql) has the compiled tests, where there are any.

    select names models as m, +m, m+ or +m+, joined by commas; ignore names
    models that are left out after that. A stem that two files of a revision
    have, and a selection of unknown syntax, are errors.
    """
    spark = base.files.sparkSession
    _no_twins(base.files, current.files)
    adapter = current.manifest.select("metadata.adapter_type").first()
    dialect = catalog.resolve_dialect(dialect, adapter[0] if adapter else None)
    old, new = cut(catalog.models(base.manifest)), cut(catalog.models(current.manifest))
    every = cut(new.unionByName(old.join(new.select("node_id"), "node_id", "left_anti")))
    relations = cut(catalog.relation_index(every))
    changed = diff.tree_diff(base.files, current.files).select(F.col("stem").alias("name"), "status")
    gone = diff.only_in(old.select("name"), new, base.files.withColumnRenamed("stem", "name"), changed).withColumn("status", F.lit("removed"))
    fields = ["materialization", "on_schema_change", "relation_name", "language"]
    moved = diff.setting_changes(old.select("name", *fields), new.select("name", *fields), fields)
    config = moved.select("name").unionByName(_manifest_only(old, new, current.files)).distinct().join(changed, "name", "left_anti").withColumn("status", F.lit("modified"))
    todo = changed.unionByName(gone).unionByName(config).join(every.select("name").distinct(), "name", "left_semi")
    wanted, listed = todo, spark.createDataFrame([(n,) for n in ignore], "name string")
    if select is not None:
        selected = closure.select_nodes(_named_links(base, current, every), every.select("name", F.col("name").alias("node")).distinct(), select)
        if selected is None:
            raise ValueError(f"no selection: {select}")
        wanted = wanted.join(selected.select(F.col("node").alias("name")), "name", "left_semi")
    ignored, unmatched = wanted.select("name").join(listed, "name", "left_semi"), listed.join(every.select("name"), "name", "left_anti")
    todo = cut(wanted.join(listed, "name", "left_anti"))

    def uncompiled(models: DataFrame, files: DataFrame, code: str, message: str) -> DataFrame:
        rows = diff.only_in(models.where(~_without_sql()).select("name"), files.withColumnRenamed("stem", "name"), listed)
        return rows.select(F.col("name").alias("resource"), F.lit(code).alias("reason_code"), F.lit(message).alias("message"))

    missing = uncompiled(new, current.files, "missing_compiled_sql", "no compiled SQL")
    # A baseline that lacks files of its own models establishes nothing.
    partial = uncompiled(old, base.files, "baseline_missing", "no compiled SQL in the baseline")
    incomplete = missing.unionByName(partial)
    tests, columns, depends = catalog.data_tests(current.manifest)
    aliases = every.select("name", F.col("node_id").alias("unique_id")).unionByName(tests.select(F.col("test_name").alias("name"), F.col("test_id").alias("unique_id")))
    if todo.isEmpty():  # what is missing is told all the same
        none, quiet_, idle = (spark.createDataFrame([], t) for t in (_PREDICTIONS, _IMPACTS, "source string, exposures array<string>"))
        unseen = spark.createDataFrame([], _READS)
        return Result(none, quiet_, report.facts(none, quiet_, cut(incomplete), aliases), incomplete, idle, ignored, unmatched, unseen, aliases)
    shape = shapes(base.files, current.files, relations, dialect)
    # The legacy star and names that are known in part count; a refusal is null.
    side = {r: shape.where(F.col("rev") == r).select("name", F.col("columns").alias(f"{r}_columns"), F.col("state").alias(f"{r}_state"), F.col("casts").alias(f"{r}_casts")) for r in ("base", "current")}
    rows = todo.join(every.dropDuplicates(["name"]), "name").join(side["base"], "name", "left").join(side["current"], "name", "left")
    rows = rows.withColumn("current_columns", F.when(F.col("status") != "removed", F.col("current_columns")))
    predicted = rules.predict(rows.withColumnRenamed("current_casts", "casts"))
    judged = _types_changed(_star_macros(rules.apply_contract(predicted), base.files, current.files))
    before = moved.where("before IS NOT NULL OR after IS NOT NULL").groupBy("name").agg(F.collect_list(F.struct("field", "before", "after")).alias("moved"))
    judged = _settings(judged.join(before, "name", "left"))
    unread = (F.col("status") == "added") & (F.col("current_state") == "refused")
    review = F.array(F.struct(F.lit("REVIEW REQUIRED").alias("op"), F.lit(None).cast("string").alias("column")))
    other = F.coalesce(F.col("language"), F.lit("sql")) != "sql"
    judged = judged.withColumns(
        {
            "operations": F.when(other | unread, F.concat(review, F.col("operations"))).otherwise(F.col("operations")),
            "safety": F.when(other | unread, F.greatest("safety", F.lit(rules.WARNING))).otherwise(F.col("safety")),
        }
    )
    predictions = cut(judged)

    links = cut(closure.without_inactive(_named_links(base, current, every), _inactive_links(base, current, dialect)))
    changes = cut(cascade.changed_columns(predictions))
    reach = closure.closure(links, predictions.select(F.col("name").alias("root"))).select(F.col("root").alias("source"), F.col("node").alias("affected"))
    reach = cut(reach.join(every.select(F.col("name").alias("affected")), "affected", "left_semi").select("source", "affected"))
    loud = reach.join(predictions.where(cascade.quiet(predictions)).select(F.col("name").alias("source")), "source", "left_anti")
    all_sides = every.dropDuplicates(["name"]).select("name", "materialization", "on_schema_change")
    model_rows = all_sides.join(side["base"], "name", "left").join(side["current"], "name", "left").join(current.files.withColumnRenamed("stem", "name"), "name", "left")
    model_rows = cut(model_rows.withColumn("sql", F.col("sql")))
    passed_on, lost_on = cascade.inherited(changes, loud, model_rows, predictions.select("name"))
    lost = cut(cascade.lost_columns(changes, lost_on))
    schema = {r["relation"]: list(r["base_columns"]) for r in relations.join(side["base"].where("base_state = 'known'"), "name").select("relation", "base_columns").collect()}
    schema |= {k.rsplit(".", 1)[-1]: v for k, v in schema.items()}
    read, resolved = reads(current.files, schema, dialect)
    by_model = read.join(relations, "relation").select("reader", F.col("name").alias("model"), "column")
    # A resolved reader answers for every model whose columns are in the schema.
    known = side["base"].where("base_state = 'known'").select(F.col("name").alias("model"))
    asked = loud.join(lost.select("source", "model").distinct(), "source").select(F.col("affected").alias("reader"), "model").distinct()
    state = asked.join(resolved, "reader").join(known, "model", "left_semi")
    removed = predictions.where("status = 'removed'").select("name")
    owners = changes.select("source", F.col("source").alias("owner")).unionByName(loud.select("source", F.col("affected").alias("owner")))
    sql = test_sql if test_sql is not None else spark.createDataFrame([], "test_name string, sql string")
    pairs = cut(cascade.reading_pairs(lost, loud, model_rows, by_model, state, removed))
    impacts = cascade.build_failures(changes, loud, model_rows)
    for part in (
        passed_on,
        contracts_below(reach, every, side["current"]),
        cascade.broken_references(pairs),
        cascade.unit_test_impacts(lost, owners, links, catalog.fixtures(current.manifest)),
        cascade.data_test_impacts(lost, owners, links, tests.join(sql, "test_name", "left"), columns, depends),
    ):
        impacts = impacts.unionByName(part)
    impacts = cut(impacts)
    final = cut(cascade.escalate(predictions, impacts))
    refused = shape.where("state IN ('refused', 'partial')").join(predictions.select("name"), "name", "left_semi").select(F.col("name").alias("resource"), F.lit("parse_failed").alias("reason_code"), F.lit("output columns cannot all be read").alias("message")).distinct()
    refusals = cut(refused.unionByName(incomplete))
    observed = cut(cascade.observed_reads(pairs, links))
    blind = cut(evidence.unresolved_reads(observed, report.facts(final, impacts, refusals, aliases)))
    refusals = refusals.unionByName(blind)
    findings = report.facts(final, impacts, refusals, aliases)
    declared = catalog.exposures(current.manifest)
    return Result(final, impacts, findings, refusals, cascade.exposures(final, reach, links, declared), ignored, unmatched, observed, aliases)


def causal_graph(base: Revision, current: Revision, result: Result) -> DataFrame:
    """The evidence graph of a result: what reads a lost column, and the dependencies on paths from a cause to what it affects."""
    every = catalog.models(current.manifest).select("node_id", "name").unionByName(catalog.models(base.manifest).select("node_id", "name")).distinct()
    sides = [_by_name(catalog.edges(r.manifest), every) for r in (base, current)]
    outside = catalog.edges(current.manifest).where(F.startswith(F.col("child"), F.lit("exposure."))).select(F.col("child").alias("node"))
    edges, _ = evidence.read_edges(result.reads)
    return evidence.graph(edges, *sides, result.findings.select("source", "affected"), outside)


def exit_code(result: Result, acknowledged: Sequence[str] = (), fail_on: str | None = None, warning_code: int = 2) -> DataFrame:
    """One row: the code that a build ends with. Acknowledged models waive what is understood and unambiguous; the report stays whole."""
    named = result.aliases.sparkSession.createDataFrame([(n,) for n in acknowledged], "name string")
    open_ = report.unwaived(result.predictions, result.impacts, named, report.ambiguous(result.aliases))
    rows = open_.select("rank", F.lit(False).alias("refused")).unionByName(result.refused.select(F.lit(rules.SAFE).alias("rank"), F.lit(True).alias("refused")))
    rows = rows.agg(F.coalesce(F.max("rank"), F.lit(rules.SAFE)).alias("worst"), F.coalesce(F.bool_or("refused"), F.lit(False)).alias("refused"))
    return rows.select(report.exit_code(F.col("worst"), F.col("refused"), F.lit(fail_on).cast("string"), F.lit(warning_code)).alias("exit_code"))


def _no_twins(base: DataFrame, current: DataFrame) -> None:
    both = diff.duplicate_keys(base).unionByName(diff.duplicate_keys(current)).orderBy("stem").limit(5).collect()
    if both:
        raise ValueError("more than one file for " + ", ".join(r["stem"] for r in both))


def _without_sql() -> Column:
    """Models that are not compiled to SQL files."""
    return (F.col("materialization") == "snapshot") | (F.coalesce(F.col("language"), F.lit("sql")) != "sql")


def _named_links(base: Revision, current: Revision, every: DataFrame) -> DataFrame:
    """The dependencies of both revisions by the models' names."""
    key = every.select(F.col("node_id"), F.col("name"))
    return _by_name(closure.merge_revisions(catalog.edges(current.manifest), catalog.edges(base.manifest)), key)


def _by_name(links: DataFrame, key: DataFrame) -> DataFrame:
    named = links.join(key.toDF("parent", "p"), "parent", "left").join(key.toDF("child", "c"), "child", "left")
    return named.select(F.coalesce("p", "parent").alias("parent"), F.coalesce("c", "child").alias("child"))


def _inactive_links(base: Revision, current: Revision, dialect: str) -> DataFrame:
    """(parent, child) by name, of models whose statement has the parent's relation in comments alone.

    Both must be SQL without hooks whose files are what the manifest says was
    compiled, and the parent's relation the same in both revisions; selection
    still follows these links.
    """
    n = F.col("n")
    said = catalog.nodes(current.manifest).where(n["resource_type"] == "model")
    no_hook = [F.coalesce(F.get_json_object(n["config_text"], f"$['{h}-hook']"), F.lit("[]")).isin("[]", "") for h in ("pre", "post")]
    code = F.regexp_replace(F.regexp_replace(n["compiled_code"], "^\ufeff", ""), "\r\n", "\n")
    plain = said.withColumn("stem", catalog.model_key(F.col("node_id"))).join(current.files, "stem")
    plain = plain.where(
        (F.coalesce(n["language"], F.lit("sql")) == "sql") & n["config"]["materialized"].isin("table", "view", "incremental") & no_hook[0] & no_hook[1] & n["compiled"] & (code == F.col("sql"))
    )
    named = F.coalesce(n["relation_name"], F.lit("")) != ""
    before = catalog.nodes(base.manifest).select(F.col("node_id").alias("parent"), n["relation_name"].alias("relation"))
    parents = plain.where(named).select(F.col("node_id").alias("parent"), n["relation_name"].alias("relation"), F.col("stem").alias("name")).join(before, ["parent", "relation"], "left_semi")
    needs = plain.where(F.contains("sql", F.lit("--")) | F.contains("sql", F.lit("/*"))).select(F.col("node_id").alias("child"), F.explode(n["depends_on"]["nodes"]).alias("parent"))
    known = needs.join(said.where(named).select(F.col("node_id").alias("parent"), n["relation_name"].alias("relation")), "parent").groupBy("child").agg(F.collect_set("relation").alias("known"))
    asked = needs.join(catalog.edges(current.manifest), ["parent", "child"], "left_semi").join(parents, "parent")
    asked = asked.groupBy("child").agg(F.collect_set(F.struct("name", "relation")).alias("asked")).join(known, "child")
    asked = asked.join(plain.select(F.col("node_id").alias("child"), "stem", "sql"), "child").select("stem", "sql", "known", "asked")

    def proved(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = zip(frame.stem, frame.sql, frame.known, frame.asked, strict=True)
            yield pd.DataFrame(
                [(a["name"], stem) for stem, sql, have, wanted in rows for a in wanted if only_in_comments(sql, a["relation"], set(have), dialect)], columns=["parent", "child"], dtype=object
            )

    return asked.mapInPandas(proved, "parent string, child string")


def _manifest_only(old: DataFrame, new: DataFrame, files: DataFrame) -> DataFrame:
    """(name) of models of both revisions whose manifest entries differ; compiled ones must have their file."""
    here = new.join(files.select(F.col("stem").alias("name"), F.lit(True).alias("compiled")), "name", "left").where(_without_sql() | F.col("compiled"))
    code = F.when(_without_sql(), F.col("raw_code")).alias("code")
    now, was = (x.select("name", *MANIFEST_FIELDS, code) for x in (here, old))
    return diff.setting_changes(was, now, [*MANIFEST_FIELDS, "code"]).select("name").distinct()


def _star_macros(rows: DataFrame, *sides: DataFrame) -> DataFrame:
    """A warning over a star that a macro left behind says so first."""
    marks = [F.contains(F.col("sql"), F.lit(m)) for m in STAR_MARKS]
    found = [x.where(marks[0] & marks[1]).select(F.col("stem").alias("name")) for x in sides]
    rows = rows.join(found[0].unionByName(found[1]).distinct().withColumn("star_mark", F.lit(True)), "name", "left")
    said = F.array(F.struct(F.lit(STAR_FOUND_NOTHING).alias("op"), F.lit(None).cast("string").alias("column")))
    loud = F.col("star_mark") & (F.col("safety") == rules.WARNING)
    return rows.withColumn("operations", F.when(loud, F.concat(said, F.col("operations"))).otherwise(F.col("operations"))).drop("star_mark")


def _types_changed(rows: DataFrame) -> DataFrame:
    """TYPE CHANGED for each column of both sides whose explicit casts differ; one without a cast is of unknown type.

    Whether such a change loses data cannot be told from the statements, so it
    is a warning at least. What is built anew is left out.
    """
    names = F.array_sort(F.array_distinct(F.concat(F.map_keys("base_casts"), F.map_keys("casts"))))
    was, now = (lambda c: F.try_element_at("base_casts", c)), (lambda c: F.try_element_at("casts", c))
    differ = F.filter(names, lambda c: F.array_contains("base_columns", c) & F.array_contains("current_columns", c) & ~was(c).eqNullSafe(now(c)))
    none = F.lit("unknown")
    ops = F.transform(differ, lambda c: F.struct(F.concat(F.lit("TYPE CHANGED: "), F.coalesce(was(c), none), F.lit(" -> "), F.coalesce(now(c), none)).alias("op"), c.alias("column")))
    asked = (F.col("status") == "modified") & ~F.col("materialization").isin(*REPLACED) & (F.col("base_state") == "known") & (F.col("current_state") == "known")
    ops = F.when(F.coalesce(asked, F.lit(False)), ops).otherwise(F.array().cast("array<struct<op:string,column:string>>"))
    rows = rows.withColumn("type_ops", ops)
    safety = F.when(F.size("type_ops") > 0, F.greatest("safety", F.lit(rules.WARNING))).otherwise(F.col("safety"))
    return rows.withColumns({"operations": F.concat("type_ops", "operations"), "safety": safety}).drop("type_ops")


def contracts_below(reach: DataFrame, models: DataFrame, shapes_now: DataFrame) -> DataFrame:
    """Impacts on downstream models whose own columns break their enforced contract; shapes_now(name, current_columns, current_casts)."""
    bound = models.where("contract_enforced").dropDuplicates(["name"]).join(shapes_now, "name", "left").withColumnRenamed("current_casts", "casts")
    bound = bound.join(reach.select(F.col("affected").alias("name")).distinct(), "name", "left_semi")
    bare = bound.withColumns({"operations": F.array().cast("array<struct<op:string,column:string>>"), "safety": F.lit(rules.SAFE)})
    broken = rules.apply_contract(bare).where(F.col("safety") != rules.SAFE)
    return reach.join(broken.withColumnRenamed("name", "affected"), "affected").select(
        "source",
        "affected",
        F.lit("contract_violation").alias("risk"),
        F.array_join(F.transform("operations", lambda o: o["op"]), "; ").alias("reason"),
        F.forall("operations", lambda o: rules.known_operation(o["op"])).alias("waiver_allowed"),
    )


def _settings(rows: DataFrame) -> DataFrame:
    """Operations for changed settings come first; a change of materialization or relation is a warning, of the policy one where ignore turns to sync."""

    def text(x):
        was, now = F.coalesce(x["before"], F.lit("none")), F.coalesce(x["after"], F.lit("none"))
        arrow = F.concat(was, F.lit(" -> "), now)
        return F.when(x["field"] == "materialization", F.concat(F.lit("MATERIALIZATION CHANGED: "), arrow)).when(
            x["field"] == "on_schema_change", F.concat(F.lit("on_schema_change CHANGED: "), arrow)
        ).when(x["field"] == "relation_name", F.concat(F.lit("RELATION CHANGED ("), arrow, F.lit(")")))

    moved = F.coalesce("moved", F.array().cast("array<struct<field:string,before:string,after:string>>"))
    ops = F.transform(F.filter(moved, lambda x: x["field"] != "language"), lambda x: F.struct(text(x).alias("op"), F.lit(None).cast("string").alias("column")))
    risky = F.exists(moved, lambda x: x["field"].isin("materialization", "relation_name") | ((x["field"] == "on_schema_change") & (F.coalesce(x["before"], F.lit("ignore")) == "ignore") & (x["after"] == "sync_all_columns")))
    modified = F.col("status") == "modified"
    return rows.withColumns(
        {
            "operations": F.when(modified, F.concat(ops, F.col("operations"))).otherwise(F.col("operations")),
            "safety": F.when(modified & risky, F.greatest("safety", F.lit(rules.WARNING))).otherwise(F.col("safety")),
        }
    ).drop("moved")
