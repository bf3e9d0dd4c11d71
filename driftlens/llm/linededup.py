"""Repeated runs of lines by a distributed suffix array; later copies are deleted.

Every line is an id (128 bits of its SHA-256). Prefix doubling ranks the
suffixes of all documents: round k sorts pairs of ranks, so that the rank of a
position stands for the order of its next 2**k lines. Equal ranks are one
interval of the suffix array, whose suffixes have a common prefix of 2**k
lines; lengths between powers of two are two overlapping ranks. A run is the
shortest that reaches the threshold from its first or from its last line;
wherever such a run has an earlier copy, its lines go. Every longer repeated
run is the union of such runs, so what is deleted are the maximal ones.

Only built-in functions run on the executors, and only lines that occur twice
take part in the rounds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftlens.llm.common import SPACE, fresh, hot_keys, materialize, spread_join

#: Words that a repeated run has at least.
LEAST_WORDS = 50
#: What names a line's place.
PLACE = ["doc_id", "text_hash", "pos"]


def _line_id(line: Column) -> Column:
    return F.substring(F.unhex(F.sha2(F.encode(line, "UTF-8"), 256)), F.lit(1), F.lit(16))


def _n_words(line: Column) -> Column:
    return F.size(F.array_remove(F.split(line, SPACE), ""))


def _ranked(rows: DataFrame, keys: list[str], name: str) -> DataFrame:
    """rows with `rank`: numbers in the order of the keys, equal for equal keys.

    The distinct keys are sorted over ranges; a row's number within its range
    and the range's own make a number that grows with the key. It is written
    at once, since a range bound is a sample's.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = rows.groupBy(*keys).agg(F.count("*").alias("n")).repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
    order = materialize(order.withColumn("rank", F.monotonically_increasing_id()), f"order_{name}")
    return spread_join(rows, order.drop("n"), keys, hot_keys(order, keys, rows.count()), PLACE)


def _with_runs(rows: DataFrame, least_words: int) -> DataFrame:
    """rows with the lines of the shortest run of least_words from each line on (ahead) and up to it (back); null for none.

    stretch numbers the parts of a document without a line that occurs once.
    """
    doc = Window.partitionBy("doc_id", "text_hash").orderBy("pos")
    gap = F.when(F.lag("pos").over(doc) == F.col("pos") - 1, 0).otherwise(1)
    rows = rows.withColumn("gap", gap).withColumn("stretch", F.sum("gap").over(doc)).drop("gap")
    part = Window.partitionBy("doc_id", "text_hash", "stretch")
    upto = F.sum("words").over(part.orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    rows = rows.withColumn("upto", upto).withColumn("before", F.col("upto") - F.col("words"))
    # Frames that only grow: the first line whose start lies least_words further, the last whose end lies so far back.
    after = F.min("pos").over(part.orderBy(F.desc("before")).rangeBetween(Window.unboundedPreceding, -least_words))
    prior = F.max("pos").over(part.orderBy("upto").rangeBetween(Window.unboundedPreceding, -least_words))
    rows = rows.withColumns(
        {"after": after, "prior": prior, "begin": F.min("pos").over(part), "end": F.max("pos").over(part), "all": F.sum("words").over(part)}
    )
    ahead = F.when(F.col("after").isNotNull(), F.col("after") - F.col("pos")).when(
        F.col("all") - F.col("before") >= least_words, F.col("end") - F.col("pos") + 1
    )
    back = F.when(F.col("prior").isNotNull(), F.col("pos") - F.col("prior")).when(
        F.col("upto") >= least_words, F.col("pos") - F.col("begin") + 1
    )
    return rows.withColumns({"ahead": ahead, "back": back}).drop("upto", "before", "after", "prior", "begin", "end", "all")


def suffix_ranks(rows: DataFrame, longest: int) -> tuple[DataFrame, list[str]]:
    """rows(doc_id, text_hash, stretch, pos, r0, ...) with r1, r2, ...: the order of the next 2, 4, ... lines up to `longest`."""
    levels, stretch = ["r0"], Window.partitionBy("doc_id", "text_hash", "stretch").orderBy("pos")
    while 2 ** len(levels) <= longest:
        step = 2 ** (len(levels) - 1)
        pairs = rows.withColumn("second", F.coalesce(F.lead(levels[-1], step).over(stretch), F.lit(-1).cast("long")))
        name = f"r{len(levels)}"
        rows = materialize(_ranked(pairs, [levels[-1], "second"], name).withColumnRenamed("rank", name).drop("second"), name)
        levels.append(name)
    return rows, levels


def _intervals(ranks: DataFrame, levels: list[str], length: str, first: Column) -> DataFrame:
    """A row for each run of `length` lines that begins at `first`, named by its interval of the suffix array."""
    at = ["doc_id", "text_hash", "stretch"]
    # The largest power of two within the length, as the number of its level.
    level = sum((F.when(F.col("n") >= 2**k, 1).otherwise(0) for k in range(1, len(levels))), F.lit(0))
    runs = ranks.filter(F.col(length).isNotNull()).select(*at, first.alias("pos"), F.col(length).alias("n")).withColumn("level", level)
    runs = runs.withColumn("tail_pos", F.col("pos") + F.col("n") - F.pow(F.lit(2), F.col("level")).cast("int"))
    all_ranks = ranks.select(*(F.col(c).alias(f"k_{c}") for c in at), F.col("pos").alias("k_pos"), F.array(*levels).alias("r"))
    same = F.lit(True)
    for c in at:
        same = same & F.col(c).eqNullSafe(F.col(f"k_{c}"))
    drop = [f"k_{c}" for c in at] + ["k_pos", "r"]
    runs = runs.join(all_ranks, same & (F.col("pos") == F.col("k_pos"))).withColumn("head", F.get("r", F.col("level"))).drop(*drop)
    runs = runs.join(all_ranks, same & (F.col("tail_pos") == F.col("k_pos"))).withColumn("tail", F.get("r", F.col("level"))).drop(*drop)
    return runs.select("doc_id", "text_hash", "pos", "n", "head", "tail")


def _overlaps(first: Column) -> Column:
    """Whether a run begins within the first one of its kind: then its lines are the first copy's own."""
    same = first["doc_id"].eqNullSafe(F.col("doc_id")) & first["text_hash"].eqNullSafe(F.col("text_hash"))
    return same & (F.col("pos") < first["pos"] + F.col("n"))


def repeated_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least_words: int = LEAST_WORDS) -> DataFrame:
    """The lines to delete: doc_id, text_hash and removed, sorted line numbers from 0.

    A line goes where it lies in a run of least_words words or more that occurs
    earlier, in the order of doc_id (nulls last), text hash and line. In a text
    that repeats itself a later copy begins behind the end of the first, which
    so never loses a line to itself. Rows that share doc_id and text are one
    document. doc_id keeps its type.
    """
    split = docs.select(
        F.col(doc_id).alias("doc_id"),
        F.xxhash64(F.col(text)).alias("text_hash"),
        F.posexplode(F.split(F.coalesce(F.col(text).cast("string"), F.lit("")), "\n", -1)).alias("pos", "line"),
    )
    lines = materialize(
        split.select("doc_id", "text_hash", "pos", _line_id(F.col("line")).alias("id"), _n_words(F.col("line")).cast("long").alias("words")), "lines"
    )
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash", "pos")
    twice = lines.groupBy("id").agg(F.min(place).alias("lo"), F.max(place).alias("hi"), F.count("*").alias("n")).filter("lo <> hi").select("id", "n")
    twice = materialize(twice, "twice")
    shared = spread_join(lines, twice.select("id"), ["id"], hot_keys(twice, ["id"], lines.count()), PLACE)
    shared = shared.select("doc_id", "text_hash", "pos", "id", "words").distinct()
    first = _ranked(materialize(shared, "shared"), ["id"], "r0").withColumnRenamed("rank", "r0").drop("id")
    rows = materialize(_with_runs(first, least_words), "r0")
    longest = rows.agg(F.max(F.greatest("ahead", "back"))).first()[0] or 0
    ranks, levels = suffix_ranks(rows, longest)

    later = []
    for length, begin in (("ahead", F.col("pos")), ("back", F.col("pos") - F.col("back") + 1)):
        runs = materialize(_intervals(ranks, levels, length, begin), f"runs_{length}")
        key = ["n", "head", "tail"]
        copied = runs.groupBy(*key).agg(F.min(place).alias("first"), F.max(place).alias("last"), F.count("*").alias("n_runs")).filter("first <> last")
        copied = materialize(copied.select(*key, "first", "n_runs"), f"copied_{length}")
        found = spread_join(runs, copied.drop("n_runs"), key, hot_keys(copied, key, runs.count(), "n_runs"), PLACE).filter((F.col("first") < place) & ~_overlaps(F.col("first")))
        later.append(found.select("doc_id", "text_hash", F.explode(F.sequence(F.col("pos"), F.col("pos") + F.col("n") - 1)).alias("pos")))
    doomed = later[0].unionByName(later[1])
    return doomed.groupBy("doc_id", "text_hash").agg(F.sort_array(F.collect_set("pos")).alias("removed"))


def delete_repeated_lines(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least_words: int = LEAST_WORDS, removed: str = "removed_lines"
) -> DataFrame:
    """docs with the text less its later copies, and `removed`: the numbers of the lines that went.

    See repeated_lines. The first copy of everything stays, and runs of fewer
    words stay everywhere. A document that is a copy as a whole keeps an empty
    text. Null texts stay null, empty ones empty; an empty table stays empty;
    other columns are left alone, but for one that is called as `removed`,
    whatever its case: the new one replaces it.
    """
    gone = materialize(repeated_lines(docs, doc_id, text, least_words), "removed")
    key, id_, hash_, new = (fresh(docs, n) for n in ("key_hash", "gone_id", "gone_hash", "gone_lines"))
    gone = gone.toDF(id_, hash_, new)
    same = F.col(doc_id).eqNullSafe(F.col(id_)) & (F.col(key) == F.col(hash_))
    # Dealt by document at every size, so that disk and network grow as the input does.
    rows = docs.withColumn(key, F.xxhash64(F.col(text))).join(gone.hint("merge"), same, "left")
    lines = fresh(docs, "line_array")
    rows = rows.withColumn(lines, F.when(F.col(new).isNotNull(), F.split(F.col(text), "\n", -1)))
    keep = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(new))
    cleaned = F.array_join(F.transform(keep, lambda i: F.get(lines, i)), "\n")
    cleaned = F.when(F.col(new).isNotNull(), cleaned).otherwise(F.col(text)).alias(text)
    own = [cleaned if c == text else F.col(c) for c in docs.columns if c.lower() != removed.lower()]
    return rows.select(*own, F.coalesce(new, F.array().cast("array<int>")).alias(removed))
