"""Near-duplicates by Order MinHash, verified by banded alignment.

Shingles are five lower-case words, labelled by their occurrence. For each of
SKETCHES random orders a text keeps its smallest labelled shingles in the order
of the text; two texts agree on a sketch more likely the closer they are in
edits. Texts that agree on one are candidates; a banded alignment of their
shingles verifies each. Long texts keep TAKEN shingles, so that a passage which
many texts share rarely makes a sketch alone; short ones keep TAKEN_SHORT, and
those of a length in between have both kinds, so any two texts of near lengths
have one kind in common. A pair at the least similarity agrees on none of its
sketches about three times in 100,000.

Equal texts are one node from the start. A bucket of candidates is not paired
out: its members meet its best-connected member. Once verified links have merged
groups, only members of different groups are left to meet. The texts of all
buckets that still hold such, of whatever size, are joined exactly: two of them
that are similar share one of their rarest labelled shingles, early enough that
what follows it suffices. So copies make no number of pairs that grows with the
square of a group, texts that share no more than a passage are told apart by
their own shingles, and every pair that shares a sketch is linked or tested
unless its shingles rule it out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftlens.llm.common import fresh, hot_keys, materialize, spread_join, workers_know
from driftlens.llm.components import components
from driftlens.llm.shingles import mix, shingle_hashes, similar, word_hashes, words

SKETCHES, TAKEN, TAKEN_SHORT = 32, 5, 2
#: Shingles that a long text has at least.
LONG_FROM = 16
LEAST = 0.8
#: How often a pair at the least similarity may share no sketch.
MISSED = 1e-5
#: Of a text longer than this the orders are taken one after another, to bound memory.
_LONG = 50_000


@dataclass(frozen=True)
class Plan:
    """What follows from the least similarity: shingles of a sketch, and up to how many shingles a text is short."""

    long: int
    short: int
    short_to: int

    @classmethod
    def of(cls, least: float) -> Plan:
        fit = [n for n in range(1, TAKEN + 1) if (1 - least**n) ** SKETCHES <= MISSED]
        if not fit or least > 1:
            raise ValueError(f"{SKETCHES} sketches cannot find pairs of similarity {least}")
        # Of two similar texts the longer one has at most 1 / least times as many shingles.
        return cls(max(fit), min(TAKEN_SHORT, max(fit)), max(24, int((LONG_FROM - 1) / least + 1e-9)))


_ORDERS = (mix(np.arange(1, SKETCHES + 1, dtype="u8") * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)).astype("u4")


def label_occurrences(hashes: np.ndarray) -> np.ndarray:
    """Each shingle's hash with the number of its occurrence, so that repeats differ."""
    order = np.argsort(hashes, kind="stable")
    ordered = hashes[order]
    new = np.concatenate([[True], ordered[1:] != ordered[:-1]])
    if new.all():
        return hashes
    at = np.arange(len(hashes))
    seen = at - np.maximum.accumulate(np.where(new, at, 0))
    out = hashes.copy()
    out[order] = np.where(seen > 0, mix(ordered + seen.astype("u8") * np.uint64(0xA0761D6478BD642F)), ordered)
    return out


def order_minhash(hashes: np.ndarray, take: int = TAKEN) -> np.ndarray:
    """One number for each order: the smallest labelled shingles, as they follow in the text."""
    labelled = label_occurrences(hashes)
    n, groups = len(labelled), [_ORDERS] if len(labelled) <= _LONG else np.split(_ORDERS, SKETCHES)
    short, out = (labelled >> np.uint64(32)).astype("u4"), []
    for orders in groups:
        if n > take:
            ranks = (short[None, :] ^ orders[:, None]) * np.uint32(0x85EBCA6B)
            ranks ^= ranks >> np.uint32(13)
            ranks *= np.uint32(0xC2B2AE35)
            taken = np.sort(np.argpartition(ranks, take - 1, axis=1)[:, :take], axis=1)
        else:
            taken = np.broadcast_to(np.arange(n), (len(orders), n))
        value = np.full(len(orders), min(n, take), "u8")
        for column in taken.T:
            value = mix(value * np.uint64(0x9E3779B97F4A7C15) + labelled[column])
        out.append(value)
    return np.concatenate(out)


def _sketcher(plan: Plan):
    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                nodes, long, short, shingles = [], [], [], []
                for body in part.column(2):
                    tokens = words(body.as_py())
                    if tokens:
                        hashes = shingle_hashes(word_hashes(tokens))
                        nodes.append(hashlib.sha256("\n".join(tokens).encode()).digest()[:16])
                        long.append(order_minhash(hashes, plan.long).view("i8") if len(hashes) >= LONG_FROM else None)
                        short.append(order_minhash(hashes, plan.short).view("i8") if len(hashes) <= plan.short_to else None)
                        shingles.append((hashes >> np.uint64(32)).astype("<u4").tobytes())
                    else:
                        for column in (nodes, long, short, shingles):
                            column.append(None)
                made = [pa.array(nodes, pa.binary()), pa.array(long, pa.list_(pa.int64())), pa.array(short, pa.list_(pa.int64())), pa.array(shingles, pa.binary())]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *made], names=["doc_id", "row_hash", "node", "long", "short", "shingles"])

    return sketch


def _verifier(least: float):
    def verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = batch.column(2), batch.column(3)
            good = [
                similar(np.frombuffer(x.as_buffer(), "<u4"), np.frombuffer(y.as_buffer(), "<u4"), least)
                for x, y in zip(left, right, strict=True)
            ]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(good, pa.bool_())], names=["a", "b", "good"])

    return verified


class _Links:
    """Tested pairs, and the groups that verified links make."""

    def __init__(self, texts: DataFrame, least: float) -> None:
        self.texts, self.least = texts, least
        self.tested: DataFrame | None = None
        self.groups: DataFrame | None = None  # node, label

    def test(self, pairs: DataFrame, level: int) -> None:
        """Verifies the pairs (a, b) that have not been tested before, and merges groups."""
        pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a <> b").distinct()
        if self.tested is not None:
            pairs = pairs.join(self.tested.select("a", "b"), ["a", "b"], "left_anti")
        pairs = materialize(pairs, f"pairs{level}")
        text, total, both = self.texts.select("node", "shingles"), pairs.count(), pairs
        # A centre meets very many members: its pairs, and their shingles, are dealt to many tasks.
        for end, other, column in (("a", "b", "left"), ("b", "a", "right")):
            hot = materialize(hot_keys(pairs.groupBy(end).agg(F.count("*").alias("n")), [end], total), f"hot_{end}{level}")
            both = spread_join(both, text.toDF(end, column), [end], hot, [other])
        both = both.select("a", "b", "left", "right")
        done = materialize(both.mapInArrow(_verifier(self.least), "a long, b long, good boolean"), f"links{level}")
        self.tested = done if self.tested is None else self.tested.unionByName(done)
        good = done.filter("good").select("a", "b")
        if self.groups is None:
            self.groups = components(good)
            return
        # Groups merge as wholes: only labels that new links connect take part.
        ends = good.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(self.groups, "node", "left_anti")
        known = self.groups.unionByName(ends.select("node", F.col("node").alias("label")))
        linked = good.join(known.toDF("a", "la"), "a").join(known.toDF("b", "lb"), "b").filter("la <> lb").select(F.col("la").alias("a"), F.col("lb").alias("b"))
        linked = materialize(linked.distinct(), f"merged{level}")
        if linked.isEmpty():
            self.groups = materialize(known, f"groups{level}")
            return
        now = components(linked).toDF("label", "now")
        self.groups = materialize(
            known.join(now, "label", "left").select("node", F.coalesce("now", "label").alias("label")), f"groups{level}"
        )

    def mixed(self, rows: DataFrame) -> DataFrame:
        """rows(bucket, node, ...), a written table, of buckets that hold two groups, with n, the members, and group."""
        total = rows.count()
        label = self.groups.toDF("node", "own")
        rows = rows.join(label.hint("merge"), "node", "left").withColumn("group", F.coalesce("own", "node")).drop("own")
        few = rows.groupBy("bucket").agg(F.count("*").alias("n"), F.min("group").alias("lo"), F.max("group").alias("hi"))
        few = materialize(few.filter("lo <> hi").select("bucket", "n"), "mixed")
        return spread_join(rows, few, ["bucket"], hot_keys(few, ["bucket"], total), ["node"])


def _star(rows: DataFrame) -> DataFrame:
    """Each member of a bucket with the one that meets the most others over all its buckets; ties by node.

    rows is a written table. Where groups are known, only members of other groups than that one's meet it.
    """
    if "group" not in rows.columns:
        rows = rows.withColumn("group", F.col("node"))
    degree = rows.groupBy("node").agg(F.sum("n").alias("degree"))
    ranked = rows.select("bucket", "node", "group").join(degree.hint("merge"), "node")
    centres = ranked.groupBy("bucket").agg(F.max(F.struct("degree", "node", "group")).alias("c"), F.count("*").alias("members"))
    centres = materialize(centres.select("bucket", F.col("c.node").alias("b"), F.col("c.group").alias("centre_group"), "members"), "centres")
    hot = hot_keys(centres, ["bucket"], rows.count(), "members")
    met = spread_join(rows, centres.drop("members"), ["bucket"], hot, ["node"])
    return met.filter(F.col("group") != F.col("centre_group")).select(F.col("node").alias("a"), "b")


def _labelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each labelled shingle of (node, shingles), with the number of the text's shingles."""
    for batch in batches:
        for lo in range(0, batch.num_rows, 500):
            part = batch.slice(lo, 500)
            texts = [label_occurrences(np.frombuffer(x.as_buffer(), "<u4").astype("u8")) for x in part.column(1)]
            sizes = np.array([len(x) for x in texts])
            columns = np.repeat(part.column(0).to_numpy(), sizes), np.repeat(sizes, sizes), np.concatenate(texts).view("i8")
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["node", "size", "bucket"])


def _rare(texts: DataFrame, least: float) -> DataFrame:
    """(bucket, node, size, left) for the rarest labelled shingles of each of texts(node, shingles).

    All texts order their shingles alike, the rarest first; `left` counts those
    from this one on. Of two similar texts the first common shingle has at least
    as many left as must be common, so later ones need not be looked at, and
    shingles of one text only are not rows at all.
    """
    rows = texts.select("node", "shingles").mapInArrow(_labelled, "node long, size long, bucket long")
    common = materialize(rows.groupBy("bucket").agg(F.count("*").alias("texts")).filter("texts > 1"), "common")
    total = common.agg(F.sum("texts")).first()[0] or 0
    place = F.row_number().over(Window.partitionBy("node").orderBy(F.desc("texts"), "bucket"))
    rows = spread_join(rows, common, ["bucket"], hot_keys(common, ["bucket"], total, "texts"), ["node"])
    return rows.select("bucket", "node", "size", place.alias("left")).filter(F.col("left") >= F.ceil(F.col("size") * least - 1e-9))


#: Rows of a hot bucket meet in a grid of so many by so many parts.
GRID = 8


def _in_grid(rows: DataFrame, hot: DataFrame, node: str, own: str, other: str) -> DataFrame:
    """rows(bucket, ...) with their part of a grid: dealt by node along their own side, repeated along the other; others are in part 0, 0."""
    rows = rows.join(F.broadcast(hot.withColumn("is_hot", F.lit(True))), "bucket", "left")
    dealt = F.when(F.col("is_hot"), F.pmod(F.xxhash64(node), F.lit(GRID)).cast("int")).otherwise(F.lit(0))
    across = F.when(F.col("is_hot"), F.sequence(F.lit(0), F.lit(GRID - 1))).otherwise(F.array(F.lit(0)))
    return rows.withColumn(own, dealt).withColumn(other, F.explode(across)).drop("is_hot")


def _candidates(rows: DataFrame, least: float) -> DataFrame:
    """Pairs of rows of _rare, a written table with group, that share a bucket, are of different groups and can be similar.

    One side leaves out each bucket's largest group, so its members are not held against each other.
    """
    of_group = rows.groupBy("bucket", "group").agg(F.count("*").alias("members"))
    largest = of_group.groupBy("bucket").agg(F.max(F.struct("members", "group")).alias("m"), F.sum("members").alias("n"))
    largest = materialize(largest.select("bucket", F.col("m.group").alias("main"), "n"), "largest")
    hot = materialize(hot_keys(largest, ["bucket"], rows.count()), "hot_shingles")
    others = spread_join(rows, largest.drop("n"), ["bucket"], hot, ["node"]).filter(F.col("group") != F.col("main"))
    one = _in_grid(others.select("bucket", "main", *(F.col(c).alias(f"{c}_a") for c in ("node", "group", "size", "left"))), hot, "node_a", "x", "y")
    two = _in_grid(rows.select("bucket", *(F.col(c).alias(f"{c}_b") for c in ("node", "group", "size", "left"))), hot, "node_b", "y", "x")
    size_a, size_b = F.col("size_a"), F.col("size_b")
    once = (F.col("group_b") == F.col("main")) | (F.col("node_a") < F.col("node_b"))
    enough = F.least("left_a", "left_b") >= F.ceil((size_a + size_b) * (least / (1 + least)) - 1e-9)
    near = F.least(size_a, size_b) >= F.greatest(size_a, size_b) * least - 1e-9
    return one.join(two.hint("merge"), ["bucket", "x", "y"]).filter((F.col("group_a") != F.col("group_b")) & once & near & enough).select(F.col("node_a").alias("a"), F.col("node_b").alias("b"))


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: float = LEAST) -> DataFrame:
    """One row for each document: doc_id, row_hash, exact_id, class_id, class_size, class_key.

    exact_id is the smallest doc_id with the same words in the same order,
    class_id the smallest of all that verified links connect with it, class_size
    the number of rows in that class; class_key names it. Ids keep their type. Texts without a word (null, empty, marks
    only) are near to nothing: their ids are their own doc_id, the size 1, the key null. Rows
    that occur twice are two copies; a null doc_id is never the smallest, and
    where it is the only one the class id is null; an empty table gives no rows.
    """
    workers_know(docs.sparkSession)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(F.col(text)).alias("row_hash"), F.col(text).cast("string").alias("text"))
    longs = T.ArrayType(T.LongType())
    schema = T.StructType([rows.schema["doc_id"]])
    for name, kind in (("row_hash", T.LongType()), ("node", T.BinaryType()), ("long", longs), ("short", longs), ("shingles", T.BinaryType())):
        schema = schema.add(name, kind)
    sketched = materialize(rows.mapInArrow(_sketcher(Plan.of(least)), schema), "sketched")
    copies = sketched.filter("node IS NOT NULL")
    # One row for each distinct text and kind of sketch; equal texts have equal sketches.
    once = copies.groupBy(F.col("node").alias("digest")).agg(F.first("long").alias("long"), F.first("short").alias("short"), F.count("*").alias("n"))
    # From here on a text is a number, which is a third of its digest's bytes in each of many rows.
    once = materialize(once.withColumn("node", F.monotonically_increasing_id()), "texts")
    kinds = F.explode(F.array(*(F.struct(F.lit(i).alias("kind"), F.col(c).alias("sketches")) for i, c in enumerate(("long", "short")))))
    texts = once.select("node", kinds.alias("k")).select("node", "k.kind", "k.sketches").where("sketches IS NOT NULL")
    coarse = texts.select("node", "kind", F.posexplode("sketches").alias("band", "s"))
    # The last bit of a bucket's number says to which half its sketch belongs.
    half = F.when(F.col("band") < SKETCHES // 2, 1).otherwise(0).cast("long")
    coarse = coarse.select("node", F.shiftleft(F.xxhash64("kind", "band", "s"), 1).bitwiseOR(half).alias("bucket"))
    # Joins of what grows with the input are dealt by key at every size, so that disk and network grow alike.
    full = coarse.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1")
    met = materialize(coarse.join(full.hint("merge"), "bucket").withColumn("first_half", F.col("bucket").bitwiseAND(F.lit(1).cast("long")) == 1), "met")
    wanted = once.select("digest", "node").join(met.select("node").distinct().hint("merge"), "node", "left_semi")
    # Texts that very many documents have: their rows are dealt to many tasks wherever they are joined.
    often = materialize(hot_keys(once, ["digest"], sketched.count()), "often")
    held = spread_join(copies.select(F.col("node").alias("digest"), "row_hash", "shingles"), wanted, ["digest"], often, ["row_hash"])
    held = held.groupBy("node").agg(F.first("shingles").alias("shingles"))
    links = _Links(materialize(held, "held"), least)
    # Half of the sketches merge what is near by far; the others see what is still apart.
    links.test(_star(met.filter("first_half")), 0)
    apart = materialize(links.mixed(met.select("bucket", "node")), "apart")
    links.test(_star(apart), 1)
    # What shares a sketch and is still apart, in buckets of any size, is joined exactly.
    nodes = links.mixed(apart.select("bucket", "node")).select("node").distinct()
    rare = materialize(_rare(links.texts.join(nodes.hint("merge"), "node", "left_semi"), least), "rare")
    links.test(_candidates(materialize(links.mixed(rare).drop("n"), "joined"), least), 2)

    exact = copies.groupBy(F.col("node").alias("digest")).agg(F.min("doc_id").alias("exact_id"))
    texts = once.select("digest", "node", "n").join(exact.hint("merge"), "digest").join(links.groups.toDF("node", "label").hint("merge"), "node", "left")
    texts = materialize(texts, "placed")
    alone = texts.filter("label IS NULL").select("digest", "exact_id", F.col("exact_id").alias("class_id"), F.col("n").alias("class_size"), F.col("node").alias("class_key"))
    grouped = texts.filter("label IS NOT NULL")
    whole = grouped.groupBy("label").agg(F.min("exact_id").alias("class_id"), F.sum("n").alias("class_size"), F.count("*").alias("texts"))
    whole = materialize(whole, "classes")
    named = spread_join(grouped.select("digest", "exact_id", "label"), whole.drop("texts"), ["label"], hot_keys(whole, ["label"], texts.count(), "texts"), ["digest"])
    classes = alone.unionByName(named.select("digest", "exact_id", "class_id", "class_size", F.col("label").alias("class_key")))
    rows = sketched.select("doc_id", "row_hash", F.col("node").alias("digest"))
    rows = spread_join(rows, classes, ["digest"], often, ["doc_id", "row_hash"], "left")
    return rows.select(
        "doc_id",
        "row_hash",
        F.when(F.col("digest").isNull(), F.col("doc_id")).otherwise(F.col("exact_id")).alias("exact_id"),
        F.when(F.col("digest").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("class_size", F.lit(1)).cast("long").alias("class_size"),
        "class_key",
    )


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: float = LEAST) -> DataFrame:
    """docs with one row of each near-duplicate class: that with the smallest doc_id, then hash (null ids last).

    Of rows that share doc_id and text one stays, whatever their other columns;
    which one is left to chance. Null and empty texts are texts without a word. Texts without a word are in no class: all of different doc_id stay.
    """
    found = near_duplicates(docs, doc_id, text, least)
    key, digest, id_, hash_ = (fresh(docs, n) for n in ("class_key", "key_hash", "key_id", "key_row"))
    # A row without a word is a class of its own: its id and hash.
    of_class = F.coalesce(F.col("class_key").cast("string"), F.concat_ws("/", F.lit("none"), "doc_id", "row_hash"))
    first = (
        found.groupBy(of_class.alias(key))
        .agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row_hash")).alias("first"))
        .select(F.col("first.doc_id").alias(id_), F.col("first.row_hash").alias(hash_))
    )
    rows = docs.withColumn(digest, F.xxhash64(F.col(text)))
    same = F.col(doc_id).eqNullSafe(F.col(id_)) & (F.col(digest) == F.col(hash_))
    return rows.join(first, same, "left_semi").dropDuplicates([doc_id, digest]).select(*docs.columns)
