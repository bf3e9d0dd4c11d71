"""Benchmark decontamination: size-partitioned MinHash containment search, verified exactly.

The smallest shingle of an item under a random order is a uniform sample of
its shingles, so the share of such minima that a document has estimates the
share of the item that it contains, however long the document is. Items are
partitioned by their number of shingles; each partition has its own number of
minima and of hits that a candidate needs. Candidates are verified by the exact
containment of the item's shingles, compared as words.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from math import ceil, comb, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from driftlens.llm.common import fresh, workers_know
from driftlens.llm.shingles import K, mix, shingle_hashes, word_hashes, words

#: Orders for items of many shingles, at least, and how often a contained item may show too few of their minima.
ORDERS, MISSED = 24, 1e-9
#: Items of no more shingles than this have them all as minima.
SMALL = 8
#: Bytes of item text that a pass over the documents looks for.
BLOCK_BYTES = 16_000_000
_FILTER_BITS = 22


def orders_and_hits(least: float) -> tuple[int, int]:
    """How many orders, and how many of their minima a candidate has: one contained by `least` shows fewer MISSED times.

    Of 24 independent minima an item contained by 0.8 shows fewer than 6 once in 10^9 times.
    """
    if not 0 < least <= 1:
        raise ValueError(f"no containment: {least}")
    orders = max(ORDERS, ceil(log(MISSED) / log(1 - least))) if least < 1 else ORDERS
    below, hits = 0.0, 0
    while hits < orders and (below := below + comb(orders, hits) * least**hits * (1 - least) ** (orders - hits)) <= MISSED:
        hits += 1
    return orders, max(1, hits)


class _Partition:
    """Items whose shingles have one length and whose numbers of shingles have one size."""

    def __init__(self, small: bool, least: float) -> None:
        self.small, (self.orders, self.hits) = small, orders_and_hits(least)
        self.probes: dict[int, Counter] = defaultdict(Counter)
        self.need: dict[int, int] = {}

    def add(self, item: int, hashes: np.ndarray) -> None:
        if self.small:
            minima = hashes
        else:
            orders = mix(np.arange(1, self.orders + 1, dtype="u8"))
            minima = [hashes[np.argmin(mix(hashes ^ o))] for o in orders]
        for h in map(int, minima):
            self.probes[h][item] += 1
        self.need[item] = 1 if self.small else self.hits


class ItemIndex:
    """The items of one block, by shingle length and size partition."""

    def __init__(self, items: list[tuple[int | None, str]], least: float) -> None:
        self.ids, self.shingles, self.least = [], [], least
        self.partitions: dict[tuple[int, int], _Partition] = {}
        for key, text in items:
            tokens = words(text)
            if not tokens:
                continue
            k = min(K, len(tokens))
            own = {tuple(tokens[i : i + k]) for i in range(len(tokens) - k + 1)}
            number = len(self.ids)
            self.ids.append(key)
            self.shingles.append(own)
            hashes = np.unique(shingle_hashes(word_hashes(tokens), k))
            part = self.partitions.setdefault((k, len(own).bit_length()), _Partition(len(own) <= SMALL, least))
            part.add(number, hashes)
        self.filters = {}
        for k in {k for k, _ in self.partitions}:
            seen = np.zeros(1 << _FILTER_BITS, bool)
            for (own, _), part in self.partitions.items():
                if own == k:
                    seen[np.fromiter(part.probes, "u8", len(part.probes)) >> np.uint64(64 - _FILTER_BITS)] = True
            self.filters[k] = seen

    def found(self, text: str | None) -> list[tuple[int, int]]:
        """(number of the item, shingles shared) for each item that the text contains by `least` or more."""
        tokens = words(text)
        hashed, out = word_hashes(tokens), []
        for k, seen in self.filters.items():
            if len(tokens) < k:
                continue
            hashes = shingle_hashes(hashed, k)
            here = np.unique(hashes[seen[hashes >> np.uint64(64 - _FILTER_BITS)]]).tolist()
            if not here:
                continue
            candidates: list[int] = []
            for (own, _), part in self.partitions.items():
                if own == k:
                    hits: Counter = Counter()
                    for h in here:
                        if h in part.probes:
                            hits.update(part.probes[h])
                    candidates += [i for i, n in hits.items() if n >= part.need[i]]
            if candidates:
                mine = set(zip(*(tokens[i:] for i in range(k)), strict=False))
                for i in candidates:
                    shared = len(self.shingles[i] & mine)
                    if shared >= self.least * len(self.shingles[i]):
                        out.append((i, shared))
        return sorted(out)


def _blocks(items: DataFrame, item_id: str, text: str) -> Iterator[list[tuple[int | None, str]]]:
    """The items in blocks of bounded size, each small enough for every worker."""
    rows = items.select(F.col(item_id).alias("i"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("t"))
    size = rows.agg(F.sum(F.octet_length("t")).alias("n")).first()["n"] or 0
    n = ceil(size / BLOCK_BYTES)
    for b in range(n):
        mine = rows if n == 1 else rows.filter(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == b)
        yield [tuple(r) for r in mine.collect()]


def find_leaks(
    docs: DataFrame,
    items: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    least: float = 0.8,
) -> DataFrame:
    """A row for each document and item of which it contains `least` or more of the shingles.

    doc_id, item_id (both in their own types), n_shared, n_shingles,
    containment. Shingles are five lower-case words; an item of fewer words has
    one shingle of them all, so an item of a single word is found wherever that
    word stands: leave such items out of `items` if that is not what is asked.
    Items or documents without a word match nothing. Rows that occur twice,
    on either side, are reported twice; null ids stay null; an empty table on
    either side gives no rows. Documents are never shuffled: each block of
    items of at most BLOCK_BYTES goes to all workers.
    """
    workers_know(docs.sparkSession)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    schema = T.StructType([rows.schema["doc_id"], items.select(F.col(item_id).alias("item_id")).schema["item_id"]])
    schema = schema.add("n_shared", T.LongType()).add("n_shingles", T.LongType()).add("containment", T.DoubleType())
    arrow = to_arrow_schema(schema)
    out = None
    for block in _blocks(items, item_id, item_text):
        sent = docs.sparkSession.sparkContext.broadcast(block)

        def searched(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            index = ItemIndex(sent.value, least)
            for batch in batches:
                found = []
                for key, body in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                    for i, shared in index.found(body.as_py()):
                        n = len(index.shingles[i])
                        found.append((key, index.ids[i], shared, n, shared / n))
                if found:
                    columns = zip(*found, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

        part = rows.mapInArrow(searched, schema)
        out = part if out is None else out.unionByName(part)
    return docs.sparkSession.createDataFrame([], schema) if out is None else out


def without_leaks(
    docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", least: float = 0.8
) -> DataFrame:
    """docs without the rows that contain `least` or more of any item's shingles; see find_leaks."""
    workers_know(docs.sparkSession)
    out, body = docs, fresh(docs, "body")
    for block in _blocks(items, item_id, item_text):
        sent = docs.sparkSession.sparkContext.broadcast(block)

        def kept(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            index = ItemIndex(sent.value, least)
            for batch in batches:
                clean = [not index.found(body.as_py()) for body in batch.column(batch.num_columns - 1)]
                yield batch.select(range(batch.num_columns - 1)).filter(pa.array(clean, pa.bool_()))

        # the text once more as the last column, since names may repeat but for their case
        out = out.withColumn(body, F.col(text).cast("string")).mapInArrow(kept, docs.schema)
    return out
