"""Harmonic packing: lengths in reciprocal-capacity classes, bins with a fixed number of pieces.

A piece of r tokens belongs to class m = capacity // r and its bins hold
exactly m pieces, so every worker fills its bins alone and at once. Where
m * r would leave more than a small share of a bin empty, a head of
capacity // (m + 1) tokens, which fits its own class without loss, is cut off
and the rest is classed anew. Pieces of bins that a worker cannot fill meet in
ever fewer workers, which fill bins by the same rule; what the last one has
left, less than one bin for each class, is packed best fit.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from driftlens.llm.common import materialize, workers_know
from driftlens.llm.tokens import WORD_BPE, encoder, whole_ids

#: Share of a bin that a class may leave empty before a piece is cut.
SLACK = 1 / 64
#: How many workers' leftovers one worker takes in the next round.
FAN_IN = 32
#: Rows that a worker gathers before it hands them on.
ROWS = 20_000

#: What is known of a piece besides its document's id.
PIECE = ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def cut(tokens: int, capacity: int, slack: float = SLACK) -> list[int]:
    """Lengths of the pieces of a document, in order; each fills its class's bins but for the slack."""
    whole, rest = divmod(tokens, capacity)
    out = [capacity] * whole
    while rest:
        m = capacity // rest
        if capacity - m * rest <= slack * capacity:
            out.append(rest)
            break
        head = capacity // (m + 1)
        out.append(head)
        rest -= head
    return out


class _Filler:
    """Fills bins of one worker; rows are tuples of an id and PIECE."""

    def __init__(self, capacity: int, base: int, id_type: pa.DataType) -> None:
        self.capacity, self.next = capacity, base
        self.schema = pa.schema([("doc_id", id_type), *((n, pa.int64()) for n in PIECE)])
        self.open: dict[int, list[tuple]] = defaultdict(list)
        self.rows: list[tuple] = []

    def close(self, pieces: list[tuple]) -> None:
        offset = 0
        for p in pieces:
            self.rows.append((*p[:5], self.next, offset))
            offset += p[2]
        self.next += 1

    def add(self, piece: tuple) -> None:
        m = self.capacity // piece[2]
        mine = self.open[m]
        mine.append(piece)
        if len(mine) == m:
            self.close(self.open.pop(m))

    def best_fit(self) -> None:
        """Closes what is open: longest first, each into the fullest bin that has room."""
        rest: list[tuple[int, int]] = []  # room, bin
        bins: list[list[tuple]] = []
        for p in sorted((p for mine in self.open.values() for p in mine), key=lambda p: (-p[2], p[0] is None, str(p[0]), p[1])):
            i = bisect_left(rest, (p[2], -1))
            room, b = rest.pop(i) if i < len(rest) else (self.capacity, len(bins))
            if b == len(bins):
                bins.append([])
            bins[b].append(p)
            insort(rest, (room - p[2], b))
        self.open.clear()
        for pieces in bins:
            self.close(pieces)

    def taken(self, least: int = 0) -> Iterator[pa.RecordBatch]:
        if len(self.rows) > least:
            columns = zip(*self.rows, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, self.schema, strict=True)], schema=self.schema)
            self.rows = []

    def left(self) -> Iterator[pa.RecordBatch]:
        self.rows += [(*p[:5], None, None) for mine in self.open.values() for p in mine]
        yield from self.taken()


def _base(level: int) -> int:
    """Sequence ids of a worker: none meets another's, and a retried task has the same."""
    return (level << 56) | (TaskContext.get().partitionId() << 32)


def pack(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    capacity: int = 4096,
    end_id: int | None = 2,
    tokenizer: str = WORD_BPE,
) -> DataFrame:
    """One row for each piece: doc_id, in its own type, and PIECE (long).

    A document's ids are those of its whole text (null: empty) and then end_id.
    start counts its ids before the piece; ids_crc32 is of the piece's ids as
    little-endian unsigned 32-bit numbers; sequence_id and offset say where it
    lies. Rows that occur twice are packed twice; a null doc_id stays null;
    without any id (an empty text and end_id None) there is no piece; an empty
    table gives no rows. Nothing is dropped or truncated.
    """
    workers_know(docs.sparkSession)
    tail = b"" if end_id is None else end_id.to_bytes(4, "little")
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    pieces = T.StructType([rows.schema["doc_id"], *(T.StructField(n, T.LongType()) for n in PIECE)])
    id_type = to_arrow_type(rows.schema["doc_id"].dataType)

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, filler = encoder(tokenizer), _Filler(capacity, _base(1), id_type)
        for batch in batches:
            for key, body in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = whole_ids(body.as_py(), enc) + tail
                start = 0
                for n in cut(len(ids) // 4, capacity):
                    filler.add((key, start, n, zlib.crc32(memoryview(ids)[4 * start : 4 * (start + n)]), len(ids) // 4))
                    start += n
                yield from filler.taken(ROWS)
        yield from filler.left()

    def again(level: int, last: bool):
        def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            filler = _Filler(capacity, _base(level), id_type)
            for batch in batches:
                for p in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    filler.add(p[:5])
                yield from filler.taken(ROWS)
            if last:
                filler.best_fit()
            yield from filler.left()

        return fill

    parts, level = rows.rdd.getNumPartitions(), 1
    packed = materialize(rows.mapInArrow(first, pieces), "packed")
    done = packed.filter(F.col("sequence_id").isNotNull())
    left = packed.filter(F.col("sequence_id").isNull())
    while True:
        parts, level = max(1, -(-parts // FAN_IN)), level + 1
        packed = left.repartition(parts).mapInArrow(again(level, parts <= 1), pieces)
        if parts <= 1:
            return done.unionByName(packed)
        packed = materialize(packed, f"packed{level}")
        done = done.unionByName(packed.filter(F.col("sequence_id").isNotNull()))
        left = packed.filter(F.col("sequence_id").isNull())
