"""Packed token-id matrices: best-fit decreasing, with a segment tree over the bins' free room."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from driftlens.llm.common import workers_know
from driftlens.llm.tokens import WORD_BPE, encoder, whole_ids

#: Tokens that a worker holds at once: one block is packed for itself.
BLOCK = 4_000_000

def _schema(id_field: T.StructField) -> T.StructType:
    """Of a row of the matrix, for documents with such ids."""
    segment = [id_field, ("start", T.LongType()), ("length", T.IntegerType()), ("ids_crc32", T.LongType()), ("doc_tokens", T.LongType())]
    row = [
        ("sequence_id", T.LongType()),
        ("n_tokens", T.IntegerType()),
        ("input_ids", T.BinaryType()),
        ("cu_seqlens", T.ArrayType(T.IntegerType())),
        ("position_resets", T.ArrayType(T.IntegerType())),
        ("segments", T.ArrayType(T.StructType([f if isinstance(f, T.StructField) else T.StructField(*f) for f in segment]))),
    ]
    return T.StructType([T.StructField(*f) for f in row])


class RoomTree:
    """Bins by free room 0..capacity; finds one with the least room that is enough.

    A segment tree over the rooms: a node tells whether any bin below it has
    one of its rooms.
    """

    def __init__(self, capacity: int) -> None:
        self.size = 1 << capacity.bit_length()
        self.tree = bytearray(2 * self.size)
        self.bins: list[list[int]] = [[] for _ in range(capacity + 1)]

    def put(self, room: int, bin_: int) -> None:
        self.bins[room].append(bin_)
        i = room + self.size
        while i and not self.tree[i]:
            self.tree[i] = 1
            i >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """(room, bin) of a bin with the least room >= need; it leaves the tree."""
        i = need + self.size
        while not self.tree[i]:
            while i & 1:  # a right child: nothing further right below this parent
                i >>= 1
            if not i:
                return None
            i += 1
            if i & (i - 1) == 0:  # past the last leaf of this level
                return None
        while i < self.size:
            i = 2 * i if self.tree[2 * i] else 2 * i + 1
        room = i - self.size
        bin_ = self.bins[room].pop()
        if not self.bins[room]:
            self.tree[i] = 0
            while (i := i >> 1) and not (self.tree[2 * i] or self.tree[2 * i + 1]):
                self.tree[i] = 0
        return room, bin_


def best_fit_decreasing(lengths: list[int], capacity: int) -> list[list[int]]:
    """Bins of indexes into lengths, none over the capacity; the longest piece first, each where it fits best."""
    tree, bins = RoomTree(capacity), []
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        found = tree.take(lengths[i])
        room, b = found or (capacity, len(bins))
        if found is None:
            bins.append([])
        bins[b].append(i)
        tree.put(room - lengths[i], b)
    return bins


def pack_matrix(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    capacity: int = 4096,
    end_id: int | None = 49407,
    pad_id: int = 0,
    tokenizer: str = WORD_BPE,
    block: int = BLOCK,
) -> DataFrame:
    """One row for each row of the matrix: sequence_id, n_tokens, input_ids, cu_seqlens, position_resets, segments.

    input_ids has capacity ids, padded with pad_id, as little-endian unsigned
    16-bit numbers where the vocabulary allows and 32-bit ones otherwise.
    cu_seqlens starts with 0 and ends with n_tokens; position_resets are the
    offsets at which position ids start again at 0. Documents longer than the
    capacity are split without loss, start counting their ids before a segment.
    Null and empty texts give end_id alone, or nothing without it. Rows that
    occur twice are packed twice; a null doc_id stays null; an empty table
    gives no rows. A worker packs blocks of its own rows, so nothing is shuffled
    and its memory is bounded by `block` tokens and one document.
    """

    workers_know(docs.sparkSession)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    schema = _schema(rows.schema["doc_id"])
    arrow = to_arrow_schema(schema)

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        kind = "<u2" if enc.vocab_size <= 1 << 16 else "<u4"
        next_id = TaskContext.get().partitionId() << 32
        tail = b"" if end_id is None else end_id.to_bytes(4, "little")
        pieces: list[tuple[int | None, int, bytes, int]] = []
        held = 0

        def matrix() -> Iterator[pa.RecordBatch]:
            nonlocal next_id
            bins = best_fit_decreasing([len(p[2]) // 4 for p in pieces], capacity)
            for at in range(0, len(bins), 256):
                columns: list[list] = [[] for _ in arrow]
                for own in bins[at : at + 256]:
                    ids = np.frombuffer(b"".join(pieces[i][2] for i in own), "<u4")
                    row = np.full(capacity, pad_id, kind)
                    row[: len(ids)] = ids
                    ends = np.cumsum([0] + [len(pieces[i][2]) // 4 for i in own]).tolist()
                    segments = [
                        {"doc_id": k, "start": s, "length": len(b) // 4, "ids_crc32": zlib.crc32(b), "doc_tokens": n}
                        for k, s, b, n in (pieces[i] for i in own)
                    ]
                    for column, value in zip(columns, (next_id, len(ids), row.tobytes(), ends, ends[:-1], segments), strict=True):
                        column.append(value)
                    next_id += 1
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

        for batch in batches:
            for key, body in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = whole_ids(body.as_py(), enc) + tail
                n = len(ids) // 4
                pieces += [(key, s, ids[4 * s : 4 * (s + capacity)], n) for s in range(0, n, capacity)]
                held += n
                if held >= block:
                    yield from matrix()
                    pieces, held = [], 0
        yield from matrix()

    return rows.mapInArrow(packed, schema)


def write_matrix(docs: DataFrame, path: str, **options) -> None:
    """Writes the matrix of pack_matrix as Parquet, the ids without dictionary encoding."""
    pack_matrix(docs, **options).write.option("parquet.enable.dictionary", "false").parquet(path)
