"""Chat formatting as a prefix tree: shared initial turns are emitted once, depth first.

A node is a turn after a certain history, so conversations that begin alike
share nodes. All nodes in depth-first order make one sequence of tokens, in
which a node stands at start..start+n_tokens. Its position ids go on where its
parent's end, and it attends to itself and to its ancestors, whose intervals in
the sequence it carries.

A node knows its parent's name, not its path. Its place follows from the
children that were chosen at the forks above it: nodes in the order of those
names, and of depth where they are equal, are in depth-first order. So a long
conversation costs as much as its turns, however deep it is.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftlens.llm.common import hot_keys, materialize, spread_join, workers_know
from driftlens.llm.tokens import KEPT_CHARS, KEPT_WORDS, _byte_chars, library, tokenizer_path

BYTE_BPE = "byte_bpe_50k.json"
OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"
#: Bytes of a node's name.
NAME = 16
#: Openings of turns that a worker keeps the ids of.
KEPT_ROLES = 10_000

_CONTROL = re.compile(r"<(\\*)\|")
_ESCAPED = re.compile(r"<\\(\\*)\|")


def escape(text: str) -> str:
    """No control string is left: < and | get a backslash more between them."""
    return _CONTROL.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"<\1|", text)


def escape_role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


def format_turn(role: str, text: str) -> tuple[str, str, str]:
    """What opens the turn, its escaped text, and what closes it."""
    return f"{OPEN}{escape_role(role)}\n", escape(text), CLOSE


def parse(formatted: str) -> list[tuple[str, str]]:
    """The (role, text) turns of a formatted conversation."""
    turns = []
    for part in formatted.split(OPEN)[1:]:
        role, _, text = part.removesuffix(CLOSE).partition("\n")
        turns.append((unescape_role(role), unescape(text)))
    return turns


#: How byte-level vocabularies split texts (fixed value); characters whose class all versions of Unicode agree on.
_PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
_SETTLED = re.compile("[\t-\r -~\xa0-\u024f]*")


class ByteEncoder:
    """Byte-level ids that decode to exactly what was encoded; special strings are ordinary text.

    Ids are packed, little-endian and 32 bits wide. They are the library's for
    the whole text; where the vocabulary splits texts by _PIECES, pieces of
    Latin text are kept, up to KEPT_WORDS a worker.
    """

    def __init__(self, name: str = BYTE_BPE) -> None:
        path = tokenizer_path(name)
        self.library = library(path)
        self.library.encode_special_tokens = True
        with open(path, encoding="utf-8") as f:
            own = json.load(f)
        split = own["pre_tokenizer"] or {}
        plain = own.get("normalizer") is None and own.get("post_processor") is None
        self.in_pieces = plain and split.get("type") == "ByteLevel" and not split.get("add_prefix_space") and split.get("use_regex", True)
        self.chars, self.kept = _byte_chars(), {}
        back = {c: b for b, c in self.chars.items()}
        self.spelled = {i: bytes(back[c] for c in t) for t, i in self.library.get_vocab(with_added_tokens=False).items() if all(c in back for c in t)}

    def _piece(self, piece: str) -> bytes:
        ids = self.kept.get(piece)
        if ids is None:
            spelled = "".join(map(self.chars.__getitem__, piece.encode()))
            ids = _packed([t.id for t in self.library.model.tokenize(spelled)])
            if len(self.kept) < KEPT_WORDS and len(piece) <= KEPT_CHARS:
                self.kept[piece] = ids
        return ids

    def encode(self, texts: list[str]) -> list[bytes]:
        out = [b"".join(map(self._piece, _PIECES.findall(t))) if self.in_pieces and _SETTLED.fullmatch(t) else None for t in texts]
        rest = [i for i, ids in enumerate(out) if ids is None]
        for i, e in zip(rest, self.library.encode_batch_fast([texts[i] for i in rest], add_special_tokens=False), strict=True):
            out[i] = _packed(e.ids)
        return out

    def decode(self, ids: np.ndarray) -> str:
        return b"".join(map(self.spelled.__getitem__, ids.tolist())).decode()


_encoders: dict[str, ByteEncoder] = {}


def _encoder(name: str) -> ByteEncoder:
    if name not in _encoders:
        _encoders[name] = ByteEncoder(name)
    return _encoders[name]


def _rows(columns: list, kinds: dict[str, pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds.values(), strict=True)], schema=pa.schema(list(kinds.items())))


def _fields(lists: pa.ListArray) -> tuple[list[int], list[list]]:
    """Lengths of a column of arrays of structs, and the values of each field, one after another."""
    return pc.list_value_length(lists).to_pylist(), [f.to_pylist() for f in lists.flatten().flatten()]


def _joined(spans: tuple[tuple[int, ...], ...], start: int, end: int, number: int) -> tuple[tuple[int, ...], ...]:
    """spans and one more node behind them; where it follows the last, they are one."""
    if spans and spans[-1][1] == start and spans[-1][3] == number - 1:
        return (*spans[:-1], (spans[-1][0], end, spans[-1][2], number))
    return (*spans, (start, end, number, number))


def prefix_tree(
    turns: DataFrame,
    conv_id: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
    tokenizer: str = BYTE_BPE,
) -> tuple[DataFrame, DataFrame]:
    """(nodes, conversations) of the turns; turns are ordered by turn, role and text.

    nodes: name, parent (null for a root), depth, start, n_tokens, ids
    (little-endian unsigned 32-bit), number in the order of the sequence,
    position_start, attends (the ancestors from the root on as spans of tokens
    start..end, which are the nodes first..last; a node also attends to its
    own past), loss_start and loss_end within the node (equal where nothing is
    learnt; an assistant's text and nothing around it).
    conversations: conv, a number of its own, conv_id in its type and the name
    of its last node.

    Null role or text: empty. Null turn: before the others. Every row with a
    null conv_id is a conversation of its own. Rows that occur twice are two
    turns. An empty table has no nodes. Other columns are left alone. One
    conversation must fit into a task's memory.
    """
    spark = turns.sparkSession
    workers_know(spark)
    turn_ = F.struct(
        F.col(turn).cast("long").alias("turn"),
        F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"),
    )
    rows = turns.select(F.col(conv_id).alias("conv_id"), turn_.alias("t"))
    whole = rows.filter("conv_id IS NOT NULL").groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    whole = whole.unionByName(rows.filter("conv_id IS NULL").select("conv_id", F.array("t").alias("turns")))
    step = {"conv": pa.int64(), "depth": pa.int32(), "name": pa.binary(), "parent": pa.binary(), "role": pa.string(), "text": pa.string(), "leaf": pa.bool_()}

    def steps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv = TaskContext.get().partitionId() << 40
        for batch in batches:
            lengths, (_, roles, texts) = _fields(batch.column(1))
            out: list[list] = [[] for _ in step]
            ids, at = [], 0
            for key, n in zip(batch.column(0), lengths, strict=True):
                name = b""
                for depth in range(n):
                    said, parent = (roles[at].encode(), texts[at].encode()), name
                    name = hashlib.sha256(name + len(said[0]).to_bytes(8, "big") + said[0] + said[1]).digest()[:NAME]
                    for column, value in zip(out, (conv, depth, name, parent, roles[at], texts[at], depth == n - 1), strict=True):
                        column.append(value)
                    at += 1
                ids += [key] * n
                conv += 1
            made = _rows(out, step)
            yield pa.RecordBatch.from_arrays([pa.array([k.as_py() for k in ids], batch.column(0).type), *made.columns], names=["conv_id", *step])

    schema = T.StructType([rows.schema["conv_id"]])
    for name, kind in zip(step, (T.LongType(), T.IntegerType(), T.BinaryType(), T.BinaryType(), T.StringType(), T.StringType(), T.BooleanType()), strict=True):
        schema = schema.add(name, kind)
    stepped = materialize(whole.mapInArrow(steps, schema), "steps")
    conversations, total = stepped.filter("leaf").select("conv", "conv_id", "name"), stepped.count()

    # Where turns go on in different ways, and what each conversation chose there.
    forks = stepped.groupBy("parent").agg(F.min("name").alias("lo"), F.max("name").alias("hi"), F.count("*").alias("n")).filter("lo <> hi").select("parent", "n")
    forks = materialize(forks, "forks")
    chosen = spread_join(stepped.select("conv", "depth", "name", "parent"), forks.select("parent"), ["parent"], hot_keys(forks, ["parent"], total), ["conv"])
    choices = chosen.groupBy("conv").agg(F.sort_array(F.collect_list(F.struct("depth", "name"))).alias("choices"))
    # A node's text comes from the first conversation that has it.
    owners = materialize(stepped.groupBy("name").agg(F.min("conv").alias("conv"), F.min("depth").alias("depth"), F.count("*").alias("n")), "owners")
    above = F.filter("choices", lambda x: x["depth"] <= F.col("depth"))
    key = F.aggregate(above, F.lit(b""), lambda a, x: F.concat(a, x["name"]))
    keyed = owners.join(choices.hint("merge"), "conv", "left").select("conv", "name", F.coalesce(key, F.lit(b"")).alias("key"))
    once = stepped.drop("conv_id", "leaf").join(keyed.hint("merge"), ["conv", "name"])
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    node = {
        "conv": pa.int64(), "depth": pa.int32(), "name": pa.binary(), "parent": pa.binary(), "part": pa.int32(), "local": pa.int64(), "rank": pa.int64(),
        "n_tokens": pa.int32(), "loss_start": pa.int32(), "loss_end": pa.int32(), "ids": pa.binary(),
    }

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part, at, rank = _encoder(tokenizer), TaskContext.get().partitionId(), 0, 0
        tail = enc.encode([CLOSE])[0]
        heads: dict[str, bytes] = {}
        for batch in batches:
            roles = batch.column(2).to_pylist()
            new = [r for r in set(roles) if r not in heads]
            if len(heads) + len(new) > KEPT_ROLES:
                heads, new = {}, list(set(roles))
            heads |= zip(new, enc.encode([f"{OPEN}{escape_role(r)}\n" for r in new]), strict=True)
            bodies = enc.encode([escape(t) for t in batch.column(3).to_pylist()])
            ids, sizes, learnt = [], [], []
            for role_, body in zip(roles, bodies, strict=True):
                head = heads[role_]
                ids.append(head + body + tail)
                sizes.append(len(ids[-1]) // 4)
                learnt.append((len(head) // 4, (len(head) + len(body)) // 4) if role_ == "assistant" else (0, 0))
            ends = at + np.cumsum([0, *sizes])
            n = len(ids)
            made = (np.full(n, part), ends[:-1], np.arange(rank, rank + n), sizes, [a for a, _ in learnt], [b for _, b in learnt], ids)
            kinds = dict(list(node.items())[4:])
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in (0, 1, 4, 5)), *_rows(list(made), kinds).columns], schema=pa.schema(list(node.items())))
            at, rank = int(ends[-1]), rank + n

    # Ranges in order: each worker numbers its own nodes, and what the workers before it hold is added.
    ordered = once.repartitionByRange(parts, "key", "depth").sortWithinPartitions("key", "depth").select("conv", "depth", "role", "text", "name", "parent")
    local = ordered.mapInArrow(
        encoded, "conv long, depth int, name binary, parent binary, part int, local long, rank long, n_tokens int, loss_start int, loss_end int, ids binary"
    )
    local = materialize(local, "nodes")
    sums = local.groupBy("part").agg(F.sum("n_tokens").alias("n"), F.count("*").alias("rows")).collect()  # a row for each worker
    before, at, rank = [], 0, 0
    for r in sorted(sums):
        before.append((r["part"], at, rank))
        at, rank = at + r["n"], rank + r["rows"]
    offsets = F.broadcast(spark.createDataFrame(before, "part int, first_token long, first_rank long"))
    placed = local.join(offsets, "part").withColumns({"start": F.col("local") + F.col("first_token"), "number": F.col("rank") + F.col("first_rank")})
    # Every conversation that owns a node looks up the places of all of its turns.
    places = placed.select("name", "start", (F.col("start") + F.col("n_tokens")).alias("end"), "number", F.col("conv").alias("owner"))
    mine = stepped.select("conv", "depth", "name").join(owners.select("conv").distinct().hint("merge"), "conv", "left_semi")
    path = spread_join(mine, places, ["name"], hot_keys(owners, ["name"], total), ["conv"])
    path = path.select("conv", F.struct("depth", "start", "end", "number", (F.col("owner") == F.col("conv")).alias("own"), "name").alias("x"))
    path = path.groupBy("conv").agg(F.sort_array(F.collect_list("x")).alias("path")).select("path")
    span = pa.struct([(n, pa.int64()) for n in ("start", "end", "first", "last")])

    def ancestors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths, fields = _fields(batch.column(0))
            turns_ = zip(*fields, strict=True)
            names, attends = [], []
            for n in lengths:
                spans: tuple[tuple[int, ...], ...] = ()
                for _ in range(n):
                    _, start, end, number, own, name = next(turns_)
                    if own:
                        names.append(name)
                        attends.append([dict(zip(("start", "end", "first", "last"), x, strict=True)) for x in spans])
                    spans = _joined(spans, start, end, number)
            yield _rows([names, attends], {"name": pa.binary(), "attends": pa.list_(span)})

    found = path.mapInArrow(ancestors, "name binary, attends array<struct<start:bigint,end:bigint,first:bigint,last:bigint>>")
    nodes = placed.join(found.hint("merge"), "name").select(
        "name",
        F.when(F.length("parent") > 0, F.col("parent")).alias("parent"),
        "depth",
        "start",
        "n_tokens",
        "ids",
        "number",
        F.expr("aggregate(attends, 0L, (a, x) -> a + x.end - x.start)").alias("position_start"),
        "attends",
        "loss_start",
        "loss_end",
    )
    return nodes, conversations


def _packed(ids: list[int]) -> bytes:
    return np.array(ids, "<u4").tobytes()


def read_back(nodes: DataFrame, conversations: DataFrame, tokenizer: str = BYTE_BPE) -> DataFrame:
    """Each conversation by what its last node attends to: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars.

    The token ids of the intervals are decoded and the template is parsed;
    nothing comes from the table that was formatted.
    """
    workers_know(nodes.sparkSession)
    tree = materialize(nodes, "tree")
    leaf = conversations.join(tree.select("name", "attends", "number").hint("merge"), "name")
    # Ends at an interval's nodes as the sequence numbers them: as many rows as the conversation has turns.
    numbers = F.concat(F.flatten(F.transform("attends", lambda x: F.sequence(x["first"], x["last"]))), F.array("number"))
    wanted = materialize(leaf.select("conv", "conv_id", F.explode(numbers).alias("number")), "wanted")
    hot = hot_keys(wanted.groupBy("number").agg(F.count("*").alias("n")), ["number"], wanted.count())
    found = spread_join(wanted, tree.select("number", "start", "ids", "loss_start", "loss_end"), ["number"], materialize(hot, "hot"), ["conv"])
    parts = F.sort_array(F.collect_list(F.struct("start", "ids", "loss_start", "loss_end")))
    whole = found.groupBy("conv").agg(F.first("conv_id").alias("conv_id"), parts.alias("parts")).select("conv_id", "parts")
    schema = T.StructType([whole.schema["conv_id"]])
    for name, kind in (("n_turns", T.LongType()), ("turns_sha256", T.StringType()), ("loss_chars", T.LongType()), ("loss_sha256", T.StringType()), ("formatted_chars", T.LongType())):
        schema = schema.add(name, kind)

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoder(tokenizer)
        kinds = {"n_turns": pa.int64(), "turns_sha256": pa.string(), "loss_chars": pa.int64(), "loss_sha256": pa.string(), "formatted_chars": pa.int64()}
        for batch in batches:
            lengths, (_, ids, first, last) = _fields(batch.column(1))
            out, at = [], 0
            for n in lengths:
                formatted, learnt = [], []
                for i in range(at, at + n):
                    own = np.frombuffer(ids[i], "<u4")
                    formatted.append(enc.decode(own))
                    if last[i] > first[i]:
                        learnt.append(unescape(enc.decode(own[first[i] : last[i]])))
                at += n
                formatted, learnt = "".join(formatted), "".join(learnt)
                turns = parse(formatted)
                out.append((len(turns), _sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(learnt), _sha(learnt), len(formatted)))
            made = _rows(list(zip(*out, strict=True)) or [[]] * len(kinds), kinds)
            yield pa.RecordBatch.from_arrays([batch.column(0), *made.columns], names=["conv_id", *kinds])

    return whole.mapInArrow(decoded, schema)


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()
