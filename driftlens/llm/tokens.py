"""Token counts of whole texts by overlap resynchronisation.

A huge text is encoded in overlapping windows, with the library's offsets. Two
neighbouring windows are spliced at a boundary that both encodings have, that
follows white space (which the pre-tokenizer never crosses) and whose
surrounding words got the same ids in both. Where the overlap holds no such
boundary it is widened, in the end to the rest of the text, so the result always
equals one encoding of the whole. A vocabulary file whose rules are not known to
stop at white space has no proven boundary: its texts are encoded in one call.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftlens.llm.common import fresh, workers_know

WORD_BPE = "word_bpe_49k.json"
#: Characters of a window, and by how many neighbours overlap at first.
WINDOW, OVERLAP = 32_768, 512
#: Words whose ids a worker keeps, and the longest that it keeps.
KEPT_WORDS, KEPT_CHARS = 600_000, 64

#: Python splits here, but the tokenizer takes these for symbols.
_NOT_SPACE = re.compile("[\x1c-\x1f]")
#: What Python splits at, without those four.
_SPACES = re.compile(r"[^\S\x1c-\x1f]+")
#: Words whose normal form and pre-tokens are certain: ASCII and Latin-1 letters, digits and marks.
_PLAIN = re.compile("[A-Za-z0-9À-ÖØ-öø-ÿ!#-;=?-{}~]+")
_PIECE = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9]+")
_LETTERS = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]+")


#: Rules under which the ids of a text are those of its words (fixed values of the vocabulary files).
_WORD_RULES = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
    "post_processor": None,
}


def splits_at_space(path: str) -> bool:
    """Whether a vocabulary file has those rules, and no added token that takes white space."""
    if not path.endswith(".json"):
        return False
    with open(path, encoding="utf-8") as f:
        own = json.load(f)
    plain = all(not (t["lstrip"] or t["rstrip"] or re.search(r"\s", t["content"])) for t in own.get("added_tokens", []))
    return plain and all(own.get(k) == v for k, v in _WORD_RULES.items())


def tokenizer_path(name: str) -> str:
    """The place of a vocabulary file: a path as it is, a bare name by the installed package."""
    if os.sep in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_chars() -> dict[int, str]:
    """The printable stand-in that byte-level vocabularies use for each byte."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class WholeEncoder:
    """Ids as the library gives them for the whole text in one call: for any vocabulary file."""

    def __init__(self, name: str) -> None:
        path = tokenizer_path(name)
        if path.endswith(".model"):
            import sentencepiece

            pieces = sentencepiece.SentencePieceProcessor(model_file=path)
            self.vocab_size, self._encode = pieces.get_piece_size(), pieces.encode
        else:
            found = library(path)
            self.vocab_size = found.get_vocab_size()
            self._encode = lambda text: found.encode(text, add_special_tokens=False).ids

    def ids(self, text: str | None) -> bytes:
        return np.array(self._encode(text or ""), "<u4").tobytes()


def library(path: str):
    """The tokenizers library's own encoder of a vocabulary file, without truncation and padding."""
    from tokenizers import Tokenizer

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    found = Tokenizer.from_file(path)
    found.no_truncation()
    found.no_padding()
    return found


class WordEncoder:
    """Ids of texts as the tokenizers library gives them, word by word, with a bounded cache.

    Only for vocabularies that splits_at_space knows: the ids of a text are
    those of its words. Words of plain letters and marks go straight to the
    library's model; all others go through the whole library.
    """

    def __init__(self, name: str = WORD_BPE) -> None:
        path = tokenizer_path(name)
        if not splits_at_space(path):
            raise ValueError(f"{name}: its rules are not known to stop at white space")
        self.library = library(path)
        self.vocab_size = self.library.get_vocab_size()
        self.model = self.library.model
        self.bytes = _byte_chars()
        self.four = [i.to_bytes(4, "little") for i in range(self.library.get_vocab_size())]
        self.kept: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}

    def _piece(self, piece: str) -> bytes:
        ids = self.pieces.get(piece)
        if ids is None:
            spelled = piece if piece.isascii() else "".join(map(self.bytes.__getitem__, piece.encode()))
            ids = b"".join([self.four[t.id] for t in self.model.tokenize(spelled)])
            if len(self.pieces) < KEPT_WORDS and len(piece) <= KEPT_CHARS:
                self.pieces[piece] = ids
        return ids

    def _learn(self, words: set[str]) -> dict[str, bytes]:
        found, rest = {}, []
        for word in words:
            # most new words are letters, or letters and one mark
            if _LETTERS.fullmatch(word):
                found[word] = self._piece(word.lower())
            elif word[-1] in ".,!" and _LETTERS.fullmatch(word, 0, len(word) - 1):
                found[word] = self._piece(word[:-1].lower()) + self._piece(word[-1])
            elif _PLAIN.fullmatch(word):
                found[word] = b"".join(map(self._piece, _PIECE.findall(word.lower())))
            else:
                rest.append(word)
        if rest:
            for word, e in zip(rest, self.library.encode_batch_fast(rest, add_special_tokens=False), strict=True):
                found[word] = b"".join(map(self.four.__getitem__, e.ids))
        room = KEPT_WORDS - len(self.kept)
        if room > 0:
            self.kept.update(found if len(found) <= room and max(map(len, found)) <= KEPT_CHARS else [(w, i) for w, i in list(found.items())[:room] if len(w) <= KEPT_CHARS])
        return found

    def words(self, text: str) -> list[str]:
        return [w for w in _SPACES.split(text) if w] if _NOT_SPACE.search(text) else text.split()

    def word_ids(self, words: list[str]) -> list[bytes]:
        """For each word its ids, as little-endian unsigned 32-bit numbers."""
        ids = list(map(self.kept.get, words))
        if None in ids:
            new = self._learn({w for w, i in zip(words, ids, strict=True) if i is None})
            ids = [new[w] if i is None else i for w, i in zip(words, ids, strict=True)]
        return ids

    def ids(self, text: str | None) -> bytes:
        return b"".join(self.word_ids(self.words(text or "")))

    def with_offsets(self, text: str) -> tuple[list[int], list[bytes]]:
        """Where the words of a window start by the library's offsets, and the ids from each to the next."""
        found = self.library.encode(text, add_special_tokens=False)
        starts, first, last = [], [], -1
        for i, (start, _) in enumerate(found.offsets):
            # Bytes of one character share its offset.
            if start != last and (start == 0 or _SPACES.fullmatch(text[start - 1])) or not i:
                starts.append(start)
                first.append(4 * i)
            last = start
        ids = np.array(found.ids, "<u4").tobytes()
        return starts, [ids[a:b] for a, b in zip(first, [*first[1:], len(ids)], strict=True)]

    def with_places(self, text: str) -> tuple[list[int], list[bytes]]:
        """The same word by word, from the cache."""
        spans = [m.span() for m in re.finditer(r"(?:\S|[\x1c-\x1f])+", text)]
        return [a for a, _ in spans], self.word_ids([text[a:b] for a, b in spans])


Encoder = WordEncoder | WholeEncoder
_encoders: dict[str, Encoder] = {}


def encoder(name: str = WORD_BPE) -> Encoder:
    """One encoder for each worker process and vocabulary file, whatever its rules."""
    if name not in _encoders:
        _encoders[name] = WordEncoder(name) if splits_at_space(tokenizer_path(name)) else WholeEncoder(name)
    return _encoders[name]


def whole_ids(text: str | None, enc: Encoder) -> bytes:
    """The ids of a whole text, in memory of the ids and a few windows."""
    return b"".join(spliced_ids(text or "", enc, cached=True))


def splice(left: tuple[list[int], list[bytes]], right: tuple[list[int], list[bytes]]) -> tuple[int, int] | None:
    """Where the left window may end and the right one begin, as indexes; None without a stable place.

    Both give absolute starts. Stable: a word that both windows start at one
    place, with the same ids, whose next word also starts at one place in both.
    The one in the middle of the overlap is taken.
    """
    at = {start: i for i, start in enumerate(left[0])}
    stable = [
        (at[start], j)
        for j, start in enumerate(right[0][:-1])
        if start in at
        and at[start] + 1 < len(left[0])
        and left[0][at[start] + 1] == right[0][j + 1]
        and left[1][at[start]] == right[1][j]
        and j  # the first word of a window may be the rest of one that the cut has split
    ]
    return stable[len(stable) // 2] if stable else None


def spliced_ids(text: str, enc: Encoder, window: int = WINDOW, overlap: int = OVERLAP, cached: bool = False) -> Iterator[bytes]:
    """The ids of a text in order, window by window, in memory of a few windows.

    Windows are encoded by the library, or word by word from the cache.
    """
    if len(text) <= window or isinstance(enc, WholeEncoder):
        yield enc.ids(text)
        return
    one = enc.with_places if cached else enc.with_offsets

    def encoded(start: int, end: int) -> tuple[list[int], list[bytes]]:
        starts, ids = one(text[start:end])
        return [start + s for s in starts], ids

    end, left = window, encoded(0, window)
    while end < len(text):
        wide, cut, begin = overlap, None, end
        first = left[0][0] if left[0] else end
        while cut is None and begin > first:
            begin, stop = max(end - wide, first), min(len(text), end + window)
            right = encoded(begin, stop)
            cut = splice(left, right)
            wide *= 2
        if cut is None:  # no boundary in the whole left window: it is encoded anew, with twice the text
            end = min(len(text), end + max(window, end - first))
            left = encoded(first, end)
            continue
        yield b"".join(left[1][: cut[0]])
        left, end = (right[0][cut[1] :], right[1][cut[1] :]), stop
    yield b"".join(left[1])


def count_tokens(
    docs: DataFrame,
    text: str = "text",
    tokenizer: str = WORD_BPE,
    window: int = WINDOW,
    overlap: int = OVERLAP,
    limit: int = 2048,
) -> DataFrame:
    """docs without the text, plus n_bytes, n_tokens (long) and over_limit (n_tokens > limit).

    n_tokens is what one call of the library on the whole text gives, without
    added special tokens, whatever the vocabulary file (.json by tokenizers,
    .model by sentencepiece). Null and empty texts count 0 of both. Each row is
    counted for itself: repeated rows, nulls in other columns and empty tables
    need no rule. An own column of one of the new names is replaced.
    """
    workers_know(docs.sparkSession)
    new = ["n_bytes", "n_tokens", "over_limit"]
    kept = [c for c in docs.columns if c != text and c.lower() not in new]
    body = fresh(docs, "body")
    rows = docs.select(*kept, F.col(text).alias(body))
    schema = T.StructType(
        [rows.schema[c] for c in kept]
        + [T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("over_limit", T.BooleanType())]
    )

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        for batch in batches:
            column = batch.column(len(kept))
            n_tokens, n_bytes = np.zeros(len(column), "i8"), np.zeros(len(column), "i8")
            for i, value in enumerate(column):
                if body := value.as_py():
                    n_bytes[i] = len(body.encode())
                    n_tokens[i] = sum(map(len, spliced_ids(body, enc, window, overlap))) // 4
            yield pa.RecordBatch.from_arrays(
                [batch.column(i) for i in range(len(kept))] + [pa.array(n_bytes), pa.array(n_tokens), pa.array(n_tokens > limit)],
                names=schema.names,
            )

    return rows.mapInArrow(counted, schema)
