import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from driftlens.llm.bfd import RoomTree, best_fit_decreasing, pack_matrix
from driftlens.llm.harmonic import cut, pack
from driftlens.llm.tokens import WordEncoder, count_tokens, encoder, spliced_ids

ODD = ["", " \n\t ", "it's DON'T we'll", "a\x1cb \x85c", "<|endoftext|> x<|startoftext|>", "é é ﬁ ß İ Σ", "漢字 かな 123 4.5", "x" * 300, "word " * 400, "one two"]


def whole(text):
    return encoder().library.encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("text", ODD)
def test_ids_are_the_library_s(text):
    assert np.frombuffer(encoder().ids(text), "<u4").tolist() == whole(text)


@settings(max_examples=300, deadline=None)
@given(st.text(st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from(" \n'stTé!<|>\x1ć")), max_size=60), st.integers(2, 20), st.integers(1, 8))
def test_windows_splice_to_the_whole(text, window, overlap):
    for cached in (False, True):
        ids = b"".join(spliced_ids(text, encoder(), window, overlap, cached))
        assert np.frombuffer(ids, "<u4").tolist() == whole(text)


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "piece_bpe_32k.model"])
def test_other_vocabularies_are_not_cut(spark, name):
    import public_tokenizers

    texts = [*ODD, "  two  blanks\n\n  and lines " * 3000]
    if name.endswith(".json"):
        from tokenizers import Tokenizer

        library = Tokenizer.from_file(public_tokenizers.path(name))
        expected = [library.encode(t, add_special_tokens=False).ids for t in texts]
    else:
        import sentencepiece

        library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(name))
        expected = [library.encode(t) for t in texts]
    assert [np.frombuffer(encoder(name).ids(t), "<u4").tolist() for t in texts] == expected
    got = {r.doc_id: r.n_tokens for r in count_tokens(rows(spark, texts), tokenizer=name).collect()}
    assert got == {i: len(ids) for i, ids in enumerate(expected)}
    docs = {i: [*ids, 2] for i, ids in enumerate(expected)}
    check_layout([r.asDict() for r in pack(rows(spark, texts), capacity=512, tokenizer=name).collect()], 512, docs)
    with pytest.raises(ValueError, match="white space"):
        WordEncoder(name)


def test_text_without_white_space_is_widened_to_the_whole():
    text = "abcdefghij" * 2000
    assert np.frombuffer(b"".join(spliced_ids(text, encoder(), 500, 20)), "<u4").tolist() == whole(text)


def rows(spark, texts):
    return spark.createDataFrame([(i, t, "x", i) for i, t in enumerate(texts)], "doc_id long, text string, lang string, N_TOKENS long")


def test_counts(spark):
    texts = [*ODD, None, "the same", "the same"]
    got = {r.doc_id: r for r in count_tokens(rows(spark, texts), limit=100).collect()}
    for i, t in enumerate(texts):
        assert (got[i].n_tokens, got[i].n_bytes, got[i].over_limit) == (len(whole(t)), len((t or "").encode()), len(whole(t)) > 100)
    assert count_tokens(rows(spark, texts).limit(0)).count() == 0


@settings(deadline=None)
@given(st.integers(1, 50_000), st.sampled_from([64, 4096, 1000]))
def test_cut_is_lossless_and_tight(tokens, capacity):
    pieces = cut(tokens, capacity)
    assert sum(pieces) == tokens and all(0 < p <= capacity for p in pieces)
    assert all(capacity - capacity // p * p <= max(capacity / 64, capacity // p) for p in pieces)


def check_layout(pieces, capacity, docs):
    sequences, owned = {}, {}
    for p in pieces:
        sequences.setdefault(p["sequence_id"], []).append((p["offset"], p["length"]))
        owned.setdefault(p["doc_id"], []).append(p)
    for own in sequences.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    for key, ids in docs.items():
        mine = sorted(owned.get(key, []), key=lambda p: p["start"])
        assert [p["start"] for p in mine] == np.cumsum([0] + [p["length"] for p in mine])[:-1].tolist()
        assert sum(p["length"] for p in mine) == len(ids)
        for p in mine:
            part = np.array(ids[p["start"] : p["start"] + p["length"]], "<u4").tobytes()
            assert p["ids_crc32"] == zlib.crc32(part) and p["doc_tokens"] == len(ids)
    return len(sequences)


def test_harmonic_packing(spark):
    texts = [*ODD, None, *(f"word {i} " * (i % 97) for i in range(300))]
    out = [r.asDict() for r in pack(rows(spark, texts).repartition(40), capacity=128).collect()]
    docs = {i: [*whole(t), 2] for i, t in enumerate(texts)}
    n = check_layout(out, 128, docs)
    total = sum(map(len, docs.values()))
    assert total / (n * 128) > 0.93
    assert pack(rows(spark, texts).limit(0)).count() == 0


def test_rows_that_repeat_or_have_no_id(spark):
    df = spark.createDataFrame([(None, "a b"), ("1", "same text"), ("1", "same text"), ("2", None)], "doc_id string, text string")
    out = pack(df).collect()
    assert sum(r.length for r in out) == 3 + 3 + 3 + 1 and {r.doc_id for r in out} == {None, "1", "2"}
    segments = [s for r in pack_matrix(df, capacity=8).collect() for s in r.segments]
    assert sorted((str(s.doc_id), s.length) for s in segments) == [("1", 3), ("1", 3), ("2", 1), ("None", 3)]


def test_matrix_round_trip(spark):
    texts = [*ODD, None, *(f"word {i} " * (i % 97) for i in range(200))]
    out = pack_matrix(rows(spark, texts), capacity=64, block=2000).collect()
    docs = {i: [*whole(t), 49407] for i, t in enumerate(texts)}
    pieces = []
    for r in out:
        ids = np.frombuffer(r.input_ids, "<u2")
        assert len(ids) == 64 and not ids[r.n_tokens :].any()
        assert r.cu_seqlens[0] == 0 and r.cu_seqlens[-1] == r.n_tokens and r.position_resets == r.cu_seqlens[:-1]
        for s, a, b in zip(r.segments, r.cu_seqlens, r.cu_seqlens[1:], strict=False):
            assert ids[a:b].tolist() == docs[s.doc_id][s.start : s.start + s.length]
            pieces.append({**s.asDict(), "sequence_id": r.sequence_id, "offset": a})
    check_layout(pieces, 64, docs)
    assert pack_matrix(rows(spark, texts).limit(0)).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 32), max_size=60))
def test_best_fit_against_brute_force(lengths):
    bins, expected = best_fit_decreasing(lengths, 32), []
    for n in sorted(lengths, reverse=True):
        room = [(r, i) for i, r in enumerate(expected) if r >= n]
        if room:
            expected[min(room)[1]] -= n
        else:
            expected.append(32 - n)
    assert sorted(32 - sum(lengths[i] for i in b) for b in bins) == sorted(expected)
    assert sorted(i for b in bins for i in b) == list(range(len(lengths)))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.booleans(), st.integers(0, 20)), max_size=80))
def test_room_tree(steps):
    tree, have = RoomTree(20), []
    for n, (put, room) in enumerate(steps):
        if put:
            tree.put(room, n)
            have.append(room)
        else:
            found, best = tree.take(room), min((r for r in have if r >= room), default=None)
            assert (found[0] if found else None) == best
            if best is not None:
                have.remove(best)
