"""Every registered query of the subpackage, over the smallest tables, against its oracle or what its contract says."""

import hashlib
import math
import zlib
from pathlib import Path

import duckdb
import numpy as np
import pandas as pd
import pytest

from driftlens.llm.chat import escape, escape_role
from driftlens.llm.queries import CONTROL_STRINGS, ORACLE_SQL, QUERIES
from driftlens.llm.tokens import encoder

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def plain(v):
    if v is None or v is pd.NaT or isinstance(v, float) and math.isnan(v):
        return "~"
    return repr(round(v, 6)) if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_matches_oracle(spark, duck, name):
    df, rel = QUERIES[name](spark, SF), duck.sql(ORACLE_SQL[name])
    assert sorted(rel.columns) == sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in rel.columns) for r in df.collect())
    assert got == sorted(tuple(map(plain, r)) for r in rel.fetchall())


@pytest.fixture(scope="module")
def texts(duck):
    return dict(duck.sql("SELECT doc_id, coalesce(text, '') FROM documents").fetchall())


@pytest.fixture(scope="module")
def ids(texts):
    return {d: encoder().library.encode(t, add_special_tokens=False).ids for d, t in texts.items()}


def test_token_counts(spark, texts, ids):
    got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in QUERIES["op2_token_counts"](spark, SF).collect()}
    assert got == {d: (len(texts[d].encode()), len(i), len(i) > 2048) for d, i in ids.items()}


def test_conversations(spark, duck):
    rows = duck.sql("SELECT conv_id, turn, role, coalesce(text, '') FROM conversations ORDER BY conv_id, turn").fetchall()
    rows += [(-1, 0, "user", CONTROL_STRINGS), (-1, 1, "assistant", CONTROL_STRINGS)]
    turns = {}
    for c, _, role, text in rows:
        turns.setdefault(c, []).append((role, text))
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    expected = set()
    for c, own in turns.items():
        learnt = "".join(x for r, x in own if r == "assistant")
        shown = sum(len(f"<|im_start|>{escape_role(r)}\n{escape(x)}<|im_end|>\n") for r, x in own)
        expected.add((c, len(own), sha("".join(f"{r}\n{x}\n" for r, x in own)), len(learnt), sha(learnt), shown))
    assert {tuple(r) for r in QUERIES["op4_chat_prefix_tree"](spark, SF).collect()} == expected


def test_pieces(spark, ids):
    out = pd.DataFrame([r.asDict() for r in QUERIES["op5_harmonic_packing"](spark, SF).collect()])
    for d, own in out.sort_values("start").groupby("doc_id"):
        whole = [*ids[d], 2]
        assert own.start.tolist() == np.cumsum([0, *own.length])[:-1].tolist() and own.length.sum() == len(whole)
        for p in own.itertuples():
            assert p.ids_crc32 == zlib.crc32(np.array(whole[p.start : p.start + p.length], "<u4").tobytes()) and p.doc_tokens == len(whole)
    assert set(out.doc_id) == set(ids)
    for _, own in out.sort_values("offset").groupby("sequence_id"):
        assert own.offset.tolist() == np.cumsum([0, *own.length])[:-1].tolist() and own.length.sum() <= 4096


def test_shards(spark, texts):
    out = pd.DataFrame([r.asDict() for r in QUERIES["op7_kd_sharding"](spark, SF).collect()])
    assert sorted(out.doc_id) == sorted(texts) and set(out.law) == {"bytes"} and out.grown_shard.isna().all()
    assert all((r.size_, r.text_crc32) == (len(texts[r.doc_id].encode()) + 1, zlib.crc32(texts[r.doc_id].encode())) for r in out.rename(columns={"size": "size_"}).itertuples())
    sums = out.groupby("shard")["size"].sum()
    assert sums.index.tolist() == list(range(8)) and sums.max() - sums.min() <= 3 * out["size"].max()
    assert all(sorted(g.slot) == list(range(len(g))) for _, g in out.groupby("shard"))


def test_near_duplicates_hold_their_copies(spark, texts):
    out = {r.doc_id: r for r in QUERIES["op3_order_minhash"](spark, SF).collect()}
    assert out.keys() == texts.keys()
    first = {}
    for d in sorted(texts):
        if texts[d].split():
            assert out[d].exact_id <= first.setdefault(texts[d], d) and out[out[d].class_id].class_id == out[d].class_id


def test_lines_and_matrix(spark, texts, ids):
    for r in QUERIES["op6_line_dedup"](spark, SF).collect():
        left = [x for i, x in enumerate(texts[r.doc_id].split("\n")) if i not in set(r.removed_lines)]
        assert (r.text or "") == "\n".join(left) and r.n_removed == len(r.removed_lines)
    held = dict.fromkeys(ids, 0)
    for r in QUERIES["op9_token_matrix"](spark, SF).collect():
        row = np.frombuffer(r.input_ids, "<u2")
        for s, a, b in zip(r.segments, r.cu_seqlens, r.cu_seqlens[1:], strict=False):
            assert row[a:b].tolist() == [*ids[s.doc_id], 49407][s.start : s.start + s.length]
            held[s.doc_id] += s.length
    assert held == {d: len(i) + 1 for d, i in ids.items()}
