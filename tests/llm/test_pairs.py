import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from driftlens.llm.components import components
from driftlens.llm.decontam import find_leaks, orders_and_hits, without_leaks
from driftlens.llm.omh import label_occurrences, near_duplicates, one_of_each, order_minhash
from driftlens.llm.shingles import _chain_at_least, _table_at_least, lcs_at_least, shingle_hashes, similar, word_hashes, words


def brute_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(max(row[j + 1], new[j], row[j] + (x == y)))
        row = new
    return row[-1]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 3), min_size=1, max_size=18), st.lists(st.integers(0, 3), min_size=1, max_size=18))
def test_alignment_against_brute_force(a, b):
    n, x, y = brute_lcs(a, b), np.array(a, "u4"), np.array(b, "u4")
    assert all(lcs_at_least(x, y, need) == (n >= need) for need in range(20))
    assert similar(x, y) == (n / (len(a) + len(b) - n) >= 0.8 - 1e-12)
    order = np.argsort(y, kind="stable")
    places = order.tolist(), np.searchsorted(y[order], x, "left").tolist(), np.searchsorted(y[order], x, "right").tolist()
    for need in range(1, min(len(a), len(b)) + 1):
        assert _table_at_least(x, y, need) == _chain_at_least(*places, len(a) - need, len(b) - need, need) == (n >= need)


def test_whole_books_align():
    rng = np.random.default_rng(4)
    a = rng.integers(0, 2**32, 400_000).astype("u4")
    b = np.delete(a, rng.choice(len(a), 20_000, replace=False))
    assert similar(a, b) and not similar(a, np.concatenate([b, rng.integers(0, 2**32, 100_000).astype("u4")]))
    again = np.tile(a[:50], 60)  # a text that repeats itself
    assert similar(again, np.delete(again, [7, 900]), 0.99) and not similar(again, np.roll(again[::-1], 3), 0.99)


def test_sketches_know_order_and_repeats():
    a = shingle_hashes(word_hashes([f"w{i}" for i in range(80)]))
    assert (order_minhash(a) == order_minhash(a.copy())).all()
    assert (order_minhash(a) != order_minhash(a[::-1].copy())).any()
    assert len(np.unique(label_occurrences(np.array([5, 5, 7, 5], "u8")))) == 4


def corpus():
    rng = random.Random(11)
    fresh = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    passage = fresh(60)
    texts = []
    for _ in range(6):  # groups of near copies around a base, and their copies
        base = fresh(rng.randint(120, 260))
        texts += [" ".join(base)] * 2
        for _ in range(25):
            own = list(base)
            for _ in range(rng.randint(1, 3)):
                own[rng.randrange(len(own))] = f"new{rng.randrange(10**6)}"
            texts.append(" ".join(own))
    texts += [" ".join([*fresh(60), *passage, *fresh(60)]) for _ in range(80)]  # one passage in many texts
    texts += [" ".join(fresh(150)) for _ in range(40)] + ["short one", "short one", "a b c d e f g h", "a b c d e f g h i", "", "...", None]
    rng.shuffle(texts)
    return list(enumerate(texts))


def brute_classes(docs):
    sh = {d: (shingle_hashes(word_hashes(words(t))) >> np.uint64(32)).astype("u4") for d, t in docs}
    parent = {d: d for d, _ in docs}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = [d for d, _ in docs if len(sh[d])]
    for k, a in enumerate(ids):
        for b in ids[:k]:
            if similar(sh[a], sh[b]):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {d: find(d) for d, _ in docs}


def test_classes_against_brute_force(spark):
    docs = corpus()
    df = spark.createDataFrame([(d, t, 1) for d, t in docs], "doc_id long, text string, NODE int")
    expected = brute_classes(docs)
    got = {r.doc_id: r for r in near_duplicates(df).collect()}
    assert {d: r.class_id for d, r in got.items()} == expected
    sizes = {c: sum(v == c for v in expected.values()) for c in expected.values()}
    assert all(r.class_size == sizes[r.class_id] for r in got.values())
    kept = one_of_each(df)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == sorted(set(expected.values()))


def test_pairs_in_large_buckets(spark):
    # Each pair is at 0.81, and all texts are near 0.78: what a pair shares lies in buckets of many.
    rng = random.Random(3)
    fresh = lambda n: [f"w{rng.randrange(10**9)}" for _ in range(n)]
    core, texts = fresh(144), []
    for _ in range(60):
        shared = fresh(3)
        texts += [" ".join([*core, *shared, *fresh(17)]) for _ in range(2)]
    docs = list(enumerate(texts))
    expected = brute_classes(docs)
    assert expected == {d: d - d % 2 for d, _ in docs}
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert {r.doc_id: r.class_id for r in near_duplicates(df).collect()} == expected


def test_pairs_in_small_buckets(spark):
    # x and y share no two sketches 1, 3 or 7 apart, and z, better connected, is in each bucket that they share.
    rng = random.Random(0)
    fresh = lambda n: [f"w{rng.randrange(10**9)}" for _ in range(n)]
    sketches = lambda w: order_minhash(shingle_hashes(word_hashes(w)))
    near = lambda *pair: similar(*((shingle_hashes(word_hashes(w)) >> np.uint64(32)).astype("u4") for w in pair))
    texts = []
    while len(texts) < 18:
        core = fresh(147)
        x, y = [*core, *fresh(17)], [*core, *fresh(17)]
        same = np.flatnonzero(sketches(x) == sketches(y))
        if not len(same) or any((b + d) % 32 in same for b in same for d in (1, 3, 7)):
            continue
        for _ in range(3000):
            at, cut = rng.randrange(125), rng.randint(1, 8)
            z = [*core[:at], *fresh(cut), *core[at + cut :], *fresh(17)]
            if not near(x, z) and not near(y, z) and (sketches(z)[same] == sketches(x)[same]).all():
                texts += [" ".join(w) for w in (x, y, z, *([*z[:-1], *fresh(1)] for _ in range(3)))]
                break
    docs = list(enumerate(texts))
    expected = brute_classes(docs)
    assert expected == {d: d - d % 6 + 2 * (d % 6 > 1) for d, _ in docs}
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert {r.doc_id: r.class_id for r in near_duplicates(df).collect()} == expected


def test_other_thresholds_and_ids(spark):
    rng = random.Random(6)
    fresh = lambda n: [f"w{rng.randrange(10**9)}" for _ in range(n)]
    rows = []
    for i in range(40):
        base = fresh(31)  # 27 shingles, and 14 of them
        rows += [(f"{i:02}a", " ".join(base)), (f"{i:02}b", " ".join(base[:18]))]
    df = spark.createDataFrame([*rows, ("b", None)], "doc_id string, text string")
    got = {r.doc_id: r.class_id for r in near_duplicates(df, least=0.5).collect()}
    assert got == {d: d[:2] + "a" for d, _ in rows} | {"b": "b"}
    assert {r.class_size for r in near_duplicates(df).collect()} == {1}
    assert one_of_each(df, least=0.5).count() == 41
    with pytest.raises(ValueError, match="similarity"):
        near_duplicates(df, least=0.2)


def test_hot_texts_buckets_and_centres_are_dealt(spark, monkeypatch):
    from driftlens.llm import common

    monkeypatch.setattr(common, "HOT_LEAST", 4)
    docs = [(d, t) for d, t in corpus()]
    docs += [(1000 + i, docs[0][1]) for i in range(30)]
    expected = brute_classes(docs)
    assert {r.doc_id: r.class_id for r in near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()} == expected


def test_odd_rows_of_near_duplicates(spark):
    text = " ".join(f"w{i}" for i in range(50))
    df = spark.createDataFrame([(None, text), (7, text), (7, text), (8, None), (None, None), (9, "")], "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.class_id or 0, r.class_size) for r in near_duplicates(df).collect())
    assert got == [(0, 0, 1), (0, 7, 3), (7, 7, 3), (7, 7, 3), (8, 8, 1), (9, 9, 1)]
    assert sorted((r.doc_id or 0) for r in one_of_each(df).collect()) == [0, 7, 8, 9]
    assert near_duplicates(df.limit(0)).count() == 0 and one_of_each(df.limit(0)).count() == 0


def test_components(spark):
    rng = random.Random(2)
    pairs = [(f"{i:03}", f"{i + 1:03}") for i in range(40)] + [(f"x{rng.randrange(30):02}", f"x{rng.randrange(30):02}") for _ in range(25)]
    got = {r.node: r.label for r in components(spark.createDataFrame(pairs, "a string, b string")).collect()}
    parent = {n: n for p in pairs for n in p}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        x, y = sorted((find(a), find(b)))
        parent[y] = x
    assert got == {n: find(n) for n in parent}


def test_orders_follow_from_the_containment(spark):
    assert orders_and_hits(0.8) == (24, 6) and orders_and_hits(1.0) == (24, 24)
    assert all(1 <= h <= n for n, h in map(orders_and_hits, (0.05, 0.3, 0.5, 0.95)))
    rng = random.Random(7)
    own = lambda k: [f"w{rng.randrange(10**9)}" for _ in range(k)]
    items = [(f"i{i}", " ".join(own(100))) for i in range(60)]
    docs = [(f"d{i}", " ".join([*own(50), *t.split()[:40], *own(50)])) for i, (_, t) in enumerate(items)] + [("long", "z " * 500_000 + items[0][1]), ("long", None)]
    df, bench = spark.createDataFrame(docs, "doc_id string, text string"), spark.createDataFrame(items, "item_id string, text string")
    got = sorted((r.doc_id, r.item_id) for r in find_leaks(df, bench, least=0.3).collect())
    assert got == sorted([(f"d{i}", f"i{i}") for i in range(60)] + [("long", "i0")])


def test_leaks_against_brute_force(spark):
    rng = random.Random(4)
    vocabulary = [f"v{i}" for i in range(300)]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.randint(1, 60)))) for i in range(40)] + [(40, ""), (41, None), (None, "q q q q q q")]
    docs = []
    for d in range(120):
        own = rng.choices(vocabulary, k=rng.randint(0, 400))
        if d % 3 == 0:
            item = words(rng.choice(items[:40])[1])
            item = [w.upper() if rng.random() < 0.3 else w for w in item]
            if d % 2:
                item = item[: max(1, int(len(item) * rng.uniform(0.6, 1)))]
            at = rng.randrange(len(own) + 1)
            own[at:at] = item
        docs.append((d, ", ".join(own)))
    docs += [(200, None), (201, ""), (None, items[0][1]), (202, "q Q q q q q")]
    df = spark.createDataFrame([(d, t, "u") for d, t in docs], "doc_id long, text string, BODY string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    expected = []
    for d, t in docs:
        w = words(t)
        for i, q in items:
            s = words(q)
            k = min(5, len(s))
            if not k:
                continue
            q_set, d_set = ({tuple(x[j : j + k]) for j in range(len(x) - k + 1)} for x in (s, w))
            if len(q_set & d_set) >= 0.8 * len(q_set):
                expected.append((d, i, len(q_set & d_set)))
    key = lambda x: tuple(-1 if v is None else v for v in x)
    got = [(r.doc_id, r.item_id, r.n_shared) for r in find_leaks(df, bench).collect()]
    assert sorted(got, key=key) == sorted(expected, key=key)
    kept = without_leaks(df, bench)
    assert kept.columns == df.columns
    assert sorted((r.doc_id for r in kept.collect()), key=lambda x: -1 if x is None else x) == sorted((d for d, _ in docs if d not in {e[0] for e in expected}), key=lambda x: -1 if x is None else x)
    assert find_leaks(df, bench.limit(0)).count() == 0 and find_leaks(df.limit(0), bench).count() == 0
