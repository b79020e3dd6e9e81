"""Similarity join by group counts: bounds, directory and components against all pairs."""

from __future__ import annotations

import random

import numpy as np
import pytest

from wiregrain.llm import countjoin as C
from wiregrain.session import Scratch


def brute_set(text, words=4):
    found = ("" if text is None else text).encode().lower().split()
    return {tuple(found[i : i + words]) for i in range(max(len(found) - words + 1, 1))} if found else set()


def linked(a, b, percent=85):
    return bool(a) and bool(b) and 100 * len(a & b) >= percent * len(a | b)


def brute_components(sets, percent=85):
    label = list(range(len(sets)))
    for i in range(len(sets)):
        for j in range(i):
            if label[i] != label[j] and linked(sets[i], sets[j], percent):
                low, high = sorted((label[i], label[j]))
                label = [low if x == high else x for x in label]
    return label


def planted(seed=1):
    """Texts of 1 to 400 words with chains of copies in which ever more words differ, short texts, and a shared passage."""
    rng = random.Random(seed)
    texts = []
    for i in range(50):
        n = rng.choice([3, 5, 8, 9, 12, 30, 60, 120, 400])
        base = [f"w{rng.randrange(400)}" for _ in range(n)]
        texts.append(" ".join(base))
        for j in range(rng.randrange(5)):
            at = rng.randrange(len(base))
            base[at : at + rng.randrange(2)] = [f"new{i}x{j}"] * rng.randrange(1, 3)
            if rng.random() < 0.3:
                base = base[: max(len(base) - len(base) // 12, 1)]
            texts.append(" ".join(base))
    passage = " ".join(f"passage{i}" for i in range(40))
    texts += [f"{passage} {' '.join(f'own{k}y{i}' for i in range(k % 14))}" for k in range(60)]
    return [*texts, None, "", " \t", "One two", "one TWO", "two one", "é É", "É É", "a b c d", "a b c d e", texts[0], texts[0].upper()]


def table(spark, texts):
    return spark.createDataFrame([(i, t, "clash", "clash") for i, t in enumerate(texts)], "doc_id long, text string, cid string, cell string").repartition(5)


@pytest.mark.parametrize("percent", [60, 85])
def test_linked_sets_share_a_signature(percent):
    rng = random.Random(3)
    for _ in range(300):
        n = rng.randrange(1, 90)
        one = [rng.randrange(1 << 62) for _ in range(n)]
        two = one[: n - rng.randrange(n // 3 + 1)] + [rng.randrange(1 << 62) for _ in range(rng.randrange(n // 3 + 1))]
        a, b = (np.unique(np.array(x, np.uint64)) for x in (one, two))
        if set(a) != set(b) and linked(set(a.tolist()), set(b.tolist()), percent):
            owner, signature = C.signatures([a, b], percent)
            assert set(signature[owner == 0]) & set(signature[owner == 1])


def test_summed_minima_bound_the_overlap():
    rng = np.random.default_rng(1)
    for n, m in ((5, 9), (100, 140), (3000, 2500)):
        pool = rng.integers(0, 1 << 62, n + m, dtype=np.uint64)
        a, b = np.unique(pool[:n]), np.unique(np.concatenate((pool[: m // 2], pool[n : n + m // 2])))
        p, q = C.point(a), C.point(b)
        width = C._width((p, q))
        x, y = C._matrix([p], np.array([len(a)]), width)[0], C._matrix([q], np.array([len(b)]), width)[0]
        assert np.minimum(x, y).sum() >= len(np.intersect1d(a, b)) and x.sum() == len(a)


def test_tree_pairs_equal_all_pairs():
    rng = np.random.default_rng(2)
    for n, m in ((1, 1), (1, 30), (9, 70), (64, 65)):
        make = lambda k: np.where(rng.random((k, 9)) < 0.5, 5, rng.integers(3, 7, (k, 9))).astype(np.int32)
        one, two = make(n), make(m)
        first, second = np.arange(n) % 4, np.arange(m) % 3
        ok = lambda x, y: np.minimum(x, y).sum() * 185 >= 85 * (x.sum() + y.sum()) and min(x.sum(), y.sum()) * 100 >= 85 * max(x.sum(), y.sum())
        tree = lambda v, r: C.Tree(v.sum(axis=1).astype(np.int64), v, r)
        a, b = C.tree_pairs(tree(one, first), tree(two, second), 85)
        expected = {(i, j) for i in range(n) for j in range(m) if first[i] != second[j] and ok(one[i], two[j])}
        assert set(zip(a.tolist(), b.tolist(), strict=True)) == expected and len(a) == len(expected)
        a, b = C.tree_pairs(tree(one, first), tree(two, second), 85, best=2)
        assert set(zip(a.tolist(), b.tolist(), strict=True)) <= expected
        assert all(sum(i == x for i in a.tolist()) >= min(2, sum(i == x for i, _ in expected)) for x in range(n))
        own = tree(two, second)
        a, b = C.tree_pairs(own, own, 85)
        expected = {(i, j) for j in range(m) for i in range(j) if second[i] != second[j] and ok(two[i], two[j])}
        assert set(zip(a.tolist(), b.tolist(), strict=True)) == expected


@pytest.mark.parametrize("page_rows", [C.PAGE_ROWS, 4])
def test_components_equal_all_pairs(spark, page_rows, monkeypatch):
    texts = planted()
    sets = [brute_set(t) for t in texts]
    if page_rows == 4:  # every cell's first class by the way of hot cells, every pair in a task of its own, no broadcast
        monkeypatch.setattr(C, "_HOT_ROWS", 0)
        monkeypatch.setattr(C, "_HOT_CELLS", 1 << 60)
        monkeypatch.setattr(C, "_PAIRS", 1)
        monkeypatch.setattr(C, "_BROADCAST_ROWS", 0)
    with Scratch(spark) as scratch:
        found = {r.doc_id: (r.n_shingles, r.component_id) for r in C.jaccard_groups(table(spark, texts), scratch, page_rows=page_rows).collect()}
    assert found == {i: (len(s), c) for i, (s, c) in enumerate(zip(sets, brute_components(sets), strict=True))}


def test_trees_find_what_stars_miss(spark):
    """Two ends of one cell that are linked with each other but not with the cell's first member."""
    rng = random.Random(9)
    base = [f"w{i}" for i in range(200)]
    far = base[:100] + [f"x{i}" for i in range(100)]
    texts = [" ".join(base)]
    for i in range(24):
        copy = list(far)
        copy[150 + i] = f"y{rng.randrange(10**9)}"
        texts.append(" ".join(copy))
    sets = [brute_set(t) for t in texts]
    with Scratch(spark) as scratch:
        found = C.jaccard_groups(table(spark, texts), scratch, page_rows=3).collect()
    assert [r.component_id for r in sorted(found)] == brute_components(sets)


def test_few_pairs_of_near_copies_are_checked(spark, monkeypatch):
    """Near copies that are mostly no links: 7140 pairs, of which points must let only few pass."""
    rng = random.Random(4)
    base = [f"w{i}" for i in range(150)]
    texts = []
    for i in range(120):
        copy = list(base)
        for j in range(2):
            copy[rng.randrange(150)] = f"x{i}y{j}"
        texts.append(" ".join(copy))
    sets = [brute_set(t) for t in texts]
    checked, verified = [], C._verified

    def counted(pairs, *rest):
        checked.append(pairs.count())
        return verified(pairs, *rest)

    monkeypatch.setattr(C, "_verified", counted)
    with Scratch(spark) as scratch:
        found = C.jaccard_groups(table(spark, texts), scratch).collect()
    expected = brute_components(sets)
    assert [r.component_id for r in sorted(found)] == expected
    assert len(set(expected)) > 20 and sum(checked) < 1200, checked


def test_odd_rows(spark):
    rows = [(None, "a b c d e f g h i j"), (None, "a b c d e f g h i j"), (7, "a b c d e f g h i j"), (7, "a b c d e f g h i j"), (None, "alone here"), (3, None), (3, ""), (9, "x " * 30000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    with Scratch(spark) as scratch:
        found = sorted(map(str, ((r.doc_id, r.n_shingles, r.component_id) for r in C.jaccard_groups(docs, scratch).collect())))
        none = C.jaccard_groups(docs.filter("false"), scratch).collect()
    expected = [(None, 7, 7), (None, 7, 7), (7, 7, 7), (7, 7, 7), (None, 1, None), (3, 0, 3), (3, 0, 3), (9, 1, 9)]
    assert found == sorted(map(str, expected)) and none == []


def test_query_on_whole_table(spark):
    from wiregrain.llm.queries import QUERIES

    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet").orderBy("doc_id").select("doc_id", "text").collect()
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in QUERIES["op13_ngram_jaccard_join"](spark, folder).collect()}
    sets = [brute_set(r.text) for r in docs]
    expected = {r.doc_id: (len(s), docs[c].doc_id) for r, s, c in zip(docs, sets, brute_components(sets), strict=True)}
    assert found == expected
