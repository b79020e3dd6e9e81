"""Fingerprints, trie self-join and components against brute force."""

from __future__ import annotations

import random

import numpy as np
import pytest
import xxhash

from wiregrain.llm import simhash as S
from wiregrain.session import Scratch


def brute_print(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        lowered = lowered.replace(c, " ")
    words = [w for w in lowered.split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints):
    label = list(range(len(prints)))
    for i in range(len(prints)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= 4 and label[i] != label[j]:
                old, new = max(label[i], label[j]), min(label[i], label[j])
                label = [new if x == old else x for x in label]
    return label


@pytest.mark.parametrize("text", [None, "", " \n", "A", "a b c", "a b c d", "One two three FOUR\tfive Élan six", "x " * 70000])
def test_fingerprint(text):
    assert S.simhash((text or "").encode()) == brute_print(text)


def planted(seed, n=300):
    rng = random.Random(seed)
    prints = [0, 0xF, 0x1F]
    while len(prints) < n:
        if rng.random() < 0.5:
            prints.append(rng.getrandbits(64))
        else:
            x = rng.choice(prints)
            for _ in range(rng.randrange(1, 7)):
                x ^= 1 << rng.randrange(64)
            prints.append(x)
    return sorted(set(prints))


@pytest.mark.parametrize("held", [1 << 21, 4])
def test_components_equal_brute_force(spark, held):
    prints = planted(3)
    rows = [(i, int(np.uint64(p).astype(np.int64))) for i, p in enumerate(prints)]
    with Scratch(spark) as scratch:
        links = S.near_links(spark.createDataFrame(rows, "doc_id long, fingerprint long"), 4, held)
        stars = {r.node: r.root for r in S.star_components(links, scratch).collect()}
    expected = brute_components(prints)
    group, theirs = {}, {}
    for (_, p), e in zip(rows, expected, strict=True):
        assert group.setdefault(stars.get(p, p), e) == e
        assert theirs.setdefault(e, stars.get(p, p)) == stars.get(p, p)


def test_dense_group_is_one_component():
    prints = np.unique(np.random.default_rng(1).integers(0, 1 << 18, 60000).astype(np.uint64))
    label = S.trie_links(prints, np.array([0, len(prints)]), np.array([0]), 4)
    assert (label == 0).all()


def test_documents_with_every_odd_row(spark):
    rows = [(1, "a b c d e f", "x"), (2, "A B C d e f", None), (2, "A B C d e f", None), (None, None, "y"), (5, "", "z"), (7, "q " * 3000, "z"), (None, "lonely words here", "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fingerprint string")
    with Scratch(spark) as scratch:
        got = sorted((r.doc_id or -1, r.fingerprint, r.component_id) for r in S.near_duplicates(docs, scratch).collect())
        assert S.near_duplicates(docs.limit(0), scratch).count() == 0
    one, zero = S.simhash(b"a b c d e f"), 0
    signed = lambda x: int(np.uint64(x).astype(np.int64))
    expected = [(1, signed(one), 1), (2, signed(one), 1), (2, signed(one), 1), (-1, zero, 5), (5, zero, 5), (7, signed(S.simhash(b"q " * 3000)), 7), (-1, signed(S.simhash(b"lonely words here")), None)]
    assert got == sorted(expected, key=lambda x: x[:2])
