"""Removal of repeated spans against brute force."""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pytest

from wiregrain.llm import spans as S

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(docs, size):
    """docs: (id, text); equal rows count once."""
    import zlib

    rows = sorted({(d if d is not None else -(1 << 63), zlib.crc32((t or "").encode()), t) for d, t in docs}, key=lambda x: x[:2])
    seen, result = set(), {}
    for d, crc, t in rows:
        words = WORD.findall(t or "")
        gone = [False] * len(words)
        for i in range(len(words) - size + 1):
            window = tuple(words[i : i + size])
            if window in seen:
                gone[i : i + size] = [True] * size
            seen.add(window)
        kept = [w for w, g in zip(words, gone, strict=True) if not g]
        result[(d, t)] = (len(words), sum(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest())
    return result


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdé") for _ in range(rng.randrange(1, 4)))
    line = [word() for _ in range(45)]
    docs = []
    for i in range(120):
        words = [word() for _ in range(rng.randrange(0, 150))]
        if i % 3 == 0:
            at = rng.randrange(len(words) + 1)
            cut = rng.randrange(10)
            words[at:at] = line[cut : 45 - rng.randrange(10)]
        if i % 7 == 0 and docs:
            words = (docs[rng.randrange(len(docs))][1] or "").split()
            if words and i % 2:
                words[len(words) // 2] = "changed"
        if i % 11 == 0:
            words = ["spam"] * rng.randrange(60) + words
        docs.append((i, rng.choice([" ", "\n", "\t \x0b"]).join(words)))
    docs += [(None, docs[3][1]), (500, None), (501, ""), (502, " \n"), (502, docs[4][1]), (502, docs[4][1]), (502, "x " * 5000), (503, "a\x1cb c d")]
    rng.shuffle(docs)
    return docs


@pytest.mark.parametrize("size, anchor, parts", [(20, 8, 1), (20, 8, 7), (5, 2, 3)])
def test_equals_brute_force(spark, size, anchor, parts):
    rows = corpus(size + parts)
    docs = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, spans string").repartition(parts)
    expected = brute(rows, size)
    got = S.drop_repeats(docs, size=size, anchor=anchor).collect()
    assert len(got) == len(rows)
    by_key = {}
    for r in got:
        by_key.setdefault(r.doc_id if r.doc_id is not None else -(1 << 63), []).append((r.n_words, r.n_removed, r.kept_sha256))
        assert hashlib.sha256(r.kept_text.encode()).hexdigest() == r.kept_sha256
    for d in {k for k, _ in expected}:
        own = [expected[(d, t)] for x, t in [((i if i is not None else -(1 << 63)), t) for i, t in rows] if x == d]
        assert sorted(by_key[d]) == sorted(own)


def test_small_batches_carry_a_group(spark, monkeypatch):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
    try:
        test_equals_brute_force(spark, 20, 8, 5)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_empty_table(spark):
    assert S.drop_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_rolling_and_minimum():
    values = np.random.default_rng(0).integers(0, 50, 200).astype(np.uint64)
    for width in (1, 2, 3, 5, 8, 13):
        got = S.last_minimum(values, width)
        assert all(got[i] == max(j for j in range(i, i + width) if values[j] == values[i : i + width].min()) for i in range(len(got)))
    hashes = S.rolling(values, 20)
    assert len(hashes) == 181 and S.rolling(values[5:], 20)[0] == hashes[5]
    assert len(S.rolling(values[:19], 20)) == 0
