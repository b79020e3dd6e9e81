"""Quality rules and the n-gram verdict against plain Python."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import xxhash

from wiregrain.llm import quality as Q

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_rules(text):
    text = text or ""
    words = WORD.findall(text)
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    gone = set()
    for i in range(len(words) - 7):
        if windows[tuple(words[i : i + 8])] > 1:
            gone.update(range(i, i + 8))
    lines = [x for x in text.split("\n") if WORD.search(x)]
    failed = len(words) < 20 or 100 * len(gone) > 30 * len(words)
    return (len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(gone), failed)


def brute_grams(text):
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    # A long is hashed as its eight bytes; the second one with the hash of the first as seed.
    as_bytes = lambda x: x.to_bytes(8, "little", signed=True)
    h = [signed(xxhash.xxh64_intdigest(w.encode(), 42)) for w in WORD.findall(text or "")]
    pair = [signed(xxhash.xxh64_intdigest(as_bytes(b), xxhash.xxh64_intdigest(as_bytes(a), 42))) for a, b in zip(h, h[1:], strict=False)]
    return [x % Q.BUCKETS for x in h + pair]


def corpus():
    rng = random.Random(2)
    word = lambda: rng.choice(["alpha", "béta", "gamma#", "x|", "delta", "eps"]) + str(rng.randrange(30))
    texts = [" ".join(word() for _ in range(rng.randrange(60))) for _ in range(60)]
    texts += [t + "\n" + t for t in texts[:10]] + ["a b c d e f g h " * 40, "line one\nline one\n\n \nline one", None, "", " \t\x0b\n", "$$$ %%% " * 30, "a b c d e f g h i " * 3000]
    texts += ["one two three four five six seven eight"] * 2
    return [(i if i % 9 else None, t, i % 2 == 0 if i % 3 else None, "x") for i, t in enumerate(texts)]


def test_equals_brute_force(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string, trusted boolean, hashes string").repartition(3)
    got = Q.judge(docs, Q.log_ratios(docs)).collect()
    raw, good = Counter(), Counter()
    for _, t, trusted, _ in rows:
        raw.update(brute_grams(t))
        if trusted:
            good.update(brute_grams(t))
    ratio = lambda b: math.log((good[b] + 1) / (good.total() + Q.BUCKETS)) - math.log((raw[b] + 1) / (raw.total() + Q.BUCKETS))
    expected = []
    for i, t, _, _ in rows:
        grams = brute_grams(t)
        score = sum(map(ratio, grams)) / len(grams) if grams else 0.0
        base = brute_rules(t)
        expected.append((-1 if i is None else i, *base, not base[-1] and round(score, 6) >= Q.THRESHOLD, round(score, 5)))
    found = [(-1 if r.doc_id is None else r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.kept, round(r.score, 5)) for r in got]
    assert sorted(found) == sorted(expected)


def test_no_trusted_rows_and_no_rows(spark):
    docs = spark.createDataFrame([(1, "word " * 25)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long")
    ratios = Q.log_ratios(Q.with_trusted(docs, none))
    assert Q.judge(docs, ratios).first().score == 0
    empty = docs.limit(0)
    assert Q.judge(empty, Q.log_ratios(Q.with_trusted(empty, none))).count() == 0


def test_no_python_in_the_plan(spark):
    docs = spark.createDataFrame([(1, "word")], "doc_id long, text string").withColumn("trusted", Q.F.lit(True))
    plan = Q.judge(docs, Q.log_ratios(docs))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_trusted_keys_are_bounded(spark):
    docs = spark.createDataFrame([(i, "t") for i in [None, *range(30)] * 2], "doc_id long, text string")
    marked = Q.with_trusted(docs, docs, most=5)
    assert marked.count() == 62 and marked.filter("trusted").count() == 10
