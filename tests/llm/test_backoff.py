"""Backoff scores against direct counting."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import pytest

from wiregrain.llm import backoff as B
from wiregrain.session import Scratch

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(texts, order):
    lists = [WORD.findall(t or "") for t in texts]

    def grams(words):
        marked = ["<s>", *words]
        return Counter(tuple(marked[i - k + 1 : i + 1]) for k in range(1, order + 1) for i in range(max(1, k - 1), len(marked)))

    counts = [grams(x) for x in lists]
    every, starts, words = sum(counts, Counter()), sum(bool(x) for x in lists), sum(map(len, lists))
    every["<s>",] = starts
    out = []
    for x, own in zip(lists, counts, strict=True):
        own["<s>",] = bool(x)
        marked, total, backs = ["<s>", *x], 0.0, 0
        for i in range(1, len(marked)):
            longest = min(order, i + 1)
            for k in range(longest, 0, -1):
                gram = tuple(marked[i - k + 1 : i + 1])
                left = every[gram] - own[gram]
                if k == 1:
                    total += math.log10(max(left, 1) / max(words - len(x), 1))
                elif left > 0:
                    total += math.log10(left / max(every[gram[:-1]] - own[gram[:-1]], 1))
                if k == 1 or left > 0:
                    total += math.log10(0.4) * (longest - k)
                    backs += k < longest
                    break
        out.append((len(x), backs, total))
    return out


def corpus():
    rng = random.Random(7)
    words = [f"w{i}" for i in range(40)] + ["é", "x|"]
    texts = [" ".join(rng.choice(words[: rng.randrange(2, 42)]) for _ in range(rng.randrange(50))) for _ in range(80)]
    texts += [texts[5], None, "", " \n", "only here twice only here twice", "  a\x0bb\x1cc\x85d\u00a0e\x0cf\u2003g\x00h \n a b", "w1 w2 " * 4000]
    # Rare words: most of the corpus's words stand in one or two documents.
    texts += [" ".join(f"rare{rng.randrange(600)}" for _ in range(60)) for _ in range(20)]
    return [(i if i % 10 else None, t, "x") for i, t in enumerate(texts)] + [(5, texts[5], "x")]


@pytest.mark.parametrize("order, portion_bytes, part_grams", [(3, 4 << 20, 1_000_000), (3, 300, 50), (2, 2000, 400), (1, 300, 50), (4, 5000, 100)])
def test_equals_direct_counts(spark, order, portion_bytes, part_grams):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string, n string").repartition(3)
    with Scratch(spark) as scratch:
        got = B.score(docs, scratch, order=order, portion_bytes=portion_bytes, part_grams=part_grams).collect()
    expected = brute([t for _, t, _ in rows], order)
    by = lambda x: (x[0], x[1], x[2], x[3])
    found = sorted(((-1 if r.doc_id is None else r.doc_id, r.n_words, r.n_backoff, r.log10_prob or 0.0) for r in got), key=by)
    wanted = sorted(((-1 if i is None else i, *e) for (i, _, _), e in zip(rows, expected, strict=True)), key=by)
    assert len(found) == len(wanted)
    for f, w in zip(found, wanted, strict=True):
        assert f[:3] == w[:3] and f[3] == pytest.approx(w[3], abs=1e-4)
    assert all((r.score is None) == (r.n_words == 0) for r in got)


def test_rare_words_score_low(spark):
    """Texts of words that hardly anyone else uses score below all texts of common words, whatever their number."""
    rng = random.Random(3)
    common = [" ".join(rng.choice(["the", "of", "and", "in", "to", "is"]) for _ in range(40)) for _ in range(60)]
    rare = [" ".join(f"odd{rng.randrange(10**6)}" for _ in range(40)) for _ in range(60)]
    docs = spark.createDataFrame(list(enumerate(common + rare)), "doc_id long, text string")
    with Scratch(spark) as scratch:
        got = {r.doc_id: r.score for r in B.score(docs, scratch).collect()}
    assert max(got[i] for i in range(60, 120)) < min(got[i] for i in range(60))


def test_key_of_another_type_and_name(spark):
    docs = spark.createDataFrame([("a", "x y z"), ("b", "x y z"), (None, "q")], "portion string, body string")
    with Scratch(spark) as scratch:
        got = sorted(map(tuple, B.score(docs, scratch, key="portion", text="body").collect()), key=str)
    assert [(r[0], r[1], r[3]) for r in got] == [("a", 3, 0), ("b", 3, 0), (None, 1, 1)]


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    with Scratch(spark) as scratch:
        assert B.score(docs, scratch).count() == 0
