"""Sampled segmentations against full enumeration, and exact round trips."""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import public_tokenizers
import pytest

from wiregrain.llm import segmentation as S

PATH = str(public_tokenizers.path("piece_bpe_32k.model"))


@pytest.fixture(scope="module")
def pieces():
    return S.Pieces(PATH, 1.0)


def every(pieces, text):
    """All segmentations of a short text with their probabilities."""
    text = pieces.normalised(text)
    found = {(): 0.0}
    done = {}

    def go(at, ids, log):
        if at == len(text):
            done[ids] = log
            return
        own = [(e, (pieces.of[text[at:e]],)) for e in range(at + 1, len(text) + 1) if text[at:e] in pieces.of]
        if not any(e == at + 1 for e, _ in own):
            own.append((at + 1, tuple(pieces.byte_ids[b] for b in text[at].encode())))
        for e, more in own:
            go(e, ids + more, log + sum(pieces.log_prob[p] for p in more))

    go(0, (), 0.0)
    top = max(done.values(), default=0.0)
    total = top + math.log(sum(math.exp(v - top) for v in done.values()))
    assert found
    return {k: v - total for k, v in done.items()}


def ids_of(lattices, doc):
    return [tuple(lattices.ids(p).tolist()) for p in doc.paths]


@pytest.mark.parametrize("text", ["ab", "the cat", "a\nb", "  x ", "日€", "\U0001f600a"])
def test_samples_are_distinct_and_normalised(pieces, text):
    expected, lattices = every(pieces, text), S.Lattices(pieces)
    k = min(4, len(expected))
    docs = S.sample(lattices, [text] * 50, S._mixed(np.arange(50, dtype=np.uint64)), 4)
    for d in docs:
        ids = ids_of(lattices, d)
        assert len(set(ids)) == len(ids) == k
        assert d.values == sorted(d.values, reverse=True)
        for i, log in zip(ids, d.logs, strict=True):
            assert log == pytest.approx(expected[i], abs=1e-9)


def test_frequencies_follow_sampling_without_replacement(pieces):
    text, n = "abc de", 20000
    expected, lattices = every(pieces, text), S.Lattices(pieces)
    docs = S.sample(lattices, [text] * n, S._mixed(np.arange(n, dtype=np.uint64)), 2)
    first, second = Counter(), Counter()
    for d in docs:
        a, b = ids_of(lattices, d)
        first[a] += 1
        second[b] += 1
    p = {k: math.exp(v) for k, v in expected.items()}
    for k, share in p.items():
        assert first[k] / n == pytest.approx(share, abs=0.02)
        next_share = sum(q * share / (1 - q) for other, q in p.items() if other != k)
        assert second[k] / n == pytest.approx(next_share, abs=0.02)


TEXTS = ["Hello  world, this is  a test.\nNew line\tand tab", "", None, "日本語 \U0001f600 é ▁ x", " lead and trail  ", "a" * 3000, "one two three " * 2000, "\x00\x01 odd"]


def test_round_trip_and_seeds(spark):
    rows = [(i, t, 1) for i, t in enumerate(TEXTS)] + [(None, "none", 1), (0, TEXTS[0], 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids long").repartition(3)
    encoded = S.encode(docs, PATH, k=3)
    got = S.decode(encoded, PATH).collect()
    for r in got:
        text = "none" if r.doc_id is None else TEXTS[r.doc_id] or ""
        assert r.decoded == text.replace("▁", " ") and r.exact == ("▁" not in text)
    samples = lambda rows: sorted((r.doc_id or 0, r["rank"], tuple(r.ids), r.log_prob, r.perturbed, r.log_inclusion) for r in rows)
    assert samples(got) == samples(S.encode(docs.repartition(1), PATH, k=3).collect())
    by = Counter((r.doc_id, tuple(r.ids)) for r in got)
    assert all(n == (2 if d == 0 else 1) for (d, _), n in by.items())
    assert all(r.log_inclusion <= 0 and r.log_prob <= 1e-9 for r in got)
    empty = [r for r in got if r.doc_id in (1, 2)]
    assert len(empty) == 2 and all(r.ids == [] and r.log_inclusion == 0 for r in empty)
    assert S.encode(docs.limit(0), PATH).count() == 0 and S.decode(encoded.limit(0), PATH).count() == 0


def test_words_met_again_are_built_once(pieces, monkeypatch):
    """A full table keeps the words that came again, and its samples are those of a table of unlimited size."""
    texts = [f"common words of all texts own{i}x{i * 7919} {'日' if i % 3 else 'é'}{i}" for i in range(40)]
    free, tight = S.Lattices(pieces), S.Lattices(pieces)
    built, build = [], S.Lattices._built

    def counted(self, words, *rest):
        if self is tight:
            built.extend(words)
        return build(self, words, *rest)

    monkeypatch.setattr(S.Lattices, "_built", counted)
    for i, text in enumerate(texts):
        key = S._mixed(np.array([i], np.uint64))
        monkeypatch.setattr(S, "_NODES", 1 << 40)
        (expected,) = S.sample(free, [text], key, 3)
        monkeypatch.setattr(S, "_NODES", 90)
        (found,) = S.sample(tight, [text], key, 3)
        assert ids_of(tight, found) == ids_of(free, expected) and found.logs == pytest.approx(expected.logs, abs=1e-12)
    assert len(tight) < len(free) and built.count("▁common") == 1


def test_random_numbers_of_a_round_are_drawn_at_once(pieces, monkeypatch):
    """Ten times as many texts need hardly more draws, not ten times as many."""
    calls, draw = [], S._uniform
    monkeypatch.setattr(S, "_uniform", lambda key: calls.append(len(key)) or draw(key))
    counts = []
    for n in (5, 50):
        calls.clear()
        S.sample(S.Lattices(pieces), ["the cat sat"] * n, S._mixed(np.arange(n, dtype=np.uint64)), 2)
        counts.append(len(calls))
    assert counts[1] < 2 * counts[0]
