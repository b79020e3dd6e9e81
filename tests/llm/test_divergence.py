"""The transducer against sorted lists, and the audit against plain Python and SQL."""

from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pytest

from wiregrain.llm import divergence as D
from wiregrain.llm import transducer as T
from wiregrain.session import Scratch

ROWS = "doc_id long, text string, lang string, source string, term string, n long, ordinal int"


def test_transducer_is_minimal_and_numbers_in_order():
    rng = random.Random(1)
    draw = lambda most: bytes(rng.choice(b"abc\xc3\x00") for _ in range(rng.randrange(1, most)))
    for size in (0, 1, 2, 7, 60, 300):
        words = sorted({draw(7) for _ in range(size)})
        made = T.build(words)
        asked = [*words, *(draw(9) for _ in range(50)), b"", b"\xff" * 40]
        data, length = np.frombuffer(b"".join(asked), np.uint8), np.array([len(x) for x in asked])
        zero = np.zeros(len(asked), np.int64)
        found = made.walk(zero + made.root, zero, data, np.cumsum(length) - length, length)
        place = {w: i for i, w in enumerate(words)}
        assert found.tolist() == [place.get(x, -1) for x in asked]
        prefixes = {w[:i] for w in words for i in range(len(w) + 1)} | {b""}
        assert made.states == len({frozenset(w[len(p) :] for w in words if w.startswith(p)) for p in prefixes})
    with pytest.raises(ValueError, match="sorted"):
        T.build([b"a", b"a"])


def test_equal_marks_are_found_out(monkeypatch):
    real, calls = T._mix, []

    def poor(x, seed=0):
        calls.append(seed)
        return real(x, seed) & np.uint64(3) if 0 < seed < 10 else real(x, seed)

    monkeypatch.setattr(T, "_mix", poor)
    words = sorted({bytes(p) for p in ([97 + i % 7, 97 + i % 5, 97 + i % 3] for i in range(105))})
    made = T.build(words)
    assert max(calls) > 10
    data = np.frombuffer(b"".join(words), np.uint8)
    zero = np.zeros(len(words), np.int64)
    assert made.walk(zero + made.root, zero, data, zero + np.arange(len(words)) * 3, zero + 3).tolist() == list(range(len(words)))


def brute(rows, least=10, top=10):
    docs = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))) for _, text, lang, source in rows]
    out = []
    for lang in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == lang]
        frequency = Counter(w for _, _, words in own for w in set(words))
        kept = sorted((w for w, n in frequency.items() if n >= least), key=str.encode)
        count = {s: Counter() for s in {d[1] for d in own}}
        for _, s, words in own:
            count[s].update(w for w in words if frequency[w] >= least)
        whole = sum(count.values(), Counter())
        weigh = lambda c: {w: 1 + 10**9 * (c[w] + 2) // (sum(c.values()) + 2 * len(kept)) for w in kept}  # noqa: B023,E731
        p, q = {s: weigh(c) for s, c in count.items()}, weigh(whole)
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in count:
            pairs = [(sum(f(p[s][w], p[o][w]) for w in kept), o) for o in count if o != s]
            terms = [(f(p[s][w], q[w]), w) for w in kept if count[s][w] and p[s][w] > q[w]]
            for part, found, most in (("pair", pairs, None), ("term", terms, top)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, value, i + 1) for i, (value, item) in enumerate(found[:most])]
    return sorted(out)


def planted():
    rng = random.Random(2)
    words = ["the", "Of", "und", "élan", "É", "zzz", "日本", "a", "ab", "abc", "b", "x" * 70, *(f"q{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(80))]
    rows = []
    for i in range(260):
        n = rng.choice([0, 1, 5, 30, 60])
        text = "".join(rng.choice(words[: 20 + 15 * (i % 5)]) + rng.choice([" ", "-", "1", "\n", "[", "\x7f"]) for _ in range(n))
        rows.append((i, text, rng.choice(["en", "de", "en", None, ""]), rng.choice(["s1", "s2", "S3", "é", None])))
    rows += [rows[7]] * 12
    rows += [(900, "only here", "xx", "s1"), (901, None, "xx", "s2"), (902, "", "yy", "s1"), (None, "THE the", "en", "s1"), (903, "the " * 20000, "en", "big")]
    return rows


def table(spark, rows):
    return spark.createDataFrame([(*r, "clash", 1, 2) for r in rows], ROWS).repartition(6)


def result(frame):
    return sorted((r.lang, r.source, r.part, r["item"], r.value, r["rank"]) for r in frame.collect())


@pytest.mark.parametrize("small", [False, True])
def test_audit_equals_plain_python(spark, small, monkeypatch):
    """Small: blocks of 4 ordinals, tiles of 2 sources, 25 terms in the transducer and the others joined, sums in two steps."""
    rows = planted()
    if small:
        monkeypatch.setattr(D, "_FAN_IN", 2)
        monkeypatch.setattr(D, "_HELD", 5)
    with Scratch(spark) as scratch:
        sizes = {"most_terms": 25, "block": 4, "tile": 2} if small else {}
        assert result(D.audit(table(spark, rows), scratch, **sizes)) == brute(rows)


def test_empty_table_and_other_names(spark):
    with Scratch(spark) as scratch:
        assert D.audit(table(spark, planted()).filter("false"), scratch).collect() == []
        docs = spark.createDataFrame([("b", "x y", "m"), ("a", "x z", "m")], "source string, body string, tongue string")
        found = result(D.audit(docs, scratch, text="body", lang="tongue", least=1, top=1))
    assert found == brute([(0, "x y", "m", "b"), (0, "x z", "m", "a")], 1, 1)


def test_query_on_whole_table(spark):
    from wiregrain.llm.queries import QUERIES

    folder = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text, r.lang, r.source) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    assert result(QUERIES["op12_source_divergence"](spark, folder)) == brute(rows)
