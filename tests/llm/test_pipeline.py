"""The pipeline on planted documents, and its contract."""

from __future__ import annotations

import random

import pytest

import corpus_pipeline as P
from test_similar import brute as brute_groups
from tests_llm_brute import brute_spans

EN = "the of and to in that is was for on with as by at from this have which one you".split()
DE = "der die und in den von zu das mit sich des auf ist im dem nicht ein eine als auch".split()
ITEM = "which train leaves the old station at 40 miles per hour and arrives at the harbour before the second boat goes out again"


def planted():
    rng = random.Random(9)
    text = lambda words, n: " ".join(rng.choice(words) + rng.choice(["", "ing", "er", "en"]) for _ in range(n))
    rows = [(i, text(EN if i % 2 else DE, 40 + i % 50), "en" if i % 2 else "de", f"s{i % 3}") for i in range(60)]
    rows += [(100, rows[1][1], "en", "x"), (101, rows[1][1].upper(), None, "x"), (1, rows[1][1], "en", "s1"), (1, rows[1][1], "en", "s1")]
    rows += [(110, rows[4][1] + f" {ITEM} " + rows[6][1], "de", "x"), (111, ITEM.replace("40", "75") + " " + rows[7][1], "en", "x")]
    rows += [(120, rows[9][1] + " write to anna.b@mail.example.org or +1 (555) 123-4567 now", "en", "x"), (130, None, "en", None), (131, "", None, "x"), (132, "123 ... 456", "en", "x"), (None, text(DE, 30), "de", "x")]
    rows += [(140, text(EN, 20) + " write to anna.b@mail.example.org or +1 (555) 123-4567 now", "en", "x")]
    return [(*r, len(r[1] or "")) for r in rows]


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(planted(), SCHEMA).repartition(2).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(0, ITEM), (1, None)], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return at


def test_stages_equal_plain_python(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    names = [n for n, _ in P.STAGES]
    results = {}
    for name, stage in P.STAGES:
        before = docs.count()
        docs = stage(spark, docs, folder).cache()
        results[name] = docs.collect()
        if name != names[-1]:
            assert docs.columns == P.COLUMNS and len(results[name]) <= before
    expected = [r for r in planted() if r[1] and any(c.isalpha() for c in r[1])]
    row = lambda r: tuple("" if x is None else str(x) for x in r)
    assert sorted(map(row, results["language_id"])) == sorted(map(row, expected))
    label = brute_groups([r[1] for r in expected])
    kept = {}
    for r, c in zip(expected, label, strict=True):
        kept[c] = min(kept.get(c, r), r, key=lambda x: -1 if x[0] is None else x[0])
    assert sorted(map(row, results["simhash_near_dedup"])) == sorted(map(row, kept.values()))
    clean = [r for r in kept.values() if r[0] not in (110, 111)]
    assert sorted(map(row, results["benchmark_decontamination"])) == sorted(map(row, clean))
    texts = {r.doc_id: r.text for r in results["pii"]}
    assert set(texts) == {r[0] for r in clean}
    for r in clean:
        assert ("[EMAIL]" in texts[r[0]]) == any(k == "email" for k, *_ in brute_spans(r[1]))
        assert texts[r[0]] == r[1] or r[0] == 140
    # Document 120 is document 9 with a contact added: similar enough to go.
    assert 120 not in texts and "123-4567" not in texts[140] and "anna" not in texts[140]
    final = results["sentencepiece"]
    assert len(final) == 2 * len(clean) and all(r.exact and r.decoded == texts[r.doc_id] for r in final)


def test_run_and_odd_inputs(spark, folder):
    assert P.run(spark, folder).count() > 100
    empty = spark.createDataFrame([], SCHEMA)
    for _, stage in P.STAGES:
        assert stage(spark, empty, folder).count() == 0


def test_contract():
    assert 4 <= len(P.STAGES) <= 5
    import __spark_entry__ as entry

    assert entry.queries()["pipeline"].__name__ == "run"
    assert all(any(q.startswith(f"op{n}_") for q in entry.queries()) for n in range(1, 11))
