"""Language identification: kernel values, held-out accuracy, odd rows."""

from __future__ import annotations

import os
import tracemalloc

import numpy as np
import pytest

from wiregrain.llm import language as L

FOLDER = "/root/testdata/sf0.01"


def test_marks_every_ngram_once():
    seen, parts = np.zeros(L.BUCKETS, np.uint8), np.zeros(L.BUCKETS, np.uint8)
    L.mark_grams("Abc  abc", 2, seen)
    for gram in ("abc abc",):
        L.mark_grams(gram, 2, parts)
    assert (seen == parts).all() and seen.sum() <= 4 + 4  # " abc" and their pairs
    long, again = np.zeros(L.BUCKETS, np.uint8), np.zeros(L.BUCKETS, np.uint8)
    L.mark_grams("xyz " * (L._STEP // 2), 4, long)
    L.mark_grams("xyz " * 9, 4, again)
    assert (long == again).all()


def test_odd_rows(spark):
    rows = [(i, t, l) for i, (t, l) in enumerate([("der die das und nicht", "de"), ("the and of that with", "en")] * 5)]
    rows += [(90, None, "en"), (91, "", "en"), (92, "123 ... \n", "en"), (93, "the and", None), (None, "und nicht das", None), (94, "the of " * 50000, None), (93, "the and", None)]
    docs = spark.createDataFrame([(*r, 0.5) for r in rows], "doc_id long, text string, lang string, score double")
    model = L.fit(docs)
    assert model.languages == ["de", "en"]
    got = {r.doc_id: r for r in L.predict(docs, model).collect()}
    assert [got[k].lang_pred for k in (0, 1, 90, 91, 92, 93, None, 94)] == ["de", "en", "und", "und", "und", "en", "de", "en"]
    assert all(0 <= r.score <= 1 for r in got.values()) and got[90].score == 0
    assert L.predict(docs, model).count() == len(rows)
    odd = spark.createDataFrame(list(enumerate(["½ ² ①", "Ⅷ", "ª", "½ und nicht", "一", "٣ 5"])), "doc_id long, text string")
    assert [r.lang_pred == "und" for r in sorted(L.predict(odd, model).collect())] == [True, True, False, False, False, True]
    assert L.fit(docs.limit(0)) is None and {r.lang_pred for r in L.predict(docs, None).collect()} == {"und"}
    with pytest.raises(ValueError):
        L.fit(docs, most_languages=1)


def test_fit_keeps_sets_packed(spark):
    """600 sets of 65,536 buckets: 157 MB as matrix, 5 MB packed."""
    rows = [(f"{words} nummer {i} {i * 7919}", lang) for lang, words in (("de", "der die das und nicht"), ("en", "the and of that with")) for i in range(300)]
    docs = spark.createDataFrame(rows, "text string, lang string")
    tracemalloc.start()
    try:
        model = L.fit(docs)
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert model.languages == ["de", "en"] and most < 100e6
    langs, scores = L._scored(model, [text for text, _ in rows])
    assert langs == [lang for _, lang in rows] and scores.min() > 0.5


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables here")
def test_held_out_accuracy(spark):
    from wiregrain.llm.queries import QUERIES

    found = QUERIES["op1_language_id"](spark, FOLDER)
    lang = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "lang")
    held = found.filter("held_out").join(lang, "doc_id").selectExpr("avg(int(lang = lang_pred))", "count(*)").first()
    assert held[1] > 200 and held[0] >= 0.98
