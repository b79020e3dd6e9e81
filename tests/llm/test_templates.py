"""Template windows: exact, re-parameterised and inconsistent copies of benchmark items."""

from __future__ import annotations

from wiregrain.llm import templates as T

ITEM = "A train leaves Boston at 30 miles per hour while Anna Miller walks 4 miles home, so Anna Miller needs 4 hours to reach the station before noon."
FILL = "some words before that do not belong to anything in particular and go on"


def found(spark, texts, items=None, **options):
    docs = spark.createDataFrame([(i, t, 1) for i, t in texts], "doc_id long, text string, hash long")
    bench = spark.createDataFrame(items or [(1, ITEM)], "item_id long, text string")
    return {(r.doc_id, r.item_id): r for r in T.contaminated(docs, bench, **options).collect()}


def test_numbers_names_and_units_may_change(spark):
    new = ITEM.replace("30", "75").replace("4", "9").replace("Anna Miller", "Omar").replace("Boston", "New York").replace("miles", "km")
    mixed = new.replace("walks 9", "walks 5")  # 4 is 5 in one slot and 9 in another
    swapped = new.replace("75", "9")  # two values of the item are one value here
    got = found(
        spark,
        [(1, ITEM), (2, f"{FILL} {new} {FILL}"), (3, mixed), (4, swapped), (5, FILL), (6, " ".join(ITEM.split()[:9])), (7, f"{FILL}\n{ITEM.upper().lower()}"), (8, None), (9, ""), (None, ITEM), (1, ITEM), (1, "other text")],
    )
    assert set(got) == {(1, 1), (2, 1), (7, 1), (None, 1)}, set(got)
    assert got[1, 1].covered == 1.0 and got[1, 1].changed == 0
    assert got[2, 1].covered == 1.0 and got[2, 1].changed >= 6


def test_short_items_and_ties(spark):
    items = [(1, "red green blue yellow black"), (2, "one two"), (3, None), (4, "red green blue yellow black"), (5, "3 4 5 6 7 8 9 10 11")]
    got = found(spark, [(1, "x red, GREEN blue yellow black y"), (2, "one two"), (3, "3 4 5 6 7 8 9 10 11"), (4, "red green blue " * 40000)], items)
    assert set(got) == {(1, 1), (1, 4), (2, 2), (3, 5)}


def test_filter_stage_keeps_the_rest(spark):
    docs = spark.createDataFrame([(1, ITEM, "x"), (2, FILL, "y"), (None, None, "z"), (None, ITEM, "w")], "doc_id long, text string, crc string")
    bench = spark.createDataFrame([(1, ITEM)], "item_id long, text string")
    assert sorted(r.crc for r in T.drop_contaminated(docs, bench).collect()) == ["y", "z"]
    assert T.drop_contaminated(docs, bench.limit(0)).count() == 4
    assert T.contaminated(docs.limit(0), bench).count() == 0


def test_names_at_the_start_of_sentences(spark):
    item = "Mia has 5 apples in her bag. Mia gives 2 apples to Ben. Ben eats 1 apple. How many apples does Mia have?"
    renamed = item.replace("Mia", "Olga").replace("Ben", "Tariq")
    mixed = renamed.replace("Olga gives", "Eve gives")  # one name of the item is two names here
    short = "Boats leave the small harbour at noon"
    got = found(spark, [(1, f"{FILL}. {renamed} {FILL}"), (2, mixed), (3, f"we ask {short} and go"), (4, item)], [(1, item), (2, short)])
    assert set(got) == {(1, 1), (3, 2), (4, 1)}
    assert got[1, 1].covered == 1.0 and got[1, 1].changed > 0 and (got[4, 1].covered, got[4, 1].changed) == (1.0, 0)


def test_verbatim_items_without_literals(spark, tmp_path):
    long = " ".join(f"{i} km" for i in range(3, 23))
    items = [(1, "What is 12 + 35?"), (2, "3 4 5 6 7 8 9 10 11"), (3, long), (4, "7"), (5, None), (6, "..."), (7, ITEM)]
    texts = [(1, f"{FILL} what is 12 + 35 {FILL}"), (2, "x 3 4 5 6 7 8 9 10 11 y"), (3, f"{FILL} {long}"), (4, "What is 12 - 35?"), (5, "What is 13 + 35?"), (6, "not 8"), (7, ""), (8, ITEM.lower())]
    got = found(spark, texts, items)
    assert set(got) == {(1, 1), (2, 2), (2, 4), (3, 3), (3, 4), (8, 7)}, set(got)
    assert all((r.covered, r.changed) == (1.0, 0) for r in got.values())
    # The query and the pipeline's stage look for them.
    import corpus_pipeline
    from wiregrain.llm.queries import QUERIES

    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in texts], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert {(r.doc_id, r.item_id) for r in QUERIES["op7_benchmark_decontamination"](spark, str(tmp_path)).collect()} == set(got)
    assert {r.doc_id for r in corpus_pipeline.decontaminate(spark, docs, str(tmp_path)).collect()} == {4, 5, 6, 7}
