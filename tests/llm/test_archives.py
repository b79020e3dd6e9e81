"""Archives: exact round trip, revisits, loser-tree order."""

from __future__ import annotations

import base64
import hashlib
import random

import pytest

from wiregrain.llm import archives as A
from wiregrain.session import Scratch


@pytest.mark.parametrize("k", [0, 1, 2, 3, 7, 8])
def test_loser_tree_merges(k):
    rng = random.Random(k)
    runs = [sorted((rng.randrange(9), rng.randrange(3)) for _ in range(rng.randrange(6))) for _ in range(k)]
    assert list(A.LoserTree([iter(r) for r in runs])) == sorted(x for r in runs for x in r)


PAGES = [
    (1, "https://www.A.example.org:80/x?q=1#f", "same"), (2, "http://b.example.org", "same"), (3, None, None), (4, "u\r\nEvil: 1", ""),
    (5, "http://b.example.org/é", "é\r\n\r\nWARC/1.0\r\n\x00"), (5, "http://b.example.org/é", "é\r\n\r\nWARC/1.0\r\n\x00"), (None, "http://c.example", "same"),
    (None, "http://c.example", "only null"), (6, "", "x" * 300000), (7, "http://b.example.org", "same"),
]


def test_round_trip(spark):
    pages = spark.createDataFrame([(*p, "n") for p in PAGES], "page_id long, url string, html string, digest string").repartition(3)
    with Scratch(spark) as scratch:
        rows = A.capture_histories(pages, scratch).collect()
        assert A.capture_histories(pages.limit(0), Scratch(spark)).count() == 0
    assert len(rows) == len(PAGES) and all(r.intact for r in rows)
    b32 = lambda x: base64.b32encode(hashlib.sha1((x or "").encode()).digest()).decode()
    last = {}
    for i, _, h in PAGES:
        last[h or ""] = max(last.get(h or "", -1), -1 if i is None else i)
    expected = []
    for i, _, h in PAGES:
        w = last[h or ""]
        response = w == -1 or i == w
        expected.append((-1 if i is None else i, len((h or "").encode()), b32(h), "response" if response else "revisit", -1 if response else w))
    got = [(-1 if r.page_id is None else r.page_id, r.payload_bytes, r.payload_digest, r.record_type, -1 if r.refers_to is None else r.refers_to) for r in rows]
    assert sorted(got) == sorted(expected)
    assert {r.url_key for r in rows if r.page_id == 1} == {"org,example,a)/x?q=1"}


def test_ranges_keep_the_global_order(spark):
    rng = random.Random(5)
    rows = [(i, f"http://h{rng.randrange(3)}.org/{rng.randrange(4)}" if i % 3 else "http://hot.org/", f"text {rng.randrange(40)}") for i in range(400)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)
    with Scratch(spark) as scratch:
        path = f"{scratch.path}/a"
        A.write_archives(pages, path)
        index = scratch.settle(A.read_archives(spark, path))
        merged = A.merge_runs(index, rows_per_range=30).collect()
    merged.sort(key=lambda r: (r.history_range, r.history_position))
    assert len({r.history_range for r in merged}) > 5
    keys = [(r.url_key, r.stamp, r.page_id) for r in merged]
    assert keys == sorted(keys) and len(keys) == 400
