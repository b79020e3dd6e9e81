"""Identifiers against the plain patterns, disclosure shares against direct counts."""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

from wiregrain.llm import disclosure as D
from wiregrain.session import Scratch

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    return sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(int(c) for c in reversed(digits))) % 10 == 0


def brute_base(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(p) > 255 for p in m[0].split(".")):
                continue
            if kind == "card" and not (13 <= len(digits) <= 19 and luhn(digits)):
                continue
            if kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            out.append((kind, m.start(), m.end(), m[0]))
    return out


ODD = [
    None, "", "no data", "a@b", "a@b.c", "x@y@z.com", "a@b.c._d@e.f", "a@b.c_d@e.f..g@h.i", "é@b.co ünï@c.de,f@g.h.", "%@-.-", "." * 30000, "a" * 30000 + "@", "a@b" + ".c" * 20000,
    "1.2.3.4", "1.2.3.4.5.6.7.8", "256.1.1.1 001.002.003.255 1.2.3.0000000000000000000001", "9" * 30000, "4111 1111 1111 1111", "4111-1111-1111-1111 5500 0000 0000 0004", "4111  1111 1111 1111 1111",
    "12 4111111111111111", "x4111111111111111y 41111111111111111111", "+1 (555) 123-4567", "+1 555", "+12345678901234567890", "++49 30 1234567. +49.30.123.45.67-", "\U0001f600 +1 (555) 123-4567 a@b.cd 10.0.0.1", "+4111111111111111 1-1-1-1-1",
]


def noise(seed):
    rng = random.Random(seed)
    pieces = ["a@b.c", "@", ".", "+", "1", "22", "4111111111111111", " ", "-", "(", ")", "1.2.3.4", "x", "_", "+1 555 123 4567", "é", "\n"]
    return ["".join(rng.choice(pieces) for _ in range(rng.randrange(40))) for _ in range(300)]


def test_base_spans_equal_the_patterns(spark):
    texts = ODD + noise(1)
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, spans string")
    for r in D.personal_data(docs, Scratch(spark), support=10**9).collect():
        base = brute_base(texts[r.doc_id])
        written = ",".join(f"{k}:{a}:{b}" for k, a, b, _ in base)
        assert r.spans == written, texts[r.doc_id]
        assert r.base_sha256 == hashlib.sha256(written.encode()).hexdigest()
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(k == x[0] for x in base) for k in D.KINDS)


def brute_terms(docs, support, least):
    """Spans of revealing terms by direct counts."""
    terms = lambda t: [(m[0].lower(), m.start(), m.end()) for m in re.finditer(r"[^\W_]+", t or "")]
    corpus = Counter(w for _, t in docs for w, _, _ in terms(t))
    near, slots = defaultdict(list), Counter()
    for d, t in docs:
        base = brute_base(t)
        own = [x for x in terms(t) if len(x[0]) >= 3 and not any(a < x[2] and b > x[1] for _, a, b, _ in base)]
        for kind, a, b, value in base:
            entity = f"{kind}:{value.lower()}"
            left = [x for x in own if x[2] <= a and (x[1] > a - D.CONTEXT_CHARS or a <= D.CONTEXT_CHARS)][-D.CONTEXT_TERMS :]
            right = [x for x in own if x[1] >= b and (x[2] < b + D.CONTEXT_CHARS or b + D.CONTEXT_CHARS >= len(t) and x[2] <= b + D.CONTEXT_CHARS)][: D.CONTEXT_TERMS]
            slots[entity] += len(left) + len(right)
            for x in left + right:
                near[entity, x[0]].append((d, x[1], x[2]))
    told = set()
    for (entity, term), places in near.items():
        if len(places) >= support:
            share = 1 - math.log2(corpus[term] / len(places)) / math.log2(max(corpus.total() / slots[entity], 2))
            if round(share, 6) >= least:
                told.add(term)
    found = defaultdict(set)
    for d, t in docs:
        base = brute_base(t)
        found[d] |= {(a, b) for w, a, b in terms(t) if w in told and not any(x < b and y > a for _, x, y, _ in base)}
    return found


def test_revealing_terms_equal_direct_counts(spark):
    rng = random.Random(4)
    words = [f"word{i}" for i in range(200)] + ["the", "of"]
    docs = []
    for i in range(150):
        text = [rng.choice(words) for _ in range(rng.randrange(5, 60))]
        if i % 3 == 0:
            at = rng.randrange(len(text))
            text[at:at] = rng.choice([["Zelda", "boss@acme.org", "Hyrule"], ["bob@acme.org", "the"], ["call", "+1 555 123 4567"]])
        docs.append((i, " ".join(text)))
    # Identifiers side by side, one in another, and at the edges of pieces and contexts.
    docs += [(200, "Zelda a@b.cd,10.0.0.1,c@d.ef Link " * 70), (201, "Ganon 1.2.3.4@x.yz+4111111111111111@q.rs abc4111111111111111 " * 30), (202, ("é" * 119 + " Navi 10.0.0.7 ") * 40)]
    docs += [(203, "x" * 1000 + " Epona far@away.org " + "y" * 1003 + " Epona far@away.org " + "z" * 118 + " q")]
    frame = spark.createDataFrame([*docs, docs[0]], "doc_id long, text string").repartition(3)
    expected = brute_terms([*docs, docs[0]], 2, 0.75)
    assert any(expected.values())
    got = {r.doc_id: r for r in D.personal_data(frame, Scratch(spark)).collect()}
    for d, t in docs:
        base = ",".join(f"{k}:{a}:{b}" for k, a, b, _ in brute_base(t))
        terms = ",".join(f"term:{a}:{b}" for a, b in sorted(expected.get(d, ())))
        assert got[d].spans == ",".join(x for x in (base, terms) if x)
    zelda = {r.action for r in D.revealing(frame, Scratch(spark)).filter("value = 'zelda'").collect()}
    assert zelda == {"removed"}


def test_sanitise(spark):
    rows = [(1, "Zelda wrote a@b.cd from 10.0.0.1 today", "e"), (2, "Zelda wrote a@b.cd again", "e"), (3, "plain text", None), (4, None, "f"), (None, "x +1 (555) 123-4567", "g"), (5, "", "h")] + [(10 + i, "wrote again today from", "e") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, key string")
    got = {r.doc_id: r for r in D.sanitise(docs, Scratch(spark)).collect()}
    assert got[1].text.startswith(" wrote [EMAIL] from [IP]") and got[2].text.startswith(" wrote [EMAIL]")
    assert (got[3].text, got[4].text, got[5].text, got[None].text) == ("plain text", None, "", "x [PHONE]")
    assert got[1].key == "e" and D.sanitise(docs, Scratch(spark)).columns == ["doc_id", "text", "key"]
    assert D.sanitise(docs.limit(0), Scratch(spark)).count() == 0 and D.personal_data(docs.limit(0), Scratch(spark)).count() == 0


def test_no_python_in_the_plan(spark):
    docs = spark.createDataFrame([(1, "a@b.cd")], "doc_id long, text string")
    for frame in (D.personal_data(docs, Scratch(spark)), D.sanitise(docs, Scratch(spark))):
        plan = frame._jdf.queryExecution().toString()
        assert "Python" not in plan and "Arrow" not in plan


def test_revealing_terms_go_wherever_they_stand(spark):
    filler = " ".join(f"plain{i}" for i in range(60))
    near = [(i, f"start Zelda boss@acme.org {filler}") for i in range(20)]
    rows = [*near, (20, f"Zelda boss@acme.org {filler} and ZELDA again"), (21, "here zelda stands alone"), (None, "x Zelda, y"), (22, "zelda@acme.org zeldas"), (23, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.text for r in D.sanitise(docs, Scratch(spark)).collect()}
    assert set(got) == {r[0] for r in rows}
    assert got[21] in ("here  stands alone", "here [TERM] stands alone") and got[22] == "[EMAIL] zeldas"
    assert not any(re.search(r"\bzelda\b", t.lower()) for t in got.values() if t)
    spans = {r.doc_id: r.spans for r in D.personal_data(docs, Scratch(spark)).collect()}
    assert spans[21] == "term:5:10" and spans[None] == "term:2:7" and spans[20].count("term:") >= 2


def test_many_identifiers_in_one_text(spark):
    """Time grows with the number of identifiers, not with its square: eight times as many take less than thirty times as long."""
    import time

    def seconds(n):
        docs = spark.createDataFrame([(1, " ".join(f"w{i} v{i} 10.{i // 65536}.{i // 256 % 256}.{i % 256}" for i in range(n)))], "doc_id long, text string")
        begin = time.monotonic()
        assert D._contexts(D.with_base(docs)).agg({"terms": "count"}).first()[0] == n
        return time.monotonic() - begin

    seconds(100)
    assert seconds(8000) < 30 * max(seconds(1000), 0.3)
