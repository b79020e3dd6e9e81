"""Token counts equal the tokenizer library's."""

from __future__ import annotations

import public_tokenizers
import pytest
import regex
from tokenizers import Tokenizer

from wiregrain.llm import tokens as T

PATH = public_tokenizers.path("byte_bpe_50k.json")
TEXTS = [
    None, "", " ", "\n\n  \t x", "Hello  world's   end… it'll don't 12 3a4 été ß", "a" * 5000, "<|endoftext|>", "x <|endoftext|> y<|endoftext|>",
    "中文 text 　 \u0085 \x1c\x1d ​ \U0001f600\U0001f468‍\U0001f469", "tab\tand\x0bvertical\x0c feed\r\n ", "   nbsp ", " the the the" * 3000, "é combining", "٠١ ²½ İı",
]


def test_counts_equal_the_library(spark):
    library = Tokenizer.from_file(PATH)
    docs = spark.createDataFrame([(i, t, 7) for i, t in enumerate(TEXTS)] + [(None, "the end", 1), (3, TEXTS[3], 1)], "doc_id long, text string, n_tokens long").repartition(3)
    rows = T.token_counts(docs, PATH).collect()
    assert len(rows) == len(TEXTS) + 2
    for r in rows:
        text = (TEXTS[r.doc_id] if r.doc_id is not None else "the end") or ""
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(text.encode()), n := len(library.encode(text, add_special_tokens=False).ids), n > 512)
    assert T.token_counts(docs.limit(0), PATH).count() == 0


def test_plain_characters_are_divided_as_the_library_divides():
    """Every plain character, alone and beside letters, digits, signs and spaces."""
    library = Tokenizer.from_file(PATH)
    counter = T.Counter2Tier(PATH, {})
    plain = [c for c in map(chr, range(0x110000)) if not 0xD800 <= ord(c) < 0xE000 and regex.fullmatch(T.PLAIN, c)]
    assert len(plain) > 800
    text = "".join(f"{c}a{c}1{c}. {c} {c}{c}\n" for c in plain)
    spans = [s for _, s in library.pre_tokenizer.pre_tokenize_str(text)]
    assert [text[a:b] for a, b in spans] == counter.divided(text)


@pytest.mark.parametrize("size", [1, 50])
def test_table_is_bounded_and_exact(spark, size):
    docs = spark.createDataFrame([(i, "the cat and the dog " * (i + 1)) for i in range(5)] * 3, "doc_id long, text string")
    table = T.frequent_lengths(docs, PATH, table_size=size)
    assert 0 < len(table) <= size and table[" the"] == 1
