"""Language identification with string kernels.

A text is the set of its character n-grams of all lengths up to ``order`` (lower case, white space runs as one space),
hashed into 65,536 buckets. The blended-spectrum presence kernel of two texts is the number of buckets they share
over the geometric mean of their bucket counts. Kernel ridge regression, one language against the rest, is fitted in
the feature space that Nystroem landmarks span. As the kernel is linear in the buckets, the landmark matrix and the
regression weights multiply to one matrix of buckets by languages; batches of texts are scored by one product with it.

Null texts and texts without a letter are ``und`` with score 0. Without a labelled text every row is ``und``. Rows keep
their number and order of columns whatever else the table holds; repeated rows get equal results; a tie goes to the
language that sorts first. Whole texts count, in steps of bounded memory.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wiregrain.llm.rows import portions, released, require

BUCKETS = 1 << 16
#: Score below which a text has no language: no better than a text that shares nothing with any landmark.
LEAST_SCORE = 0.1
_STEP = 1 << 20
#: Sets that are unpacked at a time, 256 KB each.
_BLOCK = 64
#: Characters of words; letters are among them, but so are numbers such as one half or circled digits.
_WORD = re.compile(r"[^\W\d_]")
_SPACE = re.compile(r"\s+")
_MULTIPLIER = np.uint32(2654435761)


def has_letter(text: str) -> bool:
    """Whether a character of the text is a letter (Unicode category L, as in the choice of texts to fit on)."""
    return any(unicodedata.category(m[0])[0] == "L" for m in _WORD.finditer(text))


def mark_grams(text: str, order: int, seen: np.ndarray) -> None:
    """Set the entries of ``seen`` whose buckets hold an n-gram of the text."""
    text = _SPACE.sub(" ", text.lower())
    text = f" {text.strip()} "
    for at in range(0, len(text), _STEP):
        codes = np.frombuffer(text[at : at + _STEP + order - 1].encode("utf-32-le", "surrogatepass"), np.uint32)
        rolled = np.zeros(len(codes), np.uint32)
        for n in range(1, order + 1):
            if len(codes) < n:
                break
            rolled = (rolled[: len(codes) - n + 1] + codes[n - 1 :] + np.uint32(n)) * _MULTIPLIER
            rolled ^= rolled >> np.uint32(15)
            seen[rolled & np.uint32(BUCKETS - 1)] = 1


@dataclass
class LanguageModel:
    languages: list[str]
    weights: np.ndarray  # buckets x languages
    order: int


def _bucket_rows(order: int):
    """mapInArrow function: (lang, pick, text) to (lang, pick, buckets)."""

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches, "text"):
            sets = []
            for value in batch.column(2).to_pylist():
                seen = np.zeros(BUCKETS, np.uint8)
                mark_grams(value, order, seen)
                sets.append(np.packbits(seen).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sets, pa.binary())], ["lang", "pick", "buckets"])

    return run


def _unpacked(rows: list[bytes]) -> np.ndarray:
    return np.stack([np.unpackbits(np.frombuffer(r, np.uint8)) for r in rows]).astype(np.float32)


def _shared(one: list[bytes], two: list[bytes]) -> np.ndarray:
    """How many buckets each set of ``one`` shares with each of ``two``: whole numbers, exact in any blocks."""
    out = np.empty((len(one), len(two)))
    for at in range(0, len(one), _BLOCK):
        own = _unpacked(one[at : at + _BLOCK])
        for to in range(0, len(two), _BLOCK):
            out[at : at + _BLOCK, to : to + _BLOCK] = own @ _unpacked(two[to : to + _BLOCK]).T
    return out


def fit(
    labelled: DataFrame,
    text: str = "text",
    lang: str = "lang",
    order: int = 4,
    rows_per_language: int = 300,
    landmarks_per_language: int = 32,
    ridge: float = 0.05,
    most_languages: int = 300,
) -> LanguageModel | None:
    """Fit on at most ``rows_per_language`` distinct texts of each language, those with the smallest hashes.

    8 KB for each of these rows reach the driver, whatever their length, and stay packed there. More than ``most_languages`` labels are an
    error: such a column holds no languages.
    """
    rows = require(labelled, lang, text).toDF("lang", "text").filter("lang is not null and text is not null")
    rows = rows.filter(F.regexp_like("text", F.lit(r"\p{L}"))).withColumn("pick", F.xxhash64("text"))
    # Of each language about four times as many hashes as wanted are ranked, the smallest, by a threshold from its size;
    # so a language with a third of all rows sends no more to one task than any other.
    sizes = rows.groupBy("lang").agg(F.approx_count_distinct("pick").alias("texts"))
    part = F.col("pick").cast("double") / 2.0**64 + 0.5
    low = rows.select("lang", "pick").join(F.broadcast(sizes.limit(most_languages + 1)), "lang").filter(part * F.col("texts") <= 4 * rows_per_language)
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("pick"))
    picks = low.select("lang", "pick").distinct().withColumn("rank", rank).filter(F.col("rank") <= rows_per_language)
    picks = picks.select("lang", "pick").limit(most_languages * rows_per_language + 1)
    # Bounded by the limit above: at most 1.5 MB of hashes.
    chosen = rows.join(F.broadcast(picks), ["lang", "pick"]).groupBy("lang", "pick").agg(F.min("text").alias("text"))
    found = sorted(chosen.select("lang", "pick", "text").mapInArrow(_bucket_rows(order), "lang string, pick long, buckets binary").collect())
    languages = sorted({r.lang for r in found})
    if len(languages) > most_languages:
        raise ValueError(f"more than {most_languages} languages in column {lang}")
    if not languages:
        return None
    # Sets stay packed, 8 KB each; a block at a time is unpacked.
    sets = [bytes(r.buckets) for r in found]
    norms = np.sqrt([int.from_bytes(x).bit_count() for x in sets])
    targets = np.array([[r.lang == x for x in languages] for r in found], np.float64)
    held: dict[str, int] = {}
    landmark = []
    for i, r in enumerate(found):
        held[r.lang] = held.get(r.lang, 0) + 1
        if held[r.lang] <= landmarks_per_language:
            landmark.append(i)
    base = [sets[i] for i in landmark]
    kernel = _shared(sets, base) / (norms[:, None] * norms[landmark])
    values, vectors = np.linalg.eigh(kernel[landmark])
    keep = values > 1e-6 * values.max()
    whiten = vectors[:, keep] / np.sqrt(values[keep])
    features = kernel @ whiten
    inner = features.T @ features + ridge * len(found) / len(languages) * np.eye(features.shape[1])
    solved = whiten @ np.linalg.solve(inner, features.T @ targets) / norms[landmark][:, None]
    weights = np.zeros((BUCKETS, len(languages)))
    for at in range(0, len(base), _BLOCK):
        weights += _unpacked(base[at : at + _BLOCK]).T @ solved[at : at + _BLOCK]
    return LanguageModel(languages, weights.astype(np.float32), order)


def _scored(fitted: LanguageModel | None, texts: list[str]) -> tuple[list[str], np.ndarray]:
    """Language and score of each text."""
    known = [i for i, t in enumerate(texts) if fitted is not None and has_letter(t)]
    langs, scores = ["und"] * len(texts), np.zeros(len(texts))
    for at in range(0, len(known), 64):
        own = known[at : at + 64]
        seen = np.zeros((len(own), BUCKETS), np.uint8)
        for row, i in zip(seen, own, strict=True):
            mark_grams(texts[i], fitted.order, row)
        norm = np.sqrt(np.maximum(seen.sum(axis=1, dtype=np.int64), 1))
        found = (seen.astype(np.float32) @ fitted.weights) / norm[:, None]
        best = found.argmax(axis=1)
        scores[own] = np.clip(found[np.arange(len(own)), best], 0, 1)
        for i, b in zip(own, best, strict=True):
            langs[i] = fitted.languages[b]
    return langs, scores


def predict(docs: DataFrame, model: LanguageModel | None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Key, lang_pred and score (0 to 1) of every row; only the text is looked at."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches, text):
            langs, scores = _scored(shared.value, pc.fill_null(batch.column(1), "").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(langs, pa.string()), pa.array(scores)], ["key", "lang_pred", "score"])

    kind = docs.schema[key].dataType.simpleString()
    return require(docs, key, text).mapInArrow(run, f"key {kind}, lang_pred string, score double").withColumnRenamed("key", key)


def keep_identified(docs: DataFrame, model: LanguageModel | None, text: str = "text", least: float = LEAST_SCORE) -> DataFrame:
    """The rows whose text has a language with a score of ``least`` or more, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    place = docs.columns.index(text)

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches, text):
            langs, scores = _scored(shared.value, pc.fill_null(batch.column(place), "").to_pylist())
            yield batch.filter(pa.array([x != "und" and s >= least for x, s in zip(langs, scores.tolist(), strict=True)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
