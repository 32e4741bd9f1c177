"""Operator 4, language identification with bit-sliced Bloom filters of character n-grams.

Fitting: a bounded sample of labelled texts for each language (at most about FIT_ROWS a
language, chosen by a hash of the id) gives the share of texts with each n-gram. A language
owns an n-gram that at least MIN_SHARE of its texts have, and at least RATIO of the share of
the language that uses it most. All languages share one filter: each of its slots holds one
bit for each language, and the AND of an n-gram's slots returns all languages that own it.

Prediction: over the whole text, each language's bits are counted over all n-gram occurrences
(popcounts) and corrected for the filter's false positives, n * fill ** HASHES; the largest
corrected count decides. score is its share of the two largest.

Defined results: a null text, and one without a letter, is "und" with score 0. A text none of
whose n-grams is known gets the most frequent language with score 0. Without labelled rows
every text is "und". Repeated rows get the same result; an empty table gives no rows. Whole
texts count, however long. Other columns are kept; lang_pred and score are replaced if there.
More than MAX_LANGUAGES languages are an error.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siteloom.llm.common import cut, small_batches, table, texts, widen

#: Bounds of the fitted sample (rows a language), of the filter and of the languages.
FIT_ROWS, SLOTS, HASHES, MAX_LANGUAGES = 2000, 1 << 19, 2, 512
SIZES, MIN_SHARE, MIN_ROWS, RATIO = (3, 4), 0.01, 2, 0.25

_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), np.bool_, 0x110000)


def ngrams(text: str | None) -> np.ndarray:
    """64-bit hashes of the n-grams of a text, one for each occurrence; words are lower-cased
    letters with a space on both sides."""
    if not text:
        return np.empty(0, np.uint64)
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters()[points]
    if not letter.any():
        return np.empty(0, np.uint64)
    flat = np.zeros(len(points) + 2, np.uint64)
    flat[1:-1] = np.where(letter, points, 0)
    keep = np.ones(len(flat), np.bool_)
    keep[1:] = (flat[1:] != 0) | (flat[:-1] != 0)
    flat = flat[keep]
    out = []
    for n in SIZES:
        if len(flat) >= n:
            h = np.full(len(flat) - n + 1, n, np.uint64)
            for k in range(n):
                h = (h ^ flat[k : len(flat) - n + 1 + k]) * _MIX[k % 4]
                h ^= h >> np.uint64(29)
            out.append(h[_inside(flat, n)])
    return np.concatenate(out) if out else np.empty(0, np.uint64)


def _inside(flat: np.ndarray, n: int) -> np.ndarray:
    """n-grams without a space in the middle."""
    ok = np.ones(len(flat) - n + 1, np.bool_)
    for k in range(1, n - 1):
        ok &= flat[k : len(flat) - n + 1 + k] != 0
    return ok


def slots(h: np.ndarray) -> list[np.ndarray]:
    h = h * _MIX[0]
    return [((h >> np.uint64(7 + 24 * k)) % np.uint64(SLOTS)).astype(np.int64) for k in range(HASHES)]


def fit(docs: DataFrame, train: Column) -> tuple[list[str], np.ndarray, str | None]:
    """(languages, filter of shape (words, SLOTS), most frequent language) from the rows where
    train holds and lang is not null. Only the filter's slots, a fixed number, reach the driver."""
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.where(train & F.col("lang").isNotNull())
    counts = {r[0]: r[1] for r in rows.groupBy("lang").count().limit(MAX_LANGUAGES + 1).collect()}
    if len(counts) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    languages = sorted(counts)
    if not languages:
        return [], np.zeros((1, SLOTS), np.uint64), None
    share = F.create_map(*(x for c in languages for x in (F.lit(c), F.lit(min(1.0, FIT_ROWS / counts[c])))))
    number = F.create_map(*(x for i, c in enumerate(languages) for x in (F.lit(c), F.lit(i))))
    sample = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < share[F.col("lang")] * (1 << 30)).select(number[F.col("lang")].alias("l"), "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """For each batch: (language, n-gram, texts with it); n-gram null: texts at all."""
        for batch in batches:
            by: dict[int, list[np.ndarray]] = {}
            for lang, text in zip(batch.column(0).to_pylist(), texts(batch.column(1))):
                by.setdefault(lang, []).append(np.unique(ngrams(text)))
            for lang, found in by.items():
                grams, n = np.unique(np.concatenate(found), return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(grams) + 1, lang, np.int32)), pa.concat_arrays([pa.array(grams.astype(np.int64)), pa.array([None], pa.int64())]), pa.concat_arrays([pa.array(n.astype(np.int64)), pa.array([len(found)], pa.int64())])],
                    names=["l", "gram", "n"],
                )

    grams = cut(sample.mapInArrow(count, "l int, gram long, n long").groupBy("l", "gram").agg(F.sum("n").alias("n")).where(f"n >= {MIN_ROWS} OR gram IS NULL"))
    sizes = {r[0]: r[1] for r in grams.where("gram IS NULL").select("l", "n").collect()}
    total = F.create_map(*(x for k, v in sizes.items() for x in (F.lit(k), F.lit(float(v)))))
    shares = grams.where("gram IS NOT NULL").select("l", "gram", (F.col("n") / total[F.col("l")]).alias("share")).where(f"share >= {MIN_SHARE}")
    owned = (
        shares.groupBy("gram")
        .agg(F.max("share").alias("top"), F.collect_list(F.struct("l", "share")).alias("by"))  # one entry for each language
        .select("gram", F.explode(F.filter("by", lambda x: x["share"] >= F.col("top") * RATIO)).alias("x"))
        .select("gram", F.col("x.l").alias("l"))
    )

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = batch.column(0).to_numpy(zero_copy_only=False).astype(np.uint64)
            langs = batch.column(1).to_numpy(zero_copy_only=False)
            at = np.concatenate(slots(h))
            lang = np.tile(langs, HASHES).astype(np.int64)
            bits = np.left_shift(np.uint64(1), (lang % 64).astype(np.uint64)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(lang // 64), pa.array(bits)], names=["slot", "word", "bits"])

    filled = owned.mapInArrow(place, "slot long, word long, bits long").groupBy("word", "slot").agg(F.expr("bit_or(bits)").alias("bits"))
    table_ = np.zeros((-(-len(languages) // 64), SLOTS), np.uint64)
    for row in filled.collect():  # at most SLOTS rows for each 64 languages
        table_[row["word"], row["slot"]] = np.uint64(row["bits"] & 0xFFFFFFFFFFFFFFFF)
    return languages, table_, max(languages, key=lambda c: (counts[c], c))


def _decide(text: str | None, model: tuple) -> tuple[str, float]:
    languages, filled, usual, wrong = model
    h = ngrams(text)
    if not languages or not len(h) and not (text and any(map(str.isalpha, text))):
        return "und", 0.0
    if not len(h):
        return usual, 0.0
    at = slots(h)
    counts = np.zeros(len(languages))
    for w in range(filled.shape[0]):
        bits = filled[w][at[0]]
        for a in at[1:]:
            bits = bits & filled[w][a]
        values, n = np.unique(bits, return_counts=True)
        for k in range(64 * w, min(64 * w + 64, len(languages))):
            counts[k] = n[(values >> np.uint64(k % 64)) & np.uint64(1) == 1].sum()
    corrected = np.maximum(0.0, (counts - len(h) * wrong) / np.maximum(1e-9, 1 - wrong))
    order = np.argsort(-corrected, kind="stable")
    first, second = corrected[order[0]], corrected[order[1]] if len(order) > 1 else 0.0
    return (languages[order[0]], float(first / (first + second))) if first > 0 else (usual, 0.0)


def predict(docs: DataFrame, fitted: tuple[list[str], np.ndarray, str | None]) -> DataFrame:
    """Adds lang_pred and score from the text alone, in place of the text."""
    languages, filled, usual = fitted
    fill = np.array([((filled[k // 64] >> np.uint64(k % 64)) & np.uint64(1)).mean() for k in range(len(languages))])
    shared = docs.sparkSession.sparkContext.broadcast((languages, filled, usual, fill**HASHES))

    def rows(batch: pa.RecordBatch) -> list:
        model = shared.value
        told = [_decide(t, model) for t in texts(batch.column(batch.schema.get_field_index("text")))]
        return [pa.array([x[0] for x in told], pa.string()), pa.array([x[1] for x in told], pa.float64())]

    return widen(docs, [("lang_pred", T.StringType()), ("score", T.DoubleType())], rows, ("text",))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    fitted = fit(documents.select("doc_id", "text", "lang"), ~held_out)
    return predict(documents.select("doc_id", held_out.alias("held_out"), "text"), fitted)
