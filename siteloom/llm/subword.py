"""Operator 13, a quality classifier over supervised subword embeddings.

A text is the mean of learned vectors of its words, word bigrams and character n-grams (of SIZES
characters, with a space at both ends of a word), all hashed to BUCKETS vectors of SIZE numbers; a
softmax over that mean gives the score. Vectors and softmax are trained together by stochastic
gradient descent in numpy, one text a step, over a fixed number of epochs with a falling rate.

A word bigram is hashed by the difference of its words' hashes. So the bigram of a word with itself
is one feature whatever the word, and immediate repetition can be learned.

Fitting takes the FIT_ROWS labelled documents with the least hash of their id, fewer if these hold
more than FIT_FEATURES features (documented bounds), and runs in one task; only BUCKETS numbers and the bias come back, as the softmax is linear: the
log-odds of a text are the mean of its features' own log-odds. Scoring reads every whole text once,
in slices of at most SLICE characters, cut at white space where the slice has any; slices are summed.

Words are what white space separates, lower-cased; a run of more than SLICE characters counts as
several words, and bigrams don't cross slices.

Defined results: an empty or null text has the score of the bias alone. Without labels of both kinds
every score is the share of label 1, or 0.5 without any. Label rows with a null id or label are left
out; several label rows of one id count as 1 only if all are. Of several documents with one id,
fitting takes that whose text comes first in order; all are scored. Repeated texts score alike; an
empty table gives no rows. Other columns are kept; score and predicted are replaced if there.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siteloom.llm.common import small_batches, table, texts, widen

#: Bounds of the fitted sample (texts, and distinct features of all of them) and of the model.
FIT_ROWS, FIT_FEATURES, BUCKETS, SIZE = 4000, 40_000_000, 1 << 16, 16
SIZES, SLICE = (3, 4, 5), 1 << 18
RATE, EPOCHS, SEED, THRESHOLD = 0.5, 5, 1, 0.3

_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD)]
_LOW, _HIGH = np.uint64(29), np.uint64(48)


def slices(text: str) -> Iterator[str]:
    """A text in slices of at most SLICE characters that end at white space where they can."""
    at = 0
    while len(text) - at > SLICE:
        part = text[at : at + SLICE]
        white = max(part.rfind(c) for c in " \n\t\r\v\f")
        end = at + (white + 1 if white > 0 else SLICE)
        yield text[at:end]
        at = end
    yield text[at:]


def _scramble(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _LOW)) * _MIX[4]
    return h ^ (h >> np.uint64(32))


def features(text: str) -> np.ndarray:
    """The features of a slice, one for each occurrence: word, bigram and n-gram buckets."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    white = (points == 0x20) | ((points >= 0x09) & (points <= 0x0D))
    flat = np.zeros(len(points) + 2, np.uint64)
    flat[1:-1] = np.where(white, 0, points)
    keep = np.ones(len(flat), np.bool_)
    keep[1:] = (flat[1:] != 0) | (flat[:-1] != 0)
    flat = flat[keep]
    inside = flat != 0
    start = np.flatnonzero(inside[1:] & ~inside[:-1]) + 1
    if not len(start):
        return np.empty(0, np.int64)
    # Words: a sum over their characters, each scrambled with its place in the word.
    place = np.arange(len(flat)) - np.repeat(np.concatenate([[0], start]), np.diff(np.concatenate([[0], start, [len(flat)]])))
    words = np.add.reduceat(np.where(inside, _scramble((flat + place.astype(np.uint64) * _MIX[0]) * _MIX[1]), 0), start)
    found = [_scramble(words * _MIX[3]), _scramble((words[1:] - words[:-1]) * _MIX[0] + _MIX[2])]
    for n in SIZES:
        size = len(flat) - n + 1
        if size > 0:
            h, whole = np.full(size, n, np.uint64), np.ones(size, np.bool_)
            for k in range(n):
                h = (h ^ flat[k : size + k]) * _MIX[k % 5]
                h ^= h >> _LOW
                if 0 < k < n - 1:
                    whole &= inside[k : size + k]
            found.append(h[whole])
    return ((np.concatenate(found) * _MIX[3]) >> _HIGH).astype(np.int64) % BUCKETS


def weights(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(features, share of each) of a whole text."""
    counts = np.zeros(BUCKETS, np.int64)
    for part in slices(text or ""):
        counts += np.bincount(features(part), minlength=BUCKETS)
    at = np.flatnonzero(counts)
    return at, counts[at] / max(1, counts.sum())


def train(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray) -> tuple[np.ndarray, float]:
    """(log-odds of each bucket, bias) by stochastic gradient descent over (features, shares). A
    text's step is dealt to its features by their shares, at unit length, so that the texts with
    many features learn as fast as those with few."""
    share = y.mean() if len(y) else 0.5
    if share in (0.0, 1.0) or not len(y):
        return np.zeros(BUCKETS), float(np.log(max(share, 1e-9) / max(1 - share, 1e-9)))
    draw = np.random.default_rng(SEED)
    vectors = (draw.random((BUCKETS, SIZE), dtype=np.float32) - np.float32(0.5)) / np.float32(SIZE)
    softmax, bias = np.zeros((2, SIZE), np.float32), np.zeros(2, np.float32)
    steps, done = EPOCHS * len(rows), 0
    for _ in range(EPOCHS):
        for i in draw.permutation(len(rows)):
            at, part = rows[i][0], rows[i][1].astype(np.float32)
            rate = np.float32(RATE * (1 - done / steps))
            done += 1
            own = vectors[at]
            mean = part @ own
            z = softmax @ mean + bias
            error = np.exp(z - z.max())
            error /= error.sum()
            error[y[i]] -= 1
            back = error @ softmax
            softmax -= rate * np.outer(error, mean)
            bias -= np.float32(0.1) * rate * error
            if len(at):
                vectors[at] = own - (rate / np.sqrt(part @ part)) * part[:, None] * back
    return (vectors @ (softmax[1] - softmax[0])).astype(np.float64), float(bias[1] - bias[0])


def fit(docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, float]:
    """The model from a bounded sample of the labelled documents; labels: (doc_id, label 0 or 1)."""
    small_batches(docs.sparkSession)
    told = labels.where("doc_id IS NOT NULL AND label IS NOT NULL").groupBy("doc_id").agg(F.min((F.col("label") == 1).cast("int")).alias("y"))
    held = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    sample = told.join(docs.select("doc_id"), "doc_id", "left_semi").orderBy(F.xxhash64("doc_id"), "doc_id").limit(FIT_ROWS)  # so its broadcast is bounded
    one = held.join(F.broadcast(sample), "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text"))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            told = [weights(t) for t in texts(batch.column(2))]
            columns = [pa.array([a.astype(np.uint16).tobytes() for a, _ in told], pa.binary()), pa.array([w.astype(np.float32).tobytes() for _, w in told], pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], names=["h", "y", "at", "part"])

    def learned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, y, room = [], [], FIT_FEATURES
        for batch in batches:
            for label, at, part in zip(*(batch.column(c).to_pylist() for c in ("y", "at", "part"))):
                room -= len(at) // 2
                if room >= 0:
                    rows.append((np.frombuffer(at, np.uint16), np.frombuffer(part, np.float32)))
                    y.append(label)
        odds, bias = train(rows, np.array(y, np.int64))
        yield pa.RecordBatch.from_arrays([pa.array([odds.tobytes()], pa.binary()), pa.array([bias])], names=["odds", "bias"])

    found = one.select(F.xxhash64("doc_id").alias("h"), "y", "text").mapInArrow(counted, "h long, y int, at binary, part binary")
    made = found.repartition(1).sortWithinPartitions("h", "y", "at", "part").mapInArrow(learned, "odds binary, bias double").first()
    return (np.frombuffer(bytes(made["odds"]), np.float64), made["bias"]) if made else (np.zeros(BUCKETS), 0.0)


def score_text(text: str | None, odds: np.ndarray, bias: float) -> float:
    total = size = 0
    for part in slices(text or ""):
        found = features(part)
        total, size = total + odds[found].sum(), size + len(found)
    z = bias + (total / size if size else 0.0)
    return float(1 / (1 + np.exp(-np.clip(z, -700, 700))))


def predict(docs: DataFrame, model: tuple[np.ndarray, float], threshold: float = THRESHOLD, keep_text: bool = True) -> DataFrame:
    """Adds score and predicted, from the text alone."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def rows(batch: pa.RecordBatch) -> list:
        odds, bias = shared.value
        told = [score_text(t, odds, bias) for t in texts(batch.column(batch.schema.get_field_index("text")))]
        return [pa.array(told, pa.float64()), pa.array([int(x >= threshold) for x in told], pa.int32())]

    return widen(docs, [("score", T.DoubleType()), ("predicted", T.IntegerType())], rows, () if keep_text else ("text",))


def held_out(key: Column) -> Column:
    """Whether a row's label is kept from fitting; a null id is not."""
    return F.coalesce(F.crc32(key.cast("string")) % 5 == 0, F.lit(False))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
    model = fit(documents, labels.where(~held_out(F.col("doc_id"))))
    return predict(documents.withColumn("held_out", held_out(F.col("doc_id"))), model, keep_text=False)
