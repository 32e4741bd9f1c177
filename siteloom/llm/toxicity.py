"""Operator 9, toxicity by a classifier chain.

The labelled categories are predicted one after the other (here: low quality, then toxic);
each model is linear over the presence of words, and each later model also sees the log-odds
of the earlier categories. In training these come from out-of-fold predictions, so a later
model learns from probabilities as good as those it will see. A category's threshold is the
one with the best F1 over the out-of-fold predictions.

Fitting takes the FIT_ROWS labelled documents with the least hash of their id (a documented
bound) and the VOCABULARY most frequent words of these; each model keeps the FEATURES words
with the largest chi-square in its own training rows. Prediction reads every whole text once,
with a broadcast of at most (categories * FEATURES) words.

Words are runs of 0-9, a-z (A-Z lower-cased) and anything beyond ASCII.

Defined results: a null or wordless text has the models' base rates and is toxic only if these
pass the threshold. Label rows with a null id or without a document are left out; a null label
leaves the row out of that category; several label rows of one id count as positive if one is.
Of several documents with one id, fitting takes that whose words come first in order.
Without labels every probability is 0 and nothing is toxic. Repeated documents are judged alike.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siteloom.llm.common import cut, small_batches, table, utf8, widen
from siteloom.llm.decontam import words

FIT_ROWS, VOCABULARY, FEATURES, FOLDS = 4000, 50_000, 400, 5
MIN_WORD_ROWS, RIDGE, STEPS = 5, 1.0, 12
CHAIN = ("low_quality", "toxic")


def labelled(labels: DataFrame) -> DataFrame:
    """doc_id and one 0/1 column for each category of the chain."""
    return (
        labels.where("doc_id IS NOT NULL")
        .groupBy("doc_id")
        .agg(F.max((F.col("quality") == 0).cast("int")).alias("low_quality"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    )


class Linear:
    """Logistic regression with a ridge, fitted by Newton steps over a few chosen words."""

    def __init__(self, rows: list[np.ndarray], extra: np.ndarray, y: np.ndarray, size: int):
        self.base = float(np.clip(y.mean() if len(y) else 0.0, 0, 1))
        self.chosen = np.empty(0, np.int64)
        if not len(y) or self.base in (0.0, 1.0):
            self.beta = np.zeros(1 + extra.shape[1])
            self.beta[0] = -20.0 if self.base < 0.5 else 20.0
            return
        flat = np.concatenate(rows) if rows else np.empty(0, np.int64)
        owner = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
        n, p = len(y), y.sum()
        df, pos = np.bincount(flat, minlength=size).astype(float), np.bincount(flat, weights=y[owner], minlength=size)
        expected = df * p / n
        rest = np.maximum(1e-9, n - df)
        chi = np.where(df >= MIN_WORD_ROWS, n * (n * (pos - expected)) ** 2 / (np.maximum(1e-9, df * rest) * p * (n - p)), 0)
        self.chosen = np.sort(np.argsort(-chi, kind="stable")[:FEATURES])
        self.chosen = self.chosen[chi[self.chosen] > 0]
        x = self.matrix(rows, extra)
        beta = np.zeros(x.shape[1])
        beta[0] = np.log(self.base / (1 - self.base))
        ridge = np.full(x.shape[1], RIDGE)
        ridge[0] = 1e-6
        for _ in range(STEPS):
            q = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
            gradient = x.T @ (q - y) + ridge * beta
            step = np.linalg.solve((x * (q * (1 - q))[:, None]).T @ x + np.diag(ridge), gradient)
            beta -= step
            if np.abs(step).max() < 1e-6:
                break
        self.beta = beta

    def matrix(self, rows: list[np.ndarray], extra: np.ndarray) -> np.ndarray:
        x = np.zeros((len(rows), 1 + extra.shape[1] + len(self.chosen)))
        x[:, 0] = 1
        x[:, 1 : 1 + extra.shape[1]] = extra
        for i, r in enumerate(rows):
            at = np.searchsorted(self.chosen, r)
            at = at[(at < len(self.chosen)) & (self.chosen[np.minimum(at, len(self.chosen) - 1)] == r)] if len(self.chosen) else at[:0]
            x[i, 1 + extra.shape[1] + at] = 1
        return x

    def logits(self, rows: list[np.ndarray], extra: np.ndarray) -> np.ndarray:
        return np.clip(self.matrix(rows, extra) @ self.beta, -20, 20)


def _threshold(p: np.ndarray, y: np.ndarray) -> float:
    """The probability from 0.2 to 0.8 with the best F1; 0.5 among equals, else the nearest."""
    best = (-1.0, 0.0, 0.5)
    for t in np.arange(20, 81) / 100:
        hit = p >= t
        f1 = 2 * (hit & (y == 1)).sum() / max(1, hit.sum() + (y == 1).sum())
        best = max(best, (f1, -abs(t - 0.5), float(t)))
    return best[2]


def train(rows: list[np.ndarray], y: np.ndarray, fold: np.ndarray, size: int) -> list[dict]:
    """The chain. y: a column for each category, -1 where unlabelled; fold: 0 to FOLDS - 1."""
    chain, extra = [], np.zeros((len(rows), 0))
    pick = lambda at: [rows[i] for i in at]
    for c in range(y.shape[1]):
        out = np.zeros(len(rows))
        for k in range(FOLDS):
            fit, held = np.flatnonzero((fold != k) & (y[:, c] >= 0)), np.flatnonzero(fold == k)
            if len(held):
                out[held] = Linear(pick(fit), extra[fit], y[fit, c].astype(float), size).logits(pick(held), extra[held])
        known = np.flatnonzero(y[:, c] >= 0)
        full = Linear(pick(known), extra[known], y[known, c].astype(float), size)
        chain.append({"words": full.chosen, "beta": full.beta, "threshold": _threshold(1 / (1 + np.exp(-out[known])), y[known, c])})
        extra = np.column_stack([extra, out])
    return chain


def fit(docs: DataFrame, labels: DataFrame) -> dict:
    """The fitted chain, over a bounded sample of the labelled documents."""
    spark = docs.sparkSession
    small_batches(spark)
    sample = labelled(labels).orderBy(F.xxhash64("doc_id"), "doc_id").limit(FIT_ROWS)  # so its broadcast is bounded

    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [sorted(set(words(t))) for t in utf8(batch.column(0))]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.binary())), *batch.columns[1:]], names=["words", "doc_id", *CHAIN])

    texts = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select("text", "doc_id", *CHAIN)
    kinds = ", ".join(f"{c} int" for c in CHAIN)
    every = cut(texts.mapInArrow(distinct, f"words array<binary>, doc_id {docs.schema['doc_id'].dataType.simpleString()}, {kinds}"))
    # Ids may repeat in the documents; one row for each keeps what follows within FIT_ROWS.
    sampled = cut(every.groupBy("doc_id").agg(F.min(F.struct("words", *CHAIN)).alias("x")).select("doc_id", "x.*"))
    counted = sampled.select(F.explode("words").alias("word")).groupBy("word").count().where(f"count >= {MIN_WORD_ROWS}")
    vocabulary = {bytes(r[0]): i for i, r in enumerate(counted.orderBy(F.desc("count"), "word").limit(VOCABULARY).collect())}
    shared = spark.sparkContext.broadcast(vocabulary)

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            known = shared.value
            ids = [sorted(known[w] for w in row if w in known) for row in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.list_(pa.int32())), *batch.columns[1:]], names=["ids", "fold", *CHAIN])

    folds = sampled.select("words", F.pmod(F.hash("doc_id"), F.lit(FOLDS)).alias("fold"), *CHAIN)
    rows = folds.mapInArrow(number, f"ids array<int>, fold int, {kinds}").collect()  # FIT_ROWS documents
    rows.sort(key=lambda r: (r["fold"], r["ids"], *(r[c] is None or r[c] for c in CHAIN)))
    if not rows or not vocabulary:
        return {"chain": []}
    y = np.array([[-1 if r[c] is None else r[c] for c in CHAIN] for r in rows], np.int64)
    chain = train([np.array(r["ids"], np.int64) for r in rows], y, np.array([r["fold"] for r in rows]), len(vocabulary))
    names = {i: w for w, i in vocabulary.items()}
    return {"chain": [{"threshold": m["threshold"], "head": m["beta"][: 1 + c].tolist(), "weights": {names[int(j)]: float(b) for j, b in zip(m["words"], m["beta"][1 + c :])}} for c, m in enumerate(chain)]}


def judge_text(text: bytes | None, chain: list[dict]) -> list[float]:
    """The probability of each category, in the order of the chain."""
    own, logits = set(words(text)), []
    for model in chain:
        weights = model["weights"]
        z = model["head"][0] + sum(b * z0 for b, z0 in zip(model["head"][1:], logits))
        z += sum(weights[w] for w in sorted(weights.keys() & own))
        logits.append(min(20.0, max(-20.0, z)))
    return [1 / (1 + float(np.exp(-z))) for z in logits]


def predict(docs: DataFrame, model: dict, keep_text: bool = True) -> DataFrame:
    """Adds p_<category> for each category and toxic."""
    shared = docs.sparkSession.sparkContext.broadcast(model["chain"])
    docs = docs.drop("toxic", *(f"p_{c}" for c in CHAIN))

    def rows(batch: pa.RecordBatch) -> list:
        chain = shared.value
        told = [judge_text(t, chain) if chain else [0.0] * len(CHAIN) for t in utf8(batch.column(batch.schema.get_field_index("text")))]
        toxic = [bool(chain) and p[-1] >= chain[-1]["threshold"] for p in told]
        return [pa.array([p[i] for p in told], pa.float64()) for i in range(len(CHAIN))] + [pa.array(toxic, pa.bool_())]

    fields: list[tuple] = [(f"p_{c}", T.DoubleType()) for c in CHAIN] + [("toxic", T.BooleanType())]
    return widen(docs, fields, rows, () if keep_text else ("text",))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    return predict(documents, fit(documents, table(spark, sf_dir, "labels")), keep_text=False)
