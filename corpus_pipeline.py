"""A corpus pipeline of five stages over documents; each stage's rows are written as Parquet
and read again as the next one's input.

Toxic documents go, low-quality documents go (and lines that fail go from those that stay), one
document of each near-duplicate class stays, documents contaminated by benchmark items go, and
what is left is encoded.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siteloom.llm import bpe, decontam, jaccard, quality, toxicity
from siteloom.llm.common import remove, shared_dir, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain doesn't call toxic; it is fitted on docs and labels."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.predict(docs, model).where(~F.col("toxic")).select(*docs.columns)


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules, without their failed lines; n_chars follows."""
    kept = quality.judge(docs).where("kept")
    text = F.col("clean_text")
    made = {"text": text, "n_chars": F.char_length(text).cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {"text": text}
    return kept.select(*(made[c].alias(c) if c in made else F.col(c) for c in docs.columns))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least doc_id of each class; documents without an id stay."""
    told = jaccard.join(docs)
    repeated = told.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1")
    gone = told.where("doc_id <> class_id").select("doc_id").distinct()
    kept = docs.join(gone.hint("shuffle_hash"), "doc_id", "left_anti").select(*docs.columns)
    if repeated.isEmpty():
        return kept
    return kept.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"]).unionByName(kept.where("doc_id IS NULL"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that benchmark items don't contaminate."""
    found = decontam.find(docs, table(spark, sf_dir, "benchmark"))
    return found.where(~F.col("contaminated")).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and token_ids; the ids are decoded again, and a text that doesn't come
    back byte for byte is an error."""
    back = bpe.decode(bpe.encode(docs.select("doc_id", "text"), keep_text=True))
    same = F.coalesce(F.col("text"), F.lit("")).cast("binary") == F.col("decoded")
    checked = F.when(same, F.col("token_ids")).otherwise(F.raise_error(F.lit("a text doesn't survive its encoding")))
    return back.select("doc_id", F.size("token_ids").cast("long").alias("n_tokens"), checked.alias("token_ids"))


STAGES = [
    ("toxicity", drop_toxic),
    ("quality_rules", drop_low_quality),
    ("ngram_jaccard_join", drop_near_duplicates),
    ("benchmark_decontamination", drop_contaminated),
    ("byte_bpe", encode),
]

#: SQL expresses neither the classifier, nor the join's classes, nor the encoding.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn over the whole table documents; what a stage has read is deleted."""
    docs = table(spark, sf_dir, "documents")
    base = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{k}-{name}")
        docs = spark.read.parquet(f"{base}/{k}-{name}")
        if k:
            remove(spark, f"{base}/{k - 1}-{STAGES[k - 1][0]}")
    return docs
