"""Operator 2, byte-level BPE with the tiktoken library and a local rank file.

Each match of the pre-tokenizer's pattern is encoded for itself and without special tokens.
Long texts are cut first, only at places where a match ends whatever surrounds it, so the ids
are those of the whole text while the library only ever sees bounded pieces (its own pattern
engine overflows on very long runs of white space; such a run is handed over as one match).

Safe places, by the pattern: before white space that follows anything else; after letters
before a non-letter; after digits before a non-digit; before the last of several white-space
characters that precede something else.

Defined results: a null text counts as empty (no tokens). Bytes that are not UTF-8 are read
as U+FFFD. Each row is treated for itself, so repeated rows give repeated results; an empty
table gives no rows. Other columns are kept; one that has the result's name is replaced.
"""

from __future__ import annotations

import base64
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siteloom.llm.common import table, texts, widen

VOCABULARY = "byte_bpe_50k.tiktoken"
#: Texts over so many characters are cut.
CHUNK = 1 << 16
#: A run of white space over so many characters is one match, which is encoded directly.
RUN = 1 << 14

_SAFE = regex.compile(r"(?<=\S)(?=\s)|(?<=\p{L})(?=\P{L})|(?<=\p{N})(?=\P{N})|(?<=\s)(?=\s\S)")
_RUN = regex.compile(r"\s{%d,}" % RUN)


@lru_cache(maxsize=4)
def encoding(name: str = VOCABULARY):
    """The library's encoder for a rank file: a name among the public tokenizers, or a path."""
    import public_tokenizers
    import tiktoken

    path = name if "/" in name else public_tokenizers.path(name)
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("local", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def _cut(text: str, chunk: int):
    at = 0
    while len(text) - at > chunk:
        found = _SAFE.search(text, at + chunk // 2)
        if not found or found.start() >= len(text):
            break
        yield text[at : found.start()]
        at = found.start()
    yield text[at:]


def pieces(text: str, chunk: int = CHUNK):
    """(piece, whether it is one match): cut at safe places only."""
    if len(text) <= chunk:
        yield text, False
        return
    at = 0
    for run in _RUN.finditer(text):
        end = run.end() if run.end() == len(text) else run.end() - 1
        for x in _cut(text[at : run.start()], chunk) if run.start() > at else ():
            yield x, False
        yield text[run.start() : end], True
        at = end
    if at < len(text):
        for x in _cut(text[at:], chunk):
            yield x, False


def encode_text(text: str | None, name: str = VOCABULARY, chunk: int = CHUNK) -> list[int]:
    if not text:
        return []
    enc = encoding(name)
    if len(text) <= chunk:
        return enc.encode_ordinary(text)
    ids: list[int] = []
    for piece, single in pieces(text, chunk):
        ids += enc._encode_single_piece(piece) if single else enc.encode_ordinary(piece)
    return ids


def encode(df: DataFrame, text: str = "text", out: str = "token_ids", name: str = VOCABULARY, keep_text: bool = False) -> DataFrame:
    """Adds the ids of the text, in place of the text unless keep_text."""

    def rows(batch: pa.RecordBatch) -> list:
        column = texts(batch.column(batch.schema.get_field_index(text)))
        return [pa.array([encode_text(t, name) for t in column], pa.list_(pa.int32()))]

    return widen(df, [(out, T.ArrayType(T.IntegerType()))], rows, () if keep_text else (text,))


def decode(df: DataFrame, ids: str = "token_ids", out: str = "decoded", name: str = VOCABULARY) -> DataFrame:
    """Adds the raw bytes of the ids; they need not be valid UTF-8. Null ids give no bytes."""

    def rows(batch: pa.RecordBatch) -> list:
        enc = encoding(name)
        column = batch.column(batch.schema.get_field_index(ids)).to_pylist()
        return [pa.array([enc.decode_bytes(x) if x else b"" for x in column], pa.binary())]

    return widen(df, [(out, T.BinaryType())], rows)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    return decode(encode(documents)).select(
        "doc_id",
        F.size("token_ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("token_ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
