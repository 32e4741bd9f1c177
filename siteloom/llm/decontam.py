"""Operator 5, benchmark decontamination with an Aho-Corasick automaton.

Texts and benchmark items are normalised alike: A-Z lower-cased, words are runs of 0-9, a-z
and anything beyond ASCII. A window is 13 consecutive words of an item; an item of fewer words
is one window. The automaton holds the windows as sequences of word numbers and reads each
text once; word offsets are then mapped to character spans of the original text.

The automaton is rebuilt in each Python worker from the broadcast words of the items. It is one
automaton, and the text is read once, for benchmarks of up to BLOCK_WORDS words. Larger ones go
into blocks of about as many words (long items are cut into overlapping segments), so that what
is broadcast and what a worker holds (one automaton at a time) has a fixed bound: each block is a
pass of its own, which writes the rows with their hits to the shared folder before its broadcast is
freed and the next pass adds to them. A pass deletes what the one before it wrote, so that two
copies of the documents are stored at most, and one is left. Nothing is shuffled.

Defined results: null and empty texts have no words, no hits, no items and are clean. Null and
wordless items have no windows. An item with a null id is reported as the empty string; an
item_id on several rows counts once. Repeated documents give repeated rows. Other columns are
kept; those with a result's name are replaced. Empty tables give no rows, or no hits. Texts of
any length are read whole; a worker holds the words of one text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from uuid import uuid4

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siteloom.llm.common import cut, remove, shared_dir, small_batches, table, texts, utf8, widen

WINDOW = 13
#: Item words in one automaton (about 13 nodes a word, 200 MB in all).
BLOCK_WORDS = 200_000
SEGMENT_WORDS = 10_000

_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_TABLE = bytes(b if b >= 0x80 or chr(b) in "0123456789abcdefghijklmnopqrstuvwxyz" else 0x20 for b in bytes(range(256)).lower())


def words(text: bytes | None) -> list[bytes]:
    """The normalised words of UTF-8 text; bytes beyond ASCII are never white space here."""
    return text.translate(_TABLE).split() if text else []


def segments(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """(item_id string, words, n): the normalised words of the items, long ones in parts that
    overlap by a window less one word."""
    small_batches(benchmark.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for item, text in zip(batch.column(0).to_pylist(), utf8(batch.column(1))):
                w = words(text)
                for at in range(0, max(1, len(w) - window + 1), SEGMENT_WORDS) if w else ():
                    part = w[at : at + SEGMENT_WORDS + window - 1]
                    out.append((item, b" ".join(part), len(part)))
            cols = list(zip(*out)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.binary()), pa.array(cols[2], pa.int64())], names=["item_id", "words", "n"])

    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), "text")
    return items.mapInArrow(run, "item_id string, words binary, n long")


class _Vocabulary(dict):
    def __missing__(self, _):
        return 0


_HELD: dict = {}


def _automaton_of(name: str, shared, window: int):
    """The automaton of a broadcast block. A worker keeps the last one only."""
    if name not in _HELD:
        _HELD.clear()
        _HELD[name] = _automaton(shared.value, window)
    return _HELD[name]


def _automaton(block: tuple[tuple[str, bytes], ...], window: int):
    """(automaton of word numbers, vocabulary); a key's value is its length and its items."""
    import ahocorasick

    vocabulary, keys = _Vocabulary(), {}
    for item, joined in block:
        ids = [vocabulary.setdefault(w, len(vocabulary) + 1) for w in joined.split()]
        for at in range(max(1, len(ids) - window + 1)):
            keys.setdefault(tuple(ids[at : at + window]), set()).add(item)
    automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
    for key, items in keys.items():
        automaton.add_word(key, (len(key), items))
    automaton.make_automaton()
    return automaton, vocabulary


def _merge(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Unions of [first, last) word ranges that touch or overlap."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def spans(text: str, ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Character spans of the original text for ranges of words."""
    at = [m.span() for m in _WORD.finditer("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text))]
    return [(at[a][0], at[b - 1][1]) for a, b in ranges]


_RANGES = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
_PA_RANGES = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
_FIELDS = [("n_words", T.LongType()), ("hit_ranges", _RANGES), ("hit_items", T.ArrayType(T.StringType()))]


def _scan(docs: DataFrame, shared, window: int, first: bool) -> DataFrame:
    """shared: the broadcast block."""
    name = uuid4().hex

    def rows(batch: pa.RecordBatch) -> list:
        column = lambda name: batch.column(batch.schema.get_field_index(name))
        automaton, vocabulary = _automaton_of(name, shared, window)
        number = vocabulary.__getitem__
        counts, ranges, items = [], [], []
        before = [None] * batch.num_rows if first else column("hit_ranges").to_pylist()
        known = [None] * batch.num_rows if first else column("hit_items").to_pylist()
        for text, old, had in zip(utf8(column("text")), before, known):
            w = words(text)
            found: list[tuple[int, int]] = [(x["start"], x["end"]) for x in old or ()]
            names: set[str] = set(had or ())
            if w and len(automaton):
                for end, (length, of) in automaton.iter(tuple(map(number, w))):
                    found.append((end + 1 - length, end + 1))
                    names |= of
            counts.append(len(w))
            ranges.append([{"start": a, "end": b} for a, b in _merge(found)])
            items.append(sorted(names))
        return [pa.array(counts, pa.int64()), pa.array(ranges, _PA_RANGES), pa.array(items, pa.list_(pa.string()))]

    return widen(docs, _FIELDS, rows, () if first else tuple(n for n, _ in _FIELDS))


def find(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """docs (with a column text) and n_words, n_hit, hit_ranges (of words), hit_items (strings,
    sorted), contaminated: at least a twentieth of the words is hit."""
    docs = docs.drop("n_words", "n_hit", "hit_ranges", "hit_items", "contaminated")
    items = cut(segments(benchmark, window))
    total = items.agg(F.sum("n")).first()[0] or 0
    blocks = max(1, -(-total // block_words))
    spark, folder = docs.sparkSession, f"{shared_dir(docs.sparkSession)}/decontam-{uuid4().hex}"
    for b in range(blocks):
        mine = items.where(F.pmod(F.xxhash64("item_id", "words"), F.lit(blocks)) == b)
        rows = mine.select("item_id", "words").distinct().collect()  # about block_words words
        shared = spark.sparkContext.broadcast(tuple(sorted((r[0], bytes(r[1])) for r in rows)))
        docs = _scan(docs, shared, window, b == 0)
        if b < blocks - 1:
            schema = docs.schema
            docs.write.parquet(f"{folder}/{b}")
            docs = spark.read.schema(schema).parquet(f"{folder}/{b}")
            shared.unpersist()
            if b:
                remove(spark, f"{folder}/{b - 1}")
    hit = F.aggregate("hit_ranges", F.lit(0).cast("long"), lambda n, r: n + r["end"] - r["start"])
    return docs.withColumn("n_hit", hit).withColumn("contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * 20 >= F.col("n_words")))


def with_spans(found: DataFrame) -> DataFrame:
    """Adds hit_spans: the hit ranges as character offsets of the original text."""

    def rows(batch: pa.RecordBatch) -> list:
        column = lambda name: batch.column(batch.schema.get_field_index(name))
        out = []
        for text, ranges in zip(texts(column("text")), column("hit_ranges").to_pylist()):
            out.append([{"start": a, "end": b} for a, b in spans(text or "", [(x["start"], x["end"]) for x in ranges])] if ranges else [])
        return [pa.array(out, _PA_RANGES)]

    return widen(found, [("hit_spans", _RANGES)], rows)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("hit_items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("hit_items"), ","), 256).alias("items_sha256"),
        "contaminated",
    )


ORACLE = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), win AS (
  SELECT DISTINCT item_id, least(len(w), 13) AS n, array_to_string(list_slice(w, i, i + least(len(w), 13) - 1), ' ') AS k
  FROM (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - 12) + 1)) AS i FROM b WHERE len(w) > 0)
), spot AS (
  SELECT doc_id, n, i, array_to_string(list_slice(w, i, i + n - 1), ' ') AS k
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM win) WHERE len(w) >= n)
), hits AS (
  SELECT a.doc_id, a.i, a.n, win.item_id FROM spot a JOIN win ON a.n = win.n AND a.k = win.k
), hit_words AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id
), hit_items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hits) GROUP BY doc_id
)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit_words USING (doc_id) LEFT JOIN hit_items USING (doc_id)
"""
