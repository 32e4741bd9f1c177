"""Operator 6, quality rules: line-first cleaning.

Each line with a word is judged by itself. It fails for its punctuation (no closing mark at
its end and no end of a sentence in its second half, or many exclamation runs), as navigation (many separators or symbols for its words)
or as boilerplate (a stock phrase in a line of at most PHRASE_WORDS words; a long line that
mentions one is prose). Failed lines are removed; a document that loses more than
half of its words with them is rejected, and so is one that fails the base rules (fewer than
10 words, or more than a fifth of the words in repeated 5-word windows).

Words are runs of anything but space and the control characters 9 to 13.

Defined results: a null or empty text has no words and is rejected; its clean text is empty.
Each row is judged by itself, so repeated rows are judged alike; an empty table gives no rows.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from siteloom.llm.common import table, utf8, widen

MIN_WORDS, MAX_REPEAT_PERCENT, REPEAT_WINDOW = 10, 20, 5
#: A document is rejected if it keeps less than this percentage of its words.
MIN_KEPT_PERCENT = 50

# Closing marks, ends of sentences, separators and symbols, stock phrases (lower case, in four languages).
CLOSING = ".!?…。！？:;\"'”’»)"
ENDS = ".!?…。！？"
SEPARATORS = "#*$%&|<>»›·•"
PHRASE_WORDS = 12
PHRASES = ["all rights reserved", "accept cookies", "cookie policy", "privacy policy", "terms of use", "terms of service", "enable javascript", "click here", "read more", "share this", "subscribe to", "sign up", "log in to", "lorem ipsum",
    "tous droits réservés", "accepter les cookies", "politique de confidentialité", "mentions légales", "conditions d'utilisation", "lire la suite", "cliquez ici", "en savoir plus", "partager sur",
    "alle rechte vorbehalten", "cookies akzeptieren", "datenschutzerklärung", "nutzungsbedingungen", "mehr lesen", "weiterlesen", "hier klicken", "jetzt anmelden", "mehr erfahren",
    "todos los derechos reservados", "aceptar cookies", "política de privacidad", "política de cookies", "aviso legal", "términos de uso", "leer más", "haga clic aquí", "suscríbete", "iniciar sesión",
]

_WS = b"\x20\x09\x0a\x0b\x0c\x0d"
_NOT_POINTS = bytes(range(0x80, 0xC0))
_SYMBOLS = b"#*$%&|<>"
_SEPARATOR = re.compile("[" + re.escape(SEPARATORS) + "]")
_PHRASE = re.compile("|".join(map(re.escape, PHRASES)))
_AZ = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def line_fails(line: str, n_words: int) -> bool:
    """line: without white space at its ends; it has n_words words, one at least."""
    if line[-1] not in CLOSING and 2 * (max(map(line.rfind, ENDS)) + 1) < len(line):
        return True
    if line.count("!!") * 10 > 3 * n_words:
        return True
    if len(_SEPARATOR.findall(line)) * 10 > 3 * n_words:
        return True
    return n_words <= PHRASE_WORDS and _PHRASE.search(line.translate(_AZ)) is not None


def repeated_words(words: list[bytes], window: int = REPEAT_WINDOW) -> int:
    """Words within windows of that many words that occur twice or more in the text."""
    n = len(words)
    if n <= window:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, n)
    v = len(number)
    if v == n:
        return 0
    key, size = ids, v
    for k in range(1, window):
        if size * v >= 1 << 62:
            key = np.unique(key, return_inverse=True)[1].astype(np.int64)
            size = len(key)
        key, size = key[:-1] * v + ids[k:], size * v
    _, inverse, counts = np.unique(key, return_inverse=True, return_counts=True)
    at = np.flatnonzero(counts[inverse] >= 2)
    cover = np.zeros(n + 1, np.int64)
    np.add.at(cover, at, 1)
    np.add.at(cover, at + window, -1)
    return int((np.cumsum(cover) > 0).sum())


def judge_text(text: bytes | None) -> tuple:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, clean text."""
    text = text or b""
    words = text.split()  # for bytes: exactly the separators named above
    n = len(words)
    seen: set[bytes] = set()
    dup = kept_words = 0
    clean = []
    for line in text.split(b"\n"):
        own = len(line.split())
        if not own:
            clean.append(line)
            continue
        dup += line in seen
        seen.add(line)
        if not line_fails(line.strip(_WS).decode("utf-8", "replace"), own):
            kept_words += own
            clean.append(line)
    repeat = repeated_words(words)
    failed = n < MIN_WORDS or 100 * repeat > MAX_REPEAT_PERCENT * n
    return (
        n,
        len(text.translate(None, _NOT_POINTS + _WS)),
        len(text) - len(text.translate(None, _SYMBOLS)),
        dup,
        repeat,
        failed,
        not failed and 100 * kept_words >= MIN_KEPT_PERCENT * n,
        b"\n".join(clean).decode("utf-8", "replace"),
    )


_FIELDS = [("n_words", T.LongType()), ("word_chars", T.LongType()), ("n_symbols", T.LongType()), ("n_dup_lines", T.LongType()), ("n_repeat_words", T.LongType()), ("base_failed", T.BooleanType()), ("kept", T.BooleanType())]


def judge(docs: DataFrame, clean: str | None = "clean_text", keep_text: bool = True) -> DataFrame:
    """Adds the base counts, base_failed and kept, and, unless clean is None, the text without
    the lines that failed."""
    docs = docs.drop(*(n for n, _ in _FIELDS), clean or "clean_text")
    kinds = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.string()]

    def rows(batch: pa.RecordBatch) -> list:
        told = [judge_text(t) for t in utf8(batch.column(batch.schema.get_field_index("text")))]
        columns = list(zip(*told)) or [()] * 8
        return [pa.array(columns[i], kinds[i]) for i in range(8 if clean else 7)]

    fields = _FIELDS + ([(clean, T.StringType())] if clean else [])
    return widen(docs, fields, rows, () if keep_text else ("text",))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents").select("doc_id", "text"), clean=None, keep_text=False)


_Q = lambda s: s.replace("'", "''")
ORACLE = rf"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), counts AS (
  SELECT doc_id, text, len(w)::BIGINT AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
    (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols
  FROM d
), lines AS (
  SELECT doc_id, l, len(regexp_extract_all(l, '[^\x20\x09-\x0D]+')) AS n, regexp_replace(l, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g') AS t
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l FROM d)
), by_line AS (
  SELECT doc_id, count(*) FILTER (n > 0) - count(DISTINCT l) FILTER (n > 0) AS n_dup_lines,
    sum(n) FILTER (n > 0 AND (regexp_matches(t, '[{_Q(re.escape(CLOSING))}]$') OR 2 * length(regexp_extract(t, '^(.*[{re.escape(ENDS)}])', 1)) >= length(t))
      AND (length(t) - length(replace(t, '!!', ''))) / 2 * 10 <= 3 * n
      AND (length(t) - length(regexp_replace(t, '[{_Q(re.escape(SEPARATORS))}]', '', 'g'))) * 10 <= 3 * n
      AND (n > {PHRASE_WORDS} OR NOT regexp_matches(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_Q("|".join(PHRASES))}'))) AS kept_words
  FROM lines GROUP BY doc_id
), win AS (
  SELECT doc_id, i, array_to_string(list_slice(w, i, i + 4), ' ') AS k
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM d WHERE len(w) >= 5)
), twice AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, k) AS c FROM win) WHERE c > 1
), rep AS (
  SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 5)) AS p FROM twice) GROUP BY doc_id
), judged AS (
  SELECT c.doc_id, n_words, word_chars, n_symbols, n_dup_lines::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words,
    n_words < 10 OR 100 * coalesce(rep.n, 0) > 20 * n_words AS base_failed, coalesce(kept_words, 0) AS kept_words
  FROM counts c LEFT JOIN by_line USING (doc_id) LEFT JOIN rep USING (doc_id)
)
SELECT * EXCLUDE (kept_words), NOT base_failed AND 100 * kept_words >= 50 * n_words AS kept FROM judged
"""
