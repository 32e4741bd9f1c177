"""Operator 11, fill-in-middle transformation by a parallel automaton scan.

A text is units: white space and the run of other characters after it; white space at the end is
a unit of its own. An automaton of four states over bytes ends a unit where white space follows
another character, and finds the markers `<P>`, `<S>` and `<M>`. Texts are read in chunks of CHUNK
bytes. A chunk emits its transition function (the state it leaves for each state it may be
entered in) and, for each of these, the units that end and the markers that are completed in it.
Functions compose associatively; composition in order tells each chunk its entry state and the
units before it, and with these the chunk that holds a cut selects it.

Texts of at most GIANT bytes are scanned, composed and cut in the row they are in (transform()).
Larger ones are dealt out as rows of chunks (parts()), scanned anywhere, composed in two levels
(blocks of BLOCK chunks, then the blocks of a text) and cut by the chunk that holds the cut
(pieces()); their output is pieces in order and no task holds a whole text. Their digests are
taken over the ordered pieces as a stream, one text in one task, as SHA-256 is sequential.

seed, and the shares of texts that are transformed and of these in suffix-first form, are
parameters. h1 to h4, from the SHA-256 of the seed and the id, decide cuts and form.

Defined results: a null text is empty; an empty text has no units and is plain. A text with a
marker in it is plain, so that markers in an output are always its own. A null id hashes like an
empty one. White space and markers are ASCII, so bytes that are not UTF-8 do no harm; characters
are counted as bytes that don't continue one. Repeated rows are transformed alike, each by itself.
An empty table gives no rows. Other columns are kept by transform(); n, form, prefix_chars,
middle_chars and output are replaced if there.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siteloom.llm.common import cut, small_batches, table, utf8, widen

CHUNK, GIANT, BLOCK = 1 << 14, 1 << 16, 1024
SEED, FIM_PERCENT, SPM_PERCENT = 42, 50, 80
#: Sections by number: prefix, suffix, middle.
MARKERS = (b"<P>", b"<S>", b"<M>")
PREFIX, SUFFIX, MIDDLE = range(3)

#: States: in white space (the start), in other characters, after `<`, after `<` and a letter of a marker.
WHITE, OTHER, OPEN, LETTER = range(4)
STATES = (WHITE, OTHER, OPEN, LETTER)
#: Bytes that lead from the start to a state.
_TO = (b" ", b"x", b"<", b"<P")
_IS_WHITE = np.zeros(256, np.bool_)
_IS_WHITE[[0x20, *range(0x09, 0x0E)]] = True


def step(state: int, byte: int) -> int:
    if _IS_WHITE[byte]:
        return WHITE
    if byte == 0x3C:
        return OPEN
    return LETTER if state == OPEN and byte in b"PSM" else OTHER


class Scan:
    """The transition function of some bytes: for each entry state, the state they leave, the
    units that end in them and the markers completed in them; and their characters."""

    __slots__ = ("to", "ends", "marks", "chars")

    def __init__(self, to=STATES, ends=(0, 0, 0, 0), marks=(0, 0, 0, 0), chars=0):
        self.to, self.ends, self.marks, self.chars = to, ends, marks, chars

    def then(self, other: Scan) -> Scan:
        return Scan(
            [other.to[t] for t in self.to],
            [n + other.ends[t] for n, t in zip(self.ends, self.to)],
            [n + other.marks[t] for n, t in zip(self.marks, self.to)],
            self.chars + other.chars,
        )


def _unit_ends(state: int, chunk: bytes) -> np.ndarray:
    """Offsets in the chunk at which a unit ends, where the chunk is entered in a state."""
    white = _IS_WHITE[np.frombuffer(_TO[state][-1:] + chunk, np.uint8)]
    return np.flatnonzero(white[1:] & ~white[:-1])


def _chars(chunk: bytes) -> int:
    return int(np.count_nonzero(np.frombuffer(chunk, np.uint8) & 0xC0 != 0x80))


def scan(chunk: bytes) -> Scan:
    """All entry states walk byte by byte until they have met, which two bytes always do; the
    rest is read once for all of them."""
    states, ends, marks, at = list(STATES), [0] * 4, [0] * 4, 0
    while at < len(chunk) and len(set(states)) > 1:
        byte = chunk[at]
        for i, s in enumerate(states):
            ends[i] += bool(_IS_WHITE[byte] and s != WHITE)
            marks[i] += s == LETTER and byte == 0x3E
            states[i] = step(s, byte)
        at += 1
    if at < len(chunk):
        rest, state = chunk[at:], states[0]
        more, whole = len(_unit_ends(state, rest)), _TO[state] + rest
        found = sum(map(whole.count, MARKERS))
        ends, marks = [n + more for n in ends], [n + found for n in marks]
        for byte in rest[-2:]:
            state = step(state, byte)
        states = [state] * 4
    return Scan(states, ends, marks, _chars(chunk))


def find(chunk: bytes, state: int, k: int) -> int:
    """The offset at which the k-th unit that ends in the chunk ends."""
    return int(_unit_ends(state, chunk)[k - 1])


def cut_text(text: bytes, h: tuple[int, ...], fim: int, spm: int) -> tuple[int, str, int | None, int | None, bytes]:
    """(units, form, characters of prefix and of middle, output) of one text, chunk by chunk."""
    chunks = [text[i : i + CHUNK] for i in range(0, len(text), CHUNK)]
    entry = [Scan()]
    for c in chunks:
        entry.append(entry[-1].then(scan(c)))
    ends = entry[-1].ends[WHITE]
    n = ends + bool(text)
    if not text or entry[-1].marks[WHITE] or h[2] % 100 >= fim:
        return n, "plain", None, None, text
    form, places = "spm" if h[3] % 100 < spm else "psm", []
    for k in sorted(x % (n + 1) for x in h[:2]):
        if not k or k > ends:
            places.append(len(text) * bool(k))
        else:
            i = next(i for i in range(len(chunks)) if entry[i + 1].ends[WHITE] >= k)
            places.append(i * CHUNK + find(chunks[i], entry[i].to[WHITE], k - entry[i].ends[WHITE]))
    a, b = places
    part = (text[:a], text[b:], text[a:b])
    output = b"".join(MARKERS[s] + part[s] for s in _order(form))
    return n, form, _chars(part[PREFIX]), _chars(part[MIDDLE]), output


def _order(form: str) -> tuple[int, ...]:
    return (PREFIX, SUFFIX, MIDDLE) if form == "psm" else (SUFFIX, PREFIX, MIDDLE)


def hashes(key: Column, seed: int = SEED) -> list[Column]:
    """h1 to h4 of an id."""
    told = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(told, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def transform(docs: DataFrame, seed: int = SEED, fim: int = FIM_PERCENT, spm: int = SPM_PERCENT) -> DataFrame:
    """Adds n, form, prefix_chars, middle_chars and output to texts that are whole in their rows."""
    held = docs.withColumn("_h", F.array(*hashes(F.col("doc_id"), seed)))

    def rows(batch: pa.RecordBatch) -> list:
        at = batch.schema.get_field_index
        told = [cut_text(t or b"", h, fim, spm) for t, h in zip(utf8(batch.column(at("text"))), batch.column(at("_h")).to_pylist())]
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary())
        made = [pa.array([x[i] for x in told], k) for i, k in enumerate(kinds)]
        return made[:4] + [made[4].view(pa.string())]

    fields = [("n", T.LongType()), ("form", T.StringType()), ("prefix_chars", T.LongType()), ("middle_chars", T.LongType()), ("output", T.StringType())]
    return widen(held, fields, rows, ("_h",))


def restore(output: Column, form: Column) -> Column:
    """The text of an output, by its markers."""
    part = F.split(output, "<[PSM]>", -1)
    get = lambda i: F.get(part, F.lit(i))
    return F.when(form == "psm", F.concat(get(1), get(3), get(2))).when(form == "spm", F.concat(get(2), get(3), get(1))).otherwise(output)


# -- texts as rows of chunks ------------------------------------------------------------------

_SCAN = "to array<int>, ends array<long>, marks array<long>, chars long"


def parts(docs: DataFrame) -> DataFrame:
    """(key, doc_id, part, chunk): texts as numbered chunks, written to the shared store, where
    each row keeps its key. Empty texts have no part."""
    body = docs.select(F.monotonically_increasing_id().alias("key"), "doc_id", F.col("text").cast("binary").alias("body"))
    many = F.sequence(F.lit(0), F.expr(f"CAST((octet_length(body) - 1) div {CHUNK} AS INT)"))
    dealt = body.where("octet_length(body) > 0").select("*", F.explode(many).alias("part"))
    return cut(dealt.select("key", "doc_id", "part", F.expr(f"substring(body, part * {CHUNK} + 1, {CHUNK})").alias("chunk")))


def _scans(batch: pa.RecordBatch | pa.Table) -> list[Scan]:
    return [Scan(*x) for x in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("to", "ends", "marks", "chars")))]


def entries(dealt: DataFrame) -> DataFrame:
    """(key, part, state, before, n, marked): for each chunk its entry state and the units that
    end before it; for its text the units, and whether it holds a marker."""
    small_batches(dealt.sparkSession)

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            told = [scan(c) for c in b.column(2).to_pylist()]
            columns = [pa.array([list(x.to) for x in told], pa.list_(pa.int32())), *(pa.array([list(getattr(x, f)) for x in told], pa.list_(pa.int64())) for f in ("ends", "marks")), pa.array([x.chars for x in told], pa.int64())]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *columns], names=["key", "part", "to", "ends", "marks", "chars"])

    def fold(group: pa.Table) -> pa.Table:
        """A block as one function."""
        group = group.sort_by("part")
        whole = Scan()
        for x in _scans(group):
            whole = whole.then(x)
        return pa.table({"key": group["key"][:1], "block": group["block"][:1], "to": [list(whole.to)], "ends": [list(whole.ends)], "marks": [list(whole.marks)], "chars": [whole.chars]}, schema=blocks)

    def lead(group: pa.Table) -> pa.Table:
        """What comes before each block of a text, and the whole of the text."""
        group = group.sort_by("block")
        now, found = Scan(), []
        for x in _scans(group):
            found.append((now.to[WHITE], now.ends[WHITE]))
            now = now.then(x)
        size = len(found)
        return pa.table({"key": group["key"], "block": group["block"], "state": [s for s, _ in found], "before": [n for _, n in found], "n": [now.ends[WHITE] + 1] * size, "marked": [now.marks[WHITE] > 0] * size}, schema=led)

    def within(group: pa.Table) -> pa.Table:
        """What comes before each chunk of a block."""
        group = group.sort_by("part")
        state, before, states, counts = group["state"][0].as_py(), group["before"][0].as_py(), [], []
        for x in _scans(group):
            states.append(state)
            counts.append(before)
            state, before = x.to[state], before + x.ends[state]
        return pa.table({"key": group["key"], "part": group["part"], "state": states, "before": counts, "n": group["n"], "marked": group["marked"]}, schema=placed)

    function = [("to", pa.list_(pa.int32())), ("ends", pa.list_(pa.int64())), ("marks", pa.list_(pa.int64())), ("chars", pa.int64())]
    tail = [("state", pa.int32()), ("before", pa.int64()), ("n", pa.int64()), ("marked", pa.bool_())]
    blocks = pa.schema([("key", pa.int64()), ("block", pa.int32()), *function])
    led, placed = pa.schema([("key", pa.int64()), ("block", pa.int32()), *tail]), pa.schema([("key", pa.int64()), ("part", pa.int32()), *tail])
    functions = cut(dealt.select("key", "part", "chunk").mapInArrow(scanned, f"key long, part int, {_SCAN}").withColumn("block", F.expr(f"CAST(part div {BLOCK} AS INT)")))
    folded = functions.groupBy("key", "block").applyInArrow(fold, f"key long, block int, {_SCAN}")
    before = folded.groupBy("key").applyInArrow(lead, "key long, block int, state int, before long, n long, marked boolean")
    return functions.join(before, ["key", "block"]).groupBy("key", "block").applyInArrow(within, "key long, part int, state int, before long, n long, marked boolean")


def pieces(dealt: DataFrame, seed: int = SEED, fim: int = FIM_PERCENT, spm: int = SPM_PERCENT) -> DataFrame:
    """(key, doc_id, n, form, section, rank, part, chars, piece): the outputs of texts dealt out by
    parts(). In order of (rank, part), the pieces of a key are its output; a section's piece of
    part 0 begins with the marker. chars counts the text alone."""
    h1, h2, h3, h4 = hashes(F.col("doc_id"), seed)
    plain = F.col("marked") | (F.pmod(h3, F.lit(100)) >= fim)
    form = F.when(plain, "plain").when(F.pmod(h4, F.lit(100)) < spm, "spm").otherwise("psm")
    a, b = (F.pmod(h, F.col("n") + 1) for h in (h1, h2))
    held = dealt.join(entries(dealt), ["key", "part"]).select("key", "doc_id", "n", form.alias("form"), "part", "chunk", "state", "before", F.least(a, b).alias("a"), F.greatest(a, b).alias("b"))
    id_type = dealt.schema["doc_id"].dataType.simpleString()

    def offset(chunk: bytes, state: int, before: int, n: int, k: int) -> int:
        """Where the cut after k units falls in a chunk: at its start if before, at its end if behind."""
        if k <= before:
            return 0
        own = _unit_ends(state, chunk) if k < n else ()
        return int(own[k - before - 1]) if k - before <= len(own) else len(chunk)

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            index, told = [], []
            for i, r in enumerate(batch.select(["n", "form", "part", "chunk", "state", "before", "a", "b"]).to_pylist()):
                chunk = r["chunk"]
                if r["form"] == "plain":
                    index.append(i)
                    told.append((PREFIX, 0, _chars(chunk), chunk))
                    continue
                a, b = (offset(chunk, r["state"], r["before"], r["n"], r[k]) for k in "ab")
                for rank, section in enumerate(_order(r["form"])):
                    text = (chunk[:a], chunk[b:], chunk[a:b])[section]
                    if text or not r["part"]:
                        index.append(i)
                        told.append((section, rank, _chars(text), (b"" if r["part"] else MARKERS[section]) + text))
            kept = batch.select(["key", "doc_id", "n", "form", "part"]).take(pa.array(index, pa.int64()))
            columns = [pa.array([t[j] for t in told], k) for j, k in enumerate((pa.int32(), pa.int32(), pa.int64(), pa.binary()))]
            yield pa.RecordBatch.from_arrays([*kept.columns, *columns], names=["key", "doc_id", "n", "form", "part", "section", "rank", "chars", "piece"])

    return held.mapInArrow(made, f"key long, doc_id {id_type}, n long, form string, part int, section int, rank int, chars long, piece binary")


def restored(made: DataFrame) -> DataFrame:
    """The pieces of the texts themselves, from those of outputs: without markers, in their order."""
    bare = F.when((F.col("form") == "plain") | (F.col("part") > 0), F.col("piece")).otherwise(F.expr("substring(piece, 4)"))
    place = F.when(F.col("section") == MIDDLE, 1).when(F.col("section") == SUFFIX, 2).otherwise(0)
    return made.withColumns({"piece": bare, "rank": place})


def digests(made: DataFrame, name: str) -> DataFrame:
    """(key, doc_id, n, form, prefix_chars, middle_chars, name): one row for each text, whose
    pieces pass in order through one task, a batch at a time."""
    small_batches(made.sparkSession)
    id_type = made.schema["doc_id"].dataType
    kept = ["key", "doc_id", "n", "form", "section", "chars", "piece"]
    ordered = made.repartition("key").sortWithinPartitions("key", "rank", "part").select(*kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = None
        for batch in batches:
            done = []
            for r in batch.to_pylist():
                if now is None or now[0]["key"] != r["key"]:
                    done += [now] if now else []
                    now = (r, hashlib.sha256(), [0, 0, 0])
                now[1].update(r["piece"])
                now[2][r["section"]] += r["chars"]
            yield rows(done, batch.schema.field("doc_id").type)
            kind = batch.schema.field("doc_id").type
        if now:
            yield rows([now], kind)

    def rows(done: list, kind: pa.DataType) -> pa.RecordBatch:
        plain = [r["form"] == "plain" for r, _, _ in done]
        count = lambda s: pa.array([None if p else c[s] for p, (_, _, c) in zip(plain, done)], pa.int64())
        return pa.RecordBatch.from_arrays(
            [pa.array([r["key"] for r, _, _ in done], pa.int64()), pa.array([r["doc_id"] for r, _, _ in done], kind), pa.array([r["n"] for r, _, _ in done], pa.int64()), pa.array([r["form"] for r, _, _ in done], pa.string()), count(PREFIX), count(MIDDLE), pa.array([h.hexdigest() for _, h, _ in done], pa.string())],
            names=["key", "doc_id", "n", "form", "prefix_chars", "middle_chars", name],
        )

    return ordered.mapInArrow(run, f"key long, doc_id {id_type.simpleString()}, n long, form string, prefix_chars long, middle_chars long, {name} string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    columns = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"]
    whole = transform(documents.where(f"octet_length(text) <= {GIANT}"))
    whole = whole.withColumns({"output_sha256": F.sha2("output", 256), "restored_sha256": F.sha2(restore(F.col("output"), F.col("form")), 256)}).select(*columns)
    made = pieces(parts(documents.where(f"octet_length(text) > {GIANT}")))
    dealt = digests(made, "output_sha256").join(digests(restored(made), "restored_sha256").select("key", "restored_sha256"), "key")
    return whole.unionByName(dealt.select(*columns))


_HASH = "CAST('0x' || substr(sha256('42:' || COALESCE(CAST(doc_id AS VARCHAR), '')), {}, 8) AS UBIGINT)"
ORACLE = rf"""
WITH units AS (
  SELECT doc_id, COALESCE(text, '') AS text, regexp_extract_all(COALESCE(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u FROM documents
), cuts AS (
  SELECT doc_id, text, u, len(u) AS n, {_HASH.format(1)} % (len(u) + 1) AS x, {_HASH.format(9)} % (len(u) + 1) AS y,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR {_HASH.format(17)} % 100 >= 50 THEN 'plain'
         WHEN {_HASH.format(25)} % 100 < 80 THEN 'spm' ELSE 'psm' END AS form
  FROM units
), cut AS (
  SELECT doc_id, n, form, text, array_to_string(u[1:least(x, y)], '') AS p, array_to_string(u[least(x, y) + 1:greatest(x, y)], '') AS m, array_to_string(u[greatest(x, y) + 1:], '') AS s FROM cuts
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM cut
"""
