"""Fill-in-middle, hard negatives and the quality classifier."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siteloom.llm import fim, negatives, subword

UNITS = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def rows(df):
    return [r.asDict() for r in df.collect()]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_fim(text, h, fim_percent=50, spm_percent=80):
    """(n, form, prefix characters, middle characters, output), unit by unit."""
    u = UNITS.findall(text)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= fim_percent:
        return len(u), "plain", None, None, text
    a, b = sorted(x % (len(u) + 1) for x in h[:2])
    p, m, s = "".join(u[:a]), "".join(u[a:b]), "".join(u[b:])
    if h[3] % 100 < spm_percent:
        return len(u), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(u), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def hashed(key, seed=42):
    told = hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()
    return [int(told[8 * i : 8 * i + 8], 16) for i in range(4)]


def odd_texts(n, size, seed=7):
    random.seed(seed)
    return ["".join(random.choice(["a", "é", "字", "😀", " ", " ", "\n", "\t", "\x0b", "<", "P", ">", "M", "S", " ", "\x1c"]) for _ in range(random.randrange(size))) for _ in range(n)]


@pytest.mark.parametrize("chunk", [1, 2, 3, 5, 1000])
def test_scan_against_units(monkeypatch, chunk):
    monkeypatch.setattr(fim, "CHUNK", chunk)
    for i, text in enumerate([*odd_texts(400, 40), "", "<P>", "x<S", "<<M>", " ", "< P>", "<P <P"]):
        h = [random.randrange(1 << 32), random.randrange(1 << 32), i % 2 * 99, random.randrange(100)]
        n, form, p, m, out = fim.cut_text(text.encode(), h, 50, 80)
        assert (n, form, p, m, out.decode()) == plain_fim(text, h), (text, chunk)


def test_functions_compose_in_any_order():
    """Chunks composed from the left, from the right and by halves are the whole text's function."""
    text = ("ab <P>  x<S y\n<<M> z" * 9).encode()
    for size in (1, 2, 5, 17):
        found = [fim.scan(text[i : i + size]) for i in range(0, len(text), size)]
        told = lambda s: (list(s.to), list(s.ends), list(s.marks), s.chars)
        left = right = fim.Scan()
        for x in found:
            left = left.then(x)
        for x in reversed(found):
            right = x.then(right)
        while len(found) > 1:
            found = [a.then(b) for a, b in zip(found[::2], [*found[1::2], fim.Scan()])]
        assert told(left) == told(right) == told(found[0]) == told(fim.scan(text))


@pytest.mark.parametrize("giant", [0, 25, 1 << 16])
def test_query_against_units(spark, tmp_path, monkeypatch, giant):
    """All texts, some or none dealt out in chunks of 7 bytes and blocks of 3 chunks."""
    for name, value in (("GIANT", giant), ("CHUNK", 7), ("BLOCK", 3)):
        monkeypatch.setattr(fim, name, value)
    held = list(enumerate([*odd_texts(120, 90), "", None, "one", " ", "x" * 300, " " * 300, "word " * 100, ("<P> " + "y " * 40)]))
    held += [(None, "no id " * 20), (None, None), held[3], held[3], (3, "another text of the same id " * 4)]
    told = [(i, t, "x", 1) for i, t in held]
    spark.createDataFrame(told, "doc_id long, text string, output string, n int").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(repr(sorted(r.items())) for r in rows(fim.query(spark, str(tmp_path))))
    want = []
    for i, t in held:
        n, form, p, m, out = plain_fim(t or "", hashed(i))
        want.append(repr(sorted({"doc_id": i, "n": n, "form": form, "prefix_chars": p, "middle_chars": m, "output_sha256": sha(out), "restored_sha256": sha(t or "")}.items())))
    assert got == sorted(want)
    assert {"plain", "spm", "psm"} == {plain_fim(t or "", hashed(i))[1] for i, t in held}


def test_transform_keeps_columns_and_restores(spark):
    held = [(i, t, i * 2) for i, t in enumerate(odd_texts(60, 60, seed=3))]
    out = fim.transform(spark.createDataFrame(held, "doc_id long, text string, form long"), seed=9, fim=100, spm=30)
    assert out.columns == ["doc_id", "text", "n", "form", "prefix_chars", "middle_chars", "output"]
    for r in rows(out.withColumn("back", fim.restore(F.col("output"), F.col("form")))):
        assert (r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) == plain_fim(r["text"], hashed(r["doc_id"], 9), 100, 30) and r["back"] == r["text"]
    assert fim.transform(out.select("doc_id", "text").limit(0)).count() == 0


def test_fim_of_nothing(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert fim.query(spark, str(tmp_path)).count() == 0


# -- hard negatives ---------------------------------------------------------------------------

EMBEDDINGS = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("label", T.IntegerType()), T.StructField("score", T.StringType())])


def plain_negatives(data):
    held = []
    for i, v, label, _ in data:
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        held.append((i, (label + 1) % 10 if i % 7 == 0 else label, [math.floor(256 * x) for x in v]))
    out = []
    for i, label, v in held:
        if i % 50:
            continue
        other = [(-sum(a * b for a, b in zip(v, w)), j, kind) for j, kind, w in held if j != i and len(w) == len(v)]
        for cost, j, _ in sorted(x for x in other if x[2] == label)[:5]:
            fits = sorted(x for x in other if x[2] != label and 50 * -cost <= 100 * -x[0] <= 95 * -cost)
            out += [(i, j, k + 1, n, -cost, -s) for k, (s, n, _) in enumerate(fits[:3])]
    return sorted(out)


@pytest.mark.parametrize("small", [False, True])
def test_negatives_against_brute_force(spark, tmp_path, monkeypatch, small):
    if small:  # several blocks, small batches and many lists to merge
        monkeypatch.setattr(negatives, "ANCHOR_ROWS", 3)
        monkeypatch.setattr(negatives, "MERGE", 2)
    draw = np.random.default_rng(2)
    base = draw.normal(0, 0.3, (12, 8))
    data = []
    for i in range(700):
        v = np.round(base[draw.integers(12)] + draw.normal(0, 0.1, 8), 1 if i % 3 else 3)  # rounding makes ties
        data.append((i, [float(np.float32(x)) for x in v], int(draw.integers(0, 3 if i % 2 else 10)), "x"))
    third = data[0][1]
    data += [(1000 + i, third, 1, "hot") for i in range(300)]  # one vector and label in a third of the rows
    data += [(2000, None, 1, "x"), (2050, [], 1, "x"), (2051, [], 1, "x"), (2052, [], 2, "x"), (2100, [1.0, None] * 4, 1, "x"), (2150, [float("nan")] * 8, 1, "x"), (2151, [float("inf")] * 8, 1, "x")]
    data += [(None, third, 1, "x"), (2200, third, None, "x"), (2250, third[:5], 3, "x"), (2251, third[:5], 3, "x"), (2252, [x * 0.8 for x in third[:5]], 4, "x"), (50, data[50][1], 4, "x"), data[60], data[60], data[100]]
    spark.createDataFrame(data, EMBEDDINGS).repartition(9).write.parquet(f"{tmp_path}/embeddings.parquet")
    out = negatives.query(spark, str(tmp_path))
    assert [f.dataType.simpleString() for f in out.schema] == ["bigint", "bigint", "int", "bigint", "bigint", "bigint"]
    got = sorted(tuple(r) for r in out.collect())
    assert got == plain_negatives(data) and len(got) > 60


def test_negatives_of_nothing(spark, tmp_path):
    for at, data in (("a", []), ("b", [(1, [1.0], 1, "x")]), ("c", [(50, [1.0], 1, "x")]), ("d", [(50, [1.0], 1, "x"), (51, [1.0], 2, "x")])):
        spark.createDataFrame(data, EMBEDDINGS).write.parquet(f"{tmp_path}/{at}/embeddings.parquet")
        assert rows(negatives.query(spark, f"{tmp_path}/{at}")) == []


def test_products_beyond_floats():
    """Values whose products float64 would round."""
    a, b = np.array([[2.0**30 + 1, 3.0]]), np.array([[2.0**30 + 3, 5.0], [-(2.0**30) - 7, 1.0]])
    assert negatives.products(a, b).tolist() == [[(2**30 + 1) * (2**30 + 3) + 15, -(2**30 + 1) * (2**30 + 7) + 3]]
    with pytest.raises(OverflowError):
        negatives.products(np.array([[2.0**60]]), np.array([[2.0**60]]))


def test_blocks_hold_all_numbers():
    for counts, most in (([(0, 5), (1, 2), (7, 9)], 4), ([(3, 1)] * 1, 1), ([], 5), ([(k, 1) for k in range(20)], 6)):
        ranges = negatives._ranges(counts, most)
        numbers = [(p << 33) + i for p, n in counts for i in range(n)]
        held = [[x for x in numbers if lo <= x < hi] for lo, hi in ranges]
        assert sorted(sum(held, [])) == sorted(numbers) and all(0 < len(x) <= most for x in held)


# -- quality classifier -----------------------------------------------------------------------


def quality_corpus(n, seed=1):
    random.seed(seed)
    good, data, labels = [f"{a}{b}o" for a in ("ka", "mi", "lo", "te") for b in ("ran", "sul", "tem", "vid")], [], []
    for i in range(n):
        words = [random.choice(good) for _ in range(random.randrange(5, 60))]
        label = int(i % 4 != 0)
        if not label:
            words = [w + random.choice(["###", "$$$"]) for w in words] if i % 8 else [random.choice(["xy", "zw"]) + str(i)] * 30
        data.append((i, " ".join(words)))
        labels.append((i, label, 0))
    return data, labels


def test_quality(spark, tmp_path):
    data, labels = quality_corpus(500)
    extra = [(1000, None), (1001, ""), (1002, "karano " * 70_000), (1003, "y" * 600_000), (None, "karano"), (1004, data[7][1]), (7, "other text of an id")]
    spark.createDataFrame([(*d, 0.5, "s") for d in data + extra], "doc_id long, text string, score double, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels + [(None, 1, 0), (5000, 0, 0), (1001, None, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    out = rows(subword.query(spark, str(tmp_path)))
    assert len(out) == len(data) + len(extra) and set(out[0]) == {"doc_id", "held_out", "score", "predicted"}
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in out)
    assert all(r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in out)
    by = {r["doc_id"]: r for r in out if r["doc_id"] != 7}
    held = [by[i]["predicted"] == q for i, q, _ in labels if i != 7 and by[i]["held_out"]]
    assert len(held) > 60 and np.mean(held) > 0.97
    assert by[1000]["score"] == by[1001]["score"] and any(r["score"] == by[1004]["score"] for r in out if r["doc_id"] == 7)
    again = {(r["doc_id"], r["score"]) for r in rows(subword.query(spark, str(tmp_path)))}
    assert again == {(r["doc_id"], r["score"]) for r in out}


def test_labels_of_held_out_rows_are_not_learned(spark, tmp_path):
    """Scores don't change when every held-out label is turned around."""
    data, labels = quality_corpus(120, seed=5)
    spark.createDataFrame(data, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    told = []
    for turned in (False, True):
        held = [(i, 1 - q if turned and zlib.crc32(str(i).encode()) % 5 == 0 else q, 0) for i, q, _ in labels]
        spark.createDataFrame(held, "doc_id long, quality int, toxic int").write.mode("overwrite").parquet(f"{tmp_path}/labels.parquet")
        told.append({r["doc_id"]: r["score"] for r in rows(subword.query(spark, str(tmp_path)))})
    assert told[0] == told[1]


def test_quality_without_labels(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, label int")
    one = spark.createDataFrame([(1, 1), (2, 1)], "doc_id long, label int")
    assert {r["score"] for r in rows(subword.predict(docs, subword.fit(docs, none)))} == {0.5}
    assert all(r["score"] > 0.99 for r in rows(subword.predict(docs, subword.fit(docs, one))))
    assert subword.predict(docs.limit(0), subword.fit(docs.limit(0), one)).count() == 0


def test_features_by_hand():
    """Each word, bigram and n-gram once, equal ones in one bucket, whatever the white space."""

    def kinds(text):
        words = text.lower().split()
        grams = [f" {w} "[i : i + n] for w in words for n in subword.SIZES for i in range(len(w) + 3 - n)]
        pairs = [a == b or (a, b) for a, b in zip(words, words[1:])]
        return [("w", w) for w in words] + [("p", p) for p in pairs] + [("g", g) for g in grams]

    for text in ("ab cd ab", "One two  one\ntwo", "a", "Ääx ääx ääx 日本語です x", "q " * 9, "", " \n"):
        want = kinds(text)
        got = subword.features(text)
        assert len(got) == len(want)
        counts = sorted(np.unique(got, return_counts=True)[1].tolist())
        assert counts == sorted(want.count(k) for k in set(want)), text
    whole = "alpha beta gamma " * 40
    parts = list(subword.slices(whole))
    assert "".join(parts) == whole


def test_slices_end_at_white_space(monkeypatch):
    monkeypatch.setattr(subword, "SLICE", 10)
    for text in ("abc def ghi jkl mno", "x" * 35, "", "ab " * 9, "abcdefghij klm"):
        parts = list(subword.slices(text))
        assert "".join(parts) == text and all(len(p) <= 10 for p in parts)
    assert list(subword.slices("abc def ghi jkl")) == ["abc def ", "ghi jkl"]


def test_training_against_plain_steps():
    """The trained log-odds against the same steps, written out over dense vectors."""
    random.seed(3)
    texts = [" ".join(random.choice(("aa", "bb", "cc")) for _ in range(4)) for _ in range(6)]
    held, y = [subword.weights(t) for t in texts], np.array([0, 1, 1, 0, 1, 1])
    odds, bias = subword.train(held, y)
    draw = np.random.default_rng(subword.SEED)
    e = (draw.random((subword.BUCKETS, subword.SIZE), dtype=np.float32) - 0.5) / subword.SIZE
    e, w, b, done = e.astype(np.float64), np.zeros((2, subword.SIZE)), np.zeros(2), 0
    for _ in range(subword.EPOCHS):
        for i in draw.permutation(6):
            rate = subword.RATE * (1 - done / (6 * subword.EPOCHS))
            done += 1
            x = np.zeros(subword.BUCKETS)
            x[held[i][0]] = held[i][1]
            h = x @ e
            p = np.exp(w @ h + b) / np.exp(w @ h + b).sum()
            p[y[i]] -= 1
            g = p @ w
            w = w - rate * np.outer(p, h)
            b = b - 0.1 * rate * p
            e = e - rate * np.outer(x / np.linalg.norm(x), g)
    assert np.allclose(odds, e @ (w[1] - w[0]), atol=1e-4) and abs(bias - (b[1] - b[0])) < 1e-4
    z = bias + held[2][1] @ odds[held[2][0]]
    assert abs(subword.score_text(texts[2], odds, bias) - 1 / (1 + math.exp(-z))) < 1e-9
