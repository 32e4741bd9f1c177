"""Language identification, toxicity, Jaccard join and the pipeline."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from siteloom.llm import jaccard, langid, toxicity


def rows(df):
    return [r.asDict() for r in df.collect()]


WORDS = {"aa": "ka ko kul mako tiku loka", "bb": "sen ser sil esen tises lens", "cc": "dor dun gor nodo gurd ondo"}


def corpus(n, seed=1):
    random.seed(seed)
    return [(i, " ".join(random.choice(WORDS[lang].split()) for _ in range(30)), lang, "s") for i in range(n) for lang in [list(WORDS)[i % 3]]]


def test_languages(spark):
    data = corpus(90) + [(900, None, "aa", "s"), (901, "", "bb", "s"), (902, "123 !", None, "s"), (903, "ZZZZ qq", "cc", "s"), (904, "ka ko", None, "s"), (None, "ka ko kul", "aa", "s")]
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string, score string")
    train = F.coalesce(F.col("doc_id") % 3 != 5, F.lit(False)) & (F.col("doc_id") < 60)
    out = rows(langid.predict(docs.select("doc_id", "text"), langid.fit(docs, train)))
    told = {r["doc_id"]: r for r in out}
    held = [told[i]["lang_pred"] == lang for i, _, lang, _ in data[60:90]]
    assert np.mean(held) == 1 and all(0 <= r["score"] <= 1 for r in out) and len(out) == len(data)
    assert [told[i]["lang_pred"] for i in (900, 901, 902)] == ["und"] * 3 and told[903]["lang_pred"] in WORDS and told[904]["lang_pred"] == "aa"
    nothing = langid.fit(docs, F.lit(False))
    assert {r["lang_pred"] for r in rows(langid.predict(docs.select("doc_id", "text"), nothing))} == {"und"}
    assert langid.predict(docs.select("doc_id", "text").limit(0), nothing).count() == 0


def test_languages_against_exact_sets(spark):
    """The filter's decisions against exact sets of n-grams for each language."""
    data = corpus(150, seed=9)
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string, source string")
    fitted = langid.fit(docs, F.col("doc_id") < 90)
    told = {r["doc_id"]: r["lang_pred"] for r in rows(langid.predict(docs.select("doc_id", "text"), fitted))}

    def grams(text):
        out = []
        for word in text.split():
            w = f" {word.lower()} "
            out += [w[i : i + n] for n in langid.SIZES for i in range(len(w) - n + 1)]
        return out

    share = {}
    for lang in WORDS:
        own = [set(grams(t)) for i, t, x, _ in data[:90] if x == lang]
        for g in set().union(*own):
            n = sum(g in s for s in own)
            if n >= langid.MIN_ROWS and n / len(own) >= langid.MIN_SHARE:
                share.setdefault(g, {})[lang] = n / len(own)
    owned = {g: {x for x, v in by.items() if v >= langid.RATIO * max(by.values())} for g, by in share.items()}
    for i, text, _, _ in data:
        counts = {x: sum(x in owned.get(g, ()) for g in grams(text)) for x in WORDS}
        assert told[i] == max(counts, key=counts.get), (i, counts)
    clash = docs.select("doc_id", "text", F.lit("x").alias("lang_pred"), F.lit(1).alias("score"))
    assert {r["doc_id"]: r["lang_pred"] for r in rows(langid.predict(clash, fitted))} == told


def test_bloom_filter_has_no_false_negatives():
    h = langid.ngrams("some words of a language")
    filled = np.zeros((1, langid.SLOTS), np.uint64)
    for at in langid.slots(h):
        filled[0][at] |= np.uint64(2)
    bits = filled[0][langid.slots(h)[0]] & filled[0][langid.slots(h)[1]]
    assert len(h) and (bits == 2).all()


def toxic_corpus(n):
    random.seed(2)
    plain = [f"w{i}" for i in range(60)]
    docs, labels = [], []
    for i in range(n):
        words = [random.choice(plain) for _ in range(40)]
        if i % 7 == 0:
            words[random.randrange(40)] = random.choice(["Vile", "nasty,"])
        if i % 5 == 0:
            words += ["junk"] * 3
        docs.append((i, " ".join(words)))
        labels.append((i, int(i % 5 != 0), int(i % 7 == 0)))
    return docs, labels


def test_toxicity(spark):
    docs, labels = toxic_corpus(400)
    table = spark.createDataFrame(docs + [(1000, None), (1001, ""), (1002, "vile " * 5000), (None, "w1 w2"), (3, docs[3][1])], "doc_id long, text string")
    told = spark.createDataFrame(labels + [(None, 1, 1), (5000, 1, 1), (8, None, None), (9, None, 0)], "doc_id long, quality int, toxic int")
    model = toxicity.fit(table, told)
    out = rows(toxicity.predict(table, model))
    assert len(out) == 405
    by = {r["doc_id"]: r for r in out}
    assert all(by[i]["toxic"] == (i % 7 == 0) for i, _ in docs) and by[1002]["toxic"] and not by[1000]["toxic"] and not by[1001]["toxic"]
    assert np.mean([(by[i]["p_low_quality"] > 0.5) == (i % 5 == 0) for i, _ in docs]) > 0.95
    none = toxicity.fit(table, told.limit(0))
    assert not any(r["toxic"] or r["p_toxic"] for r in rows(toxicity.predict(table, none)))
    assert toxicity.predict(table.limit(0), model).count() == 0


def test_toxicity_against_brute_force(spark):
    """Predictions against a plain walk of the chain, and out-of-fold training against plain
    gradient descent over the same folds and words."""
    docs, labels = toxic_corpus(200)
    table = spark.createDataFrame(docs + [(i, docs[i][1]) for i in range(20)], "doc_id long, text string")
    model = toxicity.fit(table, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    for r in rows(toxicity.predict(table, model)):
        own, logits = set(r["text"].lower().replace(",", " ").split()), []
        for step in model["chain"]:
            z = sum(a * b for a, b in zip(step["head"], [1.0, *logits]))
            z += sum(v for w, v in step["weights"].items() if w.decode() in own)
            logits.append(max(-20.0, min(20.0, z)))
        assert abs(r["p_low_quality"] - 1 / (1 + np.exp(-logits[0]))) < 1e-9 and abs(r["p_toxic"] - 1 / (1 + np.exp(-logits[1]))) < 1e-9
        assert r["toxic"] == (r["p_toxic"] >= model["chain"][-1]["threshold"])
    draw = np.random.default_rng(4)
    x = (draw.random((120, 6)) < 0.4).astype(float)
    y = np.column_stack([(x[:, 0] + draw.random(120) > 0.9), (x[:, 1] * x[:, 0] + draw.random(120) > 0.8)]).astype(int)
    fold = np.arange(120) % toxicity.FOLDS
    chain = toxicity.train([np.flatnonzero(r) for r in x], y, fold, 6)

    def descend(a, t):
        """Words (the last six columns) that say nothing about t in these rows have no weight."""
        use = np.abs(a.T @ (t - t.mean())) > 1e-9
        use[: a.shape[1] - 6] = True
        a = a * use
        beta, ridge = np.zeros(a.shape[1]), np.array([1e-6] + [toxicity.RIDGE] * (a.shape[1] - 1))
        for _ in range(20_000):
            beta -= 0.01 * (a.T @ (1 / (1 + np.exp(-a @ beta)) - t) + ridge * beta)
        return beta

    ones = lambda a: np.column_stack([np.ones(len(a)), a])
    beta = descend(ones(x), y[:, 0])
    assert np.allclose(np.delete(chain[0]["beta"], 0), beta[1:][chain[0]["words"]], atol=1e-3)
    out = np.zeros(120)
    for k in range(toxicity.FOLDS):
        fit, held = fold != k, fold == k
        out[held] = ones(x[held]) @ descend(ones(x[fit]), y[fit, 0])
    beta = descend(ones(np.column_stack([out, x])), y[:, 1])
    assert np.allclose(chain[1]["beta"][:2], beta[:2], atol=0.02)


def near(text, n, seed):
    random.seed(seed)
    w = text.split()
    for _ in range(n):
        w[random.randrange(len(w))] = f"new{random.randrange(10**6)}"
    return " ".join(w)


def brute(docs, threshold=0.8):
    held = [(i, jaccard.shingles(t)) for i, t in docs if i is not None and t is not None]
    parent, links = {i: i for i, _ in held}, {i: 0 for i, _ in held}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    raw = dict(docs)
    for k, (i, a) in enumerate(held):
        for j, b in held[k + 1 :]:
            same = len(np.intersect1d(a, b)) >= threshold * len(np.union1d(a, b)) if len(a) and len(b) else not len(a) and not len(b) and raw[i] == raw[j]
            if same:
                links[i] += 1
                links[j] += 1
                x, y = root(i), root(j)
                parent[max(x, y)] = min(x, y)
    return {i: (root(i), links[i]) for i, _ in held}


@pytest.mark.parametrize("small", [False, True])
def test_join_against_brute_force(spark, monkeypatch, small):
    if small:  # small limits, so that large buckets are split, blocked and contracted
        monkeypatch.setattr(jaccard, "LIMIT", 4)
        monkeypatch.setattr(jaccard, "BLOCK", 8)
        monkeypatch.setattr(jaccard, "FULL", 1)
    random.seed(4)
    text = lambda n: " ".join(f"v{random.randrange(5000)}" for _ in range(n))
    passage = text(60)
    base = [text(random.choice([5, 20, 80, 200])) for _ in range(12)]
    docs = [(i, near(base[i % 12], random.choice([0, 0, 1, 2, 6]), i)) for i in range(120)]
    docs += [(200 + i, passage + " " + text(60)) for i in range(25)] + [(300 + i, near(base[11], 1, 50 + i)) for i in range(30)]
    docs += [(400, ""), (401, ""), (402, "..."), (403, None), (404, None), (405, "one two"), (406, "One, two!"), (407, "two one")]
    table = spark.createDataFrame([(i, t, "c") for i, t in docs] + [(None, base[0], "c"), (None, None, "c")], "doc_id long, text string, class_id string")
    out = rows(jaccard.join(table))
    want = brute(docs)
    assert len(out) == len(docs) + 2
    for r in out:
        if r["doc_id"] is None:
            assert r["class_id"] is None and r["n_links"] == 0
        else:
            assert (r["class_id"], r["n_links"]) == want.get(r["doc_id"], (r["doc_id"], 0))


def test_pairs_whose_nodes_are_all_large(spark, monkeypatch):
    """Pairs at the threshold that share three nodes, each of all 3000 sets, and nothing else."""
    monkeypatch.setattr(jaccard, "FULL", 1)
    draw = np.random.default_rng(3)
    found = [draw.integers(0, 2**63, 260, dtype=np.uint64) for _ in range(1500)]
    side = lambda t, k: np.unique(np.concatenate([t[:200], t[200 + 25 * k : 225 + 25 * k]]))
    held = [(2 * i + k, bytes(jaccard.sketch(side(t, k)))) for i, t in enumerate(found) for k in (0, 1)]
    reps = spark.createDataFrame([(i, [1, 2, 3], s) for i, s in held], "rep long, picks array<long>, sketch binary")
    comp = {r["rep"]: r["comp"] for r in rows(jaccard.families(reps, jaccard.Runs(0.8, jaccard.RECALL)))}
    together = sum(2 * i in comp and comp[2 * i] == comp.get(2 * i + 1) for i in range(1500))
    assert together >= 0.995 * 1500, together


def test_runs_reach_the_recall():
    for threshold, recall in ((0.8, 0.99999), (0.7, 0.999), (0.9, 0.9999)):
        runs = jaccard.Runs(threshold, recall)
        assert runs.missed() <= 1 - recall and 2 * runs._lost(runs.paths) <= 1 - recall
        assert all(runs.first < n <= jaccard.PICKS for n in runs.then)


def test_pairs_behind_a_frequent_passage(spark, monkeypatch):
    """Pairs at the threshold in texts of which a third, a half or most is one passage of all."""
    monkeypatch.setattr(jaccard, "BLOCK", 256)
    monkeypatch.setattr(jaccard, "FULL", 1)
    draw = np.random.default_rng(5)
    fresh = lambda n: draw.integers(0, 2**63, n, dtype=np.uint64)
    for heavy in (60, 100, 150):
        common, held = fresh(heavy), []
        for i in range(600):
            own = fresh(200 - heavy)
            held += [(2 * i + k, np.unique(np.concatenate([common, own, fresh(25)]))) for k in (0, 1)]
        reps = spark.createDataFrame([(i, jaccard.sampled(t).astype(np.int64).tolist(), bytes(jaccard.sketch(t))) for i, t in held], "rep long, picks array<long>, sketch binary")
        comp = {r["rep"]: r["comp"] for r in rows(jaccard.families(reps, jaccard.Runs(0.8, jaccard.RECALL)))}
        assert sum(2 * i in comp and comp[2 * i] == comp.get(2 * i + 1) for i in range(600)) >= 599, heavy


def test_join_with_repeated_ids(spark):
    random.seed(8)
    a, b = (" ".join(f"v{random.randrange(10**6)}" for _ in range(60)) for _ in range(2))
    data = [(5, a), (5, b), (6, a + " z"), (7, b + " z"), (8, a), (8, a), (9, "else"), (9, "else"), (None, a)]
    out = rows(jaccard.join(spark.createDataFrame(data, "doc_id long, text string")))
    assert sorted((r["doc_id"] or -1, r["class_id"], r["n_links"]) for r in out) == [(-1, None, 0), (5, 5, 1), (5, 5, 3), (6, 5, 3), (7, 5, 1), (8, 5, 3), (8, 5, 3), (9, 9, 1), (9, 9, 1)]


def test_join_of_nothing(spark):
    assert jaccard.join(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    lone = rows(jaccard.join(spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f")], "doc_id long, text string")))
    assert [r["class_id"] for r in lone] == [1, 1]


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    docs, labels = toxic_corpus(140)
    docs = [(i, t + ". It ends here, as all of these do.") for i, t in docs]
    docs += [(500, docs[1][1]), (501, docs[1][1] + " x."), (502, None), (503, "Buy | now | here | and | there | or | else | go | away | you"), (504, docs[2][1])]
    question = "what is the name of the river that runs through the old town of the north"
    docs += [(505, question + "? It is long."), (504, docs[2][1])]
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in docs], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, question)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = {r["doc_id"]: r for r in rows(corpus_pipeline.run(spark, str(tmp_path)))}
    clean = {i for i, _ in docs[:140] if i % 7}
    assert set(out) == clean and all(r["n_tokens"] == len(r["token_ids"]) > 0 for r in out.values())
