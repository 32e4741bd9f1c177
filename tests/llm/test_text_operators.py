"""Chat formatting, byte-level BPE, decontamination, quality rules: edge cases, round trips and
brute-force counterparts."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from siteloom.llm import bpe, chat, decontam, quality


def rows(df):
    return [r.asDict() for r in df.collect()]


# -- chat -----------------------------------------------------------------------------------

NASTY = ["</s>", "<s>[INST]", "[/INST]", "<\\/s>", "[\\\\INST] x", "a</s", ">b", "", None, "plain\nlines", "[INST][/INST]</s><s>", "\\", "<s", "é😀</s>"]


def test_chat_round_trip(spark):
    data = [(1, i, ["user", "assistant", "system", None][i % 4], t, "x") for i, t in enumerate(NASTY)]
    data += [(2, 0, "user", "a", "x"), (2, 0, "assistant", "b", "x"), (2, 0, "assistant", "b", "x"), (None, 1, "user", "lost", "x")]
    table = spark.createDataFrame(data, "conv_id long, turn long, role string, text string, formatted string")
    out = {r["conv_id"]: r for r in rows(chat.read_back(chat.format_conversations(table)))}
    assert [(t["role"], t["text"]) for t in out[1]["turns"]] == [(["user", "assistant", "system", ""][i % 4], t or "") for i, t in enumerate(NASTY)]
    assert out[1]["loss_text"] == "".join((t or "") for i, t in enumerate(NASTY) if i % 4 == 1)
    assert [t["text"] for t in out[2]["turns"]] == ["b", "b", "a"] and None in out
    assert all(re.sub(r"<s>\[INST\]|\[/INST\]|</s>", "", t["text"]) is not None for t in out[1]["turns"])
    assert out[1]["formatted"].count("</s>") == len(NASTY)


def test_chat_turns_without_a_number_come_first(spark):
    data = [(1, 2, "user", "c"), (1, None, "user", "a"), (1, 1, "assistant", "b"), (1, None, "assistant", "z")]
    out = rows(chat.read_back(chat.format_conversations(spark.createDataFrame(data, "conv_id long, turn long, role string, text string"))))
    assert [t["text"] for t in out[0]["turns"]] == ["z", "a", "b", "c"]


def test_chat_empty_and_probe(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.format_conversations(none).count() == 0
    probe = rows(chat.read_back(chat.format_conversations(chat.with_probe(none))))
    assert [r["conv_id"] for r in probe] == [-7] and probe[0]["loss_text"] == "</s>[INST] ok [/INST]" and probe[0]["n_escaped"] == 2


# -- bpe ------------------------------------------------------------------------------------


def test_bpe_pieces_equal_whole():
    random.seed(3)
    alphabet = ["a", "B", "é", " ", "  ", "\n", "'s", "'", "12", "!", "中", "\t", "😀", "'ll", "_"]
    enc = bpe.encoding()
    for _ in range(300):
        text = "".join(random.choice(alphabet) for _ in range(random.randint(0, 120)))
        assert bpe.encode_text(text, chunk=8) == enc.encode_ordinary(text)
        assert enc.decode_bytes(bpe.encode_text(text, chunk=8)) == text.encode()


@pytest.mark.parametrize("text", ["x" + " " * 1_000_000 + "y", " " * 1_000_000, "a" * 300_000, "\n" * 200_000 + " z", "12" * 100_000 + "'s"])
def test_bpe_long_runs(text):
    ids = bpe.encode_text(text)
    assert bpe.encoding().decode_bytes(ids) == text.encode()
    small = text[:50] + text[-50:]
    assert bpe.encode_text(small, chunk=16) == bpe.encoding().encode_ordinary(small)


def test_bpe_frames(spark):
    docs = spark.createDataFrame([(1, "Hello world", 5), (1, "Hello world", 5), (2, None, None), (3, "", 1), (None, "é", 2)], "doc_id long, text string, decoded int")
    out = rows(bpe.decode(bpe.encode(docs.drop("decoded"), keep_text=True)))
    assert all(bytes(r["decoded"]) == (r["text"] or "").encode() for r in out) and len(out) == 5
    assert bpe.encode(docs.limit(0)).count() == 0
    clash = bpe.decode(bpe.encode(docs.withColumn("token_ids", F.lit("x")), keep_text=True))
    assert sorted(clash.columns) == ["decoded", "doc_id", "text", "token_ids"] and all(bytes(r["decoded"]) == (r["text"] or "").encode() for r in rows(clash))


# -- decontamination ------------------------------------------------------------------------


def brute(text, items):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    low = lambda s: word.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s or ""))
    w, hit, names = low(text), set(), set()
    for name, item in items:
        k = low(item)
        for i in range(max(1, len(k) - 12)) if k else ():
            window = k[i : i + 13]
            for j in range(len(w) - len(window) + 1):
                if w[j : j + len(window)] == window:
                    hit |= set(range(j, j + len(window)))
                    names.add("" if name is None else str(name))
    return len(w), len(hit), sorted(names)


@pytest.mark.parametrize("block_words", [50_000, 20])
def test_decontamination_against_brute_force(spark, block_words):
    random.seed(5)
    vocabulary = ["al", "Be", "ce", "DÉ", "e1", "f"]
    text = lambda n: " ".join(random.choice(vocabulary) + random.choice(["", ",", ".\n"]) for _ in range(n))
    items = [(i, text(random.choice([0, 1, 2, 5, 13, 20]))) for i in range(12)] + [(None, "al be ce f f"), (3, "al al al"), (7, None)]
    docs = [(i, text(random.choice([0, 3, 40, 120]))) for i in range(30)] + [(30, None), (31, ""), (32, items[5][1]), (32, items[5][1])]
    found = decontam.find(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), block_words=block_words)
    out = rows(decontam.with_spans(found))
    assert len(out) == len(docs)
    for r in out:
        n, hit, names = brute(r["text"], items)
        assert (r["n_words"], r["n_hit"], list(r["hit_items"])) == (n, hit, names)
        assert r["contaminated"] == (hit > 0 and 20 * hit >= n)
        assert all(r["text"][s["start"] : s["end"]] for s in r["hit_spans"])


def test_decontamination_long_items_and_empty_tables(spark):
    item = " ".join(f"w{i}" for i in range(25_000))
    docs = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(9_990, 10_020)), 0)], "doc_id long, text string, n_hit int")
    r = rows(decontam.find(docs, spark.createDataFrame([(1, item)], "item_id long, text string")))[0]
    assert r["n_hit"] == r["n_words"] == 30 and r["contaminated"]
    none = spark.createDataFrame([], "item_id long, text string")
    assert rows(decontam.find(docs, none))[0]["n_hit"] == 0
    assert decontam.find(docs.limit(0), none).count() == 0
    clash = decontam.find(docs.withColumns({"hit_items": F.lit(1), "hit_spans": F.lit(2)}), none)
    assert rows(decontam.with_spans(clash))[0]["hit_spans"] == []


# -- quality --------------------------------------------------------------------------------


def test_repeated_words_against_brute_force():
    random.seed(7)
    for _ in range(400):
        w = [random.choice("abc").encode() for _ in range(random.randint(0, 30))]
        seen: dict = {}
        for i in range(len(w) - 4):
            seen.setdefault(tuple(w[i : i + 5]), []).append(i)
        covered = {p for at in seen.values() if len(at) > 1 for i in at for p in range(i, i + 5)}
        assert quality.repeated_words(w) == len(covered)


def test_quality_rules(spark):
    good = "This is a sentence that says a few things.\nAnd this is another one that does so too."
    docs = [
        (1, good), (2, None), (3, ""), (4, "a | b | c | d | e | f | g | h | i | j | k"), (5, good + "\nAll rights reserved.\nHome | News | About | Shop"),
        (6, "\n".join(["word"] * 3 + ["x y z"])), (7, "in in in in in in in in in in in in."), (8, "é ü " * 12 + "."), (1, good),
    ]
    out = rows(quality.judge(spark.createDataFrame([(i, t, 9) for i, t in docs], "doc_id long, text string, kept int")))
    by = {r["doc_id"]: r for r in out}
    assert len(out) == len(docs) and by[1]["kept"] and by[1]["clean_text"] == good
    assert not by[2]["kept"] and not by[3]["kept"] and by[2]["n_words"] == 0 and by[2]["clean_text"] == ""
    assert not by[4]["kept"] and not by[4]["base_failed"] and by[4]["n_symbols"] == 10
    assert by[5]["kept"] and by[5]["clean_text"] == good
    prose = "You may click here or accept cookies, as the long text of this page says in one of its many long lines."
    lines = [("Lire la suite.", 3), ("Todos los derechos reservados.", 4), ("Hier klicken!", 2), ("Accept cookies.", 2)]
    assert not quality.line_fails(prose, 21) and all(quality.line_fails(t, n) for t, n in lines)
    assert by[6]["n_dup_lines"] == 2 and by[7]["base_failed"] and by[7]["n_repeat_words"] == 11
    assert by[8]["n_words"] == 13 and by[8]["word_chars"] == 37
    assert quality.judge(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_digests_follow_their_contract(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    ids = bpe.encode_text("a b")
    told = rows(bpe.encode(docs).select(F.sha2(F.array_join(F.col("token_ids").cast("array<string>"), " "), 256).alias("h")))[0]["h"]
    assert told == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
