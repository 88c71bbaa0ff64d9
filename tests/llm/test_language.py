"""Cross-parsing against a plain parse by substring search, held-out accuracy and edge cases."""

import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from kgspark.llm import language

D = "/root/testdata/sf0.01"
DOC = "doc_id long, text string, lang string"


def plain_phrases(text, runs, letters):
    """Phrases of a normalised text by greedy longest substrings of any run, in blocks; letters outside `letters` are phrases."""
    n = 0
    for lo in range(0, len(text), language.BLOCK):
        block, i = text[lo : lo + language.BLOCK], 0
        while i < len(block):
            j = i
            while j < len(block) and block[j] in letters and any(block[i : j + 1] in r for r in runs):
                j += 1
            i, n = max(j, i + 1), n + 1
    return n


def test_phrases_equal_a_plain_parse():
    rnd = random.Random(5)
    word = lambda a: "".join(rnd.choice(a) for _ in range(rnd.randint(1, 9)))
    text = lambda a, n: " ".join(word(a) for _ in range(n))
    samples = {"x": [text("abcd", 60), text("abé", 40)], "y": [text("bcdß", 80), "Zz-zz"], "z": ["q"]}
    model = language.build(samples)
    table = language.code_table(model.letters)
    tests = ["a", "ABCD, abé!", text("abcdéß", 300), text("xyz", 30), "qqqq qq q", "a" * 700, "Ω" * 5, text("bß", 200) + "\n\n" + text("12 ,", 5)]
    got, _ = language.judge([language.encoded(t, table) for t in tests], model)
    for k, name in enumerate(model.languages):
        runs = [language.lowered(p) for p in samples[name]]
        letters = set("".join(runs))
        assert [plain_phrases(language.lowered(t), runs, letters) for t in tests] == got[:, k].tolist()


def test_automaton_knows_substrings_and_nothing_else():
    rnd = random.Random(7)
    runs = [[rnd.randint(1, 3) for _ in range(rnd.randint(1, 40))] for _ in range(6)]
    table = language.automaton(runs, 4)
    inside = {tuple(r[i:j]) for r in runs for i in range(len(r)) for j in range(i + 1, min(len(r), i + 8) + 1)}
    for _ in range(3000):
        w = tuple(rnd.randint(1, 3) for _ in range(rnd.randint(1, 8)))
        s = 1
        for c in w:
            s = table[s, c] if s else 0
        assert bool(s) == (w in inside)


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{D}/documents.parquet")
    got = language.identify(docs, language.fit(docs)).join(docs.select("doc_id", "lang"), "doc_id").where("held_out")
    n, right = got.agg(F.count("*"), F.count_if(F.col("lang") == F.col("lang_pred"))).first()
    assert n > 200 and right / n >= 0.98


def test_learned_from_labelled_rows_that_are_not_held_out(spark):
    out = [k for k in range(400) if zlib.crc32(str(k).encode()) % 4 == 2]
    kept = [k for k in range(400) if k not in out]
    rows = [(k, "uno dos tres cuatro cinco", "es") for k in kept[:20]] + [(k, "one two three four five", "en") for k in kept[20:40]] + [(k, "jeden dwa trzy cztery", "pl") for k in out[:20]] + [(kept[50], "jeden dwa trzy", None), (None, "jeden dwa trzy", "cs")]
    docs = spark.createDataFrame(rows, DOC)
    model = language.fit(docs)
    assert model.languages == ["en", "es"]
    got = {r.doc_id: r for r in language.identify(docs, model).collect()}
    assert got[kept[0]].lang_pred == "es" and got[kept[20]].lang_pred == "en" and not got[kept[0]].held_out and got[out[0]].held_out and not got[None].held_out


def test_edge_cases(spark):
    docs = spark.createDataFrame([(k, "the cat and the dog " * 3, "en") for k in range(30)] + [(100 + k, "der hund und die katze " * 3, "de") for k in range(30)], DOC)
    model = language.fit(docs)
    long = "der hund " * 100_000
    rows = [(1, None), (2, ""), (3, "12 :-) \n"), (4, long), (5, "the dog"), (5, "the dog"), (9007199254740993, "und die"), (None, "the"), (7, "ж"), (8, "\U0001f600")]
    got = [tuple(r) for r in language.identify(spark.createDataFrame(rows, "doc_id long, text string").withColumns({"lang_pred": F.lit("x"), "a.b": F.lit(1)}), model).collect()]
    by = {r[0]: r for r in got}
    assert len(got) == len(rows) and all(0 <= r[3] <= 1 for r in got)
    assert [by[k][2] for k in (1, 2, 3, 8)] == ["und"] * 4 and by[4][2] == "de" and by[5][2] == "en" and by[9007199254740993][2] == "de" and by[None][2] == "en"
    assert by[7][2] == "de" and by[7][3] == 0  # no language knows the letter: a tie, and the first name
    empty = language.fit(docs.limit(0))
    assert [r.lang_pred for r in language.identify(docs.limit(2), empty).collect()] == ["und"] * 2 and language.identify(docs.limit(0), model).count() == 0


def test_blocks_and_pieces_of_any_size():
    model = language.build({"a": ["ab" * 300], "b": ["ba" * 3]})
    table = language.code_table(model.letters)
    texts = [language.encoded("ab" * n, table) for n in (1, 127, 128, 129, 5000)]
    got, sizes = language.judge(texts, model)
    assert got[:, 0].tolist() == [1, 1, 1, 2, 40] and sizes.tolist() == [2, 254, 256, 258, 10000]
    assert language.judge([], model)[0].shape == (0, 2) and np.array_equal(language.encoded("", table), [])
