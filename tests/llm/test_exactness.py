"""Benchmark items against overlap alone, ids that floats would round, odd names, and labels given twice."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from kgspark.llm import decontaminate, jaccard, matroska, packing, pii, quality

BIG = 9007199254740993
DOCS = "doc_id long, text string"


def overlaps(text, item):
    """Whether one passage of the text holds the item's question and answer."""
    w, (q, a) = decontaminate.words(text), decontaminate.parts(item)
    span = decontaminate.span_of(len(decontaminate.words(item)))
    return any(decontaminate.holds(p, q) >= decontaminate.QUESTION and decontaminate.holds(p, a) >= decontaminate.ANSWER for at in decontaminate.passages(len(w), span) for p in [f" {' '.join(w[at : at + span])} "])


def test_every_item_that_overlaps_is_found(spark):
    rnd = random.Random(11)
    common = [f"c{k}" for k in range(12)]

    def item(k):
        words = [rnd.choice(common) for _ in range(rnd.randint(6, 30))]
        for _ in range(rnd.randint(0, 4)):
            words[rnd.choice([0, 0, len(words) - 1, rnd.randrange(len(words))])] = f"rare{k}x{rnd.randrange(99)}"
        cut = rnd.randint(3, len(words) - 2)
        return " ".join(words[:cut]) + "? " + " ".join(words[cut:])

    items = [(k, item(k)) for k in range(150)]
    items += [(200 + k, f"first{k} one two three four five six seven eight nine ten? the answer is here now") for k in range(40)]

    def near(t):
        w = t.replace("?", " ?").split()
        for _ in range(rnd.randint(0, 3)):
            k = rnd.choice([0, len(w) - 1, rnd.randrange(len(w))])
            w[k : k + 1] = rnd.choice([[], ["zz"]])
            if not w:
                break
        return " ".join([*(rnd.choice(common) for _ in range(rnd.randint(0, 40))), *w, *(rnd.choice(common) for _ in range(30))])

    docs = [(k, near(t)) for k, (_, t) in enumerate(items)] + [(900, "one two three four five six seven eight nine ten? the answer is here now"), (901, ""), (902, None)]
    want = {(d, i) for d, t in docs for i, x in items if t and overlaps(t, x)}
    got = decontaminate.leaks(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, "item_id long, text string"))
    assert {(r.doc_id, r.item_id) for r in got.collect()} == want and len(want) > 60 and sum(d == 900 for d, _ in want) == 40


def test_words_lost_at_most():
    rnd = random.Random(2)
    for _ in range(300):
        n = rnd.randint(5, 14)
        w = [rnd.random() for _ in range(n)]
        runs = n - 4
        lacking = {r for r in range(runs) if rnd.random() < 0.4}
        lost = sum(w[i] for i in range(n) if all(r in lacking for r in range(max(0, i - 4), min(runs, i + 1))))
        assert lost <= decontaminate.most_lost(w, len(lacking)) + 1e-9


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame([(BIG, "call +49 30 1234567 or mail a@b.org"), (None, "plain words here"), (BIG + 2, "more words. " * 9), (None, None)], DOCS)


def test_large_ids_beside_null_ones(spark, rows):
    want = {BIG, BIG + 2, None}
    ids = lambda df: {r.doc_id for r in df.select("doc_id").collect()}
    assert ids(packing.tokenize(rows)) == ids(matroska.text_media(rows)) == ids(pii.find_personal_data(rows)) == want
    bench = spark.createDataFrame([(1, "more words more words more words more words? more words more words more")], "item_id long, text string")
    assert ids(decontaminate.leaks(rows, bench)) == {BIG + 2}
    labels = spark.createDataFrame([(1, 0)], "doc_id long, quality int")
    assert ids(quality.score(rows, quality.fit(rows, labels))) == want


def test_odd_names_and_large_numbers_stay(spark, rows):
    docs = rows.withColumns({"a.b": F.lit(1), "kg_score": F.col("doc_id"), "kg leaks": F.lit("x")})
    labels = spark.createDataFrame([(BIG, 1)], "doc_id long, quality int")
    same = lambda a, b: sorted(map(str, (tuple(r) for r in a.collect()))) == sorted(map(str, (tuple(r) for r in b.collect())))
    assert same(quality.keep_good(docs, labels), docs)
    assert same(decontaminate.keep_clean(docs, spark.createDataFrame([(1, "nothing of this stands in any of the texts")], "item_id long, text string")), docs)


def test_labels_given_twice_are_one(spark):
    docs = spark.createDataFrame([(k, ("good fine words " if k % 2 else "bad junk noise ") * 5) for k in range(60)], DOCS)
    once = spark.createDataFrame([(k, k % 2) for k in range(60)], "doc_id long, quality int")
    twice = once.unionByName(once).unionByName(spark.createDataFrame([(k, 0) for k in range(1, 60, 2)], once.schema))
    score = lambda labels: sorted(map(tuple, quality.score(docs, quality.fit(docs, labels)).collect()))
    assert score(once) == score(twice.repartition(5))


def test_a_key_of_sets_of_all_sizes_needs_no_parts(spark, monkeypatch):
    # the least shingle by hash stands in the prefix of every set, so its list is long; no two sets are near in size, but for one linked pair
    first = min((f"one{i} two three" for i in range(5000)), key=lambda t: int(jaccard.set_of(t, 3)[0]))
    rows = [(i, " ".join([first, *(f"w{i}x{j}" for j in range(int(8 * 1.5**i)))])) for i in range(9)]
    rows.append((20, rows[5][1] + " more"))
    monkeypatch.setattr(jaccard, "common_shingles", lambda *a: (np.zeros(0, np.uint64), np.zeros(0, np.int32)))
    monkeypatch.setattr(jaccard, "late_parts", lambda *a: pytest.fail("sets of different sizes were cut into parts"))
    got = {r.doc_id: r.component_id for r in jaccard.link(spark.createDataFrame(rows, DOCS), 3, 90, small=2).collect()}
    assert got == {i: 5 if i == 20 else i for i, _ in rows}
