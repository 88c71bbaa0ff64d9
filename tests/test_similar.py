"""Near duplicates of a subject against all pairs by difflib."""

import random
from difflib import SequenceMatcher

import numpy as np

from kgspark.operators import similar


def test_equals_all_pairs(spark):
    rnd = random.Random(4)
    words = "market growth share region price of the and energy demand naïve 市场 ß1".split()
    base = [" ".join(rnd.choice(words) for _ in range(rnd.randint(1, 25))) for _ in range(40)]

    def changed(t):
        t = list(t)
        for _ in range(rnd.randint(0, max(1, len(t) // 8))):
            k = rnd.randrange(len(t) + 1)
            t[k : k + rnd.randint(0, 1)] = rnd.choice("abcdexyz ")
        return "".join(t)

    texts = base + [changed(rnd.choice(base)) for _ in range(160)] + [rnd.choice(base).upper() + " " for _ in range(20)] + ["", " ", None, "a", "a", "b"]
    rows = [(k, rnd.choice(["s1", "s1", "s1", "s2", None]), t) for k, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "id int, subject string, text string")
    pairs, members = similar.similar_statements(df, "subject", "id", "text")
    tidy = {(s, str(i)): " ".join((t or "").lower().split()) for i, s, t in rows if s and (t or "").strip()}
    rep = {}
    for (s, i), t in tidy.items():
        rep[s, t] = min(rep.get((s, t), i), i)
    want = set()
    for (s, t), i in rep.items():
        for (z, u), j in rep.items():
            if s == z and i < j:
                r = SequenceMatcher(None, u, t).ratio()
                if r >= 0.85:
                    want.add((s, i, j, r))
    assert {tuple(r) for r in pairs.collect()} == want and len(want) > 20
    assert {tuple(r) for r in members.collect()} == {(s, i, rep[s, t]) for (s, i), t in tidy.items()}
    gate = {r.id: r.gate_duplicate for r in similar.duplicate_gate(df, pairs, members, "subject", "id").collect()}
    linked = {(s, x) for s, a, b, _ in want for x in (a, b)}
    size = {}
    for (s, i), t in tidy.items():
        size[s, rep[s, t]] = size.get((s, rep[s, t]), 0) + 1
    assert all(gate[i] == (not ((s, str(i)) in tidy and (size[s, rep[s, tidy[s, str(i)]]] > 1 or (s, rep[s, tidy[s, str(i)]]) in linked))) for i, s, _ in rows)


def test_nothing_to_compare(spark):
    pairs, members = similar.similar_statements(spark.createDataFrame([], "id int, subject string, text string"), "subject", "id", "text")
    assert pairs.count() == 0 and members.count() == 0


def test_anagrams_of_a_large_subject_are_ruled_out_before_difflib():
    rnd = random.Random(7)
    letters = list("the market share of a region grows with its price " * 4)
    texts = []
    for _ in range(60):
        rnd.shuffle(letters)
        texts.append("".join(letters))
    texts.append(texts[0][:90] + texts[0][95:])
    assert {frozenset(p) for p in similar.near_pairs(texts, None, 0.85)} == {frozenset((0, 60))}


def test_cells_lose_no_pair(spark, monkeypatch):
    rnd = random.Random(9)
    base = ["".join(rnd.choice("abcdef ") for _ in range(rnd.randint(5, 30))) for _ in range(12)]
    texts = base + [t[:k] + t[k + 1 :] for t in base for k in (2, 4)]
    df = spark.createDataFrame([(k, "s", t) for k, t in enumerate(texts)], "id int, subject string, text string")
    want = {tuple(r) for r in similar.similar_statements(df, "subject", "id", "text")[0].collect()}
    monkeypatch.setattr(similar, "CELL", 4)
    assert {tuple(r) for r in similar.similar_statements(df, "subject", "id", "text")[0].collect()} == want and len(want) > 12


def _edited(rnd, text, letters, share):
    """A text after edits of about this share of its characters, some of whole stretches."""
    t = list(text)
    for _ in range(int(rnd.random() * share * len(t)) + 1):
        k, run = rnd.randrange(len(t) + 1), rnd.choice((1, 1, 1, 1, 9))
        t[k : k + rnd.choice((0, run))] = [rnd.choice(letters) for _ in range(rnd.choice((0, 1)))]
    return "".join(t)


def test_no_bound_loses_a_pair():
    """Texts beside the lengths at which difflib and the comparison change their ways, over alphabets of all sizes: what difflib finds near is among the pairs, whichever text comes first."""
    rnd, found = random.Random(11), 0
    for letters in ("ab", "etaoin shrdlu", "abcdefghijklmnopqrstuvwxyz    ", "".join(chr(0x4E00 + k) for k in range(900)), "e" * 60 + "qxz,."):
        texts = []
        for size in (1, 2, 5, 30, 62, 63, 64, 126, 150, 199, 200, 201, 230, 252, 315, 316, 400, 700):
            base = "".join(rnd.choice(letters) for _ in range(size))
            texts += [base, *(_edited(rnd, base, letters, share) for share in (0.05, 0.1, 0.2, 0.3)), base[: size // 7 + 1] + base[::-1][size // 7 + 1 :]]
        texts = [t for t in dict.fromkeys(texts) if t]
        near = {(i, j) for i, x in enumerate(texts) for j, y in enumerate(texts) if i < j and 2 * min(len(x), len(y)) >= 0.85 * (len(x) + len(y)) and max(SequenceMatcher(None, x, y).ratio(), SequenceMatcher(None, y, x).ratio()) >= 0.85}
        found += len(near)
        assert near <= {(min(p), max(p)) for p in similar.near_pairs(texts, None, 0.85)}
        left, right = list(range(0, len(texts), 2)), list(range(1, len(texts), 2))
        across = {(min(left[a], right[b]), max(left[a], right[b])) for a, b in similar.near_pairs([texts[k] for k in left], [texts[k] for k in right], 0.85)}
        assert {p for p in near if (p[0] + p[1]) % 2} <= across
        groups = np.array([rnd.randrange(5) for _ in texts])
        assert {p for p in near if groups[p[0]] == groups[p[1]]} <= {(min(p), max(p)) for p in similar.near_in_groups(texts, groups, 0.85)}
    assert found > 200


def test_ratio_is_that_of_difflib():
    rnd = random.Random(12)
    for letters in ("ab", "etaoin shrdlu", "abcdefghijklmnopqrstuvwxyz    ", "".join(chr(0x4E00 + k) for k in range(300)), "e" * 60 + "qxz,.", "a"):
        for size in (0, 1, 3, 40, 150, 199, 200, 201, 299, 300, 640):
            base = "".join(rnd.choice(letters) for _ in range(size))
            for share in (0.0, 0.05, 0.2, 0.6):
                other = _edited(rnd, base, letters, share) if share else rnd.choice((base, base[::-1], "".join(rnd.choice(letters) for _ in range(size))))
                assert similar.ratio(base, other) == SequenceMatcher(None, base, other).ratio()
                assert similar.ratio(other, base) == SequenceMatcher(None, other, base).ratio()


def test_ratio_of_long_texts_is_that_of_difflib(monkeypatch):
    rnd, letters = random.Random(13), "etaoinshrdlucmfwypvbgkjqxz    "
    base = "".join(rnd.choice(letters[: rnd.randint(5, 30)]) for _ in range(6000))
    for share in (0.02, 0.2, 0.5):
        other = _edited(rnd, base, letters, share)
        assert similar.ratio(base, other) == SequenceMatcher(None, base, other).ratio()
    monkeypatch.setattr(similar, "AT_ONCE", (1, 1 << 22))
    test_ratio_is_that_of_difflib()


def test_long_texts_without_common_grams_are_ruled_out_before_their_subsequences(monkeypatch):
    rnd = random.Random(3)
    syllables = ["th", "er", "on", "an", "re", "he", "in", "ed", "nd", "ha", "at", "en", "es", "of", "or", "nt", "ea", "ti", "to", "it", "st", "io", "le", "is", "ou", "ar", "as", "de", "rt", "ve"]
    texts = [" ".join("".join(rnd.choice(syllables) for _ in range(rnd.randint(1, 4))) for _ in range(80)) + " why, my big job quiz." for _ in range(60)]
    texts.append(texts[5][:100] + texts[5][110:])
    looked, subsequences = [], similar.subsequences
    monkeypatch.setattr(similar, "subsequences", lambda text, starts, n, *rest: looked.append(len(n)) or subsequences(text, starts, n, *rest))
    assert {frozenset(p) for p in similar.near_pairs(texts, None, 0.85)} == {frozenset((5, 60))}
    assert sum(looked) < 60
