"""Near duplicates among all statements of a subject: an exact self join by character similarity, block by block, behind bounds by length, common grams and common subsequence."""

from __future__ import annotations

import math
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from kgspark.functions.exprs import normalized_name
from kgspark.operators.governance import NEAR
from kgspark.session import Scratch, materialise, workers_import_this

#: Texts, and characters, of a cell at most, about: two cells meet in a task.
CELL, CELL_CHARS = 2000, 1_000_000
#: Characters of texts that are looked at as one number.
ROW = 1 << 14
#: Parts of a text after which it is dropped where no text of a row can be near it any more; parts after which a pair of short texts is.
STOPS, SHORT_STOPS = (0.55, 0.75), (0.5, 0.57, 0.64, 0.72, 0.8, 0.9)
#: Pairs that a task compares, about.
TASK_PAIRS = 4_000_000
#: Characters of a gram; slots for grams, a character of a text; numbers in a table of grams, about.
GRAM, SLOTS, TABLE = 5, 8, 1 << 23
#: difflib's own: from this length on, characters that make up more than a hundredth of a text (and one) start no match.
POPULAR = 200
#: Pairs of equal characters that may start a match, from how many to how many they are looked at at once.
AT_ONCE = (20_000, 1 << 22)
#: Subjects of at most so many texts are compared together, pair by pair.
FEW = 64
#: Texts of at most so many characters are compared pair by pair, in words of 63; first texts and pairs at once; bytes of characters' places, about.
SHORT, SHORT_ROWS, SHORT_PAIRS, PLACES = 315, 512, 4096, 1 << 24


def classes(statements: DataFrame, subject: str, ident: str, text: str) -> DataFrame:
    """subject, t (normalised text), rep (least id), members: each distinct text of a subject once. Blank texts and null subjects have none."""
    tidy = statements.select(F.col(subject).cast("string").alias("subject"), F.col(ident).cast("string").alias("i"), normalized_name(F.col(text)).alias("t")).where("subject is not null and t <> ''")
    return tidy.groupBy("subject", "t").agg(F.min("i").alias("rep"), F.count("*").alias("members"))


def _chars(texts: list[str]) -> np.ndarray:
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)


def _rows(texts: list[str], order: list[int]) -> Iterator[list[int]]:
    """Texts (by length) that are looked at as one number."""
    at = 0
    while at < len(order):
        end, size = at, 0
        while end < len(order) and (end == at or size + len(texts[order[end]]) < ROW):
            size += len(texts[order[end]]) + 1
            end += 1
        yield order[at:end]
        at = end


def _number(bits: np.ndarray) -> int:
    return int.from_bytes(np.packbits(bits, bitorder="little").tobytes(), "little")


def _row(texts: list[str]) -> tuple[np.ndarray, dict[str, int], int]:
    """Texts put behind one another, a free bit after each: their first bits, the bits of each character and of all characters."""
    chars = _chars([t + "\0" for t in texts])
    n = np.array([len(t) for t in texts])
    starts = np.cumsum(n + 1) - n - 1
    free = np.zeros(len(chars), bool)
    free[starts + n] = True
    held = {chr(c): _number((chars == c) & ~free) for c in np.unique(chars[~free]).tolist()}
    return starts, held, _number(~free)


class _Grams:
    """Grams of texts (by length): the texts' lengths, the most blocks that difflib can match of each as the second text, each gram's text and hash."""

    def __init__(self, texts: list[str]) -> None:
        chars = _chars(texts).astype(np.uint64)
        self.n = np.array([len(t) for t in texts], np.int64)
        own = np.repeat(np.arange(len(texts)), self.n)
        held, times = np.unique(own.astype(np.uint64) << np.uint64(21) | chars, return_counts=True)
        of = (held >> np.uint64(21)).astype(np.int64)
        # each block holds a character that is not popular, but for one: what both texts begin with
        rare = np.bincount(of, np.where(times > self.n[of] // 100 + 1, 0, times), len(texts)).astype(np.int64)
        self.blocks = np.where(self.n >= POPULAR, rare + 1, self.n)
        many = max(len(chars) - GRAM + 1, 0)
        h = np.zeros(many, np.uint64)
        for j in range(GRAM):
            h = h * np.uint64(0x100000001B3) + chars[j : j + many]
        h = (h ^ h >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)
        inside = own[:many] == own[GRAM - 1 :][:many]
        self.own, self.hashes = own[:many][inside], h[inside] >> np.uint64(32)

    def table(self, at: int, end: int, slots: int) -> np.ndarray:
        """How many grams of each of these texts fall in each slot."""
        out, step = np.empty((end - at, slots), np.float32), max(1, (1 << 20) // slots)
        for k in range(at, end, step):
            upto = min(end, k + step)
            a, b = np.searchsorted(self.own, (k, upto))
            place = (self.own[a:b] - k) * slots + (self.hashes[a:b] % np.uint64(slots)).astype(np.int64)
            out[k - at : upto - at] = np.bincount(place, minlength=(upto - k) * slots).reshape(-1, slots)
        return out


    def may_match(self, i: int, j: int, near: float) -> bool:
        """may_match() of two of these texts."""
        need = math.ceil(near * (self.n[i] + self.n[j]) / 2 - 1e-9)
        a, b = (self.hashes[slice(*np.searchsorted(self.own, (k, k + 1)))] for k in (i, j))
        return any(self.n[k] < POPULAR or np.isin(g, h).sum() >= need - self.blocks[k] * (GRAM - 1) for k, g, h in ((i, a, b), (j, b, a)))


def may_match(first: list[str], second: list[str], near: float) -> np.ndarray:
    """Which texts (both lists by length) difflib may find near each other, whichever of both it gets second.

    Of a second text of POPULAR characters or more, a block that difflib matches has a character that is not popular there (one block may have none). So blocks
    are at most so many, and all but GRAM - 1 characters of each begin a gram that the first text has too. Grams of one slot count as equal, so no pair is lost.
    """
    x, y = _Grams(first), _Grams(second)
    may = np.ones((len(first), len(second)), bool)
    wide, at, low = (2 - near) / near, int(np.searchsorted(x.n, POPULAR)), int(np.searchsorted(y.n, POPULAR))
    while at < len(first) and low < len(second):
        end = at + 1
        while end < len(first) and (end + 1 - at) * SLOTS * int(x.n[end]) <= TABLE:
            end += 1
        size = SLOTS * int(x.n[end - 1])
        here = x.table(at, end, size)
        has = (here > 0).astype(np.float32)
        a, b = max(low, int(np.searchsorted(y.n, int(x.n[at] / wide)))), int(np.searchsorted(y.n, int(x.n[end - 1] * wide) + 1, "right"))
        step = max(1, TABLE // size)
        for k in range(a, b, step):
            upto = min(b, k + step)
            there = y.table(k, upto, size)
            m, n = x.n[at:end, None], y.n[None, k:upto]
            need = np.ceil(near * (m + n) / 2 - 1e-9)
            got = here @ (there > 0).astype(np.float32).T >= need - x.blocks[at:end, None] * (GRAM - 1)
            may[at:end, k:upto] = got | (has @ there.T >= need - y.blocks[None, k:upto] * (GRAM - 1))
        at = end
    return may


def subsequences(text: str, starts: np.ndarray, n: np.ndarray, held: dict[str, int], whole: int, near: float) -> np.ndarray:
    """Lengths of the longest common subsequences of a text with each text of a row: a bit falls where one gets longer, a free bit keeps texts apart.

    All are 0 where no text can be near: of a text's first i characters as many are shared as with the other's first i and those
    that this one may have more, the rest at best all.
    """
    m, v, done, size = len(text), whole, 0, int(starts[-1] + n[-1] + 1)
    need = np.ceil(near * (m + n) / 2 - 1e-9).astype(np.int64)
    bits = [held.get(c) for c in text]
    for i in (*(int(m * x) for x in STOPS), m):
        for p in bits[done:i]:
            if p is not None:
                u = v & p
                v = (v + u | v ^ u) & whole
        done = i
        ones = np.cumsum(np.unpackbits(np.frombuffer(b"\0" + v.to_bytes(size // 8 + 1, "little"), np.uint8), bitorder="little")[7:], dtype=np.int64)
        reach = n if i == m else np.clip(n - need + i, 0, n)
        got = reach - (ones[starts + reach] - ones[starts])
        if not (got + m - i >= need).any():
            return np.zeros(len(n), np.int64)
    return got


def _times(texts: list[str]) -> np.ndarray:
    """How often each text has the characters of each of 64 slots."""
    own = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    return np.bincount(own * 64 + _chars(texts) % 64, minlength=len(texts) * 64).reshape(-1, 64)


def may_share(first: list[str], second: list[str], near: float) -> np.ndarray:
    """Which texts share as many characters, wherever they stand, as texts near each other do: ones for the first, second, ... time that a text has a character, multiplied. Characters of one slot of 64 count as equal."""

    def ones(held: np.ndarray) -> np.ndarray:
        return np.concatenate([held[:, c : c + 1] > np.arange(most[c]) for c in range(64)], axis=1).astype(np.float32)

    x, y = _times(first), _times(second)
    most = np.minimum(x.max(axis=0), y.max(axis=0))
    m, n, step = x.sum(axis=1)[:, None], y.sum(axis=1)[None, :], max(1, TABLE // max(1, int(most.sum())))
    may = np.empty((len(first), len(second)), bool)
    for k in range(0, len(second), step):
        there = ones(y[k : k + step]).T
        for at in range(0, len(first), step):
            may[at : at + step, k : k + step] = ones(x[at : at + step]) @ there >= near * (m[at : at + step] + n[:, k : k + step]) / 2 - 1e-9
    return may


def short_pairs(first: list[str], second: list[str], i: np.ndarray, j: np.ndarray, near: float) -> np.ndarray:
    """Which pairs (i, j) of short texts, both lists by length, have a common subsequence long enough: subsequences() for many pairs at once, 63 characters of a second text in a word."""
    found = np.zeros(len(i), bool)
    if not len(i):
        return found
    kinds, codes = np.unique(np.concatenate([_chars(first), _chars(second)]), return_inverse=True)
    m, n = np.array([len(t) for t in first]), np.array([len(t) for t in second])
    none, words = len(kinds), -(-int(n.max()) // 63)
    own = np.repeat(np.arange(len(first)), m)
    steps = np.full((int(m.max()), len(first)), none)  # a character that stands nowhere fills up texts
    steps[np.arange(len(own)) - (np.cumsum(m) - m)[own], own] = codes[: len(own)]
    codes, of = codes[len(own) :], np.repeat(np.arange(len(second)), n)
    at = np.arange(len(of)) - (np.cumsum(n) - n)[of]
    order, full = np.argsort(j, kind="stable"), np.uint64((1 << 63) - 1)
    size = max(1, PLACES // ((none + 1) * words * 64))
    for k in range(0, len(second), size):
        here = order[slice(*np.searchsorted(j[order], (k, k + size)))]
        if not len(here):
            continue
        some = (of >= k) & (of < k + size)
        places = np.zeros((size, none + 1, words * 64), np.uint8)
        places[of[some] - k, codes[some], at[some] // 63 * 64 + at[some] % 63] = 1
        places = np.packbits(places, axis=2, bitorder="little").view("<u8").reshape(-1, words).T.copy()
        here = here[np.argsort(i[here], kind="stable")]
        for part in range(0, len(here), SHORT_PAIRS):
            p = here[part : part + SHORT_PAIRS]
            used = -(-int(n[j[p]].max()) // 63)
            v, done = [np.full(len(p), full) for _ in range(used)], 0
            least, last = int(m[i[p]].min()), int(m[i[p]].max())
            for stop in (*(int(least * x) for x in SHORT_STOPS), last):
                x, y, need = i[p], (j[p] - k) * (none + 1), np.ceil(near * (m[i[p]] + n[j[p]]) / 2 - 1e-9).astype(np.int64)
                for step in range(done, stop):
                    place, carry = y + steps[step, x], np.uint64(0)
                    for w in range(used):
                        u = v[w] & places[w].take(place)
                        s = v[w] + u + carry
                        v[w] = (s | v[w] ^ u) & full
                        carry = s >> np.uint64(63)
                done = stop
                reach = n[j[p]] if stop == last else np.clip(n[j[p]] - need + stop, 0, n[j[p]])
                got = sum(np.bitwise_count(~v[w] & ((np.uint64(1) << np.clip(reach - 63 * w, 0, 63).astype(np.uint64)) - np.uint64(1))).astype(np.int64) for w in range(used))
                stay = got + np.maximum(m[i[p]] - stop, 0) >= need
                p, v = p[stay], [x[stay] for x in v]
                if not len(p):
                    break
            found[p] = True
    return found


def near_pairs(first: list[str], second: list[str] | None, near: float) -> Iterator[tuple[int, int]]:
    """Numbers of texts that may be near: of both lists, or of two texts of the first. What difflib matches is a common subsequence, so that one that is too short rules a pair out."""
    same, second = second is None, first if second is None else second
    if not first or not second:
        return
    by_length = sorted(range(len(first)), key=lambda k: len(first[k]))
    order = by_length if same else sorted(range(len(second)), key=lambda k: len(second[k]))
    x, y = [first[k] for k in by_length], [second[k] for k in order]
    m, n = np.array([len(t) for t in x]), np.array([len(t) for t in y])
    a, b = (int(np.searchsorted(z, SHORT, "right")) for z in (m, n))
    may = may_match(x, y, near) & (2 * np.minimum(m[:, None], n[None, :]) >= near * (m[:, None] + n[None, :]) - 1e-9)
    if a and b:
        may[:a, :b] &= may_share(x[:a], y[:b], near)
    if same:
        may = np.triu(may, 1)
    for k in range(0, a, SHORT_ROWS):
        i, j = np.nonzero(may[k : min(a, k + SHORT_ROWS), :b])
        ok = short_pairs(x[k : k + SHORT_ROWS], y[:b], i, j, near)
        yield from ((by_length[k + i], order[j]) for i, j in zip(i[ok].tolist(), j[ok].tolist()))
    may[:a, :b] = False
    at = 0
    for row in _rows(second, order):
        some, ok, looked = np.arange(at, at + len(row)), may[:, at : at + len(row)], None
        at += len(row)
        for i in np.flatnonzero(ok.any(axis=1)).tolist():
            hits = np.flatnonzero(ok[i])
            if 4 * len(hits) < len(row):  # few: a row of their own
                starts, held, whole = _row([y[j] for j in some[hits].tolist()])
            else:
                looked = looked or _row([y[j] for j in some.tolist()])
                hits, (starts, held, whole) = np.arange(len(row)), looked
            sizes = n[some[hits]]
            shared = subsequences(x[i], starts, sizes, held, whole, near)
            for j in some[hits[ok[i, hits] & (2 * shared >= near * (m[i] + sizes) - 1e-9)]].tolist():
                yield by_length[i], order[j]


def near_in_groups(texts: list[str], groups: np.ndarray, near: float) -> Iterator[tuple[int, int]]:
    """near_pairs() within each of many small groups of texts, in all of them at once."""
    by_length = np.array(sorted(range(len(texts)), key=lambda k: len(texts[k])))
    x = [texts[k] for k in by_length.tolist()]
    n, places = np.array([len(t) for t in x]), np.argsort(groups[by_length], kind="stable")
    _, starts, sizes = np.unique(groups[by_length][places], return_index=True, return_counts=True)
    found = [np.zeros((2, 0), np.int64)]
    for size in np.unique(sizes).tolist():
        members = places[starts[sizes == size][:, None] + np.arange(size)]
        found += [np.stack([members[:, a].ravel(), members[:, b].ravel()]) for a, b in [np.triu_indices(size, 1)]]
    i, j = np.concatenate(found, axis=1)
    least, held, share = near * (n[i] + n[j]) / 2 - 1e-9, _times(x), np.zeros(len(i), np.int64)
    for k in range(0, len(i), 1 << 14):
        some = slice(k, k + (1 << 14))
        share[some] = np.minimum(held[i[some]], held[j[some]]).sum(axis=1)
    stay = (n[i] >= least) & (share >= least)
    i, j = i[stay], j[stay]
    short, a = n[j] <= SHORT, int(np.searchsorted(n, SHORT, "right"))
    ok = short_pairs(x[:a], x[:a], i[short], j[short], near)
    yield from zip(by_length[i[short][ok]].tolist(), by_length[j[short][ok]].tolist())
    grams = _Grams(x)
    for k, other in zip(i[~short].tolist(), j[~short].tolist()):
        if grams.may_match(k, other, near):
            starts, bits, whole = _row([x[other]])
            m = n[k] + n[other]
            if 2 * subsequences(x[k], starts, n[other : other + 1], bits, whole, near)[0] >= near * m - 1e-9:
                yield int(by_length[k]), int(by_length[other])


@lru_cache(maxsize=256)
def _starts(text: str) -> dict[str, list[int]]:
    """Where the characters stand that may start a match in a second text: those that are not popular, if it is long."""
    most = len(text) // 100 + 1 if len(text) >= POPULAR else len(text)
    places: dict[str, list[int]] = {c: [] for c, k in Counter(text).items() if k <= most}
    for j, c in enumerate(text):
        if c in places:
            places[c].append(j)
    return places


def _runs(a: str, seeds: list[int], places: dict[str, list[int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places (x in a, y in b, by x and y) of equal characters that may start a match, and how many follow one another up to there."""
    held = {c: np.array(p) for c, p in places.items()}
    x, y = np.repeat(seeds, [len(places[a[k]]) for k in seeds]), np.concatenate([held[a[k]] for k in seeds])
    order = np.lexsort((x, y - x))
    here, way = x[order], (y - x)[order]
    first = np.flatnonzero(np.r_[True, (np.diff(way) != 0) | (np.diff(here) != 1)])
    run = np.empty(len(x), np.int64)
    run[order] = np.arange(len(x)) - np.repeat(first, np.diff(np.r_[first, len(x)])) + 1
    return x, y, run


def ratio(a: str, b: str) -> float:
    """difflib's SequenceMatcher(None, a, b).ratio(). Characters of a that can start no match are not visited, places are looked up, and what follows a match is compared in stretches."""
    places = _starts(b)
    seeds = [i for i, c in enumerate(a) if c in places]
    many = sum(len(places[a[x]]) for x in seeds)
    runs = _runs(a, seeds, places) if AT_ONCE[0] <= many <= AT_ONCE[1] else None
    total, todo = 0, [(0, len(a), 0, len(b))]
    while todo:
        alo, ahi, blo, bhi = todo.pop()
        i, j, size, before, last = alo, blo, 0, {}, -2
        some = seeds[bisect_left(seeds, alo) : bisect_left(seeds, ahi)]
        if runs and len(some) > 50:
            part = slice(*np.searchsorted(runs[0], (alo, ahi)))
            xs, ys, run = (r[part] for r in runs)
            # the first of the longest, cut where the window begins
            length = np.where((ys >= blo) & (ys < bhi), np.minimum(run, np.minimum(xs - alo, ys - blo) + 1), 0)
            best = int(length.argmax())
            if length[best]:
                size = int(length[best])
                i, j = int(xs[best]) - size + 1, int(ys[best]) - size + 1
            some = []
        for x in some:
            now: dict[int, int] = {}
            if x != last + 1:
                before = {}
            at = places[a[x]]
            for y in at[bisect_left(at, blo) : bisect_left(at, bhi)]:
                k = now[y] = before.get(y - 1, 0) + 1
                if k > size:
                    i, j, size = x - k + 1, y - k + 1, k
            before, last = now, x
        while i - alo >= 32 and j - blo >= 32 and a[i - 32 : i] == b[j - 32 : j]:
            i, j, size = i - 32, j - 32, size + 32
        while i > alo and j > blo and a[i - 1] == b[j - 1]:
            i, j, size = i - 1, j - 1, size + 1
        while i + size + 32 <= ahi and j + size + 32 <= bhi and a[i + size : i + size + 32] == b[j + size : j + size + 32]:
            size += 32
        while i + size < ahi and j + size < bhi and a[i + size] == b[j + size]:
            size += 1
        if size:
            total += size
            if alo < i and blo < j:
                todo.append((alo, i, blo, j))
            if i + size < ahi and j + size < bhi:
                todo.append((i + size, ahi, j + size, bhi))
    return 2.0 * total / (len(a) + len(b)) if a or b else 1.0


def _band(length: Column, near: float) -> Column:
    """Length bands so wide that texts near each other are in one band or in neighbouring ones."""
    return F.floor(F.log(length.cast("double")) / F.lit(math.log((2 - near) / near)) + F.lit(1e-9)).cast("int")


def similar_statements(statements: DataFrame, subject: str, ident: str, text: str, near: float = NEAR) -> tuple[DataFrame, DataFrame]:
    """(pairs, membership) of statements of one subject whose texts are near each other, over all statements.

    membership: subject, id, rep: each statement with the least id of those that say the same (in lower case, white space collapsed). pairs: subject, first_rep, second_rep,
    similarity (difflib's ratio of the second text to the first, in the order of their ids) for different texts from `near` on. Blank texts and null subjects take
    no part.

    A subject's texts are dealt into bands by their length and cells of bounded size; each two cells of a band or of neighbouring ones meet in a task, which
    drops a pair only where lengths, the grams that both have or the longest common subsequence rule it out. Subjects with few texts share tasks. The work is
    quadratic in the texts of a subject and band, what a task holds is not.
    """
    spark = statements.sparkSession
    workers_import_this(spark)

    def compared(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []

        def add(rows: pd.DataFrame, pairs: Iterator[tuple[int, int]]) -> None:
            names, ids, texts = (rows[c].tolist() for c in ("subject", "rep", "t"))
            for k, j in pairs:
                a, b = sorted((k, j), key=ids.__getitem__)
                r = ratio(texts[b], texts[a])
                if r >= near:
                    out.append((names[a], ids[a], ids[b], r))

        few = pdf[(pdf.groupby("subject")["rep"].transform("size") <= FEW) & (pdf["side"] == 0)]
        if len(few):
            add(few, near_in_groups(few["t"].tolist(), pd.factorize(few["subject"])[0], near))
        for _, rows in pdf.drop(few.index).groupby("subject", sort=False):
            side, texts = rows["side"].to_numpy(), rows["t"].tolist()
            same = bool((side == 0).all())
            left, right = (range(len(texts)), range(len(texts))) if same else (np.flatnonzero(side == 1).tolist(), np.flatnonzero(side == 2).tolist())
            pairs = near_pairs([texts[i] for i in left], None if same else [texts[i] for i in right], near)
            add(rows, ((left[k], right[j]) for k, j in pairs))
        kinds = (("subject", object), ("first_rep", object), ("second_rep", object), ("similarity", "float64"))
        return pd.DataFrame({c: pd.Series([x[i] for x in out], dtype=t) for i, (c, t) in enumerate(kinds)})

    with Scratch(spark, "similar") as s:
        reps = s.write(classes(statements, subject, ident, text).select("subject", "rep", "t").withColumn("band", _band(F.char_length("t"), near)), "classes")
        held = reps.groupBy("subject", "band").agg(F.count("*").alias("n"), F.sum(F.char_length("t")).alias("chars"))
        full = lambda n, chars: F.ceil(F.greatest(n / F.lit(CELL), chars / F.lit(CELL_CHARS))).cast("int")
        subjects = held.groupBy("subject").agg(F.sum("n").alias("all_n"), full(F.sum("n"), F.sum("chars")).alias("all_cells")).where("all_n > 1")
        cells = s.write(held.join(subjects, "subject").withColumn("cells", full(F.col("n"), F.col("chars"))), "cells")
        few = cells.where("all_cells = 1").select("subject").distinct()
        beside = lambda by, name: cells.select("subject", (F.col("band") + by).alias("band"), F.col("cells").alias(name), F.col("n").alias(f"{name}_n"))
        many = s.write(cells.where("all_cells > 1").join(beside(-1, "up"), ["subject", "band"], "left").join(beside(1, "down"), ["subject", "band"], "left").fillna(0), "many")
        rows = cells.where("all_cells = 1").agg(F.sum("n")).first()[0] or 0
        pairs_of = F.col("n").cast("double") * (F.col("n") / 2 + F.col("up_n"))
        parts = math.ceil((rows * CELL / 2 + (many.agg(F.sum(pairs_of)).first()[0] or 0)) / TASK_PAIRS)
        shared = reps.join(few, "subject").select(F.concat(F.lit("few "), F.pmod(F.xxhash64("subject"), F.lit(max(1, rows // CELL)))).alias("key"), F.lit(0).alias("side"), "subject", "rep", "t")
        # a cell meets itself (side 0), the others of its band once each, and all of the bands beside it
        own = reps.join(many, ["subject", "band"]).withColumn("i", F.pmod(F.xxhash64("rep"), F.col("cells")).cast("int"))
        key = lambda band, way, i, j: F.concat_ws(" ", band, F.lit(way), i, j, F.col("subject"))
        with_each = lambda n, make: F.transform(F.when(F.col(n) > 0, F.sequence(F.lit(0), F.col(n) - 1)).otherwise(F.array().cast("array<int>")), make)
        i, band = F.col("i"), F.col("band")
        places = F.concat(
            with_each("cells", lambda j: F.struct(key(band, "=", F.least(i, j), F.greatest(i, j)).alias("key"), F.when(i == j, 0).when(i < j, 1).otherwise(2).alias("side"))),
            with_each("up", lambda j: F.struct(key(band, "+", i, j).alias("key"), F.lit(1).alias("side"))),
            with_each("down", lambda j: F.struct(key(band - 1, "+", j, i).alias("key"), F.lit(2).alias("side"))),
        )
        met = shared.unionByName(own.select(F.explode(places).alias("p"), "subject", "rep", "t").select("p.*", "subject", "rep", "t"))
        # so many partitions by what they compare: by bytes they would be too few
        met = met.repartition(max(spark.sparkContext.defaultParallelism, parts), "key")
        pairs = materialise(met.groupBy("key").applyInPandas(compared, "subject string, first_rep string, second_rep string, similarity double"), "similar-pairs")
    tidy = statements.select(F.col(subject).cast("string").alias("subject"), F.col(ident).cast("string").alias("id"), normalized_name(F.col(text)).alias("t")).where("subject is not null and t <> ''")
    return pairs, tidy.join(classes(statements, subject, ident, text).select("subject", "t", "rep"), ["subject", "t"]).select("subject", "id", "rep")


def duplicate_gate(rows: DataFrame, pairs: DataFrame, membership: DataFrame, subject: str, ident: str) -> DataFrame:
    """rows with gate_duplicate: false where another statement of the subject says the same or nearly so (pairs and membership of similar_statements() over all of them)."""
    sizes = membership.groupBy("subject", "rep").agg(F.count("*").alias("kg_n"))
    near = pairs.select("subject", F.col("first_rep").alias("rep")).unionByName(pairs.select("subject", F.col("second_rep").alias("rep"))).distinct().withColumn("kg_near", F.lit(True))
    marked = membership.join(sizes, ["subject", "rep"]).join(near, ["subject", "rep"], "left").select(F.col("subject").alias("kg_subject"), F.col("id").alias("kg_id"), ((F.col("kg_n") > 1) | F.coalesce("kg_near", F.lit(False))).alias("kg_dup")).distinct()
    got = rows.join(marked, (F.col(subject).cast("string") == F.col("kg_subject")) & (F.col(ident).cast("string") == F.col("kg_id")), "left")
    return got.withColumn("gate_duplicate", ~F.coalesce("kg_dup", F.lit(False))).drop("kg_subject", "kg_id", "kg_dup")
