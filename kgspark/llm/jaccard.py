"""N-gram Jaccard join: prefix filters under several global orders of the shingles, intersected before verification.

Each text is a set of word shingles. Texts with equal sets form a class and
are joined through it. In any one order of all shingles, two sets whose
similarity reaches the threshold share one of their first shingles, so they do in
each of several orders:

* the first order puts shingles that few documents hold first, by hash, and then
  those that more hold, by their number of documents; its prefixes are the postings;
* further orders go by other hashes; each class has its prefixes in those
  orders as hash arrays, and a pair must share an element in each.

Lengths and a parity bitmap (bits flip with each shingle of the difference, so
set bits of the exclusive or bound it from below) are tested as well, the cheaper test first.
Only then are pairs verified, on their whole texts.

A short posting list gives all its pairs. A long one is split by levels of sizes, as sets that link
lie in one level or in neighbouring ones; what is short then gives all its pairs too. One that stays long is first paired with a few
pivots of its own, and each member's closest ones are verified. What then
stays are members of long lists in different components. Their sets are cut
into one part more than a linked pair can differ in shingles, so a linked pair has
a part in common as a whole: the lists of equal parts split the long lists, and
hold near copies only. Their members first meet a few of their list's largest component; those that join it need not meet the rest of it. Then a pair of different components includes a member outside the list's
largest one: only those are paired with the list. So links of a group
of copies cost a few pairs a member, and no link that could join two components is left out.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from kgspark.session import Scratch, materialise, workers_import_this

K, THRESHOLD = 5, 80
#: Orders beside the first, and elements of a carried prefix are 32-bit hashes (equal shingles have equal ones).
ORDERS = 2
#: Bits of a parity bitmap, at least and at most: the power of two from the set's size on.
LEAST_BITS, MOST_BITS = 64, 2048
#: Bits of those that members of long lists carry with each part.
LATE_BITS = 1024
WORDS = [f"f{i}" for i in range(LATE_BITS // 64)]
#: Shingles that the first order ranks by their number of documents, at most: the most held ones.
COMMON_KEPT = 200_000
#: Shingles that a task counts before it puts equal ones together, and those that it goes on with, at most (a few MB, as every worker holds them).
COUNTED, GOES_ON = 400_000, 200_000
#: Rows of ids that are sent to all tasks, at most.
BROADCAST_ROWS = 2_000_000
#: Rows of parts that a task gives at once, at most.
ROWS_AT_ONCE = 50_000
#: Pivots of a long list, and how many of them a member is verified with.
PIVOTS, CLOSEST = 8, 3
#: A list of so many members, or fewer, has all its pairs tried.
SMALL = 32
#: Bytes of text hashed at once; a longer word is taken whole.
CHUNK = 1 << 20

_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xFF51AFD7ED558CCD)
_BASE = 0xD6E8FEB86659FD93  # odd: it has an inverse modulo 2 ** 64
_SPACE = re.compile(rb"[\x20\x09-\x0D]")


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _M3
    return h ^ (h >> np.uint64(29))


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit value for each byte, A-Z as a-z, and whether the byte is ASCII white space."""
    value = mixed(np.arange(1, 257, dtype=np.uint64) * _M1)
    value[65:91] = value[97:123]
    blank = np.zeros(256, np.int8)
    blank[[32, 9, 10, 11, 12, 13]] = 1
    return value, blank


_VALUE, _BLANK = _tables()
_powers: list[np.ndarray] = []


def byte_powers(n: int) -> list[np.ndarray]:
    """Powers of the base and of its inverse, n of each at least."""
    if not _powers or len(_powers[0]) < n:
        n = max(n, 1 << 16)
        _powers[:] = [np.multiply.accumulate(np.r_[np.uint64(1), np.full(n, b, np.uint64)]) for b in (_BASE, pow(_BASE, -1, 2**64))]
    return _powers


def _hashed(raw: bytes) -> np.ndarray:
    b = np.frombuffer(raw, np.uint8)
    up, down = byte_powers(len(b) + 1)
    total = np.zeros(len(b) + 1, np.uint64)
    np.cumsum(_VALUE[b] * up[: len(b)], out=total[1:])
    turns = np.flatnonzero(np.diff(np.r_[np.int8(1), _BLANK[b], np.int8(1)]))
    start, end = turns[::2], turns[1::2]
    return mixed((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64) * _M2)


def word_hashes(text: str | None) -> np.ndarray:
    """64-bit hashes of the words, parted by ASCII white space, with A-Z in lower case: polynomials of their UTF-8 bytes."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    if len(raw) <= CHUNK:
        return _hashed(raw)
    parts, at = [], 0
    while at < len(raw):
        stop = _SPACE.search(raw, at + CHUNK)
        end = stop.end() if stop else len(raw)
        parts.append(_hashed(raw[at:end]))
        at = end
    return np.concatenate(parts)


def shingle_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the k-word runs, in text order; a shorter text is one run; no words, none."""
    if not len(h):
        return h
    if len(h) < k:
        k = len(h)
    n = len(h) - k + 1
    out = np.full(n, k * int(_M2) % 2**64, np.uint64)
    for i in range(k):
        out = mixed(out * _M1 + h[i : i + n])
    return out


def distinct(x: np.ndarray) -> np.ndarray:
    """Sorted, each once (np.unique goes through a hash table, which is slower here)."""
    x = np.sort(x)
    return x[np.r_[True, x[1:] != x[:-1]]] if len(x) else x


def set_of(text: str | None, k: int) -> np.ndarray:
    """Sorted 63-bit hashes of a text's shingles, each once."""
    return distinct(shingle_hashes(word_hashes(text), k) >> np.uint64(1))


def prefix_size(n: int, percent: int) -> int:
    """Elements of which one is shared, if the similarity reaches the threshold: n - ceil(n * percent / 100) + 1."""
    return n - -(-n * percent // 100) + 1


def prefix(s: np.ndarray, percent: int, common: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The set's first shingles in the first order: those not in the table by hash, then the others by their rank."""
    p = prefix_size(len(s), percent)
    table, ranks = common
    if not len(table):
        return s[:p]
    at = np.minimum(np.searchsorted(table, s), len(table) - 1)
    often = table[at] == s
    rare = s[~often][:p]
    if len(rare) == p:
        return rare
    late = np.argsort(ranks[at[often]])[: p - len(rare)]
    return np.concatenate([rare, s[often][late]])


def further(s: np.ndarray, percent: int, orders: int = ORDERS) -> list[np.ndarray]:
    """Prefixes in the further orders, sorted, 32 bits an element."""
    p = prefix_size(len(s), percent)
    out = []
    for k in range(orders):
        x = mixed(s * _M2 + np.uint64(k + 1))
        out.append(np.sort((np.partition(x, p - 1)[:p] >> np.uint64(32)).astype(np.uint32)))
    return out


def parity(s: np.ndarray, least: int = LEAST_BITS, most: int = MOST_BITS) -> np.ndarray:
    """The parity bitmap, as bytes; a wider one folds onto a narrower one, half on half."""
    bits = min(max(1 << max(len(s) - 1, 0).bit_length(), least), most)
    at = (mixed(s + _M1) & np.uint64(bits - 1)).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=bits) & 1).astype(np.uint8), bitorder="little")


def difference(x: bytes, y: bytes) -> int:
    """Bits in which two bitmaps differ: at most as many as shingles do."""
    a, b = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
    while len(a) > len(b):
        a = a[: len(a) // 2] ^ a[len(a) // 2 :]
    while len(b) > len(a):
        b = b[: len(b) // 2] ^ b[len(b) // 2 :]
    return int(np.bitwise_count(a ^ b).sum())


def meet(x: np.ndarray, y: np.ndarray) -> bool:
    """Whether two sorted arrays have an element in common."""
    at = np.searchsorted(y, x)
    return bool((y[np.minimum(at, len(y) - 1)] == x).any())


def levels(percent: int, most: int = 1 << 40) -> list[int]:
    """Least sizes of levels: sets that link lie in one level or in neighbouring ones."""
    out = [1]
    while out[-1] < most:
        out.append(out[-1] * 100 // percent + 1)
    return out


def by_levels(large: DataFrame, percent: int) -> DataFrame:
    """Long lists (key, id, n) split by levels: key, level, own, id, n, df (members of the key's level).

    A member stands in its own level (own) and in the next, so two that link meet in a level that is one's own at least. Levels that are nobody's own, or of one member, are left out.
    """
    most = large.agg(F.max("n")).first()[0] or 1
    bounds = F.array(*[F.lit(b).cast("long") for b in levels(percent, most + 1)])
    level = F.size(F.filter(bounds, lambda b: b <= F.col("n"))) - 1
    both = large.select("key", "id", "n", F.explode(F.array(F.struct(level.alias("level"), F.lit(True).alias("own")), F.struct((level + 1).alias("level"), F.lit(False).alias("own")))).alias("l"))
    both = both.select("key", "l.level", "l.own", "id", "n")
    held = both.groupBy("key", "level").agg(F.count("*").alias("df"), F.max("own").alias("any")).where("any and df > 1").drop("any")
    return both.join(held, ["key", "level"])


def level_of(n: int, bounds: list[int]) -> int:
    """The level of a set of n shingles."""
    return bisect_right(bounds, n) - 1


def parts_in(level: int, s: np.ndarray, percent: int, first: np.ndarray, bounds: list[int]) -> np.ndarray:
    """Hashes of the set's parts in a level: two sets of the level, or of it and the one below, that link have one in common.

    In a level of sizes up to `most`, linked sets differ in at most 2 * most * (100 - t) / (100 + t) shingles; cut into one part more, they agree in one.
    A part without shingles says little, so it is written once for each shingle of the prefix in the first order, of which they share one.
    """
    most = bounds[level] * 100 // percent
    m = 2 * most * (100 - percent) // (100 + percent) + 1
    seed = mixed(np.array([level + 1], np.uint64) * _M2)[0]
    h = mixed(s * _M3 + seed)
    part = ((h >> np.uint64(32)) % np.uint64(m)).astype(np.int64)
    total = np.zeros(m, np.uint64)
    np.add.at(total, part, mixed(h + _M1))
    name = mixed(np.arange(1, m + 1, dtype=np.uint64) * _M1 + seed)
    held = np.bincount(part, minlength=m) > 0
    return np.concatenate([mixed(total[held] + name[held]), mixed(name[~held][:, None] + mixed(first + _M2)[None, :]).ravel()])


def parts_of(s: np.ndarray, percent: int, first: np.ndarray, bounds: list[int]) -> np.ndarray:
    """Parts in the set's own level, then those in the next: two sets that link have one in common, which is in the own level of one at least."""
    i = level_of(len(s), bounds)
    return np.concatenate([parts_in(level, s, percent, first, bounds) for level in (i, i + 1)])


def _merged(parts: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Equal hashes once, with the sum of their counts."""
    x, c = np.concatenate(parts), np.concatenate(counts)
    o = np.argsort(x)
    x, c = x[o], c[o]
    first = np.flatnonzero(np.r_[True, x[1:] != x[:-1]]) if len(x) else np.zeros(0, np.int64)
    return x[first], np.add.reduceat(c, first) if len(x) else c


def common_shingles(docs: DataFrame, k: int, s: Scratch, kept: int = COMMON_KEPT) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of the shingles that most documents hold, and their ranks by number of documents.

    Counted are shingles that two documents of a task hold. Any such table makes a valid order: only the
    cost depends on it, so its size is bounded. Shingles held equally often are all in it or none.
    """
    workers_import_this(docs.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        size, parts, counts = 0, [np.zeros(0, np.uint64)], [np.zeros(0, np.int32)]
        for b in batches:
            for text in b["text"]:
                x = set_of(text, k)
                parts.append(x)
                counts.append(np.ones(len(x), np.int32))
                size += len(x)
                if size > COUNTED:  # bounded: what one document holds so far goes, then what two do, and so on
                    x, c = _merged(parts, counts)
                    least = 1
                    while (c >= least).sum() > GOES_ON:
                        least += 1
                    parts, counts, size = [x[c >= least]], [c[c >= least]], 0
        x, c = _merged(parts, counts)
        yield pd.DataFrame({"shingle": x[c > 1].view(np.int64), "held": c[c > 1].astype(np.int64)})

    rows = docs.select("text").mapInPandas(run, "shingle long, held long").groupBy("shingle").agg(F.sum("held").alias("held"))
    rows = s.write(rows, "common")
    level = F.least("held", F.lit(100_000))
    left, least = kept, None
    for r in rows.groupBy(level.alias("held")).count().orderBy(F.desc("held")).collect():  # 100 000 rows at most
        left -= r["count"]
        if left < 0:
            break
        least = r["held"]
    top = rows.where(level >= least).toPandas() if least else pd.DataFrame({"shingle": [], "held": []}, dtype="int64")
    s.drop(rows)
    h, held = top["shingle"].to_numpy(np.int64).view(np.uint64), top["held"].to_numpy(np.int64)
    o = np.lexsort((h, -held))
    rank = np.empty(len(h), np.int32)
    rank[o] = np.arange(len(h), 0, -1)
    o = np.argsort(h)
    return h[o], rank[o]


def classes_of(docs: DataFrame, k: int, percent: int, common: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """doc_id, class, n, first (prefix in the first order), bits, others: a row per row of docs; class is null for an empty set."""
    workers_import_this(docs.sparkSession)

    def row(text: str | None) -> tuple:
        s = set_of(text, k)
        if not len(s):
            return None, 0, None, None, None
        others = [x.tobytes() for x in further(s, percent)]
        return xxhash.xxh3_128_digest(s.tobytes()), len(s), prefix(s, percent, common).view(np.int64), parity(s).tobytes(), others

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [row(text) for text in b["text"]]
            kinds = (("class", object), ("n", "int64"), ("first", object), ("bits", object), ("others", object))
            yield pd.DataFrame({"doc_id": b["doc_id"], **{c: pd.Series([r[i] for r in rows], dtype=t) for i, (c, t) in enumerate(kinds)}})

    return docs.mapInPandas(run, "doc_id long, class binary, n long, first array<long>, bits binary, others array<binary>")


def sizes(n1: Column, n2: Column, percent: int) -> Column:
    return (n1 * 100 >= n2 * percent) & (n2 * 100 >= n1 * percent)


def near(n1: Column, n2: Column, differ: Column, percent: int) -> Column:
    """Whether bitmaps allow the threshold: the difference is at most (100 - t) / (100 + t) of the sizes' sum."""
    return differ * (100 + percent) <= (n1 + n2) * (100 - percent)


def of_both(pairs: DataFrame, rows: DataFrame, *columns: str) -> DataFrame:
    """pairs (a, b, ...) with columns of rows (doc_id, ...) for both sides: a_<column>, b_<column>."""
    for c in ("a", "b"):
        pairs = pairs.join(rows.select(F.col("doc_id").alias(c), *[F.col(x).alias(f"{c}_{x}") for x in columns]), c)
    return pairs


def by_bitmaps(pairs: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b, pivot) whose sizes and bitmaps allow the threshold, with their bitmaps' difference."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            differ = np.array([difference(x, y) for x, y in zip(b["a_bits"], b["b_bits"])], np.int64)
            n1, n2 = b["a_n"].to_numpy(np.int64), b["b_n"].to_numpy(np.int64)
            stay = (n1 * 100 >= n2 * percent) & (n2 * 100 >= n1 * percent) & (differ * (100 + percent) <= (n1 + n2) * (100 - percent))
            yield b.loc[stay, ["a", "b", "pivot"]].assign(differ=differ[stay])

    return of_both(pairs, sketches, "n", "bits").mapInPandas(run, "a long, b long, pivot int, differ long")


def by_orders(pairs: DataFrame, sketches: DataFrame) -> DataFrame:
    """Pairs (a, b) that share an element of their prefixes in each of the further orders."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            stay = [all(meet(np.frombuffer(p, np.uint32), np.frombuffer(q, np.uint32)) for p, q in zip(x, y)) for x, y in zip(b["a_others"], b["b_others"])]
            yield b.loc[np.array(stay, bool), ["a", "b"]]

    ids = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    return of_both(pairs, sketches.join(ids, "doc_id", "left_semi"), "others").mapInPandas(run, "a long, b long").distinct()


def small_side(ids: DataFrame) -> DataFrame:
    """Written rows of a few numbers, sent to all tasks if there are BROADCAST_ROWS at most; else the planner joins them as any table."""
    return F.broadcast(ids) if ids.count() <= BROADCAST_ROWS else ids


def verified(pairs: DataFrame, docs: DataFrame, k: int, percent: int, s: Scratch) -> DataFrame:
    """pairs (a, b: ids of representatives) whose sets' similarity reaches the threshold, by their whole texts."""
    ids = s.write(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), "ids")
    texts = s.write(docs.join(small_side(ids), "doc_id", "left_semi"), "texts")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last: tuple[str | None, np.ndarray] = (None, np.zeros(0, np.uint64))
        for batch in batches:
            ok = []
            for ta, tb in zip(batch["a_text"], batch["b_text"]):
                if last[0] != tb:
                    last = (tb, set_of(tb, k))
                x, y = set_of(ta, k), last[1]
                both = len(x) + len(y) - len(distinct(np.concatenate([x, y])))
                ok.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch.loc[np.array(ok, bool), ["a", "b"]]

    out = s.write(of_both(pairs, texts, "text").mapInPandas(run, "a long, b long").distinct(), "links")
    s.drop(texts)
    return out


def _stars(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A task's edges as stars: each node with the least node its own edges reach."""
    up: dict[int, int] = {}

    def root(x: int) -> int:
        while (y := up.setdefault(x, x)) != x:
            up[x] = up[y]
            x = up[x]
        return x

    for b in batches:
        for u, v in zip(b["u"].tolist(), b["v"].tolist()):
            u, v = root(u), root(v)
            if u != v:
                up[max(u, v)] = min(u, v)
    got = [(x, root(x)) for x in up]
    yield pd.DataFrame([g for g in got if g[0] != g[1]], columns=["u", "v"], dtype="int64")


def components(edges: DataFrame, s: Scratch, rounds: int = 40) -> DataFrame:
    """node, root (the least node reachable) for every node of edges (a, b), by alternating large and small stars.

    Tasks contract their own edges first. Each round is a few aggregates and joins with equal keys; the edges are written between rounds.
    """
    workers_import_this(edges.sparkSession)
    e = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").mapInPandas(_stars, "u long, v long")
    e, seen = s.write(e.distinct(), "cc"), None
    for _ in range(rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        low2 = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low2, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        e, before = s.write(small.where("u <> v").distinct(), "cc"), e
        s.drop(before)
        # settled: every edge leads to a root, and each node has one
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError("components did not settle")
    return e.groupBy("u").agg(F.min("v").alias("root")).withColumnRenamed("u", "node")


def link(docs: DataFrame, k: int = K, percent: int = THRESHOLD, small: int = SMALL) -> DataFrame:
    """doc_id, n_shingles, component_id (the least doc_id reachable by links): a row per row of docs.

    Two documents link when 100 * intersection >= percent * union of their
    sets. Null, empty and blank texts have no shingles and no links. A text of fewer than k words is one
    shingle. Equal texts are one class; rows with one doc_id are joined by it. Other columns are ignored.
    A row whose doc_id is null links as any other, with no row but by its text; a component of such rows only has a null component_id.
    """
    docs, least = numbered(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")))
    out = linked(docs.drop("doc_id").withColumnRenamed("kg_id", "doc_id"), k, percent, small)
    if least is None:
        return out
    real = lambda c: F.when(F.col(c) < least, F.col(c)).alias(c)
    return out.select(real("doc_id"), "n_shingles", real("component_id"))


def numbered(docs: DataFrame) -> tuple[DataFrame, int | None]:
    """docs with kg_id: the doc_id, or for a null one a number of its own above all ids; and the least of these numbers, None if no id is null."""
    key = F.col("doc_id").cast("long")
    top, nulls = docs.select(F.max(key), F.count_if(F.col("doc_id").isNull())).first()
    if not nulls:
        return docs.withColumn("kg_id", key), None
    least = max(top or 0, 0) + 1
    # written, so that a row keeps its number
    own = F.lit(least).cast("long") + F.monotonically_increasing_id()
    return materialise(docs.withColumn("kg_id", F.coalesce(key, own)), "numbered"), least


def late_parts(rooted: DataFrame, docs: DataFrame, k: int, percent: int, common: tuple[np.ndarray, np.ndarray], s: Scratch) -> tuple[DataFrame, DataFrame]:
    """Parts (part, own, id, root) of the members of long lists (key, id, root) in several components, and those members' sets (id, n, bits as f0, f1, ...).

    own says that the part is of the set's own level, and not of the next.
    """
    several = rooted.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi")
    ids = s.write(rooted.join(several, "key", "left_semi").select(F.col("id").alias("doc_id"), "root").distinct(), "ids")
    texts = s.write(docs.join(small_side(ids), "doc_id"), "texts")
    bounds = levels(percent)

    def parts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for t, doc, root in zip(b["text"], b["doc_id"], b["root"]):  # a long text has many parts
                x = set_of(t, k)
                if not len(x):
                    continue
                first, i = prefix(x, percent, common), level_of(len(x), bounds)
                for level in (i, i + 1):
                    got = parts_in(level, x, percent, first, bounds)
                    for at in range(0, len(got), ROWS_AT_ONCE):
                        some = got[at : at + ROWS_AT_ONCE].view(np.int64)
                        yield pd.DataFrame({"part": some, "own": level == i, "id": np.full(len(some), doc, np.int64), "root": np.full(len(some), root, np.int64)})

    def flips(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            sets = [set_of(t, k) for t in b["text"]]
            bits = np.stack([np.zeros(len(WORDS), "<i8"), *[parity(x, LATE_BITS, LATE_BITS).view("<i8") for x in sets]])[1:]
            yield pd.DataFrame({"id": b["doc_id"], "n": np.array([len(x) for x in sets], np.int64), **{w: bits[:, i] for i, w in enumerate(WORDS)}})

    rows = s.write(texts.mapInPandas(parts, "part long, own boolean, id long, root long"), "parts")
    sets = s.write(texts.mapInPandas(flips, "id long, n long, " + ", ".join(f"{w} long" for w in WORDS)), "sets")
    s.drop(texts)
    return rows, sets


def still_split(rows: DataFrame, s: Scratch) -> DataFrame:
    """Rows of the parts that stand in several components. As components only grow, a part that does not will not later."""
    split = rows.groupBy("part").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi")
    out = s.write(rows.join(split, "part", "left_semi"), "kept")
    s.drop(rows)
    return out


def late_pairs(kept: DataFrame, sets: DataFrame, percent: int, s: Scratch, pivots: int = 0) -> DataFrame:
    """Pairs (a, b) of different components that may link, from late_parts()' rows of split parts: each is of one part, own to one of both.

    With pivots, members outside a part's largest component meet so many members of that one. Without, each pair of different
    components comes: with the part's largest one from outside it, else from the greater id.
    """
    held = kept.groupBy("part", "root").agg(F.count("*").alias("c")).groupBy("part").agg(F.max(F.struct("c", "root")).alias("m"))
    marked = s.write(kept.join(held.select("part", F.col("m.root").alias("main")), "part"), "marked")
    outside = marked.where("root <> main")
    if pivots:
        chosen = [F.min(F.struct(F.xxhash64("id", F.lit(r)).alias("h"), "id", "own", "root")) for r in range(pivots)]
        inside = marked.where("root = main").groupBy("part").agg(F.array(*chosen).alias("ps")).select("part", F.explode("ps").alias("p"))
        inside = inside.select("part", "p.own", "p.id", "p.root", F.col("p.root").alias("main")).distinct()
    else:
        inside = marked
    x, y = outside.join(sets, "id").alias("x"), inside.join(sets, "id").alias("y")
    test = (F.col("x.part") == F.col("y.part")) & (F.col("x.root") != F.col("y.root")) & (F.col("x.own") | F.col("y.own"))
    test = test & ((F.col("y.root") == F.col("y.main")) | (F.col("x.id") > F.col("y.id")))
    differ = sum((F.bit_count(F.col(f"x.{w}").bitwiseXOR(F.col(f"y.{w}"))) for w in WORDS), F.lit(0))
    test = test & sizes(F.col("x.n"), F.col("y.n"), percent) & near(F.col("x.n"), F.col("y.n"), differ, percent)
    # a member's pivots stay with it as a; other pairs are put in one order
    a, b = (F.col("x.id"), F.col("y.id")) if pivots else (F.greatest("x.id", "y.id"), F.least("x.id", "y.id"))
    out = s.write(x.join(y, test).select(a.alias("a"), b.alias("b")).distinct(), "late")
    s.drop(marked)
    return out


def linked(docs: DataFrame, k: int, percent: int, small: int) -> DataFrame:
    """link() for documents (doc_id, text) none of whose ids is null. The result is written; all else that was is deleted."""
    with Scratch(docs.sparkSession, "jaccard") as s:
        return materialise(_linked(docs, k, percent, small, s), "linked")


def _linked(docs: DataFrame, k: int, percent: int, small: int, s: Scratch) -> DataFrame:
    common = common_shingles(docs, k, s)
    rows = s.write(classes_of(docs, k, percent, common), "classes")
    members = rows.select("doc_id", "class", "n")
    # the row of each class's least id stands for it; copies meet in partial aggregates
    least = rows.where("class is not null").groupBy("class").agg(F.min(F.struct("doc_id", "n", "first")).alias("m"))
    reps = s.write(least.select("class", F.col("m.doc_id").alias("rep"), "m.n", "m.first"), "reps")
    postings = reps.select(F.col("rep").alias("id"), "n", F.explode("first").alias("key"))
    shared = postings.groupBy("key").agg(F.count("*").alias("df")).where("df > 1")
    lists = s.write(postings.join(shared, "key"), "lists")
    # long lists by levels of sizes: a key that sets of all sizes hold has few of each size
    split = s.write(by_levels(lists.where(F.col("df") > small), percent), "levels")
    few = lists.where(F.col("df") <= small).select("key", F.lit(-1).alias("level"), F.lit(True).alias("own"), "id", "n")
    few = few.unionByName(split.where(F.col("df") <= small).drop("df"))
    large = split.where(F.col("df") > small).select(F.struct("key", "level").alias("key"), "id", "n")
    # a short list has few pairs, whatever the corpus size: all of them are candidates whose sizes allow it
    x, y = few.alias("x"), few.alias("y")
    same = (F.col("x.key") == F.col("y.key")) & (F.col("x.level") == F.col("y.level")) & (F.col("x.own") | F.col("y.own"))
    pairs = x.join(y, same & (F.col("x.id") > F.col("y.id")) & sizes(F.col("x.n"), F.col("y.n"), percent))
    pairs = pairs.select(F.col("x.id").alias("a"), F.col("y.id").alias("b"), F.lit(0).alias("pivot"))
    chosen = [F.min(F.struct(F.xxhash64("id", F.lit(r)).alias("h"), "id", "n")) for r in range(PIVOTS)]
    pivots = large.groupBy("key").agg(F.array_distinct(F.transform(F.array(*chosen), lambda p: F.struct(p["id"].alias("id"), p["n"].alias("n")))).alias("ps"))
    paired = large.join(pivots, "key").select("id", "n", F.explode("ps").alias("p")).where((F.col("id") != F.col("p.id")) & sizes(F.col("n"), F.col("p.n"), percent))
    pairs = pairs.unionByName(paired.select(F.col("id").alias("a"), F.col("p.id").alias("b"), F.lit(1).alias("pivot")))
    pairs = pairs.groupBy("a", "b").agg(F.min("pivot").alias("pivot"), F.count("*").alias("c"))
    # of a member's pivots, those that it shares most lists with are looked at
    most = pairs.where("pivot = 1").groupBy("a").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("c")).alias("c"), "b"))), 1, PIVOTS).alias("m"))
    most = most.select("a", F.explode("m.b").alias("b"), F.lit(1).alias("pivot"))
    pairs = s.write(pairs.where("pivot = 0").select("a", "b", "pivot").unionByName(most), "pairs")

    # an id with several texts stands for all of them: rows with one id are one component
    sketches = rows.where("class is not null")

    def tested(pairs: DataFrame) -> DataFrame:
        ids = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
        return s.write(by_bitmaps(pairs, sketches.select("doc_id", "n", "bits").join(ids, "doc_id", "left_semi").distinct(), percent), "candidates")

    found = tested(pairs)
    s.drop(pairs)

    def closest(found: DataFrame) -> DataFrame:
        """Of a member's pivots (as many as its lists or parts have, at most), the closest ones."""
        best = found.groupBy("a").agg(F.slice(F.array_sort(F.collect_set(F.struct("differ", "b"))), 1, CLOSEST).alias("m"))
        return best.select("a", F.explode("m.b").alias("b"))

    def checked(found: DataFrame) -> DataFrame:
        return verified(s.write(by_orders(found.select("a", "b").distinct(), sketches), "tried"), docs, k, percent, s)

    links = checked(found.where("pivot = 0").select("a", "b").unionByName(closest(found.where("pivot = 1"))))
    roots = components(links, s)
    if not large.isEmpty():
        rooted = large.select("key", "id").join(roots, F.col("id") == F.col("node"), "left").select("key", "id", F.coalesce("root", "id").alias("root"))
        parts, sets = late_parts(rooted, docs, k, percent, common, s)
        # members meet a few of the largest component first: those that join it need not meet all of it
        for pivots in (PIVOTS, 0):
            parts = still_split(parts, s)
            found = tested(late_pairs(parts, sets, percent, s, pivots).withColumn("pivot", F.lit(0)))
            more = checked(closest(found) if pivots else found)
            if more.isEmpty():
                continue
            stars = roots.select(F.col("node").alias("a"), F.col("root").alias("b"))
            roots = components(stars.unionByName(more), s)
            if pivots:
                now = roots.select("node", F.col("root").alias("now"))
                before, parts = parts, s.write(parts.join(now, F.col("root") == F.col("node"), "left").select("part", "own", "id", F.coalesce("now", "root").alias("root")), "parts")
                s.drop(before)

    # back to the rows: ids of one class, and classes of one id, belong together
    whole = reps.select("class", "rep").join(roots, F.col("rep") == F.col("node"), "left").select("class", F.coalesce("root", "rep").alias("root"))
    out = members.join(whole, "class", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("root", "doc_id").alias("component_id"))
    # a row whose id also stands under another class: both classes are one component
    of = F.coalesce("class", F.lit(b""))
    if members.groupBy("doc_id").agg(F.min(of).alias("lo"), F.max(of).alias("hi")).where("lo < hi").isEmpty():
        return out
    split = out.groupBy("doc_id").agg(F.min("component_id").alias("lo"), F.max("component_id").alias("hi")).where("lo < hi")
    split = s.write(split, "split")
    if split.isEmpty():
        return out
    cc = components(split.select(F.col("lo").alias("a"), F.col("hi").alias("b")).unionByName(out.join(split.select("doc_id", "lo"), "doc_id").select(F.col("component_id").alias("a"), F.col("lo").alias("b"))), s)
    return out.join(cc, F.col("component_id") == F.col("node"), "left").select("doc_id", "n_shingles", F.coalesce("root", "component_id").alias("component_id"))


def keep_one(docs: DataFrame, k: int = K, percent: int = THRESHOLD) -> DataFrame:
    """One document of each group of links stays, the one with the least id; columns stay as they are."""
    rows, _ = numbered(docs)
    groups = linked(rows.select(F.col("kg_id").alias("doc_id"), F.col("text").cast("string").alias("text")), k, percent, SMALL)
    stay = groups.where("doc_id = component_id").select(F.col("doc_id").alias("kg_id")).distinct()
    kept = rows.join(stay, "kg_id", "left_semi")
    # rows that repeat an id are copies or one component: one of them stays
    kept = kept.dropDuplicates(["kg_id"]) if _repeats(rows) else kept
    return kept.select(*docs.columns)


def _repeats(docs: DataFrame) -> bool:
    return not docs.groupBy("kg_id").agg(F.count("*").alias("n")).where("n > 1").isEmpty()
