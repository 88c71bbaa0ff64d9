"""Benchmark decontamination: a BM25 index of test items, queried with every training passage by block-max WAND.

The index is built from the benchmark table and has postings in blocks of
items, with each term's largest score in each block. Items are taken in shards
of bounded size, so what tasks are sent stays bounded however large the
benchmark grows; the documents are read once for each shard. Within a shard, items of like length make an
index of their own, whose passages are as long as such items need: what is found for an item
depends on the item alone, not on the shard or the items beside it. Scores are
divided by the item's score against itself, so one threshold serves all items.
For a passage the terms' upper bounds are summed over all blocks first, then
within each block, and only blocks whose bound reaches the threshold are scored
in full. Every pair above the threshold is verified by the overlap of the
item's question and answer with the passage.
"""

from __future__ import annotations

import itertools
import math
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, functions as F

from kgspark.session import exact_ids, plain, unused, workers_import_this

K1, B = 1.2, 0.75
#: Words a passage holds, at least; items of over half as many get passages twice, four times, ... as long, so that twice their length fits. Passages overlap by half.
PASSAGE = 64
#: Items in a block of postings, and characters of items in a shard, at most.
BLOCK, SHARD_CHARS = 16, 4_000_000
#: Entries of an index's table of block maxima (terms by blocks), at most.
TABLE = 8_000_000
#: Share of an item's own score that a passage must reach, or less where a passage could pass the verification below with less (see least_score).
RETRIEVE = 0.65
#: Shares of the question's and the answer's shingles that a passage must hold.
QUESTION, ANSWER = 0.8, 0.8
SHINGLE = 5

_WORD = re.compile(r"\w+")


def words(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def parts(text: str) -> tuple[list[str], list[str]]:
    """Question and answer of an item: its last sentence or line is the answer. One sentence alone is both."""
    cut = [m.end() for m in re.finditer(r"[.?!]\s+|\n+", text.strip())]
    for at in reversed(cut):
        q, a = words(text.strip()[:at]), words(text.strip()[at:])
        if q and a:
            return q, a
    w = words(text)
    return w, w


def shingles(w: list[str], k: int = SHINGLE) -> set[tuple[str, ...]]:
    """k-word runs; a shorter sequence counts as one run."""
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def holds(passage: str, part: tuple[str, ...] | list[str], k: int = SHINGLE) -> float:
    """Share of a part's shingles that stand in a passage (words joined and bordered by spaces)."""
    runs = shingles(list(part), k)
    return sum(f" {' '.join(r)} " in passage for r in runs) / len(runs) if runs else 0.0


def most_lost(weights: list[float], missing: int, k: int = SHINGLE) -> float:
    """Weight of a part's words that a passage can lack, at most, while it lacks `missing` of the part's k-word runs.

    A word is lacking only where all runs over it are: r runs missing in a row lose r words at an end of the part, r - k + 1 inside it.
    """
    if missing <= 0:
        return 0.0
    n = len(weights)
    if missing > n - k:
        return sum(weights)  # no run is there
    front, back, best = ([0.0, *itertools.accumulate(w)] for w in (weights, weights[::-1], sorted(weights, reverse=True)))
    at = lambda sums, j: sums[min(j, n)]
    return max(at(front, a) + at(back, b) + at(best, max(0, missing - a - b - k + 1)) for a in range(missing + 1) for b in range(missing - a + 1))


def least_score(q: list[str], a: list[str], weight: dict[str, float], own: float) -> float:
    """Share of an item's own score that any passage holding QUESTION and ANSWER of its parts has, at least."""
    lost = 0.0
    for part, share in ((q, QUESTION), (a, ANSWER)):
        runs: dict[tuple[str, ...], int] = {}
        for i in range(max(1, len(part) - SHINGLE + 1)):
            run = tuple(part[i : i + SHINGLE])
            runs[run] = runs.get(run, 0) + 1
        missing = math.floor(len(runs) * (1 - share) + 1e-9)
        lost += most_lost([weight[x] for x in part], sum(sorted(runs.values(), reverse=True)[:missing]))
    return max(0.02, 1 - lost / own)


@dataclass
class Index:
    """Postings of items of like length. Terms are numbers; items are numbers within the index."""

    items: list
    terms: dict[str, int]
    local: np.ndarray  # the shard's numbers of terms as this index's, -1 for those it lacks
    weight: np.ndarray  # posting scores (for a term that occurs once in a passage), divided by the item's own score and multiplied by its scale
    item: np.ndarray
    start: np.ndarray  # per term, into the postings
    top: np.ndarray  # per term
    block_top: np.ndarray  # per term and block
    own: np.ndarray
    scale: np.ndarray  # 1, or more where less than RETRIEVE of an item's own score has to be enough
    length: np.ndarray
    question: list[tuple[str, ...]]
    answer: list[tuple[str, ...]]
    span: int


def span_of(length: int) -> int:
    """Words of the passages in which an item of so many words is looked for."""
    span = PASSAGE
    while span < 2 * length:
        span *= 2
    return span


def build(items: list[tuple], df: dict[str, int], n: int, mean: float) -> list[Index]:
    """Indexes of a shard's items (id, text), each with at least one word. df, n, mean: over the whole benchmark, so shards don't change scores."""
    items = sorted(items, key=lambda i: (len(words(i[1])), i))  # items of like length have like weights: block maxima are tighter
    shard: dict[str, int] = {}
    groups: dict[int, list[tuple]] = {}
    for i in items:
        w = words(i[1])
        groups.setdefault(span_of(len(w)), []).append(i)
        for x in w:
            shard.setdefault(x, len(shard))
    out: list[Index] = []
    todo = list(groups.values())
    while todo:
        group = todo.pop()
        vocabulary = {x for _, t in group for x in words(t)}
        if len(group) > BLOCK and len(vocabulary) * -(-len(group) // BLOCK) > TABLE:
            todo += [group[: len(group) // 2], group[len(group) // 2 :]]
            continue
        ix = _index(group, df, n, mean)
        ix.local = np.full(len(shard) + 1, -1, np.int64)  # the last place is that of words the shard lacks
        for x, k in ix.terms.items():
            ix.local[shard[x]] = k
        ix.terms = shard
        out.append(ix)
    return sorted(out, key=lambda ix: (ix.span, ix.items[0]))


def _index(items: list[tuple], df: dict[str, int], n: int, mean: float) -> Index:
    terms: dict[str, int] = {}
    post: dict[int, list[tuple[int, float]]] = {}
    own, scale, length, question, answer = [], [], [], [], []
    for i, (_, text) in enumerate(items):
        w = words(text)
        q, a = parts(text)
        question.append(tuple(q))
        answer.append(tuple(a))
        length.append(len(w))
        total = 0.0
        tf: dict[str, int] = {}
        for x in w:
            tf[x] = tf.get(x, 0) + 1
        scores: dict[str, float] = {}
        norm = K1 * (1 - B + B * len(w) / mean)
        for x, f in tf.items():
            s = np.log(1 + (n - df[x] + 0.5) / (df[x] + 0.5)) * f * (K1 + 1) / (f + norm)
            total += s
            scores[x] = s
        scale.append(max(1.0, RETRIEVE / (least_score(q, a, scores, total) - 1e-9)))
        for x, s in scores.items():
            post.setdefault(terms.setdefault(x, len(terms)), []).append((i, s * scale[-1]))
        own.append(total)
    blocks = -(-len(items) // BLOCK)
    start = np.zeros(len(terms) + 1, np.int64)
    item, weight = [], []
    block_top = np.zeros((len(terms), blocks), np.float32)
    for t in range(len(terms)):
        for i, s in post[t]:
            item.append(i)
            weight.append(s / own[i])
            block_top[t, i // BLOCK] = max(block_top[t, i // BLOCK], s / own[i] * (1 + 1e-6))
        start[t + 1] = len(item)
    span = span_of(max(length))
    return Index([i for i, _ in items], terms, np.zeros(0, np.int64), np.array(weight), np.array(item, np.int64), start, block_top.max(1), block_top, np.array(own), np.array(scale), np.array(length), question, answer, span)


def passages(n: int, span: int) -> np.ndarray:
    """First words of the passages of a text of n words: half a passage apart, so any item of up to half a passage is whole in one."""
    step = span // 2
    return np.arange(0, max(1, n - step), step) if n else np.zeros(0, np.int64)


def wand(ids: np.ndarray, ix: Index, threshold: float = RETRIEVE) -> list[tuple[int, int, float]]:
    """(item, passage, score times the item's scale) for every pair of a text's passage and an item at or above the threshold.

    ids: the text's words as the index's terms, -1 for others. A term counts
    once a passage. Bounds are summed for half passages, each term once in
    each; those of two neighbours bound the passage they make up.
    """
    n_passages = len(passages(len(ids), ix.span))
    if not n_passages:
        return []
    step, width = ix.span // 2, len(ix.top)
    at = np.flatnonzero(ids >= 0)
    key = np.unique(at // step * width + ids[at])  # (half passage, term)
    half, term = np.divmod(key, width)
    total = np.bincount(half, ix.top[term], n_passages + 1)
    if (total[:-1] + total[1:]).max(initial=0) < threshold - 1e-4:
        return []
    cut = np.searchsorted(half, np.arange(n_passages + 2))
    blocks = np.zeros((n_passages + 1, ix.block_top.shape[1]))
    some = np.flatnonzero(cut[1:] > cut[:-1])
    blocks[some] = np.add.reduceat(ix.block_top[term], cut[some], axis=0) if len(some) else 0
    out = []
    bound = blocks[:-1] + blocks[1:] >= threshold - 1e-4
    for p in np.flatnonzero(bound.any(1)):
        t = np.unique(term[cut[p] : cut[p + 2]])
        live = np.flatnonzero(bound[p] & (ix.block_top[t].sum(0) >= threshold - 1e-4))
        if not len(live):
            continue
        first, stop = ix.start[t], ix.start[t + 1]
        sizes = stop - first
        post = np.repeat(first - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(sizes.sum())
        alive = np.zeros(ix.block_top.shape[1], bool)
        alive[live] = True
        post = post[alive[ix.item[post] // BLOCK]]  # postings of the other blocks are left out
        score = np.bincount(ix.item[post], ix.weight[post], len(ix.items))
        out += [(int(i), int(p), float(score[i])) for i in np.flatnonzero(score >= threshold - 1e-9)]
    return out


def find(text: str | None, indexes: list[Index], threshold: float = RETRIEVE) -> list[tuple]:
    """(item id, first word, words, score, question overlap, answer overlap) of verified items, each at its best passage (the first one of several)."""
    low = (text or "").lower()
    w = _WORD.findall(low)
    out = []
    get = indexes[0].terms.get
    shard = np.fromiter(map(get, w, repeat(-1)), np.int64, len(w))
    if not (shard >= 0).any():
        return out
    for ix in indexes:
        best: dict[int, tuple] = {}
        for i, p, score in wand(ix.local[shard], ix, threshold):
            at, score = int(passages(len(w), ix.span)[p]), round(score / ix.scale[i], 9)  # sums in any order
            held = f" {' '.join(w[at : at + ix.span])} "
            q, a = holds(held, ix.question[i]), holds(held, ix.answer[i])
            if q >= QUESTION and a >= ANSWER and (i not in best or (q + a, score) > (best[i][4] + best[i][5], best[i][3])):
                best[i] = (ix.items[i], at, min(ix.span, len(w) - at), score, q, a)
        out += [best[i] for i in sorted(best)]
    return out


def shards(benchmark: DataFrame, chars_of_shard: int = SHARD_CHARS) -> tuple[list[DataFrame], DataFrame]:
    """The benchmark in shards of at most chars_of_shard characters (by a hash of the item), and its rows with a word."""
    rows = benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string")).where(F.col("text").rlike(r"(?U)[\w\p{N}]")).dropDuplicates()
    chars = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    n = -(-2 * chars // chars_of_shard)  # twice as many as would do, for uneven hashes
    return ([rows] if n <= 1 else [rows.where(F.pmod(F.xxhash64("item_id"), F.lit(n)) == k) for k in range(n)]) if chars else [], rows


def indexes(benchmark: DataFrame, chars_of_shard: int = SHARD_CHARS) -> Iterator[list[Index]]:
    """The indexes of each shard; the size of what is collected for one was counted first."""
    some, rows = shards(benchmark, chars_of_shard)
    if not some:
        return
    token = F.regexp_extract_all(F.lower("text"), F.lit(r"(?U)(\w+)"), F.lit(1))
    n, mean = rows.agg(F.count("*"), F.avg(F.size(token))).first()
    for shard in some:
        items = [(r["item_id"], r["text"]) for r in shard.orderBy("item_id", "text").collect()]
        df: dict[str, int] = {}
        if len(some) == 1:
            for _, t in items:
                for x in set(words(t)):
                    df[x] = df.get(x, 0) + 1
        else:
            vocabulary = {x for _, t in items for x in words(t)}
            spark = benchmark.sparkSession
            own = spark.createDataFrame([(x,) for x in sorted(vocabulary)], "w string")  # of the shard's size
            counted = rows.select(F.explode(F.array_distinct(token)).alias("w")).groupBy("w").count().join(F.broadcast(own), "w", "left_semi")
            df = dict.fromkeys(vocabulary, 1) | {r["w"]: r["count"] for r in counted.collect()}  # the shard's words only
        if items:
            yield build(items, df, n, max(float(mean), 1.0))


FOUND = "item_id long, first_word long, n_words long, score double, question_overlap double, answer_overlap double"


def _counter(sent: Broadcast) -> Callable[[Column], Column]:
    @F.pandas_udf("int")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([len(find(t if isinstance(t, str) else None, sent.value)) for t in texts], dtype="int32")

    return count


def leaks(docs: DataFrame, benchmark: DataFrame, keep: str | None = None, chars_of_shard: int = SHARD_CHARS) -> DataFrame:
    """One row per document and item it holds: doc_id and FOUND.

    keep: instead, all rows of docs with all their columns, and a number of items found in a column of this name, which docs must lack.
    Null and empty texts and items hold nothing; an item id with two texts counts as two items.
    """
    spark = docs.sparkSession
    workers_import_this(spark)
    names = [c.split()[0] for c in FOUND.split(", ")]
    out = docs.withColumn(keep, F.lit(0)) if keep else None
    for ix in indexes(benchmark, chars_of_shard):
        sent = spark.sparkContext.broadcast(ix)  # of bounded size: a shard

        if keep:
            out = out.withColumn(keep, F.col(keep) + _counter(sent)(F.col("text").cast("string")))  # other columns stay out of Python
            continue

        def run(batches: Iterator[pd.DataFrame], sent=sent) -> Iterator[pd.DataFrame]:
            for b in map(plain, batches):
                rows = [(d, *x) for d, t in zip(b["doc_id"], b["text"]) for x in find(t, sent.value)]
                yield pd.DataFrame(rows, columns=["doc_id", *names])

        part = exact_ids(docs.select(F.col("doc_id").cast("long").cast("string"), F.col("text").cast("string")).mapInPandas(run, f"doc_id string, {FOUND}"))
        out = part if out is None else out.unionByName(part)
    return spark.createDataFrame([], f"doc_id long, {FOUND}") if out is None else out


def keep_clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that hold no benchmark item, with their columns, whatever their names. Null and empty texts stay, and so do repeated rows."""
    name = unused("kg_leaks", docs)
    return leaks(docs, benchmark, keep=name).where(F.col(name) == 0).select(*[F.col(f"`{c}`") for c in docs.columns])
