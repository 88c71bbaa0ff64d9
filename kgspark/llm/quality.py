"""Quality scores: random-indexing word vectors pooled per document, and a two-layer network with calibrated output.

Units are whole words in lower case, each after a mark of its case if it has
capitals, digit runs by their length, and runs of other signs. Units are hashed
to a fixed number of slots. One pass over all documents gives each slot its
vector: the sum of the random index vectors of the units beside it. Every
quantity sent to the driver has a fixed size: the slots' vectors, and features
of a bounded sample of labelled rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from kgspark.llm.jaccard import byte_powers, mixed
from kgspark.session import plain, unused, workers_import_this

#: Slots for units, dimensions of their vectors, and non-zero entries of an index vector.
SLOTS, DIM, SPARSE = 32768, 32, 6
#: Labelled rows that are fitted, at most (those with the least hash of their id).
TRAIN_ROWS = 20_000
#: Figures of a pooled document.
WIDTH = 3 * DIM + 8
HIDDEN, EPOCHS, DECAY, THRESHOLD = 32, 60, 1e-4, 0.3
#: Bytes of text, and pairs of neighbours, looked at at once.
CHUNK, PAIRS = 1 << 20, 1 << 17

#: Kinds of bytes: white space, letter, digit, other sign, and lead byte of a script written without spaces.
BLANK, LETTER, DIGIT, SIGN, ALONE = range(5)
_WHITE = re.compile(rb"[\x20\x09-\x0D]")


def _kinds() -> np.ndarray:
    kind = np.full(256, LETTER, np.uint8)  # bytes from 128 on belong to letters
    kind[:128] = SIGN
    kind[list(range(9, 14)) + [32]] = BLANK
    kind[list(range(65, 91)) + list(range(97, 123))] = LETTER
    kind[48:58] = DIGIT
    kind[0xE3:0xEE] = ALONE
    return kind


_KIND = _kinds()
_VALUE = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_LENGTH = np.uint64(0xC2B2AE3D27D4EB4F)


def _slots(raw: bytes) -> np.ndarray:
    if not raw:
        return np.zeros(0, np.int64)
    b = np.frombuffer(raw, np.uint8)
    before = np.r_[np.uint8(32), b[:-1]]
    upper = ((b >= 65) & (b <= 90)) | ((before == 0xC3) & (b >= 0x80) & (b <= 0x9E) & (b != 0x97))
    low = b + upper.astype(np.uint8) * np.uint8(32)
    kind = _KIND[b]
    alone = np.flatnonzero(kind == ALONE)
    for k in (1, 2):  # such a sign has three bytes and is a unit of its own
        kind[np.minimum(alone + k, len(b) - 1)] = ALONE
    edge = np.r_[True, kind[1:] != kind[:-1]]
    edge[alone] = True
    start = np.flatnonzero(edge)
    end = np.r_[start[1:], len(b)]
    some = kind[start] != BLANK
    start, end = start[some], end[some]
    if not len(start):
        return np.zeros(0, np.int64)
    up, down = byte_powers(len(b) + 1)
    total = np.zeros(len(b) + 1, np.uint64)
    np.cumsum(_VALUE[low] * up[: len(b)], out=total[1:])
    of, size = kind[start], end - start
    digits, signs = of == DIGIT, of == SIGN
    end = np.where(signs, np.minimum(end, start + 3), end)
    h = mixed((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64) * _LENGTH)
    h[digits] = mixed(np.minimum(size[digits], 4).astype(np.uint64) + _LENGTH)
    capitals, letters = np.r_[0, np.cumsum(upper)], np.r_[0, np.cumsum((b & 0xC0) != 0x80)]
    n_up, n = capitals[end] - capitals[start], letters[end] - letters[start]
    first = upper[start] | upper[np.minimum(start + 1, len(b) - 1)] & (b[start] == 0xC3)
    case = np.where(n_up == 0, 0, np.where((n_up == n) & (n > 1), 1, np.where(first & (n_up == 1), 2, 3)))
    # hashed from slot 4 on; slots 1 to 3 are the marks
    units = np.stack([case, (h % np.uint64(SLOTS - 4)).astype(np.int64) + 4], 1).ravel()
    return units[np.stack([case > 0, np.ones(len(case), bool)], 1).ravel()]


def slots(text: str | None) -> np.ndarray:
    """The whole text's units as slots."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    if len(raw) <= CHUNK:
        return _slots(raw)
    parts, at = [], 0
    while at < len(raw):
        stop = _WHITE.search(raw, at + CHUNK)
        end = stop.end() if stop else len(raw)
        parts.append(_slots(raw[at:end]))
        at = end
    return np.concatenate(parts)


def index_entries() -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of each slot's index vector's entries, fixed by a seed."""
    rng = np.random.default_rng(7)
    return np.argsort(rng.random((SLOTS, DIM)), axis=1)[:, :SPARSE], rng.choice([-1.0, 1.0], (SLOTS, SPARSE))


def index_vectors() -> np.ndarray:
    at, sign = index_entries()
    out = np.zeros((SLOTS, DIM), np.float32)
    np.put_along_axis(out, at, sign.astype(np.float32), 1)
    return out


def context_vectors(docs: DataFrame) -> np.ndarray:
    """Each slot's vector, of length 1: the sum, over all documents, of the index vectors of the units next to it.

    Tasks add up a table of fixed size; sums of whole numbers don't depend on their order.
    """
    workers_import_this(docs.sparkSession)
    names = [f"c{k}" for k in range(DIM)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, sign = index_entries()
        table, seen = np.zeros(SLOTS * DIM), np.zeros(SLOTS, bool)

        def add(x: np.ndarray, y: np.ndarray) -> None:
            for k in range(0, len(x), PAIRS):
                for u, v in ((x[k : k + PAIRS], y[k : k + PAIRS]), (y[k : k + PAIRS], x[k : k + PAIRS])):
                    table[:] += np.bincount((u[:, None] * DIM + at[v]).ravel(), sign[v].ravel(), SLOTS * DIM)
                    seen[u] = True

        left, n = [], 0
        for b in map(plain, batches):
            for text in b["text"]:
                s = slots(text)
                left.append((s[:-1], s[1:]))
                n += len(s)
                if n >= PAIRS:
                    add(np.concatenate([x for x, _ in left]), np.concatenate([y for _, y in left]))
                    left, n = [], 0
        if left:
            add(np.concatenate([x for x, _ in left]), np.concatenate([y for _, y in left]))
        some = np.flatnonzero(seen)
        if len(some):
            yield pd.DataFrame(table.reshape(SLOTS, DIM)[some].astype(np.int64), columns=names).assign(slot=some.astype(np.int32))[["slot", *names]]

    rows = docs.select(F.col("text").cast("string")).mapInPandas(run, "slot int, " + ", ".join(f"{n} long" for n in names))
    got = rows.groupBy("slot").agg(*[F.sum(n).alias(n) for n in names]).toPandas()  # SLOTS rows at most
    out = np.zeros((SLOTS, DIM), np.float32)
    if len(got):
        out[got["slot"].to_numpy()] = got[names].to_numpy(np.float64)
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return out / np.where(norm, norm, 1)


def pooled(s: np.ndarray, context: np.ndarray, index: np.ndarray) -> np.ndarray:
    """Mean and deviation of the units' vectors, mean of their index vectors, four figures on how many differ, the shares of the three marks, and of units that repeat the one before."""
    if not len(s):
        return np.zeros(WIDTH, np.float32)
    u, n = _counted(s)
    w = (n / len(s)).astype(np.float32)
    c = context[u]
    mean = w @ c
    dev = np.sqrt(np.maximum(w @ (c * c) - mean * mean, 0))
    pairs = len(_counted(s[:-1] * SLOTS + s[1:])[0]) / max(len(s) - 1, 1)
    return np.concatenate([mean, dev, w @ index[u], [np.log1p(len(s)), len(u) / len(s), pairs, w.max()], [(s == k).mean() for k in (1, 2, 3)], [(s[1:] == s[:-1]).mean() if len(s) > 1 else 0]]).astype(np.float32)


def _counted(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values and how often each stands there, by sorting."""
    x = np.sort(x)
    at = np.flatnonzero(np.r_[True, x[1:] != x[:-1]]) if len(x) else np.zeros(0, np.int64)
    return x[at], np.diff(np.r_[at, len(x)])


class Network:
    """Standardised inputs, one hidden layer of tanh, one output, and a temperature."""

    def __init__(self, x: np.ndarray, y: np.ndarray, hidden: int = HIDDEN, epochs: int = EPOCHS, seed: int = 11) -> None:
        rng = np.random.default_rng(seed)
        self.mean, self.dev = x.mean(0), x.std(0) + 1e-3
        order = rng.permutation(len(y))
        held = order[: len(y) // 5]
        fit = order[len(y) // 5 :]
        z = self._scaled(x)
        d = x.shape[1]
        self.p = [rng.normal(0, d**-0.5, (d, hidden)), np.zeros(hidden), rng.normal(0, hidden**-0.5, hidden), np.zeros(1)]
        m, v = [np.zeros_like(a) for a in self.p], [np.zeros_like(a) for a in self.p]
        t = 0
        for _ in range(epochs):
            for part in np.array_split(rng.permutation(fit), max(1, len(fit) // 128)):
                t += 1
                for k, g in enumerate(self._gradient(z[part], y[part])):
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.999 * v[k] + 0.001 * g * g
                    self.p[k] = self.p[k] - 0.003 * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
        self.temperature = 1.0
        if len(held):
            out = self._logit(z[held])
            loss = lambda at: float(np.mean(np.logaddexp(0, -(2 * y[held] - 1) * out / at)))
            self.temperature = float(min(np.geomspace(0.25, 8, 61), key=loss))

    def _scaled(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.dev, -6, 6)

    def _logit(self, z: np.ndarray) -> np.ndarray:
        return np.tanh(z @ self.p[0] + self.p[1]) @ self.p[2] + self.p[3][0]

    def _gradient(self, z: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
        h = np.tanh(z @ self.p[0] + self.p[1])
        e = (1 / (1 + np.exp(-(h @ self.p[2] + self.p[3][0]))) - y) / len(y)
        back = np.outer(e, self.p[2]) * (1 - h * h)
        return [z.T @ back + DECAY * self.p[0], back.sum(0), h.T @ e + DECAY * self.p[2], np.array([e.sum()])]

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self._logit(self._scaled(x)) / self.temperature))


def held_out(doc_id: Column) -> Column:
    """Rows that are never learnt from: crc32 of the id as text is divisible by 5."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def features(docs: DataFrame, context: np.ndarray, keep: str = "") -> DataFrame:
    """doc_id, x (pooled vector), and the columns named in keep ("name type")."""
    workers_import_this(docs.sparkSession)
    names = [c.split()[0] for c in keep.split(", ")] if keep else []

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index = index_vectors()
        for b in map(plain, batches):
            x = [pooled(slots(t), context, index) for t in b["text"]]
            yield pd.DataFrame({"doc_id": b["doc_id"], "x": x, **{n: b[n] for n in names}})

    return docs.select("doc_id", "text", *names).mapInPandas(run, "doc_id long, x array<float>" + (f", {keep}" if keep else ""))


class Model:
    def __init__(self, context: np.ndarray, network: Network | None, constant: float = 1.0) -> None:
        self.context, self.network, self.constant = context, network, constant

    def score(self, x: np.ndarray) -> np.ndarray:
        return self.network.score(x) if self.network else np.full(len(x), self.constant)


def fit(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Model:
    """Word vectors from all documents; the network from at most `rows` labelled ones outside the held-out fold.

    Rows with a null label or text don't teach; of several labels of an id the greatest counts. With one class alone, or no row, the score is the share of label 1 (1 without rows).
    """
    context = context_vectors(docs)
    sample = labels.select(F.col("doc_id").cast("long"), F.col("quality").cast("int")).where(F.col("quality").isin(0, 1) & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    sample = sample.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).where(F.col("text").isNotNull())
    got = features(texts.join(F.broadcast(sample), "doc_id"), context, "quality int").toPandas()  # `rows` is the bound of what is broadcast and collected
    got = got.assign(kg_x=[np.asarray(x, "f4").tobytes() for x in got["x"]]).sort_values(["doc_id", "kg_x"]).drop_duplicates("doc_id")
    y = got["quality"].to_numpy(float)
    if not len(y) or y.min() == y.max():
        return Model(context, None, float(y.mean()) if len(y) else 1.0)
    return Model(context, Network(np.stack(got["x"]).astype(float), y))


def score(docs: DataFrame, model: Model, keep: bool = False) -> DataFrame:
    """doc_id, held_out, score, predicted for every row; keep: with all columns of docs instead of doc_id alone."""
    workers_import_this(docs.sparkSession)

    @F.pandas_udf("double")
    def found(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        index = index_vectors()
        for texts in batches:
            x = np.stack([pooled(slots(t if isinstance(t, str) else None), model.context, index) for t in texts]).astype(float) if len(texts) else np.zeros((0, WIDTH))
            yield pd.Series(model.score(x), dtype="float64")

    value = found(F.col("text").cast("string"))  # other columns stay out of Python
    if keep:
        return docs.withColumn(unused("kg_score", docs), value)
    out = docs.select(F.col("doc_id").cast("long"), value.alias("score"))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the classifier doesn't reject, with their columns."""
    scored = score(docs, fit(docs, labels), keep=True)
    return scored.where(F.col(scored.columns[-1]) >= THRESHOLD).select(*[F.col(f"`{c}`") for c in docs.columns])
