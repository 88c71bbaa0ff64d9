"""Language identification by cross-parsing: suffix automata of labelled text, phrases counted by their longest matches.

The model is a suffix automaton a language, over a bounded sample of its
labelled documents. A text is read against each automaton: a phrase goes on as
long as the language's sample holds it, then a new one begins. The language
that needs the fewest phrases a letter wins. Texts are read whole, in blocks that
run through an automaton side by side; a block's end also ends a phrase.
"""

from __future__ import annotations

import math
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from kgspark.session import workers_import_this

#: Bounds of the sample: documents a language, characters of a piece, pieces a language (those with the least hashes).
SAMPLE_DOCS, PIECE, PIECES = 256, 1000, 24
#: Distinct letters an automaton tells apart (a language's most frequent ones), and cells of all automata together, which bound the broadcast.
LETTERS, CELLS = 160, 32_000_000
#: Letters of a block, and letters looked at at once.
BLOCK, CHUNK = 256, 1 << 20
#: Codes of a text: anything but letters and their marks is one blank, a letter that no language has is UNSEEN.
BLANK, UNSEEN = 0, 1
UNKNOWN = "und"


@dataclass(frozen=True)
class Model:
    """languages in order; letters: all letters in order (code 2 and on); codes: each language's own code of a text's code (0: it has none); tables: next states by state and own code (0: none; 1 is the start)."""

    languages: list[str]
    letters: str
    codes: list[np.ndarray]
    tables: list[np.ndarray]


# --- texts as codes ---

_CLASSES: list[np.ndarray] = []


def _classes() -> np.ndarray:
    """For each code point: 0 for what is no letter, else the letter in lower case (where that is one letter)."""
    if not _CLASSES:
        out = np.zeros(0x110000, np.int32)
        for k in range(0x110000):
            if unicodedata.category(chr(k))[0] in "LM":
                low = chr(k).lower()
                out[k] = ord(low) if len(low) == 1 else k
        _CLASSES.append(out)
    return _CLASSES[0]


def code_table(letters: str) -> np.ndarray:
    """Codes by code point."""
    lower = _classes()
    own = np.full(0x110000, UNSEEN, np.int32)
    for k, c in enumerate(letters):
        own[ord(c)] = k + 2
    return np.where(lower == 0, BLANK, own[lower]).astype(np.int32)


def encoded(text: str, table: np.ndarray) -> np.ndarray:
    """Codes of a text, with runs of blanks as one, and none at either end."""
    raw = table[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
    keep = raw != BLANK
    keep[1:] |= raw[:-1] != BLANK
    out = raw[keep]
    if len(out) and out[0] == BLANK:
        out = out[1:]
    return out[:-1] if len(out) and out[-1] == BLANK else out


def lowered(text: str) -> str:
    """A text's letters in lower case with single spaces between runs, as encoded() reads it."""
    low = _classes()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
    return " ".join("".join(chr(c) if c else " " for c in low.tolist()).split())


# --- automata ---


def automaton(pieces: list[list[int]], width: int) -> np.ndarray:
    """Suffix automaton of sequences of codes from 1 to width - 1: next state by state and code. No phrase goes over the end of a piece."""
    goes: list[dict[int, int]] = [{}, {}]
    link, length = [0, 0], [0, 0]
    for piece in pieces:
        last = 1
        for c in piece:
            old = goes[last].get(c)
            if old is not None and length[old] == length[last] + 1:
                last = old
                continue
            if old is None:
                new = len(goes)
                goes.append({})
                length.append(length[last] + 1)
                link.append(0)
                p = last
                while p and c not in goes[p]:
                    goes[p][c] = new
                    p = link[p]
                if not p:
                    link[new] = 1
                    last = new
                    continue
            else:
                new, p = 0, last
            q = goes[p][c]
            if length[q] == length[p] + 1:
                copy = q
            else:
                copy = len(goes)
                goes.append(dict(goes[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                link[q] = copy
                while p and goes[p].get(c) == q:
                    goes[p][c] = copy
                    p = link[p]
            if new:
                link[new] = copy
            last = new or copy
    table = np.zeros((len(goes), width), np.int32)
    for s, edges in enumerate(goes):
        for c, t in edges.items():
            table[s, c] = t
    return table


def build(samples: dict[str, list[str]]) -> Model:
    """The model of each language's pieces of text."""
    texts = {k: [lowered(p) for p in v] for k, v in samples.items()}
    texts = {k: [p for p in v if p] for k, v in sorted(texts.items())}
    texts = {k: v for k, v in texts.items() if v}
    often: dict[str, list[str]] = {}
    for k, v in texts.items():
        found, n = np.unique(np.frombuffer("".join(v).replace(" ", "").encode("utf-32-le", "surrogatepass"), np.uint32), return_counts=True)
        often[k] = [chr(found[i]) for i in np.lexsort((found, -n))[:LETTERS]]
    letters = "".join(sorted(set().union(*often.values()))) if often else ""
    table = code_table(letters)
    codes, tables = [], []
    for k, v in texts.items():
        own = np.zeros(len(letters) + 2, np.int32)
        own[BLANK] = 1
        for i, c in enumerate(often[k]):
            own[letters.index(c) + 2] = i + 2
        runs: list[list[int]] = []
        for piece in v:
            run: list[int] = []
            for c in [*own[encoded(piece, table)].tolist(), 0]:  # an unseen letter ends a piece
                if c:
                    run.append(c)
                elif run:
                    runs.append(run)
                    run = []
        codes.append(own)
        tables.append(automaton(runs, len(often[k]) + 2))
    return Model(list(texts), letters, codes, tables)


def counted(codes: np.ndarray, live: list[int], table: np.ndarray) -> np.ndarray:
    """Phrases of blocks: codes (place, block) in an automaton's own codes, live[j] the number of blocks with more than j codes, longest first.

    A phrase goes on to the last code with which the automaton knows it; a code that it does not know at all is a phrase.
    """
    flat, width, first = table.ravel(), table.shape[1], table[1]
    state, out = np.ones(codes.shape[1], np.int64), np.zeros(codes.shape[1], np.int64)
    for j, m in enumerate(live):
        c, s = codes[j, :m], state[:m]
        to, anew = flat[s * width + c], first[c]
        miss = to == 0
        out[:m] += miss & (s > 1)
        out[:m] += miss & (anew == 0)
        state[:m] = np.where(miss, np.maximum(anew, 1), to)
    return out + (state > 1)


def judge(texts: list[np.ndarray], model: Model) -> tuple[np.ndarray, np.ndarray]:
    """(phrases by text and language, letters by text) of encoded texts."""
    sizes = np.array([len(t) for t in texts], np.int64)
    total = np.zeros((len(texts), len(model.languages)), np.int64)
    all_codes = np.concatenate(texts) if texts else np.zeros(0, np.int32)
    blocks = -(-sizes // BLOCK)
    owner = np.repeat(np.arange(len(texts)), blocks)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    start = np.repeat(np.cumsum(sizes) - sizes, blocks) + nth * BLOCK
    length = np.minimum(BLOCK, sizes[owner] - nth * BLOCK) if len(owner) else np.zeros(0, np.int64)
    step = CHUNK // BLOCK
    for lo in range(0, len(owner), step):
        part = np.arange(lo, min(lo + step, len(owner)))
        part = part[np.argsort(-length[part], kind="stable")]
        longest = int(length[part[0]])
        at = np.minimum(start[part][None, :] + np.arange(longest)[:, None], len(all_codes) - 1)
        block = all_codes[at]
        live = np.searchsorted(-length[part], -np.arange(longest), side="left").tolist()
        for k, (own, table) in enumerate(zip(model.codes, model.tables)):
            total[:, k] += np.bincount(owner[part], counted(own[block], live, table), len(texts)).astype(np.int64)
    return total, sizes


def verdicts(texts: list[str | None], model: Model, table: np.ndarray) -> tuple[list[str], list[float]]:
    """Language and score of texts: the language with the fewest phrases, the first by name of those that tie; score is 1 - fewest / second fewest (1 for a model of one language)."""
    names, scores, encoded_, where = [UNKNOWN] * len(texts), [0.0] * len(texts), [], []

    def flush() -> None:
        phrases, _ = judge(encoded_, model)
        order = np.argsort(phrases, axis=1, kind="stable")
        for row, i, best in zip(phrases, where, order):
            names[i] = model.languages[best[0]]
            scores[i] = 1.0 - float(row[best[0]] / row[best[1]]) if len(best) > 1 else 1.0
        encoded_.clear()
        where.clear()

    size = 0
    for i, text in enumerate(texts):
        if not text or not model.languages:
            continue
        codes = encoded(text, table)
        if not (codes > BLANK).any() or not any(map(str.isalpha, text)):
            continue
        encoded_.append(codes)
        where.append(i)
        size += len(codes)
        if size >= CHUNK:
            flush()
            size = 0
    if encoded_:
        flush()
    return names, scores


# --- Spark ---


def held_out(doc_id: Column) -> Column:
    """Whether CRC-32 of the id as text leaves 2 of 4: such rows are not learned from. A null id is no row to learn from either, and not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame) -> Model:
    """The model of docs' labelled rows (doc_id, text, lang) that are not held out.

    SAMPLE_DOCS documents a language with the least hashes of their ids are sampled, and of all their pieces of PIECE characters the PIECES
    with the least hashes, fewer if CELLS would be passed: that, and only that, goes to the driver. Rows with a null id, text or language are left out.
    """
    known = docs.where("doc_id is not null and lang is not null").where(~held_out(F.col("doc_id")))
    order = lambda *c: Window.partitionBy("lang").orderBy(F.xxhash64(*c), *c)
    ids = known.select("doc_id", "lang").withColumn("kg_k", F.row_number().over(order("doc_id"))).where(F.col("kg_k") <= SAMPLE_DOCS).select("doc_id", "lang").distinct()
    rows = known.where("text is not null").select("doc_id", "lang", "text").join(F.broadcast(ids), ["doc_id", "lang"], "left_semi")
    place = F.explode(F.sequence(F.lit(0), F.floor((F.greatest(F.char_length("text"), F.lit(1)) - 1) / PIECE).cast("int")))
    pieces = rows.select("doc_id", "lang", "text", place.alias("piece")).select("doc_id", "lang", "piece", F.substring(F.col("text"), F.col("piece") * PIECE + 1, F.lit(PIECE)).alias("text"))
    best = pieces.withColumn("kg_k", F.row_number().over(order("doc_id", "piece", "text"))).where(F.col("kg_k") <= PIECES)
    got: dict[str, list[str]] = {}
    for r in best.select("lang", "kg_k", "text").orderBy("lang", "kg_k").collect():
        got.setdefault(r.lang, []).append(r.text)
    if not got:
        return Model([], "", [], [])
    most = max(1, min(PIECES, math.floor(CELLS / (len(got) * 2 * PIECE * LETTERS))))
    return build({k: v[:most] for k, v in got.items()})


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, lang_pred, score of each row of docs (doc_id, text; other columns are ignored), in any order.

    A null text, or one without a letter, is `und` with score 0, and so is every text under a model without languages. Texts are read whole, however long;
    repeated rows get equal results; an empty table gives none. Ids do not pass through Python.
    """
    spark = docs.sparkSession
    workers_import_this(spark)
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double")
    def found(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own = shared.value
        table = code_table(own.letters)
        for texts in batches:
            names, scores = verdicts([t if isinstance(t, str) else None for t in texts], own, table)
            yield pd.DataFrame({"lang_pred": pd.Series(names, dtype=object), "score": scores})

    return docs.select(F.col("doc_id"), held_out(F.col("doc_id")).alias("held_out"), found("text").alias("kg_found")).select("doc_id", "held_out", "kg_found.lang_pred", "kg_found.score")
