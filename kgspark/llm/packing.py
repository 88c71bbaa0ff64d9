"""Best-fit packing of tokenised documents by bin completion.

Tokenising is one Arrow pass over the texts. Packing itself works on the
histogram of piece lengths, which has at most `capacity` entries whatever the
corpus size: the driver solves it by bin-completion branch and bound and gets a
plan of patterns with multiplicities. Each piece then finds its place from its
length and its rank among pieces of that length; ranks come from counts per
(length, bucket), so no length, however common, meets in one task.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from kgspark.llm.jaccard import byte_powers, mixed
from kgspark.session import exact_ids, materialise, plain, workers_import_this

CAPACITY = 2048
TOKENIZER = "word_bpe_49k.json"
#: Words whose ids a worker remembers, by their hash; when there are more, those of the texts at hand stay, so it is bounded.
WORDS_KEPT = 450_000
#: Bytes of texts encoded at once.
CHUNK = 1 << 20
#: Branch-and-bound nodes and undominated fillings tried at a node.
NODES, WIDTH = 400, 4
#: Within a length, ranks are counted in so many buckets.
BUCKETS = 512


_VALUE = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_LENGTH = np.uint64(0xC2B2AE3D27D4EB4F)
#: Marks cut from a word's end: a run of them after a letter is a match of its own for the tokenizer.
MARKS = ".,!#%&*$"


@lru_cache(1)
def _tokenizer(name: str):
    """The tokenizer, a word of one id that can part others, the ids' type, and the words remembered."""
    import public_tokenizers
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path(name) if "/" not in name else name)
    size = tok.get_vocab_size()
    part = None
    for k in range(size - 1, 0, -1):
        word = (tok.id_to_token(k) or "").removesuffix("</w>")
        if word.isascii() and word.isalpha() and len(word) > 5 and tok.encode(word, add_special_tokens=False).ids == [k]:
            part = (k, f" {word} ")
            break
    suffix = getattr(tok.model, "end_of_word_suffix", None)
    ends = np.array([bool(suffix) and (tok.id_to_token(k) or "").endswith(suffix) for k in range(size)])
    return tok, part, "<u2" if size < 1 << 16 else "<u4", {}, ends


#: A comma or stop at a word's end that follows another mark, and so belongs to a longer match.
_RUN = re.compile(r"[^\w ][.,](?: |$)|_[.,]")


def _folded(text: str) -> str:
    """The text with words that the tokenizer would treat alike in fewer forms, parted by spaces: lower case, and commas and stops on their own.

    Only Latin-1 texts without special tokens are changed: there lower-casing
    is letter by letter and normalisation does nothing, as in the tokenizer.
    """
    text = text.replace("\n", " ")
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return text
    if "<|" not in text:
        text = text.lower()
        if not _RUN.search(text):
            text = text.replace(", ", " , ").replace(". ", " . ")
            if text[-1:] in (".", ","):
                text = f"{text[:-1]} {text[-1]}"
    return text


def _learn(words: list[str], tok, part, kind: str, kept: dict[str, bytes]) -> None:
    """Encode words in one call, parted by a word of one id; if that id turns up elsewhere too, one by one."""
    if part:
        ids = np.array(tok.encode(part[1].join(words), add_special_tokens=False).ids, kind)
        cuts = [-1, *np.flatnonzero(ids == part[0]).tolist(), len(ids)]
        if len(cuts) == len(words) + 1:
            raw, width = ids.tobytes(), ids.itemsize
            kept.update((w, raw[(a + 1) * width : b * width]) for w, a, b in zip(words, cuts[:-1], cuts[1:]))
            return
    if len(words) > 64:
        for at in range(0, len(words), -(-len(words) // 16)):
            _learn(words[at : at + -(-len(words) // 16)], tok, part, kind, kept)
        return
    kept.update((w, np.array(tok.encode(w, add_special_tokens=False).ids, kind).tobytes()) for w in words)


def _ids_of(words: list[str], name: str) -> list[bytes]:
    """Ids of different words: those of letters are encoded together, as one match each; marks at a word's end stand alone as well."""
    tok, part, kind, _, ends = _tokenizer(name)
    known: dict[str, bytes] = {}
    cut = [(core, w[len(core) :]) if len(core := w.rstrip(MARKS)) < len(w) and core[-1:].lower().isalpha() else (w, "") for w in words]
    bare = list({x for pair in cut for x in pair})
    letters = [w for w in bare if w.isalpha()] if ends.any() else []
    parts = [letters[at : at + 500] for at in range(0, len(letters), 500)]
    for some, got in zip(parts, tok.encode_batch_fast([" ".join(p) for p in parts], add_special_tokens=False)):
        # a word of letters is one match, whose last id is one of those that end a word
        ids = np.array(got.ids, kind)
        at = [0, *(np.flatnonzero(ends[ids]) + 1).tolist()]
        if len(at) == len(some) + 1 and at[-1] == len(ids):
            raw, width = ids.tobytes(), ids.itemsize
            known.update((w, raw[i * width : j * width]) for w, i, j in zip(some, at[:-1], at[1:]))
    bare = [w for w in bare if w not in known]
    for at in range(0, len(bare), 500):
        _learn(bare[at : at + 500], tok, part, kind, known)
    return [known[core] + known[marks] for core, marks in cut]


def _encoded(raw: bytes, name: str) -> tuple[np.ndarray, np.ndarray]:
    """Ids of lines of words, parted by spaces and line feeds, and where each line's ids end.

    A word is known by the 64-bit hash of its bytes.
    """
    kind, kept = _tokenizer(name)[2:4]
    b = np.frombuffer(raw, np.uint8)
    blank = (b == 32) | (b == 10)
    turns = np.flatnonzero(np.diff(np.r_[True, blank, True].view(np.int8)))
    start, end = turns[::2], turns[1::2]
    up, down = byte_powers(len(b) + 1)
    total = np.zeros(len(b) + 1, np.uint64)
    np.cumsum(_VALUE[b] * up[: len(b)], out=total[1:])
    h = mixed((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64) * _LENGTH)
    distinct, first, at = np.unique(h, return_index=True, return_inverse=True)
    keys = distinct.tolist()
    if len(kept) > WORDS_KEPT:
        stay = {x: kept[x] for x in keys if x in kept}
        kept.clear()
        kept.update(stay)
    new = [k for k, x in enumerate(keys) if x not in kept]
    words = [raw[i:j].decode("utf-8", "surrogatepass") for i, j in zip(start[first[new]].tolist(), end[first[new]].tolist())] if new else []
    kept.update(zip([keys[k] for k in new], _ids_of(words, name)))
    each = [kept[x] for x in keys]
    flat = np.frombuffer(b"".join(each), kind)
    size = np.fromiter(map(len, each), np.int64, len(each)) // flat.itemsize
    begin = np.cumsum(size) - size
    sizes = size[at]
    upto = np.r_[0, np.cumsum(sizes)]
    ids = flat[np.repeat(begin[at] - upto[:-1], sizes) + np.arange(upto[-1])]
    lines = np.r_[np.flatnonzero(b == 10), len(b)]
    return ids, upto[np.searchsorted(start, lines)]


def encode_all(texts: list[str], name: str = TOKENIZER) -> Iterator[np.ndarray]:
    """Ids of each text.

    The tokenizer's matches never cross a space or line feed, so each word's
    ids stand alone and are remembered. Texts are looked at together up to CHUNK
    bytes; a longer one is cut between words.
    """
    fold = name == TOKENIZER
    lines, size = [], 0

    def flush() -> Iterator[np.ndarray]:
        if lines:
            ids, ends = _encoded(b"\n".join(lines), name)
            yield from np.split(ids, ends[:-1])
            lines.clear()

    for t in texts:
        raw = (_folded(t) if fold else t.replace("\n", " ")).encode("utf-8", "surrogatepass")
        if size + len(raw) > CHUNK:
            yield from flush()
            size = 0
        if len(raw) <= CHUNK:
            lines.append(raw)
            size += len(raw)
            continue
        parts, at = [], 0
        while at < len(raw):
            stop = raw.find(b" ", at + CHUNK)
            stop = len(raw) if stop < 0 else stop
            parts.append(_encoded(raw[at:stop], name)[0])
            at = stop
        yield np.concatenate(parts)
    yield from flush()


def encode(text: str, name: str = TOKENIZER) -> list[int]:
    return next(encode_all([text], name)).tolist()


def tokenize(docs: DataFrame, capacity: int = CAPACITY, end: int = 0, tokenizer: str = TOKENIZER, emit_ids: bool = True) -> DataFrame:
    """Pieces of at most `capacity` ids: doc_id, piece, start, length, ids_crc32 (and ids).

    A null text counts as empty and gives the end id alone; other columns of docs are ignored.
    """
    workers_import_this(docs.sparkSession)
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + (", ids array<int>" if emit_ids else "")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for doc, ids in zip(b["doc_id"], encode_all([t or "" for t in b["text"]], tokenizer)):
                ids = np.append(ids, end).astype("<u4")
                for k, at in enumerate(range(0, len(ids), capacity)):
                    part = ids[at : at + capacity]
                    row = (doc, k, at, len(part), zlib.crc32(part.tobytes()))
                    rows.append((*row, part.astype("i4")) if emit_ids else row)
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in schema.split(", ")])

    return exact_ids(docs.select(F.col("doc_id").cast("long").cast("string"), F.col("text").cast("string")).mapInPandas(run, schema.replace("doc_id long", "doc_id string")))


# --- the solver, on a histogram {length: count} ---

Pattern = tuple[tuple[int, int], ...]  # (length, copies in the bin), longest first


def best_fit_decreasing(hist: dict[int, int], cap: int) -> list[tuple[Pattern, int]]:
    """Best fit over lengths in falling order; bins with equal contents are kept as one entry with a count."""
    open_: dict[int, list[list]] = {}
    for size in sorted(hist, reverse=True):
        left = hist[size]
        while left:
            room = next((r for r in range(size, cap) if open_.get(r)), None)
            if room is None:
                per = cap // size
                full, rest = divmod(left, per)
                if full:
                    open_.setdefault(cap - per * size, []).append([{size: per}, full])
                if rest:
                    open_.setdefault(cap - rest * size, []).append([{size: rest}, 1])
                left = 0
                continue
            held, n = open_[room].pop()
            per = min(room // size, left)
            take = min(n, left // per)
            if n > take:
                open_[room].append([held, n - take])
            open_.setdefault(room - per * size, []).append([held | {size: held.get(size, 0) + per}, take])
            left -= take * per
    return [(tuple(sorted(h.items(), reverse=True)), n) for group in open_.values() for h, n in group]


def lower_bound(hist: dict[int, int], cap: int) -> int:
    """Martello and Toth's L2 over thresholds at the lengths that occur."""
    best = 0
    sizes = np.array(sorted(hist), dtype=np.int64)
    counts = np.array([hist[s] for s in sizes.tolist()], dtype=np.int64)
    mass = sizes * counts
    for k in [0, *sizes[sizes <= cap // 2].tolist()]:
        big, mid, low = sizes > cap - k, (sizes <= cap - k) & (sizes > cap // 2), (sizes <= cap // 2) & (sizes >= k)
        n = int(counts[big].sum() + counts[mid].sum())
        over = int(mass[low].sum()) - (int(counts[mid].sum()) * cap - int(mass[mid].sum()))
        best = max(best, n + max(0, -(-over // cap)))
    return best


def fillings(avail: list[int], hist: dict[int, int], room: int, slack: int, width: int) -> list[tuple[int, ...]]:
    """Undominated fillings of `room`, least waste first.

    avail: lengths in falling order. A filling is kept only if it wastes at
    most `slack` and no other one that is at hand dominates it: one longer
    piece for the same room beats several shorter ones, and a filling that still
    has room for an available piece is dropped. The search stops at a perfect fit.
    """
    found: list[tuple[int, tuple[int, ...]]] = []
    sizes = np.array(avail[::-1])
    budget = [300]

    def go(at: int, room: int, chosen: tuple[int, ...]) -> bool:
        budget[0] -= 1
        i = int(np.searchsorted(sizes, min(room, at), side="right"))
        tried = 0
        while i and tried < width and budget[0] > 0:
            i -= 1
            s = int(sizes[i])
            if hist.get(s, 0) <= chosen.count(s):
                continue
            tried += 1
            if go(s, room - s, (*chosen, s)):
                return True
        if not tried and room <= slack:
            found.append((room, chosen))
            return room == 0
        return False

    if room in hist and hist[room]:
        return [(room,)]
    # two pieces that fit exactly, the longest first, come before the general search
    have = set(avail)
    for a in avail:
        if room // 2 <= a < room and room - a in have and (a != room - a or hist[a] > 1):
            found.append((0, (a, room - a)))
            if len(found) >= 2:
                break
    if not found and avail:
        go(room, room, ())
    found.sort(key=lambda f: (f[0], len(f[1]), tuple(-x for x in f[1])))
    kept: list[tuple[int, ...]] = []
    for _, f in found:
        if not any(all(x <= y for x, y in zip(f, g)) and len(f) <= len(g) for g in kept) and f not in kept:
            kept.append(f)
    return kept[:width] or [()]


def bin_completion(hist: dict[int, int], cap: int, nodes: int = NODES, width: int = WIDTH) -> list[tuple[Pattern, int]]:
    """Branch and bound: complete the bin around the longest piece left, as often as the counts allow.

    Best fit is the first incumbent; a branch ends when its waste so far cannot
    lead to fewer bins than the incumbent has. After `nodes` backtracks the
    incumbent stands, as it does when it meets the lower bound.
    """
    hist = {s: n for s, n in hist.items() if n}
    if not hist:
        return []
    best = best_fit_decreasing(hist, cap)
    bins = sum(n for _, n in best)
    low = lower_bound(hist, cap)
    total = sum(s * n for s, n in hist.items())
    left, avail = dict(hist), sorted(hist, reverse=True)
    path: list[tuple[Pattern, int]] = []
    stack: list[list] = []  # per level: fillings to try, next, what was taken
    used = waste = backs = 0

    def undo() -> None:
        nonlocal used, waste, avail
        pattern, m = path.pop()
        for s, k in pattern:
            left[s] = left.get(s, 0) + k * m
        avail = sorted((s for s in left if left[s]), reverse=True)
        used -= m
        waste -= m * (cap - sum(s * k for s, k in pattern))

    def push() -> None:
        top = avail[0]
        left[top] -= 1
        rest = avail if left[top] else avail[1:]
        slack = min(cap, (bins - 1) * cap - total - waste)
        stack.append([top, fillings([s for s in rest if s <= cap - top], left, cap - top, max(slack, 0), width), 0])
        left[top] += 1

    push()
    while stack and bins > low and backs < nodes:
        top, options, k = stack[-1]
        if k == len(options):
            stack.pop()
            if path:
                undo()
            backs += 1
            continue
        stack[-1][2] += 1
        held: dict[int, int] = {top: 1}
        for s in options[k]:
            held[s] = held.get(s, 0) + 1
        m = min(left[s] // n for s, n in held.items())
        over = m * (cap - sum(s * n for s, n in held.items()))
        if used + m >= bins and sum(left.values()) > sum(held.values()) * m or waste + over > (bins - 1) * cap - total:
            backs += 1
            continue
        path.append((tuple(sorted(held.items(), reverse=True)), m))
        used, waste = used + m, waste + over
        for s, n in held.items():
            left[s] -= n * m
        avail = [s for s in avail if left[s]]
        if not avail:
            if used < bins:
                best, bins = list(path), used
            undo()
            continue
        push()
    return best


def plan(best: list[tuple[Pattern, int]]) -> pd.DataFrame:
    """Slots: pieces of `size` with rank in [first, first + copies * bins) go to bins bin0 + (rank - first) % bins."""
    taken: dict[int, int] = {}
    rows, bin0 = [], 0
    for pattern, m in best:
        at = 0
        for s, k in pattern:
            rows.append((s, taken.get(s, 0), bin0, m, at))
            taken[s] = taken.get(s, 0) + k * m
            at += s * k
        bin0 += m
    return pd.DataFrame(rows, columns=["size", "first", "bin0", "bins", "at"]).sort_values(["size", "first"], ignore_index=True)


def pack(pieces: DataFrame, capacity: int = CAPACITY, nodes: int = NODES, buckets: int = BUCKETS) -> DataFrame:
    """Add sequence_id and offset to pieces (doc_id, piece, length, ...), in as few sequences as the search finds.

    Every piece gets a place; full-length pieces have a sequence of their own;
    pieces that are equal in all columns are told apart by their rank. No pieces give no rows.
    """
    pieces = materialise(pieces, "pieces")
    bucket = F.pmod(F.xxhash64("doc_id", "piece"), F.lit(buckets)).cast("int")
    keyed = pieces.withColumn("bucket", bucket)
    counts = keyed.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    hist = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    slots = plan(bin_completion(hist, capacity, nodes))
    before = counts.select("length", "bucket", (F.sum("n").over(Window.partitionBy("length").orderBy("bucket")) - F.col("n")).alias("before"))
    rank = F.row_number().over(Window.partitionBy("length", "bucket").orderBy("doc_id", "piece"))
    ranked = keyed.withColumn("rank", rank - 1).join(before, ["length", "bucket"]).withColumn("rank", F.col("rank") + F.col("before")).drop("bucket", "before")
    size, first, bin0, bins, at = (slots[c].to_numpy(np.int64) for c in slots.columns)
    big = np.int64(1) << np.int64(40)
    key = size * big + first
    out = [c for c in ranked.columns if c != "rank"]
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranked.select(out).schema)

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in map(plain, batches):
            n, r = b["length"].to_numpy(np.int64), b["rank"].to_numpy(np.int64)
            i = np.searchsorted(key, n * big + r, side="right") - 1
            k = r - first[i]
            yield b[out].assign(sequence_id=bin0[i] + k % bins[i], offset=at[i] + k // bins[i] * n)

    return ranked.mapInPandas(place, f"{fields}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str = TOKENIZER, emit_ids: bool = False, nodes: int = NODES) -> DataFrame:
    """Tokenise and pack: one row per piece, with its sequence and offset; emit_ids also carries the ids themselves."""
    pieces = pack(tokenize(docs, capacity, tokenizer=tokenizer, emit_ids=emit_ids), capacity, nodes)
    first = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    return pieces.select(*first, *[c for c in pieces.columns if c not in first])
