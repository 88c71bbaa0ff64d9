"""Main text of web pages: block structure, and boilerplate found by suffix arrays over the pages of a host.

A page is cut into blocks with the structure they stand in. An
article's own words stay, whatever other pages repeat; named boilerplate goes.
All other blocks are decided by what their host repeats, however much the article holds: the token streams of a host's pages, with
all blocks of each (articles and boilerplate too), are joined, and a suffix array with longest common prefixes finds runs of tokens that stand on
several different pages (copies of a page count once). Covered runs go, unique runs stay. On a host without such blocks nothing depends on repeats.
The pages of a host are dealt into shards of bounded size. Where it has several, each gives the runs of the least
length, by their hash, with the contents that hold them; these are put together over the host in parts by the hash, and each
shard gets back which of its runs repeat. So the same runs count whatever the host's size or the files' layout,
and a host that holds a third of all pages is handled in parts that stay small.
"""

from __future__ import annotations

import html as entities
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from kgspark.session import materialise, plain, workers_import_this

#: Tokens that a repeated run has at least, and distinct pages that hold it.
MIN_RUN, MIN_PAGES = 6, 3
#: Pages of a host in a shard, about.
SHARD_PAGES = 200
#: Hosts that are sent to all tasks, at most.
BROADCAST_HOSTS = 200_000
#: Shards' worth of runs that are summed at once.
BUCKET_SHARDS = 8
#: What a block's structure says: repeats decide, it stays, it goes.
OPEN, STAYS, GOES = 0, 1, 2

#: Elements whose content is no text; that stand for boilerplate; that end a block.
SILENT = {"script", "style", "noscript", "template", "svg", "iframe", "object", "select", "textarea", "button", "canvas", "math", "head"}
BOILERPLATE = {"nav", "header", "footer", "aside", "form", "menu", "dialog"}
MAIN = {"article", "main"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCKS = {
    "address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form",
    "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "option", "p", "pre", "search", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul",
}
#: Words that name boilerplate in class, id or role; words that may stand beside them in one name; names of content.
NAMES = frozenset((
    "ad ads advert adverts advertisement advertising adbox adsense sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert popup modal nav navbar navigation menu breadcrumb breadcrumbs sidebar "
    "widget widgets footer header masthead comment comments commentlist respond replies reply disqus discussion newsletter subscribe signup login search social share sharing related recommended recirc pagination pager skip toolbar hidden "
    "complementary contentinfo form alertdialog"
).split())
BESIDE = frozenset("site page main top bottom left right box block list item items container wrapper area section bar primary secondary global post posts links link slot unit buttons button inner outer row group thread widget the".split())
CONTENT = frozenset("content article post story text body entry main article-body article-content entry-content post-content post-body story-body main-content page-content".split())
_WORD = re.compile(r"[a-z]+|\d+")

_TOKEN = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|</([a-zA-Z][^\s/>]*)[^>]*(?:>|$)|<([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*)(?:>|$)|<[!?/][^>]*(?:>|$)", re.S)
_ATTR = re.compile(r"([^\s=\"'/>]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))|(\bhidden\b)")
_SPACE = re.compile(r"\s+")
#: An end tag for one of these closes it only within the nearest of the others.
_CLOSES_P = BLOCKS - {"td", "th", "tr", "tbody", "thead", "tfoot", "caption", "li", "dd", "dt", "option", "html", "body", "legend", "summary"}


def _names_boilerplate(name: str) -> bool:
    """Whether a whole class, id or role names boilerplate: a word that does, beside none but words that say nothing."""
    words = [w for w in _WORD.findall(name) if not w.isdigit()]
    return any(w in NAMES for w in words) and all(w in NAMES or w in BESIDE for w in words)


def _boilerplate(tag: str, attrs: str) -> int:
    """2: boilerplate or hidden by its element; 1: by its names; 0: neither. Names of content outweigh others."""
    level = 2 if tag in BOILERPLATE else 0
    if not attrs or "=" not in attrs and "hidden" not in attrs:
        return level
    names: list[str] = []
    for name, a, b, c, bare in _ATTR.findall(attrs):
        name = name.lower()
        value = (a or b or c).lower()
        if bare or name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none", value):
            return 2
        if name in ("class", "id", "role") and tag not in MAIN and tag not in ("html", "body"):
            names += value.split()
    if any(n in CONTENT for n in names):
        return level
    return max(level, int(any(map(_names_boilerplate, names))))


def blocks(page: str | None) -> list[tuple[str, bool, int]]:
    """(text, in an article, level of boilerplate) of each block that has text, in page order.

    Forgiving: end tags without start are ignored, elements left open end with
    their parents, a truncated tag at the end is no text. `<p>` ends an open p.
    """
    text = page or ""
    out: list[tuple[str, bool, int]] = []
    buf: list[str] = []
    stack: list[tuple[str, bool, int, bool]] = []  # tag, main, boilerplate, silent
    opened: Counter[str] = Counter()  # tags on the stack
    main = silent = False
    boiler = at = 0

    def flush() -> None:
        if buf:
            t = _SPACE.sub(" ", "".join(buf)).strip()
            if t:
                out.append((t, main, boiler))
            buf.clear()

    def close(tag: str) -> None:
        nonlocal main, boiler, silent
        if not opened[tag]:
            return
        k = len(stack) - 1
        while stack[k][0] != tag:
            k -= 1
        gone = [s[0] for s in stack[k:]]
        if any(t in BLOCKS for t in gone):
            flush()
        _, main, boiler, silent = stack[k]
        opened.subtract(gone)
        del stack[k:]

    n = len(text)
    while at < n:
        m = _TOKEN.search(text, at)
        stop = m.start() if m else n
        if stop > at and not silent:
            buf.append(entities.unescape(text[at:stop]) if "&" in text[at:stop] else text[at:stop])
        if not m:
            break
        at = m.end()
        if m[1]:
            tag = m[1].lower()
            if tag == "br":
                buf.append(" ")
            elif tag in BLOCKS and not opened[tag]:
                flush()
            else:
                close(tag)
        elif m[2]:
            tag = m[2].lower()
            attrs = m[3] or ""
            if tag == "br":
                buf.append(" ")
                continue
            if tag in _CLOSES_P and opened["p"] and not _inside_scope(stack, "p"):
                close("p")
            elif tag in ("li", "option", "dd", "dt", "tr", "td", "th") and opened[tag] and not _inside_scope(stack, tag):
                close(tag)
            if tag in BLOCKS:
                flush()
            if tag in VOID or attrs.endswith("/"):
                continue
            if tag in ("script", "style", "textarea", "noscript", "template", "iframe"):
                end = re.compile(rf"</{tag}\b[^>]*(?:>|$)", re.I).search(text, at)
                at = end.end() if end else n
                continue
            stack.append((tag, main, boiler, silent))
            opened[tag] += 1
            if tag in MAIN and not boiler:
                main = True
            boiler = max(boiler, _boilerplate(tag, attrs))
            silent = silent or tag in SILENT
            if tag == "body":
                silent = False
    flush()
    return out


_SCOPE = {"li": {"ul", "ol", "menu"}, "p": {"td", "th", "table", "button", "article", "section", "div", "aside", "form", "blockquote", "main"}, "option": {"select"}, "dd": {"dl"}, "dt": {"dl"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}}


def _inside_scope(stack: list, tag: str) -> bool:
    """Whether an element that keeps `tag` open stands between the nearest such tag and here."""
    for s in reversed(stack):
        if s[0] == tag:
            return False
        if s[0] in _SCOPE[tag]:
            return True
    return True


# --- suffix arrays ---


def suffix_array(ids: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes in the order of their first tokens, and the common prefix of each with the next, both up to a power of two >= 8 * least.

    Prefix doubling on ranks; the ranks of each length give the common prefixes.
    """
    n = len(ids)
    _, rank = np.unique(ids, return_inverse=True)
    ranks, width = [rank.astype(np.int64)], 1
    while width < 8 * least:
        r = ranks[-1]
        nxt = np.concatenate([r[width:] + 1, np.zeros(min(width, n), np.int64)])[:n]
        _, rank = np.unique(r * (n + 2) + nxt, return_inverse=True)
        ranks.append(rank.astype(np.int64))
        width *= 2
        if len(_) == n:
            break
    order = np.argsort(ranks[-1], kind="stable")
    a, b = order[:-1].copy(), order[1:].copy()
    lcp = np.zeros(max(n - 1, 0), np.int64)
    for k in range(len(ranks) - 1, -1, -1):
        i, j = a + lcp, b + lcp
        ok = (i < n) & (j < n)
        same = np.zeros(len(lcp), bool)
        same[ok] = ranks[k][i[ok]] == ranks[k][j[ok]]
        lcp += same * (1 << k)
    return order, lcp


def repeated(streams: list[list[int]], least: int = MIN_RUN, pages: int = MIN_PAGES, owners: list[int] | None = None) -> list[np.ndarray]:
    """Per stream, which tokens lie in a run of `least` or more tokens that stands in `pages` or more streams (streams of one owner, a number below theirs, count once). Equal streams are given once."""
    sizes = [len(s) for s in streams]
    if not sum(sizes):
        return [np.zeros(k, bool) for k in sizes]
    flat, owner = [], []
    for k, s in enumerate(streams):
        flat += [*s, -1 - k]  # a mark that occurs once keeps runs within a page
        owner += [owners[k] if owners else k] * (len(s) + 1)
    ids, own = np.array(flat, np.int64), np.array(owner, np.int64)
    order, lcp = suffix_array(ids, least)
    joined = lcp >= least
    group = np.concatenate([[0], np.cumsum(~joined)])
    pair = np.unique(group * (len(streams) + 1) + own[order])
    enough = np.bincount(pair // (len(streams) + 1), minlength=group[-1] + 1) >= pages
    hit = np.zeros(len(ids) + 1, np.int64)
    starts = order[enough[group]]
    np.add.at(hit, starts, 1)
    np.add.at(hit, np.minimum(starts + least, len(ids)), -1)
    cover = np.cumsum(hit[:-1]) > 0
    ends = np.cumsum([k + 1 for k in sizes])
    return [cover[e - 1 - k : e - 1] for e, k in zip(ends, sizes)]


def streams_of(pages: list[list[str]]) -> list[list[int]]:
    return [[zlib.crc32(w.encode("utf-8", "surrogatepass")) for t in p for w in t.split()] for p in pages]


def run_hashes(stream: list[int], least: int = MIN_RUN) -> np.ndarray:
    """Hashes of a stream's runs of `least` tokens, at the runs' first tokens."""
    if len(stream) < least:
        return np.zeros(0, np.uint64)
    h, n = np.zeros(len(stream) - least + 1, np.uint64), len(stream) - least + 1
    x = np.array(stream, np.uint64)
    for j in range(least):
        h = (h ^ (x[j : j + n] + np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(29)
    return h


def covered(stream: list[int], hot: np.ndarray, least: int = MIN_RUN) -> np.ndarray:
    """Which tokens lie in a run of `least` tokens whose hash is among the hot ones."""
    starts = np.flatnonzero(np.isin(run_hashes(stream, least), hot))
    hit = np.zeros(len(stream) + 1, np.int64)
    hit[starts] += 1
    hit[starts + least] -= 1
    return np.cumsum(hit[:-1]) > 0


def contents(streams: list[list[int]], texts: list[list[str]], codes: list[list[int]]) -> list[tuple[int, ...]]:
    """Per page, what it is known by: the tokens of its blocks that do not go (they are its stream's first), or all where there are none. Pages with equal contents are copies."""
    sizes = [sum(len(t.split()) for t, c in zip(ts, cs) if c != GOES) for ts, cs in zip(texts, codes)]
    return [tuple(s[:n] or s) for s, n in zip(streams, sizes)]


def covers(texts: list[list[str]], codes: list[list[int]]) -> list[np.ndarray]:
    """Per page, which of its tokens runs that these pages repeat cover. Copies of a page count as one."""
    streams = streams_of(texts)
    first: dict[tuple[int, ...], int] = {}
    known: dict[tuple[int, ...], int] = {}
    owners: list[int] = []
    of = []
    for s, c in zip(map(tuple, streams), contents(streams, texts, codes)):
        if s not in first:
            first[s] = len(first)
            owners.append(known.setdefault(c, len(known)))
        of.append(first[s])
    got = repeated([list(s) for s in first], owners=owners)
    return [got[k] for k in of]


def unique_text(texts: list[str], cover: np.ndarray, codes: list[int], least: int = MIN_RUN) -> str:
    """A page's blocks but those that go, open ones without their covered runs: those of `least` tokens or more within a block, or that are the whole block. All of these blocks stay if nothing else does."""
    out, at = [], 0
    for t, code in zip(texts, codes):
        if code == GOES:
            continue
        words = t.split()
        c = cover[at : at + len(words)]
        at += len(words)
        if code == STAYS or not c.any():
            out.append(t)
            continue
        turns = np.flatnonzero(np.diff(np.r_[False, c, False].astype(np.int8)))
        stay = np.ones(len(words), bool)
        for a, b in zip(turns[::2].tolist(), turns[1::2].tolist()):
            if b - a >= least or b - a == len(words):
                stay[a:b] = False
        kept = " ".join(w for w, k in zip(words, stay) if k)
        if kept:
            out.append(t if stay.all() else kept)
    return "\n".join(out or [t for t, code in zip(texts, codes) if code != GOES])


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.-]*://)?([^/?#]*)", 1))


def choose(found: list[tuple[str, bool, int]]) -> tuple[list[str], list[int]]:
    """A page's blocks and what their structure says of each: those that stay or are open in page order, then those that go.

    An article's stay, boilerplate goes, repeats decide the others. A page whose blocks are all boilerplate by name has these decided; what elements mark as such is never text.
    """
    some = any(not level for _, _, level in found)
    codes = [(STAYS if main else OPEN) if not level else GOES if some or level == 2 else OPEN for _, main, level in found]
    order = sorted(range(len(found)), key=lambda k: codes[k] == GOES)
    return [found[k][0] for k in order], [codes[k] for k in order]


def extract(pages: DataFrame, shard_pages: int = SHARD_PAGES) -> DataFrame:
    """page_id, url, text, n_chars: a row per row of pages.

    Null and empty pages give an empty text. Rows with equal ids are told apart; other columns are ignored.
    Where a host has an open block, the streams hold all blocks of all its pages. A host without one is not looked at: nothing there depends on repeats.
    """
    spark = pages.sparkSession
    workers_import_this(spark)

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in map(plain, batches):
            chosen = [choose(blocks(h)) for h in b["html"]]
            yield pd.DataFrame({"page_id": b["page_id"], "url": b["url"], "texts": pd.Series([t for t, _ in chosen], dtype=object), "codes": pd.Series([c for _, c in chosen], dtype=object)})

    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    rows = rows.mapInPandas(cut, "page_id long, url string, texts array<string>, codes array<int>").withColumn("open", F.array_contains("codes", OPEN))
    rows = materialise(rows.withColumn("host", host(F.col("url"))).withColumn("row", F.monotonically_increasing_id()), "blocks")
    staying = F.transform(F.filter(F.arrays_zip("texts", "codes"), lambda x: x["codes"] == STAYS), lambda x: x["texts"])
    whole = rows.where("not open").select("page_id", "url", F.array_join(staying, "\n").alias("text"))
    waiting = materialise(rows.where("open").select("host").distinct(), "hosts")
    n = waiting.count()
    if not n:
        return whole.withColumn("n_chars", F.length("text").cast("long"))
    looked = rows.join(F.broadcast(waiting) if n <= BROADCAST_HOSTS else waiting, "host", "left_semi")

    # shards: about shard_pages pages of a host each
    sizes = looked.groupBy("host").agg(F.ceil(F.count("*") / shard_pages).cast("int").alias("shards")).where("shards > 1")
    keyed = looked.join(sizes, "host", "left").withColumn("shard", F.pmod(F.xxhash64("row"), F.coalesce("shards", F.lit(1))).cast("int"))
    texts = keyed.select("host", "shard", "shards", "row", "open", "texts", "codes")
    schema = "row long, kept string"

    def listed(pdf: pd.DataFrame) -> tuple[list[list[str]], list[list[int]]]:
        return [list(t) for t in pdf["texts"]], [list(c) for c in pdf["codes"]]

    def kept(pdf: pd.DataFrame, hot: np.ndarray | None) -> pd.DataFrame:
        texts, codes = listed(pdf)
        cover = covers(texts, codes) if hot is None else [covered(s, hot) for s in streams_of(texts)]
        got = [(r, unique_text(t, v, c)) for r, o, t, v, c in zip(pdf["row"], pdf["open"], texts, cover, codes) if o]
        return pd.DataFrame(got, columns=["row", "kept"])

    def alone(pdf: pd.DataFrame) -> pd.DataFrame:
        return kept(pdf, None if len(pdf) >= MIN_PAGES else np.zeros(0, np.uint64))

    def held(pdf: pd.DataFrame) -> pd.DataFrame:
        """A shard's runs, each with the contents that hold it, MIN_PAGES of them at most, in buckets by the run's hash."""
        texts, codes = listed(pdf)
        all_ = streams_of(texts)
        streams = {tuple(s): c for s, c in zip(all_, contents(all_, texts, codes))}
        runs = [np.unique(run_hashes(list(s))) for s in streams]
        ids = [zlib.crc32(np.array(c, np.int64).tobytes()) << 32 | zlib.adler32(np.array(c, np.int64).tobytes()) for c in streams.values()]
        h = np.concatenate([np.zeros(0, np.uint64), *runs])
        who = np.repeat(np.array(ids, np.uint64), [len(r) for r in runs])
        h, who = _least(h, who)
        buckets = -(-int(pdf["shards"].iloc[0]) // BUCKET_SHARDS)
        of = (h % np.uint64(buckets)).astype(np.int64)
        parts = [(b, of == b) for b in np.unique(of).tolist()]
        got = {"bucket": [b for b, _ in parts], "runs": [h[i].tobytes() for _, i in parts], "held": [who[i].tobytes() for _, i in parts]}
        return pd.DataFrame({"host": pdf["host"].iloc[0], "shard": int(pdf["shard"].iloc[0]), **got}, columns=["host", "shard", "bucket", "runs", "held"])

    def hot_runs(pdf: pd.DataFrame) -> pd.DataFrame:
        """The runs of a bucket that MIN_PAGES contents of the host hold, for each shard that holds them."""
        runs = [np.frombuffer(r, np.uint64) for r in pdf["runs"]]
        h, _ = _least(np.concatenate(runs), np.concatenate([np.frombuffer(c, np.uint64) for c in pdf["held"]]))
        x, n = np.unique(h, return_counts=True)
        hot = x[n >= MIN_PAGES]
        got = [(s, np.unique(r[np.isin(r, hot)])) for s, r in zip(pdf["shard"], runs)]
        got = [(s, r.tobytes()) for s, r in got if len(r)]
        return pd.DataFrame({"host": [pdf["host"].iloc[0]] * len(got), "shard": [s for s, _ in got], "hot": [r for _, r in got]}, columns=["host", "shard", "hot"])

    def kept_hot(pdf: pd.DataFrame, hot: pd.DataFrame) -> pd.DataFrame:
        return kept(pdf, np.frombuffer(b"".join(hot["hot"]), np.uint64)) if len(pdf) else kept(pdf, np.zeros(0, np.uint64))

    some, parts = texts.where("shards is null").drop("shards"), texts.where("shards is not null")
    found = some.groupBy("host", "shard").applyInPandas(alone, schema)
    counted = parts.groupBy("host", "shard").applyInPandas(held, "host string, shard int, bucket int, runs binary, held binary")
    hot = counted.groupBy("host", "bucket").applyInPandas(hot_runs, "host string, shard int, hot binary")
    # runs are known by now: only pages with an open block need them
    found = found.unionByName(parts.where("open").drop("shards").groupBy("host", "shard").cogroup(hot.groupBy("host", "shard")).applyInPandas(kept_hot, schema))
    decided = rows.where("open").join(found, "row", "left").select("page_id", "url", F.coalesce("kept", F.lit("")).alias("text"))
    return whole.unionByName(decided).withColumn("n_chars", F.length("text").cast("long"))


def _least(h: np.ndarray, who: np.ndarray, most: int = MIN_PAGES) -> tuple[np.ndarray, np.ndarray]:
    """Distinct pairs of a run and a content, the first `most` of each run."""
    if not len(h):
        return h, who
    o = np.lexsort((who, h))
    h, who = h[o], who[o]
    new = np.r_[True, (h[1:] != h[:-1]) | (who[1:] != who[:-1])]
    h, who = h[new], who[new]
    start = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
    nth = np.arange(len(h)) - np.repeat(start, np.diff(np.r_[start, len(h)]))
    return h[nth < most], who[nth < most]
