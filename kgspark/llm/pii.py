"""Personal data: exact base patterns, and contextual extraction bootstrapped from them.

One Arrow pass over the texts finds the base spans and, beside them, candidates:
digit-bearing tokens that no base pattern took, with the words around. The
bootstrap then works on that small table. Values found by base patterns are
the seeds; the contexts they stand in are lexical patterns; Spark scores the
graph of patterns and instances, accepts patterns that almost always hold known
values of one kind, accepts unseen instances that such patterns hold, and
starts over with them as further seeds.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from kgspark.session import exact_ids, materialise, workers_import_this

#: Kinds in their order.
KINDS = ("email", "ip", "card", "phone")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
#: The possessive quantifiers and the look-behind leave the matches as they are and keep the search linear.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_RUN = re.compile(r"[^\s,;|<>\"'=]+")
_DIGITS = re.compile(r"[0-9]")

#: A pattern needs so many distinct known values, and so large a share of them among all its instances.
MIN_SEEDS, MIN_PRECISION = 3, 0.8
#: An instance is accepted at this confidence: 1 - product of (1 - precision) over its patterns.
MIN_INSTANCE = 0.8
ROUNDS = 3
#: Characters of an identifier of unknown form, and digits in it.
MIN_CHARS, MAX_CHARS, MIN_DIGITS = 6, 64, 4


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if k % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Matches of local@domain, found from their @ signs: the local part is the longest run before one, after the last match."""
    last, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield start, m.end()
            last = m.end()
        else:
            last = max(last, at + 1)  # no later local part holds this @
        at = text.find("@", last)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of base matches, sorted."""
    out = [(s, 0, e) for s, e in emails(text)]
    if _DIGITS.search(text):
        if "." in text:
            out += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) < 4 and int(p) < 256 for p in m[0].split("."))]
        for m in _CARD.finditer(text):
            if 12 <= m.end() - m.start():
                digits = m[0].replace(" ", "").replace("-", "")
                if 12 <= len(digits) <= 19 and luhn(digits):
                    out.append((m.start(), 2, m.end()))
        if "+" in text:
            out += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
    return sorted(out)


def words_before(text: str, at: int, n: int = 3) -> list[str]:
    """Up to n words that end at `at`, lower-case; a window of fixed width bounds the work at any place."""
    return [w.lower() for w in text[max(0, at - 120) : at].split()[-n:]]


def contexts(text: str, start: int, end: int) -> list[str]:
    """Lexical patterns of a place: two words before; a cue word that ends in a mark; a word on either side with such a mark."""
    left, right = words_before(text, start), text[end : end + 60].split()[:1]
    right = [w.lower() for w in right]
    out = []
    if len(left) >= 2:
        out.append("L2 " + " ".join(left[-2:]))
    if len(left) >= 3:
        out.append("L3 " + " ".join(left[-3:]))
    if left and left[-1][-1:] in ":#=":
        out.append("C " + left[-1])
        if right:
            out.append("CR " + left[-1] + " _ " + right[0])
    return out


def scan(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int, str, list[str]]]]:
    """Base spans; and places for the graph: (kind or -1, start, end, value, patterns)."""
    spans = base_spans(text)
    places = [(k, s, e, text[s:e].lower(), contexts(text, s, e)) for s, k, e in spans]
    if _DIGITS.search(text):
        taken = sorted((s, e) for s, _, e in spans)
        i = 0
        for m in _RUN.finditer(text):
            if m.end() - m.start() < MIN_CHARS or not _DIGITS.search(m[0]):
                continue
            s, e = m.start(), m.end()
            while i < len(taken) and taken[i][1] <= s:
                i += 1
            while e > s and text[e - 1] in ".,:;!?)":
                e -= 1
            while s < e and text[s] in "(":
                s += 1
            if not MIN_CHARS <= e - s <= MAX_CHARS or any(a < e and s < b for a, b in taken[i : i + 8]):
                continue
            value = text[s:e]
            if sum(c in "0123456789" for c in value) >= MIN_DIGITS and (ps := contexts(text, s, e)):
                places.append((-1, s, e, value.lower(), ps))
    return spans, places


PLACE = "struct<kind:int,start:bigint,end:bigint,value:string,patterns:array<string>>"


def scan_texts(docs: DataFrame) -> DataFrame:
    """doc_id, base (array of start, kind, end), places; a row per row of docs."""
    workers_import_this(docs.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            base, places = [], []
            for text in b["text"]:
                s, p = scan(text or "")
                base.append([{"start": a, "rank": k, "kind": KINDS[k], "end": e} for a, k, e in s])
                places.append([{"kind": k, "start": s, "end": e, "value": v, "patterns": ps} for k, s, e, v, ps in p])
            yield pd.DataFrame({"doc_id": b["doc_id"], "base": base, "places": places})

    rows = docs.select(F.col("doc_id").cast("long").cast("string"), F.col("text").cast("string"))
    return exact_ids(rows.mapInPandas(run, f"doc_id string, base array<{SPAN}>, places array<{PLACE}>"))


SPAN = "struct<start:bigint,rank:int,kind:string,end:bigint>"


def bootstrap(edges: DataFrame, rounds: int = ROUNDS, min_seeds: int = MIN_SEEDS, min_precision: float = MIN_PRECISION, min_instance: float = MIN_INSTANCE) -> DataFrame:
    """Accepted unseen instances (value, kind, confidence) of a graph of edges (pattern, value, kind; kind null where unknown).

    Each round scores a pattern for a kind by the share of its distinct
    instances that are known to be of that kind, and its support, accepts
    precise ones, and joins the confidences of an instance's patterns. All
    steps are aggregates and joins with equal keys; only counts leave a pattern.
    """
    spark = edges.sparkSession
    edges = edges.distinct()
    known = edges.where("kind is not null").select("value", "kind").distinct()
    accepted = spark.createDataFrame([], "value string, kind int, confidence double")
    bare = edges.select("pattern", "value").distinct()
    size = bare.groupBy("pattern").agg(F.count("*").alias("n"))
    for _ in range(rounds):
        hits = bare.join(known, "value").groupBy("pattern", "kind").agg(F.count("*").alias("hits"))
        good = hits.where(F.col("hits") >= min_seeds).join(size, "pattern").withColumn("precision", F.col("hits") / F.col("n")).where(F.col("precision") >= min_precision)
        miss = F.sum(F.log(F.lit(1.0) - F.least(F.col("precision"), F.lit(0.999))))
        new = bare.join(known.select("value").distinct(), "value", "left_anti").join(good, "pattern").groupBy("value", "kind").agg((F.lit(1.0) - F.exp(miss)).alias("confidence"))
        new = new.where(F.col("confidence") >= min_instance)
        best = new.groupBy("value").agg(F.max(F.struct("confidence", (-F.col("kind")).alias("k"))).alias("b"))
        new = materialise(best.select("value", (-F.col("b.k")).alias("kind"), F.col("b.confidence").alias("confidence")), "pii-new")
        if new.isEmpty():
            break
        accepted = accepted.unionByName(new)
        known = known.unionByName(new.select("value", "kind"))
    return accepted


def find_personal_data(docs: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, base, found (spans of accepted instances): a row per row of docs.

    Null and empty texts have no spans; repeated rows each get theirs; other columns are ignored.
    """
    rows = materialise(scan_texts(docs).withColumn("row", F.monotonically_increasing_id()), "pii-scan")
    places = rows.select("row", F.explode("places").alias("p")).select("row", "p.*")
    edges = places.select(F.explode("patterns").alias("pattern"), "value", F.when(F.col("kind") >= 0, F.col("kind")).alias("kind"))
    new = bootstrap(edges, rounds)
    kind = F.element_at(F.array(*[F.lit(f"like_{k}") for k in KINDS]), F.col("as") + 1)
    hits = places.where("kind = -1").join(new.select("value", F.col("kind").alias("as")), "value")
    # a row's own places come back together: no more than its text holds
    spans = hits.groupBy("row").agg(F.array_sort(F.collect_set(F.struct("start", (F.col("as") + len(KINDS)).alias("rank"), kind.alias("kind"), "end").cast(SPAN))).alias("found"))
    return rows.drop("places").join(spans, "row", "left").select("doc_id", "base", F.coalesce("found", F.array().cast(f"array<{SPAN}>")).alias("found"))


def written(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def digest(found: DataFrame) -> DataFrame:
    """doc_id, n_<kind>, base_sha256, spans."""
    count = lambda k: F.size(F.filter("base", lambda s: s["rank"] == k)).cast("bigint")
    everything = F.array_sort(F.concat("base", "found"))
    return found.select("doc_id", *[count(k).alias(f"n_{n}") for k, n in enumerate(KINDS)], F.sha2(written(F.col("base")), 256).alias("base_sha256"), written(everything).alias("spans"))
