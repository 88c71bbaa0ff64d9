"""Secret scans over a ledger of content-addressed blobs, in DataFrame expressions only.

A version of a file is a (path, text) row; its blob is the SHA-256 of the text.
The ledger holds one row per scanned (blob, rule version). A scan takes the
blobs of all versions, leaves out pairs the ledger has, reads one copy of each
unseen blob, appends what it finds, and joins findings back to every path that
ever held the blob. Where few blobs are new, the planner broadcasts their keys
and no text is shuffled.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from kgspark.session import scratch


@dataclass(frozen=True)
class Rule:
    """A kind of secret: pattern, the group whose length counts (0: the whole match), its least length, a test that every text with a match passes, and strings of which such a text holds one (none: not said)."""

    kind: str
    pattern: str
    group: int
    least: int
    anchor: str
    needles: tuple[str, ...] = ()

    @property
    def long_enough(self) -> str:
        """The pattern, cut to matches that are long enough: a run's longest match starts where its short prefix would."""
        if self.group or not self.pattern.endswith("+"):
            return self.pattern
        fixed = {"access": len("AKIA"), "vcs": len("ghp_")}.get(self.kind, 0)
        return self.pattern[:-1] + "{%d,}" % (self.least - fixed)

    def may_match(self, text: Column) -> Column:
        test = text.rlike(self.anchor)
        for k, needle in enumerate(self.needles):
            held = text.contains(needle) if k == 0 else held | text.contains(needle)
        return held & test if self.needles else test


#: The three base kinds, in their order.
BASE = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]""", (":", "=")),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20, r"AKIA[A-Z0-9]{16}", ("AKIA",)),
    Rule("hex", r"[0-9a-f]+", 0, 24, r"[0-9a-f]{24}"),
)
#: Kinds of our own, whose spans come after the base ones.
MORE = (
    Rule("pem", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----", 0, 1, r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----", ("PRIVATE KEY-----",)),
    Rule("vcs", r"gh[pousr]_[A-Za-z0-9]+", 0, 40, r"gh[pousr]_[A-Za-z0-9]{36}", ("ghp_", "gho_", "ghu_", "ghs_", "ghr_")),
)
RULES = BASE + MORE
VERSION = "rules-1"

SPAN = "struct<start:bigint,rank:int,kind:string,end:bigint>"


def spans_of(text: Column, rule: Rule, rank: int) -> Column:
    """Spans of a rule's matches in code points, leftmost and non-overlapping, short ones dropped.

    split() gives the pieces between the matches that regexp_extract_all()
    gives, so running sums of their lengths are the matches' places.
    """
    pattern = rule.long_enough
    whole = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.length)
    counted = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(rule.group)), F.length)
    gaps = F.transform(F.split(text, pattern, -1), F.length)
    steps = F.arrays_zip(gaps.alias("gap"), whole.alias("len"), counted.alias("n"))
    none = F.lit(None).cast(f"array<{SPAN}>")
    zero = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast(f"array<{SPAN}>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["gap"]
        span = F.struct(start.alias("start"), F.lit(rank).alias("rank"), F.lit(rule.kind).alias("kind"), (start + x["len"]).alias("end"))
        hit = x["n"] >= (rule.least if rule.group else 1)
        return F.struct((start + F.coalesce(x["len"], F.lit(0))).cast("bigint").alias("at"), F.when(hit, F.concat(acc["out"], F.array(span.cast(SPAN)))).otherwise(acc["out"]).alias("out"))

    return F.when(rule.may_match(text), F.aggregate(steps, zero, step, lambda acc: acc["out"])).otherwise(F.coalesce(none, F.array().cast(f"array<{SPAN}>")))


def all_spans(text: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """Spans of all kinds, by start, then kind in the rules' order."""
    return F.array_sort(F.flatten(F.array(*[spans_of(text, r, k) for k, r in enumerate(rules)])))


def written(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def merged(spans: Column) -> Column:
    """Spans (by start) as runs of overlapping or adjoining ones: start, end."""
    run = "struct<start:bigint,end:bigint>"
    zero = F.struct(F.lit(None).cast(run).alias("last"), F.array().cast(f"array<{run}>").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        joins = s["start"] <= acc["last"]["end"]
        longer = F.struct(acc["last"]["start"].alias("start"), F.greatest(acc["last"]["end"], s["end"]).alias("end"))
        own = F.struct(s["start"].alias("start"), s["end"].alias("end"))
        done = F.when(joins | acc["last"].isNull(), acc["out"]).otherwise(F.concat(acc["out"], F.array(acc["last"])))
        return F.struct(F.when(joins, longer).otherwise(own).cast(run).alias("last"), done.alias("out"))

    return F.aggregate(spans, zero, step, lambda acc: F.when(acc["last"].isNull(), acc["out"]).otherwise(F.concat(acc["out"], F.array(acc["last"]))))


def redact(text: Column, spans: Column, mask: str = "[SECRET]") -> Column:
    """The text with each run of overlapping spans replaced by the mask: the pieces between the runs, joined by it."""
    runs = F.concat(merged(spans), F.array(F.struct((F.length(text) + F.lit(0)).cast("bigint").alias("start"), F.lit(0).cast("bigint").alias("end"))))

    def pieces(runs: Column) -> Column:
        ends = F.concat(F.array(F.lit(0).cast("bigint")), F.transform(runs, lambda r: r["end"]))
        return F.array_join(F.transform(runs, lambda r, i: F.substring(text, (F.get(ends, i) + 1).cast("int"), (r["start"] - F.get(ends, i)).cast("int"))), mask)

    return F.transform(F.array(runs), pieces)[0]  # worked out once


def blob_of(text: Column) -> Column:
    return F.sha2(text, 256)


def anchored(text: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """Whether any rule's cheap test holds; no other text has a span."""
    test = F.lit(False)
    for r in rules:
        test = test | r.may_match(text)
    return test


LEDGER = f"blob string, version string, spans array<{SPAN}>"


def scan_new(versions: DataFrame, ledger: str, rules: tuple[Rule, ...] = RULES, version: str = VERSION, first_run: bool = False) -> DataFrame:
    """Scan blobs of versions(path, text) whose (blob, version) pair the ledger lacks, append them, and return the ledger.

    Null texts count as empty. Any number of paths and repeated rows may share a
    blob: one copy is scanned. Paths may be null, other columns are ignored. Only texts that pass a rule's cheap
    test are moved, one copy of each from a task; the others enter the ledger without spans. ledger is a Parquet folder (blob, version, spans)
    on the shared store; a scan that failed leaves no rows there, so it can be run again.
    """
    spark = versions.sparkSession
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = versions.select(text.alias("text"), blob_of(text).alias("blob"))
    if not first_run:
        seen = spark.read.schema(LEDGER).parquet(ledger).where(F.col("version") == version).select("blob")
        rows = rows.join(seen, "blob", "left_anti")
    hits = rows.where(anchored(F.col("text"), rules)).groupBy("blob").agg(F.any_value("text").alias("text"))
    hits = hits.select("blob", F.lit(version).alias("version"), all_spans(F.col("text"), rules).alias("spans"))
    rest = rows.where(~anchored(F.col("text"), rules)).select("blob").distinct()
    fresh = hits.unionByName(rest.select("blob", F.lit(version).alias("version"), F.array().cast(f"array<{SPAN}>").alias("spans")))
    fresh.write.mode("append").parquet(ledger)
    return spark.read.schema(LEDGER).parquet(ledger)


def findings(versions: DataFrame, ledger: DataFrame, version: str = VERSION, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Every row of versions (path, text, ...) with blob and the spans of its blob (an empty array where nothing was found).

    Other columns stay, but for ones named blob and spans, which are replaced. Only rows that pass a rule's cheap test meet the ledger; the others stay where they are.
    """
    other = [F.col(f"`{c}`") for c in versions.columns if c.lower() not in ("blob", "spans")]
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    found = ledger.where((F.col("version") == version) & (F.size("spans") > 0)).dropDuplicates(["blob"]).select("blob", "spans")
    rows = versions.select(*other, blob_of(text).alias("blob"))
    none = F.array().cast(f"array<{SPAN}>")
    hits = rows.where(anchored(text, rules)).join(found, "blob", "left")
    hits = hits.select(*other, "blob", F.coalesce("spans", none).alias("spans"))
    return hits.unionByName(rows.where(~anchored(text, rules)).withColumn("spans", none))


def scan_documents(docs: DataFrame, ledger: str | None = None) -> DataFrame:
    """Findings for documents (doc_id, text): doc_id, blob, spans. Without a ledger, a new one is begun in the shared folder."""
    spark: SparkSession = docs.sparkSession
    versions = docs.select(F.col("doc_id").alias("path"), F.col("text").cast("string").alias("text"))
    scanned = scan_new(versions, ledger or scratch(spark, "ledger"), first_run=ledger is None)
    return findings(versions, scanned).select(F.col("path").alias("doc_id"), "blob", "spans")


def digest(found: DataFrame) -> DataFrame:
    """doc_id, n_<base kind>, base_sha256, spans."""
    base = F.filter("spans", lambda s: s["rank"] < len(BASE))
    count = lambda k: F.size(F.filter("spans", lambda s: s["rank"] == k)).cast("bigint")
    return found.select("doc_id", *[count(k).alias(f"n_{r.kind}") for k, r in enumerate(BASE)], F.sha2(written(base), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"))


def redact_documents(docs: DataFrame) -> DataFrame:
    """docs with secrets masked in text and n_chars, where it stands there, set anew.

    Columns (whatever their names), rows, repeated and null ids stay; null and empty texts stay as they are.
    """
    spark = docs.sparkSession
    versions = docs.select(F.struct("*").alias("row"), F.col("text").cast("string").alias("text"), F.col("doc_id").alias("path"))
    scanned = scan_new(versions, scratch(spark, "ledger"), first_run=True)
    masked = F.when(F.size("spans") > 0, redact(F.col("text"), F.col("spans"))).otherwise(F.col("row.text"))
    rows = findings(versions, scanned).withColumn("text", masked)
    row = F.col("row").withField("text", F.col("text"))
    if "n_chars" in docs.columns:
        length = F.length("text").cast(docs.schema["n_chars"].dataType)
        row = row.withField("n_chars", F.when(F.size("spans") > 0, length).otherwise(F.col("row.n_chars")))
    return rows.select(row.alias("row")).select("row.*")
