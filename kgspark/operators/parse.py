"""Documents to located spans and merged units, and statements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from kgspark.functions.exprs import CJK, running, stable_id, token_estimate

#: A unit is closed before the next span once it is estimated at so many tokens.
UNIT_TOKENS = 120
#: Values that a fold gathers before it puts them away.
BLOCK = 128
HEADING = r"^(#{1,6})(?U:\s)+(.*?)(?U:\s)*#*(?U:\s)*$"
LIST_ITEM = r"^(?U:\s)*(?:[-*+]|\d+[.)])(?U:\s)+(.*)$"


def _placed(text: Column) -> Column:
    """start, raw of a text's lines; offsets count code points and one for each line feed."""
    parts = F.split(F.regexp_replace(F.coalesce(text, F.lit("")), "\r\n", "\n"), "\n")

    def rows(p: Column) -> Column:
        starts = running(F.transform(p, lambda x: F.length(x).cast("bigint") + 1))
        return F.transform(F.array(starts), lambda s: F.transform(p, lambda x, i: F.struct(F.get(s, i).cast("int").alias("start"), x.alias("raw"))))[0]

    return F.transform(F.array(parts), rows)[0]


def lines(docs: DataFrame) -> DataFrame:
    """doc_id, line_no, raw, char_start of every non-blank line; offsets count code points and one for each line feed."""
    return docs.select("doc_id", F.posexplode(_placed(F.col("text"))).alias("line_no", "x")).select("doc_id", "line_no", "x.raw", F.col("x.start").alias("char_start")).where(F.trim("raw") != "")


def _span(x: Column) -> Column:
    head = F.regexp_extract(x["raw"], HEADING, 1)
    title = F.trim(F.regexp_extract(x["raw"], HEADING, 2))
    item = F.regexp_extract(x["raw"], LIST_ITEM, 1)
    kind = F.when((head != "") & (title != ""), "heading").when(item != "", "list_item").otherwise("paragraph")
    text = F.when(kind == "heading", title).when(kind == "list_item", F.trim(item)).otherwise(F.trim(x["raw"]))
    end = x["start"] + F.when(kind == "heading", F.length(title)).otherwise(F.length(x["raw"]))
    return F.struct(kind.alias("span_type"), F.substring(text, 1, 4000).alias("text"), F.substring(x["raw"], 1, 4000).alias("raw"), F.length(head).alias("depth"), x["start"].alias("char_start"), end.alias("char_end"))


def _pushed(acc: Column, x: Column) -> list[Column]:
    """done and block of a fold after x: a block of BLOCK values is put away as one, so no step copies all there is."""
    full = F.size(acc["block"]) >= BLOCK
    return [F.when(full, F.concat(acc["done"], F.array(acc["block"]))).otherwise(acc["done"]).alias("done"), F.when(full, F.array(x)).otherwise(F.concat(acc["block"], F.array(x))).alias("block")]


def _all_pushed(acc: Column) -> Column:
    return F.concat(F.flatten(acc["done"]), acc["block"])


def span_arrays(docs: DataFrame) -> DataFrame:
    """doc_id, spans: a document's spans in order, each with the path of headings above it.

    The path is a fold over the headings: one of depth d keeps the first d - 1
    titles and adds its own, so a jump in depth adds one title only. A span takes the path of the last heading up to it.
    """
    none = F.array().cast("array<string>")
    is_head = lambda x: x["span_type"] == "heading"
    once = lambda value, f: F.transform(F.array(value), f)[0]  # noqa: E731 (worked out once, not for each element)

    def path(acc: Column, x: Column) -> Column:
        here = F.concat(F.slice(acc["path"], F.lit(1), F.least(F.size(acc["path"]), x["depth"] - 1)), F.array(x["text"]))
        return F.struct(here.alias("path"), *_pushed(acc, here))

    def paths(flat: Column) -> Column:
        zero = F.struct(none.alias("path"), F.array().cast("array<array<array<string>>>").alias("done"), F.array(none).alias("block"))  # before the first heading the path is empty
        return F.aggregate(F.filter(flat, is_head), zero, path, _all_pushed)

    def full(x: Column, i: Column, a: Column) -> Column:
        at = F.get(a["before"], i) + F.when(is_head(x), 1).otherwise(0)
        return F.struct(*[x[f].alias(f) for f in ("span_type", "text", "raw", "depth", "char_start", "char_end")], F.get(a["paths"], at.cast("int")).alias("heading_path"))

    def rows(flat: Column) -> Column:
        before = running(F.transform(flat, lambda x: F.when(is_head(x), 1).otherwise(0).cast("bigint")))
        return once(F.struct(flat.alias("flat"), paths(flat).alias("paths"), before.alias("before")), lambda a: F.transform(a["flat"], lambda x, i: full(x, i, a)))

    placed = F.filter(_placed(F.col("text")), lambda x: F.trim(x["raw"]) != "")
    return docs.select("doc_id", once(F.transform(placed, _span), rows).alias("spans"))


def spans(docs: DataFrame) -> DataFrame:
    """evidence_spans: doc_id, span_id, order_index, span_type, text, raw, heading_path, char_start, char_end."""
    out = span_arrays(docs).select("doc_id", F.posexplode("spans").alias("order_index", "s"))
    return out.select("doc_id", F.format_string("ES_%05d", "order_index").alias("span_id"), "order_index", "s.span_type", "s.text", "s.raw", "s.heading_path", "s.char_start", "s.char_end")


def units(docs: DataFrame, limit: int = UNIT_TOKENS) -> DataFrame:
    """evidence_units: spans joined in order; a unit ends before a span whose heading path differs, or once it has `limit` tokens.

    doc_id, unit_id, unit_no, text, heading_path, token_count, source_span_ids, merge_reason, char_start, char_end (from its first span's start to its spans' greatest end).

    One fold over numbers decides where units begin: a unit's estimate is that of its pieces, less one for each run of letters that goes over from one piece to the next.
    """
    word = "[A-Za-z0-9]"

    def known(s: Column, i: Column) -> Column:
        t = s["text"]
        differs = (i == 0) | ~F.get(F.col("spans"), i - 1)["heading_path"].eqNullSafe(s["heading_path"])
        return F.struct(F.regexp_count(t, F.lit(CJK)).alias("cjk"), F.regexp_count(t, F.lit(word + "+")).alias("runs"), t.rlike("^" + word).alias("head"), t.rlike(word + r"\z").alias("tail"), (t == "").alias("blank"), differs.alias("differs"), i.alias("i"))

    def step(acc: Column, x: Column) -> Column:
        begins = x["differs"] | (F.floor(F.lit(0.6) * acc["cjk"] + acc["runs"]) >= limit)
        over = F.when(acc["tail"] & x["head"], 1).otherwise(0)
        done, block = _pushed(acc, x["i"])
        return F.struct(
            F.when(begins, x["cjk"]).otherwise(acc["cjk"] + x["cjk"]).alias("cjk"), F.when(begins, x["runs"]).otherwise(acc["runs"] + x["runs"] - over).alias("runs"),
            F.when(x["blank"] & ~begins, acc["tail"]).otherwise(x["tail"]).alias("tail"), F.when(begins, done).otherwise(acc["done"]).alias("done"), F.when(begins, block).otherwise(acc["block"]).alias("block"),
        )

    zero = F.struct(F.lit(0).alias("cjk"), F.lit(0).alias("runs"), F.lit(False).alias("tail"), F.array().cast("array<array<int>>").alias("done"), F.array().cast("array<int>").alias("block"))
    begins = F.aggregate(F.transform("spans", known), zero, step, _all_pushed)
    cut = lambda at: F.transform(at, lambda s, k: F.struct(s.alias("first"), F.transform(F.sequence(s, F.coalesce(F.get(at, k + 1), F.size("spans")) - 1), lambda j: F.get(F.col("spans"), j)).alias("spans")))
    out = span_arrays(docs).select("doc_id", F.posexplode(F.transform(F.array(begins), cut)[0]).alias("unit_no", "u"))
    each = lambda f: F.transform("u.spans", lambda s: s[f])
    text = F.substring(F.trim(F.array_join(each("text"), "")), 1, 8000)
    reasons = F.when(F.size("u.spans") == 1, F.array().cast("array<string>")).otherwise(F.array_compact(F.array(F.lit("same_heading"), F.when(F.array_contains(each("span_type"), "list_item"), F.lit("list_context")))))
    return out.select(
        "doc_id", F.format_string("EU_%05d", "unit_no").alias("unit_id"), "unit_no", text.alias("text"), F.get("u.spans", F.lit(0))["heading_path"].alias("heading_path"), token_estimate(text).alias("token_count"),
        F.transform("u.spans", lambda s, i: F.format_string("ES_%05d", F.col("u.first") + i)).alias("source_span_ids"), reasons.alias("merge_reason"), F.array_min(each("char_start")).alias("char_start"), F.array_max(each("char_end")).alias("char_end"),
    )


def statements(docs: DataFrame, first: int = 200, least: int = 8) -> DataFrame:
    """Statements from a document's first spans of some length; a text repeated in a document counts once, at its first place."""
    s = spans(docs).where((F.col("order_index") < first) & (F.length(F.trim("text")) >= least))
    one = F.row_number().over(Window.partitionBy("doc_id", "text").orderBy("order_index"))
    return s.withColumn("k", one).where("k = 1").select(stable_id("stmt", "doc_id", "text").alias("statement_id"), "doc_id", F.col("text").alias("statement_text"), F.lit("observation").alias("statement_class"), "span_id", "order_index", "heading_path")
