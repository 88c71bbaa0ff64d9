"""Scalar functions as column expressions: ids, names, hashes, numbers."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Marks removed from names, and trailing marks cut from display names.
NAME_MARKS = r"[\s，,、。;；：:]+"
TAIL_MARKS = r"[。；，、]+$"
CJK = "[\u4e00-\u9fff]"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def stable_id(prefix: str, *parts: Column | str) -> Column:
    """prefix_ and 20 hex digits of the SHA-256 of the parts joined by U+001F; null and empty parts count as empty."""
    joined = F.concat_ws("\u001f", *[F.coalesce(_col(p).cast("string"), F.lit("")) for p in parts])
    return F.concat(F.lit(prefix + "_"), F.substring(F.sha2(joined, 256), 1, 20))


def stable_hash(*parts: Column | str) -> Column:
    """16 hex digits of the SHA-256 of the parts joined by ::; null counts as empty."""
    return F.substring(F.sha2(F.concat_ws("::", *[F.coalesce(_col(p).cast("string"), F.lit("")) for p in parts]), 256), 1, 16)


def content_hash(text: Column | str) -> Column:
    return F.sha2(_col(text), 256)


def normalize_text(c: Column | str) -> Column:
    """Runs of white space become one space; ends are cut."""
    return F.trim(F.regexp_replace(_col(c), r"(?U)\s+", " "))


def normalized_name(c: Column | str) -> Column:
    """The key of entities: normalised text in lower case."""
    return F.lower(normalize_text(c))


def normalize_name(c: Column | str) -> Column:
    """The key of candidates: no white space or separating marks, lower case."""
    return F.lower(F.regexp_replace(_col(c), "(?U)" + NAME_MARKS, ""))


def display_name(c: Column | str) -> Column:
    return F.regexp_replace(normalize_text(c), TAIL_MARKS, "")


def metric_number(c: Column | str) -> Column:
    """A signed decimal as double, else null; the text itself stays for other values."""
    s = F.trim(_col(c))
    return F.when(s.rlike(r"^[+-]?\d+(?:\.\d+)?$"), s.cast("double"))


def candidate_key(kind: Column, subject: Column, predicate: Column, obj: Column, value: Column) -> Column:
    """entity: type and name; relation: both names and the relation; others: type and normalised text or value."""
    return (
        F.when(kind == "entity", F.concat_ws("::", F.lit("entity"), normalize_name(subject)))
        .when(kind == "relation", F.concat_ws("::", F.lit("relation"), normalize_name(subject), predicate, normalize_name(obj)))
        .otherwise(F.concat_ws("::", kind, normalize_name(F.coalesce(value, subject, F.lit("")))))
    )


def upper_snake(c: Column | str) -> Column:
    return F.upper(F.regexp_replace(_col(c), r"[^0-9A-Za-z]+", "_"))


def pascal(c: Column | str) -> Column:
    return F.array_join(F.transform(F.split(_col(c), r"[^0-9A-Za-z]+"), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1 << 20))), "")


def slug(c: Column | str) -> Column:
    """Lower-case letters and digits, 40 at most, or unnamed."""
    s = F.substring(F.regexp_replace(F.lower(_col(c)), r"[^a-z0-9]+", ""), 1, 40)
    return F.when(F.coalesce(s, F.lit("")) == "", F.lit("unnamed")).otherwise(s)


def clamp_progress(c: Column | str) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(100), _col(c)))


def duplicate_rate(deprecated: Column, active: Column) -> Column:
    """Share of deprecated rows to four places, 0 where there are none."""
    total = deprecated + active
    return F.when(total > 0, F.round(deprecated / total, 4)).otherwise(F.lit(0.0))


def token_estimate(c: Column | str) -> Column:
    """0.6 for each CJK character and 1 for each run of letters or digits, cut to a whole number."""
    t = F.coalesce(_col(c), F.lit(""))
    return F.floor(F.lit(0.6) * F.regexp_count(t, F.lit(CJK)) + F.regexp_count(t, F.lit("[A-Za-z0-9]+"))).cast("int")


def layer_of(owner: Column, industry: Column) -> Column:
    """L3 with an owner or brand, L2 with an industry, else L1."""
    return F.when(owner.isNotNull(), "L3").when(industry.isNotNull(), "L2").otherwise("L1")


def merged_scope(left: Column, right: Column) -> Column:
    """Maps joined, the right one's values win."""
    return F.map_concat(F.map_filter(left, lambda k, v: ~F.map_contains_key(right, k)), right)


def json_or(c: Column, schema: str, default: Column) -> Column:
    """A JSON column decoded, or the default where it is null, empty or broken."""
    return F.coalesce(F.when(F.try_parse_json(c).isNotNull(), F.from_json(c, schema)), default)


def json_object_text(c: Column) -> Column:
    """From the first { to the last } of a model's answer, code fences left out."""
    return F.regexp_extract(c, r"(?s)(\{.*\})", 1)


#: Media types by file ending.
MIME = {"md": "text/markdown", "markdown": "text/markdown", "txt": "text/plain", "html": "text/html", "htm": "text/html", "pdf": "application/pdf"}


def mime_type(path: Column | str) -> Column:
    ending = F.lower(F.regexp_extract(_col(path), r"\.([A-Za-z0-9]+)$", 1))
    table = F.create_map(*[F.lit(x) for kv in MIME.items() for x in kv])
    return F.coalesce(F.element_at(table, ending), F.lit("application/octet-stream"))


def is_markdown(path: Column | str, mime: Column | None = None) -> Column:
    by_name = F.lower(_col(path)).rlike(r"\.(md|markdown)$")
    return by_name if mime is None else by_name | mime.isin("text/markdown", "text/x-markdown")


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity of two arrays of numbers, in doubles."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def uuid5_url(name: Column | str) -> Column:
    """The name-based UUID (version 5) in the URL namespace."""
    h = F.sha1(F.concat(F.unhex(F.lit("6ba7b8119dad11d180b400c04fd430c8")), F.encode(_col(name), "UTF-8")))
    variant = F.lower(F.hex(F.conv(F.substring(h, 17, 1), 16, 10).cast("int").bitwiseAND(3).bitwiseOR(8)))
    part = lambda at, n: F.substring(h, at, n)
    return F.concat(part(1, 8), F.lit("-"), part(9, 4), F.lit("-5"), part(14, 3), F.lit("-"), variant, part(18, 3), F.lit("-"), part(21, 12))


def running(sizes: Column, block: int = 256) -> Column:
    """Sums of the elements before each one (bigint), worked out in blocks so that long arrays aren't copied at every step."""
    array = "array<bigint>"
    zero = lambda at: F.struct(at.cast("bigint").alias("at"), F.array().cast(array).alias("out"))
    step = lambda acc, x: F.struct((acc["at"] + x).cast("bigint").alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out"))

    def placed(blocks: Column) -> Column:
        sums = F.transform(blocks, lambda b: F.aggregate(b, F.lit(0).cast("bigint"), lambda a, x: a + x))
        bases = F.aggregate(sums, zero(F.lit(0)), step, lambda acc: acc["out"])
        return F.transform(F.array(bases), lambda at: F.flatten(F.transform(blocks, lambda b, i: F.aggregate(b, zero(F.get(at, i)), step, lambda acc: acc["out"]))))[0]

    def cut(x: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.floor((F.size(x) - 1) / block).cast("int")), lambda b: F.slice(x, b * block + 1, F.lit(block)))

    def sums(x: Column) -> Column:
        return F.when(F.size(x) > 0, F.transform(F.array(cut(x)), placed)[0]).otherwise(F.array().cast(array))

    return F.transform(F.array(sizes), sums)[0]
