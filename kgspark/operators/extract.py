"""Rule extraction: candidates, mentions and relations from units, as exploded regular expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from kgspark.functions.exprs import normalize_name, normalize_text, stable_hash

#: The rules' patterns (kind, pattern, confidence, method) and the relation triggers.
RULES = (
    ("metric", r"(\d+(?:\.\d+)?)(?U:\s)*(%|％|亿元人民币|亿元|万元|万|亿|美元|元|人|家|个|台|套|项|倍)", 0.85, "regex:numeric_metric"),
    ("statement", r"\b(20\d{2})[-/.年](\d{1,2})[-/.月](\d{1,2})?日?|20\d{2}年(?:第[一二三四]?季度|上半年|下半年)\b", 0.9, "regex:date"),
    ("version", r"\b[Vv](\d+(?:\.\d+)+)\b|\b(\d+\.\d+\.\d+)\b", 0.9, "regex:version"),
    ("certification", r"(ISO(?U:\s)*27001|ISO(?U:\s)*27002|ISO(?U:\s)*27017|ISO(?U:\s)*27018|ISO(?U:\s)*9001|等保三级|国家高新技术企业|CMMI(?U:\s)*[0-9]|SOC(?U:\s)*2|可信云|云服务安全评估)", 0.9, "regex:certification"),
    ("url", r"https?://[^\s，。；]+", 0.95, "regex:url"),
)
TRIGGERS = (
    ("offers", "提供|推出|上线|发布|支持"),
    ("capability", "具备|拥有|支持能力|具备能力"),
    ("certification", "获得|取得|通过|认证"),
    ("targets", "面向|服务|针对|覆盖"),
)
#: Patterns of mentions.
ORGANIZATION = r"[一-鿿A-Za-z0-9·（）()\s]{2,32}?(?:有限公司|公司|集团)"
PRODUCT = r"[A-Za-z0-9一-鿿·（）()\-\s]{2,32}?(?:平台|系统|智能体|工厂|解决方案|产品)"
PRODUCT_CUT = r"^.*?(?:提供|推出|上线|发布|支持|具备|拥有|包括|面向|服务|针对|覆盖)"
CAPABILITY = r"(?:支持|提供|具备|拥有|包括)([^。；\n]{2,160})"
CAPABILITY_CUT = r"(?:面向|服务|针对|覆盖|获得|取得|通过).*$"
AUDIENCE = r"(?:面向|服务|针对|覆盖)([^。；\n]{2,100})"
ITEM_SPLIT = r"[、,，/；;|]|(?U:\s)+和(?U:\s)+|(?U:\s)+及(?U:\s)+"
ITEM_VERB = r"^(包括|主要包括|支持|提供|具备|拥有|面向|服务|针对|覆盖)(?U:\s)*"
#: Risk classes with severity and markers.
RISKS = (
    ("absolute_claim", 2, ("唯一", "首个", "第一", "最全", "最准", "最好", "最佳", "名列前茅", "无可比拟")),
    ("financial_kpi", 2, ("ROI", "投资回报", "增长率", "市场份额", "营收", "利润率", "%提升", "省  ")),
    ("certification_claim", 2, ("认证", "资质", "ISO", "等保", "安全评估", "可信云")),
    ("competitor_denigration", 1, ("竞品", "短板", "优于对手", "竞对", "碾压", "吊打")),
    ("compliance_signal", 1, ("合规", "监管", "处罚", "诉讼", "召回", "资质受限")),
    ("customer_specific", 1, ("客户名", "招投标", "中标", "合同金额", "订单")),
)

CANDIDATE = "struct<rule:int,kind:string,value:string,confidence:double,method:string>"


def _candidate(rule: int, kind: str, confidence: float, method: str) -> Callable[[Column], Column]:
    return lambda v: F.struct(F.lit(rule), F.lit(kind), v, F.lit(confidence), F.lit(method)).cast(CANDIDATE)


def rule_matches(text: Column) -> Column:
    """All rules' matches in a text, by rule, then place; a trigger class gives one row at most."""
    found = []
    for k, (kind, pattern, confidence, method) in enumerate(RULES):
        hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
        found.append(F.transform(hits, _candidate(k, kind, confidence, method)))
    for k, (name, pattern) in enumerate(TRIGGERS):
        hit = F.regexp_extract(text, f"({pattern})", 1)
        row = _candidate(len(RULES) + k, "relation", 0.6, f"regex:trigger:{name}")(F.lit(name))
        found.append(F.when(hit != "", F.array(row)).otherwise(F.array().cast(f"array<{CANDIDATE}>")))
    return F.flatten(F.array(*found))


def candidates(units: DataFrame) -> DataFrame:
    """doc_id, unit_id, ord, kind, value, confidence, method of all rule matches in units (doc_id, unit_id, text)."""
    out = units.select("doc_id", "unit_id", F.posexplode(rule_matches(F.coalesce("text", F.lit("")))).alias("ord", "c"))
    return out.select("doc_id", "unit_id", "ord", "c.kind", "c.value", "c.confidence", "c.method")


#: What the older runtime calls the kinds.
ROW_KINDS = {"numeric_metric": "metric", "certification": "statement", "version": "statement", "url": "statement", "date": "event"}


def capped(cands: DataFrame, per_unit: int = 12) -> DataFrame:
    """Candidate rows of the older runtime: id from document, kind, method and value; the first of an id in a unit, and 12 a unit."""
    mapped = F.element_at(F.create_map(*[F.lit(x) for pair in ROW_KINDS.items() for x in pair]), F.col("kind"))
    ided = cands.where("kind <> 'entity'").withColumn("candidate_type", F.coalesce(mapped, F.col("kind")))
    ided = ided.withColumn("candidate_id", F.concat(F.lit("KC_"), F.col("doc_id").cast("string"), F.lit("_"), stable_hash("kind", "method", "value")))
    first = F.row_number().over(Window.partitionBy("doc_id", "unit_id", "candidate_id").orderBy("ord"))
    rank = F.row_number().over(Window.partitionBy("doc_id", "unit_id").orderBy("ord"))
    return ided.withColumn("k", first).where("k = 1").withColumn("k", rank).where(F.col("k") <= per_unit).drop("k")


def items(value: Column) -> Column:
    """A listing cut into its items: verbs at the front off, 2 to 48 characters, each once, 20 at most."""
    cut = F.transform(F.split(value, ITEM_SPLIT, -1), lambda x: F.regexp_replace(normalize_text(x), ITEM_VERB, ""))
    return F.slice(F.array_distinct(F.filter(cut, lambda x: F.length(x).between(2, 48))), 1, 20)


def mentions(units: DataFrame, types: list[str], brand: Column | None = None) -> DataFrame:
    """Entity mentions of units in their order: doc_id, unit_id, ord, entity_type, name.

    A mention counts once for its type and normalised name; a capability whose name any earlier mention has is left out.
    """
    one = "struct<source:int,entity_type:string,name:string>"
    row = lambda k, t, v: F.struct(F.lit(k), F.lit(t), v).cast(one)
    text = F.coalesce("text", F.lit(""))
    orgs = F.transform(F.regexp_extract_all(text, F.lit("(?U)" + ORGANIZATION), F.lit(0)), lambda v: row(1, "organization", v))
    products = F.transform(F.regexp_extract_all(text, F.lit("(?U)" + PRODUCT), F.lit(0)), lambda v: row(2, "product", F.regexp_replace(v, "(?s)" + PRODUCT_CUT, "")))
    abilities = F.transform(F.flatten(F.transform(F.regexp_extract_all(text, F.lit(CAPABILITY), F.lit(1)), lambda s: items(F.regexp_replace(s, CAPABILITY_CUT, "")))), lambda v: row(3, "capability", v))
    audiences = F.transform(F.flatten(F.transform(F.regexp_extract_all(text, F.lit(AUDIENCE), F.lit(1)), items)), lambda v: row(4, "audience", v))
    parts = [orgs, products, abilities, audiences]
    if brand is not None:
        parts.insert(0, F.when(brand.isNotNull(), F.array(row(0, "brand", brand))).otherwise(F.array().cast(f"array<{one}>")))
    out = units.select("doc_id", "unit_id", F.posexplode(F.flatten(F.array(*parts))).alias("ord", "m")).select("doc_id", "unit_id", "ord", "m.*")
    name = F.regexp_replace(normalize_text("name"), "^[:：，,、;；。]+|[:：，,、;；。]+$", "")
    out = out.withColumn("name", name).where((F.col("name") != "") & F.col("entity_type").isin(types)).withColumn("key", normalize_name("name"))
    first = F.row_number().over(Window.partitionBy("doc_id", "unit_id", "entity_type", "key").orderBy("ord"))
    before = F.min("ord").over(Window.partitionBy("doc_id", "unit_id", "key"))
    out = out.withColumn("k", first).withColumn("before", before).where("k = 1 and (entity_type <> 'capability' or before = ord)")
    return out.select("doc_id", "unit_id", "ord", "entity_type", "name", "key")


def relations(found: DataFrame, allowed: list[str]) -> DataFrame:
    """Rule relations of a unit's mentions: its anchor (first brand, else organisation) offers products, which have capabilities; it serves audiences."""
    keys = ["doc_id", "unit_id"]
    rank = F.when(F.col("entity_type") == "brand", 0).otherwise(1)
    anchors = found.where(F.col("entity_type").isin("brand", "organization")).groupBy(*keys).agg(F.min(F.struct(rank.alias("r"), "ord", "name", "key", "entity_type")).alias("a")).select(*keys, F.col("a.name").alias("subject"), F.col("a.key").alias("subject_key"), F.col("a.entity_type").alias("subject_type"))
    of = lambda t: found.where(F.col("entity_type") == t).select(*keys, F.col("name").alias("object"), F.col("key").alias("object_key"), F.lit(t).alias("object_type"))
    products = found.where("entity_type = 'product'").select(*keys, F.col("name").alias("subject"), F.col("key").alias("subject_key"), F.lit("product").alias("subject_type"))
    anchored = anchors.select(*keys).distinct()
    parts = [
        anchors.join(of("product"), keys).withColumn("relation", F.lit("offers")),
        products.join(anchored, keys, "left_semi").join(of("capability"), keys).withColumn("relation", F.lit("has_capability")),
        anchors.join(products.select(*keys).distinct(), keys, "left_anti").join(of("capability"), keys).withColumn("relation", F.lit("has_capability")),
        anchors.join(of("audience"), keys).withColumn("relation", F.lit("serves")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.where((F.col("subject_key") != F.col("object_key")) & F.col("relation").isin(allowed)).withColumn("confidence", F.lit(0.68))


def risks(docs: DataFrame) -> DataFrame:
    """doc_id, warning_type, severity, matched, hits, action for each risk class with a marker in the text (any case)."""
    low = F.lower(F.coalesce("text", F.lit("")))
    rows = [F.struct(F.lit(n).alias("warning_type"), F.lit(s).alias("severity"), F.filter(F.array(*[F.lit(m) for m in ms]), lambda m: F.contains(low, F.lower(m))).alias("matched")) for n, s, ms in RISKS]
    out = docs.select("doc_id", F.explode(F.array(*rows)).alias("r")).select("doc_id", "r.*").where(F.size("matched") > 0)
    action = F.when(F.col("severity") >= 2, "review_before_publication").when(F.col("severity") == 1, "flag_for_disclosure").otherwise("note")
    return out.withColumn("hits", F.size("matched")).withColumn("action", action)


def high_risk(statement: Column, quotes: Column, markers: list[str]) -> Column:
    """Whether a statement or its first quote holds a marker."""
    text = F.concat_ws(" ", statement, F.get(quotes, F.lit(0)))
    return F.exists(F.array(*[F.lit(m) for m in markers]), lambda m: F.contains(text, m))
