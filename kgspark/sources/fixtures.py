"""The driver's tables in the shapes of the knowledge store; SQL texts give the same rows to DuckDB."""

from __future__ import annotations

from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession, functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def placed(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table with kg_place, a row's number in it (files by their names, then rows as they stand): among rows that an order leaves equal, the table's first one is first."""
    rows = table(spark, sf_dir, name)
    files = sorted(rows.inputFiles(), key=unquote)
    if len(files) < 2:
        return rows.withColumn("kg_place", F.col("_metadata.row_index"))
    # Spark names a local file file:///x here and file:/x in a row
    names = {name: n for n, f in enumerate(files) for name in (f, f.replace(":///", ":/", 1))}
    numbers = spark.createDataFrame(list(names.items()), "kg_file string, kg_number long")
    rows = rows.withColumns({"kg_row": F.col("_metadata.row_index"), "kg_file": F.col("_metadata.file_path")}).join(F.broadcast(numbers), "kg_file", "left")
    number = F.coalesce("kg_number", F.raise_error(F.concat(F.lit("file without a number: "), "kg_file")).cast("long"))
    return rows.withColumn("kg_place", F.shiftleft(number, 40) + F.col("kg_row")).drop("kg_file", "kg_row", "kg_number")


def entities(spark: SparkSession, d: str) -> DataFrame:
    """id, type, name, layer, brand_id, status, updated_at (a day number) from parts, suppliers, customers, nations and regions."""
    part = table(spark, d, "part")

    def of(df: DataFrame, kind: str, key: str, name: str, brand: str = "null", layer: str = "'l2_industry'") -> DataFrame:
        return df.selectExpr(f"concat('{kind}_', {key}) as id", f"'{kind}' as type", f"{name} as name", f"{layer} as layer", f"cast({brand} as string) as brand_id", f"cast({key} as string) as k")

    rows = of(part, "product", "p_partkey", "p_name", "concat('brand_', p_brand)", "if(p_size > 25, 'l3_brand', 'l2_industry')")
    for df, args in (
        (part.select("p_brand").distinct(), ("brand", "p_brand", "p_brand", "concat('brand_', p_brand)")), (part.select("p_type").distinct(), ("category", "p_type", "p_type")),
        (table(spark, d, "supplier"), ("organization", "s_suppkey", "s_name")), (table(spark, d, "customer"), ("audience", "c_custkey", "c_name")),
        (table(spark, d, "nation"), ("regional_market", "n_nationkey", "n_name")), (table(spark, d, "region"), ("industry", "r_regionkey", "r_name")),
    ):
        rows = rows.unionByName(of(df, *args))
    n = F.expr("try_cast(k as bigint)")
    return rows.withColumn("status", F.when(F.coalesce(n % 10 == 0, F.lit(False)), "deprecated").otherwise("active")).withColumn("updated_at", F.coalesce(n, F.lit(0))).drop("k")


ENTITIES = """
select id, type, name, layer, brand_id,
  case when coalesce(try_cast(k as bigint) % 10 = 0, false) then 'deprecated' else 'active' end as status, coalesce(try_cast(k as bigint), 0) as updated_at
from (
  select 'product_' || p_partkey as id, 'product' as type, p_name as name, case when p_size > 25 then 'l3_brand' else 'l2_industry' end as layer, 'brand_' || p_brand as brand_id, p_partkey::varchar as k from part
  union all select 'brand_' || p_brand, 'brand', p_brand, 'l2_industry', 'brand_' || p_brand, p_brand from (select distinct p_brand from part)
  union all select 'category_' || p_type, 'category', p_type, 'l2_industry', null, p_type from (select distinct p_type from part)
  union all select 'organization_' || s_suppkey, 'organization', s_name, 'l2_industry', null, s_suppkey::varchar from supplier
  union all select 'audience_' || c_custkey, 'audience', c_name, 'l2_industry', null, c_custkey::varchar from customer
  union all select 'regional_market_' || n_nationkey, 'regional_market', n_name, 'l2_industry', null, n_nationkey::varchar from nation
  union all select 'industry_' || r_regionkey, 'industry', r_name, 'l2_industry', null, r_regionkey::varchar from region)
"""


def relations(spark: SparkSession, d: str) -> DataFrame:
    """source_id, target_id, relation_type, created_at: brands offer products, these belong to categories and are active in nations."""
    part = table(spark, d, "part")
    offers = part.selectExpr("concat('brand_', p_brand) as source_id", "concat('product_', p_partkey) as target_id", "'offers' as relation_type", "p_partkey as created_at")
    belongs = part.selectExpr("concat('product_', p_partkey) as source_id", "concat('category_', p_type) as target_id", "'belongs_to' as relation_type", "p_partkey as created_at")
    sold = table(spark, d, "lineitem").select("l_partkey", "l_suppkey").join(table(spark, d, "supplier").select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
    sold = sold.select("l_partkey", "s_nationkey").distinct()  # of numbers, before they become texts
    active = sold.selectExpr("concat('product_', l_partkey) as source_id", "concat('regional_market_', s_nationkey) as target_id", "'active_in' as relation_type", "l_partkey as created_at")
    return offers.unionByName(belongs).unionByName(active)


RELATIONS = """
select 'brand_' || p_brand as source_id, 'product_' || p_partkey as target_id, 'offers' as relation_type, p_partkey as created_at from part
union all select 'product_' || p_partkey, 'category_' || p_type, 'belongs_to', p_partkey from part
union all select distinct 'product_' || l_partkey, 'regional_market_' || s_nationkey, 'active_in', l_partkey from lineitem join supplier on l_suppkey = s_suppkey
"""


def outbox(spark: SparkSession, d: str) -> DataFrame:
    """id, aggregate_type, aggregate_id, event_type, created_at, processed: errors delete, other events upsert, the first half is processed."""
    return table(spark, d, "events").selectExpr("event_id as id", "'entity' as aggregate_type", "user_id as aggregate_id", "if(event_type = 'error', 'delete', 'upsert') as event_type", "ts as created_at", "ts < timestamp_ntz'2024-01-15' as processed")


OUTBOX = "select event_id as id, 'entity' as aggregate_type, user_id as aggregate_id, case when event_type = 'error' then 'delete' else 'upsert' end as event_type, ts as created_at, ts < timestamp '2024-01-15' as processed from events"
