"""One way to the tables of several tenants: every read, join and write carries the tenant; tenants, brands and workspaces are got or created."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from kgspark.functions.exprs import stable_id

# fixed values: tables that belong to tenants
PROTECTED = ("brand_workspace", "assertion", "claim_policy", "brand_source_policy", "product_record", "knowledge_conflict", "content_inventory", "brand_snapshot")


class Catalogue:
    """The tables as one tenant sees them. A table is either protected (it has the tenant's column) or named as shared; others cannot be reached, and nothing can without a tenant."""

    def __init__(self, tables: dict[str, DataFrame], tenant: str | None, shared: tuple[str, ...] = (), column: str = "tenant_id") -> None:
        if tenant is None or not str(tenant).strip():
            raise PermissionError("no tenant is set")
        bare = [n for n, df in tables.items() if n not in shared and column not in df.columns]
        if bare:
            raise PermissionError(f"tables without {column} that are not shared: {sorted(bare)}")
        self._tables, self.tenant, self._shared, self._column = dict(tables), tenant, frozenset(shared), column

    def table(self, name: str) -> DataFrame:
        """Rows of the tenant; rows without a tenant are nobody's. The predicate stands at the scan, where it is pushed down."""
        if name not in self._tables:
            raise PermissionError(f"no table {name}")
        df = self._tables[name]
        return df if name in self._shared else df.where(F.col(self._column) == self.tenant)

    def join(self, left: str, right: str, on: list[str], how: str = "inner") -> DataFrame:
        """Two tables by columns of both; where both are protected the tenant is one of them, so no plan pairs rows of two tenants."""
        both = [n for n in (left, right) if n not in self._shared]
        keys = [*on, self._column] if len(both) == 2 else list(on)
        return self.table(left).join(self.table(right), keys, how)

    def view(self) -> dict[str, DataFrame]:
        return {n: self.table(n) for n in self._tables}

    def refused(self, name: str, rows: DataFrame) -> DataFrame:
        """Rows that may not be written to a table: those of another tenant, or of none."""
        if name in self._shared:
            raise PermissionError(f"{name} is shared, and read only here")
        self.table(name)
        return rows.where(~F.coalesce(F.col(self._column) == self.tenant, F.lit(False)))

    def written(self, name: str, rows: DataFrame, key: str) -> DataFrame:
        """The whole table after rows came in by key: only rows of the tenant come in, only rows of the tenant are replaced, also where another tenant uses the same key."""
        self.refused(name, rows)
        old, own = self._tables[name], rows.where(F.col(self._column) == self.tenant)
        return old.join(own.select(key, self._column).distinct(), [key, self._column], "left_anti").select(*old.columns).unionByName(own.select(*old.columns))


def got_or_created(known: DataFrame, wanted: DataFrame, key: list[str], ident: str, prefix: str, fixed: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    """(rows after, wanted with ident and created): wanted rows take the id of the known row of their key (the least, where it is known twice), others get an id made of the key.

    The same key always gets the same id, so two writers and a repeated run agree. fixed: values of columns of new rows that wanted lacks. Null keys equal each other.
    """
    ask = wanted.dropDuplicates(key)
    same = lambda a, b: [F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}")) for c in key]
    held = known.groupBy(*key).agg(F.min(ident).alias("kg_id"))
    on = same("w", "k")
    cond = on[0]
    for c in on[1:]:
        cond = cond & c
    met = ask.alias("w").join(held.alias("k"), cond, "left").select("w.*", "k.kg_id")
    named = met.select(*key, F.coalesce("kg_id", stable_id(prefix, *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in key])).alias(ident), F.col("kg_id").isNull().alias("created"), *[c for c in ask.columns if c not in key and c != ident])
    new = named.where("created")
    for c, v in fixed.items():
        if c not in new.columns:
            new = new.withColumn(c, F.lit(v))
    rows = known.unionByName(new.select(*[c for c in known.columns if c in new.columns]), allowMissingColumns=True)
    return rows.select(*known.columns), named.select(*key, ident, "created")


def brand_context(tenants: DataFrame, entities: DataFrame, workspaces: DataFrame, wanted: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(tenants, entities, workspaces, context) after wanted (tenant_key, tenant_name, brand_key, market, language) was looked up.

    tenants: id, tenant_key, name, status; entities: id, tenant_id, entity_type, canonical_name, owner_brand, status; workspaces: id, tenant_id, brand_entity_id, market, language, status. A null or blank
    tenant is "default", market CN, language zh-CN; rows without a brand are left out. context: tenant_key, brand_key, tenant_id, brand_id.
    """
    given = lambda c, v: F.coalesce(F.when(F.trim(c) != "", F.col(c)), F.lit(v)).alias(c)
    ask = wanted.where(F.trim("brand_key") != "").select(given("tenant_key", "default"), "tenant_name", "brand_key", given("market", "CN"), given("language", "zh-CN"))
    people = ask.groupBy("tenant_key").agg(F.coalesce(F.min("tenant_name"), F.concat(F.lit("Tenant "), F.col("tenant_key"))).alias("name"))
    after_t, ids = got_or_created(tenants, people, ["tenant_key"], "id", "tenant", {"status": "active"})
    asked = ask.join(ids.select("tenant_key", F.col("id").alias("tenant_id")), "tenant_key")
    selves = entities.where("entity_type = 'brand' and owner_brand is null")
    brands = asked.select("tenant_id", F.col("brand_key").alias("canonical_name")).distinct().withColumn("entity_type", F.lit("brand"))
    after_b, bids = got_or_created(selves, brands, ["tenant_id", "canonical_name", "entity_type"], "id", "brand", {"status": "active"})
    context = asked.join(bids.select("tenant_id", F.col("canonical_name").alias("brand_key"), F.col("id").alias("brand_id")), ["tenant_id", "brand_key"])
    spaces = context.select("tenant_id", F.col("brand_id").alias("brand_entity_id"), "market", "language").distinct()
    after_w, _ = got_or_created(workspaces, spaces, ["tenant_id", "brand_entity_id", "market", "language"], "id", "workspace", {"status": "active"})
    others = entities.where("not (entity_type = 'brand' and owner_brand is null) or entity_type is null")
    return after_t, others.unionByName(after_b), after_w, context.select("tenant_key", "brand_key", "tenant_id", "brand_id").distinct()
