"""Path templates of the ontology over a graph: all templates advance together, a level a join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from kgspark.session import Scratch, materialise

# fixed values: the narrative chains as types of nodes in order
CHAINS = {
    "l2_market_opportunity": ["industry", "category", "market_segment", "audience", "use_case", "demand", "problem", "opportunity"],
    "l2_competitive_landscape": ["industry", "category", "brand", "product"],
    "l2_unmet_demand": ["demand", "problem", "opportunity"],
    "l2_risk_transmission": ["risk", "opportunity", "industry", "category", "brand"],
    "l2_trend_growth": ["trend", "use_case", "audience", "demand", "opportunity"],
    "l3_brand_value_proof": ["brand", "brand_claim", "product", "solution", "capability", "service", "delivery_result"],
    "l3_solution_evidence": ["capability", "solution", "service", "technology", "case"],
    "l3_applicability_delivery": ["product", "solution", "service", "audience", "customer", "delivery_result"],
    "l3_claim_credibility": ["brand_claim", "certification", "case", "delivery_result"],
    "l3_applicability_risk": ["capability", "product_version", "technology", "certification"],
}


def prefix_tree(templates: dict[str, list[str]]) -> tuple[list[dict[tuple[int, str], int]], dict[int, list[str]]]:
    """(steps by level, names by last node): steps[k] maps (node, type) to the node after k + 1 types; node 0 is the empty prefix."""
    number: dict[tuple[str, ...], int] = {(): 0}
    steps: list[dict[tuple[int, str], int]] = [{} for _ in range(max(map(len, templates.values()), default=0))]
    ends: dict[int, list[str]] = {}
    for name, types in sorted(templates.items()):
        for k in range(len(types)):
            node = number.setdefault(tuple(types[: k + 1]), len(number))
            steps[k][number[tuple(types[:k])], types[k]] = node
        ends.setdefault(number[tuple(types)], []).append(name)
    return steps, ends


def _chosen(pairs: dict, key: Column) -> Column:
    """The value of a literal map, null where it lacks the key."""
    if not pairs:
        return F.lit(None).cast("int")
    return F.try_element_at(F.create_map(*[F.lit(x) for k, v in pairs.items() for x in (k, v)]), key)


def template_paths(entities: DataFrame, relations: DataFrame, templates: dict[str, list[str]] = CHAINS) -> DataFrame:
    """template, path (ids of nodes) for every chain of nodes whose types are a template's, one edge in either direction apart.

    entities: id, type; relations: source_id, target_id. The templates form a prefix tree, and rows carry the tree's node: a level of the tree is one join,
    whatever the number of templates, and a shared prefix is joined once. Entities and relations are read once and written with types as numbers.
    Going from the ends back first leaves a level's edges from which some template can be completed, found among the edges between the level's own types;
    going forward meets these alone, so no row of a prefix is without a result and cycles or hubs that lead nowhere are never joined. Each level is
    written; of edges given twice, or both ways, one counts. Templates of no types give nothing.
    """
    spark = entities.sparkSession
    templates = {k: v for k, v in templates.items() if v}
    steps, ends = prefix_tree(templates)
    if not steps:
        return entities.limit(0).select(F.lit("").alias("template"), F.array("id").alias("path"))
    number = {t: k for k, t in enumerate(sorted({t for v in templates.values() for t in v}))}
    types = {n: number[t] for level in steps for (_, t), n in level.items()}
    parent = {n: p for level in steps for (p, _), n in level.items()}
    # an edge's two types as one number
    pair_of = {n: types[p] * len(number) + types[n] for n, p in parent.items() if p}
    with Scratch(spark, "templates") as s:
        kinds = entities.where(F.col("type").isin(sorted(number)) & F.col("id").isNotNull()).select("id", _chosen(number, F.col("type")).alias("t")).distinct()
        kinds = s.write(kinds, "kinds")
        typed = lambda c: kinds.select(F.col("id").alias(c), F.col("t").alias(f"{c}_t"))
        way = lambda a, b: F.struct(F.col(a).alias("u"), F.col(b).alias("v"), (F.col(f"{a}_t") * len(number) + F.col(f"{b}_t")).alias("pair"))
        ways = relations.select(F.col("source_id").alias("a"), F.col("target_id").alias("b")).join(typed("a"), "a").join(typed("b"), "b")
        edges = ways.select(F.inline(F.array(way("a", "b"), way("b", "a")))).where(F.col("pair").isin(sorted(set(pair_of.values()))))
        edges = s.write(edges.distinct(), "edges")

        def at(level: int) -> list[int]:
            return sorted(set(steps[level].values()))

        def alive(level: int) -> DataFrame:
            """node of the tree, id: those from which a template can be completed. Where one ends, all nodes of its type; else those that an edge on leads from."""
            whole = F.explode(F.array(*[F.struct(F.lit(n).alias("node"), F.lit(types[n]).alias("t")) for n in at(level) if n in ends] or [F.struct(F.lit(-1).alias("node"), F.lit(-1).alias("t"))]))
            rows = kinds.select("id", "t", whole.alias("n")).where(F.col("t") == F.col("n.t")).select(F.col("n.node").alias("node"), "id")
            if level + 1 < len(steps):
                rows = rows.unionByName(ahead[level + 1].where(~F.col("up").isin(sorted(ends))).select(F.col("up").alias("node"), F.col("u").alias("id")).distinct())
            return rows

        # from the ends back: edges u, v of a level from the tree's node up to its node, from which a template can be completed
        ahead: dict[int, DataFrame] = {}
        for level in range(len(steps) - 1, 0, -1):
            rows = alive(level).select("node", F.col("id").alias("v"), _chosen({n: pair_of[n] for n in at(level)}, F.col("node")).alias("pair"))
            own = edges.where(F.col("pair").isin(sorted({pair_of[n] for n in at(level)})))
            ahead[level] = s.write(rows.join(own, ["v", "pair"]).select(_chosen({n: parent[n] for n in at(level)}, F.col("node")).alias("up"), "u", "node", "v"), f"ahead{level}")
        found = None
        level_rows = alive(0).select("node", F.array("id").alias("path"), F.col("id").alias("tail"))
        for level in range(len(steps)):
            if level:
                on = ahead[level].select("up", F.col("u").alias("tail"), F.col("node").alias("next"), "v")
                got = level_rows.withColumnRenamed("node", "up").join(on, ["up", "tail"])
                level_rows = s.write(got.select(F.col("next").alias("node"), F.concat("path", F.array("v")).alias("path"), F.col("v").alias("tail")), f"level{level}")
            names = {n: ends[n] for n in at(level) if n in ends}
            if names:
                named = F.create_map(*[x for n, v in names.items() for x in (F.lit(n), F.array(*map(F.lit, v)))])
                out = level_rows.where(F.col("node").isin(list(names))).select(F.explode(F.try_element_at(named, F.col("node"))).alias("template"), "path")
                found = out if found is None else found.unionByName(out)
        return materialise(found, "template-paths")
