"""Queries of the operators in this subpackage: each applies one to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from kgspark.llm import decontaminate, html_text, jaccard, language, licenses, matroska, oracles, packing, pii, prefix_trie, quality, revisit, secret_scan, stamps

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents"))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op3_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digest(secret_scan.scan_documents(table(spark, sf_dir, "documents")))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.find_personal_data(table(spark, sf_dir, "documents")))


def op6_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = revisit.resolve(revisit.records_of_pages(table(spark, sf_dir, "pages")))
    return got.withColumn("headers", revisit.written(F.col("headers")))


def op7_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.link(table(spark, sf_dir, "documents"), k=3, percent=90)


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op9_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matroska.text_media(table(spark, sf_dir, "documents"))


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def op11_mixed_timestamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stamps.normalise(table(spark, sf_dir, "stamps"))


def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.conversation_trie(table(spark, sf_dir, "conversations"))


def op13_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return language.identify(docs, language.fit(docs))


QUERIES: dict[str, Query] = {
    "op1_license_scans": op1_license_scans,
    "op2_best_fit_packing": op2_best_fit_packing,
    "op3_benchmark_decontamination": op3_benchmark_decontamination,
    "op4_secret_scans": op4_secret_scans,
    "op5_pii": op5_pii,
    "op6_warc_revisits": op6_warc_revisits,
    "op7_ngram_jaccard_join": op7_ngram_jaccard_join,
    "op8_html_extraction": op8_html_extraction,
    "op9_media_columns": op9_media_columns,
    "op10_quality_classifier": op10_quality_classifier,
    "op11_mixed_timestamps": op11_mixed_timestamps,
    "op12_conversation_trie": op12_conversation_trie,
    "op13_language_id": op13_language_id,
}

def _spans(rule: secret_scan.Rule, rank: int) -> str:
    """Rows (doc_id, start, rank, kind, stop) of one kind: pieces between matches and the matches themselves give the places."""
    counted = f"len(regexp_extract_all(t, p, {rule.group})[i]) >= {rule.least}"
    place = "list_sum(list_transform(g[1:i], lambda x: len(x))) + coalesce(list_sum(list_transform(w[1:i-1], lambda x: len(x))), 0)"
    pattern = rule.long_enough.replace("'", "''")
    return f"""select doc, start, {rank} as rank, '{rule.kind}' as kind, start + len(w[i]) as stop from (
      select doc, w, i, ({place})::bigint as start from (select doc, t, p, regexp_extract_all(t, p) as w, string_split_regex(t, p) as g from (select rowid as doc, text as t, '{pattern}' as p from d)), unnest(generate_series(1, len(w))) as u(i) where {counted})"""


SECRETS = f"""
with d as (select row_number() over () as rowid, doc_id, coalesce(text, '') as text from documents),
 s as ({" union all ".join(_spans(r, k) for k, r in enumerate(secret_scan.RULES))}),
 g as (select doc, {", ".join(f"count(*) filter (rank = {k}) as n_{r.kind}" for k, r in enumerate(secret_scan.BASE))},
   string_agg(kind || ':' || start || ':' || stop, ',' order by start, rank) filter (rank < {len(secret_scan.BASE)}) as base, string_agg(kind || ':' || start || ':' || stop, ',' order by start, rank) as spans from s group by doc)
select doc_id, {", ".join(f"coalesce(n_{r.kind}, 0) as n_{r.kind}" for r in secret_scan.BASE)}, sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans from d left join g on rowid = doc
"""

LINKS = r"""
with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
 s as (select doc_id, list_distinct(list_transform(generate_series(1, greatest(1, len(w) - 2)), lambda i: array_to_string(w[i:i+2], ' '))) as s from w where len(w) > 0),
 c as (select s, len(s) as n, min(doc_id) as rep from (select doc_id, list_sort(s) as s from s) group by s),
 e as (select rep, n, unnest(s) as x from c),
 l as (select a.rep as a, b.rep as b from e a join e b on a.x = b.x and a.rep < b.rep group by a.rep, b.rep, a.n, b.n having 100 * count(*) >= 90 * (a.n + b.n - count(*))),
 both_ways as (select a, b from l union all select b, a from l),
 reach as (select rep as a, rep as b from c union select reach.a, both_ways.b from reach join both_ways on reach.b = both_ways.a),
 root as (select a, min(b) as r from reach group by a),
 of as (select s.doc_id, c.n, root.r from (select doc_id, list_sort(s) as s from s) s join c on s.s = c.s join root on root.a = c.rep)
select d.doc_id, coalesce(of.n, 0)::bigint as n_shingles, coalesce(of.r, d.doc_id) as component_id from documents d left join of on of.doc_id = d.doc_id
"""

#: SQL where DuckDB can express the operator: op7's holds for documents whose ids differ.
ORACLES: dict[str, str] = {"op4_secret_scans": SECRETS, "op7_ngram_jaccard_join": LINKS, **oracles.ORACLES}
