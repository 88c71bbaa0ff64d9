"""Rows that an order leaves equal: the table's first one decides, as in DuckDB on one thread."""

import datetime
import random

import duckdb
import pytest

from kgspark.plans import catalog, knowledge, lifecycle  # noqa: F401 (these add their queries)


@pytest.fixture(scope="module")
def tied(spark, tmp_path_factory):
    """Lines in which orders and line numbers are given many times, in two row groups."""
    rnd, at = random.Random(5), tmp_path_factory.mktemp("tied")
    con = duckdb.connect()
    con.execute("set threads = 1")
    con.execute("create table l (l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber integer, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag varchar, l_linestatus varchar, l_shipdate timestamp)")
    rows = [(rnd.randrange(4), rnd.randrange(30), rnd.randrange(40), rnd.randrange(3), 1.0, 2.0, rnd.randrange(9) / 100, 0.0, rnd.choice("ARN"), rnd.choice("OF"), datetime.datetime(1996, 1, 1)) for _ in range(3000)]
    con.executemany("insert into l values (" + ", ".join("?" * 11) + ")", rows)
    con.execute(f"copy l to '{at}/lineitem.parquet' (row_group_size 2048)")
    con.execute(f"copy (select i as s_suppkey, i % 25 as s_nationkey from range(40) t(i)) to '{at}/supplier.parquet'")
    for t in ("lineitem", "supplier"):
        con.execute(f"create view {t} as select * from '{at}/{t}.parquet'")
    for t in ("part", "customer", "nation", "region", "events", "documents"):
        con.execute(f"create view {t} as select * from '/root/testdata/sf0.001/{t}.parquet'")
    return str(at), con


@pytest.mark.parametrize("name", ["candidate_fusion", "document_fold", "relations_first"])
def test_ties(spark, tied, name):
    """All but the fold's aliases: DuckDB leaves those of one place in the order of its hash table."""
    at, con = tied
    df = catalog.QUERIES[name](spark, at)
    cur = con.execute(f"select * exclude (aliases) from ({catalog.ORACLES[name]})" if name == "document_fold" else catalog.ORACLES[name])
    names = [x[0] for x in cur.description]
    assert sorted(tuple(r) for r in df.select(*names).collect()) == sorted(cur.fetchall())


def test_aliases_of_one_place_stand_as_the_table_first_has_them(spark, tied):
    at, con = tied
    first, row = {}, {}
    for n, (s, p, o, line) in enumerate(con.execute("select l_suppkey, l_partkey, l_orderkey, l_linenumber from lineitem where l_suppkey % 25 > 4").fetchall()):
        k = f"s{s}", f"b{p % 5}"
        first[k] = min(first.get(k, (9, 9)), (o, line))
        row.setdefault(k, n)
    want = {i: ",".join(["x"] * (int(i[1:]) % 2 == 0) + [a for _, _, a in sorted((first[k], row[k], k[1]) for k in first if k[0] == i)]) for i in {k[0] for k in first}}
    got = {r.id: r.aliases for r in catalog.QUERIES["document_fold"](spark, at).collect()}
    assert {i: got[i] for i in want} == want


def test_all_pending_events_count(spark, tmp_path):
    """No sample of the unprocessed events decides what is pending."""
    rows = [(1, 7, "click"), (2, 8, "click"), (3, 9, "error")]
    early, late = datetime.datetime(2024, 1, 2), datetime.datetime(2024, 2, 2)
    spark.createDataFrame([(i, u, t, early) for i, u, t in rows] + [(5, 7, "view", late), (6, 8, "error", late)], "event_id long, user_id long, event_type string, ts timestamp_ntz").write.parquet(f"{tmp_path}/events.parquet")
    assert [r.aggregate_id for r in catalog.QUERIES["pending_absent"](spark, str(tmp_path)).collect()] == [8]


@pytest.fixture(scope="module")
def tied_files(tied, tmp_path_factory):
    """The tied lines dealt over several files, some names of which stand otherwise in a URL than in a folder."""
    _, one = tied
    at, con = tmp_path_factory.mktemp("tied files"), duckdb.connect()
    (at / "lineitem.parquet").mkdir()
    con.execute("set threads = 1")
    one.execute("create or replace table numbered as select row_number() over () as n, * from l")
    for k, f in enumerate(("part 0", "part#1", "part-10", "part-2", "part_3")):
        one.execute(f"copy (select * exclude (n) from numbered where n % 5 = {4 - k} order by n) to '{at}/lineitem.parquet/{f}.parquet'")
    one.execute(f"copy supplier to '{at}/supplier.parquet'")
    con.execute(f"create view lineitem as select * from '{at}/lineitem.parquet/*.parquet'")
    con.execute(f"create view supplier as select * from '{at}/supplier.parquet'")
    for t in ("part", "customer", "nation", "region", "events", "documents"):
        con.execute(f"create view {t} as select * from '/root/testdata/sf0.001/{t}.parquet'")
    return str(at), con


def test_candidate_fusion_over_files(spark, tied_files):
    test_ties(spark, tied_files, "candidate_fusion")


def test_document_fold_over_files(spark, tied_files):
    test_ties(spark, tied_files, "document_fold")
    test_aliases_of_one_place_stand_as_the_table_first_has_them(spark, tied_files)


def test_relations_first_over_files(spark, tied_files):
    test_ties(spark, tied_files, "relations_first")
