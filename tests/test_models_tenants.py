"""Model calls with injected failures, and tables of several tenants."""

import pytest

from kgspark.operators import models, rule_tables, tenants
from pyspark.sql import functions as F


def connect(log, down=()):
    """A client that notes what it is asked, answers out of order, fails on texts of `down` and has no answer for blank ones."""

    def open_():
        def client(texts):
            with open(log, "a", encoding="utf-8") as f:
                f.writelines(t + "\n" for t in texts)
            if any(t in down for t in texts):
                raise TimeoutError("y" * 900)
            return [{"index": k, "payload": t.upper()} for k, t in reversed(list(enumerate(texts))) if t != "silent"]

        return client

    return open_


def test_calls_keep_order_and_ask_again_only_what_failed(spark, tmp_path):
    texts = [f"t{k}" for k in range(40)] + ["t3", "bad", "silent", "", " ", None]
    units = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    log = tmp_path / "asked"
    results, kept = models.called(units, "id", "text", connect(str(log), ("bad",)), "m", batch=8, tries=2)
    got = {r.id: r for r in results.collect()}
    assert len(got) == len(texts) and all(got[k].payload == f'"T{k}"' for k in range(40)) and got[40].payload == '"T3"'
    assert not got[41].ok and got[41].error.startswith("TimeoutError") and len(got[41].error) == 500 and got[42].error == "no answer"
    assert [(got[k].ok, got[k].attempts, got[k].error) for k in (43, 44, 45)] == [(False, 0, None)] * 3
    first = log.read_text("utf-8").splitlines()
    assert first.count("t3") <= 3 and "" not in first
    log.write_text("")
    more = units.unionByName(spark.createDataFrame([(99, "new")], "id int, text string"))
    again, _ = models.called(more, "id", "text", connect(str(log)), "m", known=kept)
    assert sorted(log.read_text("utf-8").splitlines()) == ["bad", "bad", "new", "silent", "silent"] or set(log.read_text("utf-8").splitlines()) == {"bad", "new", "silent"}
    assert {r.id for r in again.where("ok").collect()} == set(range(42)) | {99}
    assert models.called(units.limit(0), "id", "text", connect(str(log)), "m")[0].count() == 0


def test_recognised_entities(spark):
    rows = [(1, True, '[{"text": "Acme", "type": "ORG", "score": 0.12345}, {"text": "x", "type": "place"}, {"text": "", "type": "org"}, {"text": "Jo", "type": "person"}]'), (2, False, None)]
    got = models.recognised(spark.createDataFrame(rows, "id int, ok boolean, payload string"), "id")
    assert {tuple(r) for r in got.collect()} == {(1, "Acme", "organization", 0.123, "ner:organization"), (1, "Jo", "customer", 0.7, "ner:customer")}


def test_no_table_without_a_tenant(spark):
    a = spark.createDataFrame([(1, "t1", "x"), (1, "t2", "y"), (2, None, "z")], "id int, tenant_id string, v string")
    b = spark.createDataFrame([(1, "t1", 5), (1, "t2", 6)], "id int, tenant_id string, n int")
    names = spark.createDataFrame([(1, "one")], "id int, name string")
    for none in (None, "", " "):
        with pytest.raises(PermissionError):
            tenants.Catalogue({"a": a}, none)
    with pytest.raises(PermissionError):
        tenants.Catalogue({"a": a, "names": names}, "t1")
    c = tenants.Catalogue({"a": a, "b": b, "names": names}, "t1", shared=("names",))
    with pytest.raises(PermissionError):
        c.table("zz")
    assert [r.v for r in c.table("a").collect()] == ["x"] and [tuple(r) for r in c.join("a", "b", ["id"]).select("v", "n").collect()] == [("x", 5)] and c.join("a", "names", ["id"]).count() == 1
    new = spark.createDataFrame([(1, "t1", "X"), (3, "t2", "no"), (4, None, "no")], a.schema)
    assert sorted(r.id for r in c.refused("a", new).collect()) == [3, 4]
    assert sorted(map(str, (tuple(r) for r in c.written("a", new, "id").collect()))) == sorted(map(str, [(1, "t1", "X"), (1, "t2", "y"), (2, None, "z")]))
    with pytest.raises(PermissionError):
        c.refused("names", new)


def test_the_tenant_is_pushed_to_both_scans(spark, tmp_path):
    for n in "ab":
        spark.createDataFrame([(1, "t1"), (2, "t2")], "id int, tenant_id string").write.parquet(str(tmp_path / n))
    c = tenants.Catalogue({n: spark.read.parquet(str(tmp_path / n)) for n in "ab"}, "t1")
    plan = c.join("a", "b", ["id"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("EqualTo(tenant_id,t1)") >= 2


def test_got_or_created_twice_is_the_same(spark):
    known = spark.createDataFrame([("k1", "a", "active"), ("k0", "a", "active")], "id string, name string, status string")
    wanted = spark.createDataFrame([("a",), ("b",), ("b",), (None,)], "name string")
    rows, ids = tenants.got_or_created(known, wanted, ["name"], "id", "x", {"status": "active"})
    got = {r.name: (r.id, r.created) for r in ids.collect()}
    assert got["a"] == ("k0", False) and got["b"][1] and got[None][1] and rows.count() == 4
    again, ids2 = tenants.got_or_created(rows, wanted, ["name"], "id", "x", {"status": "active"})
    assert again.count() == 4 and {r.name: r.id for r in ids2.collect()} == {k: v[0] for k, v in got.items()}


def test_masks_of_many_rules(spark):
    rows = spark.createDataFrame([(1, None), (2, 0), (3, 5), (3, 5)], "id int, v int")
    rules = {f"r{k}": (F.col("v") == k) | (F.lit(k) == 62) for k in range(63)}
    got = sorted((r.id, r.rule) for r in rule_tables.failures(rows, "id", rules).collect())
    assert got == sorted([(1, "r62"), (2, "r0"), (2, "r62")] + [(3, "r5"), (3, "r62")] * 2)
