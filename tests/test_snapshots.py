"""Snapshots: readers beside writers, two writers, backup, restore and expiry."""

import threading

import pytest

from kgspark.operators import snapshots


def both(spark, n):
    return {"a": spark.range(n), "b": spark.range(n).selectExpr("id as a_id")}


def test_reader_beside_a_writer_sees_whole_snapshots(spark, tmp_path):
    at, seen, stop = str(tmp_path / "s"), [], threading.Event()
    snapshots.publish(spark, at, both(spark, 1))

    def look():
        while not stop.is_set():
            t = snapshots.read(spark, at)
            seen.append((t["a"].count(), t["b"].count()))

    reader = threading.Thread(target=look)
    reader.start()
    for n in range(2, 6):
        snapshots.publish(spark, at, both(spark, n))
    stop.set()
    reader.join()
    assert seen and all(x == y for x, y in seen) and snapshots.numbers(spark, at) == [1, 2, 3, 4, 5]


def test_of_two_writers_the_second_is_told(spark, tmp_path):
    at = str(tmp_path / "s")
    base = snapshots.publish(spark, at, both(spark, 2))
    snapshots.publish(spark, at, {"a": spark.range(7)}, base)
    with pytest.raises(snapshots.Conflict):
        snapshots.publish(spark, at, {"a": spark.range(9)}, base)
    with pytest.raises(snapshots.Conflict):
        snapshots._commit(spark, at, {"number": 2, "tables": {}})
    t = snapshots.read(spark, at)
    assert t["a"].count() == 7 and t["b"].count() == 2 and snapshots.read(spark, at, 1)["a"].count() == 2
    assert len([x for x in (tmp_path / "s" / "data").iterdir()]) == 2  # the refused writer left nothing


def test_backup_restore_and_expiry(spark, tmp_path):
    at, safe, back = (str(tmp_path / x) for x in ("s", "backup", "back"))
    snapshots.publish(spark, at, both(spark, 5))
    assert snapshots.copy(spark, at, safe) == ["a", "b"] and snapshots.copy(spark, at, safe) == []
    snapshots.publish(spark, at, {"b": spark.range(3).selectExpr("id as a_id")})
    assert snapshots.copy(spark, at, safe) == ["b"]
    for f in next((tmp_path / "s" / "data").glob("*/b")).glob("*.parquet"):
        f.unlink()
    assert snapshots.damaged(spark, safe) == [] and snapshots.copy(spark, safe, back) == ["a", "b"]
    t = snapshots.read(spark, back)
    assert t["b"].count() == 3 and snapshots.broken_keys(t, [("b", "a_id", "a", "id")]).count() == 0
    assert [tuple(r) for r in snapshots.broken_keys({"b": spark.range(7), "a": spark.range(6)}, [("b", "id", "a", "id")]).collect()] == [("b", "id", "6")]
    snapshots.publish(spark, back, {"a": spark.range(1)})
    assert len(snapshots.expire(spark, back, 1)) == 1 and snapshots.read(spark, back)["a"].count() == 1 and snapshots.numbers(spark, back) == [2]


def test_damage_shows(spark, tmp_path):
    at = str(tmp_path / "s")
    snapshots.publish(spark, at, both(spark, 5))
    where = snapshots.manifest(spark, at)["tables"]["a"]["at"]
    spark.range(5).selectExpr("id + 1 as id").write.mode("overwrite").parquet(f"{at}/{where}")
    assert snapshots.damaged(spark, at) == ["a"] and snapshots.manifest(spark, str(tmp_path / "none")) == {"number": 0, "tables": {}}
