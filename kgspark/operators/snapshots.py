"""A store of tables as numbered snapshots: a manifest each, published by one rename, with backup, restore and expiry.

folder/data/<id>/<table> holds written tables, folder/log/<number>.json a
manifest. The newest manifest is the store. A manifest is moved to its number
in one rename that fails where the number is taken, so readers see all of a snapshot or none of
it, and of two writers that began at the same snapshot the second is told.
"""

from __future__ import annotations

import json
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from kgspark.operators.gates import dangling


class Conflict(Exception):
    """Another writer published since the snapshot a writer began at."""


def _paths(spark: SparkSession):
    jvm = spark.sparkContext._jvm
    return jvm, jvm.org.apache.hadoop.fs.Path, spark.sparkContext._jsc.hadoopConfiguration()


def _fs(spark: SparkSession, folder: str):
    _, path, conf = _paths(spark)
    return path(folder).getFileSystem(conf)


def fingerprint(df: DataFrame) -> dict:
    """rows, and the sum of their hashes, which no order of rows or columns changes."""
    n, total = df.agg(F.count("*"), F.sum(F.xxhash64(*[F.col(f"`{c}`") for c in sorted(df.columns)]).cast("decimal(38,0)"))).first()
    return {"rows": n, "hash": str(total or 0)}


def numbers(spark: SparkSession, folder: str) -> list[int]:
    """Numbers of the published snapshots, oldest first."""
    fs, path = _fs(spark, folder), _paths(spark)[1]
    log = path(f"{folder}/log")
    if not fs.exists(log):
        return []
    return sorted(int(n[:-5]) for n in (s.getPath().getName() for s in fs.listStatus(log)) if n.endswith(".json") and n[:-5].isdigit())


def manifest(spark: SparkSession, folder: str, number: int | None = None) -> dict:
    """The manifest of a snapshot, the newest by default: number, tables {name: at, rows, hash}. An empty store has number 0 and no tables."""
    if number is None:
        number = max(numbers(spark, folder), default=0)
    if number == 0:
        return {"number": 0, "tables": {}}
    stream = _fs(spark, folder).open(_paths(spark)[1](f"{folder}/log/{number:012d}.json"))
    try:
        return json.loads(bytes(stream.readAllBytes()).decode())
    finally:
        stream.close()


def _commit(spark: SparkSession, folder: str, content: dict) -> None:
    jvm, path, conf = _paths(spark)
    fs = _fs(spark, folder)
    fs.mkdirs(path(f"{folder}/log"))
    new = path(f"{folder}/log/_{uuid.uuid4().hex}")
    stream = fs.create(new, True)
    stream.write(bytearray(json.dumps(content, sort_keys=True).encode()))
    stream.close()
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), conf)
    none = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
    try:
        context.rename(fs.makeQualified(new), fs.makeQualified(path(f"{folder}/log/{content['number']:012d}.json")), none)  # without overwriting
    except Exception as e:
        fs.delete(new, False)
        if "FileAlreadyExists" in str(e) or "already exists" in str(e):
            raise Conflict(f"snapshot {content['number']} of {folder} is there already") from None
        raise


def publish(spark: SparkSession, folder: str, tables: dict[str, DataFrame], base: int | None = None, drop: tuple[str, ...] = ()) -> int:
    """Write tables and publish them as the snapshot after `base` (the newest by default); tables that are not given stay as base has them. Its number.

    Only what is given is written. A writer whose base is no longer the newest gets Conflict, and what it wrote is deleted.
    """
    before = manifest(spark, folder, base)
    after = {k: v for k, v in before["tables"].items() if k not in drop}
    own = uuid.uuid4().hex
    try:
        for name, df in tables.items():
            at = f"data/{own}/{name}"
            df.write.parquet(f"{folder}/{at}")
            after[name] = {"at": at, **fingerprint(spark.read.parquet(f"{folder}/{at}"))}
        if max(numbers(spark, folder), default=0) != before["number"]:
            raise Conflict(f"{folder} is past snapshot {before['number']}")
        _commit(spark, folder, {"number": before["number"] + 1, "tables": after})
    except BaseException:
        _fs(spark, folder).delete(_paths(spark)[1](f"{folder}/data/{own}"), True)
        raise
    return before["number"] + 1


def read(spark: SparkSession, folder: str, number: int | None = None) -> dict[str, DataFrame]:
    """The tables of a snapshot, the newest by default."""
    return {n: spark.read.parquet(f"{folder}/{t['at']}") for n, t in manifest(spark, folder, number)["tables"].items()}


def damaged(spark: SparkSession, folder: str, number: int | None = None) -> list[str]:
    """Tables of a snapshot that differ from its manifest in number of rows or hash, or cannot be read."""

    def sound(t: dict) -> bool:
        try:
            return fingerprint(spark.read.parquet(f"{folder}/{t['at']}")) == {"rows": t["rows"], "hash": t["hash"]}
        except Exception:  # a file that is gone or cut short shows as one of many errors
            return False

    return sorted(n for n, t in manifest(spark, folder, number)["tables"].items() if not sound(t))


def copy(spark: SparkSession, source: str, target: str, number: int | None = None) -> list[str]:
    """Bring a snapshot to another folder (backup, or restore the other way round); returns the tables that moved.

    Tables that the target's newest snapshot holds with the same rows and hash are not copied again. Executors copy, the manifest is published last, so a copy that
    breaks off leaves the target as it was.
    """
    wanted, have = manifest(spark, source, number), manifest(spark, target)
    same = lambda n, t: n in have["tables"] and (have["tables"][n]["rows"], have["tables"][n]["hash"]) == (t["rows"], t["hash"])
    moved = [n for n, t in wanted["tables"].items() if not same(n, t)]
    gone = tuple(n for n in have["tables"] if n not in wanted["tables"])
    if moved or gone or have["number"] == 0:
        publish(spark, target, {n: spark.read.parquet(f"{source}/{wanted['tables'][n]['at']}") for n in moved}, have["number"], gone)
        bad = [n for n in damaged(spark, target) if n in moved]
        if bad:
            raise OSError(f"copies differ from their originals: {bad}")
    return moved


def expire(spark: SparkSession, folder: str, keep: int) -> list[str]:
    """Drop all but the newest `keep` snapshots and the tables that only they held; what was deleted. A reader of a dropped one fails, so keep as many as may be read."""
    fs, path = _fs(spark, folder), _paths(spark)[1]
    every = numbers(spark, folder)
    old, kept = every[: max(0, len(every) - max(1, keep))], every[max(0, len(every) - max(1, keep)) :]
    held = {t["at"] for n in kept for t in manifest(spark, folder, n)["tables"].values()}
    gone = sorted({t["at"] for n in old for t in manifest(spark, folder, n)["tables"].values()} - held)
    for n in old:
        fs.delete(path(f"{folder}/log/{n:012d}.json"), False)
    for at in gone:
        fs.delete(path(f"{folder}/{at}"), True)
        parent = path(f"{folder}/{at}").getParent()
        if fs.exists(parent) and not fs.listStatus(parent):
            fs.delete(parent, False)
    return gone


def broken_keys(tables: dict[str, DataFrame], keys: list[tuple[str, str, str, str]]) -> DataFrame:
    """child, column, value of references (child, column, parent, key) that a snapshot's tables leave without a parent."""
    found = [dangling(tables[c], col, tables[p], k).select(F.lit(c).alias("child"), F.lit(col).alias("column"), F.col(col).cast("string").alias("value")) for c, col, p, k in keys]
    return reduce(DataFrame.unionByName, found)
