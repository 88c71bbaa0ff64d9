"""The retrying outbox stream: shuffled, replayed and failing events end where the batch projection does."""

import random
import time

import pytest

from kgspark.streaming import projector


@pytest.fixture(scope="module")
def rocks(spark):
    before = spark.conf.get(projector.RETRIES, None)
    spark.conf.set(projector.RETRIES, projector.ROCKS)
    yield spark
    spark.conf.set(projector.RETRIES, before) if before else spark.conf.unset(projector.RETRIES)


def events():
    rnd = random.Random(3)
    kinds = ["entity"] * 5 + ["relation"] * 4 + ["assertion", "statement", "source"]
    rows = []
    for k in range(240):
        kind = rnd.choice(kinds)
        one = {"entity": f"e{rnd.randrange(12)}", "source": "s1"}.get(kind, f"{kind[0]}{rnd.randrange(10)}")
        ends = (f"e{rnd.randrange(12)}", f"e{rnd.randrange(12)}") if kind not in ("entity", "source") else (None, None)
        rows.append((k, kind, one, "delete" if rnd.random() < 0.25 else "upsert", 1000 + k // 2, *ends, f"n{k}"))
    return rows


def brute(rows):
    last, gone = {}, {}
    for r in sorted(rows, key=lambda r: (r[4], r[0])):
        label = projector.LABELS.get(r[1], "")
        last[label, r[2]] = r
        if r[3] == "delete":
            gone[label, r[2]] = (r[4], r[0])
    shown = {k: r for k, r in last.items() if r[3] != "delete"}
    there = lambda label, i, at: (label, i) in shown and gone.get((label, i), (0, 0)) < at
    edges = []
    for (label, i), r in shown.items():
        at = (r[4], r[0])
        if label == "" and there("Entity", r[5], at) and there("Entity", r[6], at):
            edges.append((i, r[5], r[6], r[7]))
        if label == "Assertion":
            edges += [(None, i, e, kind) for e, kind in ((r[5], "SUBJECT"), (r[6], "OBJECT")) if e and there("Entity", e, at)]
    return sorted((label, i, r[7]) for (label, i), r in shown.items() if label), sorted(edges, key=repr)


def graph(df):
    v, e = projector.projection(df)
    return sorted(map(tuple, v.collect())), sorted(map(tuple, e.collect()), key=repr)


def written(spark, rows, path):
    rnd = random.Random(9)
    rows = rows + rnd.sample(rows, 60)  # replays
    rnd.shuffle(rows)
    for k in range(0, len(rows), 50):
        spark.createDataFrame(rows[k : k + 50], projector.EVENT).coalesce(1).write.mode("append").parquet(path)


def flaky(event):
    if event["id"] % 5 == 0 and event["attempt"] < 3:
        raise ConnectionError("x" * 900)


def test_failing_shuffled_and_replayed_stream_gives_the_batch_projection(rocks, tmp_path):
    rows = events()
    want = brute(rows)
    assert graph(rocks.createDataFrame(rows, projector.EVENT)) == want
    at, log, ck = str(tmp_path / "in"), str(tmp_path / "log"), str(tmp_path / "ck")
    written(rocks, [*rows[:200], (900, "odd", "x", "upsert", 1, None, None, None), (901, "entity", None, "upsert", 1, None, None, None)], at)
    projector.start(rocks, at, log, ck, flaky, first_wait_ms=200).awaitTermination()
    first = {r.id: r for r in projector.outcomes(rocks, log).collect()}
    assert not any(r.status == "dead" for r in first.values()) and {first[900].status, first[901].status} == {"unknown"}
    assert any(k not in first for k in range(0, 200, 5))  # they wait
    written(rocks, rows[150:], at)
    q = projector.start(rocks, at, log, ck, flaky, wait="300 milliseconds", first_wait_ms=200)
    end = time.time() + 90
    while time.time() < end and projector.outcomes(rocks, log).count() < 242:
        time.sleep(1)
    q.stop()
    done = projector.outcomes(rocks, log)
    got = {r.id: r for r in done.collect()}
    assert len(got) == 242 and graph(done) == want
    assert all(r.attempts == 3 and len(r.last_error) == projector.ERROR_LENGTH for r in got.values() if r.status == "applied" and r.id % 5 == 0)


def test_spent_attempts(rocks, tmp_path):
    def never(event):
        raise ValueError("no")

    rows = [(1, "entity", "a", "upsert", 1, None, None, "n")]
    rocks.createDataFrame(rows, projector.EVENT).write.parquet(str(tmp_path / "in"))
    projector.start(rocks, str(tmp_path / "in"), str(tmp_path / "log"), str(tmp_path / "ck"), never, most=3, tries_now=3).awaitTermination()
    (r,) = projector.outcomes(rocks, str(tmp_path / "log")).collect()
    assert (r.status, r.attempts, r.last_error) == ("dead", 3, "ValueError: no") and graph(projector.outcomes(rocks, str(tmp_path / "log"))) == ([], [])


def test_needs_the_state_store(spark, tmp_path):
    if spark.conf.get(projector.RETRIES, "") != projector.ROCKS:
        with pytest.raises(ValueError):
            projector.start(spark, str(tmp_path), "l", "c", flaky)
