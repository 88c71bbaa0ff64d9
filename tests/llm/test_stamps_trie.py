"""Mixed timestamps and the prefix trie against plain Python, with their edge cases."""

import hashlib
import re
import zlib
from collections import defaultdict
from datetime import datetime, timedelta
from zoneinfo import ZoneInfo

from kgspark.llm import prefix_trie, stamps

STAMP = "stamp_id long, source string, zone string, raw string"
UTC0 = datetime(1970, 1, 1)


def placed(wall, zone):
    """(seconds since 1970, odd) by the days around a wall time: where the zone's offset changes, the one after counts."""
    z = ZoneInfo(zone)
    off = lambda utc: datetime.fromtimestamp(utc, z).utcoffset().total_seconds()
    w = (wall - UTC0).total_seconds()
    b, a = off(w - 130_000), off(w + 130_000)
    fits = [o for o in (b, a) if off(w - o) == o]
    if b == a:
        return w - a, False
    return (w - fits[0], False) if len(fits) == 1 else (w - a, True)


def brute(rows):
    shape = re.compile(r"(?:(?P<y1>20\d\d)-(?P<m1>\d\d)-(?P<d1>\d\d)|(?P<y2>20\d\d)(?P<m2>\d\d)(?P<d2>\d\d)|(?P<d3>\d\d)\.(?P<m3>\d\d)\.(?P<y3>20\d\d)|(?P<d4>\d\d) (?P<m4>[A-Z][a-z]{2}) (?P<y4>20\d\d)|(?P<a>\d\d)/(?P<b>\d\d)/(?P<y5>20\d\d))(?:[T ](?P<h>\d\d):(?P<mi>\d\d)(?::(?P<s>\d\d))?(?: ?(?P<p>[AP])M)?(?: ?(?:(?P<z>Z)|(?P<g>[+-])(?P<oh>\d\d):?(?P<om>\d\d)))?)?", re.A)
    months = "Jan Feb Mar Apr May Jun Jul Aug Sep Oct Nov Dec".split()

    def dates(g):
        if g["a"]:
            tries = [(g["y5"], g["b"], g["a"]), (g["y5"], g["a"], g["b"])]
        else:
            k = next(k for k in "1234" if g["y" + k])
            m = g["m" + k]
            tries = [(g["y" + k], 1 + months.index(m) if m in months else m if m.isdigit() else 0, g["d" + k])]
        out = []
        for t in tries:
            try:
                out.append(datetime(*map(int, t)))
            except ValueError:
                out.append(None)
        return out if len(out) == 2 else [out[0], None]

    parsed = []
    for i, source, zone, raw in rows:
        s = (raw or "").strip(" \t\n\x0b\x0c\r")
        if re.fullmatch(r"\d{10}|\d{13}", s, re.A):
            parsed.append((i, source, "epoch", int(s) * (1_000_000 if len(s) == 10 else 1000)))
            continue
        g, bad = shape.fullmatch(s), (i, source, "bad", None)
        g = g and g.groupdict()
        if not g:
            parsed.append(bad)
            continue
        h, mi, sec = (int(g[c] or 0) for c in ("h", "mi", "s"))
        ok = mi < 60 and sec < 60 and (1 <= h <= 12 if g["p"] else h < 24) and (not g["g"] or int(g["oh"]) <= 14 and int(g["om"]) < 60)
        off = 0 if g["z"] else (-60 if g["g"] == "-" else 60) * (int(g["oh"]) * 60 + int(g["om"])) if g["g"] else None
        ok = ok and (off is not None or zone in ("UTC", "America/New_York", "Europe/Berlin", "Australia/Lord_Howe", "Pacific/Apia"))
        h = h % 12 + 12 * (g["p"] == "P") if g["p"] else h
        two = dates(g)
        parsed.append((i, source, "date", two, bool(g["a"]), timedelta(hours=h, minutes=mi, seconds=sec), off, zone) if ok and any(two) else bad)
    votes = defaultdict(lambda: [0, 0])
    for p in parsed:
        if p[2] == "date" and p[4] and (p[3][0] is None) != (p[3][1] is None):
            votes[p[1]][p[3][0] is None] += 1
    out = []
    for p in parsed:
        if p[2] != "date":
            out.append((p[0], p[3], p[2], False))
            continue
        (d, m), rule, (n, k) = p[3], "plain", votes[p[1]]
        day = d or m
        if d and m and d != m:
            rule = "votes" if n > 10 * k or k > 10 * n else "default"
            day = m if k > 10 * n else d
        wall, odd = day + p[5], False
        at = (wall - UTC0).total_seconds() - p[6] if p[6] is not None else None
        if at is None:
            at, odd = placed(wall, p[7])
        out.append((p[0], int(at) * 1_000_000, rule, rule in ("votes", "default") or odd))
    return sorted(out, key=repr)


def normalised(spark, rows):
    return sorted((tuple(r) for r in stamps.normalise(spark.createDataFrame(rows, STAMP)).collect()), key=repr)


def test_stamps_equal_brute_force(spark):
    ny, berlin = "America/New_York", "Europe/Berlin"
    texts = [
        None, "", " ", "n/a", "1733025832", "1733942329007", "17330258321", " \t2024-02-29 \r\n", "2023-02-29", "2024-02-09T02:07:34+05:30", "2024-02-09T02:07-1459", "2024-02-09T02:07+15:00", "2024-02-09T02:07+0160", "20240502", "20241301",
        "26.01.2024 17:55:06", "31.04.2024", "05 Nov 2024 02:48", "05 nov 2024", "05 Foo 2024", "2024-01-01 24:00", "2024-01-01 23:60", "2024-01-01 23:59:60", "2024-01-01 12:30 AM", "2024-01-01 12:30PM", "2024-01-01 00:30 AM", "2024-01-01 13:30 PM",
        "2024-01-01 1:30", "2024-01-01T", "2024-01-01 11:00 PM Z", "2024-01-01 11:00Z", "2024-01-01 11:00:00 z", "1999-01-01", "2099-12-31", "2024/01/02", "13/04/2024", "04/13/2024", "05/05/2024", "03/04/2024 10:00", "30/02/2024", "02/30/2024", "04/31/2024", "31/04/2024",
        "13/04/2024 25:00", "٢٠٢٤-01-01", "2024-01-01 10:00" + "0" * 50_000,
    ]
    rows = [(k, "s", z, t) for k, t in enumerate(texts) for z in ("UTC", ny, None, "Mars/Olympus")]
    changes = ["2024-03-10 02:30", "2024-03-10 01:59:59", "2024-03-10 03:00", "2024-11-03 01:30", "2024-11-03 00:59:59", "2024-11-03 02:00", "2024-11-03 01:00"]
    rows += [(1000 + k, "d", ny, t) for k, t in enumerate(changes)]
    rows += [(1100 + k, "d", berlin, t) for k, t in enumerate(["2024-03-31 02:15", "2024-10-27 02:15", "31/03/2024 02:15", "10/27/2024 02:45 AM"])]
    rows += [(1200 + k, "d", "Australia/Lord_Howe", t) for k, t in enumerate(["2024-04-07 01:45", "2024-10-06 02:15", "2024-04-07 02:00"])]
    rows += [(1300, "d", "Pacific/Apia", "2011-12-30 12:00")]
    rows += [(2000 + k, "days", "UTC", "25/12/2024") for k in range(11)] + [(2100, "days", "UTC", "12/25/2024"), (2101, "days", "UTC", "03/04/2024")]
    rows += [(2200 + k, "few", "UTC", "25/12/2024") for k in range(10)] + [(2300, "few", "UTC", "12/25/2024"), (2301, "few", "UTC", "03/04/2024")]
    rows += [(2400 + k, None, "UTC", "12/25/2024") for k in range(3)] + [(2500, None, "UTC", "03/04/2024"), (2500, None, "UTC", "03/04/2024"), (None, None, "UTC", "03/04/2024")]
    rows += [(2600, "none", "UTC", "03/04/2024"), (9007199254740993, "none", "UTC", "20240101")]
    assert normalised(spark, rows) == brute(rows)


def test_stamps_hot_source_and_many_small_ones(spark):
    rows = [(k, "hot", "UTC", f"{1 + k % 12:02d}/{1 + k % 28:02d}/2024") for k in range(1500)]
    rows += [(5000 + k, f"s{k % 1500}", "UTC", t) for k, t in enumerate(["03/04/2024"] * 1500 + ["12/25/2024"] * 700)]
    assert normalised(spark, rows) == brute(rows)


def test_stamps_empty_table_and_other_columns(spark):
    assert normalised(spark, []) == []
    df = spark.createDataFrame([(1, "s", "UTC", "20240101", "x", 5)], STAMP + ", reading string, `a.b` int")
    assert [tuple(r) for r in stamps.normalise(df).collect()] == [(1, 1704067200000000, "plain", False)]


CONV = "conv_id long, turn long, role string, text string"


def trie_brute(rows):
    own = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            r, x = r or "", x or ""
            own[c].append((t is not None, t or 0, hashlib.sha256(f"{len(r)}:{r}{x}".encode()).hexdigest(), r, x))
    seqs = {c: [v[3:] for v in sorted(vs)] for c, vs in own.items()}
    members, last = defaultdict(list), defaultdict(list)
    for c in seqs:
        h = zlib.crc32(str(c).encode()) % 6
        full = tuple(seqs.get(c - c % 100, [])[:h] + seqs[c][h:])
        for d in range(len(full) + 1):
            members[full[:d]].append(c)
        last[full].append(c)
    out = []
    for p, cs in members.items():
        below = [q for q in members if q[: len(p)] == p]
        kids = [q for q in below if len(q) == len(p) + 1]
        leaves = [q for q in below if not any(x[: len(q)] == q and len(x) == len(q) + 1 for x in members)]
        saved = sum((len(members[q]) - 1) * len(q[-1][1]) for q in below if q)
        out.append((min(cs), len(p), min(members[p[:-1]]) if p else None, len(cs), len(kids), len(leaves), saved, hashlib.sha256(",".join(map(str, sorted(last[p]))).encode()).hexdigest()))
    return sorted(out, key=repr)


def trie_of(spark, rows, schema=CONV):
    got = prefix_trie.conversation_trie(spark.createDataFrame(rows, schema))
    return sorted((tuple(r) for r in got.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256").collect()), key=repr)


def test_trie_equals_brute_force(spark):
    rows = []
    for c in [*range(0, 30), *range(100, 125), *range(205, 215), 300, 301, 9007199254740993]:
        for t in range(1 + c % 7):
            rows.append((c, t, "user" if t % 2 == 0 else "assistant", f"turn {t} {'é' * (c % 3)}{c % 2}"))
    rows += [(7, None, "system", "first"), (7, None, "system", "again"), (7, 2, "user", "tie"), (7, 2, "user", "tie"), (8, 3, None, None), (None, 1, "user", "lost"), (11, 9, "user", ""), (400, 1, "u", "x" * 200_000)]
    assert trie_of(spark, rows) == trie_brute(rows)


def test_trie_of_copies_a_long_one_and_a_comb(spark):
    rows = [(1000 + k, t, "user", f"same {t}") for k in range(60) for t in range(8)]
    rows += [(2000, t, "user", f"step {t}") for t in range(40)] + [(2100 + 100 * k, t, "user", f"step {t}") for k in range(12) for t in range(3 * k + 1)] + [(2100 + 100 * k, 90, "user", f"off {k}") for k in range(12)]
    assert trie_of(spark, rows) == trie_brute(rows)


def test_trie_of_no_rows_and_other_columns(spark):
    assert trie_of(spark, []) == []
    rows = [(5, 1, "user", "a", 1, "z"), (5, 2, "user", "b", 2, "y")]
    assert trie_of(spark, rows, CONV + ", pos int, `a.b` string") == trie_brute([r[:4] for r in rows])
