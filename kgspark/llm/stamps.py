"""Mixed timestamps to UTC: candidate interpretations as rows, votes per source, the candidate of best rank kept.

A slashed stamp explodes into a day-first and a month-first candidate, those
that no calendar has left out. Slashed stamps with one candidate are votes of their source. The votes
give each source a verdict, which ranks the two candidates of its other
slashed stamps. All of it is column expressions; sources that hold a large share of
the stamps meet a broadcast of fewer than hot.SHARE verdicts, the others a shuffle.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from kgspark.operators.hot import with_share
from kgspark.session import Scratch, materialise

#: White space taken off both ends, month names, and the forms of stamps.
WHITE = " \t\n\x0b\x0c\r"
MONTHS = "JanFebMarAprMayJunJulAugSepOctNovDec"
YEAR = "20[0-9][0-9]"
NAMED = "(Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)"
DATE = rf"({YEAR}-[0-9][0-9]-[0-9][0-9]|{YEAR}[0-9][0-9][0-9][0-9]|[0-9][0-9][.][0-9][0-9][.]{YEAR}|[0-9][0-9] {NAMED} {YEAR}|[0-9][0-9]/[0-9][0-9]/{YEAR})"
TIME = "([T ][0-9][0-9]:[0-9][0-9](:[0-9][0-9])?( ?[AP]M)?( ?(Z|[+-][0-9][0-9]:?[0-9][0-9]))?)?"
STAMP = DATE + TIME
#: The winner needs more than this many times the other's votes.
ODDS = 10
DAY_US = 86_400_000_000


def _number(text: Column, start: int, length: int = 2) -> Column:
    return F.substring(text, start, length).try_cast("int")


def known_zone(spark: SparkSession, zone: Column) -> Column:
    """Whether a zone can be reckoned with: a region name that the JVM knows, or an offset +hh:mm."""
    names = sorted(spark.sparkContext._jvm.java.time.ZoneId.getAvailableZoneIds())
    return F.coalesce(zone.isin(names) | zone.rlike(r"^[+-](0[0-9]|1[0-7]):[0-5][0-9]\z"), F.lit(False))


def _offset(at_us: Column, zone: Column) -> Column:
    """Microseconds that the zone's wall clock is ahead of UTC at an instant."""
    return F.unix_micros(F.from_utc_timestamp(F.timestamp_micros(at_us), zone)) - at_us


def placed(wall_us: Column, zone: Column) -> tuple[Column, Column]:
    """(instant, whether the zone skips or repeats it) of a wall time; such times take the offset after the change.

    The JVM takes the offset before a change. A skipped time then does not come back as itself, and what it comes back with is the
    offset after; a repeated one also comes back with the offset of a day later. No zone changes twice within a day.
    """
    first = F.unix_micros(F.to_utc_timestamp(F.timestamp_micros(wall_us), zone))
    after = _offset(first, zone)
    skipped = first + after != wall_us
    second = wall_us - _offset(first + DAY_US, zone)
    repeated = (second > first) & (second + _offset(second, zone) == wall_us)
    return F.when(skipped, wall_us - after).when(repeated, second).otherwise(first), skipped | repeated


def _days(year: Column, month: Column) -> Column:
    leap = (year % 4 == 0) & ((year % 100 != 0) | (year % 400 == 0))
    return F.when(month == 2, F.when(leap, 29).otherwise(28)).when(month.isin(4, 6, 9, 11), 30).otherwise(31)


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with value standing once in the expression: the optimiser copies what it pushes through a projection."""
    return F.transform(F.array(value), then)[0]


def _form(s: Column) -> Column:
    return (
        F.when(s.rlike(r"^[0-9]{10}\z"), "seconds").when(s.rlike(r"^[0-9]{13}\z"), "milliseconds").when(~s.rlike(rf"^{STAMP}\z"), None)
        .when(F.substring(s, 5, 1) == "-", "dashed").when(F.substring(s, 3, 1) == ".", "dotted").when(F.substring(s, 3, 1) == " ", "named").when(F.substring(s, 3, 1) == "/", "slashed").otherwise("compact")
    )


def _date_parts(s: Column, form: Column) -> Column:
    """Struct of form, year, a and b (the two other numbers of a date: day and month, or as they stand when slashed), rest (from the time on) and epoch_us."""
    of = lambda *places: F.coalesce(*[F.when(form == name, part) for name, part in places])
    late = _number(s, 7, 4)
    month = ((F.position(F.substring(s, 4, 3), F.lit(MONTHS)) + 2) / 3).cast("int")
    at = F.when(form == "compact", 9).when(form == "named", 12).otherwise(11)
    return F.struct(
        form.alias("form"), of(("dashed", _number(s, 1, 4)), ("compact", _number(s, 1, 4)), ("dotted", late), ("slashed", late), ("named", _number(s, 8, 4))).alias("year"),
        of(("dashed", _number(s, 9)), ("compact", _number(s, 7)), ("dotted", _number(s, 1)), ("slashed", _number(s, 1)), ("named", _number(s, 1))).alias("a"),
        of(("dashed", _number(s, 6)), ("compact", _number(s, 5)), ("dotted", _number(s, 4)), ("slashed", _number(s, 4)), ("named", month)).alias("b"),
        F.when(form.isNotNull() & ~form.endswith("seconds"), F.substring(s, at, F.lit(64))).alias("rest"),
        F.when(form == "seconds", s.try_cast("bigint") * 1_000_000).when(form == "milliseconds", s.try_cast("bigint") * 1000).alias("epoch_us"),
    )


def _time_parts(r: Column) -> Column:
    """Struct of h, mi, sec, half (0 for AM, 12 for PM) and off (+hhmm, +0000 for Z) of what follows a date; nulls for what is not given."""
    timed = r != ""
    sign = F.regexp_extract(r, r"[+-][0-9:]+\z", 0)
    return F.struct(
        F.when(timed, _number(r, 2)).alias("h"), F.when(timed, _number(r, 5)).alias("mi"), F.when(timed & (F.substring(r, 7, 1) == ":"), _number(r, 8)).alias("sec"),
        F.when(timed & r.contains("M"), F.when(r.contains("P"), 12).otherwise(0)).alias("half"),
        F.when(timed & r.endswith("Z"), "+0000").when(timed & (sign != ""), F.replace(sign, F.lit(":"))).alias("off"),
    )


def _clock(t: Column) -> Column:
    """Struct of clock_us (null for an impossible time) and offset_us of _time_parts()."""
    h, mi, sec, half, off = (t[c] for c in ("h", "mi", "sec", "half", "off"))
    zero = F.lit(0)
    off_h, off_m = _number(off, 2), _number(off, 4)
    good = F.when(half.isNull(), F.coalesce(h, zero).between(0, 23)).otherwise(h.between(1, 12)) & F.coalesce(mi, zero).between(0, 59) & F.coalesce(sec, zero).between(0, 59)
    good = good & (off.isNull() | (off_h.between(0, 14) & off_m.between(0, 59)))
    hour = F.coalesce(F.when(half.isNull(), h).otherwise(h % 12 + half), zero)
    signed = (off_h * 60 + off_m) * F.when(F.substring(off, 1, 1) == "-", -1).otherwise(1)
    return F.struct(F.when(good, (hour * 3600 + F.coalesce(mi, zero) * 60 + F.coalesce(sec, zero)).cast("bigint") * 1_000_000).alias("clock_us"), F.when(good, signed.cast("bigint") * 60_000_000).alias("offset_us"))


def _readings(d: Column, c: Column, zoned: Column) -> Column:
    """Struct of shape, epoch_us, offset_us and found (array of the possible readings: order, wall_us) of date parts and clock."""
    form, y, a, b = (d[x] for x in ("form", "year", "a", "b"))
    usable = c["clock_us"].isNotNull() & (c["offset_us"].isNotNull() | zoned)
    two = (form == "slashed") & (a != b)

    def reading(order: str, month: Column, day: Column, asked: Column) -> Column:
        good = usable & asked & month.between(1, 12) & day.between(1, _days(y, month))
        date = F.make_date(F.when(good, y), F.when(good, month), F.when(good, day))
        return F.when(good, F.struct(F.lit(order).alias("order"), (F.unix_date(date).cast("bigint") * DAY_US + c["clock_us"]).alias("wall_us")))

    found = F.array_compact(F.array(reading("d", b, a, F.lit(True)), reading("m", a, b, two)))
    shape = F.when(form.endswith("seconds"), "epoch").when(two, "slashed").when(form.isNotNull(), "plain")
    return F.struct(shape.alias("shape"), d["epoch_us"].alias("epoch_us"), c["offset_us"].alias("offset_us"), found.alias("found"))


def candidates(stamps: DataFrame) -> DataFrame:
    """Candidates of stamps: each row of stamps with its possible readings (a null one where there is none).

    Columns: stamp_id, source (never null: "=" and the name, "" for null), zone (null if unknown), shape (epoch, plain or slashed; null
    for other texts), epoch_us, offset_us, n (number of readings), reading (order d or m, wall_us).
    """
    zone = F.when(known_zone(stamps.sparkSession, F.col("zone")), F.col("zone"))
    parsed = _let(F.btrim(F.col("raw").cast("string"), F.lit(WHITE)), lambda s: _let(_date_parts_of(s), lambda d: _let(_clock_of(d), lambda c: _readings(d, c, zone.isNotNull()))))
    rows = stamps.select(F.col("stamp_id").cast("bigint").alias("stamp_id"), F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("")).alias("source"), zone.alias("zone"), parsed.alias("p"))
    return rows.select("stamp_id", "source", "zone", "p.shape", "p.epoch_us", "p.offset_us", F.size("p.found").alias("n"), F.explode_outer("p.found").alias("reading"))


def _date_parts_of(s: Column) -> Column:
    return _let(_form(s), lambda form: _date_parts(s, form))


def _clock_of(d: Column) -> Column:
    return _let(_time_parts(d["rest"]), _clock)


def verdicts(cands: DataFrame) -> DataFrame:
    """source, order (d or m), rule (votes or default), hot, for each source with a stamp of two readings.

    Slashed stamps with one reading are votes; the order with over ODDS times the other's votes wins, else day first.
    """
    slashed = cands.where("shape = 'slashed' and n > 0")
    order, one = F.col("reading.order"), F.col("n") == 1
    counts = slashed.groupBy("source").agg(F.count_if(one & (order == "d")).alias("d"), F.count_if(one & (order == "m")).alias("m"), F.count_if(~one).alias("asks")).where("asks > 0")
    won = F.when(F.col("d") > ODDS * F.col("m"), "d").when(F.col("m") > ODDS * F.col("d"), "m")
    return with_share(counts, "asks").select("source", F.coalesce(won, F.lit("d")).alias("verdict"), F.when(won.isNotNull(), "votes").otherwise("default").alias("rule"), "hot")


def normalise(stamps: DataFrame) -> DataFrame:
    """stamp_id, utc_us (null for bad ones), rule (bad, epoch, votes, default, plain), ambiguous: one row for each row of stamps.

    stamps: stamp_id, source, zone, raw; other columns are ignored. Null, empty, overlong and impossible texts are bad. A null source
    is a source of its own. Where no offset is given, a null zone or one that the JVM does not know makes the stamp bad, so it does not
    vote either; with an offset the zone has no say. Repeated rows each give a row and each vote. A tie of votes is day first. A reading both orders agree on
    (05/05/2024) is plain and no vote. An empty table gives an empty result. Candidates are written once and deleted; the result is a
    written table of the caller's.
    """
    with Scratch(stamps.sparkSession, "stamps") as tmp:
        return materialise(_kept(tmp.write(candidates(stamps), "candidates")), "stamps-utc")


def _kept(cands: DataFrame) -> DataFrame:
    asks = (F.col("shape") == "slashed") & (F.col("n") == 2)
    judged = verdicts(cands)
    settled = cands.where(~F.coalesce(asks, F.lit(False))).withColumns({"verdict": F.col("reading.order"), "rule": F.when(F.col("shape") == "epoch", "epoch").when(F.col("n") == 0, "bad").otherwise("plain")})
    open_, hot = cands.where(asks), judged.where("hot").drop("hot")
    warm = open_.join(F.broadcast(hot), "source")
    cold = open_.join(F.broadcast(hot.select("source")), "source", "left_anti").join(judged.where("not hot").drop("hot"), "source")
    ranked = settled.unionByName(warm.select(*settled.columns)).unionByName(cold.select(*settled.columns))
    rank = F.when(F.col("reading.order").eqNullSafe(F.col("verdict")), 1).otherwise(2)
    best = ranked.where(rank == 1)  # the readings of a stamp differ in order, so one of them has this rank
    safe = F.coalesce("zone", F.lit("UTC"))
    at, odd = placed(F.col("reading.wall_us"), safe)
    local = F.col("offset_us").isNull()
    utc = F.when(F.col("shape") == "epoch", F.col("epoch_us")).when(F.col("n") > 0, F.when(local, at).otherwise(F.col("reading.wall_us") - F.col("offset_us")))
    strange = F.col("rule").isin("votes", "default") | ((F.col("n") > 0) & local & odd)
    return best.select("stamp_id", utc.alias("utc_us"), F.when(F.col("shape").isNull(), "bad").otherwise(F.col("rule")).alias("rule"), F.coalesce(strange, F.lit(False)).alias("ambiguous"))
