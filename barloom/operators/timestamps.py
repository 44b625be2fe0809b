"""Mixed timestamp notations to one UTC instant.

All notations are one regex alternation with named groups. A single ``regexp_replace`` pulls every
component out of a stamp at once; calendar ranges are then checked and the instant is assembled
with integer day arithmetic. Everything up to the result stays inside the JVM.

Wall-clock stamps are tried with the zone's offset a day before and a day after. A candidate holds
if the zone really has that offset at that instant: none holds in a skipped hour, two hold in a
repeated hour. A repeated hour is decided by the bar's place in its series.
"""

from __future__ import annotations

import zoneinfo

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.session import stash

# English month abbreviations in calendar order.
MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]

# Zone abbreviations and their minutes east of UTC.
ABBREVIATIONS = {
    "utc": 0, "gmt": 0, "z": 0, "ut": 0, "wet": 0, "west": 60, "bst": 60, "cet": 60, "cest": 120, "eet": 120,
    "eest": 180, "msk": 180, "ist": 330, "npt": 345, "sgt": 480, "hkt": 480, "awst": 480, "jst": 540, "kst": 540,
    "acst": 570, "acdt": 630, "aest": 600, "aedt": 660, "nzst": 720, "nzdt": 780, "nst": -210, "ndt": -150,
    "ast": -240, "adt": -180, "est": -300, "edt": -240, "cst": -360, "cdt": -300, "mst": -420, "mdt": -360,
    "pst": -480, "pdt": -420, "akst": -540, "akdt": -480, "hst": -600,
}

# Abbreviations that mean something else at some venues.
LOCAL_MEANINGS = [
    ("ist", ["Europe/Dublin"], 60),
    ("ist", ["Asia/Jerusalem", "Asia/Tel_Aviv", "Israel"], 120),
    ("cst", ["Asia/Shanghai", "Asia/Taipei", "Asia/Macau", "PRC", "ROC"], 480),
    ("bst", ["Asia/Dhaka"], 360),
]

NUMBERS = ["year", "month", "day", "first", "second", "hour", "minute", "sec", "s", "ms", "us", "ns"]
COMPONENTS = [*NUMBERS, "name", "frac", "half", "offset", "region", "word"]

MINUTE = 60_000_000
DAY = 86_400_000_000
SLACK = 61_000_000  # stamps may be cut to the minute


def _time(k: str, half: bool = False) -> str:
    text = rf"(?<hour{k}>\d{{1,2}}):(?<minute{k}>\d{{2}})(?::(?<sec{k}>\d{{2}})(?:[.,](?<frac{k}>\d{{1,9}}))?)?"
    return text + (rf"(?: ?(?<half{k}>[ap]m))?" if half else "")


def _zone(k: str) -> str:
    return (
        rf"(?: ?(?<offset{k}>z|[+-]\d{{2}}(?::?\d{{2}})?)(?:\[[a-z0-9_+/-]+\])?"
        rf"| (?<region{k}>[a-z_]+/[a-z0-9_+/-]+)|\[(?<region{k}x>[a-z_]+(?:/[a-z0-9_+-]+)*)\]| (?<word{k}>[a-z]{{1,5}}))?"
    )


def stamp_pattern() -> tuple[str, str]:
    """The alternation over all notations, and the replacement that lists its components."""
    ways = [
        # year first, one separator throughout
        rf"(?<yearA>\d{{4}})(?<sepA>[-/.])(?<monthA>\d{{1,2}})\k<sepA>(?<dayA>\d{{1,2}})(?:[t ]{_time('A')}{_zone('A')})?",
        # two numbers and the year: the feed's date order tells day from month
        rf"(?<firstB>\d{{1,2}})(?<sepB>[-/.])(?<secondB>\d{{1,2}})\k<sepB>(?<yearB>\d{{4}})(?:[t ]{_time('B', half=True)}{_zone('B')})?",
        # digits only, or with a T
        rf"(?<yearC>\d{{4}})(?<monthC>\d{{2}})(?<dayC>\d{{2}})(?:t?(?<hourC>\d{{2}})(?<minuteC>\d{{2}})(?<secC>\d{{2}})?(?:[.,](?<fracC>\d{{1,9}}))?{_zone('C')})?",
        # month by name, weekday allowed
        rf"(?:[a-z]{{3,9}},? )?(?<dayD>\d{{1,2}})[ -](?<nameD>[a-z]{{3,9}})[ -](?<yearD>\d{{4}})(?:,? {_time('D', half=True)}{_zone('D')})?",
        # counts since 1970
        r"(?<sE>\d{10})|(?<msE>\d{13})|(?<usE>\d{16})|(?<nsE>[1-8]\d{18})",
    ]
    pattern = r"(?i)^[\s ]*(?:" + "|".join(f"(?:{w})" for w in ways) + r")[\s ]*$"
    groups = {
        "year": "ABCD", "month": "AC", "name": "D", "day": "ACD", "first": "B", "second": "B", "hour": "ABCD", "minute": "ABCD",
        "sec": "ABCD", "frac": "ABCD", "half": "BD", "offset": "ABCD", "region": ["A", "B", "C", "D", "Ax", "Bx", "Cx", "Dx"],
        "word": "ABCD", "s": "E", "ms": "E", "us": "E", "ns": "E",
    }
    return pattern, "!" + "!".join("".join(f"${{{c}{k}}}" for k in groups[c]) for c in COMPONENTS)


def days_from_civil(y: Column, m: Column, d: Column) -> Column:
    """Days since 1970-01-01 of a proleptic Gregorian date, by integer arithmetic (years from 1 on)."""
    months = y * 12 + m - 3  # counted from March, so that the leap day ends a year
    year, month = F.call_function("div", months, F.lit(12)), months % 12
    part = lambda n: F.call_function("div", year, F.lit(n))
    return year * 365 + part(4) - part(100) + part(400) + F.call_function("div", month * 153 + 2, F.lit(5)) + d - 1 - 719468


def _lookup(key: Column, table: dict) -> Column:
    """A folded literal map: one expression, however many entries."""
    return F.element_at(F.str_to_map(F.lit(";".join(f"{k}={v}" for k, v in table.items())), F.lit(";"), F.lit("=")), key)


def _offset_at(us: Column, zone: Column) -> Column:
    return F.unix_micros(F.from_utc_timestamp(F.timestamp_micros(us), zone)) - us


def parse_stamps(df: DataFrame, feeds: DataFrame, stamp: str = "timestamp") -> DataFrame:
    """Adds ``early_us`` and ``late_us``: the instants that a stamp can mean.

    Both are null where the stamp states no instant, they are equal where it states one, and they
    differ where the wall clock showed the time twice. ``local_us`` is the clock reading itself.
    Null or meaningless text, dates or times that don't exist, skipped wall-clock times, unknown
    zones, and stamps without zone from a feed without ``venue_zone`` (or an unknown feed) have no
    instant.
    """
    pattern, parts = stamp_pattern()
    zones = {z.lower(): z for z in sorted(zoneinfo.available_timezones()) if "/" in z or z.isalpha()}
    venues = feeds.groupBy(F.col("feed").alias("_feed")).agg(F.max(_lookup(F.lower("venue_zone"), zones)).alias("_venue"), F.max(F.upper(F.trim("date_order"))).alias("_order"))

    x = df.join(venues, df["feed"] == F.col("_feed"), "left")
    x = x.withColumn("_all", F.regexp_replace(stamp, pattern, parts))
    x = x.withColumn("_c", F.when(F.col("_all").startswith("!"), F.split("_all", "!", -1)))
    x = x.withColumn("_n", F.transform(F.slice("_c", 2, len(NUMBERS)), lambda t: F.nullif(t, F.lit("")).cast("long")))
    text = {c: F.col("_c")[i + 1] for i, c in enumerate(COMPONENTS)}
    num = {c: F.col("_n")[i] for i, c in enumerate(NUMBERS)}

    dmy = F.col("_order") == "DMY"
    name = F.array_position(F.lit(MONTHS), F.lower(F.substring(text["name"], 1, 3)))
    month = F.coalesce(num["month"], F.nullif(name, F.lit(0)), F.when(dmy, num["second"]).when(F.col("_order") == "MDY", num["first"]))
    day = F.coalesce(num["day"], F.when(dmy, num["first"]).when(F.col("_order") == "MDY", num["second"]))
    clean = lambda c: F.nullif(F.lower(c), F.lit(""))
    x = x.select(
        *df.columns, "_venue", num["year"].alias("_y"), month.alias("_m"), day.alias("_d"),
        F.coalesce(num["hour"], F.lit(0)).alias("_h"), F.coalesce(num["minute"], F.lit(0)).alias("_mi"), F.coalesce(num["sec"], F.lit(0)).alias("_s"),
        F.rpad(text["frac"], 6, "0").cast("long").alias("_f"), clean(text["half"]).alias("_half"),
        clean(text["offset"]).alias("_off"), clean(text["region"]).alias("_region"), clean(text["word"]).alias("_word"),
        F.coalesce(num["s"] * 1_000_000, num["ms"] * 1000, num["us"], F.floor(num["ns"] / 1000)).alias("_epoch"),
    )
    leap = F.expr("cast(_m = 2 and _y % 4 = 0 and (_y % 100 <> 0 or _y % 400 = 0) as int)")
    length = F.expr("get(array(31, 28, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31), cast(_m - 1 as int))") + leap
    x = x.withColumn("_h", F.expr("case when _half is null then _h when _h between 1 and 12 then _h % 12 + if(_half = 'pm', 12, 0) end"))
    good = F.expr("_y between 1 and 9999 and _m between 1 and 12 and _h between 0 and 23 and _mi between 0 and 59 and _s between 0 and 59")
    x = x.withColumn("_day", F.when(good, F.when(F.col("_d").between(1, length), days_from_civil(F.col("_y"), F.col("_m"), F.col("_d")))))
    x = x.withColumn("local_us", F.expr(f"_day * {DAY} + ((_h * 60 + _mi) * 60 + _s) * 1000000 + _f"))

    digits = F.regexp_replace("_off", "[^0-9]", "")
    off_h, off_m = F.substring(digits, 1, 2).cast("long"), F.rpad(F.substring(digits, 3, 2), 2, "0").cast("long")
    written = F.when(F.col("_off") == "z", 0).when((off_h <= 18) & (off_m <= 59), F.when(F.col("_off").startswith("-"), -1).otherwise(1) * (off_h * 60 + off_m))
    meaning = F.lit(None).cast("int")
    for abbr, places, minutes in LOCAL_MEANINGS:
        meaning = F.when((F.col("_word") == abbr) & F.col("_venue").isin(places), minutes).otherwise(meaning)
    fixed = F.when(F.col("_off").isNotNull(), written).when(F.col("_word").isNotNull(), F.coalesce(meaning, _lookup(F.col("_word"), ABBREVIATIONS).cast("long")))
    named = F.col("_off").isNotNull() | F.col("_word").isNotNull()
    x = x.withColumn("_fixed", F.col("local_us") - fixed * MINUTE)
    x = x.withColumn("_zone", F.when(~named & F.col("local_us").isNotNull(), F.when(F.col("_region").isNotNull(), _lookup(F.col("_region"), zones)).otherwise(F.col("_venue"))))
    wall, zone = F.col("local_us"), F.col("_zone")
    x = x.withColumns({"_o1": F.when(zone.isNotNull(), _offset_at(wall - DAY, zone)), "_o2": F.when(zone.isNotNull(), _offset_at(wall + DAY, zone))})
    x = x.withColumns({f"_k{i}": F.when(_offset_at(wall - F.col(f"_o{i}"), zone) == F.col(f"_o{i}"), wall - F.col(f"_o{i}")) for i in (1, 2)})
    one = F.coalesce("_epoch", "_fixed")
    return x.select(
        *df.columns,
        "local_us",
        F.coalesce(one, F.least("_k1", "_k2")).alias("early_us"),
        F.coalesce(one, F.greatest("_k1", "_k2")).alias("late_us"),
    )


def resolve_stamps(parsed: DataFrame, bucket: int = 4096) -> DataFrame:
    """One instant for each row of ``parse_stamps``: ``utc_us``; rows without instant are dropped.

    Bars of a series (feed, symbol) rise in time with ``bar_index`` and lie at least a quarter of an
    hour apart, so u - 15 min * bar_index never falls along a series. A repeated hour is late if an
    earlier bar's value exceeds that of its early reading, early if a later bar's value is below
    that of its late reading; what is decided for a bar binds its neighbours in the same hour. What
    is left goes to the reading nearer to the line between the neighbours.

    Series are cut into buckets of ``bucket`` bar numbers, with running bounds carried from bucket
    to bucket, so that no task holds a whole series. Twice-shown times of rows without bar_index
    can't be told apart and are dropped; so is everything without an instant.
    """
    series = ["feed", "symbol"]
    keys = [*series, "_b"]
    pace = 15 * MINUTE
    parsed = stash(parsed, "stamps")  # else Catalyst inlines the whole parse into each filter below
    plain = parsed.where(F.col("early_us") == F.col("late_us")).select(*parsed.columns, F.col("early_us").alias("utc_us"))
    x = parsed.where(F.col("early_us").isNotNull() & F.col("bar_index").isNotNull()).withColumn("_b", F.floor(F.col("bar_index") / bucket))
    sure = F.when(F.col("early_us") == F.col("late_us"), F.col("early_us"))
    x = x.withColumns({"_u": sure, "_w": sure - F.col("bar_index") * pace})
    at = F.when(F.col("_u").isNotNull(), F.struct("bar_index", "_u"))
    sums = x.groupBy(*keys).agg(F.max("_w").alias("hi"), F.min("_w").alias("lo"), F.max(at).alias("last"), F.min(at).alias("first"), F.max(F.col("early_us") != F.col("late_us")).alias("amb"))
    before = Window.partitionBy(*series).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    after = Window.partitionBy(*series).orderBy(F.col("_b").desc()).rowsBetween(Window.unboundedPreceding, -1)
    carry = sums.select(
        *[F.col(k).alias(f"c{k}") for k in keys], "amb",
        F.max("hi").over(before).alias("hi0"), F.last("last", ignorenulls=True).over(before).alias("last0"),
        F.min("lo").over(after).alias("lo0"), F.last("first", ignorenulls=True).over(after).alias("first0"),
    ).where("amb")
    asked = carry.select(*[F.col(f"c{k}") for k in keys])
    x = x.join(asked, [x[k].eqNullSafe(asked[f"c{k}"]) for k in keys], "left_semi")
    w = Window.partitionBy(*keys).orderBy("bar_index")
    back = Window.partitionBy(*keys).orderBy(F.col("bar_index").desc())  # running frames of a reversed order: one pass
    upto, onward = w.rangeBetween(Window.unboundedPreceding, 0), back.rangeBetween(Window.unboundedPreceding, 0)
    x = x.withColumns({"_hi": F.max("_w").over(upto), "_lo": F.min("_w").over(onward), "_last": F.max(at).over(upto), "_first": F.min(at).over(onward)})
    twice = x.where((F.col("early_us") != F.col("late_us")) & F.col("bar_index").isNotNull())
    twice = twice.join(carry, [twice[k].eqNullSafe(carry[f"c{k}"]) for k in keys], "left")
    lead = F.col("bar_index") * pace
    twice = twice.withColumns({
        "_hi": F.greatest("_hi", "hi0"), "_lo": F.least("_lo", "lo0"), "_last": F.coalesce("_last", "last0"), "_first": F.coalesce("_first", "first0"),
        "_hour": F.floor((F.col("local_us") + DAY // 2) / DAY), "_v": F.col("local_us") - lead,
    })
    hour = Window.partitionBy(*series, "_hour").orderBy("bar_index")
    twice = twice.withColumns({
        "_late": F.coalesce((F.col("_hi") > F.col("early_us") - lead + SLACK), F.lit(False)) | F.coalesce(F.max("_v").over(hour.rangeBetween(Window.unboundedPreceding, -1)) > F.col("_v") + SLACK, F.lit(False)),
        "_early": F.coalesce((F.col("_lo") < F.col("late_us") - lead - SLACK), F.lit(False)) | F.coalesce(F.min("_v").over(hour.rangeBetween(1, Window.unboundedFollowing)) < F.col("_v") - SLACK, F.lit(False)),
    })
    twice = twice.withColumns({
        "_late": F.max("_late").over(hour.rangeBetween(Window.unboundedPreceding, 0)),
        "_early": F.max("_early").over(hour.rangeBetween(0, Window.unboundedFollowing)),
    })
    i, (k0, u0), (k1, u1) = F.col("bar_index"), (F.col("_last.bar_index"), F.col("_last._u")), (F.col("_first.bar_index"), F.col("_first._u"))
    guess = u0 + (u1 - u0) * ((i - k0) / F.when(k1 > k0, k1 - k0))
    nearer = F.when(F.coalesce(F.abs(guess - F.col("late_us")) < F.abs(guess - F.col("early_us")), F.lit(False)), F.col("late_us")).otherwise(F.col("early_us"))
    told = F.when(F.col("_late") & ~F.col("_early"), F.col("late_us")).when(F.col("_early") & ~F.col("_late"), F.col("early_us")).otherwise(nearer)
    return plain.unionByName(twice.select(*parsed.columns, told.alias("utc_us")))


def normalise_timestamps(bars: DataFrame, feeds: DataFrame, stamp: str = "timestamp") -> DataFrame:
    """(row_id, utc_us): the UTC instant, in microseconds, of each row whose stamp states one.

    Repeated rows each give their row. Extra columns are ignored, whatever their names; an empty
    table gives an empty result.
    """
    need = bars.select("row_id", "feed", "symbol", F.col("bar_index").cast("long").alias("bar_index"), F.col(stamp).cast("string").alias("_stamp"))
    parsed = parse_stamps(need, feeds.select("feed", "venue_zone", "date_order"), "_stamp").drop("_stamp")
    return resolve_stamps(parsed).select("row_id", "utc_us")
