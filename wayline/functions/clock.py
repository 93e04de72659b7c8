"""Clock strings and minutes of the day, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY = 1440
ZONE = "Asia/Tbilisi"


def to_minutes(clock: Column) -> Column:
    """Minutes after midnight of "HH:MM"."""
    parts = F.split(clock, ":")
    return (parts[0].cast("int") * 60 + parts[1].cast("int")).cast("bigint")


def to_clock(minutes: Column) -> Column:
    """"HH:MM" of minutes, rounded, any number of days on."""
    m = F.pmod(F.floor(minutes + 0.5), F.lit(DAY))
    return F.concat(F.lpad(F.floor(m / 60).cast("string"), 2, "0"), F.lit(":"), F.lpad((m % 60).cast("string"), 2, "0"))


def local_minutes(instant: Column) -> Column:
    """Minutes after midnight in the city's zone; the instant is in UTC."""
    local = F.from_utc_timestamp(instant, ZONE)
    return (F.hour(local) * 60 + F.minute(local)).cast("bigint")


def next_departure(minutes: Column, now: Column) -> Column:
    """Minutes until the first of the listed times that is not before now, else until tomorrow's first; null if none."""
    later = F.filter(minutes, lambda m: m >= now)
    return F.when(F.size(minutes) == 0, None).when(F.size(later) > 0, F.element_at(later, 1) - now).otherwise(DAY - now + F.element_at(minutes, 1))


def countdown(seconds: Column, confidence: Column) -> Column:
    """What the board shows of an estimate, null once it is gone."""
    m = F.ceil(seconds / 60)
    return F.when(seconds < -90, None).when(seconds <= 45, "approaching").otherwise(F.concat(F.when(confidence == "slow", "~").otherwise(""), m.cast("string"), F.lit(" min")))


def duration(minutes: Column) -> Column:
    """Whole minutes, up, at least one, as hours and minutes."""
    m = F.greatest(F.lit(1), F.ceil(minutes - 1e-9))
    h, rest = F.floor(m / 60), m % 60
    return F.when(h == 0, F.concat(m.cast("string"), F.lit(" min"))).when(rest == 0, F.concat(h.cast("string"), F.lit(" h"))).otherwise(F.concat(h.cast("string"), F.lit(" h "), rest.cast("string"), F.lit(" min")))


def distance_label(metres: Column) -> Column:
    """Tens of metres below a kilometre, else kilometres with one decimal."""
    tens = F.greatest(F.lit(10), F.floor(metres / 10 + 0.5) * 10).cast("bigint")
    tenths = F.floor(metres / 100 + 0.5).cast("bigint")
    km = F.concat(F.floor(tenths / 10).cast("string"), F.lit("."), (tenths % 10).cast("string"), F.lit(" km"))
    return F.when(metres < 1000, F.concat(tens.cast("string"), F.lit(" m"))).otherwise(km)


def ordinal(n: Column) -> Column:
    """1st, 2nd, 3rd, 4th, 11th."""
    ten, hundred = n % 10, n % 100
    end = F.when(hundred.between(11, 13), "th").when(ten == 1, "st").when(ten == 2, "nd").when(ten == 3, "rd").otherwise("th")
    return F.concat(n.cast("string"), end)


def slavic_plural(n: Column) -> Column:
    """one, few or many."""
    ten, hundred = n % 10, n % 100
    return F.when((ten == 1) & (hundred != 11), "one").when(ten.between(2, 4) & ~hundred.between(12, 14), "few").otherwise("many")
