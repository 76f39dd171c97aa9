"""Column expressions of the tracking and text queries."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Metres in a foot; the hoops of a court, in metres; the bounds of the speed zones, in metres a second.
FOOT = 0.3048
HOOPS = ((1.6764, 7.62), (26.9748, 7.62))
SLOW_BELOW, FAST_ABOVE = 2.0, 7.0
ZONES = ("slow", "normal", "fast")
REBOUNDS = r"\(Off:(\d+) Def:(\d+)\)"


def metres(feet: Column) -> Column:
    """Feet as metres; null for null and NaN."""
    feet = feet.cast("double")
    return F.when(~F.isnan(feet), feet * FOOT)


def sound(v: Column) -> Column:
    """A number, or null where it is NaN."""
    v = v.cast("double")
    return F.when(~F.isnan(v), v)


def euclid(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.sqrt(F.pow(x1 - x2, F.lit(2.0)) + F.pow(y1 - y2, F.lit(2.0)))


def hoop_distance(x: Column, y: Column) -> Column:
    """Metres to the nearer hoop."""
    return F.least(*[euclid(x, y, F.lit(hx), F.lit(hy)) for hx, hy in HOOPS])


def clock_seconds(text: Column) -> Column:
    """``M:SS`` as seconds; null where a part is missing or no number."""
    parts = F.split(text, ":")
    return (F.get(parts, F.lit(0)).try_cast("int") * 60 + F.get(parts, F.lit(1)).try_cast("int")).cast("double")


def rebound_count(text: Column, which: int) -> Column:
    """Offensive (1) or defensive (2) rebounds so far, as a description tells them; null without them."""
    return F.regexp_extract(text, REBOUNDS, which).try_cast("int")


def zone(speed: Column, slow: float = SLOW_BELOW, fast: float = FAST_ABOVE) -> Column:
    """slow, fast, or normal, which an unknown speed is too."""
    return F.when(speed < slow, "slow").when(speed > fast, "fast").otherwise("normal")


def jaccard(a: Column, b: Column) -> Column:
    """Shared elements of two sets as a part of all; null for two empty ones."""
    both = F.size(F.array_intersect(a, b))
    return F.try_divide(both.cast("double"), (F.size(a) + F.size(b) - both).cast("double"))


def square_distance(a: Column, b: Column) -> Column:
    """Squared Euclidean distance of two arrays, in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda p, q: F.pow(p.cast("double") - q.cast("double"), F.lit(2.0))), F.lit(0.0), lambda s, v: s + v)


def char_at(text: Column, place: int) -> Column:
    """Code of the character at a place counted from 0; -1 behind the end."""
    return F.when(F.length(text) > place, F.ascii(F.substring(text, place + 1, 1))).otherwise(-1)
