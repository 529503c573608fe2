"""Dates, scores, narration and colour as Column expressions."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date, datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Recency decay per day, its floor, and the value for "never".
DECAY_PER_DAY = 0.0019
DECAY_FLOOR = 0.25
DECAY_NEVER = 0.5

# How long a provider record stays fresh, in days.
SHORT_AGE_DAYS = 7
LONG_AGE_DAYS = 90
RECENT_RELEASE_DAYS = 180
AIRING_STATUSES = ("Returning Series", "In Production", "Planned", "Pilot")

# Cost per step below which a path is called strong or moderate.
STRONG_BELOW = 5
MODERATE_BELOW = 8

# Hub penalty and confidence floor of a path step.
HUB_PENALTY = 0.45
CONFIDENCE_FLOOR = 0.1

# Raw similarity that maps to one half.
HALF_SCORE = 8

# How a suggestion reason reads, by predicate.
REASON_PHRASES = {
    "directed": "directed %d you've seen",
    "wrote": "wrote %d you've seen",
    "acted_in": "in %d you've seen",
    "composed_for": "scored %d you've seen",
    "shot": "shot %d you've seen",
    "explores_theme": "a theme in %d you've seen",
    "part_of_franchise": "%d of these you've seen",
    "based_on": "source of %d you've seen",
    "features_character": "appears in %d you've seen",
    "portrayed_by": "plays %d you've seen",
    "sequel_to": "leads to %d you've seen",
}
REASON_DEFAULT = "connected to %d you've seen"

# Which pixels carry a hue, the hue bins, and the band an accent is held to.
HUE_MIN_SATURATION = 0.18
HUE_LIGHTNESS = (0.12, 0.88)
HUE_BUCKETS = 24
ACCENT_SATURATION = 0.62
CLAMP_SATURATION = (0.45, 0.75)
CLAMP_LIGHTNESS = (0.46, 0.62)

AsOf = str | datetime | Column


def timestamp(as_of: AsOf) -> Column:
    """A point in time given as text, datetime or Column."""
    return as_of if isinstance(as_of, Column) else F.lit(as_of).cast("timestamp")


def today(as_of: AsOf | date) -> Column:
    """The calendar day of a point in time."""
    return timestamp(as_of).cast("date")


def micros(ts: Column) -> Column:
    """Microseconds since the epoch, of timestamps with and without a time zone."""
    return F.unix_micros(ts.cast("timestamp"))


def seconds_between(start: Column, end: Column) -> Column:
    """Elapsed seconds, with fraction."""
    return (micros(end) - micros(start)) / 1_000_000


def release_year(release: Column) -> Column:
    return F.year(release)


def recency_decay(ts: Column, as_of: AsOf) -> Column:
    """Exponential weight of an event's age with a floor; a middle value for NULL."""
    days = seconds_between(ts, timestamp(as_of)) / 86400.0
    return F.when(ts.isNull(), F.lit(DECAY_NEVER)).otherwise(
        F.greatest(F.lit(DECAY_FLOOR), F.exp(-DECAY_PER_DAY * days))
    )


def title_max_age(kind: Column, status: Column, release: Column, as_of: AsOf) -> Column:
    """Days a title's provider record may age before it counts as stale."""
    volatile = (
        release.isNull()
        | (release > F.date_sub(today(as_of), RECENT_RELEASE_DAYS))
        | ((kind == "show") & F.coalesce(status.isin(*AIRING_STATUSES), F.lit(False)))
    )
    return F.when(volatile, F.lit(SHORT_AGE_DAYS)).otherwise(F.lit(LONG_AGE_DAYS))


def stars_to_value(stars: Column) -> Column:
    """Half-stars as 1..10; NULL outside the range, for the caller to reject."""
    value = F.floor(stars * 2 + 0.5).cast("int")
    return F.when(value.between(1, 10), value)


def value_to_stars(value: Column) -> Column:
    return value / 2


def path_strength(cost: Column, steps: Column) -> Column:
    """Strong, Moderate or Faint by cost per step."""
    per_step = F.when(steps > 0, cost / steps).otherwise(cost)
    return (
        F.when(per_step < STRONG_BELOW, "Strong")
        .when(per_step < MODERATE_BELOW, "Moderate")
        .otherwise("Faint")
    )


def reason_phrase(predicate: Column, n: Column) -> Column:
    """One suggestion reason in words."""
    phrase = F.lit(None).cast("string")
    for name, text in REASON_PHRASES.items():
        phrase = F.when(predicate == name, F.format_string(text, n)).otherwise(phrase)
    return F.coalesce(phrase, F.format_string(REASON_DEFAULT, n))


def narrate(from_label: Column, steps: Column) -> Column:
    """A sentence from steps ``array<struct<template, label, object_label, object_type>>``.

    ``template`` names ``{subject}`` and ``{object}``; without one the step's label is used. From the
    second step on the subject is a pronoun for the node the step before ended on.
    """

    def fragment(step: Column, i: Column) -> Column:
        before = F.get(steps, i - 1)["object_type"]
        pronoun = F.when(before.isin("person", "character"), "who").otherwise("which")
        subject = F.when(i == 0, from_label).otherwise(pronoun)
        plain = F.concat_ws(" ", subject, step["label"], step["object_label"])
        filled = F.replace(
            F.replace(step["template"], F.lit("{subject}"), subject),
            F.lit("{object}"), step["object_label"],
        )
        return F.coalesce(filled, plain)

    text = F.array_join(F.transform(steps, fragment), ", ")
    return F.concat(F.upper(F.substring(text, 1, 1)), F.substring(text, F.lit(2), F.length(text)), F.lit("."))


def squash(score: Column, half: float = HALF_SCORE) -> Column:
    """Map an unbounded score onto 0..1."""
    return score / (score + F.lit(half))


def share_pct(a: Column, b: Column) -> Column:
    """Whole percent of a in b; NULL when b is 0."""
    return F.floor(100.0 * a / F.nullif(b, F.lit(0)) + 0.5).cast("int")


def bucket_of(col: Column, edges: Sequence[float]) -> Column:
    """How many of the ascending edges are at or below the value."""
    return F.size(F.filter(F.array(*[F.lit(e) for e in edges]), lambda e: e <= col))


def tuple_le(left: Sequence[Column], right: Sequence[Column]) -> Column:
    """Row-value comparison, left at or before right."""
    return F.struct(*[c.alias(f"k{i}") for i, c in enumerate(left)]) <= F.struct(
        *[c.alias(f"k{i}") for i, c in enumerate(right)]
    )


def edge_cost(weight: Column, degree: Column, confidence: Column) -> Column:
    """Cost of a step: its weight, more for a crowded target and less confidence."""
    crowding = 1 + HUB_PENALTY * F.log1p(F.coalesce(degree, F.lit(0)).cast("double"))
    return weight * crowding / F.greatest(F.coalesce(confidence, F.lit(1.0)), F.lit(CONFIDENCE_FLOOR))


def edge_attributes(**cols: Column) -> Column:
    """Attributes of an edge as JSON without its NULLs."""
    return F.to_json(F.struct(*[c.alias(n) for n, c in cols.items()]), {"ignoreNullFields": "true"})


def hsl(r: Column, g: Column, b: Column) -> Column:
    """Hue in degrees, saturation and lightness of 0..255 channels."""
    rn, gn, bn = r / 255.0, g / 255.0, b / 255.0
    high, low = F.greatest(rn, gn, bn), F.least(rn, gn, bn)
    span = high - low
    light = (high + low) / 2
    sat = F.when(span == 0, F.lit(0.0)).otherwise(
        span / F.when(light > 0.5, 2 - high - low).otherwise(high + low)
    )
    sixth = (
        F.when(span == 0, F.lit(0.0))
        .when(high == rn, (gn - bn) / span + F.when(gn < bn, 6).otherwise(0))
        .when(high == gn, (bn - rn) / span + 2)
        .otherwise((rn - gn) / span + 4)
    )
    return F.struct((sixth * 60).alias("h"), sat.alias("s"), light.alias("l"))


def rgb_hex(hue: Column, sat: Column, light: Column) -> Column:
    """``#RRGGBB`` of a hue in degrees, saturation and lightness."""
    reach = sat * F.least(light, 1 - light)

    def channel(shift: int) -> Column:
        k = F.pmod(F.lit(shift) + hue / 30, F.lit(12.0))
        v = light - reach * F.greatest(F.lit(-1.0), F.least(k - 3, 9 - k, F.lit(1.0)))
        level = F.floor(F.greatest(F.lit(0.0), F.least(F.lit(1.0), v)) * 255 + 0.5)
        return F.lpad(F.hex(level), 2, "0")

    return F.concat(F.lit("#"), channel(0), channel(8), channel(4))


def accent_color(pixels: DataFrame, key: str = "image_id") -> DataFrame:
    """One accent colour per image from (key, r, g, b) pixels; NULL when no pixel carries a hue.

    Pixels vote for a hue bin with their saturation, the winning bin is averaged as a circular mean,
    and saturation and lightness are held to a band. Only 24 partial sums per image are shuffled.
    """
    c = hsl(F.col("r"), F.col("g"), F.col("b"))
    p = pixels.select(key, c["h"].alias("h"), c["s"].alias("s"), c["l"].alias("l"))
    coloured = (F.col("s") >= HUE_MIN_SATURATION) & F.col("l").between(*HUE_LIGHTNESS)
    bins = F.least(F.lit(HUE_BUCKETS - 1), F.floor(F.col("h") / (360 / HUE_BUCKETS)))
    angle = F.radians("h")
    binned = (
        p.withColumn("bin", F.when(coloured, bins))
        .groupBy(key, "bin")
        .agg(
            F.sum("s").alias("w"), F.avg(F.cos(angle)).alias("x"),
            F.avg(F.sin(angle)).alias("y"), F.avg("l").alias("l"),
        )
    )
    best = binned.groupBy(key).agg(
        F.max_by(F.struct("x", "y", "l"), F.when(F.col("bin").isNotNull(), F.struct("w", -F.col("bin")))).alias("c")
    )
    hue = F.degrees(F.atan2(F.col("c.y"), F.col("c.x")))
    sat = F.lit(min(max(ACCENT_SATURATION, CLAMP_SATURATION[0]), CLAMP_SATURATION[1]))
    light = F.greatest(F.lit(CLAMP_LIGHTNESS[0]), F.least(F.lit(CLAMP_LIGHTNESS[1]), F.col("c.l")))
    return best.select(key, F.when(F.col("c").isNotNull(), rgb_hex(hue, sat, light)).alias("accent_color"))


