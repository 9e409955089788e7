"""Column functions on CSS colours and lengths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The colour names of CSS level 1 and transparent.
NAMES = {"black": "000000", "silver": "c0c0c0", "gray": "808080", "grey": "808080", "white": "ffffff", "maroon": "800000", "red": "ff0000", "purple": "800080", "fuchsia": "ff00ff", "green": "008000", "lime": "00ff00", "olive": "808000", "yellow": "ffff00", "navy": "000080", "blue": "0000ff", "teal": "008080", "aqua": "00ffff", "orange": "ffa500", "transparent": "00000000"}


def px(s: Column) -> Column:
    """A length in px as a number; null for others."""
    return F.regexp_extract(F.trim(s), r"^([+-]?\d*\.?\d+)(?:px)?$", 1).try_cast("double")


def _read_colour(t: Column) -> Column:
    digits = F.substring(t, 2, 8)
    n = F.length(digits)
    long_ = F.when(n <= 4, F.regexp_replace(digits, "(.)", "$1$1")).otherwise(digits)

    def pair(i: int) -> Column:
        return F.conv(F.substring(long_, 2 * i + 1, 2), 16, 10).try_cast("double")

    is_hex = t.rlike(r"^#(?:[0-9a-f]{3}|[0-9a-f]{4}|[0-9a-f]{6}|[0-9a-f]{8})$")
    hexed = F.struct(pair(0).alias("r"), pair(1).alias("g"), pair(2).alias("b"), F.when(F.length(long_) == 8, pair(3) / 255).otherwise(1.0).alias("a"))
    parts = F.split(F.regexp_extract(t, r"^rgba?\(([^)]*)\)$", 1), r"[,/\s]+")

    def part(i: int, full: float) -> Column:
        p = F.get(parts, F.lit(i))
        number = F.regexp_replace(p, "%$", "").try_cast("double")
        return F.when(p.endswith("%"), number * full / 100).otherwise(number)

    rgb = F.struct(part(0, 255).alias("r"), part(1, 255).alias("g"), part(2, 255).alias("b"), F.coalesce(part(3, 1), F.lit(1.0)).alias("a"))
    return F.when(is_hex, hexed).when(t.rlike(r"^rgba?\([^)]*\)$") & (F.size(parts) >= 3), rgb)


def parse_colour(s: Column) -> Column:
    """struct(r, g, b in 0..255, a in 0..1), or null: rgb(), rgba() with numbers or percent,
    hex of 3, 4, 6 or 8 digits, and names."""
    t = F.lower(F.trim(s))
    names = F.create_map(*[F.lit(x) for k, v in NAMES.items() for x in (k, "#" + v)])
    # the text is bound once: written out at each use, the plan's code would outgrow its limit
    return F.get(F.transform(F.array(F.coalesce(F.try_element_at(names, t), t)), _read_colour), F.lit(0))


def over(top: Column, under: Column) -> Column:
    """``top`` painted over an opaque colour."""

    def channel(c: str) -> Column:
        return (top[c] * top["a"] + under[c] * (1 - top["a"])).alias(c)

    return F.struct(channel("r"), channel("g"), channel("b"), F.lit(1.0).alias("a"))


def luminance(c: Column) -> Column:
    def linear(x: Column) -> Column:
        v = x / 255
        return F.when(v <= 0.03928, v / 12.92).otherwise(F.pow((v + 0.055) / 1.055, F.lit(2.4)))

    return 0.2126 * linear(c["r"]) + 0.7152 * linear(c["g"]) + 0.0722 * linear(c["b"])


def contrast(a: Column, b: Column) -> Column:
    x, y = luminance(a), luminance(b)
    return (F.greatest(x, y) + 0.05) / (F.least(x, y) + 0.05)


def distance(a: Column, b: Column) -> Column:
    return F.sqrt(F.pow(a["r"] - b["r"], F.lit(2.0)) + F.pow(a["g"] - b["g"], F.lit(2.0)) + F.pow(a["b"] - b["b"], F.lit(2.0)))


def hsl(c: Column) -> Column:
    """struct(h in degrees, s, l in 0..1)."""
    r, g, b = c["r"] / 255, c["g"] / 255, c["b"] / 255
    hi, lo = F.greatest(r, g, b), F.least(r, g, b)
    d, light = hi - lo, (hi + lo) / 2
    sat = F.when(d == 0, 0.0).otherwise(d / F.when(light > 0.5, 2 - hi - lo).otherwise(hi + lo))
    hue = F.when(d == 0, 0.0).when(hi == r, F.pmod((g - b) / d, F.lit(6.0))).when(hi == g, (b - r) / d + 2).otherwise((r - g) / d + 4) * 60
    return F.struct(hue.alias("h"), sat.alias("s"), light.alias("l"))
