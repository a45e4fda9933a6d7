"""Colours as column expressions: a heat-map palette and continuous ramps."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def _hex(red: Column, green: Column, blue: Column) -> Column:
    """#RRGGBB of channels from 0 to 255; halves go up."""
    byte = lambda c: F.format_string("%02X", F.floor(c + 0.5).cast("int"))
    return F.concat(F.lit("#"), byte(red), byte(green), byte(blue))


def heat_palette() -> list[str]:
    """64 colours from blue over cyan, yellow and red to dark red: each channel is a ramp of sixteenths, flat at its top."""
    out = []
    for k in range(64):
        level = lambda centre: min(16, max(0, 24 - abs(k - centre)))  # noqa: E731, B023
        out.append("#" + "".join(f"{int(255 * level(c) / 16 + 0.5):02X}" for c in (47, 31, 15)))
    return out


def color_ramp(value: Column, low: float | Column, high: float | Column, colors: Sequence[str] | None = None) -> Column:
    """The colour of a value between ``low`` and ``high``, mixed linearly between neighbouring colours; values beyond take the ends.

    A range of no length counts as one long. Null and NaN have no colour.
    """
    colors = heat_palette() if colors is None else list(colors)
    low, high = (v if isinstance(v, Column) else F.lit(float(v)) for v in (low, high))
    span = F.when(high - low <= 0, F.lit(1.0)).otherwise(high - low)
    at = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (value.cast("double") - low) / span)) * (len(colors) - 1)
    k = F.least(F.floor(at), F.lit(max(0, len(colors) - 2))).cast("int")
    part = at - k
    channels = []
    for i in (1, 3, 5):
        table = F.array(*(F.lit(float(int(c[i : i + 2], 16))) for c in (*colors, colors[-1])))
        channels.append(F.get(table, k) * (1 - part) + F.get(table, k + 1) * part)
    return F.when(value.isNotNull() & ~F.isnan(value.cast("double")), _hex(*channels))
