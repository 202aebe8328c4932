"""Column functions for values, text and geometry, and checks of requests."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import Column
from pyspark.sql import functions as F

ID_PATTERN = r"^[a-zA-Z0-9-]+$"


def typed_value(raw: Column) -> dict[str, Column]:
    """A raw text as the three slots of a cell object: a number, JSON (an object or a list), or text; empty gives nulls."""
    t = F.trim(raw)
    number = t.try_cast("double")
    empty = raw.isNull() | (t == "")
    json = ~empty & number.isNull() & t.rlike(r"^[\[{]") & F.try_parse_json(t).isNotNull()
    return {"value_num": F.when(~empty, number), "value_json": F.when(json, t), "value_text": F.when(~empty & number.isNull() & ~json, raw)}


def clean_text(text: Column) -> Column:
    """Text without control characters (tabs and line ends stay) and script elements, trimmed."""
    t = F.regexp_replace(text, r"(?is)<script\b[^>]*>.*?</script\s*>", "")
    return F.trim(F.regexp_replace(t, "[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f]", ""))


def identifier(name: str) -> str:
    """A name with only letters, digits and underscores, not starting with a digit."""
    s = re.sub(r"\W", "_", name, flags=re.ASCII)
    return f"_{s}" if s[:1].isdigit() else s


def iso_timestamp(text: Column) -> Column:
    """A timestamp from ISO text; Z counts as +00:00."""
    return F.try_to_timestamp(F.regexp_replace(text, "Z$", "+00:00"))


def in_ring(lon: Column, lat: Column, ring: Column) -> Column:
    """Whether a point is inside a ring (array of struct(lon, lat), closed or not) by ray casting."""
    n = F.size(ring)
    def crosses(i: Column) -> Column:
        a, b = F.get(ring, i), F.get(ring, F.pmod(i + 1, n))
        spans = (a["lat"] > lat) != (b["lat"] > lat)
        return F.when(spans & (lon < (b["lon"] - a["lon"]) * (lat - a["lat"]) / F.nullif(b["lat"] - a["lat"], F.lit(0.0)) + a["lon"]), 1).otherwise(0)

    return (F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), lambda s, i: s + crosses(i)) % 2 == 1) & (n >= 3)


def closed_ring(ring: Column) -> Column:
    """A ring with its first corner repeated at the end; null if it has fewer than three corners."""
    return F.when(F.size(ring) >= 3, F.when(F.element_at(ring, 1) == F.element_at(ring, -1), ring).otherwise(F.concat(ring, F.array(F.element_at(ring, 1)))))


def check_uuid(value: str) -> str:
    return str(uuid.UUID(value))


def check_id(value: str) -> str:
    """A cell id: letters, digits and hyphens, at most 256."""
    if len(value) > 256 or not re.fullmatch(ID_PATTERN[1:-1], value):
        raise ValueError("not a cell id")
    return value


def check_box(west: float, south: float, east: float, north: float) -> tuple[float, float, float, float]:
    if not (-180 <= west <= 180 and -180 <= east <= 180 and -90 <= south <= north <= 90 and west <= east):
        raise ValueError("not a bounding box")
    return west, south, east, north


def check_choice(value: str, choices: tuple[str, ...]) -> str:
    if value not in choices:
        raise ValueError(f"{value} is not one of {', '.join(choices)}")
    return value


def check_limit(value: int, most: int, least: int = 1) -> int:
    if not least <= value <= most:
        raise ValueError(f"{value} is not from {least} to {most}")
    return value


def check_ids(values: list[str], most: int = 3000) -> list[str]:
    """A list of cell ids, not empty and not too long."""
    check_limit(len(values), most)
    return [check_id(v) for v in values]


def check_name(value: str, most: int = 255) -> str:
    """A name: trimmed, without control characters, not empty and not too long."""
    value = re.sub(r"[\x00-\x1f\x7f]", "", value).strip()
    check_limit(len(value), most)
    return value


def check_key(value: str) -> str:
    """An attribute's key: letters, digits, underscores, hyphens and dots, at most 100."""
    if not re.fullmatch(r"[A-Za-z0-9_.-]{1,100}", value):
        raise ValueError("not an attribute key")
    return value


def check_range(low: float | None, high: float | None) -> tuple[float | None, float | None]:
    """A range with one bound at least, in order."""
    if (low is None and high is None) or (low is not None and high is not None and low > high):
        raise ValueError("not a range")
    return low, high


def degrees_ring(ring: Column) -> Column:
    """A ring given in radians (array of struct(lon, lat)) in degrees, closed; null if it is degenerate."""
    return closed_ring(F.transform(ring, lambda p: F.struct(F.degrees(p["lon"]).alias("lon"), F.degrees(p["lat"]).alias("lat"))))
