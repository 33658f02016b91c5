"""Rules on column names alone; they run on the schema and touch no data."""

from __future__ import annotations

import re

# Names that are keys by themselves.
KEY_NAMES = ("index", "key", "pk", "primary_key")


def looks_like_id(name: str, rule: str = "strict") -> bool:
    """``letters``: the letters ``id`` anywhere; ``strict``: ``id`` as a word."""
    low = name.lower()
    if low in KEY_NAMES:
        return True
    if rule == "letters":
        return "id" in low
    words = re.split(r"[^a-z0-9]+", low)
    return "id" in words or low.endswith("key") or "_key_" in low


def is_timestamp_name(name: str) -> bool:
    return "timestamp" in name.lower()


def is_date_name(name: str) -> bool:
    low = name.lower()
    return "date" in low or "time" in low


def is_age_name(name: str) -> bool:
    return "age" in name.lower()
