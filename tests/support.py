"""Comparing frames with rows computed elsewhere."""

import math
from collections import Counter


def plain(v):
    if isinstance(v, float):
        return round(v, 9) if math.isfinite(v) else str(v)
    if isinstance(v, dict):
        return tuple(plain(x) for x in v.values())
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


def rows(df, *cols):
    """The rows as a multiset, columns in the order given, else by name."""
    return Counter(tuple(plain(v) for v in r) for r in df.select(*(cols or sorted(df.columns))).collect())
