"""Random numbers by counter: functions of a seed and keys of a row, the same wherever and whenever the row is read."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def uniform(seed: int, *keys: Column | str) -> Column:
    """A number between 0 and 1 (neither included), from the first 13 hex digits of the MD5 of `seed:key:key...`."""
    text = F.concat_ws(":", F.lit(str(seed)), *[(F.col(k) if isinstance(k, str) else k).cast("string") for k in keys])
    return (F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def normal(seed: int, *keys: Column | str) -> Column:
    """A standard normal number, from two uniform ones (Box and Muller)."""
    return F.sqrt(-2 * F.log(uniform(seed, F.lit("r"), *keys))) * F.cos(2 * math.pi * uniform(seed, F.lit("a"), *keys))
