"""Seeded noise that depends on row keys only, so partitioning and retries do not change it."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

_RANGE = float(1 << 48)


def key_digest(key: Column, seed: int) -> Column:
    """md5 of ``key|seed`` as 32 hex digits."""
    return F.md5(F.concat_ws("|", key.cast("string"), F.lit(str(seed))))


def digest_number(digest: Column, part: int = 0) -> Column:
    """Twelve hex digits of the digest as an integer below 2**48; ``part`` is 0 or 1."""
    return F.conv(F.substring(digest, 1 + 12 * part, 12), 16, 10).cast("bigint")


def hash_number(key: Column, seed: int) -> Column:
    """A uniform integer below 2**48 for the key."""
    return digest_number(key_digest(key, seed))


def gauss(key: Column, seed: int) -> Column:
    """A standard normal draw for the key (Box-Muller on two halves of its digest)."""
    digest = key_digest(key, seed)
    u1 = (digest_number(digest, 0) + 0.5) / _RANGE
    u2 = (digest_number(digest, 1) + 0.5) / _RANGE
    return F.sqrt(-2.0 * F.log(u1)) * F.cos(u2 * (2 * math.pi))


def add_noise(value: Column, key: Column, sigma: Column | float, seed: int) -> Column:
    """``value`` plus normal noise with standard deviation ``sigma``."""
    return value + F.lit(sigma) * gauss(key, seed)


def noise_array(
    values: Column, key: Column, sigma: Column | float, seed: int, sentinel: float | None = None
) -> Column:
    """Noise on every element of an array; elements equal to ``sentinel`` stay as they are."""
    scale = F.lit(sigma)

    def noisy(x: Column, i: Column) -> Column:
        moved = x + scale * gauss(F.concat_ws("#", key.cast("string"), i.cast("string")), seed)
        return moved if sentinel is None else F.when(x == F.lit(sentinel), x).otherwise(moved)

    return F.transform(values, noisy)
