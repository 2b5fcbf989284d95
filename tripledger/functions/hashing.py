"""Repeatable randomness from keys instead of generators.

Every random decision is a function of ``(seed, key, iteration)``. A lost task
that runs again draws the same numbers, and results do not depend on how rows
were partitioned.

Per key, one MD5 digest gives two integers ``a`` and ``b`` below the prime
``P = 2**31 - 1``. Iteration ``i`` uses ``(a * (2 i + 1) + b) mod P``. For a fixed
iteration the values of different keys are independent and uniform; over
iterations they are pairwise independent (Carter & Wegman 1979), which is what
the spread of a resampling distribution needs. It costs one digest per key
rather than one per key and iteration.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

P = 2_147_483_647


def digest(seed: int | str, *keys: Column, purpose: str = "") -> Column:
    """Digest of the keys. Decisions of different purpose draw from different digests; a null key has a mark."""
    marked = [F.coalesce(k.cast("string"), F.lit("\\N")) for k in keys]
    return F.md5(F.concat_ws("|", F.lit(f"{seed}{purpose}"), *marked))


def _hex_int(hex_text: Column) -> Column:
    return F.conv(hex_text, 16, 10).cast("bigint")


def digest_uniform(dig: Column) -> Column:
    """Uniform number in [0, 1) from the first 8 hex digits."""
    return _hex_int(F.substring(dig, 1, 8)) / F.lit(4294967296.0)


def digest_pick(dig: Column) -> Column:
    """Uniform number in [0, 1) from digits that neither slope nor offset uses."""
    return _hex_int(F.substring(dig, 17, 8)) / F.lit(4294967296.0)


def digest_cell(dig: Column, cells: int) -> Column:
    """Integer in 0 … cells-1."""
    return _hex_int(F.substring(dig, 25, 8)) % cells


def digest_coin(dig: Column) -> Column:
    """0 or 1 from the first hex digit."""
    return _hex_int(F.substring(dig, 1, 1)) % 2


def slope(dig: Column) -> Column:
    """In 1 … P-1."""
    return _hex_int(F.substring(dig, 1, 8)) % (P - 1) + 1


def offset(dig: Column) -> Column:
    """In 0 … P-1."""
    return _hex_int(F.substring(dig, 9, 8)) % P


def iteration_value(a: Column, b: Column, iteration: Column) -> Column:
    """Integer in 0 … P-1 for a key's ``(a, b)`` in one iteration."""
    return (a * (iteration * 2 + 1) + b) % P
