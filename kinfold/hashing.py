"""Content hashing and hash-driven draws, the same in Spark and in SQL, so that random choices need no random generator."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F

NUL = "\x00"


def stable(*parts: Column | str | int) -> Column:
    """sha256 hex of the parts as text, joined by NUL. A null part reads None."""
    cols = [F.coalesce((p if isinstance(p, Column) else F.lit(str(p))).cast("string"), F.lit("None")) for p in parts]
    return F.sha2(F.concat_ws(NUL, *cols), 256)


def number(digest: Column, digits: int = 8) -> Column:
    """The first hex digits of a digest as an unsigned number."""
    return F.conv(F.substring(digest, 1, digits), 16, 10).cast("bigint")


def draw(n: Column | int, *parts) -> Column:
    """A number from 0 to n - 1 that depends on the parts only."""
    return F.pmod(number(stable(*parts)), n if isinstance(n, Column) else F.lit(n))


def uniform(*parts) -> Column:
    """A number in [0, 1) that depends on the parts only."""
    return number(stable(*parts)) / F.lit(4294967296.0)


def int_array_hash(ids: Column) -> Column:
    """Canonical-JSON sha256 of an integer array."""
    return F.sha2(F.concat(F.lit("["), F.array_join(F.transform(ids, lambda x: x.cast("string")), ","), F.lit("]")), 256)


def little_endian_seed(*parts) -> int:
    """Seed of a simulation run: eight bytes of sha256 over the parts joined by |, little-endian, modulo 2**63 - 1."""
    return int.from_bytes(hashlib.sha256("|".join(map(str, parts)).encode()).digest()[:8], "little") % (2**63 - 1)


def big_endian_seed(*parts) -> int:
    """Seed of a training run: eight bytes of sha256 over the parts joined by NUL, big-endian, modulo 2**32."""
    return int.from_bytes(hashlib.sha256(NUL.join(map(str, parts)).encode()).digest()[:8], "big") % 2**32
