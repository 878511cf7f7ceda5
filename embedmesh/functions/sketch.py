"""A HyperLogLog of 16 registers, held in 16 columns so that merging is a plain (partially aggregated) max."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

REGISTERS = 16
NAMES = [f"r{i}" for i in range(REGISTERS)]
#: Spark's murmur3 of this int is 0xbeef: hashing it first makes 0xbeef the seed of what follows.
_SEED = -1589922032


def murmur3(id_: Column) -> Column:
    """MurmurHash3 (x86, 32 bits) of a long with seed 0xbeef, as a signed int."""
    return F.hash(F.lit(_SEED).cast("int"), id_.cast("bigint"))


def observed(id_: Column) -> list[Column]:
    """The registers of a sketch that has seen one id."""
    h = murmur3(id_)
    rest = F.shiftrightunsigned(h, 4).bitwiseOR(F.lit(-268435456))
    value = (F.bit_count(rest.bitwiseAND(-rest) - 1) + 1).cast("tinyint")
    return [F.when(h.bitwiseAND(F.lit(15)) == i, value).otherwise(F.lit(0).cast("tinyint")).alias(n) for i, n in enumerate(NAMES)]


def merged() -> list[Column]:
    return [F.max(n).alias(n) for n in NAMES]


def joined(prefix: str) -> list[Column]:
    """The element-wise maximum of the registers and others with a prefix, which may be null."""
    return [F.greatest(F.col(n), F.col(prefix + n)).alias(n) for n in NAMES]


def estimate() -> Column:
    """Distinct ids seen; linear counting while the raw estimate is under 40 and a register is empty."""
    add = lambda cs: reduce(lambda a, b: a + b, cs)
    raw = F.lit(0.673 * REGISTERS * REGISTERS) / add([F.pow(F.lit(2.0), -F.col(n)) for n in NAMES])
    empty = add([(F.col(n) == 0).cast("int") for n in NAMES])
    linear = F.lit(float(REGISTERS)) * F.ln(F.lit(float(REGISTERS)) / F.greatest(empty, F.lit(1)))
    return F.when((raw < 40) & (empty > 0), linear).otherwise(raw).cast("long")
