"""Content hashes, 64-bit visual hashes and their distance."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from lumenlake.constants import HASH_BITS


def content_hash(content: Column) -> Column:
    """SHA-256 of the original bytes or text, as lower-case hex."""
    return F.sha2(content, 256)


def _total(terms: list[Column]) -> Column:
    """Sum as a balanced tree, so the expression stays shallow."""
    while len(terms) > 1:
        pairs = zip(terms[::2], terms[1::2])
        terms = [a + b for a, b in pairs] + ([terms[-1]] if len(terms) % 2 else [])
    return terms[0]


def word_hex(bits: list[Column]) -> Column:
    """Eight hex digits from 32 conditions, most significant bit first."""
    zero = F.lit(0).cast("bigint")
    value = _total(
        [F.when(bit, F.lit(1 << (31 - i)).cast("bigint")).otherwise(zero) for i, bit in enumerate(bits)]
    )
    return F.lower(F.lpad(F.hex(value), 8, "0"))


def average_hash(pixels: Column) -> Column:
    """64-bit average hash of an 8x8 grid: a bit is set where the pixel reaches the mean.

    Any other grid size gives null.
    """
    total = F.aggregate(pixels, F.lit(0.0), lambda acc, p: acc + p.cast("double"))
    mean = total / F.lit(float(HASH_BITS))
    bits = [F.get(pixels, F.lit(i)).cast("double") >= mean for i in range(HASH_BITS)]
    return F.when(F.size(pixels) == HASH_BITS, F.concat(word_hex(bits[:32]), word_hex(bits[32:])))


def hash_bits(hash_hex: Column) -> Column:
    """A 16-digit hash as one 64-bit integer; digits that are missing or not 0-9a-f count as zero."""
    digits = F.rpad(
        F.regexp_replace(F.substring(F.coalesce(hash_hex, F.lit("")), 1, 16), "[^0-9a-f]", "0"), 16, "0"
    )
    high = F.conv(F.substring(digits, 1, 8), 16, 10).cast("bigint")
    low = F.conv(F.substring(digits, 9, 8), 16, 10).cast("bigint")
    return F.shiftleft(high, 32).bitwiseOR(low)


def bits_hash(bits: Column) -> Column:
    """The 16 digits of a 64-bit integer, as of :func:`hash_bits`."""
    return F.lower(F.lpad(F.hex(bits), 16, "0"))


def bit_distance(a: Column, b: Column) -> Column:
    """Number of differing bits of two integers."""
    return F.bit_count(a.bitwiseXOR(b))


def hamming(a: Column, b: Column) -> Column:
    """Number of differing bits of two 16-digit hashes."""
    return bit_distance(hash_bits(a), hash_bits(b))


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda x, y: x & y, conditions, F.lit(True))
