"""Fingerprints of file contents as Spark expressions.

All of them work on a binary column inside the JVM. The two 64-bit prints look at evenly
spaced bytes only, so their cost does not grow with the file.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinsift.schemas import CONTENT_HASH, DHASH, PHASH

_EMPTY_PRINT = "0" * 16


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it several times in ``body``."""
    return F.element_at(F.transform(F.array(value), body), 1)


def content_hash(content: Column) -> Column:
    return F.sha2(content, 256)


def _byte_at(content: Column, index: Column) -> Column:
    return F.conv(F.hex(F.substring(content, index + 1, F.lit(1))), 16, 10).cast("int")


def sample_bytes(content: Column, k: int) -> Column:
    """``k`` evenly spaced byte values; shorter contents repeat their last byte."""

    def pick(data: Column) -> Column:
        size = F.octet_length(data)
        step = size.cast("double") / F.lit(float(k))
        offset = lambda i: F.when(size > k, F.floor(i.cast("double") * step).cast("int")).otherwise(i)
        return F.transform(
            F.sequence(F.lit(0), F.lit(k - 1)), lambda i: _byte_at(data, F.least(offset(i), size - 1))
        )

    # Bound first: a computed column (say, a cast) would be worked out again for every byte.
    return F.when(F.octet_length(content) > 0, bind(content, pick))


def _pack(bits: Column) -> Column:
    """Array of booleans to a signed 64-bit number, first element in the highest bit."""
    return F.aggregate(
        bits,
        F.lit(0).cast("long"),
        lambda acc, bit: F.shiftleft(acc, 1).bitwiseOR(F.when(bit, F.lit(1)).otherwise(F.lit(0)).cast("long")),
    )


def to_hex64(bits: Column) -> Column:
    return F.lpad(F.lower(F.hex(bits)), 16, "0")


def from_hex64(hex_text: Column) -> Column:
    """Hex text to the signed 64-bit number with the same bits."""
    return F.conv(hex_text, 16, -10).cast("long")


def dhash64(content: Column) -> Column:
    """Bit i is set where sample i is larger than sample i+1 (65 samples)."""
    falling = lambda s: F.transform(
        F.sequence(F.lit(1), F.lit(64)), lambda i: F.element_at(s, i) > F.element_at(s, i + 1)
    )
    print64 = bind(sample_bytes(content, 65), lambda s: to_hex64(_pack(falling(s))))
    return F.when(F.octet_length(content) > 0, print64).otherwise(F.lit(_EMPTY_PRINT))


def phash64(content: Column) -> Column:
    """Bit i is set where sample i reaches the mean of the 64 samples."""
    total = lambda s: F.aggregate(s, F.lit(0), lambda acc, v: acc + v)
    bright = lambda s: bind(total(s), lambda t: _pack(F.transform(s, lambda v: v * 64 >= t)))
    print64 = bind(sample_bytes(content, 64), lambda s: to_hex64(bright(s)))
    return F.when(F.octet_length(content) > 0, print64).otherwise(F.lit(_EMPTY_PRINT))


def hamming(a: Column, b: Column) -> Column:
    """Differing bits of two 64-bit numbers."""
    return F.bit_count(a.bitwiseXOR(b))


def hamming_hex(a: Column, b: Column) -> Column:
    return hamming(from_hex64(a), from_hex64(b))


def fingerprint(files: DataFrame, content: str = "content") -> DataFrame:
    """All three prints in one pass over the content, one row per file and print."""
    data = F.col(content)
    wide = files.select(
        "file_id",
        content_hash(data).alias(CONTENT_HASH),
        dhash64(data).alias(DHASH),
        phash64(data).alias(PHASH),
    )
    return wide.unpivot("file_id", [CONTENT_HASH, DHASH, PHASH], "hash_type", "hash_hex")
