"""128-bit sample ids: hex strings of 32 lower-case digits once canonical."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UID_DIGITS = 32


def canonical_uid(uid: Column) -> Column:
    """Lower-case and left-pad to 32 digits; anything longer is not an id and gives NULL."""
    return F.when(F.length(uid) <= UID_DIGITS, F.lpad(F.lower(uid), UID_DIGITS, "0"))


def _unsigned(hex_digits: Column) -> Column:
    return F.conv(hex_digits, 16, 10).cast("decimal(20,0)")


def uid_hi(uid: Column) -> Column:
    """Upper 64 bits as an unsigned number."""
    return _unsigned(F.substring(canonical_uid(uid), 1, 16))


def uid_lo(uid: Column) -> Column:
    """Lower 64 bits as an unsigned number."""
    return _unsigned(F.substring(canonical_uid(uid), 17, 16))


def uid_from_pair(hi: Column, lo: Column) -> Column:
    """Inverse of :func:`uid_hi` and :func:`uid_lo`."""
    half = lambda c: F.lpad(F.lower(F.conv(c.cast("string"), 10, 16)), 16, "0")
    return F.concat(half(hi), half(lo))


def sample_key(uid: Column, copy: Column) -> Column:
    """Key of one emitted copy of a sample, ``<uid>-<copy>``."""
    return F.concat_ws("-", uid, copy)


def seeded_hex(seed: int | str, *parts: Column) -> Column:
    """32 pseudo-random hex digits that depend only on ``seed`` and ``parts``."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[p.cast("string") for p in parts]))


def hex_prefix_number(hex_digits: Column, digits: int) -> Column:
    """The first ``digits`` (at most 15) hex digits as a non-negative bigint."""
    if not 1 <= digits <= 15:
        raise ValueError("digits must be in 1..15 to fit a signed 64-bit number")
    return F.conv(F.substring(hex_digits, 1, digits), 16, 10).cast("bigint")
