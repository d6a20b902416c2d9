"""Scalar column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

HASH_FACTOR = 2654435761
HASH_SPACE = 1 << 32


def safe_divide(top: Column, bottom: Column, otherwise: Column | None = None) -> Column:
    """Quotient where the divisor is positive, else ``otherwise`` (null by default)."""
    return F.when(bottom > 0, top / bottom).otherwise(otherwise)


def magnitude(*axes: Column) -> Column:
    return F.sqrt(sum((a * a for a in axes[1:]), axes[0] * axes[0]))


def spread_order(key: Column, seed: int = 42) -> Column:
    """Pseudo-random order key by multiplicative hashing; does not depend on partitioning.

    The product is taken in halves of 16 bits, so that no key overflows it.
    """
    low = (key + seed) % HASH_SPACE
    upper = ((low / 65536).cast("long") * HASH_FACTOR) % HASH_SPACE
    mixed = (upper * 65536 + (low % 65536) * HASH_FACTOR) % HASH_SPACE
    return ((F.floor(mixed / 8192) + mixed * 40503) % HASH_SPACE).cast("long")


def angular_rate(w: Column, vector: Sequence[Column], period: Column) -> list[Column]:
    """Angular rate of unit-quaternion increments, taken on the hemisphere with a positive scalar."""
    sign = F.when(w < 0, -1.0).otherwise(1.0)
    norm = magnitude(*vector)
    angle = 2 * F.atan2(norm, w * sign)
    scale = angle / F.when(norm > 0, norm).otherwise(1.0) / period
    return [v * sign * scale for v in vector]


def vertical_part(body: Sequence[Column], total: Sequence[Column]) -> Column:
    """Body acceleration projected on the direction of gravity (total minus body)."""
    gravity = [t - b for t, b in zip(total, body)]
    length = magnitude(*gravity)
    return sum((b * g / length for b, g in zip(body[1:], gravity[1:])), body[0] * gravity[0] / length)


def select_channels(columns: Sequence[str], sensors: Sequence[str] = (), part: str | None = None) -> list[str]:
    """Channel names of given sensors (``acc_1`` keeps ``acc_1_x``), or holding a part (``_acc``)."""
    if part is not None:
        return [c for c in columns if part in c]
    return [c for c in columns if c.rsplit("_", 1)[0] in sensors]


def all_fractional(*channels: Column) -> Column:
    """True where every channel holds a fraction, the mark of a filled frame."""
    return F.forall(F.array(*channels), lambda x: x % 1 != 0)


def name_group(name: Column) -> Column:
    return F.substring_index(F.substring_index(name, "-", 1), "(", 1)


def assign_by_word(name: Column, words: Sequence[tuple[str, str]], otherwise: str = "Other") -> Column:
    """First matching word decides, e.g. Gyro before Acc, else Other."""
    out = F.lit(otherwise)
    for word, value in reversed(words):
        out = F.when(F.contains(name, F.lit(word)), value).otherwise(out)
    return out


def participant_of(name: Column) -> Column:
    return F.element_at(F.split(name, "_sub"), -1).cast("int")
