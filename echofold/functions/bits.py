"""Column builders over 32-bit frames; all of them stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from echofold.schema import MAX_OFFSET, SIMILARITY_THRESHOLD

U32 = 0xFFFFFFFF
# The four views of a frame, each without one of its octets.
VIEW_MASKS = (0xFFFFFF00, 0xFFFF00FF, 0xFF00FFFF, 0x00FFFFFF)


def unsigned32(x: Column) -> Column:
    """The bit pattern of a frame as a BIGINT of 0 to 2^32-1; null stays null."""
    return x.cast("bigint").bitwiseAND(F.lit(U32))


def to_signed32(x: Column) -> Column:
    """A value of any 64-bit integer column as two's complement INT; null stays null."""
    u = unsigned32(x)
    return F.when(u >= F.lit(1 << 31), u - F.lit(1 << 32)).otherwise(u).cast("int")


def differing_bits(a: Column, b: Column) -> Column:
    """Bits in which two frames differ.  Masked first: bit_count of a negative INT also counts the sign extension."""
    return F.bit_count(a.cast("bigint").bitwiseXOR(b.cast("bigint")).bitwiseAND(F.lit(U32)))


def extract_terms(fingerprint: Column, stride: int = 1) -> Column:
    """Distinct index terms of a fingerprint: (view << 32) | masked frame, of every stride-th frame.

    Null and empty fingerprints give an empty array; null frames give no term.
    """
    frames = F.filter(F.coalesce(fingerprint, F.array().cast("array<int>")), lambda x, i: x.isNotNull() & (i % stride == 0))
    views = F.array(*[F.struct(F.lit(v).cast("bigint").alias("v"), F.lit(m).cast("bigint").alias("m")) for v, m in enumerate(VIEW_MASKS)])
    terms = F.transform(frames, lambda x: F.transform(views, lambda w: F.shiftleft(w["v"], 32).bitwiseOR(unsigned32(x).bitwiseAND(w["m"]))))
    return F.array_distinct(F.flatten(terms))


def similarity_at_offset(a: Column, b: Column, k: Column) -> Column:
    """Share of equal bits when the first k >= 0 frames of ``a`` (of ``b`` for k < 0) are skipped; 0.0 without overlap."""
    skip_a, skip_b = F.greatest(k, F.lit(0)), F.greatest(-k, F.lit(0))
    n = F.greatest(F.least(F.size(a) - skip_a, F.size(b) - skip_b), F.lit(0))
    pairs = F.zip_with(F.slice(a, skip_a + 1, n), F.slice(b, skip_b + 1, n), lambda x, y: differing_bits(x, y).cast("bigint"))
    diff = F.aggregate(pairs, F.lit(0).cast("bigint"), lambda s, x: s + x)
    return F.when(n > 0, 1.0 - diff / (n * 32.0)).otherwise(F.lit(0.0))


def fingerprint_similarity(a: Column, b: Column, threshold: float = SIMILARITY_THRESHOLD, max_offset: int = MAX_OFFSET) -> Column:
    """The running best similarity at the first offset distance that reaches the threshold, else the best of all.

    So the score depends on the threshold, by definition: offset 0 is taken
    whenever it is good enough.  Symmetric in its arguments.  Null or empty
    fingerprints score 0.0.
    """
    empty = F.array().cast("array<int>")
    a, b = F.coalesce(a, empty), F.coalesce(b, empty)
    zero = similarity_at_offset(a, b, F.lit(0))
    if max_offset < 1:
        return zero
    # Evaluated only where offset 0 falls short, CASE WHEN being lazy.
    shifted = F.transform(
        F.sequence(F.lit(1), F.lit(max_offset)),
        lambda k: F.greatest(similarity_at_offset(a, b, k), similarity_at_offset(a, b, -k)),
    )
    first = F.try_element_at(F.filter(shifted, lambda s: s >= threshold), F.lit(1))
    return F.when(zero >= threshold, zero).otherwise(F.coalesce(first, F.greatest(zero, F.array_max(shifted))))
