"""Scalar and array expressions. Everything here is a JVM-side Column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Slack on curve ranges, logit clip, allele-frequency bounds, fixed-point limit.
RANGE_SLACK = 1e-9
LOGIT_CLIP = 1e-6
FREQ_LOW, FREQ_HIGH = 0.02, 0.98
FIXED_POINT_LIMIT = 2.0**62 / 64


def r(c: Column | str, digits: int = 6) -> Column:
    """Round for reporting, with negative zero folded into zero."""
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c.cast("double"), digits) + F.lit(0.0)


def expit(z: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def logit(p: Column, clip: float = LOGIT_CLIP) -> Column:
    p = F.least(F.greatest(p, F.lit(clip)), F.lit(1.0 - clip))
    return F.log(p / (F.lit(1.0) - p))


def shift_frequency(p: Column, shift: Column) -> Column:
    """Move a frequency on the logit scale and keep it inside its bounds."""
    moved = expit(F.log(p / (F.lit(1.0) - p)) + shift)
    return F.least(F.greatest(moved, F.lit(FREQ_LOW)), F.lit(FREQ_HIGH))


def within_range(x: Column, x_max: float, slack: float = 0.0) -> Column:
    return F.abs(x) <= F.lit(x_max + slack)


# ---- vectors held in an array column


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, e: s + e * e))


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda p, q: (p - q) * (p - q)), F.lit(0.0), lambda s, v: s + v)


def scale(v: Column, k: Column) -> Column:
    return F.transform(v, lambda e: e * k)


def add(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda p, q: p + q)


def clip_factor(n: Column, bound: Column) -> Column:
    return F.least(F.lit(1.0), bound / F.greatest(n, F.lit(1e-12)))


def clip_to_norm(v: Column, bound: Column) -> Column:
    return scale(v, clip_factor(norm(v), bound))


def cosine(a: Column, b: Column) -> Column:
    """Null when either vector has a zero or non-finite norm."""
    na, nb = norm(a), norm(b)

    def usable(n):
        return (n > 0) & ~F.isnan(n) & (n < F.lit(float("inf")))

    return F.when(usable(na) & usable(nb), dot(a, b) / (na * nb))


def flatten_params(*parts: Column) -> Column:
    """Named parameter blocks laid end to end as one vector."""
    return F.concat(*parts)


def fixed_encode(x: Column, bits: int) -> Column:
    """Round-half-even fixed point as BIGINT; raises outside the safe range."""
    scaled = F.rint(x * F.lit(2.0**bits))
    ok = ~F.isnan(scaled) & (F.abs(scaled) < F.lit(FIXED_POINT_LIMIT))
    return F.when(ok, scaled.cast("bigint")).otherwise(
        F.raise_error(F.lit("value too large for the fixed-point range; lower frac_bits")).cast("bigint"))


def fixed_decode(v: Column, bits: int) -> Column:
    return v.cast("double") / F.lit(2.0**bits)


# ---- losses


def squared_error(out: Column, y: Column) -> Column:
    return (out - y) * (out - y)


def logistic_loss(out: Column, y: Column) -> Column:
    return F.greatest(out, F.lit(0.0)) - out * y + F.log1p(F.exp(-F.abs(out)))


# ---- dose-response curves


def dose_response(shape: Column | str, x: Column, theta1: Column, theta2: Column,
                  binary: Column | None = None) -> Column:
    """Known curve at x: straight, quadratic, or flat beyond theta2. Null for binary outcomes."""
    shape = F.lit(shape) if isinstance(shape, str) else shape
    f = (F.when(shape == "quadratic", theta1 * x + theta2 * x * x)
         .when(shape == "threshold", theta1 * F.least(x, theta2))
         .otherwise(theta1 * x))
    return f if binary is None else F.when(~binary, f)


# ---- deterministic pseudo-random draws from a key


def hash_uniform(*keys: Column) -> Column:
    """A uniform in (0, 1) that depends only on the keys, so retried tasks draw it again."""
    return (F.shiftrightunsigned(F.xxhash64(*keys), 11).cast("double") + F.lit(0.5)) / F.lit(2.0**53)


def hash_normal(*keys: Column) -> Column:
    """Standard normal by Box-Muller on two hashed uniforms."""
    u = hash_uniform(*keys, F.lit("radius"))
    v = hash_uniform(*keys, F.lit("angle"))
    return F.sqrt(F.lit(-2.0) * F.log(u)) * F.cos(F.lit(2.0) * F.pi() * v)
