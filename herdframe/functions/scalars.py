"""Column expressions: probabilities, angles, rotations, likelihoods. All run in the JVM; those over arrays are interpreted, the others part of generated code."""

import math
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import Window as W

EPSILON = 1e-5


def is_missing(*coords: Column) -> Column:
    return reduce(lambda a, b: a | b, (c.isNull() | F.isnan(c) for c in coords))


def from_nan(c: Column) -> Column:
    """NULL for NaN, as every source must do: Spark orders NaN above all numbers."""
    return F.when(~F.isnan(c), c)


def outlier_prob(confidence: Column, missing: Column, eps: float = EPSILON) -> Column:
    """1 - confidence within [eps, 1 - eps]; a missing detection has no confidence."""
    c = F.when(missing, 0.0).otherwise(F.coalesce(from_nan(confidence), F.lit(0.0)))
    return F.greatest(F.lit(eps), F.least(F.lit(1 - eps), 1 - c))


def log_sigmoid(z: Column) -> Column:
    """-log(1 + exp(-z)), without overflow for very negative z."""
    return F.when(z < -30, z).otherwise(-F.log1p(F.exp(-z)))


def log_normalized(x: Column, over: list[str]) -> tuple[Column, Column]:
    """x minus its log-sum-exp over the rows that share `over`, and the log-sum-exp."""
    w = W.partitionBy(*over)
    top = F.max(x).over(w)
    lse = top + F.log(F.sum(F.exp(x - top)).over(w))
    return x - lse, lse


def angle(x: Column, y: Column) -> Column:
    """atan2(y, x + 1e-10), with -pi for the heading (-1, 0)."""
    return F.when((y == 0) & (x < 0), F.lit(-math.pi)).otherwise(F.atan2(y, x + 1e-10))


def rotation_matrix(heading: Column, dim: int = 3) -> Column:
    """The rotation by `heading` in the first two axes of an identity of `dim`, as nested arrays."""
    c, s = F.cos(heading), F.sin(heading)
    cell = {(0, 0): c, (0, 1): -s, (1, 0): s, (1, 1): c}
    return F.array(*[F.array(*[cell.get((i, j), F.lit(float(i == j))) for j in range(dim)]) for i in range(dim)])


def gaussian_2d_log(error: Column, variance: float) -> Column:
    """log density of an isotropic normal in two dimensions at distance `error` from its mean."""
    return -F.lit(math.log(2 * math.pi * variance)) - error * error / (2 * variance)


def mixture_log(error: Column, outlier: Column, inlier_variance: float = 10.0, outlier_variance: float = 1e6) -> Column:
    """log of the inlier and outlier mixture; 0 where the error is missing."""
    a = F.log(1 - outlier) + gaussian_2d_log(error, inlier_variance)
    b = F.log(outlier) + gaussian_2d_log(error, outlier_variance)
    top = F.greatest(a, b)
    return F.coalesce(top + F.log(F.exp(a - top) + F.exp(b - top)), F.lit(0.0))


def jensen_shannon(p: Column, q: Column, pseudocount: float = 1e-6) -> Column:
    """Jensen-Shannon divergence (natural log) of two arrays of weights."""

    def normal(a: Column) -> Column:
        b = F.transform(a, lambda v: v + pseudocount)
        total = F.aggregate(b, F.lit(0.0), lambda s, v: s + v)
        return F.transform(b, lambda v: v / total)

    def entropy_gap(a: Column, b: Column) -> Column:
        return F.aggregate(F.zip_with(a, b, lambda u, v: u * F.log(u * 2 / (u + v))), F.lit(0.0), lambda s, v: s + v)

    p, q = normal(p), normal(q)
    return (entropy_gap(p, q) + entropy_gap(q, p)) / 2


def undistorted(x: Column, y: Column, lens: dict, steps: int = 5) -> Column:
    """Struct (x, y) of pixel coordinates without radial (k1, k2, k3) and tangential (p1, p2) distortion, by fixed-point steps.

    A step is a lambda over the last step's struct, so the expression stays small whatever the
    number of steps; lens holds numbers or columns.
    """
    x0, y0 = (x - lens["cx"]) / lens["fx"], (y - lens["cy"]) / lens["fy"]
    start = F.struct(x0.alias("u"), y0.alias("v"), x0.alias("u0"), y0.alias("v0"))

    def step(s: Column, _: Column) -> Column:
        u, v = s["u"], s["v"]
        r = u * u + v * v
        scale = 1 + ((lens["k3"] * r + lens["k2"]) * r + lens["k1"]) * r
        dx = 2 * lens["p1"] * u * v + lens["p2"] * (r + 2 * u * u)
        dy = lens["p1"] * (r + 2 * v * v) + 2 * lens["p2"] * u * v
        return F.struct(((s["u0"] - dx) / scale).alias("u"), ((s["v0"] - dy) / scale).alias("v"), s["u0"].alias("u0"), s["v0"].alias("v0"))

    return F.aggregate(
        F.sequence(F.lit(1), F.lit(steps)),
        start,
        step,
        lambda s: F.struct((s["u"] * lens["fx"] + lens["cx"]).alias("x"), (s["v"] * lens["fy"] + lens["cy"]).alias("y")),
    )
