"""Box, anchor and homography expressions."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, functions as F

PITCH_LENGTH_M = 105.0
PITCH_WIDTH_M = 68.0


def area(box: Sequence[Column]) -> Column:
    x1, y1, x2, y2 = box
    return F.greatest(F.lit(0.0), x2 - x1) * F.greatest(F.lit(0.0), y2 - y1)


def intersection(a: Sequence[Column], b: Sequence[Column]) -> Column:
    return area([F.greatest(a[0], b[0]), F.greatest(a[1], b[1]), F.least(a[2], b[2]), F.least(a[3], b[3])])


def iou(a: Sequence[Column], b: Sequence[Column]) -> Column:
    shared = intersection(a, b)
    union = area(a) + area(b) - shared
    return F.when(union > 0, shared / union).otherwise(F.lit(0.0))


def anchor_problem(box: Sequence[Column], is_ball: bool = False) -> Column:
    """Reason a box gives no anchor point, or null."""
    x1, y1, x2, y2 = box
    missing = x1.isNull() | y1.isNull() | x2.isNull() | y2.isNull()
    kind = "BALL_BBOX" if is_ball else "BBOX"
    return F.when(missing, f"MISSING_{kind}").when((x2 <= x1) | (y2 <= y1), f"DEGENERATE_{kind}")


def anchor(box: Sequence[Column], is_ball: bool = False) -> tuple[Column, Column]:
    """Ground point of a player (bottom centre) or the centre of a ball."""
    x1, y1, x2, y2 = box
    return (x1 + x2) / 2.0, (y1 + y2) / 2.0 if is_ball else y2


def is_inside(x: Column, y: Column, margin: float = 0.0) -> Column:
    return (F.abs(x) <= PITCH_LENGTH_M / 2 + margin) & (F.abs(y) <= PITCH_WIDTH_M / 2 + margin)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often ``body`` reads it."""
    return F.transform(F.array(value), body)[0]


def project(matrix: Column, x: Column, y: Column) -> Column:
    """Struct (x, y): a 3x3 matrix (nine doubles, row by row) applied to a point; null where there is no image."""
    def divide(v: Column) -> Column:
        px, py = v["a"] / v["w"], v["b"] / v["w"]
        finite = (F.abs(v["w"]) >= 1e-9) & (F.abs(px) < float("inf")) & (F.abs(py) < float("inf"))
        return F.when(finite, F.struct(px.alias("x"), py.alias("y")))

    def homogeneous(h: Column) -> Column:
        return F.struct((h[0] * x + h[1] * y + h[2]).alias("a"), (h[3] * x + h[4] * y + h[5]).alias("b"),
                        (h[6] * x + h[7] * y + h[8]).alias("w"))

    return let(let(matrix, homogeneous), divide)


def invert(matrix: Column) -> Column:
    """Inverse of a 3x3 matrix scaled so its last entry is 1; null when singular."""
    def cofactors(m: Column) -> Column:
        a, b, c, d, e, f, g, h, i = [m[n] for n in range(9)]
        return F.array(e * i - f * h, c * h - b * i, b * f - c * e, f * g - d * i, a * i - c * g, c * d - a * f,
                       d * h - e * g, b * g - a * h, a * e - b * d)

    def scaled(m: Column, k: Column) -> Column:
        determinant = m[0] * k[0] + m[1] * k[3] + m[2] * k[6]
        scale = F.when(F.abs(k[8] / determinant) > 1e-12, k[8]).otherwise(determinant)
        return F.when(F.abs(determinant) >= 1e-15, let(scale, lambda s: F.transform(k, lambda v: v / s)))

    return let(matrix, lambda m: let(cofactors(m), lambda k: scaled(m, k)))
