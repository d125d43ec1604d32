"""Scalar geometry as Column expressions: everything stays inside code generation.

Points are pairs or triples of Columns. Divisions are guarded (`try_divide`, explicit branches), since ANSI mode
raises where IEEE arithmetic would give NaN or infinity. Angles are radians.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Tolerance of turn directions (a fixed value of the semantics).
TURN_EPS = 1e-6
#: Arms shorter than this have no visual angle; shorter vectors have no direction (fixed values).
ARM_EPS, DIRECTION_EPS = 1e-8, 1e-5


def distance(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1))


def distance3(x1, y1, z1, x2, y2, z2) -> Column:
    return F.sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1) + (z2 - z1) * (z2 - z1))


def feature_distance(a: Column, b: Column) -> Column:
    """Euclidean over arrays; NaN when their lengths differ."""
    same = F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))
    return F.when(F.size(a) == F.size(b), same).otherwise(F.lit(float("nan")))


def cross(x0, y0, x1, y1, x2, y2) -> Column:
    """z of (p1 - p0) x (p2 - p0)."""
    return (x1 - x0) * (y2 - y0) - (y1 - y0) * (x2 - x0)


def turn(x0, y0, x1, y1, x2, y2) -> Column:
    """1 clockwise, -1 counter-clockwise, 0 straight."""
    c = cross(x0, y0, x1, y1, x2, y2)
    return F.when(c < -TURN_EPS, 1).when(c > TURN_EPS, -1).otherwise(0)


def direction(x, y, x0, y0) -> Column:
    """Of (x, y) seen from (x0, y0)."""
    return F.nanvl(F.atan2(y - y0, x - x0), F.lit(0.0))


def visual_angle(x1, y1, x2, y2, x0, y0) -> Column:
    """Between the arms from (x0, y0), by the law of cosines; 0 where an arm has no length."""
    a, b, c = distance(x1, y1, x0, y0), distance(x2, y2, x0, y0), distance(x1, y1, x2, y2)
    cosine = F.try_divide(a * a + b * b - c * c, 2 * a * b)
    return F.when((a < ARM_EPS) | (b < ARM_EPS), 0.0).otherwise(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine))))


def signed_visual_angle(x1, y1, x2, y2, x0, y0) -> Column:
    """Negative where (x2, y2) lies counter-clockwise of (x1, y1) as seen from (x0, y0)."""
    a = visual_angle(x1, y1, x2, y2, x0, y0)
    return F.when(turn(x0, y0, x1, y1, x2, y2) >= 0, a).otherwise(-a)


def triangle_area(x1, y1, x2, y2, x3, y3) -> Column:
    """Heron's; 0 for what is none."""
    a, b, c = distance(x1, y1, x2, y2), distance(x2, y2, x3, y3), distance(x3, y3, x1, y1)
    s = (a + b + c) / 2
    return F.sqrt(F.greatest(F.lit(0.0), s * (s - a) * (s - b) * (s - c)))


def line_parameter(px, py, qx, qy, x, y) -> Column:
    """t of the foot of (x, y) on p + t (q - p); null when p = q."""
    return F.try_divide((x - px) * (qx - px) + (y - py) * (qy - py), (qx - px) * (qx - px) + (qy - py) * (qy - py))


def line_distance(px, py, qx, qy, x, y) -> Column:
    t = line_parameter(px, py, qx, qy, x, y)
    return distance(x, y, px + t * (qx - px), py + t * (qy - py))


def segment_distance(px, py, qx, qy, x, y) -> Column:
    """To the segment; to p where p = q."""
    t = F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(1.0), line_parameter(px, py, qx, qy, x, y))), F.lit(0.0))
    return distance(x, y, px + t * (qx - px), py + t * (qy - py))


def intersection(p1x, p1y, p2x, p2y, q1x, q1y, q2x, q2y) -> tuple[Column, Column]:
    """(s, t) with p1 + s (p2 - p1) = q1 + t (q2 - q1); null for parallel lines."""
    dx, dy, ex, ey = p2x - p1x, p2y - p1y, q2x - q1x, q2y - q1y
    det = dx * ey - dy * ex
    return F.try_divide((q1x - p1x) * ey - (q1y - p1y) * ex, det), F.try_divide((q1x - p1x) * dy - (q1y - p1y) * dx, det)


def unit(dx: Column, dy: Column) -> tuple[Column, Column]:
    """Zero where there is no direction."""
    n = F.sqrt(dx * dx + dy * dy)
    some = n > DIRECTION_EPS
    return F.when(some, F.try_divide(dx, n)).otherwise(0.0), F.when(some, F.try_divide(dy, n)).otherwise(0.0)


def left_normal(px, py, qx, qy) -> tuple[Column, Column]:
    ux, uy = unit(qx - px, qy - py)
    return -uy, ux


def angle_difference(a: Column, b: Column) -> Column:
    """The short way round the circle."""
    d = F.abs(a - b)
    return F.least(F.pmod(d, F.lit(2 * math.pi)), 2 * math.pi - F.pmod(d, F.lit(2 * math.pi)))


def median3(a: Column, b: Column, c: Column) -> Column:
    return F.greatest(F.least(a, b), F.least(F.greatest(a, b), c))


def side(orientation: Column, towards: Column) -> Column:
    """front, left, back or right by sectors of 90 degrees about the orientation."""
    d = F.pmod(towards - orientation + math.pi / 4, F.lit(2 * math.pi))
    k = F.floor(d / (math.pi / 2))
    return F.when(k == 0, "front").when(k == 1, "left").when(k == 2, "back").when(k == 3, "right").otherwise("unknown")


def eigen2(xx: Column, xy: Column, yy: Column) -> tuple[Column, Column]:
    """Eigenvalues of a symmetric 2 x 2 matrix, the larger first."""
    mean, root = (xx + yy) / 2, F.sqrt((xx - yy) * (xx - yy) / 4 + xy * xy)
    return mean + root, mean - root


def sub_to_index(x: Column, y: Column, width: int) -> Column:
    return y * width + x


def gaussian_pdf2(dx, dy, xx, xy, yy) -> Column:
    """Density of a centred normal with the given covariance; null where it is singular."""
    det = xx * yy - xy * xy
    q = F.try_divide(yy * dx * dx - 2 * xy * dx * dy + xx * dy * dy, det)
    return F.when(det > 0, F.exp(-q / 2) / (2 * math.pi * F.sqrt(det)))


# --- three dimensions: vectors are tuples of three Columns ------------------


def dot3(a, b) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def cross3(a, b) -> tuple[Column, Column, Column]:
    return a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]


def difference3(a, b) -> tuple[Column, Column, Column]:
    """b - a."""
    return b[0] - a[0], b[1] - a[1], b[2] - a[2]


def length3(a) -> Column:
    return F.sqrt(dot3(a, a))


def plane_normal(a, b, c) -> tuple[Column, Column, Column]:
    """Of the plane through three points, turned to z >= 0; not of unit length."""
    n = cross3(difference3(a, b), difference3(a, c))
    s = F.when(n[2] < 0, -1.0).otherwise(1.0)
    return n[0] * s, n[1] * s, n[2] * s


def plane_line(op, normal, ol, u) -> Column:
    """t with ol + t u on the plane through op; null for a parallel line."""
    return F.try_divide(dot3(difference3(ol, op), normal), dot3(u, normal))


def closest_on_line3(p, q, x) -> tuple[Column, Column, Column]:
    """The foot of x on the line through p and q, in three dimensions; p where p = q."""
    d = difference3(p, q)
    t = F.coalesce(F.try_divide(dot3(difference3(p, x), d), dot3(d, d)), F.lit(0.0))
    return p[0] + t * d[0], p[1] + t * d[1], p[2] + t * d[2]


# --- predicates and pair metrics --------------------------------------------


def collinear(ax, ay, bx, by, cx, cy, eps: float) -> Column:
    """By the sine of the angle at a; coincident points are."""
    ux, uy = unit(bx - ax, by - ay)
    vx, vy = unit(cx - ax, cy - ay)
    return F.abs(ux * vy - uy * vx) < eps


def parallel(ax, ay, bx, by, cx, cy, dx, dy, eps: float) -> Column:
    ux, uy = unit(bx - ax, by - ay)
    vx, vy = unit(dx - cx, dy - cy)
    return F.abs(ux * vy - uy * vx) < eps


def approaching(ax, ay, avx, avy, bx, by, bvx, bvy) -> Column:
    """Whether the gap closes, or stays."""
    return (bvx - avx) * (bx - ax) + (bvy - avy) * (by - ay) <= 0


def bisector(ox, oy, ax, ay, bx, by) -> tuple[Column, Column]:
    """Unit bisector of the angle a-o-b; the left normal of a-o where the arms are opposite."""
    ux, uy = unit(ax - ox, ay - oy)
    vx, vy = unit(bx - ox, by - oy)
    sx, sy = ux + vx, uy + vy
    flat = sx * sx + sy * sy < 1e-10
    nx, ny = unit(sx, sy)
    return F.when(flat, -uy).otherwise(nx), F.when(flat, ux).otherwise(ny)


def pair_metric(px, py, pz, pt, qx, qy, qz, qt, scale: float, wz: float, wt: float) -> Column:
    """Distance of two pair features (middle, half length, angle), weighted."""
    d = (px - qx) * (px - qx) + (py - qy) * (py - qy) + wz * (pz - qz) * (pz - qz)
    s = F.sin(pt - qt)
    return F.sqrt(d + wt * scale * scale * s * s)


def off_axis(px, py, pt, qx, qy) -> Column:
    """Distance of q from the line through p that is square to the direction pt."""
    return F.abs((qx - px) * F.cos(pt) + (qy - py) * F.sin(pt))


def compatibility(dx: Column, dy: Column, sigma: float) -> Column:
    """Gaussian of a velocity difference; 0 beyond sqrt(2) sigma."""
    d2 = dx * dx + dy * dy
    return F.when(d2 > 2 * sigma * sigma, 0.0).otherwise(F.exp(-d2 / (2 * sigma * sigma)))


def saliency(length: Column, angle: Column, beta: float, gamma: float) -> Column:
    """Logistic in the length, times how straight the angle is."""
    return (1 - F.cos(angle)) / 2 / (1 + F.exp(gamma * (length - beta)))
