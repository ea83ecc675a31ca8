"""Points on the four-dimensional unit sphere, as Column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the projection: the golden angle, a band's width, and the band of each code point.
GOLDEN = 2 * math.pi / 1.6180339887498948482**2
BAND = math.pi / 16
BANDS = [
    (0x00, 0x1F, 0),
    (0x7F, 0x7F, 0),
    (0x30, 0x39, 1),
    (0x41, 0x5A, 2),
    (0x61, 0x7A, 3),
    (0x20, 0x7E, 4),
    (0x80, 0x24F, 5),
    (0x370, 0x3FF, 6),
    (0x400, 0x4FF, 7),
    (0x4E00, 0x9FFF, 8),
]
HIGH_FROM, HIGH_BAND, OTHER_BAND = 0x1F600, 9, 10
PI, TWO_PI, EDGE = math.pi, 2 * math.pi, 0.001
AXES = ("x", "y", "z", "m")
#: The two axes of each attention head, in turn.
HEAD_AXES = [("x", "y"), ("y", "z"), ("z", "m"), ("m", "x")]


def band(code: Column) -> Column:
    """The category of a code point; the first range that holds it counts."""
    out = F.when(code.between(*BANDS[0][:2]), BANDS[0][2])
    for low, high, value in BANDS[1:]:
        out = out.when(code.between(low, high), value)
    return out.when(code >= HIGH_FROM, HIGH_BAND).otherwise(OTHER_BAND)


def on_sphere(psi: Column, theta: Column, phi: Column) -> list[Column]:
    """x, y, z, m of three angles; the first two keep clear of the poles."""
    keep = lambda a: F.least(F.greatest(a, F.lit(EDGE)), F.lit(PI - EDGE))
    psi, theta = keep(psi), keep(theta)
    return [F.sin(psi) * F.sin(theta) * F.cos(phi), F.sin(psi) * F.sin(theta) * F.sin(phi), F.sin(psi) * F.cos(theta), F.cos(psi)]


def project_code(code: Column) -> list[Column]:
    """The point of a code point."""
    psi = (band(code) + 0.5) * F.lit(BAND) + ((code % 1000) / 100000.0) * F.lit(BAND) * 0.1
    theta = ((code % 10000) * F.lit(GOLDEN)) % F.lit(PI)
    phi = (code * F.lit(GOLDEN) * 1.5) % F.lit(TWO_PI)
    return on_sphere(psi, theta, phi)


def project_integer(n: Column) -> list[Column]:
    """The point of an integer: its sign picks the hemisphere."""
    size = F.abs(n).cast("double")
    psi = F.when(n >= 0, F.lit(PI / 4)).otherwise(F.lit(3 * PI / 4)) + (F.abs(n) % 1000) / 10000.0
    return on_sphere(psi, (size * F.lit(GOLDEN)) % F.lit(PI), (size * F.lit(GOLDEN) * 1.6180339887498948482) % F.lit(TWO_PI))


def project_double_bits(bits: Column) -> list[Column]:
    """The point of a double by its bits: exponent, high and low mantissa, sign."""
    exponent = F.shiftrightunsigned(bits, 52).bitwiseAND(F.lit(0x7FF))
    mantissa = bits.bitwiseAND(F.lit(0xFFFFFFFFFFFFF))
    phi = mantissa.bitwiseAND(F.lit(0xFFFFFFFF)) / float(0xFFFFFFFF) * TWO_PI + F.when(bits < 0, F.lit(PI)).otherwise(0.0)
    return on_sphere(exponent / 2048.0 * PI, F.shiftright(mantissa, 32) / float(0xFFFFF) * PI, phi % F.lit(TWO_PI))


def is_on_sphere(point: list[Column], tolerance: float = 1e-9) -> Column:
    return F.abs(sum((c * c for c in point[1:]), point[0] * point[0]) - 1.0) < tolerance


def _apart(a: Column, b: Column | float) -> Column:
    d = a - b
    return d * d


def planar_distance(a: list, b: list) -> Column:
    """Distance by the first two ordinates alone, as the spatial index has it."""
    return F.sqrt(_apart(a[0], b[0]) + _apart(a[1], b[1]))


def distance(a: list, b: list) -> Column:
    """Euclidean distance in all four ordinates; NaN ordinates count as 0."""
    clean = lambda c: F.nanvl(c, F.lit(0.0)) if isinstance(c, Column) else F.lit(float(c))
    parts = [_apart(clean(p), clean(q)) for p, q in zip(a, b, strict=True)]
    return F.sqrt(parts[0] + parts[1] + parts[2] + parts[3])


def closeness(d: Column) -> Column:
    """1 at distance 0, falling to 0."""
    return 1.0 / (1.0 + d)


def head_distance(head: Column, a: dict[str, Column], b: dict[str, Column]) -> Column:
    """Distance in the plane of an attention head."""
    planes = [F.sqrt(_apart(a[p], b[p]) + _apart(a[q], b[q])) for p, q in HEAD_AXES]
    return F.when(head % 4 == 0, planes[0]).when(head % 4 == 1, planes[1]).when(head % 4 == 2, planes[2]).otherwise(planes[3])


def quantized(v: Column) -> Column:
    """An ordinate of [-1, 1] as 32 bits."""
    return F.floor(F.least(F.greatest((v + 1) / 2, F.lit(0.0)), F.lit(1.0)) * 4294967295.0 + 0.5).cast("long")


def dequantized(q: Column) -> Column:
    """The ordinate of 32 bits."""
    return q / 4294967295.0 * 2 - 1


def added(a: list, b: list) -> list[Column]:
    return [p + q for p, q in zip(a, b, strict=True)]


def subtracted(a: list, b: list) -> list[Column]:
    return [p - q for p, q in zip(a, b, strict=True)]


def scaled(a: list, by) -> list[Column]:
    return [p * by for p in a]


def centroid(path: Column) -> Column:
    """struct(x, y, z, m): the mean of an array of points; NaN ordinates count as 0, no points as the origin."""
    mean = lambda c: F.when(F.size(path) > 0, F.aggregate(path, F.lit(0.0), lambda s, p: s + F.nanvl(p[c], F.lit(0.0))) / F.size(path)).otherwise(0.0)
    return F.struct(*[mean(c).alias(c) for c in AXES])


def magnitude(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, a: s + a.cast("double") * a.cast("double")))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, p: s + p)


def normalized(v: Column) -> Column:
    """A vector of length 1; one of (almost) no length stays."""
    size = magnitude(v)
    return F.when(size > 1e-15, F.transform(v, lambda a: a / size)).otherwise(v.cast("array<double>"))


def thirds(v: Column) -> list[Column]:
    """A vector reduced to three: the sums of its thirds over the root of a third of its length."""
    n = F.size(v)
    third = F.floor(n / 3).cast("int")
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double"))
    return [total(F.slice(v, start, length)) / F.sqrt(n / 3.0) for start, length in ((F.lit(1), third), (third + 1, third), (2 * third + 1, n - 2 * third))]


def path_length(path: Column) -> Column:
    """Planar length of an array of points."""
    steps = F.zip_with(F.slice(path, 1, F.greatest(F.size(path) - 1, F.lit(0))), F.slice(path, 2, F.greatest(F.size(path) - 1, F.lit(0))), lambda a, b: F.sqrt(_apart(a["x"], b["x"]) + _apart(a["y"], b["y"])))
    return F.aggregate(steps, F.lit(0.0), lambda s, d: s + d)


def _segments(path: Column) -> Column:
    """array<struct<a, b>> of neighbouring points."""
    n = F.greatest(F.size(path) - 1, F.lit(0))
    return F.zip_with(F.slice(path, F.lit(1), n), F.slice(path, F.lit(2), n), lambda a, b: F.struct(a.alias("a"), b.alias("b")))


def path_centre(path: Column) -> Column:
    """struct(x, y): the planar centre of a line, its segments weighted by length; of points, their mean."""
    parts = F.transform(
        _segments(path), lambda s: F.struct(F.sqrt(_apart(s["a"]["x"], s["b"]["x"]) + _apart(s["a"]["y"], s["b"]["y"])).alias("w"), ((s["a"]["x"] + s["b"]["x"]) / 2).alias("x"), ((s["a"]["y"] + s["b"]["y"]) / 2).alias("y"))
    )
    long = path_length(path)
    line = lambda c: F.aggregate(parts, F.lit(0.0), lambda t, p: t + p["w"] * p[c]) / long
    mean = lambda c: F.aggregate(path, F.lit(0.0), lambda t, p: t + p[c]) / F.size(path)
    return F.struct(*[F.when(long > 0, line(c)).when(F.size(path) > 0, mean(c)).alias(c) for c in "xy"])


def path_kind(path: Column) -> Column:
    """POINT, LINESTRING, or null where there is none."""
    return F.when(F.size(path) == 1, "POINT").when(F.size(path) > 1, "LINESTRING")


def hausdorff(a: Column, b: Column) -> Column:
    """The planar Hausdorff distance of two arrays of points."""
    far = lambda p, q: F.array_max(F.transform(p, lambda s: F.array_min(F.transform(q, lambda t: F.sqrt(_apart(s["x"], t["x"]) + _apart(s["y"], t["y"]))))))
    return F.greatest(far(a, b), far(b, a))


def frechet(a: Column, b: Column) -> Column:
    """The planar discrete Frechet distance: row by row of the table of least greatest steps."""
    far = lambda p, q: F.sqrt(_apart(p["x"], q["x"]) + _apart(p["y"], q["y"]))

    def row(last: Column, p: Column) -> Column:
        def cell(done: Column, j: Column) -> Column:
            reach = F.least(F.get(last, j), F.get(last, j - 1), F.get(done, j - 1))  # nulls are left out
            return F.concat(done, F.array(F.greatest(far(p, F.get(b, j)), F.coalesce(reach, F.lit(0.0)))))

        return F.aggregate(F.sequence(F.lit(0), F.size(b) - 1), F.array().cast("array<double>"), cell)

    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.element_at(F.aggregate(a, F.array().cast("array<double>"), row), -1))


def paths_cross(a: Column, b: Column) -> Column:
    """Whether a segment of one path properly crosses one of the other."""
    turn = lambda p, q, r: F.signum((q["x"] - p["x"]) * (r["y"] - p["y"]) - (q["y"] - p["y"]) * (r["x"] - p["x"]))
    cross = lambda s, t: (turn(s["a"], s["b"], t["a"]) * turn(s["a"], s["b"], t["b"]) < 0) & (turn(t["a"], t["b"], s["a"]) * turn(t["a"], t["b"], s["b"]) < 0)
    return F.exists(_segments(a), lambda s: F.exists(_segments(b), lambda t: cross(s, t)))


def in_polygon(x: Column, y: Column, corners: list[tuple[float, float]]) -> Column:
    """Whether a point lies in a polygon: a ray from it crosses an odd number of sides."""
    odd = F.lit(0)
    for (ax, ay), (bx, by) in zip(corners, corners[1:] + corners[:1]):
        if ay != by:
            odd = odd + F.when(((F.lit(ay) > y) != (F.lit(by) > y)) & (x < (bx - ax) * (y - ay) / (by - ay) + ax), 1).otherwise(0)
    return odd % 2 == 1
