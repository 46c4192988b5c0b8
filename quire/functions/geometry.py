"""Column functions over boxes: structs of x0, y0, x1, y1, with x1 and y1 exclusive."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def box(x0, y0, x1, y1) -> Column:
    col = lambda v: F.col(v) if isinstance(v, str) else v
    return F.struct(col(x0).alias("x0"), col(y0).alias("y0"), col(x1).alias("x1"), col(y1).alias("y1"))


def width(a: Column) -> Column:
    return a["x1"] - a["x0"]


def height(a: Column) -> Column:
    return a["y1"] - a["y0"]


def area(a: Column) -> Column:
    return width(a) * height(a)


def meet(a: Column, b: Column) -> Column:
    """Area of the intersection."""
    w = F.least(a["x1"], b["x1"]) - F.greatest(a["x0"], b["x0"])
    h = F.least(a["y1"], b["y1"]) - F.greatest(a["y0"], b["y0"])
    return F.greatest(w, F.lit(0)) * F.greatest(h, F.lit(0))


def overlap_fraction(a: Column, b: Column) -> Column:
    """Intersection over the area of a, which counts as 1 at least."""
    return meet(a, b) / F.greatest(area(a), F.lit(1))


def vertical_overlap(a: Column, b: Column) -> Column:
    """Common height over the smaller height (P5)."""
    h = F.least(a["y1"], b["y1"]) - F.greatest(a["y0"], b["y0"])
    return F.greatest(h, F.lit(0)) / F.greatest(F.least(height(a), height(b)), F.lit(1))


def intersects(a: Column, b: Column) -> Column:
    return (a["x0"] < b["x1"]) & (b["x0"] < a["x1"]) & (a["y0"] < b["y1"]) & (b["y0"] < a["y1"])


def contains(outer: Column, inner: Column, tolerance: int = 2) -> Column:
    return (inner["x0"] >= outer["x0"] - tolerance) & (inner["y0"] >= outer["y0"] - tolerance) & (inner["x1"] <= outer["x1"] + tolerance) & (inner["y1"] <= outer["y1"] + tolerance)


def iou(a: Column, b: Column) -> Column:
    """Intersection over union, 0 for empty boxes."""
    union = area(a) + area(b) - meet(a, b)
    return F.when(union > 0, meet(a, b) / union).otherwise(F.lit(0.0))


def clip(a: Column, w, h) -> Column:
    """The box within a page."""
    to = lambda v, top: F.least(F.greatest(v, F.lit(0)), F.lit(top) if isinstance(top, int) else top)
    return box(to(a["x0"], w), to(a["y0"], h), to(a["x1"], w), to(a["y1"], h))


def grow(a: Column, m) -> Column:
    m = F.lit(m) if isinstance(m, int) else m
    return box(a["x0"] - m, a["y0"] - m, a["x1"] + m, a["y1"] + m)


def once(value: Column, f) -> Column:
    """f of a value that is made once, however often f names it."""
    return F.transform(F.array(value), f)[0]


def of_points(points: Column) -> Column:
    """The box of an array of structs x, y: floor of the least, ceiling of the most."""

    def around(ps: Column) -> Column:
        xs, ys = F.transform(ps, lambda p: p["x"]), F.transform(ps, lambda p: p["y"])
        return box(F.floor(F.array_min(xs)), F.floor(F.array_min(ys)), F.ceil(F.array_max(xs)), F.ceil(F.array_max(ys)))

    return once(points, around)


def project(h: list[list[float]], x: Column, y: Column) -> tuple[Column, Column]:
    """A point under a 3 x 3 homography."""
    row = lambda r: x * r[0] + y * r[1] + r[2]
    return row(h[0]) / row(h[2]), row(h[1]) / row(h[2])


def quarter_turn(rot: Column, w: Column, h: Column) -> tuple[Column, Column]:
    """The matrix (rows of a point's x, y, 1) that turns a page of w by h by rot degrees, and its size then (P20)."""
    row = lambda *v: F.array(*[F.lit(x).cast("long") if isinstance(x, int) else x for x in v])
    last = row(0, 0, 1)
    m = F.when(rot == 90, F.array(row(0, -1, h - 1), row(1, 0, 0), last)).when(rot == 180, F.array(row(-1, 0, w - 1), row(0, -1, h - 1), last)).when(rot == 270, F.array(row(0, 1, 0), row(-1, 0, w - 1), last)).otherwise(F.array(row(1, 0, 0), row(0, 1, 0), last))
    return m, F.when(rot.isin(90, 270), F.array(h, w)).otherwise(F.array(w, h))


def fold_angle(a: Column) -> Column:
    """An angle folded to [-90, 90)."""
    return F.pmod(a + 90, F.lit(180)) - 90


def order_quad(points: Column) -> Column:
    """Four points by their angle around the centroid, from the one with the least x + y on."""
    mean = lambda ps, c: F.aggregate(ps, F.lit(0.0), lambda s, p: s + p[c]) / F.size(ps)

    def turned(ps: Column, m: Column) -> Column:
        angles = F.array_sort(F.transform(ps, lambda p: F.struct(F.atan2(p["y"] - m["y"], p["x"] - m["x"]).alias("a"), p["x"].alias("x"), p["y"].alias("y"))))
        return F.transform(angles, lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y")))

    def from_least(plain: Column) -> Column:
        sums = F.transform(plain, lambda p: p["x"] + p["y"])
        return once(F.array_position(sums, F.array_min(sums)).cast("int"), lambda k: F.concat(F.slice(plain, k, F.size(plain)), F.slice(plain, F.lit(1), k - 1)))

    centre = lambda ps: F.struct(mean(ps, "x").alias("x"), mean(ps, "y").alias("y"))
    return once(points, lambda ps: once(once(centre(ps), lambda m: turned(ps, m)), from_least))
