"""Units, boxes, polygons and plane maps as column expressions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillset.functions.measures import MM_PER_INCH, iou, overlap

#: Fixed value: units of a page's own coordinates to an inch.
POINTS_PER_INCH = 72.0
#: Where the classes of a sheet's number of paths end.
PATH_CLASSES = (100, 500, 2000)


def mm_to_px(mm: Column, dpi: float = 200.0) -> Column:
    return mm * (dpi / MM_PER_INCH)


def px_to_mm(px: Column, dpi: float = 200.0) -> Column:
    return px / (dpi / MM_PER_INCH)


def site_mm(paper_mm: Column, denominator: Column) -> Column:
    """Millimetres on site; null without a scale."""
    return F.when(denominator > 0, paper_mm * denominator)


def expected_content_scale(old_denominator: Column, new_denominator: Column, old_area: Column, new_area: Column) -> Column:
    """By how much a drawing's content grows from one issue to the next; null where scales or areas are unknown."""
    known = (old_denominator > 0) & (new_denominator > 0) & (old_area > 0) & (new_area > 0)
    return F.when(known, old_denominator / new_denominator * F.sqrt(new_area / old_area))


def area_site_m2(area_px: Column, denominator: Column, dpi: float = 200.0) -> Column:
    side = MM_PER_INCH / dpi
    return F.when(denominator > 0, area_px * (side * side) * denominator * denominator / 1e6)


def length_text(px: Column, denominator: Column, dpi: float = 200.0) -> Column:
    """A length on paper and, where the scale is known, on site."""
    paper = px_to_mm(px, dpi)
    on_site = F.format_string("%.2f mm on paper, %.0f mm on site at 1:%d", paper, paper * denominator, denominator.cast("int"))
    return F.when(denominator > 0, on_site).otherwise(F.format_string("%.2f mm on paper", paper))


@dataclass
class Box:
    """A box by its corner and size."""

    x: Column
    y: Column
    w: Column
    h: Column

    @classmethod
    def of(cls, prefix: str = "") -> Box:
        return cls(*(F.col(f"{prefix}{c}") for c in "xywh"))

    @classmethod
    def around(cls, x: str, y: str) -> Box:
        """The box of a group's points, as aggregates."""
        return cls(F.min(x), F.min(y), F.max(x) - F.min(x), F.max(y) - F.min(y))

    @property
    def area(self) -> Column:
        return self.w * self.h

    @property
    def centre(self) -> tuple[Column, Column]:
        return self.x + self.w / 2, self.y + self.h / 2

    def expanded(self, by: Column | float) -> Box:
        return Box(self.x - by, self.y - by, self.w + 2 * by, self.h + 2 * by)

    def scaled(self, factor: Column | float) -> Box:
        return Box(self.x * factor, self.y * factor, self.w * factor, self.h * factor)

    def holds(self, px: Column, py: Column) -> Column:
        return (px >= self.x) & (px <= self.x + self.w) & (py >= self.y) & (py <= self.y + self.h)

    def contains(self, other: Box) -> Column:
        return (other.x >= self.x) & (other.y >= self.y) & (other.x + other.w <= self.x + self.w) & (other.y + other.h <= self.y + self.h)

    def intersects(self, other: Box) -> Column:
        return (self.x <= other.x + other.w) & (other.x <= self.x + self.w) & (self.y <= other.y + other.h) & (other.y <= self.y + self.h)

    def shared(self, other: Box) -> Column:
        return overlap(*self.columns, *other.columns)

    def iou(self, other: Box) -> Column:
        return iou(*self.columns, *other.columns)

    def inside(self, other: Box) -> Column:
        """The share of this box that lies in another; 0 for an empty one."""
        return F.coalesce(F.try_divide(self.shared(other), self.area), F.lit(0.0))

    def union(self, other: Box) -> Box:
        x, y = F.least(self.x, other.x), F.least(self.y, other.y)
        return Box(x, y, F.greatest(self.x + self.w, other.x + other.w) - x, F.greatest(self.y + self.h, other.y + other.h) - y)

    def clipped(self, least: float = 0.0, most: float = 1.0) -> Box:
        """What of the box lies between two limits on both axes; empty if nothing does."""
        lo, hi = F.lit(least), F.lit(most)
        x, y = F.least(F.greatest(self.x, lo), hi), F.least(F.greatest(self.y, lo), hi)
        right, top = F.least(F.greatest(self.x + self.w, lo), hi), F.least(F.greatest(self.y + self.h, lo), hi)
        return Box(x, y, right - x, top - y)

    @property
    def columns(self) -> tuple[Column, Column, Column, Column]:
        return self.x, self.y, self.w, self.h

    def named(self, prefix: str = "") -> list[Column]:
        return [c.alias(f"{prefix}{n}") for c, n in zip(self.columns, "xywh", strict=True)]


def in_polygon(px: Column, py: Column, points: Column) -> Column:
    """Whether a point lies in a polygon (array of struct<x, y>), by the parity of edges to its right."""
    n = F.size(points)

    def crosses(i: Column) -> Column:
        a, b = F.get(points, i), F.get(points, (i + 1) % n)
        spans = (a["y"] > py) != (b["y"] > py)
        return spans & (px < a["x"] + F.try_divide((py - a["y"]) * (b["x"] - a["x"]), b["y"] - a["y"]))

    hits = F.size(F.filter(F.sequence(F.lit(0), n - 1), crosses))
    return F.when(n >= 3, hits % 2 == 1).otherwise(False)


def page_to_px(x: Column, y: Column, box_x: Column, box_y: Column, height: Column, dpi: float = 200.0) -> tuple[Column, Column]:
    """Page points (y up, from any origin) to pixels (y down)."""
    scale = dpi / POINTS_PER_INCH
    return (x - box_x) * scale, (height - (y - box_y)) * scale


def mapped(x: Column, y: Column, m: tuple[Column, ...]) -> tuple[Column, Column]:
    """A point under a plane map (m00, m01, m10, m11, tx, ty)."""
    return m[0] * x + m[1] * y + m[4], m[2] * x + m[3] * y + m[5]


def mapped_box(box: Box, m: tuple[Column, ...]) -> Box:
    """The box around the four mapped corners."""
    corners = [mapped(x, y, m) for x in (box.x, box.x + box.w) for y in (box.y, box.y + box.h)]
    xs, ys = zip(*corners, strict=True)
    x, y = F.least(*xs), F.least(*ys)
    return Box(x, y, F.greatest(*xs) - x, F.greatest(*ys) - y)


def at_other_dpi(m: tuple[Column, ...], factor: Column | float) -> tuple[Column, ...]:
    """The same map where pixels are ``factor`` times finer: only the shift changes."""
    return (*m[:4], m[4] * factor, m[5] * factor)


def decomposed(m: tuple[Column, ...]) -> Column:
    """struct(rotation_deg, scale_x, scale_y, shear, determinant): the map as a rotation after a scale and shear."""
    a, b, c, d = m[:4]
    determinant, length = a * d - b * c, F.sqrt(a * a + c * c)
    flat = length <= 1e-12
    other = F.sqrt(b * b + d * d) * F.when(determinant < 0, -1.0).otherwise(1.0)
    return F.struct(
        F.when(flat, 0.0).otherwise(F.degrees(F.atan2(c, a))).alias("rotation_deg"),
        length.alias("scale_x"),
        F.when(flat, other).otherwise(F.try_divide(determinant, length)).alias("scale_y"),
        F.when(flat, 0.0).otherwise(F.try_divide(a * b + c * d, length)).alias("shear"),
        determinant.alias("determinant"),
    )


def similarity(tx: Column, ty: Column, rotation_deg: Column, scale: Column) -> tuple[Column, ...]:
    c, s = scale * F.cos(F.radians(rotation_deg)), scale * F.sin(F.radians(rotation_deg))
    return c, -s, s, c, tx, ty


def page_shape(width_mm: Column, height_mm: Column) -> Column:
    """struct(width, height, orientation), sizes to the nearest 5 mm."""
    w, h = (F.bround(v / 5) * 5 for v in (width_mm, height_mm))
    return F.struct(w.alias("width"), h.alias("height"), F.when(w == h, "square").when(w > h, "landscape").otherwise("portrait").alias("orientation"))


def path_class(n: Column) -> Column:
    """0 to 3 by how many paths a sheet has."""
    return sum((F.when(n >= limit, 1).otherwise(0) for limit in PATH_CLASSES[1:]), F.when(n >= PATH_CLASSES[0], 1).otherwise(0))
