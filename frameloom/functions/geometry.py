"""Boxes, polygons and projections as column expressions.

A box is four columns x1, y1, x2, y2; everything stays in the JVM.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F


class Box(NamedTuple):
    x1: Column
    y1: Column
    x2: Column
    y2: Column

    @staticmethod
    def of(prefix: str = "", alias: str | None = None) -> Box:
        at = f"{alias}." if alias else ""
        return Box(*(F.col(f"{at}{prefix}{c}") for c in ("x1", "y1", "x2", "y2")))


def width(b: Box) -> Column:
    return b.x2 - b.x1


def height(b: Box) -> Column:
    return b.y2 - b.y1


def center(b: Box) -> tuple[Column, Column]:
    return (b.x1 + b.x2) * 0.5, (b.y1 + b.y2) * 0.5


def area(b: Box) -> Column:
    return F.greatest(F.lit(0.0), width(b)) * F.greatest(F.lit(0.0), height(b))


def overlap(a: Box, b: Box) -> Column:
    w = F.least(a.x2, b.x2) - F.greatest(a.x1, b.x1)
    h = F.least(a.y2, b.y2) - F.greatest(a.y1, b.y1)
    return F.greatest(F.lit(0.0), w) * F.greatest(F.lit(0.0), h)


def iou(a: Box, b: Box) -> Column:
    both = overlap(a, b)
    return F.when(both > 0, both / (width(a) * height(a) + width(b) * height(b) - both + 1e-12)).otherwise(0.0)


def diagonal(b: Box) -> Column:
    return F.hypot(width(b), height(b))


def clamped(b: Box, w: Column | int, h: Column | int) -> Box:
    """Rounded half to even and held within the image."""

    def held(c: Column, most: Column | int) -> Column:
        top = (most if isinstance(most, Column) else F.lit(most)) - 1
        return F.greatest(F.lit(0), F.least(top.cast("int"), F.bround(c).cast("int")))

    return Box(held(b.x1, w), held(b.y1, h), held(b.x2, w), held(b.y2, h))


def cropped(b: Box, w: int, h: int) -> Box:
    """Cut down to whole pixels with exclusive far edges, as crops are taken."""
    return Box(
        F.greatest(F.lit(0), F.least(F.lit(w - 1), b.x1.cast("int"))),
        F.greatest(F.lit(0), F.least(F.lit(h - 1), b.y1.cast("int"))),
        F.greatest(F.lit(0), F.least(F.lit(w), b.x2.cast("int"))),
        F.greatest(F.lit(0), F.least(F.lit(h), b.y2.cast("int"))),
    )


def degenerate(b: Box) -> Column:
    return (b.x2 <= b.x1) | (b.y2 <= b.y1)


def from_center(cx: Column, cy: Column, w: Column, h: Column) -> Box:
    return Box(cx - w / 2, cy - h / 2, cx + w / 2, cy + h / 2)


def ground_point(b: Box) -> tuple[Column, Column]:
    """Where the feet are: the middle of the lower edge."""
    return (b.x1 + b.x2) * 0.5, b.y2


def projected(x: Column, y: Column, m: Sequence[float] | Column) -> tuple[Column, Column]:
    """A homography's image of a point; points at infinity go to the origin."""
    c = [m[i] if isinstance(m, Column) else F.lit(float(m[i])) for i in range(9)]
    w = c[6] * x + c[7] * y + c[8]
    at = lambda a, b, d: F.when(w != 0, (a * x + b * y + d) / w).otherwise(0.0)
    return at(*c[:3]), at(*c[3:6])


def letterbox(w: Column, h: Column, size: int, stride: int | None = None) -> dict[str, Column]:
    """Ratio and padding that fit an image into a square, or into the least multiple of a stride."""
    ratio = F.least(F.lit(float(size)) / w, F.lit(float(size)) / h)
    new_w, new_h = F.bround(w * ratio), F.bround(h * ratio)
    rest_w, rest_h = F.lit(float(size)) - new_w, F.lit(float(size)) - new_h
    if stride:
        rest_w, rest_h = rest_w % stride, rest_h % stride
    return {"ratio": ratio, "new_w": new_w, "new_h": new_h, "pad_x": rest_w / 2, "pad_y": rest_h / 2}


def unletterbox(b: Box, ratio: Column, pad_x: Column, pad_y: Column, w: Column, h: Column) -> Box:
    held = lambda c, pad, most: F.greatest(F.lit(0.0), F.least(most, (c - pad) / ratio))
    return Box(held(b.x1, pad_x, w), held(b.y1, pad_y, h), held(b.x2, pad_x, w), held(b.y2, pad_y, h))


def resized(w: Column, h: Column, most: int = 1280, step: int = 32) -> tuple[Column, Column]:
    """Size with the same shape, never larger, whose sides are multiples of a step."""
    scale = F.least(F.lit(1.0), F.lit(float(most)) / F.greatest(w, h))
    side = lambda c: F.greatest(F.lit(step), (F.floor(c * scale / step) * step).cast("int"))
    return side(w), side(h)


def expanded(b: Box, scale: float, w: Column | int, h: Column | int) -> Box:
    """Grown about its middle to whole pixels and clipped."""
    (cx, cy), grown_w, grown_h = center(b), width(b) * scale, height(b) * scale
    far = lambda most: most if isinstance(most, Column) else F.lit(most)
    return Box(
        F.greatest(F.lit(0), F.floor(cx - grown_w / 2)),
        F.greatest(F.lit(0), F.floor(cy - grown_h / 2)),
        F.least(far(w), F.ceil(cx + grown_w / 2)),
        F.least(far(h), F.ceil(cy + grown_h / 2)),
    )


def in_polygon(x: Column, y: Column, polygon: Column, eps: float = 1e-9) -> Column:
    """Whether a point is within or on an array of (x, y); fewer than three corners hold nothing."""
    n = F.size(polygon)
    corners = F.sequence(F.lit(0), n - 1)

    def edge(i: Column) -> tuple[Column, ...]:
        a, b = polygon[F.when(i == 0, n - 1).otherwise(i - 1)], polygon[i]
        return a["x"], a["y"], b["x"], b["y"]

    def on(i: Column) -> Column:
        ax, ay, bx, by = edge(i)
        cross = (bx - ax) * (y - ay) - (by - ay) * (x - ax)
        within = x.between(F.least(ax, bx) - eps, F.greatest(ax, bx) + eps) & y.between(F.least(ay, by) - eps, F.greatest(ay, by) + eps)
        return (F.abs(cross) <= eps) & within

    def crossed(i: Column) -> Column:
        ax, ay, bx, by = edge(i)
        spans = (ay > y) != (by > y)
        return spans & (x < ax + (y - ay) * (bx - ax) / F.when(by != ay, by - ay).otherwise(1.0))

    odd = F.size(F.filter(corners, crossed)) % 2 == 1
    return F.when(n >= 3, F.exists(corners, on) | odd).otherwise(False)


def bearing(dx: Column, dy: Column) -> Column:
    return F.degrees(F.atan2(dy, dx))
