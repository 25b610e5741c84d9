"""Box geometry as column arithmetic; boxes are corners (x1, y1, x2, y2)."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

from boxframe.schemas import EMPTY_SIDE, MOL


class Box(NamedTuple):
    x1: Column
    y1: Column
    x2: Column
    y2: Column

    @classmethod
    def of(cls, value: Column) -> Box:
        """The corners of a struct column."""
        return cls(*(value[c] for c in cls._fields))

    def named(self, prefix: str = "") -> list[Column]:
        return [c.alias(prefix + n) for n, c in zip(self._fields, self, strict=True)]

    @property
    def area(self) -> Column:
        return (self.x2 - self.x1) * (self.y2 - self.y1)


def from_xywh(x: Column, y: Column, w: Column, h: Column, width: Column, height: Column) -> Box:
    """Pixels from the corner and size, to corners normalised by the image."""
    return Box(x / width, y / height, (x + w) / width, (y + h) / height)


def to_pixels(box: Box, width: Column, height: Column) -> Box:
    return Box(box.x1 * width, box.y1 * height, box.x2 * width, box.y2 * height)


def to_xywh(box: Box, width: Column, height: Column) -> tuple[Column, Column, Column, Column]:
    """Normalised corners to pixels, corner and size."""
    return box.x1 * width, box.y1 * height, (box.x2 - box.x1) * width, (box.y2 - box.y1) * height


def crop_rectangle(box: Box, width: Column, height: Column) -> Box:
    """Whole pixels to cut out, cut to the image."""
    p = to_pixels(box, width, height)
    whole = lambda c: c.cast("long")
    return Box(F.greatest(whole(p.x1), F.lit(0)), F.greatest(whole(p.y1), F.lit(0)), F.least(whole(p.x2), F.lit(width).cast("long")), F.least(whole(p.y2), F.lit(height).cast("long")))


def is_mol(category: Column) -> Column:
    return category == MOL


def is_empty(box: Box) -> Column:
    return (F.abs(box.x2 - box.x1) <= EMPTY_SIDE) | (F.abs(box.y2 - box.y1) <= EMPTY_SIDE)


def to_center(box: Box) -> tuple[Column, Column, Column, Column]:
    return (box.x1 + box.x2) / 2, (box.y1 + box.y2) / 2, box.x2 - box.x1, box.y2 - box.y1


def from_center(cx: Column, cy: Column, w: Column, h: Column) -> Box:
    return Box(cx - w / 2, cy - h / 2, cx + w / 2, cy + h / 2)


def clamp(box: Box, width: Column, height: Column) -> Box:
    inside = lambda c, most: F.least(F.greatest(c, F.lit(0.0)), F.lit(most))
    return Box(inside(box.x1, width), inside(box.y1, height), inside(box.x2, width), inside(box.y2, height))


def iou(a: Box, b: Box, digits: int | None = None) -> Column:
    """Intersection over union; 0 for disjoint boxes. ``digits`` rounds it, for comparing engines."""
    wide = F.least(a.x2, b.x2) - F.greatest(a.x1, b.x1)
    high = F.least(a.y2, b.y2) - F.greatest(a.y1, b.y1)
    both = wide * high
    value = F.coalesce(both / F.nullif(a.area + b.area - both, F.lit(0.0)), F.lit(0.0))
    if digits is not None:
        # Not by round, which goes through decimals.
        value = F.rint(value * 10.0**digits) / 10.0**digits
    return F.when((wide < 0) | (high < 0), F.lit(0.0)).otherwise(value)


def crop(box: Box, left: Column, top: Column, width: Column, height: Column) -> Box:
    """Corners in a cut-out; boxes outside it shrink to area 0 but stay."""
    return clamp(Box(box.x1 - left, box.y1 - top, box.x2 - left, box.y2 - top), width, height)


def hflip(box: Box, width: Column) -> Box:
    return Box(width - box.x2, box.y1, width - box.x1, box.y2)


def rotate90(box: Box, new_height: Column) -> Box:
    """A quarter turn; ``new_height`` is that of the turned picture (the old width)."""
    return Box(box.y1, new_height - box.x2, box.y2, new_height - box.x1)


def resized(width: Column, height: Column, size: int, max_size: int | None = None) -> tuple[Column, Column]:
    """Width and height with the shorter side at ``size``, unless the longer would pass ``max_size``."""
    short, long_ = F.least(width, height).cast("double"), F.greatest(width, height).cast("double")
    target = F.lit(float(size))
    if max_size is not None:
        target = F.when(long_ / short * size > max_size, F.rint(max_size * short / long_)).otherwise(target)
    other = lambda side, over: (target * side / over).cast("long")
    same = ((width <= height) & (width == target)) | ((height <= width) & (height == target))
    new_w = F.when(same, width.cast("long")).when(width < height, target.cast("long")).otherwise(other(width, height))
    new_h = F.when(same, height.cast("long")).when(width < height, other(height, width)).otherwise(target.cast("long"))
    return new_w, new_h


def scaled(box: Box, x_ratio: Column, y_ratio: Column) -> Box:
    return Box(box.x1 * x_ratio, box.y1 * y_ratio, box.x2 * x_ratio, box.y2 * y_ratio)


def normalised(box: Box, width: Column, height: Column) -> Box:
    one = F.lit(1.0)
    return clamp(Box(box.x1 / width, box.y1 / height, box.x2 / width, box.y2 / height), one, one)
