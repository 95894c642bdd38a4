"""Column functions over boxes. A box is four numeric columns x1, y1, x2, y2, half-open, from the top left."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F


class Box(NamedTuple):
    """Four columns, in any numeric type."""

    x1: Column
    y1: Column
    x2: Column
    y2: Column

    @classmethod
    def of(cls, prefix: str = "", suffix: str = "") -> Box:
        return cls(*(F.col(f"{prefix}{c}{suffix}") for c in cls._fields))

    @property
    def width(self) -> Column:
        return self.x2 - self.x1

    @property
    def height(self) -> Column:
        return self.y2 - self.y1

    @property
    def area(self) -> Column:
        return self.width * self.height

    @property
    def centre(self) -> tuple[Column, Column]:
        return (self.x1 + self.x2) / 2, (self.y1 + self.y2) / 2

    def named(self) -> list[Column]:
        return [c.alias(n) for c, n in zip(self, self._fields, strict=True)]


def _within(value: Column, low: int, high: Column) -> Column:
    return F.greatest(F.lit(low), F.least(value, high))


def clamp(box: Box, width: Column, height: Column) -> Box:
    """Starts to [0, size - 1], ends to [0, size]."""
    return Box(_within(box.x1, 0, width - 1), _within(box.y1, 0, height - 1), _within(box.x2, 0, width), _within(box.y2, 0, height))


def is_valid(box: Box) -> Column:
    return (box.x1 < box.x2) & (box.y1 < box.y2)


def shift_back(box: Box, dx: Column, dy: Column) -> Box:
    """Coordinates before padding by dx, dy; none below 0."""
    zero = F.lit(0)
    return Box(F.greatest(zero, box.x1 - dx), F.greatest(zero, box.y1 - dy), F.greatest(zero, box.x2 - dx), F.greatest(zero, box.y2 - dy))


def letterbox(width: Column, height: Column, target: int) -> dict[str, Column]:
    """Shrink to fit a square, never enlarge: new size (truncated) and the offsets that centre it."""
    scale = F.when((width > target) | (height > target), F.least(target / width, target / height)).otherwise(F.lit(1.0))
    w, h = (F.floor(x * scale).cast("long") for x in (width, height))
    return {"new_w": w, "new_h": h, "off_x": F.floor((target - w) / 2).cast("long"), "off_y": F.floor((target - h) / 2).cast("long")}


def _ratio(size: Column, by: Column) -> Column:
    """size / by, or 1 where `by` is not positive."""
    return F.when(by > 0, size / by).otherwise(F.lit(1.0))


def points_to_image(points: Column, box: Box, mask_w: Column, mask_h: Column) -> Column:
    """Points [[x, y], ...] of a mask of the box, in the image's coordinates."""
    sx, sy = _ratio(box.width, mask_w), _ratio(box.height, mask_h)
    return F.transform(points, lambda p: F.array(p[0] * sx + box.x1, p[1] * sy + box.y1))


def to_square(box: Box, width: Column, height: Column, size: int = 1024) -> Box:
    """Coordinates on a square canvas."""
    sx, sy = _ratio(F.lit(size), width), _ratio(F.lit(size), height)
    return Box(box.x1 * sx, box.y1 * sy, box.x2 * sx, box.y2 * sy)


def to_centre(box: Box, width: Column, height: Column) -> dict[str, Column]:
    """Centre and size as shares of the image's."""
    cx, cy = box.centre
    return {"cx": cx / width, "cy": cy / height, "w": box.width / width, "h": box.height / height}


def from_centre(cx: Column, cy: Column, w: Column, h: Column, width: Column, height: Column) -> Box:
    return Box((cx - w / 2) * width, (cy - h / 2) * height, (cx + w / 2) * width, (cy + h / 2) * height)


#: Each category's name and target size, and the largest side and area that a box of it stays under.
SIZES = [("tiny", 64, 64, 2000), ("small", 128, 128, 8000), ("medium", 256, 256, 32000), ("large", 512, 512, 128000)]


def size_category(width: Column, height: Column) -> tuple[Column, Column]:
    """Category and target side: the first whose side or area bound a box is under, else xlarge at 1024."""
    side, area = F.greatest(width, height), width * height
    name, target = F.lit("xlarge"), F.lit(1024)
    for category, size, top_side, top_area in reversed(SIZES):
        under = (side < top_side) | (area < top_area)
        name, target = F.when(under, category).otherwise(name), F.when(under, size).otherwise(target)
    return name, target


def crop_key(stem: Column, box: Box, was_fixed: Column) -> Column:
    return F.concat(F.concat_ws("_", stem, *(c.cast("string") for c in box)), F.when(was_fixed, "_FIXED").otherwise(""), F.lit(".jpg"))


def _snap(start: Column, end: Column, size: Column, low: Column, high: Column, limit: Column) -> tuple[Column, Column]:
    """One axis: to the far edge if `high`, then to the near edge if `low`; the near edge wins. Sizes are cut to `limit`."""
    length = F.least(end - start, limit)
    far_start = F.when(high, F.greatest(size - length, F.lit(0))).otherwise(start)
    far_end = F.when(high, F.when(size - length < 0, length).otherwise(size)).otherwise(end)
    near_start = F.when(low, F.when(length > size, size - length).otherwise(F.lit(0))).otherwise(far_start)
    near_end = F.when(low, F.least(length, size)).otherwise(far_end)
    return near_start, near_end


def fix_at_border(box: Box, width: Column, height: Column, margin: int = 10) -> tuple[Box, Column]:
    """A box near a border goes to it, cut to a quarter of the image in each direction it moves; and whether it did."""
    top, left = box.y1 <= margin, box.x1 <= margin
    bottom, right = box.y2 >= height - margin, box.x2 >= width - margin
    y1, y2 = _snap(box.y1, box.y2, height, top, bottom, F.floor(height / 4))
    x1, x2 = _snap(box.x1, box.x2, width, left, right, F.floor(width / 4))
    return Box(x1, y1, x2, y2), top | left | bottom | right


def would_be_tiny(box: Box, width: Column, height: Column, least: int = 20) -> Column:
    inside = clamp(box, width, height)
    return (inside.width < least) | (inside.height < least)


def intersection(a: Box, b: Box) -> Column:
    w = F.least(a.x2, b.x2) - F.greatest(a.x1, b.x1)
    h = F.least(a.y2, b.y2) - F.greatest(a.y1, b.y1)
    return F.when((w > 0) & (h > 0), w * h).otherwise(F.lit(0))


def iou(a: Box, b: Box, floor: float | None = None) -> Column:
    """0 for disjoint boxes. With `floor`, the union is taken as that at least, and disjoint boxes are not special."""
    inter = intersection(a, b)
    union = a.area + b.area - inter
    if floor is not None:
        return inter / F.greatest(union.cast("double"), F.lit(floor))
    return F.when((inter > 0) & (union > 0), inter / union).otherwise(F.lit(0.0))


def giou(a: Box, b: Box, floor: float = 1e-6) -> Column:
    """IoU less the share of the enclosing box that neither covers."""
    union = F.greatest((a.area + b.area - intersection(a, b)).cast("double"), F.lit(floor))
    hull = (F.greatest(a.x2, b.x2) - F.least(a.x1, b.x1)) * (F.greatest(a.y2, b.y2) - F.least(a.y1, b.y1))
    hull = F.greatest(hull.cast("double"), F.lit(floor))
    return intersection(a, b) / union - (hull - union) / hull
