"""Boxes and relations between them as column expressions (origin top left, y grows downward).

Expressions are null where a coordinate is null; callers drop boxless rows first.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from leafline.config import ALIGN_TOLERANCE, EPS, FAR_DISTANCE


def num(x: float) -> Column:
    return F.lit(float(x))


def clamp(x: Column, lo: float, hi: float) -> Column:
    return F.least(num(hi), F.greatest(num(lo), x))


@dataclass(frozen=True)
class Box:
    left: Column
    top: Column
    width: Column
    height: Column

    @classmethod
    def of(cls, struct: str) -> Box:
        """From a struct column of x, y, w, h."""
        return cls(*(F.col(f"{struct}.{c}") for c in "xywh"))

    @property
    def right(self) -> Column:
        return self.left + self.width

    @property
    def bottom(self) -> Column:
        return self.top + self.height

    @property
    def cx(self) -> Column:
        return self.left + self.width / 2

    @property
    def cy(self) -> Column:
        return self.top + self.height / 2

    @property
    def area(self) -> Column:
        return self.width * self.height


def overlap_ratio(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """Shared length over the larger length; 0 for points."""
    longest = F.greatest(a1 - a0, b1 - b0)
    return F.when(longest > 0, F.greatest(num(0), F.least(a1, b1) - F.greatest(a0, b0)) / longest).otherwise(0.0)


def allen(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """Struct (relation, confidence, overlap) of two intervals; touching ones are overlaps of 0.1."""
    r = overlap_ratio(a0, a1, b0, b1)
    same = lambda x, y: F.abs(x - y) < EPS
    less = lambda x, y: x < y - EPS
    cases = [
        (same(a0, b0) & same(a1, b1), "equals", num(1)),
        (less(a1, b0), "precedes", num(0.9)),
        (less(b1, a0), "preceded_by", num(0.9)),
        (~(r > 0), "overlaps", num(0.1)),
        (same(a0, b0) & less(a1, b1), "starts", num(0.9)),
        (same(a0, b0), "started_by", num(0.9)),
        (same(a1, b1) & less(b0, a0), "finishes", num(0.9)),
        (same(a1, b1), "finished_by", num(0.9)),
        (less(b0, a0) & less(a1, b1), "during", F.least(num(0.9), r + 0.1)),
        (less(a0, b0) & less(b1, a1), "contains", F.least(num(0.9), r + 0.1)),
        (less(a0, b0) & less(a1, b1), "overlaps", F.greatest(num(0.5), r)),
    ]
    relation, sure = F.when(cases[0][0], cases[0][1]), F.when(cases[0][0], cases[0][2])
    for test, name, value in cases[1:]:
        relation, sure = relation.when(test, name), sure.when(test, value)
    return F.struct(relation.otherwise("overlapped_by").alias("relation"), sure.otherwise(F.greatest(num(0.5), r)).alias("confidence"), r.alias("overlap"))


def center_distance(a: Box, b: Box) -> Column:
    return F.sqrt((a.cx - b.cx) * (a.cx - b.cx) + (a.cy - b.cy) * (a.cy - b.cy))


def direction(a: Box, b: Box) -> Column:
    """Side of ``b`` on which ``a`` lies along the dominant axis; null when near in the middle."""
    dx, dy = a.cx - b.cx, a.cy - b.cy
    half_w, half_h = (a.width + b.width) / 2 * 0.5, (a.height + b.height) / 2 * 0.5
    wide = F.abs(dx) > F.abs(dy)
    return F.when(wide & (dx > half_w), "right_of").when(wide & (dx < -half_w), "left_of").when(~wide & (dy > half_h), "below").when(~wide & (dy < -half_h), "above")


def relation_confidence(h: Column, v: Column, a: Box, b: Box) -> Column:
    """Confidence of a relation from its two Allen structs."""
    nd = center_distance(a, b) / F.greatest((a.width + a.height + b.width + b.height) / 4, num(1))
    far = F.when(nd > 5, F.greatest(num(0.3), 1 - (nd - 5) * 0.1)).otherwise(1.0)
    shared = (h["overlap"] + v["overlap"]) / 2
    return clamp((h["confidence"] + v["confidence"]) / 2 * far * F.when(shared > 0, 1 + shared * 0.2).otherwise(1.0), 0.1, 1.0)


def direction_score(confidence: Column, side: Column) -> Column:
    """Confidence with a bonus by direction, weighted by 0.3."""
    bonus = F.when(side.isin("above", "below"), 0.2).when(side.isin("left_of", "right_of"), 0.1).otherwise(0.0)
    return F.least(num(1), confidence + bonus) * 0.3


def edge_distance(a: Box, b: Box) -> Column:
    h = F.greatest(num(0), F.greatest(a.left, b.left) - F.least(a.right, b.right))
    v = F.greatest(num(0), F.greatest(a.top, b.top) - F.least(a.bottom, b.bottom))
    return F.sqrt(h * h + v * v)


def corner_distance(a: Box, b: Box) -> Column:
    """Least distance between corners and centres of both boxes."""
    points = lambda x: [(x.left, x.top), (x.right, x.top), (x.left, x.bottom), (x.right, x.bottom), (x.cx, x.cy)]
    return F.sqrt(F.least(*((p - r) * (p - r) + (q - s) * (q - s) for p, q in points(a) for r, s in points(b))))


def size_ratio(a: Box, b: Box) -> Column:
    x, y = F.greatest(a.width, a.height), F.greatest(b.width, b.height)
    return F.least(x, y) / F.nullif(F.greatest(x, y), num(0))


def overlap_area(a: Box, b: Box) -> Column:
    w = F.least(a.right, b.right) - F.greatest(a.left, b.left)
    h = F.least(a.bottom, b.bottom) - F.greatest(a.top, b.top)
    return F.when((w > 0) & (h > 0), w * h).otherwise(0.0)


def overlap_share(a: Box, b: Box) -> Column:
    """Shared area over the smaller area."""
    return F.coalesce(overlap_area(a, b) / F.nullif(F.least(a.area, b.area), num(0)), num(0))


def _near(pairs: list[tuple[Column, Column, str]]) -> Column:
    out = F.when(F.abs(pairs[0][0] - pairs[0][1]) <= ALIGN_TOLERANCE, pairs[0][2])
    for x, y, name in pairs[1:]:
        out = out.when(F.abs(x - y) <= ALIGN_TOLERANCE, name)
    return out.otherwise("none")


def horizontal_alignment(a: Box, b: Box) -> Column:
    return _near([(a.left, b.left, "left"), (a.right, b.right, "right"), (a.cx, b.cx, "center")])


def vertical_alignment(a: Box, b: Box) -> Column:
    return _near([(a.top, b.top, "top"), (a.bottom, b.bottom, "bottom"), (a.cy, b.cy, "middle")])


def alignment_score(a: Box, b: Box) -> Column:
    hit = lambda c: (c != "none").cast("double")
    return (hit(horizontal_alignment(a, b)) + hit(vertical_alignment(a, b))) / 2


def same_row(a: Box, b: Box) -> Column:
    return F.least(a.bottom, b.bottom) - F.greatest(a.top, b.top) > (a.height + b.height) / 2 * 0.3


def same_column(a: Box, b: Box) -> Column:
    return F.least(a.right, b.right) - F.greatest(a.left, b.left) > (a.width + b.width) / 2 * 0.3


def reading_order(a: Box, b: Box) -> Column:
    lr = F.when(a.cx < b.cx, 0.7).when(a.cx > b.cx, 0.3).otherwise(0.5)
    tb = F.when(a.cy < b.cy, 0.8).when(a.cy > b.cy, 0.2).otherwise(0.5)
    return lr * 0.3 + tb * 0.7


def mean_side(a: Box, b: Box) -> Column:
    return F.greatest((a.width + a.height + b.width + b.height) / 4, num(1))


def angle(a: Box, b: Box) -> Column:
    return F.atan2(b.cy - a.cy, b.cx - a.cx)


def vertical_side(text: Box, image: Box) -> Column:
    """Where the image is from the text: below, above or overlap."""
    return F.when(image.top >= text.bottom, "below").when(text.top >= image.bottom, "above").otherwise("overlap")


def vertical_score(text: Box, image: Box) -> Column:
    side = vertical_side(text, image)
    gap = F.when(side == "below", image.top - text.bottom).when(side == "above", text.top - image.bottom).otherwise(0.0)
    weight = F.when(side == "below", 1.0).when(side == "above", 0.3).otherwise(0.8)
    return F.exp(-gap / F.greatest(image.height * 2, num(1)) * 2) * weight


def horizontal_score(text: Box, image: Box) -> Column:
    shared = F.least(text.right, image.right) - F.greatest(text.left, image.left)
    r = shared / F.greatest(F.least(text.width, image.width), num(1))
    return F.when(shared <= 0, 0.0).when(r < 0.4, r * 0.3).otherwise(F.least(num(1), r * 1.2))


def distance_score(text: Box, image: Box, layout: Column | None = None) -> Column:
    """Decay of the centre distance by a base that follows the layout."""
    base = image.height * 4
    if layout is not None:
        diagonal = F.sqrt(image.width * image.width + image.height * image.height)
        base = F.when(layout == "single_column", image.height * 5).when(layout == "multi_column", image.height * 3).otherwise(diagonal * 2)
    return F.exp(-center_distance(text, image) / F.greatest(base, num(1)) * 1.5)


def base_score(text: Box, image: Box, layout: Column | None = None) -> Column:
    return vertical_score(text, image) * 0.4 + horizontal_score(text, image) * 0.25 + distance_score(text, image, layout) * 0.2 + alignment_score(text, image) * 0.1


def column_penalty(a: Column, b: Column) -> Column:
    d = F.abs(a - b)
    return F.when(d == 0, 1.0).when(d == 1, 0.6).when(d == 2, 0.3).otherwise(0.1)


def caption_position(text: Box, image: Box) -> Column:
    dx, dy = text.cx - image.cx, text.cy - image.cy
    inside = (text.left >= image.left) & (text.right <= image.right) & (text.top >= image.top) & (text.bottom <= image.bottom)
    tall = F.abs(dy) > F.abs(dx)
    return F.when(inside, "inside").when(center_distance(text, image) > FAR_DISTANCE, "distant").when(tall & (dy < 0), "above").when(tall, "below").when(dx < 0, "left").otherwise("right")


def legacy_score(text: Box, image: Box) -> Column:
    """The older spatial score from Allen confidence, alignment, overlap and reading order."""
    h, v = allen(text.left, text.right, image.left, image.right), allen(text.top, text.bottom, image.top, image.bottom)
    share = overlap_share(text, image)
    cd = center_distance(text, image) / mean_side(text, image)
    total = relation_confidence(h, v, text, image) + alignment_score(text, image) * 0.2 + F.when((share > 0) & (share < 0.3), share * 0.1).otherwise(0.0) + reading_order(text, image) * 0.1
    return F.least(num(1), total * F.greatest(num(0.3), 1 - cd * 0.1)) * 0.3


# The compositions of Allen relations that are known.
COMPOSITIONS = {("precedes", "precedes"): "precedes", ("meets", "precedes"): "precedes", ("overlaps", "overlaps"): "overlaps", ("during", "contains"): "during", ("equals", "equals"): "equals"}


def compose(first: Column, second: Column) -> Column:
    """What follows from two relations, a to b and b to c; null where it isn't known."""
    return F.coalesce(*(F.when((first == a) & (second == b), c) for (a, b), c in COMPOSITIONS.items()))
