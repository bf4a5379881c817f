"""Box algebra as column expressions. A box argument is any struct column with x, y, width, height (and angle)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Degrees from which a box counts as rotated.
ROTATED_FROM = 3.0


def js_round(x: Column) -> Column:
    """Rounds halves upwards, for negative numbers too."""
    return F.floor(x + 0.5).cast("double")


def trunc(x: Column) -> Column:
    return x.cast("long")


def bbox(b: Column, padding=0.0) -> Column:
    p = F.lit(padding) if not isinstance(padding, Column) else padding
    return F.struct((b["x"] - p).alias("x0"), (b["y"] - p).alias("y0"), (b["x"] + b["width"] + p).alias("x1"), (b["y"] + b["height"] + p).alias("y1"))


def shape(b: Column, padding=0.0) -> Column:
    r = bbox(b, padding)
    return F.array(F.array(r["x0"], r["y0"]), F.array(r["x1"], r["y1"]))


def is_rotated(b: Column) -> Column:
    return F.abs(b["angle"]) >= ROTATED_FROM


def from_bbox(x0: Column, y0: Column, x1: Column, y1: Column, text=None, score=None, angle=None) -> Column:
    from ..schemas import box

    return box(text, score, js_round(x0), js_round(y0), js_round(x1 - x0), js_round(y1 - y0), angle)


def scale(b: Column, factor, padding=0.0) -> Column:
    """Scaled and rounded; the padding moves the origin out and the size grows by it once."""
    from ..schemas import box

    return box(b["text"], b["score"], js_round(b["x"] * factor - padding), js_round(b["y"] * factor - padding), js_round(b["width"] * factor + padding), js_round(b["height"] * factor + padding), b["angle"])


def overlap_width(a: Column, b: Column) -> Column:
    return F.least(a["x"] + a["width"], b["x"] + b["width"]) - F.greatest(a["x"], b["x"])


def overlap_height(a: Column, b: Column) -> Column:
    return F.least(a["y"] + a["height"], b["y"] + b["height"]) - F.greatest(a["y"], b["y"])


def iou(a: Column, b: Column) -> Column:
    """Intersection over union of the upright boxes; 0 where they only touch."""
    w, h = overlap_width(a, b), overlap_height(a, b)
    union = a["width"] * a["height"] + b["width"] * b["height"] - w * h
    return F.when((w <= 0) | (h <= 0) | (union <= 0), 0.0).otherwise(w * h / F.nullif(union, F.lit(0.0)))


def coverage(inner: Column, outer: Column) -> Column:
    """The share of ``inner`` that lies in ``outer``."""
    w, h, area = overlap_width(inner, outer), overlap_height(inner, outer), inner["width"] * inner["height"]
    return F.when((w <= 0) | (h <= 0) | (area <= 0), 0.0).otherwise(w * h / F.nullif(area, F.lit(0.0)))


def same_line(a: Column, b: Column, angle_limit: float = 10.0, line_limit: float = 0.5) -> Column:
    """Centres are near one another across the writing direction; by the box's own direction once it leans enough."""
    height = (a["height"] + b["height"]) / 2
    dx = (b["x"] + b["width"] / 2) - (a["x"] + a["width"] / 2)
    dy = (b["y"] + b["height"] / 2) - (a["y"] + a["height"] / 2)
    lean = F.radians(a["angle"])
    across = F.when(F.abs(a["angle"]) < angle_limit, F.abs(dy)).otherwise(F.abs(dy * F.cos(lean) - dx * F.sin(lean)))
    return (F.abs(a["angle"] - b["angle"]) <= angle_limit) & (height > 0) & (across < height * line_limit)


def merge_upright(a: Column, b: Column) -> Column:
    """The box around two upright boxes: texts joined, the smaller score."""
    from ..schemas import box

    x, y = F.least(a["x"], b["x"]), F.least(a["y"], b["y"])
    right, bottom = F.greatest(a["x"] + a["width"], b["x"] + b["width"]), F.greatest(a["y"] + a["height"], b["y"] + b["height"])
    return box(F.trim(F.concat(a["text"], F.lit(" "), b["text"])), F.least(a["score"], b["score"]), x, y, right - x, bottom - y, 0.0)


def identity(b: Column) -> Column:
    """A box's text and rounded place: equal for readings of the same word."""
    return F.concat_ws("|", b["text"], *[js_round(b[c]).cast("long").cast("string") for c in ("x", "y", "width", "height")])


def label(b: Column, fields: list[str]) -> Column:
    """Fields joined by ':'; numbers with two decimals, nulls left out."""
    return F.concat_ws(":", *[b[f].cast("string") if f in ("text", "entity_group", "word", "source") else F.when(b[f].isNotNull(), F.format_string("%.2f", b[f].cast("double"))) for f in fields])


def overlay(b: Column, colour: str = "#ff2d55", line_width: int = 2) -> Column:
    """An SVG rectangle for a box, turned about its centre."""
    number = lambda c: F.regexp_replace(c.cast("decimal(20,3)").cast("string"), r"\.?0+$", "")
    turn = F.when(b["angle"] != 0, F.concat(F.lit(' transform="rotate('), number(b["angle"]), F.lit(" "), number(b["x"] + b["width"] / 2), F.lit(" "), number(b["y"] + b["height"] / 2), F.lit(')"'))).otherwise("")
    sides = F.concat(F.lit('<rect x="'), number(b["x"]), F.lit('" y="'), number(b["y"]), F.lit('" width="'), number(F.greatest(b["width"], F.lit(1.0))), F.lit('" height="'), number(F.greatest(b["height"], F.lit(1.0))))
    return F.concat(sides, F.lit(f'" fill="none" stroke="{colour}" stroke-width="{line_width}"'), turn, F.lit("/>"))


def centre_inside(b: Column, region: Column) -> Column:
    cx, cy = b["x"] + b["width"] / 2, b["y"] + b["height"] / 2
    return (cx >= region["x"]) & (cx <= region["x"] + region["width"]) & (cy >= region["y"]) & (cy <= region["y"] + region["height"])


def covering(bboxes: Column, region: Column) -> Column:
    """How many boxes have their centre in the region."""
    return F.size(F.filter(bboxes, lambda b: centre_inside(b, region)))


def drop_covered(losers: Column, winners: Column, threshold: float = 0.5) -> Column:
    """Losers of which no single winner covers the share."""
    return F.filter(losers, lambda b: ~F.exists(winners, lambda w: coverage(b, w) >= threshold))


def drop_nested(bboxes: Column, threshold: float = 0.6) -> Column:
    """Without the boxes that a larger upright one (or an equal, earlier one) covers enough. Rotated boxes stay."""
    numbered = F.transform(bboxes, lambda b, i: F.struct(b.alias("b"), i.alias("i")))

    def larger(other: Column, own: Column) -> Column:
        a, b = other["b"]["width"] * other["b"]["height"], own["b"]["width"] * own["b"]["height"]
        return (a > b) | ((a == b) & (other["i"] < own["i"]))

    kept = F.filter(numbered, lambda own: is_rotated(own["b"]) | ~F.exists(numbered, lambda o: ~is_rotated(o["b"]) & larger(o, own) & (coverage(own["b"], o["b"]) >= threshold)))
    return F.transform(kept, lambda k: k["b"])


def extend_along(bboxes: Column, ratio: float = 0.3) -> Column:
    """Boxes grown at both ends by a share of their height; upright ones at most up to the next upright box on their line.

    Boxes share a line if they overlap by half the lower height. A neighbour lies left if its centre does; one that
    overlaps leaves no room on its side. Rotated boxes grow freely.
    """
    from ..schemas import box

    numbered = F.transform(bboxes, lambda b, i: F.struct(b.alias("b"), i.alias("i")))
    centre = lambda b: b["x"] + b["width"] / 2

    def grown(own: Column) -> Column:
        b, reach = own["b"], F.greatest(own["b"]["height"] * ratio, F.lit(0.0))
        near = F.filter(numbered, lambda o: (o["i"] != own["i"]) & ~is_rotated(o["b"]) & (overlap_height(o["b"], b) >= F.least(o["b"]["height"], b["height"]) / 2))
        left = F.array_min(F.transform(F.filter(near, lambda o: centre(o["b"]) < centre(b)), lambda o: F.greatest(b["x"] - o["b"]["x"] - o["b"]["width"], F.lit(0.0))))
        right = F.array_min(F.transform(F.filter(near, lambda o: centre(o["b"]) >= centre(b)), lambda o: F.greatest(o["b"]["x"] - b["x"] - b["width"], F.lit(0.0))))
        before = F.when(is_rotated(b), reach).otherwise(F.least(reach, F.coalesce(left, reach)))
        after = F.when(is_rotated(b), reach).otherwise(F.least(reach, F.coalesce(right, reach)))
        return box(b["text"], b["score"], b["x"] - before, b["y"], b["width"] + before + after, b["height"], b["angle"])

    return F.transform(numbered, grown)


def text_of(bboxes: Column, separator: str = " ") -> Column:
    return F.array_join(F.transform(bboxes, lambda b: b["text"]), separator)


def above_score(bboxes: Column, threshold: float) -> Column:
    return F.filter(bboxes, lambda b: b["score"] >= threshold)


def non_maximum_suppression(found: Column, threshold: float) -> Column:
    """Best first; one goes if a kept one of its class overlaps it by more. found: array of x0, y0, x1, y1, score, class_id, label."""
    from ..schemas import DETECTED

    def overlap(a: Column, b: Column) -> Column:
        w = F.greatest(F.least(a["x1"], b["x1"]) - F.greatest(a["x0"], b["x0"]), F.lit(0.0))
        h = F.greatest(F.least(a["y1"], b["y1"]) - F.greatest(a["y0"], b["y0"]), F.lit(0.0))
        union = (a["x1"] - a["x0"]) * (a["y1"] - a["y0"]) + (b["x1"] - b["x0"]) * (b["y1"] - b["y0"]) - w * h
        return F.when(union <= 0, 0.0).otherwise(w * h / F.nullif(union, F.lit(0.0)))

    ranked = F.transform(F.array_sort(F.transform(found, lambda d, i: F.struct((-d["score"]).alias("s"), i.alias("i"), d.alias("d")))), lambda r: r["d"])
    step = lambda kept, d: F.when(F.exists(kept, lambda k: (k["class_id"] == d["class_id"]) & (overlap(k, d) > threshold)), kept).otherwise(F.concat(kept, F.array(d)))
    return F.aggregate(ranked.cast(f"array<{DETECTED}>"), F.array().cast(f"array<{DETECTED}>"), step)


def merge_overlapping(bboxes: Column, iou_limit: float = 0.3, angle_limit: float = 10.0, line_limit: float = 0.5) -> Column:
    """One pass over upright boxes: each joins the first group that it overlaps on its line, as that group has grown."""
    from ..schemas import BOXES

    typed = bboxes.cast(BOXES)

    def take(state: Column, seed: Column) -> Column:
        # the seed absorbs, in order, what it overlaps; the rest waits for its turn
        first = F.struct(seed.alias("now"), F.array().cast(BOXES).alias("rest"))
        left = F.slice(state["rest"], 2, F.greatest(F.size(state["rest"]) - 1, F.lit(0)))

        def absorb(acc: Column, b: Column) -> Column:
            joins = (iou(acc["now"], b) > iou_limit) & same_line(acc["now"], b, angle_limit, line_limit)
            return F.struct(F.when(joins, merge_upright(acc["now"], b)).otherwise(acc["now"]).alias("now"), F.when(joins, acc["rest"]).otherwise(F.concat(acc["rest"], F.array(b))).alias("rest"))

        done = F.aggregate(left, first, absorb)
        return F.struct(F.concat(state["out"], F.array(done["now"])).alias("out"), done["rest"].alias("rest"))

    start = F.struct(F.array().cast(BOXES).alias("out"), typed.alias("rest"))
    walk = lambda state, _: F.when(F.size(state["rest"]) > 0, take(state, F.get(state["rest"], 0))).otherwise(state)
    return F.aggregate(typed, start, walk)["out"]
