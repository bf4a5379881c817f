"""Where a page shows its images and text runs, and the pixels of rasters; numpy alone, no reader is needed.

A page's operators are (name, arguments) pairs. An affine map is six numbers (a, b, c, d, e, f) outside, a 3 x 3 array
inside; the viewport's map takes the page's points to pixels.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np

from .geometry import box_from_polygon, corners, js_round

# Operators of a page by what they do to the state, and those that paint rasters. Stencil masks are not
# among them: they hold no picture.
SAVES = {"save", "beginGroup", "paintFormXObjectBegin", "beginAnnotation"}
RESTORES = {"restore", "endGroup", "paintFormXObjectEnd", "endAnnotation"}
PAINTS = {"paintImageXObject", "paintInlineImageXObject", "paintInlineImageXObjectGroup", "paintImageXObjectRepeat"}
# The part of a run's height above its base line, the score of text that a file states, and the kinds of raster.
ASCENT, STATED = 0.75, 0.99
GREY_1, RGB_24, RGBA_32 = 1, 2, 3
#: The angle in degrees below which a box counts as upright, and the most that an image is enlarged by.
UPRIGHT, MOST_UPSCALE = 3.0, 4.0
POINTS_PER_INCH = 72.0


def affine(numbers: Sequence[float]) -> np.ndarray:
    a, b, c, d, e, f = numbers
    return np.array([[a, c, e], [b, d, f], [0, 0, 1]], float)


def numbers_of(m: np.ndarray) -> list[float]:
    return [float(v) for v in m[:2].T.ravel()]


@dataclass(frozen=True)
class Paint:
    """One painting of a raster: its name or its own data, the unit square's map to the page, the part that is shown."""

    id: str
    unit: np.ndarray
    part: tuple[float, float, float, float] | None = None
    data: object = None


def _painted(name: str, args: Sequence) -> Iterator[tuple[str, np.ndarray, tuple | None, object]]:
    if name == "paintImageXObject":
        yield str(args[0]), np.eye(3), None, None
    elif name == "paintInlineImageXObject":
        yield "", np.eye(3), None, args[0]
    elif name == "paintInlineImageXObjectGroup":
        for entry in args[1] or ():
            if entry and entry.get("transform"):
                yield "", affine(entry["transform"]), (entry["x"], entry["y"], entry["w"], entry["h"]), args[0]
    else:
        key, wide, high, places = args
        for x, y in zip(places[0::2], places[1::2]):  # noqa: B905 (half a place at the end is none)
            yield str(key), affine((wide, 0, 0, high, x, y)), None, None


def paints(operators: Iterable[tuple[str, Sequence | None]], viewport: Sequence[float]) -> list[Paint]:
    """The rasters that a page paints, in order. Restoring more often than saving leaves the identity."""
    base, states, found = affine(viewport), [np.eye(3)], []
    for name, args in operators:
        args = args or ()
        if name in RESTORES:
            states = states[:-1] or [np.eye(3)]
        elif name == "transform":
            states[-1] = states[-1] @ affine(args)
        elif name in SAVES:
            # an annotation starts from the page's own state; its two maps, and a form's one, apply at once
            given = {"beginAnnotation": args[2:4], "paintFormXObjectBegin": args[:1]}.get(name, ())
            state = np.eye(3) if name == "beginAnnotation" else states[-1]
            for m in given:
                state = state if m is None else state @ affine(m)
            states.append(state)
        elif name in PAINTS:
            found += [Paint(key, base @ states[-1] @ local, part, data) for key, local, part, data in _painted(name, args)]
    return found


def box_around(points, text: str = "", score: float = 0.0) -> dict:
    """The box of four corners, upper left first and clockwise: upright if the upper edge is level, else turned."""
    p = np.asarray(points, float)
    edge = p[1] - p[0]
    slant = abs(math.degrees(math.atan2(edge[1], edge[0])))
    if min(slant, abs(slant - 180)) >= UPRIGHT:
        return box_from_polygon(p, text, score)
    low, high = p.min(axis=0), p.max(axis=0)
    x, y, w, h = (float(js_round(v)) for v in (*low, *(high - low)))
    return {"text": text, "score": float(score), "x": x, "y": y, "width": w, "height": h, "angle": 0.0}


def enlargement(resolution: float, least: float) -> float:
    """How much to enlarge an image to reach the least resolution; never less than 1 nor more than 4."""
    return min(MOST_UPSCALE, least / resolution) if 0 < resolution < least else 1.0


def placement(paint: Paint, width: int, height: int, resolution: float, least: float = 0.0) -> dict:
    """The record of a painted raster of so many pixels: the map of its pixels to the page's, its box, its resolution.

    Where a part is shown, that part is the image. The resolution is taken along the upper edge, so that turning changes nothing.
    """
    w, h = (max(1, v) for v in (paint.part[2:] if paint.part else (width, height)))
    matrix = paint.unit @ np.array([[1 / w, 0, 0], [0, -1 / h, 1], [0, 0, 1]])
    shown = (matrix @ np.array([[0, w, w, 0], [0, 0, h, h], [1, 1, 1, 1]]))[:2].T
    inches = math.hypot(*(shown[1] - shown[0])) / resolution
    dots = w / inches if inches > 0 else 0.0
    return {
        "id": paint.id, "width": float(w), "height": float(h), "box": box_around(shown), "matrix": numbers_of(matrix),
        "effectiveResolution": dots, "scaleFactor": enlargement(dots, least),
    }


def to_page(box: dict, placed: dict) -> dict:
    """A box of an image, in the pixels of the page that shows it; the image may have been enlarged before it was read."""
    scale = placed.get("scaleFactor") or 1.0
    at = {**box, "width": max(1.0, box["width"]), "height": max(1.0, box["height"])}
    lower_left, upper_left, upper_right, lower_right = corners(at) / scale
    points = np.stack([upper_left, upper_right, lower_right, lower_left])
    m = affine(placed["matrix"])
    return {**box, **box_around(points @ m[:2, :2].T + m[:2, 2], box["text"], box["score"])}


def covering(boxes: Iterable[dict], region: dict) -> int:
    """How many boxes have their middles in the region, its edges included."""
    mid = np.array([(b["x"] + b["width"] / 2, b["y"] + b["height"] / 2) for b in boxes], float).reshape(-1, 2)
    low = np.array([region["x"], region["y"]])
    return int(((mid >= low) & (mid <= low + [region["width"], region["height"]])).all(axis=1).sum())


def raster(data: bytes, width: int, height: int, kind: int) -> np.ndarray:
    """RGBA pixels of a raster: bits (set is white, rows start at bytes; missing ones are white), RGB, or RGBA over white."""
    given = np.frombuffer(bytes(data), np.uint8)
    out = np.full((height, width, 4), 255, np.uint8)
    if kind == GREY_1:
        row = (width + 7) // 8
        whole = np.concatenate([given[: row * height], np.full(max(0, row * height - len(given)), 255, np.uint8)])
        out[..., :3] = (np.unpackbits(whole.reshape(height, row), axis=1)[:, :width] * 255)[..., None]
    elif kind == RGB_24:
        out[..., :3] = given[: width * height * 3].reshape(height, width, 3)
    elif kind == RGBA_32:
        px = given[: width * height * 4].reshape(height, width, 4).astype(float)
        clear = 1 - px[..., 3:] / 255
        out[..., :3] = np.rint(px[..., :3] * (1 - clear) + 255 * clear)
    else:
        raise TypeError(f"unknown kind of raster {kind}")
    return out


def cut(px: np.ndarray, part: Sequence[float] | None) -> np.ndarray:
    """The shown part of a raster; what lies outside it is transparent."""
    if part is None:
        return px
    x, y, w, h = (int(v) for v in part)
    out = np.zeros((max(1, h), max(1, w), 4), np.uint8)
    top, left, low, right = max(0, y), max(0, x), min(px.shape[0], y + h), min(px.shape[1], x + w)
    if top < low and left < right:
        out[top - y : low - y, left - x : right - x] = px[top:low, left:right]
    return out


def text_run(item: dict, viewport: Sequence[float]) -> dict | None:
    """A text run in pixels: box, anchor at its upper left, vectors along its reading and its height. Empty text: none.

    item: str, transform (the six numbers of the text matrix), width, height, fontName.
    """
    if not item["str"]:
        return None
    m, view = affine([*item["transform"], 0, 0, 0, 0, 0, 0][:6]), affine(viewport)
    axes = m[:2, :2] / [math.hypot(*m[:2, k]) or 1.0 for k in (0, 1)]  # the size is in width and height already
    along, up = axes[:, 0] * item["width"], axes[:, 1] * item["height"]
    start = m[:2, 2] + up * ASCENT
    upper_left, upper_right, lower_left, lower_right = (view[:2, :2] @ p + view[:2, 2] for p in (start, start + along, start - up, start + along - up))
    box = box_from_polygon([upper_left, upper_right, lower_left, lower_right], item["str"], STATED)
    return {
        "text": item["str"], "score": STATED, "box": box, "anchor": upper_left.tolist(), "reading": (upper_right - upper_left).tolist(),
        "height": (lower_left - upper_left).tolist(), "fontName": item.get("fontName") or "",
    }


# Parts of font names, by what they say.
FONT_WEIGHTS, FONT_STYLES = ("bold", "black", "heavy", "semibold"), ("italic", "oblique")
FONT_FAMILIES = {"serif": ("serif", "times", "georgia", "garamond", "roman"), "monospace": ("mono", "courier", "consol")}


def css_font(name: str, size: float) -> str:
    """A CSS font for a PDF font's name, which a subset's six letters may precede."""
    lower = re.sub(r"^[A-Z]{6}\+", "", name).lower()
    says = lambda parts: any(p in lower for p in parts)
    family = next((f for f, parts in FONT_FAMILIES.items() if says(parts)), "sans-serif")
    return f"{'italic' if says(FONT_STYLES) else 'normal'} {'bold' if says(FONT_WEIGHTS) else 'normal'} {max(1, js_round(size))}px {family}"
