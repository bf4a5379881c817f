"""What stages with a model do around it: the model sees plain arrays or strings, everything else is done here.

An engine is what a run is given: for entities an object with ``extract(text, labels, threshold)`` (or a call of that
form) that returns spans (start, end, label, score); for detectors a call from an array of planes to its output. Images
are PNG unless the engine has ``decode(bytes)`` to RGBA.
"""

from __future__ import annotations

import json
import math

import numpy as np

from ..functions import geometry, placing
from ..functions.text import normalise_casing
from ..operators import images
from ..operators.entities import boxes_in_range, char_to_box
from .errors import DetectionError

#: Sides of the square input of a detector, and the longest side of a text detector's, where the engine names none.
DETECTOR_SIZE, TEXT_SIZE = 640, 960
# Means and deviations of the pictures that text detectors are trained on.
MEAN, DEVIATION = (0.485, 0.456, 0.406), (0.229, 0.224, 0.225)


def windows(text: str, length: int, stride: int):
    """(offset, text) of windows every ``stride`` characters, the last being the first that is short."""
    at = 0
    while at < len(text):
        yield at, text[at : at + length]
        if len(text) - at < length or len(text) <= length:
            return
        at += stride


def spans_of(engine, text: str, params: dict) -> list[dict]:
    """The engine's spans over all windows, in the text's offsets: the best of equal ones, by their starts."""
    find = getattr(engine, "extract", engine)
    best: dict[tuple[int, int, str], dict] = {}
    for offset, part in windows(text, params["chunkLength"], params["chunkStride"]):
        for s in find(part, list(params["labels"]), params["threshold"]):
            moved = {"start": s["start"] + offset, "end": s["end"] + offset, "label": s["label"], "score": float(s["score"])}
            key = (moved["start"], moved["end"], moved["label"])
            if key not in best or moved["score"] > best[key]["score"]:
                best[key] = moved
    return sorted(best.values(), key=lambda s: s["start"])


def named_entities(engine, value: dict, params: dict) -> dict:
    """An NER record of a document. Casing is mended without moving a character; words are those of the text itself."""
    document = value[params["inputCol"]]
    text, boxes = document.get("text") or "", document.get("bboxes") or []
    allowed, entities = set(params["whiteList"]), []
    if text.strip() and params["labels"]:
        found = [s for s in spans_of(engine, normalise_casing(text) if params["normaliseCasing"] else text, params) if not allowed or s["label"] in allowed]
        owner = char_to_box(text, [b["text"] for b in boxes]) if found else []
        for s in found:
            near = [boxes[i] for i in boxes_in_range(owner, s["start"], s["end"])]
            entities.append({"entity_group": s["label"], "score": s["score"], "word": text[s["start"] : s["end"]], "start": s["start"], "end": s["end"], "boxes": near, "source": "model"})
    return {"path": document.get("path") or "memory", "entities": entities, "exception": "", "json": json.dumps(entities, ensure_ascii=False)}


def pixels(engine, value: dict) -> np.ndarray:
    data = value["data"]
    if not data:
        raise DetectionError("no image")
    return engine.decode(data) if hasattr(engine, "decode") else images.decode_png(data)


def _on_paper(rgba: np.ndarray, width: int, height: int, left: int, top: int) -> np.ndarray:
    out = np.full((height, width, 4), 255, np.uint8)
    out[top : top + rgba.shape[0], left : left + rgba.shape[1]] = rgba
    return out


def _record(value: dict, params: dict, kind: str, boxes: list[dict]) -> dict:
    return {"path": (value[params["inputCol"]] or {}).get("path") or "memory", "type": kind, "bboxes": boxes, "exception": ""}


def detections(engine, value: dict, params: dict) -> dict:
    """Boxes of an object detector: the image centred in a square, its output decoded, moved back, padded, suppressed."""
    rgba, size = pixels(engine, value), getattr(engine, "size", DETECTOR_SIZE)
    height, width = rgba.shape[:2]
    scale, w, h, pad_x, pad_y = images.letterbox_size(width, height, size, True)
    left, top = math.trunc(pad_x), math.trunc(pad_y)
    output, dims = engine(images.planes(_on_paper(images.resize(rgba, w, h), size, size, left, top))[None])
    found = []
    for d in geometry.decode_detections(output, dims, params["scoreThreshold"]):
        d = geometry.unletterbox(d, scale, left, top)
        grow_x, grow_y = (d["x1"] - d["x0"]) * params["padding"], (d["y1"] - d["y0"]) * params["padding"]
        found.append({**d, "x0": max(0.0, d["x0"] - grow_x), "y0": max(0.0, d["y0"] - grow_y), "x1": min(float(width), d["x1"] + grow_x), "y1": min(float(height), d["y1"] + grow_y)})
    names = dict(enumerate(params["labels"]))
    kept = geometry.suppress(found, params["iouThreshold"])
    boxes = [{"text": names.get(d["class_id"], f"class_{d['class_id']}"), "score": d["score"], "x": d["x0"], "y": d["y0"], "width": d["x1"] - d["x0"], "height": d["y1"] - d["y0"], "angle": 0.0} for d in kept]
    return _record(value, params, params["outputType"], boxes)


def text_regions(engine, value: dict, params: dict) -> dict:
    """Boxes of a text detector: the image scaled to sides that are multiples of 32, quadrangles cut from its map."""
    rgba, longest = pixels(engine, value), getattr(engine, "size", TEXT_SIZE)
    height, width = rgba.shape[:2]
    scale = min(1.0, longest / max(width, height))
    w, h = max(1, round(width * scale)), max(1, round(height * scale))
    wide, tall = (longest, longest) if params["squareInput"] else (-(-w // 32) * 32, -(-h // 32) * 32)
    values = np.asarray(engine(images.planes(_on_paper(images.resize(rgba, w, h), wide, tall, 0, 0), MEAN, DEVIATION)[None]), float).reshape(tall, wide)
    quads = geometry.quads(values, width, height, scale, params["binaryThreshold"], params["scoreThreshold"], ratio=params["unclipRatio"])
    return _record(value, params, "dbnet", [geometry.box_from_polygon(q, "", float(s)) for q, s in quads])


def pack_sheets(sizes: list[tuple[float, float]], side: int, max_scale: float, gutter: int) -> list[list[dict]]:
    """Crops dealt on square sheets in shelves, the tallest first: item, scale, x, y, width and height of each.

    A crop is scaled to fit the sheet, up to ``max_scale``; a shelf is as tall as its first crop.
    """
    scaled = [(i, min(side / w, side / h, max_scale), w, h) for i, (w, h) in enumerate(sizes)]
    pieces = [{"item": i, "scale": s, "width": max(1, int(w * s)), "height": max(1, int(h * s))} for i, s, w, h in scaled]
    sheets: list[list[dict]] = []
    x, y, shelf = side + 1, side + 1, 0  # no sheet is open yet
    for p in sorted(pieces, key=lambda p: (-p["height"], -p["width"])):
        if x + p["width"] > side:
            x, y, shelf = 0, y + shelf + gutter, 0
        if not sheets or y + p["height"] > side:
            sheets.append([])
            x = y = shelf = 0
        sheets[-1].append({**p, "x": x, "y": y})
        x, shelf = x + p["width"] + gutter, max(shelf, p["height"])
    return sheets


def text_page(engine, content: bytes, page: int, p: dict) -> dict:
    """A page's document from its text runs: ``runs(content, page)`` and ``viewport(content, page, scale)`` are the engine's."""
    view = engine.viewport(content, page, p["resolution"] / placing.POINTS_PER_INCH)
    runs = [r for r in (placing.text_run(item, view) for item in engine.runs(content, page)) if r]
    boxes = [b for r in runs for b in (geometry.split_run(r) if p["splitWords"] else [r["box"]])]
    return {"path": "memory", "text": "\n".join(r["text"] for r in runs), "type": "pdf", "bboxes": boxes, "exception": ""}


def embedded_images(engine, content: bytes, page: int, p: dict, layer: list[dict]) -> list[dict]:
    """(image, placement) of the rasters that a page paints and its text layer doesn't cover already.

    The engine gives ``operators(content, page)``, ``viewport(content, page, scale)`` and ``raster(content, page, id)``,
    a dict of data, width, height and kind, or None where there is none. A raster that is painted often is asked for once.
    Where there are more than ``imageLimit``, the largest on the page stay, the largest first.
    """
    view = engine.viewport(content, page, p["resolution"] / placing.POINTS_PER_INCH)
    decoded: dict[str, dict | None] = {}
    found = []
    for paint in placing.paints(engine.operators(content, page), view):
        given = paint.data
        if given is None:
            if paint.id and paint.id not in decoded:
                decoded[paint.id] = engine.raster(content, page, paint.id)
            given = decoded.get(paint.id)
        if not given or min(given["width"], given["height"]) < 1 or given["width"] * given["height"] < p["minPixels"]:
            continue
        placed = placing.placement(paint, given["width"], given["height"], p["resolution"], p["minEffectiveResolution"])
        found.append((given, paint, placed))
    if 0 < p["imageLimit"] < len(found):
        found.sort(key=lambda f: -f[2]["box"]["width"] * f[2]["box"]["height"])
        found = found[: p["imageLimit"]]
    if p["minCoveringBoxes"] > 0 and layer:
        found = [f for f in found if placing.covering(layer, f[2]["box"]) < p["minCoveringBoxes"]]
    out = []
    for given, paint, placed in found:
        px = placing.cut(placing.raster(given["data"], given["width"], given["height"], given["kind"]), paint.part)
        scale = placed["scaleFactor"]
        if scale > 1:
            px = images.resize(px, *(max(1, geometry.js_round(n * scale)) for n in px.shape[1::-1]))
        record = {"path": "memory", "resolution": geometry.js_round(placed["effectiveResolution"] * scale), "data": images.encode_png(px), "imageType": "png", "exception": "", "height": px.shape[0], "width": px.shape[1]}
        out.append({"image": record, "placement": placed})
    return out
