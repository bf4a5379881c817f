"""Images and text runs on a page, words of a line's picture, sheets; stages with a reader that knows its pages."""

import math
import sys

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark import cloudpickle

from pagewright.functions import ink, placing
from pagewright.operators import images
from pagewright.plans import registry
from pagewright.plans.errors import NO_EMBEDDED_IMAGES, ConfigError
from pagewright.plans.stage import Run

SAME = (1, 0, 0, 1, 0, 0)


def units(operators, view=SAME):
    return [(p.id, placing.numbers_of(p.unit)) for p in placing.paints(operators, view)]


def test_state_of_the_operators():
    draw = ("paintImageXObject", ["i"])
    assert units([("transform", [2, 0, 0, 2, 5, 6]), draw]) == [("i", [2, 0, 0, 2, 5, 6])]
    assert units([("save", None), ("transform", [2, 0, 0, 2, 0, 0]), ("restore", None), draw, ("restore", None), draw]) == [("i", list(SAME))] * 2
    assert units([("transform", [2, 0, 0, 2, 0, 0]), ("transform", [1, 0, 0, 1, 3, 4]), draw]) == [("i", [2, 0, 0, 2, 6, 8])]
    assert units([("paintFormXObjectBegin", [[3, 0, 0, 3, 1, 1], None]), draw, ("paintFormXObjectEnd", None), draw]) == [("i", [3, 0, 0, 3, 1, 1]), ("i", list(SAME))]
    assert units([("beginGroup", [{"matrix": [9, 0, 0, 9, 0, 0]}]), draw, ("endGroup", None)]) == [("i", list(SAME))]
    note = ("beginAnnotation", ["a", None, [1, 0, 0, 1, 7, 8], [2, 0, 0, 2, 0, 0]])
    assert units([("transform", [5, 0, 0, 5, 0, 0]), note, draw, ("endAnnotation", None), draw]) == [("i", [2, 0, 0, 2, 7, 8]), ("i", [5, 0, 0, 5, 0, 0])]
    assert units([("paintImageMaskXObject", ["m"]), ("showText", [])]) == []
    assert units([("paintImageXObjectRepeat", ["t", 4, 5, [1, 2, 3, 4]])], (1, 0, 0, -1, 0, 100)) == [("t", [4, 0, 0, -5, 1, 98]), ("t", [4, 0, 0, -5, 3, 96])]


def test_parts_of_inline_images():
    group = ("paintInlineImageXObjectGroup", ["sheet", [{"transform": [1, 0, 0, 1, 2, 3], "x": 4, "y": 5, "w": 6, "h": 7}, {}]])
    (p,) = placing.paints([group], SAME)
    assert (p.id, p.part, p.data) == ("", (4, 5, 6, 7), "sheet") and placing.numbers_of(p.unit) == [1, 0, 0, 1, 2, 3]
    placed = placing.placement(p, 100, 100, 72)
    assert (placed["width"], placed["height"]) == (6, 7)


def test_placement_of_upright_and_turned_images():
    (p,) = placing.paints([("transform", [144, 0, 0, 72, 10, 20]), ("paintImageXObject", ["i"])], (1, 0, 0, -1, 0, 200))
    placed = placing.placement(p, 288, 144, 72, 300)
    assert placed["box"] == {"text": "", "score": 0.0, "x": 10.0, "y": 108.0, "width": 144.0, "height": 72.0, "angle": 0.0}
    assert (placed["effectiveResolution"], placed["scaleFactor"]) == (pytest.approx(144.0), pytest.approx(300 / 144))
    word = {"text": "w", "score": 0.5, "x": 20.0, "y": 40.0, "width": 40.0, "height": 10.0, "angle": 0.0}
    assert placing.to_page(word, {**placed, "scaleFactor": 2.0}) == {**word, "x": 15.0, "y": 118.0, "width": 10.0, "height": 3.0}
    c, s = math.cos(0.5), math.sin(0.5)
    (p,) = placing.paints([("transform", [100 * c, 100 * s, -50 * s, 50 * c, 0, 0]), ("paintImageXObject", ["i"])], (1, 0, 0, -1, 0, 500))
    placed = placing.placement(p, 200, 100, 72)
    assert (placed["box"]["width"], placed["box"]["height"]) == (100, 50) and abs(placed["box"]["angle"]) == pytest.approx(math.degrees(0.5), abs=0.1)
    assert placed["effectiveResolution"] == pytest.approx(144)
    assert placing.enlargement(0, 150) == 1 and placing.enlargement(10, 150) == 4 and placing.enlargement(200, 150) == 1


def test_rasters():
    bits = placing.raster(bytes([0b10100000, 0xFF, 0b01000000]), 9, 2, placing.GREY_1)
    assert bits[0, :, 0].tolist() == [255, 0, 255, 0, 0, 0, 0, 0, 255] and bits[1, :3, 0].tolist() == [0, 255, 0] and bits[1, 8, 0] == 255
    assert placing.raster(bytes([1, 2, 3, 4, 5, 6]), 2, 1, placing.RGB_24).tolist() == [[[1, 2, 3, 255], [4, 5, 6, 255]]]
    assert placing.raster(bytes([10, 20, 30, 255, 0, 0, 0, 0]), 2, 1, placing.RGBA_32).tolist() == [[[10, 20, 30, 255], [255, 255, 255, 255]]]
    with pytest.raises(TypeError):
        placing.raster(b"", 1, 1, 9)


def test_text_runs():
    run = placing.text_run({"str": "ab cd", "transform": [12, 0, 0, 12, 100, 700], "width": 60, "height": 12}, (2, 0, 0, -2, 0, 1600))
    assert run["box"] == {"text": "ab cd", "score": 0.99, "x": 200.0, "y": 182.0, "width": 120.0, "height": 24.0, "angle": 0.0}
    assert run["anchor"] == [200, 182] and run["reading"] == [120, 0] and run["height"] == [0, 24]
    assert placing.text_run({"str": "", "transform": SAME, "width": 1, "height": 1}, SAME) is None
    assert placing.css_font("ABCDEF+Times-BoldItalic", 11.5) == "italic bold 12px serif" and placing.css_font("CourierNew", 0.2) == "normal normal 1px monospace"
    assert placing.css_font("Helvetica-Oblique", 9) == "italic normal 9px sans-serif"


def line(*words, height=20, width=100):
    px = np.full((height, width, 4), 255, np.uint8)
    for x0, x1, y0, y1 in words:
        px[y0:y1, x0:x1, :3] = 0
    return px


def test_words_of_a_line():
    words = [(5, 20, 4, 16), (30, 50, 2, 18), (52, 60, 4, 12)]
    assert ink.word_spans(line(*words), 0.15) == [(5, 20, 4, 16), (30, 60, 2, 18)]
    assert ink.word_spans(line(*words), 0.1) == words
    whole = [(0, 100, 0, 20)]
    assert ink.word_spans(line(), 0.15) == whole and ink.word_spans(line((5, 6, 3, 4)), 0.15) == whole
    clear = line(*words)
    clear[:, 60:] = 0  # transparent black is paper
    assert ink.word_spans(clear, 0.15) == [(5, 20, 4, 16), (30, 60, 2, 18)]


def merged(spans, n):
    """Spans joined one pair at a time, the pair with the smallest gap first."""
    spans = list(spans)
    while len(spans) > n:
        i = min(range(len(spans) - 1), key=lambda i: (spans[i + 1][0] - spans[i][1], i))
        a, b = spans[i : i + 2]
        spans[i : i + 2] = [(a[0], b[1], min(a[2], b[2]), max(a[3], b[3]))]
    return spans


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 9), st.integers(1, 9), st.integers(0, 4)), min_size=1, max_size=8), st.lists(st.text("ab", min_size=1, max_size=6), min_size=1, max_size=9))
def test_alignment(shapes, words):
    spans, x = [], 0
    for gap, width, y in shapes:
        spans.append((x + gap, x + gap + width, y, y + 5))
        x += gap + width
    made = ink.align_spans(words, spans)
    assert " ".join(t for _, t in made) == " ".join(words)  # each word once, in order
    places = merged(spans, min(len(words), len(spans)))
    assert [p for p, _ in made] == places and all(t for _, t in made)
    if len(words) <= len(spans):
        assert [t for _, t in made] == words


def test_shares_of_ink():
    assert [t for _, t in ink.align_spans(["aa", "bb", "cc", "dd"], [(0, 30, 0, 5), (40, 50, 0, 5)])] == ["aa bb cc", "dd"]
    assert ink.align_spans([], [(0, 1, 0, 1)]) == [] and ink.align_spans(["a"], []) == []


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 400), st.integers(1, 400)), max_size=20), st.sampled_from([0, 4, 16]))
def test_sheets(sizes, gutter):
    sheets = ink.pack_sheets(sizes, 128, 2, gutter)
    assert sorted(p["item"] for s in sheets for p in s) == list(range(len(sizes)))
    for sheet in sheets:
        assert sheet and all(p["x"] >= 0 and p["y"] >= 0 and p["x"] + p["width"] <= 128 and p["y"] + p["height"] <= 128 for p in sheet)
        for i, a in enumerate(sheet):
            for b in sheet[:i]:
                apart = (a["x"] >= b["x"] + b["width"] + gutter, b["x"] >= a["x"] + a["width"] + gutter, a["y"] >= b["y"] + b["height"] + gutter, b["y"] >= a["y"] + a["height"] + gutter)
                assert any(apart)


class Pages:
    """A file of three pages: two paintings of one raster and a small one, none, and one that can't be read."""

    def count(self, content):
        return 3

    def viewport(self, content, page, scale):
        return [scale, 0, 0, -scale, 0, 800 * scale]

    def operators(self, content, page):
        if page == 2:
            raise ValueError("torn")
        at = lambda x, size, key: [("save", None), ("transform", [size, 0, 0, size, x, 100]), ("paintImageXObject", [key]), ("restore", None)]
        return at(0, 72, "a") + at(200, 144, "a") + at(400, 72, "small") + at(500, 72, "gone") if page == 0 else []

    def raster(self, content, page, key):
        side = {"a": 100, "small": 10}.get(key)
        return side and {"data": bytes(side * side * 3), "width": side, "height": side, "kind": placing.RGB_24}

    def runs(self, content, page):
        return [{"str": "two words", "transform": [10, 0, 0, 10, 72, 700], "width": 90, "height": 10}, {"str": "", "transform": [1, 0, 0, 1, 0, 0], "width": 0, "height": 0}]


def test_stages_with_a_reader(spark):
    cloudpickle.register_pickle_by_value(sys.modules[Pages.__module__])
    rows = spark.createDataFrame([(b"x", "p", 5)], "content binary, path string, __made int")
    run = Run(engines={"pdf-images": Pages(), "pdf-text": Pages()})
    made = registry.PdfEmbeddedImages(resolution=72).run(rows, run).collect()
    shown = [(r.page, r.image.width, r.image.resolution, r.placement and r.placement.box.x, r.image.path, r["__made"]) for r in made]
    # 100 pixels on 1 and on 2 inches, enlarged to 150 dots an inch
    assert sorted(shown, key=str) == sorted([(0, 150, 150, 0.0, "p", 5), (0, 300, 150, 200.0, "p", 5), (1, 0, 72, None, "p", 5), (2, 0, 72, None, "p", 5)], key=str)
    assert {r.page: r.image.exception for r in made if r.image.exception} == {1: NO_EMBEDDED_IMAGES, 2: "PdfEmbeddedImages: ValueError: torn"}
    assert images.decode_png(bytes(made[0].image.data)).shape == (made[0].image.height, made[0].image.width, 4)
    largest = registry.PdfEmbeddedImages(resolution=72, imageLimit=1, returnEmpty=False, pageLimit=2).run(rows, run).collect()
    assert [(r.page, r.placement.box.x) for r in largest] == [(0, 200.0)]
    every = registry.PdfEmbeddedImages(resolution=72, minPixels=1, pageLimit=1, minEffectiveResolution=0).run(rows, run).collect()
    assert sorted(r.placement.scaleFactor for r in every) == [1.0] * 3
    with pytest.raises(ConfigError):
        registry.PdfEmbeddedImages(imageType="webp")
    read = registry.PdfToDocument(resolution=72).run(rows, run).orderBy("page").collect()
    assert [(r.document.text, [b.text for b in r.document.bboxes]) for r in read] == [("two words", ["two", "words"])] * 3
    whole = registry.PdfToDocument(resolution=72, splitWords=False, pageLimit=1).run(rows, run).first().document
    assert [(b.text, b.x, b.y, b.width, b.height) for b in whole.bboxes] == [("two words", 72.0, 93.0, 90.0, 10.0)]


def test_images_that_the_text_layer_covers(spark):
    from pyspark.sql import functions as F

    from pagewright.schemas import box, document

    cloudpickle.register_pickle_by_value(sys.modules[Pages.__module__])
    over = F.array(*[box(str(i), 0.9, 210.0 + i, 600.0 + i, 8.0, 4.0, 0.0) for i in range(8)])
    rows = spark.createDataFrame([(b"x",)], "content binary").withColumn("document", document(bboxes=over))
    run = Run(engines={"pdf-images": Pages()})
    found = lambda **o: sorted(r.placement.box.x for r in registry.PdfEmbeddedImages(resolution=72, pageLimit=1, **o).run(rows, run).collect())
    assert found() == [0.0] and found(minCoveringBoxes=9) == [0.0, 200.0] and found(minCoveringBoxes=0) == [0.0, 200.0]
