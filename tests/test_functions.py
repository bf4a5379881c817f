import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import Row
from pyspark.sql import functions as F

from pagewright.functions import geometry, text, validators
from pagewright.functions.conditions import compile_condition, usable_text_layer, validate
from pagewright.operators import entities, images, layout, merging


def box(text="", x=0, y=0, width=40, height=10, score=1.0, angle=0.0):
    return {"text": text, "score": float(score), "x": float(x), "y": float(y), "width": float(width), "height": float(height), "angle": float(angle)}


def test_validators(spark):
    values = {"luhn": ["4111111111111111", "4111111111111112", "1", "x", None], "iban": ["GB29NWBK60161331926819", "DE89370400440532013000", "GB29NWBK6016133192681", "zz", None], "pesel": ["44051401359", "44051401358", "", None, "1"], "ssn": ["123456789", "000123456", "666123456", "900123456", None]}
    for name, given_ in values.items():
        made = [r.ok for r in spark.createDataFrame([(v,) for v in given_], "s string").select(getattr(validators, name)(F.col("s")).alias("ok")).collect()]
        assert made == [v is not None and getattr(validators, f"{name}_text")(v) for v in given_], name
        assert made[0] is True
    dates = [(2024, 2, 29), (2023, 2, 29), (2024, 13, 1), (2024, 0, 1), (2024, 4, 31), (2024, 4, 30)]
    made = [r.ok for r in spark.createDataFrame(dates, "y int, m int, d int").select(validators.date(F.col("y"), F.col("m"), F.col("d")).alias("ok")).collect()]
    assert made == [validators.date_text(*d) for d in dates] == [True, False, False, False, False, True]


ROW = Row(document=Row(exception="", bboxes=[Row(text="a"), Row(text="b")], text="a b"), page=3, flag=False, tags=["x", "y"])


@pytest.mark.parametrize(
    ("condition", "variables", "expected"),
    [
        ({"path": "page", "gte": 3, "lt": 4}, {}, True), ({"path": "page", "gte": 3, "lt": 3}, {}, False), ({"path": "page", "in": [1, 3]}, {}, True),
        ({"path": "flag", "eq": False}, {}, True), ({"path": "flag", "truthy": True}, {}, False), ({"path": "tags.length", "eq": 2}, {}, True),
        ({"path": "document.bboxes.1.text", "eq": "b"}, {}, True), ({"path": "missing", "ne": 1}, {}, False), ({"path": "missing", "exists": False}, {}, True),
        ({"path": "missing", "exists": False, "ne": 1}, {}, False), ({"path": "page", "exists": False}, {}, False), ({"path": "page", "eq": "3"}, {}, False), ({"path": "page", "ne": "3"}, {}, True),
        ({"all": [{"path": "page", "eq": 3}, {"path": "flag", "eq": False}]}, {}, True), ({"any": [{"path": "page", "eq": 9}, {"path": "flag", "eq": False}]}, {}, True),
        ({"not": {"path": "page", "eq": 3}}, {}, False), ({"var": "forced", "truthy": True}, {"forced": True}, True), ({"var": "forced", "truthy": True}, {}, False),
        (usable_text_layer(), {}, True), (usable_text_layer("document", 3), {}, False),
    ],
)
def test_conditions(spark, condition, variables, expected):
    df = spark.createDataFrame([ROW])
    assert df.select(compile_condition(validate(condition), df.schema, variables).alias("ok")).first().ok is expected


@pytest.mark.parametrize("bad", [[], {"all": []}, {"path": "a"}, {"path": "a", "var": "b", "eq": 1}, {"path": "a", "gt": "1"}, {"path": "a", "exists": 1}, {"path": "a", "in": 3}, {"path": "a", "eq": 1, "x": 2}, {"any": [{"path": "a"}]}])
def test_conditions_refused(bad):
    with pytest.raises(TypeError):
        validate(bad)


@pytest.mark.parametrize("n", [0, 1, 499, 500, 501, 980, 981, 1460])
def test_chunks(spark, n):
    body = "".join(chr(97 + i % 26) for i in range(n))
    got = [(c.offset, c.text) for c in spark.createDataFrame([(body,)], "t string").select(text.chunks(F.col("t")).alias("c")).first().c]
    want = []
    for o in range(0, n, 480):
        want.append((o, body[o : o + 500]))
        if len(want[-1][1]) < 500 or (o == 0 and n <= 500):
            break
    assert got == want


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 40).map(float), max_size=20))
def test_typical_size(values):
    ordered = sorted(values)
    n = len(ordered)
    if n > 4:
        middle = ordered[n // 4 : n - n // 4]
        assert layout.typical(values) == int(max(sorted(set(middle)), key=middle.count))
    elif n > 1:
        assert layout.typical(values) == int(sum(ordered) / n)
    else:
        assert layout.typical(values) == (ordered[0] if ordered else 0)


def test_formatted_text():
    boxes = [box("b", 60, 0, 10, 10), box("a", 0, 1, 10, 10), box("c", 20, 60, 10, 10)]
    assert layout.formatted(boxes) == " a     b\n\n\n  c" or layout.formatted(boxes).splitlines()[0].split() == ["a", "b"]
    assert layout.formatted([]) == ""


def test_fold_and_places():
    assert text.fold_with_offsets("  Ab\n\tC ") == ("ab c", [2, 3, 4, 6])
    assert text.whole_word_places("ann anna ann", "ann") == [0, 9]
    assert text.texts_agree("Invoce", "the Invoice no") and not text.texts_agree("total", "amount") and text.texts_agree("", "x")
    assert text.normalise_casing("JOHN SMITH") == "John Smith" and text.normalise_casing("John Smith") == "John Smith"


def test_char_to_box_claims_in_order():
    assert entities.char_to_box("a b a", ["a", "b", "a"]) == [0, -1, 1, -1, 2]
    assert entities.char_to_box("a b a", ["b", "a", "a"]) == [2, -1, 0, -1, 1]
    assert entities.boxes_in_range([0, 0, -1, 1], -5, 99) == [0, 1]


def test_propagation():
    found = [{"entity_group": "PERSON", "score": 0.9, "word": "John", "start": 0, "end": 4, "boxes": [], "source": None}]
    out = entities.propagate("John met Johnny, john.", [], [("john", [("PERSON", 0.8)])], found)
    assert [(e["start"], e["end"], e["source"], e["score"]) for e in out] == [(0, 4, "model", 0.9), (17, 21, "propagated", 0.8)]
    long_first = entities.propagate("John Smith", [], [("john", [("A", 1.0)]), ("john smith", [("B", 1.0)])], [])
    assert [(e["word"], e["entity_group"]) for e in long_first] == [("John Smith", "B")]
    assert entities.propagate("", [], [("x", [("A", 1.0)])], found) == []


def test_rebase_entities():
    boxes = [box("John", 0), box("Smith", 50)]
    moved = entities.rebase_entities([{"word": "John", "start": 7, "end": 11, "boxes": [boxes[0]]}, {"word": "Smith", "start": 0, "end": 5, "boxes": []}, {"word": "zzz", "start": 1, "end": 4, "boxes": []}], "Hi John Smith", boxes)
    assert [(e["start"], e["end"]) for e in moved] == [(3, 7), (8, 13), (1, 4)]


def test_merging():
    layer, read = [box("Hello world", 0, 0, 100, 10)], [box("Hello", 0, 0, 45, 10), box("new", 0, 50, 30, 10)]
    assert [b["text"] for b in merging.merge_sets(layer, read)] == ["Hello world", "new"]
    assert [b["text"] for b in merging.merge_sets(layer, read, "union")] == ["Hello world", "Hello", "new"]
    assert [b["text"] for b in merging.merge_sets([box("Hello", 1, 0, 40, 10)], [box("Hello", 0, 0, 45, 10)], "ocr-wins")] == ["Hello"]
    assert [b["text"] for b in merging.join_fragments([box("la", 40, 0, 10, 10), box("Al", 0, 0, 40, 10), box("far", 90, 0, 30, 10)])] == ["Alla", "far"]
    failed = {"path": "p", "text": "", "type": "pdf", "bboxes": [], "exception": "broken"}
    assert merging.fold_page(failed, [])["exception"] == "broken"
    good = {**failed, "exception": "", "bboxes": layer}
    assert merging.fold_page(good, [(failed, None)])["exception"] == "" and merging.fold_page({**good, "bboxes": []}, [(failed, None)])["exception"] == "broken"


@pytest.mark.parametrize("angle", range(0, 180, 15))
def test_boxes_from_polygons(angle):
    b = geometry.box_from_polygon(geometry.box_points((50, 40), (30, 10), angle))
    turn = abs(b["angle"] - angle) % 180
    assert abs(b["width"] - 30) <= 1 and abs(b["height"] - 10) <= 1 and min(turn, 180 - turn) < 1e-3


def test_detection_decoders():
    import numpy as np

    assert geometry.decode_detections([1, 2, 3, 4, 0.9, 1, 0, 0, 1, 1, 0.1, 0], [1, 2, 6], 0.5) == [{"x0": 1.0, "y0": 2.0, "x1": 3.0, "y1": 4.0, "score": pytest.approx(0.9), "class_id": 1}]
    planes = np.array([[10], [20], [4], [6], [0.2], [0.7]])
    (d,) = geometry.decode_detections(planes, [1, 6, 1], 0.5)
    assert (d["x0"], d["y0"], d["x1"], d["y1"], d["class_id"]) == (8, 17, 12, 23, 1)
    assert len(geometry.suppress([{**d, "score": 0.5}, d, {**d, "class_id": 0}], 0.5)) == 2
    words = [("Raja", 0, 4), ("Raman", 5, 10)]
    logits = np.full(4, -10.0)
    logits[[0, 1]] = 5, 6
    assert [s["text"] for s in geometry.decode_spans(logits, "Raja Raman", words, ["person"], 2)] == ["Raja Raman"]
    logits[:] = -10
    logits[3] = 5
    assert geometry.decode_spans(logits, "Raja Raman", words, ["person"], 2) == []


def test_images(spark):
    import numpy as np

    px = np.random.default_rng(1).integers(0, 256, (7, 9, 4), np.uint8)
    assert (images.decode_png(images.encode_png(px)) == px).all() and images.probe(images.encode_png(px)) == ("png", 9, 7)
    page = np.full((60, 200, 4), 255, np.uint8)
    page[20:40, 50:120, :3] = 0
    (fitted,) = images.fit_boxes(images.luma(page), [box("a", 55, 22, 60, 16)])
    assert (fitted["x"], fitted["y"], fitted["width"], fitted["height"]) == (50, 20, 70, 20)
    assert images.crop(page, box("", -5, -5, 10, 10)).shape == (10, 10, 4)
    rows = spark.createDataFrame([(images.encode_png(px), "a"), (b"junk", "b"), (None, "c")], "content binary, path string")
    made = {r.path: r.image for r in images.data_to_image(rows).collect()}
    assert (made["a"].width, made["a"].height, made["a"].exception) == (9, 7, "") and made["b"].exception and made["c"].exception
