"""Queries and stages do the whole job: every row, box and byte of what they are given."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagewright import queries
from pagewright.operators import images
from pagewright.plans import registry
from pagewright.plans.errors import ConfigError
from pagewright.schemas import BOXES, ENTITIES, PLACEMENT, box, image, ner

SF = "/root/testdata/sf0.001"


def test_every_box_of_every_page_is_cropped(spark):
    made = queries.image_boxes(spark, SF).select("page", "exception").collect()
    assert len(made) == queries.table(spark, SF, "lineitem").count() and not any(r.exception for r in made)


def test_crop_limit(spark):
    px = np.random.default_rng(3).integers(0, 256, (40, 60, 4), np.uint8)
    boxes = F.array(*[box(str(i), 0.9, 2.0 * i, 3.0, 10.0 + i, 5.0, 0.0) for i in range(5)]).cast(BOXES)
    rows = spark.range(2).select("id", image(F.lit(images.encode_png(px)), F.lit("a")).alias("image"), F.struct(boxes.alias("bboxes")).alias("boxes"))
    cut = lambda **o: [(r.id, r.box.text, r.cropped_image.width) for r in images.crop_boxes(rows, **o).orderBy("id", "box.text").collect()]
    every = [(n, str(i), 10 + i) for n in (0, 1) for i in range(5)]
    assert cut() == every and cut(limit=3) == [x for x in every if x[1] < "3"]


def test_every_document_is_normalised(spark, tmp_path):
    import hashlib

    texts = {1: "no digit, a – dash", 2: "2O24‒01", 3: "plain", 4: "", 5: None}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    want = {1: "no digit, a - dash", 2: "2024-01", 3: "plain", 4: ""}
    made = {r.doc_id: r.digest for r in queries.ocr_normalise(spark, str(tmp_path)).collect()}
    assert made == {k: hashlib.md5(t.encode()).hexdigest() for k, t in want.items()} | {5: None}


def test_jpeg_with_metadata_longer_than_the_head(spark):
    frame = b"\xff\xc0\x00\x11\x08" + (30).to_bytes(2, "big") + (50).to_bytes(2, "big") + b"\x03" + bytes(9)
    profile = b"\xff\xe2\xff\xff" + bytes(0xFFFD)
    rows = [("long", b"\xff\xd8" + 3 * profile + frame), ("short", b"\xff\xd8" + frame), ("broken", b"\xff\xd8" + 3 * profile), ("junk", bytes(1 << 17))]
    made = {r.path: r.image for r in images.data_to_image(spark.createDataFrame(rows, "path string, content binary")).collect()}
    assert all((made[k].imageType, made[k].width, made[k].height, made[k].exception) == ("jpeg", 50, 30, "") for k in ("long", "short"))
    assert bytes(made["long"].data) == rows[0][1] and made["broken"].exception and made["junk"].exception


def test_every_source_is_drawn_and_lists_hold(spark):
    page = images.encode_png(np.full((40, 60, 4), 255, np.uint8))
    boxes = [F.array(box(F.lit("a"), F.lit(1.0), F.lit(x), F.lit(4.0), F.lit(6.0), F.lit(6.0), F.lit(0.0))).cast(BOXES) for x in (2.0, 22.0, 42.0)]
    entity = lambda group, found: F.struct(F.lit(group).alias("entity_group"), F.lit(0.9).alias("score"), F.lit("w").alias("word"), F.lit(0).alias("start"), F.lit(1).alias("end"), found.alias("boxes"), F.lit("").alias("source"))
    found = ner(F.array(entity("EMAIL", boxes[1]), entity("DATE", boxes[2])).cast(ENTITIES))
    rows = spark.createDataFrame([(page,)], "page binary").select(image(F.col("page"), F.lit("a")).alias("image"), F.struct(boxes[0].alias("bboxes")).alias("boxes"), found.alias("ner"), F.struct(F.lit(None).cast(BOXES).alias("bboxes")).alias("none"))

    def centres(**options):
        (r,) = registry.ImageDrawBoxes(inputCols=["image", "boxes", "ner", "none"], filled=True, **options).run(rows).collect()
        assert r.image_with_boxes.exception == ""
        px = images.decode_png(bytes(r.image_with_boxes.data))
        return [tuple(px[7, x, :3].tolist()) for x in (5, 25, 45)]

    white = (255, 255, 255)
    assert centres() == [images.colour_of("a"), images.colour_of("EMAIL"), images.colour_of("DATE")]
    assert centres(whiteList=["DATE"], color="#0f0") == [(0, 255, 0), white, (0, 255, 0)]
    assert centres(blackList=["DATE"], color="#010203") == [(1, 2, 3), (1, 2, 3), white]
    for bad in ({"displayDataList": ["score"]}, {"textSize": 9}, {"color": "red"}, {"inputCols": ["image"]}):
        with pytest.raises(ConfigError):
            registry.ImageDrawBoxes(**bad)


def test_presets_are_whole(spark):
    rows = spark.createDataFrame([(b"x", "p")], "content binary, path string").withColumn("placement", F.lit(None).cast(PLACEMENT))
    assert {"pdf-hybrid-detect", "pii-paddle-auto-script"} <= set(registry.PRESETS)
    for name in set(registry.PRESETS) - {"patterns"}:
        assert registry.PRESETS[name][-1]["type"] == "ImageDrawBoxes"
        assert "image_with_boxes" in registry.preset(name).transform(rows).columns


def test_numbers_are_found_across_white_space_and_with_all_edits():
    import random

    pattern, r = queries.FuzzyPattern(queries.NUMBER), random.Random(8)
    for text in ("call 555 -1234 now", "555-12x4", "555-124", "5551234", "555-1234", "") + tuple("".join(r.choice("0123456789-- x\n") for _ in range(r.randrange(60))) for _ in range(400)):
        assert queries.number_matches(pattern, text) == pattern.match_all(text, 1)
    (m,) = queries.number_matches(pattern, "call 555 -1234 now")
    assert (m.start, m.end, m.cost) == (5, 14, 1)
    assert [m.cost for t in ("555-12x4", "555-124") for m in queries.number_matches(pattern, t)] == [1, 1]
