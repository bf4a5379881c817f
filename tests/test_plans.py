import json

import pytest
from pyspark.sql import functions as F

from pagewright import display
from pagewright.plans import registry
from pagewright.plans.errors import NO_EMBEDDED_IMAGES, ConfigError, SkipError, format_exception, is_skipped, upstream_message
from pagewright.plans.stage import Pipeline, Run, Stage
from pagewright.schemas import document
from pagewright.sources.inputs import to_rows, with_content


class Tag(Stage):
    name, defaults = "Tag", {"inputCol": "document", "outputCol": "tag", "keepInputData": True, "word": "x"}

    def apply(self, df, run):
        return F.concat(F.col("document.text"), F.lit(self.params["word"]))


def docs(spark, *texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", document(F.col("t")).alias("document"))


def test_all_stages_are_there():
    assert len(registry.STAGES) == 24
    for kind in registry.STAGES.values():
        kind()
    for name in registry.PRESETS:
        registry.preset(name)


def test_conditions_switches_and_ids(spark):
    rows = docs(spark, "a", "b")
    p = Pipeline([Tag(when={"path": "document.text", "eq": "a"}), Tag(outputCol="tag2", word="y", id="second")])
    assert p.ids == ["Tag", "second"]
    out = {r.i: (r.tag, r.tag2) for r in p.transform(rows).collect()}
    assert out == {0: ("ax", "ay"), 1: (None, "by")}
    assert "tag2" not in p.transform(rows, Run(enabled={"second": False})).columns
    assert [r.i for r in p.transform(rows, ordered=True).collect()] == [0, 1]
    assert Pipeline([Tag(), Tag()]).ids == ["Tag#0", "Tag#1"]
    with pytest.raises(ConfigError):
        Pipeline([Tag(id="a"), Tag(id="a")])
    with pytest.raises(ConfigError):
        Tag(inputCol="nowhere").run(rows)
    with pytest.raises(ConfigError):
        Tag(nonsense=1)


def test_descriptors_and_code():
    given = [{"type": "RegexNer", "options": {"inputCol": "document", "threshold": 0.7}, "when": {"path": "page", "gte": 1}}, {"type": "NerConsistency", "options": {}, "enabled": False}]
    p = registry.pipeline_from_descriptors(json.dumps(given))
    assert p.describe() == given
    space: dict = {}
    exec(registry.pipeline_code(given), space)
    assert space["pipeline"].describe() == given
    for bad in ({"type": "Nothing"}, {"type": "RegexNer", "x": 1}, {"type": "RegexNer", "when": {"path": "a"}}):
        with pytest.raises((ConfigError, TypeError)):
            registry.create_stage(bad)
    with pytest.raises(ValueError):
        registry.create_stage({"type": "RegexNer", "options": {"threshold": 2}})


def test_missing_engine_is_a_failure_in_the_record(spark):
    rows = spark.createDataFrame([(b"x", "p")], "content binary, path string")
    (r,) = registry.pipeline_from_descriptors([{"type": "PdfToDocument"}, {"type": "RegexNer", "options": {"inputCol": "document"}}]).transform(rows).collect()
    assert "no engine" in r.document.exception and r.ner.exception.startswith("Upstream stage failed: ")


class Reader:
    def count(self, content):
        return int(content)

    def page(self, content, n, params):
        if n == 1:
            raise ValueError("torn")
        return {"path": "memory", "text": f"page {n}", "type": "pdf", "bboxes": [], "exception": ""}


def test_page_engine(spark):
    import sys

    from pyspark import cloudpickle

    cloudpickle.register_pickle_by_value(sys.modules[Reader.__module__])
    rows = spark.createDataFrame([(b"3", "p")], "content binary, path string")
    out = registry.PdfToDocument().run(rows, Run(engines={"pdf-text": Reader()})).orderBy("page").collect()
    assert [(r.page, r.document.text, bool(r.document.exception)) for r in out] == [(0, "page 0", False), (1, "", True), (2, "page 2", False)]
    one = rows.withColumn("page", F.lit(2))
    assert [r.page for r in registry.PdfToDocument().run(one, Run(engines={"pdf-text": Reader()})).collect()] == [2]


def test_consistency_over_all_rows(spark):
    rows = docs(spark, "write to Ann: ann@example.com", "Ann, ann@example.com again, ANN@example.com")
    out = registry.preset("patterns").transform(rows).orderBy("i").collect()
    assert [[(e.word, e.source) for e in r.ner.entities] for r in out] == [[("ann@example.com", "pattern")], [("ann@example.com", "pattern"), ("ANN@example.com", "pattern")]]


def test_errors():
    assert is_skipped(NO_EMBEDDED_IMAGES) and upstream_message(NO_EMBEDDED_IMAGES) == NO_EMBEDDED_IMAGES and upstream_message("x") == "Upstream stage failed: x"
    assert format_exception("S", ValueError("bad")) == "S: ValueError: bad" and format_exception("S", SkipError("none")) == "none"


def test_sources(spark, tmp_path):
    (tmp_path / "a.bin").write_bytes(b"abc")
    assert [bytes(r.content) for r in to_rows(spark, str(tmp_path)).collect()] == [b"abc"]
    assert to_rows(spark, b"x").first().path == "memory" and to_rows(spark, {"a": 1}).first().a == 1
    contents = spark.createDataFrame([("k", b"x")], "key string, content binary")
    refs = spark.createDataFrame([("k",), (None,)], "contentRef string")
    assert sorted((r.contentRef or "", None if r.content is None else bytes(r.content)) for r in with_content(refs, contents).collect()) == [("", None), ("k", b"x")]
    with pytest.raises(Exception, match="unknown content"):
        with_content(spark.createDataFrame([("z",)], "contentRef string"), contents).collect()


def test_display():
    doc = {"text": "a <b> c", "exception": ""}
    ner = {"entities": [{"entity_group": "X", "score": 0.9, "word": "<b>", "start": 2, "end": 5}, {"entity_group": "Y", "score": 0.5, "word": "b", "start": 3, "end": 4}], "exception": ""}
    html = display.visualize_ner(doc, ner)
    assert "&lt;b&gt;" in html and html.count("<span") == 1
    assert "error" in display.show_text({"text": "", "exception": "bad"}) and "<table>" in display.show_ner(ner)


def test_models_and_hues(tmp_path):
    from pagewright.operators.images import hue_of
    from pagewright.plans import models

    need = models.required([{"type": "GlinerNer"}, {"type": "GlinerNer", "options": {"model": "gliner-small"}}, {"type": "GlinerNer", "id": "again"}, {"type": "GlinerNer", "enabled": False}])
    assert {k: v["stages"] for k, v in need.items()} == {"onnx-community/gliner_multi_pii-v1@main": ["GlinerNer#0", "again"], "onnx-community/gliner_small-v2.1@main": ["GlinerNer#1"]}
    assert set(models.status(str(tmp_path), [{"type": "GlinerNer"}]).values()) == {False} and models.MODELS["gliner-small"].size > 3e8
    assert hue_of("PERSON-NAME") == hue_of("person") == 216 and hue_of("a") == 97 and 0 <= hue_of("some other group") < 360
    assert models.parallelism(8, "throughput") == {"workers": 8, "threads": 1, "pages_in_flight": 1}


def test_documents_are_made_row_by_row(spark):
    from pagewright.operators.words import as_document, word_offsets

    rows = [(1, "ab  c"), (1, "d"), (None, "ef g"), (None, None), (2, "")]
    docs = as_document(spark.createDataFrame(rows, "doc_id int, text string"), "doc_id", "text")
    got = [(r.doc_id, r.document.text, [(b.text, b.x, b.width) for b in r.document.bboxes]) for r in docs.collect()]
    assert got == [(1, "ab  c", [("ab", 0, 20), ("c", 40, 10)]), (1, "d", [("d", 0, 10)]), (None, "ef g", [("ef", 0, 20), ("g", 30, 10)]), (None, "", []), (2, "", [])]
    assert "Exchange" not in docs._jdf.queryExecution().executedPlan().toString()
    words = word_offsets(spark.createDataFrame(rows, "doc_id int, text string"), "doc_id", "text")
    assert [tuple(w) for w in words.collect()] == [(1, 0, "ab", 0), (1, 1, "", 3), (1, 2, "c", 4), (1, 0, "d", 0), (None, 0, "ef", 0), (None, 1, "g", 3), (2, 0, "", 0)]


def test_phrases_are_matched_by_any_key(spark):
    """Against the same phrases given to every row."""
    from pagewright.operators import entities
    from pagewright.operators.words import as_document

    texts = ["see the long Phrase here", "a LONG phrase", "*** and +++", "x*** y", "+++", "the", "", "phrase long", "* * *"]
    marked = {0: [("long Phrase", 8)], 2: [("***", 0), ("+++", 8)], 5: [("the", 0)], 8: [("* * *", 0)]}
    docs = as_document(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string"), "doc_id", "text")
    lists = [(i, [{"entity_group": "G", "score": 0.9, "word": w, "start": a, "end": a + len(w), "boxes": [], "source": "model"} for w, a in marked.get(i, [])]) for i in range(len(texts))]
    found = spark.createDataFrame(lists, f"doc_id int, entities {entities.ENTITIES}")
    rows = docs.join(found, "doc_id").withColumn("ner", entities.ner(F.col("entities"))).drop("entities")
    vocabulary = [(w.lower(), [("G", 0.9)]) for ws in marked.values() for w, _ in ws]
    want = {i: [(e["start"], e["end"], e["entity_group"]) for e in entities.propagate(t, [], vocabulary, lists[i][1])] for i, t in enumerate(texts)}
    got = entities.consistent(rows, "ner", "document").collect()
    assert {r.doc_id: [(e.start, e.end, e.entity_group) for e in r.ner.entities] for r in got} == want
    assert want[3] and want[1] and not want[7]


def test_pages_leave_no_place_behind(spark):
    rows = spark.createDataFrame([("a 12.03.2024",)], "text string").select(document(F.col("text")).alias("document"))
    pipeline = registry.pipeline_from_descriptors([{"type": "RegexNer", "options": {"inputCol": "document"}}])
    assert pipeline.transform(rows).columns == ["document", "ner"]
    kept = rows.withColumn("_ord", F.array(F.lit(7).cast("long")))
    assert pipeline.transform(kept).columns == ["document", "_ord", "ner"]


def test_stage_specs():
    specs = registry.stage_specs()
    assert set(specs) == set(registry.STAGES) and len(specs) == 24
    assert specs["PdfMergeImageText"]["scope"] == "group" and specs["NerConsistency"]["scope"] == "all rows" and specs["PdfToImage"]["pageScoped"]
    assert specs["ImageCropBoxes"]["alsoProduces"] == ["box"] and specs["GlinerNer"]["params"]["chunkLength"] == {"default": 500, "type": "int", "checked": True}


def test_what_is_not_done_is_refused(spark):
    with pytest.raises(ConfigError):
        registry.DbnetOnnxDetector(model="m", pack=True)
    rows = spark.createDataFrame([("a",)], "text string").select(document(F.col("text")).alias("text"))
    with pytest.raises(ConfigError):
        registry.RegexNer(defaultCountry="PL").run(rows)


def test_model_stages_write_failures(spark):
    rows = spark.createDataFrame([("x y",), ("",), (None,)], "text string").select(document(F.col("text"), exception=F.when(F.col("text").isNull(), "broken").otherwise("")).alias("text"))

    def failing(text, labels, threshold):
        raise RuntimeError("no weights")

    got = [r.ner for r in registry.GlinerNer(labels=["A"]).run(rows, Run(engines={"gliner": failing})).collect()]
    assert "no weights" in got[0].exception and got[1].exception == "" and got[1].entities == [] and "broken" in got[2].exception


def test_windows_and_casing():
    from pagewright.plans import bodies

    assert [(a, len(t)) for a, t in bodies.windows("x" * 980, 500, 480)] == [(0, 500), (480, 500), (960, 20)]
    assert [(a, len(t)) for a, t in bodies.windows("x" * 500, 500, 480)] == [(0, 500)] and list(bodies.windows("", 500, 480)) == []
    seen = []
    params = {"inputCol": "text", "chunkLength": 500, "chunkStride": 480, "labels": ["P"], "threshold": 0.5, "whiteList": [], "normaliseCasing": True}
    engine = lambda text, labels, threshold: seen.append(text) or [{"start": 0, "end": 4, "label": "P", "score": 1}, {"start": 0, "end": 4, "label": "P", "score": 0.7}]
    made = bodies.named_entities(engine, {"text": {"text": "JOHN SMITH", "bboxes": []}}, params)
    assert seen == ["John Smith"] and [(e["word"], e["score"]) for e in made["entities"]] == [("JOHN", 1.0)]


def test_sheets():
    from pagewright.plans import bodies

    sheets = bodies.pack_sheets([(50, 20), (100, 40), (60, 30), (400, 100)], 100, 1, 10)
    assert [[(p["item"], p["x"], p["y"]) for p in s] for s in sheets] == [[(1, 0, 0), (2, 0, 50)], [(3, 0, 0), (0, 0, 35)]]
    for sheet in sheets:
        for i, p in enumerate(sheet):
            assert p["x"] + p["width"] <= 100 and p["y"] + p["height"] <= 100
            assert all(p["x"] >= q["x"] + q["width"] or q["x"] >= p["x"] + p["width"] or p["y"] >= q["y"] + q["height"] or q["y"] >= p["y"] + p["height"] for q in sheet[:i])
