"""The stages by name, pipelines as JSON descriptors, and code that builds a pipeline.

Stages that need an outside engine (a PDF reader, a recogniser, model weights) take it from the run: a callable that is
given plain values and returns a plain record. Without their engine they write a failure; they never make results up.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import presets
from ..functions.boxes import merge_overlapping
from ..functions.text import CHUNK_LENGTH, CHUNK_STRIDE
from ..operators import entities, images, merging, patterns
from ..schemas import KINDS, empty, image
from . import bodies
from .errors import NO_EMBEDDED_IMAGES, ConfigError, format_exception, upstream
from .pages import explode_pages
from .stage import BASE, ORDER, Pipeline, Run, Stage, in_range, place, positive_int, unused


class EngineStage(Stage):
    """A map over one column by an engine: ``engine(value, params) -> record``, both plain Python values.

    Where ``body`` is given, it makes the record with the engine's help, and the engine has the form that it asks for.
    """

    engine = "engine"
    body: Callable | None = None

    def apply(self, df: DataFrame, run: Run) -> Column:
        kind, name, params = KINDS[self.kind], self.name, dict(self.params)
        call, body = run.engines.get(self.engine), self.body
        inputs = self.reads()
        if call is None:
            missing = self.failure(f"{name}: ConfigError: no engine {self.engine!r} was given")
            return F.when(F.col(inputs[0]).isNotNull(), missing)
        error = F.lit("")
        for c in inputs:
            if c in df.columns and "exception" in getattr(df.schema[c].dataType, "names", []):
                error = F.when((error == "") & (F.coalesce(F.col(f"{c}.exception"), F.lit("")) != ""), upstream(F.col(f"{c}.exception"))).otherwise(error)
        # images travel as binary, the rest of each input as JSON
        data = F.col(f"{inputs[0]}.data") if "data" in getattr(df.schema[inputs[0]].dataType, "names", []) else F.lit(None).cast("binary")
        plain = F.to_json(F.struct(*[F.col(c).dropFields("data").alias(c) if "data" in getattr(df.schema[c].dataType, "names", []) else F.col(c) for c in inputs]))

        @F.pandas_udf(f"struct<value:{kind},error:string>")
        def work(values: pd.Series, blobs: pd.Series, errors: pd.Series) -> pd.DataFrame:
            rows = []
            for value, blob, bad in zip(values, blobs, errors, strict=True):
                if bad:
                    rows.append((None, bad))
                    continue
                try:
                    given = {**json.loads(value), "data": None if blob is None else bytes(blob)}
                    rows.append((call(given, params) if body is None else body(call, given, params), ""))
                except Exception as e:  # the contract: a row that fails says so
                    if params["propagateError"]:
                        raise
                    rows.append((None, format_exception(name, e)))
            return pd.DataFrame(rows, columns=["value", "error"])

        done = work(plain, data, error)
        return F.when(done["error"] != "", empty(self.kind, exception=done["error"])).otherwise(done["value"])


class PageEngineStage(Stage):
    """One row for each page of a file: ``engine.count(content)`` and ``engine.page(content, page, params) -> record``.

    Pages are dealt out before any is read, so that each is read where its row is. An engine that has ``form`` instead of
    ``page`` gives raw parts of a page, and ``body`` makes the record of them.
    """

    engine = "pdf"
    expands = True
    form, body = "", None

    def paged(self, df: DataFrame, tool) -> DataFrame:
        """A row for each page that the file has, or the one that the row names."""
        p = self.params

        @F.pandas_udf("int")
        def count(data: pd.Series) -> pd.Series:
            def pages(d) -> int:
                try:
                    return max(1, tool.count(bytes(d)))
                except Exception:  # the page that is read will say why
                    return 1

            return data.map(pages)

        return explode_pages(df.withColumn("__n", count(F.col(p["inputCol"]))), "__n", p["pageCol"], p["pageLimit"]).drop("__n")

    def transform(self, df: DataFrame, run: Run) -> DataFrame:
        p, out, kind, name = dict(self.params), self.params["outputCol"], KINDS[self.kind], self.name
        tool = run.engines.get(self.engine)
        content, page = p["inputCol"], p["pageCol"]
        body = self.body if self.form and hasattr(tool, self.form) else None
        if tool is None:
            made = df if page in df.columns else df.withColumn(page, F.lit(0))
            return made.withColumn(out, self.failure(f"{name}: ConfigError: no engine {self.engine!r} was given"))

        @F.pandas_udf(f"struct<value:{kind},error:string>")
        def read(data: pd.Series, numbers: pd.Series) -> pd.DataFrame:
            rows = []
            for d, n in zip(data, numbers, strict=True):
                try:
                    rows.append((tool.page(bytes(d), int(n), p) if body is None else body(tool, bytes(d), int(n), p), ""))
                except Exception as e:  # the contract: a row that fails says so
                    rows.append((None, format_exception(name, e)))
            return pd.DataFrame(rows, columns=["value", "error"])

        wide = self.paged(df, tool)
        done = read(F.col(content), F.col(page))
        return place(wide.withColumn(out, F.when(done["error"] != "", empty(self.kind, exception=done["error"])).otherwise(done["value"])), F.col(page))


def _stage(name: str, kind: str, base: type[Stage] = EngineStage, engine: str = "", expands: bool = False, barrier: bool = False, checks: dict | None = None, body: Callable | None = None, form: str = "", **defaults) -> type[Stage]:
    own = {"name": name, "kind": kind, "defaults": defaults, "engine": engine or name, "expands": expands, "barrier": barrier, "checks": checks or {}}
    return type(name, (base,), own | ({"body": staticmethod(body)} if body else {}) | ({"form": form} if form else {}))


SHARE = in_range(0, 1)
KEEP = {"keepInputData": True}
PDF = {"inputCol": "content", "resolution": 300, "pageLimit": 0}

PdfToImage = _stage("PdfToImage", "image", PageEngineStage, "pdf", True, outputCol="image", imageType="png", **PDF)
PdfToDocument = _stage("PdfToDocument", "document", PageEngineStage, "pdf-text", True, form="runs", body=bodies.text_page, outputCol="document", splitWords=True, **PDF, **KEEP)
_EmbeddedImages = _stage(
    "PdfEmbeddedImages", "image", PageEngineStage, "pdf-images", True, outputCol="image", imageType="png", placementCol="placement", minPixels=4096, imageLimit=0,
    minEffectiveResolution=150, objectTimeoutMs=10_000, textLayerCol="document", minCoveringBoxes=8, returnEmpty=True, **PDF, **KEEP,
)


class PdfEmbeddedImages(_EmbeddedImages):
    """A row for each raster that a page paints, with its placement; a page without any gives one row that says so.

    What the text layer's boxes cover already is left out. An engine without ``operators`` gives one image for a page.
    """

    form = "operators"

    def __init__(self, **options):
        super().__init__(**options)
        if self.params["imageType"] != "png":
            raise ConfigError("PdfEmbeddedImages writes PNG only")

    def writes(self) -> list[str]:
        return [self.params["outputCol"], self.params["placementCol"]]

    def transform(self, df: DataFrame, run: Run) -> DataFrame:
        p, out, name = dict(self.params), self.params["outputCol"], self.name
        tool, nowhere = run.engines.get(self.engine), F.lit(None).cast(KINDS["placement"])
        if tool is None or not hasattr(tool, self.form):
            return super().transform(df, run).withColumn(p["placementCol"], nowhere)
        wide = self.paged(df, tool)
        layer = F.to_json(F.col(f"{p['textLayerCol']}.bboxes")) if p["textLayerCol"] in df.columns else F.lit(None).cast("string")

        @F.pandas_udf(f"struct<found:array<struct<image:{KINDS['image']},placement:{KINDS['placement']}>>,error:string>")
        def read(data: pd.Series, numbers: pd.Series, layers: pd.Series) -> pd.DataFrame:
            rows = []
            for d, n, boxes in zip(data, numbers, layers, strict=True):
                try:
                    rows.append((bodies.embedded_images(tool, bytes(d), int(n), p, json.loads(boxes) if boxes else []), ""))
                except Exception as e:  # the contract: a row that fails says so
                    if p["propagateError"]:
                        raise
                    rows.append(([], format_exception(name, e)))
            return pd.DataFrame(rows, columns=["found", "error"])

        columns = [c for c in wide.columns if c not in (out, p["placementCol"])]
        made, nth, one = (unused(f"__{c}", [*wide.columns, out, p["placementCol"]]) for c in ("made", "nth", "one"))
        done = wide.withColumn(made, read(F.col(p["inputCol"]), F.col(p["pageCol"]), layer))
        done = done.select(*wide.columns, made, F.posexplode_outer(f"{made}.found").alias(nth, one))
        if not p["returnEmpty"]:
            done = done.where(F.col(nth).isNotNull() | (F.col(f"{made}.error") != ""))
        path = F.coalesce(F.col(p["pathCol"]), F.lit("memory")) if p["pathCol"] in columns else F.lit("memory")
        why = F.when(F.col(f"{made}.error") != "", F.col(f"{made}.error")).otherwise(F.lit(NO_EMBEDDED_IMAGES))
        none = image(path=path, resolution=p["resolution"], exception=why)
        shown = F.when(F.col(nth).isNull(), none).otherwise(F.col(f"{one}.image").withField("path", path))
        ordered = place(place(done, F.col(p["pageCol"])), F.coalesce(F.col(nth), F.lit(0)))
        return ordered.select(*columns, shown.alias(out), F.col(f"{one}.placement").alias(p["placementCol"]))


IMAGE_IN = {"inputCol": "image", **KEEP}
PaddleTextDetector = _stage("PaddleTextDetector", "boxes", engine="paddle-detect", checks={"scoreThreshold": SHARE}, outputCol="boxes", preset=presets.DEFAULT, presetCol="", scoreThreshold=0, **IMAGE_IN)
_TextDetector = _stage(
    "DbnetOnnxDetector", "boxes", engine="dbnet", checks={"scoreThreshold": SHARE, "binaryThreshold": SHARE}, body=bodies.text_regions, outputCol="boxes", model="", scoreThreshold=0.3,
    binaryThreshold=0.5, unclipRatio=2.5, mergeBoxes=True, squareInput=False, pack=False, packMaxScale=2, packGutter=64, **IMAGE_IN,
)


class DbnetOnnxDetector(_TextDetector):
    """Text boxes; those that overlap on a line are merged on request. Images are not packed on sheets."""

    def __init__(self, **options):
        super().__init__(**options)
        if self.params["pack"]:
            raise ConfigError("DbnetOnnxDetector reads one image at a time: pack is not supported")

    def apply(self, df: DataFrame, run: Run) -> Column:
        found = super().apply(df, run)
        return found.withField("bboxes", merge_overlapping(found["bboxes"])) if self.params["mergeBoxes"] else found


YOLO = {"model": "", "labels": [], "scoreThreshold": 0.2, "iouThreshold": 0.5, "padding": 0}
YoloOnnxDetector = _stage("YoloOnnxDetector", "boxes", engine="yolo", checks={"scoreThreshold": SHARE, "iouThreshold": SHARE}, body=bodies.detections, outputCol="boxes", outputType="yolo", **YOLO, **IMAGE_IN)
SignatureDetector = _stage("SignatureDetector", "boxes", engine="yolo", body=bodies.detections, outputCol="signatures", outputType="signature", **YOLO, **IMAGE_IN)
FaceDetector = _stage("FaceDetector", "boxes", engine="yolo", body=bodies.detections, outputCol="faces", outputType="face", **YOLO, **IMAGE_IN)
TesseractScriptDetector = _stage("TesseractScriptDetector", "script", engine="tesseract-script", outputCol="script", scoreThreshold=0, **IMAGE_IN)
BOTH = {"inputCols": ["image", "boxes"], **IMAGE_IN}
LineOrientationDetector = _stage("LineOrientationDetector", "boxes", engine="orientation", outputCol="oriented", orientationCol="orientations", model="", correct=True, onlyRotated=True, padding=2, imageType="png", **BOTH)
READ = {"scoreThreshold": 0.5, "keepFormatting": False, "lineTolerance": 0, "boxLevel": "word"}
REGIONS = {"scaleFactor": 1, "padding": 5, "endPadding": 0.3, "dropNested": True, "oriModel": ""}
PaddleTextRecognizer = _stage("PaddleTextRecognizer", "document", engine="paddle", checks={"scoreThreshold": SHARE}, outputCol="text", preset=presets.DEFAULT, presetCol="", strategy="per-box", wordGapRatio=0.15, recBatchSize=1, **READ, **IMAGE_IN)
PaddleRecognizer = _stage(
    "PaddleRecognizer", "document", engine="paddle-lines", outputCol="text", preset=presets.DEFAULT, presetCol="", detectLineOrientation=False, onlyRotated=False, spaceRecovery=False,
    recBatchSize=1, wordGapRatio=0.15, **READ, **REGIONS, **BOTH,
)
TesseractOcr = _stage("TesseractOcr", "document", engine="tesseract", outputCol="text", lang=["eng"], **{k: v for k, v in READ.items() if k != "boxLevel"}, **IMAGE_IN)
TesseractRecognizer = _stage("TesseractRecognizer", "document", engine="tesseract-lines", outputCol="text", lang=["eng"], detectLineOrientation=True, onlyRotated=False, **READ, **REGIONS, **BOTH)
GlinerNer = _stage(
    "GlinerNer", "ner", engine="gliner", checks={"threshold": SHARE, "chunkLength": positive_int, "chunkStride": positive_int}, body=bodies.named_entities, inputCol="text", outputCol="ner", model="", labels=[], threshold=0.5, whiteList=[], chunkLength=CHUNK_LENGTH,
    chunkStride=CHUNK_STRIDE, normaliseCasing=True, **KEEP,
)


class DataToImage(Stage):
    name, kind, defaults = "DataToImage", "image", {"outputCol": "image", "imageType": "png", "resolution": 0}

    def transform(self, df: DataFrame, run: Run) -> DataFrame:
        p = self.params
        return images.data_to_image(df, p["inputCol"], p["pathCol"], p["outputCol"], "resolution" if "resolution" in df.columns else p["resolution"])


class RegexNer(Stage):
    name, kind = "RegexNer", "ner"
    defaults = {
        "inputCol": "text", "outputCol": "ner", "keepInputData": True, "labels": list(patterns.LABELS), "threshold": 0.5, "ocrTolerant": True, "maxEdits": 1, "validate": True,
        "useLibraries": True, "defaultCountry": "", "dateLocales": ["en"], "countryLocales": ["en", "pl"],
    }
    checks = {"threshold": SHARE, "maxEdits": in_range(0, 3)}

    def transform(self, df: DataFrame, run: Run) -> DataFrame:
        p = self.params
        for name in ("defaultCountry", "dateLocales"):
            if p[name] != self.defaults[name] and not ("find_phones" in run.engines or "find_dates" in run.engines):
                raise ConfigError(f"RegexNer: {name} is for an engine (find_phones, find_dates), and the run has none")
        engines = {k: run.engines[k] for k in ("find_phones", "find_dates") if p["useLibraries"] and k in run.engines}
        return patterns.pattern_entities(df, p["inputCol"], p["outputCol"], tuple(p["labels"]), tuple(p["countryLocales"]), threshold=p["threshold"], tolerant=p["ocrTolerant"], max_edits=p["maxEdits"], check=p["validate"], **engines)


class NerConsistency(Stage):
    name, kind, barrier = "NerConsistency", "ner", True
    defaults = {"inputCol": "ner", "inputCols": ["ner", "text"], "outputCol": "ner", "keepInputData": True, "scope": "document", "minLength": 3, "minScore": 0, "resolveConflicts": True, "overrideModelLabels": True}

    def transform(self, df: DataFrame, run: Run) -> DataFrame:
        p = self.params
        found, text = p["inputCols"]
        return entities.consistent(df, found, text, None, p["outputCol"], p["minLength"], p["minScore"], p["resolveConflicts"], p["overrideModelLabels"], row_scope=p["scope"] == "row")


class NerMerger(Stage):
    name, kind = "NerMerger", "ner"
    defaults = {"inputCol": "ner", "inputCols": ["ner", "delta_ner"], "documentCol": "merged", "outputCol": "ner", "keepInputData": True, "dedupe": "span"}

    def reads(self) -> list[str]:
        return [*self.params["inputCols"], *([self.params["documentCol"]] if self.params["documentCol"] else [])]

    def apply(self, df: DataFrame, run: Run) -> Column:
        p = self.params
        records = [F.col(c) for c in p["inputCols"]]
        if not p["documentCol"]:
            return entities.merge_records(records, p["dedupe"] == "span")
        document = F.col(p["documentCol"])
        moved = [F.when(r.isNotNull(), r.withField("entities", entities.rebased(r["entities"], document))) for r in records]
        bad = F.coalesce(document["exception"], F.lit(""))
        return F.when(bad != "", empty("ner", exception=upstream(bad))).otherwise(entities.merge_records(moved, p["dedupe"] == "span"))


class DocumentDelta(Stage):
    name = "DocumentDelta"
    defaults = {"inputCol": "document", "inputCols": ["document", "merged"], "outputCol": "delta", "keepInputData": True}

    def apply(self, df: DataFrame, run: Run) -> Column:
        base, merged = self.params["inputCols"]
        return entities.document_delta(F.col(base), F.col(merged))


class PdfMergeImageText(Stage):
    name, expands = "PdfMergeImageText", False
    defaults = {
        "inputCol": "document", "inputCols": ["document", "image_text"], "outputCol": "document", "keepInputData": True, "placementCol": "placement", "groupByCols": ["path", "page"],
        "strategy": "text-layer-wins", "coverageThreshold": 0.5, "matchText": True, "joinFragments": True, "keepFormatting": False, "lineTolerance": 0, "collect": True,
    }
    checks = {"coverageThreshold": SHARE}

    def transform(self, df: DataFrame, run: Run) -> DataFrame:
        p = self.params
        layer, read = p["inputCols"]
        keep = [c for c in df.columns if c not in (*p["groupByCols"], layer, read, p["placementCol"], ORDER)] if p["collect"] else []
        rows = df.select(*p["groupByCols"], layer, read, p["placementCol"], ORDER, *keep)
        return merging.page_fold(
            rows, p["groupByCols"], layer, read, p["placementCol"], ORDER, p["outputCol"], strategy=p["strategy"], threshold=p["coverageThreshold"],
            match_text=p["matchText"], join=p["joinFragments"], keep_formatting=p["keepFormatting"], tolerance=p["lineTolerance"],
        )


class ImageCropBoxes(Stage):
    name, kind, expands = "ImageCropBoxes", "image", True
    defaults = {**BOTH, "outputCol": "cropped_image", "imageType": "png", "padding": 0, "limit": 0, "autoRotate": True, "returnEmpty": False, "boxCol": "box"}

    def transform(self, df: DataFrame, run: Run) -> DataFrame:
        p = self.params
        return images.crop_boxes(df, *p["inputCols"], p["outputCol"], p["boxCol"], p["limit"], p["padding"], p["autoRotate"], p["returnEmpty"])


class ImageDrawBoxes(Stage):
    name, kind = "ImageDrawBoxes", "image"
    defaults = {**BOTH, "outputCol": "image_with_boxes", "imageType": "png", "filled": False, "color": None, "lineWidth": 1, "textSize": 24, "displayDataList": [], "padding": 0, "whiteList": [], "blackList": []}

    def __init__(self, **options):
        super().__init__(**options)
        p = self.params
        if len(p["inputCols"]) < 2:
            raise ConfigError("inputCols needs an image column and at least one source of boxes")
        if p["displayDataList"] or p["textSize"] != self.defaults["textSize"]:
            raise ConfigError("ImageDrawBoxes has no font: displayDataList and textSize are not supported")
        if p["color"] is not None:
            images.colour_from(p["color"])

    def transform(self, df: DataFrame, run: Run) -> DataFrame:
        p = self.params
        source, *boxes = p["inputCols"]
        return images.draw_boxes(df, source, boxes, p["outputCol"], p["filled"], p["lineWidth"], p["padding"], p["color"], p["whiteList"], p["blackList"])


class FitBoxesToInk(Stage):
    name, kind = "FitBoxesToInk", "boxes"
    defaults = {**BOTH, "outputCol": "boxes", "maxGrowAlong": 0.75, "maxGrowAcross": 0.5, "gapRatio": 0.15}

    def transform(self, df: DataFrame, run: Run) -> DataFrame:
        p = self.params
        return images.fit_to_ink(df, *p["inputCols"], p["outputCol"], along=p["maxGrowAlong"], across=p["maxGrowAcross"], gap=p["gapRatio"])


STAGES: dict[str, type[Stage]] = {
    s.name: s
    for s in (
        DataToImage, PdfToImage, PdfToDocument, PdfEmbeddedImages, PdfMergeImageText, DocumentDelta, PaddleTextDetector, DbnetOnnxDetector, YoloOnnxDetector, SignatureDetector,
        FaceDetector, TesseractScriptDetector, LineOrientationDetector, PaddleTextRecognizer, PaddleRecognizer, TesseractOcr, TesseractRecognizer, GlinerNer, RegexNer, NerConsistency,
        NerMerger, ImageDrawBoxes, ImageCropBoxes, FitBoxesToInk,
    )
}

_DRAW_TEXT = {"type": "ImageDrawBoxes", "options": {"inputCols": ["image", "text"]}}
_DRAW_ENTITIES = {"type": "ImageDrawBoxes", "options": {"inputCols": ["image", "ner"], "lineWidth": 3, "padding": 2}}
_SCRIPT_READ = [{"type": "PdfToImage"}, {"type": "TesseractScriptDetector"}, {"type": "PaddleTextRecognizer", "options": {"presetCol": "script"}}]
_ENTITIES = [{"type": "GlinerNer"}, {"type": "NerConsistency"}, _DRAW_ENTITIES]
# the page is read for its image too, which boxes are fitted to and drawn on; the pictures on it stay apart
_HYBRID_READ = [{"type": "PdfToDocument"}, {"type": "PdfToImage", "options": {"keepInputData": True}}, {"type": "PdfEmbeddedImages", "options": {"outputCol": "embedded"}}]
_HYBRID_DETECT = [
    {"type": "DbnetOnnxDetector", "options": {"inputCol": "embedded", "outputCol": "detected"}}, {"type": "FitBoxesToInk", "options": {"inputCols": ["embedded", "detected"], "outputCol": "detected"}},
    {"type": "PaddleRecognizer", "options": {"inputCols": ["embedded", "detected"], "outputCol": "image_text", "detectLineOrientation": True}},
]
_HYBRID_MERGE = [{"type": "PdfMergeImageText"}, {"type": "FitBoxesToInk", "options": {"inputCols": ["image", "document"], "outputCol": "document"}}]
_DRAW_DOCUMENT = {"type": "ImageDrawBoxes", "options": {"inputCols": ["image", "document"]}}

#: Pipelines by name: the stages of each, in order.
PRESETS: dict[str, list[dict]] = {
    "tesseract": [{"type": "PdfToImage"}, {"type": "TesseractOcr"}, _DRAW_TEXT],
    "paddle": [{"type": "PdfToImage"}, {"type": "PaddleTextRecognizer"}, _DRAW_TEXT],
    "paddle-auto-script": [*_SCRIPT_READ, _DRAW_TEXT],
    "pdf-hybrid": [*_HYBRID_READ, {"type": "PaddleTextRecognizer", "options": {"inputCol": "embedded", "outputCol": "image_text"}}, *_HYBRID_MERGE, _DRAW_DOCUMENT],
    "pdf-hybrid-detect": [*_HYBRID_READ, *_HYBRID_DETECT, *_HYBRID_MERGE, _DRAW_DOCUMENT],
    "tesseract-detect": [{"type": "PdfToImage"}, {"type": "DbnetOnnxDetector"}, {"type": "TesseractRecognizer"}, _DRAW_TEXT],
    "paddle-detect": [{"type": "PdfToImage"}, {"type": "DbnetOnnxDetector"}, {"type": "PaddleRecognizer"}, _DRAW_TEXT],
    "pii-tesseract": [{"type": "PdfToImage"}, {"type": "DbnetOnnxDetector"}, {"type": "TesseractRecognizer"}, *_ENTITIES],
    "pii-paddle": [{"type": "PdfToImage"}, {"type": "DbnetOnnxDetector"}, {"type": "PaddleRecognizer"}, *_ENTITIES],
    "pii-paddle-auto-script": [*_SCRIPT_READ, *_ENTITIES],
    "pii-patterns-pdf-hybrid": [*_HYBRID_READ, *_HYBRID_DETECT, *_HYBRID_MERGE, {"type": "RegexNer", "options": {"inputCol": "document"}}, _DRAW_ENTITIES],
    "patterns": [{"type": "RegexNer", "options": {"inputCol": "document"}}, {"type": "NerConsistency", "options": {"inputCols": ["ner", "document"]}}],
}


def stage_specs() -> dict[str, dict]:
    """For each stage what it reads and writes by default, the kind of its output, its scope, engine and options."""
    out = {}
    for name, kind in STAGES.items():
        params = {**BASE, **kind.defaults}
        also = [params[c] for c in ("placementCol", "orientationCol", "boxCol") if c in kind.defaults and name != "PdfMergeImageText"]
        out[name] = {
            "consumes": list(dict.fromkeys(params.get("inputCols") or [params["inputCol"]])), "produces": params["outputCol"], "kind": kind.kind, "alsoProduces": also,
            "expands": kind.expands, "barrier": kind.barrier, "scope": "all rows" if kind.barrier else "group" if "groupByCols" in params else "row",
            "pageScoped": issubclass(kind, PageEngineStage), "engine": getattr(kind, "engine", None) or None,
            "params": {k: {"default": v, "type": type(v).__name__, "checked": k in kind.checks} for k, v in params.items()},
        }
    return out


def create_stage(descriptor: dict) -> Stage:
    extra = set(descriptor) - {"type", "options", "id", "enabled", "when", "barrier", "runtime"}
    if extra:
        raise ConfigError(f"unexpected keys {sorted(extra)} in a stage descriptor")
    if descriptor.get("type") not in STAGES:
        raise ConfigError(f"unknown stage {descriptor.get('type')!r}")
    return STAGES[descriptor["type"]](id=descriptor.get("id"), when=descriptor.get("when"), enabled=descriptor.get("enabled", True), **descriptor.get("options", {}))


def pipeline_from_descriptors(descriptors: str | Sequence[dict]) -> Pipeline:
    return Pipeline([create_stage(d) for d in (json.loads(descriptors) if isinstance(descriptors, str) else descriptors)])


def preset(name: str) -> Pipeline:
    return pipeline_from_descriptors(PRESETS[name])


def pipeline_code(descriptors: Sequence[dict]) -> str:
    """Python that builds the pipeline; options that say the default are left out."""
    lines = []
    for d in descriptors:
        kind = STAGES[d["type"]]
        known = {**BASE, **kind.defaults}
        given = {k: v for k, v in d.get("options", {}).items() if known.get(k) != v}
        args = [f"{k}={v!r}" for k, v in given.items()] + [f"{k}={d[k]!r}" for k in ("id", "when") if k in d] + ([] if d.get("enabled", True) else ["enabled=False"])
        lines.append(f"    {d['type']}({', '.join(args)}),")
    names = ", ".join(sorted({d["type"] for d in descriptors}))
    return f"from pagewright.plans.registry import {names}\nfrom pagewright.plans.stage import Pipeline\n\npipeline = Pipeline([\n" + "\n".join(lines) + "\n])\n"
