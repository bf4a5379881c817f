"""Column types of the document data model, and the records that stand for nothing."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

BOX = "struct<text:string,score:double,x:double,y:double,width:double,height:double,angle:double>"
BOXES = f"array<{BOX}>"
DOCUMENT = f"struct<path:string,text:string,type:string,bboxes:{BOXES},exception:string>"
DETECTION = f"struct<path:string,type:string,bboxes:{BOXES},exception:string>"
ENTITY = f"struct<entity_group:string,score:double,word:string,start:int,end:int,boxes:{BOXES},source:string>"
ENTITIES = f"array<{ENTITY}>"
NER = f"struct<path:string,entities:{ENTITIES},exception:string,json:string>"
IMAGE = "struct<path:string,resolution:int,data:binary,imageType:string,exception:string,height:int,width:int>"
PLACEMENT = f"struct<id:string,width:double,height:double,box:{BOX},matrix:array<double>,effectiveResolution:double,scaleFactor:double>"
SCRIPT = "struct<path:string,type:string,script:string,script_confidence:double,orientation_degrees:double,orientation_confidence:double,presets:array<string>,exception:string>"
TIMES = "struct<stages:map<string,double>,total:double>"
FUZZY_MATCH = "struct<start:int,end:int,cost:double,edits:array<struct<kind:string,index:int>>>"
DETECTED = "struct<x0:double,y0:double,x1:double,y1:double,score:double,class_id:int,label:string>"

#: Kinds of columns that stages declare to read and write.
KINDS = {
    "bytes": "binary", "image": IMAGE, "boxes": DETECTION, "document": DOCUMENT, "ner": NER,
    "orientations": "array<string>", "box": BOX, "script": SCRIPT, "placement": PLACEMENT,
}


# The simple types that the column types are made of, as Arrow names them.
ARROW = {"string": pa.string(), "double": pa.float64(), "int": pa.int32(), "bigint": pa.int64(), "binary": pa.binary(), "boolean": pa.bool_()}


def arrow_type(ddl: str) -> pa.DataType:
    """The Arrow type of a column type written as above."""
    tokens = re.findall(r"\w+|[<>,:]", ddl)

    def read() -> pa.DataType:
        kind = tokens.pop(0)
        if kind not in ("array", "struct"):
            return ARROW[kind]
        tokens.pop(0)  # <
        if kind == "array":
            out = pa.list_(read())
        else:
            fields = []
            while True:
                name = tokens.pop(0)
                tokens.pop(0)  # :
                fields.append(pa.field(name, read()))
                if tokens[0] != ",":
                    break
                tokens.pop(0)
            out = pa.struct(fields)
        tokens.pop(0)  # >
        return out

    return read()


def lit_or(value, default) -> Column:
    return value if isinstance(value, Column) else F.lit(default if value is None else value)


def box(text=None, score=None, x=None, y=None, width=None, height=None, angle=None) -> Column:
    """A BOX from columns or values; what is not given is empty or zero."""
    fields = {"text": (text, ""), "score": (score, 0.0), "x": (x, 0.0), "y": (y, 0.0), "width": (width, 0.0), "height": (height, 0.0), "angle": (angle, 0.0)}
    return F.struct(*[lit_or(v, d).cast("string" if k == "text" else "double").alias(k) for k, (v, d) in fields.items()])


def document(text=None, bboxes=None, path="memory", kind="text", exception="") -> Column:
    boxes = F.array().cast(BOXES) if bboxes is None else bboxes.cast(BOXES)
    return F.struct(lit_or(path, "memory").alias("path"), lit_or(text, "").alias("text"), lit_or(kind, "text").alias("type"), boxes.alias("bboxes"), lit_or(exception, "").alias("exception"))


def detection(bboxes=None, path="memory", kind="detector", exception="") -> Column:
    boxes = F.array().cast(BOXES) if bboxes is None else bboxes.cast(BOXES)
    return F.struct(lit_or(path, "memory").alias("path"), lit_or(kind, "detector").alias("type"), boxes.alias("bboxes"), lit_or(exception, "").alias("exception"))


def ner(entities=None, path="memory", exception="") -> Column:
    """An NER record; its json is that of its entities."""
    found = F.array().cast(ENTITIES) if entities is None else entities.cast(ENTITIES)
    return F.struct(lit_or(path, "memory").alias("path"), found.alias("entities"), lit_or(exception, "").alias("exception"), F.to_json(found).alias("json"))


def image(data=None, path="memory", resolution=0, kind="png", exception="", height=0, width=0) -> Column:
    return F.struct(
        lit_or(path, "memory").alias("path"), lit_or(resolution, 0).cast("int").alias("resolution"), (F.lit(None) if data is None else data).cast("binary").alias("data"),
        lit_or(kind, "png").alias("imageType"), lit_or(exception, "").alias("exception"), lit_or(height, 0).cast("int").alias("height"), lit_or(width, 0).cast("int").alias("width"),
    )


def empty(kind: str, exception="", path="memory") -> Column:
    """The record that a stage writes where it failed."""
    made = {"document": document, "boxes": detection, "ner": ner, "image": image}
    if kind in made:
        return made[kind](path=path, exception=exception)
    return F.lit(None).cast(KINDS[kind])
