"""Affine maps and resolutions of placed images, and addresses of model files, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

POINTS_PER_INCH = 72.0
MOST_UPSCALE = 4.0


def multiply(m: Column, n: Column) -> Column:
    """The map that applies n first and m after it; six numbers each."""
    a, b, c, d, e, f = (F.get(m, i) for i in range(6))
    p, q, r, s, t, u = (F.get(n, i) for i in range(6))
    return F.array(a * p + c * q, b * p + d * q, a * r + c * s, b * r + d * s, a * t + c * u + e, b * t + d * u + f)


def apply(m: Column, x: Column, y: Column) -> Column:
    return F.struct((F.get(m, 0) * x + F.get(m, 2) * y + F.get(m, 4)).alias("x"), (F.get(m, 1) * x + F.get(m, 3) * y + F.get(m, 5)).alias("y"))


def effective_resolution(pixels: Column, points: Column) -> Column:
    """Dots per inch of an image of so many pixels on so many points."""
    return F.when(points > 0, pixels * POINTS_PER_INCH / points).otherwise(0.0)


def upscale_factor(resolution: Column, least: float) -> Column:
    """How much to enlarge an image to reach the least resolution; never less than 1 nor more than 4."""
    return F.when((resolution > 0) & (resolution < least), F.least(F.lit(MOST_UPSCALE), F.lit(float(least)) / resolution)).otherwise(1.0)


def cache_key(repo: Column, revision: Column, path: Column) -> Column:
    return F.concat(repo, F.lit("@"), F.coalesce(revision, F.lit("main")), F.lit("/"), path)


def file_url(host: Column, repo: Column, revision: Column, path: Column) -> Column:
    """Absolute paths as they are; a hub's files by revision; else files below the host."""
    root = F.regexp_replace(host, "/+$", "")
    hub = F.concat(root, F.lit("/"), repo, F.lit("/resolve/"), F.coalesce(revision, F.lit("main")), F.lit("/"), path)
    return F.when(path.rlike("^https?://"), path).when(root.rlike(r"^https?://([^/]*\.)?huggingface\.co"), hub).otherwise(F.concat(root, F.lit("/"), repo, F.lit("/"), path))


def spans_to(n: Column, width: int) -> Column:
    """n x width slots of inclusive (start, end) word spans; slots beyond the last word are (0, 0)."""
    from_start = lambda i: F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda k: F.when(i + k < n, F.struct(i.alias("start"), (i + k).alias("end"))).otherwise(F.struct(F.lit(0).alias("start"), F.lit(0).alias("end"))))
    empty = F.array().cast("array<struct<start:int,end:int>>")
    return F.when(n > 0, F.flatten(F.transform(F.sequence(F.lit(0), (n - 1).cast("int")), from_start))).otherwise(empty)
