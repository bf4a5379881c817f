"""Lines of boxes: grouping, typical sizes, and text that keeps the layout.

The table forms take one row per box and window over a page; the ``*_of`` forms work on plain lists within workers.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def cluster(df: DataFrame, page: list[str], value: str, max_gap, order: list[str], out: str = "group") -> DataFrame:
    """Add the number of a row's group: a new one begins where the value is more than ``max_gap`` above the last."""
    w = Window.partitionBy(*page).orderBy(value, *order)
    gap = max_gap if isinstance(max_gap, Column) else F.lit(max_gap)
    opens = F.coalesce((F.col(value) - F.lag(value).over(w) > gap).cast("int"), F.lit(0))
    return df.withColumn("__opens", opens).withColumn(out, F.sum("__opens").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("int")).drop("__opens")


def size_of(values: Column) -> Column:
    """A typical value of an array: nothing gives 0, one itself, up to four the mean, else the mode of the middle half.

    Means and modes are cut to whole numbers; of several modes the smallest counts.
    """
    ordered = F.array_sort(values.cast("array<double>"))
    n = F.size(ordered)
    drop = F.floor(n / 4).cast("int")
    middle = F.slice(ordered, drop + 1, F.greatest(n - 2 * drop, F.lit(0)))
    start = F.struct(F.lit(None).cast("double").alias("v"), F.lit(0).alias("run"), F.lit(None).cast("double").alias("best"), F.lit(0).alias("most"))

    def step(acc: Column, v: Column) -> Column:
        run = F.when(acc["v"] == v, acc["run"] + 1).otherwise(1)
        better = run > acc["most"]
        return F.struct(v.alias("v"), run.alias("run"), F.when(better, v).otherwise(acc["best"]).alias("best"), F.when(better, run).otherwise(acc["most"]).alias("most"))

    mode = F.aggregate(middle, start, step)["best"]
    mean = F.aggregate(ordered, F.lit(0.0), lambda a, v: a + v) / F.greatest(n, F.lit(1))
    whole = lambda c: c.cast("long").cast("double")
    return F.when(n <= 0, 0.0).when(n == 1, F.get(ordered, 0)).when(n <= 4, whole(mean)).otherwise(whole(mode))


def char_width_of(bboxes: Column) -> Column:
    """The typical width of a character: box widths by text lengths, cut to whole numbers."""
    named = F.filter(bboxes, lambda b: F.length(b["text"]) > 0)
    return size_of(F.transform(named, lambda b: (b["width"] / F.length(b["text"])).cast("long").cast("double")))


def lines(df: DataFrame, page: list[str], pos: str, tolerance=None) -> DataFrame:
    """Add line and nth (place on the line) to boxes with x, y and height.

    Without a tolerance a third of the page's typical height separates lines.
    """
    if tolerance is None:
        heights = df.groupBy(*page).agg((size_of(F.collect_list("height")) / 3).alias("__tolerance"))
        df, limit = df.join(heights, page), F.col("__tolerance")
    else:
        limit = F.lit(tolerance)
    grouped = cluster(df.withColumn("__y", F.col("y").cast("long")), page, "__y", limit, [pos], "line")
    nth = F.row_number().over(Window.partitionBy(*page, "line").orderBy(F.col("x").cast("long"), "__y", pos)) - 1
    return grouped.withColumn("nth", nth).drop("__y", "__tolerance")


def formatted_text(df: DataFrame, page: list[str], pos: str, tolerance=None) -> DataFrame:
    """page, text: lines with their left margins, gaps between words, and blank lines for large vertical gaps."""
    on_line = lines(df, page, pos, tolerance)
    sizes = df.groupBy(*page).agg(
        size_of(F.collect_list("height")).alias("__height"),
        size_of(F.collect_list(F.when(F.length("text") > 0, (F.col("width") / F.greatest(F.length("text"), F.lit(1))).cast("long").cast("double")))).alias("__char"),
    )
    w = Window.partitionBy(*page, "line").orderBy("nth")
    joined = on_line.join(sizes, page)
    space = F.when(F.col("__char") == 0, 1.0).otherwise(F.col("__char"))
    right = F.lag(F.col("x") + F.col("width"), 1, 0.0).over(w)
    spaces = F.greatest(((F.col("x") - right) / space).cast("long"), F.lit(1)).cast("int")
    piece = F.concat(F.repeat(F.lit(" "), spaces), F.col("text"))
    cells = joined.withColumn("piece", piece)
    rows = cells.groupBy(*page, "line").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("nth", "piece"))), lambda s: s["piece"]), "").alias("text"),
        F.min(F.struct("nth", "y"))["y"].alias("top"),
        F.first("__height").alias("height"),
    )
    above = F.lag("top", 1, 0.0).over(Window.partitionBy(*page).orderBy("line"))
    blanks = F.when(F.col("height") > 0, ((F.col("top") - above) / (F.col("height") * 2)).cast("long") - 1).otherwise(F.lit(0))
    full = rows.withColumn("text", F.concat(F.repeat(F.lit("\n"), F.greatest(blanks, F.lit(0)).cast("int")), F.col("text")))
    return full.groupBy(*page).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "text"))), lambda s: s["text"]), "\n").alias("text"))


def bands(df: DataFrame, page: list[str], start: str, end: str) -> DataFrame:
    """page, band, lo, hi: spans that overlap or touch, joined."""
    w = Window.partitionBy(*page).orderBy(start, end)
    reach = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    opens = F.coalesce((F.col(start) > reach).cast("int"), F.lit(0))
    grouped = df.withColumn("__opens", opens).withColumn("band", F.sum("__opens").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("int"))
    return grouped.groupBy(*page, "band").agg(F.min(start).alias("lo"), F.max(end).alias("hi"))


# Plain lists, for stages that work within a worker.


def typical(values: Sequence[float]) -> float:
    ordered = sorted(values)
    if len(ordered) <= 1:
        return ordered[0] if ordered else 0
    if len(ordered) <= 4:
        return int(sum(ordered) / len(ordered))
    cut = len(ordered) // 4
    middle = ordered[cut : len(ordered) - cut]
    return int(max(dict.fromkeys(middle), key=middle.count))


def clusters(items: Sequence, gap: float, key: Callable = lambda x: x) -> list[list]:
    out: list[list] = []
    for item in sorted(items, key=key):
        if out and key(item) - key(out[-1][-1]) <= gap:
            out[-1].append(item)
        else:
            out.append([item])
    return out


def lines_of(boxes: Sequence, tolerance: float = 0) -> list[list]:
    """Boxes (with text, x, y, width, height) in lines, from left to right."""
    limit = tolerance or typical([b["height"] for b in boxes]) / 3
    return [sorted(line, key=lambda b: int(b["x"])) for line in clusters(boxes, limit, lambda b: int(b["y"]))]


def char_width(grouped: Sequence[Sequence]) -> float:
    return typical([int(b["width"] / len(b["text"])) for line in grouped for b in line if b["text"]])


def format_lines(grouped: Sequence[Sequence], height: float) -> str:
    space = char_width(grouped) or 1
    out: list[str] = []
    top = 0
    for line in grouped:
        if not line:
            continue
        step = int((line[0]["y"] - top) / (2 * height)) if height > 0 else 0
        top = line[0]["y"]
        out += [""] * max(0, step - 1)
        text, right = "", 0
        for b in line:
            text += " " * max(1, int((b["x"] - right) / space)) + b["text"]
            right = b["x"] + b["width"]
        out.append(text)
    return "\n".join(out)


def formatted(boxes: Sequence, tolerance: float = 0) -> str:
    return format_lines(lines_of(boxes, tolerance), typical([b["height"] for b in boxes])) if boxes else ""
