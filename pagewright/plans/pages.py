"""Planning pages before the work on them: which pages a row stands for, and runs of rows of one page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def page_numbers(count: Column, page: Column | None = None, limit: int = 0) -> Column:
    """array<int>: the pages to work on, from 0. A row that names a page has that alone, or none if there is no such page."""
    most = F.least(count, F.lit(limit)) if limit > 0 else count
    every = F.when(most > 0, F.sequence(F.lit(0), (most - 1).cast("int"))).otherwise(F.array().cast("array<int>"))
    if page is None:
        return every
    named = F.when((page >= 0) & (page < count), F.array(page.cast("int"))).otherwise(F.array().cast("array<int>"))
    return F.when(page.isNotNull(), named).otherwise(every)


def explode_pages(df: DataFrame, count: str, page: str = "page", limit: int = 0) -> DataFrame:
    """One row for each page. The pages are dealt out before any page is read, as reading is what costs."""
    named = F.col(page) if page in df.columns else None
    rest = [c for c in df.columns if c != page]
    return df.select(*rest, F.explode(page_numbers(F.col(count), named, limit)).alias(page))


def page_runs(df: DataFrame, order: str, keys: list[str], out: str = "unit", within: list[str] | None = None) -> DataFrame:
    """Number the runs of consecutive rows that share their keys."""
    w = Window.partitionBy(*(within or [F.lit(0)])).orderBy(order)
    changed = F.lit(False)
    for k in keys:
        changed = changed | ~F.col(k).eqNullSafe(F.lag(k).over(w))
    first = F.row_number().over(w) == 1
    return df.withColumn("__new", (first | changed).cast("int")).withColumn(out, F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1).drop("__new")


def strip_binary(df: DataFrame) -> DataFrame:
    """Binary columns, and binary fields of structs, replaced by their number of bytes."""
    from pyspark.sql import types as T

    def stripped(c: Column, kind: T.DataType) -> Column:
        if isinstance(kind, T.BinaryType):
            return F.when(c.isNotNull(), F.struct(F.octet_length(c).alias("bytes")))
        if isinstance(kind, T.StructType):
            return F.when(c.isNotNull(), F.struct(*[stripped(c[f.name], f.dataType).alias(f.name) for f in kind.fields]))
        return c

    return df.select(*[stripped(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema.fields])
