"""The operators as queries over the test tables, each beside the SQL that gives the same rows.

Where a page of boxes is needed, an order is a page and its line items are its boxes; entities come from events.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import boxes as B
from .functions import geometry_columns as G
from .functions import presets, validators
from .functions.conditions import compile_condition, usable_text_layer, validate, where
from .functions.fuzzy import FuzzyPattern, Match
from .functions.text import chunks, fold, mostly_uppercase, texts_agree
from .operators import entities as E
from .operators import layout, merging, patterns
from .operators.words import as_document, pieces, word_offsets
from .plans import errors, pages, registry
from .plans.stage import Run
from .schemas import BOXES, box, detection, document

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn

    return add


def r6(c: Column) -> Column:
    return F.round(c, 6)


# ---- derived inputs ---------------------------------------------------------------------------------------------

BOX_ORDER = ("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")

BOX_ROWS = """
box_rows AS (
  SELECT l_orderkey AS page,
    row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS pos,
    CAST(l_partkey % 200 AS DOUBLE) AS x, CAST(l_suppkey % 200 AS DOUBLE) AS y, 2 * l_quantity AS width, l_quantity AS height,
    l_discount AS score, CAST(4 * (l_partkey % 5) AS DOUBLE) AS angle, l_returnflag AS flag, l_linestatus AS status
  FROM lineitem)"""


def page_boxes(spark: SparkSession, sf_dir: str, angle: bool = False) -> DataFrame:
    """page, bboxes, flags: one row per order; a box's text is its number."""
    quantity = F.col("l_quantity")
    lean = (4 * (F.col("l_partkey") % 5)).cast("double") if angle else F.lit(0.0)
    made = box(None, F.col("l_discount"), (F.col("l_partkey") % 200).cast("double"), (F.col("l_suppkey") % 200).cast("double"), 2 * quantity, quantity, lean)
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("page"), F.struct(*BOX_ORDER, made.alias("b"), F.col("l_returnflag").alias("flag")).alias("s"))
    ordered = rows.groupBy("page").agg(F.array_sort(F.collect_list("s")).alias("s"))
    return ordered.select("page", F.transform("s", lambda s, i: s["b"].withField("text", i.cast("string"))).cast(BOXES).alias("bboxes"), F.transform("s", lambda s: s["flag"]).alias("flags"))


def box_rows(spark: SparkSession, sf_dir: str, angle: bool = False) -> DataFrame:
    wide = page_boxes(spark, sf_dir, angle).select("page", F.posexplode("bboxes").alias("pos", "b"))
    return wide.select("page", "pos", "b")


def pairs(spark: SparkSession, sf_dir: str, angle: bool = False) -> DataFrame:
    """page, i, j, a, b: each two boxes of a page (a page has a few)."""
    p = page_boxes(spark, sf_dir, angle)
    first = p.select("page", "bboxes", F.posexplode("bboxes").alias("i", "a"))
    return first.select("page", "i", "a", F.posexplode("bboxes").alias("j", "b")).where("i < j")


PAIRS = f"""WITH {BOX_ROWS}, pairs AS (
  SELECT a.page, a.pos AS i, b.pos AS j, a.x AS ax, a.y AS ay, a.width AS aw, a.height AS ah, a.angle AS aa,
    b.x AS bx, b.y AS by_, b.width AS bw, b.height AS bh, b.angle AS ba,
    least(a.x + a.width, b.x + b.width) - greatest(a.x, b.x) AS ow,
    least(a.y + a.height, b.y + b.height) - greatest(a.y, b.y) AS oh
  FROM box_rows a JOIN box_rows b ON a.page = b.page AND a.pos < b.pos)"""


def text_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("text"))


def each(df: DataFrame, key: str, array: str) -> DataFrame:
    """key, e: one row for each element. The outer form keeps the optimizer from testing the array's size below a shuffle,
    for which functions that make it would run twice."""
    return df.select(key, F.explode_outer(array).alias("e")).where(F.col("e").isNotNull())


def dealt_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents for work that is much more than reading: a table of fewer parts than cores is dealt to all cores."""
    docs, cores = text_documents(spark, sf_dir), spark.sparkContext.defaultParallelism
    return docs.repartition(cores, "doc_id") if docs.rdd.getNumPartitions() < cores else docs


def dealt(df: DataFrame, key: str) -> DataFrame:
    """Rows that are small, but much work each: as many pieces as keep all cores busy, however few files they come from."""
    return df.repartition(4 * df.sparkSession.sparkContext.defaultParallelism, key)


def digits(width: int) -> Column:
    return F.lpad((F.col("l_orderkey") * 1000003 + F.col("l_partkey")).cast("string"), width, "4")


def number_rows(spark: SparkSession, sf_dir: str, width: int) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", digits(width).alias("s"))


# ---- predicates -------------------------------------------------------------------------------------------------

MIXED = {"any": [{"all": [{"path": "o_orderstatus", "eq": "F"}, {"path": "o_totalprice", "gt": 250000}]}, {"not": {"path": "o_orderpriority", "in": ["1-URGENT", "2-HIGH", "3-MEDIUM", "5-LOW"]}}]}


@query("SELECT o_orderstatus, count(*) AS n FROM orders WHERE (o_orderstatus = 'F' AND o_totalprice > 250000) OR NOT (o_orderpriority IN ('1-URGENT', '2-HIGH', '3-MEDIUM', '5-LOW')) GROUP BY o_orderstatus")
def cond_all_any_not(spark: SparkSession, sf_dir: str) -> DataFrame:
    return where(table(spark, sf_dir, "orders"), MIXED).groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT event_type, count(*) AS n FROM events WHERE event_type IN ('click', 'view') GROUP BY event_type")
def cond_in(spark: SparkSession, sf_dir: str) -> DataFrame:
    # a number among the values matches no string
    return where(table(spark, sf_dir, "events"), {"path": "event_type", "in": ["click", "view", 3]}).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT count(*) AS n, CAST(sum(o_custkey) AS BIGINT) AS keys FROM orders WHERE o_totalprice >= 100000 AND o_totalprice < 200000 AND o_custkey <> 5")
def cond_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = where(table(spark, sf_dir, "orders"), {"all": [{"path": "o_totalprice", "gte": 100000, "lt": 200000}, {"path": "o_custkey", "ne": 5}]})
    return found.agg(F.count(F.lit(1)).alias("n"), F.sum("o_custkey").alias("keys"))


@query("""SELECT count(*) FILTER (o_totalprice > 200000) AS there, count(*) FILTER (o_totalprice <= 200000) AS missing, CAST(0 AS BIGINT) AS other, count(*) AS absent
FROM orders""")
def cond_exists(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select(F.when(F.col("o_totalprice") > 200000, F.struct(F.col("o_orderstatus").alias("status"))).alias("doc"))
    count = lambda c, v=None: F.count(F.when(compile_condition(c, rows.schema, v), 1))
    return rows.agg(
        count({"path": "doc.status", "exists": True}).alias("there"),
        count({"path": "doc.status", "exists": False}).alias("missing"),
        count({"path": "doc.nowhere", "ne": 1}).alias("other"),
        count({"all": [{"path": "doc.nowhere", "exists": False}, {"var": "forced", "truthy": True}]}, {"forced": True}).alias("absent"),
    )


@query("SELECT length(o_orderpriority) AS size, count(*) AS n FROM orders WHERE length(o_orderpriority) >= 6 GROUP BY 1")
def cond_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    return where(table(spark, sf_dir, "orders"), {"path": "o_orderpriority.length", "gte": 6}).groupBy(F.length("o_orderpriority").cast("long").alias("size")).agg(F.count(F.lit(1)).alias("n"))


@query("""WITH w AS (SELECT doc_id, len(list_filter(string_split(text, ' '), lambda x: x <> '')) AS n FROM documents)
SELECT n >= 100 AS usable, count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS n_boxes FROM w GROUP BY 1""")
def usable_layer(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = as_document(dealt_documents(spark, sf_dir), "doc_id", "text")
    usable = compile_condition(validate(usable_text_layer("document", 100)), docs.schema)
    return docs.groupBy(usable.alias("usable")).agg(F.count(F.lit(1)).alias("n_docs"), F.sum(F.size("document.bboxes")).alias("n_boxes"))


@query("""SELECT event_type, count(*) FILTER (value > 5) AS applied, count(*) FILTER (NOT value > 5) AS untouched,
  round(sum(CASE WHEN value > 5 THEN 2 * value ELSE value END), 4) AS total FROM events GROUP BY event_type""")
def conditional_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    on = compile_condition({"path": "value", "gt": 5}, events.schema)
    done = events.withColumn("out", F.when(on, F.col("value") * 2).otherwise(F.col("value"))).withColumn("on", on)
    return done.groupBy("event_type").agg(F.count(F.when(F.col("on"), 1)).alias("applied"), F.count(F.when(~F.col("on"), 1)).alias("untouched"), F.round(F.sum("out"), 4).alias("total"))


# ---- pages and sources ------------------------------------------------------------------------------------------

COUNTED = "counted AS (SELECT l_orderkey AS doc, CAST(count(*) AS INTEGER) AS n FROM lineitem GROUP BY l_orderkey)"


def counted_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("doc")).agg(F.count(F.lit(1)).cast("int").alias("n"))


@query(f"WITH {COUNTED} SELECT doc, n, CAST(unnest(range(n)) AS INTEGER) AS page FROM counted")
def page_explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.explode_pages(counted_pages(spark, sf_dir), "n")


@query(f"WITH {COUNTED} SELECT doc, n, CAST(unnest(range(least(n, 3))) AS INTEGER) AS page FROM counted")
def page_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.explode_pages(counted_pages(spark, sf_dir), "n", limit=3)


@query(f"""WITH {COUNTED} SELECT doc, n, CAST(doc % 5 AS INTEGER) AS page FROM counted WHERE doc % 3 <> 0 AND doc % 5 < n
UNION ALL SELECT doc, n, CAST(unnest(range(n)) AS INTEGER) FROM counted WHERE doc % 3 = 0""")
def page_pruning(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = counted_pages(spark, sf_dir).withColumn("page", F.when(F.col("doc") % 3 != 0, F.col("doc") % 5).cast("int"))
    return pages.explode_pages(named, "n").select("doc", "n", "page")


@query("""WITH o AS (SELECT user_id, event_id, event_type, CASE WHEN event_type IS DISTINCT FROM lag(event_type) OVER w OR row_number() OVER w = 1 THEN 1 ELSE 0 END AS opens
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
u AS (SELECT user_id, event_type, sum(opens) OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS unit FROM o)
SELECT user_id, CAST(unit AS BIGINT) AS unit, event_type, count(*) AS n FROM u GROUP BY ALL""")
def split_by_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = pages.page_runs(table(spark, sf_dir, "events"), "event_id", ["event_type"], within=["user_id"])
    return runs.groupBy("user_id", "unit", "event_type").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT doc_id, octet_length(encode(text)) AS data_bytes, lang FROM documents")
def strip_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", F.struct(F.col("text").cast("binary").alias("data"), F.col("lang").alias("lang")).alias("image"))
    return pages.strip_binary(rows).select("doc_id", F.col("image.data.bytes").cast("long").alias("data_bytes"), F.col("image.lang").alias("lang"))


@query("""SELECT o_orderstatus AS status, CASE o_orderstatus WHEN 'O' THEN '' WHEN 'F' THEN 'This page has no embedded images to read.' ELSE 'Upstream stage failed: bad scan' END AS exception, count(*) AS n
FROM orders GROUP BY ALL""")
def upstream_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    reason = F.when(F.col("o_orderstatus") == "O", "").when(F.col("o_orderstatus") == "F", errors.NO_EMBEDDED_IMAGES).otherwise("bad scan")
    docs = table(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("status"), document(F.lit("x"), exception=reason).alias("doc"))
    out = F.when(F.col("doc.exception") == "", document(F.upper("doc.text"))).otherwise(document(exception=errors.upstream(F.col("doc.exception"))))
    return docs.select("status", out["exception"].alias("exception")).groupBy("status", "exception").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT event_type, count(*) AS rows_in, count(*) FILTER (value > 10) AS matched, count(*) FILTER (props IS NULL) AS failed,
  quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95 FROM events GROUP BY event_type""")
def run_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    return events.groupBy("event_type").agg(
        F.count(F.lit(1)).alias("rows_in"), F.count(F.when(F.col("value") > 10, 1)).alias("matched"), F.count(F.when(F.col("props").isNull(), 1)).alias("failed"),
        F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY value)").alias("p50"), F.expr("percentile_disc(0.95) WITHIN GROUP (ORDER BY value)").alias("p95"),
    )


# ---- text -------------------------------------------------------------------------------------------------------


@query("""WITH w AS (SELECT doc_id, CASE WHEN length(text) = 0 THEN -1 WHEN length(text) <= 500 THEN 0 ELSE (length(text) - 500) // 480 + 1 END AS most, text FROM documents),
c AS (SELECT doc_id, unnest(range(0, 480 * most + 1, 480)) AS o, text FROM w WHERE most >= 0)
SELECT doc_id, CAST(o AS INTEGER) AS chunk_offset, md5(substring(text, o + 1, 500)) AS digest FROM c WHERE length(text) > o""")
def chunk_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = text_documents(spark, sf_dir).select("doc_id", F.explode(chunks(F.col("text"))).alias("c"))
    return cut.select("doc_id", F.col("c.offset").alias("chunk_offset"), F.md5(F.col("c.text").cast("binary")).alias("digest"))


@query("""WITH w AS (SELECT doc_id, string_split(text, ' ') AS words FROM documents),
e AS (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) - 1 AS pos FROM w),
s AS (SELECT doc_id, pos, word, coalesce(sum(length(word) + 1) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM e)
SELECT doc_id, count(*) AS n, CAST(sum(start * (pos % 7 + 1)) AS BIGINT) AS weighted, CAST(max(start + length(word)) AS BIGINT) AS last FROM s GROUP BY doc_id""")
def word_split_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = word_offsets(dealt_documents(spark, sf_dir), "doc_id", "text")
    return words.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("start") * (F.col("pos") % 7 + 1)).cast("long").alias("weighted"), F.max(F.col("start") + F.length("word")).cast("long").alias("last"))


@query(r"SELECT doc_id, md5(trim(regexp_replace(lower(text), '\s+', ' ', 'g'))) AS digest FROM documents")
def fold_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_documents(spark, sf_dir).select("doc_id", F.md5(fold(F.col("text")).cast("binary")).alias("digest"))


@query(r"""WITH c AS (SELECT doc_id, len(regexp_extract_all(text, '\p{L}')) AS letters, len(regexp_extract_all(text, '\p{Lu}')) AS upper FROM documents)
SELECT doc_id, letters > 0 AND upper > 0.6 * letters AS shouting FROM c""")
def uppercase_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_documents(spark, sf_dir).select("doc_id", mostly_uppercase(F.col("text")).alias("shouting"))


EMAIL = r"[\p{L}\p{N}._%+-]+@[\p{L}\p{N}-]+(?:\.[\p{L}\p{N}-]+)*\.[A-Za-z]{2,24}"
PHONE = r"\+[0-9]{1,3} \([0-9]{2,4}\) [0-9]{3}-[0-9]{4}"


@query(f"SELECT doc_id, unnest(regexp_extract_all(text, '{EMAIL}')) AS word FROM documents")
def email_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    # the cheap test keeps texts without the sign away from the pattern
    rows = text_documents(spark, sf_dir).where(F.contains("text", F.lit("@")))
    return rows.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(EMAIL), F.lit(0))).alias("word"))


@query(rf"SELECT lang, unnest(regexp_extract_all(text, '{PHONE}')) AS word FROM documents")
def phone_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").where(F.contains("text", F.lit("+")))
    return rows.select("lang", F.explode(F.regexp_extract_all("text", F.lit(PHONE), F.lit(0))).alias("word"))


@query("SELECT regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1) AS host, count(*) AS n FROM pages GROUP BY 1")
def url_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").groupBy(F.regexp_extract("url", "^[a-z]+://([^/:?#]+)", 1).alias("host")).agg(F.count(F.lit(1)).alias("n"))


# ---- validators -------------------------------------------------------------------------------------------------

NUMBERS = "n AS (SELECT l_orderkey, l_linenumber, l_partkey, lpad(CAST(l_orderkey * 1000003 + l_partkey AS VARCHAR), {w}, '4') AS s FROM lineitem)"


@query(f"""WITH {NUMBERS.format(w=16)} SELECT l_orderkey, l_partkey, s,
  list_sum(list_transform(range(16), lambda i: CASE WHEN i % 2 = 1 THEN CAST(substr(s, 16 - i, 1) AS INTEGER) * 2 // 10 + CAST(substr(s, 16 - i, 1) AS INTEGER) * 2 % 10 ELSE CAST(substr(s, 16 - i, 1) AS INTEGER) END)) % 10 = 0 AS ok
FROM n""")
def validate_luhn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return number_rows(spark, sf_dir, 16).select("l_orderkey", "l_partkey", "s", validators.luhn(F.col("s")).alias("ok"))


@query(f"""WITH {NUMBERS.format(w=9)} SELECT l_orderkey, l_partkey, s,
  length(s) = 9 AND s[1:3] NOT IN ('000', '666') AND s[1:1] <> '9' AND s[4:5] <> '00' AND s[6:9] <> '0000' AS ok FROM n""")
def validate_ssn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return number_rows(spark, sf_dir, 9).select("l_orderkey", "l_partkey", "s", validators.ssn(F.col("s")).alias("ok"))


@query(f"""WITH {NUMBERS.format(w=11)}, d AS (SELECT *, CAST(s[1:2] AS INTEGER) AS yy, CAST(s[3:4] AS INTEGER) AS mm, CAST(s[5:6] AS INTEGER) AS dd,
  list_sum(list_transform(range(1, 11), lambda i: CAST(substr(s, i, 1) AS INTEGER) * CAST(substr('1379137913', i, 1) AS INTEGER))) AS total FROM n),
y AS (SELECT *, CASE WHEN mm > 80 THEN 1800 ELSE 1900 + 100 * (mm // 20) END + yy AS year, mm % 20 AS month FROM d)
SELECT l_orderkey, l_partkey, s, length(s) = 11 AND (10 - total % 10) % 10 = CAST(s[11:11] AS INTEGER) AND month BETWEEN 1 AND 12 AND dd >= 1
  AND dd <= CASE WHEN month BETWEEN 1 AND 12 THEN day(last_day(make_date(year, month, 1))) ELSE 0 END AS ok FROM y""")
def validate_pesel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return number_rows(spark, sf_dir, 11).select("l_orderkey", "l_partkey", "s", validators.pesel(F.col("s")).alias("ok"))


@query("""WITH n AS (SELECT l_orderkey, l_partkey, 'DE' || lpad(CAST(l_partkey % 100 AS VARCHAR), 2, '0') || lpad(CAST(l_orderkey * 1000003 + l_partkey AS VARCHAR), 18, '4') AS s FROM lineitem)
SELECT l_orderkey, l_partkey, s, length(s) = 22 AND CAST(s[5:] || '1314' || s[3:4] AS HUGEINT) % 97 = 1 AS ok FROM n""")
def validate_iban(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = F.concat(F.lit("DE"), F.lpad((F.col("l_partkey") % 100).cast("string"), 2, "0"), digits(18))
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", made.alias("s"))
    return rows.select("l_orderkey", "l_partkey", "s", validators.iban(F.col("s")).alias("ok"))


@query("""WITH n AS (SELECT l_orderkey, l_partkey, 1990 + l_partkey % 40 AS y, l_orderkey % 14 AS m, l_suppkey % 33 AS d FROM lineitem)
SELECT l_orderkey, l_partkey, m BETWEEN 1 AND 12 AND d >= 1 AND d <= CASE WHEN m BETWEEN 1 AND 12 THEN day(last_day(make_date(CAST(y AS INTEGER), CAST(m AS INTEGER), 1))) ELSE 0 END AS ok FROM n""")
def validate_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    y, m, d = (1990 + F.col("l_partkey") % 40).cast("int"), (F.col("l_orderkey") % 14).cast("int"), (F.col("l_suppkey") % 33).cast("int")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", validators.date(y, m, d).alias("ok"))


# ---- boxes ------------------------------------------------------------------------------------------------------


@query(f"{PAIRS} SELECT page, i, j, round(CASE WHEN ow <= 0 OR oh <= 0 THEN 0 ELSE ow * oh / (aw * ah + bw * bh - ow * oh) END, 10) AS iou FROM pairs")
def box_iou(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs(spark, sf_dir).select("page", F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"), F.round(B.iou(F.col("a"), F.col("b")), 10).alias("iou"))


@query(f"{PAIRS} SELECT page, i, j, round(CASE WHEN ow <= 0 OR oh <= 0 THEN 0 ELSE ow * oh / (aw * ah) END, 10) AS share FROM pairs")
def box_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs(spark, sf_dir).select("page", F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"), F.round(B.coverage(F.col("a"), F.col("b")), 10).alias("share"))


@query(f"""{PAIRS}, d AS (SELECT *, bx + bw / 2 - ax - aw / 2 AS dx, by_ + bh / 2 - ay - ah / 2 AS dy FROM pairs)
SELECT page, i, j, abs(aa - ba) <= 10 AND (ah + bh) / 2 > 0 AND
  CASE WHEN abs(aa) < 10 THEN abs(dy) ELSE abs(dy * cos(radians(aa)) - dx * sin(radians(aa))) END < (ah + bh) / 4 AS same FROM d""")
def same_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs(spark, sf_dir, angle=True).select("page", F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"), B.same_line(F.col("a"), F.col("b")).alias("same"))


@query(f"""WITH {BOX_ROWS} SELECT page, CAST(pos AS BIGINT) AS pos, floor(x * 0.37 - 2 + 0.5) AS x, floor(y * 0.37 - 2 + 0.5) AS y, floor(width * 0.37 + 2 + 0.5) AS width, floor(height * 0.37 + 2 + 0.5) AS height FROM box_rows""")
def scale_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = box_rows(spark, sf_dir).select("page", F.col("pos").cast("long").alias("pos"), B.scale(F.col("b"), 0.37, 2.0).alias("s"))
    return s.select("page", "pos", *[F.col(f"s.{c}").alias(c) for c in ("x", "y", "width", "height")])


@query(f"""WITH {BOX_ROWS} SELECT page, concat_ws('|', CAST(pos AS VARCHAR), CAST(CAST(floor(x + 0.5) AS BIGINT) AS VARCHAR), CAST(CAST(floor(y + 0.5) AS BIGINT) AS VARCHAR),
  CAST(CAST(floor(width + 0.5) AS BIGINT) AS VARCHAR), CAST(CAST(floor(height + 0.5) AS BIGINT) AS VARCHAR)) AS identity FROM box_rows""")
def box_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return box_rows(spark, sf_dir).select("page", B.identity(F.col("b")).alias("identity"))


@query(f"""{PAIRS} SELECT page, i, j, least(ax, bx) AS x, least(ay, by_) AS y, greatest(ax + aw, bx + bw) - least(ax, bx) AS width,
  greatest(ay + ah, by_ + bh) - least(ay, by_) AS height, i || ' ' || j AS text FROM pairs""")
def merge_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = pairs(spark, sf_dir).select("page", F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"), B.merge_upright(F.col("a"), F.col("b")).alias("m"))
    return m.select("page", "i", "j", *[F.col(f"m.{c}").alias(c) for c in ("x", "y", "width", "height", "text")])


@query(f"""WITH {BOX_ROWS} SELECT r.page, CAST(r.pos AS BIGINT) AS pos, count(b.pos) AS n FROM box_rows r LEFT JOIN box_rows b ON r.page = b.page
  AND b.x + b.width / 2 BETWEEN r.x AND r.x + r.width AND b.y + b.height / 2 BETWEEN r.y AND r.y + r.height GROUP BY 1, 2""")
def covering_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = page_boxes(spark, sf_dir).select("page", "bboxes", F.posexplode("bboxes").alias("pos", "region"))
    return p.select("page", F.col("pos").cast("long").alias("pos"), B.covering(F.col("bboxes"), F.col("region")).cast("long").alias("n"))


COVERS = """least({a}.x + {a}.width, {b}.x + {b}.width) - greatest({a}.x, {b}.x) > 0 AND least({a}.y + {a}.height, {b}.y + {b}.height) - greatest({a}.y, {b}.y) > 0
  AND (least({a}.x + {a}.width, {b}.x + {b}.width) - greatest({a}.x, {b}.x)) * (least({a}.y + {a}.height, {b}.y + {b}.height) - greatest({a}.y, {b}.y)) / ({a}.width * {a}.height) >= {t}"""


@query(f"""WITH {BOX_ROWS}, kept AS (SELECT * FROM box_rows a WHERE NOT EXISTS (SELECT 1 FROM box_rows b WHERE b.page = a.page AND b.pos <> a.pos
  AND (b.width * b.height > a.width * a.height OR (b.width * b.height = a.width * a.height AND b.pos < a.pos)) AND {COVERS.format(a="a", b="b", t=0.6)}))
SELECT page, string_agg(CAST(pos AS VARCHAR), ' ' ORDER BY pos) AS kept FROM kept GROUP BY page""")
def drop_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_boxes(spark, sf_dir).select("page", B.text_of(B.drop_nested(F.col("bboxes"))).alias("kept"))


@query(f"""WITH {BOX_ROWS}, kept AS (SELECT * FROM box_rows a WHERE flag <> 'R' AND NOT EXISTS (SELECT 1 FROM box_rows b WHERE b.page = a.page AND b.flag = 'R' AND {COVERS.format(a="a", b="b", t=0.5)}))
SELECT page, coalesce(string_agg(CAST(pos AS VARCHAR), ' ' ORDER BY pos) FILTER (flag IS NOT NULL), '') AS kept
FROM (SELECT page, pos, flag FROM kept UNION ALL SELECT DISTINCT page, NULL, NULL FROM box_rows) GROUP BY page""")
def drop_covered(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = page_boxes(spark, sf_dir)
    flagged = F.arrays_zip(F.col("bboxes").alias("b"), F.col("flags").alias("f"))
    pick = lambda on: F.transform(F.filter(flagged, lambda z: (z["f"] == "R") if on else (z["f"] != "R")), lambda z: z["b"])
    return p.withColumn("layer", pick(True)).withColumn("read", pick(False)).select("page", B.text_of(B.drop_covered(F.col("read"), F.col("layer"))).alias("kept"))


@query(f"""WITH {BOX_ROWS}, near AS (SELECT a.page, a.pos, a.x, a.width, 0.3 * a.height AS reach,
    min(greatest(a.x - b.x - b.width, 0)) FILTER (b.x + b.width / 2 < a.x + a.width / 2) AS l, min(greatest(b.x - a.x - a.width, 0)) FILTER (b.x + b.width / 2 >= a.x + a.width / 2) AS r
  FROM box_rows a LEFT JOIN box_rows b ON a.page = b.page AND a.pos <> b.pos AND least(a.y + a.height, b.y + b.height) - greatest(a.y, b.y) >= least(a.height, b.height) / 2
  GROUP BY ALL)
SELECT page, CAST(pos AS BIGINT) AS pos, round(x - least(reach, coalesce(l, reach)), 6) AS x, round(width + least(reach, coalesce(l, reach)) + least(reach, coalesce(r, reach)), 6) AS width FROM near""")
def extend_along_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = page_boxes(spark, sf_dir).select("page", F.posexplode(B.extend_along(F.col("bboxes"), 0.3)).alias("pos", "b"))
    return e.select("page", F.col("pos").cast("long").alias("pos"), r6(F.col("b.x")).alias("x"), r6(F.col("b.width")).alias("width"))


@query(f"""WITH {BOX_ROWS} SELECT page, string_agg(CAST(pos AS VARCHAR), ' ' ORDER BY pos) AS text, CAST(count(*) FILTER (score >= 0.05) AS INTEGER) AS sure,
  string_agg(CAST(pos AS VARCHAR) || ':' || format('{{:.2f}}', score), ',' ORDER BY pos) AS labels FROM box_rows GROUP BY page""")
def box_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = F.array_join(F.transform("bboxes", lambda b: B.label(b, ["text", "score"])), ",")
    return page_boxes(spark, sf_dir).select("page", B.text_of(F.col("bboxes")).alias("text"), F.size(B.above_score(F.col("bboxes"), 0.05)).alias("sure"), labels.alias("labels"))


@query(f"""WITH {BOX_ROWS} SELECT page, CAST(pos AS BIGINT) AS pos, '<rect x="' || CAST(x AS BIGINT) || '" y="' || CAST(y AS BIGINT) || '" width="' || CAST(width AS BIGINT) || '" height="' || CAST(height AS BIGINT) ||
  '" fill="none" stroke="#ff2d55" stroke-width="2"' || CASE WHEN angle <> 0 THEN ' transform="rotate(' || CAST(angle AS BIGINT) || ' ' || CAST(x + width / 2 AS BIGINT) || ' ' ||
  regexp_replace(format('{{:.1f}}', y + height / 2), '\\.0$', '') || ')"' ELSE '' END || '/>' AS svg FROM box_rows""")
def box_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return box_rows(spark, sf_dir, angle=True).select("page", F.col("pos").cast("long").alias("pos"), B.overlay(F.col("b")).alias("svg"))


NMS = f"""WITH RECURSIVE {BOX_ROWS}, ranked AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY score DESC, pos) AS rn, CAST(x % 2 AS INTEGER) AS class_id FROM box_rows),
walk AS (
  SELECT page, rn, [struct_pack(pos := pos, c := class_id, x := x, y := y, w := width, h := height)] AS kept FROM ranked WHERE rn = 1
  UNION ALL
  SELECT r.page, r.rn, CASE WHEN len(list_filter(k.kept, lambda o: o.c = r.class_id AND
      greatest(least(o.x + o.w, r.x + r.width) - greatest(o.x, r.x), 0) * greatest(least(o.y + o.h, r.y + r.height) - greatest(o.y, r.y), 0) >
      0.2 * (o.w * o.h + r.width * r.height - greatest(least(o.x + o.w, r.x + r.width) - greatest(o.x, r.x), 0) * greatest(least(o.y + o.h, r.y + r.height) - greatest(o.y, r.y), 0)))) > 0
    THEN k.kept ELSE list_append(k.kept, struct_pack(pos := r.pos, c := r.class_id, x := r.x, y := r.y, w := r.width, h := r.height)) END
  FROM walk k JOIN ranked r ON r.page = k.page AND r.rn = k.rn + 1)
SELECT page, array_to_string(list_transform(arg_max(kept, rn), lambda o: CAST(o.pos AS VARCHAR)), ' ') AS kept FROM walk GROUP BY page"""


@query(NMS)
def nms_per_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = F.transform("bboxes", lambda b: F.struct(b["x"].alias("x0"), b["y"].alias("y0"), (b["x"] + b["width"]).alias("x1"), (b["y"] + b["height"]).alias("y1"), b["score"].alias("score"), (b["x"] % 2).cast("int").alias("class_id"), b["text"].alias("label")))
    kept = B.non_maximum_suppression(found, 0.2)
    return page_boxes(spark, sf_dir).select("page", F.array_join(F.transform(kept, lambda d: d["label"]), " ").alias("kept"))


# ---- layout -----------------------------------------------------------------------------------------------------

LINES = f"""{BOX_ROWS},
heights AS (SELECT page, height, row_number() OVER (PARTITION BY page ORDER BY height) AS rn, count(*) OVER (PARTITION BY page) AS n FROM box_rows),
modes AS (SELECT page, height, count(*) AS c FROM heights WHERE rn > n // 4 AND rn <= n - n // 4 GROUP BY ALL),
size_of AS (SELECT h.page, CASE WHEN any_value(n) = 1 THEN any_value(h.height) WHEN any_value(n) <= 4 THEN trunc(sum(h.height) / any_value(n))
  ELSE trunc((SELECT arg_max(m.height, m.c * 1000 - m.height) FROM modes m WHERE m.page = h.page)) END AS size FROM heights h GROUP BY h.page),
opened AS (SELECT b.*, s.size, CASE WHEN trunc(y) - lag(trunc(y)) OVER w > s.size / 3 THEN 1 ELSE 0 END AS opens FROM box_rows b JOIN size_of s USING (page) WINDOW w AS (PARTITION BY page ORDER BY trunc(y), pos)),
on_line AS (SELECT *, sum(opens) OVER (PARTITION BY page ORDER BY trunc(y), pos ROWS UNBOUNDED PRECEDING) AS line FROM opened),
placed AS (SELECT *, row_number() OVER (PARTITION BY page, line ORDER BY trunc(x), trunc(y), pos) - 1 AS nth FROM on_line)"""


def flat_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return box_rows(spark, sf_dir).select("page", "pos", "b.*")


@query(f"WITH {LINES} SELECT page, CAST(pos AS BIGINT) AS pos, CAST(line AS BIGINT) AS line, nth FROM placed")
def cluster_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = layout.lines(flat_boxes(spark, sf_dir), ["page"], "pos")
    return placed.select("page", F.col("pos").cast("long").alias("pos"), F.col("line").cast("long").alias("line"), F.col("nth").cast("long").alias("nth"))


@query(f"WITH {LINES} SELECT page, size FROM size_of")
def get_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_boxes(spark, sf_dir).select("page", layout.size_of(F.transform("bboxes", lambda b: b["height"])).alias("size"))


CHARS = """chars AS (SELECT page, trunc(width / length(CAST(pos AS VARCHAR))) AS w, row_number() OVER (PARTITION BY page ORDER BY trunc(width / length(CAST(pos AS VARCHAR)))) AS rn, count(*) OVER (PARTITION BY page) AS n FROM box_rows),
char_modes AS (SELECT page, w, count(*) AS c FROM chars WHERE rn > n // 4 AND rn <= n - n // 4 GROUP BY ALL),
char_size AS (SELECT c.page, CASE WHEN any_value(n) = 1 THEN any_value(c.w) WHEN any_value(n) <= 4 THEN trunc(sum(c.w) / any_value(n))
  ELSE (SELECT arg_max(m.w, m.c * 1000 - m.w) FROM char_modes m WHERE m.page = c.page) END AS size FROM chars c GROUP BY c.page)"""


@query(f"WITH {BOX_ROWS}, {CHARS} SELECT page, size AS width FROM char_size")
def char_width(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_boxes(spark, sf_dir).select("page", layout.char_width_of(F.col("bboxes")).alias("width"))


@query(f"""WITH {LINES}, {CHARS},
pieces AS (SELECT p.*, repeat(' ', CAST(greatest(trunc((x - lag(x + width, 1, 0) OVER (PARTITION BY p.page, line ORDER BY nth)) / CASE WHEN c.size = 0 THEN 1 ELSE c.size END), 1) AS INTEGER)) || CAST(pos AS VARCHAR) AS piece
  FROM placed p JOIN char_size c USING (page)),
rows_ AS (SELECT page, line, string_agg(piece, '' ORDER BY nth) AS text, arg_min(y, nth) AS top, any_value(size) AS height FROM pieces GROUP BY page, line),
gaps AS (SELECT *, CASE WHEN height > 0 THEN CAST(trunc((top - lag(top, 1, 0) OVER (PARTITION BY page ORDER BY line)) / (2 * height)) AS INTEGER) - 1 ELSE 0 END AS blanks FROM rows_)
SELECT page, string_agg(repeat(chr(10), greatest(blanks, 0)) || text, chr(10) ORDER BY line) AS text FROM gaps GROUP BY page""")
def lines_formatted_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.formatted_text(flat_boxes(spark, sf_dir), ["page"], "pos")


@query(f"""WITH {BOX_ROWS}, o AS (SELECT *, CASE WHEN y > max(y + height) OVER (PARTITION BY page ORDER BY y, y + height, pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 1 ELSE 0 END AS opens FROM box_rows),
b AS (SELECT *, sum(opens) OVER (PARTITION BY page ORDER BY y, y + height, pos ROWS UNBOUNDED PRECEDING) AS band FROM o)
SELECT page, CAST(band AS BIGINT) AS band, min(y) AS lo, max(y + height) AS hi FROM b GROUP BY ALL""")
def fit_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = flat_boxes(spark, sf_dir).withColumn("end", F.col("y") + F.col("height"))
    return layout.bands(spans, ["page"], "y", "end").withColumn("band", F.col("band").cast("long"))


@query(f"""WITH {BOX_ROWS}, r AS (SELECT page, pos, row_number() OVER (PARTITION BY page ORDER BY width * height DESC, pos) AS rn FROM box_rows)
SELECT page, string_agg(CAST(pos AS VARCHAR), ' ' ORDER BY rn) AS largest FROM r WHERE rn <= 2 GROUP BY page""")
def top_n_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = F.array_sort(F.transform("bboxes", lambda b, i: F.struct((-b["width"] * b["height"]).alias("a"), i.alias("i"), b["text"].alias("t"))))
    return page_boxes(spark, sf_dir).select("page", F.array_join(F.transform(F.slice(ranked, 1, 2), lambda r: r["t"]), " ").alias("largest"))


# ---- entities ---------------------------------------------------------------------------------------------------

EVENT_ENTITIES = """ents AS (SELECT event_id, user_id, event_type || ' ' || upper(substr(event_type, 1, 1)) AS word, 'L' || (event_id % 3) AS label,
  round(value / 1000, 6) AS score, CAST(event_id % 97 AS INTEGER) AS s, CAST(event_id % 97 + 1 + event_id % 11 AS INTEGER) AS e FROM events)"""


def event_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    return table(spark, sf_dir, "events").select(
        "event_id", "user_id", F.concat("event_type", F.lit(" "), F.upper(F.substring("event_type", 1, 1))).alias("word"), F.concat(F.lit("L"), (e % 3).cast("string")).alias("entity_group"),
        F.round(F.col("value") / 1000, 6).alias("score"), (e % 97).cast("int").alias("start"), (e % 97 + 1 + e % 11).cast("int").alias("end"),
    )


@query(f"WITH {EVENT_ENTITIES} SELECT trim(lower(word)) AS phrase, label, max(score) AS score, count(*) AS n FROM ents WHERE score >= 0.002 GROUP BY 1, 2")
def vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.vocabulary(event_entities(spark, sf_dir), min_score=0.002)


@query(f"""WITH {EVENT_ENTITIES}, v AS (SELECT trim(lower(word)) AS phrase, label, max(score) AS score, count(*) AS n FROM ents GROUP BY 1, 2)
SELECT phrase, label, score, n FROM v QUALIFY row_number() OVER (PARTITION BY phrase ORDER BY score DESC, n DESC, label) = 1""")
def vocabulary_top1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.top_label(E.vocabulary(event_entities(spark, sf_dir)))


@query(f"WITH {EVENT_ENTITIES} SELECT user_id, event_id, s AS start, e AS end_, label, score FROM ents QUALIFY row_number() OVER (PARTITION BY user_id, s, e, label ORDER BY score DESC, event_id) = 1")
def dedupe_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = E.dedupe(event_entities(spark, sf_dir), ["user_id"], ["start", "end", "entity_group"], "score", "event_id")
    return kept.select("user_id", "event_id", "start", F.col("end").alias("end_"), F.col("entity_group").alias("label"), "score")


@query(f"""WITH {EVENT_ENTITIES}, kept AS (SELECT * FROM ents WHERE label IN ('L0', 'L2') AND word <> 'error E')
SELECT user_id, count(*) AS n, min(s) AS first FROM kept GROUP BY user_id""")
def entity_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = event_entities(spark, sf_dir).where("word <> 'error E'").groupBy("user_id").agg(F.collect_list(F.struct("entity_group", "score", "word", "start", "end")).alias("found"))
    kept = E.whitelist(F.col("found"), ["L0", "L2", "L9"], ["L9"])
    return rows.withColumn("kept", kept).where(F.size("kept") > 0).select("user_id", F.size("kept").cast("long").alias("n"), F.array_min(F.transform("kept", lambda k: k["start"])).alias("first"))


@query(f"""WITH {EVENT_ENTITIES}, u AS (SELECT *, CASE WHEN event_id % 2 = 0 THEN 0 ELSE 1 END AS reading FROM ents),
best AS (SELECT user_id, s, e, label, score FROM u QUALIFY row_number() OVER (PARTITION BY user_id, s, e, label ORDER BY score DESC, reading, event_id) = 1)
SELECT user_id, count(*) AS n, string_agg(s || '-' || e || label, ' ' ORDER BY s, e, label) AS spans FROM best GROUP BY user_id""")
def ner_merge_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .schemas import ner

    rows = event_entities(spark, sf_dir).withColumn("second", F.col("event_id") % 2 == 1)
    entity = F.struct("entity_group", "score", "word", "start", "end", F.array().cast(BOXES).alias("boxes"), F.lit("model").alias("source"))
    read = lambda on: F.transform(F.array_sort(F.collect_list(F.when(F.col("second") == on, F.struct("event_id", entity.alias("e"))))), lambda s: s["e"])
    both = rows.groupBy("user_id").agg(read(False).alias("a"), read(True).alias("b"))
    merged = both.withColumn("ra", ner(F.col("a"))).withColumn("rb", ner(F.col("b"))).select("user_id", E.merge_records([F.col("ra"), F.col("rb")]).alias("m"))
    spans = F.array_join(F.transform("m.entities", lambda e: F.concat(e["start"].cast("string"), F.lit("-"), e["end"].cast("string"), e["entity_group"])), " ")
    return merged.select("user_id", F.size("m.entities").cast("long").alias("n"), spans.alias("spans"))


@query(f"""WITH {BOX_ROWS}, base AS (SELECT DISTINCT page, pos FROM box_rows WHERE flag = 'R')
SELECT b.page, coalesce(string_agg(CAST(b.pos AS VARCHAR), chr(10) ORDER BY b.pos) FILTER (s.pos IS NULL), '') AS text, CAST(count(*) FILTER (s.pos IS NULL) AS INTEGER) AS n
FROM box_rows b LEFT JOIN base s ON s.page = b.page AND s.pos = b.pos GROUP BY b.page""")
def document_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = page_boxes(spark, sf_dir)
    zipped = F.arrays_zip(F.col("bboxes").alias("b"), F.col("flags").alias("f"))
    base = document(F.lit(""), F.transform(F.filter(zipped, lambda z: z["f"] == "R"), lambda z: z["b"]))
    made = p.withColumn("base", base).withColumn("merged", document(F.lit(""), F.col("bboxes"))).select("page", E.document_delta(F.col("base"), F.col("merged")).alias("d"))
    return made.select("page", F.col("d.text").alias("text"), F.size("d.bboxes").alias("n"))


REBASE_BOXES = """boxed AS (SELECT user_id, event_type AS box_id, max(event_id * 10) AS lo FROM events GROUP BY ALL)"""


@query(f"""WITH {EVENT_ENTITIES}, {REBASE_BOXES}, t AS (SELECT user_id, string_agg(box_id, ' ' ORDER BY box_id) || ' click C' AS text FROM boxed GROUP BY user_id),
x AS (SELECT n.user_id, n.event_id, n.word, n.s, n.e, min(b.lo) AS lo, max(b.lo + 5) AS hi FROM ents n LEFT JOIN boxed b ON b.user_id = n.user_id AND n.event_id % 3 = 0 AND b.box_id IN ('click', split_part(n.word, ' ', 1)) GROUP BY ALL)
SELECT x.user_id, event_id, CAST(coalesce(lo, nullif(instr(text, word), 0) - 1, s) AS INTEGER) AS start, CAST(coalesce(hi, nullif(instr(text, word), 0) - 1 + length(word), e) AS INTEGER) AS end_ FROM x JOIN t ON t.user_id = x.user_id""")
def rebase_by_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    boxed = events.groupBy("user_id", F.col("event_type").alias("box_id")).agg(F.max(F.col("event_id") * 10).alias("lo")).withColumn("hi", F.col("lo") + 5)
    texts = boxed.groupBy("user_id").agg(F.concat(F.array_join(F.sort_array(F.collect_list("box_id")), " "), F.lit(" click C")).alias("text"))
    ids = F.when(F.col("event_id") % 3 == 0, F.array_distinct(F.array(F.lit("click"), F.split("word", " ")[0]))).otherwise(F.array().cast("array<string>"))
    out = E.rebase_by_box(event_entities(spark, sf_dir).withColumn("box_ids", ids), boxed.join(texts, "user_id"), ["user_id"], "event_id")
    return out.select("user_id", "event_id", "start", F.col("end").alias("end_"))


CLAIM = """WITH RECURSIVE {ents}, ranked AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY {order}) AS rn FROM ents),
walk AS (SELECT user_id, rn, {init} AS kept FROM ranked WHERE rn = 1
  UNION ALL SELECT r.user_id, r.rn, CASE WHEN {skip} THEN k.kept ELSE list_append(k.kept, struct_pack(s := r.s, e := r.e, id := r.event_id)) END
  FROM walk k JOIN ranked r ON r.user_id = k.user_id AND r.rn = k.rn + 1)
SELECT user_id, array_to_string(list_transform(arg_max(kept, rn), lambda o: CAST(o.id AS VARCHAR)), ' ') AS kept FROM walk GROUP BY user_id"""


@query(CLAIM.format(ents=EVENT_ENTITIES, order="e - s DESC, score DESC, event_id", init="[struct_pack(s := s, e := e, id := event_id)]", skip="len(list_filter(k.kept, lambda o: o.s < r.e AND r.s < o.e)) > 0"))
def greedy_span_claim(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = F.array_sort(F.collect_list(F.struct((F.col("start") - F.col("end")).alias("k"), (-F.col("score")).alias("p"), "event_id", "start", "end", F.col("event_id").cast("string").alias("tag"))))
    rows = event_entities(spark, sf_dir).groupBy("user_id").agg(spans.alias("spans"))
    return rows.select("user_id", F.array_join(F.transform(E.claim(F.col("spans")), lambda s: s["tag"]), " ").alias("kept"))


@query(CLAIM.format(ents=EVENT_ENTITIES, order="s, score DESC, event_id", init="[struct_pack(s := s, e := e, id := event_id)]", skip="r.s < list_max(list_transform(k.kept, lambda o: o.e))"))
def visualize_ner_cursor(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = F.array_sort(F.collect_list(F.struct("start", (-F.col("score")).alias("p"), "event_id", "end", F.col("event_id").cast("string").alias("tag"))))
    rows = event_entities(spark, sf_dir).groupBy("user_id").agg(spans.alias("spans"))
    return rows.select("user_id", F.array_join(F.transform(E.visible(F.col("spans")), lambda s: s["tag"]), " ").alias("kept"))


# ---- documents, presets, maps -----------------------------------------------------------------------------------


@query("""SELECT n_name, r_name || chr(10) || n_name AS text, CASE WHEN n_regionkey = 1 THEN 'first' WHEN n_regionkey = 2 THEN 'second' ELSE '' END AS exception FROM nation JOIN region ON n_regionkey = r_regionkey""")
def merge_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .operators.documents import merge

    both = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    own = document(F.col("n_name"), exception=F.when(F.col("n_regionkey") == 1, "first").otherwise(""))
    other = document(F.col("r_name"), exception=F.when(F.col("n_regionkey").isin(1, 2), "second").otherwise(""))
    made = both.withColumn("own", own).withColumn("other", other).select("n_name", merge(F.col("own"), F.col("other")).alias("d"))
    return made.select("n_name", F.col("d.text").alias("text"), F.col("d.exception").alias("exception"))


PRESET_ROWS = "VALUES " + ", ".join(f"({i}, '{name}', {list(scripts)})" for i, (name, scripts) in enumerate(presets.PRESETS.items()))
SCRIPT_OF = {"en": "Latin", "de": "Latin", "fr": "Cyrillic", "es": "Hangul"}
SCRIPT_CASE = "CASE lang " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in SCRIPT_OF.items()) + " END"


@query(f"WITH p(i, name, scripts) AS ({PRESET_ROWS}), l AS (SELECT DISTINCT lang, {SCRIPT_CASE} AS script FROM documents) SELECT lang, script, string_agg(name, ' ' ORDER BY i) AS presets FROM l JOIN p ON list_contains(scripts, script) GROUP BY ALL")
def presets_for_script(spark: SparkSession, sf_dir: str) -> DataFrame:
    script = F.create_map(*[F.lit(x) for pair in SCRIPT_OF.items() for x in pair])[F.col("lang")]
    langs = table(spark, sf_dir, "documents").select("lang").distinct().withColumn("script", script)
    return langs.select("lang", "script", F.array_join(presets.for_script(F.col("script")), " ").alias("presets"))


@query("""SELECT CASE WHEN lang = 'en' THEN 'v5-en-mobile' WHEN lang = 'de' THEN 'v6-tiny' ELSE 'v6-small' END AS preset, count(*) AS n FROM documents GROUP BY 1""")
def preset_for_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = F.when(F.col("lang") == "en", F.array(F.lit("v5-en-mobile"))).when(F.col("lang") == "de", F.array(F.lit("unknown"), F.lit("v6-tiny"))).when(F.col("lang") == "fr", F.array(F.lit("other")))
    return table(spark, sf_dir, "documents").groupBy(presets.for_row(asked).alias("preset")).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT l_orderkey, l_partkey, 2 * (l_partkey % 50) + 3 * (l_suppkey % 50) + 7 AS x, -1 * (l_partkey % 50) + 4 * (l_suppkey % 50) + 9 AS y,
  round(l_quantity * 72 / 36, 6) AS dpi, round(CASE WHEN l_quantity * 2 < 60 THEN least(4, 60 / (l_quantity * 2)) ELSE 1 END, 6) AS factor FROM lineitem""")
def placement_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    row = lambda *v: F.array(*[F.lit(float(x)) for x in v])
    matrix = G.multiply(row(1, 0, 0, 1, 7, 9), row(2, -1, 3, 4, 0, 0))
    dpi = G.effective_resolution(F.col("l_quantity"), F.lit(36.0))
    rows = table(spark, sf_dir, "lineitem").withColumn("at", G.apply(matrix, (F.col("l_partkey") % 50).cast("double"), (F.col("l_suppkey") % 50).cast("double")))
    return rows.select("l_orderkey", "l_partkey", F.col("at.x").cast("long").alias("x"), F.col("at.y").cast("long").alias("y"), r6(dpi).alias("dpi"), r6(G.upscale_factor(dpi, 60.0)).alias("factor"))


@query("""WITH n AS (SELECT p_partkey, p_size % 6 AS n FROM part), s AS (SELECT p_partkey, n, unnest(range(n)) AS i FROM n WHERE n > 0), k AS (SELECT *, unnest(range(3)) AS k FROM s)
SELECT p_partkey, CAST(count(*) AS INTEGER) AS slots, CAST(sum(CASE WHEN i + k < n THEN i * 10 + i + k ELSE 0 END) AS BIGINT) AS code FROM k GROUP BY p_partkey""")
def generate_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") % 6).alias("n")).where("n > 0")
    spans = rows.withColumn("spans", G.spans_to(F.col("n"), 3))
    return spans.select("p_partkey", F.size("spans").alias("slots"), F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["start"] * 10 + s["end"]).alias("code"))


@query("""SELECT p_brand, p_brand || '@' || CASE WHEN p_size < 10 THEN 'main' ELSE 'v2' END || '/model.onnx' AS key, 'https://models.example.org/' || p_brand || '/model.onnx' AS url, count(*) AS n FROM part GROUP BY ALL""")
def model_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    revision, path = F.when(F.col("p_size") >= 10, "v2"), F.lit("model.onnx")
    key, url = G.cache_key(F.col("p_brand"), revision, path), G.file_url(F.lit("https://models.example.org/"), F.col("p_brand"), revision, path)
    return table(spark, sf_dir, "part").groupBy("p_brand", key.alias("key"), url.alias("url")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {BOX_ROWS} SELECT page, count(*) AS n, string_agg(CAST(pos AS VARCHAR) || flag, '; ' ORDER BY pos) AS read, round(avg(score), 6) AS confidence FROM box_rows GROUP BY page HAVING round(avg(score), 9) >= 0.04""")
def page_gather(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = page_boxes(spark, sf_dir).withColumn("z", F.arrays_zip(F.transform("bboxes", lambda b: b["text"]).alias("t"), F.col("flags").alias("f")))
    mean = F.aggregate("bboxes", F.lit(0.0), lambda a, b: a + b["score"]) / F.size("bboxes")
    out = rows.select("page", F.size("bboxes").cast("long").alias("n"), F.array_join(F.transform("z", lambda z: F.concat(z["t"], z["f"])), "; ").alias("read"), mean.alias("mean"))
    return out.where("round(mean, 9) >= 0.04").select("page", "n", "read", r6(F.col("mean")).alias("confidence"))


# ---- work on whole texts and pixels ------------------------------------------------------------------------------

# What the test tables' documents hold: addresses, telephone numbers, sixteen digits, and dotted numbers (which read as
# telephone numbers from nine digits on; marks behind them that look like digits are repaired, and a ninth digit may be
# another mark).
HELD = rf"{EMAIL}|{PHONE}|[0-9]{{1,3}}(?:\.[0-9]{{1,3}}){{3}}(?:[$]|!*)|[0-9]{{16}}"
LUHN = "list_sum(list_transform(range(16), lambda i: CASE WHEN i % 2 = 1 THEN CAST(substr(word, 16 - i, 1) AS INTEGER) * 2 // 10 + CAST(substr(word, 16 - i, 1) AS INTEGER) * 2 % 10 ELSE CAST(substr(word, 16 - i, 1) AS INTEGER) END)) % 10 = 0"
FOUND = rf"""cut AS (SELECT doc_id, text, regexp_extract_all(text, '(?s)(.*?)({HELD})', 1) AS gaps, regexp_extract_all(text, '(?s)(.*?)({HELD})', 2) AS words FROM documents),
spread AS (SELECT doc_id, text, unnest(gaps) AS gap, unnest(words) AS word, generate_subscripts(words, 1) AS nth FROM cut),
placed AS (SELECT *, CAST(sum(length(gap) + length(word)) OVER (PARTITION BY doc_id ORDER BY nth) - length(word) AS INTEGER) AS start FROM spread),
eight AS (SELECT doc_id, text, start, CASE WHEN word LIKE '%$' AND length(regexp_replace(word, '[^0-9]', '', 'g')) <> 8 THEN word[:-2] ELSE word END AS word FROM placed),
read AS (SELECT *, length(regexp_replace(word, '[^0-9!$]', '', 'g')) AS digits,
    CASE WHEN contains(word, '@') THEN 'EMAIL' WHEN regexp_full_match(word, '[0-9]{{16}}') THEN 'CREDIT_CARD' ELSE 'PHONE' END AS entity_group,
    regexp_matches(substr(text, start, CASE WHEN start = 0 THEN 0 ELSE 1 END) || substr(text, start + length(word) + 1, 1), '[\p{{L}}\p{{N}}]') AS joined FROM eight),
found AS (SELECT doc_id, text, entity_group, word, start, CAST(start + length(word) AS INTEGER) AS end_, length(word) - length(replace(word, ' ', '')) + 1 AS n_boxes,
    CASE WHEN entity_group <> 'PHONE' THEN 0.95 WHEN word[1] = '+' THEN 0.85 WHEN word LIKE '%!' THEN 0.665 WHEN word LIKE '%$' THEN 0.595 ELSE 0.7 END AS score FROM read
  WHERE CASE entity_group WHEN 'EMAIL' THEN true WHEN 'CREDIT_CARD' THEN NOT joined AND {LUHN.replace("word", "CASE WHEN length(word) = 16 THEN word ELSE repeat('1', 16) END")} ELSE NOT joined AND digits BETWEEN 9 AND 15 END)"""


@query(f"WITH {FOUND} SELECT doc_id, entity_group, CAST(score AS DOUBLE) AS score, word, start, end_, CAST(n_boxes AS INTEGER) AS n_boxes FROM found")
def pattern_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = as_document(dealt_documents(spark, sf_dir), "doc_id", "text")
    found = each(patterns.pattern_entities(docs), "doc_id", "ner.entities")
    return found.select("doc_id", "e.entity_group", F.round("e.score", 6).alias("score"), "e.word", "e.start", F.col("e.end").alias("end_"), F.size("e.boxes").alias("n_boxes"))


def entity_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents to pattern entities, made consistent over all documents, counted by label and source."""
    docs = as_document(dealt_documents(spark, sf_dir), "doc_id", "text")
    pipeline = registry.preset("patterns")
    found = each(pipeline.transform(docs), "doc_id", "ner.entities")
    return found.groupBy(F.col("e.entity_group").alias("label"), F.col("e.source").alias("source")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("doc_id").alias("n_docs"), F.round(F.avg("e.score"), 6).alias("mean_score"))


QUERIES["ner_consistency"] = entity_report
ORACLES["ner_consistency"] = f"WITH {FOUND} SELECT entity_group AS label, 'pattern' AS source, count(*) AS n, count(DISTINCT doc_id) AS n_docs, round(avg(score), 6) AS mean_score FROM found GROUP BY 1"


@query(f"""WITH {FOUND}, wide AS (SELECT doc_id, entity_group, word, text, CAST(start - length(regexp_extract(substr(text, 1, start), '[^ ]*$')) AS INTEGER) AS start,
  CAST(end_ + length(regexp_extract(substr(text, end_ + 1), '^[^ ]*')) AS INTEGER) AS end_ FROM found),
words AS (SELECT *, len(list_filter(string_split(substr(text, 1, start), ' '), lambda w: w <> '')) AS before, len(list_filter(string_split(text, ' '), lambda w: w <> '')) AS n FROM wide)
SELECT doc_id, entity_group, CASE WHEN before >= n // 2 THEN replace(word, ' ', chr(10)) ELSE word END AS word, start, end_ FROM words""")
def ner_merger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Patterns on the first half of each document's boxes, on the rest and across both, merged in the whole document's offsets, by boxes."""
    whole = as_document(dealt_documents(spark, sf_dir), "doc_id", "text").withColumnRenamed("document", "merged")
    half = F.slice(F.col("merged.bboxes"), 1, (F.size("merged.bboxes") / 2).cast("int"))
    docs = whole.withColumn("document", document(B.text_of(half), half))
    delta = docs.withColumn("delta", E.document_delta(F.col("document"), F.col("merged"))).withColumn("seam", E.seam(F.col("document"), F.col("delta")))
    read = patterns.pattern_entities(patterns.pattern_entities(delta, "document", "ner"), "delta", "delta_ner")
    read = E.settle_seam(patterns.pattern_entities(read, "seam", "seam_ner"), ["ner", "delta_ner"], "seam_ner", "document", "delta")
    merged = each(registry.NerMerger().run(read), "doc_id", "ner.entities")
    return merged.select("doc_id", "e.entity_group", "e.word", "e.start", F.col("e.end").alias("end_"))


@query()
def ocr_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    @F.arrow_udf("string")
    def repair(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for (texts,) in (piece for batch in batches for piece in pieces(batch)):
            yield pa.array([None if t is None else patterns.normalise(t)[0] for t in texts.to_pylist()], pa.string())

    return text_documents(spark, sf_dir).select("doc_id", F.md5(repair("text").cast("binary")).alias("digest"))


NUMBER = r"\d{3}-\d{4}"
#: An occurrence of NUMBER with one edit has one of its halves as it is, and spans 9 characters at most.
HALF, WIDEST = "[0-9]{3}-|[0-9]{4}", 9


def number_matches(pattern: FuzzyPattern, text: str) -> list[Match]:
    """``pattern.match_all(text, 1)`` for NUMBER, sought only around halves of it: no other place can hold a match."""
    zones: list[list[int]] = []
    for m in regex.finditer(f"(?={HALF})", text):
        low, high = max(0, m.start() - WIDEST), min(len(text), m.start() + 4 + WIDEST)
        if zones and low <= zones[-1][1]:
            zones[-1][1] = high
        else:
            zones.append([low, high])
    return [m for low, high in zones for m in pattern.match_all(text, 1, begin=low, stop=high)]


@query()
def fuzzy_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers within whole texts, with one character inserted, replaced or left out at most."""

    @F.pandas_udf("array<struct<word:string,start:int,end:int,cost:double>>")
    def find(texts: pd.Series) -> pd.Series:
        pattern = FuzzyPattern(NUMBER)
        return texts.map(lambda t: [{"word": t[m.start : m.end], "start": m.start, "end": m.end, "cost": m.cost} for m in number_matches(pattern, t)])

    texts = text_documents(spark, sf_dir).where(F.col("text").rlike(HALF))
    found = texts.select("doc_id", find("text").alias("found")).select("doc_id", F.explode_outer("found").alias("m")).where(F.col("m").isNotNull())
    return found.select("doc_id", "m.word", "m.start", F.col("m.end").alias("end_"), "m.cost")


@query()
def readings_agree(spark: SparkSession, sf_dir: str) -> DataFrame:
    @F.pandas_udf("boolean")
    def agree(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([texts_agree(x, y) for x, y in zip(a, b, strict=True)])

    parts = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type")
    return parts.select("p_partkey", agree("p_name", "p_type").alias("other"), agree("p_name", F.translate("p_name", "oil", "011")).alias("misread"))


# Boxes of a page, each of which goes to the first word (or group) that it fits, as that has grown, or begins one.
SWEEP = """WITH RECURSIVE {boxes}, ranked AS (SELECT *, x AS l, y AS t, x + width AS r, y + height AS b, CAST(pos AS VARCHAR) AS txt, row_number() OVER (PARTITION BY page ORDER BY {order}) AS rn FROM box_rows),
walk AS (SELECT page, rn, [struct_pack(l := l, t := t, r := r, b := b, txt := txt)] AS words FROM ranked WHERE rn = 1
  UNION ALL
  SELECT n.page, n.rn, CASE WHEN list_contains(fits, true)
    THEN list_transform(k.words, lambda w, i: CASE WHEN i = list_position(fits, true) THEN struct_pack(l := least(w.l, n.l), t := least(w.t, n.t), r := greatest(w.r, n.r), b := greatest(w.b, n.b), txt := w.txt || '{glue}' || n.txt) ELSE w END)
    ELSE list_append(k.words, struct_pack(l := n.l, t := n.t, r := n.r, b := n.b, txt := n.txt)) END
  FROM (SELECT k.page, k.rn, k.words, list_transform(k.words, lambda w: {fits}) AS fits FROM walk k JOIN ranked n ON n.page = k.page AND n.rn = k.rn + 1) k
    JOIN ranked n ON n.page = k.page AND n.rn = k.rn + 1),
last AS (SELECT page, arg_max(words, rn) AS words FROM walk GROUP BY page)"""
GOES_ON = """least(w.b - w.t, n.b - n.t) > 0 AND least(w.b, n.b) - greatest(w.t, n.t) >= 0.5 * least(w.b - w.t, n.b - n.t)
  AND CASE WHEN n.l - w.r < 0 THEN w.r - n.l <= 0.5 * least(w.r - w.l, n.r - n.l) ELSE n.l - w.r <= 0.15 * least(w.b - w.t, n.b - n.t) AND least(length(w.txt), length(n.txt)) <= 3 END"""
SHARED = "greatest(least(w.r, n.r) - greatest(w.l, n.l), 0) * greatest(least(w.b, n.b) - greatest(w.t, n.t), 0)"
OVERLAPS = f"""{SHARED} > 0.02 * ((w.r - w.l) * (w.b - w.t) + (n.r - n.l) * (n.b - n.t) - {SHARED})
  AND abs((w.t + w.b) / 2 - (n.t + n.b) / 2) < 0.3 * ((w.b - w.t) + (n.b - n.t)) / 2"""


@query(SWEEP.format(boxes=BOX_ROWS, order="x, pos", fits=GOES_ON, glue="") + """
SELECT page, CAST(len(words) AS INTEGER) AS n, array_to_string(list_transform(words, lambda w: w.txt), ' ') AS text FROM last""")
def join_fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    @F.pandas_udf(BOXES)
    def join(pages_: pd.Series) -> pd.Series:
        return pages_.map(lambda boxes: merging.join_fragments([dict(b) for b in boxes]))

    done = page_boxes(spark, sf_dir).withColumn("joined", join("bboxes"))
    return done.select("page", F.size("joined").alias("n"), B.text_of(F.col("joined")).alias("text"))


@query(f"""WITH RECURSIVE {BOX_ROWS}, ranked AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY width * height DESC, score DESC, pos) AS rn FROM box_rows),
walk AS (SELECT page, rn, [struct_pack(pos := pos, x := x, y := y, width := width, height := height)] AS kept FROM ranked WHERE rn = 1
  UNION ALL SELECT n.page, n.rn, CASE WHEN len(list_filter(k.kept, lambda o: {COVERS.format(a="n", b="o", t=0.5)})) > 0 THEN k.kept
    ELSE list_append(k.kept, struct_pack(pos := n.pos, x := n.x, y := n.y, width := n.width, height := n.height)) END
  FROM walk k JOIN ranked n ON n.page = k.page AND n.rn = k.rn + 1)
SELECT page, array_to_string(list_transform(list_sort(list_transform(arg_max(kept, rn), lambda o: o.pos)), lambda p: CAST(p AS VARCHAR)), ' ') AS kept FROM walk GROUP BY page""")
def dedupe_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    @F.pandas_udf(BOXES)
    def dedupe(pages_: pd.Series) -> pd.Series:
        return pages_.map(lambda boxes: merging.dedupe_readings([dict(b) for b in boxes], 0.5, False))

    return page_boxes(spark, sf_dir).select("page", B.text_of(dedupe("bboxes")).alias("kept"))


@query(SWEEP.format(boxes=BOX_ROWS, order="pos", fits=OVERLAPS, glue=" ") + """, one AS (SELECT page, unnest(words) AS w FROM last)
SELECT page, w.txt AS text, w.l AS x, w.t AS y, w.r - w.l AS width, w.b - w.t AS height FROM one""")
def merge_overlapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = page_boxes(spark, sf_dir).select("page", F.explode(B.merge_overlapping(F.col("bboxes"), 0.02, line_limit=0.3)).alias("b"))
    return m.select("page", "b.text", "b.x", "b.y", "b.width", "b.height")


@query()
def page_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items of status O are the text layer, each flag's others are an image's reading, placed on the page."""
    from .schemas import DOCUMENT, PLACEMENT

    rows = box_rows(spark, sf_dir).join(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("page"), "o_orderpriority"), "page")
    layer = F.transform(F.array_sort(F.collect_list(F.when(F.col("pos") % 2 == 0, F.struct("pos", "b")))), lambda s: s["b"])
    read = F.transform(F.array_sort(F.collect_list(F.when(F.col("pos") % 2 == 1, F.struct("pos", "b")))), lambda s: s["b"])
    sets = rows.groupBy("page").agg(layer.alias("layer"), read.alias("read"), F.first("o_orderpriority").alias("priority"))
    place = F.struct(F.lit("i").alias("id"), F.lit(100.0).alias("width"), F.lit(100.0).alias("height"), box().alias("box"), F.array(*map(F.lit, (1.0, 0.0, 0.0, 1.0, 5.0, 5.0))).alias("matrix"), F.lit(0.0).alias("effectiveResolution"), F.lit(1.0).alias("scaleFactor")).cast(PLACEMENT)
    pages_ = sets.select("page", F.lit(0).alias("ord"), "priority", document(F.lit(""), F.col("layer")).cast(DOCUMENT).alias("document"), document(F.lit(""), F.col("read")).cast(DOCUMENT).alias("image_text"), place.alias("placement"))
    folded = merging.page_fold(pages_, ["page"])
    return folded.select("page", F.col("document.text").alias("text"), F.col("document.type").alias("type"), F.size("document.bboxes").alias("n"))


@query("""WITH w AS (SELECT doc_id, string_split(text, ' ') AS words FROM documents), e AS (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS pos FROM w),
s AS (SELECT doc_id, word, sum(length(word) + 1) OVER (PARTITION BY doc_id ORDER BY pos) - length(word) - 1 AS lo FROM e)
SELECT doc_id, count(*) AS n, CAST(sum(lo * 3 + lo + length(word)) AS BIGINT) AS code FROM s WHERE word <> '' GROUP BY doc_id""")
def map_chars_to_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = as_document(dealt_documents(spark, sf_dir), "doc_id", "text").withColumn("at", E.box_extents(F.col("document")))
    code = F.aggregate("at", F.lit(0).cast("long"), lambda a, s: a + s["lo"] * 3 + s["hi"])
    coded = docs.select("doc_id", F.size("at").cast("long").alias("n"), code.alias("code"))
    return coded.groupBy("doc_id").agg(F.sum("n").alias("n"), F.sum("code").alias("code")).where("n > 0")


def part_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dealt(table(spark, sf_dir, "part").select("p_partkey"), "p_partkey")


def drawn_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Small pages drawn from line items: image and boxes that cut their ink by two pixels."""
    import numpy as np

    from .operators import images
    from .schemas import IMAGE

    @F.pandas_udf(IMAGE)
    def paint(found: pd.Series) -> pd.DataFrame:
        rows = []
        for boxes in found:
            px = images.draw(np.full((260, 320, 4), 255, np.uint8), [dict(b) for b in boxes], (0, 0, 0), filled=True)
            rows.append(("memory", 72, images.encode_png(px, 1), "png", "", 260, 320))
        return pd.DataFrame(rows, columns=["path", "resolution", "data", "imageType", "exception", "height", "width"])

    inner = F.transform("bboxes", lambda b: b.withField("x", b["x"] + 2).withField("width", F.greatest(b["width"] - 4, F.lit(3.0))))
    return dealt(page_boxes(spark, sf_dir), "page").select("page", paint("bboxes").alias("image"), detection(inner).alias("boxes"))


@query()
def image_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fit boxes to ink, crop them, and measure the crops."""
    from .operators import images

    fitted = images.fit_to_ink(drawn_pages(spark, sf_dir))
    crops = images.crop_boxes(fitted)
    return crops.select("page", "box.text", "box.x", "box.width", "cropped_image.width", "cropped_image.height", "cropped_image.exception").toDF("page", "text", "x", "box_width", "width", "height", "exception")


@query("""WITH r AS (SELECT p_partkey, 10 + p_partkey % 30 AS x, 10 + p_partkey % 20 AS y, 40 + p_partkey % 7 AS w FROM part)
SELECT p_partkey, CAST(greatest(x - 11, 0) AS DOUBLE) AS x, CAST(greatest(y - 11, 0) AS DOUBLE) AS y, CAST(x + 10 + w - greatest(x - 11, 0) AS DOUBLE) AS width,
  CAST(y + 22 - greatest(y - 11, 0) AS DOUBLE) AS height, CAST(0.9 AS DOUBLE) AS score FROM r""")
def probability_quads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text quadrangles of probability maps that have one rectangle each."""
    import numpy as np

    from .functions import geometry

    @F.pandas_udf("array<struct<x:double,y:double,width:double,height:double,score:double>>")
    def decode(keys: pd.Series) -> pd.Series:
        def one(k: int) -> list[dict]:
            values = np.zeros((80, 120), np.float32)
            x, y = 10 + k % 30, 10 + k % 20
            values[y : y + 12, x : x + 40 + k % 7] = 0.9
            return [{c: b[c] for c in ("x", "y", "width", "height")} | {"score": float(s)} for q, s in geometry.quads(values, 120, 80, 1.0) for b in [geometry.box_from_polygon(q)]]

        return keys.map(one)

    rows = part_keys(spark, sf_dir).select("p_partkey", F.explode(decode("p_partkey")).alias("q"))
    return rows.select("p_partkey", "q.x", "q.y", "q.width", "q.height", F.round("q.score", 2).alias("score"))


@query("SELECT 'rows' AS what, count(*) AS n FROM documents")
def stream_equals_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page-by-page run over a stream of files beside the batch run: rows that only one of them has (none), and a count."""
    from .sources.shared import saved, workspace
    from .streaming.page_order import run_pages

    folder = workspace(spark, "stream")
    # texts are dealt before their boxes are made, which take some ten times their room, to files of a bounded size
    texts = dealt_documents(spark, sf_dir)
    files = max(6, 6 * texts.rdd.getNumPartitions())
    as_document(texts.repartition(files, "doc_id"), "doc_id", "text").write.parquet(f"{folder}/in")
    pipeline = registry.pipeline_from_descriptors([{"type": "RegexNer", "options": {"inputCol": "document", "labels": ["EMAIL", "PHONE", "DATE"]}, "when": {"path": "document.bboxes.length", "gte": 20}}])
    source = spark.read.parquet(f"{folder}/in")
    stream = spark.readStream.schema(source.schema).option("maxFilesPerTrigger", files // 3).parquet(f"{folder}/in")
    run_pages(pipeline, stream, f"{folder}/out", f"{folder}/checkpoint").awaitTermination()
    flat = lambda df: df.select("doc_id", F.to_json("ner.entities").alias("found"))
    one, two = flat(spark.read.parquet(f"{folder}/out")), saved(flat(pipeline.transform(source)), "batch")
    return two.select(F.lit("rows").alias("what"), "doc_id").unionAll(one.exceptAll(two).select(F.lit("only streamed"), "doc_id")).unionAll(two.exceptAll(one).select(F.lit("only batch"), "doc_id")).groupBy("what").agg(F.count(F.lit(1)).alias("n"))


# ---- stages around a model: engines that need no weights, the rest of the stage as it is ---------------------------


def digit_engine(text: str, labels: list[str], threshold: float) -> list[dict]:
    """Runs of sixteen digits, labelled by the parity of the last and scored by it."""
    found = [(m.start(), m.end(), int(m[0][-1])) for m in regex.finditer(r"(?<![0-9])[0-9]{16}(?![0-9])", text)]
    return [{"start": a, "end": b, "label": labels[d % 2], "score": 0.5 + d / 20} for a, b, d in found if 0.5 + d / 20 >= threshold]


@query(r"""WITH cut AS (SELECT doc_id, text, regexp_extract_all(text, '(?s)(.*?)([0-9]+)', 1) AS gaps, regexp_extract_all(text, '(?s)(.*?)([0-9]+)', 2) AS words FROM documents),
spread AS (SELECT doc_id, text, unnest(gaps) AS gap, unnest(words) AS word, generate_subscripts(words, 1) AS nth FROM cut),
placed AS (SELECT *, CAST(sum(length(gap) + length(word)) OVER (PARTITION BY doc_id ORDER BY nth) - length(word) AS INTEGER) AS start FROM spread)
SELECT doc_id, 'odd' AS label, word, start, CAST(start + 16 AS INTEGER) AS end_, round(0.5 + CAST(word[-1] AS INTEGER) / 20, 6) AS score, 1 AS n_boxes FROM placed
WHERE length(word) = 16 AND CAST(word[-1] AS INTEGER) % 2 = 1 AND 0.5 + CAST(word[-1] AS INTEGER) / 20 >= 0.6""")
def gliner_stage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in overlapping windows, the spans moved back, each once, one label of two, with boxes."""
    docs = as_document(dealt_documents(spark, sf_dir), "doc_id", "text").withColumnRenamed("document", "text")
    stage = registry.GlinerNer(labels=["even", "odd"], threshold=0.6, whiteList=["odd"])
    found = each(stage.run(docs, Run(engines={"gliner": digit_engine})), "doc_id", "ner.entities")
    return found.select("doc_id", F.col("e.entity_group").alias("label"), "e.word", "e.start", F.col("e.end").alias("end_"), F.round("e.score", 6).alias("score"), F.size("e.boxes").alias("n_boxes"))


def blank_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """White pictures of several sizes, one for each part."""
    import numpy as np

    from .operators import images
    from .schemas import IMAGE

    @F.pandas_udf(IMAGE)
    def paint(keys: pd.Series) -> pd.DataFrame:
        sizes = [(80 + k % 30, 100 + 4 * (k % 50)) for k in keys]
        return pd.DataFrame([("memory", 72, images.encode_png(np.full((h, w, 4), 255, np.uint8)), "png", "", h, w) for h, w in sizes], columns=["path", "resolution", "data", "imageType", "exception", "height", "width"])

    return part_keys(spark, sf_dir).select("p_partkey", paint("p_partkey").alias("image"))


def square_engine(planes):
    """Four boxes in a square of 160 pixels: the second repeats the first, the last is weak."""
    return [20, 60, 70, 90, 0.9, 1, 22, 61, 71, 92, 0.8, 1, 20, 60, 70, 90, 0.7, 0, 0, 0, 9, 9, 0.1, 0], [1, 4, 6]


square_engine.size = 160


@query("""WITH i AS (SELECT p_partkey, 100 + 4 * (p_partkey % 50) AS w, 80 + p_partkey % 30 AS h FROM part),
s AS (SELECT *, least(160 / w, 160 / h) AS scale FROM i), p AS (SELECT *, trunc((160 - round_even(w * scale, 0)) / 2) AS px, trunc((160 - round_even(h * scale, 0)) / 2) AS py FROM s),
c AS (SELECT *, (20 - px) / scale AS x0, (60 - py) / scale AS y0, (70 - px) / scale AS x1, (90 - py) / scale AS y1 FROM p),
b AS (SELECT *, greatest(0, x0 - 0.1 * (x1 - x0)) AS l, greatest(0, y0 - 0.1 * (y1 - y0)) AS t, least(w, x1 + 0.1 * (x1 - x0)) AS r, least(h, y1 + 0.1 * (y1 - y0)) AS u FROM c)
SELECT p_partkey, label, CAST(round(score, 4) AS DOUBLE) AS score, round(l, 4) AS x, round(t, 4) AS y, round(r - l, 4) AS width, round(u - t, 4) AS height
FROM b, (VALUES ('class_1', 0.9), ('face', 0.7)) AS v(label, score)""")
def yolo_stage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An object detector's output decoded, moved back from the square, padded, clipped and suppressed by class."""
    stage = registry.YoloOnnxDetector(model="m", labels=["face"], padding=0.1, scoreThreshold=0.2, iouThreshold=0.5)
    found = each(stage.run(blank_images(spark, sf_dir), Run(engines={"yolo": square_engine})), "p_partkey", "boxes.bboxes")
    sizes = [F.round(f"e.{c}", 4).alias(c) for c in ("x", "y", "width", "height")]
    return found.select("p_partkey", F.col("e.text").alias("label"), F.round("e.score", 4).alias("score"), *sizes)


def map_engine(planes):
    """A text detector that sees one block of 40 by 12 pixels, at (20, 30) of its input."""
    import numpy as np

    values = np.zeros(planes.shape[2:], np.float32)
    values[30:42, 20:60] = 0.9
    return values


@query("SELECT p_partkey, CAST(9 AS DOUBLE) AS x, CAST(19 AS DOUBLE) AS y, CAST(61 AS DOUBLE) AS width, CAST(33 AS DOUBLE) AS height, CAST(0.9 AS DOUBLE) AS score FROM part")
def dbnet_stage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A text detector's map cut into boxes, in the picture's pixels."""
    stage = registry.DbnetOnnxDetector(model="m")
    found = each(stage.run(blank_images(spark, sf_dir), Run(engines={"dbnet": map_engine})), "p_partkey", "boxes.bboxes")
    return found.select("p_partkey", "e.x", "e.y", "e.width", "e.height", F.round("e.score", 2).alias("score"))


class PartFile:
    """A one-page file for each part, by its key: a raster that is painted at a place and size, and a text run."""

    def count(self, content: bytes) -> int:
        return 1

    def viewport(self, content: bytes, page: int, scale: float) -> list[float]:
        return [scale, 0, 0, -scale, 0, 800 * scale]

    def operators(self, content: bytes, page: int) -> list:
        k = int(content)
        return [("save", None), ("transform", [100 + k % 50, 0, 0, 50 + k % 30, k % 200, k % 300]), ("paintImageXObject", ["i"]), ("restore", None), ("paintImageMaskXObject", ["m"])]

    def raster(self, content: bytes, page: int, key: str) -> dict:
        return {"data": bytes(80 * 40 * 3), "width": 80, "height": 40, "kind": 2}

    def runs(self, content: bytes, page: int) -> list[dict]:
        k = int(content)
        return [{"str": f"part {k}", "transform": [20, 0, 0, 20, k % 200, k % 700], "width": 100 + k % 50, "height": 20, "fontName": ""}]


def part_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return part_keys(spark, sf_dir).select("p_partkey", F.col("p_partkey").cast("string").cast("binary").alias("content"))


@query("""SELECT p_partkey, CAST(p_partkey % 200 AS DOUBLE) AS x, CAST(800 - p_partkey % 300 - (50 + p_partkey % 30) AS DOUBLE) AS y, CAST(100 + p_partkey % 50 AS DOUBLE) AS width,
round(72 * 80 / (100 + p_partkey % 50), 4) AS dots, round(least(4, 150 / (72 * 80 / (100 + p_partkey % 50))), 4) AS scale, round((100 + p_partkey % 50) / 80, 4) AS a, round(-(50 + p_partkey % 30) / -40, 4) AS d,
CAST(floor(80 * least(4, 150 / (72 * 80 / (100 + p_partkey % 50))) + 0.5) AS INTEGER) AS pixels FROM part""")
def embedded_images_stage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rasters that a page's operators paint: their places, resolutions, maps and the pixels after enlarging."""
    stage = registry.PdfEmbeddedImages(resolution=72, minPixels=1000)
    made = stage.run(part_files(spark, sf_dir), Run(engines={"pdf-images": PartFile()}))
    place = [F.col(f"placement.box.{c}") for c in ("x", "y", "width")]
    numbers = {"dots": "placement.effectiveResolution", "scale": "placement.scaleFactor", "a": "placement.matrix[0]", "d": "placement.matrix[3]"}
    return made.select("p_partkey", *place, *[F.round(F.expr(e), 4).alias(n) for n, e in numbers.items()], F.col("image.width").alias("pixels"))


@query("""SELECT p_partkey, 'part ' || p_partkey AS text, CAST(2 * (p_partkey % 200) AS DOUBLE) AS x, CAST(2 * (800 - p_partkey % 700 - 15) AS DOUBLE) AS y, CAST(2 * (100 + p_partkey % 50) AS DOUBLE) AS width,
CAST(40 AS DOUBLE) AS height, CAST(0.99 AS DOUBLE) AS score FROM part""")
def text_layer_stage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes of text runs in pixels, from their text matrices."""
    stage = registry.PdfToDocument(resolution=144, splitWords=False)
    found = each(stage.run(part_files(spark, sf_dir), Run(engines={"pdf-text": PartFile()})), "p_partkey", "document.bboxes")
    return found.select("p_partkey", *[F.col(f"e.{c}") for c in ("text", "x", "y", "width", "height", "score")])


@query("""SELECT p_partkey, CAST(i AS INTEGER) AS pos, CAST(5 + 30 * i AS INTEGER) AS x0, CAST(15 + 30 * i + p_partkey % 7 AS INTEGER) AS x1, 3 AS y0, CAST(10 + p_partkey % 5 AS INTEGER) AS y1,
CASE WHEN p_partkey % 4 < 3 THEN 'w' || i WHEN i = 0 THEN 'w0 w1' ELSE 'w' || (i + 1) END AS word FROM part, unnest(range(p_partkey % 4 + 1)) AS t(i)""")
def word_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of the pictures of lines, and what was read shared out to them; some lines have a word more than spans.

    Four spans of one width share ten letters: the first has its 2.5 only with its second word.
    """
    import numpy as np

    from .functions import ink

    @F.pandas_udf("array<struct<x0:int,x1:int,y0:int,y1:int,word:string>>")
    def cut(keys: pd.Series) -> pd.Series:
        def one(k: int) -> list[dict]:
            px = np.full((20, 130, 4), 255, np.uint8)
            for i in range(k % 4 + 1):
                px[3 : 10 + k % 5, 5 + 30 * i : 15 + 30 * i + k % 7, :3] = 30
            words = [f"w{i}" for i in range(k % 4 + 1 + (k % 4 == 3))]
            return [dict(zip(("x0", "x1", "y0", "y1"), s, strict=True), word=w) for s, w in ink.align_spans(words, ink.word_spans(px, 0.15))]

        return keys.map(one)

    return part_keys(spark, sf_dir).select("p_partkey", F.posexplode(cut("p_partkey")).alias("pos", "e")).select("p_partkey", "pos", "e.*")


# ---- planted strings beside what must come of them ---------------------------------------------------------------


def values(rows: list[tuple], names: str) -> str:
    """SQL that lists rows."""
    show = lambda v: "NULL" if v is None else str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(show, r)) + ')' for r in rows)}) AS t({names})"


#: A text, and the label and word that are found in it (none).
PLANTED = [
    ("Card: 5500 0000 0000 0004.", "CREDIT_CARD", "5500 0000 0000 0004"),
    ("Amex 3714 496353 98431", "CREDIT_CARD", "3714 496353 98431"),
    ("PESEL: 44051401359", "PESEL", "44051401359"),
    ("PESEL 44O514O1359", "PESEL", "44O514O1359"),
    ("SSN 123-45-6789", "SSN", "123-45-6789"),
    ("SSN 000-12-3456", None, None),
    ("mail anna.nowak@example.org now", "EMAIL", "anna.nowak@example.org"),
    ("mail anna.nowak @ example .org now", "EMAIL", "anna.nowak @ example .org"),
    ("mail anna©example.org", "EMAIL", "anna©example.org"),
    ("Tel. +48 600-l23-456", "PHONE", "+48 600-l23-456"),
    ("Tel. (555) 123-4567", "PHONE", "(555) 123-4567"),
    ("Date 12.03.2024", "DATE", "12.03.2024"),
    ("born 12 stycznia 2024 in", "DATE", "12 stycznia 2024"),
    ("on Jan. 12, 2024 we", "DATE", "Jan. 12, 2024"),
    ("on 3rd of March 2021", "DATE", "3rd of March 2021"),
    ("valid until 10/2024", "DATE", "10/2024"),
    ("since October 2024", "DATE", "October 2024"),
    ("see https://example.com/docs?x=1#y.", "URL", "https://example.com/docs?x=1#y"),
    ("visit www.example.pl today", "URL", "www.example.pl"),
    ("at http ://example.com/a)", "URL", "http ://example.com/a"),
    ("ul. Prosta 1, 00-950 Warszawa", "ZIP_CODE", "00-950"),
    ("New York, NY 10001", "ZIP_CODE", "10001"),
    ("ZIP 94105-1234", "ZIP_CODE", "94105-1234"),
    ("10115 Berlin", "ZIP_CODE", "10115"),
    ("12345 Main Street", None, None),
    ("London SW1A 1AA", "ZIP_CODE", "SW1A 1AA"),
    ("Ottawa ON K1A 0B1", "ZIP_CODE", "K1A 0B1"),
    ("IBAN: DE89 3704 0044 0532 0130 00.", "IBAN", "DE89 3704 0044 0532 0130 00"),
    ("GB29 NWBK 6016 1331 9268 19", "IBAN", "GB29 NWBK 6016 1331 9268 19"),
    ("nr 61 1090 1014 0000 0712 1981 2874", "IBAN", "61 1090 1014 0000 0712 1981 2874"),
    ("a trip through Poland ended", "COUNTRY", "Poland"),
    ("Nationality: Chad", "COUNTRY", "Chad"),
    ("passport issued, country: POL", "COUNTRY", "POL"),
    ("Chad said so", None, None),
    ("Page 3 of 12", None, None),
    ("Version 1.2.3.4", None, None),
    ("Date 45.13.2024", None, None),
    ("period 13/2024", None, None),
    ("", None, None),
]


def planted(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"id int, {schema}")


@query(values([(i, label, word) for i, (_, label, word) in enumerate(PLANTED)], "id, label, word"))
def planted_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = planted(spark, [(t,) for t, _, _ in PLANTED], "text string")
    found = patterns.pattern_entities(as_document(rows, "id", "text")).select("id", F.explode_outer("ner.entities").alias("e"))
    return found.select("id", F.col("e.entity_group").alias("label"), F.col("e.word").alias("word"))


#: A text, and how it reads once numbers that were misread are repaired.
REPAIRS = [("4111 1lll 1111 1111", "4111 1111 1111 1111"), ("1st of May", "1st of May"), ("12–34—56‒7", "12-34-56-7"), ("Bill SOS", "Bill SOS"), ("tel 6OO-l23", "tel 600-123"), ("O0O lll", "O0O lll"), ("O0 1l", "00 11"), ("x1O", "x1O"), ("252!!", "25211"), ("", "")]


@query(values([(i, r) for i, (_, r) in enumerate(REPAIRS)], "id, repaired"))
def planted_repairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    repair = F.pandas_udf(lambda texts: texts.map(lambda t: patterns.normalise(t)[0]), "string")
    return planted(spark, [(t,) for t, _ in REPAIRS], "text string").select("id", repair("text").alias("repaired"))


#: A pattern, a text, the edits allowed, and the first match: its word and cost (nothing and -1).
FUZZY = [(r"\d{3}-\d{4}", "call 555-1234", 0, "555-1234", 0), (r"\d{3}-\d{4}", "call 555-12X4", 1, "555-12X4", 1), (r"\d{3}-\d{4}", "555--1234", 1, "555--1234", 1), (r"\d{3}-\d{4}", "55-12", 1, "", -1), ("colou?r", "the colr", 1, "colr", 1), ("ab+c", "xabbbc", 0, "abbbc", 0)]


@query(values([(i, word, cost) for i, (_, _, _, word, cost) in enumerate(FUZZY)], "id, word, cost"))
def planted_fuzzy(spark: SparkSession, sf_dir: str) -> DataFrame:
    @F.pandas_udf("struct<word:string,cost:int>")
    def first(shapes: pd.Series, texts: pd.Series, most: pd.Series) -> pd.DataFrame:
        found = [next(iter(FuzzyPattern(p).match_all(t, n)), None) for p, t, n in zip(shapes, texts, most, strict=True)]
        return pd.DataFrame([(t[m.start : m.end], int(m.cost)) if m else ("", -1) for m, t in zip(found, texts, strict=True)], columns=["word", "cost"])

    rows = planted(spark, [r[:3] for r in FUZZY], "shape string, text string, most int").withColumn("m", first("shape", "text", "most"))
    return rows.select("id", "m.word", "m.cost")


#: Two readings, and whether the first is found within the second, a third of its letters misread at most.
AGREEMENTS = [("Invoce", "the Invoice no", 1), ("total", "amount", 0), ("", "anything", 1), ("Résumé", "resume", 1), ("T0TAL", "total sum", 1), ("abc", "xyz", 0), ("ab", "a", 1), ("12345", "12 34 5", 1)]


@query(values([(i, a) for i, (_, _, a) in enumerate(AGREEMENTS)], "id, agree"))
def planted_agreements(spark: SparkSession, sf_dir: str) -> DataFrame:
    agree = F.pandas_udf(lambda a, b: pd.Series([int(texts_agree(x, y)) for x, y in zip(a, b, strict=True)]), "int")
    return planted(spark, [r[:2] for r in AGREEMENTS], "one string, other string").select("id", agree("one", "other").alias("agree"))


#: Pictures for sheets of 100 pixels a side with a gutter of 10, none enlarged: their sizes, and the sheet, place and size that each gets.
SHEETS = [((100, 50), (0, 0, 0, 100, 50)), ((40, 30), (1, 0, 60, 40, 30)), ((40, 20), (1, 50, 60, 40, 20)), ((200, 100), (1, 0, 0, 100, 50)), ((30, 10), (2, 0, 0, 30, 10))]


@query(values([(i, *place) for i, (_, place) in enumerate(SHEETS)], "item, sheet, x, y, width, height"))
def planted_sheets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .functions import ink

    @F.pandas_udf("array<struct<item:int,sheet:int,x:int,y:int,width:int,height:int>>")
    def pack(sizes: pd.Series) -> pd.Series:
        return sizes.map(lambda pairs: [{**p, "sheet": n} for n, sheet in enumerate(ink.pack_sheets([tuple(s) for s in pairs], 100, 1, 10)) for p in sheet])

    rows = spark.createDataFrame([([list(size) for size, _ in SHEETS],)], "sizes array<array<int>>")
    return rows.select(F.inline(pack("sizes")))


#: A PDF font's name and size, and its CSS font.
FONTS = [("ABCDEF+Times-BoldItalic", 12, "italic bold 12px serif"), ("CourierNew", 9, "normal normal 9px monospace"), ("Helvetica-Oblique", 0, "italic normal 1px sans-serif"), ("Abcdef+Arial-Black", 10, "normal bold 10px sans-serif"), ("", 8, "normal normal 8px sans-serif")]


@query(values([(i, css) for i, (_, _, css) in enumerate(FONTS)], "id, css"))
def planted_fonts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .functions import placing

    css = F.pandas_udf(lambda names, sizes: pd.Series([placing.css_font(n, s) for n, s in zip(names, sizes, strict=True)]), "string")
    return planted(spark, [f[:2] for f in FONTS], "name string, size int").select("id", css("name", "size").alias("css"))
