"""Benchmark decontamination by spaced-seed hashing, with DataFrame functions alone.

Words are runs of letters and digits, in lower case. A passage is contaminated by an item if some ``WINDOW`` aligned
words of both differ in at most ``SUBSTITUTIONS`` places; an item of fewer words must occur word for word, and items of
under ``shortest`` words are not searched for (1 searches for all). Two fixed masks of span 9 look at six places each
and ignore three. Of any 13 aligned words that differ in at most two places, one mask in one position sees none of the
two, so that no such overlap is missed; every hit is then verified word by word along its alignment.

Documents are read once, for items of all lengths together, and never shuffled: their seeds are made, exploded and
looked up within the scan's stage. The items' seeds are broadcast where a count shows that they are few; else hits are
joined by a shuffle. Both ways give the same rows. What is found of documents is keyed by the row's text besides its
id, so that no two texts are taken for each other, whatever their ids.

Defined results: null and empty texts and items match nothing; items that share an id are searched for separately and
reported under that id once; a repeated doc_id is reported once per item. Documents are removed row by row: of rows that
share an id or have none, those whose own text is contaminated.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import private, saved

WINDOW = 13
SUBSTITUTIONS = 2
SHORTEST = 5
#: Places that each mask looks at.
MASKS = ((0, 1, 2, 3, 7, 8), (0, 3, 4, 6, 7, 8))
SPAN = 9
#: Items' seeds that are broadcast at most (some 60 bytes each).
BROADCAST_SEEDS = 500_000
#: Contaminated rows (some 40 bytes each) that are broadcast at most when documents are removed.
BROADCAST_ROWS = 200_000


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{M}\p{N}]+"), "")


def _seeds(hashes: Column, places: Column, short: list[int]) -> Column:
    """For each kind of seed, one for each word as the first: the masks', then those of runs of the short items' lengths.

    Past a text's last window words are missing and a seed means nothing; verification turns such hits away.
    """

    def kind(number: int, offsets) -> Column:
        return F.transform(places, lambda i: F.xxhash64(F.lit(number), *[F.get(hashes, i + o) for o in offsets]))

    return F.flatten(F.array(*(kind(n, m) for n, m in enumerate(MASKS)), *(kind(100 + n, range(n)) for n in short)))


def item_seeds(items: DataFrame, item_id: str, text: str, shortest: int = SHORTEST) -> tuple[DataFrame, list[int]]:
    """Seed rows (seed, item_id, item, at) and the word counts (under SPAN) of items that are too short for the masks."""
    base = items.select(F.col(item_id).alias("item_id"), words(F.col(text)).alias("item")).withColumn("n", F.size("item")).where(F.col("n") >= max(1, shortest)).dropDuplicates(["item_id", "item"])
    short = sorted(r.n for r in base.where(F.col("n") < SPAN).select("n").distinct().collect())
    rows = base.withColumn("h", F.transform("item", lambda w: F.xxhash64(w))).withColumn("seeds", _seeds(F.col("h"), F.sequence(F.lit(0), F.col("n") - 1), short))
    cells = rows.select("item_id", "item", "n", F.posexplode("seeds").alias("i", "seed"))
    at, kind = F.pmod("i", "n"), F.floor(F.col("i") / F.col("n"))
    lengths = F.array(*[F.lit(n) for n in (*[SPAN] * len(MASKS), *short)])
    # an item has the seeds of its own kind alone, and those of whole windows
    own = F.when(F.col("n") >= SPAN, kind < len(MASKS)).otherwise(kind >= len(MASKS)) & (at + F.get(lengths, kind.cast("int")) <= F.col("n")) & ((F.col("n") >= SPAN) | (F.get(lengths, kind.cast("int")) == F.col("n")))
    return cells.where(own).select("seed", "item_id", "item", at.cast("int").alias("at")), short


def verified(doc: Column, item: Column) -> Column:
    """Of aligned words, the number that agree, or 0 where no window agrees well enough. Both arrays: one length."""
    same = F.zip_with(doc, item, lambda a, b: (a == b).cast("int"))
    size, width = F.size(item), F.least(F.size(item), F.lit(WINDOW))
    # the number of agreeing words in each window
    sums = F.transform(F.sequence(F.lit(0), size - width), lambda i: F.aggregate(F.slice(same, i + 1, width), F.lit(0), lambda a, x: a + x))
    return F.aggregate(same, F.lit(0), lambda a, x: a + x) * F.array_max(sums).__ge__(width - F.when(width < WINDOW, 0).otherwise(SUBSTITUTIONS)).cast("int")


def text_key(text: Column) -> Column:
    """128 bits that tell the texts of rows apart which share an id, or have none."""
    return F.struct(F.xxhash64(text).alias("a"), F.xxhash64(F.lit(1), text).alias("b"))


def verified_hits(docs: DataFrame, items: DataFrame, doc_id: str, text: str, item_id: str = "item_id", item_text: str = "text", broadcast_seeds: int = BROADCAST_SEEDS, shortest: int = SHORTEST) -> DataFrame:
    """doc_id, key (of the text), item_id, first_word, n_item_words, n_matched: each alignment that agrees well enough."""
    seeds, short = item_seeds(items, item_id, item_text, shortest)
    few = seeds.count() <= broadcast_seeds
    base = docs.select(F.col(doc_id).alias("doc_id"), text_key(F.col(text)).alias("key"), words(F.col(text)).alias("words"))
    hashed = base.select("doc_id", "key", "words", F.greatest(F.size("words"), F.lit(1)).alias("m"), F.transform("words", lambda w: F.xxhash64(w)).alias("h"))
    # seeds are a column of their own before the generator, which can then run within generated code; the outer form
    # keeps the optimizer from adding a filter on the seeds, which would compute them again for each word
    made = hashed.select("doc_id", "key", "words", "m", _seeds(F.col("h"), F.sequence(F.lit(0), F.col("m") - 1), short).alias("seeds"))
    rows = made.select("doc_id", "key", "words", "m", F.posexplode_outer("seeds").alias("i", "seed"))
    if few:
        found = rows.join(F.broadcast(seeds), "seed")
    else:
        # the words stay behind: they are joined again for the rows that have a hit
        texts = base.dropDuplicates(["doc_id", "key"]).withColumnsRenamed({"doc_id": "d", "key": "k"})
        found = rows.drop("words").join(seeds, "seed").join(texts, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("key") == F.col("k")))
    start = F.pmod("i", "m") - F.col("at")
    low = F.greatest(start, F.lit(0))
    span = F.greatest(F.least(start + F.size("item"), F.size("words")) - low, F.lit(0))
    hits = found.select("doc_id", "key", "item_id", start.alias("first_word"), F.size("item").alias("n_item_words"), F.slice("words", low + 1, span).alias("doc"), F.slice("item", low - start + 1, span).alias("part"), F.size("item").alias("whole"))
    # with the text's own key, the hits of a group are of one text at one place: all are alike
    once = hits.groupBy("doc_id", "key", "item_id", "first_word", "n_item_words", F.xxhash64("part").alias("which")).agg(F.first(F.struct("doc", "part", "whole")).alias("p"))
    # an item that is shorter than a window counts only whole
    enough = F.when(F.col("p.whole") < WINDOW, F.size("p.part") == F.col("p.whole")).otherwise(F.size("p.part") >= WINDOW)
    return once.withColumn("n_matched", F.when(enough, verified(F.col("p.doc"), F.col("p.part"))).otherwise(0)).where("n_matched > 0")


def overlaps(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", broadcast_seeds: int = BROADCAST_SEEDS, shortest: int = SHORTEST) -> DataFrame:
    """doc_id, item_id, n_matched, n_item_words, first_word: one row for each contaminated pair.

    n_matched counts the agreeing words of the best alignment, first_word is the document's word where the item's first
    would lie (negative if the document begins within the item).
    """
    good = verified_hits(docs, items, doc_id, text, item_id, item_text, broadcast_seeds, shortest)
    best = good.groupBy("doc_id", "item_id").agg(F.max(F.struct("n_matched", "n_item_words", (-F.col("first_word")).alias("back"))).alias("b"))
    return best.select("doc_id", "item_id", F.col("b.n_matched").cast("int").alias("n_matched"), F.col("b.n_item_words").cast("int").alias("n_item_words"), (-F.col("b.back")).cast("int").alias("first_word"))


def remove_contaminated(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", broadcast_rows: int = BROADCAST_ROWS, **names) -> DataFrame:
    """The documents that share no passage with an item; their columns as they were.

    What is contaminated is written first; counted, it is broadcast if it is little, so that the documents stay where
    they are, else joined by a shuffle.
    """
    bad, key = private(docs, "bad", "key")
    hits = verified_hits(docs, items, doc_id, text, **names).select(F.col("doc_id").alias(bad), F.col("key").alias(key)).distinct()
    gone = saved(hits, "contaminated")
    few = gone.count() <= broadcast_rows
    return docs.join(F.broadcast(gone) if few else gone, F.col(doc_id).eqNullSafe(F.col(bad)) & (text_key(F.col(text)) == F.col(key)), "left_anti")
