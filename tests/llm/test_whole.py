"""Training-data operators do the whole job by the method they are described with."""

import numpy as np
from pyspark.sql import functions as F

from pagewright.llm import bpe, chat, decontaminate, jaccard, langid, quality, suffix_dedup
from pagewright.llm.queries import vocabulary

from .conftest import passage


def test_a_plain_text_goes_through_the_visitor(spark, monkeypatch):
    seen = []
    visit = chat._visit
    monkeypatch.setattr(chat, "_visit", lambda *a: seen.append(1) or visit(*a))
    rows = spark.createDataFrame([(1, 0, "user", "a <| \\ b"), (1, 1, "assistant", None), (1, 1, "assistant", "c")], "conv_id int, turn int, role string, text string")
    (r,) = chat.format_conversations(rows).collect()
    (p,) = chat.format_conversations(rows.withColumn("parts", chat.text_parts(F.col("text"))), parts="parts").collect()
    assert seen == [1, 1] and r == p
    assert r.formatted == "<|turn|>user<|body|>a <\\1 \\0 b<|end|>\n<|turn|>assistant<|body|><|end|>\n<|turn|>assistant<|body|>c<|end|>\n"
    assert r.attachments == [] and r.expanded_tokens == 0


def test_rows_that_share_an_id_are_decided_each(spark):
    item = passage(41, 13)
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    clean, bad = passage(42, 40), passage(43, 20) + " " + item
    near = passage(43, 20) + " " + " ".join(w if i % 3 else "other" for i, w in enumerate(item.split()))
    docs = spark.createDataFrame([(None, clean), (None, bad), (7, clean), (7, bad), (7, bad), (7, near), (8, None)], "doc_id long, text string")
    for few in (decontaminate.BROADCAST_SEEDS, 0):
        kept = decontaminate.remove_contaminated(docs, bench, broadcast_seeds=few).collect()
        want = [(None, clean), (7, clean), (7, near), (8, None)]
        assert sorted(map(repr, map(tuple, kept))) == sorted(map(repr, want))
        assert {(r.doc_id, r.item_id) for r in decontaminate.overlaps(docs, bench, broadcast_seeds=few).collect()} == {(None, 1), (7, 1)}


def test_counts_that_do_not_fit_rule_nothing_out():
    r = np.random.default_rng(6)
    common = r.integers(0, 1 << 40, 40_000, np.uint64) * np.uint64(256)  # all in one group
    a = np.unique(np.concatenate([common, common + np.uint64(1 << 60)]))
    b = a[: len(a) - 5]
    assert len(a) > 65_536 and jaccard.linked(a, b)
    label = jaccard.classes([jaccard.group_counts(x) for x in (a, b)], np.array([len(a), len(b)]), lambda i, j: jaccard.linked((a, b)[i], (a, b)[j]))
    assert label.tolist() == [0, 0]


def test_short_items_of_all_lengths_in_one_scan(spark):
    items = [(n, passage(60 + n, n)) for n in range(1, 13)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = spark.createDataFrame([(n, passage(80, 9) + " " + body + " " + passage(81, 9)) for n, body in items], "doc_id long, text string")
    for few in (decontaminate.BROADCAST_SEEDS, 0):
        found = decontaminate.overlaps(docs, bench, broadcast_seeds=few, shortest=1)
        assert {(r.doc_id, r.item_id) for r in found.collect()} == {(n, n) for n, _ in items}
    assert {r.item_id for r in decontaminate.overlaps(docs, bench).collect()} == set(range(decontaminate.SHORTEST, 13))
    few = decontaminate.remove_contaminated(docs, bench, broadcast_rows=0)
    assert sorted(r.doc_id for r in few.collect()) == [1, 2, 3, 4]


def test_user_columns_keep_their_values(spark):
    """Names that operators use inside may be names of the user's columns, in any case."""
    inner = ["__text", "__TEXT_", "__declared", "__gone", "__bad", "__key", "__a", "__b", "__c", "__d", "__id", "__ranges", "__flags", "___text", "__lang", "__share", "id", "y"]
    rows = [(1, passage(1, 60), "en", 1), (2, passage(1, 60), "de", 2), (3, passage(2, 60), "en", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, n_chars long")
    for i, name in enumerate(inner):
        docs = docs.withColumn(name, F.lit(i))
    bench = spark.createDataFrame([(1, passage(2, 20))], "item_id long, text string")
    labels = spark.createDataFrame([(1, 1), (3, 0)], "doc_id long, quality int")
    made = [
        langid.predict(docs, langid.fit(docs, F.lit(True))), quality.score(docs, quality.fit(docs, labels, F.lit(True))), bpe.encode(docs, vocabulary()),
        jaccard.keep_one(docs), decontaminate.remove_contaminated(docs, bench), suffix_dedup.remove_repeats(docs, n_chars="n_chars"),
    ]
    for frame in made:
        for r in frame.collect():
            assert [r[name] for name in inner] == list(range(len(inner)))
    assert [len(f.columns) - len(docs.columns) for f in made] == [2, 1, 1, 0, 0, 0]


def test_numbers_are_no_letters(spark):
    docs = spark.createDataFrame([(1, "the house and the dog", "en"), (2, "das haus und der hund", "de"), (3, "½ ² ①", None), (4, "½ the house ²", None)], "doc_id long, text string, lang string")
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.predict(docs, langid.fit(docs, F.lit(True))).collect()}
    assert got[3] == ("und", 0.0) and got[4][0] == "en"


def test_candidates_of_the_script_give_the_same_labels():
    """Narrowing the search, and giving up blocks where there are many languages, changes no label."""
    r = np.random.default_rng(3)
    for k in (2, 5, 12):
        lengths = r.integers(0, 30, 6)
        owner = np.repeat(np.arange(6), lengths)
        scores = r.normal(0, 4, (len(owner), k))
        allowed = r.random((len(owner), k)) < 0.5
        allowed |= ~allowed.any(axis=1, keepdims=True)
        scores[~allowed] -= 1e6
        own = langid.best_labels(scores, allowed, owner, 6, 3.0)
        assert (own == langid.viterbi(scores, owner, 6, 3.0, block=5)).all()


def test_long_samples_are_cut_to_their_bytes(spark):
    docs = spark.createDataFrame([(i, passage(i, 50), 0) for i in range(60)], "doc_id long, text string, n_chars long")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, quality int")
    assert quality.fit(docs, labels, F.lit(True), sample_bytes=8_000) is not None


def test_two_sets_alone_are_judged_like_many():
    r = np.random.default_rng(11)
    for _ in range(400):
        a = np.unique(r.integers(0, 1 << 62, r.integers(1, 300), np.uint64))
        b = np.unique(np.concatenate([a[: int(len(a) * r.uniform(0.7, 1))], r.integers(0, 1 << 62, r.integers(0, 1 + len(a) // 4), np.uint64)]))
        if not len(b):
            continue
        points, sizes = [jaccard.group_counts(x) for x in (a, b)], np.array([len(a), len(b)])
        both = jaccard.classes(points, sizes, lambda i, j: True).tolist() == [0, 0]
        alone = jaccard.pair_may_link(*points, len(a), len(b))
        assert alone or not jaccard.linked(a, b)
        assert not alone or both
