import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from pagewright.llm import graph, media, queries, shards, token_counts
from pagewright.sources.shared import workspace

from .. import oracle
from .conftest import passage

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_matches_sql(spark, name):
    assert oracle.rows(queries.QUERIES[name](spark, SF).toPandas()) == oracle.rows(oracle.connect(SF).execute(queries.ORACLES[name]).df())


def test_components(spark):
    r = random.Random(7)
    links = [(r.randrange(200), r.randrange(200)) for _ in range(150)] + [(i, i + 1) for i in range(300, 340)]
    parent = {n: n for pair in links for n in pair}

    def root(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in links:
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    want = {n: root(n) for a, b in links if a != b for n in (a, b)}
    assert {x.node: x.label for x in graph.components(spark.createDataFrame(links, "a long, b long")).collect()} == want


# ---- token counts


def test_batches_are_idempotent(spark, awkward):
    docs = awkward.select("doc_id", "source", "lang", "text")
    rollup = token_counts.Rollup(spark, workspace(spark, "t"))
    assert rollup.totals().count() == 0
    assert rollup.commit("1", token_counts.changes(docs, "insert", "words-1"))
    once = sorted(map(str, rollup.totals().collect()))
    assert not rollup.commit("1", token_counts.changes(docs, "insert", "words-1"))
    assert rollup.commit("2", token_counts.changes(docs, "insert", "words-1"))  # known keys: revisions, nothing changes
    assert sorted(map(str, rollup.totals().collect())) == once
    assert rollup.commit("3", token_counts.changes(docs, "delete", "words-1"))
    assert rollup.totals().count() == 0 and rollup.state().count() == 0
    assert rollup.commit("4", token_counts.changes(docs, "delete", "words-1")) and rollup.totals().count() == 0
    rows = [(1, "v", "insert", 0, "s", "en", 5, 9), (1, "v", "revise", 1, "s", "de", 7, 9), (2, "v", "odd", 0, "s", "en", 1, 1), (3, "v", None, 0, "s", "en", 1, 1), (4, "v", "insert", 0, None, None, None, None)]
    change = spark.createDataFrame(rows, "doc_id long, tokenizer string, op string, seq long, source string, lang string, n_tokens long, n_chars long")
    rollup.commit("5", change)
    assert sorted((r.source or "", r.lang or "", r.n_docs, r.n_tokens, r.n_chars) for r in rollup.totals().collect()) == [("", "", 1, 0, 0), ("s", "de", 1, 7, 9)]
    for bad in ("", "a/b", "_x"):
        with pytest.raises(ValueError):
            rollup.commit(bad, change)


def test_few_buckets_are_read_and_history_is_compacted(spark, awkward):
    docs = awkward.select("doc_id", "source", "lang", "text")
    rollup = token_counts.Rollup(spark, workspace(spark, "t"), buckets=8)
    assert not rollup.compact()
    rollup.commit("1", token_counts.changes(docs, "insert", "words-1"))
    few = docs.where("doc_id in (3, 9)")
    rollup.commit("2", token_counts.changes(few, "revise", "words-1", text=F.lit("one two")))
    totals, state = sorted(map(str, rollup.totals().collect())), sorted(map(str, rollup.state().collect()))
    assert sum(r.n_tokens for r in rollup.state().where("doc_id in (3, 9)").collect()) == 4
    buckets = {r.bucket for r in rollup.state().select(rollup._bucket()).distinct().collect()}
    assert len(buckets) > 2 and len(rollup.state([0]).collect()) + len(rollup.state(list(range(1, 8))).collect()) == len(state)
    assert rollup.compact() and len(rollup._live()) == 1
    assert sorted(map(str, rollup.totals().collect())) == totals and sorted(map(str, rollup.state().collect())) == state
    assert not rollup.commit("2", token_counts.changes(few, "delete", "words-1"))  # known, though compacted
    assert rollup.commit("3", token_counts.changes(docs, "delete", "words-1")) and rollup.totals().count() == 0
    assert rollup.compact() and rollup.state().count() == 0 and rollup.totals().count() == 0


def test_the_slower_of_two_writers_is_not_read(spark, awkward):
    docs = awkward.select("doc_id", "source", "lang", "text")
    rollup = token_counts.Rollup(spark, workspace(spark, "t"))
    rollup._write("1-slow", token_counts.changes(docs, "insert", "words-1").select("doc_id", "tokenizer", "source", "lang", "n_tokens", "n_chars", F.lit(1).alias("sign")))
    assert rollup.commit("1", token_counts.changes(docs.where("doc_id = 0"), "insert", "words-1"))
    assert not rollup._seal("1", "1-slow") and rollup.state().count() == 1


def test_bpe_counts(spark, awkward, nothing):
    import public_tokenizers
    import tiktoken

    from pagewright.llm import bpe
    from pagewright.llm.queries import vocabulary

    encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(vocabulary()), special_tokens={})
    frame = awkward.withColumn("__text", F.col("text"))
    got = token_counts.with_bpe_counts(frame, vocabulary()).collect()
    assert len(got) == awkward.count() and all(r.n_tokens == len(encoding.encode_ordinary(r["__text"] or "")) for r in got)
    assert token_counts.with_bpe_counts(nothing, vocabulary()).count() == 0


def test_broken_attempt_is_overwritten(spark, awkward):
    docs = awkward.select("doc_id", "source", "lang", "text").where("doc_id < 5")
    path = workspace(spark, "t")
    rollup = token_counts.Rollup(spark, path)
    spark.range(3).write.parquet(f"{path}/batches/1-dead/ledger")  # what an attempt left that never committed
    rollup._fs.mkdirs(rollup._path(f"{path}/commits"))
    rollup._fs.create(rollup._path(f"{path}/commits/1"), False).close()  # and one that died while committing
    assert rollup.totals().count() == 0 and rollup.commit("1", token_counts.changes(docs, "insert", "words-1"))
    assert rollup.totals().agg(F.sum("n_docs")).first()[0] == 5


# ---- media


def test_media(spark, awkward, nothing):
    frame = awkward.where("doc_id is not null").withColumn("digest", F.lit("clash"))
    folder = workspace(spark, "m")
    out = media.stored_texts(frame, folder=folder).collect()
    texts = {r.doc_id: r.text for r in frame.collect()}
    assert len(out) == frame.count()
    for r in out:
        raw = (texts[r.doc_id] or "").encode()
        payload = raw.ljust(max(64, -(-len(raw) // 64) * 64), b"\0")
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert r.media_bytes == r.length and r.width == 64 and r.height * 64 == len(payload)
    assert len({(r.shard, r.offset) for r in out}) == len({r.media_sha256 for r in out})
    assert media.stored_texts(nothing).count() == 0


def test_payloads_of_many_rows(spark, monkeypatch):
    monkeypatch.setattr(media, "HOT_ROWS", 3)
    docs = spark.createDataFrame([(i, "same" if i < 20 else None if i < 30 else f"own {i}") for i in range(40)], "doc_id long, text string").repartition(5)
    out = media.stored_texts(docs).collect()
    want = {i: hashlib.sha256((b"same" if i < 20 else b"" if i < 30 else b"own %d" % i).ljust(64, b"\0")).hexdigest() for i in range(40)}
    assert {r.doc_id: r.payload_sha256 for r in out} == want and len(out) == 40
    assert media._uri("s3a://b/x") == "s3://b/x" and media._uri("dbfs:/x") == "file:///dbfs/x" and media._uri("/x") == "file:///x"


def test_tar_files_are_tar_files(spark, tmp_path):
    import tarfile

    shards_ = media.TarShards(str(tmp_path))
    body = media.to_png(media.pad(b"hello"))
    name, offset, length = shards_.add("d", body)
    shards_.close()
    raw = (tmp_path / name).read_bytes()
    with tarfile.open(tmp_path / name) as tar:
        assert tar.extractfile("d.png").read() == body
    assert raw[offset : offset + length] == body and media.from_png(body) == media.pad(b"hello")


# ---- shards


def brute_capacity(sizes, k):
    best = [[0] * (len(sizes) + 1)] + [[10**18] * (len(sizes) + 1) for _ in range(k)]
    best[0] = [0] + [10**18] * len(sizes)
    for j in range(1, k + 1):
        for n in range(len(sizes) + 1):
            best[j][n] = min(max(best[j - 1][m], sum(sizes[m:n])) for m in range(n + 1))
    return best[k][len(sizes)]


@pytest.mark.parametrize("seed", range(12))
def test_smallest_capacity(seed):
    r = random.Random(seed)
    sizes = [r.choice([1, 2, 3, 50]) for _ in range(r.randrange(1, 14))]
    k = r.randrange(1, 5)
    capacity = shards.smallest_capacity(sizes, k)
    assert capacity == brute_capacity(sizes, k)
    cuts = [0, *shards.even_cuts(sizes, k, capacity), len(sizes)]
    assert cuts == sorted(cuts) and max(sum(sizes[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)) <= capacity


@pytest.mark.parametrize("ranges", [4, 64])
def test_cuts_from_bounded_answers_are_exact(spark, ranges):
    r = random.Random(ranges)
    rows = sorted({r.randrange(-(2**63), 2**63): r.randrange(8, 5000) for _ in range(700)}.items())
    groups = spark.createDataFrame(rows, "h long, bytes long")
    cuts = shards.find_cuts(groups, 5, ranges)
    totals = [0] * 5
    for h, b in rows:
        totals[sum(h >= c for c in cuts)] += b
    assert max(totals) == shards.smallest_capacity([b for _, b in rows], 5)


def test_shards(spark, awkward, nothing):
    docs = awkward.withColumn("shard", F.lit("clash"))
    out = shards.assign(docs, 4, slot_rows=2).collect()
    assert len(out) == docs.count() and {r.law for r in out} == {"bytes"}
    for s in range(4):
        slots = sorted(r.slot for r in out if r.shard == s)
        assert slots == list(range(len(slots)))
    text = {r.doc_id: r.text or "" for r in docs.where("doc_id is not null").collect()}
    where = {}
    for r in out:
        if r.doc_id is not None:
            raw = text[r.doc_id].encode()
            assert (r["size"], r.text_crc32) == (len(raw) + 8, zlib.crc32(raw))
            assert where.setdefault(raw, r.shard) == r.shard
    assert shards.assign(nothing).count() == 0


# ---- pipeline


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    from pagewright.llm.queries import vocabulary

    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "ngram_jaccard", "suffix_array_dedup", "decontamination", "byte_bpe"]
    common = passage(40, 30)
    leak = passage(41, 30)
    rows = [(1, passage(50, 60)), (2, passage(50, 60)), (3, common + " " + passage(51, 60)), (4, passage(52, 60) + " " + common), (5, passage(53, 30) + " " + leak), (6, "12 34"), (7, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    folder = str(tmp_path)
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    step = spark.read.parquet(f"{folder}/documents.parquet")
    kept = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        step = stage(spark, step, folder)
        assert step.columns == docs.columns
        kept.append(sorted(r.doc_id for r in step.collect()))
    assert kept == [[1, 2, 3, 4, 5], [1, 3, 4, 5], [1, 3, 4, 5], [1, 3, 4]]
    assert common not in step.where("doc_id = 4").first().text and common in step.where("doc_id = 3").first().text
    out = corpus_pipeline.run(spark, folder)
    from pagewright.llm import bpe

    assert {r.doc_id: r.decoded for r in bpe.decode(out, vocabulary(), ids="token_ids").collect()} == {r.doc_id: r.text for r in step.collect()}
